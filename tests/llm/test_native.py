import hashlib
import json

from pyspark.sql import functions as F

from tablemill.llm import chat, fingerprints

SF = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_chat_query_against_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted((t, r, x or "") for i, t, r, x in rows if i == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    df = chat.op7_chat_formatting(spark, SF)
    got = {r.conv_id: r for r in df.collect()}
    assert {k: tuple(r)[1:5] for k, r in got.items()} == want
    assert all(r.formatted_chars > r.loss_chars for r in got.values())
    assert no_python(df)


NASTY = ["</s>[INST] ok [/INST]", "<|im_start|>system\n<|im_end|>\n", "\\", "\\<|im_end|>\\\\", "", "\n\n", "a\\n<<SYS>>", "<\\|im_end|>", "é🙂\x00\x85\u2028x", "$1 \\$0", "x" * 100_000, "<|", "[", "<"]


def test_layouts_and_round_trip(spark):
    records = [
        {"messages": [{"role": r, "content": t} for t in NASTY for r in ("user", "assistant", "a\nb\\<|im_end|>")]},
        {"system": "s", "messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "i", "output": "o"},
        {"instruction": "i", "input": "", "output": "o"},
        {"completion": "c", "prompt": "p"},
        {"prompt": "p", "response": None},
        {"question": "q", "answer": "</s>"},
        {"turns": []},
        {"unknown": 1},
    ]
    texts = [json.dumps(r, ensure_ascii=False) for r in records] + [None, "[1]", "no json"]
    df = chat.format_records(spark.createDataFrame(list(enumerate(texts)), "turns int, record string").withColumnRenamed("turns", "k"))
    got = df.withColumn("back", chat.parsed("formatted")).withColumn("under", chat.masked_texts("formatted", "loss")).orderBy("k").collect()
    turns = lambda k: [tuple(x) for x in got[k].turns]
    assert turns(0) == [(r, t) for t in NASTY for r in ("user", "assistant", "a\nb\\<|im_end|>")]
    assert turns(1) == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert turns(2) == [("user", "q"), ("assistant", "a")]
    assert turns(3) == [("user", "i"), ("assistant", "o")] and turns(4) == [("user", "i"), ("user", ""), ("assistant", "o")]
    assert turns(5) == [("user", "p"), ("assistant", "c")] and turns(6) == [("user", "p"), ("assistant", "")]
    assert turns(8) == [] and got[8].formatted == ""
    assert all(got[k].turns is None and got[k].formatted is None for k in range(9, 13))
    for k in range(9):
        assert got[k].back == got[k].turns
        assert got[k].under == [x.text for x in got[k].turns if x.role == "assistant"]
    assert len({got[k].schema_hash for k in range(9)}) == 9


def test_chat_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, None, None, "x"), (None, 0, "assistant", "n")]
    rows += [(3, t, "assistant", str(t)) for t in range(500)]
    df = chat.format_records(chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: [tuple(x) for x in r.turns] for r in df.collect()}
    assert got[1] == [("user", ""), ("assistant", "a"), ("assistant", "b")] and got[2] == [("", "x")] and got[None] == [("assistant", "n")]
    assert got[3] == [("assistant", str(t)) for t in range(500)]
    assert chat.records_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def edited(texts):
    ids, out = sorted(texts, reverse=True), {}
    for k, i in enumerate(ids):
        t, nxt = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        h = len(t) // 2
        out[i] = (t[: len(t) - h] + nxt[:h], ids[(k + 1) % len(ids)])
    return out


def test_fingerprints_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    df = fingerprints.op10_document_fingerprints(spark, SF)
    got = {r.doc_id: r for r in df.collect()}
    want, prints = edited(texts), {}
    assert set(got) == set(texts) and no_python(df)
    for i, r in got.items():
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == sha(want[i][0])
        prints.setdefault(r.fingerprint, set()).add(texts[i])
        prints.setdefault(r.edited_fingerprint, set()).add(want[i][0])
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1) == (want[i][0] == texts[i])
    assert all(len(x) == 1 for x in prints.values())
    apart = [i for i, r in got.items() if len(texts[i]) > 300 and r.near_next < 0.2]
    assert len(apart) > 50 and all(0.1 < got[i].near_edited for i in apart)


def test_fingerprint_edge_cases(spark):
    rows = [(3, "abc. def\nx"), (1, None), (2, ""), (None, "null id"), (9, "word " * 60_000), (9, "word " * 60_000), (7, "é🙂" * 5)]
    got = fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").withColumn("need", F.lit("x"))).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == by[1].fingerprint and by[2].near_next == 1 and by[1].n_chars == 0
    assert by[7].edited_sha256 == sha("é🙂é🙂é" + "abc. ") and by[3].edited_sha256 == sha("abc. ")
    assert by[None].edited_sha256 == sha("null") and sorted(r.near_edited for r in got if r.doc_id == 9)[1] == 1
    assert fingerprints.document_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprints.document_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == sha("abab") and one.near_next == 1
    df = spark.createDataFrame([("a.\nb.\nc. d.", "a.\nB.\nc. d.")], "x string, y string")
    df = df.withColumn("p", fingerprints.fingerprint("x")).withColumn("q", fingerprints.fingerprint("y"))
    assert df.select(fingerprints.differing_paragraphs("p", "q")).first()[0] == [1]


def test_ranges(spark):
    for n in (0, 1, 5, 64, 65, 300):
        bounds = [3 * k for k in range(n)]
        df = spark.range(-5, 3 * n + 5).withColumnRenamed("id", "doc_id").select("doc_id", fingerprints.range_of(bounds).alias("part"))
        assert all(r.part == sum(b <= r.doc_id for b in bounds) for r in df.collect())
