import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_passages import plain as plain_passages

import corpus_pipeline
from tablemill.llm import common, decontaminate, toxicity

SF = "/root/testdata/sf0.001"
#: Names that the stages use inside.
CLASH = ["n_tokens", "_gone_id", "_gone_id_", "gone_id", "gone_parts", "_sieve_word", "_sieve_bits", "kept", "key", "id", "first_doc", "component", "score", "label", "at", "stop", "island"]


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.learned(*(common.read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels")))


def test_trained_stages_against_plain_versions(spark, monkeypatch, model):
    """The network as it is trained; every stage on what the one before it kept."""
    monkeypatch.setattr(toxicity, "learned", lambda docs, labels: model)
    docs, bench = common.read_table(spark, SF, "documents"), common.read_table(spark, SF, "benchmark")
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in common.read_table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF))
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            scores = toxicity.Scorer(model).many([before[i].encode() for i in sorted(before)])
            assert set(after) == {i for i, s in zip(sorted(before), scores) if s < toxicity.THRESHOLD}
            gone = set(before) - set(after)
            assert gone and sum(labels.get(i, 0) for i in gone) > 0.5 * sum(i in labels for i in gone)
        elif name == "minhash_near_dedup":
            assert after == {i: before[i] for i, (_, c) in brute.near(before).items() if i == c}
        elif name == "substring_dedup":
            gone = {i: {k for a, n in found for k in range(a, a + n)} for (i, kept), found in plain_passages(before).items() if not kept}
            assert set(after) == set(before) and gone
            for i in before:
                assert brute.words(after[i]) == [w for k, w in enumerate(brute.words(before[i])) if k not in gone.get(i, ())]
        elif name == "benchmark_decontamination":
            rows = spark.createDataFrame(list(before.items()), "doc_id long, text string")
            assert set(before) - set(after) == {r.doc_id for r in decontaminate.contaminated(rows, bench).collect()}
        else:
            assert after == before
        before = after


def test_stages_with_clashing_columns_nulls_and_repeats(spark, monkeypatch, model):
    monkeypatch.setattr(toxicity, "learned", lambda docs, labels: model)
    plain = common.read_table(spark, SF, "documents")
    few = plain.orderBy("doc_id").limit(60)
    odd = few.union(few.limit(3)).union(few.limit(2).withColumn("text", F.lit(None).cast("string"))).union(few.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    wide = odd.withColumns({c: F.lit(k) for k, c in enumerate(CLASH)})
    for name, stage in corpus_pipeline.STAGES:
        odd, wide = common.written(stage(spark, odd, SF)), common.written(stage(spark, wide, SF))
        rows = lambda df: sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=str)
        assert rows(odd) == rows(wide), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert odd.columns == plain.columns and wide.columns == plain.columns + CLASH
    assert set(wide.columns) == {*plain.columns, *CLASH, "ids", "ids_sha256", "decoded_sha256"}


def test_run_leaves_its_result_only(spark, monkeypatch, model):
    monkeypatch.setattr(toxicity, "learned", lambda docs, labels: model)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and common._OPEN == []
    place = spark.conf.get("spark.checkpoint.dir")
    left = {p.name for p in Path(place.removeprefix("file://")).iterdir()} if Path(place.removeprefix("file://")).exists() else set()
    own = Path(out._tablemill_path).name
    before = left - {own}
    again = corpus_pipeline.run(spark, SF)
    left = {p.name for p in Path(place.removeprefix("file://")).iterdir()}
    assert left == before | {own, Path(again._tablemill_path).name}
