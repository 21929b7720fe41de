"""Chat formatting by schema fingerprints, in SQL functions only.

Records come as JSON text in one of many layouts. Each record's nested field paths are hashed; the
hash selects a declarative mapping, which turns the record into canonical (role, text) turns. A
template writes the turns with control strings that no turn can forge, and a loss mask marks the
assistants' texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import read_table

START, END = "<|im_start|>", "<|im_end|>"
#: Turns that are gathered before the blocks of a conversation meet.
BLOCK_TURNS = 64

#: Mappings: each step is ("field", path, role) for one turn, or ("list", path, role key, text key) for many.
#: Optional fields have layouts of their own, since the fingerprint covers all paths.
MAPPINGS: dict[str, tuple] = {
    "messages": (("list", "messages", "role", "content"),),
    "system_messages": (("field", "system", "system"), ("list", "messages", "role", "content")),
    "conversations": (("list", "conversations", "from", "value"),),
    "system_conversations": (("field", "system", "system"), ("list", "conversations", "from", "value")),
    "turns": (("list", "turns", "role", "text"),),
    "instruction": (("field", "instruction", "user"), ("field", "output", "assistant")),
    "instruction_input": (("field", "instruction", "user"), ("field", "input", "user"), ("field", "output", "assistant")),
    "prompt_completion": (("field", "prompt", "user"), ("field", "completion", "assistant")),
    "prompt_response": (("field", "prompt", "user"), ("field", "response", "assistant")),
    "system_prompt_response": (("field", "system", "system"), ("field", "prompt", "user"), ("field", "response", "assistant")),
    "question_answer": (("field", "question", "user"), ("field", "answer", "assistant")),
}
#: Names that layouts give to the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths_of(mapping: tuple) -> list[list[str]]:
    """The field paths of records of a mapping: with filled lists, and with empty ones."""
    filled, empty = set(), set()
    for step in mapping:
        filled.add(step[1])
        empty.add(step[1])
        if step[0] == "list":
            filled |= {f"{step[1]}[].{k}" for k in step[2:]}
    return [sorted(filled)] + ([sorted(empty)] if empty != filled else [])


def hash_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()


def schema_fingerprint(record: str) -> Column:
    """Hash of the sorted nested field paths of a JSON object in a string column; null for other text."""
    return F.expr(
        f"""
        transform(array(json_object_keys({record})), keys -> sha2(array_join(array_sort(array_distinct(flatten(transform(keys, k ->
            concat(array(k), coalesce(transform(array_distinct(flatten(transform(filter(
                from_json(if(left(ltrim(get_json_object({record}, concat('$.', k))), 1) = '[', get_json_object({record}, concat('$.', k)), null), 'array<map<string,string>>'),
                m -> m is not null), m -> map_keys(m)))), x -> concat(k, '[].', x)), cast(array() as array<string>))))))), '\\n'), 256))[0]
        """
    )


def _turns(record: str, mapping: tuple) -> Column:
    fields = ", ".join(f"`{s[1]}` string" if s[0] == "field" else f"`{s[1]}` array<struct<`{s[2]}`: string, `{s[3]}`: string>>" for s in mapping)
    parts = [
        f"array(named_struct('role', '{s[2]}', 'text', coalesce(r.`{s[1]}`, '')))"
        if s[0] == "field"
        else f"transform(coalesce(r.`{s[1]}`, array()), x -> named_struct('role', coalesce(x.`{s[2]}`, ''), 'text', coalesce(x.`{s[3]}`, '')))"
        for s in mapping
    ]
    return F.expr(f"transform(array(from_json({record}, '{fields}')), r -> concat({', '.join(parts)}))[0]")


def canonical_turns(record: str, print_: str) -> Column:
    """Turns (role, text) of a record by its fingerprint; null if no mapping has it."""
    out = None
    for mapping in MAPPINGS.values():
        known = F.col(print_).isin([hash_of(p) for p in paths_of(mapping)])
        out = F.when(known, _turns(record, mapping)) if out is None else out.when(known, _turns(record, mapping))
    names = ", ".join(f"'{k}', '{v}'" for k, v in ROLES.items())
    return F.transform(out, lambda x: F.struct(F.coalesce(F.expr(f"map({names})")[x["role"]], x["role"]).alias("role"), x["text"].alias("text")))


#: What a text must not contain raw: the template's own marks, and those of other usual templates.
_CONTROL = r"([<\\[])(?=\\||/?s>|/?INST\\]|</?SYS>>|end_of_turn>|start_of_turn>)"


def escaped(x: str) -> str:
    """SQL: a backslash into each control string; backslashes are doubled first."""
    return f"regexp_replace(replace({x}, '\\\\', '\\\\\\\\'), '{_CONTROL}', '$1\\\\\\\\')"


def unescaped(x: str) -> str:
    return f"regexp_replace({x}, '(?s)\\\\\\\\(.)', '$1')"


def formatted(turns: str) -> Column:
    """(text, loss): the formatted text, and for each assistant's text its turn, start in the turn and length."""
    role = "replace({0}, '\\n', '\\\\\\n')".format(escaped("t.role"))
    return F.expr(
        f"""
        transform(array(transform({turns}, t -> named_struct('head', concat('{START}', {role}, '\\n'), 'body', {escaped('t.text')}, 'loss', t.role = 'assistant'))),
        ts -> named_struct(
            'text', array_join(transform(ts, t -> concat(t.head, t.body, '{END}\\n')), ''),
            'loss', filter(transform(ts, (t, i) -> if(t.loss, named_struct('turn', i, 'start', length(t.head), 'length', length(t.body)), null)), x -> x is not null)))[0]
        """
    )


def parsed(text: str) -> Column:
    """The turns of a formatted text: the exact inverse of formatted()."""
    return F.expr(
        f"""
        transform(filter(split({text}, '(?=<\\\\|im_start\\\\|>)'), s -> s <> ''), s -> named_struct(
            'role', {unescaped("regexp_extract(s, '(?s)^<\\\\|im_start\\\\|>((?:[^\\\\\\\\\\n]|\\\\\\\\.)*+)\\n', 1)")},
            'text', {unescaped("regexp_extract(s, '(?s)^<\\\\|im_start\\\\|>(?:[^\\\\\\\\\\n]|\\\\\\\\.)*+\\n(.*)<\\\\|im_end\\\\|>\\n$', 1)")}))
        """
    )


def masked_texts(text: str, loss: str) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.expr(
        f"""
        transform(array(filter(split({text}, '(?=<\\\\|im_start\\\\|>)'), s -> s <> '')),
        ts -> transform({loss}, x -> {unescaped("substring(ts[x.turn], x.start + 1, x.length)")}))[0]
        """
    )


def format_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Adds schema_hash, turns, formatted and loss to records of JSON text.

    A record of an unknown layout, null or no JSON object keeps null turns, formatted and loss: it
    is returned, not guessed at. Null fields are empty texts; an empty list gives no turns and an
    empty formatted text. Columns of those names are replaced, all others stay.
    """
    clash = [c for c in records.columns if c.lower() in {"schema_hash", "turns", "formatted", "loss"}]
    out = records.drop(*clash).withColumn("schema_hash", schema_fingerprint(f"`{column}`"))
    out = out.withColumn("turns", canonical_turns(f"`{column}`", "schema_hash"))
    out = out.withColumn("_f", formatted("turns"))
    return out.withColumn("formatted", F.col("_f.text")).withColumn("loss", F.col("_f.loss")).drop("_f")


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to one JSON record of the messages layout for each conversation.

    Turns are in order of turn; equal turns in order of role, then text; a null turn comes first.
    They are gathered by blocks of turns first, so a long conversation's rows meet in few blocks.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    blocks = rows.groupBy("conv_id", F.floor(F.col("turn") / BLOCK_TURNS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("part")
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
    messages = F.expr("transform(flatten(parts.part), x -> named_struct('role', x.role, 'content', x.content))")
    return whole.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    more = spark.sql(
        "select -7L as conv_id, * from values (0L, 'user', '</s>[INST] ok [/INST]'), (1L, 'assistant', '</s>[INST] ok [/INST]') as t(turn, role, text)"
    )
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    out = format_records(records_of(conversations)).select("conv_id", "formatted", "loss")
    back = out.select("conv_id", "formatted", parsed("formatted").alias("read"), F.array_join(masked_texts("formatted", "loss"), "").alias("under"))
    return back.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(read, x -> concat(x.role, '\\n', x.text, '\\n')), '')"), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPES = r"length({0}) - length(replace({0}, '\', '')) + len(regexp_extract_all({0}, '<\||</?s>|\[/?INST\]|<</?SYS>>|<end_of_turn>|<start_of_turn>'))"
#: The query in DuckDB SQL: digests of the turns, and lengths with the escapes that the template adds.
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
             string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text) AS loss,
             CAST(sum({len(START) + len(END) + 2} + length(role) + length(text) + {_ESCAPES.format("role")} + {_ESCAPES.format("text")}) AS BIGINT) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t"""
