import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from tablemill.llm import common, decontaminate, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, monkeypatch):
    """Each stage is held against a plain version on what the stage before it kept."""
    model = toxicity.Network({}, seed=1)
    model.shift = -50.0
    monkeypatch.setattr(toxicity, "learned", lambda docs, labels: model)
    docs = common.read_table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    bench = common.read_table(spark, SF, "benchmark")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, SF))
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert after == before
        elif name == "minhash_near_dedup":
            assert after == {i: before[i] for i, (_, c) in brute.near(before).items() if i == c}
        elif name == "substring_dedup":
            assert set(after) == set(before) and sum(map(len, after.values())) <= sum(map(len, before.values()))
        elif name == "benchmark_decontamination":
            rows = spark.createDataFrame(list(before.items()), "doc_id long, text string")
            assert set(before) - set(after) == {r.doc_id for r in decontaminate.contaminated(rows, bench).collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        before = after
    assert docs.columns[: len(columns)] == columns and {"n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(docs.columns)
    assert all(r.n_tokens == len(r.ids) for r in docs.collect())


def test_empty_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "learned", lambda docs, labels: toxicity.Network({}, seed=1))
    docs = common.read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF))
    assert docs.count() == 0
