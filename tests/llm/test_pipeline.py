"""The pipeline's stages against plain versions on a small table."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_near_dedup import WORD, classes  # noqa: E402

from folioscope.llm import bpe, pii  # noqa: E402

DIR = "/root/testdata/sf0.001"


def windows(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = docs.limit(1).selectExpr("1000000 AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars").unionByName(docs.limit(1).selectExpr("1000001 AS doc_id", "'Write to a.b@example.com or call +1 (706) 555-3138 now.' AS text", "lang", "source", "n_chars"))
    docs = docs.unionByName(extra.withColumn("doc_id", extra.doc_id.cast("long")))
    steps = dict(corpus_pipeline.STAGES)
    rows = {}
    for name in ("quality", "near_dedup", "decontaminate", "pii", "bpe"):
        docs = steps[name](spark, docs, DIR)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    of = [(d, q) for d, q in labels.items()]
    assert sum((d in rows["quality"]) == bool(q) for d, q in of) / len(of) > 0.95
    was = [(d, r.text) for d, r in rows["quality"].items()]
    assert set(rows["near_dedup"]) == {c for _, c in classes(was)}
    items = [windows(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    known = set().union(*items)
    assert set(rows["decontaminate"]) == {d for d, r in rows["near_dedup"].items() if not windows(r.text) & known}
    for d, r in rows["pii"].items():
        assert (r.text is None) == (rows["decontaminate"][d].text is None)
        assert not pii.base_spans(r.text or "") and r.n_chars == (None if r.text is None else len(r.text))
    assert rows["pii"][1000001].text == "Write to <EMAIL> or call <PHONE> now."
    enc = bpe.encoder(bpe.vocabulary())
    assert set(rows["bpe"]) == set(rows["pii"])
    for d, r in rows["bpe"].items():
        assert list(r.ids) == enc.encode(rows["pii"][d].text or "") and r.n_tokens == len(r.ids) and r.decoded == enc.decode(r.ids)
