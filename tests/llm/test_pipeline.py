"""The pipeline against its stages redone in plain Python on what each stage was given."""

import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lacuna.llm import decontaminate, quality, secrets  # noqa: E402
from tests.llm.test_decontaminate import brute  # noqa: E402
from tests.llm.test_near_copies import brute_kept  # noqa: E402


def test_stages(spark, sf_small):
    read = lambda name: spark.read.parquet(f"{sf_small}/{name}.parquet")
    docs = read("documents")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    x, model = quality.learned(docs, read("labels"))
    predicted = {r["id"]: r["predicted"] for r in quality.apply(x, model).collect()}
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    stages = dict(corpus_pipeline.STAGES)

    out = stages["quality"](spark, docs, sf_small)
    assert out.columns == columns
    texts = {i: t for i, t in texts.items() if predicted[i]}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == texts

    out = stages["near_duplicates"](spark, out, sf_small)
    texts = {i: texts[i] for i in brute_kept(texts)}
    assert out.columns == columns and out.count() == len(texts)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == texts

    out = stages["decontamination"](spark, out, sf_small)
    known = {i: set(decontaminate.words_of(t.encode())) for i, t in items}
    texts = {
        i: t
        for i, t in texts.items()
        if not brute(t, [(k, x) for k, x in items if known[k] & set(decontaminate.words_of(t.encode()))])[1]
    }
    assert out.columns == columns and {r["doc_id"]: r["text"] for r in out.collect()} == texts

    before = out
    out = stages["secrets"](spark, out, sf_small)
    spans = {r["id"]: r["spans"] for r in secrets.secrets(before).collect()}
    texts = {i: secrets._rewritten(t, spans[i]) for i, t in texts.items()}
    assert out.columns == columns and {r["doc_id"]: r["text"] for r in out.collect()} == texts
    assert {r["doc_id"]: r["n_chars"] for r in out.collect()} == {i: len(t) for i, t in texts.items()}

    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf_small).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_empty(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_small)
        assert out.count() == 0
        docs = out
