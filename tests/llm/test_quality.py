"""Quality classifier: held-out accuracy, prior, and that neither held-out labels nor negatives are learned."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lacuna.llm import quality

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("score", StringType())])
LABELS = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])


@pytest.fixture(scope="module")
def tables(spark, sf_small):
    d = sf_small.replace("sf0.001", "sf0.1")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = quality.scored(docs, labels).toPandas()
    assert len(got) == docs.count()
    assert list(got.held_out) == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.id]
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.5)).all()
    both = got.merge(labels.toPandas(), left_on="id", right_on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.97
    pos, neg = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.99


def test_only_usable_positives_are_learned(spark, tables, monkeypatch):
    docs, labels = tables
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u: seen.append((len(p), len(u))))
    quality.scored(docs, labels)
    usable = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1 and quality = 1").count()
    free = docs.join(labels, "doc_id", "left_anti").where(~quality.held_out(F.col("doc_id"))).count()
    assert seen == [(usable, free)]


def test_bounded_sample(tables):
    docs, labels = tables
    x, _ = quality.learned(docs, labels)
    n = x.count()
    some = quality._sample(x, 500)
    assert abs(len(some) - 500) < 150 and n > 5000
    assert (some == quality._sample(x, 500)).all() and len(quality._sample(x, n)) == n


def test_prior():
    rng = np.random.default_rng(2)
    p = rng.normal(2, 1, 8000)
    u = np.concatenate([rng.normal(2, 1, 9000), rng.normal(-2, 1, 3000)])
    assert quality.estimate_prior(p, u) == pytest.approx(0.75, abs=0.04)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "fine words here", "a"), (3, "a " * 40000, "b"), (3, "b", "b")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (2, None, 0), (None, 1, 1)], LABELS)
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    assert [r["held_out"] for r in got if r["id"] is None] == [True]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (1, 1, 0)], LABELS)
    assert len(quality.scored(docs, labels).collect()) == len(rows)
    assert quality.scored(docs.limit(0), labels).collect() == []
    assert len(quality.scored(docs, labels.limit(0)).collect()) == len(rows)


def test_nothing_passes_unjudged(spark):
    docs = spark.createDataFrame([(1, "a text", 9), (None, None, 9), (2, "b", 9), (2, "b", 9)], "doc_id long, text string, id int")
    labels = spark.createDataFrame([], "doc_id long, quality int, text string")
    with pytest.raises(ValueError, match="classifier needs"):
        quality.accepted(docs, labels)
    assert quality.accepted(docs.limit(0), labels).collect() == []
