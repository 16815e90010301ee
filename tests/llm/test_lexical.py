"""Ranked lexical search against every score in Python integers."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lacuna.llm import lexical

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("score", IntegerType()), StructField("n", IntegerType())])
ITEMS = StructType([StructField("item_id", StringType()), StructField("text", StringType()), StructField("id", IntegerType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def brute(docs, items, k=10):
    split = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, length = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(w for _, c in split for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in split:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            score = 0
            for w in set(words(text)):
                if c[w]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)


@pytest.mark.parametrize("document_block, block_words", [(8192, 500_000), (7, 500_000), (64, 40)])
def test_against_all_scores(spark, document_block, block_words):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(120)]
    text = lambda most: " ".join(vocabulary[int(120 * rng.random() ** 3)] for _ in range(rng.randint(1, most)))
    docs = [(i, text(60)) for i in range(250)]
    docs += [(300 + i, docs[9][1]) for i in range(40)] + [(400 + i, "the W1 " * i) for i in range(8)]
    # some items with more than 64 and more than 128 distinct terms
    items = [(f"q{j}", text(20)) for j in range(12)] + [("long", " ".join(vocabulary[:90])), ("all", " ".join([*vocabulary, *(f"x{k}" for k in range(40))]))]
    d, i = frames(spark, docs, items)
    want = brute(docs, items)
    assert result(lexical.search(d, i, document_block=document_block, block_words=block_words)) == want


def test_terms_of_a_crowded_block(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 3)
    docs = [(i, " ".join(f"a{k}" for k in range(i))) for i in range(12)]
    d, i = frames(spark, docs, [("q", "a1 a3 a9 a11")])
    assert result(lexical.search(d.coalesce(1), i)) == brute(docs, [("q", "a1 a3 a9 a11")])


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, "... !!"), (4, "Été É9 naïve"), (4, "Été É9 naïve"), (None, "alpha beta"), (5, "alpha beta"), (6, "ALPHA\nbeta\tbeta"),
        (7, "long " * 50_000 + "alpha"), (8, "everywhere"), (9, "everywhere alpha"),
    ]
    items = [("a", "alpha, alpha. BETA"), ("a", "alpha, alpha. BETA"), ("b", None), ("c", "?"), (None, "naïve É9"), ("d", "absent"), ("e", "long everywhere")]
    d, i = frames(spark, docs, items)
    want = brute(docs, items)
    assert len(want) > 10 and result(lexical.search(d, i)) == want
    assert result(lexical.search(d, i, k=2)) == brute(docs, items, 2)
    assert lexical.search(d.limit(0), i).collect() == lexical.search(d, i.limit(0)).collect() == []
    assert lexical.search(d.where("doc_id < 4"), i).collect() == []


def test_groups_are_left_out_once_the_bound_is_below(spark):
    """A block of many weak groups is not scored once ten documents are better."""
    d, i = frames(spark, [(k, "rare common") for k in range(20)] + [(100 + k, f"common x{k}") for k in range(500)], [("q", "rare common")])
    got = result(lexical.search(d, i))
    assert sorted(r[2] for r in got) == list(range(10))
