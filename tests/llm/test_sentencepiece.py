"""Lattice encoding against the SentencePiece library with the same piece table declared as a unigram model."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lacuna.llm import sentencepiece as ours

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("ids", StringType())])


@pytest.fixture(scope="module")
def model():
    return ours.load_model(ours.default_model_path())


def best_score(text, model):
    """Highest total score, position by position."""
    s, low, longest = ours.normalise(text), model.unknown_score, model.longest
    best = [0.0] + [float("-inf")] * len(s)
    for e in range(1, len(s) + 1):
        for a in range(max(0, e - longest), e):
            piece = s[a:e]
            if piece in model.pieces:
                best[e] = max(best[e], best[a] + model.pieces[piece][1])
            elif a == e - 1:
                best[e] = max(best[e], best[a] + low)
    return best[-1]


_BY_ID: dict = {}


def score_of(ids, text, model):
    by_id = _BY_ID or _BY_ID.update((k, (p, s)) for p, (k, s) in model.pieces.items()) or _BY_ID
    total, raw = 0.0, b""
    for k in ids:
        raw += model.surface[k]
        if k in by_id:
            total += by_id[k][1]
    unknown = [c for c in ours.normalise(text) if c not in model.pieces]
    return total + len(unknown) * model.unknown_score if raw else total


TEXTS = [
    "Hello world", "The quick brown fox jumps over the lazy dog", "  two  blanks ", "\n\ttabs\r\nlines\n", "é日本 😀 ñandú straße",
    "a" * 700, "ab" * 3000 + " tail", "x", " ", "", None, "▁ already", "don't stop; re-run: a/b_c", "1234567890" * 60,
    "con\x01trol \x01\x01 \x02 \x7f", "\x01",
]


def test_best_score_and_round_trip(spark, model):
    rng = random.Random(5)
    texts = [*TEXTS, "".join(rng.choice("abcdeïñ日\n -.") for _ in range(4000)), "".join(rng.choice("etaoin") for _ in range(3000))]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA)
    encoded = ours.encode(df, model, block_bytes=2000)
    rows = {r["id"]: r for r in encoded.collect()}
    back = {r["id"]: r["text"] for r in ours.decode(encoded, model).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        t = t or ""
        assert back[k] == t.replace("▁", " ")
        assert rows[k]["decoded_sha256"] == hashlib.sha256(back[k].encode()).hexdigest()
        assert rows[k]["n_tokens"] == len(rows[k]["ids"])
        assert score_of(rows[k]["ids"], t, model) == pytest.approx(best_score(t, model), rel=1e-12)


def unigram_library(path):
    """The library with the model type of the file set to unigram (field 3 of the trainer section)."""
    raw = open(path, "rb").read()
    at = raw.rindex(b"\x18\x02 \x80\xfa\x01")
    return sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2 :])


def test_never_below_the_library(spark, sf_small, model):
    """Total scores of whole documents: equal to a position-by-position search, at least those of the library.

    The library adds in single precision, so a few of its paths fall short.
    """
    library = unigram_library(ours.default_model_path())
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(60)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {r["id"]: r["ids"] for r in ours.encode(docs, model).collect()}
    assert len(rows) == len(texts)
    for i, text in texts.items():
        assert score_of(rows[i], text, model) == pytest.approx(best_score(text, model), rel=1e-12)
        assert score_of(rows[i], text, model) >= score_of(library.encode(text), text, model)


def test_odd_rows(spark, model):
    rows = [(1, "same text", "a"), (1, "same text", "b"), (None, "null id", None), (2, None, None)]
    got = ours.encode(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert sorted(((r["id"], r["n_tokens"] > 0) for r in got), key=repr) == [(1, True), (1, True), (2, False), (None, True)]
    assert ours.encode(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_long_words(spark, model):
    """Words far beyond a chunk, also mixed with short ones, in a text without blanks and with runs of blanks."""
    rng = random.Random(9)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(100_000))
    texts = [
        letters, f"short {letters[:129]} words {letters[:128]} " + letters[:127], " " * 400 + "indent", "日本語" * 200, "é" * 129,
        letters[:1000] + " " + letters[:1000] + " tail", "-" * 500 + "x" * 300 + "9" * 300, "▁" * 300 + letters[:200],
    ]
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], SCHEMA)
    rows = {r["id"]: r for r in ours.encode(df, model).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert ours.decode_ids(rows[k]["ids"], model) == t.replace("▁", " ")
        assert score_of(rows[k]["ids"], t, model) == pytest.approx(best_score(t, model), rel=1e-9)


def test_chunks_and_whole_words_agree(spark, model):
    """The same ids, ties included, whichever way a word takes."""
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choice("abcdeïñ日-") for _ in range(n)) for n in (1, 2, 127, 128, 129, 255, 256, 257, 700)]
    df = spark.createDataFrame([(0, w, [1]) for w in words], "part long, word string, blocks array<long>")
    whole = {r["word"]: r["ids"] for r in ours.segment(df, model).collect()}
    assert {r["word"]: r["ids"] for r in ours.segment_long(df, model).collect()} == whole


def plain_ids(word, model):
    """Position by position; a tie goes to the longer last piece."""
    best = [(0.0, 0, 0)]
    for e in range(1, len(word) + 1):
        found = None
        for s in range(max(0, e - model.longest), e):
            k, w = model.pieces.get(word[s:e], (-ord(word[s]), model.unknown_score) if s == e - 1 else (None, 0.0))
            if k is not None and (found is None or best[s][0] + w > found[0]):
                found = (best[s][0] + w, s, k)
        best.append(found)
    ids, at = [], len(word)
    while at:
        ids.append(best[at][2])
        at = best[at][1]
    return ids[::-1]


def test_ties_and_unknown_characters(spark):
    """Whole numbers as scores, so that many segmentations are equally good."""
    scores = {"▁": -1, "a": -2, "b": -2, "ab": -4, "ba": -3, "aab": -6, "bb": -3, "abab": -7, "▁a": -3, "c": -5}
    pieces = {p: (k, float(w)) for k, (p, w) in enumerate(scores.items())}
    tied = ours.Model(pieces, tuple(range(256)), tuple(b"" for _ in pieces), "\n\r\t")
    rng = random.Random(11)
    words = {"▁" * rng.randint(0, 1) + "".join(rng.choice("aaabbbcé") for _ in range(rng.choice([1, 3, 9, 40, 300]))) for _ in range(150)}
    df = spark.createDataFrame([(0, w, [1]) for w in words], "part long, word string, blocks array<long>")
    want = {w: plain_ids(w, tied) for w in words}
    assert {r["word"]: r["ids"] for r in ours.segment(df, tied).collect()} == want
    assert {r["word"]: r["ids"] for r in ours.segment_long(df, tied).collect()} == want


class Counting:
    def __init__(self, pattern):
        self.pattern, self.calls = pattern, 0

    def findall(self, text):
        self.calls += 1
        return self.pattern.findall(text)


def test_units_are_cut_by_one_search(model):
    """Not one search per distinct unit and text, which took half of the operator's seconds in Python."""
    pattern = Counting(ours.word_pattern(model))
    texts = [" ".join(f"w{k},x{j}." for k in range(40)) for j in range(50)]
    units = ours._units([*texts, *(t or "" for t in TEXTS)], pattern)
    irregular = sum(not ours._regular(t or "") for t in TEXTS)
    assert pattern.calls == 1 + irregular
    words = units.words.to_pylist()
    for k, t in enumerate([*texts, *(t or "" for t in TEXTS)]):
        of_text = units.unit_of[units.text_at[k] : units.text_at[k + 1]]
        got = [words[w] for u in of_text for w in units.word_of[units.unit_at[u] : units.unit_at[u + 1]]]
        assert got == pattern.pattern.findall(ours.normalise(t))


def test_totals_build_no_structure_per_edge(spark, model):
    """Structures and arrays made anew in every interpreted step took half of the lattice's seconds."""
    df = spark.createDataFrame([(0, "word", [1])], "part long, word string, blocks array<long>")
    plan = ours.segment(df, model)._jdf.queryExecution().optimizedPlan().toString()
    folds = [x.split(" AS totals")[0] for x in plan.split("aggregate(") if x.startswith("edges") and " AS totals" in x]
    assert folds and not any("struct(" in x for x in folds)
