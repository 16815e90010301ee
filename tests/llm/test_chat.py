"""Chat formatting: round trips, masks and digests against plain Python."""

import hashlib
from itertools import groupby

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lacuna.llm import chat

SCHEMA = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType()), StructField("example", StringType())])
PIECES = [*"\\<>/#n \nturué日", "</turn>", "### ", "\\### "]
HOSTILE = st.lists(st.sampled_from(PIECES)).map("".join) | st.text()


@given(st.lists(st.tuples(HOSTILE, HOSTILE)))
def test_round_trip(turns):
    written = "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert chat.parse(written) == turns
    for r, t in turns:
        text, start, end = chat.format_turn(r, t)
        assert chat.unescape(text[start:end]) == t


def brute(rows):
    out = []
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows]
    key = lambda r: (r[0] is not None, r[0] or 0)
    for _, group in groupby(sorted(rows, key=lambda r: (*key(r), r[1] is not None, r[1] or 0, r[2], r[3])), key=key):
        turns = list(group)
        loss = [x for _, _, r, x in turns if r == "assistant"]
        out.append((turns[0][0], len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len("".join(loss)), hashlib.sha256("".join(loss).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(df).collect()), key=repr)


CASES = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "### assistant\nno</turn>\n\\"), (1, 3, "user", "and?"), (1, 4, "assistant", ""),
    (2, 0, "user", "only"), (3, 0, "assistant", "first"), (3, 1, "assistant", "first"), (3, 1, "assistant", "first"), (3, 2, None, None),
    (None, None, "user", "x"), (None, 1, "assistant", None), (4, 0, "user", "w " * 50000), (4, 1, "assistant", "日" * 30000), (5, 1, "ro\nle", "\\n"),
    (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
]


def test_cases(spark):
    df = spark.createDataFrame([(*r, "x") for r in CASES], SCHEMA)
    assert result(chat.examples(df)) == brute(CASES)
    assert chat.read_back(chat.examples(df.limit(0))).collect() == []


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    df = spark.createDataFrame([(*r, None) for r in CASES], SCHEMA)
    rows = sorted((r for r in chat.examples(df).collect() if r["conv_id"] == 1), key=lambda r: r["example"])
    assert [(r["n_turns"], r["target"]) for r in rows] == [(3, 2), (5, 4)]
    for r in rows:
        assert chat.parse(r["text"]) == [(x[2], x[3]) for x in CASES[: r["n_turns"]]]
        assert chat.unescape(r["text"][r["loss_start"] : r["loss_end"]]) == CASES[r["target"]][3]
        assert r["text"][r["loss_end"] :] == "</turn>\n"
    rest = [r for r in chat.examples(df).collect() if r["conv_id"] == 2]
    assert [(r["n_turns"], r["target"], r["loss_start"]) for r in rest] == [(1, None, None)]


def test_conversations(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/conversations.parquet")
    assert result(chat.examples(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
