"""Secret scans against direct regular expressions and counts in plain Python."""

import re
from collections import defaultdict

from pyspark.sql.types import LongType, StringType, StructField, StructType

from lacuna.llm import secrets

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType()), StructField("spans", StringType())])
ACCESS = "AKIA" + "Q" * 16
HEX = "0123456789abcdef0123456789"
MIXED = "Zx9Kd83nvQpLw02mTbYc6"
OTHER = "Rt5Yh77uJmNbVc43xZaQ1"


def brute_base(text):
    text = text or ""
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def told(spans, only=lambda x: True):
    return [f"{x['kind']}:{x['start']}:{x['end']}" for x in spans if only(x)]


CASES = [
    (1, f"é password = 'hunter2x' {ACCESS} {HEX}", "a", None), (2, f"PassWd:{HEX}", "a", None), (3, None, "b", None), (4, "", None, None),
    (5, "api_key=token:longvalue token==abc123 secret=abc", "b", "x"), (6, f"日本 {MIXED} and {OTHER}", "a", None), (7, f"{MIXED}", "b", None),
    (8, f"x {MIXED}", "c", None), (8, f"x {MIXED}", "c", None), (None, f"{OTHER}", None, None), (9, "AKIA123 " + "f" * 23 + " toKen=abcdefgh", "c", None),
    (10, "w " * 50000 + ACCESS, "d", None),
]


def test_cases(spark):
    rows = secrets.secrets(spark.createDataFrame(CASES, SCHEMA)).collect()
    assert len(rows) == len(CASES)
    got = sorted(((r["id"], told(r["spans"], lambda x: x["base"])) for r in rows), key=repr)
    assert got == sorted(((i, brute_base(t)) for i, t, _, _ in CASES), key=repr)
    added = {r["id"]: told(r["spans"], lambda x: not x["base"]) for r in rows}
    assert added[6] == [f"token:{3 + len(MIXED) + 5}:{3 + len(MIXED) + 5 + len(OTHER)}"]  # three owners hold the first
    assert added[None] == [f"token:0:{len(OTHER)}"]
    assert not added[7] and not added[8]
    assert secrets.secrets(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents_and_ownership(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet".replace("sf0.001", "sf0.01"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = secrets.secrets(docs).collect()
    assert {r["id"]: told(r["spans"], lambda x: x["base"]) for r in got} == {i: brute_base(r["text"]) for i, r in rows.items()}
    owners, repos = defaultdict(set), defaultdict(set)
    for i, r in rows.items():
        for x in secrets.find(r["text"].encode()):
            owners[x[3]].add(r["source"])
            repos[x[3]].add(i)
    counts = {r["value"]: (r["owners"], r["repositories"]) for r in secrets.ownership(secrets.scan(docs, "doc_id", "text", "doc_id", "source")).collect()}
    assert counts == {v: (len(owners[v]), len(repos[v])) for v in owners} and counts
    for r in got:
        for x in r["spans"]:
            assert x["live"] == (len(owners[x["value"]]) <= 2)


def test_redacted(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    out = secrets.redacted(df)
    assert out.columns == df.columns
    rows = [r.asDict() for r in out.collect()]
    assert len(rows) == len(CASES)
    by_id = {r["doc_id"]: r["text"] for r in rows}
    assert by_id[1] == "é [assign]' [access] [hex]"  # the closing quote is no part of the match
    assert by_id[2] == "[assign]"
    assert by_id[3] is None and by_id[4] == "" and by_id[7] == MIXED and by_id[None] == "[token]"


def test_an_owner_may_copy_its_own_secret(spark):
    """The class of a value does not change with the number of documents of one owner that hold it."""
    for n in (100, 101, 5000):
        docs = spark.range(n).selectExpr("id AS doc_id", f"concat('key {MIXED} in ', id) AS text", "'me' AS source")
        found = secrets.secrets(docs).selectExpr("size(spans) AS k").groupBy("k").count().collect()
        assert [(r["k"], r["count"]) for r in found] == [(1, n)]
        assert secrets.secrets(docs, max_repositories=100).where("size(spans) > 0").count() == (n if n <= 100 else 0)
