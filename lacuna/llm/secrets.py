"""Secret scans: spans per document, and how widely each value is owned over the whole corpus.

Every document is scanned once. What looks like a secret becomes a candidate: the values of the fixed
patterns and, besides them, long mixed strings of high entropy. A candidate leaves the scan as a hash
with its repository and owner. Candidates are aggregated by hash to the numbers of distinct owners and
distinct repositories, in steps that combine before each shuffle. A value that many owners hold is a copied example;
a value of few owners is live-looking, in however many repositories they copied it. A limit of repositories is an option,
per owner of the value, so that the class of a value never depends on the size of the corpus.

Fixed-pattern spans always stay. The method adds the span of a mixed string where its value is live-looking
and no fixed-pattern span covers it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import NO_ID, column_bytes, slices, stage

KINDS = ("assign", "access", "hex", "token")
#: A value held by more owners is a copied example.
MAX_OWNERS = 2
#: Length and bits per character from which a mixed string is a candidate.
MIN_LENGTH = 20
MIN_ENTROPY = 3.5

ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_IS_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_IS_TOKEN = bytes(120 if re.fullmatch(rb"[A-Za-z0-9+/_=-]", bytes([b])) else 32 for b in range(256))

_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("base", pa.bool_())])
_SPANS = "array<struct<kind:int,start:int,end:int,value:string,base:boolean>>"


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in map(text.count, set(text)))


def find(raw: bytes) -> list[tuple[int, int, int, str, bool]]:
    """(kind, start, end, value hash, base) by start and kind; positions are code points, ends are exclusive.

    Cheap byte tests decide which patterns a text can match at all.
    """
    low = raw.lower()
    assign = any(k in low for k in _KEYWORDS)
    access = b"AKIA" in raw
    hexes = b"x" * 24 in raw.translate(_IS_HEX)
    tokens = b"x" * MIN_LENGTH in raw.translate(_IS_TOKEN)
    if not (assign or access or hexes or tokens):
        return []
    text = raw.decode()
    found: list[tuple[int, int, int, str]] = []
    if assign:
        found += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if hexes:
        found += [(2, *m.span(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 24]
    base = len(found)
    if tokens:
        covered = sorted((s, e) for _, s, e, _ in found)
        at = 0
        for m in TOKEN.finditer(text):
            s, e = m.span()
            if e - s < MIN_LENGTH or not (re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])):
                continue
            while at < len(covered) and covered[at][1] <= s:
                at += 1
            if (at == len(covered) or covered[at][0] >= e) and entropy(m[0]) >= MIN_ENTROPY:
                found.append((3, s, e, m[0]))
    hashed = [(k, s, e, hashlib.sha256(v.encode()).hexdigest()[:32], n < base) for n, (k, s, e, v) in enumerate(found)]
    return sorted(hashed, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """(uid, id, thash, repo, owner, spans) per document row, stored; uid numbers the rows."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("thash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            spans = [[dict(zip(("kind", "start", "end", "value", "base"), x, strict=True)) for x in find(t)] for t in column_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "thash", "repo", "owner")), pa.array(spans, pa.list_(_SPAN))], names=["id", "thash", "repo", "owner", "spans"]
            )

    found = rows.mapInArrow(run, f"id long, thash long, repo string, owner string, spans {_SPANS}")
    return stage(found.withColumn("uid", F.monotonically_increasing_id()), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """(value, owners, repositories): exact distinct counts per candidate hash.

    A repository belongs to its owner: equal repository names of two owners are two repositories.
    """
    seen = scanned.select("repo", "owner", F.explode("spans.value").alias("value")).groupBy("value", "owner", "repo").agg(F.lit(1).alias("x"))
    per_owner = seen.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repositories: int | None = None,
) -> DataFrame:
    """(id, thash, spans) per document row; spans are structs (kind, start, end, value, base, live) by start and kind.

    ``value`` is a hash, never the secret. ``base`` marks fixed patterns, ``live`` owner-specific values; spans of
    copied mixed strings are left out. A null text is empty and has no spans; null repositories and owners count as one
    of their own. Where the table has no column for repositories, each document stands for one. ``max_repositories`` is a
    limit of repositories per owner of a value, none by default. Repeated rows give one row each; an empty table gives an empty result.
    """
    scanned = scan(docs, id_col, text_col, repo_col, owner_col)
    live = F.col("owners") <= max_owners
    if max_repositories is not None:
        live &= F.col("repositories") <= max_repositories * F.col("owners")
    judged = ownership(scanned).select("value", live.alias("live"))
    each = scanned.select("uid", F.posexplode("spans").alias("k", "x"))
    at = each.select("uid", "k", F.col("x.value").alias("value")).join(judged, "value").groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("k", "live"))).alias("lives")
    )
    joined = scanned.join(at, "uid", "left")

    def told(x: Column, k: Column) -> Column:
        return F.struct(
            F.element_at(F.array(*[F.lit(n) for n in KINDS]), x["kind"] + 1).alias("kind"),
            x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["base"].alias("base"),
            F.get("lives", k)["live"].alias("live"),
        )

    return joined.select("id", "thash", F.filter(F.transform("spans", told), lambda x: x["base"] | x["live"]).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span of ``secrets`` replaced by ``[kind]``; overlapping spans are replaced as one.

    All rows and columns stay, null texts too. Spans meet their document by id and text hash.
    """
    found = secrets(docs, id_col, text_col, **options).where(F.size("spans") > 0)
    spans = found.select(
        F.coalesce("id", F.lit(NO_ID)).alias("ord"),
        "thash",
        F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))).alias("spans"),
    ).dropDuplicates(["ord", "thash"])

    @F.pandas_udf("string")
    def rewritten(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else _rewritten(t, s) for t, s in zip(texts, spans, strict=True)])

    packed = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("ord"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("thash"),
    )
    joined = packed.join(spans, ["ord", "thash"], "left")
    text = F.when(F.col("spans").isNull(), F.col("row")[text_col]).otherwise(rewritten(F.col("row")[text_col], F.col("spans")))
    return joined.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def _rewritten(text: str, spans: Sequence) -> str:
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += [text[at : x["start"]], f"[{x['kind']}]"]
        at = max(at, x["end"])
    return "".join([*out, text[at:]])
