"""License scans against plain Python: phrase places and set containment of every line with every template."""

import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

from lacuna.llm import licenses

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("labels", StringType())])


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = words(text)
    places = sorted((k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
    found = {}
    for line in (text or "").split("\n"):
        have = set(words(line))
        for name, template in licenses.TEMPLATES.items():
            want = set(words(template))
            share = len(have & want) / len(want)
            if share >= 0.8 - 1e-12:
                found[name] = max(found.get(name, 0), share)
    return len(w), places, sorted(found), max(found.values(), default=0.0)


def result(df):
    return sorted(((r["id"], r["n_words"], sorted((p["start"], p["label"]) for p in r["places"]), r["templates"], r["contained"]) for r in df.collect()), key=repr)


T = licenses.TEMPLATES
CASES = [
    (1, "Released under the MIT License.", "x"), (2, "MIT licenſe, mit LICENSE; Apache-License general public license", None), (3, None, None), (4, "", None),
    (5, "é\n" + T["mit-permission"] + "\n" + T["gpl-header"].upper() + "\nrest", None), (5, "license license", None), (5, "license license", None),
    (None, " ".join(T["bsd-conditions"].split()[:13]), None), (6, " ".join(T["apache-2.0-header"].split()[5:]), "q"), (7, "the of and to " * 30000 + "\n" + T["apache-2.0-notice"], None),
    (8, "public license\nmit\nlicense", None), (9, "\n\n ,, \n", None), (10, "Released under the Kindly-K license", None), (11, "general license public license x mit license", None),
]


def test_cases(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    assert result(licenses.licenses(df)) == sorted(((i, *brute(t)) for i, t, _ in CASES), key=repr)
    assert licenses.licenses(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = licenses.licenses(spark.createDataFrame(CASES, SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet".replace("sf0.001", "sf0.01"))
    want = sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=repr)
    assert result(licenses.licenses(docs)) == want
    assert any(r[2] for r in want) and any(r[3] for r in want)
