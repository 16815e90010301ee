"""Every query of the package against its SQL on a small table, and its columns."""

import pytest

from lacuna.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

COLUMNS = {
    "op1_substrings": "doc_id n_words n_removed kept_sha256",
    "op2_sentencepiece": "doc_id n_tokens ids decoded_sha256",
    "op3_quality": "doc_id held_out score predicted",
    "op4_secrets": "doc_id n_assign n_access n_hex base_sha256 spans n_live",
    "op5_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op6_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op9_simhash": "doc_id fingerprint component_id",
    "op10_topk": "query_id rank vec_id score",
    "op13_maintext": "page_id url text n_chars",
    "op12_lexical": "item_id rank doc_id score",
    "op11_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
}


def test_names():
    assert list(QUERIES) == sorted(COLUMNS, key=lambda n: int(n[2:].split("_")[0]))


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    assert df.columns == COLUMNS[name].split()
    if name in ORACLES:
        with connect(sf_small) as con:
            assert differences(df, con, ORACLES[name]) is None
    else:
        assert df.count() == spark.read.parquet(f"{sf_small}/documents.parquet").count()
