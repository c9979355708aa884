"""Text queries against their DuckDB statements, and their columns and types."""

import duckdb
import pytest

from runout.llm.oracles import ORACLES
from runout.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"

CONTRACT = {
    "op1_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_token_blocks": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_packing": "doc_id bigint, n_tokens bigint, bin bigint, capacity int",
    "op8_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint",
    "op13_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
    "identity_error double",
}


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = QUERIES[name](spark, SMALL)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(names).collect()), key=repr) == want


@pytest.mark.parametrize("name", list(QUERIES))
def test_columns(spark, name):
    kinds = dict(QUERIES[name](spark, SMALL).dtypes)
    for column in CONTRACT[name].split(", "):
        column, kind = column.split(" ")
        assert kinds[column] == kind
