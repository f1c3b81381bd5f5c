"""The registered queries: their columns, and those with an oracle against it."""

import oracle
import pytest
from odd_rows import SMALL

from townhall.llm.oracles import ORACLES
from townhall.llm.queries import QUERIES

COLUMNS = {
    "op1_kd_shards": "doc_id size text_crc32 law shard slot grown_shard", "op2_simhash": "doc_id fingerprint component_id",
    "op3_webp": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op4_langid": "doc_id held_out lang_pred score",
    "op5_secrets_ledger": "doc_id n_assign n_access n_hex base_sha256 spans", "op6_quality": "doc_id held_out score predicted",
    "op7_cube_mix": "doc_id size source_size target taken", "op8_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_decontaminate": "doc_id item_id score", "op10_warc": "page_id kind record_id refers_to record",
    "op11_source_audit": "lang source part item value rank",
    "op12_spelling": "word form root n n_near form_n",
    "op13_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, key):
    assert oracle.compare(spark, oracle.connect(SMALL), key, QUERIES, ORACLES, SMALL) is None


def test_columns(spark):
    assert sorted(QUERIES) == sorted(COLUMNS)
    for key in ("op3_webp", "op5_secrets_ledger", "op8_suffix_dedup", "op9_decontaminate", "op10_warc"):
        assert set(COLUMNS[key].split()) <= set(QUERIES[key](spark, SMALL).columns)
