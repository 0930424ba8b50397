"""The registered queries of this part: names, columns and, where there is SQL, the same rows."""

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from chatterlake.llm import queries
from check import TABLES, normalise

COLUMNS = {
    "op1_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op2_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op7_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op8_quality": ["doc_id", "held_out", "score", "predicted"],
    "op9_repetition_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op11_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op12_matched_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op13_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}
LONG = {"n_words", "n_base", "first_word", "last_word", "n_shingles", "component_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
        "n_tokens", "n_known", "train_tokens", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_removed", "n_spans"}


def test_registered():
    assert set(queries.registered()) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.registered()) == list(range(1, 14))
    assert set(queries.statements()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    types = dict(queries.registered()[name](spark, DATA).dtypes)
    assert set(COLUMNS[name]) <= set(types)
    assert all(types[c] == "bigint" for c in COLUMNS[name] if c in LONG)


@pytest.mark.parametrize("name", sorted(queries.statements()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = queries.registered()[name](spark, DATA).toPandas(), con.execute(queries.statements()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normalise(got) == normalise(want)
