"""Every registered query on the smallest tables: columns of the fixed results, whole tables, and the SQL oracles."""

import duckdb
import pytest

from tesserae.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_html_extract": ("pages", "page_id url text n_chars"),
    "op2_near_dedup": ("documents", "doc_id n_shingles component_id kept"),
    "op3_pii": ("documents", "doc_id n_email n_ip n_card n_phone base_sha256 spans"),
    "op4_quality_rules": ("documents", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
    "op5_packing": (None, "doc_id start length ids_crc32 doc_tokens sequence_id offset"),
    "op6_token_counts": ("documents", "doc_id n_bytes n_tokens over_limit"),
    "op7_url_filter": ("pages", "page_id host path rule verdict"),
    "op8_sentencepiece": ("documents", "doc_id n_ids ids_crc32 decoded_chars restored"),
    "op9_topk_search": (None, "query_id rank vec_id score"),
    "op10_toxicity": ("documents", "doc_id probability toxic kept"),
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    found = queries.QUERIES[name](spark, SF)
    table, columns = COLUMNS[name]
    assert set(columns.split()) <= set(found.columns)
    rows = found.toPandas()
    if table:
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(queries.ORACLES[name]).df()
        key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
        assert key(rows) == key(want)


def test_verdicts_are_not_all_alike(spark):
    """A query that decides nothing would still have rows."""
    for name, column in (("op10_toxicity", "toxic"), ("op4_quality_rules", "kept"), ("op2_near_dedup", "kept"), ("op7_url_filter", "verdict")):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().count() == 2
