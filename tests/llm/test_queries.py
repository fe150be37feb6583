"""The registered queries over the smallest test set: contract columns, one row a document, and the SQL where there is one."""

from collections import Counter

import duckdb
import pytest

from lumenrec.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id",
    "op2_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op3_toxicity": "doc_id held_out score predicted",
    "op4_best_fit_packing": "doc_id part start n_words bin_id position bin_words",
    "op5_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op8_url_filters": "page_id host path rule verdict",
    "op9_embedding_dedup": "vec_id n_links component_id kept",
    "op10_quality": "doc_id held_out score predicted",
    "op11_centroid_clustering": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op12_language_id": "doc_id held_out lang_pred score",
    "op13_source_divergence": "lang source part item value rank",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert set(COLUMNS[name].split()) <= set(df.columns)
    table, key = ("pages", "page_id") if name.startswith("op8") else ("embeddings", "vec_id") if name.startswith(("op9", "op11")) else ("documents", "doc_id")
    ids = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    assert name.startswith("op13") or sorted(r[key] for r in rows if name != "op4_best_fit_packing" or r.part == 0) == sorted(ids)
    if name in SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        got = con.execute(SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert Counter(tuple(r[n] for n in names) for r in rows) == Counter(got.fetchall())
