"""The flagship does the whole job: no terms are left out."""

from conftest import compare

from textloom.plans import catalog


def test_flagship_holds_all_terms(spark):
    """Against the SQL of its pairs with the operator's own prune, tf > 3."""
    sql = f"""{catalog._pairs_sql(catalog._COUNTS, "3", catalog._DECAY)}, r AS (SELECT *, row_number() OVER (PARTITION BY target_word ORDER BY round(similarity, 6) DESC, sim_word) AS rank FROM sim WHERE similarity >= 0.55)
SELECT target_word, sim_word, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 50"""
    compare(spark, "c3_sparse_topk", catalog.c3_sparse_topk, sql)
