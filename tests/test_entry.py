import __spark_entry__ as E

from conftest import SF_SMALL
from hatefold.plans.registry import all_oracle_sql, all_queries

ROWS_ONLY = {"two_head_flat", "two_head_hierarchical", "experiment_matrix", "batch_scoring",
             "baseline_classifier", "hyperparameter_sweep", "data_ablation", "chat_filter_stream_scored",
             "training_history"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["hate_label", "seed", "form", "n_docs", "n_matches"]
    assert df.count() >= 0


def test_every_query_has_oracle_or_is_rows_only():
    assert set(E.oracle_sql()) <= set(E.queries())
    qs, sql = all_queries(), all_oracle_sql()
    assert set(qs) - set(sql) == ROWS_ONLY


def test_sql_queries_run_at_smallest_scale(spark):
    import duckdb
    con = duckdb.connect()
    for t in ["documents", "labels", "embeddings", "events", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name in ["lexicon_hits_by_class", "fine_metrics", "split_assignment", "augmented_variants",
                 "early_stopping", "label_crosswalk"]:
        spark_rows = E.queries()[name](spark, SF_SMALL).count()
        duck_rows = len(con.sql(E.oracle_sql()[name]).fetchall())
        assert spark_rows == duck_rows, name
