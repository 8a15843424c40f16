"""Plan regressions: properties of the physical plans the scale design relies on."""

import re

import __spark_entry__ as E

from conftest import SF_MID


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(spark, name):
    df = E.queries()[name](spark, SF_MID)
    return df, _plan(df)


def test_matching_is_row_local_and_not_pushed_below_the_join(spark):
    df, plan = _formatted(spark, "augmented_variants")
    # one broadcast exchange (labels), no shuffle of documents
    assert "Exchange hashpartitioning" not in plan
    # the scan-side filter of documents must not evaluate the matcher
    scan_filters = re.findall(r"Filter \((.*)", plan)
    assert all("regexp_extract_all" not in f for f in scan_filters)


def test_flagship_partial_aggregation_before_shuffle(spark):
    df, plan = _formatted(spark, "lexicon_hits_by_class")
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_count" in plan and "partial_sum" in plan


def test_term_mining_combines_map_side(spark):
    df, plan = _formatted(spark, "term_frequencies")
    assert "partial_count" in plan


def test_fine_metrics_single_aggregation(spark):
    df, plan = _formatted(spark, "fine_metrics")
    assert plan.count("Exchange") == 1  # one single-partition exchange of partial sums


def _final_plan(df):
    df.collect()
    return _plan(df).split("== Initial Plan ==")[0]


def test_split_is_one_pass_with_a_broadcast_of_cuts(spark):
    plan = _final_plan(E.queries()["split_assignment"](spark, SF_MID))
    # labels and cuts are broadcast; rows are neither ranked nor shuffled
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan and "Union" not in plan


def test_early_stopping_is_one_shuffle_of_the_history(spark):
    plan = _final_plan(E.queries()["early_stopping"](spark, SF_MID))
    assert plan.count("Window [") == 2 and plan.count("Scan parquet") == 1
    assert plan.count("Exchange hashpartitioning") <= 2


def test_metric_bundles_read_the_scores_once(spark):
    for name in ("coarse_metrics", "baseline_metrics"):
        plan = _final_plan(E.queries()[name](spark, SF_MID))
        assert plan.count("Scan parquet") == 1, name


def test_column_pruning_reaches_the_scan(spark):
    df = E.queries()["fine_metrics"](spark, SF_MID)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<embedding:array<float>>" in plan or "struct<embedding:array<float>" in plan


def test_training_source_prunes_partitions(spark):
    import tempfile
    from hatefold.operators import labels as L
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = spark.createDataFrame([(1, "a", "main"), (2, "b", "aux"), (3, "c", "main")],
                               "doc_id long, text string, source string")
    df.write.partitionBy("source").parquet(d + "/corpus")
    sel = L.training_source(spark.read.parquet(d + "/corpus"), "main_only")
    plan = _plan(sel)
    assert "PartitionFilters: [isnotnull(source" in plan and "main" in plan.split("PartitionFilters")[1]
    assert sorted(r["doc_id"] for r in sel.collect()) == [1, 3]
