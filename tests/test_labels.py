import pytest
from pyspark.sql import functions as F

from hatefold.operators import labels as L
from hatefold.plans import fixed_values as FV


def test_default_crosswalk_and_collapse(spark):
    rows = [(1, "혐오발언", "여성"), (2, "혐오발언", "기타 혐오"), (3, "혐오발언", "모름"), (4, "단순 악플", None),
            (5, "None", "x"), (6, "일반 댓글", None), (7, "애매", "여성"), (8, "혐오발언", "종교")]
    df = spark.createDataFrame(rows, "id long, macrolabel string, microlabel string")
    out = L.crosswalk_labels(df, L.mapping_frame(spark), FV.MULTI_HOT_LABELS)
    out = L.collapse_labels(out)
    got = {r["id"]: ([r[c] for c in FV.MULTI_HOT_LABELS], r["labels"]) for r in out.collect()}
    onehot = lambda c: [int(x == c) for x in FV.MULTI_HOT_LABELS]
    assert got[1] == (onehot("여성/가족"), 2)
    assert got[2] == (onehot("기타혐오"), 9)
    assert got[3] == ([0] * 10, 0)          # unmatched micro -> all zeros -> clean id
    assert got[4] == (onehot("악플/욕설"), 1)
    assert got[5] == (onehot("clean"), 0)   # literal "None" is clean
    assert got[6] == (onehot("clean"), 0)
    assert got[7] == ([0] * 10, 0)          # unknown macro
    assert got[8] == (onehot("종교"), 8)


def test_collapse_priority_missing_and_existing(spark):
    df = spark.createDataFrame([(1, 1, 1), (0, 0, 1)], "`악플/욕설` int, `남성` int, clean int")
    assert [r["labels"] for r in L.collapse_labels(df).collect()] == [3, 0]
    pre = spark.createDataFrame([(7,)], "labels int")
    assert L.collapse_labels(pre).first()["labels"] == 7


def test_harmonize_add_missing_project(spark):
    df = spark.createDataFrame([("t", 1)], "`문장` string, `기타 혐오` int")
    df = L.add_missing_labels(L.harmonize_columns(df), FV.MULTI_HOT_LABELS)
    out = L.project_corpus(df, "문장", FV.MULTI_HOT_LABELS, "main_train").first()
    assert out["기타혐오"] == 1 and out["clean"] == 0 and out["source"] == "main_train"


def test_coarse_encode_strict_and_pack(spark):
    df = spark.createDataFrame([("hate",), ("clean",)], "hate_label string")
    assert [r[0] for r in df.select(L.coarse_encode(F.col("hate_label"))).collect()] == [2, 0]
    bad = spark.createDataFrame([("weird",)], "hate_label string")
    with pytest.raises(Exception):
        bad.select(L.coarse_encode(F.col("hate_label"))).collect()


def test_training_source_and_skip_blank(spark):
    df = spark.createDataFrame([("main",), ("aux",)], "source string")
    assert L.training_source(df, "main_only").count() == 1
    assert L.training_source(df, "combined").count() == 2
    with pytest.raises(ValueError):
        L.training_source(df, "other")
    t = spark.createDataFrame([("　 hi \t",), ("  ",), ("\n",)], "text string")
    assert [r[0] for r in L.skip_blank(t).collect()] == ["hi"]


def test_class_filter_without_column(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert L.class_filter(df, ["hate"]).count() == 1


def test_crosswalk_counts_repeated_rows_once_and_rejects_conflicts(spark):
    df = spark.createDataFrame([(1, "m", "u"), (2, "m", "x")], "id long, macrolabel string, microlabel string")
    twice = L.mapping_frame(spark, [("m", "u", "a"), ("m", "u", "a"), ("m", None, "b"), ("m", None, "b")])
    got = {r["id"]: (r["a"], r["b"]) for r in L.crosswalk_labels(df, twice, ["a", "b"]).collect()}
    assert got == {1: (1, 0), 2: (0, 1)}
    for rows in ([("m", "u", "a"), ("m", "u", "b")], [("m", None, "a"), ("m", None, "b")]):
        with pytest.raises(Exception, match="conflicting crosswalk targets"):
            L.crosswalk_labels(df, L.mapping_frame(spark, rows), ["a", "b"]).collect()
