from pyspark.sql import functions as F

from hatefold.operators import features as FE


def test_char_ngrams_code_points_and_newlines(spark):
    df = spark.createDataFrame([("ab\nc",), ("가😀나",), ("a",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(FE.char_ngrams(F.col("t"))).collect()]
    assert got[0] == ["ab", "b\n", "\nc", "ab\n", "b\nc"]
    assert got[1] == ["가😀", "😀나", "가😀나"]
    assert got[2:] == [[], [], []]


def test_hashed_features_counts(spark):
    df = spark.createDataFrame([(1, "abab")], "doc_id long, text string")
    v = FE.hashed_features(df, dim=1 << 10).first()["features"]
    assert sum(v.values) == 3 + 2  # 3 bigrams + 2 trigrams


def test_vocabulary_and_encoding(spark):
    terms = spark.createDataFrame([("b", 3), ("a", 3), ("c", 1), ("d", 1)], "term string, freq long")
    vocab = FE.term_vocabulary(terms, vocab_size=3)
    assert {r["term"]: r["token_id"] for r in vocab.collect()} == {"a": 2, "b": 3, "c": 4}
    docs = spark.createDataFrame([(1, "A b d c a"), (2, ""), (3, "b " * 10)], "doc_id long, text string")
    enc = {r["doc_id"]: (r["input_ids"], r["attention_mask"]) for r in FE.encode_text(docs, vocab, max_len=4).collect()}
    assert enc[1] == ([2, 3, 1, 4], [1, 1, 1, 1])      # truncated to 4, "d" unknown -> 1
    assert enc[2] == ([0, 0, 0, 0], [0, 0, 0, 0])      # padded
    assert enc[3] == ([3, 3, 3, 3], [1, 1, 1, 1])


def test_encoding_keeps_rows_that_share_an_id(spark):
    terms = spark.createDataFrame([("a", 2), ("b", 1)], "term string, freq long")
    vocab = FE.term_vocabulary(terms, vocab_size=2)
    docs = spark.createDataFrame([(7, "a a"), (7, "b"), (7, None), (None, "b a")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["input_ids"]) for r in FE.encode_text(docs, vocab, max_len=3).collect())
    assert got == [("7", [0, 0, 0]), ("7", [2, 2, 0]), ("7", [3, 0, 0]), ("None", [3, 2, 0])]


def test_hashed_features_equal_hashing_tf(spark, monkeypatch):
    from pyspark.ml.feature import HashingTF
    rows = [(1, "abab Straße ñ"), (2, "가😀나 a\nb"), (3, None), (4, ""), (5, "x"), (6, "😀😀😀😀"), (7, "q" * 5000), (None, "no id\u0000\uffff")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for cells in (FE.MAX_CELLS, 1):
        monkeypatch.setattr(FE, "MAX_CELLS", cells)
        for sizes in ((2, 3), (2,), (3,)):
            got, _ = FE.mllib_features(df, dim=1 << 12, sizes=sizes)
            tf = HashingTF(inputCol="g", outputCol="want", numFeatures=1 << 12)
            want = tf.transform(df.withColumn("g", FE.char_ngrams(F.col("text"), sizes)))
            assert {r["doc_id"]: r["features"] for r in got.collect()} == {r["doc_id"]: r["want"] for r in want.collect()}


def test_features_make_no_string_per_gram(spark):
    df = spark.createDataFrame([(1, "abab")], "doc_id long, text string")
    plan = FE.hashed_features(df)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan
