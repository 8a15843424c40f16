import tempfile

from hatefold.operators import lexicon as LX
from hatefold.operators.lexicon import prepare_matcher
from hatefold.streaming.chat_filter import MESSAGE_SCHEMA, filter_messages, run_chat_filter


def test_stream_equals_batch(spark):
    rows = [(1, i, "user", t) for i, t in enumerate(["  Trash talk  ", "", "fine", "trash trashs!", "\t", "clown"])]
    rows += [(2, i, "assistant", f"msg {i} trash") for i in range(20)]
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.createDataFrame(rows, MESSAGE_SCHEMA).repartition(3).write.parquet(f"{d}/src")
    lex = spark.createDataFrame([("trash", 0, ["trash", "trashs"], [], "profanity", []),
                                 ("clown", 1, ["clown"], [], "slur_a", [])], LX.LEXICON_SCHEMA)
    run_chat_filter(spark, f"{d}/src", lex, f"{d}/out", f"{d}/ckpt", max_files_per_trigger=1)
    cols = ["conv_id", "turn", "role", "n_chars", "n_matches", "flagged", "terms"]
    streamed = sorted(tuple(r) for r in spark.read.parquet(f"{d}/out").select(*cols).collect())
    batch = filter_messages(spark.read.parquet(f"{d}/src"), prepare_matcher(lex, counts_only=True))
    assert streamed == sorted(tuple(r) for r in batch.select(*cols).collect())
    by_turn = {(r[0], r[1]): r for r in streamed}
    assert (1, 1) not in by_turn and (1, 4) not in by_turn        # blank messages skipped
    assert by_turn[(1, 3)][4] == 3 and by_turn[(1, 3)][6] == "trash"  # trash, trash (inside trashs), trashs
    # re-running the finished query processes nothing new and leaves the output unchanged
    run_chat_filter(spark, f"{d}/src", lex, f"{d}/out", f"{d}/ckpt")
    assert spark.read.parquet(f"{d}/out").count() == len(streamed)


def test_scored_stream_equals_batch(spark):
    from pyspark.sql import functions as F
    from hatefold.operators import features as FE
    from hatefold.operators import train as TR
    rows = [(1, i, "user", t) for i, t in enumerate(["trash talk", "fine day", "you trash", "hello", "  "])]
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.createDataFrame(rows, MESSAGE_SCHEMA).repartition(2).write.parquet(f"{d}/src")
    train = spark.createDataFrame([(i, "trash " * (i % 2) + "word", i % 2 * 2, [i % 2] + [0] * 7) for i in range(20)],
                                  "doc_id long, text string, y_coarse int, y_fine array<int>")
    model = TR.fit_two_head(FE.hashed_features(train, dim=256), dim=256, iterations=5, checkpoint=False)
    lex = spark.createDataFrame([("trash", 0, ["trash"], [], "profanity", [])], LX.LEXICON_SCHEMA)
    run_chat_filter(spark, f"{d}/src", lex, f"{d}/out", f"{d}/ckpt", model=model)
    cols = ["conv_id", "turn", "n_matches", "terms", "coarse_pred", "fine_pred"]
    streamed = sorted(tuple(r) for r in spark.read.parquet(f"{d}/out").select(*cols).collect())
    batch = filter_messages(spark.read.parquet(f"{d}/src"), prepare_matcher(lex, counts_only=True), model=model)
    assert streamed == sorted(tuple(r) for r in batch.select(*cols).collect())
    assert len(streamed) == 4 and all(r[4] in ("clean", "offensive", "hate") for r in streamed)
