import csv
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import types as T

from hatefold.sources import io as IO
from hatefold.sources.splitting import quoted_records, count_of, split_json_object

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("u", T.StringType())])


@pytest.fixture(params=[150, 4000, 1 << 27])
def split_spark(spark, request):
    """Splits of some bytes, so that records cross one or more of their ends."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield spark
    for k, v in keep.items():
        spark.conf.set(k, v)


def _rows(n):
    random.seed(n)
    text = lambda: "".join(random.choice(["a", '"', "\n", ",", "\t", "é", " ", "x" * 40]) for _ in range(random.choice([0, 3, 30, 300])))
    return [(str(i), text(), random.choice(["u", ""])) for i in range(n)]


@pytest.mark.parametrize("sep", [",", "\t"])
def test_split_csv_gives_the_rows_of_multi_line(split_spark, sep):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for k in range(3):
        with open(f"{d}/{k}.csv", "w", newline="", encoding="utf-8-sig" if k == 1 else "utf-8") as f:
            w = csv.writer(f, delimiter=sep, lineterminator="\r\n" if k == 2 else "\n")
            w.writerows([["id", "te\nxt", "u"], *([r for r in _rows(40)] if k < 2 else [(str(i), "plain", "u") for i in range(9)])])
    read = IO.read_posts_csv if sep == "," else IO.read_tsv
    want, got = read(split_spark, d, SCHEMA), read(split_spark, d, SCHEMA, split=True)
    # multiLine keeps the carriage return of a record's end.
    want = [(r.id, r.text, r.u and r.u.rstrip("\r")) for r in want.collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == 89


def test_one_file_is_many_tasks(split_spark):
    if int(split_spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")) > 10_000:
        pytest.skip("one split")
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{d}/a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "text", "u"], *_rows(200)])
    records = quoted_records(split_spark, d, "\n", lambda v: count_of(v, '"')).collect()
    assert len(records) == 201 and len({r.split for r in records}) > 3
    assert len({(r.split, r.place) for r in records}) == 201


def test_unclosed_quotes_raise(split_spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{d}/a.csv", "w") as f:
        f.write('id,text,u\n1,"open,u\n' + "2,x,y\n" * 50)
    with pytest.raises(ValueError, match="unclosed"):
        IO.read_posts_csv(split_spark, d, SCHEMA, split=True)


def test_split_json_object(split_spark):
    random.seed(4)
    obj = {"".join(random.choice('ab",\\{}[]:\n é') for _ in range(random.randint(1, 30))) + str(i): random.choice([1, "x,y{", 2.5, None, "7"]) for i in range(300)}
    for text in (json.dumps(obj), json.dumps(obj, ensure_ascii=False, indent=2) + "\n"):
        path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/terms.json"
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        want = IO.read_term_freq(split_spark, path).collect()
        assert sorted(map(tuple, IO.read_term_freq(split_spark, path, split=True).collect()), key=lambda r: r[2]) == [tuple(r) for r in want]
        assert [r.term for r in want] == list(obj)


@pytest.mark.parametrize("text", ['{"a": 1', '["a", 2]', '{"a": 1, "b"}', '{"a": [1, 2]}', '{"a": {"x": 1}}', '{"a": 1}}', '{"a" 1}', '{"a": 1,}', '{"a": 1, , "b": 2}', '{"a": "x}', '"a": 1'])
def test_broken_objects_raise(spark, text):
    path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "bad.json")
    with open(path, "w") as f:
        f.write(text)
    with pytest.raises(Exception):  # noqa: B017 - Spark's own errors, by the place that finds it
        split_json_object(spark, path).collect()


def test_empty_object(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/none.json"
    for text in ("{}", " { \n} "):
        with open(path, "w") as f:
            f.write(text)
        assert split_json_object(spark, path).collect() == []
