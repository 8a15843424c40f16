import os
import tempfile

from pyspark.sql import types as T

from hatefold.operators import lexicon as LX
from hatefold.sources import io as IO

SCHEMA = T.StructType([T.StructField("문장", T.StringType()), T.StructField("clean", T.IntegerType()),
                       T.StructField("기타 혐오", T.IntegerType())])


def _write(path, text, bom=True):
    with open(path, "wb") as f:
        f.write((b"\xef\xbb\xbf" if bom else b"") + text.encode("utf-8"))


def test_csv_bom_quoted_header_newline_and_quotes(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    p = os.path.join(d, "a.csv")
    _write(p, '"문장",clean,"기타 혐오"\n"첫 줄\n둘째 줄",1,0\n"그가 ""안녕"" 했다",0,1\n')
    rows = IO.read_posts_csv(spark, p, SCHEMA).collect()
    assert [tuple(r) for r in rows] == [("첫 줄\n둘째 줄", 1, 0), ('그가 "안녕" 했다', 0, 1)]


def test_tsv_and_convert(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    p = os.path.join(d, "a.tsv")
    _write(p, "문장\tclean\t기타 혐오\n안녕\t1\t0\n\"탭\t포함\"\t0\t1\n", bom=False)
    out = IO.convert_tsv(spark, p, os.path.join(d, "pq"), SCHEMA)
    assert sorted(tuple(r) for r in out.collect()) == [("안녕", 1, 0), ("탭\t포함", 0, 1)]


def test_csv_write_read_roundtrip_keeps_whitespace(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = spark.createDataFrame([("  앞뒤 공백  ", 1, 0), ("줄\n바꿈, 쉼표", 0, 1)], SCHEMA)
    IO.write_table(df, os.path.join(d, "o"), "csv")
    back = IO.read_posts_csv(spark, os.path.join(d, "o"), SCHEMA)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_read_term_freq_object(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    p = os.path.join(d, "auto_seed.json")
    _write(p, '{"병신": 5, " 씨발 ": "7", "개새끼": "many", "미친": 2.9}', bom=False)
    got = [tuple(r) for r in IO.read_term_freq(spark, p).orderBy("pos").collect()]
    assert got == [("병신", 5, 0), (" 씨발 ", 7, 1), ("개새끼", 1, 2), ("미친", 2, 3)]


def test_read_lexicon_object_and_default(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    p = os.path.join(d, "merged.json")
    _write(p, '{"시발": {"canonical": ["시발", "씨발"], "jamo": ["ㅅㅂ"], "type": "profanity", "targets": []},'
              ' "병신": {"canonical": ["병신"], "jamo": [], "type": "slur_disability", "targets": ["장애"]}}',
           bom=False)
    lex = IO.read_lexicon(spark, p).orderBy("seed_ord").collect()
    assert [(r["seed"], r["seed_ord"], r["canonical"], r["type"]) for r in lex] == [
        ("시발", 0, ["시발", "씨발"], "profanity"), ("병신", 1, ["병신"], "slur_disability")]
    default = spark.createDataFrame([("a", 0, ["a"], [], "profanity", [])], LX.LEXICON_SCHEMA)
    assert IO.read_lexicon(spark, os.path.join(d, "missing"), default).count() == 1
    out = os.path.join(d, "lex_out")
    IO.write_lexicon(IO.read_lexicon(spark, p), out)
    assert IO.read_lexicon(spark, out).count() == 2
