import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestar.functions import tokens
from lodestar.operators import words
from lodestar.plans import spread
from lodestar.sources import lines_from, read_lines


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("a b ", ["a", "b"]),
        ("", [""]),
        ("   ", []),
        (" a  b", ["", "a", "", "b"]),
        ("a\tb c  ", ["a\tb", "c"]),
        ("A a", ["A", "a"]),
    ],
)
def test_tokens(spark, line, expected):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(tokens(F.col("line")).alias("t")).first()["t"] == expected


LINES = ["a b a", "", "b  c ", "   ", "a" * 5 + " b"]
COUNTS = [("", 2), ("a", 2), ("aaaaa", 1), ("b", 3), ("c", 1)]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(line,) for line in LINES], "line string")


def test_four_counts_agree(lines):
    assert rows(words.word_count(lines)) == COUNTS
    for salt in ("map", "group"):
        assert rows(words.word_count_salted(lines, 3, seed=1, salt=salt)) == COUNTS
    assert rows(words.word_count_by_partition(lines)) == COUNTS
    assert rows(words.word_count_by_partition(lines, 3)) == COUNTS


def test_summary(lines):
    counts = words.word_count(lines)
    assert words.doc_count(lines).first()[0] == 5
    assert words.distinct_words(counts).first()[0] == 5
    assert words.avg_word_length(counts).first()[0] == (0 + 1 + 5 + 1 + 1) // 5
    assert words.avg_word_length(counts.limit(0)).first()[0] is None


def test_hot_word(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("w"), F.col("id"))).alias("line"))
    for counts in (words.word_count(many), words.word_count_salted(many)):
        assert counts.orderBy(F.desc("n")).first()["n"] == 1000
        assert counts.count() == 2001


def test_arguments(lines):
    with pytest.raises(ValueError):
        words.word_count_salted(lines, 0)
    with pytest.raises(ValueError):
        words.word_count_salted(lines, salt="other")
    with pytest.raises(ValueError):
        words.word_count_by_partition(lines, 0)


@pytest.mark.parametrize("text", ["a\nb", "a\nb\n", "a\r\nb\r\n", "a\rb", "a\n\nb", "\n", "\n\n", "x"])
def test_lines_of_column_and_file_agree(spark, tmp_path, text):
    (tmp_path / "doc.txt").write_bytes(text.encode())
    from_column = lines_from(spark.createDataFrame([(text,)], "text string"), "text")
    from_file = read_lines(spark, str(tmp_path / "doc.txt"))
    assert [r[0] for r in from_column.collect()] == [r[0] for r in from_file.collect()]


def test_empty_text_has_no_line(spark):
    assert lines_from(spark.createDataFrame([("",)], "text string"), "text").count() == 0


def test_spread(spark):
    small = spark.range(0, 100, 1, 2)
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 50)
    assert spread(wide) is wide


def test_errors_are_pyspark(spark):
    with pytest.raises(PySparkException):
        read_lines(spark, "/nonexistent/path").count()


@pytest.mark.parametrize("salt", ["map", "group"])
def test_equal_lines_use_all_salts_evenly(spark, salt):
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("line"))
    groups = words.salted_words(many, 8, 42, salt).agg(F.count("*").alias("n")).collect()
    assert len(groups) == 8
    assert all(1000 / 16 <= g["n"] <= 1000 / 4 for g in groups)


def test_copies_of_a_line_in_a_document(spark):
    text = spark.createDataFrame([(1, "hot hot\n" * 500)], "doc_id bigint, text string")
    groups = words.salted_words(lines_from(text, "text", keep=["doc_id"]), 4, 42, "map").agg(F.count("*").alias("n"))
    assert [200 <= r["n"] <= 300 for r in groups.collect()] == [True] * 4
