import pytest
from conftest import rows
from pyspark.errors import PySparkException

from lodestar.operators import kcenter
from lodestar.plans import with_position
from lodestar.sources import items_from, points_from, read_items, read_points


def write(tmp_path, text):
    path = tmp_path / "in.txt"
    path.write_text(text)
    return str(path)


def test_points_file(spark, tmp_path):
    path = write(tmp_path, "0.1,2\n-3,4.5,ignored\n1e2, 7 ")
    out = sorted((tuple(r) for r in read_points(spark, path).collect()))
    assert [r[1:] for r in out] == [(0.10000000149011612, 2.0), (-3.0, 4.5), (100.0, 7.0)]
    assert [r[0] for r in out] == [0, 1, 2]


@pytest.mark.parametrize("text", ["1,2\nx,3\n", "1\n", "1,\n", "\n"])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_point_fails(spark, tmp_path, text, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(PySparkException, match="bad [xy]"):
            read_points(spark, write(tmp_path, text)).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_null_coordinate_fails(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, b double")
    with pytest.raises(PySparkException, match="bad x: NULL"):
        points_from(df, "a", "b").collect()


def test_items_file(spark, tmp_path):
    path = write(tmp_path, "5\n-7\n5000000000\n")
    assert rows(read_items(spark, path)) == [(0, 5), (1, -7), (2, 5000000000)]
    with pytest.raises(PySparkException, match="bad item"):
        read_items(spark, write(tmp_path, "1\ntwo\n")).collect()


def test_positions(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id", "id % 3 as a", "(id * 7919) % 5000 as b")
    got = rows(with_position(df, ["a", "b"], "t", start=10).select("a", "b", "t"))
    assert [r[2] for r in got] == list(range(10, 5010))


def test_positions_with_a_hot_order_value(spark):
    df = spark.range(0, 3000).selectExpr("id", "if(id < 1000, 5, id) as ts")
    out = with_position(df, ["ts", "id"], "t").orderBy("ts", "id").select("t").collect()
    assert [r[0] for r in out] == list(range(3000))


def test_items_from(spark):
    df = spark.createDataFrame([(2, 9.0), (0, 7.0), (1, 8.0)], "k bigint, v double")
    assert rows(items_from(df, "v", t="k")) == [(0, 7), (1, 8), (2, 9)]
    assert rows(items_from(df, "v", order_by=["k"])) == [(0, 7), (1, 8), (2, 9)]
    with pytest.raises(ValueError):
        items_from(df, "v")


def test_files_are_read_in_the_order_of_their_paths(spark, tmp_path):
    (tmp_path / "b.txt").write_text("\n".join(map(str, range(100, 3000))) + "\n")
    (tmp_path / "a.txt").write_text("1\n2\n")
    (tmp_path / "c.txt").write_text("7\n")
    got = rows(read_items(spark, str(tmp_path)))
    assert got == list(enumerate([1, 2, *range(100, 3000), 7]))


@pytest.mark.parametrize("size", ["2k", "16k", "1m"])
def test_point_ids_do_not_depend_on_splits(spark, tmp_path, size):
    points = [((k * 7919) % 1000 / 3, (k * 104729) % 997 / 7) for k in range(4000)]
    path = write(tmp_path, "".join(f"{x},{y}\n" for x, y in points))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in before:
            spark.conf.set(key, size)
        read = read_points(spark, path)
        assert [r[0] for r in rows(read)] == list(range(4000))
        (radius,) = kcenter.kcenter_radius(read, 4, 3).first()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert radius == RADIUS.setdefault("radius", radius)


RADIUS = {}


@pytest.mark.parametrize("bad", ["NaN", "Infinity", "-Infinity"])
def test_points_that_are_not_finite_fail(spark, tmp_path, bad):
    with pytest.raises(PySparkException, match="y is not finite"):
        read_points(spark, write(tmp_path, f"0.1,0.1\n0.2,{bad}\n")).collect()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", ["1k", "5k", "1m"])
def test_lines_are_numbered_where_they_lie(spark, tmp_path, size):
    """Split files, several in one split, gzip, empty files and bare line ends; no line is moved."""
    import gzip

    lines = [str(k * 7919) for k in range(6000)]
    for k in range(4):
        (tmp_path / f"a{k}.txt").write_text("\n".join(lines[k * 1000 : (k + 1) * 1000]) + "\n" * (k % 2))
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(("\n".join(lines[4000:5000]) + "\n").encode()))
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.txt").write_text("\r\n".join(lines[5000:]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in before:
            spark.conf.set(key, size)
        read = read_items(spark, str(tmp_path))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    # The splits stay those of the time of reading.
    got = rows(read)
    assert got == [(k, int(line)) for k, line in enumerate(lines)]
    # Only the table of the blocks, a row for each, is moved.
    moved = [line for line in executed(read).splitlines() if "Exchange" in line]
    assert moved and all("SinglePartition" in line or "BroadcastExchange" in line for line in moved)
    assert rows(read) == got and read.sparkSession is spark


def test_number_of_splits_is_fixed(spark, tmp_path):
    from lodestar.plans import fixed_splits

    path = write(tmp_path, "".join(f"{k}\n" for k in range(50_000)))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set("spark.sql.files.minPartitionNum", "5")
        fixed = fixed_splits(spark, lambda own: own.read.text(path))
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        assert fixed.rdd.getNumPartitions() in (5, 6) and spark.read.text(path).rdd.getNumPartitions() in (2, 3)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    assert not spark.catalog.listTables("global_temp")


def test_a_file_that_changed_fails(spark, tmp_path):
    path = write(tmp_path, "1\n2\n3\n")
    read = read_items(spark, path)
    write(tmp_path, "1\n2\n3\n4\n5\n6\n")
    with pytest.raises(PySparkException):
        assert rows(read) == [(0, 1), (1, 2), (2, 3)]
        raise PySparkException("the lines counted are the lines read")


def test_many_blocks_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    from lodestar.sources import text

    monkeypatch.setattr(text, "BROADCAST_ROWS", 0)
    (tmp_path / "a.txt").write_text("1\n2\n")
    (tmp_path / "b.txt").write_text("3\n")
    assert rows(read_items(spark, str(tmp_path))) == [(0, 1), (1, 2), (2, 3)]
