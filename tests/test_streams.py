import pytest
import sequential
from conftest import rows
from test_frequent import PARAMS, make_items

from lodestar.operators import frequent
from lodestar.sources import items_from, items_from_lines, read_item_stream
from lodestar.streaming.store import BatchTable
from lodestar.streaming import (
    FrequentStream,
    SizedStream,
    StickyAudit,
    batch_sizes,
    distinct_report,
    distinct_rows,
    distinct_summary,
    item_counts,
    item_freq_rows,
    replay,
    rocksdb_state,
    run_distinct,
    run_distinct_summary,
    run_item_counts,
    run_item_freq,
    run_until,
    stream_item_freq,
)

SPLIT = [1500, 1, 2499, 2000]


@pytest.fixture(scope="module")
def stream():
    return make_items()


@pytest.fixture(scope="module")
def files(spark, stream, tmp_path_factory):
    """The stream in uneven files, in the order of their names and times."""
    import os

    folder = tmp_path_factory.mktemp("stream")
    begin = 0
    for k, size in enumerate(SPLIT):
        part = [(t, stream[t]) for t in range(begin, begin + size)]
        begin += size
        frame = spark.createDataFrame(part, "t bigint, item bigint").coalesce(1)
        target = folder / f"part{k}.parquet"
        frame.toPandas().to_parquet(target)
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


def open_stream(spark, files):
    return (
        spark.readStream.schema("t bigint, item bigint")
        .option("maxFilesPerTrigger", 1)
        .parquet(files)
    )


def run(query):
    query.awaitTermination()


@pytest.mark.parametrize("n", [None, 5000, 7])
def test_summaries_equal_the_sequential_run(spark, files, stream, tmp_path, n):
    summary = FrequentStream(str(tmp_path), *PARAMS, n=n)
    run(summary.start(open_stream(spark, files)))
    used = stream[:n]
    assert summary.n_processed(spark) == len(used)
    assert summary.done(spark) == (n is not None)
    assert rows(summary.sticky_table(spark)) == sequential.sticky(used, *PARAMS)
    assert rows(summary.reservoir(spark)) == sequential.reservoir(used, PARAMS[0])
    assert rows(summary.item_freq(spark)) == sorted((i, used.count(i)) for i in set(used))
    true = sequential.true_items(used, PARAMS[0])
    assert rows(summary.true_frequent(spark)) == true
    for marked in (summary.reservoir_marked(spark), summary.sticky_marked(spark)):
        right = {r["item"] for r in marked.collect() if r["mark"] == "+"}
        assert right <= {i for i, _ in true}
    report = dict(rows(summary.summary(spark)))
    assert report["n_processed"] == len(used)
    assert report["table_size"] == len(set(used))
    assert report["n_true"] == len(true)


def test_restart_after_a_failure(spark, files, stream, tmp_path):
    """A batch that fails after it wrote its state runs again and counts once."""

    class Failing(FrequentStream):
        seen = []

        def on_batch(self, batch, batch_id):
            super().on_batch(batch, batch_id)
            self.seen.append(batch_id)
            if self.seen == [0, 1, 2]:
                raise RuntimeError("lost after the write")

    summary = Failing(str(tmp_path), *PARAMS, n=5000)
    with pytest.raises(Exception, match="lost after the write"):
        run(summary.start(open_stream(spark, files)))
    run(summary.start(open_stream(spark, files)))
    assert summary.seen == [0, 1, 2, 2, 3]
    used = stream[:5000]
    assert rows(summary.sticky_table(spark)) == sequential.sticky(used, *PARAMS)
    assert rows(summary.reservoir(spark)) == sequential.reservoir(used, PARAMS[0])
    assert rows(summary.item_freq(spark)) == sorted((i, used.count(i)) for i in set(used))


def test_failure_inside_a_batch(spark, files, stream, tmp_path):
    """A batch that fails between its state tables leaves the state before it usable."""

    class Failing(FrequentStream):
        broken = False

        def _positioned(self, batch, total, stage):
            if total == SPLIT[0] + SPLIT[1] and not self.broken:
                self.broken = True
                save = self.table.save

                def fail(*_):
                    self.table.save = save
                    raise RuntimeError("lost inside")

                self.table.save = fail
            return super()._positioned(batch, total, stage)

    summary = Failing(str(tmp_path), *PARAMS)
    with pytest.raises(Exception, match="lost inside"):
        run(summary.start(open_stream(spark, files)))
    half = stream[: SPLIT[0] + SPLIT[1]]
    assert rows(summary.sticky_table(spark)) == sequential.sticky(half, *PARAMS)
    run(summary.start(open_stream(spark, files)))
    assert rows(summary.sticky_table(spark)) == sequential.sticky(stream, *PARAMS)
    assert rows(summary.item_freq(spark)) == sorted((i, stream.count(i)) for i in set(stream))


def test_positions_across_batches(spark, files, stream, tmp_path):
    """Without positions in the source they are counted on from batch to batch."""
    source = open_stream(spark, files).withColumnRenamed("t", "arrived")
    summary = FrequentStream(
        str(tmp_path), *PARAMS, n=5000, order_by=["arrived"], keep=["sticky"]
    )
    run(summary.start(source))
    assert rows(summary.sticky_table(spark)) == sequential.sticky(stream[:5000], *PARAMS)


def test_gap_in_positions_fails(spark, tmp_path):
    spark.createDataFrame([(0, 1), (2, 1)], "t bigint, item bigint").write.parquet(
        str(tmp_path / "in")
    )
    summary = FrequentStream(str(tmp_path / "out"), *PARAMS)
    with pytest.raises(Exception, match="expected"):
        run(summary.start(open_stream(spark, str(tmp_path / "in"))))


def test_batches_out_of_order(spark, files, stream, tmp_path):
    """Exact counts and the sample need positions, not their order."""
    source = open_stream(spark, files).selectExpr(f"{len(stream) - 1} - t as t", "item")
    summary = FrequentStream(str(tmp_path), *PARAMS, n=3000, keep=["exact", "reservoir"])
    run(summary.start(source))
    used = stream[::-1][:3000]
    assert rows(summary.item_freq(spark)) == sorted((i, used.count(i)) for i in set(used))
    assert rows(summary.reservoir(spark)) == sequential.reservoir(used, PARAMS[0])


def test_lost_state_fails(spark, files, tmp_path):
    summary = FrequentStream(str(tmp_path), *PARAMS, n=1, keep=["exact"])
    run(summary.start(open_stream(spark, files)))
    with pytest.raises(RuntimeError, match="no state of batch 17"):
        summary.progress.after(spark, 17)


def test_before_the_first_batch(spark, tmp_path):
    summary = FrequentStream(str(tmp_path), *PARAMS)
    assert summary.n_processed(spark) == 0
    assert summary.item_freq(spark).count() == 0
    assert summary.sticky_table(spark).count() == 0
    assert batch_sizes(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", [None, 2600])
def test_exact_counts_in_the_state_store(spark, files, stream, tmp_path, n):
    run(run_item_freq(open_stream(spark, files), str(tmp_path), n))
    used = stream[:n]
    assert rows(stream_item_freq(spark, str(tmp_path))) == sorted(
        (i, used.count(i)) for i in set(used)
    )
    changed = item_freq_rows(str(tmp_path)).load(spark).where("batch_id = 1")
    assert changed.count() == 1


def test_distinct_items(spark, files, stream, tmp_path):
    run(run_distinct(open_stream(spark, files), str(tmp_path)))
    assert rows(distinct_rows(spark, str(tmp_path))) == [(i,) for i in sorted(set(stream))]


@pytest.mark.parametrize(
    ("threshold", "batches"), [(None, 4), (1500, 1), (1501, 2), (1502, 3), (10**6, 4)]
)
def test_stop_after_threshold(spark, files, stream, tmp_path, threshold, batches):
    """The batch that crosses the threshold counts as a whole, later ones not at all."""
    sized = SizedStream(str(tmp_path), threshold)
    run(sized.start(open_stream(spark, files)))
    sizes = rows(batch_sizes(spark, str(tmp_path)).select("batch_id", "n"))
    assert sizes == list(enumerate(SPLIT[:batches]))
    used = stream[: sum(SPLIT[:batches])]
    assert dict(rows(distinct_report(spark, str(tmp_path)))) == {
        "n_processed": len(used),
        "n_distinct": len(set(used)),
        "largest": max(used),
    }
    done = threshold is not None and len(used) >= threshold
    assert sized.done(spark) == SizedStream(str(tmp_path), threshold).done(spark) == done


def test_live_query_is_stopped(spark, files, stream, tmp_path):
    summary = FrequentStream(str(tmp_path), *PARAMS, n=1500, keep=["exact"])
    query = summary.start(open_stream(spark, files), every="10 milliseconds")
    try:
        query.processAllAvailable()
        assert summary.done(spark)
    finally:
        query.stop()
    assert rows(summary.item_freq(spark)) == rows(
        frequent.item_freq(
            spark.createDataFrame(list(enumerate(stream)), "t bigint, item bigint"), 1500
        )
    )


def test_text_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("3\n3\n-1\n")
    stream = read_item_stream(spark.readStream, str(tmp_path / "in"))
    got = []
    replay(stream, lambda df, k: got.extend(rows(df)), str(tmp_path / "c"))
    assert got == [(-1,), (3,), (3,)]
    lines = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    assert items_from_lines(lines).isStreaming
    table = spark.readStream.schema("t bigint, v double").parquet(str(tmp_path))
    assert items_from(table, "v", t="t").isStreaming


def test_arguments(tmp_path):
    with pytest.raises(ValueError, match="unknown summaries"):
        FrequentStream(str(tmp_path), *PARAMS, keep=["other"])
    with pytest.raises(ValueError):
        FrequentStream(str(tmp_path), 0.1, 0.2, 0.1)
    with pytest.raises(ValueError):
        FrequentStream(str(tmp_path), *PARAMS, n=0)


def test_stores_stay_bounded(spark, tmp_path):
    """After 50 batches there are as many folders as after a few, and one row for each item."""
    import os
    from collections import Counter

    from pyspark.sql import functions as F

    table = BatchTable(str(tmp_path), "item bigint, freq bigint", lambda rows: rows.groupBy("item").agg(F.sum("freq").alias("freq")), every=4)
    counts = Counter()
    for batch_id in range(50):
        batch = [(batch_id % 7, 1), (100 + batch_id % 3, 2)]
        frame = spark.createDataFrame(batch, "item bigint, freq bigint").coalesce(1)
        if batch_id % 9 == 3:  # a first run of the batch that was lost
            table.save(frame.limit(1), batch_id)
        table.save(frame, batch_id)
        for item, n in batch:
            counts[item] += n
        if batch_id % 10 == 9:
            loaded = table.load(spark)
            assert rows(loaded.groupBy("item").agg(F.sum("freq"))) == sorted(counts.items())
            assert loaded.count() <= 10 + 2 * 4
    folders = [d for d, _, _ in os.walk(tmp_path)]
    assert len(folders) <= 1 + 2 + 2 * 4 + 2


def folders_below(path):
    import os

    return sum(len(dirs) for _, dirs, _ in os.walk(path))


def test_staged_tables_stay_bounded(spark, tmp_path):
    """50 batches leave as many folders as 10, beside the checkpoints and below the state; some batches run twice."""
    import os

    class Twice(FrequentStream):
        def on_batch(self, batch, batch_id):
            if batch_id % 7 == 3:
                super().on_batch(batch, batch_id)
            super().on_batch(batch, batch_id)

    (tmp_path / "in").mkdir()
    seen, counts = [], []
    summary = Twice(str(tmp_path / "out"), *PARAMS, order_by=["arrived"], keep=["sticky"])
    shared = spark.sparkContext.getCheckpointDir() or str(tmp_path)
    before = folders_below(shared)
    for end in (10, 50):
        for k in range(len(seen) // 3, end):
            part = [(3 * k + j, (3 * k + j) % 5) for j in range(3)]
            seen += [item for _, item in part]
            target = tmp_path / "in" / f"{k:03}.parquet"
            spark.createDataFrame(part, "t bigint, item bigint").toPandas().to_parquet(target)
            os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
        source = open_stream(spark, str(tmp_path / "in"))
        run(summary.start(source.withColumnRenamed("t", "arrived")))
        counts.append(folders_below(tmp_path / "out" / "stage"))
        assert rows(summary.sticky_table(spark)) == sequential.sticky(seen, *PARAMS)
    assert counts[0] == counts[1] <= 2 + 2 * 2
    assert folders_below(shared) == before


@pytest.mark.parametrize("n", [None, 2600])
def test_counts_in_the_state_store_alone(spark, files, stream, tmp_path, n):
    """In RocksDB, with a restart between the batches; the counts after an earlier batch can be read too."""
    import os

    some = tmp_path / "some"
    some.mkdir()
    for k in range(2):
        os.link(f"{files}/part{k}.parquet", some / f"part{k}.parquet")
    before = {key: spark.conf.get(key, None) for key in ("spark.sql.streaming.stateStore.providerClass",)}
    expected = lambda used: sorted((i, used.count(i)) for i in set(used))
    for ends in (2, 4):
        for k in range(2, ends):
            os.link(f"{files}/part{k}.parquet", some / f"part{k}.parquet")
        with rocksdb_state(spark):
            query = run_item_counts(open_stream(spark, str(some)), str(tmp_path), n)
        run(query)
        assert rows(item_counts(spark, str(tmp_path))) == expected(stream[: sum(SPLIT[:ends])][:n])
    assert rows(item_counts(spark, str(tmp_path), batch_id=0)) == expected(stream[: SPLIT[0]][:n])
    assert before == {key: spark.conf.get(key, None) for key in before}
    written = {d for d in os.listdir(tmp_path) if d != "some"}
    assert written == {"checkpoint-counts"}
    found = [name for _, _, names in os.walk(tmp_path / "checkpoint-counts" / "state") for name in names]
    assert any(name.endswith(".changelog") for name in found)


def test_distinct_summary_in_the_state_store(spark, files, stream, tmp_path):
    import os

    some = tmp_path / "some"
    some.mkdir()
    assert dict(rows(distinct_summary(spark, str(tmp_path)))) == {"n_distinct": 0, "largest": 0}
    for k, end in enumerate([SPLIT[0], SPLIT[0] + SPLIT[1], sum(SPLIT[:3]), sum(SPLIT)]):
        os.link(f"{files}/part{k}.parquet", some / f"part{k}.parquet")
        run(run_distinct_summary(open_stream(spark, str(some)), str(tmp_path)))
        used = stream[:end]
        assert dict(rows(distinct_summary(spark, str(tmp_path)))) == {"n_distinct": len(set(used)), "largest": max(0, *used)}
    assert len(os.listdir(tmp_path / "summary")) == 2


def test_live_query_ends_by_itself(spark, files, stream, tmp_path):
    """At n, inside a batch; what comes after is not read, and the summaries are those of the first n."""
    summary = FrequentStream(str(tmp_path), *PARAMS, n=1700)
    summary.run(open_stream(spark, files), every="10 milliseconds")
    assert not spark.streams.active and summary.n_processed(spark) == 1700
    used = stream[:1700]
    assert rows(summary.sticky_table(spark)) == sequential.sticky(used, *PARAMS)
    assert rows(summary.reservoir(spark)) == sequential.reservoir(used, PARAMS[0])
    with pytest.raises(ValueError, match="no end"):
        FrequentStream(str(tmp_path), *PARAMS).run(open_stream(spark, files), every="10 milliseconds")


def test_live_batch_sizes_end_at_the_threshold(spark, files, stream, tmp_path):
    sized = SizedStream(str(tmp_path), 1501)
    sized.run(open_stream(spark, files), every="10 milliseconds")
    assert not spark.streams.active
    assert rows(batch_sizes(spark, str(tmp_path)).select("batch_id", "n")) == [(0, 1500), (1, 1)]
    with pytest.raises(ValueError, match="no end"):
        SizedStream(str(tmp_path)).run(open_stream(spark, files), every="10 milliseconds")


def test_errors_of_a_live_query_are_raised(spark, files, tmp_path):
    class Failing(SizedStream):
        def on_batch(self, batch, batch_id):
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        Failing(str(tmp_path), 10**9).run(open_stream(spark, files), every="10 milliseconds")
    assert not spark.streams.active
    query = SizedStream(str(tmp_path / "b")).start(open_stream(spark, files))
    run_until(query, lambda: False)
    assert batch_sizes(spark, str(tmp_path / "b")).count() == 4


def test_a_batch_that_runs_again_has_the_same_time(spark, files, tmp_path):
    class Failing(SizedStream):
        times = []

        def on_batch(self, batch, batch_id):
            super().on_batch(batch, batch_id)
            self.times.append([tuple(r) for r in batch_sizes(spark, self.path).where(f"batch_id = {batch_id}").collect()])
            if len(self.times) == 2:
                raise RuntimeError("lost after the write")

    sized = Failing(str(tmp_path))
    with pytest.raises(Exception, match="lost after the write"):
        run(sized.start(open_stream(spark, files)))
    run(sized.start(open_stream(spark, files)))
    assert sized.times[1] == sized.times[2]
    at = [r["at"] for r in batch_sizes(spark, str(tmp_path)).orderBy("batch_id").collect()]
    assert len(at) == 4 and at == sorted(at)


def test_sticky_tables_of_all_prefixes(spark, files, stream, tmp_path):
    """From parts in a tree, at every batch end, with a batch that fails after it wrote its parts."""

    class Failing(StickyAudit):
        seen = []

        def on_batch(self, batch, batch_id):
            super().on_batch(batch, batch_id)
            self.seen.append(batch_id)
            if self.seen == [0, 1]:
                raise RuntimeError("lost after the write")

    audit = Failing(str(tmp_path), *PARAMS)
    with pytest.raises(Exception, match="lost after the write"):
        run(audit.start(open_stream(spark, files)))
    run(audit.start(open_stream(spark, files)))
    assert audit.seen == [0, 1, 1, 2, 3]
    for batch_id in range(4):
        used = stream[: sum(SPLIT[: batch_id + 1])]
        assert rows(audit.table(spark, batch_id)) == sequential.sticky(used, *PARAMS)
    assert rows(audit.table(spark)) == sequential.sticky(stream, *PARAMS)


def test_sticky_parts_compose_associatively(spark, stream):
    """However a stream is cut and whichever parts are joined first; also with many winners and hot items."""
    from lodestar.functions import sticky_rate
    from lodestar.operators.sticky import followed_by, part_table, sticky_part

    rate = sticky_rate(*PARAMS)
    used = stream[:3000]
    everything = spark.createDataFrame(list(enumerate(used)), "t bigint, item bigint")

    def part(low, high, **limits):
        return sticky_part(everything.where(f"t >= {low} AND t < {high}"), rate, 42, high - low, **limits)

    whole = rows(part(0, 3000))
    a, b, c = part(0, 700), part(700, 701), part(701, 3000, broadcast_rows=0, floor=5)
    assert rows(followed_by(followed_by(a, b), c)) == rows(followed_by(a, followed_by(b, c))) == whole
    assert rows(part_table(part(0, 3000), 3000, rate, 42)) == sequential.sticky(used, *PARAMS)
    assert part_table(part(0, 0), 0, rate, 42).count() == 0
