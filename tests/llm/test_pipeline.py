import os
import weakref
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from conftest import rows
from test_jaccard import kept_rows
from texts import documents, edges, frame

import __spark_entry__ as entry
import corpus_pipeline
from lodestar.llm import common, language, packing, quality, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables with clean documents, junk, copies, near copies and odd rows."""
    known = documents(n=300)
    docs = [(d, t, lang, f"src{d % 3}") for d, t, lang, _ in known]
    clean = [d for d in known if d[3]]
    docs += [(1000 + d, t, lang, "src9") for d, t, lang, _ in clean[:20]]
    docs += [(2000 + d, f"{t} and a few words more", lang, None) for d, t, lang, _ in clean[20:40]]
    docs += [(d, t, None, None) for d, t in edges()]
    folder = tmp_path_factory.mktemp("tables")
    frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, q) for d, _, _, q in known], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def texts_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    columns = docs.schema
    seen = [texts_of(docs)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, tables)
        if k < 4:
            assert result.schema == columns
        result.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            seen.append(texts_of(docs))
        if k == 0:
            passed = {r["doc_id"] for r in quality.classify(before, labels).where("predicted = 1").collect()}
            assert {d for d, _ in seen[1]} == passed
            truth = {d: q for d, _, _, q in documents(n=300)}
            assert all(d in passed for d, q in truth.items() if q)
        if k == 1:
            sure = language.identify(before).where(f"lang_pred <> 'und' AND score >= {language.LEAST_SCORE}")
            assert sorted(map(str, (d for d, _ in seen[2]))) == sorted(str(r["doc_id"]) for r in sure.collect())
        if k == 2:
            assert seen[3] == kept_rows(seen[2])
            assert len(seen[3]) < len(seen[2])
        if k == 3:
            assert seen[4] == seen[3]
    pieces = docs.collect()
    whole = defaultdict(int)
    for r in pieces:
        whole[r["doc_id"]] += r["length"]
    assert {d for d, _ in seen[4]} == set(whole)
    assert all(r["doc_tokens"] == whole[r["doc_id"]] for r in pieces if r["doc_id"] is not None)


def test_run_equals_the_stages(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    again = corpus_pipeline.run(spark, tables)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(rows(got.where("doc_id IS NOT NULL"))) == sorted(rows(again.where("doc_id IS NOT NULL")))


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_short_document(spark, tables, tmp_path):
    frame(spark, [(1, "Page not found")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 1


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert packing.SIZE == 2048


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_queries_equal_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    expected = connection.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    key = lambda found: sorted(map(str, (tuple(r) for r in found)))
    assert key(df.select(*columns).collect()) == key(expected)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_queries_return_a_row_for_each(spark, name):
    table = "pages" if name in ("op2_html", "op8_urls") else "documents"
    ids = "page_id" if table == "pages" else "doc_id"
    expected = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(ids).collect()}
    assert {r[0] for r in queries.QUERIES[name](spark, SF_DIR).select(ids).collect()} == expected


def test_texts_reach_python_a_few_at_a_time(spark):
    """A filter gets no batch whole, and its worker gives back what it no longer holds."""
    docs = frame(spark, [(d, f"text {d}", None, None) for d in range(1000)]).coalesce(1)
    kept = common.keep_rows(docs, "text", lambda: lambda texts: [len(texts) <= common.ROWS] * len(texts))
    assert texts_of(kept) == texts_of(docs)


def test_worker_gives_back_after_its_task(monkeypatch):
    held, seen = [], []

    def run(batches):
        big = np.zeros(10)
        held.append(weakref.ref(big))
        yield from batches

    monkeypatch.setattr(common, "give_back", lambda: seen.append(held[0]()))
    assert list(common.tidy(run)([1, 2])) == [1, 2]
    assert seen == [None]
    monkeypatch.undo()
    common.give_back()


def test_batches_for_python_are_bounded(spark, tables):
    """Each stage that sends texts to Python bounds the bytes of a batch, which are 64 MB else; a session's own bound stays."""
    name, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.read.parquet(f"{tables}/documents.parquet")
    for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.language_id, corpus_pipeline.near_duplicates, corpus_pipeline.sequence_packing):
        spark.conf.unset(name)
        stage(spark, docs, tables)
        assert spark.conf.get(name) == str(common.BATCH_BYTES)
    spark.conf.set(name, "1000")
    common.bound_batches(spark)
    assert spark.conf.get(name) == "1000"
    spark.conf.unset(name)
