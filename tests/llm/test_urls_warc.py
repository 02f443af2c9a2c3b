import gzip
import hashlib
import io
import random
from collections import defaultdict

import duckdb
import pytest

from lodestar.llm import urls, warc

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "x://www.example.net/en/1?q#f", "http://example.net/enx",
    "http://example.com/de/1", "http://myexample.com/de/1", "http://a.org/fr/", "http://a.org?/fr/", "http://a.org#/fr/", "http://org/fr/9",
    "http://ÄÖ.net/", "http://h/a://b/c", "http://u@h:80/p//q/?x=1#y", "://h/p", "http://net/en/", "http://sub.example.net/en/",
]


def brute_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def brute_rule(host, path):
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def pages_frame(spark, found):
    return spark.createDataFrame([(k, u, "h", "v") for k, u in found], "page_id bigint, url string, host string, verdict string")


def test_hosts_paths_and_rules(spark):
    pages = [*enumerate(URLS), (None, URLS[5]), (3, URLS[9]), (3, URLS[9])]
    none = spark.createDataFrame([], "page_id bigint, good boolean")
    got = urls.judge(pages_frame(spark, pages), none).collect()
    expected = []
    for page_id, url in pages:
        host, path = brute_parse(url)
        rule, verdict = brute_rule(host, path)
        expected.append((page_id, host, path, rule, verdict or "allow"))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    assert urls.judge(pages_frame(spark, pages).where("false"), none).count() == 0


def test_templates_and_purity(spark):
    rng = random.Random(0)
    found, labels = [], []
    for k in range(900):
        kind = ("good", "spam", "news")[k % 3]
        slug = {"good": f"docs/{k}", "spam": f"win/{k}.html", "news": f"news/{rng.randrange(10**9):x}-story-{k}"}[kind]
        found.append((k, f"http://one.example/{slug}"))
        labels.append((k, kind != "spam" if rng.random() < 0.95 else kind == "spam"))
    found += [(1000 + k, f"http://two.example/win/{k}.html") for k in range(5)]
    labels += [(None, True), (4, None)]
    known = spark.createDataFrame(labels, "page_id bigint, good boolean")
    got = {r["page_id"]: r for r in urls.judge(pages_frame(spark, found), known).collect()}
    for k in range(900):
        assert got[k]["verdict"] == ("block" if k % 3 == 1 else "allow")
    assert got[0]["template"] == "/docs/{n}" and got[1]["template"] == "/win/{n}.html" and got[2]["template"].startswith("/news/")
    assert len({got[k]["template"] for k in range(2, 900, 3)}) <= 2
    # Another host has no labels of its own: the share of all hosts decides.
    assert {got[1000 + k]["verdict"] for k in range(5)} == {"allow"}


def test_deep_and_wide_paths(spark):
    wide = [(k, f"http://w/{'abcdefghij'[k % 10]}{chr(97 + k // 10)}x/page") for k in range(200)]
    deep = [(300, "http://d/" + "/".join("s" * (k % 3 + 1) for k in range(60)))]
    none = spark.createDataFrame([], "page_id bigint, good boolean")
    got = {r["page_id"]: r["template"] for r in urls.judge(pages_frame(spark, wide + deep), none).collect()}
    assert {got[k] for k in range(200)} == {"/{*}/page"}
    assert got[300].endswith("/{rest}")


@pytest.mark.parametrize("one_off", [0, 60])
def test_frequent_sections_stay_apart_however_many_siblings(spark, one_off):
    """40 sections, a third of the rows in a bad one; paths that come once do not change the others' verdicts."""
    found = [(k, f"http://s/spam/{k}") for k in range(600)]
    found += [(600 + k, f"http://s/sec{'y' * (k % 39)}/{k}") for k in range(1200)]
    found += [(5000 + k, f"http://s/{chr(97 + k // 8)}{chr(97 + k % 8)}only/page") for k in range(one_off)]
    known = spark.createDataFrame([(k, k >= 600) for k in range(1800)], "page_id bigint, good boolean")
    got = {r["page_id"]: r for r in urls.judge(pages_frame(spark, found), known).collect()}
    assert {(got[k]["template"], got[k]["verdict"]) for k in range(600)} == {("/spam/{n}", "block")}
    assert {got[k]["verdict"] for k in range(600, 1800)} == {"allow"}
    assert len({got[k]["template"] for k in range(600, 1800)}) >= 39
    assert {got[5000 + k]["template"] for k in range(one_off)} <= {"/{*}/page"}


HTMLS = [(1, "<p>" + "a" * 2000), (2, "short"), (3, "short"), (4, "<p>" + "a" * 2000), (5, None), (6, ""), (7, "é" * 600), (8, "é" * 600), (9, "x" * 1000), (9, "x" * 1000), (10, "x" * 999), (11, "x" * 999), (12, "line\n\nWARC/1.1\r\n\r\nhttp://x 0 0 0 5\nnext")]


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip(spark, tmp_path, parts):
    pages = spark.createDataFrame([(k, f"http://h/{k} b", h, "c") for k, h in HTMLS] + [(None, None, "x" * 5000, "c")], "page_id bigint, url string, html string, key string")
    arc, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.write_arc(pages.repartition(parts), arc)
    warc.convert(spark, arc, out)
    got = warc.read_warc(spark, out, blocks=True).collect()
    groups = defaultdict(list)
    for k, h in HTMLS:
        groups[h or ""].append(k)
    expected = []
    for k, h in HTMLS:
        data = (h or "").encode()
        last = max(groups[h or ""])
        again = len(data) >= 1000 and k < last
        expected.append((str(k), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", str(last) if again else None))
    expected.append((None, 5000, hashlib.sha1(b"x" * 5000).hexdigest(), "response", None))
    assert sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(expected, key=str)
    for r in got:
        html = dict(HTMLS).get(int(r["key"]) if r["key"] else None, "x" * 5000) or ""
        payload = bytes(r["block"]).split(b"\r\n\r\n", 1)[1]
        assert payload == (b"" if r["record_type"] == "revisit" else html.encode())
        assert r["url"] == (f"http://h/{r['key']}%20b" if r["key"] else None)
        assert r["date"] == "1970-01-01T00:00:00Z" and r["record_id"].startswith("<urn:uuid:")
    empty = str(tmp_path / "none")
    warc.write_arc(pages.where("false"), empty)
    warc.convert(spark, empty, str(tmp_path / "none2"))
    assert warc.read_warc(spark, str(tmp_path / "none2")).count() == 0


def test_both_versions_of_arc(spark, tmp_path):
    old = warc.arc_opening(1, "f.arc").encode() + b"\nhttp://a b/ 1.2.3.4 19990102030405 text/plain 5\nhello\nhttp://c/ 1.2.3.4 1999 text/html 4\nx\ny\n\n"
    first, second = warc.arc_records(io.BytesIO(old))
    assert first == {"url": "http://a b/", "ip": "1.2.3.4", "date": "19990102030405", "mime": "text/plain", "block": b"hello"}
    assert second["block"] == b"x\ny\n" and warc.iso_time(second["date"]) == "1999-01-01T00:00:00Z"
    record = next(warc.warc_records(io.BytesIO(warc.warc_record(first) + b"\r\n\r\n")))
    assert record["warc-type"] == "resource" and record["block"] == b"hello" and record["warc-date"] == "1999-01-02T03:04:05Z"
    assert record["content-type"] == "text/plain" and record["warc-ip-address"] == "1.2.3.4"
    (tmp_path / "a.arc.gz").write_bytes(gzip.compress(old))
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(warc.arc_opening(2, "g.arc").encode() + b"\nhttp://d/ - 20010101 text/html 200 - 17 0 g 2\nhi\n"))
    got = warc.read_arc(spark, str(tmp_path)).select("url", "key").collect()
    assert sorted(map(tuple, got)) == [("http://a b/", None), ("http://c/", None), ("http://d/", "17")]
    for bad in (b"no block\n", warc.arc_opening(1, "f").replace("1 0", "3 0").encode(), old[:-8]):
        with pytest.raises(ValueError):
            list(warc.arc_records(io.BytesIO(bad)))


@pytest.mark.parametrize(("date", "iso"), [(None, "1970-01-01T00:00:00Z"), ("x", "1970-01-01T00:00:00Z"), ("20261301", "1970-01-01T00:00:00Z"), ("200012", "2000-12-01T00:00:00Z"), ("20001231235959", "2000-12-31T23:59:59Z")])
def test_times(date, iso):
    assert warc.iso_time(date) == iso


def test_sql_of_wide_and_deep_trees(spark, tmp_path):
    """The twin has the same templates and verdicts with many children, frequent ones among them, and deep paths."""
    rng = random.Random(1)
    names = [a + b for a in "abcdefg" for b in "hijklmn"]
    found, labels = [], []
    for k in range(1_500):
        section = "spam" if k % 3 == 0 else rng.choice(names[:39]) if k % 3 == 1 else "".join(rng.choices("abcdefgh", k=6))
        found.append((k, f"http://h.example/{section}/{k}", "x"))
        labels.append((k, int(section != "spam"), 0))
    found += [(2_000 + k, "http://d.example/" + "/".join(rng.choice("ab") * (j % 3 + 1) for j in range(rng.randint(0, 20))), "x") for k in range(200)]
    found += [(3_000, None, "x"), (3_001, "no scheme", "x")]
    spark.createDataFrame(found, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    connection = duckdb.connect()
    for name in ("pages", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict", "template"]
    want = connection.execute(f"SELECT {', '.join(columns)} FROM ({urls.OP8_SQL})").fetchall()
    got = [tuple(r) for r in urls.op8_urls(spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(map(tuple, want), key=str)
    assert {r[4] for r in got if "/spam/" in r[2]} == {"block"} and sum(r[4] == "block" for r in got) == 500
