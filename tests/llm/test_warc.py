"""WARC round trip and index lookups."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from gaugewright.llm import warc

PAGES = [
    (1, "http://www.b.com/x?q=1", "<p>one</p>", "clash"), (2, "https://a.org/y", "<p>one</p>", None), (3, "http://a.org/y", "", "k"), (4, None, None, "k"),
    (5, "http://a.org/z", "line\r\n\r\nWARC/1.1\r\n\r\nend\r\n\r\n", "k"), (6, "http://a.org/z", "é中" * 50000, "k"), (7, "bad url\nwith: break", "\r\n", "k"), (7, "bad url\nwith: break", "\r\n", "k"), (None, "http://n.org", "x", "k"),
]
SCHEMA = "page_id long, url string, html string, line string"


def _want(pages):
    keepers = {}
    for page_id, _, html, _ in pages:
        keepers[html or ""] = max(keepers.get(html or "", -1), -1 if page_id is None else page_id)
    for page_id, _, html, _ in pages:
        body = (html or "").encode()
        page_id = -1 if page_id is None else page_id
        again = keepers[html or ""] != page_id
        yield (page_id, "revisit" if again else "response", keepers[html or ""] if again else None, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())


def test_round_trip(spark):
    rows, archives, index = warc.archive(spark.createDataFrame(PAGES, SCHEMA))
    got = sorted((-1 if r.page_id is None else r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows.collect())
    assert got == sorted(_want(PAGES), key=lambda x: (x[0], x[1]))
    found = warc.lookup(spark, archives, index, spark.createDataFrame([("http://a.org/z",), ("http://absent.net",), (None,)], "url string")).collect()
    assert sorted((r.page_id, r.payload.decode()) for r in found if r.key) == [(5, PAGES[4][2]), (6, PAGES[5][2])]
    assert [r.page_id for r in found if not r.key] == [4]


def test_query_on_the_whole_small_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html", "url")
    rows, *_ = warc.archive(pages.toDF("page_id", "url", "html", "line"))
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows.collect())
    assert got == sorted(_want([tuple(r) for r in pages.collect()]), key=lambda x: x[0])


def test_archives_are_plain_gzip_and_can_be_scanned(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    path = warc.fresh_path(spark, "test")
    captures = warc.write_archives(pages, path, file_bytes=400)
    assert captures.select("file").distinct().count() > 2
    for r in captures.collect():
        data = Path(path.removeprefix("file://"), r.file).read_bytes()
        assert parse_of(data[r.offset : r.offset + r.length])[0]["WARC-Record-ID"] == f"<urn:page:{'' if r.page_id is None else r.page_id}>"
    order = lambda df: sorted((r.file, r.offset, r.length, r.key, r.page_id) for r in df.collect())
    assert order(warc.scan_archives(captures, path)) == order(captures)


def parse_of(data):
    return warc.parse(gzip.decompress(data))


def test_lookup_over_many_blocks_and_index_files(spark):
    pages = spark.range(6000).selectExpr("id as page_id", "if(id % 3 = 0, 'http://hot.com/', concat('http://h', id % 50, '.net/', id)) as url", "concat('body ', id) as html")
    _, archives, index = warc.archive(pages)
    parts = spark.read.parquet(f"{index}/parts")
    assert parts.count() > 1 and parts.agg({"blocks": "sum"}).first()[0] > 8
    found = warc.lookup(spark, archives, index, spark.createDataFrame([("http://hot.com/",), ("http://h7.net/7",)], "url string")).collect()
    assert sorted(r.page_id for r in found) == sorted([7, *range(0, 6000, 3)])
    assert all(r.payload.decode() == f"body {r.page_id}" for r in found)


def test_lookup_reads_only_its_ranges(spark):
    """Everything but the wanted record and the index is overwritten: the lookup still answers. Pages are 3 MB, files close at their bound."""
    pages = spark.range(12).selectExpr("id as page_id", "concat('http://big.net/', id) as url", "concat(id, repeat(sha2(cast(id as string), 256), 47000)) as html")
    path, index = warc.fresh_path(spark, "test"), warc.fresh_path(spark, "test-index")
    captures = warc.write_archives(pages, path, file_bytes=1 << 14)
    warc.build_index(captures, index)
    (hit,) = warc.search(spark, index, spark.createDataFrame([("http://big.net/7",)], "url string")).collect()
    total = 0
    for file in Path(path.removeprefix("file://")).glob("*.warc.gz"):
        data = file.read_bytes()
        total += len(data)
        kept = data[hit.offset : hit.offset + hit.length] if file.name == hit.file else b""
        file.write_bytes(b"\0" * hit.offset * bool(kept) + kept)
    assert hit.length < total / 10
    (row,) = warc.lookup(spark, path, index, spark.createDataFrame([("http://big.net/7",)], "url string")).collect()
    assert row.page_id == 7 and row.payload_bytes == 64 * 47000 + 1 and row.payload.startswith(b"7" + hashlib.sha256(b"7").hexdigest().encode())


def test_bytes_that_are_no_text_stay(spark):
    pages = spark.sql("select 1L as page_id, cast(unhex('687474703A2F2F612E6E65742FFF') as string) as url, cast(unhex('FF00FE') as string) as html")
    rows, archives, index = warc.archive(pages)
    (row,) = rows.collect()
    assert (row.payload_bytes, row.payload_digest) == (3, base64.b32encode(hashlib.sha1(b"\xff\0\xfe").digest()).decode())
    (found,) = warc.lookup(spark, archives, index, pages.select("url")).collect()
    assert found.payload == b"\xff\0\xfe"


def test_small_payloads_are_all_responses(spark):
    rows, *_ = warc.archive(spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", "")], SCHEMA), least_bytes=3)
    assert [r.record_type for r in rows.collect()] == ["response"] * 2


def test_empty_table(spark):
    rows, archives, index = warc.archive(spark.createDataFrame([], SCHEMA))
    assert rows.count() == 0
    assert warc.lookup(spark, archives, index, spark.createDataFrame([("http://a.org",)], "url string")).count() == 0


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_folders_with_and_without_a_scheme(spark, tmp_path, scheme):
    pages = spark.createDataFrame([(1, "http://a.org", "ab", ""), (2, "http://b.org", "ab", "")], SCHEMA)
    archives, index = f"{scheme}{tmp_path}/two words", f"{scheme}{tmp_path}/index"
    warc.build_index(warc.write_archives(pages, archives), index)
    found = warc.lookup(spark, archives, index, pages.select("url")).collect()
    assert sorted((r.page_id, r.record_type, r.payload) for r in found) == [(1, "revisit", b""), (2, "response", b"ab")]


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?b=C#frag") == "com,example)/a?b=c"
    assert warc.url_key("https://x.org:8443") == "org,x:8443)/"
    assert warc.url_key(None) == ""


def test_lookup_of_urls_that_records_hold_encoded(spark):
    urls = ["http://a.org/café", "http://a.org/it's", "http://a.org/a|b", "http://a.org/{x}", "http://a.org/two words", "http://a.org/%7Bkept%7D"]
    pages = spark.createDataFrame([(i, u, f"body {i}", "") for i, u in enumerate(urls)], SCHEMA)
    _, archives, index = warc.archive(pages)
    found = warc.lookup(spark, archives, index, pages.select("url")).collect()
    assert sorted((r.page_id, r.payload.decode()) for r in found) == [(i, f"body {i}") for i in range(len(urls))]
