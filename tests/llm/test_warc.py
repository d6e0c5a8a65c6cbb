import gzip
import hashlib
from collections import Counter

from docketlens.llm import queries, warc

PAGE = "page_id long, url string, html string, key string, digest string, file string"


def test_url_keys():
    assert warc.url_key("https://WWW.Example.org:8080/a/b?c=d#e") == "org,example,www)/a/b?c=d"
    assert warc.url_key("http://example.org") == "org,example)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") and warc.url_key("no host") == "no host"


def brute(pages):
    out = []
    for page, _, html in pages:
        payload = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == payload]
        head = max(same, key=lambda p: (p is not None, p or 0))
        again = len(payload) >= 1000 and page != head
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response",
                    head if again else None))
    return Counter(out)


def odd_pages():
    big, other = "<p>é</p>" * 200, "x" * 1000
    return [(1, "http://a.org/1", big), (2, "http://a.org/2", big), (9, "http://b.org/ x?q=\t1", big), (9, "http://b.org/ x?q=\t1", big),
            (3, None, None), (4, "", ""), (5, "http://a.org/1", "small"), (6, "http://c.org/", "small"), (None, "http://c.org/n", other),
            (7, "http://[bad", other), (-5, "http://a.org/neg", other), (8, "http://a.org/é", "y" * 300_000), (10, "ftp:", "x" * 999),
            (11, "http://z.org", "x" * 999)]


def test_round_trip_of_odd_pages(spark):
    pages = odd_pages()
    table = spark.createDataFrame([(*p, "k", "d", "f") for p in pages], PAGE).repartition(3)
    archive = warc.write_archives(table, archive_bytes=2000)
    index = warc.build_index(archive, block_lines=2)
    rows = warc.read_records(archive, warc.lookup(index, table)).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == brute(pages)
    texts = {(p, (h or "").encode()) for p, _, h in pages}
    assert all((r["page_id"], bytes(r["payload"])) in texts for r in rows if r["record_type"] == "response")


def test_blanks_beside_lower_signs_keep_the_order(spark):
    """A blank sorts before '!', the '%20' that is stored after it."""
    urls = [f"http://h.org/a{sign}{tail}" for sign in ' !"#$%&' for tail in "abc"] + ["no\rhost", "no host", "no!host"]
    pages = [(i, url, f"page {i}") for i, url in enumerate(urls)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    archive = warc.write_archives(table)
    for lines in (1, 3, 1000):
        archive.folder = f"{archive.folder}/{lines}"
        rows = warc.lookup(warc.build_index(archive, block_lines=lines), table)
        assert Counter(map(tuple, rows.collect())) == Counter((c["file"], c["offset"], c["length"]) for c in archive.captures.collect())


def test_absent_keys_and_empty_tables(spark):
    table = spark.createDataFrame([(*p, "k", "d", "f") for p in odd_pages()], PAGE)
    archive = warc.write_archives(table)
    index = warc.build_index(archive, block_lines=3)
    others = spark.createDataFrame([(99, "http://a.org/1"), (1, "http://nowhere.org")], "page_id long, url string")
    assert warc.lookup(index, others).count() == 0
    none = warc.write_archives(table.limit(0))
    assert warc.lookup(warc.build_index(none), table).count() == 0


def test_archives_are_concatenated_gzip_members(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = warc.write_archives(pages)
    captures = archive.captures.collect()
    root = archive.folder.removeprefix("file://")
    for file in {c["file"] for c in captures}:
        with gzip.open(f"{root}/{file}") as f:
            assert f.read().count(b"WARC/1.1\r\n") == sum(c["file"] == file for c in captures)


def test_registered_query(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    rows = queries.QUERIES["op6_warc_index"](spark, sf_dir).collect()
    assert Counter(tuple(r) for r in rows) == brute(pages)
