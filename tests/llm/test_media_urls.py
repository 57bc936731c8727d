import hashlib
import zlib
from datetime import date

import numpy as np
import pytest

from candor.llm import media, urlfilter


def test_payloads_come_back(spark):
    texts = [None, "", "x", "é" * 288, "abc " * 40_000, "\x00\xff" * 3000, "same", "same"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in media.features(media.store(docs)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        data += b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    assert rows[6][1:] == rows[7][1:]
    assert media.features(media.store(docs.limit(0))).count() == 0


def test_tall_payloads_take_several_images(monkeypatch):
    monkeypatch.setattr(media, "TALLEST", 3)
    data = bytes(np.random.default_rng(1).integers(0, 256, 576 * 7, dtype=np.uint8))
    images = media.read([media.write(data)])[0]
    assert len(images) > 1 and b"".join(t.tobytes() for _, _, t in images) == data


def test_other_coefficients_and_components_are_passed_over():
    """A colour image with 4:2:0 components and AC coefficients, coded by hand."""
    dc, ac = media.codes(media.DC_LENGTHS, media.DC_SYMBOLS), media.codes([0, 3] + [0] * 14, [0x00, 0x21, 0xF0])
    bits = ""

    def put(code, length):
        return format(code, f"0{length}b")

    def block(change):
        size = abs(change).bit_length()
        out = put(*dc[size]) + (format(change if change > 0 else change + (1 << size) - 1, f"0{size}b") if size else "")
        return out + put(*ac[0x21]) + "1" + put(*ac[0xF0]) + put(*ac[0x00])

    for changes in ((10, -3, 5, 0, 7, -7), (4, 0, 0, -20, 1, 2)):
        for c in changes:
            bits += block(c)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    image = b"\xff\xd8" + seg(0xFE, b"note") + seg(0xDB, bytes([0, 8] + [1] * 63)) + seg(0xC0, bytes([8, 0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + seg(0xC4, bytes([0, *media.DC_LENGTHS, *media.DC_SYMBOLS])) + seg(0xC4, bytes([0x10, 0, 3, *[0] * 14, 0x00, 0x21, 0xF0])) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    ((w, h, thumb),) = media.read([image])[0]
    assert (w, h) == (32, 16)
    assert thumb.tolist() == [[138, 135, 144, 144], [140, 140, 144, 124]]
    with pytest.raises(ValueError):
        media.read([image[:-2]])
    with pytest.raises(ValueError):
        media.read([b"GIF"])


def test_entries_count_only_while_they_are_listed(spark):
    changes = spark.createDataFrame(
        [("Bad.org", "x", "add", date(2024, 1, 10)), ("bad.org", "x", "remove", date(2024, 2, 1)), ("a.bad.org", "y", "add", date(2024, 1, 1)), (None, "z", "add", date(2024, 1, 1)), ("c.net", None, "add", None)],
        "key string, category string, listed string, since date",
    )
    pages = [(1, "http://bad.org/", date(2024, 1, 9)), (2, "HTTP://u:p@BAD.org:80/x", date(2024, 1, 10)), (3, "http://www.bad.org", date(2024, 2, 1)), (4, "http://a.bad.org/", date(2024, 1, 20)), (5, None, date(2024, 1, 20)), (6, "http://notbad.org/", date(2024, 1, 20)), (7, "http://bad.org", None), (2, "http://bad.org", date(2024, 1, 31))]
    captures = spark.createDataFrame(pages, "page_id long, url string, fetched date")
    for most in (100, 0):
        rows = urlfilter.judge(captures, changes, most).collect()
        assert sorted((r.page_id, r.blocked, r.matched_key) for r in rows if r.blocked) == [(2, True, "bad.org"), (2, True, "bad.org"), (4, True, "a.bad.org")]
        assert len(rows) == 8
    for most in (100, 0):
        assert urlfilter.judge(captures.limit(0), changes, most).count() == 0
        assert urlfilter.judge(captures, changes.limit(0), most).where("blocked").count() == 0


def test_forms_of_urls_and_keys(spark):
    day = date(2024, 1, 1)
    listed = ["a.org/x/", "a.org/x/y/z.html", "a.org/q?b=1", "[2001:db8::1]", "10.0.0.1", "Sub.b.org.", "c.org/"]
    changes = spark.createDataFrame([(k, "k", "add", day) for k in listed], "key string, category string, listed string, since date")
    urls = {
        "http://a.org/x/1.html": "a.org/x/", "https://A.org:8080/x/y/z.html#top": "a.org/x/y/z.html", "http://a.org/x": None, "http://a.org/X/": None, "http://www.a.org/x/1": None,
        "http://a.org/q?b=1#c": "a.org/q?b=1", "http://a.org/q?b=12": None, "http://a.org./x/?q": "a.org/x/", "http://[2001:DB8::1]:80/": "[2001:db8::1]", "http://10.0.0.1/": "10.0.0.1", "http://1.10.0.0.1/": None,
        "http://deep.sub.b.org..:1/": "sub.b.org", "http://c.org": "c.org/", "http://c.org?x": "c.org/", "mailto:x@a.org": None, "": None, "http://a.org/x/" + "d/" * 20_000: "a.org/x/",
    }
    captures = spark.createDataFrame([(i, u, day, "clash") for i, u in enumerate(urls)], "page_id long, url string, fetched date, key string")
    for most in (100, 0):
        got = {r.page_id: r.matched_key for r in urlfilter.judge(captures, changes, most).collect()}
        assert [got[i] for i in range(len(urls))] == list(urls.values())


def test_hot_keys_are_dealt_and_nothing_is_lost(spark):
    captures = spark.range(6000).selectExpr("id as page_id", "concat('http://', case when id % 3 = 0 then 'hot.example.com' else concat('h', id % 700, '.example.com') end, '/p/', id) as url", "date_add(date'2024-01-01', cast(id % 100 as int)) as fetched")
    changes = spark.range(1200).selectExpr("case when id < 400 then 'hot.example.com' else concat('h', id, '.example.com/p/') end as key", "concat('c', id % 7) as category", "case when id % 2 = 0 then 'add' else 'remove' end as listed", "date_add(date'2024-01-01', cast(id % 90 as int)) as since")
    one, two = (sorted(tuple(r) for r in urlfilter.judge(captures, changes, most).select("page_id", "blocked", "matched_key", "category").fillna("-").collect()) for most in (10**6, 0))
    assert len(one) == 6000 and one == two and sum(r[1] for r in one) > 1000


def test_query_equals_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = duck.execute(urlfilter.ORACLE).fetchall()
    got = [tuple(r) for r in urlfilter.digest(spark, d).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r[3] for r in got) and not all(r[3] for r in got)
