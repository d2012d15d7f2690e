"""WARC archives: the round trip and lookups against the pages themselves."""
import gzip
import hashlib
from collections import defaultdict

import pyarrow.fs as pafs
import pytest

from fleet_health.llm.warc import directory, lookup, parse_record, record_bytes, round_trip, url_key, write_archives
from llm_helpers import counted

SAME = "<p>" + "same payload " * 20 + "</p>"


def page_rows():
    out = [(i, f"http://h{i % 7}.Example.org:80/p/{i % 11}?q={i}", f"<p>{'é' * (i % 200)}</p>") for i in range(1, 300)]
    out += [(1000 + i, f"https://x.org/{i % 3}", SAME) for i in range(60)]
    out += [(500, "https://x.org/0", SAME), (500, "https://x.org/0", SAME), (501, None, None), (502, "no scheme", ""), (503, "", None),
            (504, "http://a b.org/\r\nX: y<>", "\r\n\r\nWARC/1.1"), (505, "http://ä.org/😀%20", SAME + "\x00"), (None, "http://n.org/", "x" * 150),
            (506, "http://big.org/", "y" * 2_000_000), (507, "http://n.org/", "x" * 150), (508, "http://s.org", "é" * 49), (509, "http://s.org", "é" * 49),
            (510, "http://s.org", "é" * 50), (511, "http://s.org", "é" * 50)]
    return out


def brute(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= 100:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = b in first and first[b] != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return out


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "k", "t") for r in page_rows()], "page_id bigint, url string, html string, key string, type string").repartition(4)


def test_round_trip(pages):
    got = round_trip(pages, archives=5, archive_bytes=20_000)
    assert counted(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == counted(brute(page_rows()))
    assert got.select("archive").distinct().count() > 5
    assert round_trip(pages.limit(0)).count() == 0


def test_files_are_plain_warc(spark, pages):
    folder = write_archives(pages, archives=3)
    n = 0
    for a in {r["archive"] for r in directory(spark, folder).collect()}:
        fs, path = pafs.FileSystem.from_uri(a)
        raw = gzip.decompress(fs.open_input_file(path).read())
        n += raw.count(b"\r\nWARC-Record-ID: ")
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
    assert n == len(page_rows())


def test_lookup(spark, pages):
    folder = write_archives(pages, archives=4, archive_bytes=5_000)
    keys = pages.select(url_key(pages.url).alias("key"), "page_id").collect()
    by_key = defaultdict(list)
    for r in keys:
        by_key[r["key"]].append(r["page_id"])
    some = sorted(by_key)[::5] + ["org,x)/0", "absent", "zz"]
    got = defaultdict(list)
    html = {p: (h or "").encode() for p, _, h in page_rows()}
    for r in lookup(folder, spark.createDataFrame([(k,) for k in some], "key string"), payload=True).collect():
        p = None if r["id"] is None else int(r["id"])
        got[r["key"]].append(p)
        assert (r["payload"] is None) == (r["type"] == "revisit") and (r["payload"] is None or bytes(r["payload"]) == html[p])
    assert {k: counted(v) for k, v in got.items()} == {k: counted(by_key[k]) for k in some if k in by_key}


def test_damage_is_noticed():
    data = record_bytes("1", "http://a/", "response", b"abc", "0", None)
    h, payload = parse_record(data)
    assert payload == b"abc" and h["WARC-Record-ID"] == "<urn:x-capture:id:1>"
    with pytest.raises(Exception):
        parse_record(data[:-4])
    with pytest.raises(ValueError):
        parse_record(gzip.compress(gzip.decompress(data).replace(b"\r\n\r\nHTTP", b"\r\n\r\nHTT")))
