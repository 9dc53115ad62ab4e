import hashlib
import io
import re

import pytest
import zstandard

from lattica.llm import warc
from lattica.llm.catalog import op3_warc
from lattica.session import shared_path

SF = "/root/testdata/sf0.01"


def brute(rows):
    payload = [(i, (h or "").encode()) for i, h in rows]
    keeper = {}
    for i, p in payload:
        if len(p) >= 1000 and i is not None:
            keeper[p] = max(i, keeper.get(p, i))
    out = []
    for i, p in payload:
        k = keeper.get(p)
        refers = k if k is not None and k != i else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_whole_table(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op3_warc(spark, SF).collect()), key=str) == brute(rows)


def test_round_trip_and_edges(spark):
    big = "<p>é " * 400
    rows = [(1, "http://a/\r\nX: y", big), (9, None, big), (5, "http://ü/", big), (None, "u", big), (2, "", None), (3, "", "")]
    rows += [(4, "", "z" * 999), (6, "", "z" * 999), (7, "", "q" * 3_000_000), (9, None, big), (8, "x", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as size")
    manifest = warc.write_archives(pages.repartition(3), shared_path(spark, "warc"), archive_bytes=20_000)
    got = warc.read_archives(manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(
        [(i, h) for i, _, h in rows]
    )
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert (r.payload is None) if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id]
    assert {r.url for r in got if r.page_id == 1} == {"http://a/%0D%0AX: y"}
    empty = warc.write_archives(pages.limit(0), shared_path(spark, "warc"))
    assert warc.read_archives(empty).count() == 0


def archive(records, dictionary=b""):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, dictionary)
    for r in records:
        writer.add(r)
    return out.getvalue()


def records(n=50):
    return [warc.record_bytes(i, f"http://h/{i}", f"<p>page {i}</p>".encode() * 40, hashlib.sha1(f"<p>page {i}</p>".encode() * 40).hexdigest()) for i in range(n)]


def test_dictionary_is_loaded_plain_or_compressed():
    dictionary = warc.train_dictionary([r for r in records(300)])
    assert dictionary
    data = archive(records(), dictionary)
    assert [d for _, d in warc.read_archive(io.BytesIO(data))] == records()
    packed = zstandard.compress(dictionary)
    again = warc.SKIPPABLE_MAGIC + len(packed).to_bytes(4, "little") + packed + data[8 + len(dictionary) :]
    assert [d for _, d in warc.read_archive(io.BytesIO(again))] == records()


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d[4:],
        lambda d: d[:-3],
        lambda d: d + b"junk",
        lambda d: d[:200] + bytes([d[200] ^ 255]) + d[201:],
        lambda d: d[:6],
    ],
)
def test_damaged_archives_are_refused(change):
    with pytest.raises(warc.WarcError):
        for _, data in warc.read_archive(io.BytesIO(change(archive(records(5))))):
            warc.parse_record(data)


@pytest.mark.parametrize(
    "old, new",
    [
        (b"WARC/1.1", b"WARC/9"),
        (b"\r\nContent-Length: ", b"\r\nContent-Length: 1"),
        (b"WARC-Type: response", b"WARC-Type: other"),
        (b"WARC-Date: ", b"Date: "),
        (b"sha1:", b"sha1:0"),
        (b"<p>page", b"<p>pagf"),
        (b"WARC-Date:", b"WARC-Date"),
        (b"urn:x-page:", b"urn:page:"),
    ],
)
def test_malformed_records_are_refused(old, new):
    good = records(1)[0]
    warc.parse_record(good)
    with pytest.raises(warc.WarcError):
        warc.parse_record(re.sub(re.escape(old), new.replace(b"\\", b"\\\\"), good, count=1))
