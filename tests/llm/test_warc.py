import base64
import hashlib
import io
import random
from collections import defaultdict

import pytest

from pathloom.llm import warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    again = base.where("page_id % 3 = 0").selectExpr("page_id + 10000 as page_id", "url", "html")
    odd = [(90001, None, None), (90002, "http://a b\n", ""), (90003, "u", "WARC/1.1\r\n\r\nWARC/1.0\r\n"), (90004, "é", "x" * 300_000), (None, "n", "x" * 300_000), (None, "m", "alone"), (90005, "r", "row"), (90005, "r", "row")]
    return base.unionByName(again).unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))


@pytest.mark.parametrize("compressed", [True, False])
def test_round_trip(pages, compressed):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    best = defaultdict(lambda: None)
    for page, data in rows:
        if page is not None:
            best[data] = page if best[data] is None else max(best[data], page)
    expected = sorted((page or -1, len(data), digest(data), *(("response", None) if best[data] in (page, None) else ("revisit", best[data]))) for page, data in rows)
    manifest = warc.write_archives(pages, compressed=compressed, file_bytes=1 << 16)
    got = warc.read_archives(manifest).collect()
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected
    assert all(r["payload"] is None or digest(r["payload"]) == r["payload_digest"] for r in got) and manifest.count() > 4


def archive(n, compressed):
    records = [warc.record(k, "u", (b"payload %d \r\n" % k) * 40, digest((b"payload %d \r\n" % k) * 40), None) for k in range(n)]
    return [warc.member(r) for r in records] if compressed else records


def read(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_salvage(compressed, seed):
    """Whatever bytes are damaged, lost or put in, the undamaged records are found, and records and gaps cover the file."""
    r = random.Random(seed)
    parts = archive(12, compressed)
    hurt = set(r.sample(range(12), 4))
    for k in hurt:
        p = bytearray(parts[k])
        at = r.randrange(20, len(p) - 20)
        match r.randrange(3):
            case 0:
                p[at] ^= 0x55
            case 1:
                del p[at : at + 15]
            case _:
                p[at:at] = b"\x1f\x8b\x08WARC/1.1\r\n"
        parts[k] = bytes(p)
    found = read(b"".join(parts))
    kept = {int(x.head["WARC-Record-ID"][10:-1]) for x in found if isinstance(x, warc.Record)}
    assert set(range(12)) - hurt <= kept
    at = 0
    for x in found:
        assert x.start == at
        at = x.end
    assert at == sum(map(len, parts))


def test_truncated_and_foreign_files():
    whole = b"".join(archive(3, True))
    assert [type(x).__name__ for x in read(whole[:-5])] == ["Record", "Record", "Gap"]
    assert [type(x).__name__ for x in read(b"hello " * 10)] == ["Gap"] and read(b"") == []
    mixed = archive(1, True)[0] + archive(2, False)[1]
    assert [type(x).__name__ for x in read(mixed)] == ["Record", "Record"]


def test_gaps_are_reported(spark, tmp_path):
    parts = archive(3, True)
    parts[1] = parts[1][:50]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    manifest = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), f"file://{tmp_path}")], "path string, folder string")
    got = [(r["record_type"], r["page_id"], r["gap_start"], r["gap_end"]) for r in warc.read_archives(manifest).collect()]
    assert got == [("response", 0, None, None), ("gap", None, len(parts[0]), len(parts[0]) + 50), ("response", 2, None, None)]


def test_empty(pages):
    assert warc.round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("compressed", [True, False])
def test_long_heads_and_foreign_records(spark, compressed):
    url = "data:text/html," + "<b>" * 40_000
    def foreign(kind, block, *fields):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{kind}>", f"WARC-Date: {warc.DATE}", *fields, f"Content-Length: {len(block)}"]
        return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    records = [
        warc.record(1, url, b"long", digest(b"long"), None), foreign("warcinfo", b"software: x\r\n"), foreign("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        foreign("response", chunked, "Content-Type: application/http; msgtype=response"), foreign("metadata", b""), foreign("resource", b"xyz", "WARC-Payload-Digest: sha1:" + digest(b"xyz")),
        foreign("resource", b"xyz", "WARC-Payload-Digest: sha1:" + digest(b"other")),
    ]
    found = read(b"".join(map(warc.member, records) if compressed else records))
    assert [x.head["WARC-Type"] if isinstance(x, warc.Record) else "gap" for x in found] == ["response", "warcinfo", "request", "response", "metadata", "resource", "gap"]
    assert found[0].head["WARC-Target-URI"] == url and found[3].payload == chunked[chunked.index(b"\r\n\r\n") + 4 :]


def test_round_trip_is_whole_or_fails(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u" * 200_000, "same"), (2, " " * 100_000, "same"), (3, "v", "other")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()) == [(1, "revisit", 2), (2, "response", None), (3, "response", None)]
    parts = archive(3, True)
    for k, (data, records) in enumerate([(b"".join(parts[:2]), 3), (parts[0] + parts[1][:50] + parts[2], 3)]):
        (tmp_path / f"{k}.warc.gz").write_bytes(data)
        manifest = spark.createDataFrame([(str(tmp_path / f"{k}.warc.gz"), f"file://{tmp_path}", records)], "path string, folder string, records long")
        with pytest.raises(Exception, match="2 of 3 records|no valid record"):
            warc.read_archives(manifest, whole=True).collect()


def test_other_writers_records():
    """Field names in any case, folded lines, digests in hex and of other kinds, no inner length."""
    import hashlib

    def other(block, *fields):
        return ("\r\n".join(["WARC/1.0", "warc-type:response", "WARC-RECORD-ID: <urn:x:1>", "Warc-Date:  2020-01-01T00:00:00Z", *fields, f"content-length:{len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    block = b"HTTP/1.0 200 OK\r\n\r\nbody"
    good = [
        other(block), other(block, "WARC-Payload-Digest: SHA-256:" + hashlib.sha256(b"body").hexdigest()), other(block, "warc-payload-digest: md5:" + hashlib.md5(b"body").hexdigest().upper()),
        other(block, "WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest(), "X-Note: a\r\n  b"), other(block, "WARC-Payload-Digest: blake9:whatever"),
    ]
    found = read(b"".join(good))
    assert [x.payload for x in found] == [b"body"] * 5 and found[3].head["x-note"] == "a b"
    bad = other(block, "WARC-Payload-Digest: sha256:" + hashlib.sha256(b"x").hexdigest())
    found = read(good[0] + bad + good[1])
    assert [type(x) for x in found] == [warc.Record, warc.Gap, warc.Record] and (found[1].start, found[1].end) == (len(good[0]), len(good[0] + bad))


def test_damage_is_searched_once():
    """Very many false beginnings without an end do not make the search quadratic."""
    reads = []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            reads.append(n)
            return super().read(n)

    data = b"WARC/1.1 x\r\n" * 200_000
    found = list(warc.salvage(Counting(data), len(data)))
    assert [(x.start, x.end) for x in found] == [(0, len(data))] and len(reads) < 100
