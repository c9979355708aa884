import io
import struct

import pytest
import zstandard

from runout.llm import warc as W


def archive(records, dictionary=b"", compressed=False):
    if not dictionary:
        return b"".join(zstandard.ZstdCompressor().compress(r) for r in records)
    stored = zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return W.dictionary_frame(stored) + b"".join(c.compress(r) for r in records)


def rec(page_id=1, payload=b"<p>x</p>", revisit=False, refers_to=None, url="http://a.b/c"):
    return W.record(page_id, url, payload, refers_to, revisit, "2024-01-01T00:00:00Z")


@pytest.mark.parametrize("compressed", [False, True])
def test_dictionary_in_the_leading_frame(compressed):
    records = [rec(i, b"payload %d " % i * 50) for i in range(30)]
    data = archive(records, rec(0, b"payload payload"), compressed)
    assert list(W.frames(io.BytesIO(data))) == records
    assert struct.unpack("<I", data[:4])[0] == 0x184D2A5D


def test_without_dictionary_and_with_large_records():
    records = [rec(1, b"a" * 3_000_000), rec(2, b""), rec(3, bytes(range(256)) * 3000)]
    got = list(W.read_records(io.BytesIO(archive(records)), "x"))
    assert [len(r["payload"]) for r in got] == [3_000_000, 0, 768_000]
    assert list(W.frames(io.BytesIO(b""))) == []


def test_records_read_back_as_written():
    r = W.parse(rec(7, "ä".encode(), url="http://x/ y\r\nz"))
    assert (r["page_id"], r["record_type"], r["payload"], r["url"]) == (7, "response", "ä".encode(), "http://x/%20y%0D%0Az")
    r = W.parse(rec(None, b"abc", revisit=True, refers_to=9, url=None))
    assert (r["page_id"], r["refers_to"], r["payload_bytes"], r["payload"], r["url"]) == (None, 9, 3, b"", None)
    assert r["payload_digest"] == "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5"


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARC/9"),
        lambda r: r.replace(b"WARC-Date", b"X-Date"),
        lambda r: r.replace(b"<p>x</p>", b"<p>y</p>"),
        lambda r: r.replace(b"<p>x</p>", b"<p>xx</p>"),
        lambda r: r[:-2],
        lambda r: r + b"x",
        lambda r: r.replace(b"Content-Length: 8", b"Content-Length: 9"),
        lambda r: r.replace(b"Content-Length: ", b"Content-Length: -"),
        lambda r: r.replace(b"response\r", b"metadata\r"),
        lambda r: r.replace(b"<urn:page:1>", b"<urn:other:1>"),
        lambda r: b"",
    ],
)
def test_damaged_records_are_refused(change):
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(archive([change(rec())])), "damaged"))


def test_cut_off_archives_are_refused():
    data = archive([rec()], rec(0, b"dictionary"))
    for cut in (len(data) - 3, 20):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(W.frames(io.BytesIO(data[:cut])))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, response long")


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_round_trip_of_edge_rows(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr("runout.llm.common.BROADCAST_ROWS", broadcast_rows)
    rows = [(i, f"http://h/{i}", "copy" if i % 3 else f"own {i}" * i) for i in range(90)]
    rows += [(None, None, "copy"), (None, "u", "alone"), (95, "u", None), (96, "u", ""), (89, "again", "copy")]
    rows += [(97, "long", "é" * 400_000)]
    df = pages(spark, [(*r, "x", 1) for r in rows])
    got = W.read_archives(W.write_archives(df)).collect()
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        payload = (html or "").encode()
        top = None if best[html or ""] < 0 else best[html or ""]
        revisit = i != top
        want.append((i, len(payload), W.base32_sha1(payload), "revisit" if revisit else "response", top if revisit else None))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.payload.decode() == "é" * 400_000 for r in got if r.page_id == 97)


def test_small_payloads_are_responses_and_empty_tables_have_none(spark):
    df = pages(spark, [(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abc", "", 0), (4, "u", "abc", "", 0)])
    got = {r.page_id: r.refers_to for r in W.read_archives(W.write_archives(df, min_bytes=3)).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
    assert W.read_archives(W.write_archives(df.where("false"))).count() == 0


def test_records_that_could_not_be_read_are_not_written(spark, monkeypatch):
    monkeypatch.setattr(W, "RECORD_BYTES", 2000)
    pages = spark.createDataFrame([(1, "http://a/", "x" * 500), (2, "http://b/", "y" * 3000)], "page_id long, url string, html string")
    assert W.read_archives(W.write_archives(pages.where("page_id = 1"))).count() == 1
    with pytest.raises(Exception, match="page 2: record of over 2000 bytes"):
        W.write_archives(pages)
    with pytest.raises(ValueError, match="record of over 2000 bytes"):
        list(W.read_records(io.BytesIO(archive([rec(1, b"a" * 5000)])), "x"))
