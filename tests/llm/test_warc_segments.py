import gzip
import hashlib

import pytest

from sitemill.llm import warc_segments as A
from sitemill.workspace import new_path

LONG = "ä\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nx" * 3000
PAGES = [
    (5, "http://a.org/", "x" * 100),
    (3, "http://b.org/", "x" * 100),
    (4, None, "x" * 99),
    (6, "http://c.org/", "x" * 99),
    (7, "u\r\nWARC-Type: bad", None),
    (8, "", ""),
    (9, "http://d.org/", LONG),
    (2, "http://e.org/", LONG + "!"),
    (3, "http://b.org/", "x" * 100),
    (None, "http://n.org/", "x" * 100),
    (None, "http://n.org/", "y" * 200),
]


def brute(pages):
    first = {}
    for i, _, h in pages:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        to = first.get(h)
        revisit = to is not None and to != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_written_and_read_back(spark):
    pages = spark.createDataFrame([(*p, "clash", "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, value string, refers_to int")
    got = [tuple(r) for r in A.report(pages, new_path(spark, "t")).collect()]
    assert sorted(got, key=str) == brute(PAGES)
    assert A.report(pages.where("false"), new_path(spark, "t")).count() == 0


def test_payloads_and_targets(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    A.write(pages, path := new_path(spark, "t"), segment_bytes=1000)
    found = {r.page_id: r for r in A.read(spark, path).collect() if r.page_id is not None}
    assert bytes(found[9].payload).decode() == LONG and bytes(found[2].payload).decode() == LONG + "!"
    assert found[4].target is None and found[7].target == "u%0D%0AWARC-Type: bad" and found[9].error is None


def test_archives_are_warc_files(spark):
    A.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path := new_path(spark, "t"))
    whole = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(path).collect())
    kinds = [h["warc-type"] for h, _ in A.parse(whole)]
    assert kinds.count("response") + kinds.count("revisit") == len(PAGES) and kinds.count("continuation") >= 2
    assert whole.endswith(A.END)


def segments(block, size):
    parts = [block[i : i + size] for i in range(0, len(block), size)]
    return [{"number": n, "total": len(block) if n == len(parts) else None, "block": p} for n, p in enumerate(parts, 1)]


def test_damaged_segments():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + A.chunked(b"payload" * 50, 64)
    parts = segments(block, 40)
    assert A.joined_segments(parts) == (b"payload" * 50, None)
    assert A.joined_segments([parts[0], *parts]) == (b"payload" * 50, None)
    assert A.joined_segments(parts[:1] + parts[2:])[1] == "segment missing"
    assert A.joined_segments(parts[1:])[1] == "segment missing"
    assert A.joined_segments(parts[:-1])[1] == "last segment missing"
    assert "total length" in A.joined_segments([*parts[:-1], parts[-1] | {"total": 3}])[1]
    assert "two different" in A.joined_segments([parts[0] | {"block": b"x"}, *parts])[1]


@pytest.mark.parametrize("body", [b"5\r\nhel", b"zz\r\n", b"3\r\nhello\r\n0\r\n\r\n", b""])
def test_damaged_chunks(body):
    with pytest.raises(ValueError):
        A.unchunked(body)
    assert A.unchunked(b"3;a=b\r\nabc\r\n0\r\nT: x\r\n\r\n") == b"abc"


def _plain(name, page, text, **more):
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("Page-ID", page), *more.items()]
    return A.record(headers, b"HTTP/1.1 200 OK\r\n\r\n" + text) + A.END


def test_damaged_records_keep_their_row_and_the_others(spark, tmp_path):
    good = [_plain(f"g{i}", i, b"text %d" % i) for i in range(5)]
    longer = _plain("d1", 11, b"abc").replace(b"Content-Length: 22", b"Content-Length: 900000")
    other = _plain("d2", 12, b"abc").replace(b"Content-Length: 22", b"Content-Length: 20")
    without = _plain("d3", 13, b"abc").replace(b"Content-Length: 22", b"X: 22")
    odd_page = _plain("d4", "1e", b"abc")
    odd_segment = _plain("d5", 15, b"abc", **{"WARC-Segment-Number": "one"})
    assert all(b"Content-Length: 22" in _plain(n, 11, b"abc") for n in ("d1", "d2"))
    parts = [good[0], longer, good[1], other, good[2], b"junk" + A.END, without, good[3], odd_page, odd_segment, good[4]]
    data = b"".join([*parts, _plain("d6", 16, b"abc")[:30]])
    (tmp_path / "a.warc").write_bytes(data)
    found = A.read(spark, str(tmp_path / "a.warc")).collect()
    kept = {r.record_id: bytes(r.payload) for r in found if r.error is None}
    assert kept == {f"g{i}": b"text %d" % i for i in range(5)}
    reasons = {r.record_id: r.error.split(" at byte")[0] for r in found if r.error and r.record_id}
    assert reasons == {
        "d1": "block cut off",
        "d2": "block has another length than stated",
        "d3": "no content length",
        "d4": "page id is not a number",
        "d5": "segment number is not a number",
    }
    assert sorted(r.error.split(" at byte")[0] for r in found if r.error and not r.record_id) == ["headers cut off", "no record"]
    with pytest.raises(ValueError):
        list(A.parse(data))


def test_archives_cut_off_or_empty(spark, tmp_path):
    records = [_plain(f"g{i}", i, bytes(range(256)) * (i + 1)) for i in range(40)]
    members = b"".join(gzip.compress(r) for r in records)
    whole = gzip.compress(b"".join(records))
    assert A.unzipped(members) == A.unzipped(whole) == b"".join(records)
    (tmp_path / "cut.gz").write_bytes(members[: len(members) - 40])
    (tmp_path / "empty.gz").write_bytes(b"")
    (tmp_path / "none.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "odd.gz").write_bytes(b"\x1f\x8bno archive")
    # binaryFile hands the bytes over as they are
    found = A.read(spark, str(tmp_path / "*.gz")).collect()
    assert {r.record_id for r in found if r.error is None} == {f"g{i}" for i in range(39)}
    assert all(r.payload is None for r in found if r.error)


def test_a_damaged_segment_is_reported_with_its_record(spark, tmp_path):
    block_parts = A.response_records("<o>", [("Page-ID", 1)], b"z" * 5000, 1000)
    broken = block_parts[2].replace(b"Content-Length: 1000", b"Content-Length: 990")
    assert broken != block_parts[2]
    data = b"".join(p + A.END for p in [*block_parts[:2], broken, *block_parts[3:]]) + _plain("g", 2, b"fine")
    (tmp_path / "s.warc").write_bytes(data)
    found = {r.record_id: r for r in A.read(spark, str(tmp_path / "s.warc")).collect()}
    assert found["<o>"].error == "segment missing" and found["<o>"].payload is None
    assert sum(r.error is not None for r in found.values()) == 2 and bytes(found["g"].payload) == b"fine"
