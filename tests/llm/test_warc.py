import gzip
import hashlib
import struct
import zipfile

import pytest

from gleaner.llm import warc

PAGES = "page_id long, url string, html string, payload string, digest string, first int, revisit int, records int"


def build(tmp_path, records, zip64=False, name="a.zip"):
    path = str(tmp_path / name)
    writer = warc.ArchiveWriter(warc.create(path), zip64)
    for n, data in enumerate(records):
        writer.add(data, page=str(n))
    writer.close()
    return path


@pytest.mark.parametrize("zip64", [False, True])
def test_archive_round_trip_and_format(tmp_path, zip64):
    payloads = [b"", b"x" * 5000, "é <p>".encode(), b"\r\n\r\nWARC/1.1 in the payload"]
    records = [warc.record(n, f"http://a/{n}", p, hashlib.sha1(p).hexdigest(), None, False) for n, p in enumerate(payloads)]
    path = build(tmp_path, records, zip64)
    assert (struct.pack("<I", warc.END64) in open(path, "rb").read()) == zip64
    with zipfile.ZipFile(path) as z:  # others can read what we write
        assert z.testzip() is None and z.namelist() == [warc.RECORDS, warc.INDEX]
        assert gzip.decompress(z.read(warc.RECORDS)) == b"".join(records)
    got = list(warc.read_records(path))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == payloads
    assert [h["warc-target-uri"] for h, _ in got] == [f"http://a/{n}" for n in range(4)]


def test_reads_others_archives_with_comments(tmp_path):
    path = tmp_path / "b.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("one", b"1" * 10)
        z.writestr("two", b"2" * 20)
        z.comment = b"PK\x05\x06 a comment that looks like an end" + b"\0" * 30
    with warc.Ranges(str(path)) as src:
        members = warc.directory(src)
        assert [(m.name, m.size) for m in members] == [("one", 10), ("two", 20)]
        assert src.read(warc.data_offset(src, members[1]), 20) == b"2" * 20


def test_zip64_sizes_come_from_the_extra_field():
    extra = struct.pack("<HH", 9, 2) + b"xx" + struct.pack("<HHQQ", warc.EXTRA64, 16, 5 << 32, 7 << 32)
    assert warc._wide(extra, warc.FULL32, 12, warc.FULL32) == [5 << 32, 12, 7 << 32]


def test_what_is_not_an_archive_raises(tmp_path):
    bad = tmp_path / "bad.zip"
    for data in (b"", b"not a zip", b"PK" * 40):
        bad.write_bytes(data)
        with warc.Ranges(str(bad)) as src, pytest.raises(ValueError):
            warc.directory(src)
    with zipfile.ZipFile(bad, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", b"1" * 1000)
    with warc.Ranges(str(bad)) as src, pytest.raises(ValueError):
        warc.data_offset(src, warc.directory(src)[0])
    with pytest.raises(ValueError):
        warc.parsed(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort")


def test_only_the_record_s_range_is_read(tmp_path, monkeypatch):
    import random

    noise = random.Random(1).randbytes(200_000)
    records = [warc.record(n, None, noise, "0", None, False) for n in range(10)]
    path = build(tmp_path, records)
    read = []
    monkeypatch.setattr(warc.Ranges, "read", lambda self, o, n: read.append(n) or self.file.read_at(n, o))
    next(warc.read_records(path))
    assert sum(read) < 500_000


def plain(rows):
    out = []
    large = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            large[data] = max(large.get(data, page), page)
    for page, _, html in rows:
        data = (html or "").encode()
        first = large.get(data)
        revisit = first is not None and page != first
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def test_archived_equals_plain_version(spark):
    long, other = "long payload " * 100, "é" * 500
    rows = [(1, "u1", long), (2, "u2", "short"), (3, "u3", "short"), (4, "u\r\n4", long), (5, None, None), (6, "u6", ""), (7, "u7", other), (None, "n", other)]
    rows += [(8, "u8", "x" * 999), (9, "u9", "x" * 999), (10, "u10", long), (10, "u10", long), (11, "é", "y" * 1000)]
    pages = spark.createDataFrame([(*r, "p", "d", 1, 2, 3) for r in rows], PAGES)
    got = [tuple(r) for r in warc.archived(pages).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_hot_payload_and_rolled_archives(spark, tmp_path):
    pages = spark.range(3000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, repeat('same', 300), concat(repeat('x', 1200), id)) as html")
    manifest = warc.write_archives(pages, str(tmp_path), archive_bytes=20_000)
    assert manifest.count() > 4
    rows = warc.read_archives(manifest).collect()
    assert len(rows) == 3000
    revisits = [r for r in rows if r.record_type == "revisit"]
    assert len(revisits) == 999 and {r.refers_to for r in revisits} == {2997}


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0
