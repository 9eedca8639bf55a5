import base64
import hashlib
import zlib
from collections import Counter

import pytest

from codequarry.llm import media, warc


def test_media_round_trip(odd_docs, no_docs):
    got = media.media_columns(odd_docs).collect()
    want = Counter()
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        want[(r.doc_id, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    same = {(r.media_sha256, r.feature) for r in got if r.doc_id in (2, 3)}
    assert len(same) == 1 and all(r.media_bytes == r.payload_bytes + 44 for r in got)
    assert media.media_columns(no_docs).count() == 0


def test_ranges_cover_members_once(spark):
    df = spark.createDataFrame([(i, "x" * (i * 37 % 5000)) for i in range(200)], "doc_id long, text string").repartition(3)
    _, manifest = media.write_archives(df)
    folder = manifest.inputFiles()[0].rpartition("/")[0]
    for size in (1_000, 50_000, 10**9):
        ids = [r.doc_id for r in media.read_archives(spark, folder, range_bytes=size).select("doc_id").collect()]
        assert sorted(ids) == list(range(200))


def test_partitions_are_bounded(spark):
    df = spark.createDataFrame([(i, f"{i} " * 900) for i in range(200)], "doc_id long, text string").repartition(6)
    _, manifest = media.write_archives(df)
    folder = manifest.inputFiles()[0].rpartition("/")[0]
    total = sum(r.bytes for r in manifest.collect())
    for most in (1, 3, 100):
        parts = media.MediaArchiveReader({"path": folder, "range_bytes": 1_000, "partitions": most}).partitions()
        assert len(parts) <= most and sum(e - b for p in parts for _, b, e in p.ranges) == total
        ids = [r.doc_id for r in media.read_archives(spark, folder, range_bytes=1_000, partitions=most).select("doc_id").collect()]
        assert sorted(ids) == list(range(200))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "m", "s", "f"), (2, None, None, None, None)], "doc_id long, text string, media string, sha256 string, feature string")
    assert sorted(r.n_bytes for r in media.media_columns(df).collect()) == [0, 1]
    p = spark.createDataFrame([(1, "u", "x", b"h", 5, "r"), (2, "u", "x", b"h", 5, "r")], "page_id long, url string, html string, head binary, sha256 long, record string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archive(p).collect()) == [(1, "revisit", 2), (2, "response", None)]


def test_damaged_member_is_told_alone(spark):
    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(5)], "doc_id long, text string").coalesce(1)
    _, manifest = media.write_archives(df)
    folder, path = manifest.inputFiles()[0].rpartition("/")[0], manifest.first().archive.removeprefix("file://")
    rows = sorted(media.read_archives(spark, folder).collect(), key=lambda r: r.offset)
    data = bytearray(open(path, "rb").read())
    at = rows[2].offset + 60
    data[at : at + 8] = b"\xff" * 8
    open(path, "wb").write(data)
    again = media.read_archives(spark, folder, retries=1).collect()
    assert [r.doc_id for r in again if r.error] == [rows[2].doc_id]
    assert sum(r.media is not None for r in again) == 4
    with pytest.raises(Exception, match="OSError|checksum|Error"):
        media.features(media.read_archives(spark, folder, retries=0)).collect()


def test_transient_failures_are_retried():
    class Flaky:
        left = 2

        def open_input_file(self, path):
            Flaky.left -= 1
            if Flaky.left >= 0:
                raise OSError("gone")
            return open_it(path)

    import os
    import tempfile
    import zipfile

    from pyarrow import fs

    def open_it(path):
        return fs.LocalFileSystem().open_input_file(path)

    path = os.path.join(tempfile.mkdtemp(), "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("m", b"data")
        info = z.infolist()[0]
    reader = media.MediaArchiveReader({"path": path, "retries": 3})
    assert reader._member(Flaky(), path, info) == (b"data", None)


PAGES = "page_id long, url string, html string, digest string"


def pages(spark):
    rows = [(1, "u1", "<p>a</p>", "x"), (2, "u 2\r\nX: y", "<p>a</p>", "x"), (3, None, None, None), (4, "u4", "", "x"), (5, "u5", "<p>b</p>", "x"), (7, "é", "é" * 100_000, "x")]
    return spark.createDataFrame(rows, PAGES)


def test_warc_result(spark):
    got = {r.page_id: r for r in warc.archive(pages(spark)).collect()}
    for r in pages(spark).collect():
        raw = (r.html or "").encode()
        assert got[r.page_id].payload_bytes == len(raw)
        assert got[r.page_id].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 7: ("response", None)}
    small = {r.page_id: r.record_type for r in warc.archive(pages(spark), least=5).collect()}
    assert small[3] == "response" and small[1] == "revisit"


def test_warc_records_come_back_whole(spark):
    index, heads = warc.write(pages(spark))
    assert index.count() == 4  # each payload once
    html = {r.page_id: (r.html or "").encode() for r in pages(spark).collect()}
    for r in warc.reconstruct(index, heads).collect():
        fields, block = warc.split_record(bytes(r.record))
        body = block.partition(b"\r\n\r\n")[2]
        assert body == (html[r.page_id] if fields["WARC-Type"] == "response" else b"")
        assert "X" not in fields and ("WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit")


def test_warc_small_records_of_equal_payloads(spark):
    index, heads = warc.write(pages(spark), least=1_000)
    assert sorted(r.page_id for r in warc.reconstruct(index, heads).collect()) == [1, 2, 3, 4, 5, 7]


def test_warc_damage_stops_the_job(spark):
    index, _ = warc.write(pages(spark).where("page_id = 5"))
    r = index.first()
    path = r.file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[r.offset + r.size - 12] ^= 0xFF
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="Error"):
        warc.payloads(index).collect()


def test_warc_odd_tables(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(1, "u", "x", ""), (1, "u", "x", ""), (None, "u", "x", ""), (None, None, "only", "")]
    got = warc.archive(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 4


def test_a_range_is_read_once_in_order(spark, monkeypatch):
    """One handle and few large reads, whatever the number of members; a long member takes one read of its own."""
    reads = []
    data = bytes(range(256)) * 400
    file = type("File", (), {"read_at": lambda self, n, at: reads.append((at, n)) or data[at : at + n]})()
    monkeypatch.setattr(media, "BATCH", 10_000)
    ahead = media.Ahead(file, 60_000)
    at = 0
    while at < 60_000:
        n = 30_000 if at == 20_000 else 500
        assert ahead.get(at, 30) == data[at : at + 30] and ahead.get(at, n) == data[at : at + n]
        at += n
    assert len(reads) <= 8 and [a for a, _ in reads] == sorted(a for a, _ in reads)
