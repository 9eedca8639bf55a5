"""Media columns: payloads stored in archives and read back by a Spark data source.

Writing: each task packs its rows as WAV members (8-bit mono samples) into ZIP archives of
about ``ARCHIVE`` bytes in shared storage. Reading: the data source ``media_archive`` plans partitions of byte ranges
of the archives, ``RANGE`` bytes each, or more where that would make over ``PARTITIONS`` partitions. A partition reads its
archives' central directories, takes the members whose local header begins inside its ranges, fetches and
decodes each by its offset, and streams them as Arrow batches. A member that fails is tried
again by its own offset (``retries`` times) without touching its neighbours; if it keeps
failing its row carries the error and a null payload.

Payload of a text: its UTF-8 bytes and then zero bytes up to a positive multiple of 64.

Defined cases: null counts as empty (64 zero bytes); equal texts have equal values; a null
doc_id and repeated rows are kept (a member's name is its place in the archive, the id goes
into the member's comment); an empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import create, open_fs, task_file
from .common import cut, id_and_text, shared_dir, ship, slices

ARCHIVE, RANGE, BATCH, RETRIES, RATE = 32 << 20, 8 << 20, 4 << 20, 3, 8000
PARTITIONS = 50_000  # the driver plans so many partitions at most, whatever the input
_WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes((-len(data)) % 64 or (64 if not data else 0))


def to_wav(samples: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    n = len(samples)
    return _WAV.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples


def from_wav(media: bytes) -> bytes:
    riff, _, wave, fmt, _, kind, channels, _, _, _, bits, data, n = _WAV.unpack_from(media)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) != _WAV.size + n:
        raise ValueError("not an 8-bit mono WAV member")
    return media[_WAV.size :]


def feature_of(samples: bytes) -> str:
    """Mean, root mean square about the middle, crossings of the middle, and a 16-bucket level histogram."""
    x = np.frombuffer(samples, dtype=np.uint8)
    levels = np.bincount(x >> 4, minlength=16)
    y = x.astype(np.int64) - 128
    cross = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    # integers only until the division, so that the text is the same on every machine
    return f"mean={int(x.sum(dtype=np.int64)) / len(x):.4f};power={int((y * y).sum()) / len(x):.4f};cross={cross};levels={'-'.join(map(str, levels))}"


def _write(folder: str):
    def run(batches):
        done, stream = [], None
        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if stream is None:
                    uri, members = task_file(folder, ".zip"), 0
                    stream = create(uri)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                info = zipfile.ZipInfo(f"{members:08d}.wav")
                data = payload_of(text)
                info.compress_type = zipfile.ZIP_DEFLATED
                info.comment = f"{'' if doc is None else doc},{len(text.encode('utf-8', 'surrogatepass'))}".encode()
                archive.writestr(info, to_wav(data), compresslevel=1)
                members += 1
                if stream.tell() >= ARCHIVE:
                    archive.close()
                    done.append((uri, stream.tell(), members))
                    stream.close()
                    stream = None
        if stream is not None:
            archive.close()
            done.append((uri, stream.tell(), members))
            stream.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["archive", "bytes", "members"])

    return run


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write the payloads; returns the folder and the manifest (archive, bytes, members)."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark, "media")
    return folder, cut(id_and_text(docs, id_col, text_col).mapInArrow(_write(folder), "archive string, bytes long, members long"), "media_manifest")


class Ahead:
    """Bytes of a file from requests in rising order: ``BATCH`` at a time, up to ``end``, or as many as one request takes."""

    def __init__(self, file, end: int):
        self.file, self.end, self.at, self.held = file, end, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(n, min(BATCH, self.end - at)), at)
        return self.held[at - self.at : at - self.at + n]


class ByteRanges(InputPartition):
    """Byte ranges (archive, begin, end) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


MEMBER = "archive string, offset long, doc_id long, n_bytes long, media binary, error string"


class MediaArchiveReader(DataSourceReader):
    """Options: archives (a manifest written by Spark), range_bytes, partitions (at most), retries."""

    def __init__(self, options):
        self.manifest = options["path"]
        self.range = int(options.get("range_bytes", RANGE))
        self.retries = int(options.get("retries", RETRIES))
        self.most = int(options.get("partitions", PARTITIONS))

    def partitions(self):
        import pyarrow.dataset as ds

        fs, path = open_fs(self.manifest)
        manifest = ds.dataset(path, filesystem=fs, format="parquet")
        rows = lambda: (r for b in manifest.to_batches(columns=["archive", "bytes"]) for r in zip(*(c.to_pylist() for c in b.columns)))
        step = max(self.range, -(-sum(size for _, size in rows()) // self.most))
        out, own, held = [], [], 0
        for archive, size in rows():
            at = 0
            while at < size:
                end = min(size, at + step - held)
                own.append((archive, at, end))
                held, at = held + end - at, end
                if held == step:
                    out.append(ByteRanges(own))
                    own, held = [], 0
        return [*out, ByteRanges(own)] if own or not out else out

    @staticmethod
    def _payload(get, info: zipfile.ZipInfo) -> bytes:
        """The member's bytes through ``get`` (offset, size), verified."""
        head = get(info.header_offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member at this offset")
        name, extra = struct.unpack("<HH", head[26:30])
        begin = 30 + name + extra
        raw = get(info.header_offset, begin + info.compress_size)[begin:]
        data = zlib.decompress(raw, -15) if info.compress_type == zipfile.ZIP_DEFLATED else raw
        if zlib.crc32(data) != info.CRC or len(data) != info.file_size:
            raise ValueError("checksum differs")
        return data

    def _member(self, fs, path: str, info: zipfile.ZipInfo, problem: str = "not read") -> tuple[bytes | None, str | None]:
        """A member that couldn't be taken from its range, by its offset, through handles of its own."""
        for attempt in range(self.retries):
            try:
                time.sleep(0.05 * 2**attempt)
                with fs.open_input_file(path) as f:
                    return self._payload(lambda at, n: f.read_at(n, at), info), None
            except Exception as e:  # noqa: BLE001 - any failure of one member is told in its row
                problem = f"{type(e).__name__}: {e}"
        return None, problem

    def read(self, partition: ByteRanges):
        names = [x.split()[0] for x in MEMBER.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        rows, size = [], 0
        for archive, begin, end in partition.ranges:
            fs, path = open_fs(archive)
            for info, media, error in self._members(fs, path, begin, end):
                doc, _, n = info.comment.decode().partition(",")
                rows.append((archive, info.header_offset, int(doc) if doc else None, int(n), media, error))
                size += len(media or b"")
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


    def _members(self, fs, path: str, begin: int, end: int):
        """(entry, bytes, error) of the members that begin in a range, which is read once, in order."""
        with fs.open_input_file(path) as f:
            members = sorted((i for i in zipfile.ZipFile(f).infolist() if begin <= i.header_offset < end), key=lambda i: i.header_offset)
            ahead = Ahead(f, end)
            for info in members:
                try:
                    yield info, self._payload(ahead.get, info), None
                except Exception as e:  # noqa: BLE001 - this member is tried by itself
                    yield info, *self._member(fs, path, info, f"{type(e).__name__}: {e}")


class MediaArchive(DataSource):
    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return MEMBER

    def reader(self, schema):
        return MediaArchiveReader(self.options)


def read_archives(spark: SparkSession, manifest_path: str, **options) -> DataFrame:
    """The members of all archives that the manifest names."""
    spark.dataSource.register(MediaArchive)
    reader = spark.read.format("media_archive")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(manifest_path)


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(members: DataFrame) -> DataFrame:
    """Digests and features of members, from their stored bytes; a member with an error stops the job."""

    def run(batches):
        names = [x.split()[0] for x in RESULT.split(", ")]
        for b in slices(batches, "media"):
            rows = []
            for doc, n, media, error in zip(*(b.column(i).to_pylist() for i in range(4))):
                if error is not None:
                    raise OSError(error)
                data = from_wav(media)
                rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]) & 0xFFFFFFFF, len(media), hashlib.sha256(media).hexdigest(), feature_of(data)))
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return members.select("doc_id", "n_bytes", "media", "error").mapInArrow(run, RESULT)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the payloads of ``docs`` in archives, read them back and compute their features."""
    _, manifest = write_archives(docs, id_col, text_col)
    folder = manifest.inputFiles()[0].rpartition("/")[0] if manifest.inputFiles() else None
    if folder is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    return features(read_archives(docs.sparkSession, folder))


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
