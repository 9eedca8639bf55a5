"""Content-addressed WARC archives.

Payload bytes are stored once for each SHA-256 digest, as gzip members of ``.warc.gz`` files
(one WARC record a member, so any WARC reader opens them); the exact header bytes of every
record, of responses and of revisits alike, are kept apart in a table that Spark writes.
A join by digest of headers and archive index (small rows, no payloads) says which member each record needs;
the records are then rebuilt file by file, in the order of the members. Every payload is checked against its digest
(and length) when it is read back, so a damaged archive stops the job instead of passing.

Of the records with equal payloads the one with the largest page_id is the response; the
others are revisits that refer to it. Digests are found inside the JVM, and only the row that is stored is compressed.
Joins by digest may meet a payload that a third of all pages share; they carry small rows and are sort-merge
joins, which adaptive execution splits.

Defined cases: null html counts as empty; null urls give an empty target, and white space in a url (which a header
can't hold) becomes single spaces; rows that share page_id and payload share one record and one result row each; rows
with a null page_id are responses when no other row holds the payload, else revisits; extra columns are neither read
nor returned; an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .archives import create, open_fs, task_file
from .common import cut, shared_dir, ship, slices

DATE = "1970-01-01T00:00:00Z"
CRLF = b"\r\n"
#: Extension fields of the records: the page's id and that of the response.
PAGE, REFERS = "WARC-Page-ID", "WARC-Refers-To-Page-ID"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _lines(*lines: str) -> bytes:
    return CRLF.join(x.encode("utf-8", "surrogatepass") for x in lines) + CRLF + CRLF


def record_head(page_id, url: str, digest: str, payload_bytes: int, refers_to) -> bytes:
    """The exact bytes of a record before its payload: WARC header and HTTP header."""
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {payload_bytes}")
    own = f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"
    target = " ".join(url.split())
    if refers_to is None:
        extra, length = [], len(http) + payload_bytes
    else:
        extra = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>"]
        length = len(http)
    extra += [f"{PAGE}: {page_id}"] * (page_id is not None) + [f"{REFERS}: {refers_to}"] * (refers_to is not None)
    kind = "response" if refers_to is None else "revisit"
    head = _lines("WARC/1.1", f"WARC-Type: {kind}", own, f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", *extra, "Content-Type: application/http;msgtype=response", f"Content-Length: {length}")
    return head + http


def payload_record(data: bytes, sha256: str) -> bytes:
    """One gzip member: a resource record that holds a payload under its strong digest."""
    head = _lines("WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:sha256:{sha256}>", f"WARC-Target-URI: urn:sha256:{sha256}", f"WARC-Date: {DATE}", f"WARC-Block-Digest: sha256:{sha256}", "Content-Type: text/html", f"Content-Length: {len(data)}")
    return gzip.compress(head + data + CRLF + CRLF, compresslevel=3, mtime=0)


def _compress(batches):
    """(sha256, member) of rows (sha256, html)."""
    for b in slices(batches, "html"):
        html = [t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
        members = [payload_record(h, s.hex()) for h, s in zip(html, b.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(members, pa.binary())], names=["sha256", "member"])


def _store(folder: str):
    def run(batches):
        rows, stream = [], None
        for b in batches:
            for sha, member in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if stream is None:
                    uri = task_file(folder, ".warc.gz")
                    stream = create(uri)
                rows.append((uri, stream.tell(), len(member), sha))
                stream.write(member)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["file", "offset", "size", "sha256"])

    return run


def _heads(batches):
    """The header of each record, from rows (page_id, url, sha1 in hex, payload_bytes, refers_to, sha256)."""
    for b in batches:
        rows = zip(*(b.column(i).to_pylist() for i in range(5)))
        heads = [record_head(p, u or "", base64.b32encode(bytes.fromhex(d)).decode(), n, r) for p, u, d, n, r in rows]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 4, 5)), pa.array(heads, pa.binary())], names=["page_id", "refers_to", "sha256", "head"])


def write(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Write the archives; returns the index (file, offset, size, sha256) and the headers, as tables in shared storage.

    Payloads smaller than ``least`` bytes are responses in every record.
    """
    spark = pages.sparkSession
    ship(spark)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), html.alias("html"), F.col(url_col).cast("string").alias("url"))
    strong = F.unhex(F.sha2("html", 256))
    seen = cut(rows.select("page_id", "url", strong.alias("sha256"), F.sha1("html").alias("sha1"), F.octet_length("html").cast("long").alias("payload_bytes")), "warc_seen")
    owners = cut(seen.groupBy("sha256").agg(F.max("page_id").alias("owner")), "warc_owners")
    refers = F.when((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    heads = seen.join(owners, "sha256").select("page_id", "url", "sha1", "payload_bytes", refers.alias("refers_to"), "sha256")
    heads = cut(heads.mapInArrow(_heads, "page_id long, refers_to long, sha256 binary, head binary"), "warc_heads")
    # one row a payload, the owner's: found by the page's id, which has no hot values, and the digest, before anything is compressed
    keys = owners.select(F.coalesce("owner", F.lit(0)).alias("row_id"), "sha256")
    chosen = rows.select(F.coalesce("page_id", F.lit(0)).alias("row_id"), strong.alias("sha256"), "html").join(keys, ["row_id", "sha256"], "left_semi")
    chosen = chosen.dropDuplicates(["row_id", "sha256"]).select("sha256", "html").mapInArrow(_compress, "sha256 binary, member binary")
    index = cut(chosen.mapInArrow(_store(shared_dir(spark, "warc")), "file string, offset long, size long, sha256 binary"), "warc_index")
    return index, heads


def split_record(block: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the block of one uncompressed WARC record."""
    head, _, rest = block.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    n = int(fields["Content-Length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError("record length differs")
    return fields, rest[:n]


def _members(batches):
    """(payload, its SHA-256, the other columns) for index rows (file, offset, size, ...), read and verified."""
    path = stream = None
    for b in batches:
        for uri, offset, n, *rest in zip(*(c.to_pylist() for c in b.columns)):
            if path != uri:
                if stream is not None:
                    stream.close()
                fs, inner = open_fs(uri)
                stream, path = fs.open_input_file(inner), uri
            fields, data = split_record(gzip.decompress(stream.read_at(n, offset)))
            sha = hashlib.sha256(data).digest()
            if fields["WARC-Block-Digest"] != f"sha256:{sha.hex()}":
                raise ValueError(f"payload at {uri}:{offset} doesn't match its digest")
            yield data, sha, rest
    if stream is not None:
        stream.close()


def _in_batches(rows, names: list[str], kinds: list, most: int = 4_000_000):
    """Arrow batches of rows whose last column holds bytes, at most about ``most`` of them in a batch."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1])
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def payloads(index: DataFrame) -> DataFrame:
    """sha256, payload: read from the archives and verified."""

    def run(batches):
        yield from _in_batches(((sha, data) for data, sha, _ in _members(batches)), ["sha256", "payload"], [pa.binary(), pa.binary()])

    return index.select("file", "offset", "size").mapInArrow(run, "sha256 binary, payload binary")


def reconstruct(index: DataFrame, heads: DataFrame) -> DataFrame:
    """page_id, record: the original bytes of every record, revisits without a payload."""

    def run(batches):
        records = ((page, head + data + CRLF + CRLF) for data, _, (page, head) in _members(batches))
        yield from _in_batches(records, ["page_id", "record"], [pa.int64(), pa.binary()])

    needed = cut(heads.where("refers_to is null").join(index, "sha256").select("file", "offset", "size", "page_id", "head"), "warc_needed")
    full = needed.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, "page_id long, record binary")
    return full.unionByName(heads.where("refers_to is not null").select("page_id", F.concat("head", F.lit(CRLF + CRLF)).alias("record")))


def _read_records(batches):
    """What the bytes of records say; a response's payload has to match its digest and length."""
    for b in slices(batches, "record"):
        rows = []
        for record in b.column(0).to_pylist():
            fields, block = split_record(record)
            http, _, payload = block.partition(CRLF + CRLF)
            n = int(next(x for x in http.split(CRLF) if x.startswith(b"Content-Length:")).partition(b":")[2])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            whole = fields["WARC-Type"] == "response"
            if whole and (len(payload) != n or sha1_base32(payload) != digest):
                raise ValueError(f"record of page {fields.get(PAGE)} doesn't match its header")
            rows.append((int(fields[PAGE]) if PAGE in fields else None, n, digest, fields["WARC-Type"], int(fields[REFERS]) if REFERS in fields else None))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def archive(pages: DataFrame, least: int = 0, **columns) -> DataFrame:
    """Write the archives, rebuild the records: page_id, payload_bytes, payload_digest, record_type, refers_to as the records' bytes have them."""
    index, heads = write(pages, least, **columns)
    records = reconstruct(index, heads).select("record")
    return records.mapInArrow(_read_records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Base32 takes the hex digest five digits (20 bits, four letters) at a time.
OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT page_id, n, h, array_to_string(list_transform(range(0, 8), lambda i:
    array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * i, 5))::BIGINT >> s) & 31)::INT, 1)), '')), '') AS d
  FROM p),
o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h)
SELECT b.page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN b.page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN b.page_id = owner THEN NULL ELSE owner END AS refers_to
FROM b JOIN o USING (h)
"""
