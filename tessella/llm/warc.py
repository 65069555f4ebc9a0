"""WARC archives, index first.

Writing gives one gzip member a record and, for each record, an index row with file, offset, length,
URL and digest. Reading starts from index rows: they are sorted by file and offset, dealt
in ranges, and neighbouring byte ranges are fetched by one read each.

A task writes files under names of its own, and only the index that Spark has stored says which
files count; files of lost or repeated attempts are in no index and are never read. Archives go to
the shared folder, by a file system that is opened from its URI. Payloads are never shuffled: which rows
revisit which page is found from digests and stored by scan partition.

Defined cases: a null html is the empty payload, a null url leaves out the target URI. Equal payloads
of at least ``least`` bytes, the empty one too at 0, are stored once: the row with the largest
page_id (null being the smallest) is the response, one row of equal ones. A long payload is held
whole, some three times. An empty table gives an empty index. The input must be a table or a checkpoint, whose scan
deals rows to partitions alike each time. Other columns are not read; they may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import beside, shared
from . import textcols as tc

INDEX = "file string, offset long, length long, url string, digest string"
RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
#: Neighbouring records whose gap is at most this are fetched by one read, up to the other size.
GAP_BYTES, READ_BYTES, FILE_BYTES = 64 << 10, 4 << 20, 128 << 20
#: A reading task has about so many bytes of records.
TASK_BYTES = 128 << 20


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None, revisit: bool) -> bytes:
    """One record with its closing lines; a revisit has no payload of its own."""
    clean = lambda x: x.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Record-ID: <urn:page:{clean(page_id)}>"] if page_id is not None else []
    head += [f"WARC-Target-URI: {clean(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []
    head += [f"WARC-Refers-To: <urn:page:{clean(refers_to)}>"] if refers_to is not None else []
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """A record as a row of RECORD, its digest taken again from the payload."""
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    plain = lambda x: None if x is None else x.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    page = lambda x: None if x is None else plain(x[len("<urn:page:") : -1])
    payload, kind = body[: int(field["Content-Length"])], field["WARC-Type"]
    digest, size = field["WARC-Payload-Digest"].removeprefix("sha1:"), int(field["X-Payload-Length"])
    if kind == "response" and (sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"record {field.get('WARC-Record-ID')} doesn't hold the payload of its digest")
    return page(field.get("WARC-Record-ID")), plain(field.get("WARC-Target-URI")), size, digest, kind, page(field.get("WARC-Refers-To")), payload if kind == "response" else None


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def store_revisits(pages: DataFrame, at: str, least: int) -> None:
    """Stores r, a monotonically increasing id, and refers_to of the rows whose payload another row holds."""
    keyed = shared.cut(pages.where(F.octet_length("html") >= least).select("page_id", "r", F.sha1("html").alias("key")))
    groups = keyed.groupBy("key").agg(F.max(F.struct("page_id", "r")).alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top")
    rows = keyed.join(shared.cut(groups), "key").where(F.col("r") != F.col("top.r"))
    beside.store(rows.select("r", F.col("top.page_id").cast("string").alias("refers_to")), at)


def write_archives(pages: DataFrame, to: str, least: int = 0) -> DataFrame:
    """Writes a record per row below the URI ``to`` and returns the stored index."""
    tc.tune(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("r"))
    store_revisits(pages, f"{to}/revisits", least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(to)
        fs.create_dir(base, recursive=True)
        out, name, offset, side = None, "", 0, None
        try:
            for batch in tc.sub_batches(batches, "html"):
                if not batch.num_rows:
                    continue
                r = batch.column("r").to_numpy()
                side = beside.stored(f"{to}/revisits", int(r[0])) if side is None else side
                found, place = beside.rows_of(side, r)
                of = dict(zip(place.tolist(), side["refers_to"][found].tolist() if len(found) else [], strict=True))
                rows = []
                for k, (page_id, url, html) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)):
                    revisit, refers_to = k in of, of.get(k)
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    payload = html.encode()
                    digest = sha1(payload)
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = z.compress(record(page_id, url, payload, digest, len(payload), refers_to, revisit)) + z.flush()
                    out.write(member)
                    rows.append((name, offset, len(member), url, digest))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "offset", "length", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    pages.withColumn("page_id", F.col("page_id").cast("string")).mapInArrow(run, INDEX).write.parquet(f"{to}/index")
    shared.remove(pages.sparkSession, f"{to}/revisits")
    return pages.sparkSession.read.parquet(f"{to}/index")


def read_records(index: DataFrame, at: str, payloads: bool = True) -> DataFrame:
    """The records of the given index rows, in the columns of RECORD."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(at)
        source, opened = None, None
        for batch in batches:
            wanted = list(zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True))
            k = 0
            while k < len(wanted):
                file, start, length = wanted[k]
                end, to = start + length, k + 1
                while to < len(wanted) and wanted[to][0] == file and 0 <= wanted[to][1] - end <= GAP_BYTES and wanted[to][1] + wanted[to][2] - start <= READ_BYTES:
                    end, to = wanted[to][1] + wanted[to][2], to + 1
                if file != opened:
                    source, opened = fs.open_input_file(f"{base}/{file}"), file
                data = source.read_at(end - start, start)
                rows = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in wanted[k:to]]
                if not payloads:
                    rows = [(*r[:-1], None) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                k = to

    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    # by bytes of records, not of index rows; but a few reads for each core
    tasks = max(1, -(-total // TASK_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-total // READ_BYTES)))
    return index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)
