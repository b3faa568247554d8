"""WARC archives: gzip member per record, written by partitions and read back by byte ranges.

Writer: each partition writes one `.warc.gz` under a name of its own attempt and moves it into place, so a retried task leaves
no half archive among those listed; the manifest (path, bytes), written as a table, lists exactly the archives of tasks that
succeeded. A revisit record holds the HTTP header and digests but no payload.

Reader: the manifest is cut to byte ranges. A range scans for gzip magic, decodes the header of each candidate member and
takes the first that begins a WARC record; from there members follow one another. It owns the records that start inside it
and reads past its end to finish the last. Memory is bounded by the largest record and one range.

Damage does not pass in silence: where a record ought to begin and none does, or one begins and cannot be decoded to its end, a range
raises, or with on_damage="report" gives a row of type `damaged` with archive and offset and goes on at the next record it
finds. A range looks at the header behind its last record too, so a broken header on a border is seen by one of both.

Defined results: null payload is empty, null url leaves the target out, a null id leaves X-Row-Id out and reads back null; a
url's control characters are percent-encoded; repeated rows make repeated records. Empty tables give no archives and no
rows. Archives are reached through pyarrow's file systems, by the scheme of the shared folder.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import make_dir, materialise, new_path

SPLIT_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
LEVEL = 3
_DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary, archive string, offset long"


def _uri(page_id: int | None) -> str:
    return f"<urn:braidwork:row:{'none' if page_id is None else page_id}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "%{:02X}".format(ord(m[0])), url)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = "sha1:" + b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {_DATE}"]
    if page_id is not None:
        head.append(f"X-Row-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    # surrogates cannot occur in Spark strings, so the header always encodes
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def decode_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields.get("warc-type") == "revisit"
    said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", b"\r\n" + http)
    stated = fields.get("warc-payload-digest", "")
    digest = b32decode(stated[5:]).hex() if revisit and stated.startswith("sha1:") else hashlib.sha1(payload).hexdigest()
    to = re.fullmatch(r"<urn:braidwork:row:(-?\d+)>", fields.get("warc-refers-to", ""))
    return {
        "page_id": int(fields["x-row-id"]) if "x-row-id" in fields else None,
        "record_type": fields.get("warc-type"),
        "refers_to": int(to[1]) if revisit and to else None,
        "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": int(said[1]) if revisit and said else len(payload),
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


def _write_partition(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        fs, root = _open(folder)
        out, size, records = None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit"))):
                if out is None:
                    out = fs.open_output_stream(f"{root}/.{name}.part", compression=None)
                member = gzip_member(encode_record(row[0], row[1], (row[2] or "").encode("utf-8", "surrogatepass"), row[3], bool(row[4])))
                out.write(member)
                size += len(member)
                records += 1
        if out is not None:
            out.close()
            fs.move(f"{root}/.{name}.part", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": pa.array([size], pa.int64()), "records": pa.array([records], pa.int64())})

    return write


def revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """Adds `refers_to` and `revisit`: of equal payloads of at least least_bytes, the row with the largest id is the response."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumn("_key", F.when(F.length(payload) >= least_bytes, F.sha2(payload, 256)))
    # Only digests that repeat are joined; the table is written so that the join deals both sides anew and splits a hot digest.
    groups = rows.filter("_key is not null").groupBy("_key").agg(F.max(id_col).alias("refers_to"), F.count("*").alias("_n"))
    winners = materialise(groups.filter("_n > 1").select(F.col("_key").alias("_w"), "refers_to"), "warc-winners")
    out = rows.join(winners, F.col("_key") == F.col("_w"), "left")
    revisit = F.col("_w").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("refers_to"))
    return out.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("refers_to"))).drop("_key", "_w")


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Writes the archives; gives the manifest (path, bytes, records)."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    make_dir(spark, folder)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    rows = revisits(rows, "page_id", "html", least_bytes).select("page_id", "url", "html", "refers_to", "revisit")
    return materialise(rows.mapInArrow(_write_partition(folder), "path string, bytes long, records long"), "warc-manifest")


def members(read, start: int, end: int, size: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes | None]]:
    """(offset, record) of each gzip member that starts in [start, end); None in place of a record that is damaged.

    read(offset, length) gives bytes of the archive.
    """

    def member(at: int, head_only: bool = False) -> tuple[bytes | None, int] | None:
        """The record that starts at `at`, decoded, and where it ends; no record if it is damaged; None if no WARC record begins here."""
        d, parts, pos, seen = zlib.decompressobj(31), [], at, 0
        while not d.eof:
            data = read(pos, min(chunk if parts else 16 << 10, size - pos))
            pos += len(data)
            try:
                parts.append(d.decompress(data))
                lost = not data
            except zlib.error:
                lost = True
            if seen < 5:
                head = b"".join(parts)
                seen = len(head)
                if not head.startswith(b"WARC/"[:seen]) or (lost and seen < 5):
                    return None
            if lost or (head_only and seen >= 5):
                return None, at
        return b"".join(parts), pos - len(d.unused_data)

    at, base, held, due = start, start, b"", start == 0  # due: a record must begin here
    while at < end:
        if not due:
            # look for magic in the range; two bytes past its end can belong to a magic that starts inside
            if at + 2 >= base + len(held) or at < base:
                base, held = at, read(at, min(chunk, end + 2 - at, size - at))
            found = held.find(MAGIC, at - base)
            if found < 0:
                at = max(at + 1, base + len(held) - 2)
                if at >= size or len(held) < 3:
                    return
                continue
            at = base + found
            if at >= end:
                return
        got = member(at)
        if got is not None and got[0] is not None:
            yield at, got[0]
            at, due = got[1], True
            continue
        if due or got is not None:
            yield at, None
        at, due = at + 1, False
    if due and at < size and member(at, head_only=True) is None:
        yield at, None


def _read_splits(batches: Iterator[pa.RecordBatch], on_damage: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64())])
    for batch in batches:
        for path, start, end, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "bytes"))):
            fs, name = _open(path)
            rows, held = [], 0
            with fs.open_input_file(name) as f:

                block = [0, b""]

                def read(offset: int, length: int) -> bytes:
                    """Small reads come from one block that moves on."""
                    if length <= 0:
                        return b""
                    if offset < block[0] or offset + length > block[0] + len(block[1]):
                        block[:] = offset, f.read_at(max(length, min(1 << 20, size - offset)), offset)
                    return block[1][offset - block[0] : offset - block[0] + length]

                for offset, record in members(read, start, end, size):
                    if record is None and on_damage == "raise":
                        raise ValueError(f"{path}: damaged at byte {offset}")
                    rows.append((decode_record(record) if record is not None else {"record_type": "damaged"}) | {"archive": os.path.basename(path), "offset": offset})
                    held += len(record or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


#: Tasks that a read is dealt to at most; each then takes several ranges.
MAX_TASKS = 1 << 14


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, on_damage: str = "raise") -> DataFrame:
    """The records of the archives in manifest (path, bytes), one row each."""
    if on_damage not in ("raise", "report"):
        raise ValueError("on_damage is raise or report")
    # dealt to as many tasks as there are ranges: their rows are tiny, so a number left open would be coalesced to one
    ranges = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = manifest.filter("bytes > 0").select("path", "bytes", starts.alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    return splits.repartition(min(int(ranges), MAX_TASKS), "path", "start").mapInArrow(lambda batches: _read_splits(batches, on_damage), RECORD)


def manifest_of(spark: SparkSession, paths_and_sizes: list[tuple[str, int]]) -> DataFrame:
    """A manifest of archives written elsewhere."""
    return spark.createDataFrame(paths_and_sizes, "path string, bytes long")
