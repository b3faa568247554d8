"""Indexed shards: a data source of files that rows are read from by place, touching only their bytes.

Writing: each task packs its rows to groups, Arrow messages of `groupRows` rows at most, one behind the other in files of about
`shardBytes`, under names of its own attempt; beside each lies an index with the first row, offset and size of every group. Only the
manifest, put in place when all tasks are through, says which files count and how many rows each has, so a failed or repeated
task leaves nothing that is read. `append` adds to the manifest that is there, `overwrite` replaces it.

Reading: `rows` names ordinals and ranges ("5", "0-9,40-49", ends included; all rows without it), in the order of the manifest. The
manifest gives the shards, a shard's index the groups, and of its file just these groups' bytes are read. A partition is one shard, or a
piece of it. An ordinal out of range raises before any shard is opened. The schema may name some of the columns written, and `ordinal`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"
#: Bytes of a shard and rows of a group unless options say otherwise, and groups that one partition reads.
SHARD_BYTES, GROUP_ROWS, PART_GROUPS = 10 << 30, 64, 4096


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _manifest(path: str) -> dict | None:
    fs, root = _open(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def ranges_of(text: str | None, total: int) -> list[tuple[int, int]]:
    """Sorted ranges [begin, end) without overlap of ordinals named by a text."""
    if text is None or not text.strip():
        return [(0, total)] if total else []
    found = []
    for piece in text.split(","):
        first, _, last = piece.strip().partition("-")
        begin, end = int(first), int(last or first) + 1
        if not 0 <= begin < end <= total:
            raise IndexError(f"rows {piece.strip()} are not among {total}")
        found.append((begin, end))
    out: list[tuple[int, int]] = []
    for begin, end in sorted(found):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


@dataclass
class Written(WriterCommitMessage):
    """name, rows and bytes of the shards of a task."""

    shards: list[tuple[str, int, int]]


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.schema = path, overwrite, to_arrow_schema(schema).serialize().to_pybytes().hex()
        self.shard_bytes, self.group_rows = int(options.get("shardbytes", SHARD_BYTES)), int(options.get("grouprows", GROUP_ROWS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        shards: list[tuple[str, int, int]] = []
        out, index, name, size, rows = None, [], "", 0, 0

        def finish() -> None:
            nonlocal out
            out.close()
            with fs.open_output_stream(f"{root}/{name}.idx", compression=None) as f:
                f.write(np.array(index, np.int64).tobytes())
            shards.append((name, rows, size))
            out = None

        for batch in iterator:
            for begin in range(0, batch.num_rows, self.group_rows):
                if out is None:
                    name, index, size, rows = f"shard-{uuid.uuid4().hex}", [], 0, 0
                    out = fs.open_output_stream(f"{root}/{name}.bin", compression=None)
                group = batch.slice(begin, self.group_rows)
                data = group.serialize()
                out.write(data)
                index.append((rows, size, len(data)))
                size, rows = size + len(data), rows + group.num_rows
                if size >= self.shard_bytes:
                    finish()
        if out is not None:
            finish()
        return Written(shards)

    def commit(self, messages: list[Written | None]) -> None:
        before = None if self.overwrite else _manifest(self.path)
        shards = (before["shards"] if before else []) + [list(s) for m in messages if m for s in m.shards]
        if before and before["schema"] != self.schema:
            raise ValueError("rows of another schema lie there")
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        part = f"{root}/.{MANIFEST}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part, compression=None) as f:
            f.write(json.dumps({"schema": self.schema, "shards": shards, "rows": sum(s[1] for s in shards)}).encode())
        fs.move(part, f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        for name, _, _ in (s for m in messages if m for s in m.shards):
            for end in ("bin", "idx"):
                fs.delete_file(f"{root}/{name}.{end}")


@dataclass
class Piece(InputPartition):
    """Rows [begin, end) of a shard, which stand at `first` on of the whole, in local ranges."""

    name: str
    schema: str
    first: int
    ranges: list[tuple[int, int]]


class ShardReader(DataSourceReader):
    def __init__(self, path: str, options: dict, schema: StructType):
        self.path, self.rows, self.schema = path, options.get("rows"), schema
        self.part_groups = int(options.get("partgroups", PART_GROUPS)) * int(options.get("grouprows", GROUP_ROWS))

    def partitions(self) -> list[Piece]:
        manifest = _manifest(self.path)
        if manifest is None:
            raise FileNotFoundError(f"no {MANIFEST} in {self.path}")
        wanted, out, first, at = ranges_of(self.rows, manifest["rows"]), [], 0, 0
        for name, rows, _ in manifest["shards"]:
            own: list[tuple[int, int]] = []
            while at < len(wanted) and wanted[at][0] < first + rows:
                begin, end = max(wanted[at][0], first) - first, min(wanted[at][1], first + rows) - first
                own += [(b, min(b + self.part_groups, end)) for b in range(begin, end, self.part_groups)]
                if wanted[at][1] > first + rows:
                    break
                at += 1
            held, count = [], 0
            for r in own:
                if held and count + r[1] - r[0] > self.part_groups:
                    out.append(Piece(name, manifest["schema"], first, held))
                    held, count = [], 0
                held.append(r)
                count += r[1] - r[0]
            if held:
                out.append(Piece(name, manifest["schema"], first, held))
            first += rows
        return out

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no rows
            return
        names = [f.name for f in self.schema.fields]
        fs, root = _open(self.path)
        with fs.open_input_file(f"{root}/{partition.name}.idx") as f:
            index = np.frombuffer(f.read(), np.int64).reshape(-1, 3)
        kind = pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(partition.schema)))
        with fs.open_input_file(f"{root}/{partition.name}.bin") as f:
            for begin, end in partition.ranges:
                g = int(np.searchsorted(index[:, 0], begin, side="right")) - 1
                while g < len(index) and index[g, 0] < end:
                    row, offset, size = index[g].tolist()
                    f.seek(offset)
                    group = pa.ipc.read_record_batch(pa.py_buffer(f.read(size)), kind)
                    a, b = max(begin - row, 0), min(end - row, group.num_rows)
                    part = group.slice(a, b - a)
                    if "ordinal" in names:
                        part = part.append_column("ordinal", pa.array(np.arange(partition.first + row + a, partition.first + row + b), pa.int64()))
                    yield part.select(names)
                    g += 1


class IndexedShards(DataSource):
    """`df.write.format("indexed").option("path", ..)`, `spark.read.format("indexed").schema(..).load(path)`; register() first."""

    @classmethod
    def name(cls) -> str:
        return "indexed"

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], {k.lower(): v for k, v in self.options.items()}, schema, overwrite)

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options["path"], {k.lower(): v for k, v in self.options.items()}, schema)


def register(spark) -> None:
    spark.dataSource.register(IndexedShards)
