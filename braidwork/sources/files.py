"""File sources and sinks, dataset locators and the registry. Schemas are explicit wherever rows are parsed."""

from __future__ import annotations

import re
import time
import uuid
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, shared_dir  # noqa: F401

FORMATS = {"jsonl": "json", "json": "json", "txt": "text", "csv": "csv", "parquet": "parquet", "orc": "orc"}


def load_file(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Reads by extension. CSV has a header, and its empty fields stay empty strings."""
    ext = path.rstrip("/").rpartition(".")[2].lower()
    if ext not in FORMATS:
        raise ValueError(f"no reader for .{ext}")
    reader = spark.read.format(FORMATS[ext])
    if ext == "csv":
        reader = reader.options(header=True, nullValue="\x00", emptyValue="", quote='"', escape='"', multiLine=True)
    elif ext == "json":
        reader = reader.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All rows; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_splits(spark: SparkSession, folder: str, splits: list[str], ext: str = "parquet", retries: int = 3, wait: float = 0.5) -> DataFrame:
    """The splits of a folder, one after the other; each is tried `retries` times."""
    parts = []
    for split in splits:
        for attempt in range(retries):
            try:
                parts.append(load_file(spark, f"{folder}/{split}.{ext}"))
                break
            except Exception:
                if attempt == retries - 1:
                    raise
                time.sleep(wait)
    return concatenated(parts)


def training_files(spark: SparkSession, paths: list[str], allowed: tuple[str, ...] = ("parquet", "json", "jsonl")) -> DataFrame:
    """Parquet or JSON files as one table; any other kind raises."""
    for p in paths:
        if p.rpartition(".")[2] not in allowed:
            raise ValueError(f"unsupported file: {p}")
    return concatenated([load_file(spark, p) for p in paths])


@dataclass(frozen=True)
class Locator:
    """`[hub::]name[:subset/subset][#rows]`."""

    name: str
    hub: str | None = None
    subsets: tuple[str, ...] = ()
    rows: int | None = None


def parse_locator(text: str, exists: Callable[[str], bool] = lambda p: False) -> Locator:
    """A text that is an existing path as a whole names that path."""
    hub, sep, rest = text.partition("::")
    if not sep or hub.lower() not in ("hf", "ms"):
        hub, rest = None, text
    if exists(rest):
        return Locator(rest, hub)
    rows = None
    if m := re.fullmatch(r"(.*)#(\d+)", rest, re.S):
        rest, rows = m[1], int(m[2])
    if exists(rest):
        return Locator(rest, hub, rows=rows)
    name, sep, subs = rest.partition(":")
    return Locator(name, hub, tuple(s for s in subs.split("/") if s) if sep else (), rows)


@dataclass
class Subset:
    name: str
    weak: bool = False


def select_subsets(known: list[Subset], wanted: tuple[str, ...]) -> list[str]:
    """`default` (or nothing): the first; `all`: those that aren't weak; others by name, unknown ones too."""
    if not wanted or wanted == ("default",):
        return [known[0].name] if known else ["default"]
    if wanted == ("all",):
        return [s.name for s in known if not s.weak]
    return list(wanted)


@dataclass
class Registry:
    """Named sources: a function from (spark, locator) to a table. Found by id, else by the last part of the id."""

    sources: dict[str, Callable[[SparkSession, Locator], DataFrame]] = field(default_factory=dict)

    def register(self, name: str, load: Callable[[SparkSession, Locator], DataFrame], replace: bool = False) -> None:
        if name in self.sources and not replace:
            raise ValueError(f"{name} is registered already")
        self.sources[name] = load

    def find(self, name: str) -> Callable[[SparkSession, Locator], DataFrame]:
        if name in self.sources:
            return self.sources[name]
        by_suffix = [k for k in self.sources if k.rpartition("/")[2] == name.rpartition("/")[2]]
        if len(by_suffix) != 1:
            raise KeyError(name)
        return self.sources[by_suffix[0]]

    def load(self, spark: SparkSession, text: str) -> DataFrame:
        locator = parse_locator(text)
        df = self.find(locator.name)(spark, locator)
        return df if locator.rows is None else df.limit(locator.rows)


def tolerant_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): blank lines are skipped, lines that don't parse are counted."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    open_ = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select(F.from_json("value", open_, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.filter(~bad).select("r.*").drop("_bad"), parsed.agg(F.count_if(~bad).alias("rows"), F.count_if(bad).alias("errors"))


def dated_rows(df: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    day = F.to_date(column)
    if first is not None:
        df = df.filter(day >= F.lit(first))
    return df if last is None else df.filter(day <= F.lit(last))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, name, bytes, sha256 of each file. A file is one row, so it must be smaller than 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@dataclass
class OrdinalIndex:
    """Files of a table in order, each with the ordinal that its first row has, and the number of rows."""

    files: list[str]
    first: list[int]
    rows: int


def ordinal_index(df: DataFrame, required: list[str] | None = None, rows: int | None = None) -> OrdinalIndex:
    """An index of the rows of Parquet files by their places: file by file in order of their paths, as they lie in each.

    Reads no column, only how many rows files have; a row a file comes to the driver. Missing columns and another number of rows than expected raise.
    """
    missing = sorted(set(required or []) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    counts = df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").count().collect()
    files = sorted((r["file"], r["count"]) for r in counts)
    first = list(accumulate((n for _, n in files), initial=0))
    if rows is not None and first[-1] != rows:
        raise ValueError(f"{first[-1]} rows where {rows} are expected")
    return OrdinalIndex([f for f, _ in files], first[:-1], first[-1])


def by_ordinal(df: DataFrame, index: OrdinalIndex, wanted: list[int]) -> DataFrame:
    """`ordinal` and the rows of df at these places. Only files that have one are read; an ordinal out of range raises before that."""
    if any(not 0 <= w < index.rows for w in wanted):
        raise IndexError("ordinal out of range")
    at: dict[int, list[int]] = {}
    for w in sorted(set(wanted)):
        at.setdefault(bisect_right(index.first, w) - 1, []).append(w)
    spark = df.sparkSession
    places = [(index.files[f], w - index.first[f], w) for f, own in at.items() for w in own]
    places = spark.createDataFrame(places, "_file string, _row long, ordinal long")
    # the list of files prunes the scan, the join picks their rows
    rows = df.filter(F.col("_metadata.file_path").isin([index.files[f] for f in at])).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index"))
    return rows.join(places, (F.col("_path") == F.col("_file")) & (F.col("_index") == F.col("_row"))).drop("_path", "_index", "_file", "_row")


def json_folder(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object a file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def log_metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """name and value of every `name:number` of each line; colour codes go first. Other columns stay."""
    plain = F.regexp_replace(column, "\x1b\\[[0-9;]*m", "")
    found = F.regexp_extract_all(plain, F.lit(r"([A-Za-z_][\w/.@-]*:-?\d[\d.eE+-]*)"), 1)
    rows = lines.withColumn("_m", F.explode(found))
    cut = F.length("_m") - F.length(F.substring_index("_m", ":", -1))
    return rows.withColumn("name", F.substr("_m", F.lit(1), cut - 1)).withColumn("number", F.substring_index("_m", ":", -1).try_cast("double")).drop("_m", column)


def guarded_sql(spark: SparkSession, tables: dict[str, DataFrame], statement: str) -> DataFrame:
    """Runs one SELECT over the tables: no `SELECT *`, and a filter word somewhere in the text."""
    low = statement.lower().strip().rstrip(";")
    if not low.startswith(("select", "with")) or ";" in low:
        raise ValueError("one SELECT statement is allowed")
    if re.search(r"select\s+\*", low):
        raise ValueError("SELECT * is not allowed")
    if not re.search(r"\b(where|limit|group by|having|count|sum|avg|min|max)\b", low):
        raise ValueError("the statement must filter or aggregate")
    return spark.sql(statement, **tables)


def profile(df: DataFrame, most: int = 20) -> DataFrame:
    """column, type, distinct: distinct values (sorted, joined) of each text column that has at most `most`."""
    spark, text = df.sparkSession, [c for c, t in df.dtypes if t == "string"]
    kinds = spark.createDataFrame(df.dtypes, "column string, type string")
    if not text:
        return kinds.withColumn("distinct", F.lit(None).cast("string"))
    values = df.select(*text).unpivot([], text, "column", "value").distinct()
    by = values.groupBy("column").agg(F.when(F.count("*") <= most, F.array_join(F.array_sort(F.collect_list("value")), ",")).alias("distinct"))
    return kinds.join(by, "column", "left")


def run_sql(df_statement: str, spark: SparkSession, **tables: DataFrame) -> tuple[DataFrame, int]:
    """Rows of a statement and their number; no limit is added."""
    out = spark.sql(df_statement, **tables)
    return out, out.count()


# ---- sinks

def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


class AppendLog:
    """JSON rows that are appended run by run, each id once, whatever fails or runs beside.

    A run writes to a folder of its own attempt and then claims the next number: a marker that only one run can create. Rows of attempts without
    a marker are not there. A run that finds its number taken looks at what was committed since it began, leaves those ids out, and
    tries the number behind; so a retried or concurrent run writes no id twice. Of rows of a run that share an id one is kept.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def attempts(self) -> list[str]:
        """Names of the committed attempts by number; an empty marker, of a run that ended while it claimed, counts for none."""
        fs, where = self._hadoop(f"{self.path}/commits")
        if not fs.exists(where):
            return []
        found = self.spark.read.option("wholetext", True).text(f"{self.path}/commits").select(F.col("_metadata.file_name").alias("n"), "value").collect()
        taken = {int(r["n"]): r["value"] for r in found}
        # markers without content give no row of text
        numbers = sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit())
        return [taken.get(n, "") for n in numbers]

    def _rows(self, attempts: list[str]) -> DataFrame:
        paths = [f"{self.path}/attempts/{a}" for a in attempts if a]
        return self.spark.read.schema(self.schema).json(paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.attempts())

    def _claim(self, number: int, attempt: str) -> bool:
        fs, where = self._hadoop(f"{self.path}/commits/{number:08d}")
        try:
            out = fs.create(where, False)
        except Exception as e:  # taken by another run
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(attempt.encode())
        out.close()
        return True

    def append(self, df: DataFrame) -> DataFrame:
        """Appends the rows whose id isn't there; gives those rows."""
        seen = self.attempts()
        new = df.join(self._rows(seen).select(self.key).distinct(), self.key, "left_anti").dropDuplicates([self.key])
        attempt = uuid.uuid4().hex
        new.write.json(f"{self.path}/attempts/{attempt}")
        while not self._claim(len(seen), attempt):
            now = self.attempts()
            since = self._rows(now[len(seen) :]).select(self.key).distinct()
            left, attempt = self._rows([attempt]).join(since, self.key, "left_anti"), uuid.uuid4().hex
            left.write.json(f"{self.path}/attempts/{attempt}")
            seen = now
        return self._rows([attempt])


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key isn't in the folder yet; gives those rows. Read with read_appended."""
    return AppendLog(df.sparkSession, path, df.schema, key).append(df)


def read_appended(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return AppendLog(spark, path, schema, "").read()


def manifest(df: DataFrame, key: Column, size: Column, seed: int) -> DataFrame:
    """One row: rows, seed, smallest, largest and mean size, and a checksum that doesn't depend on the order of rows."""
    h = F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.lit(seed).alias("seed"), F.min(size).alias("min"), F.max(size).alias("max"), F.avg(size).alias("mean"), F.sum(h).alias("checksum"))
