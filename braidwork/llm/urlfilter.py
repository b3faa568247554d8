"""URL filters: host-suffix and path-prefix expressions, hash-prefix equi-join, digest check, precedence.

Each url becomes one expression per (host suffix, path prefix) whose shape occurs in the rules: label count of the host and
length of the path. An expression meets the rules by the first four bytes of its digest; the full digest then decides. All
of it is DataFrame functions, so nothing leaves the JVM.

Defined results: a null url or one without `://` has empty host and path and fits no rule; repeated rows give repeated
results; very long urls are judged whole; an empty rule table gives the default verdict everywhere; among rules that fit, the longest `host || path` wins, then the
longest host, then block before allow. Columns of the input other than the id and the url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (verdict, host, path)
CONTRACT_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many bytes may be broadcast; beyond it they are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Up to so many distinct (labels, path length) shapes of rules, a url is expanded to those alone; beyond, to all of its own suffixes and prefixes.
MAX_SHAPES = 4096


def split_url(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#`, A-Z lower-cased. Path: then up to `?`, `#`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + F.lit(3)), "#", 1)).otherwise(F.lit(""))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substr(rest, F.char_length(host) + F.lit(1))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (host, lower-cased, and path of the rule that decides, else null), verdict."""
    lowered = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
    lowered = lowered.filter(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull())
    one = Window.partitionBy("rule_host", "rule_path").orderBy(F.col("verdict").desc())
    lowered = lowered.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    shapes = [
        (r[0], r[1])
        for r in lowered.select(F.size(F.split("rule_host", r"\.")), F.char_length("rule_path")).distinct().limit(MAX_SHAPES + 1).collect()
    ]
    host, path = split_url(F.col(url_col))
    rows = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not shapes:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    labels = F.size(F.split("host", r"\."))
    if len(shapes) <= MAX_SHAPES:
        made = [
            F.when(
                (labels >= n) & (F.char_length("path") >= m),
                F.struct(F.substring_index("host", ".", -n).alias("h"), F.substring("path", 1, m).alias("p")),
            )
            for n, m in sorted(shapes)
        ]
        made = F.filter(F.array(*made), lambda x: x.isNotNull())
    else:
        suffixes = F.transform(F.sequence(F.lit(1), labels), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
        prefixes = F.transform(F.sequence(F.lit(0), F.char_length("path")), lambda m: F.substr(F.col("path"), F.lit(1), m))
        made = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    # A row's expressions stay together up to the partial aggregate, so the shuffle carries one row per url whatever its host.
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    parts = rows.select("*", F.explode_outer(made).alias("x"))
    parts = parts.select(id_col, "host", "path", "_row", _digest(F.col("x.h"), F.col("x.p")).alias("digest"))
    known = lowered.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path")))
    known = known.withColumn("rule_key", F.substring("rule_digest", 1, 8)).withColumnRenamed("verdict", "rule_verdict")
    size = known.select(F.sum(F.length("rule_host") + F.length("rule_path") + 200)).first()[0] or 0
    known = F.broadcast(known) if size <= BROADCAST_BYTES else known
    met = parts.join(known, F.substring("digest", 1, 8) == F.col("rule_key"), "left")
    rank = F.struct(
        F.char_length(F.concat("rule_host", "rule_path")).alias("a"),
        F.char_length("rule_host").alias("b"),
        F.when(F.col("rule_verdict") == "block", 1).otherwise(0).alias("c"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    won = F.max(F.when(F.col("digest") == F.col("rule_digest"), rank)).alias("won")
    out = met.groupBy(id_col, "host", "path", "_row").agg(won)
    return out.select(id_col, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
