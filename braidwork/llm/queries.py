"""One thin query for each operator of this subpackage; digest columns are derived here or in the operator's last step."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpecodec, chat, decontaminate, exactdedup, interaction, jaccard, ngramlm, repair, substring, tokencount, toxicity, urlfilter, warc

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"), digest=True)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup(table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpecodec.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


#: The conversation that the query adds: control strings inside texts.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"
CHAT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    for batch in batches:
        out = []
        for formatted, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns = chat.parse(formatted)
            masked = "".join(chat.unescape(formatted[s["start"] : s["end"]]) for s in loss)
            out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(masked), sha(masked), len(formatted)))
        columns = {"conv_id": batch.column("conv_id")}
        for i, (name, kind) in enumerate([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]):
            columns[name] = pa.array([r[i] for r in out], kind)
        yield pa.RecordBatch.from_pydict(columns)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)], rows.schema)
    return chat.format_log(chat.as_log(rows.unionByName(extra))).mapInArrow(_read_back, CHAT)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark, urlfilter.CONTRACT_RULES))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score_held_out(table(spark, sf_dir, "documents"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))
    return found.withColumn("repaired_sha256", F.sha2(F.col("repaired").cast("binary"), 256)).drop("repaired")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_toxicity": op2_toxicity,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_bpe_codec": op5_bpe_codec,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_warc": op7_warc,
        "op8_chat_format": op8_chat_format,
        "op9_decontaminate": op9_decontaminate,
        "op10_url_filter": op10_url_filter,
        "op11_filter_audit": op11_filter_audit,
        "op12_lm_scoring": op12_lm_scoring,
        "op13_structure_repair": op13_structure_repair,
    }


_WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = f"translate(coalesce({{0}}, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}')"

_OP3 = rf"""
WITH w AS (SELECT doc_id, {_WORDS.replace("text", "coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
e AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h FROM g),
m AS (SELECT h, min(doc_id) AS low FROM e GROUP BY h),
r AS (SELECT DISTINCT e.doc_id, e.i + o.o AS p FROM e JOIN m USING (h), range(0, 13) AS o(o) WHERE m.low < e.doc_id),
p AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(list_transform(range(1, len(ws) + 1), lambda j: (j, ws[j])), lambda x: NOT list_contains(gone, x[1])), lambda x: x[2]) END AS kept
  FROM w LEFT JOIN p USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

_OP4 = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER.format("text")}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

_OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("text", _LOWER.format("text"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 2)), lambda i: array_to_string(ws[i:i + 3], ' '))) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY ALL
"""

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""

_OP8 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (SELECT *, regexp_replace(text, '[\\#<]', '\\\0', 'g') AS esc, regexp_replace(role, '[\\#<:]', '\\\0', 'g') AS esc_role FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || esc_role || ': ' || esc || '</turn>') + 1) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

_OP10 = f"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
x AS (SELECT page_id, {_LOWER.format("h")} AS host, path, row_number() OVER () AS n FROM u),
rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urlfilter.CONTRACT_RULES)}),
m AS (SELECT n, max_by((h || p, verdict), length(h || p)) AS won FROM x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, won[1] AS rule, coalesce(won[2], 'allow') AS verdict FROM x LEFT JOIN m USING (n)
"""

_OP9 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
v AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(ws) - 11, 2)), lambda i: ws[i:i + 12])) AS win FROM b WHERE len(ws) > 0),
t AS (SELECT array_to_string(win, ' ') AS k, len(win) AS n, list(DISTINCT item_id) AS items FROM v GROUP BY ALL),
s AS (SELECT DISTINCT n FROM t),
g AS (SELECT doc_id, s.n AS n, unnest(range(1, len(ws) - s.n + 2)) AS i, ws FROM w, s WHERE len(ws) >= s.n),
h AS (SELECT g.doc_id, g.i, g.n, t.items FROM g JOIN t ON t.n = g.n AND t.k = array_to_string(g.ws[g.i:g.i + g.n - 1], ' ')),
p AS (SELECT doc_id, count(DISTINCT i + o.o) AS n_hit FROM h, range(0, 13) AS o(o) WHERE o.o < h.n GROUP BY doc_id),
q AS (SELECT doc_id, list_sort(list(DISTINCT x)) AS items FROM (SELECT doc_id, unnest(items) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""


_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS fs FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(fs, lambda i: 'ABCDE'[i]), '') AS filter_order, step, fs[step] AS i, fs[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, i, n, good, toxic, fails[i] AS fail, list_bool_or(list_transform(before, lambda j: fails[j])) AS gone,
  len(list_filter(fails, lambda x: x)) AS failures FROM c, s),
t AS (SELECT part, filter_order, step, i,
  sum(n) FILTER (NOT coalesce(gone, false) AND NOT fail) AS kept, sum(n) FILTER (fail AND NOT coalesce(gone, false)) AS removed, sum(n) FILTER (fail AND coalesce(gone, false)) AS redundant,
  sum(n) FILTER (fail AND failures = 1) AS unique_fails, sum(good) FILTER (fail AND NOT coalesce(gone, false)) AS good_lost, sum(toxic) FILTER (fail AND NOT coalesce(gone, false)) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, i), 0) AS BIGINT) AS shapley FROM t
"""

#: CTEs: crc_of holds the 256 values of the checksum's table.
_CRC_TABLE = """crc_rows(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_rows WHERE k < 8),
crc_of AS (SELECT list(c ORDER BY i) AS tab FROM crc_rows WHERE k = 8)"""


def _crc32(key: str) -> str:
    """Of an ASCII text; needs crc_of among the tables."""
    return f"xor(list_reduce(list_concat([4294967295], list_transform(list_filter(string_split({key}, ''), lambda x: x <> ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


def _rounded(share: str) -> str:
    return f"coalesce(pow(10, -round(-log10({share}) * {ngramlm.STEP}) / {ngramlm.STEP}), 0)"


_OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 10 = 0 AS held_out,
  list_concat([' b'], {_WORDS.replace("text", _LOWER.format("text"))}, [' e']) AS l FROM documents, crc_of),
s AS (SELECT r, doc_id, held_out, i, l[i] AS z, l[i - 1] AS y, CASE WHEN i > 2 THEN l[i - 2] END AS x FROM (SELECT *, unnest(range(2, len(l) + 1)) AS i FROM d)),
c1 AS (SELECT z, count(*) AS c FROM s WHERE NOT held_out GROUP BY z UNION ALL SELECT ' b', count(*) FROM d WHERE NOT held_out),
c2 AS (SELECT y, z, count(*) AS c FROM s WHERE NOT held_out GROUP BY ALL),
c3 AS (SELECT x, y, z, count(*) AS c FROM s WHERE NOT held_out AND x IS NOT NULL GROUP BY ALL),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) FILTER (c > 0) AS v FROM c1 WHERE z <> ' b'),
p AS (SELECT s.*, n.n AS train_tokens, coalesce(a.c, 0) AS c, (coalesce(a.c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (v + 1)) AS p1, coalesce(b.c, 0) AS cy, c2.c AS cyz, c3.c AS cxyz, e.c AS cxy, coalesce(g.c, 0) AS cx
  FROM s CROSS JOIN n LEFT JOIN c1 a ON a.z = s.z LEFT JOIN c1 b ON b.z = s.y LEFT JOIN c1 g ON g.z = s.x LEFT JOIN c2 ON c2.y = s.y AND c2.z = s.z
  LEFT JOIN c3 ON c3.x = s.x AND c3.y = s.y AND c3.z = s.z LEFT JOIN c2 e ON e.y = s.x AND e.z = s.y),
q AS (SELECT *, {_rounded("cyz / (cy + k2)")} + k2 / (cy + k2) * p1 AS p2, {_rounded("cxy / (cx + k2)")} * (cx + k2) AS near FROM p, (SELECT {ngramlm.K2}::DOUBLE AS k2, {ngramlm.K3}::DOUBLE AS k3)),
u AS (SELECT *, CASE WHEN x IS NULL THEN p2 ELSE {_rounded("cxyz / (cxy + k3)")} + k3 / (near + k3) * p2 END AS p3 FROM q)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(any_value(train_tokens) AS BIGINT) AS train_tokens,
  sum(log10(p1)) AS base_score, sum(log10(least(p3, 1))) AS score FROM u GROUP BY r, doc_id, held_out
"""

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _after(prefix: str, cost: str, letter: str, allowed: str = "true") -> str:
    return f"CASE WHEN {allowed} AND {prefix} IS NOT NULL THEN {{'c': {prefix}.c + {cost}, 'a': {prefix}.a || '{letter}'}} END"


_FREE = "coalesce(f, '') NOT IN ('blank', 'duplicate')"
_MORE = "CASE WHEN f = 'truncated' THEN 3 ELSE 0 END"


def _any_of(*choices: str) -> str:
    """The least (cost, audit) of those that there are."""
    return f"list_sort(list_filter([{', '.join(choices)}], lambda x: x IS NOT NULL))[1]"


_OP13 = rf"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations, crc_of),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
f AS (SELECT *, role[1] AS g, CASE WHEN trim(text, {_BLANKS}) = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN rtrim(text, {_BLANKS})[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS f,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM n),
r(conv_id, i, p0, p1, p2, p3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'a': ''}}, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)), {{'c': 3, 'a': 'I'}}, {{'c': 6, 'a': 'IJ'}} FROM k
  UNION ALL SELECT conv_id, i, q0, q1, u, {_any_of("q3", _after("u", "3", "J"))} FROM (
    SELECT *, {_any_of("q2", _after("q0", "3", "I"), _after("q1", "3", "I"), _after("q3", "3", "I"))} AS u FROM (
      SELECT r.conv_id, f.i, {_after("p0", "4", "D")} AS q0,
        {_any_of(_after("p1", "4", "D"), _after("p0", _MORE, "K", f"{_FREE} AND g = 's'"))} AS q1,
        {_any_of(_after("p2", "4", "D"), *[_after(p, _MORE, "K", f"{_FREE} AND g = 'u'") for p in ("p0", "p1", "p3")], *[_after(p, f"3 + {_MORE}", "R", _FREE) for p in ("p0", "p1", "p3")])} AS q2,
        {_any_of(_after("p3", "4", "D"), _after("p2", _MORE, "K", f"{_FREE} AND g = 'a'"), _after("p2", f"3 + {_MORE}", "S", _FREE))} AS q3
      FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1))),
b AS (SELECT conv_id, arg_max({_any_of("p0", "p3")}, i) AS best FROM r GROUP BY conv_id),
e AS (SELECT conv_id, regexp_extract_all(best.a, '[IJ]*[DKRS]') AS es, regexp_extract(best.a, '[IJ]*$') AS rest FROM b),
x AS (SELECT e.conv_id, string_agg(replace(replace(regexp_replace(es[i], '[DKRS]', ''), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10))
    || CASE es[i][-1] WHEN 'K' THEN role || ':' || text || chr(10) WHEN 'R' THEN 'user:' || text || chr(10) WHEN 'S' THEN 'assistant:' || text || chr(10) ELSE '' END, '' ORDER BY i) AS lines
  FROM e JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id GROUP BY e.conv_id),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.c AS BIGINT) AS cost, translate(best.a, 'JS', 'IR') AS audit, sha256(regexp_replace(coalesce(lines, '') || replace(replace(rest, 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)), '\n$', '')) AS repaired_sha256
FROM b JOIN e ON e.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": _OP3,
        "op4_exact_dedup": _OP4,
        "op6_jaccard_join": _OP6,
        "op7_warc": _OP7,
        "op8_chat_format": _OP8,
        "op9_decontaminate": _OP9,
        "op10_url_filter": _OP10,
        "op11_filter_audit": _OP11,
        "op12_lm_scoring": _OP12,
        "op13_structure_repair": _OP13,
    }
