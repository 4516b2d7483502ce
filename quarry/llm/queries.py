"""The registered queries of the training-data operators and their DuckDB SQL.

Each query applies its operator, with production parameters, to its whole table and derives the
columns of its contract from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (context_mixing, decontaminate, filter_audit, hnsw, language_id, license_scan, mixing, pii, sharding, simhash, spelling,
               topk, toxicity)
from .common import table, written


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id")


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))).withColumn("learned", ~F.col("held_out"))
    keep = ("doc_id", "held_out")
    return context_mixing.score(docs, context_mixing.learn(docs, "learned", keep), keep)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(rows, rows.where("vec_id % 20 = 0"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    known = language_id.profiles(docs.where("NOT held_out"))
    return language_id.identify(docs, known, keep=("doc_id", "held_out"))


def sharded(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "source", sharding.size_of(F.col("text")).alias("size"),
                       F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shard(rows).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.lit(0).alias("key"), "doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix(written(rows, "sizes")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_context_mixing, op3_pii, op4_hnsw, op5_language_id, op6_sharding, op7_toxicity, op8_mixing, op9_license_scan,
    op10_decontamination, op11_spelling_variants, op12_exact_top_k, op13_filter_audit)}

# ---- DuckDB SQL. The other operators' models and hashes have no SQL form; tests/llm holds plain versions.

#: seeded(): 48 bits of an md5, as a double in (0, 1)
_DRAW = "(('0x' || substr(md5({key}), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0"

_OP8 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
t AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w
  FROM d GROUP BY source),
-- round after round: share what is left by weight, stop the sources above 3 times their size
fill(i, source, source_size, w, stopped, level) AS (
  SELECT 0, source, source_size, w, false, sum(source_size) OVER ()::DOUBLE / sum(w) OVER () FROM t
  UNION ALL
  SELECT i + 1, source, source_size, w, stopped OR level * w > 3 * source_size,
         (sum(source_size) OVER () - sum(CASE WHEN stopped OR level * w > 3 * source_size THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE
         / nullif(sum(CASE WHEN stopped OR level * w > 3 * source_size THEN 0 ELSE w END) OVER (), 0)
  FROM fill WHERE i < (SELECT count(*) FROM t)),
g AS (
  SELECT f.source, f.source_size, CASE WHEN f.stopped THEN 3.0::DOUBLE * f.source_size ELSE f.level * f.w END AS target
  FROM fill f JOIN t ON f.source IS NOT DISTINCT FROM t.source WHERE i = (SELECT count(*) FROM t)),
q AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS whole,
         {_DRAW.format(key="'mix:' || coalesce(doc_id::VARCHAR, 'null') || ':0:1'")} AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
o AS (SELECT *, target - whole * source_size AS rest FROM q),
-- chance min(1, c * size): sizes from the longest, c as if all longer ones were certain; the first that holds
n AS (SELECT source, size, count(*) AS n, any_value(rest) AS rest FROM o WHERE size > 0 AND size <= rest GROUP BY source, size),
m AS (
  SELECT source, size, (rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(n * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS c FROM n),
lv AS (SELECT source, max(size) AS upto, arg_max(c, size) AS c FROM m WHERE c > 0 AND c * size <= 1 GROUP BY source),
k AS (
  SELECT o.*, CASE WHEN size > 0 AND size <= rest THEN CASE WHEN upto IS NULL OR size > upto THEN 1.0::DOUBLE ELSE c * size END END AS chance,
         CASE WHEN chance >= 1 THEN 0.0 WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank
  FROM o LEFT JOIN lv ON o.source IS NOT DISTINCT FROM lv.source),
f AS (
  SELECT *, rank IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) <= rest AS drawn,
         CASE WHEN rank IS NOT NULL THEN floor(log2(size))::INTEGER END AS class FROM k),
v AS (SELECT *, rest - coalesce(sum(size) FILTER (drawn) OVER (PARTITION BY source), 0) AS gap FROM f),
-- what the first misfit leaves is filled by size class, largest first
b AS (
  SELECT source, class, doc_id, gap, sum(size) OVER (PARTITION BY source, class ORDER BY rank, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto
  FROM v WHERE rank IS NOT NULL AND NOT drawn AND size <= gap),
walk(source, class, amount, most) AS (
  SELECT source, 63, any_value(gap), 0::BIGINT FROM b GROUP BY source
  UNION ALL
  SELECT w.source, w.class - 1, w.amount - coalesce(max(b.upto), 0), coalesce(max(b.upto), 0)::BIGINT
  FROM walk w LEFT JOIN b ON b.source IS NOT DISTINCT FROM w.source AND b.class = w.class - 1 AND b.upto <= w.amount
  WHERE w.class > 0 GROUP BY w.source, w.class, w.amount),
z0 AS (
  SELECT v.* EXCLUDE (drawn, gap), drawn OR coalesce(b.upto <= w.most, false) AS drawn
  FROM v LEFT JOIN b ON b.doc_id IS NOT DISTINCT FROM v.doc_id AND b.source IS NOT DISTINCT FROM v.source AND NOT v.drawn AND v.rank IS NOT NULL AND v.size <= v.gap
  LEFT JOIN walk w ON w.source IS NOT DISTINCT FROM b.source AND w.class = b.class),
-- twice, the one document more that comes nearest to what is left
y1 AS (SELECT *, rest - coalesce(sum(size) FILTER (drawn) OVER (PARTITION BY source), 0) AS gap FROM z0),
z1 AS (SELECT * EXCLUDE (drawn, gap), drawn OR (abs(gap - size) < abs(gap) AND size > 0 AND row_number() OVER (
         PARTITION BY source ORDER BY drawn OR size = 0, abs(gap - size), coalesce(rank, 'Infinity'::DOUBLE), doc_id NULLS LAST) = 1) AS drawn FROM y1),
y2 AS (SELECT *, rest - coalesce(sum(size) FILTER (drawn) OVER (PARTITION BY source), 0) AS gap FROM z1),
z2 AS (SELECT * EXCLUDE (drawn, gap), drawn OR (abs(gap - size) < abs(gap) AND size > 0 AND row_number() OVER (
         PARTITION BY source ORDER BY drawn OR size = 0, abs(gap - size), coalesce(rank, 'Infinity'::DOUBLE), doc_id NULLS LAST) = 1) AS drawn FROM y2),
e AS (SELECT *, whole + CASE WHEN drawn THEN 1 ELSE 0 END AS copies FROM z2)
SELECT doc_id, source, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM e
"""

_OP10 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, list_slice(w, i, i + 9) AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM windows),
places AS (
  SELECT rid, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item FROM places JOIN windows USING (g)),
words AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

_OP12 = r"""
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) q
  JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

_OP13 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
-- one bit a failed filter: A 1, B 2, C 4, D 8, E 16
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask),
-- every order of the filters, step by step: the filter, the filters before it
o(ord, used) AS (
  SELECT '', 0 UNION ALL
  SELECT ord || f, used + b FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, b) WHERE used & b = 0),
s AS (
  SELECT ord AS filter_order, i::INT AS step, 1 << (ascii(ord[i]) - 65) AS bit,
         list_sum([1 << (ascii(ord[j]) - 65) FOR j IN range(1, i)])::INT AS earlier
  FROM o, range(1, 6) r(i) WHERE used = 31),
x AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER (mask & (coalesce(earlier, 0) | bit) = 0) AS kept,
         sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0) AS removed,
         sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) <> 0) AS redundant,
         sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0) AS good_lost,
         sum(toxic) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM x
"""

ORACLE: dict[str, str] = {"op8_mixing": _OP8, "op10_decontamination": _OP10, "op12_exact_top_k": _OP12, "op13_filter_audit": _OP13}
