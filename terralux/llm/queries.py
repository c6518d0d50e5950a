"""Registered queries of the text operators, each over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralux.llm import (
    ann_forest,
    best_fit_packing,
    best_fit_sharding,
    byte_dedup,
    decontaminate,
    hadamard_clustering,
    importance_resampling,
    jaccard_join,
    language_id,
    line_dedup,
    lm_interpolation,
    toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_interpolation.interpolation_scores(_table(spark, sf_dir, "documents"))


@_query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(_table(spark, sf_dir, "documents"))


@_query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


@_query
def op5_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann_forest.nearest(rows, rows.where("vec_id % 50 = 0"))


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kept = line_dedup.delete_repeated_lines(docs)
    return kept.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@_query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.repeated_spans(_table(spark, sf_dir, "documents")).drop("starts", "ends")


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents")).drop("class")


@_query
def op11_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_sharding.sharded(_table(spark, sf_dir, "documents"))


@_query
def op12_hadamard_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard_clustering.cluster(_table(spark, sf_dir, "embeddings"))


@_query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _term_hits(strict: bool) -> str:
    terms = [t for t, w in url_filter.VOCABULARY.items() if (w >= url_filter.STRICT) == strict]
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^0-9a-z]){t}([^0-9a-z]|$)') AS INTEGER)" for t in terms)


def _rule_cases(field: int) -> str:
    # Longest first, so that the first fitting rule is the one that decides.
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    return " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[field]}'" for h, p, v in rules
    )


ORACLES["op4_url_filter"] = f"""
WITH base AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM base),
hits AS (
  SELECT page_id, host, path, CASE {_rule_cases(0)} END AS rule, CASE {_rule_cases(1)} END AS ruled,
         {_term_hits(True)} AS strict_hits, {_term_hits(False)} AS soft_hits
  FROM parts)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN strict_hits > 0 OR soft_hits >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits
FROM hits"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WIDTH = decontaminate.WIDTH
ORACLES["op9_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, size, list_slice(w, i, i + size - 1) AS g
  FROM (SELECT item_id, w, least({_WIDTH}, len(w)) AS size, unnest(range(1, len(w) - least({_WIDTH}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
spot AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
hits AS (SELECT doc_id, item_id, i, spot.size FROM spot JOIN win ON win.size = spot.size AND win.g = list_slice(w, i, i + spot.size - 1)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {decontaminate.SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLES["op10_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + {jaccard_join.SHINGLE - 1})) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {jaccard_join.SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= {jaccard_join.PERCENT} * (any_value(x.n) + any_value(y.n) - count(*))),
cc(id, c) USING KEY (id) AS (SELECT doc_id AS id, doc_id AS c FROM d UNION
  SELECT l.u AS id, min(w.c) AS c FROM cc w JOIN links l ON l.v = w.id JOIN recurring.cc o ON o.id = l.u WHERE w.c < o.c GROUP BY l.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, cc.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN cc ON cc.id = d.doc_id"""


# Rounds are named tables; centroids are rows of (cluster, place, component).
_DIM, _K, _ROUNDS = hadamard_clustering.DIMENSION, hadamard_clustering.K, hadamard_clustering.ROUNDS


def _nearest(round_: int) -> str:
    return f"""a{round_} AS (SELECT vec_id, min(struct_pack(d := d, c := c)) AS b FROM (
    SELECT vec_id, c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM v JOIN c{round_} k USING (i) GROUP BY vec_id, c) GROUP BY vec_id)"""


def _moved(round_: int) -> str:
    return f"""c{round_ + 1} AS (SELECT k.c, k.i, CASE WHEN n IS NULL THEN k.x ELSE (s - ((s % n) + n) % n) // n END AS x
    FROM c{round_} k LEFT JOIN (SELECT a.b.c AS c, i, sum(x) AS s, count(*) AS n FROM a{round_} a JOIN v USING (vec_id) GROUP BY 1, 2) m USING (c, i))"""


ORACLES["op12_hadamard_clustering"] = f"""
WITH kept AS (SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = {_DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {_DIM}),
v AS (SELECT vec_id, i, CAST(floor({hadamard_clustering.SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {_DIM + 1}) t(i)),
starts AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{hadamard_clustering.SEED}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {_K}),
c0 AS (SELECT c, i, x FROM starts JOIN v USING (vec_id)),
{", ".join(f"{_nearest(r)}, {_moved(r)}" for r in range(_ROUNDS))},
{_nearest(_ROUNDS)},
sha AS (SELECT c, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS h FROM c{_ROUNDS} GROUP BY c)
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance,
       CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{_ROUNDS} JOIN sha ON sha.c = b.c"""


def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1
        table.append(b)
    return table


_BUCKETS, _RUN, _SEED = importance_resampling.BUCKETS, importance_resampling.RUN, importance_resampling.SEED
ORACLES["op13_importance_resampling"] = f"""
WITH t AS (SELECT 0 AS side, doc_id, {_WORDS} AS w FROM documents UNION ALL SELECT 1, NULL, {_WORDS} FROM benchmark),
f AS (SELECT side, doc_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g, count(*) AS k
  FROM (SELECT side, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, range(1, {_RUN + 1}) r(n) WHERE len(w) >= n) GROUP BY ALL),
crc AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda p: CAST('0x' || substr(h, p, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, ({_crc_table()})[(xor(a, b) & 255) + 1])), 4294967295) % {_BUCKETS} AS bucket
  FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM f))),
n AS (SELECT bucket, sum(k) FILTER (side = 0) AS s, sum(k) FILTER (side = 1) AS t FROM f JOIN crc USING (g) GROUP BY bucket),
whole AS (SELECT CAST(coalesce(sum(k) FILTER (side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(k) FILTER (side = 1), 0) AS DOUBLE) AS t FROM f),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(n.t, 0) + 1.0::DOUBLE) * (whole.s + {_BUCKETS}) / ((coalesce(n.s, 0) + 1.0::DOUBLE) * (whole.t + {_BUCKETS})))) AS BIGINT) AS gain FROM n, whole),
weight AS (SELECT doc_id, sum(k) AS n_features, sum(k * gain) AS weight FROM f JOIN crc USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (SELECT t.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{_SEED}:' || t.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM t LEFT JOIN weight USING (doc_id) WHERE side = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= {importance_resampling.LEAST_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN rank <= {importance_resampling.PERCENT} * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""
