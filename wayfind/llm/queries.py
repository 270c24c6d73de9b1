"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm import centroids, importance, license_scan, media, mixing, near_vectors, packing, personal, quality, shingle_join, substring_dedup, toxicity, url_filter
from wayfind.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rk FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w, source_size * 3 AS cap FROM by_source
), running AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS w_all,
    coalesce(sum(cap) OVER o, 0)::BIGINT AS caps_before, coalesce(sum(w) OVER o, 0)::BIGINT AS w_before
  FROM weighted WINDOW o AS (ORDER BY cap * (10 // w), rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, (total - caps_before) * w > cap * (w_all - w_before) AS capped FROM running
), level AS (
  SELECT *, total - coalesce(sum(cap) FILTER (capped) OVER (), 0)::BIGINT AS rest, w_all - coalesce(sum(w) FILTER (capped) OVER (), 0)::BIGINT AS w_rest FROM judged
), goals AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (rest * w)::DOUBLE / nullif(w_rest, 0)::DOUBLE END AS target FROM level
), rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, least(coalesce(g.target / nullif(g.source_size, 0), 0), 3.0) AS rate
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken
FROM rated
"""


@query("op1_mixing", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_shingle_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_report(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, own, start) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), outcome AS (
  SELECT doc_id AS page_id, min(quality)::BIGINT AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id
), counted AS (
  SELECT host, regexp_replace(host, ':[0-9]*$', '') AS bare, sum(good)::DOUBLE AS k, count(*)::DOUBLE AS n FROM parts JOIN outcome USING (page_id) GROUP BY host
), labels_of AS (
  SELECT *, regexp_matches(bare, '^[0-9.]+$') AS address, string_split(bare, '.') AS parts_, array_to_string(string_split(bare, '.')[-2:], '.') AS two FROM counted
), long_ AS (
  SELECT *, two IN ('ac.uk', 'co.in', 'co.jp', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'github.io', 'gov.uk', 'net.au', 'org.au', 'org.uk') AS is_long FROM labels_of
), hosts AS (
  SELECT host, k, n, CASE WHEN address THEN bare WHEN is_long THEN array_to_string(parts_[-3:], '.') ELSE two END AS domain, CASE WHEN address THEN '' WHEN is_long THEN two ELSE parts_[-1] END AS suffix FROM long_
), domains AS (SELECT domain, suffix, sum(k) AS k, sum(n) AS n FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(k) AS k, sum(n) AS n FROM domains GROUP BY suffix),
levels AS (
  SELECT 1 AS lv, k, n FROM suffixes UNION ALL SELECT 2, k, n FROM domains UNION ALL SELECT 3, k, n FROM hosts
), sums AS (SELECT lv, sum(k) AS kk, sum(n) AS nn, sum(n * n) AS n2, count(*) AS c FROM levels GROUP BY lv),
spread AS (SELECT lv, kk, nn, n2, c, sum((k - n * kk / nn) * (k - n * kk / nn) / n) AS s FROM levels JOIN sums USING (lv) GROUP BY ALL),
rho AS (
  SELECT lv, greatest(0.0001, least(0.5, CASE WHEN d = 0 OR kk = 0 OR kk = nn THEN 0.0001 ELSE (s / (kk / nn * (1 - kk / nn)) - (c - 1)) / d END)) AS rho
  FROM (SELECT *, nn - n2 / nn - (c - 1) AS d FROM spread)
), consts AS (
  SELECT (SELECT (sum(k) + 1) / (sum(n) + 2) FROM suffixes) AS floor_, (SELECT 1 / rho - 1 FROM rho WHERE lv = 1) AS s1, (SELECT 1 / rho - 1 FROM rho WHERE lv = 2) AS s2, (SELECT 1 / rho - 1 FROM rho WHERE lv = 3) AS s3
), by_suffix AS (SELECT suffix, (k + s1 * floor_) / (n + s1) AS p FROM suffixes, consts),
by_domain AS (SELECT domain, (d.k + s2 * p) / (d.n + s2) AS p FROM domains d JOIN by_suffix USING (suffix), consts),
post AS (
  SELECT host, k + s3 * p AS a, n - k + s3 * (1 - p) AS b, floor_ FROM hosts JOIN by_domain USING (domain), consts
), bad AS (
  SELECT host FROM post WHERE a / (a + b) + 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) < floor_
), best AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.own || r.start, length(r.own || r.start)) AS rule, arg_max(r.verdict, length(r.own || r.start)) AS verdict
  FROM (SELECT DISTINCT * FROM parts) p JOIN rules r ON (p.host = r.own OR ends_with(p.host, '.' || r.own)) AND starts_with(p.path, r.start)
  GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN p.host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.host = b.host AND p.path = b.path
"""


@query("op6_url_filter", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op9_near_vectors")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_media")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for hosts, and a source's languages for its paths."""
    path = F.concat_ws("/", "source", "lang")
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), path)


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for a repository, whose directories hold its documents by language and thousand."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.expr("doc_id div 1000"), "doc_id")
    return license_scan.scan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")


@query("op11_personal_data")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(table(spark, sf_dir, "documents"))


def _kmeans_sql(clusters: int, rounds: int) -> str:
    """Plain k-means: every vector against every centroid, round by round."""
    parts = [f"""
  kept AS MATERIALIZED (
    SELECT vec_id, [greatest(least(floor(256 * x::DOUBLE), 16777216), -16777216)::BIGINT FOR x IN embedding] AS x FROM embeddings
    WHERE len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
  ), v AS MATERIALIZED (SELECT vec_id, unnest(x) AS x, unnest(range(64)) AS i FROM kept),
  first AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x)::INTEGER - 1 AS cluster, x FROM kept QUALIFY cluster < {clusters}),
  c0 AS MATERIALIZED (SELECT cluster, unnest(x) AS c, unnest(range(64)) AS i FROM first)"""]
    for k in range(rounds + 1):
        parts.append(f"""
  d{k} AS (SELECT vec_id, cluster, sum((x - c) * (x - c))::BIGINT AS distance FROM v JOIN c{k} USING (i) GROUP BY ALL),
  n{k} AS MATERIALIZED (SELECT vec_id, cluster, distance FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if k < rounds:
            parts.append(f"""
  s{k} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN n{k} USING (vec_id) GROUP BY ALL),
  c{k + 1} AS MATERIALIZED (SELECT cluster, i, coalesce((s - (s % n + n) % n) // n, c)::BIGINT AS c FROM c{k} LEFT JOIN s{k} USING (cluster, i))""")
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM n{rounds} JOIN (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) USING (cluster)
"""


@query("op12_centroids", _kmeans_sql(centroids.CLUSTERS, centroids.ROUNDS))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS tab
  FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))
), corpus AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), target AS (
  SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), corpus_words AS MATERIALIZED (SELECT doc_id, unnest(w) AS w FROM corpus),
target_words AS MATERIALIZED (SELECT unnest(w) AS w FROM target),
known AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM corpus_words UNION SELECT w FROM target_words)),
hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)]), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM known, crc_table
), s AS (SELECT bucket, count(*) AS s FROM corpus_words JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM corpus_words) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target_words) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM corpus_words JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM corpus LEFT JOIN weights USING (doc_id)
), ordered AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM scored LEFT JOIN ordered USING (doc_id)
"""


@query("op13_importance_resampling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
