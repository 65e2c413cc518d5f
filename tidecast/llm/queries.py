"""Queries of the training-data operators: thin opN_<name> functions over the tables, and their DuckDB SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes: the labels row with the page's number (good: of quality and not toxic), a stand-in for page audits."""
    from .hosts import judge

    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"), "level")


OP2_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
lv AS (SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS p FROM hp),
seen AS (SELECT page_id, host, path, CASE WHEN array_to_string(p[-2:], '.') IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix,
         CASE WHEN array_to_string(p[-2:], '.') IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM lv),
lab AS (SELECT s.*, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS good FROM seen s JOIN labels l ON l.doc_id = s.page_id),
hosts AS (SELECT suffix, domain, host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS good FROM lab GROUP BY ALL),
root AS (SELECT (coalesce(sum(good), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS mean, coalesce(sum(n), 0) + 2.0 AS strength FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(r.mean) AS parent FROM hosts, root r GROUP BY suffix),
sk AS (SELECT sum(pow(good - n * parent, 2) / n - parent * (1 - parent)) / sum(parent * (1 - parent) * (n - 1)) AS rho FROM s0),
sr AS (SELECT suffix, n, good, parent, greatest(1.0, least(1000.0, coalesce(CASE WHEN rho > 0 THEN (1 - rho) / rho END, 1000.0))) AS k FROM s0, sk),
sfx AS (SELECT suffix, (good + k * parent) / (n + k) AS mean, n + k AS strength FROM sr),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
d1 AS (SELECT d0.*, sfx.mean AS parent FROM d0 JOIN sfx USING (suffix)),
dk AS (SELECT sum(pow(good - n * parent, 2) / n - parent * (1 - parent)) / sum(parent * (1 - parent) * (n - 1)) AS rho FROM d1),
dr AS (SELECT domain, n, good, parent, greatest(1.0, least(1000.0, coalesce(CASE WHEN rho > 0 THEN (1 - rho) / rho END, 1000.0))) AS k FROM d1, dk),
dom AS (SELECT domain, (good + k * parent) / (n + k) AS mean, n + k AS strength FROM dr),
h1 AS (SELECT hosts.*, dom.mean AS parent FROM hosts JOIN dom USING (domain)),
hk AS (SELECT sum(pow(good - n * parent, 2) / n - parent * (1 - parent)) / sum(parent * (1 - parent) * (n - 1)) AS rho FROM h1),
hr AS (SELECT host, n, good, parent, greatest(1.0, least(1000.0, coalesce(CASE WHEN rho > 0 THEN (1 - rho) / rho END, 1000.0))) AS k FROM h1, hk),
hst AS (SELECT host, (good + k * parent) / (n + k) AS mean, n + k AS strength FROM hr),
sc AS (SELECT s.page_id, s.host, s.path, coalesce(h.mean, d.mean, x.mean, r.mean) AS mean, coalesce(h.strength, d.strength, x.strength, r.strength) AS strength,
       CASE WHEN h.host IS NOT NULL THEN 'host' WHEN d.domain IS NOT NULL THEN 'domain' WHEN x.suffix IS NOT NULL THEN 'suffix' ELSE 'root' END AS level
       FROM seen s CROSS JOIN root r LEFT JOIN hst h ON h.host = s.host LEFT JOIN dom d ON d.domain = s.domain LEFT JOIN sfx x ON x.suffix = s.suffix),
jd AS (SELECT *, greatest(0.0, mean - 1.645 * sqrt(mean * (1 - mean) / (strength + 1))) AS score,
       CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM sc)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN score >= 0.5 THEN 'allow' ELSE 'block' END AS verdict,
       round(score, 9) AS score, level FROM jd
"""


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizer versions; toxic ones deleted, low-quality ones recounted without symbols; every batch sent twice."""
    from .common import Scratch, with_ids
    from .rollups import COUNTERS, Rollup, count_tokens

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scratch = Scratch(spark, "rollups")
    rollup = Rollup(spark, f"{scratch.root}/totals")
    # every text is counted once, in one narrow pass; labels meet the counts, so no text moves
    plain = F.regexp_replace("text", r"[!#$%&*|]+", " ")
    counts = F.array(*[F.struct(F.lit(v).alias("version"), count_tokens(F.col("text"), v).alias("n"), count_tokens(plain, v).alias("plain")) for v in COUNTERS])
    each = scratch.save(docs.select("doc_id", "source", "lang", F.explode(counts).alias("c")).select("doc_id", "source", "lang", "c.*"), "counts")
    toxic = scratch.save(labels.where("toxic = 1").select("doc_id").distinct(), "toxic")
    poor = scratch.save(labels.where("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti"), "poor")
    load = each.select("source", "lang", "version", F.col("n").alias("n_tokens"), F.lit(0).alias("old_tokens"))
    gone = with_ids(each, toxic, "doc_id").select("source", "lang", "version", F.col("n").alias("n_tokens"), F.lit(0).alias("old_tokens"))
    fewer = with_ids(each, poor, "doc_id").select("source", "lang", "version", F.col("plain").alias("n_tokens"), F.col("n").alias("old_tokens"))
    for name, op, rows in (("load", "insert", load), ("toxic", "delete", gone), ("symbols", "revise", fewer)):
        for _ in range(2):
            rollup.commit(name, rows.select(F.lit(op).alias("op"), "source", "lang", "version", "n_tokens", "old_tokens"))
    for t in (each, toxic, poor):
        scratch.drop(t)
    rollup.compact()
    return rollup.totals()


OP6_SQL = r"""
WITH c AS (
  SELECT doc_id, source, lang, 'words-1' AS version, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[!#$%&*|]+', ' ', 'g'), '[^\x20\x09-\x0D]+')) AS plain FROM documents
  UNION ALL
  SELECT doc_id, source, lang, 'pieces-1', len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+')), len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[!#$%&*|]+', ' ', 'g'), '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+')) FROM documents),
ch AS (
  SELECT source, lang, version, 1 AS docs, n AS tokens FROM c
  UNION ALL SELECT source, lang, version, -1, -n FROM c WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT source, lang, version, 0, plain - n FROM c WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0))
SELECT source, lang, version, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens FROM ch GROUP BY ALL HAVING sum(docs) <> 0 OR sum(tokens) <> 0
"""


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "repeats", "taken")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op9_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import grade, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, ratings(table(spark, sf_dir, "labels")), levels=3)
    return grade(docs, model, least=2)


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of labelled documents: 0 without quality, 1 with quality but toxic, 2 with quality and not toxic."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op12_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 8 KiB, as these pages are small: about one in forty is then put together from several."""
    from .warc import round_trip

    back = round_trip(table(spark, sf_dir, "pages"), segment=8192)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM q
"""


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings")).drop("looked")


def _op13_sql() -> str:
    """Every round over all centroids, unrolled; all numbers are whole and below 2**53."""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "c0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS m FROM v) x WHERE c < 40)"]
    for k in range(6):
        parts.append(f"a{k} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(CAST(list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m) AS BIGINT) * 64 + c) AS k FROM v, c{k} GROUP BY vec_id)")
        if k < 5:
            parts.append(f"m{k} AS (SELECT c, list(mean ORDER BY i) AS m FROM (SELECT c, i, floor(sum(x) / count(*)) AS mean FROM (SELECT k % 64 AS c, unnest(range(64)) AS i, unnest(v) AS x FROM a{k}) x GROUP BY c, i) y GROUP BY c)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(m{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN m{k} ON m{k}.c = c{k}.c)")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, CAST(c AS INTEGER) AS cluster, k // 64 AS distance, CAST(sum(k // 64) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(k // 64) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(m, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM a5 JOIN c5 ON c5.c = a5.k % 64
"""


def queries() -> dict:
    each = (op1_personal_data, op2_url_reputation, op3_byte_bpe, op4_license_scan, op5_embedding_pairs, op6_token_rollups, op7_source_mix, op8_nearest, op9_quality_grades, op10_shingle_join)
    return {f.__name__: f for f in (*each, op11_spelling_variants, op12_warc_round_trip, op13_centroid_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_reputation": OP2_SQL, "op6_token_rollups": OP6_SQL, "op12_warc_round_trip": OP12_SQL, "op13_centroid_clusters": _op13_sql()}
