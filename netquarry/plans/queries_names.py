"""Queries on names and texts: DNS, HTTP, encodings, alert texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions import text
from netquarry.functions.lists import HIGH_RISK_TLDS, NAME_KEYWORDS
from netquarry.operators import evidence, signals as sig
from netquarry.operators.common import count_if
from netquarry.plans import adapters
from netquarry.plans.catalog import query

ENTROPY = "coalesce(list_aggregate(string_split({0}, ''), 'entropy'), 0)"
FIRST = "split_part(query, '.', 1)"
SRV = "(starts_with(query, '_') OR contains(query, '._'))"
PARENT = "split_part(query, '.', -2) || '.' || split_part(query, '.', -1)"
STEM = "split_part(query, '.', -2)"
SUSPICIOUS = f"""
  (NOT query LIKE '%.local' AND NOT query LIKE '%.arpa' AND NOT {SRV} AND contains(query, '.')
   AND (split_part(query, '.', -1) IN ({", ".join(repr(t) for t in HIGH_RISK_TLDS)})
        OR regexp_matches(replace(query, '.', ''), '{"|".join(NAME_KEYWORDS)}')
        OR (length({STEM}) >= 8 AND {ENTROPY.format(STEM)} > 3.5)))"""


@query("dns_summary", f"""
WITH {adapters.DNS_SQL},
parents AS (
  SELECT capture_id, {PARENT} AS parent, count(*) AS n, avg(length({FIRST})) AS l
  FROM (SELECT DISTINCT capture_id, query FROM dns) WHERE NOT {SRV} AND NOT query LIKE '%.local' AND contains(query, '.')
  GROUP BY 1, 2),
once AS (SELECT capture_id, query FROM dns GROUP BY 1, 2 HAVING count(*) = 1)
SELECT capture_id, count(DISTINCT query) AS dns_unique_query_count,
       round(avg(length(query)), 6) AS dns_avg_query_length,
       round(avg(CASE WHEN qtype_name IN ('TXT', 'NULL') THEN 1e0 ELSE 0e0 END), 4) AS dns_txt_null_ratio,
       round(avg(CASE WHEN rcode_name = 'NXDOMAIN' THEN 1e0 ELSE 0e0 END), 4) AS dns_nxdomain_rate,
       round(max(CASE WHEN NOT query LIKE '%.local' AND len(string_split(query, '.')) >= 3
                      THEN {ENTROPY.format(FIRST)} ELSE 0 END), 4) AS dns_max_subdomain_entropy,
       CAST(sum(CASE WHEN qtype_name = 'PTR' THEN 1 ELSE 0 END) AS BIGINT) AS dns_ptr_lookup_count,
       (SELECT count(*) FROM parents p WHERE p.capture_id = d.capture_id AND n > 10 AND l > 15) AS dns_suspicious_parent_count,
       (SELECT count(*) FROM once o WHERE o.capture_id = d.capture_id AND {SUSPICIOUS}) AS dns_singleton_suspicious_count
FROM dns d GROUP BY capture_id""")
def dns_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sig.dns_signals(adapters.dns(spark, sf_dir))
    return out.drop("dns_base64_label_count", "dns_c2_service_lookup_count").withColumn(
        "dns_avg_query_length", F.round("dns_avg_query_length", 6)
    )


@query("dns_parents", f"""
WITH {adapters.DNS_SQL},
parents AS (
  SELECT capture_id, {PARENT} AS parent, count(*) AS fqdn_count, avg(length({FIRST})) AS l
  FROM (SELECT DISTINCT capture_id, query FROM dns) WHERE NOT {SRV} AND NOT query LIKE '%.local' AND contains(query, '.')
  GROUP BY 1, 2)
SELECT capture_id, parent, fqdn_count, round(l, 6) AS avg_first_label_length, fqdn_count > 10 AND l > 15 AS suspicious
FROM parents""")
def dns_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sig.dns_parents(adapters.dns(spark, sf_dir))
    return out.withColumn("avg_first_label_length", F.round("avg_first_label_length", 6))


@query("dns_singletons", f"""
WITH {adapters.DNS_SQL}
SELECT query, CAST(count(*) AS BIGINT) AS n, {SUSPICIOUS} AS suspicious FROM dns GROUP BY query HAVING count(*) = 1""")
def dns_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up once over all captures, with the verdict."""
    dns = adapters.dns(spark, sf_dir).withColumn("capture_id", F.lit("all"))
    once = sig.dns_names(dns).where("n = 1")
    return once.select("query", "n", text.is_suspicious_name(F.col("query")).alias("suspicious"))


@query("suspicious_names", f"""
SELECT query, {SUSPICIOUS} AS suspicious FROM (
  SELECT DISTINCT lower(word) || CASE length(word) % 4 WHEN 0 THEN '.su' WHEN 1 THEN '.net' ELSE '.example.com' END AS query
  FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents))""")
def suspicious_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name test on a large vocabulary: every word of the documents as a host name."""
    words = adapters.table(spark, sf_dir, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("word")
    )
    suffix = F.expr("CASE length(word) % 4 WHEN 0 THEN '.su' WHEN 1 THEN '.net' ELSE '.example.com' END")
    names = words.select(F.concat(F.lower("word"), suffix).alias("query")).distinct()
    return names.withColumn("suspicious", text.is_suspicious_name(F.col("query")))


@query("encoded_labels", f"""
WITH labels AS (
  SELECT doc_id, to_base64(unhex(md5(text))) || '.example.com' AS query, to_base64(unhex(md5(text))) AS label FROM documents)
SELECT doc_id % 4 AS bucket,
       CAST(sum(CASE WHEN regexp_full_match(label, '[A-Za-z0-9+/=_-]{{24,}}') AND {ENTROPY.format('label')} > 4.0
                     THEN 1 ELSE 0 END) AS BIGINT) AS encoded
FROM labels GROUP BY 1""")
def encoded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = adapters.table(spark, sf_dir, "documents").select(
        F.expr("doc_id % 4").alias("bucket"),
        F.expr("concat(base64(unhex(md5(text))), '.example.com')").alias("query"),
    )
    return names.groupBy("bucket").agg(count_if(text.has_encoded_label(F.col("query"))).alias("encoded"))


@query("label_entropy", f"""
SELECT word, round({ENTROPY.format('word')}, 6) AS entropy FROM (
  SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM documents)""")
def label_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = adapters.table(spark, sf_dir, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("word")
    ).distinct()
    return words.select("word", F.round(text.shannon_entropy(F.col("word")), 6).alias("entropy"))


@query("dns_evidence", f"""
WITH {adapters.DNS_SQL},
e AS (
  SELECT *, CASE WHEN contains(query, '.') THEN {ENTROPY.format(FIRST)} ELSE 0 END AS h FROM dns)
SELECT capture_id, uid, query, round(h, 6) AS entropy, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY round(h, 9) DESC, ts, uid) AS position
  FROM e WHERE h > 1.5) WHERE position <= 30""")
def dns_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.dns_evidence(adapters.dns(spark, sf_dir), minimum=1.5)
    return out.select("capture_id", "uid", "query", F.round("entropy", 6).alias("entropy"), "position")


@query("web_service_lookups", f"""
WITH {adapters.DNS_SQL}
SELECT capture_id, CAST(sum(CASE WHEN query = 'example.com' OR query LIKE '%.example.com' OR query = 'example.org'
                                      OR query LIKE '%.example.org' THEN 1 ELSE 0 END) AS BIGINT) AS lookups
FROM dns GROUP BY 1""")
def web_service_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups at or below a list of domains."""
    names = sig.dns_names(adapters.dns(spark, sf_dir))
    hit = text.domain_in(F.lower("query"), ("example.com", "example.org"))
    return names.groupBy("capture_id").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("lookups"))


@query("http_summary", f"""
WITH {adapters.HTTP_SQL}
SELECT capture_id, count(DISTINCT user_agent) AS http_unique_user_agent_count,
       CAST(sum(CASE WHEN method = 'POST' THEN 1 ELSE 0 END) AS BIGINT) AS http_plaintext_post_count,
       CAST(sum(CASE WHEN regexp_matches(uri, '[A-Za-z0-9+/]{{24,}}={{0,2}}') THEN 1 ELSE 0 END) AS BIGINT) AS http_base64_uri_count
FROM http GROUP BY 1""")
def http_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.http_signals(adapters.http(spark, sf_dir))


@query("post_destinations", f"""
WITH {adapters.HTTP_SQL}
SELECT DISTINCT capture_id, resp_h AS ip FROM http WHERE method = 'POST'""")
def post_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.post_destinations(adapters.http(spark, sf_dir))


@query("post_evidence", f"""
WITH {adapters.HTTP_SQL}
SELECT capture_id, uid, uri, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts, uid) AS position
  FROM http WHERE method = 'POST') WHERE position <= 20""")
def post_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.post_evidence(adapters.http(spark, sf_dir))
    return out.select("capture_id", "uid", "uri", "position")


@query("b64_runs", """
SELECT 'page' AS kind, page_id AS id FROM pages WHERE regexp_matches(html, '[A-Za-z0-9+/]{24,}={0,2}')
UNION ALL
SELECT 'document', doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9+/]{24,}={0,2}')""")
def b64_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = adapters.table(spark, sf_dir, "pages").where(text.has_b64_run(F.col("html")))
    documents = adapters.table(spark, sf_dir, "documents").where(text.has_b64_run(F.col("text")))
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id")).unionByName(
        documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    )


@query("size_texts", """
SELECT p_partkey, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024)
            ELSE printf('%.1f MB', n / 1048576) END AS shown,
       CAST(floor(p_size * CASE p_partkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END) AS BIGINT) AS parsed
FROM (SELECT *, CAST(p_partkey * p_size * 64 AS DOUBLE) AS n FROM part)""")
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte counts to text, and size text to byte counts."""
    part = adapters.table(spark, sf_dir, "part")
    written = F.concat(F.col("p_size"), F.expr("CASE p_partkey % 3 WHEN 0 THEN ' kB' WHEN 1 THEN ' MB' ELSE '' END"))
    return part.select(
        "p_partkey",
        text.format_bytes(F.expr("p_partkey * p_size * 64")).alias("shown"),
        text.parse_bytes(written).alias("parsed"),
    )
