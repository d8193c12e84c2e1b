"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes.

A URL is expanded into the expressions that a rule could have (its host's suffixes by whole labels, its
path's prefixes), each hashed with SHA-256. The first four bytes are the equi-join key against the rules;
the whole digest confirms, and the longest confirmed rule decides. Only DataFrame functions are used.

Expansion is bounded by the rules, not by the URLs: only suffixes with as many labels, and prefixes with
as many characters, as some rule has. Verdicts are made once per distinct (host, path), so a URL that a
third of the rows share is expanded once; the join back to the pages is one that adaptive execution splits.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule, and the default
verdict; a page that no rule fits has a null rule and the default verdict; of rules as long as each other the one with the
longer host wins. Rows are kept as they are, repeated or not; a very long URL has no more expressions than the rules have lengths; other columns of
the pages are ignored, whatever their names; an empty table of pages gives an empty result, one of rules the default verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (host, path prefix, verdict); fixed values.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Bytes of a digest that make the join key.
PREFIX_BYTES = 4


def split_url(url: str) -> tuple[F.Column, F.Column]:
    """(host, path): the host after the first ``://`` with A-Z lower-cased, the path up to ``?`` or ``#``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise("")
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType(), False) for n in ("r_host", "r_path", "r_verdict")])
    return spark.createDataFrame(rules, schema)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict. rules: r_host, r_path, r_verdict (a later copy of the same rule loses to 'allow')."""
    host, path = split_url("_url")
    seen = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    rules = rules.groupBy("r_host", "r_path").agg(F.min("r_verdict").alias("r_verdict"))
    shape = rules.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("l"), F.collect_set(F.length("r_path")).alias("p")).first()
    labels, lengths = sorted(shape["l"] or []), sorted(shape["p"] or [])
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    key = lambda d: F.conv(F.substring(d, 1, 2 * PREFIX_BYTES), 16, 10).cast("long")
    coded = rules.withColumn("digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("key", key(F.col("digest")))

    distinct = seen.select("host", "path").distinct().where("host <> ''")
    parts = F.size(F.split("host", r"\."))
    hosts = F.array(*[F.when(parts >= n, F.substring_index("host", ".", -n)) for n in labels]) if labels else F.array().cast("array<string>")
    paths = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    expanded = (
        distinct.withColumn("h", F.explode(F.array_compact(hosts)))
        .withColumn("p", F.explode(F.array_compact(paths)))
        .withColumn("d", digest(F.col("h"), F.col("p")))
        .withColumn("key", key(F.col("d")))
    )
    found = expanded.join(coded, "key").where(F.col("d") == F.col("digest"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("m"))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), rank).alias("b"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "b.rule", F.col("b.r_verdict").alias("v"))
    return seen.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").select(
        F.col("_id").alias(page_id), "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict")
    )


ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1, 's') ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(rest, '') AS rest, coalesce(regexp_extract(rest, '^([^/]*)', 1, 's'), '') AS h0 FROM a),
c AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(h0) + 1) AS path FROM b),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
d AS (SELECT page_id, host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC NULLS LAST, length(rh) DESC) AS k
      FROM c LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM d WHERE k = 1
"""
