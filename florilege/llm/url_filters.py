"""URL filters: a blocked Bloom filter of listed keys, then an exact hash join.

A rule is a host and the beginning of a path. It fits its host and every subdomain of it when the
URL's path starts with the rule's path. The listed key of a rule is ``host + path`` ("com/fr/").
Every URL yields its possible keys: each suffix of its host at a label boundary, with each prefix
of its path that is as long as some rule's path (or every prefix, if rules have many lengths). The keys are probed in a blocked Bloom filter
(one key touches one 512-bit block); only possible hits reach the exact join with the rules, which
removes the false positives. The longest rule that fits wins (host and path together); two rules of
one length with different verdicts: block wins.

Main path: DataFrame functions only.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and the
default verdict. URLs of any length are judged whole. Repeated rows are judged alike, each in its own row. An empty table gives an empty
result. Other columns of the input are ignored by :func:`judge_urls`, whatever their names, and
kept by :func:`filter_pages`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict) of the contract.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LANES = 8
BITS_PER_KEY = 16
#: The filter is at most this many 72-byte blocks (about 9 MB), however long the list.
MAX_BLOCKS = 1 << 17
#: Path lengths of rules that the plan lists; with more kinds, every prefix of a path is a possible key.
LISTED_LENGTHS = 64


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII goes through ``lower``, which is the same there and faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*+([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _mask(key: Column, lane: int) -> Column:
    """One bit of 64: six bits of a second hash pick it."""
    pick = F.shiftrightunsigned(F.xxhash64(key, F.lit(lane // 4)), 6 * (lane % 4) + 8).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), pick)


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as a table: one row for each block that is in use, with its eight 64-bit lanes."""
    key = F.col("key")
    return keys.groupBy(_block(key, n_blocks).alias("block")).agg(*[F.bit_or(_mask(key, i)).alias(f"lane{i}") for i in range(LANES)])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` for every row of ``pages``."""
    spark = pages.sparkSession
    n_rules = rules.count()
    kinds = rules.select(F.length("rule_path").alias("n")).distinct()
    lengths = [r[0] for r in kinds.limit(LISTED_LENGTHS + 1).collect()]
    listed = rules.select(F.concat("rule_host", "rule_path").alias("key"), F.struct("rule_host", "rule_path", "rule_verdict").alias("entry"))
    exact = listed.groupBy("key").agg(F.max(F.col("entry.rule_verdict")).alias("key_verdict"))
    urls = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if n_rules == 0:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    n_blocks = max(1, min(MAX_BLOCKS, n_rules * BITS_PER_KEY // (64 * LANES) + 1))
    blocks = bloom_blocks(exact, n_blocks)

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if len(lengths) <= LISTED_LENGTHS:
        prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]), lambda p: p.isNotNull())
    else:
        prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    probes = urls.where("host <> ''").select("page_id", "url", F.explode(keys).alias("key")).withColumn("block", _block(F.col("key"), n_blocks))
    passed = None
    for i in range(LANES):
        bit = F.col(f"lane{i}").bitwiseAND(_mask(F.col("key"), i)) != 0
        passed = bit if passed is None else passed & bit
    possible = probes.join(F.broadcast(blocks), "block").where(passed).select("page_id", "url", "key")  # at most MAX_BLOCKS rows
    hits = possible.join(exact, "key")
    best = hits.groupBy("page_id", "url").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key_verdict"), F.col("key"))).alias("best"))
    best = best.select(F.col("page_id").alias("_page"), F.col("url").alias("_url"), F.col("best.key").alias("rule"), F.col("best.key_verdict").alias("hit"))
    out = urls.join(best, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("url") == F.col("_url")), "left")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("hit", F.lit(default)).alias("verdict"))


def filter_pages(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The rows of ``pages``, all columns kept, whose verdict is ``allow``."""
    allowed = judge_urls(pages, rules, default).where("verdict = 'allow'").select(F.col("page_id").alias("_page"), F.col("url").alias("_url")).distinct()
    return pages.join(allowed, pages["page_id"].eqNullSafe(F.col("_page")) & pages["url"].eqNullSafe(F.col("_url")), "left_semi")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (SELECT row_number() OVER () AS k, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT k, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC) AS rn
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE rn = 1) USING (k)
"""
