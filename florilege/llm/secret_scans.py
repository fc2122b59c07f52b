"""Secret scans: an incremental ledger of content-addressed blobs.

Every version of every document is a blob, named by the SHA-256 of its text. The ledger is a table
of runs; a row says that a blob was scanned under some rule versions and what was found. A run
scans a blob only for the rule versions that the ledger has not seen for it, writes its rows to the
shared folder, and joins the findings back to every document (path) that carries the blob. A
changed rule gets a new version and so is scanned anew; old findings stay in the ledger.

A span is the code points ``start`` (inclusive) to ``end`` (exclusive) of a leftmost,
non-overlapping match. Positions come from the pieces between the matches: a text is cut at the
matches, and the lengths of pieces and matches before a match add up to its start.

Main path: DataFrame functions only.

Defined results: a null text is the empty blob, with no spans. Rows with one text share a blob and
each get its findings, repeated rows included. Texts of any length are scanned whole, in time that
grows with their length. An empty table gives an empty result. Columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.llm.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """``measured``: the group whose length must reach ``least``; matches below it are dropped."""

    kind: str
    version: int
    pattern: str
    measured: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values of the contract, in the order in which kinds are listed. Letters of the names are
#: spelled in both cases, as a case-insensitive flag differs between regex engines.
RULES = (
    Rule(
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)

SPAN = "struct<start:int,rank:int,rule:string,kind:string,end:int>"
LEDGER = f"blob_id binary, fresh array<string>, spans array<{SPAN}>"


def _steps(text: Column, rule: Rule) -> Column:
    """Of one rule: for each match the code points since the last one (``gap``), its own (``m``) and
    those of the measured group (``g``). Null if no match passes."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = found if rule.measured == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.measured))
    lengths = F.zip_with(found, measured, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g")))
    steps = F.zip_with(F.split(text, rule.pattern, -1), lengths, lambda piece, m: F.struct(F.length(piece).alias("gap"), m["m"].alias("m"), m["g"].alias("g")))
    return F.when(F.exists(measured, lambda g: F.length(g) >= rule.least), steps)


def _found(pending: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob_id, fresh, spans`` from ``blob_id, text, fresh, old``: old spans and those of fresh rules.

    Starts are running sums over the matches of a blob and rule, so a text with any number of matches
    takes time in proportion. Blobs are dealt by their id already; nothing is shuffled again.
    """
    of = [F.when(F.array_contains("fresh", r.key), _steps(F.col("text"), r)) for r in rules]
    scanned = F.filter(F.array(*[F.when(x.isNotNull(), F.struct(F.lit(i).alias("rank"), x.alias("steps"))) for i, x in enumerate(of)]), lambda x: x.isNotNull())
    each = pending.select("blob_id", "fresh", "old", F.explode_outer(scanned).alias("x"))
    each = each.select("blob_id", "fresh", "old", F.col("x.rank").alias("rank"), F.posexplode_outer("x.steps").alias("pos", "s"))
    stop = F.sum(F.col("s.gap") + F.coalesce("s.m", F.lit(0))).over(Window.partitionBy("blob_id", "rank").orderBy("pos")).cast("int")
    named = lambda value: F.element_at(F.array(*[F.lit(value(r)) for r in rules]), F.col("rank") + 1)
    span = F.struct((F.col("stop") - F.col("s.m")).alias("start"), "rank", named(lambda r: r.key).alias("rule"), named(lambda r: r.kind).alias("kind"), F.col("stop").alias("end"))
    kept = each.withColumn("stop", stop).select("blob_id", "fresh", "old", F.when(F.col("s.g") >= named(lambda r: r.least), span).alias("span"))
    per_blob = kept.groupBy("blob_id").agg(F.first("fresh").alias("fresh"), F.first("old").alias("old"), F.collect_list("span").alias("new"))
    return per_blob.select("blob_id", "fresh", F.array_sort(F.array_distinct(F.concat("old", "new"))).cast(f"array<{SPAN}>").alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, run): ``doc_id, spans`` for each document, and this run's rows of the ledger.

    ``docs``: ``doc_id, text``; a document may come in any number of versions, each a row that gets
    its own findings. ``ledger``: the rows of earlier runs (any union of them), or None. Append
    ``run`` to it; its ``fresh`` says which rule versions this run has scanned a blob for.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob_id", F.unhex(F.sha2("text", 256)))
    blobs = keyed.groupBy("blob_id").agg(F.first("text").alias("text"))  # equal ids: equal texts
    keys = F.array(*[F.lit(r.key) for r in rules])
    none = F.array().cast(f"array<{SPAN}>")
    if ledger is None:
        known = blobs.withColumns({"seen": F.array().cast("array<string>"), "old": none})
    else:
        past = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("fresh"))).alias("seen"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("old"))
        known = blobs.join(past, "blob_id", "left").withColumns({"seen": F.coalesce("seen", F.array().cast("array<string>")), "old": F.coalesce("old", none)})
    pending = known.withColumn("fresh", F.array_except(keys, F.col("seen")))
    held = F.filter("old", lambda s: F.array_contains(keys, s["rule"]))
    run = Scratch(spark, "secret-ledger").write(_found(pending.withColumn("old", held), rules), "run")
    hits = run.where(F.size("spans") > 0).select("blob_id", "spans")
    findings = keyed.select("doc_id", "blob_id").join(hits, "blob_id", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    return findings, run


def scan_with_ledger(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` for each row of ``docs``; what earlier runs over ``folder`` have scanned is taken
    from their ledger there, and this run's rows are appended to it."""
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    kept = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    findings, run = scan(docs, rules, spark.read.schema(LEDGER).parquet(folder) if kept else None)
    run.where(F.size("fresh") > 0).write.mode("append").parquet(folder)
    return findings


def op1_secret_scans(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """``ledger``: a shared folder that keeps what is scanned from one call to the next; without one, this
    run's ledger begins empty and is a table of the run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    findings = scan_with_ledger(docs, ledger) if ledger else scan(docs)[0]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = findings.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), line.alias("spans"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


OP1_SQL = r"""
WITH rules(rank, kind, pat, grp, least) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 18),
  (2, 'hex', '[0-9a-f]+', 0, 16)),
docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT k, 0 AS rank, string_split_regex(text, (SELECT pat FROM rules WHERE rank = 0)) AS gaps, regexp_extract_all(text, (SELECT pat FROM rules WHERE rank = 0), 0) AS ms, regexp_extract_all(text, (SELECT pat FROM rules WHERE rank = 0), 2) AS gs FROM docs
  UNION ALL SELECT k, 1, string_split_regex(text, (SELECT pat FROM rules WHERE rank = 1)), regexp_extract_all(text, (SELECT pat FROM rules WHERE rank = 1), 0), regexp_extract_all(text, (SELECT pat FROM rules WHERE rank = 1), 0) FROM docs
  UNION ALL SELECT k, 2, string_split_regex(text, (SELECT pat FROM rules WHERE rank = 2)), regexp_extract_all(text, (SELECT pat FROM rules WHERE rank = 2), 0), regexp_extract_all(text, (SELECT pat FROM rules WHERE rank = 2), 0) FROM docs),
each AS (SELECT k, rank, unnest(range(1, len(ms) + 1)) AS i, gaps, ms, gs FROM cut WHERE len(ms) > 0),
one AS (SELECT k, rank, i, length(gaps[i]) AS gap, length(ms[i]) AS m, length(gs[i]) AS g FROM each),
placed AS (SELECT k, rank, m, g, sum(gap + m) OVER (PARTITION BY k, rank ORDER BY i) AS stop FROM one),
kept AS (SELECT k, p.rank, kind, stop - m AS start, stop FROM placed p JOIN rules r ON p.rank = r.rank WHERE g >= least),
line AS (SELECT k, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans FROM kept GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN line USING (k)
"""
