"""Reports as running text. A report is an order, a line of it an order line put in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.functions import passages
from florilege.plans.catalog import Tables, query

#: One line of a report, in words that both engines read alike.
LINE = """(l_linenumber + CASE WHEN l_quantity > 45 THEN 4 ELSE 0 END) || '. In (' || year(l_shipdate) || ') ' || l_suppkey || ' REP ' || l_partkey ||
CASE WHEN l_returnflag = 'R' THEN CASE l_partkey % 3 WHEN 0 THEN ', overruled' WHEN 1 THEN ', partly overruled' ELSE ', held not good law' END
     WHEN l_returnflag = 'A' THEN CASE l_partkey % 3 WHEN 0 THEN ', doubted' WHEN 1 THEN ' and Part v. Order, followed' ELSE ', relied on' END
     ELSE CASE l_partkey % 3 WHEN 0 THEN ', not overruled' WHEN 1 THEN ', referred to' ELSE '' END END ||
CASE l_suppkey % 6 WHEN 0 THEN ' at paragraphs ' || (l_partkey % 40 + 1) || ' to ' || (l_partkey % 70 + 1) WHEN 1 THEN ' at paras 9, ' || (l_partkey % 1200) || ' and 3'
     WHEN 2 THEN ' at paragraph ' || (l_partkey % 1100) WHEN 3 THEN ' [Para 129]' ELSE '' END ||
CASE l_partkey % 5 WHEN 0 THEN ' under section 302A of the Penal Code, 1860' WHEN 1 THEN ' s.' || (l_suppkey % 9 + 1) || ' of the NI Act' WHEN 2 THEN ' section 7(1)(b) of the Sale of Goods Act, 1930'
     WHEN 3 THEN ' section 5, where the court held that the Sales Act applied' ELSE '' END"""
LINES = f"(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {LINE} AS line FROM lineitem)"
REPORTS = f"(SELECT l_orderkey, 'Report' || chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, line) AS text FROM {LINES} GROUP BY 1)"


def lines(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(LINE).alias("line"))


def reports(t: Tables) -> DataFrame:
    each = lines(t).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "line"))).alias("x"))
    return each.select("l_orderkey", F.concat(F.lit("Report\n"), F.array_join("x.line", "\n")).alias("text"))


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


CITED = quoted(passages.CITATION)
REACH = f"string_split_regex(%s, {quoted(passages.NEXT_CASE)})[1]"
PHRASES = " ".join(f"WHEN regexp_matches({REACH % 'substr(ahead, 1, 80)'}, {quoted(p)}) THEN '{name}'" for p, name in passages.TREATMENTS)


@query("ref_treatments", f"""
WITH m AS (SELECT l_orderkey, text, regexp_extract_all(text, {CITED}) AS ms, string_split_regex(text, {CITED}) AS g FROM {REPORTS}),
s AS (SELECT l_orderkey, i AS ordinal, ms[i] AS citation, substr(text, 1 + length(array_to_string(list_slice(g, 1, i), '')) + length(array_to_string(list_slice(ms, 1, i), '')), 220) AS ahead FROM (SELECT *, generate_subscripts(ms, 1) AS i FROM m))
SELECT l_orderkey, ordinal, citation, lower(regexp_extract({REACH % 'ahead'}, {quoted(passages.ANNOTATION)}, 1)) AS annotation, CASE {PHRASES} ELSE 'cites' END AS treatment FROM s""")
def treatments(t: Tables) -> DataFrame:
    return passages.treatments(reports(t), "l_orderkey", "text")


CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(upper(a), '^THE\s+', ''), '\s*,?\s*[0-9]{4}\s*$', ''), '\s+', ' ', 'g'))"
SPELLINGS = " ".join(f"WHEN c IN ({', '.join(quoted(x) for x in spellings)}) THEN '{name}'" for spellings, name in passages.ACTS)


@query("ref_section_references", f"""
WITH f AS (SELECT l_orderkey, unnest(regexp_extract_all(text, {quoted(passages.SECTION)}, 1)) AS s, unnest(regexp_extract_all(text, {quoted(passages.SECTION)}, 2)) AS a FROM {REPORTS}),
c AS (SELECT l_orderkey, upper(s) AS section, {CLEAN} AS c FROM f)
SELECT l_orderkey, CASE {SPELLINGS} ELSE c END AS act, section, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def section_references(t: Tables) -> DataFrame:
    return passages.section_references(reports(t), "l_orderkey", "text")


@query("ref_paragraph_numbers", f"""
WITH x AS (SELECT *, regexp_extract_all(line, {quoted(passages.RANGE)}, 1)::INT[] AS lo, regexp_extract_all(line, {quoted(passages.RANGE)}, 2)::INT[] AS hi,
  regexp_extract_all(array_to_string(regexp_extract_all(line, {quoted(passages.LIST)}, 1), ' '), '[0-9]+')::INT[] AS li, regexp_extract_all(line, {quoted(passages.SINGLE)}, 1)::INT[] AS si FROM {LINES}),
y AS (SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(line, {quoted(passages.NOT_PROSE)}) THEN NULL
  WHEN len(lo) > 0 THEN CASE WHEN lo[1] < hi[1] AND hi[1] - lo[1] <= 30 THEN range(lo[1], hi[1] + 1)::INT[] END WHEN len(li) > 0 THEN li ELSE si END AS n FROM x)
SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_sort(list_distinct(list_filter(n, lambda v: v > 0 AND v < 1000))), lambda v: v::VARCHAR), ',') AS paragraphs
FROM y WHERE len(list_filter(n, lambda v: v > 0 AND v < 1000)) > 0""")
def paragraph_numbers(t: Tables) -> DataFrame:
    # a filter on the numbers would read the line once more
    some = F.filter(F.array(passages.paragraph_numbers(F.col("line"))), lambda n: n.isNotNull())
    named = lines(t).select("l_orderkey", "l_linenumber", F.explode(some).alias("n"))
    return named.select("l_orderkey", "l_linenumber", F.array_join(F.col("n").cast("array<string>"), ",").alias("paragraphs"))


def walked(first: int, gap: int, least: int) -> str:
    """Paragraphs by recursive SQL: one step for each line."""
    return f"""
WITH RECURSIVE r AS {REPORTS},
p AS (SELECT l_orderkey, i, coalesce(sum(length(line) + 1) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  try_cast(nullif(regexp_extract(line, '^[ \t]*([0-9]{{1,4}}) *[.)]\\s+', 1), '') AS INT) AS n, size FROM (SELECT l_orderkey, length(text) AS size, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM r))),
w AS (SELECT l_orderkey, i, start, size, CASE WHEN n <= {first} THEN n END AS number, CASE WHEN n <= {first} THEN n ELSE 0 END AS last FROM p WHERE i = 1
  UNION ALL SELECT p.l_orderkey, p.i, p.start, p.size, CASE WHEN o THEN n END, CASE WHEN o THEN n ELSE last END FROM (SELECT p.*, last, CASE WHEN last = 0 THEN n <= {first} ELSE n > last AND n <= last + {gap} END AS o FROM w JOIN p ON p.l_orderkey = w.l_orderkey AND p.i = w.i + 1) p),
d AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY l_orderkey ORDER BY i), size) AS stop FROM w WHERE i = 1 OR number IS NOT NULL),
k AS (SELECT * FROM d WHERE i = 1 OR stop - start >= {least})
SELECT l_orderkey, row_number() OVER o AS ordinal, number, start::BIGINT AS start, (coalesce(lead(start) OVER o, size) - start)::BIGINT AS size FROM k WINDOW o AS (PARTITION BY l_orderkey ORDER BY i)"""


@query("doc_numbered_paragraphs", walked(20, 3, 40))
def numbered_paragraphs(t: Tables) -> DataFrame:
    return passages.paragraphs(reports(t), "l_orderkey", "text")


@query("doc_served_paragraphs", walked(3, 5, 0))
def served_paragraphs(t: Tables) -> DataFrame:
    """As shown to a reader: counting begins at three or less, and steps of five are taken."""
    return passages.paragraphs(reports(t), "l_orderkey", "text", first=3, gap=5, least=0)


@query("doc_canonical_marks")
def canonical_marks(t: Tables) -> DataFrame:
    """No oracle: SQL has no NFKC; a test holds it against cases."""
    return t.documents.select("doc_id", F.length(passages.canonical_marks(F.col("text"))).cast("long").alias("n"))


@query("doc_issue_statements", r"""
SELECT doc_id, generate_subscripts(a, 1) AS ordinal, unnest(a) AS statement FROM (SELECT doc_id, regexp_extract_all(text, '(?:The|Das|Le|El)[^.\n?]{20,400}[.?]') AS a FROM documents)""")
def issue_statements(t: Tables) -> DataFrame:
    """Sentences that open as an issue does; here the articles of the four languages stand for 'Whether'."""
    found = F.regexp_extract_all("text", F.lit(r"(?:The|Das|Le|El)[^.\n?]{20,400}[.?]"), F.lit(0))
    each = t.documents.select("doc_id", F.posexplode(found).alias("i", "statement"))
    return each.select("doc_id", (F.col("i") + 1).cast("long").alias("ordinal"), "statement")
