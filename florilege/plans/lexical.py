"""Ranked lexical search and name search, each over a table of queries drawn from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import tokens
from florilege.operators import lexical
from florilege.plans.catalog import Tables, query

WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _index(table: str, keys: str, text: str) -> str:
    return f"(SELECT {keys}, pos, {lexical.stem_sql('w')} AS term FROM (SELECT {keys}, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS w FROM (SELECT {keys}, {WORDS.format(text)} AS a FROM {table})))"


def _ranked(asked: str, query_id: str, index: str, keys: str, top: int) -> str:
    """The three rarest stems of each query, texts that hold all of them, by cover density."""
    last = ", ".join(f"max(CASE WHEN no = {k} THEN pos END) OVER w AS l{k}" for k in (1, 2, 3))
    return f"""
WITH idx AS {index}, asked AS (SELECT DISTINCT {query_id}, term FROM {asked}),
freq AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT term, {keys} FROM idx) GROUP BY 1),
rare AS (SELECT {query_id}, term, no, count(*) OVER (PARTITION BY {query_id}) AS terms FROM (SELECT {query_id}, term, row_number() OVER (PARTITION BY {query_id} ORDER BY df, term) AS no FROM asked JOIN freq USING (term)) WHERE no <= 3),
hits AS (SELECT {query_id}, {keys}, pos, no, terms FROM idx JOIN rare USING (term)),
last AS (SELECT *, {last} FROM hits WINDOW w AS (PARTITION BY {query_id}, {keys} ORDER BY pos)),
ends AS (SELECT {query_id}, {keys}, pos, least(l1, CASE WHEN terms > 1 THEN l2 ELSE l1 END, CASE WHEN terms > 2 THEN l3 ELSE l1 END) AS begin FROM last WHERE l1 IS NOT NULL AND (terms < 2 OR l2 IS NOT NULL) AND (terms < 3 OR l3 IS NOT NULL)),
windows AS (SELECT {query_id}, {keys}, begin, min(pos) AS pos FROM ends GROUP BY ALL),
scored AS (SELECT {query_id}, {keys}, round(sum(1 / (pos - begin + 1)), 6) AS rank FROM windows GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {query_id} ORDER BY rank DESC, {keys}) AS rn FROM scored) WHERE rn <= {top}"""


@query("retrieve_cover_rank", _ranked(_index("benchmark", "item_id", "text"), "item_id", _index("documents", "doc_id", "text"), "doc_id", 10))
def cover_rank(t: Tables) -> DataFrame:
    """Every benchmark item as a query: its three rarest stems, the ten documents that hold all of them most
    densely."""
    index = lexical.positions(t.documents, ["doc_id"], "text")
    asked = lexical.positions(t.benchmark, ["item_id"], "text").select("item_id", "term")
    return lexical.cover_search(index, ["doc_id"], lexical.rarest(asked, "item_id", index, ["doc_id"], 3), "item_id", 10)


TITLE = "regexp_extract(html, '<title>([^<]*)', 1)"
TITLES = f"(SELECT min(page_id) AS title_id, {TITLE} AS title FROM pages GROUP BY {TITLE})"


def titles(t: Tables) -> DataFrame:
    """One row for each title that pages have."""
    return t.pages.groupBy(F.regexp_extract("html", "<title>([^<]*)", 1).alias("title")).agg(F.min("page_id").alias("title_id"))


SECTIONS = "(SELECT page_id, generate_subscripts(a, 1) AS ordinal, unnest(a) AS s FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)', 1) AS a FROM pages))"


@query("retrieve_section_rank", _ranked(_index(TITLES, "title_id", "title"), "title_id", _index(SECTIONS, "page_id, ordinal", "s"), "page_id, ordinal", 3))
def section_rank(t: Tables) -> DataFrame:
    """Every title as a query: the three sections of any page that hold its three rarest stems most densely."""
    sections = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1))).alias("i", "s")).select("page_id", (F.col("i") + 1).cast("long").alias("ordinal"), "s")
    asked = lexical.positions(titles(t), ["title_id"], "title").select("title_id", "term")
    return lexical.cover_rarest(sections, ["page_id", "ordinal"], "s", asked, "title_id", 3, 3)


GRAMS = "list_distinct(flatten(list_transform({}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
ASKED = "list_transform(list_slice(words, 2, 4), lambda w: CASE WHEN length(w) > 5 THEN left(w, length(w) - 1) ELSE w END)"


@query("search_word_similarity", f"""
WITH titles AS (SELECT title_id, {WORDS.format("title")} AS words FROM {TITLES}),
asked AS (SELECT title_id AS query_id, {ASKED} AS words FROM titles WHERE len(words) >= 4),
named AS (SELECT query_id, n, unnest(g) AS gram FROM (SELECT query_id, g, len(g) AS n FROM (SELECT query_id, {GRAMS.format("words")} AS g FROM asked))),
held AS (SELECT title_id, unnest({GRAMS.format("words")}) AS gram FROM titles),
-- no extent has more of the trigrams asked for than its title
enough AS (SELECT query_id, title_id FROM named JOIN held USING (gram) GROUP BY query_id, title_id, n HAVING count(*) >= 0.65 * n),
pairs AS (SELECT query_id, title_id, a.words AS q, t.words AS words FROM enough JOIN asked a USING (query_id) JOIN titles t USING (title_id)),
extents AS (SELECT query_id, title_id, {GRAMS.format("q")} AS g, {GRAMS.format("list_slice(words, i, j)")} AS h FROM (SELECT *, unnest(range(i, len(words) + 1)) AS j FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM pairs))),
best AS (SELECT query_id, title_id, max(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h)))) AS similarity FROM extents GROUP BY 1, 2)
SELECT query_id, title_id, round(similarity, 6) AS similarity FROM best WHERE similarity >= 0.65""")
def word_similarity(t: Tables) -> DataFrame:
    """The second to fourth word of every title, with a letter lost from long words, looked up in all titles: every
    pair that reaches the threshold."""
    worded = titles(t).select("title_id", tokens(F.col("title")).alias("words"))
    spelled = F.transform(F.slice("words", 2, 3), lambda w: F.when(F.length(w) > 5, F.left(w, F.length(w) - 1)).otherwise(w))
    asked = worded.where(F.size("words") >= 4).select(F.col("title_id").alias("query_id"), spelled.alias("words"))
    return lexical.alike_titles(asked, worded)
