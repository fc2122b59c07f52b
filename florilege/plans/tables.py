"""Lists printed as HTML tables, read back to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.operators import html_tables
from florilege.plans.catalog import Tables, query

FIELDS = {"mode": ["Shipped by"], "case": ["Case No.", "Case Number"], "day": ["Next date", "Date"], "amount": ["Amount (Rs.)"]}
#: Each order is a page with one table: a caption row, a header, a row for each line, the header again. The first
#: cell spans the lines; a quantity that eleven divides has no case number, a tax of nothing no amount.
LINES = """
SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line,
  CASE WHEN l_quantity::INT % 11 <> 0 THEN 'C ' || l_partkey || '/' || year(l_shipdate) END AS no, l_shipdate::DATE AS day, CASE WHEN round(l_tax, 2) <> 0 THEN round(l_extendedprice, 2) END AS amount,
  first('mode ' || l_linestatus) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS mode FROM lineitem"""


def rows(t: Tables) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    whole = Window.partitionBy("l_orderkey")
    numbered = t.lineitem.withColumns({"line": F.row_number().over(order), "n": F.count(F.lit(1)).over(whole)})
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    case = F.when(F.col("l_quantity").cast("int") % 11 != 0, F.concat(F.lit("C&nbsp;"), F.col("l_partkey").cast("string"), F.lit("/"), F.year("l_shipdate").cast("string"))).otherwise("")
    amount = F.when(F.round("l_tax", 2) != 0, F.format_number(F.round("l_extendedprice", 2).cast("double"), 2)).otherwise("")
    mode = F.when(F.col("line") == 1, F.concat(F.lit('<td rowspan="'), F.col("n").cast("string"), F.lit('">mode '), F.col("l_linestatus"), F.lit("</td>"))).otherwise("")
    row = F.concat(F.lit("<tr>"), mode, cell(case), cell(F.date_format("l_shipdate", "dd-MM-yyyy")), cell(F.concat(F.lit("<b>"), amount, F.lit("</b>"))), F.lit("</tr>"))
    head = '<tr><th>Shipped by<th>CASE  NUMBER<th>Next date<th>Amount (Rs.)</tr>'
    # an order has a few lines
    joined = numbered.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", row.alias("r")))), lambda s: s["r"]), "").alias("rows"))
    pages = joined.select("l_orderkey", F.concat(F.lit(f'<p>x</p><table><tr><td colspan="4">List of the day</td></tr>{head}'), "rows", F.lit(f"{head}</table>")).alias("html"))
    return html_tables.table_rows(pages, "html", FIELDS, "case", ["day", "amount"])


@query("doc_table_rows", f"""
SELECT l_orderkey, line + 1 AS row_no, mode, no AS case_no, day, amount::DOUBLE AS amount, CASE WHEN amount IS NULL THEN 'partial' ELSE 'read' END AS state FROM ({LINES}) WHERE no IS NOT NULL""")
def table_rows(t: Tables) -> DataFrame:
    """Typed rows of the tables; the SQL has them from the columns."""
    text = lambda k: F.col("cells")[k]
    amount = F.regexp_replace(text("amount"), ",", "").try_cast("double")
    return rows(t).where("state <> 'refused'").select("l_orderkey", F.col("row_no").cast("long").alias("row_no"), text("mode").alias("mode"), text("case").alias("case_no"), F.to_date(text("day"), "dd-MM-yyyy").alias("day"), amount.alias("amount"), "state")


@query("doc_table_refusals", f"""
WITH x AS ({LINES}) SELECT refusal, sum(n)::BIGINT AS n FROM (SELECT unnest(['above_header', 'header', 'repeated_header']) AS refusal, count(DISTINCT l_orderkey) AS n FROM x
UNION ALL SELECT 'no_key', count(*) FILTER (WHERE no IS NULL) FROM x UNION ALL SELECT 'lacks amount', count(*) FILTER (WHERE no IS NOT NULL AND amount IS NULL) FROM x UNION ALL SELECT 'none', count(*) FILTER (WHERE no IS NOT NULL AND amount IS NOT NULL) FROM x) WHERE n > 0 GROUP BY 1""")
def table_refusals(t: Tables) -> DataFrame:
    """Why rows were not read; with those that were, all rows of all tables."""
    return rows(t).groupBy(F.coalesce("refusal", F.lit("none")).alias("refusal")).agg(F.count(F.lit(1)).alias("n"))
