"""Document hygiene, identity, quality, references and conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import quality
from florilege.functions.text import collapse, jaccard
from florilege.operators import documents as d
from florilege.operators import rows
from florilege.plans.catalog import Tables, query

PIECES = r"regexp_extract_all(text, '[^\s]+')"


@query("doc_duplicate_groups", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS representative FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(t: Tables) -> DataFrame:
    return d.duplicate_groups(t.documents, "doc_id", "text")


@query("doc_duplicate_members", """
SELECT content_hash, doc_id, doc_id = rep AS is_representative FROM (SELECT sha256(text) AS content_hash, doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS rep, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n > 1""")
def duplicate_members(t: Tables) -> DataFrame:
    return d.duplicate_members(t.documents, "doc_id", "text")


@query("doc_first_wins", """
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def first_wins(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("doc_identity_ladder", """
SELECT p_partkey, CASE WHEN p_size = 1 THEN 'strong:' || p_brand WHEN p_size <= 10 THEN 'medium:' || p_type ELSE 'weak:' || p_name END AS identity FROM part""")
def identity_ladder(t: Tables) -> DataFrame:
    strong, medium = F.when(F.col("p_size") == 1, F.col("p_brand")), F.when(F.col("p_size") <= 10, F.col("p_type"))
    return t.part.select("p_partkey", d.identity(strong, medium, F.col("p_name")).alias("identity"))


@query("doc_pair_strength", """
SELECT a.c_custkey AS a, b.c_custkey AS b, CASE WHEN a.c_acctbal = b.c_acctbal THEN 'EXACT' WHEN abs(a.c_acctbal - b.c_acctbal) <= 1 THEN 'ADJACENT' WHEN abs(a.c_acctbal - b.c_acctbal) <= 10 THEN 'STRONG' ELSE 'WEAK' END AS strength
FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey AND floor(a.c_acctbal / 100) = floor(b.c_acctbal / 100) AND a.c_custkey < b.c_custkey""")
def pair_strength(t: Tables) -> DataFrame:
    block = ["c_mktsegment", "c_nationkey", "bin"]
    keyed = t.customer.select(*block[:2], F.floor(F.col("c_acctbal") / 100).alias("bin"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    pairs = keyed.toDF(*block, "a", "va").join(keyed.toDF(*block, "b", "vb"), block).where("a < b")
    gap = F.abs(F.col("va") - F.col("vb"))
    return pairs.select("a", "b", F.when(gap == 0, "EXACT").when(gap <= 1, "ADJACENT").when(gap <= 10, "STRONG").otherwise("WEAK").alias("strength"))


@query("doc_best_representative", """
SELECT DISTINCT ON (source, lang) source, lang, doc_id, n_chars FROM documents LEFT JOIN labels USING (doc_id) ORDER BY source, lang, (quality IS NOT NULL AND quality = 1) DESC, n_chars DESC, sha256(text), doc_id""")
def best_representative(t: Tables) -> DataFrame:
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    joined = t.documents.join(t.labels, "doc_id", "left").select("source", "lang", "doc_id", "n_chars", good.alias("good"), F.sha2("text", 256).alias("h"))
    order = [F.desc("good"), F.desc("n_chars"), F.col("h"), F.col("doc_id")]
    return rows.first_per_group(joined, ["source", "lang"], order).select("source", "lang", "doc_id", "n_chars")


@query("doc_collapse_space", r"SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g'))) AS n FROM documents")
def collapse_space(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(collapse(F.col("text"))).cast("long").alias("n"))


@query("doc_normalise_and_join_words", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z])-\n([a-z])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents""")
def normalise(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(quality.normal_space(quality.dehyphenate(F.col("text"))), 256).alias("h"))


@query("doc_ocr_quality", rf"""
SELECT doc_id, round(1 - coalesce(len(list_filter(list_filter({PIECES}, lambda w: regexp_matches(w, '[A-Za-z]')), lambda w: regexp_matches(w, '[A-Za-z][0-9|~^*#%$&]+[A-Za-z]') OR regexp_matches(w, '[|~^*#%$&]{{2,}}'))) / nullif(len(list_filter({PIECES}, lambda w: regexp_matches(w, '[A-Za-z]'))), 0), 0), 3) AS quality FROM documents""")
def ocr_quality(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", quality.ocr_quality(F.col("text")).alias("quality"))


@query("doc_corruption_verdict", rf"""
WITH s AS (SELECT doc_id, len(w) AS n, round(len(list_filter(w, lambda x: length(x) = 1)) / nullif(len(w), 0), 6) AS single, round(len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]{{3,}}[.,;:!?]?$'))) / nullif(len(w), 0), 6) AS wordlike, list_avg(list_transform(w, lambda x: length(x))) AS mean FROM (SELECT doc_id, {PIECES} AS w FROM documents))
SELECT doc_id, n, single, wordlike, CASE WHEN n < 40 THEN 'too_short' WHEN single > 0.3 THEN 'exploded' WHEN wordlike < 0.2 AND mean < 2.5 THEN 'garbled' ELSE 'sound' END AS verdict FROM s""")
def corruption(t: Tables) -> DataFrame:
    w = F.col("w")
    n, single, wordlike = quality.corruption(w)
    mean = F.try_divide(F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)), F.size(w))
    cut = t.documents.select("doc_id", quality.pieces(F.col("text")).alias("w"))
    s = cut.select("doc_id", n.cast("long").alias("n"), single.alias("single"), wordlike.alias("wordlike"), mean.alias("mean"))
    verdict = quality.corruption_verdict(F.col("n"), F.col("single"), F.col("wordlike"), F.col("mean"))
    return s.select("doc_id", "n", "single", "wordlike", verdict.alias("verdict"))


@query("doc_damage_verdict", r"""
SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) / length(text) > 0.001 THEN 'control' WHEN len(regexp_extract_all(text, chr(65533))) / length(text) > 0.001 THEN 'replacement' WHEN coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z]{25,}'), lambda x: length(x))), 0) / length(text) > 0.15 THEN 'runs' ELSE 'clean' END AS verdict FROM documents""")
def damage(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", quality.damage_verdict(F.col("text")).alias("verdict"))


@query("doc_quality_state", """
WITH r AS (SELECT doc_id, text, coalesce(round(len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to', 'in', 'is', 'that', 'for'))) * 1000 / nullif(len(w), 0), 4), 0) AS rate FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))
SELECT doc_id, rate, CASE WHEN quality = 0 THEN 'stored_bad' WHEN quality = 1 THEN 'stored_good' WHEN trim(text) = '' THEN 'empty' WHEN rate >= 12 THEN 'english' ELSE 'unknown' END AS state FROM r LEFT JOIN labels USING (doc_id)""")
def quality_state(t: Tables) -> DataFrame:
    rated = t.documents.select("doc_id", "text", quality.english_rate(F.col("text")).alias("rate")).join(t.labels, "doc_id", "left")
    q = F.col("quality")
    state = F.when(q == 0, "stored_bad").when(q == 1, "stored_good").when(F.trim("text") == "", "empty").when(F.col("rate") >= quality.ENGLISH_PER_1000, "english").otherwise("unknown")
    return rated.select("doc_id", "rate", state.alias("state"))


@query("doc_citability_matrix", """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'withheld' WHEN quality = 1 AND n_chars >= 1000 THEN 'citable' WHEN quality = 1 THEN 'short' WHEN quality = 0 THEN 'review' ELSE 'unknown' END AS citability FROM documents LEFT JOIN labels USING (doc_id)""")
def citability(t: Tables) -> DataFrame:
    q = F.col("quality")
    state = F.when(F.col("toxic") == 1, "withheld").when((q == 1) & (F.col("n_chars") >= 1000), "citable").when(q == 1, "short").when(q == 0, "review").otherwise("unknown")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", state.alias("citability"))


@query("doc_font_signature", r"""
SELECT doc_id, round(len(regexp_extract_all(text, '[\x01-\x7F]')) / nullif(length(text), 0), 6) AS ascii_share, round(len(regexp_extract_all(text, '[#%$&*]{3}')) * 1000.0 / nullif(length(text), 0), 6) AS markers, len(regexp_extract_all(text, '[\x{0900}-\x{097F}]')) = 0 AS no_devanagari FROM documents""")
def font_signature(t: Tables) -> DataFrame:
    x = F.col("text")
    per = lambda pattern, scale: F.round(F.try_divide(F.regexp_count(x, F.lit(pattern)) * scale, F.length(x)), 6)
    return t.documents.select("doc_id", per(r"[\x01-\x7F]", 1.0).alias("ascii_share"), per(r"[#%$&*]{3}", 1000.0).alias("markers"), (F.regexp_count(x, F.lit(r"[\x{0900}-\x{097F}]")) == 0).alias("no_devanagari"))


@query("doc_script_retention", rf"""
WITH p AS (SELECT doc_id, text AS old, regexp_replace(text, '[#%$&*]+', '', 'g') AS new FROM documents)
SELECT doc_id, len(regexp_extract_all(old, '[^\s]+')) >= 5 AND len(regexp_extract_all(new, '[^\s]+')) >= 0.8 * len(regexp_extract_all(old, '[^\s]+')) AND length(new) >= 0.8 * length(old) AS keeps FROM p""")
def script_retention(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", quality.keeps_script(x, F.regexp_replace(x, "[#%$&*]+", "")).alias("keeps"))


@query("doc_digit_trust", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?:^|[^0-9A-Za-z_])[0-9]+[OolI][0-9OolI]*(?:$|[^0-9A-Za-z_])') THEN 'substituted' WHEN regexp_matches(text, '[0-9]') THEN 'plain' ELSE 'none' END AS trust FROM documents""")
def digit_trust(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", quality.digit_trust(F.col("text")).alias("trust"))


@query("doc_date_quality", """
SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_shipdate AS DATE) = CAST(o_orderdate AS DATE) THEN 'VERIFIED' WHEN abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) = 1 THEN 'OFF_BY_ONE' WHEN l_shipdate < o_orderdate THEN 'SUSPECT' WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 100 THEN 'UNKNOWN' ELSE 'PLAUSIBLE' END AS state FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def date_quality(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    gap = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    state = F.when(gap == 0, "VERIFIED").when(F.abs(gap) == 1, "OFF_BY_ONE").when(F.col("l_shipdate") < F.col("o_orderdate"), "SUSPECT").when(gap > 100, "UNKNOWN").otherwise("PLAUSIBLE")
    return j.select("l_orderkey", "l_linenumber", state.alias("state"))


@query("doc_repeated_lines", r"""
SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY 1, 2 HAVING count(*) >= 2""")
def repeated_lines(t: Tables) -> DataFrame:
    return d.repeated_furniture(t.documents, "doc_id", "text")


@query("doc_without_furniture", r"""
WITH s AS (SELECT doc_id, generate_subscripts(a, 1) AS i, trim(unnest(a)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS rn FROM s WHERE line <> '')
SELECT doc_id, coalesce(k.text, '') AS text FROM documents LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM k WHERE rn < 2 GROUP BY 1) k USING (doc_id)""")
def without_furniture(t: Tables) -> DataFrame:
    return d.without_furniture(t.documents, "doc_id", "text")


@query("doc_chunks")
def chunks(t: Tables) -> DataFrame:
    """No oracle: chunk ends depend on the packing of the chunks before them; tests check that spans
    lie in the text, in order, within the size limit."""
    return d.chunks(t.documents, "doc_id", "text")


@query("doc_sentence_spans", r"""
SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: trim(s) <> '')) AS sentences, list_max(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: length(s))) AS longest FROM documents""")
def sentence_spans(t: Tables) -> DataFrame:
    s = F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return t.documents.select("doc_id", F.size(F.filter(s, lambda x: F.trim(x) != "")).cast("long").alias("sentences"), F.array_max(F.transform(s, F.length)).cast("long").alias("longest"))


@query("doc_reference_extraction", r"""
SELECT doc_id, min(lower(ref)) AS ref, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:version|section|part)\s+\d+')) AS ref FROM documents) GROUP BY doc_id, lower(ref)""")
def reference_extraction(t: Tables) -> DataFrame:
    refs = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)(?:version|section|part)\s+\d+"), F.lit(0))).alias("ref"))
    return refs.groupBy("doc_id", F.lower("ref").alias("ref")).agg(F.count(F.lit(1)).alias("n"))


@query("doc_contact_spans", r"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS emails, len(regexp_extract_all(text, '\+1 \(\d{3}\) \d{3}-\d{4}')) AS phones FROM documents""")
def contact_spans(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")).cast("long").alias("emails"), F.regexp_count("text", F.lit(r"\+1 \(\d{3}\) \d{3}-\d{4}")).cast("long").alias("phones"))


@query("doc_licence_lines", r"""
SELECT line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE regexp_matches(line, '(?i)licen[sc]e|all rights reserved|copyright') GROUP BY 1""")
def licence_lines(t: Tables) -> DataFrame:
    cut = d.lines(t.documents, "doc_id", "text").where(F.col("line").rlike("(?i)licen[sc]e|all rights reserved|copyright"))
    return cut.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("doc_name_jaccard", """
WITH s AS (SELECT p_brand, p_size, p_type, count(*) AS n, list_distinct(list_filter(regexp_extract_all(lower(p_type), '[a-z]+'), lambda w: length(w) >= 3)) AS g FROM part GROUP BY 1, 2, 3)
SELECT a.p_brand AS brand, a.p_size AS a_size, a.p_type AS a_type, b.p_size AS b_size, b.p_type AS b_type, a.n AS a_parts, b.n AS b_parts, round(len(list_intersect(a.g, b.g)) / nullif(len(list_distinct(list_concat(a.g, b.g))), 0), 6) AS similarity
FROM s a JOIN s b ON a.p_brand = b.p_brand AND (b.p_size = a.p_size + 1 OR (b.p_size = a.p_size AND a.p_type < b.p_type)) WHERE len(list_intersect(a.g, b.g)) / nullif(len(list_distinct(list_concat(a.g, b.g))), 0) >= 0.45""")
def name_jaccard(t: Tables) -> DataFrame:
    """Pairs of names of one brand and neighbouring sizes, with the parts that bear them: names, not
    parts, are paired, so that a common name makes one pair."""
    s = t.part.groupBy("p_brand", "p_size", "p_type").agg(F.count(F.lit(1)).alias("n")).withColumn("g", d.name_tokens(F.col("p_type")))
    a = s.select("p_brand", F.col("p_size").alias("a_size"), F.col("p_type").alias("a_type"), F.col("n").alias("a_parts"), F.col("g").alias("ga"), F.explode(F.array(F.col("p_size"), F.col("p_size") + 1)).alias("b_size"))
    b = s.select("p_brand", F.col("p_size").alias("b_size"), F.col("p_type").alias("b_type"), F.col("n").alias("b_parts"), F.col("g").alias("gb"))
    pairs = a.join(b, ["p_brand", "b_size"]).where((F.col("b_size") > F.col("a_size")) | (F.col("a_type") < F.col("b_type")))
    kept = pairs.withColumn("s", jaccard(F.col("ga"), F.col("gb"))).where("s >= 0.45")
    return kept.select(F.col("p_brand").alias("brand"), "a_size", "a_type", "b_size", "b_type", "a_parts", "b_parts", F.round("s", 6).alias("similarity"))


@query("doc_name_coverage", """
WITH s AS (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z]+'), lambda w: length(w) >= 3)) AS a, list_distinct(list_filter(regexp_extract_all(lower(p_type), '[a-z]+'), lambda w: length(w) >= 3)) AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b)) >= 1 AND len(list_intersect(a, b)) / least(len(a), len(b)) >= 0.3 AS agrees FROM s WHERE len(a) > 0 AND len(b) > 0""")
def name_coverage(t: Tables) -> DataFrame:
    s = t.part.select("p_partkey", d.name_tokens(F.col("p_name")).alias("a"), d.name_tokens(F.col("p_type")).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    shared = F.size(F.array_intersect("a", "b"))
    return s.select("p_partkey", ((shared >= 1) & (shared / F.least(F.size("a"), F.size("b")) >= 0.3)).alias("agrees"))


@query("doc_marker_lift", """
WITH w AS (SELECT DISTINCT doc_id, toxic, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents JOIN labels USING (doc_id)), t AS (SELECT count(*) FILTER (WHERE toxic = 1) AS p, count(*) FILTER (WHERE toxic <> 1) AS n FROM documents JOIN labels USING (doc_id))
SELECT word, pos, neg, round(((pos + 1) / (p + 2)) / ((neg + 1) / (n + 2)), 6) AS lift FROM (SELECT word, count(*) FILTER (WHERE toxic = 1) AS pos, count(*) FILTER (WHERE toxic <> 1) AS neg FROM w GROUP BY 1 HAVING count(*) >= 10), t""")
def marker_lift(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id")
    return d.marker_lift(joined, F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), F.col("toxic") == 1, 10)


@query("doc_routing_table", """
SELECT source, lang, CASE WHEN lang = 'en' AND source IN ('src1', 'src2') THEN 'court' WHEN lang IN ('fr', 'de') THEN 'translate' WHEN source = 'src9' THEN 'hold' ELSE 'general' END AS route, count(*) AS n FROM documents GROUP BY 1, 2""")
def routing_table(t: Tables) -> DataFrame:
    lang, source = F.col("lang"), F.col("source")
    route = F.when((lang == "en") & source.isin("src1", "src2"), "court").when(lang.isin("fr", "de"), "translate").when(source == "src9", "hold").otherwise("general")
    return t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).withColumn("route", route)


@query("doc_classifier", r"""
SELECT doc_id, CASE WHEN n_chars < 200 THEN 'note' WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licensed' WHEN len(regexp_extract_all(text, '\|')) >= 10 THEN 'table' WHEN len(regexp_extract_all(text, '!!')) >= 5 THEN 'shouting' ELSE 'prose' END AS class FROM documents""")
def classifier(t: Tables) -> DataFrame:
    x = F.col("text")
    kind = F.when(F.col("n_chars") < 200, "note").when(x.rlike("(?i)licen[sc]e"), "licensed").when(F.regexp_count(x, F.lit(r"\|")) >= 10, "table").when(F.regexp_count(x, F.lit("!!")) >= 5, "shouting").otherwise("prose")
    return t.documents.select("doc_id", kind.alias("class"))


@query("doc_operative_region", r"""
SELECT doc_id, right(text, 300) AS region, regexp_matches(lower(right(text, 300)), '(licen[sc]e|rights|version)') AS procedural FROM documents""")
def operative_region(t: Tables) -> DataFrame:
    region = F.right("text", F.lit(300))
    return t.documents.select("doc_id", region.alias("region"), F.lower(region).rlike("(licen[sc]e|rights|version)").alias("procedural"))


@query("doc_span_location", """
SELECT item_id, doc_id, strpos(d.text, b.text) - 1 AS start FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def span_location(t: Tables) -> DataFrame:
    return d.locate(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


@query("doc_vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS norm FROM embeddings")
def vector_norms(t: Tables) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return t.embeddings.select("vec_id", F.round(F.sqrt(square), 6).alias("norm"))


@query("doc_mean_pool", """
SELECT label, i, round(avg(x), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2""")
def mean_pool(t: Tables) -> DataFrame:
    each = t.embeddings.select("label", F.posexplode("embedding").alias("p", "x"))
    return each.groupBy("label", (F.col("p") + 1).cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("doc_hard_negative_digits", r"""
SELECT o_orderkey, CASE WHEN right(o_orderkey::VARCHAR, 1) = '9' THEN left(o_orderkey::VARCHAR, length(o_orderkey::VARCHAR) - 1) || '0' ELSE left(o_orderkey::VARCHAR, length(o_orderkey::VARCHAR) - 1) || (right(o_orderkey::VARCHAR, 1)::INT + 1)::VARCHAR END AS perturbed FROM orders""")
def hard_negative_digits(t: Tables) -> DataFrame:
    s = F.col("o_orderkey").cast("string")
    last = (F.right(s, F.lit(1)).cast("int") + 1) % 10
    return t.orders.select("o_orderkey", F.concat(F.left(s, F.length(s) - 1), last.cast("string")).alias("perturbed"))


@query("doc_training_pairs", """
SELECT conv_id, turn, text AS prompt, reply FROM (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def training_pairs(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    led = t.conversations.withColumns({"reply": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return led.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "reply")


@query("doc_export_split", """
SELECT doc_id, CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 10 = 0 THEN 'eval' ELSE 'train' END AS split FROM documents""")
def export_split(t: Tables) -> DataFrame:
    bucket = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 10
    return t.documents.select("doc_id", F.when(bucket == 0, "eval").otherwise("train").alias("split"))


@query("doc_tier_manifest", """
SELECT source, count(*) AS docs, count(DISTINCT sha256(text)) AS texts, round(1 - count(DISTINCT sha256(text)) / count(*), 6) AS collapse, sum(n_chars)::BIGINT AS chars, bit_xor(hash_part) AS fingerprint FROM (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT AS hash_part FROM documents) GROUP BY 1""")
def tier_manifest(t: Tables) -> DataFrame:
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), 16, 10).cast("long")
    h = F.count_distinct(F.sha2("text", 256))
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), h.alias("texts"), F.round(1 - h / F.count(F.lit(1)), 6).alias("collapse"), F.sum("n_chars").alias("chars"), F.bit_xor(part).alias("fingerprint"))


@query("doc_page_links", r"""
SELECT page_id, len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def page_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


@query("doc_page_status", r"""
SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN NOT regexp_matches(html, '<body') THEN 'unreadable' WHEN NOT regexp_matches(html, '</html>') THEN 'cut_off' WHEN len(regexp_extract_all(html, '<p>')) < 3 THEN 'thin' ELSE 'read' END AS status FROM pages""")
def page_status(t: Tables) -> DataFrame:
    x = F.col("html")
    status = F.when(x.isNull() | (x == ""), "empty").when(~x.rlike("<body"), "unreadable").when(~x.rlike("</html>"), "cut_off").when(F.regexp_count(x, F.lit("<p>")) < 3, "thin").otherwise("read")
    return t.pages.select("page_id", status.alias("status"))
