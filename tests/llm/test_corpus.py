"""Mixing, sharding, language ID, HTML extraction, nearest neighbours and the pipeline."""

from __future__ import annotations

import hashlib
import html.parser
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from florilege.llm import html_extraction as he
from florilege.llm import language_id as li
from florilege.llm import mixing, nearest, sharding
from florilege.llm.scratch import Scratch, ranked
from tests.llm.cases import awkward, empty
from tests.llm.test_groups import SPACE, brute_components, brute_hits


# ---- ranks in buckets

def test_ranked_is_the_plain_rank(spark):
    rng = random.Random(1)
    data = [(rng.choice([None, "a", "b"]), rng.randint(0, 3), i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, b int, id int")
    got = {r["id"]: r["r"] for r in ranked(df, Scratch(spark, "t"), ["g"], F.col("b"), [F.col("id")], "r").collect()}
    by = defaultdict(list)
    for g, b, i in data:
        by[g].append((b, i))
    assert got == {i: k for rows in by.values() for k, (_, i) in enumerate(sorted(rows))}


# ---- mixing

def brute_targets(sizes):
    order = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: i % 3 + 1 for i, k in enumerate(order)}
    target, free, left = {}, list(order), sum(sizes.values())
    while free:
        level = left / sum(weight[k] for k in free)
        over = [k for k in free if level * weight[k] > 3 * sizes[k]]
        if not over:
            return target | {k: level * weight[k] for k in free}
        for k in over:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
            free.remove(k)
    return target


def test_mix_targets_and_bounds(spark, sf):
    rows = mixing.op9_mixing(spark, sf).collect()
    sizes, taken = Counter(), Counter()
    docs = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    for r in rows:
        sizes[docs[r["doc_id"]]] += r["size"]
        taken[docs[r["doc_id"]]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    want = brute_targets(sizes)
    for r in rows:
        assert abs(r["target"] - want[docs[r["doc_id"]]]) < 1e-6 * max(1, r["target"])
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.1 * sum(sizes.values())


def test_mix_keeps_columns_and_reruns_agree(spark):
    docs = awkward(spark)
    one, two = mixing.mix(docs), mixing.mix(docs)
    assert one.columns == docs.columns
    text = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert text(one) == text(two)
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_comes_near_its_targets_on_many_documents(spark):
    rng = random.Random(8)
    data = [(i, " ".join(["w"] * int(rng.paretovariate(1.2) * 10)), f"s{min(4, int(rng.expovariate(1)))}") for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mixing.mix(docs).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n"))
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    largest = max(len(t.split()) for _, t, _ in data)
    for r in out.collect():
        assert abs(r["n"] - want[r["source"]]) <= 0.05 * want[r["source"]] + largest


def brute_mix(docs):
    """``(doc_id, size, copies)``: draws and their repair, one source after the other."""
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    sizes, by, seen = Counter(), {}, Counter()
    for i, text, source in docs:
        key = digest("\n".join(["" if i is None else str(i), digest(source or ""), digest(text or "")]))
        by.setdefault(source, []).append((digest(f"{key}:{seen[key]}"), i, words(text)))
        seen[key] += 1
        sizes[source] += words(text)
    out, want = [], brute_targets(sizes)
    for source, own in by.items():
        rate = want[source] / sizes[source] if sizes[source] else 0.0
        whole, lacks = int(rate), want[source] - int(rate) * sizes[source]
        near = [abs(int(h[:13], 16) / 2**52 - (rate - whole)) <= 8 / len(own) ** 0.5 for h, _, _ in own]
        copied = [int(h[:13], 16) / 2**52 < rate - whole for h, _, _ in own]
        have = sum(n for (_, _, n), c, k in zip(own, copied, near) if c and not k)
        for k in sorted((k for k in range(len(own)) if near[k]), key=lambda k: own[k][0]):
            copied[k] = have + own[k][2] / 2 <= lacks
            have += own[k][2]
        out += [(i, n, whole + (c and lacks > 0)) for (_, i, n), c in zip(own, copied)]
    return sorted(out, key=repr), want


def mixed(spark, tmp_path, data):
    spark.createDataFrame(data, "doc_id long, text string, source string, copies int, _no string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    rows = mixing.op9_mixing(spark, str(tmp_path)).collect()
    return sorted(((r["doc_id"], r["size"], r["taken"]) for r in rows), key=repr)


def test_draws_and_repairs_against_brute_force(spark, tmp_path):
    rng = random.Random(14)
    data = [(rng.choice([None, i, i, 7]), rng.choice([None, "", "a b c", "w " * rng.randrange(1, 300)]), rng.choice(["s0", "s1", "s2", "s2", "s2", None, "ü"]), 1, "x") for i in range(1500)]
    want, _ = brute_mix([d[:3] for d in data])
    assert mixed(spark, tmp_path, data) == sorted(((i, n, n * c) for i, n, c in want), key=repr)


def test_a_source_of_equal_rows_comes_near_its_target(spark, tmp_path):
    data = [(None, "a b c d e", "s0", 1, "x") for _ in range(40)] + [(i, "a b c d e f", "s1", 1, "x") for i in range(90)] + [(1, "w " * 30, "s2", 1, "x")]
    got = mixed(spark, tmp_path, data)
    want, targets = brute_mix([d[:3] for d in data])
    assert got == sorted(((i, n, n * c) for i, n, c in want), key=repr)
    assert abs(sum(t for i, _, t in got if i is None) - targets["s0"]) <= 2.5


# ---- sharding

def laws(rows, texts):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(i, 0) for i in range(16)) <= 1
    for i in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == i) == list(range(counts.get(i, 0)))
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode()) and r["law"] == "rows" and r["grown_shard"] is None


def test_shards_obey_the_law_and_keep_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = sharding.op6_sharding(spark, sf).collect()
    assert len(rows) == len(texts)
    laws(rows, texts)
    at = defaultdict(set)
    for r in rows:
        at[texts[r["doc_id"]]].add(r["shard"])
    several = [t for t, n in Counter(texts.values()).items() if n > 1]
    assert sum(len(at[t]) == 1 for t in several) >= 0.7 * len(several)  # by chance, hardly any


def test_shards_of_awkward_rows_and_of_a_group_larger_than_a_shard(spark):
    docs = awkward(spark, ["same text"] * 60)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    laws(rows, texts)
    assert sharding.shard(empty(spark)).count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of (value, bytes it has)."""
    seed = 42
    for v, size in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 8 * size) - 1).to_bytes(size, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_propagation(rows, shards, quota):
    """``{(grp, chunk, init): shard}`` and how many rounds moved something."""
    at = {r[:3]: r[2] for r in rows}
    count = {r[:3]: r[3] for r in rows}
    turn = 0
    while True:
        votes = defaultdict(Counter)
        for k, s in at.items():
            votes[k[:2]][s] += count[k]
        wish = {hub: max(v, key=lambda s: (v[s], spark_hash((hub[0], 8), (hub[1], 8), (s, 4)), s)) for hub, v in votes.items()}
        flow, load = Counter(), [0] * shards
        for k, s in at.items():
            flow[s, wish[k[:2]]] += count[k]
            load[s] += count[k]
        room = sharding._room(flow, load, quota, shards)
        if sum(n * room[b] for (a, b), n in flow.items() if a != b) < max(1, sharding.LEAST_MOVED * sum(load)):
            return at, turn
        for k, s in at.items():
            if wish[k[:2]] != s and (spark_hash((k[0], 8), (k[1], 8), (turn, 4)) % (1 << 20)) / (1 << 20) < room[wish[k[:2]]]:
                at[k] = wish[k[:2]]
        turn += 1


def cut_links(at, count):
    """Members of a hub that stand apart from the most of it."""
    votes = defaultdict(Counter)
    for k, s in at.items():
        votes[k[:2]][s] += count[k]
    return sum(sum(v.values()) - max(v.values()) for v in votes.values())


@pytest.mark.parametrize("quota", [10_000, 260, 200])
def test_propagation_against_a_plain_version(spark, quota):
    rng = random.Random(quota)
    rows = [(g, c, i, rng.randrange(1, 6), i) for g in range(60) for c in range(1 + g % 2) for i in rng.sample(range(4), rng.randrange(1, 5))]
    state = spark.createDataFrame(rows, "grp long, chunk long, init int, cnt long, cur int")
    from florilege.llm.scratch import Scratch

    got = {tuple(r)[:3]: r["cur"] for r in sharding._propagate(state, Scratch(spark, "test-shards"), 4, quota).select("grp", "chunk", "init", "cur").collect()}
    want, turns = plain_propagation(rows, 4, quota)
    assert got == want and turns > 0
    count = {r[:3]: r[3] for r in rows}
    before, after = cut_links({r[:3]: r[2] for r in rows}, count), cut_links(got, count)
    assert after == 0 if quota == 10_000 else after < 0.5 * before
    load, began = Counter(), Counter()
    for k, s in got.items():
        load[s] += count[k]
        began[k[2]] += count[k]
    assert all(load[s] <= 1.25 * max(quota, began[s]) for s in load)  # shares of room are met by hash, on average


# ---- language

def plain_language(text, counts):
    """Prediction, score and share of the background, by sums over single trigrams."""
    grams = li.trigrams(text)
    if grams is None or not counts:
        return "und", 0.0, 1.0
    langs, seen = sorted(counts), Counter(int(g) for g in grams)
    total = {x: sum(counts[x].values()) + li.SMOOTHING * li.BUCKETS for x in langs}
    p = {g: [(counts[x].get(g, 0) + li.SMOOTHING) / total[x] for x in langs] + [1 / li.BUCKETS] for g in seen}
    share = [1 / (len(langs) + 1)] * (len(langs) + 1)
    for _ in range(li.EM_STEPS):
        new = [0.0] * len(share)
        for g, n in seen.items():
            whole = sum(s * q for s, q in zip(share, p[g]))
            for k, (s, q) in enumerate(zip(share, p[g])):
                new[k] += n * s * q / whole / len(grams)
        moved = max(abs(a - b) for a, b in zip(share, new))
        share = new
        if moved < 1e-4:
            break
    order = sorted(range(len(langs)), key=lambda k: -share[k])
    best = None
    for size in range(1, len(order) + 1):
        own = [max(share[k], 1e-12) for k in order[:size]]
        own = [s / sum(own) * (1 - share[-1]) for s in own]
        fit = sum(n * math.log(sum(s * p[g][k] for s, k in zip(own, order)) + share[-1] * p[g][-1] + 1e-300) for g, n in seen.items()) - 0.5 * size * math.log(len(grams))
        if best is None or fit > best[0]:
            best = fit, order[:size]
    held = sum(share[k] for k in best[1])
    return langs[best[1][0]], min(1.0, share[best[1][0]] / held), share[-1]


def test_language_query_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = {}
    for r in docs:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 and (grams := li.trigrams(r["text"])) is not None:
            counts.setdefault(r["lang"], Counter()).update(int(g) for g in grams)
    got = {r["doc_id"]: r for r in li.op3_language_id(spark, sf).collect()}
    for r in docs:
        lang, score, background = plain_language(r["text"], counts)
        assert got[r["doc_id"]]["lang_pred"] == lang
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-6) and got[r["doc_id"]]["background"] == pytest.approx(background, abs=1e-6)


def test_languages_of_equal_proportions_go_by_code_point():
    counts = np.zeros((2, li.BUCKETS))
    counts[:, li.trigrams("abc abd")] = 5.0
    assert li.Model(["de", "en"], counts).infer("abc abd")[0] == "de"


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = li.op3_language_id(spark, sf).join(docs, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_mixtures_and_texts_without_letters(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = li.train(docs.where(~li.held_out()))
    pick = {r["lang"]: r["text"] for r in docs.where("length(text) > 1500").collect()}
    both = pick["en"][:1500] + " " + pick["de"][:1000]
    top, score, _, langs = model.infer(both)
    assert top == "en" and set(langs) == {"en", "de"} and 0.5 < score < 0.75
    for text in (None, "", "123 !? \n", "\U0001f600 12"):
        assert model.infer(text)[:2] == ("und", 0.0)
    assert model.infer("中文 \U00020000")[2] > 0.5  # no learned language explains it


def test_language_of_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    kept = li.keep_known(docs)
    assert kept.columns == docs.columns
    assert {0, 1, 2}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert li.keep_known(empty(spark)).count() == 0


def test_prediction_never_reads_the_label(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    blind = docs.withColumn("lang", F.when(li.held_out(), "xx").otherwise(F.col("lang")))
    get = lambda df: sorted((r[0], r[1]["lang_pred"]) for r in df.select("doc_id", li.identify(df)[0]).collect())
    assert get(docs) == get(blind)


# ---- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="home page"><nav><ul><li><a href="/x">menu {i}</a></li></ul></nav><!-- ad --><div class="cookie-notice">We use cookies</div>
<header><h2>Site {i}</h2></header><article><header><h1>Title&nbsp;{i} &amp; more</h1></header><p><b>First  par {i}.<br><p>Second\n par &lt;{i}&gt;.</p><div class="ad">buy</div><ul><li>one<li>two</ul><p>Repeated licence line.</p><form><input><button>Send</button></form><section class="comments"><p>nice!</p></section></article><div class="box q{i}"><p>same words</p></div><aside>side {i}</aside><footer>&copy; x</footer></body></html>"""
TEXT = "Title {i} & more\nFirst par {i}.\nSecond par <{i}>.\none\ntwo\nRepeated licence line."


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, low string")


def test_extraction_of_declared_pages(spark):
    rows = [(i, f"http://h.org/{i}", PAGE.format(i=i), "x") for i in range(12)]
    got = {r["page_id"]: r for r in he.extract(pages(spark, rows)).collect()}
    for i in range(12):
        assert got[i]["text"] == TEXT.format(i=i) and got[i]["n_chars"] == len(TEXT.format(i=i))


def test_style_tree_finds_undeclared_furniture(spark):
    body = lambda i: f'<html><body><div class="z9"><p>Follow us every day</p></div><div class="k3"><p>Text of page {i}</p>{"<p>more of it</p>" * (i % 4)}</div></body></html>'
    rows = [(i, f"http://h.org/{i}", body(i), None) for i in range(20)] + [(99, "http://one.org/", body(99), None)]
    got = {r["page_id"]: r["text"] for r in he.extract(pages(spark, rows)).collect()}
    assert all(got[i].startswith(f"Text of page {i}") for i in range(20))
    assert got[99].startswith("Follow us")  # one page tells nothing about its host


@pytest.mark.parametrize("page", [None, "", "<", "<p", "plain & simple", "<p>a<p>b</p", "<article>" * 500 + "deep", "<!-- open", "<script>never closed", "&#xZZ; &amp &bogus;"])
def test_broken_markup(spark, page):
    r = he.extract(pages(spark, [(1, None, page, None)])).first()
    assert r["text"] is not None and r["n_chars"] == len(r["text"]) and (page == "<" or "<" not in r["text"])


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='page no-sidebar'><article><p>all of it</p></article></div>", "all of it"),
        ("<div class='content has-sidebar'><p>all of it</p></div><div class='site-nav'>menu</div>", "all of it"),
        ("<form id='aspnet'><nav>menu</nav><h1>title</h1><p>a long text of the page</p></form><footer>end</footer>", "title\na long text of the page"),
        ("<form><article><p>the text</p><form><p>find</p></form></article><section class='comments'><article><p>nice one</p></article></section></form><p>" + "other " * 30 + "</p>", "the text\nfind"),
        ("<main><form><p>the whole text</p></form></main>", "the whole text"),
        ("<div class='sidebar'><article><p>text</p></article></div><p>outside</p>", "text"),
        ("<div class='sidebar'><article><p>teaser</p></article></div><article><p>text</p></article>", "text"),
        ("<article><div class='article-header'><h1>title</h1></div><div class='ad-slot-3'>buy</div><p>text</p></article>", "title\ntext"),
        ("<article>" + "<div>" * 300 + "deep<nav>menu</nav>" + "</div>" * 300 + "<p>after it</p></article><p>outside</p>", "deep\nafter it"),
        ("<article>" + "<div>" * 5000 + "deep" + "</div></b></section>" * 5000 + "<p>after it</p></article>", "deep\nafter it"),
    ],
)
def test_wrappers_and_depth_lose_no_text(page, text):
    assert he.main_text(page, set()) == text


class PlainArticle(html.parser.HTMLParser):
    """The blocks of the article elements of a page, by the standard library's parser."""

    BLOCKS = {"article", "p", "h1", "h2", "h3", "ul", "ol", "li", "div", "section", "table", "tr", "td", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.held, self.out = 0, [], []

    def end(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text and self.depth:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.end()
        self.depth += tag == "article"
        if tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.end()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.held.append(data)


def test_extraction_query_against_a_plain_parser(spark, sf):
    held = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = he.op4_html_extraction(spark, sf).collect()
    assert len(got) == len(held)
    for r in got:
        plain = PlainArticle()
        plain.feed(held[r["page_id"]])
        plain.close()
        assert r["text"] == "\n".join(plain.out) and r["n_chars"] == len(r["text"])


def plain_entropy(counts, pages):
    """Entropy of how often something stands on the pages, to the base of their number."""
    return -sum(n / pages * math.log(n / pages, pages) for n in counts)


def test_style_tree_against_a_plain_version(spark):
    rng = random.Random(21)
    rows = []
    for i in range(60):
        side = "".join(f"<p>note {rng.randrange(3)}</p>" for _ in range(rng.randrange(4)))
        rows.append((i, f"http://h{i % 3}.org/{i}", f"<html><body><div class=k{rng.randrange(2)}>{side}</div><section><h1>t{i}</h1><div><p>body {i}</p></div></section></body></html>", None))
    got = {(r["host"], r["path"]): (r["pages"], r["importance"]) for r in he.style_tree(pages(spark, rows).withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))).collect()}
    tree = defaultdict(lambda: (Counter(), Counter(), [0]))
    for i, _, page, _ in rows:
        found, children = he.blocks(page)
        for path in {b.path[:d] for b in found if not b.noise for d in range(1, len(b.path) + 1)}:
            styles, texts, n = tree[f"h{i % 3}.org", "/".join(path)]
            n[0] += 1
            styles[tuple(sorted(children.get(path, Counter()).items()))] += 1
            texts.update({b.text for b in found if not b.noise and b.path[: len(path)] == path})
    assert got.keys() == tree.keys() and len(got) > 10
    for key, (styles, texts, (n,)) in tree.items():
        assert got[key][0] == n
        style = plain_entropy(styles.values(), n) if n > 1 else 1.0
        # over the standing texts: one less the mean share of pages, in logarithms, that a text stands on
        text = 1.0
        if n > 1 and texts:
            spread = [math.log(k, n) for k in texts.values() for _ in range(k)]
            text = 1 - sum(spread) / len(spread)
        weight = 1 - he.DECAY ** len(styles)
        assert got[key][1] == pytest.approx(weight * style + (1 - weight) * text)


def test_no_pages(spark):
    assert he.extract(pages(spark, [])).count() == 0


# ---- nearest neighbours

def test_recall_and_exact_scores(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows])
    found = defaultdict(dict)
    for r in nearest.op10_nearest(spark, sf).collect():
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        got = found[ids[q]]
        assert sorted(got) == list(range(1, 21))
        assert all(abs(sc - s[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, sc in got.values())
        assert [got[k] for k in sorted(got)] == sorted(got.values(), key=lambda p: (-p[1], p[0]))
        recall.append(len({v for v, _ in got.values()} & set(ids[order])) / 20)
    assert np.mean(recall) >= 0.9


def test_odd_vectors_take_no_part_and_ties_go_by_id(spark):
    same = [1.0, 0.0]
    data = [(i, same) for i in range(30)] + [(40, None), (41, [0.0, 0.0]), (42, [float("nan"), 1.0]), (43, [None, 1.0]), (44, [1.0]), (45, [float("inf"), 0.0]), (None, same), (60, [3.0, 4.0]), (5, same)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == [0, 20, 60]
    assert [v for v, _ in got[0]] == [60, *range(1, 20)] and got[0][0][1] == 3.0
    assert [v for v, _ in got[60]] == list(range(20))
    assert nearest.search(df.where("false")).count() == 0


def test_queries_of_small_lists_get_twenty(spark):
    rng = np.random.default_rng(1)
    hot = rng.standard_normal((1, 8)) + rng.standard_normal((2000, 8)) * 1e-3
    far = np.eye(8)[rng.integers(0, 8, 40)] * rng.choice([-1.0, 1.0], (40, 1)) * 3 + rng.standard_normal((40, 8)) * 0.05
    x = np.vstack([hot, far])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = Counter(r["query_id"] for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == {i: 20 for i in range(0, len(x), 20)}


# ---- pipeline

def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    known = {r["doc_id"] for r in li.op3_language_id(spark, sf).where("not rejected").collect()}
    first = [i for i, _, c in brute_components([(i, rows[i]["text"]) for i in sorted(known)]) if c == i]
    clean = [i for i in first if not (lambda n, h, _: h and 20 * h >= n)(*brute_hits(rows[i]["text"], items))]
    sizes = Counter()
    for i in clean:
        sizes[rows[i]["source"]] += len(SPACE.findall(rows[i]["text"]))
    target = brute_targets(sizes)
    out = corpus_pipeline.run(spark, sf).collect()
    copies = Counter(r["doc_id"] for r in out)
    assert set(copies) <= set(clean)
    for i in clean:
        s = rows[i]["source"]
        rate = target[s] / sizes[s]
        assert int(rate + 1e-9) <= copies[i] <= int(rate + 1e-9) + 1
    laws(out, {i: rows[i]["text"] for i in clean})


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixing", "sharding"]


def test_awkward_and_empty_tables_go_through_all_stages(spark, tmp_path):
    rng = random.Random(17)
    words = {x: ["".join(rng.choice(x * 3 + "eirs") for _ in range(5)) for _ in range(60)] for x in ("ab", "cd")}
    extra = [" ".join(rng.choice(words["ab" if i % 2 else "cd"]) for _ in range(80)) for i in range(60)]
    docs = awkward(spark, extra).withColumn("lang", F.when(F.col("doc_id") < 13, F.col("lang")).when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, extra[7]), (2, None), (None, ""), (3, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = Scratch(spark, "test-stage").write(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == frame.columns and kept.count() > 0
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert name != "language_id" or not ids & {0, 1, 2}  # null, empty, blank
        assert name != "jaccard_join" or (5 in ids and 6 not in ids and None not in ids)
        assert name != "decontamination" or 13 + 7 not in ids
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    count = Counter(r["shard"] for r in out)
    assert len(out) == kept.count() and max(count.values()) - min(count.get(k, 0) for k in range(sharding.SHARDS)) <= 1
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    items.write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
