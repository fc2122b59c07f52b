"""HTML extraction with a site style tree.

The pages of a host are merged into one tree: a node is a path of containers (tag and classes),
its presentations are the sequences of its children, its contents the texts of its leaves. Over
the pages of the host,

* a node's presentation importance is the entropy of its presentations: a branch that looks the
  same on every page is furniture;
* its content importance is one less the mean entropy of its texts over the pages: texts that
  stand on every page are furniture;
* both are blended by the number of presentations, as in the composite importance of the published
  method (presentation weighs 1 - DECAY ** presentations).

Branches of low importance are removed from every page of the host. Where menus, footers or adverts
carry other words on every page, entropy alone keeps them (measured on the test pages, where all of
them do), so evidence that a branch *declares* counts first: elements and class words
of navigation, header, footer, sidebar, notice, advert, form and comment are removed whatever their
entropy, and on pages with an ``article`` or ``main`` element text outside of it is. Class words and
ids declare as a whole, or as compounds of such words and neutral ones (``site-nav``; not ``no-sidebar``
or ``article-header``). Marks of wrappers count against an ``article`` or ``main`` only if
another one of the page stands in fewer of them, and a ``form`` that holds half of a page's text or more
declares nothing. Entropy decides
on the branches that declare nothing; paragraphs and headings are judged with the branch they stand
in, so that a repeated paragraph of an article stays.

The text: blocks in page order, joined by one newline; in a block character references decoded,
white space turned into one space, trimmed.

Counts are aggregated in Spark; a host that holds a third of all pages is spread over its texts.

Defined results: null or empty html gives the empty text. A null url, or one without a host, is
judged by declared evidence alone, as is a branch that fewer than ``LEAST_PAGES`` pages of its host
have (on two pages, copies of one text would pass for furniture). Unclosed and
cut-off markup is read as far as it goes, at any depth; the style tree takes containers below
``TREE_DEPTH`` for part of the one at that depth. Texts of any length are
extracted whole. Repeated rows are extracted each in its own row. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm.scratch import Scratch
from florilege.llm.url_filters import url_host

DECAY = 0.9
LOW = 0.2
LEAST_PAGES = 8
TREE_DEPTH = 200
#: Low branches are broadcast up to so many hosts; beyond, pages are joined with them by host.
BROADCAST_HOSTS = 20_000

# Elements and class words.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|title|xmp"
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
NOISE_TAGS = set("nav header footer aside form button select option menu dialog head object canvas audio video map fieldset".split())
NOISE_WORDS = set(
    "ad ads adbox advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "recommended related reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say nothing of their own in a compound with words of NOISE_WORDS.
NEUTRAL_WORDS = set(
    "site global main top bottom left right primary secondary first last inner outer wrap wrapper container box bar block section area region "
    "column col slot unit zone panel list item items link links button buttons btn icon icons posts articles stories widgets this".split()
)
NOISE_COMPOUNDS = set("post-comments post-comment post-navigation post-share entry-comments entry-share article-comments article-share page-navigation page-footer".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN_TAGS = ("article", "main")
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption summary tbody thead table ul ol dl".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?P<broken>/?[a-zA-Z])[^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Block:
    """A text block: its text, the containers it stands in, and what they declare."""

    __slots__ = ("text", "path", "noise", "main")

    def __init__(self, text: str, path: tuple[str, ...], noise: bool, main: bool):
        self.text, self.path, self.noise, self.main = text, path, noise, main


class _Open:
    """An open container, with what it and those around it declare."""

    __slots__ = ("tag", "path", "main", "outer", "inner", "form")

    def __init__(self, tag: str, path: tuple[str, ...], main: bool, outer: int, inner: bool, form: int):
        self.tag, self.path, self.main = tag, path, main
        #: marks outside of the outermost article or main, and whether one stands within, forms aside;
        #: the number of the outermost form, 0 for none, below 0 within an article or main
        self.outer, self.inner, self.form = outer, inner, form


_PAGE = _Open("", (), False, 0, False, 0)


def _furniture(token: str) -> bool:
    pieces = _WORD.findall(token)
    return not NOISE_WORDS.isdisjoint(pieces) and (all(p in NOISE_WORDS or p in NEUTRAL_WORDS for p in pieces) or "-".join(pieces) in NOISE_COMPOUNDS)


def _declares(tag: str, attrs: str, in_main: bool) -> tuple[str, bool]:
    """The name of a container in the tree, and whether it declares itself furniture."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)} if "=" in attrs else {}
    words = found.get("class", "").lower().split()
    name = ".".join([tag, *sorted(words)])
    if tag in NOISE_TAGS and not (tag == "header" and in_main):
        return name, True
    marked = tag not in MAIN_TAGS and tag not in ("html", "body") and any(_furniture(w) for w in words + found.get("id", "").lower().split())
    return name, marked or found.get("role", "").lower() in NOISE_ROLES


def blocks(page: str | None) -> tuple[list[Block], dict[tuple[str, ...], Counter]]:
    """The text blocks of a page in order, and the children of every container."""
    out: list[tuple[str, _Open]] = []
    children: dict[tuple[str, ...], Counter] = {}
    stack: list[_Open] = [_PAGE]
    opened: Counter = Counter()  # open containers of each tag
    held: list[str] = []
    n_forms = 0

    def end_block() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, stack[-1]))

    at = 0
    for m in _TOKEN.finditer(page or ""):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag in ("br", "wbr"):
                held.append(" " if tag == "br" else "")
            continue
        end_block()
        if m["close"]:
            while opened[tag]:
                last = stack.pop().tag
                opened[last] -= 1
                if last == tag:
                    break
        elif tag not in VOID and not m["attrs"].endswith("/"):
            if stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or tag == stack[-1].tag in ("li", "dt", "dd", "td", "th", "tr"):
                opened[stack.pop().tag] -= 1
            top = stack[-1]
            name, noise = _declares(tag, m["attrs"], top.main)
            children.setdefault(top.path, Counter())[name] += 1
            main, outer, inner, form = top.main or tag in MAIN_TAGS, top.outer, top.inner, top.form
            if tag == "form":
                if not form:  # a form has no forms in it
                    n_forms += 1
                    form = -n_forms if main else n_forms
            elif main:
                inner = inner or noise
            else:
                outer += noise
            path = top.path if tag in TEXT_BLOCKS or len(top.path) >= TREE_DEPTH else (*top.path, name)
            stack.append(_Open(tag, path, main, outer, inner, form))
            opened[tag] += 1
    if page and at < len(page):
        held.append(page[at:])
    end_block()
    return _judged(out), children


def _judged(found: list[tuple[str, _Open]]) -> list[Block]:
    """The blocks of a page, with the marks that count on it."""
    within: Counter = Counter()  # characters in each form
    for text, at in found:
        within[at.form] += len(text)
    total = sum(within.values())
    within[0] = total
    narrow = [2 * within[at.form] < total for _, at in found]
    marks = [at.outer + (at.form > 0 and x) for x, (_, at) in zip(narrow, found, strict=True)]
    inner = [at.inner or at.form < 0 and x for x, (_, at) in zip(narrow, found, strict=True)]
    least = min((k for k, x, (_, at) in zip(marks, inner, found, strict=True) if at.main and not x), default=0)
    return [Block(text, at.path, x or k > (least if at.main else 0), at.main) for k, x, (text, at) in zip(marks, inner, found, strict=True)]


def _hash(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _branches(found: list[Block]) -> Iterator[tuple[str, Block]]:
    for block in found:
        for depth in range(1, len(block.path) + 1):
            yield "/".join(block.path[:depth]), block


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``host, path, kind, feature`` of the undeclared branches: kind 0 the page, 1 its presentation, 2 a
    text; of both the hash, as each text counts in every branch that holds it."""
    for batch in batches:
        rows = []
        for host, page in zip(batch["host"], batch["html"], strict=True):
            found, children = blocks(page)
            seen = set()
            for branch, block in _branches([b for b in found if not b.noise]):
                if branch not in seen:
                    seen.add(branch)
                    style = children.get(tuple(branch.split("/")), Counter())
                    rows += [(host, branch, 0, 0), (host, branch, 1, _hash(",".join(f"{k}*{n}" for k, n in sorted(style.items()))))]
                if (branch, block.text) not in seen:
                    seen.add((branch, block.text))
                    rows.append((host, branch, 2, _hash(block.text)))
        yield pd.DataFrame(rows, columns=["host", "path", "kind", "feature"])


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, path, pages, importance`` for every branch of every host's merged tree."""
    seen = pages.where("host <> ''").select("host", "html").mapInPandas(_observe, "host string, path string, kind int, feature long")
    counts = seen.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("k"))
    k, log_k = F.col("k"), F.col("k") * F.log("k")
    only = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    sums = counts.groupBy("host", "path").agg(
        only(0, k).alias("pages"), only(1, log_k).alias("style_log"), only(1, F.lit(1)).alias("styles"), only(2, k).alias("texts"), only(2, log_k).alias("text_log")
    )
    log_m = F.log("pages")
    style = F.when(F.col("pages") > 1, 1 - F.col("style_log") / (F.col("pages") * log_m)).otherwise(1.0)
    text = F.when((F.col("pages") > 1) & (F.col("texts") > 0), 1 - F.col("text_log") / (F.col("texts") * log_m)).otherwise(1.0)
    weight = 1 - F.pow(F.lit(DECAY), F.col("styles"))
    return sums.select("host", "path", "pages", (weight * style + (1 - weight) * text).alias("importance"))


def main_text(page: str | None, low: set[str]) -> str:
    """The text of a page without declared furniture and without the ``low`` branches."""
    found = [b for b in blocks(page)[0] if not b.noise]
    if any(b.main for b in found):
        found = [b for b in found if b.main]
    if low:
        found = [b for b in found if not any("/".join(b.path[:d]) in low for d in range(1, len(b.path) + 1))]
    return "\n".join(b.text for b in found)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        low = [set(x) if x is not None else set() for x in batch["low"]]
        text = [main_text(p, x) for p, x in zip(batch["html"], low, strict=True)]
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    scratch = Scratch(pages.sparkSession, "html")
    hosted = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], url_host(pages["url"]).alias("host"), pages["html"])
    # what may be removed by entropy: branches below the body that hold neither article nor main
    low = style_tree(hosted).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LOW)).where(~F.col("path").isin("html", "html/body", "body") & ~F.col("path").rlike(r"(^|/)(article|main)[^/]*$"))
    low = scratch.write(low.groupBy("host").agg(F.collect_set("path").alias("low")), "low")
    few = F.broadcast(low) if low.count() <= BROADCAST_HOSTS else low
    return hosted.join(few, "host", "left").select("page_id", "url", "html", "low").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
