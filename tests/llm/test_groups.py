"""Near copies, decontamination, line dedup, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest

from florilege.llm import decontamination as dc
from florilege.llm import jaccard_join as jj
from florilege.llm import line_dedup as ld
from florilege.llm import shingles as sh
from tests.llm.cases import awkward, empty

SPACE = re.compile("[^\x20\x09-\x0d]+")
LOW = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = SPACE.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def families(seed):
    """Families of copies with more and more edits, short and long, so that links are near the limit."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    out = []
    for size in (4, 5, 6, 8, 12, 20, 40, 90, 200, 500):
        base = [rng.choice(words) for _ in range(size)]
        line = "the common line that very many documents of a family hold".split()
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[: -rng.randint(1, 3)] or copy
            if rng.random() < 0.3:
                copy += line
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def test_jaccard_components_against_brute_force(spark):
    texts = [t for seed in (1, 2, 3) for t in families(seed)]
    docs = awkward(spark, texts)
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = sorted((tuple(r) for r in jj.join_components(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == want


def tight(monkeypatch):
    """Neither slack nor reserve: many sets have more empty segments than they may skip."""
    for name, value in {"SLACK": 0, "LEAST_SLACK": 0, "RESERVE": 0, "LEAST_RESERVE": 0}.items():
        monkeypatch.setattr(jj, name, value)


def small_blocks(monkeypatch):
    for name, value in {"FLUSH": 500, "PART_WORDS": 200, "BLOCK": 5, "PAIR": 20, "CELL": 12}.items():
        monkeypatch.setattr(jj, name, value)


@pytest.mark.parametrize("change", [tight, small_blocks])
def test_jaccard_components_do_not_depend_on_layout(spark, monkeypatch, change):
    docs = awkward(spark, [t for seed in (4, 5) for t in families(seed)])
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    change(monkeypatch)
    if change is tight:
        assert jj._Join(docs).base.where("size(odd) > 0").count() > 3
    got = sorted((tuple(r) for r in jj.join_components(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == want


def test_long_texts_hash_as_in_one_piece(monkeypatch):
    rng = random.Random(1)
    texts = pa.array(["".join(rng.choice("abC dE\n\t ") for _ in range(rng.choice([0, 3, 50, 400]))) for _ in range(60)] + ["x" * 3000 + " a b c d e f", " " * 2000 + "q w e r t y"])
    whole = [x.tolist() for x in sh.shingle_sets(texts)]
    for piece in (1, 7, 333):
        monkeypatch.setattr(sh, "PIECE", piece)
        for name, table in zip(("_POWER", "_INVERSE"), sh._powers(), strict=True):
            monkeypatch.setattr(sh, name, table)
        assert [x.tolist() for x in sh.shingle_sets(texts)] == whole


def test_one_of_each_component_stays(spark):
    docs = awkward(spark)
    kept = jj.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.where("doc_id is not null").collect()]
    assert 5 in ids and 6 not in ids and 7 not in ids and {0, 1, 2} <= set(ids)


def test_jaccard_of_an_empty_table(spark):
    assert jj.join_components(empty(spark)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items):
    w = WORD.findall((text or "").translate(LOW))
    hit, held = set(), set()
    for item, t in items:
        x = WORD.findall((t or "").translate(LOW))
        size = min(13, len(x))
        for i in range(len(x) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == x[i : i + size]:
                    hit |= set(range(j, j + size))
                    held.add(str(item))
    return len(w), len(hit), sorted(held)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "of", *("".join(rng.choice("abcé") for _ in range(4)) for _ in range(40))]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 12, 13, 14, 30, 30])] + [(7, None), (8, ""), (9, "!!"), (10, "The OF"), (10, "The OF")]
    texts = []
    for i in range(25):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        part = (items[rng.randrange(7)][1]).split()
        at = rng.randint(0, len(body))
        texts.append(" ".join(body[:at] + part[: rng.choice([5, 13, 20, 40])] + body[at:]).upper())
    docs = awkward(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in dc.match(docs, bench).collect()), key=repr)
    want = sorted(((r["doc_id"], *brute_hits(r["text"], items)) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert got == want
    kept = dc.remove_contaminated(docs, bench)
    bad = {i for i, n, h, _ in got if h and 20 * h >= n and i is not None}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").select("doc_id").distinct().collect()) == sorted({g[0] for g in got if g[0] is not None} - bad)


def test_decontamination_in_blocks_gives_the_same(spark, monkeypatch):
    docs = awkward(spark, ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen"])
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "one two")], "item_id long, text string")
    whole = sorted((tuple(r) for r in dc.match(docs, bench).drop("row").collect()), key=repr)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 400)
    assert sorted((tuple(r) for r in dc.match(docs, bench).drop("row").collect()), key=repr) == whole


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.match(awkward(spark), bench).where("n_hit > 0").count() == 0
    assert dc.match(empty(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x x x x x x alpha"), (2, "beta alpha"), (3, "alpha")], "doc_id long, text string")
    index = dc.postings(docs, spark.createDataFrame([("alpha",), ("beta",), ("",)], "term string"), 3)
    got = sorted(tuple(r) for r in dc.proximity(index, "alpha", "beta", 3).collect())
    assert got == [(1, 0, 3), (2, 1, 0)]


def test_patience_diff_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        m = ld._matches(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    assert ld._matches([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def brute_kept(rows):
    """Each text stripped of the blocks aligned with any earlier text."""
    cls = {}
    for i, t in rows:
        if t is not None:
            cls[t] = min(ld.LAST if i is None else i, cls.get(t, ld.LAST))
    order = sorted(cls, key=lambda t: (cls[t], hashlib.md5(t.encode()).digest()))
    cut = {t: [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")] for t in order}
    kept = {}
    for t in order:
        lines, gone = [x for _, x in cut[t]], set()
        for p in order[: order.index(t)]:
            gone |= {cut[t][k][0] for k in ld.common_blocks(lines, [x for _, x in cut[p]], [len(re.split(r"\s+", x)) for x in lines])}
        kept[t] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
        elif (ld.LAST if i is None else i) != cls[t]:
            out.append((i, "\n".join(x for x in t.split("\n") if not x.strip(" "))))
        else:
            out.append((i, kept[t]))
    return sorted(out, key=repr)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(6)
    line = lambda n=12: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n))
    shared = [line() for _ in range(6)]
    licence = "Released under the licence."
    texts = []
    for _ in range(30):
        body = [line() for _ in range(rng.randint(1, 5))]
        at, a = rng.randint(0, len(body)), rng.randint(0, 3)
        texts.append("\n".join(body[:at] + shared[a : a + rng.randint(0, 3)] + body[at:] + ([licence] if rng.random() < 0.5 else []) + [""]))
    docs = awkward(spark, [*texts, texts[0], texts[3]])
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = ld.remove_repeated(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()), key=repr) == brute_kept(rows)


def test_long_passages_go_and_clean_documents_stay(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"first own\n{passage}\nend one"), (2, f"second own\n{passage}\nend two"), (3, "nothing shared here")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in ld.remove_repeated(docs).collect()}
    assert got == {1: f"first own\n{passage}\nend one", 2: "second own\nend two", 3: "nothing shared here"}


def test_swapped_blocks_go_in_two_alignments():
    p, q, mid = [1, 2, 3], [4, 5], [9]
    words = {1: 8, 2: 8, 3: 8, 4: 15, 5: 15, 9: 3, 8: 3}
    first, later = [*p, *mid, *q], [*q, 8, *p]
    count = lambda x: [words[i] for i in x]
    once = ld.common_blocks(later, first, count(later))
    assert once in ([0, 1], [3, 4, 5])  # one common subsequence holds one of them
    assert ld.aligned_blocks(later, first, count(later), count(first)) == {0, 1, 3, 4, 5}


def test_repeating_lines_have_no_anchor_but_go():
    assert ld.aligned_blocks([7, 7, 7, 1], [2, 7, 7, 7, 7], [10, 10, 10, 1], [1, 10, 10, 10, 10]) == {0, 1, 2}


def test_line_dedup_of_an_empty_table(spark):
    assert ld.remove_repeated(empty(spark)).count() == 0


def numbered(text):
    """Lines that are not blank, with their numbers and word counts."""
    cut = [(k, x.strip(" ")) for k, x in enumerate(text.split("\n")) if x.strip(" ")]
    return [k for k, _ in cut], [x for _, x in cut], [len(re.split(r"\s+", x)) for _, x in cut]


def common_runs(a, b, words):
    """Places in ``a`` of all runs of LEAST_WORDS words that ``b`` holds in a row, over all pairs of places."""
    gone = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(words[i : i + n]) >= ld.LEAST_WORDS:
                gone |= set(range(i, i + n))
    return gone


def test_blocks_of_any_earlier_document_go(spark):
    line = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    own = [line(f"own{i}x", 18) for i in range(6)]
    l1, l2, l3 = (line(f"shared{i}x", 18) for i in range(3))
    # the first document holds the lines scattered, so that it is their first holder but holds no block
    texts = ["\n".join(x) for x in ([l1, own[0], l2, own[1], l3], [own[2], l1, l2, l3, own[3]], [own[4], l1, l2, l3, own[5]])]
    rng = random.Random(12)
    pool = [line(f"p{i}x", rng.choice([1, 2, 5, 9, 12, 20, 23])) for i in range(14)]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in ld.remove_repeated(docs).collect()}
    assert got[2] == f"{own[4]}\n{own[5]}"
    cut = [numbered(t) for t in texts]
    for d, (at, lines, words) in enumerate(cut):
        gone, aligned = set(), set()
        for _, other, _ in cut[:d]:
            gone |= common_runs(lines, other, words)
            aligned |= set(ld.common_blocks(lines, other, words))
        assert aligned <= gone  # what alignment with every earlier document deletes
        gone = {at[k] for k in gone}
        assert got[d] == "\n".join(x for k, x in enumerate(texts[d].split("\n")) if k not in gone)


def test_every_row_is_judged_by_its_own_text(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60))
    base, other, only_null, bad = (text() for _ in range(4))
    rows = [(5, base), (5, base), (None, base), (None, base + " tail"), (7, base + " end"), (7, other), (None, only_null), (None, only_null), (None, only_null + " more"), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in jj.keep_first(docs).collect()), key=repr)
    null_kept = [r for r in kept if r[0] is None]
    assert len(null_kept) == 1 and null_kept[0][1] in (only_null, only_null + " more")
    assert [r for r in kept if r[0] is not None] == sorted([(5, base), (7, other), (8, None), (8, None)], key=repr)
    items = spark.createDataFrame([(1, bad)], "item_id long, text string")
    docs = spark.createDataFrame([(1, bad), (1, base), (None, bad), (None, other), (2, other)], "doc_id long, text string")
    kept = sorted((tuple(r) for r in dc.remove_contaminated(docs, items).collect()), key=repr)
    assert kept == sorted([(1, base), (None, other), (2, other)], key=repr)
