"""Packing, conversation repair and periodic runs, against brute force."""

from __future__ import annotations

import functools
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from florilege.llm import conversation_repair as cr
from florilege.llm import packing as pk
from florilege.llm import periodic_runs as pr
from tests.llm.cases import awkward, empty

WORD = re.compile("[^\x20\x09-\x0d]+")


# periodic runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def periodic_texts(seed):
    """Texts of few words, with planted repetitions of many periods, nested and side by side."""
    rng = random.Random(seed)
    out = []
    for k in range(40):
        letters = [f"w{i}" for i in range(rng.choice([1, 2, 3, 50]))]
        words = [rng.choice(letters) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            part = [rng.choice(letters) for _ in range(rng.choice([1, 2, 7, 8, 9, 14, 15, 24, 25, 40, 41, 90]))]
            if rng.random() < 0.3:
                part = part * 3 + ["x"]
            many = len(part) * rng.choice([2, 3, 4]) + rng.randrange(-2, len(part))
            words += (part * 6)[:many] + [rng.choice(letters) for _ in range(rng.randrange(20))]
        out.append(rng.choice([" ", "\n", "  "]).join(words))
    return out


def test_runs_against_brute_force(spark):
    texts = [t for seed in range(4) for t in periodic_texts(seed)]
    docs = awkward(spark, texts)
    got = pr.periodic_runs(docs).collect()
    kept = docs.select("doc_id", "text").collect()
    assert len(got) == len(kept)
    some = 0
    for row, have in zip(sorted(kept, key=repr), sorted(got, key=lambda r: repr(next(k for k in kept if k["doc_id"] == r["doc_id"]))), strict=True):
        words = WORD.findall(row["text"] or "")
        want = brute_runs(words) if len(words) < 5000 else []
        assert have["n_words"] == len(words)
        if len(words) < 5000:
            assert [(r["start"], r["length"], r["period"]) for r in have["runs"]] == want, row
            assert have["collapsed"] == brute_collapsed(words, want)
        some += len(want)
    assert some > 100


def test_runs_of_long_periods():
    rng = np.random.default_rng(3)
    for period in (9, 100, 273, 436, 1000, 2222):
        for times in (3.0, 3.4):
            body = np.tile(rng.integers(0, 10**6, period), 5)[: int(period * times)]
            words = np.concatenate((rng.integers(0, 10**6, 37), body, [-5 + 10**7], rng.integers(0, 10**6, 11)))
            got = pr.find_runs(np.concatenate((words, [-1])), [len(words)])
            assert got == ([(37, 37 + len(body), period)] if len(body) >= 24 else [])


def test_runs_do_not_depend_on_batches(monkeypatch):
    texts = [t.encode() for t in periodic_texts(9)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    whole = pa.Table.from_batches(list(pr._batches(iter([batch])))).to_pylist()
    monkeypatch.setattr(pr, "FLUSH_BYTES", 300)
    assert pa.Table.from_batches(list(pr._batches(iter([batch])))).to_pylist() == whole


def test_a_text_of_one_word_is_linear():
    words = np.zeros(400_001, np.int64)
    words[-1] = -1
    assert pr.find_runs(words, [400_000]) == [(0, 400_000, 1)]


def tailed(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_of_runs_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pr.op13_periodic_runs(spark, sf).collect()
    assert len(got) == len(docs)
    some = 0
    for r in got:
        words = tailed(r["doc_id"], docs[r["doc_id"]])
        if len(words) > 2500:
            continue
        runs = brute_runs(words)
        some += len(runs)
        assert r["n_runs"] == len(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
    assert some > 5


def test_query_of_runs_on_awkward_rows(spark, tmp_path):
    awkward(spark, ["a b c " * 50]).withColumnRenamed("cls", "runs").write.parquet(f"{tmp_path}/documents.parquet")
    rows = pr.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(rows) == awkward(spark, ["a"]).count() and [r["period"] for r in rows if r["n_runs"]]
    nothing = hashlib.sha256(b"").hexdigest()
    assert {r["collapsed_sha256"] for r in rows if r["doc_id"] in (0, 1, 2)} == {nothing}
    empty(spark).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert pr.op13_periodic_runs(spark, f"{tmp_path}/e").count() == 0


# packing


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pk.vocabulary_path())


def test_ids_are_those_of_the_library():
    rng = random.Random(5)
    bits = ["the", " ", "  ", "\n", "\n\n", "\t", "Été", "naïve", "don't", "'s", "3.5", "a²3", "x_y", "...", "?!", " ", "\r\n", "中文", "ā", "é", "\x1c", "<|endoftext|>", "ß.", "(a)", "-", "word,", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(600)]
    texts += ["", " ", "plain words. More words, and more!\n\nA line", "É" * 3000, "a " * 5000]
    want = [np.array([*library().encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert list(pk.Encoder(pk.vocabulary_path()).encode(texts)) == want


def test_ids_do_not_depend_on_what_is_known(monkeypatch):
    monkeypatch.setattr(pk, "CACHE", 5)
    texts = ["one two three, four.", "five six seven eight nine ten", "one two"]
    want = [np.array([*library().encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert list(pk.Encoder(pk.vocabulary_path()).encode(texts)) == want


class PlainBins:
    """Best fit by looking at every open bin."""

    def __init__(self, length, most):
        self.length, self.most, self.open, self.made = length, most, [], 0

    def place(self, size):
        fits = [(space, -k) for k, (space, _) in enumerate(self.open) if space >= size]
        if fits:
            space, number = self.open.pop(-min(fits)[1])
        else:
            if len(self.open) == self.most:
                self.open.pop(-min((space, -k) for k, (space, _) in enumerate(self.open))[1])
            space, number = self.length, self.made
            self.made += 1
        if space > size:
            self.open.append((space - size, number))
        return number, self.length - space


@pytest.mark.parametrize("most", [1, 3, 40, 10_000])
def test_bins_against_plain_best_fit(most):
    rng = random.Random(most)
    bins, plain = pk.Bins(64, most), PlainBins(64, most)
    for _ in range(2000):
        size = rng.randrange(1, 64)
        assert bins.place(size) == plain.place(size)


def check_packing(rows, docs, length):
    ids = {}
    for doc_id, text in docs:
        ids.setdefault(doc_id, []).append([*library().encode(text or "", add_special_tokens=False).ids, 0])
    places = {}
    by_doc = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    for doc_id, lists in ids.items():
        want = []
        for x in lists:
            first = (len(x) - 1) % length + 1
            cuts = [0, *range(first, len(x), length), len(x)]
            want += [(k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc_id]) == sorted(want)
    return len(places), sum(r["length"] for r in rows)


def test_query_of_packing_against_the_library(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = pk.op11_packing(spark, sf).collect()
    sequences, tokens = check_packing(rows, docs, pk.LENGTH)
    assert sequences <= 1.03 * -(-tokens // pk.LENGTH) + 1
    again = pk.op11_packing(spark, sf).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_query_of_packing_on_awkward_rows(spark, tmp_path):
    docs = awkward(spark, ["<|endoftext|> x", "a" * 9000])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = pk.op11_packing(spark, str(tmp_path)).collect()
    check_packing(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], pk.LENGTH)
    empty(spark).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert pk.op11_packing(spark, f"{tmp_path}/e").count() == 0


def test_packed_sequences_hold_all_ids(spark):
    docs = awkward(spark)
    want = sorted(i for r in docs.select("text").collect() for i in [*library().encode(r["text"] or "", add_special_tokens=False).ids, 0])
    found = pk.pack(docs, length=128).collect()
    assert all(len(r["ids"]) <= 4 * 128 for r in found)
    assert sorted(i for r in found for i in np.frombuffer(bytes(r["ids"]), "<u4").tolist()) == want


# conversations

PATTERN = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, initials of the edits and repaired rows, by trying edits in the order of cost and initials."""
    bad = faults(rows)
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, at, initials, done = heapq.heappop(heap)
        if at == len(rows) and PATTERN.fullmatch(initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in done)

        def push(more, edit, step, add, new):
            if re.fullmatch("s?(ua)*u?", initials + add):
                heapq.heappush(heap, (cost + more, audit + edit, at + step, initials + add, done + new))

        for role in ("user", "assistant"):
            push(3, "I", 0, role[0], ((role, ""),))
        if at < len(rows):
            role, text = rows[at]
            push(4, "D", 1, "", ())
            if bad[at] in ("", "truncated"):
                more = 3 * (bad[at] == "truncated")
                push(more, "K", 1, role[0], ((role, text),))
                for new in ("user", "assistant"):
                    push(3 + more, "R", 1, new[0], ((new, text),))


def line(rows):
    """The report of one conversation, from its ``(turn, role, text)``, by the plain version."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    said = [(r[1], r[2]) for r in rows]
    bad, turns = faults(said), {r[0] for r in rows} - {None}
    cost, audit, text = cheapest(said)
    illegal = sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


FIELDS = "conv_id long, turn long, role string, text string, edits int, fault string"


def odd_conversations():
    rng = random.Random(11)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", None, " \n", f"t {turn}.", "Yes."])
            rows.append((conv if conv else None, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 1, 3]), role or (" " if role == "" else role), text, 1, "x"))
    return rows


def expect(rows):
    want = {}
    by = {}
    for r in brute_damage([r[:4] for r in rows]):
        by.setdefault(r[0], []).append(r[1:])
    for conv in {r[0] for r in rows}:
        want[conv] = line(by[conv]) if conv in by else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return want


def reports(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def test_query_of_conversations_against_brute_force(spark, tmp_path):
    rows = odd_conversations()
    spark.createDataFrame(rows, FIELDS).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = cr.op12_conversation_repair(spark, str(tmp_path))
    assert got.count() == len({r[0] for r in rows})
    want = expect(rows)
    assert reports(got) == want
    assert sum(w[5] > 6 for w in want.values()) > 30 and all(sum(w[k] for w in want.values()) for k in range(6))


def test_query_of_conversations_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reports(cr.op12_conversation_repair(spark, sf)) == expect(rows)


def test_conversations_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], FIELDS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert cr.op12_conversation_repair(spark, str(tmp_path)).count() == 0


def test_state_goes_from_batch_to_batch(spark):
    """One conversation of many rows and a very long text, in batches of a hundred rows."""
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant", "tool"]), "z" * 300_000 if i == 500 else f"{i} {rng.choice(['ok.', 'cut'])}", 0, "") for i in range(3000)]
    df = spark.createDataFrame(rows, FIELDS)
    got = cr.report(df).collect()[0]
    # forward programme on (cost, initials of edits): no initials are the beginning of others of the same cost
    best = {0: (0, "")}
    step = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserts(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                new = (c + 3, a + "I")
                best[step[s]] = min(best.get(step[s], new), new)

    inserts(best)
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    for role, fault in zip([r[2] for r in rows], faults([(r[2], r[3]) for r in rows])):
        after = {}
        for s, (c, a) in best.items():
            more = 3 * (fault == "truncated")
            for t, new in ((s, (c + 4, a + "D")), (kept.get((s, role[0])), (c + more, a + "K")), (step[s], (c + 3 + more, a + "R"))):
                if t is not None:
                    after[t] = min(after.get(t, new), new)
        best = after
        inserts(best)
    assert got["cost"] == min(best[s][0] for s in best if s in (0, 3))
    assert got["audit"] == min(best[s] for s in best if s in (0, 3))[1]


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi.", 0, ""), (1, 1, "user", "", 0, ""), (2, 5, "user", "Why?", 0, ""), (2, 6, "assistant", "So.", 0, "")], FIELDS)
    got = sorted(map(tuple, cr.repair(df).collect()))
    assert got == [(1, 0, None, "I", "user", ""), (1, 1, 0, "K", "assistant", "Hi."), (2, 0, 5, "K", "user", "Why?"), (2, 1, 6, "K", "assistant", "So.")]
