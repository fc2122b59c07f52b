"""Language ID by mixture inference.

A document is taken as a mixture of languages. The model of a language is a distribution over
hashed character trigrams (letters folded to lower case, all else a space), learned from labelled
documents. For each document, expectation-maximisation finds the proportions of all languages; the
language set is then chosen by penalised likelihood: languages enter in the order of their
proportions, and the set with the best log likelihood, less half a logarithm of the number of
trigrams for each language (as in BIC), wins. The prediction is the strongest language of the set,
and the score its proportion within the set.

A background model, uniform over all trigrams, takes part in the mixture; a document of which it
explains more than half is rejected as none of the languages (``rejected``), as is one without
letters. The prediction itself is always a learned language where there is a letter.

Learning: labelled documents are drawn by a hash of their id, about ``TRAIN_DOCS`` for each
language, a bound that does not grow with the input. Counts per language are added in the tasks;
the model that goes to the executors is languages x ``BUCKETS`` numbers.

Inference works on whole texts, in Arrow batches (numpy on trigram counts).

Defined results: text null or without a letter: ``und``, score 0, rejected. No labelled documents:
every text is ``und``. A text of any length is counted whole; where two languages have equal
proportions, the first by code point is predicted. Null id: held out. Repeated rows are judged alike. An empty table gives an
empty result. :func:`keep_known` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm.scratch import Scratch, keyed, text_batches

BUCKETS = 1 << 14
#: Labelled documents drawn for each language, on average, where there are more.
TRAIN_DOCS = 3000
EM_STEPS = 12
SMOOTHING = 0.2
FOLDS = 5

_letters: np.ndarray | None = None
_folded: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first plane: is it a letter; its folded form, or a space."""
    global _letters, _folded
    if _folded is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
        folded = np.full(0x10000, 32, np.uint64)
        for i in np.flatnonzero(_letters):
            low = chr(i).lower()
            folded[i] = ord(low[0])
        _folded = folded
    return _letters, _folded


def trigrams(text: str | None) -> np.ndarray | None:
    """Hashed trigrams of the whole text; None if it has no letter."""
    if not text:
        return None
    letters, folded = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = points > 0xFFFF
    if high.any():
        wide = {int(c): (ord(chr(c).lower()[0]) if chr(c).isalpha() else 32) for c in np.unique(points[high])}
        chars = np.where(high, 32, folded[np.where(high, 0, points)])
        for c, low in wide.items():
            chars[points == c] = low
        has_letter = bool(letters[points[~high]].any()) or any(low != 32 for low in wide.values())
    else:
        chars = folded[points]
        has_letter = bool(letters[points].any())
    if not has_letter:
        return None
    chars = np.concatenate(([np.uint64(32)], chars, [np.uint64(32)]))
    repeated = (chars[1:] == 32) & (chars[:-1] == 32)
    if repeated.any():
        chars = chars[np.concatenate(([True], ~repeated))]
    if len(chars) < 3:
        chars = np.concatenate((chars, np.full(3 - len(chars), 32, np.uint64)))
    h = chars[:-2] * np.uint64(0x9E3779B97F4A7C15) + chars[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + chars[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(0)) == 0


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            if (grams := trigrams(text)) is not None:
                at = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                at += np.bincount(grams, minlength=BUCKETS)
    for lang, counts in sums.items():
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": used, "n": counts[used]})


class Model:
    """Log-free trigram probabilities of each language, the last row the background."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = counts + SMOOTHING
        self.p = np.vstack([p / p.sum(axis=1, keepdims=True), np.full((1, BUCKETS), 1.0 / BUCKETS)]) if langs else np.zeros((0, BUCKETS))

    def infer(self, text: str | None) -> tuple[str, float, float, list[str]]:
        """Prediction, score, share of the background, and the language set."""
        grams = trigrams(text)
        if grams is None or not self.langs:
            return "und", 0.0, 1.0, []
        counts = np.bincount(grams, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        n = counts[used].astype(np.float64)
        p = self.p[:, used]
        total = n.sum()
        share = np.full(len(p), 1.0 / len(p))
        for _ in range(EM_STEPS):
            held = share[:, None] * p
            new = (held * (n / held.sum(axis=0))).sum(axis=1) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        known = share[:-1]
        order = np.argsort(-known, kind="stable")
        best, chosen = -np.inf, order[:1]
        for k in range(1, len(order) + 1):
            part = np.maximum(known[order[:k]], 1e-12)
            part = part / part.sum() * (1 - share[-1])
            fit = float(n @ np.log((part[:, None] * p[order[:k]]).sum(axis=0) + share[-1] * p[-1] + 1e-300)) - 0.5 * k * np.log(total)
            if fit > best:
                best, chosen = fit, order[:k]
        part = known[chosen] / max(known[chosen].sum(), 1e-300)
        return self.langs[chosen[0]], float(min(1.0, part[0])), float(share[-1]), [self.langs[i] for i in chosen]


def train(labelled: DataFrame, docs_per_lang: int = TRAIN_DOCS) -> Model:
    """Learn from rows with ``doc_id, text, lang``; about ``docs_per_lang`` of each language."""
    usable = labelled.where("lang is not null and text is not null")
    have = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not have:
        return Model([], np.zeros((0, BUCKETS)))
    part = F.create_map(*[x for lang, n in have.items() for x in (F.lit(lang), F.lit(min(1.0, docs_per_lang / n)))])
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.where(unit < part[F.col("lang")]).select("text", "lang")
    sums = drawn.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    with text_batches(labelled.sparkSession):
        rows = sums.toPandas()  # at most languages x BUCKETS rows
    langs = sorted(set(rows["lang"]))
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in rows["lang"]], rows["bucket"].to_numpy(np.int64)] = rows["n"]
    return Model(langs, counts)


PREDICTED = "struct<lang_pred:string,score:double,background:double,languages:array<string>,rejected:boolean>"


def _predictor(model: Model):
    shared = model

    @F.pandas_udf(PREDICTED)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [shared.infer(t) for t in batch]
            yield pd.DataFrame(
                {
                    "lang_pred": [r[0] for r in rows],
                    "score": [r[1] for r in rows],
                    "background": [r[2] for r in rows],
                    "languages": [r[3] for r in rows],
                    "rejected": [r[0] == "und" or r[2] > 0.5 for r in rows],
                }
            )

    return predict


def identify(docs: DataFrame) -> tuple[Column, Model]:
    """The prediction of ``docs["text"]`` as a struct column, and the model learned from ``docs``."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return _predictor(model)(docs["text"]), model


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in one of the learned languages, all columns kept."""
    scratch = Scratch(docs.sparkSession, "language")
    rows = keyed(docs, scratch)
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    judged = rows.select(F.col("_row").alias("_gone"), _predictor(model)(F.col("_doc.text")).alias("p"))
    gone = scratch.write_texts(judged.where("p.rejected").select("_gone"), "gone")
    return rows.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select("_doc.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    predicted, _ = identify(docs)
    out = docs.select("doc_id", held_out().alias("held_out"), predicted.alias("p"))
    out = Scratch(spark, "language").write_texts(out, "predicted")
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.languages", "p.background", "p.rejected")
