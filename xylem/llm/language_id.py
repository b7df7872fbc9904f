"""Language identification by multilingual mixture inference.

A document is a mixture of languages, each a distribution over letter trigrams.
Expectation-maximisation estimates its proportions from the trigrams'
likelihoods; languages are then dropped while a likelihood penalised by the
number of languages rises. The prediction is the largest remaining share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, read_table, remainder

BITS = 15
STEPS = 12
#: Cost of each language beyond the first, times the logarithm of the trigrams.
PENALTY = 3.0
SMOOTHING = 0.5


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str, letters: np.ndarray) -> np.ndarray:
    """Counts of the text's letter trigrams, words padded with a space, by hashed cell."""
    points = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters[points], points, np.uint32(32))
    inner = points[1:-1] != 32
    h = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA6B) + points[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.bincount((h >> np.uint32(32 - BITS))[inner], minlength=1 << BITS)


def shares(counts: np.ndarray, likelihood: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log-likelihood they give."""
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    total = counts.sum()
    if likelihood.shape[1] > 1:
        for _ in range(STEPS):
            share = share * (likelihood.T @ (counts / (likelihood @ share))) / total
    return share, float(counts @ np.log(likelihood @ share))


def infer(counts: np.ndarray, likelihood: np.ndarray) -> tuple[int, float]:
    """Index and share of the main language of a document with any letters."""
    cell = np.flatnonzero(counts)
    n, p = counts[cell].astype(np.float64), likelihood[cell]
    cost = PENALTY * np.log(n.sum() + 1)
    share, best = shares(n, p)
    chosen = np.arange(p.shape[1])
    order = np.argsort(-share, kind="stable")
    alone = float(n @ np.log(p[:, order[0]]))
    if alone > best - cost * (len(chosen) - 1):  # the usual case: one language explains it
        lead = order[:1]
        if len(order) == 1 or best - alone < cost:
            return int(lead[0]), 1.0
    while len(chosen) > 1:
        least = chosen[np.argmin(share)]
        rest = chosen[chosen != least]
        s, ll = shares(n, p[:, rest])
        if best - ll > cost:
            break
        chosen, share, best = rest, s, ll
    k = int(np.argmax(share))
    return int(chosen[k]), float(share[k])


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, cell, n) over all of (text, lang); a task keeps one table a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        letters = letter_table()
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    n = trigrams(text, letters)
                    tables[lang] = tables[lang] + n if lang in tables else n
        for lang, n in tables.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(n[cell])], ["lang", "cell", "n"])

    return docs.mapInArrow(lean(count), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Trigram likelihoods of every language of ``docs``; null languages and texts teach nothing."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang"):
        rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
        t = trigram_counts(rows).toArrow()  # at most 2**BITS rows a language
        langs = sorted(set(t["lang"].to_pylist()))
        n = np.zeros((1 << BITS, len(langs)))
        at = {lang: i for i, lang in enumerate(langs)}
        np.add.at(n, (t["cell"].to_numpy(), [at[x] for x in t["lang"].to_pylist()]), t["n"].to_numpy())
        n += SMOOTHING
        self.held = docs.sparkSession.sparkContext.broadcast((langs, n / n.sum(0) if langs else n))

    def predict(self, docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """``keep`` columns, lang_pred and score. Null texts and texts without a letter are ``und`` with score 0, as is all if nothing was learned. Kept columns of those names are replaced."""
        held, keep = self.held, [c for c in keep if c not in ("lang_pred", "score")]
        schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, likelihood = held.value
            letters = letter_table()
            for batch in batches:
                lang, score = [], []
                for text in batch.column(len(keep)).to_pylist():
                    counts = trigrams(text, letters) if text and langs else None
                    if counts is None or not counts.any():
                        lang.append("und")
                        score.append(0.0)
                    else:
                        k, share = infer(counts, likelihood)
                        lang.append(langs[k])
                        score.append(min(1.0, share))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

        return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(lean(run), schema)


def op1(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = remainder("doc_id", 3) == 1
    d = LanguageModel(docs.where(~out)).predict(docs, ["doc_id"])
    return d.select("doc_id", out.alias("held_out"), "lang_pred", "score")
