"""Toxicity from class-conditional Kneser-Ney models of expressions.

Toxic and ordinary documents each have a model of expressions, spelt
as a chain of prefixes. A word of up to 12 bytes is an expression; in longer runs,
and in scripts without spaces, one begins at every character, so that every byte
of a text is in some expression. At every link the class's counts lose an absolute
discount, and the mass this frees is spread by continuation counts that both classes share: in how
many contexts (expressions before) an extension of the prefix was seen. So a rare or new form of a known stem
is judged by the stem, and one that neither class knows says nothing. An
expression's evidence is the difference of its two log-likelihoods. A document's
is the log-likelihood ratio, over all its expressions, of a text in which
``EXPECTED`` expressions are from the toxic model against one with none: the
share supposed falls as one over the length. As a ratio of likelihoods it passes
a bound in ordinary texts no more often the longer they are, while the plain mean
loses a few toxic words in a long text. A logistic curve of its inverse
hyperbolic sine, fitted on labelled rows left out of the counts, makes it a
probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean, read_table, remainder
from .words import Hasher, groups, joined, lower_ascii, mix, separators, spans

#: Bytes of the prefixes that make up the chain.
LEVELS = (2, 3, 4, 5, 6, 8, 12)
#: Characters of at least so large a first byte (three bytes or more, most unspaced scripts) begin expressions of their own.
WIDE = 0xE0
#: Each level's prefixes are counted in so many cells (bits).
CELL_BITS = 20
DISCOUNT = 1.5
#: Toxic expressions supposed in a toxic text, at most half of all; where the curve's scale turns logarithmic.
EXPECTED, BEND = 4.0, 0.25
#: Bound on labelled documents that are fitted: of each class, by least hash of the id; a quarter calibrate.
SAMPLE = 4000
THRESHOLD = 0.3


def pieces(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where expressions begin and their runs end: every run's begin; in runs longer than the last level every character; every wide character and the one after it."""
    s, e = spans(buf, table)
    edge = np.zeros(len(buf), np.int8)
    long_ = e - s > LEVELS[-1]
    edge[s[long_]], edge[e[long_]] = 1, -1
    whole = np.cumsum(edge, dtype=np.int8).view(bool)
    wide = np.flatnonzero(buf >= WIDE)
    whole[wide] = True
    whole[wide + 3 + (buf[wide] >= 0xF0)] = True
    whole &= ((buf & 0xC0) != 0x80) & ~table[buf]
    whole[s] = True
    begins = np.flatnonzero(whole)
    return begins, e[np.searchsorted(s, begins, "right") - 1]


def cells(texts: list[bytes], hasher: Hasher, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(levels x expressions) cells, and each expression's text."""
    buf, begins = joined(texts)
    buf = lower_ascii(buf)
    s, e = pieces(buf, table)
    hashed = hasher.hashes(buf, s, *(np.minimum(s + k, e) for k in LEVELS))
    for row, k in zip(hashed, LEVELS, strict=True):
        row[:] = mix(row + np.uint64(k)) >> np.uint64(64 - CELL_BITS)
    return hashed.astype(np.int32), np.searchsorted(begins, s, "right") - 1


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, held_out_modulus: int, held_out: int) -> DataFrame:
    """(id, label, fold) of at most ``SAMPLE`` rows a class. Of repeated ids the largest label counts; null ids and labels don't."""
    rows = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (remainder(id_col, held_out_modulus) != held_out))
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    )
    of = [rows.where(F.col("__label") == k).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE) for k in (0, 1)]
    return of[0].union(of[1]).withColumn("__calibrates", F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(4)) == 0)


def contexts(buf: np.ndarray, starts: np.ndarray, hasher: Hasher, table: np.ndarray) -> np.ndarray:
    """What stands before each expression: a hash of the run before its own, or, inside a run, of the byte before; 0 at the beginning."""
    s, e = spans(buf, table)
    run = np.searchsorted(s, starts, "right") - 1
    before = np.concatenate((np.zeros(1, np.uint64), hasher.hashes(buf, s, e)[0]))[run]
    inside = starts != s[run]
    before[inside] = mix(buf[starts[inside] - 1].astype(np.uint64) + np.uint64(1))
    return before


def class_counts(docs: DataFrame) -> DataFrame:
    """(level, cell, parent, ordinary, toxic, contexts) summed over documents (__text, __label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), separators(True)
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in groups(texts, 2 << 20):
                at, doc = cells(texts[i:j], hasher, table)
                buf, begins = joined(texts[i:j])
                buf = lower_ascii(buf)
                starts = pieces(buf, table)[0]
                before = contexts(buf, starts, hasher, table)
                before[np.isin(starts, begins)] = 0  # nothing is before a text
                toxic = label[i:j][doc] == 1
                for level in range(len(LEVELS)):
                    parent = at[level - 1] if level else np.zeros_like(at[0])
                    key = (parent.astype(np.uint64) << np.uint64(CELL_BITS)) | at[level].astype(np.uint64)
                    order = np.lexsort((before, key))
                    key, b, y = key[order], before[order], toxic[order]
                    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (b[1:] != b[:-1]))) if len(key) else np.empty(0, np.int64)
                    n = np.diff(np.append(first, len(key)))
                    n1 = np.add.reduceat(y.astype(np.int64), first) if len(first) else n
                    key, b = key[first].astype(np.int64), b[first].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), level, np.int32)), pa.array(key & ((1 << CELL_BITS) - 1)), pa.array(key >> CELL_BITS), pa.array(b), pa.array(n - n1), pa.array(n1)],
                        ["level", "cell", "parent", "before", "ordinary", "toxic"])

    out = docs.select("__text", "__label").mapInArrow(lean(count), "level int, cell long, parent long, before long, ordinary long, toxic long")
    each = out.groupBy("level", "cell", "parent", "before").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    return each.groupBy("level", "cell", "parent").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("contexts"))


def extended(n: np.ndarray, above: np.ndarray, parent: np.ndarray, continued: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A class's probability of each extension of its prefix, and the share of each prefix that is backed off.

    ``n``: the class's counts; ``above``: its counts of the prefixes; ``continued``: contexts of each extension, of both classes.
    """
    lost = np.bincount(parent, weights=np.minimum(n, DISCOUNT), minlength=len(above))
    back = np.where(above > 0, lost / np.maximum(above, 1), 1.0)
    shared = continued / np.bincount(parent, weights=continued, minlength=len(above))[parent]
    return np.maximum(n - DISCOUNT, 0) / np.maximum(above, 1)[parent] + back[parent] * shared, back


def compiled(counts: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level: evidence of a cell (not a number if never seen), and of an unseen cell under each parent."""
    level = counts["level"].to_numpy()
    n_cells, model = 1 << CELL_BITS, []
    above = [np.array([float(counts[c].to_numpy()[level == 0].sum())]) for c in ("ordinary", "toxic")]
    for li in range(len(LEVELS)):
        rows = counts.filter(pa.array(level == li))
        cell, parent, continued = (rows[c].to_numpy() for c in ("cell", "parent", "contexts"))
        n = [rows[c].to_numpy().astype(float) for c in ("ordinary", "toxic")]
        p, back = zip(*(extended(x, a, parent, continued.astype(float)) for x, a in zip(n, above, strict=True)), strict=True)
        seen = np.full(n_cells, np.nan, np.float32)
        seen[cell] = np.log(p[1]) - np.log(p[0])
        unseen = (np.log(np.where(back[1] > 0, back[1], 1)) - np.log(np.where(back[0] > 0, back[0], 1))).astype(np.float32)
        model.append((seen.astype(np.float16), unseen.astype(np.float16)))
        above = [np.bincount(cell, weights=x, minlength=n_cells) for x in n]
    return model


def evidence(texts: list[bytes], model, hasher: Hasher, table: np.ndarray) -> np.ndarray:
    """Each text's evidence from all its expressions; 0 without any."""
    out = np.zeros(len(texts))
    for i, j in groups(texts):
        at, doc = cells(texts[i:j], hasher, table)
        if not len(doc):
            continue
        total, known, parent = np.zeros(len(doc), np.float32), np.ones(len(doc), bool), np.zeros(len(doc), np.int32)
        for row, (seen, unseen) in zip(at, model, strict=True):
            x = seen[row].astype(np.float32)
            new = np.isnan(x)
            x[new] = unseen[parent[new]]
            total += np.where(known, x, 0)
            known &= ~new
            parent = row
        share = np.minimum(EXPECTED / np.maximum(np.bincount(doc, minlength=j - i), 1), 0.5)
        ratio = np.bincount(doc, weights=np.log1p(share[doc] * np.expm1(total.astype(float))), minlength=j - i)
        out[i:j] = np.arcsinh(ratio / BEND)
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset, by Newton's method with a small ridge; a step is halved until it gains."""
    if not len(y):
        return 0.0, -20.0
    middle, width = x.mean(), max(x.std(), 1e-9)
    design, ridge = np.stack([(x - middle) / width, np.ones_like(x)], 1), np.array([0.05, 0.01])

    def loss(w):
        z = design @ w
        return np.logaddexp(0, z).sum() - z @ y + (ridge * w * w).sum() / 2

    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), design.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / width), float(w[1] - w[0] * middle / width)


def evidence_column(docs: DataFrame, text_col: str, keep: list[str], held) -> DataFrame:
    """``keep`` columns and ``__evidence`` of each text; a text among them is sent once."""
    at = keep.index(text_col) if text_col in keep else len(keep)
    slim = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = docs.select(*keep).schema.add("__evidence", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, model = Hasher(), separators(True), held.value
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(evidence(texts, model, hasher, table))], [*keep, "__evidence"])
            del texts
        del model
        give_back()

    return slim.mapInArrow(lean(run), schema)


class ToxicityModel:
    """Fitted on ``docs`` and ``labels``; scores any documents."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 held_out_modulus: int = 4, held_out: int = 2):
        spark = docs.sparkSession
        sample = labelled_sample(labels, id_col, label_col, held_out_modulus, held_out)
        rows = sample.collect()  # at most 2 * SAMPLE
        ids = spark.createDataFrame(rows, sample.schema)
        train = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(ids), "__id")
        self.held = spark.sparkContext.broadcast(compiled(class_counts(train.where("NOT __calibrates")).toArrow()))
        fit = evidence_column(train.where("__calibrates"), "__text", ["__label"], self.held).toArrow()
        self.slope, self.offset = logistic(fit["__evidence"].to_numpy(), fit["__label"].to_numpy().astype(float))

    def score(self, docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns (default: all but the text) and score.

        Null and empty texts have no evidence and share one score. Equal texts have equal
        scores and repeated rows stay; texts of any length are read whole. Empty tables give empty results. A kept
        column named score goes: rename it first.
        """
        keep = [c for c in docs.columns if c != text_col] if keep is None else keep
        d = evidence_column(docs, text_col, keep, self.held)
        x = F.least(F.greatest(F.lit(self.slope) * F.col("__evidence") + F.lit(self.offset), F.lit(-30.0)), F.lit(30.0))
        return d.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).drop("__evidence")


def op7(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    d = ToxicityModel(docs, labels).score(docs, keep=["doc_id"])
    return d.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those the model rejects; columns as they were, whatever their names.

    Null and empty texts stay unless the model rejects texts without evidence.
    Equal texts stay or go together. Empty tables give empty results.

    The text travels through the scorer with its row, so nothing is joined back.
    """
    names = docs.columns
    d = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(names)])
    text = f"__c{names.index('text')}"
    return model.score(d, text_col=text, keep=d.columns).where(F.col("score") < threshold).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
