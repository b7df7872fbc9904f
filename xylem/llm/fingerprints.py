"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A sketch holds, per cell, how many paragraphs fell there and the exclusive or
of their digests and of the digests' checks. Two sketches of a size subtract
cell by cell; peeling cells that hold one digest recovers the paragraphs on
which two versions differ. If peeling stalls, both are sketched again larger.
A fingerprint is the smallest sketch; the n-th repeat of a paragraph has its own digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, parts, read_table

#: Cells in each of a sketch's three parts, and how much larger the next try is.
FIRST, GROWTH = 4, 8
#: Paragraphs end with a sentence or line; longer ones are cut.
PARAGRAPH = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")
LONGEST = 400
_LOW = (1 << 64) - 1
_LOWEST_ID = -(1 << 63)


def paragraphs(text: str) -> list[str]:
    out = PARAGRAPH.findall(text)
    if any(len(p) > LONGEST for p in out):
        out = [p[i : i + LONGEST] for p in out for i in range(0, len(p), LONGEST)]
    return out


def digests(text: str) -> list[int]:
    """Distinct 64-bit digests, one a paragraph."""
    seen: dict[int, int] = {}
    for p in paragraphs(text):
        d = xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass"))
        while d in seen:  # a repeat: the digest of the digest and of how often it came before
            seen[d] += 1
            d = xxhash.xxh3_64_intdigest(struct.pack("<QQ", d, seen[d]))
        seen[d] = 0
    return list(seen)


def check(d: int) -> int:
    return (d * 0x9E3779B97F4A7C15 & _LOW) >> 32


class Sketch:
    __slots__ = ("m", "count", "key", "mark")

    def __init__(self, keys: list[int], m: int) -> None:
        self.m, n = m, 3 * m
        count, key, mark = [0] * n, [0] * n, [0] * n
        for d in keys:
            c = (d * 0x9E3779B97F4A7C15 & _LOW) >> 32
            for i in (d % m, m + (d >> 21) % m, 2 * m + (d >> 42) % m):
                count[i] += 1
                key[i] ^= d
                mark[i] ^= c
        self.count, self.key, self.mark = count, key, mark

    def text(self) -> str:
        n = 3 * self.m
        return base64.b64encode(struct.pack(f"<{n}I{n}Q{n}I", *self.count, *self.key, *self.mark)).decode()

    def differences(self, other: Sketch) -> list[int] | None:
        """Digests that only one of the two holds, or None if peeling stalls."""
        m = self.m
        count = [a - b for a, b in zip(self.count, other.count, strict=True)]
        key = [a ^ b for a, b in zip(self.key, other.key, strict=True)]
        mark = [a ^ b for a, b in zip(self.mark, other.mark, strict=True)]
        todo = [i for i, c in enumerate(count) if c in (1, -1)]
        found = []
        while todo:
            i = todo.pop()
            c, d = count[i], key[i]
            if c not in (1, -1) or mark[i] != check(d):
                continue
            found.append(d)
            k = mark[i]
            for j in (d % m, m + (d >> 21) % m, 2 * m + (d >> 42) % m):
                count[j] -= c
                key[j] ^= d
                mark[j] ^= k
                if count[j] in (1, -1):
                    todo.append(j)
        return None if any(count) or any(key) else found


class Version:
    """A text's digests and its sketches by size, made when first needed."""

    def __init__(self, text: str) -> None:
        self.digests, self.sketches = digests(text), {}

    def sketch(self, m: int) -> Sketch:
        if m not in self.sketches:
            self.sketches[m] = Sketch(self.digests, m)
        return self.sketches[m]

    def likeness(self, other: Version) -> float:
        """Shared paragraphs over all paragraphs of both; 1 if both are empty."""
        a, b, m = len(self.digests), len(other.digests), FIRST
        while (diff := self.sketch(m).differences(other.sketch(m))) is None:
            m *= GROWTH
        return (a + b - len(diff)) / (a + b + len(diff)) if a + b else 1.0


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(slot, last, key, id, text), each slot a run of descending ids in order, then (last) the document that follows it.

    Ids are cut into slots by approximate quantiles; only each slot's first id
    and text go to the slot before. Null ids come last; equal ids by text, nulls first.
    """
    n_slots = 16 * parts(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.coalesce(F.col("id").cast("bigint"), F.lit(_LOWEST_ID)))
    cuts = d.agg(F.percentile_approx("key", [i / n_slots for i in range(1, n_slots)], 100 * n_slots)).first()[0] or []
    cuts = sorted(set(cuts))
    slot = F.lit(len(cuts)) - F.array_position(F.transform(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>"), lambda c: F.col("key") <= c), F.lit(True)).cast("int")
    # array_position is 1 for the smallest ids and 0 for those above every cut
    slot = F.when(slot == len(cuts), F.lit(-1)).otherwise(slot)
    d = d.withColumn("slot", slot)
    heads = sorted(d.groupBy("slot").agg(F.max("key").alias("key")).collect())  # one row a slot
    before = {h["key"]: heads[i - 1]["slot"] for i, h in enumerate(heads)}
    first = d.where(F.col("key").isin(list(before))).groupBy("slot", "key").agg(F.min(F.struct(F.col("text").isNotNull(), "text")).alias("t"))
    at = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None).cast("map<bigint,int>")
    ahead = first.select(at[F.col("key")].alias("slot"), F.lit(True).alias("last"), "key", F.lit(None).cast(d.schema["id"].dataType).alias("id"), F.col("t.text").alias("text"))
    both = d.select("slot", F.lit(False).alias("last"), "key", "id", "text").unionByName(ahead)
    return both.repartition(parts(docs.sparkSession), "slot").sortWithinPartitions("slot", "last", F.col("key").desc(), F.col("text").asc_nulls_first())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and likenesses.

    A null text is empty; an only document is its own next one; repeated rows
    each get a row. Other columns are ignored.
    """
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    rows = with_next(docs, id_col, text_col)
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("n_chars", LongType()), *[StructField(c, StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        held = None  # the row whose next is still to come
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for last, id_, text in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                text = text or ""
                version = Version(text)
                if held:
                    before, mine, theirs = held
                    k = len(mine) // 2
                    edited = mine[: len(mine) - k] + text[:k]
                    changed = Version(edited)
                    for column, value in zip(out, (before, len(mine), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), theirs.sketch(FIRST).text(), changed.sketch(FIRST).text(), theirs.likeness(changed), theirs.likeness(version)), strict=True):
                        column.append(value)
                held = None if last else (id_, text, version)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (batch.schema.field(3).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)

    return rows.mapInArrow(lean(run), schema)


def op2(spark, sf_dir):
    return fingerprints(read_table(spark, sf_dir, "documents"))
