"""SimHash near-duplicates with pigeonring filtering.

Two fingerprints that differ in at most TAU bits, cut into M segments on a
ring, have a segment from which every chain of l consecutive segments differs
in at most floor(l * TAU / M) bits (Qin and Xiao 2018). The first chains must
therefore be equal: M / TAU - 1 segments make a join key for each start. Longer
chains prune what the key lets through, and the Hamming distance decides.

Equal fingerprints are one node from the start. Where many distinct ones share
a key, all pairs would grow with the square, so such keys are left to an exact
other way: fingerprints at most two bits apart have a common neighbour at one
bit, and each links to the least fingerprint around that neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, read_table, written
from .components import components

SHINGLE, SEED, TAU, M = 3, 42, 2, 16
WIDTH = 64 // M
#: Keys shared by more distinct fingerprints than this are linked through neighbours instead of pairs.
CROWD = 32


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes: lower-cases A-Z, parts at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    starts, ends = [0, *(gaps[: n - 1] + 1).tolist()], [*gaps[k - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # so many ones fit a byte
        ones += np.unpackbits(h[i : i + 255].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``__fp``, a long with the fingerprint's bits; 0 for null and wordless texts."""
    schema = docs.select(*keep).schema.add("__fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(len(keep)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fp.view(np.int64))], [*keep, "__fp"])

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(lean(run), schema)


def segments(x: Column, start: Column, length: int) -> Column:
    """The bits of ``length`` segments from ``start``, the ring turned so that they are lowest."""
    turn = (start * WIDTH).cast("int")
    turned = F.when(turn == 0, x).otherwise(F.call_function("shiftrightunsigned", x, turn).bitwiseOR(F.call_function("shiftleft", x, F.lit(64) - turn)))
    bits = length * WIDTH
    return turned if bits == 64 else turned.bitwiseAND(F.lit((1 << bits) - 1))


def links(fps: DataFrame) -> DataFrame:
    """(a, b) that connect all distinct fingerprints within TAU bits; ``fps``: (fp), distinct."""
    lead = M // TAU - 1
    keys = fps.select("fp", F.explode(F.array(*[F.lit(i) for i in range(M)])).alias("start"))
    keys = keys.withColumn("key", segments(F.col("fp"), F.col("start"), lead))
    sizes = keys.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keys.join(sizes, ["start", "key"]), "simhash-keys")
    few, many = shared.where(F.col("n") <= CROWD).drop("n"), shared.where(F.col("n") > CROWD).select("fp").distinct()
    a, b = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    chains = (F.col("a") < F.col("b")) & (F.bit_count(diff) <= TAU)
    for length in range(M - 1, lead, -1):  # evaluated shortest first
        chains = (F.bit_count(segments(diff, a["start"], length)) <= length * TAU // M) & chains
    pairs = a.join(b, (a["start"] == b["start"]) & (a["key"] == b["key"]) & chains).select("a", "b")
    bits = F.array(F.lit(0), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)) for i in range(64)])
    near = many.select("fp", F.explode(F.transform(bits, lambda x: F.col("fp").bitwiseXOR(x))).alias("at"))
    centre = near.groupBy("at").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    around = near.join(centre, "at").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(around).distinct()


def grouped(d: DataFrame, least: Column) -> tuple[DataFrame, DataFrame]:
    """(fp, component) of each distinct ``__fp`` of ``d``, and (component, least): the least value of ``least`` in each component."""
    fps = written(d.groupBy(F.col("__fp").alias("fp")).agg(F.min(least).alias("least")), "simhash-distinct")
    of = components(links(fps.select("fp")))
    group = fps.join(of, fps["fp"] == of["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    return group.select("fp", "component"), group.groupBy("component").agg(F.min("least").alias("least"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: the id), ``__fp`` and ``__class``, the least id reachable over links.

    Null and wordless texts have fingerprint 0 and are linked by it like any
    other. Null ids are never the least unless a class has no other. Repeated
    rows stay. Empty tables give empty results.
    """
    keep = [id_col] if keep is None else keep
    d = written(with_fingerprint(docs, text_col, keep), "simhash")
    group, least = grouped(d, F.col(id_col))
    named = group.join(least, "component").select(F.col("fp").alias("__fp"), F.col("least").alias("__class"))
    return d.join(named, "__fp")


def op9(spark, sf_dir):
    d = classes(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__class").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: of least id, null ids last, and then of least digest of the text; columns as they were.

    Of rows that repeat that id and text, one stays. An id stays more than once
    if texts of different classes have it.
    """
    digest = F.coalesce(F.md5(docs["text"].cast("binary")), F.lit(""))
    d = written(with_fingerprint(docs.select("doc_id", "text", digest.alias("__digest")), "text", ["doc_id", "__digest"]), "simhash")
    least = grouped(d, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__digest").alias("digest")))[1]
    kept = least.select(F.col("least.id").alias("__id"), F.col("least.digest").alias("__digest"))
    d = docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]) & (digest == kept["__digest"]), "left_semi")
    repeated = d.groupBy("doc_id", digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return d.dropDuplicates(["doc_id", "text"]) if repeated else d
