"""Chunks: the texts of many documents packed in one row, for work that is vectorised over bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, lean

#: Bytes of a chunk; a longer text has one of its own.
CHUNK = 4 << 20
#: Stands for a null id: larger than any other.
NO_ID = (1 << 63) - 1


def packed_chunks(docs: DataFrame, keep: list[str], text_col: str, id_col: str) -> DataFrame:
    """(chunk, n_bytes, ids, sizes, blob, rest): texts of about ``CHUNK`` bytes together; a null text has size -1, a null id the largest."""
    names = [f"k{i}" for i in range(len(keep))]
    d = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    rest = d.select(*names).schema
    schema = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("blob", T.BinaryType()), T.StructField("rest", T.ArrayType(rest))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=5)
        ids, sizes, texts, kept, size = [], [], [], [], 0

        def row():
            struct_ = pa.concat_arrays(kept)
            lists = pa.ListArray.from_arrays(pa.array([0, len(struct_)], pa.int32()), struct_)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([size], pa.int64()), *(pa.array([b], pa.binary()) for b in (np.array(ids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), squeeze.compress(b"".join(texts)))), lists], schema.fieldNames())

        for batch in batches:
            fields = pa.StructArray.from_arrays(batch.columns[: len(names)], names=names)
            at = 0
            for i, (id_, text) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
                if size and size + len(raw) > CHUNK:
                    kept.append(fields.slice(at, i - at))
                    yield row()
                    ids, sizes, texts, kept, size, at = [], [], [], [], 0, i
                    give_back()
                ids.append(id_)
                sizes.append(-1 if text is None else len(raw))
                texts.append(raw)
                size += len(raw)
            kept.append(fields.slice(at))
        if ids:
            yield row()
        ids, sizes, texts, kept = [], [], [], []
        give_back()

    return d.mapInArrow(lean(pack), schema)


def opened(blob: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.frombuffer(sizes, np.int64), 0)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob) if n.sum() else b"", np.uint8), np.concatenate(([0], np.cumsum(n)))


def range_bits(chunks: DataFrame, size: int) -> int:
    """Bits that name a range of hashes, so that one stands for about ``size`` bytes of text, whatever the input."""
    n = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(4, (max(1, n // size) - 1).bit_length())
