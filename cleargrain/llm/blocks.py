"""Documents in compressed blocks: what the operators on shared text send between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ID = -(1 << 63)  # a null doc_id, smaller than any other
Batches = Iterator[pa.RecordBatch]
_PLACE = np.uint64((1 << 24) - 1)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Where each window of ``width`` hashes has its smallest one, the leftmost of equals; fewer than 2^24 hashes.

    Hashes are compared by their upper 40 bits.
    """
    least, span = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return (least & _PLACE).astype(np.int64)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x.as_py()) for x in batch.column("z")]


def compress(batches: Batches) -> Batches:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = pa.array([pack.compress(x.as_py()) for x in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), batch.column("text_key"), z], ["doc_id", "k", "text_key", "z"])


def byte_rows(docs: DataFrame) -> DataFrame:
    """doc_id, k (doc_id, or the smallest integer for null), text_key and text as bytes."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("text_key"), F.encode(text, "UTF-8").alias("text"))


def packed_rows(docs: DataFrame) -> DataFrame:
    """The rows with compressed texts, which is how texts are shuffled."""
    return byte_rows(docs).mapInArrow(compress, "doc_id bigint, k bigint, text_key bigint, z binary")


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer, the document of each byte, and where each document starts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(len(texts), dtype=np.int32), sizes), np.cumsum(sizes) - sizes


def to_batch(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows)] or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))


def schema_of(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{n} {({pa.int32(): 'int', pa.int64(): 'bigint'}).get(t, 'binary')}" for n, t in kinds.items())


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(own):
            yield int(bucket[own[0]]), own


def grouped(batches: Batches, names: list[str]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Rows of each bucket, from batches that are sorted by it."""
    bucket, rows = None, []
    for batch in batches:
        for b, *row in zip(batch.column("bucket").to_pylist(), *(batch.column(n) for n in names)):
            if b != bucket and rows:
                yield bucket, rows
                rows = []
            bucket = b
            rows.append([x.as_py() for x in row])
    if rows:
        yield bucket, rows


def dealt(content: str) -> Column:
    return F.when(F.col("bucket") < 0, F.xxhash64("ids", content)).otherwise(F.xxhash64("bucket"))
