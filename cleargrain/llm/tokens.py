"""Token ids of documents in files of patched frame-of-reference blocks."""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleargrain.llm.common import keep_one, partitions
from cleargrain.session import staged_path

BLOCK = 128  # ids of a block
PERCENTILE = 0.9  # share of a block's values that its width has to hold; the others are exceptions
SEGMENT = 1 << 16  # ids after which a segment ends; it holds whole documents
CACHED = 1_000_000  # words and other runs whose ids a worker remembers
_MAGIC = 0x31424650

SEGMENT_SCHEMA = "part int, seq int, first bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """Ids as blocks: header (magic, block size, number of ids), starts of the blocks, blocks.

    A block is its minimum (u32), the width in bits (u8), the number of exceptions (u8), the low ``width`` bits of every
    value less the minimum, and the exceptions' positions (u8 each) and full differences (u32 each).
    """
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    head = np.array([_MAGIC, BLOCK, n], "<u4").tobytes()
    if not n:
        return head
    values = np.full(blocks * BLOCK, ids[-1], np.uint32)
    values[:n] = ids
    values = values.reshape(blocks, BLOCK)
    low = values.min(axis=1)
    rest = values - low[:, None]
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = _bits(np.partition(rest, rank, axis=1)[:, rank])
    odd = _bits(rest) > width[:, None]
    n_odd = odd.sum(axis=1)
    size = 6 + BLOCK // 8 * width + 5 * n_odd
    start = np.concatenate(([0], np.cumsum(size)))
    body = np.zeros(start[-1], np.uint8)
    at = start[:-1, None]
    body[at + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(blocks, 4)
    body[at[:, 0] + 4], body[at[:, 0] + 5] = width, n_odd
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        bits = (rest[own, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
        body[at[own] + 6 + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
    block, place = np.nonzero(odd)
    turn = np.arange(len(block)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    where = start[block] + 6 + BLOCK // 8 * width[block]
    body[where + turn] = place
    body[(where + n_odd[block] + 4 * turn)[:, None] + np.arange(4)] = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return head + start[:-1].astype("<u4").tobytes() + body.tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (excluded) of a packed segment; all by default."""
    magic, block, n = np.frombuffer(payload, "<u4", 3)
    if magic != _MAGIC:
        raise ValueError("not a token segment")
    blocks = -(-int(n) // int(block))
    last = blocks if last is None else min(last, blocks)
    if last <= first:
        return np.zeros(0, np.uint32)
    block = int(block)
    start = np.frombuffer(payload, "<u4", blocks, 12).astype(np.int64)[first:last]
    body = np.frombuffer(payload, np.uint8, offset=12 + 4 * blocks)
    low = body[start[:, None] + np.arange(4)].view("<u4")[:, 0]
    width, n_odd = body[start + 4].astype(np.int64), body[start + 5].astype(np.int64)
    rest = np.zeros((len(start), block), np.uint32)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(body[start[own, None] + 6 + np.arange(block // 8 * w)], axis=1, bitorder="little")
        for k in range(int(w)):
            rest[own] |= bits.reshape(len(own), block, w)[:, :, k].astype(np.uint32) << np.uint32(k)
    own = np.repeat(np.arange(len(start)), n_odd)
    turn = np.arange(len(own)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    where = start[own] + 6 + block // 8 * width[own]
    rest[own, body[where + turn]] = body[(where + n_odd[own] + 4 * turn)[:, None] + np.arange(4)].view("<u4")[:, 0]
    return (rest + low[:, None]).ravel()[: int(n) - first * block if last == blocks else None]


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths; exact, as 32-bit integers have exact doubles."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


# Classes of bytes for Encoder: letters, digits, signs, and white space and others, beside which no text is cut. Text is
# cut between classes without a common bit.
_LETTER, _DIGIT, _SIGN, _SPACE, _OTHER = 1, 2, 4, 7, 7
_CLASS = np.full(256, _OTHER, np.uint8)
for _class, _bytes in ((_SPACE, b" \t\n\v\f\r"), (_DIGIT, string.digits.encode()), (_SIGN, string.punctuation.encode()), (_LETTER, string.ascii_letters.encode())):
    _CLASS[list(_bytes)] = _class


class Encoder:
    """Ids of a text by the tokenizers library, with an end id.

    A vocabulary that ignores white space splits texts at it before anything else, and letters, digits and signs from each
    other. The library is therefore asked once for each distinct piece of UTF-8 text between such borders, many pieces at a
    time, and the answers are remembered; pieces that differ in the case of A-Z are one if the vocabulary ignores it. Texts with characters beyond U+023F (marks that compose, other scripts) or
    special tokens are encoded whole, and so are all texts if the vocabulary does not split like that.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.known = np.uint32(end_id).tobytes(), {}
        probe = "a b\nc9\td,  e's"
        self.splits = self._ids(probe) == b"".join(map(self._ids, ["a", "b", "c", "9", "d", ",", "e", "'s"]))
        self.lowers = all(self._ids(x) == self._ids(x.lower()) for x in (string.ascii_uppercase, " ".join(string.ascii_uppercase)))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _pieces(data: bytes) -> list[bytes]:
        """``data`` cut at white space and at borders of letters, digits and signs. Latin-1 letters are letters; there is
        no border behind an apostrophe, which may belong to the letters that follow."""
        text = np.frombuffer(data, np.uint8)
        kind = _CLASS[text]
        if not data.isascii():
            lead = text[:-1] == 0xC3
            kind[:-1][lead] = np.where((text[1:][lead] == 0x97) | (text[1:][lead] == 0xB7), _OTHER, _LETTER)
            kind[1:][lead] = kind[:-1][lead]
        here, there = kind[:-1], kind[1:]
        cuts = np.flatnonzero(((here & there) == 0) & (text[:-1] != 0x27)) + 1
        out = np.full(len(text) + len(cuts), 0x20, np.uint8)
        inside = np.ones(len(out), bool)
        inside[cuts + np.arange(len(cuts))] = False
        out[inside] = text
        return out.tobytes().split()

    def _learn(self, new: list[bytes]) -> None:
        words = [p.decode() for p in new]
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        ids = np.array(got.ids, "<u4").tobytes()
        cuts = (4 * np.searchsorted(np.array([o[0] for o in got.offsets], np.int64), starts)).tolist()
        self.known.update((p, ids[a:b]) for p, a, b in zip(new, cuts, cuts[1:]))

    def __call__(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids; null counts as empty."""
        text = text or ""
        data, known = text.encode("utf-8", "surrogatepass"), self.known
        # below U+0240 no byte of the UTF-8 form is above 0xC8
        if not data or not self.splits or b"<|" in data or (not data.isascii() and np.frombuffer(data, np.uint8).max() > 0xC8):
            return self._ids(text) + self.end
        if len(known) > CACHED:
            known.clear()
        pieces = self._pieces(data.lower() if self.lowers else data)  # bytes: A-Z only
        ids = list(map(known.get, pieces))
        if None in ids:
            gaps = [i for i, x in enumerate(ids) if x is None]
            self._learn(list({pieces[i] for i in gaps}))
            for i in gaps:
                ids[i] = known[pieces[i]]
        ids.append(self.end)
        return b"".join(ids)


def _encoder(path: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a worker."""
    return keep_one(("encoder", path, end_id), lambda: Encoder(path, end_id))


def _segments(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, first = _encoder(path, end_id), TaskContext.get().partitionId(), 0, 0
        doc_ids, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(texts), "<u4")
            row = [part, seq, first, doc_ids, [len(t) // 4 for t in texts], pack(ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        names = ["part", "seq", "first", "doc_ids", "lengths", "payload"]
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                texts.append(encode(text.as_py()))
                size += len(texts[-1]) // 4
                if size >= SEGMENT:
                    yield close()
                    doc_ids, texts, seq, first, size = [], [], seq + 1, first + size, 0
        if doc_ids:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None) -> None:
    """Encode (doc_id, text) and write the ids in ascending doc_id order.

    ``parts`` ranges of doc_id become one stored file each at least, numbered by ``part``; a row is a segment of about
    2^16 ids with the ids and lengths of its documents, and ``first`` counts the ids of its part before it. Null ids come
    first, rows with equal ids are ordered by their text's hash. Other columns are not read.
    """
    n = parts or partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text"), F.monotonically_increasing_id())
    ordered = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(_segments(tokenizer, end_id), SEGMENT_SCHEMA).write.parquet(path)


def open_segments(spark: SparkSession, path: str) -> DataFrame:
    """Written segments with ``start``: the number of all ids before the segment."""
    rows = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # one row per part: as many as write_tokens was told to make
    sizes = rows.select("part", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("first")).drop("base")


def _documents(digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, lengths, payload in zip(*(batch.column(c) for c in ("start", "doc_ids", "lengths", "payload"))):
                ids, sizes = unpack(payload.as_py()).astype("<u4"), np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(sizes)
                own = [ids[e - s : e] for s, e in zip(sizes, ends)]
                last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digest else pa.array(own, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.as_py(), pa.int64()), pa.array(start.as_py() + ends - sizes), pa.array(sizes), last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in written files."""
    return open_segments(spark, path).mapInArrow(_documents(False), "doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the ids of all documents, read the files back and return (doc_id, start, n_tokens, ids_crc32).

    A null or empty text is the end id alone. An empty table gives an empty result.
    """
    path = staged_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    segments = open_segments(docs.sparkSession, path)
    return segments.mapInArrow(_documents(True), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
