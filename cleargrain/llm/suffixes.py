"""Removal of byte strings that repeat an earlier document, by suffix arrays of shared text.

Four steps, each a Spark stage over blocks of documents:

1. Every string of LENGTH bytes has a minimiser: of its SEED-byte strings the one with the smallest hash, the leftmost of
   equals. Equal strings have equal minimisers, so only strings whose minimiser occurs in several documents can repeat.
2. Minimiser hashes meet by hash; a document learns which of its own are shared.
3. Runs of strings with one shared minimiser are cut out and meet by its hash. There a suffix array orders them, common
   prefixes of neighbours of LENGTH bytes or more make groups, and the smallest doc_id of each group is known.
4. What a smaller doc_id has too is removed from the texts.

A block of documents sends each hash and each run once, from the smallest doc_id that has it, and decides about its other
documents by itself. So what meets at one hash grows with the number of blocks, not with the number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.blocks import Batches, by_bucket, byte_rows, dealt, grouped, joined, packed_rows, schema_of, texts_of, to_batch, window_minima
from cleargrain.llm.common import partitions

LENGTH = 50
SEED = 16
_WIDTH = LENGTH - SEED + 1  # seeds of a string
_CHUNK = 1 << 20  # bytes that are hashed at a time
LEAST_TASKS, LEAST_BUCKETS = 12, 64  # tasks in which hashes meet and buckets of runs, at least
RUN_BYTES, HASH_BYTES = 1 << 22, 1 << 26  # bytes of documents for each bucket of runs and of hashes


def _words(buffer: np.ndarray, at: np.ndarray | None = None, order: str = "<") -> np.ndarray:
    """The 8 bytes from each position on (from every position without ``at``) as unsigned integers."""
    view = np.ndarray((max(0, len(buffer) - 7),), f"{order}u8", np.ascontiguousarray(buffer), strides=(1,))
    return view if at is None else view[at].astype(np.uint64)


def seed_runs(text: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the minimiser, first position and length of each maximal run of strings that have it at one place.

    ``owner`` is nondecreasing and names the document of each byte; strings that cross documents are left out.
    """
    out = []
    for begin in range(0, max(0, len(text) - LENGTH + 1), _CHUNK):
        part = text[begin : begin + _CHUNK + LENGTH - 1]
        words = _words(part)
        n = len(part) - SEED + 1
        h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h = (h ^ words[8 : 8 + n]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        place = window_minima(h, _WIDTH)
        whole = owner[begin : begin + len(place)] == owner[begin + LENGTH - 1 : begin + LENGTH - 1 + len(place)]
        place[~whole] = -1
        first = np.flatnonzero(np.diff(place, prepend=-2))
        size = np.diff(first, append=len(place))
        kept = place[first] >= 0
        out.append((h[place[first[kept]]], begin + first[kept], size[kept]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def two_stage_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions ``wanted`` (ascending) in the order of their suffixes, which is exact for the first 56 bytes.

    Only suffixes that are smaller than their successor are sorted directly, by their first 56 bytes. A suffix larger than
    its successor follows from it: buckets of one first byte are scanned in order, and each suffix met puts the one before
    it at the end of what its own bucket has so far. Larger suffixes come first in a bucket, sorted ones behind them.
    """
    n = len(text)
    text = np.concatenate((text, [255], np.zeros(64, np.uint8))).astype(np.uint8)  # 255 is in no UTF-8 text
    differs = text[:-1] != text[1:]
    next_change = np.where(differs, np.arange(len(differs)), len(differs) - 1)
    next_change = np.minimum.accumulate(next_change[::-1])[::-1]
    rises = text[next_change] < text[next_change + 1]  # smaller than the successor
    rises[n] = True
    # every larger suffix needs its successors up to the next smaller one
    taken = np.zeros(n + 1, bool)
    taken[wanted] = True
    next_rise = np.minimum.accumulate(np.where(rises[: n + 1], np.arange(n + 1), n)[::-1])[::-1]
    depth = np.zeros(n + 2, np.int32)
    np.add.at(depth, wanted, 1)
    np.add.at(depth, next_rise[wanted] + 1, -1)
    taken |= np.cumsum(depth)[: n + 1] > 0
    direct = np.flatnonzero(taken & rises[: n + 1])
    keys = [_words(text, direct + o, ">") for o in range(48, -1, -8)]
    direct = direct[np.lexsort(keys)]
    induced = taken & ~rises[: n + 1]
    by_byte = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in range(256):
        here, fresh = [], np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(fresh):
            here.append(fresh)
            before = fresh[fresh > 0] - 1
            fresh = before[induced[before] & (text[before] == c)]
        here.append(direct[by_byte[c] : by_byte[c + 1]])
        bucket = np.concatenate(here)
        if not len(bucket):
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] != c)]
        if len(before):
            first = text[before]
            before = before[np.argsort(first, kind="stable")]
            cuts = np.flatnonzero(np.diff(text[before])) + 1
            for group in np.split(before, cuts):
                waiting[text[group[0]]].append(group)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    asked = np.zeros(n + 1, bool)
    asked[wanted] = True
    return order[asked[order]]


def smallest_owner(text: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For the string of LENGTH bytes at each of ``starts`` (ascending): the smallest owner of an equal one."""
    order = two_stage_order(text, starts)
    if not len(order):
        return np.zeros(0, np.int64)
    same = np.ones(len(order) - 1, bool)  # common prefix with the next in order is LENGTH bytes or more
    for o in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        x = _words(text, order + o)
        same &= x[1:] == x[:-1]
    group = np.concatenate(([0], np.cumsum(~same)))
    at = np.searchsorted(starts, order)
    first = np.concatenate(([0], np.flatnonzero(~same) + 1))
    out = np.empty(len(starts), np.int64)
    out[at] = np.minimum.reduceat(owner[at], first)[group]
    return out


_HASHES = {"bucket": pa.int32(), "ids": pa.binary(), "h": pa.binary(), "d": pa.binary()}
_FLAGS = {"k": pa.int64(), "h": pa.binary()}
_RUNS = {"bucket": pa.int32(), "ids": pa.binary(), "z": pa.binary(), "size": pa.binary(), "d": pa.binary(), "at": pa.binary()}
_SPANS = {"k": pa.int64(), "text_key": pa.int64(), "spans": pa.binary()}


def _send_hashes(buckets: int) -> Callable[[Batches], Batches]:
    """Blocks of minimiser hashes per bucket; what a batch itself finds in two documents goes to bucket -1 as decided."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = np.array(batch.column("k").to_pylist(), np.int64)
            text, owner, _ = joined([x.as_py() for x in batch.column("text")])
            h, at, _ = seed_runs(text, owner)
            # distinct (hash, document) pairs, the smallest doc_id of each hash first
            d = owner[at]
            order = np.lexsort((ids[d], h))
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[new], d[new]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            group = np.cumsum(first) - 1
            last = np.concatenate((np.flatnonzero(first)[1:], [len(h)])) - 1 if len(h) else np.zeros(0, np.int64)
            met = (ids[d[first]] != ids[d[last]])[group] if len(h) else np.zeros(0, bool)
            rows = []
            for decided, chosen in ((True, np.flatnonzero(met)), (False, np.flatnonzero(first))):
                chosen = chosen[np.argsort(d[chosen], kind="stable")]
                to = np.full(len(chosen), -1) if decided else (h[chosen] % np.uint64(buckets)).astype(np.int64)
                for bucket, own in by_bucket(to):
                    own_d, index = np.unique(d[chosen[own]], return_inverse=True)
                    rows.append((bucket, ids[own_d].tobytes(), (h[chosen[own]] >> np.uint64(32)).astype("<u4").tobytes(), index.astype("<u4").tobytes()))
            yield to_batch(_HASHES, rows)

    return run


def _flag_rows(ids: np.ndarray, h: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(ids, kind="stable")
    ids, h = ids[order], h[order]
    cuts = np.concatenate((np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)), [len(ids)])) if len(ids) else [0]
    return [(int(ids[a]), h[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:])]


def _shared(batches: Batches) -> Batches:
    """(k, hashes) of the documents whose hash is also in one with another doc_id."""
    for bucket, rows in grouped(batches, ["ids", "h", "d"]):
        if bucket < 0:  # decided by the sender
            for ids, h, d in rows:
                yield to_batch(_FLAGS, _flag_rows(np.frombuffer(ids, np.int64)[np.frombuffer(d, "<u4")], np.frombuffer(h, "<u4")))
            continue
        ids = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(d, "<u4")] for i, _, d in rows])
        h = np.concatenate([np.frombuffer(x, "<u4") for _, x, _ in rows])
        order = np.argsort(h, kind="stable")
        ids, h = ids[order], h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        shared = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        own = np.repeat(shared, np.diff(first, append=len(h)))
        if own.any():
            yield to_batch(_FLAGS, _flag_rows(ids[own], h[own]))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Union of (start, end) rows as maximal runs."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:], [len(spans)])) - 1
    return np.stack((spans[new, 0], reach[last]), axis=1)


def _span_rows(k: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple]:
    order = np.lexsort((start, key, k))
    k, key, spans = k[order], key[order], np.stack((start, end), axis=1)[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (key[1:] != key[:-1])
    cuts = [*np.flatnonzero(new), len(k)]
    return [(int(k[a]), int(key[a]), _merged(spans[a:b]).astype("<i8").tobytes()) for a, b in zip(cuts, cuts[1:])]


def _send_runs(buckets: int) -> Callable[[Batches], Batches]:
    """Runs of strings with a shared minimiser per bucket; each distinct run once per batch, from the smallest doc_id.

    Other documents of the batch with the same run repeat it for certain; their spans go to bucket -1 as decided.
    """

    def run(batches: Batches) -> Batches:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = np.array(list(zip(batch.column("k").to_pylist(), batch.column("text_key").to_pylist())), np.int64).reshape(-1, 2)
            texts = texts_of(batch)
            text, owner, base = joined(texts)
            data = text.tobytes()
            h, at, size = seed_runs(text, owner)
            d = owner[at].astype(np.uint64)
            flagged = [np.frombuffer(b"".join(x.as_py()), "<u4").astype(np.uint64) | np.uint64(i << 32) for i, x in enumerate(batch.column("flags"))]
            own = np.isin((d << np.uint64(32)) | (h >> np.uint64(32)), np.concatenate(flagged)) if flagged else np.zeros(0, bool)
            h, at, size, d = h[own], at[own], size[own], owner[at[own]]
            order = np.argsort(ids[d, 0], kind="stable")  # the smallest doc_id first
            h, at, size, d = h[order], at[order], size[order], d[order]
            seen: dict[bytes, int] = {}
            sends = np.ones(len(h), bool)
            owners = ids[d, 0].tolist()
            for i, (a, n) in enumerate(zip(at.tolist(), size.tolist())):
                sends[i] = seen.setdefault(data[a : a + n + LENGTH - 1], owners[i]) == owners[i]
            rows = []
            for bucket, chosen in by_bucket(np.where(sends, (h % np.uint64(buckets)).astype(np.int64), -1)):
                chosen = chosen[np.argsort(d[chosen], kind="stable")]
                start = at[chosen] - base[d[chosen]]
                if bucket < 0:
                    for row in _span_rows(ids[d[chosen], 0], ids[d[chosen], 1], start, start + size[chosen] + LENGTH - 1):
                        rows.append((bucket, np.array(row[:2], np.int64).tobytes(), row[2], b"", b"", b""))
                    continue
                own_d, index = np.unique(d[chosen], return_inverse=True)
                runs = b"".join([data[a : a + n + LENGTH - 1] for a, n in zip(at[chosen].tolist(), size[chosen].tolist())])
                rows.append((bucket, ids[own_d].tobytes(), pack.compress(runs), size[chosen].astype("<u1").tobytes(), index.astype("<u4").tobytes(), start.astype("<u4" if len(data) < 1 << 32 else "<u8").tobytes()))
            yield to_batch(_RUNS, rows)

    return run


def _judge_runs(batches: Batches) -> Batches:
    """(k, text_key, spans) of what the runs of a bucket repeat from smaller doc_ids, by a suffix array of its runs."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for bucket, rows in grouped(batches, ["ids", "z", "size", "d", "at"]):
        if bucket < 0:
            yield to_batch(_SPANS, [(*np.frombuffer(ids, np.int64).tolist(), spans) for ids, spans, *_ in rows])
            continue
        ids, at, which, known, least = [], [], [], {}, []
        for own_ids, z, size, d, start in rows:
            own = np.frombuffer(own_ids, np.int64).reshape(-1, 2)[np.frombuffer(d, "<u4")]
            sizes, runs = np.frombuffer(size, np.uint8).astype(np.int64) + LENGTH - 1, unpack.decompress(z)
            ends = np.cumsum(sizes)
            ids.append(own)
            at.append(np.frombuffer(start, "<u4" if len(start) == 4 * len(own) else "<u8").astype(np.int64))
            for a, b, k in zip((ends - sizes).tolist(), ends.tolist(), own[:, 0].tolist()):
                i = known.setdefault(runs[a:b], len(known))
                which.append(i)
                if i == len(least):
                    least.append(k)
                elif k < least[i]:
                    least[i] = k
        ids, at, which, least = np.concatenate(ids), np.concatenate(at), np.array(which), np.array(least, np.int64)
        text = np.frombuffer(b"".join(known), np.uint8)
        sizes = np.array([len(x) for x in known], np.int64)
        base, n = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
        before = np.cumsum(n) - n
        starts = np.repeat(base - before, n) + np.arange(n.sum())
        smallest = smallest_owner(text, starts, np.repeat(least, n))
        # strings of each sent run, and which of them a smaller doc_id has
        count = n[which]
        turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        sent = np.repeat(np.arange(len(which)), count)
        hit = smallest[before[which][sent] + turn] < ids[sent, 0]
        first = hit & ((turn == 0) | ~np.concatenate(([False], hit[:-1])))
        last = hit & ((turn == count[sent] - 1) | ~np.concatenate((hit[1:], [False])))
        if hit.any():
            run, begin, end = sent[first], (at[sent] + turn)[first], (at[sent] + turn)[last] + LENGTH
            yield to_batch(_SPANS, _span_rows(ids[run, 0], ids[run, 1], begin, end))


_RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def _cut(keep: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("spans").to_pylist()):
                runs = _merged(np.frombuffer(b"".join(spans or []), "<i8").reshape(-1, 2))
                at = [0, *runs.ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(at[::2], at[1::2]))
                rows.append((doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if keep else None))
            yield to_batch(_RESULT, rows)

    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """k, text_key, spans: byte ranges (start, end as pairs of 64-bit integers) to remove; several rows per document."""
    n = partitions(docs.sparkSession)
    few = max(LEAST_TASKS, n // 4)
    # what a task holds at once is one bucket, so buckets follow the measured bytes and not the number of partitions
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    run_buckets, hash_buckets = max(n, LEAST_BUCKETS, size // RUN_BYTES), max(few, size // HASH_BYTES)
    hashes = byte_rows(docs).select("k", "text").mapInArrow(_send_hashes(hash_buckets), schema_of(_HASHES))
    # decided rows need no meeting, so they are dealt evenly
    met = hashes.repartition(few, dealt("h")).sortWithinPartitions("bucket")
    flags = met.mapInArrow(_shared, schema_of(_FLAGS)).groupBy("k").agg(F.collect_list("h").alias("flags"))
    runs = packed_rows(docs).join(flags, "k").select("k", "text_key", "z", "flags").mapInArrow(_send_runs(run_buckets), schema_of(_RUNS))
    return runs.repartition(n, dealt("z")).sortWithinPartitions("bucket").mapInArrow(_judge_runs, schema_of(_SPANS))


def remove_repeats(docs: DataFrame, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes; null unless ``keep``) of every row.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id; strings are
    judged on the input. Null texts count as empty. A null doc_id is smaller than any other; rows that share a doc_id do
    not count as each other's copies, and rows equal in doc_id and text give equal rows. Other columns are not read.
    """
    # spans of one document meet here: as many as its runs at most
    spans = repeated_spans(docs).groupBy("k", "text_key").agg(F.collect_list("spans").alias("spans"))
    rows = packed_rows(docs).join(spans, ["k", "text_key"], "left").select("doc_id", "z", "spans")
    return rows.mapInArrow(_cut(keep), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
