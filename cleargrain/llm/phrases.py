"""Phrase collocations from counting quotient filters.

1. Documents are gathered into blocks. A block holds its words as numbers of its own lexicon, which lists every
   (language, word) of the block once with its count.
2. Lexicons add up to the counts of all words. Words with LEAST_COUNT or more get a number; no phrase with a rarer word
   can be a candidate. Numbers of one language and another differ, so phrases carry their language.
3. Each block gets the numbers of its words (one row per distinct word), packs its runs of two and three words as three
   lanes of word numbers, permutes the lanes invertibly, and counts them. The first lane is split into shard and
   quotient, the rest of it and the other lanes are the full remainder, so a filter loses nothing.
4. The sorted filters of a shard are merged, and what reached LEAST_COUNT is permuted back.
5. Cuts, scores, containment and ranks are joins over the candidates.

Memory: a block holds BLOCK_BYTES of text (or one longer text), and shards are as many as keep the phrases of one below
SHARD_KEYS. Hot words and phrases are one row per block or filter. Arithmetic is in whole numbers throughout.

A null text is empty, a null language is ``und``, rows with equal ids or texts count once each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleargrain.llm.common import ascii_lower, partitions
from cleargrain.operators.keyed import attach
from cleargrain.operators.scan import with_row_id
from cleargrain.session import stage

LEAST_COUNT = 10
SCALE = 1_000_000  # scores are whole millionths
INSIDE_PERCENT = 50  # a phrase goes if a longer one around it has this share of its occurrences
TOP = 2000
BLOCK_BYTES = 1 << 23
SHARD_KEYS = 1 << 22
_LANGUAGE_DEFAULT = "und"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_BREAK = bytes.maketrans(_BREAKS, b"\n" * len(_BREAKS))
_BREAK = b"\xff"  # a byte that no UTF-8 text has

Batches = Iterator[pa.RecordBatch]


# -- counting quotient filters


def _mixed(x: np.ndarray, y: np.ndarray, seed: int, width: int) -> np.ndarray:
    """``width`` bits that depend on all bits of two lanes."""
    h = (x ^ (y << np.uint64(31)) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) & np.uint64((1 << width) - 1)


def permute(lanes: list[np.ndarray], width: int, back: bool = False) -> list[np.ndarray]:
    """An invertible permutation of three lanes of ``width`` bits (31 at most): each round changes one by the others."""
    lanes = list(lanes)
    rounds = [(k % 3, k + 1) for k in range(6)]
    for at, seed in reversed(rounds) if back else rounds:
        lanes[at] = lanes[at] ^ _mixed(lanes[at - 2], lanes[at - 1], seed, width)
    return lanes


def _packed(values: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits[:, 64 - width :].ravel()).tobytes()


def _unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - width :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def write_filter(upper: np.ndarray, lower: np.ndarray, counts: np.ndarray, upper_bits: int, lower_bits: int) -> bytes:
    """A filter of distinct keys (upper, lower) in rising order.

    The quotient is the top of the upper part: ``occupied`` has a bit for each quotient that occurs, ``ends`` one for
    each key that is the last of its run. Remainders are packed. A bit tells which counts exceed one; those are bytes,
    and 255 stands for an entry of the list of large counts.
    """
    n = len(upper)
    quotient_bits = min(upper_bits, max(1, n).bit_length())
    quotient = upper >> np.uint64(upper_bits - quotient_bits)
    occupied = np.zeros(1 << quotient_bits, np.uint8)
    occupied[quotient.astype(np.int64)] = 1
    ends = np.append(quotient[1:] != quotient[:-1], True)[:n]
    many = counts[counts > 1]
    parts = [
        np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), _packed(upper & np.uint64((1 << (upper_bits - quotient_bits)) - 1), upper_bits - quotient_bits),
        _packed(lower, lower_bits), np.packbits(counts > 1).tobytes(), np.minimum(many, 255).astype(np.uint8).tobytes(), many[many >= 255].astype("<i8").tobytes(),
    ]
    return np.array([n, quotient_bits, upper_bits, lower_bits, *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def read_filter(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys (upper, lower) of a filter in rising order, and their counts."""
    n, quotient_bits, upper_bits, lower_bits, *sizes = np.frombuffer(data, "<i8", 11).tolist()
    starts = 88 + np.cumsum([0, *sizes])
    occupied, ends, high, low, flags, small, large = (data[a:b] for a, b in zip(starts, starts[1:]))
    run = np.cumsum(np.append(0, np.unpackbits(np.frombuffer(ends, np.uint8), count=n)))[:-1]
    quotient = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8), count=1 << quotient_bits))[run].astype(np.uint64)
    upper = (quotient << np.uint64(upper_bits - quotient_bits)) | _unpacked(high, n, upper_bits - quotient_bits)
    counts, many = np.ones(n, np.int64), np.frombuffer(small, np.uint8).astype(np.int64)
    many[many == 255] = np.frombuffer(large, "<i8")
    counts[np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)] = many
    return upper, _unpacked(low, n, lower_bits), counts


def summed(upper: np.ndarray, lower: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in rising order with the sums of their counts; runs that are sorted already are merged."""
    order = np.lexsort((lower, upper))
    upper, lower, counts = upper[order], lower[order], counts[order]
    first = np.flatnonzero(np.append(True, (upper[1:] != upper[:-1]) | (lower[1:] != lower[:-1]))[: len(upper)])
    return upper[first], lower[first], np.add.reduceat(counts, first) if len(first) else counts


# -- blocks of documents


def _gather(batches: Batches) -> Batches:
    """Documents to blocks: numbers of words with 0 at breaks, and the lexicon of the block."""
    import zstandard

    task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    pack, number = zstandard.ZstdCompressor(level=1), count()

    def block(texts: dict[str, list[bytes]]) -> pa.RecordBatch:
        fresh, ids, words, langs = count(1).__next__, [], [], []
        for lang, own in texts.items():
            lexicon = defaultdict(fresh, {_BREAK: 0})
            plain = (b" \xff ".join(own)).translate(_TO_BREAK).replace(b"\n", b" \xff ").split()
            ids.append(np.fromiter(map(lexicon.__getitem__, plain), np.int32, len(plain)))
            ids.append(np.zeros(1, np.int32))
            del lexicon[_BREAK]
            words += lexicon
            langs += [lang] * len(lexicon)
        every = np.concatenate(ids)
        counts = np.bincount(every, minlength=len(words) + 1)[1:]
        columns = [pa.array([task + next(number)], pa.int64()), pa.array([pack.compress(every.tobytes())], pa.binary())]
        columns += [pa.array([x], pa.list_(t)) for x, t in ((langs, pa.string()), (words, pa.binary()), (counts, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "langs", "words", "counts"])

    held, size = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            text = text.as_py()
            if size and size + len(text) > BLOCK_BYTES:
                yield block(held)
                held, size = defaultdict(list), 0
            held[lang.as_py()].append(text)
            size += len(text)
    if held:
        yield block(held)


def blocks(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(_LANGUAGE_DEFAULT)).alias("lang"), F.encode(ascii_lower(F.col("text")), "UTF-8").alias("text"))
    return rows.mapInArrow(_gather, "block bigint, ids binary, langs array<string>, words array<binary>, counts array<bigint>")


def vocabulary(lexicons: DataFrame, least: int) -> DataFrame:
    """id (from 1), lang, word, n of every word that occurs ``least`` times or more."""
    words = lexicons.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return stage(with_row_id(words, ["lang", "word"], "id").withColumn("id", F.col("id") + 1), "vocabulary")


def _counter(width: int, shard_bits: int):
    """Groups of (block's ids, numbers of its words) to one filter per shard."""

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        import zstandard

        empty = {"shard": pa.array([], pa.int32()), "filter": pa.array([], pa.binary())}
        if not own.num_rows or not known.num_rows:
            return pa.table(empty)
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(own.column("ids")[0].as_py()), np.int32)
        at, word = known.column("local").to_numpy(), known.column("id").to_numpy()
        numbers = np.zeros(int(max(ids.max(), at.max())) + 1, np.uint64)
        numbers[at] = word
        g = np.concatenate([numbers[ids], np.zeros(2, np.uint64)])
        a, b, c = g[:-2], g[1:-1], g[2:]
        two, three = (a > 0) & (b > 0), (a > 0) & (b > 0) & (c > 0)
        lanes = [np.concatenate([a[two], a[three]]), np.concatenate([b[two], b[three]]), np.concatenate([np.zeros(two.sum(), np.uint64), c[three]])]
        first, second, third = permute(lanes, width)
        upper, lower, counts = summed(first, (second << np.uint64(width)) | third, np.ones(len(first), np.int64))
        upper_bits = width - shard_bits
        shard = (upper >> np.uint64(upper_bits)).astype(np.int64)
        inner, edges = upper & np.uint64((1 << upper_bits) - 1), np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))[: len(shard)]
        out = [(int(shard[i]), write_filter(inner[i:j], lower[i:j], counts[i:j], upper_bits, 2 * width)) for i, j in zip(edges, [*edges[1:], len(shard)])]
        return pa.table({"shard": pa.array([s for s, _ in out], pa.int32()), "filter": pa.array([f for _, f in out], pa.binary())})

    return run


def _merger(width: int, shard_bits: int, least: int):
    """Filters sorted by shard to the phrases that occur ``least`` times or more."""
    upper_bits, mask = width - shard_bits, np.uint64((1 << width) - 1)

    def result(shard: int, parts: list) -> pa.RecordBatch:
        upper, lower, counts = merged(parts)[0]
        often = counts >= least
        upper, lower = upper[often] | np.uint64(shard << upper_bits), lower[often]
        a, b, c = permute([upper, lower >> np.uint64(width), lower & mask], width, back=True)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, c, counts[often])], ["w1", "w2", "w3", "a"])

    def merged(parts: list) -> list:
        return [summed(*(np.concatenate(x) for x in zip(*parts)))]

    def run(batches: Batches) -> Batches:
        current, parts, size = None, [], 0
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("filter")):
                if shard != current and parts:
                    yield result(current, parts)
                    parts, size = [], 0
                current = shard
                parts.append(read_filter(data.as_py()))
                size += len(parts[-1][0])
                if size > 2 * max(SHARD_KEYS // 4, len(parts[0][0])):
                    parts = merged(parts)
                    size = len(parts[0][0])
        if parts:
            yield result(current, parts)

    return run


def frequent_phrases(stored: DataFrame, words: DataFrame, total: int, least: int) -> DataFrame:
    """w1, w2, w3 (0 for two words) and a, for every phrase of two or three words that occurs ``least`` times or more.

    ``stored`` has the blocks, ``words`` the vocabulary; both are stored tables. ``total`` is the number of all words.
    """
    spark = stored.sparkSession
    size, parts = words.count(), partitions(spark)
    width = max(1, int(size).bit_length())
    if width > 31:
        raise ValueError("more than 2^31 words are frequent")
    shard_bits = min(width, max(2 * parts - 1, 2 * total // SHARD_KEYS).bit_length())
    named = stored.select("block", F.posexplode(F.arrays_zip("langs", "words")).alias("at", "x"))
    named = named.select("block", (F.col("at") + 1).alias("local"), F.col("x.langs").alias("lang"), F.col("x.words").alias("word"))
    known = named.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("of"), "local", "id")
    filters = stored.select("block", "ids").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_counter(width, shard_bits), "shard int, filter binary")
    dealt = filters.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard")
    return stage(dealt.mapInArrow(_merger(width, shard_bits, least), "w1 bigint, w2 bigint, w3 bigint, a bigint"), "phrases")


# -- scores


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), in decimals because the products may pass 64 bits."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (a * a), left * right)


def _lowest(a: Column, cuts: list[tuple[Column, Column]]) -> Column:
    """The cut (left, right) with the lowest score, the first of equals."""
    return F.array_min(F.array(*[F.struct(_score(a, x, y).alias("score"), F.lit(k).alias("k"), x.alias("l"), y.alias("r")) for k, (x, y) in enumerate(cuts)]))


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    stored = stage(blocks(docs), "word-blocks")
    lexicons = stored.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("x")).select(
        F.col("x.langs").alias("lang"), F.col("x.words").alias("word"), F.col("x.counts").alias("n")
    )
    per_lang = stage(lexicons.groupBy("lang").agg(F.sum("n").alias("n")), "language-words")
    total = per_lang.agg(F.sum("n")).first()[0] or 0
    words = vocabulary(lexicons, least)
    found = frequent_phrases(stored, words, total, least)

    found = found.withColumn("w3", F.expr("nullif(w3, 0)"))
    for k in (1, 2, 3):
        lang = [F.col("lang")] if k == 1 else []
        facts = words.select(F.col("id").alias(f"w{k}"), F.col("n").alias(f"n{k}"), F.col("word").alias(f"t{k}"), F.col("n").alias("weight"), *lang)
        # the most frequent words are answered from a broadcast of a fixed number of rows, the others by a shuffle
        found = attach(found, facts, [f"w{k}"], row_key=["w1", "w2", "w3"], weight="weight", limit=0, staged=True)
    found = stage(found, "phrases-with-words")
    pairs, triples = found.filter("w3 is null"), found.filter("w3 is not null")

    around = triples.select(F.explode(F.array(F.struct("w1", "w2", "a"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))).alias("x"))
    around = around.select("x.*").groupBy("w1", "w2").agg(F.max("a").alias("longest"))
    pairs_kept = pairs.join(around, ["w1", "w2"], "left").filter(f"longest is null or 100 * longest < {INSIDE_PERCENT} * a")
    ends = pairs.select("w1", "w2", "a")
    triples = triples.join(ends.withColumnRenamed("a", "head"), ["w1", "w2"])
    triples = triples.join(ends.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("tail")), ["w2", "w3"])
    a, n1, n2, n3 = (F.col(x) for x in ("a", "n1", "n2", "n3"))
    space = F.lit(b" ")
    scored = pairs_kept.select("lang", "a", _lowest(a, [(n1, n2)]).alias("cut"), F.concat("t1", space, "t2").alias("phrase")).unionByName(
        triples.select("lang", "a", _lowest(a, [(n1, F.col("tail")), (F.col("head"), n3)]).alias("cut"), F.concat("t1", space, "t2", space, "t3").alias("phrase"))
    )
    order = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    # the best of every part first, so that no task sorts all phrases of a language
    part = F.pmod(F.xxhash64("phrase"), F.lit(partitions(spark)))
    best = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(per_lang, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a",
        F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("bigint").alias("score"),
    )
