"""SimHash fingerprints and their links by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleargrain.llm.common import ascii_lower, join_groups, partitions
from cleargrain.llm.components import connected_components
from cleargrain.session import stage

BITS = 64
SEED = 42
PROBE_COST = 20.0  # what one probe costs, in candidate comparisons: it is shuffled, a candidate only compared
DRAWN = 16  # fingerprints of a key that all others with the key meet first


def fingerprint(data: bytes | None, words: int) -> int:
    """Signed 64-bit fingerprint: each bit is 1 if set in over half of the shingles' hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    tokens = (data or b"").lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    n = max(1, len(tokens) - words + 1)
    shingles = map(b" ".join, zip(*(islice(tokens, i, None) for i in range(words)))) if len(tokens) >= words else iter([b" ".join(tokens)])
    if not tokens:
        return 0
    ones = np.zeros(BITS, np.int64)
    while block := [xxh64_intdigest(s, SEED) for s in islice(shingles, 1 << 15)]:
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprint_batches(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(x.as_py(), words) for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, print) of every row; null texts count as empty, other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches(words), "doc_id bigint, print bigint")


@dataclass(frozen=True)
class Part:
    """Bits of one partition and the distance up to which it is probed."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        """Bit patterns of at most ``threshold`` bits of the part."""
        return [_signed(sum(1 << b for b in c)) for t in range(self.threshold + 1) for c in combinations(self.bits, t)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both += np.rint(bits.T @ bits).astype(np.int64)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both.ravel())], ["i", "j", "n"])


def joint_counts(prints: DataFrame) -> np.ndarray:
    """How often bits i and j are set together, over all fingerprints (BITS x BITS numbers reach the driver)."""
    rows = prints.select("print").mapInArrow(_joint, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    out = np.zeros((BITS, BITS))
    for i, j, n in rows.collect():
        out[i, j] = n
    return out


def group_bits(joint: np.ndarray, n: int, parts: int) -> list[tuple[int, ...]]:
    """Partitions of equal size (within one bit) of bits that are correlated, so that dissimilar bits part them."""
    share = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    strength = np.abs((joint / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        own = [max(left, key=lambda b: (strength[b, list(left)].sum(), -b))]
        left.remove(own[0])
        while len(own) < BITS // parts + (k < BITS % parts):
            own.append(max(left, key=lambda b: (strength[b, own].sum(), -b)))
            left.remove(own[-1])
        out.append(tuple(sorted(own)))
    return out


def _agreeing(prints: DataFrame, parts: list[tuple[int, ...]]) -> list[float]:
    """Number of pairs, in either order, that agree on all bits of each part; from the counts of all keys."""
    keys = prints.select(F.explode(F.array(*[_key(Part(p, 0), i) for i, p in enumerate(parts)])).alias("k")).groupBy("k.part", "k.key").count()
    sums = {r[0]: float(r[1]) for r in keys.groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count"))).collect()}
    return [sums.get(i, 0.0) for i in range(len(parts))]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of -1 or more whose sum is ``total`` at least cost; ``costs[i][t + 1]`` is the cost of t in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in enumerate(own, -1):
                if cost + more < step.get(used + t, (math.inf,))[0]:
                    step[used + t] = (cost + more, [*chosen, t])
        best = step
    return best[total]


def plan_parts(prints: DataFrame, distance: int) -> list[Part]:
    """Partitions and thresholds for links of at most ``distance`` bits, from statistics of all fingerprints.

    Two fingerprints within the distance are, for thresholds that sum to distance - parts + 1, within the threshold in at
    least one part. For each number of parts, the pairs to expect per part and threshold follow from the pairs that agree
    on the whole part, which are counted, and from the bits' shares. Dynamic programming picks the thresholds of least
    cost (probes and expected candidates). More fingerprints favour fewer, wider parts, so candidates stay near-linear.
    """
    n, joint = max(1, prints.count()), joint_counts(prints)  # an empty table is planned like one row, so its probes stay few
    share = np.diag(joint) / n
    agree = np.clip(share**2 + (1 - share) ** 2, 0.5, 1)
    best: tuple[float, list[Part]] = (math.inf, [])
    for m in range(1, distance + 2):
        groups = group_bits(joint, n, m)
        costs = []
        for bits, same in zip(groups, _agreeing(prints, groups)):
            ways = [1.0]  # pairs at t bits apart for one that agrees: elementary symmetric sums of the odds
            for odds in (1 - agree[list(bits)]) / agree[list(bits)]:
                ways = [a + odds * b for a, b in zip([*ways, 0.0], [0.0, *ways])][: distance + 1]
            probes = np.cumsum([math.comb(len(bits), t) for t in range(distance + 1)])
            costs.append([0.0] + [PROBE_COST * n * float(p) + same / 2 * w for p, w in zip(probes, np.cumsum(ways))])
        cost, chosen = allocate(costs, distance - m + 1)
        if cost < best[0]:
            best = cost, [Part(b, t) for b, t in zip(groups, chosen) if t >= 0]
    return best[1]


def _key(part: Part, i: int, flip: int = 0) -> Column:
    key = F.col("print").bitwiseAND(F.lit(part.mask))
    return F.struct(F.lit(i).alias("part"), (key.bitwiseXOR(F.lit(flip)) if flip else key).alias("key"))


def _stored(rows: DataFrame, parts: list[Part]) -> DataFrame:
    """(b, rb, k): the fingerprints (print) and their roots by their key in each part."""
    keys = F.array(*[_key(p, i) for i, p in enumerate(parts)])
    return rows.select(F.col("print").alias("b"), F.col("root").alias("rb"), F.explode(keys).alias("k"))


def _probes(rows: DataFrame, parts: list[Part]) -> DataFrame:
    """(a, ra, k): the fingerprints and their roots by all keys within the threshold of each part."""
    flips = [(i, p.mask, f) for i, p in enumerate(parts) for f in p.flips()]
    table = ", ".join(f"named_struct('part', {i}, 'mask', {_long(m)}, 'flip', {_long(f)})" for i, m, f in flips)
    return rows.select(F.col("print").alias("a"), F.col("root").alias("ra"), F.explode(F.expr(f"array({table})")).alias("p")).select(
        "a", "ra", F.struct(F.col("p.part").alias("part"), F.expr("(a & p.mask) ^ p.flip").alias("key")).alias("k")
    )


def _shuffled(probes: DataFrame) -> DataFrame:
    """Probes whose join is shuffled: Spark takes exploded rows to be as small as the rows before, and would broadcast them."""
    return probes.hint("merge")


def _close(distance: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance


def _same_key() -> Column:
    return (F.col("x.k.part") == F.col("y.k.part")) & (F.col("x.k.key") == F.col("y.k.key"))


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of the distinct stored fingerprints (column print) that differ in at most ``distance`` bits."""
    parts, rows = plan_parts(prints, distance), prints.select("print", F.col("print").alias("root"))
    found = _shuffled(_probes(rows, parts)).alias("x").join(_stored(rows, parts).alias("y"), _same_key() & (F.col("a") < F.col("b")) & _close(distance))
    return found.select("a", "b").distinct()


def _merged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (print, root) with the roots joined by the links (ra, rb)."""
    edges = stage(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "print-links")
    roots = stage(connected_components(edges), "print-roots").select("node", F.col("root").alias("least"))
    return stage(rows.join(roots, F.col("root") == F.col("node"), "left").select("print", F.coalesce("least", "root").alias("root")), "print-rooted")


def rooted_prints(prints: DataFrame, distance: int) -> DataFrame:
    """(print, root) of the distinct stored fingerprints: equal roots if links of at most ``distance`` bits connect them.

    The pairs of a group of near copies grow with its square, and most of them only connect what is connected. So first up
    to DRAWN fingerprints of each key, drawn by hash, meet all that probe the key, and what they link gets one root. The
    drawn ones' links to other roots, times the fingerprints that each stands for, estimate the pairs of different roots
    that were left before the round. Rounds go on, each with others drawn, until the estimate is one pair a fingerprint or
    less. Then all pairs of different roots meet, so no link is lost.
    """
    parts, n, turn, left = plan_parts(prints, distance), prints.count(), 0, math.inf
    rows = prints.select("print", F.col("print").alias("root"))
    across = (F.col("ra") != F.col("rb")) & _close(distance)
    while left > n:
        order = F.xxhash64("b", F.lit(turn))
        slots = _stored(rows, parts).groupBy("k", F.pmod(order, F.lit(DRAWN)).alias("slot"))
        drawn = slots.agg(F.min_by(F.struct("b", "rb"), order).alias("one"), F.count(F.lit(1)).alias("n")).select("k", "one.*", "n")
        found = stage(_shuffled(_probes(rows, parts)).alias("x").join(drawn.alias("y"), _same_key() & across).select("ra", "rb", "n"), "print-drawn")
        rows, left, turn = _merged(rows, found), found.agg(F.sum("n")).first()[0] or 0, turn + 1
    pairs = _shuffled(_probes(rows, parts)).alias("x").join(_stored(rows, parts).alias("y"), _same_key() & (F.col("a") < F.col("b")) & across)
    return _merged(rows, pairs.select("ra", "rb"))


def _long(x: int) -> str:
    return f"cast({x} as bigint)" if x != -(1 << 63) else "(-9223372036854775807L - 1L)"


def near_classes(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Rows with one fingerprint are one class; classes within ``distance`` bits are linked, and component_id is the smallest
    doc_id of the connected component. Texts without words have fingerprint zero and link like any other; a null doc_id
    is never the smallest one unless the component has no other. Repeated rows stay, an empty table gives no rows.
    """
    rows = stage(fingerprints(docs, words), "prints")
    groups = stage(rows.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "print-groups")
    rooted = stage(groups.join(rooted_prints(groups, distance), "print"), "print-groups-rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    facts = stage(join_groups(rooted, stage(least, "print-components"), "root", "members").select("print", "n", "component_id"), "print-facts")
    return join_groups(rows, facts, "print", "n").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


COMPARED = 2000  # members that meet one copy of their group's leaders
LEADERS = 64


def _shingle_set(words: int) -> Column:
    """Distinct hashes of the word shingles of the array column ``w``; of all words if there are fewer."""
    run = ", ".join(f"w[i + {j}]" for j in range(words))
    return F.expr(f"array_distinct(if(size(w) < {words}, array(xxhash64(w)), transform(sequence(0, size(w) - {words}), i -> xxhash64({run}))))")


def _like(similarity: float, a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common >= similarity * (F.size(a) + F.size(b) - common)


def _confirmed(members: DataFrame, similarity: float) -> DataFrame:
    """Rows (place, component, set) of stored groups that repeat an earlier one of their group; the places of those.

    In each round the first rows of every group are its leaders. They are settled one after another: a leader that has at
    least ``similarity`` (Jaccard) with an earlier one that stays is a repeat. The other rows meet the leaders that stay;
    those without a match go on to the next round, so all rows are settled as if taken in order. There is one leader at
    first, which ends most groups, then eight, then LEADERS, so a group of m unlike texts takes m / LEADERS rounds. The
    leaders are dealt in copies to COMPARED members each, which splits large groups.
    """
    out, left, n, parts = None, members, 1, partitions(members.sparkSession)
    while left.limit(1).count():
        # the first of every part of a group, then the first of those, so that no task ranks a whole group
        part = F.pmod(F.xxhash64("place"), F.lit(parts))
        ranked = left.select("component", "place", part.alias("part"))
        for by in (["component", "part"], ["component"]):
            ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("place"))).filter(F.col("rank") <= n)
        sizes = left.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        led = F.array_sort(F.collect_list(F.struct("place", "set")))
        groups = ranked.select("place").join(left, "place").groupBy("component").agg(led.alias("led")).join(sizes, "component")
        staying = F.aggregate(
            "led", F.filter("led", lambda x: F.lit(False)),
            lambda kept, x: F.when(F.exists(kept, lambda k: _like(similarity, k["set"], x["set"])), kept).otherwise(F.array_append(kept, x)),
        )
        groups = stage(groups.select("component", "size", F.element_at("led", -1)["place"].alias("last"), staying.alias("kept")), "near-leaders")
        copies = groups.select("component", "last", "kept", F.explode(F.expr(f"sequence(0L, size div {COMPARED})")).alias("salt"))
        salted = left.join(groups.select("component", "size"), "component").withColumn("salt", F.expr(f"pmod(xxhash64(place), 1 + size div {COMPARED})"))
        both = salted.drop("size").join(copies, ["component", "salt"])
        leads = F.col("place") <= F.col("last")
        stays = F.exists("kept", lambda k: k["place"] == F.col("place"))
        match = F.exists("kept", lambda k: _like(similarity, k["set"], F.col("set")))
        judged = both.select("place", "component", "set", leads.alias("leads"), F.when(leads, ~stays).otherwise(match).alias("repeats"))
        judged = stage(judged, "near-judged")
        found, left = judged.filter("repeats").select("place"), judged.filter("not repeats and not leads").select("place", "component", "set")
        out, n = found if out is None else out.unionByName(found), min(LEADERS, 8 * n)
    return members.limit(0).select("place") if out is None else out


def near_dedup(docs: DataFrame, words: int = 5, distance: int = 6, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those that repeat an earlier one; all columns stay.

    Words are runs between white space after lower-casing A-Z. Rows with the same words are one class, of which the smallest
    doc_id stays (null ids last). Classes whose fingerprints of ``words``-word shingles are connected by links of at most
    ``distance`` bits are candidates; a class goes if its shingle set has at least ``similarity`` with that of a class that
    stays and has a smaller doc_id. Texts without words are one class. An empty table gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("d"), F.monotonically_increasing_id().alias("uid"))
    rows = stage(rows, "near-rows")
    tokens = F.array_remove(F.split(ascii_lower(F.col("d.text")), "[\\x20\\x09-\\x0D]+"), "")
    order = F.struct(F.col("d.doc_id").isNull().alias("n"), F.col("d.doc_id").cast("bigint").alias("i"), F.col("uid").alias("u"))
    classes = rows.groupBy(F.sha2(F.array_join(tokens, " "), 256).alias("key")).agg(F.min(order).alias("place"))
    classes = stage(classes.select("place", F.col("place.u").alias("uid")), "near-classes")
    distinct = rows.join(classes, "uid").select("uid", F.col("d.text").alias("text"))
    near = near_classes(distinct.withColumnRenamed("uid", "doc_id"), words, distance).select(F.col("doc_id").alias("uid"), F.col("component_id").alias("component"))
    near = stage(near, "near-components")
    groups = near.groupBy("component").count().filter("count > 1").select("component")
    texts = rows.join(near.join(groups, "component").join(classes, "uid"), "uid").select("place", "component", tokens.alias("w"))
    members = stage(texts.select("place", "component", _shingle_set(words).alias("set")), "near-members")
    gone = _confirmed(members, similarity).select(F.col("place.u").alias("uid"))
    return rows.join(classes.select("uid").join(gone, "uid", "left_anti"), "uid", "left_semi").select("d.*")
