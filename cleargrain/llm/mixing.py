"""Mixing to target weights with soft domain memberships."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import ascii_lower, softmax
from cleargrain.session import stage

MAX_LABELLED = 50_000  # labelled documents that the classifier is fitted on, at most (drawn by a hash of doc_id)
BUCKETS = 1 << 16  # hashed words of the classifier; the weights are broadcast, so this bounds them
SMOOTHING = 0.5
SHARPNESS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0)  # of the posteriors, picked by likelihood
PULL = 1e-4  # weight of keeping the rates near 1, which makes the solution unique
LEAST_PULL = 1e-10  # the weight falls tenfold, down to this, while it keeps the totals from the targets
TOLERANCE = 5e-4  # share of the total left open
STEPS, SLOPE = 200, 1e-7  # Newton steps at one weight, at most, and the slope at which they end, as a share of the total


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), "[\\x20\\x09-\\x0D]+"), "")


def _bucket(token: str) -> Column:
    """Hashed feature of a token: the token, or only its last character if that is an ASCII sign."""
    last = F.substring(token, -1, 1)
    sign = F.ascii(last).between(33, 47) | F.ascii(last).between(58, 64) | F.ascii(last).between(91, 96) | F.ascii(last).between(123, 126)
    return F.pmod(F.xxhash64(F.when(sign, last).otherwise(F.col(token))), F.lit(BUCKETS)).cast("int")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text; null counts as empty) and text of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from a table (doc_id, quality, toxic): toxic, else low for quality 0, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), domain.alias("domain"))


class DomainModel:
    """Multinomial naive Bayes over hashed words: weights (bucket, w) as a stored table, priors and sharpness."""

    def __init__(self, names: list[str], weights: DataFrame, priors: list[float], sharpness: float = 1.0):
        self.names, self.weights, self.priors, self.sharpness = names, weights, priors, sharpness

    def evidence(self, docs: DataFrame) -> DataFrame:
        """doc_id, text_key, rows (equal rows), n_tokens and s: per domain, the words' mean weight times the root of their
        number (long texts would otherwise be certain of anything). One row per distinct (doc_id, text)."""
        each = _keyed(docs).select("doc_id", "text_key", F.explode(F.concat(F.array(F.lit(None).cast("string")), _tokens(F.col("text")))).alias("t"))
        hit = each.withColumn("bucket", _bucket("t")).join(F.broadcast(self.weights), "bucket", "left")
        k = range(len(self.names))
        sums = hit.groupBy("doc_id", "text_key").agg(
            F.sum(F.col("t").isNull().cast("bigint")).alias("rows"), F.sum(F.col("t").isNotNull().cast("bigint")).alias("n"),
            *[F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.coalesce(F.col("w")[i], F.lit(0.0)))), F.lit(0.0)).alias(f"s{i}") for i in k],
        )
        scale = F.sqrt(F.greatest(F.col("n"), F.lit(1)))
        return sums.select(
            "doc_id", "text_key", "rows", (F.col("n") / F.greatest(F.col("rows"), F.lit(1))).cast("bigint").alias("n_tokens"),
            F.array(*[F.col(f"s{i}") / scale * F.sqrt(1 / F.greatest(F.col("rows"), F.lit(1))) for i in k]).alias("s"),
        )

    def posterior(self, sharpness: float | None = None) -> Column:
        """Array of domain probabilities from the column s."""
        by = float(sharpness or self.sharpness)
        return softmax(F.array(*[F.lit(math.log(p)) + by * F.col("s")[i] for i, p in enumerate(self.priors)]))


def fit_domains(docs: DataFrame, domains: DataFrame, names: list[str], most: int = MAX_LABELLED) -> DomainModel:
    """Fit on at most ``most`` labelled documents, drawn by a hash of doc_id.

    ``domains`` is (doc_id, domain); rows with a null or other domain are left out, of several domains for one id the
    alphabetically first counts. Without labelled documents all domains are equally likely.
    """
    known = domains.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(names)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    total = known.count()
    cut = 1_000_000 * most // max(total, most)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < cut)  # ``most`` rows, so small enough to broadcast
    mine = stage(_keyed(docs).join(F.broadcast(drawn), "doc_id"), "labelled")
    shares = {r[0]: r[1] for r in mine.groupBy("domain").count().collect()}
    priors = [(shares.get(n, 0) + 1) / (sum(shares.values()) + len(names)) for n in names]
    counts = mine.select("domain", F.explode(_tokens(F.col("text"))).alias("t")).groupBy(_bucket("t").alias("bucket")).agg(
        *[F.sum((F.col("domain") == n).cast("bigint")).alias(f"c{i}") for i, n in enumerate(names)]
    )
    counts = stage(counts, "bucket-counts")
    sums = counts.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in range(len(names))]).first()
    logs = [F.log((F.col(f"c{i}") + SMOOTHING) / F.lit(float(s + SMOOTHING * BUCKETS))) for i, s in enumerate(sums)]
    mean = sum(logs[1:], logs[0]) / len(logs)
    model = DomainModel(names, stage(counts.select("bucket", F.array(*[x - mean for x in logs]).alias("w")), "bucket-weights"), priors)
    judged = stage(model.evidence(mine).join(F.broadcast(drawn), "doc_id"), "labelled-evidence")
    own = F.array_position(F.array(*map(F.lit, names)), F.col("domain")).cast("int") - 1
    losses = judged.agg(*[F.sum(-F.log(F.greatest(model.posterior(t)[own], F.lit(1e-12)))) for t in SHARPNESS]).first()
    if losses[0] is not None:
        model.sharpness = min(zip(losses, SHARPNESS))[1]
    return model


def memberships(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, text_key, rows, n_tokens and p, the array of domain probabilities."""
    return model.evidence(docs).select("doc_id", "text_key", "rows", "n_tokens", model.posterior().alias("p"))


def _rate(multipliers: np.ndarray) -> Column:
    """Rate of a document by the multiplier of each domain."""
    by = F.lit(0.0)
    for i, m in enumerate(multipliers):
        by = by + F.lit(float(m)) * F.col("p")[i]
    return F.greatest(F.lit(0.0), F.lit(1.0) - by)


def fit_rates(members: DataFrame, targets: list[float]) -> tuple[DataFrame, list[float]]:
    """Nonnegative rates by least squares over the stored ``members``.

    Minimises the squared gap between the expected tokens per domain, sum(rate x n_tokens x p), and ``targets``, in units of
    their sum, and PULL x the squared distance of the rates from 1. At the minimum a rate is max(0, 1 - p . m) with one
    multiplier m per domain, so Newton steps on the K multipliers find it: a step is one aggregate over the documents, with
    K totals and the K x K sums of n_tokens p p' of the documents with a rate to the driver. While the totals miss the
    targets by TOLERANCE or more and a weaker pull brings them nearer, it is weakened. Returns the members with their rate,
    and the expected totals; what those lack of the targets cannot be reached.
    """
    total, k = float(sum(targets)), range(len(targets))
    aim = np.array(targets, float)
    corpus = members.agg(F.sum(F.col("n_tokens") * F.col("rows"))).first()[0] or 0
    if not corpus or not total:
        return members.withColumn("rate", F.lit(1.0)), [0.0] * len(targets)
    n = F.col("n_tokens") * F.col("rows")

    def measured(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half the sum of n rate^2, the expected totals, and the sums of n p p' where the rate is above 0."""
        rated = members.select(n.alias("n"), "p", _rate(m).alias("r"))
        sums = [F.sum(F.col("n") * F.col("r") * F.col("p")[i]) for i in k]
        squares = [F.sum(F.when(F.col("r") > 0, F.col("n") * F.col("p")[i] * F.col("p")[j]).otherwise(0.0)) for i in k for j in k[: i + 1]]
        half, *found = rated.agg(F.sum(F.col("n") * F.col("r") * F.col("r")) / 2, *sums, *squares).first()
        outer = np.zeros((len(k), len(k)))
        for (i, j), x in zip(((i, j) for i in k for j in k[: i + 1]), found[len(k) :]):
            outer[i, j] = outer[j, i] = x
        return half, np.array(found[: len(k)], float), outer

    def solved(m: np.ndarray, at: tuple[float, np.ndarray, np.ndarray], pull: float) -> tuple[np.ndarray, tuple[float, np.ndarray, np.ndarray]]:
        def dual(m: np.ndarray, half: float) -> float:
            return half + m @ aim + total * pull / 2 * (m @ m)

        for _ in range(STEPS):
            slope = aim - at[1] + total * pull * m
            if abs(slope).max() < SLOPE * total:
                break
            step = -np.linalg.solve(at[2] + total * pull * np.eye(len(k)), slope)
            size, now = 1.0, dual(m, at[0])
            while True:
                after = measured(m + size * step)
                if dual(m + size * step, after[0]) <= now + 1e-4 * size * (slope @ step):
                    break
                size /= 2
                if size < 1e-6:  # the numbers' precision is used up
                    return m, at
            m, at = m + size * step, after
        return m, at

    def gap(totals: np.ndarray) -> float:
        return float(abs(totals - aim).max() / total)

    m = np.zeros(len(k))
    m, at = solved(m, measured(m), PULL)
    pull = PULL / 10
    while gap(at[1]) >= TOLERANCE and pull >= LEAST_PULL:
        weaker = solved(m, at, pull)
        if gap(weaker[1][1]) > 0.95 * gap(at[1]):
            break
        (m, at), pull = weaker, pull / 10
    return members.withColumn("rate", _rate(m)), at[1].tolist()


def copies(rate: Column, *key: str) -> Column:
    """Whole number of copies whose expectation is the rate; the same for equal keys on every run."""
    draw = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def mixture(docs: DataFrame, domains: DataFrame, weights: dict[str, float], scale: float | None = None) -> DataFrame:
    """Rates that bring the expected tokens per domain to ``weights``.

    Returns doc_id, text_key, rows, n_tokens, p (domain probabilities in the order of ``weights``), rate and copies, one
    row per distinct (doc_id, text). Targets are the weights times ``scale`` x the corpus's tokens; by default the smallest
    scale at which no domain needs fewer tokens than it has, so that rare domains are repeated rather than others thinned
    out. Texts without words have no tokens and the rate that their prior memberships give. An empty table gives no rows.
    Where no rates reach the targets, those that come nearest are returned, and a warning tells what is missing.
    """
    names = list(weights)
    model = fit_domains(docs, domains, names)
    members = stage(memberships(docs, model), "memberships")
    have = members.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("rows") * F.col("p")[i]), F.lit(0.0)) for i in range(len(names))]).first()
    total = sum(have) * scale if scale else max([h / w for h, w in zip(have, weights.values()) if w > 0] or [0.0])
    targets = [w * total for w in weights.values()]
    rated, reached = fit_rates(members, targets)
    if any(reached) and max(abs(r - t) for r, t in zip(reached, targets)) >= TOLERANCE * sum(targets):
        of = sum(targets)
        told = ", ".join(f"{n} {r / of:.4f} for {t / of:.4f}" for n, r, t in zip(names, reached, targets))
        warnings.warn(f"the targets of the mixture cannot be reached; shares of the target tokens: {told}", stacklevel=2)
    return rated.withColumn("copies", copies(F.col("rate"), "doc_id", "text_key"))


def mix(docs: DataFrame, domains: DataFrame, weights: dict[str, float], scale: float | None = None) -> DataFrame:
    """Rows of ``docs``, each as often as its copies say; all columns stay as they are."""
    rates = mixture(docs, domains, weights, scale).select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"), "copies")
    rows = docs.select(F.struct("*").alias("d")).withColumn("i0", F.col("d.doc_id").cast("bigint")).withColumn("k0", F.xxhash64(F.coalesce("d.text", F.lit(""))))
    kept = rows.join(rates.filter("copies > 0"), F.col("i0").eqNullSafe(F.col("i")) & (F.col("k0") == F.col("k")))
    return kept.select("d", F.explode(F.expr("sequence(1L, copies)")).alias("c")).select("d.*")
