"""Phrases, whitening and line-first cleaning against brute force, with nulls, empty and long texts, ties and odd columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from cleargrain.llm import line_quality, phrases, whitening

SCHEMA = "doc_id bigint, text string, lang string, n int, `Word` string, block string, w1 string"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, 7, "x", "y", None) for i, t, lang in rows], SCHEMA).repartition(parts)


# -- phrases


def corpus():
    rng = random.Random(5)
    common = ["der", "Die", "das", "und", "ein", "Haus", "é", "à-b", "x\x01", "x"]
    rows = [(i, " ".join(rng.choices(common, k=rng.randint(0, 60))), rng.choice(["de", "en", None, "und"])) for i in range(60)]
    rows += [(100 + i, "New York City, new  york\tcity! San Francisco", "en") for i in range(6)] + [(100, "new york city", "en")]
    rows += [(200, None, "en"), (201, "", None), (202, " \t ", "fr"), (203, "...;;", "de"), (None, "no id no id no id", "en")]
    rows += [(300, "tick tock " * 4000, "de"), (301, "a b\na b\x0ba b\x0ca b\ra b:a b", "en"), (302, "A B A B A B", "EN")]
    return rows


def brute(rows, least, top):
    grams, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            grams.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for (lang, g), a in grams.items():
        if len(g) == 1 or a < least:
            continue
        if len(g) == 2 and any(b >= least and 100 * b >= 50 * a for (other, h), b in grams.items() if other == lang and len(h) == 3 and g in (h[:2], h[1:])):
            continue
        cuts = [(1000000 * a * a // (grams[lang, g[:k]] * grams[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.append((lang, " ".join(g), a, grams[lang, g[:k]], grams[lang, g[k:]], n[lang], score))
    final = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        final += [(lang, r + 1, *x[1:]) for r, x in enumerate(own[:top])]
    return sorted(final)


@pytest.mark.parametrize("least, top", [(2, 5), (3, 2000)])
def test_collocations(spark, least, top):
    got = phrases.collocations(docs_of(spark, corpus()), least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    wanted = brute(corpus(), least, top)
    assert sorted(map(tuple, got.collect())) == wanted and len(wanted) > 10


def test_collocations_in_small_blocks(spark, monkeypatch):
    """Blocks and shards change nothing."""
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 200)
    monkeypatch.setattr(phrases, "SHARD_KEYS", 16)
    assert sorted(map(tuple, phrases.collocations(docs_of(spark, corpus(), 2), 2, 7).collect())) == brute(corpus(), 2, 7)


def test_no_collocations(spark):
    assert phrases.collocations(docs_of(spark, [(1, "a", "en")]).limit(0)).count() == 0
    assert phrases.collocations(docs_of(spark, [(1, None, "en"), (2, "one two", None)])).count() == 0


@pytest.mark.parametrize("width", [1, 5, 17, 31])
def test_permutation_and_filters_lose_nothing(width):
    rng = np.random.default_rng(width)
    lanes = [rng.integers(0, 1 << width, 5000).astype(np.uint64) for _ in range(3)]
    there = phrases.permute(lanes, width)
    assert all((x < 1 << width).all() for x in there)
    assert all((a == b).all() for a, b in zip(phrases.permute(there, width, back=True), lanes))
    counts = rng.choice([1, 1, 2, 254, 255, 256, 10**12], 5000)
    keys = phrases.summed(there[0], (there[1] << np.uint64(width)) | there[2], counts)
    for n in (0, 1, len(keys[0])):
        data = phrases.write_filter(*(x[:n] for x in keys), width, 2 * width)
        assert all((a == b[:n]).all() and len(a) == n for a, b in zip(phrases.read_filter(data), keys))


def test_exact_scores_beyond_64_bits(spark):
    row = spark.sql("select 3000000000L as a, 3000000001L as l, 3000000007L as r")
    got = row.select(phrases._score(row.a, row.l, row.r)).first()[0]
    assert got == 1000000 * 3000000000**2 // (3000000001 * 3000000007)


# -- whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, n int, `V` string"


def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 12)) @ np.diag([3, 2, 1.9999, 1, 1, 1, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05])
    rows = [(i, v.astype("f4").tolist()) for i, v in enumerate(base)] + [(5, base[5].astype("f4").tolist()), (None, base[7].astype("f4").tolist())]
    wrong = [None, [], [None] * 12, [1.0] * 11 + [None], [float("nan")] * 12, [1.0] * 11 + [float("-inf")], [1.0] * 5, [1e30] * 12]
    return rows, rows + [(900 + i, v) for i, v in enumerate(wrong)]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "v") for i, v in rows], VECTORS).repartition(4)


def test_whitening(spark):
    good, rows = vectors()
    got = whitening.by_component(whitening.whiten(frame_of(spark, rows))).toPandas()
    x = np.floor(1024 * np.array([v for _, v in good])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = (x - s // n) - (s % n) / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    wanted = y @ (q * np.sign(q[np.abs(q).argmax(0), range(8)])) / np.sqrt(e)
    assert len(got) == 8 * n and set(got.component) == set(range(1, 9)) and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    deviations = ((n * x - s) ** 2).sum(1)
    key = lambda i, a: (-1 if i is None or np.isnan(i) else i, a)
    for c in range(8):
        own = got[got.component == c + 1]
        assert np.allclose(own.explained, e[c] / np.trace(v), rtol=1e-10)
        mine = sorted((key(i, d), w) for i, d, w in zip(own.vec_id, own.deviation, own.whitened))
        theirs = sorted((key(i, d), w) for (i, _), d, w in zip(good, deviations.tolist(), wanted[:, c]))
        assert [k for k, _ in mine] == [k for k, _ in theirs]
        assert np.allclose([w for _, w in mine], [w for _, w in theirs], atol=1e-8)


def test_whitening_of_nothing_and_of_equal_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3):
        out = whitening.by_component(whitening.whiten(frame_of(spark, [(0, [1.0]), *rows]).filter("vec_id > 0")))
        assert out.count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(1, 9)]
    assert whitening.by_component(whitening.whiten(frame_of(spark, line))).select("component").distinct().count() == 1


@pytest.mark.parametrize("name", ["random", "multiple", "zero", "blocks", "one"])
def test_leading_pairs(name):
    rng = np.random.default_rng(1)
    matrices = {
        "random": np.cov(rng.standard_normal((40, 90))), "multiple": np.eye(9) * 3, "zero": np.zeros((4, 4)),
        "blocks": np.kron(np.eye(3), np.array([[2.0, 1.0], [1.0, 2.0]])), "one": np.array([[2.0]]),
    }
    m = matrices[name]
    e, z = whitening.leading_pairs(m, 8)
    assert np.allclose(e, np.linalg.eigvalsh(m)[::-1][:8], atol=1e-12)
    assert np.allclose(m @ z, z * e, atol=1e-12) and np.allclose(z.T @ z, np.eye(len(e)), atol=1e-12)


def test_exact_deviations_beyond_64_bits():
    x = np.array([[2**41, -(2**41)], [0, 5]])
    sums = [2**41, 5 - 2**41]
    assert whitening._deviations(x, 2, sums) == [sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]


# -- lines

GOOD = "This is an ordinary sentence about the weather in the hills, and it ends as it should."
PROSE = "\n".join(" ".join(random.Random(i).choices([f"word{j}" for j in range(300)], k=18)) + "." for i in range(6))
PAGES = [
    (1, PROSE),
    (2, PROSE + "\nHome | About | Contact | Shop\nAll rights reserved.\nRead More here."),
    (3, "\n".join(f"word{i}### other{i}&&& third{i}$$$ and{i}%%% more{i}***" for i in range(20))),
    (4, "short text."), (5, None), (6, ""), (7, " \n \t\n"), (8, "\n".join(["same line again and again."] * 30)),
    (9, "\n".join([GOOD] * 3 + ["Menu » Start » Help"] + ["no end here"] * 40)), (10, "\n\n" + GOOD + "\n\n" + GOOD + "\r\n" + GOOD + "\n"),
    (11, " ".join(f"w{i}" for i in range(30000))), (12, "a b c " * 20), (None, "é" * 60 + " " + " ".join(f"ü{i}" for i in range(60)) + "."),
    (4, "short text."), (13, PROSE + "\nThis site uses cookies to do things for you."),
]


def brute_lines(text):
    text, space = text or "", "[\x20\x09-\x0d]"
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = text.split("\n")
    spoken = [x for x in lines if re.sub(space, "", x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}

    def fails(line):
        n, chars = len(re.findall("[^\x20\x09-\x0d]+", line)), len(re.sub(space, "", line))
        sep = len(re.findall("[|»›•·]", line))
        closed = re.search("[.!?:;,…。！？\"'”’»)\\]]\\Z", line.rstrip("\x20\x09\x0a\x0b\x0c\x0d")) and not line.rstrip("\x20\x09\x0a\x0b\x0c\x0d").endswith(",")
        low = line.lower()
        return bool(chars) and (
            n < 12 and not closed or 100 * len(re.findall("[#*$%&|<>]", line)) > 10 * chars or sep >= 2 and n <= 4 * (sep + 1)
            or n < 30 and any(p in low for p in line_quality.PHRASES)
        )

    lost = sum(len(re.sub(space, "", x)) for x in lines if fails(x))
    chars = len("".join(w))
    base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    left = "\n".join(x for x in lines if not fails(x))
    counts = (len(w), chars, len(re.findall("[#*$%&|<>]", text)), len(spoken) - len(set(spoken)), len(hit))
    return (*counts, base, not base and 100 * lost <= 30 * chars, left)


def test_line_quality(spark):
    pages = docs_of(spark, [(i, t, "en") for i, t in PAGES])
    got = line_quality.judge(pages).drop("n_failed_lines", "lost_chars")
    wanted = sorted([(i, *brute_lines(t)) for i, t in PAGES], key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == wanted
    verdicts = {i: k for i, *_, k, _ in wanted}
    assert verdicts[1] and verdicts[2] and verdicts[13] and not verdicts[3] and not verdicts[8] and not verdicts[9]


def test_line_cleaning(spark):
    pages = docs_of(spark, [(i, t, "en") for i, t in PAGES])
    left = line_quality.clean(pages)
    assert left.columns == pages.columns
    wanted = {i: brute_lines(t)[-1] for i, t in PAGES if brute_lines(t)[-2]}
    assert {r.doc_id: r.text for r in left.collect()} == wanted
    assert "rights" not in wanted[2] and "cookies" not in wanted[13]
    assert line_quality.judge(pages.limit(0)).count() == 0 and line_quality.clean(pages.limit(0)).count() == 0


def test_hash_of_cleaned_text(spark):
    from cleargrain.llm import queries

    out = queries.op13_line_quality(spark, "/root/testdata/sf0.001").first()
    assert len(out.cleaned_sha256) == len(hashlib.sha256(b"").hexdigest())


def test_lines_are_measured_once(spark):
    """The words of a line are split once, not at every rule that asks for their number."""
    docs = spark.createDataFrame([(1, "a b\nc")], "doc_id bigint, text string")
    plan = line_quality.judge(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 3  # words of the text, lines, words of a line
