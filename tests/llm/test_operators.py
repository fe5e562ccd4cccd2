"""The dealt operators against brute force on small tables with nulls, empty texts, repeated rows and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from cleargrain.llm import decontaminate, digests, licences, mixing, passages, queries, shards, simhash, suffixes, tokens, toxicity

SCHEMA = "doc_id bigint, text string, lang string, bucket int, `Text_Key` string, token string"
VOCABULARY = [f"word{i:03d}" for i in range(400)]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


BENCHMARK = [(1, prose("item", 14)), (2, "Short One"), (3, None), (4, ""), (10, prose("item", 12)), (None, prose("other", 11))]
LONG = prose("long", 6000)
PASSAGE = prose("passage", 80)


def corpus():
    rows = [(i, prose(i, 20 + i)) for i in range(30)]
    rows += [(40 + i, prose("copy", 60)) for i in range(12)]
    rows += [(60 + i, prose("copy", 60).replace("word001", "WORD001") + f" tail{i}") for i in range(5)]
    rows += [(70, prose("a", 30) + " " + PASSAGE), (71, PASSAGE + " " + prose("b", 25)), (72, "é " + PASSAGE.replace(" ", "  "))]
    rows += [(80, "x " + prose("item", 14) + " y"), (81, "a SHORT-one here"), (82, "short"), (83, prose("other", 11).upper())]
    rows += [(90, ""), (91, None), (92, " \n\t "), (93, "..."), (94, LONG), (95, LONG + " end"), (96, "日本語 ÀÉ text"), (96, "日本語 ÀÉ text")]
    return rows + [(None, "no id at all"), (-5, prose("negative", 30)), (97, " nbsp   x")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "k", None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [(1, "x")]).limit(0)


def table(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# -- token blocks


def test_blocks_hold_any_ids():
    for ids in ([], [5], [7] * 300, [0, 2**32 - 1] * 100, random.Random(1).choices(range(50_000), k=777), [3] * 127 + [2**31]):
        packed = tokens.pack(np.array(ids, np.uint32))
        assert tokens.unpack(packed).tolist() == ids
        assert tokens.unpack(packed, 1, 2).tolist() == ids[tokens.BLOCK : 2 * tokens.BLOCK]


def test_encoder_learns_each_spelling_once():
    encode = tokens.Encoder(queries.tokenizer_path(), 2)
    for text in ("The the THE tHe", "DON'T don't Don'T", "A1b2 \u00c9T\u00c9 \u00e9t\u00c9 X\u00d7Y", "<|ENDOFTEXT|> The", "\u0130I \u01c4 \u03a3A\u03a3", "Q.E.D.,\tIT'S"):
        ids = encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == [*ids, 2]
    assert b"the" in encode.known and not any(p != p.lower() for p in encode.known)


def test_token_digests(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own = Tokenizer.from_file(path)
    # null ids come first; the two rows with id 96 are equal
    wanted, start = [], 0
    for i, t in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert table(tokens.token_digests(docs, path, 2), *columns) == sorted(wanted, key=repr)
    assert tokens.token_digests(empty, path, 2).count() == 0


# -- decontamination


def brute_contamination(items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[i : i + 10])].add("" if item is None else str(item))
    out = []
    for i, text in corpus():
        w, hit, found = words(text), set(), set()
        for win, own in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found |= own
        names = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame(BENCHMARK, "item_id int, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert table(decontaminate.contamination(docs, items), *columns) == brute_contamination(BENCHMARK)
    assert table(decontaminate.contamination(docs, items.limit(0)), *columns) == brute_contamination([])
    assert decontaminate.contamination(empty, items).count() == 0


def test_contaminated_rows_go(spark, docs):
    items = spark.createDataFrame(BENCHMARK, "item_id int, text string")
    left = decontaminate.decontaminate(docs, items)
    hit = Counter(i for i, *_, bad in brute_contamination(BENCHMARK) if bad)
    assert left.columns == docs.columns
    assert Counter(r[0] for r in left.select("doc_id").collect()) == Counter(i for i, _ in corpus()) - hit


# -- licences, shards


def test_licences(spark, empty):
    rows = [(1, "some prose about plants\nLicensed under the MIT License."), (2, "Released under Apache License 2.0."), (3, None), (4, ""), (4, "")]
    rows += [(10 + i, prose(i, 40)) for i in range(40)] + [(60, "an ordinary day in the city with the usual terms")]
    got = {r.doc_id: r.families for r in licences.scan_licences(frame(spark, rows)).collect()}
    assert got.pop(1) == "MIT" and got.pop(2) == "Apache-2.0" and set(got.values()) == {""}
    assert licences.scan_licences(frame(spark, rows)).count() == len(rows)
    assert licences.scan_licences(empty).count() == 0


def test_shards(spark, docs, empty):
    names = [f"s{i}" for i in range(7)]
    owner = shards.lookup_table(names, 1009)
    sizes = Counter(owner)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = shards.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 6)
    assert moved < 1009 / 4
    got = shards.shard_documents(docs, 7, 1009).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in corpus())
    table_of = shards.lookup_table([f"shard-{i:05d}" for i in range(7)], 1009)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 1009 and r.shard == table_of[r.slot]
    assert shards.shard_documents(empty).count() == 0
    with pytest.raises(ValueError):
        shards.lookup_table(["a", "a"])


# -- mixing


def test_mixture_meets_targets(spark, empty):
    rows = [(i, prose(i, 60) if i % 3 else " ".join(f"odd{(i * k) % 50}" for k in range(60))) for i in range(1, 90)] + [(200, None), (201, ""), (None, "word001")]
    docs, weights = frame(spark, rows), {"clean": 0.5, "low": 0.5}
    domains = spark.createDataFrame([(i, "clean" if i % 3 else "low") for i in range(1, 60)] + [(None, "low"), (61, None), (62, "alien")], "doc_id bigint, domain string")
    rated = mixing.mixture(docs, domains, weights).collect()
    assert len(rated) == len(rows) and all(r.rate >= 0 for r in rated)
    sums = [sum(r.rate * r.n_tokens * r.p[k] for r in rated) for k in range(2)]
    assert sums[0] / sum(sums) == pytest.approx(0.5, abs=0.01)
    mixed = mixing.mix(docs, domains, weights)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rated)
    assert mixing.mixture(empty, domains, weights).count() == 0
    assert mixing.mixture(docs, domains.limit(0), weights).count() == len(rows)


def soft_members(spark, shares, certainty, n=600):
    """Documents of known domains whose memberships are only partly certain."""
    draw, rows = np.random.default_rng(5), []
    for i in range(n):
        own = draw.choice(len(shares), p=shares)
        p = np.array(shares) * np.exp(certainty * draw.normal(2.0 * (np.arange(len(shares)) == own), 1.0))
        rows.append((i, i, 1, int(draw.integers(20, 400)), (p / p.sum()).tolist()))
    return spark.createDataFrame(rows, "doc_id long, text_key long, rows long, n_tokens long, p array<double>")


@pytest.mark.parametrize("shares, weights", [((0.9, 0.05, 0.05), (0.85, 0.12, 0.03)), ((0.6, 0.4), (0.88, 0.12))])
@pytest.mark.parametrize("certainty", [0.6, 1.0, 2.0])
def test_soft_memberships_meet_targets(spark, shares, weights, certainty):
    members = soft_members(spark, shares, certainty)
    rows = members.collect()
    n, p = np.array([r.n_tokens for r in rows], float), np.array([r.p for r in rows])
    total = max(n @ p / weights)
    rated, reached = mixing.fit_rates(members, [w * total for w in weights])
    rate = np.array([r.rate for r in sorted(rated.collect(), key=lambda r: r.doc_id)])
    assert (rate >= 0).all() and (rate * n) @ p == pytest.approx(reached)
    assert np.array(reached) / total == pytest.approx(weights, abs=mixing.TOLERANCE)


def test_targets_out_of_reach_are_told(spark):
    docs, domains = frame(spark, [(i, prose(i, 30)) for i in range(40)]), spark.createDataFrame([(1, "alien")], "doc_id bigint, domain string")
    with pytest.warns(UserWarning, match="cannot be reached"):
        mixing.mixture(docs, domains, {"clean": 0.88, "low": 0.12})


# -- toxicity


def labelled(spark, sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_toxicity_on_held_out_labels(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    rows = toxicity.score_documents(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    y, p = np.array([r.toxic for r in rows]), np.array([r.predicted for r in rows])
    assert y.sum() > 20
    assert (p & y).sum() / y.sum() > 0.85 and (p & y).sum() / p.sum() > 0.85


def test_toxicity_edges(spark, docs, empty):
    model = {"": -3.0, "=vile": 9.0}
    rows = frame(spark, [(1, "A vile thing. A fine day."), (2, None), (3, ""), (None, "vile"), (4, "x " * 50_000)])
    got = {r.doc_id: r for r in toxicity.score_documents(rows, model).collect()}
    assert got[1].predicted == got[None].predicted == 1 and got[2].score == got[3].score == 0
    assert got[1].held_out == (zlib.crc32(b"1") % 4 == 2)
    spans = toxicity.offending_sentences(rows, model).collect()
    assert {(r.doc_id, r.start) for r in spans} == {(1, 0), (None, 0)}
    assert toxicity.drop_toxic(rows, model).columns == rows.columns and toxicity.drop_toxic(rows, {"": -30.0}).count() == 5
    assert toxicity.score_documents(empty, model).count() == 0
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int")) == {"": -30.0}


# -- passages and byte strings


def test_passages(spark, docs, empty):
    found = passages.shared_passages(docs).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    assert any(a == 71 and b == 70 or a == 72 and b in (70, 71) for a, b in pairs)
    assert {71, 72} <= {a for a, _ in pairs} and 95 in {a for a, _ in pairs}
    assert not {i for i in range(30)} & {a for a, _ in pairs}
    assert passages.shared_passages(empty).count() == 0


def words_covered(found, doc, other=None):
    """Words of ``doc`` that lie in its passages."""
    own = [r for r in found if r.doc_id == doc and other in (None, r.other_id)]
    return {w for r in own for w in range(r.start_word, r.end_word)}


def test_passages_with_other_words_between(spark):
    rows = []
    for i, between in enumerate([20, 40, 50, 60, 70, 90, 150]):
        one, two = prose(f"one{i}", 60), prose(f"two{i}", 60)
        for side in (0, 1):
            rows.append((100 * i + side, f"{prose(f'l{i}{side}', 30)} {one} {prose(f'm{i}{side}', between)} {two} {prose(f'r{i}{side}', 30)}"))
        rows.append((100 * i + 50, f"{prose(f'x{i}', 30)} {two} {prose(f'y{i}', 30)}"))
    found = passages.shared_passages(frame(spark, rows)).collect()
    for i, between in enumerate([20, 40, 50, 60, 70, 90, 150]):
        whole = {*range(30, 90), *range(90 + between, 150 + between)}
        assert whole <= words_covered(found, 100 * i + 1, 100 * i), between
        assert set(range(30, 90)) <= words_covered(found, 100 * i + 50), between
    assert all(r.alike >= 0.8 and min(r.end_word - r.start_word, r.other_end - r.other_start) >= 40 for r in found)


def passages_of_all_pairs(rows):
    """Passages of every document with every earlier one, from all places of all common seeds, without those in better ones."""
    texts = [t.encode() for _, t in rows]
    hashes, owner = passages.word_hashes(texts)
    words = [hashes[owner == i].tolist() for i in range(len(rows))]
    places = [defaultdict(list) for _ in rows]
    for h, d, at in zip(*(x.tolist() for x in passages.seeds(texts))):
        places[d][h].append(at)
    out = set()
    for b, (kb, _) in enumerate(rows):
        found = []
        for a, (ka, _) in enumerate(rows[:b]):
            anchors = [(x, y) for h in places[a] if h in places[b] for x in places[a][h] for y in places[b][h]]
            for a0, a1, b0, b1, _ in passages.chain(anchors):
                i, j = max(0, a0 - passages.MARGIN), max(0, b0 - passages.MARGIN)
                own = words[a][i : a1 + passages.MARGIN], words[b][j : b1 + passages.MARGIN]
                for p0, p1, q0, q1, paired in passages.align(*own, a0 - i, a1 - i, b0 - j, b1 - j):
                    found.append((-paired, -ka, q0 + j, p0 + i, q1 + j, p1 + i))
        covered = set()
        for paired, other, q0, p0, q1, p1 in sorted(found):
            if len({*range(q0, q1)} - covered) >= passages.SEED_WORDS:
                covered.update(range(q0, q1))
                out.add((kb, q0, q1, -other, p0, p1, -paired / max(q1 - q0, p1 - p0)))
    return sorted(out)


def test_passages_of_frequent_lines_as_brute_force(spark):
    """A passage of lines that many other documents quote singly, before, between and after its copies."""
    lines = [prose(f"line{i}", 22) for i in range(4)]
    rows, n = [], 2 * passages.FREQUENT
    for i in range(n):
        rows += [(10 * i + j, f"{prose(f'p{i}{j}', 25)} {line} {prose(f'q{i}{j}', 25)}") for j, line in enumerate(lines)]
    rows += [(10 * i + 5, f"{prose(f's{i}', 15)} {lines[0]} {lines[1]} {prose(f't{i}', 15)}") for i in (1, n // 2, n - 1)]
    rows += [(10 * i + 6, f"{prose(f'u{i}', 15)} {lines[2]} new {lines[3]} {lines[0]} {prose(f'v{i}', 15)}") for i in (0, n // 2)]
    rows += [(10 * i + 7, prose("near", 70).replace(f"word{i:03d}", "edited") + f" end{i}") for i in range(n)]
    rows += [(10 * i + 8, f"{prose(f'w{i}', 20)} {prose('few', 55)}") for i in range(5)]
    rows.sort()
    columns = ["doc_id", "start_word", "end_word", "other_id", "other_start", "other_end", "alike"]
    want = sorted(passages_of_all_pairs(rows), key=repr)
    assert {10 * (n // 2) + 5, 10 * (n - 1) + 5, 10 * (n // 2) + 6} <= {r[0] for r in want}
    for n_partitions in (1, 7):
        assert table(passages.shared_passages(frame(spark, rows).repartition(n_partitions)), *columns) == want


def test_segments_go_to_few_families_of_seeds(spark):
    """Near copies of a long text, some with a line of others: sent a few times, not once for each of 200 seeds."""
    draw, rows, segments = random.Random(3), [], {}
    for i in range(80):
        key = [1000 + j for j in range(200) if draw.random() > 0.02] + ([7, 8, 9] if i % 2 else [])
        key = [7, 8, 9] if i % 5 == 0 else key
        segments[i] = set(key)
        rows.append((i, 5, np.array(key, "<i8").tobytes(), np.arange(0, 3 * len(key), 3, "<u4").tobytes()))
    many = spark.createDataFrame(rows, "k bigint, text_key bigint, keys binary, at binary")
    found = {r.k: {p.family for p in r.places} for r in passages.families(many).collect()}
    assert max(map(len, found.values())) <= 3
    assert all(found[i] & found[j] for i in found for j in found if segments[i] & segments[j])


def test_texts_and_segments_too_short_for_a_passage_are_not_sent():
    texts = [prose(f"t{n}", n).encode() for n in (passages.LEAST_WORDS - 1, passages.LEAST_WORDS)]
    z = [zstandard.ZstdCompressor().compress(t) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([5, 5]), pa.array(z, pa.binary())], ["k", "text_key", "z"])
    sent = [r for b in passages._send_seeds(1)(iter([batch])) for r in b.to_pylist()]
    assert [np.frombuffer(r["ids"], np.int64).tolist() for r in sent] == [[2, 5, passages.LEAST_WORDS]]
    for last, words, found in ((18, 100, 0), (19, 100, 1), (19, 39, 0)):
        assert len(passages.segments(np.array([0, 4, 9, last]), words)) == found


def test_equal_passages_in_one_document_of_frequent_seeds_as_brute_force(spark):
    """Of a line that a document has twice, far apart, the first place counts; texts of a few words have the line's seeds too."""
    line, n = prose("line", 45), 2 * passages.FREQUENT
    rows = [(i, f"{prose(f'p{i}', 20)} {line} {prose(f'q{i}', 20)}") for i in range(n)]
    rows += [(n + i, " ".join(line.split()[: 30 + i])) for i in range(5)]
    rows += [(2 * n, f"{prose('x', 9)} {line} {prose('y', 400)} {line} {prose('z', 9)}"), (2 * n + 1, f"{prose('v', 9)} {line} {prose('w', 9)}")]
    columns = ["doc_id", "start_word", "end_word", "other_id", "other_start", "other_end", "alike"]
    want = sorted(passages_of_all_pairs(rows), key=repr)
    assert (2 * n + 1, 9, 54, 2 * n, 9, 54, 1.0) in want
    assert table(passages.shared_passages(frame(spark, rows)), *columns) == want


def test_any_likely_range():
    draw = random.Random(5)
    for _ in range(300):
        known = np.array([draw.random() < draw.choice([0.5, 0.8, 0.9]) for _ in range(draw.randrange(30, 110))], bool)
        assert passages.any_likely(known) == bool(passages.likely_ranges(known))


def test_likely_ranges_as_brute_force():
    draw = random.Random(1)
    for _ in range(100):
        share = draw.choice([0.3, 0.7, 0.8, 0.9])
        known = [draw.random() < share for _ in range(draw.randrange(110))]
        want = set()
        for lo in range(len(known)):
            for hi in range(lo + passages.LEAST_WORDS, len(known) + 1):
                if sum(known[lo:hi]) >= passages.LEAST_ALIKE * (hi - lo):
                    want.update(range(lo, hi))
        assert {i for r in passages.likely_ranges(np.array(known, bool)) for i in range(*r)} == want


def test_scores_of_anchors_in_step():
    draw = random.Random(4)
    for _ in range(200):
        xy = [*zip(*(sorted(draw.sample(range(400), 25)) for _ in "ab"))]
        assert passages._scores_in_step(xy) == passages._scores(xy)


def test_links_of_repeated_words(spark):
    rows = [(i, f"{prose(f'l{i}', 20)} {'again ' * (40 + i)} {prose(f'r{i}', 20)}") for i in range(2 * passages.FREQUENT)]
    found = passages.shared_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in found} == {*range(1, len(rows))}
    assert all(len(set(range(20, 60 + i)) - words_covered(found, i)) <= 1 for i in range(1, len(rows)))


def test_later_copies_of_a_text(spark):
    rows = [(5, PASSAGE), (3, PASSAGE), (3, PASSAGE), (None, "short"), (9, "short"), (9, PASSAGE), (12, PASSAGE + " " + prose("c", 9))]
    found = table(passages.shared_passages(frame(spark, rows)), "doc_id", "start_word", "end_word", "other_id")
    assert found == [(12, 0, 80, 3), (5, 0, 80, 3), (9, 0, 80, 3)]


def test_length_of_common_words():
    draw = random.Random(2)
    for _ in range(300):
        a, b = ([draw.randrange(9) for _ in range(draw.randrange(90))] for _ in (0, 1))
        assert passages.common_length(a, b) == len(passages.common_words(a, b))


def test_common_words_as_brute_force():
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    draw = random.Random(1)
    for _ in range(300):
        a, b = ([draw.randrange(6) for _ in range(draw.randrange(30))] for _ in (0, 1))
        path = passages.common_words(a, b)
        assert len(path) == longest(a, b) and all(a[i] == b[j] for i, j in path)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(path, path[1:]))


def brute_repeats(rows, length=50):
    first = {}
    key = lambda i: float("-inf") if i is None else i
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, float("inf")), key(i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_bytes(spark, docs, empty):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert table(suffixes.remove_repeats(docs), *columns) == brute_repeats(corpus())
    runs = [(1, "a" * 500), (2, "a" * 49), (3, "b" + "a" * 50), (4, "ab" * 300), (5, "ab" * 30), (6, ("é" * 40)), (7, "x" + "é" * 30)]
    assert table(suffixes.remove_repeats(frame(spark, runs)), *columns) == brute_repeats(runs)
    assert suffixes.remove_repeats(empty).count() == 0


# -- exact and near copies


def test_exact_classes(docs, empty):
    groups = defaultdict(list)
    for i, t in corpus():
        groups[lower(t)].append(i)
    got = digests.exact_dedup_in_two(docs).collect()
    assert len(got) == len(corpus()) and sum(r.kept for r in got) == len(groups)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): own for t, own in groups.items()}
    for r in got:
        own = by_hash[r.text_sha256]
        assert r.doc_id in own and r.group_size == len(own) and r.keep_id == max(own, key=lambda i: float("-inf") if i is None else i)
    assert digests.exact_dedup_in_two(empty).count() == 0


def brute_print(text, words=3):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    runs = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    ones = Counter(b for s in runs for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs))


def brute_components(prints, ids, distance):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for x, i in enumerate(ids):
        least[find(x)].append(i)
    return [min((i for i in least[find(x)] if i is not None), default=None) for x in range(len(ids))]


def test_simhash_classes(docs, empty):
    ids, prints = [i for i, _ in corpus()], [brute_print(t) for _, t in corpus()]
    wanted = [(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, brute_components(prints, ids, 2))]
    assert table(simhash.near_classes(docs), "doc_id", "fingerprint", "component_id") == sorted(wanted, key=repr)
    assert simhash.near_classes(empty).count() == 0


def test_simhash_links_at_every_distance(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({p ^ sum(1 << b for b in rng.sample(range(64), k)) for p in base for k in range(8)})
    stored = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print bigint")
    for distance in (0, 2, 5):
        got = {(r.a, r.b) for r in simhash.links(stored, distance).collect()}
        signed = sorted(map(simhash._signed, prints))
        assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= distance}


def test_links_of_dense_groups_stay_few(spark, monkeypatch):
    """Near copies are connected without all their pairs; chains and unlike fingerprints keep their components."""
    rng, distance = random.Random(11), 6
    centre, other = rng.getrandbits(64), rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(1200)}  # 6 bits apart at most
    prints |= {other ^ ((1 << k) - 1) for k in range(0, 64, 5)} | {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    rng.shuffle(prints)
    met, components = [], simhash.connected_components
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: docs)
    monkeypatch.setattr(simhash, "connected_components", lambda edges: met.append(edges.count()) or components(edges))
    docs = spark.createDataFrame([(i, simhash._signed(p)) for i, p in enumerate(prints)], "doc_id bigint, print bigint")
    got = table(simhash.near_classes(docs, 5, distance), "doc_id", "component_id")
    assert got == sorted(zip(range(len(prints)), brute_components(prints, range(len(prints)), distance)), key=repr)
    assert sum(met) < (distance + 1) * simhash.DRAWN * len(prints)  # the large group has over 600,000 pairs


def test_near_copies_go(spark, docs, empty):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", lower(t))
    sets, order = {}, {}
    for i, t in corpus():
        w = words(t)
        rank = (i is None, i or 0)
        if tuple(w) not in order or rank < order[tuple(w)][0]:
            order[tuple(w)] = rank, i, t
        sets[tuple(w)] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    classes = [(rank, i, t, w) for w, (rank, i, t) in sorted(order.items(), key=lambda x: x[1][0])]
    prints = [brute_print(t, 5) for _, _, t, _ in classes]
    group = brute_components(prints, list(range(len(classes))), 6)
    kept = []
    for x, (_, i, _, w) in enumerate(classes):
        mine = [y for y in kept if group[y] == group[x]]
        if not any(len(sets[w] & (o := sets[classes[y][3]])) >= 0.8 * len(sets[w] | o) for y in mine):
            kept.append(x)
    got = simhash.near_dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted((classes[x][1] for x in kept), key=repr)
    assert simhash.near_dedup(empty).count() == 0


def test_confirmed_copies_in_large_groups(spark, monkeypatch):
    """Groups of many unlike texts and of many copies are settled as if row by row, in few rounds."""
    monkeypatch.setattr(simhash, "LEADERS", 8)
    monkeypatch.setattr(simhash, "COMPARED", 20)
    rng, rows = random.Random(3), []
    for i in range(240):
        own = set(range(1000 * (i % 40), 1000 * (i % 40) + 30)) if i % 2 else {rng.randrange(10**6) for _ in range(20)}
        rows.append((i, i % 3 if i < 200 else 9, sorted(own - {rng.choice(sorted(own))})))
    members = spark.createDataFrame(rows, "place bigint, component int, set array<bigint>").repartition(3).cache()
    stay, gone = {}, set()
    for place, component, own in rows:
        kept = stay.setdefault(component, [])
        if any(len(k & set(own)) >= 0.8 * len(k | set(own)) for k in kept):
            gone.add(place)
        else:
            kept.append(set(own))
    assert {r.place for r in simhash._confirmed(members, 0.8).collect()} == gone and len(gone) > 30
    assert simhash._confirmed(members.limit(0), 0.8).count() == 0
