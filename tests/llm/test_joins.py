"""kNN join, shingle join, components and mixing: against brute force, and on awkward rows."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from barleaf.llm import graph, jaccard, knn, mixing, shingles

from .conftest import same


# --- nearest by inner product


def brute_top(rows, k=5):
    valid = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (i, q) in enumerate(valid):
        if i % 50 == 0:
            # beyond 64 bits scores are cut, before ranking
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j) for at, (j, v) in enumerate(valid) if at != own and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("clusters", [1, 6])
def test_top_k_against_brute_force(spark, clusters, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 60)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    monkeypatch.setattr(knn, "PIVOTS", 12)
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 8)) * (10 if clusters > 1 else 0)
    rows = [(i, [float(np.float32(x)) for x in centres[i % clusters] + rng.normal(size=8)]) for i in range(400)]
    rows += [(i, [0.25] * 8) for i in range(400, 450)]  # ties
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert same(knn.top_k(table).collect(), brute_top(rows))


def sent_rows(rows, pivots, sizes):
    """How many vectors go to query groups, and in how many groups the queries are."""
    dealt = knn.dealt(rows, pivots, sizes)
    size, groups = knn.plan(dealt, pivots, sizes, 5)
    return knn.sent(dealt, groups, 1).count(), sizes[size]


def test_grouping_follows_what_the_bounds_leave_out(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(5, 6) * 50
    rows = [(i, [float(x) for x in centres[i // 7 % 5] + 0.1 * rng.normal(size=6)]) for i in range(500)]
    base = knn.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    sent, groups = sent_rows(base, {6: np.floor(256 * centres)}, [1, 5])
    # five far clusters: each group gets a fifth of the vectors or so
    assert groups == 5 and 0 < sent < 500 * 2
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(500)]
    base = knn.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    sent, groups = sent_rows(base, {6: np.array([r.q for r in base.limit(5).collect()], "f8")}, [1, 5])
    # nothing can be left out: every vector goes once
    assert groups == 1 and sent == 500


def test_top_k_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, None), (100, [float("nan"), 1.0]), (150, [float("inf"), 1.0]), (1, [1.0, None]), (2, [3.0, 4.0]), (3, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (200, []), (7, []), (250, [1e15, -1e15]), (4, [2e14, 1.0]), (-50, [1.0, 0.0])]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id long, embedding array<double>, VEC_ID string, score int")
    assert same(knn.top_k(table).collect(), brute_top(rows))
    assert knn.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# --- shingles


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, percent=75):
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))]


def test_shingle_hashes_follow_words():
    texts = ["a b c d e f", "A  B\tc d\ne F ", "a b c d e", "a b c", "ab c d e", None, "", " \n", "é É", "É é"]
    sets = shingles.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert (sets[0] == sets[1]).all() and set(sets[2]) < set(sets[0]) and set(sets[8]) != set(sets[9])
    long = " ".join(["w" * 40_000, "v" * 40_000, *"abc"])
    assert shingles.shingle_sets([long, long])[0].tolist() == shingles.shingle_sets(["x", long])[1].tolist()


def perturbed(rng, words, base, share):
    return [rng.choice(words) if rng.random() < share else w for w in base]


@pytest.mark.parametrize("seed", range(2))
def test_components_against_brute_force(spark, words, seed):
    rng = random.Random(seed)
    bases = [[rng.choice(words) for _ in range(rng.choice([4, 6, 30, 80]))] for _ in range(12)]
    passage = [rng.choice(words) for _ in range(20)]
    rows = []
    for i in range(260):
        base = rng.choice(bases)
        text = perturbed(rng, words, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))
        if i % 3 == 0:
            text = text + passage
        rows.append((i * 7 % 260, " ".join(text)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("row", "first").collect()
    assert same(got, brute_components(rows))


def test_a_large_group_of_near_copies(spark, words, monkeypatch):
    """Many edits of one text: hubs first, then every pair that is still apart; also when rounds are forced."""
    rng = random.Random(9)
    base = [rng.choice(words) for _ in range(60)]
    rows = [(i, " ".join(perturbed(rng, words, base, rng.choice([0.01, 0.03, 0.06])))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert same(jaccard.near_duplicates(docs).drop("row", "first").collect(), want)
    monkeypatch.setattr(jaccard, "PAIRS_EACH", -1)
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 2)
    assert same(jaccard.near_duplicates(docs).drop("row", "first").collect(), want)
    # no hub round, and all pairs in several passes
    monkeypatch.setattr(jaccard, "PAIRS_EACH", 20)
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 0)
    assert same(jaccard.near_duplicates(docs).drop("row", "first").collect(), want)


def test_frequent_columns_are_set_apart(spark, words, monkeypatch):
    """With columns of a fifth of all documents set apart, results stay the same."""
    rng = random.Random(4)
    base, passage = [rng.choice(words) for _ in range(40)], [rng.choice(words) for _ in range(25)]
    rows = [(i, " ".join(perturbed(rng, words, base, rng.choice([0, 0.01, 0.03])) if i % 3 else [rng.choice(words) for _ in range(15)] + passage)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "FREQUENT_SHARE", 0.2)
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 2)
    numbered = docs.selectExpr("monotonically_increasing_id() as rid", "doc_id", "text")
    found = jaccard.frequent_columns(numbered)
    counts = Counter(x for _, t in rows for x in set(shingles.shingle_sets([t])[0].tolist()))
    assert {k for k, n in counts.items() if n >= 0.2 * len(rows)} <= set(found.tolist()) and len(found) < len(counts)
    assert same(jaccard.near_duplicates(docs).drop("row", "first").collect(), brute_components(rows))


def test_large_columns_go_on_at_once(monkeypatch):
    """A block's task holds no column that reaches LARGE, whatever the slices; entries and codes are those of one sort."""
    monkeypatch.setattr(jaccard, "HELD", 500)
    monkeypatch.setattr(jaccard, "SORTED", 100)
    monkeypatch.setattr(jaccard, "LARGE", 40)
    rng = random.Random(7)
    block, want, held, out = jaccard.ColumnBlock(3, 4, 5), Counter(), 0, []
    for rid in range(2000):
        own = sorted({1 if rng.random() < 0.8 else 2, *(rng.randint(10, 4000) for _ in range(3))})
        keys = np.array(own, "u8")
        want.update(own)
        row = {"runs": np.array([rid], "i8").tobytes(), "sizes": np.array([9], "i4").tobytes(), "counts": np.array([len(own)], "i4").tobytes(), "low": keys.astype("u4").tobytes(), "high": np.zeros(len(own), "u2").tobytes()}
        out += block.add(row)
        held = max(held, block.entries)
    out += block.settle(True)
    got, codes = Counter(), {}
    for t in out:
        for r in t.to_pylist():
            ids, code = np.frombuffer(r["low"], "u8"), np.frombuffer(r["codes"], "u1")
            runs, counts = np.frombuffer(r["runs"], "i8"), np.frombuffer(r["counts"], "i4")
            assert counts.sum() == len(ids) and (jaccard.part_of(runs, 5) == r["block"]).all() and (ids >> np.uint64(48) == 3).all()
            for x, c in zip((ids & jaccard.LOW48).tolist(), code.tolist()):
                got[x] += 1
                assert codes.setdefault(x, c) == c
    assert got == Counter({k: n for k, n in want.items() if n > 1})
    assert all(codes[k] == int(min(254, 8 * math.log2(min(40, n)))) for k, n in want.items() if n > 1)
    assert held < sum(want.values()) - want[1] + 500


def test_sets_of_a_slice_in_pieces(prose, monkeypatch):
    texts = [None, "", prose(1, 50), prose(2, 3), prose(3, 400), "", prose(4, 9)]
    monkeypatch.setattr(jaccard, "SLICE_CHARS", 300)
    assert [s.tolist() for s in jaccard.sets_of(texts)] == [s.tolist() for s in shingles.shingle_sets(texts)] and jaccard.sets_of([]) == []


def test_column_ids_do_not_wrap():
    hashes = shingles.mix(np.arange(2000, dtype="u8"))
    for bits in (0, 7, 16, 18, 24):
        home = hashes >> np.uint64(64 - bits) if bits else np.zeros(2000, "u8")
        ids = jaccard.column_ids(home, hashes & jaccard.LOW48, bits)
        assert len(set(ids.tolist())) == 2000 and (bits < 16 or (ids == hashes).all())


def test_given_row_numbers_and_first_rows(spark, prose):
    a, b = prose(1, 30), prose(2, 30)
    rows = [(5, a, 10), (5, b, 11), (5, a + " x", 12), (None, a, 13), (3, b, 14), (None, None, 15), (None, None, 16)]
    got = {r.row: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, number long"), row="number").collect()}
    assert {k: r.first for k, r in got.items()} == {10: True, 11: False, 12: False, 13: False, 14: True, 15: True, 16: True}
    assert [got[k].component_id for k in (10, 11, 12, 13, 14, 15)] == [5, 3, 5, 5, 3, None]


def test_jaccard_rows(docs, clashing, empty, rows):
    want = brute_components(rows)
    assert same(jaccard.near_duplicates(docs).drop("row", "first").collect(), want)
    assert same(jaccard.near_duplicates(clashing).drop("row", "first").collect(), want)
    assert jaccard.near_duplicates(empty).count() == 0


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(100)] + [(200 + i, 200) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {200 + i: 200 for i in range(1, 50)}


# --- mixing


def water_fill(sizes, weights):
    """Share by weight, stop at the caps, share the excess again until none is above."""
    caps, target, free = [2.0 * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    left = 1.5 * sum(sizes)
    while free and left > 1e-9:
        total = sum(weights[i] for i in free)
        add = {i: left * weights[i] / total for i in free}
        left = 0.0
        for i, x in add.items():
            target[i] += x
            if target[i] >= caps[i] - 1e-12:
                left += target[i] - caps[i]
                target[i] = caps[i]
                free.discard(i)
    return target


def test_targets_against_resharing():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 50, 1000]) * rng.randint(0, 9) for _ in range(rng.randint(1, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        at = lambda x: [2 * s <= x * w for s, w in zip(sizes, weights)]
        stopped = lambda x: (sum(2 * s for s, y in zip(sizes, at(x)) if y), sum(w for w, y in zip(weights, at(x)) if not y), sum(at(x)))
        level = mixing.water_level(1.5 * sum(sizes), stopped)
        assert np.allclose([min(2.0 * s, level * w) for s, w in zip(sizes, weights)], water_fill(sizes, weights), rtol=1e-9, atol=1e-6)


def test_plan_of_many_sources(spark):
    """Ordinals and targets of a table of sources that lies in several ranges."""
    rng = random.Random(6)
    names = {f"{rng.choice('aZé漢😀/')}{i:03d}": rng.choice([0, 1, 7, 300, 20_000]) for i in range(400)}
    rows = [(f"v{k}", n, 1) for k, n in names.items()] + [("n", 50, 2)]
    got = {r.s: r for r in mixing.source_plan(spark.createDataFrame(rows, "s string, size long, m long").repartition(5)).collect()}
    order = [f"v{k}" for k in sorted(names, key=lambda k: k.encode())] + ["n"]
    sizes = [100 if s == "n" else names[s[1:]] for s in order]
    want = water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert len(got) == len(order) and all(got[s].source_size == n and abs(got[s].target - t) < 1e-6 * (1 + t) for s, n, t in zip(order, sizes, want))


def test_budgets_above_the_exact_range(monkeypatch):
    """The branch that fills by whole documents first leaves no more than the exact one."""
    rng = random.Random(5)
    monkeypatch.setattr(mixing, "EXACT", 64)
    for _ in range(60):
        k = rng.randint(2, 30)
        sizes, counts = np.array(sorted(rng.sample(range(1, 400), k))), np.array([rng.randint(1, 40) for _ in range(k)])
        total = int((sizes * counts).sum())
        budget = rng.randint(total // 10, total - 1)
        taken = mixing.fit(sizes, counts, budget)
        left = budget - int((taken * sizes).sum())
        assert (0 <= taken).all() and (taken <= counts).all() and left >= 0
        # no spare document fits into what is left
        assert not any(c > t and s <= left for s, c, t in zip(sizes, counts, taken))


def test_knapsack_against_all_sums():
    rng = random.Random(3)
    for _ in range(150):
        k = rng.randint(1, 4)
        sizes, counts = np.array(rng.sample(range(1, 15), k)), np.array([rng.randint(0, 3) for _ in range(k)])
        budget = rng.randint(0, 60)
        sums = {sum(n * s for n, s in zip(ns, sizes)) for ns in itertools.product(*(range(c + 1) for c in counts))}
        taken = mixing.knapsack(sizes, counts, budget)
        assert (taken <= counts).all() and (taken * sizes).sum() == max(s for s in sums if s <= budget)


def check_mix(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r[0], size(r[1]), r[3]) for r in rows) == Counter((g.doc_id, g["size"], g.source) for g in got)
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    totals = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in order}
    want = dict(zip(order, water_fill(list(totals.values()), [(5, 2, 1)[i % 3] for i in range(len(order))])))
    for s in order:
        mine = [g for g in got if g.source == s]
        assert {g.source_size for g in mine} == {totals[s]} and all(abs(g.target - want[s]) < 1e-6 for g in mine)
        longest = max((g["size"] for g in mine), default=0)
        assert abs(sum(g.taken for g in mine) - want[s]) <= longest
    assert all(g.taken <= 2 * g["size"] and (not g["size"] or g.taken % g["size"] == 0) for g in got)


def test_mix_of_many_documents(spark, prose, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 8)
    rng = random.Random(8)
    rows = [(i, prose(i, rng.choice([1, 2, 3, 10, 10, 10, 57])), None, None if i % 11 == 0 else f"s{min(rng.randint(0, 9), 6)}") for i in range(600)]
    rows += [(1000, "same words here", None, "s1")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix_sources(docs).collect()
    check_mix(rows, got)
    assert same(got, mixing.mix_sources(docs.repartition(7)).collect())
    # with small documents at hand the sums are met exactly
    assert all(abs(sum(g.taken for g in got if g.source == s) - next(g.target for g in got if g.source == s)) <= 0.5 for s in {g.source for g in got})


def test_mix_rows(docs, clashing, empty, rows):
    check_mix(rows, mixing.mix_sources(docs).collect())
    check_mix(rows, mixing.mix_sources(clashing).collect())
    assert mixing.mix_sources(empty).count() == 0
