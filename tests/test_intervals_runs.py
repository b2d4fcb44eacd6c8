import itertools
import random

import numpy as np

from pyspark.sql import functions as F

from strandmill.operators import intervals, runs


def spans(rng, n, keys="ab", top=3000, most=400):
    return [(rng.choice(keys), i, a, a + rng.randrange(most)) for i in range(n) for a in [rng.randrange(top)]]


def frame(spark, rows, p):
    return spark.createDataFrame(rows, f"key string, {p}id int, {p}lo int, {p}hi int")


def test_overlap_and_containment(spark):
    rng = random.Random(1)
    x, y = spans(rng, 60), spans(rng, 60)
    bad = [("a", 900, 5, 1), (None, 901, 1, 2), ("a", 902, None, 5)]
    for bin_size in (50, 10_000):
        got = [(r.xid, r.yid) for r in intervals.overlap_join(frame(spark, x + bad, "x"), frame(spark, y + bad, "y"), "key", ("xlo", "xhi"), ("ylo", "yhi"), bin_size).collect()]
        assert sorted(got) == sorted((a[1], b[1]) for a, b in itertools.product(x, y) if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3])
        got = [(r.xid, r.yid) for r in intervals.contained_pairs(frame(spark, x, "x"), frame(spark, y, "y"), "key", ("xlo", "xhi"), ("ylo", "yhi"), bin_size).collect()]
        assert sorted(got) == sorted((a[1], b[1]) for a, b in itertools.product(x, y) if a[0] == b[0] and a[2] <= b[2] and b[3] <= a[3])


def test_beside_and_union_length(spark):
    rng = random.Random(2)
    x, y = spans(rng, 80, top=90_000), spans(rng, 6, top=90_000)
    got = {r.id for r in intervals.beside(frame(spark, x, ""), frame(spark, y, ""), "key", "lo", "hi", 1000).collect()}
    assert got == {a[1] for a in x if any(a[0] == b[0] and a[2] <= b[3] + 1000 and a[3] >= b[2] - 1000 for b in y)}
    z = spans(rng, 90)
    want = {k: len({p for a in z if a[0] == k for p in range(a[2], a[3] + 1)}) for k in "ab"}
    assert {r.key: r.covered for r in intervals.covered_length(frame(spark, z, ""), "key", "lo", "hi").collect()} == want
    assert {r.key: r.covered for r in intervals.union_length_windowed(frame(spark, z, ""), ["key"], "lo", "hi").collect()} == want


def greedy(rows):
    """Brute force over (key, id, lo, hi, score)."""
    want = set()
    for k in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[4], r[1])):
            if all(r[3] <= x[2] or r[2] >= x[3] for x in kept):
                kept.append(r)
        want |= set(kept)
    return want


def test_greedy_suppression(spark):
    rng = random.Random(4)
    rows = [(k, i, a, b + 1, rng.randrange(20)) for k, i, a, b in spans(rng, 150)]
    rows += [("c", 500, 0, 10, 5), ("c", 501, 10, 20, 5), ("c", 502, 5, 15, 9)]
    df = spark.createDataFrame(rows, "key string, id int, lo int, hi int, score int")
    assert {tuple(r) for r in intervals.greedy_non_overlapping(df, "key", "lo", "hi", "score", "id").collect()} == greedy(rows)


def test_greedy_over_many_bins(spark):
    """One continuous period over many bins, rows across their edges, a falling chain, far and negative ends, clashing columns."""
    rng = random.Random(8)
    at = [rng.randrange(-300_000, 900_000) for _ in range(600)]
    rows = [("hot", i, a, a + rng.choice([900, 9_000, 70_000, 200_000]), rng.randrange(50)) for i, a in enumerate(at)]
    rows += [("chain", 1000 + i, 60_000 * i, 60_000 * i + 70_000, 40 - i) for i in range(40)]
    rows += [("far", 2000 + i, 2**62 + 60_000 * i, 2**62 + 60_000 * i + 61_000, i) for i in range(5)]
    rows += [("one", 3000, 5, 6, 1)]
    schema = "key string, bin int, lo bigint, hi bigint, given int"
    got = intervals.greedy_non_overlapping(spark.createDataFrame(rows * 2, schema), "key", "lo", "hi", "given", "bin")
    assert got.columns == ["key", "bin", "lo", "hi", "given"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows)
    bad = [(None, 1, 0, 5, 1), ("a", 2, None, 5, 1), ("a", 3, 5, 5, 1), ("a", 4, 0, 5, None), ("a", 5, 4, 9, 0)]
    kept = intervals.greedy_non_overlapping(spark.createDataFrame(bad, schema), "key", "lo", "hi", "given", "bin")
    assert [r.bin for r in kept.collect()] == [5]
    assert intervals.greedy_non_overlapping(spark.createDataFrame([], schema), "key", "lo", "hi", "given", "bin").isEmpty()


def median(g):
    s, n = sorted(g), len(g)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def regular(xs):
    g = [b - a for a, b in zip(xs, xs[1:])]
    return all(abs(v - median(g)) <= 0.3 * median(g) for v in g)


def test_runs_like_brute_force(spark):
    rng = random.Random(3)
    rows, want, dense, spaced = [], set(), set(), set()
    for k in range(60):
        at, xs = 0, []
        for _ in range(rng.randrange(1, 22)):
            at += rng.choice([rng.randrange(60, 470), rng.randrange(150, 300), rng.randrange(400, 700), 99, 100, 450, 451])
            xs.append(at)
        rows += [(k, x, 0) for x in [*xs, xs[0]]]
        cur, groups = [xs[0]], []
        for a, b in zip(xs, xs[1:]):
            if 100 <= b - a <= 450:
                cur.append(b)
            else:
                groups.append(cur)
                cur = [b]
        for g in [*groups, cur]:
            best = next((tuple(g[i : i + n]) for n in range(len(g), 2, -1) for i in range(len(g) - n + 1) if regular(g[i : i + n])), None)
            if best:
                want.add((k, best))
        cur = [xs[0]]
        for a, b in [*zip(xs, xs[1:]), (xs[-1], xs[-1] + 10**6)]:
            if b - a <= 99:
                cur.append(b)
            else:
                if len(cur) > 1:
                    dense.add((k, cur[0], cur[-1], len(cur)))
                cur = [b]
        last = None
        for x in xs:
            if last is None or x - last >= 300:
                spaced.add((k, x))
                last = x
    df = spark.createDataFrame(rows, "k int, at int, island int")
    assert {(r.k, tuple(r.positions)) for r in runs.regular_runs(df, ["k"], "at").collect()} == want
    assert {(r.k, r.first, r["last"], r.n) for r in runs.dense_runs(df, ["k"], "at").collect()} == dense
    assert {(r.k, r.at) for r in runs.spaced_greedily(df, ["k"], "at", 300).collect()} == spaced
    assert runs.regular_runs(df.limit(0), ["k"], "at").collect() == []


def test_runs_by_stretches_are_the_same(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(30_000)) for k in "ab" for _ in range(120)] + [(None, 1), ("c", None)]
    df = spark.createDataFrame(rows, "k string, at int")
    cut = runs.stretches(df, "k", "at", 450, bin_size=700)
    assert cut.count() == 240
    whole, parts = (sorted((r.k, tuple(r.positions)) for r in runs.regular_runs(x.where("k is not null"), keys, "at").collect()) for x, keys in ((df, ["k"]), (cut, ["k", "stretch"])))
    assert whole == parts and whole
    d99 = runs.stretches(df, "k", "at", 99)
    a, b = (sorted((r.k, r.first, r["last"], r.n) for r in runs.dense_runs(x, keys, "at").collect()) for x, keys in ((df.where("k is not null"), ["k"]), (d99, ["k", "stretch"])))
    assert a == b and a


def test_reference_boundary_runs(spark):
    df = spark.createDataFrame([(0, x) for x in (0, 200, 400, 700, 900, 1100)], "k int, at int")
    assert [tuple(r.positions) for r in runs.regular_runs(df, ["k"], "at").collect()] == [(0, 200, 400)]


def test_signal_then_remark(spark):
    rows = [("a", 1, 0, 5), ("a", 2, 3, 0), ("a", 3, 0, 1), ("b", 1, 9, 4), ("b", 2, 0, 0), ("c", 1, 2, 4), ("d", 1, None, None)]
    df = spark.createDataFrame(rows, "k string, ln int, s int, r int")
    assert {(x.k, x.ln) for x in runs.signal_then_remark(df, ["k"], "ln", "s", "r").where("after_signal").collect()} == {("a", 3), ("c", 1)}
    merged = runs.merge_consecutive(spark.createDataFrame([("a", 1, "x", "p"), ("a", 2, "x", "q"), ("a", 4, None, "r"), ("a", 5, None, "s"), ("a", 6, "x", "t")], "k string, ln int, tag string, text string"), ["k"], "ln", "tag", "text")
    assert sorted((r.first, r["last"], r.n, r.text) for r in merged.collect()) == [(1, 2, 2, "pq"), (4, 5, 2, "rs"), (6, 6, 1, "t")]
    assert merged.where(F.col("tag").isNull()).count() == 1


def test_longest_tolerant_equals_trying_all():
    rng = random.Random(7)
    for _ in range(400):
        xs = np.cumsum([rng.choice([100, 120, 150, 180, 260, 300, 450]) + rng.randrange(9) for _ in range(rng.randrange(1, 14))])
        want = None
        for size in range(len(xs), 2, -1):
            for i in range(len(xs) - size + 1):
                gaps = np.diff(xs[i : i + size])
                mid = float(np.median(gaps))
                if want is None and max(gaps) - mid <= 0.3 * mid and mid - min(gaps) <= 0.3 * mid:
                    want = xs[i : i + size].tolist()
        got = runs.longest_tolerant(xs, 3, 0.3)
        assert (None if got is None else got.tolist()) == want
