import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.operators.periods import BITS, dyadic_cover, periods_and_gaps


def brute(rows):
    out = set()
    by = {}
    for k, s, e in rows:
        if None not in (k, s, e):
            by.setdefault(k, []).append((min(s, e), max(s, e)))
    for k, xs in by.items():
        merged = []
        for lo, hi in sorted(xs):
            if merged and lo <= merged[-1][1] + 1:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        out |= {(k, "period", a, b) for a, b in merged}
        out |= {(k, "gap", x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])}
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 63), st.integers(0, 63)), max_size=30))
def test_blocks_cover_exactly(rows):
    g = np.array([r[0] for r in rows], np.int64)
    lo = np.array([min(r[1:]) for r in rows], np.int64)
    hi = np.array([max(r[1:]) for r in rows], np.int64)
    got = {(int(a), "period", int(b), int(c)) for a, b, c in zip(*dyadic_cover(g, lo, hi, bits=6))}
    assert got == {r for r in brute([(int(a), int(b), int(c)) for a, b, c in zip(g, lo, hi)]) if r[1] == "period"}


def run(spark, rows):
    df = spark.createDataFrame(rows, "k string, s int, e int, lo int, hi int, bin int, span_kind string")
    return [tuple(r) for r in periods_and_gaps(df, "k", "s", "e").collect()]


def test_random_nested_touching_and_long(spark):
    rng = np.random.default_rng(5)
    top = 1 << BITS
    rows = [("a", 10, 20), ("a", 21, 30), ("a", 32, 40), ("a", 12, 15), ("b", 50, 40), ("", 1, 1), (None, 1, 2), ("c", None, 2), ("c", 3, None)]
    rows += [("long", 5, 5 * top + 7), ("long", 6 * top, 6 * top + 1), ("long", 5 * top + 8, 6 * top - 1), ("edge", top - 1, top), ("edge", top + 1, 2 * top - 1), ("edge", 2 * top + 1, 2 * top + 1)]
    rows += [("neg", -3 * top, -5), ("neg", -4, 2 * top), ("max", 2**31 - 1, 2**31 - 1), ("max", -(2**31), -(2**31)), ("huge", -(2**31), 2**31 - 1)]
    for k in "wxyz":
        at = rng.integers(0, 4 * top, 60)
        rows += [(k, int(a), int(a + n)) for a, n in zip(at, rng.integers(0, 9000, 60))]
    rows += rows[:5]
    got = run(spark, [(*r, 7, 8, 9, "x") for r in rows])
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_microseconds_beyond_32_bits(spark):
    rng = np.random.default_rng(8)
    year, top = 365 * 86400 * 10**6, 2**63 - 1
    base = 4_102_444_800 * 10**6
    rows = [("user", base, base + 3600 * 10**6), ("user", base + 3600 * 10**6 + 1, base + 2 * year), ("user", base + 10, base + 20), ("user", base + 3 * year, base + 3 * year), ("user", base + 3 * year - 3, base + 3 * year - 2)]
    rows += [("all", -top - 1, top), ("all", 5, 9), ("ends", -top - 1, -top - 1), ("ends", top, top), ("half", -top - 1, -1), ("half", 1, top)]
    # Whole bins of every stratum with holes between them, and small ones inside and beside.
    for bits in (16, 32, 48):
        at = 1 << bits
        rows += [(f"s{bits}", 3, 5 * at), (f"s{bits}", 7 * at, 9 * at - 1), (f"s{bits}", 9 * at, 11 * at + 2)] + [(f"s{bits}", int(a), int(a + n)) for a, n in zip(rng.integers(0, 16 * at, 80), rng.integers(0, at // 8, 80))]
    for k in "pq":
        at = rng.integers(0, 3 * year, 150)
        rows += [(k, base + int(a), base + int(a + n)) for a, n in zip(at, rng.integers(0, 86400 * 10**6, 150))]
    df = spark.createDataFrame(rows * 2, "k string, s bigint, e bigint")
    got = [tuple(r) for r in periods_and_gaps(df, "k", "e", "s").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_hot_key_over_many_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", int(a), int(a + n)) for a, n in zip(rng.integers(0, 10**12, 3000), rng.integers(0, 10**8, 3000))] + [("hot", 4 * 10**11, 6 * 10**11)] + [(f"k{i % 50}", i * 10**9, i * 10**9 + 5) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = [tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, "k string, s bigint, e bigint"), "k", "s", "e").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
