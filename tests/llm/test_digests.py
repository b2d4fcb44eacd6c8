import math
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from strandmill.llm import digests
from strandmill.llm.digests import certify, digest, digest_quantiles, far_from_median, merge_digests

DDL = "id string, grp string, v double, g string, n long, lo double"
Q = [0.01, 0.25, 0.5, 0.75, 0.99]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], DDL)


def values(rng, kind, n):
    return {"skewed": lambda: rng.lognormvariate(3, 2), "flat": lambda: rng.uniform(-5, 5), "few": lambda: float(rng.randrange(4))}[kind], n


def test_rank_error_is_bounded_and_loads_combine(spark):
    rng = random.Random(3)
    rows = []
    for kind, n in (("skewed", 20_000), ("flat", 8000), ("few", 3000)):
        make, _ = values(rng, kind, n)
        rows += [(f"{kind}{i}", kind, make()) for i in range(n)]
    df = frame(spark, rows)
    days = [df.where(F.abs(F.xxhash64("id")) % 3 == i) for i in range(3)]
    merged = merge_digests(digest(days[0], "grp", "v").unionByName(digest(days[1], "grp", "v")).unionByName(digest(days[2], "grp", "v")))
    for d in (digest(df, "grp", "v"), merged):
        got = certify(df, "grp", "v", digest_quantiles(d, Q)).collect()
        assert len(got) == 3 * len(Q)
        for r in got:
            xs = np.array([x[2] for x in rows if x[1] == r.g])
            assert r.n == len(xs)
            error = max(0, (xs < r.estimate).mean() - r.q, r.q - (xs <= r.estimate).mean())
            assert math.isclose(error, r.rank_error, abs_tol=1e-12) and r.rank_error < 0.02
        assert max(d.select(F.max(F.size("mean"))).first()) <= 220


def test_exact_medians_name_the_far_ones(spark):
    rng = random.Random(9)
    rows = [(f"a{i}", "hot", float(rng.choice([*range(90, 111), 300, 20]))) for i in range(9000)]
    rows += [(f"b{i}", "even", float(x)) for i, x in enumerate([10] * 10 + [20] * 10 + [31, 7, 30, 7.5])]
    rows += [(f"c{i}", "small", 1.0 * 10**i) for i in range(19)] + [(f"e{i}", "wide", rng.lognormvariate(0, 3)) for i in range(2500)]
    rows += [("n1", None, 5.0), ("n2", "hot", None), ("n3", "hot", math.nan), ("n4", "hot", math.inf)]
    want = set()
    by = {}
    for i, k, v in rows:
        if k is not None and v is not None and math.isfinite(v):
            by.setdefault(k, []).append((i, v))
    for k, xs in by.items():
        if len(xs) >= 20:
            m = statistics.median(v for _, v in xs)
            want |= {(i, m) for i, v in xs if v > 2 * m or 2 * v < m}
    for c in (200, 20):
        got = {(r.id, r.median) for r in far_from_median(frame(spark, rows), "id", "grp", "v", compression=c).collect()}
        assert got == want


def test_groups_ordered_over_ranges_and_bounds_that_miss(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"h{i}", "hot", rng.lognormvariate(2, 1)) for i in range(6000)] + [(f"t{i}", "tied", float(rng.choice([1, 2, 2, 9]))) for i in range(400)] + [(f"o{i}", "odd", float(i * i)) for i in range(61)]
    by = {}
    for i, k, v in rows:
        by.setdefault(k, []).append((i, v))
    want = set()
    for xs in by.values():
        m = statistics.median(v for _, v in xs)
        want |= {(i, m) for i, v in xs if v > 2 * m or 2 * v < m}
    run = lambda most: {(r.id, r.median) for r in far_from_median(frame(spark, rows), "id", "grp", "v", most=most).collect()}
    assert run(10) == want
    # Bounds far above every middle: all groups are counted again, and no row is lost to the bounds.
    right = digests.median_bounds
    monkeypatch.setattr(digests, "median_bounds", lambda *a: right(*a).withColumns({"lo": F.col("hi") * 40, "hi": F.col("hi") * 50, "pure": F.lit(False)}))
    assert run(10) == want and run(10**6) == want


def test_empty_and_one_value(spark):
    df = frame(spark, [])
    assert digest(df, "grp", "v").collect() == [] and far_from_median(df, "id", "grp", "v").collect() == []
    one = digest_quantiles(digest(frame(spark, [("a", "", 4.0)]), "grp", "v"), [0.0, 0.5, 1.0]).collect()
    assert [r.estimate for r in one] == [4.0] * 3
