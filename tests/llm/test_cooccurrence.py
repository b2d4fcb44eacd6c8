import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandmill.llm import cooccurrence as cooccurrence_module
from strandmill.llm.cooccurrence import cooccurrence

DDL = "cls string, rec string, item string, id long, n long, scope string"


def brute(rows, least, lift, llr):
    recs = {}
    for c, r, i, *_ in rows:
        if None not in (c, r, i) and i:
            recs.setdefault(c, {}).setdefault(r, set()).add(i)
    out = set()
    for c, by in recs.items():
        n = len(by)
        one = Counter(i for s in by.values() for i in s)
        two = Counter(p for s in by.values() for p in itertools.combinations(sorted(s), 2))
        for (a, b), k in two.items():
            x = lambda v: v * math.log(v) if v else 0.0
            g = max(0, 2 * (x(k) + x(one[a] - k) + x(one[b] - k) + x(n - one[a] - one[b] + k) - x(one[a]) - x(n - one[a]) - x(one[b]) - x(n - one[b]) + x(n)))
            if k >= least and k * n >= lift * one[a] * one[b] and g >= llr:
                out.add((c, a, b, k, one[a], one[b], n, round(g, 6)))
    return out


def run(spark, rows, least=2, lift=0.0, llr=0.0, **kw):
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], DDL)
    got = cooccurrence(df, F.col("cls"), F.col("rec"), F.col("item"), least, lift, llr, **kw).collect()
    return {(r.scope, r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b, r.n, round(r.llr, 6)) for r in got}, len(got)


def test_like_brute_force_also_in_blocks(spark):
    rng = random.Random(7)
    rows = [(rng.choice("AB"), f"r{rng.randrange(60)}", f"i{int(rng.paretovariate(0.8)) % 40:02d}") for _ in range(900)]
    rows += [("A", "big", f"i{i:02d}") for i in range(40)] + [("A", "big2", f"i{i:02d}") for i in range(40)] + rows[:50]
    rows += [(None, "r", "x"), ("A", None, "x"), ("A", "r1", None), ("A", "r1", ""), ("C", "only", "one")]
    for args in ((2, 0.0, 0.0), (3, 1.5, 0.0), (2, 0.0, 3.84), (8, 4.0, 6.63)):
        for block in (512, 25, 5):
            got, n = run(spark, rows, *args, block=block)
            assert n == len(got) and got == brute(rows, *args)


def test_one_record_with_a_third_of_all_rows(spark):
    rng = random.Random(3)
    rows = [("A", "huge", f"i{i:04d}") for i in range(2500)] + [("A", f"r{j}", f"i{int(rng.paretovariate(0.6)) % 900:04d}") for j in range(700) for _ in range(7)]
    got, n = run(spark, rows, 3, 2.0, 3.84)
    assert n == len(got) and got == brute(rows, 3, 2.0, 3.84) and got


def test_empty(spark):
    assert run(spark, []) == (set(), 0)


def test_long_stripes_are_split(monkeypatch):
    monkeypatch.setattr(cooccurrence_module, "STRIPE", 3)
    a, b = np.array([1] * 7 + [2] * 3 + [5]), np.arange(11)
    batch = cooccurrence_module._stripes(a, b, np.ones(11, np.int64))
    assert batch.column("a").to_pylist() == [1, 1, 1, 2, 5] and batch.column("b").to_pylist() == [[0, 1, 2], [3, 4, 5], [6], [7, 8, 9], [10]]
    merged = list(cooccurrence_module._merge_stripes(1)(iter([batch.slice(0, 2), batch.slice(2)])))
    assert sum(m.num_rows for m in merged) == 11
