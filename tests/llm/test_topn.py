import math
import random

from strandmill.llm.topn import top_n

DDL = "target string, name string, score double, g string, rank int, item string"


def brute(rows, n):
    best = {}
    for t, name, s, *_ in rows:
        if None not in (t, name, s) and not math.isnan(s):
            best.setdefault(t, {})[name] = max(s, best.get(t, {}).get(name, -math.inf))
    return {(t, i + 1, k, s) for t, b in best.items() for i, (k, s) in enumerate(sorted(b.items(), key=lambda x: (-x[1], x[0].encode()))[:n])}


def test_ties_repeats_nulls_and_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", f"n{rng.randrange(3000)}", float(rng.randrange(40))) for _ in range(30_000)]
    rows += [(f"t{rng.randrange(300)}", rng.choice(["a", "B", "é", "z", "", "Z"]), rng.choice([1.0, 2.0, None, math.nan, math.inf, -0.5])) for _ in range(2000)]
    rows += [(None, "a", 1.0), ("x", None, 1.0), ("", "e", 1.0)]
    df = spark.createDataFrame([(*r, "q", 1, "w") for r in rows], DDL)
    got = [tuple(r) for r in top_n(df, "target", "name", "score", 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5)
    again = top_n(df.repartition(7), "target", "name", "score", 5).collect()
    assert set(map(tuple, again)) == set(got)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], DDL), "target", "name", "score").collect() == []
