import random

from pyspark.sql import functions as F

from strandmill.operators import chunks
from strandmill.operators.chunks import distinct_per_key, offsets


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, v string, key int, tie string, chunk int")
    return {r.key: (r.n_rows, r.n_values) for r in distinct_per_key(df, F.col("k"), F.col("v"), **kw).collect()}


def brute(rows):
    out = {}
    for k, v, *_ in rows:
        if k is not None:
            out.setdefault(k, []).append(v)
    return {k: (len(x), len({v for v in x if v is not None})) for k, x in out.items()}


def test_hot_key_with_repeats_over_many_chunks(spark):
    rng = random.Random(2)
    rows = [("hot", f"m{rng.randrange(400)}") for _ in range(3000)] + [("one", "same")] * 900 + [(f"k{rng.randrange(80)}", rng.choice(["a", "b", None, ""])) for _ in range(500)]
    rows += [("none", None)] * 30 + [(None, "x")] * 10 + [("", "y")]
    rng.shuffle(rows)
    full = [(*r, 1, "t", 2) for r in rows]
    for size, parts in ((7, 5), (100, 3), (10**6, 1)):
        assert run(spark, full, chunk_rows=size, partitions=parts) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == {}


def test_offsets_run_through_partitions_of_one_key():
    edge = lambda pid, f, fn, l, ln: {"pid": pid, "first_key": f, "first_rows": fn, "last_key": l, "last_rows": ln}
    assert offsets([edge(0, "a", 5, "b", 3), edge(1, "b", 4, "b", 4), edge(2, "b", 1, "c", 2), edge(4, "d", 1, "d", 1)]) == {0: 0, 1: 3, 2: 7, 4: 0}


def test_a_hot_key_sends_one_state_a_partition(spark):
    rows = [("hot", f"{i // 3:06d}") for i in range(45_000)] + [("cold", str(i)) for i in range(3000)]
    ordered = spark.createDataFrame(rows, "k string, v string").repartitionByRange(4, "k", "v").sortWithinPartitions("k", "v")
    edges = ordered.mapInArrow(chunks._count_edges, "pid int, first_key string, first_rows bigint, last_key string, last_rows bigint").collect()
    states = ordered.mapInArrow(chunks._chunk_states(offsets(edges), 500), "k string, at bigint, n_rows bigint, n_values bigint, first string, last string").where("k = 'hot'").collect()
    assert 2 <= len(states) <= 4 and sum(s.n_rows for s in states) == 45_000
    assert max(s.n_rows for s in states) < 2 * 48_000 / 4
    got = {r.key: (r.n_rows, r.n_values, r.n_chunks) for r in distinct_per_key(spark.createDataFrame(rows, "k string, v string"), F.col("k"), F.col("v"), 500, 4).collect()}
    assert got == {"hot": (45_000, 15_000, 90), "cold": (3000, 3000, 6)}
