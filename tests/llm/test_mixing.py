import random

from strandmill.llm.mixing import mix_sources, plan_budgets, take_budgets

DDL = "doc_id long, source string, lang string, n_tokens long, uses int, weight double"
TREE = ["domain", "lang", "source"]


def planned(spark, levels, leaves, weights, total=None):
    """Budgets by path; leaves are (path, tokens, max_repeats), weights are by path."""
    ddl = ", ".join(f"{c} string" for c in levels)
    rows = spark.createDataFrame([(*p, t, n) for p, t, n in leaves], f"{ddl}, tokens bigint, max_repeats int")
    given = spark.createDataFrame([(*p, *[None] * (len(levels) - len(p)), w) for p, w in weights.items()], f"{ddl}, weight double")
    return {tuple(r[c] for c in levels): r.budget for r in plan_budgets(rows, levels, given, total).collect()}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = [(("d1", "en", "a"), 100, 1), (("d1", "en", "b"), 1000, 1), (("d1", "fr", "c"), 5000, 1), (("d2", "en", "e"), 5000, 1)]
    w = {("d1",): 0.5, ("d2",): 0.5, ("d1", "en"): 0.5, ("d1", "fr"): 0.5, ("d1", "en", "a"): 0.5, ("d1", "en", "b"): 0.5}
    run = lambda total: [planned(spark, TREE, leaves, w, total)[p] for p, _, _ in leaves]
    assert run(2000) == [100, 400, 500, 1000]
    assert run(6000) == [100, 1000, 1900, 3000]  # en of d1 is full with 1100, so fr takes its rest
    assert run(10**9) == [100, 1000, 5000, 5000]


def test_largest_total_meets_weights(spark):
    leaves = [(("a", "x"), 100, 3), (("b", "x"), 1000, 1), (("b", "y"), 500, 1), (("none", "x"), 0, 5)]
    got = planned(spark, ["source", "lang"], leaves, {("a",): 0.4, ("b",): 0.4, ("none",): 0.2, ("absent",): 0.5})
    assert [got[p] for p, _, _ in leaves] == [300, 200, 100, 0]
    assert planned(spark, ["source", "lang"], [], {}) == {}


def filled(budget, weights, capacities):
    """Shares by repeated proportional filling."""
    got, left = [0.0] * len(weights), min(budget, sum(c for w, c in zip(weights, capacities) if w > 0))
    open_ = [i for i, w in enumerate(weights) if w > 0 and capacities[i] > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= capacities[i]]
        for i in full or open_:
            got[i] = float(capacities[i]) if full else unit * weights[i]
        left -= sum(got[i] for i in full)
        open_ = [i for i in open_ if i not in full] if full else []
    return got


def test_two_hundred_thousand_leaves(spark):
    rng = random.Random(6)
    tops = [(f"s{i:05d}", rng.choice([0.0, 0.5, 1.0, 3.0])) for i in range(20_000)]
    leaves = [((s, f"l{j}"), rng.randrange(0, 900), rng.choice([1, 4])) for s, _ in tops for j in range(10)]
    total = 40_000_000
    got = planned(spark, ["source", "lang"], leaves, {(s,): w for s, w in tops}, total)
    caps = [sum(t * n for _, t, n in leaves[i * 10 : i * 10 + 10]) for i in range(len(tops))]
    want = filled(total, [w for _, w in tops], caps)
    assert len(got) == 200_000
    for i, (s, _) in enumerate(tops):
        assert abs(sum(got[p] for p, _, _ in leaves[i * 10 : i * 10 + 10]) - want[i]) <= 11


def docs(spark, rows):
    return spark.createDataFrame([(*r, 9, 9.0) for r in rows], DDL)


def test_epochs_are_seeded_prefixes(spark):
    rng = random.Random(1)
    rows = [(i, "s", "en", rng.randrange(1, 50)) for i in range(500)] + [(1000, "s", "en", 0), (1001, "t", "en", 10), (1002, "t", "en", 10)]
    df = docs(spark, rows)
    held = sum(r[3] for r in rows if r[1] == "s")
    for budget in (held // 3, held, 2 * held + held // 2, 0):
        leaf = spark.createDataFrame([("s", "en", held, budget)], "source string, lang string, tokens bigint, budget bigint")
        got = take_budgets(df, ["source", "lang"], leaf, seed=5).collect()
        assert all(r.source == "s" and r.n_tokens > 0 for r in got)
        assert abs(sum(r.uses * r.n_tokens for r in got) - budget) <= 25
        assert {r.uses for r in got} <= {budget // held, budget // held + 1}
        again = take_budgets(df.repartition(5), ["source", "lang"], leaf, seed=5).collect()
        assert {(r.doc_id, r.uses) for r in got} == {(r.doc_id, r.uses) for r in again}


def test_whole_mix(spark):
    rows = [(i, "big", "en" if i % 3 else "und", 20) for i in range(3000)] + [(9000 + i, "small", "fr", 20) for i in range(100)] + [(9900, "other", "fr", 20), (9901, None, "fr", 20)]
    targets = spark.createDataFrame([(" Big", 0.6, 1), ("SMALL", 0.3, 4), ("small", 0.3, 4), ("no-docs", 0.1, 2), ("zero", 0.0, 1), ("nothing", None, 1), (None, 0.5, 1)], "source string, weight double, max_repeats int")
    chosen, shares = mix_sources(docs(spark, rows), targets)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"big", "small", "no_docs"} and got["no_docs"].n_uses == 0
    assert abs(got["small"].share - 1 / 3) < 0.01 and got["small"].most_uses == 4 and got["big"].most_uses == 1
    assert chosen.where("source not in ('big', 'small')").count() == 0
    empty, none = mix_sources(docs(spark, []), targets)
    assert empty.collect() == [] and all(r.tokens == 0 and r.share == 0 for r in none.collect())


def test_many_leaves_are_joined_by_shuffle(spark, monkeypatch):
    rows = [(i, f"s{i % 50}", "en", 1 + i % 7) for i in range(2000)]
    targets = spark.createDataFrame([(f"s{i}", 1.0, 2) for i in range(50)], "source string, weight double, max_repeats int")
    few = sorted(map(tuple, mix_sources(docs(spark, rows), targets)[0].collect()))
    monkeypatch.setattr("strandmill.llm.mixing.BROADCAST_LEAVES", 3)
    assert sorted(map(tuple, mix_sources(docs(spark, rows), targets)[0].collect())) == few and few


def test_a_short_source_is_made_up_for(spark):
    rows = [(i, "big", "en", 20) for i in range(1000)] + [(5000 + i, "small", "en", 20) for i in range(10)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, weight double, max_repeats int")
    got = {r.source: r for r in mix_sources(docs(spark, rows), targets, 10_000)[1].collect()}
    assert got["small"].tokens == 600 and got["small"].most_uses == 3 and got["big"].tokens == 9400
