import datetime as dt

from pyspark.sql import functions as F

from strandmill.operators.references import orphan_counts, orphan_references

T = dt.datetime(2026, 3, 1)
LATER = T + dt.timedelta(40)


def run(spark, child, parent, **kw):
    c = spark.createDataFrame(child, "id string, fk string, loaded_at timestamp, key int, state string")
    p = spark.createDataFrame(parent, "pk string, loaded_at timestamp, retired_at timestamp, gone int")
    return orphan_references(c, p, "c.fk", "id", F.upper("fk"), "loaded_at", F.upper("pk"), **kw)


CHILD = [("1", "a", T, 0, ""), ("2", "A", None, 0, ""), ("3", "gone", T, 0, ""), ("4", "old", T, 0, ""), ("5", "late", T, 0, ""), ("6", "late", None, 0, ""), ("7", "late", LATER, 0, ""), ("8", None, T, 0, ""), ("9", "", T, 0, ""), ("9", "", T, 0, ""), (None, "gone", None, 0, ""), ("10", "back", T, 0, ""), ("11", "untimed", T, 0, "")]
PARENT = [("a", T, None, 1), ("a", T, None, 1), ("old", T, T, 1), ("old", LATER, LATER, 1), ("late", LATER, None, 1), ("back", T, T, 1), ("back", LATER, None, 1), (None, T, None, 1), ("untimed", None, None, 1)]


def test_states(spark):
    want = [("3", "missing"), ("4", "retired"), ("5", "late"), ("9", "missing"), ("9", "missing"), (None, "missing")]
    for keys in (0, 100):
        got = run(spark, CHILD, PARENT, broadcast_keys=keys).select("row_id", "state").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_counts_by_month(spark):
    got = {tuple(r) for r in orphan_counts(run(spark, CHILD, PARENT)).collect()}
    assert got == {("c.fk", "2026-03", "missing", 3, 2), ("c.fk", None, "missing", 1, 0), ("c.fk", "2026-03", "retired", 1, 1), ("c.fk", "2026-03", "late", 1, 1)}


def test_empty_sides(spark):
    assert run(spark, [], PARENT).collect() == []
    assert run(spark, CHILD, []).where("state = 'missing'").count() == 12
