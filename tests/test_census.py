from pyspark.sql import functions as F

from strandmill.operators import census as C


def test_best_profiles_cover_jointly(spark):
    rows = [("t", 300, "retron_1", 100, 40.0, 1, 40, 0), ("t", 300, "retron_1", 100, 30.0, 30, 80, 1), ("t", 300, "other", 100, 40.0, 1, 100, 2), ("u", 200, "Group_II_like_x", 50, 20.0, 1, 10, 3), ("u", 200, "Group_II_like_x", 50, 22.0, 5, 50, 4), (None, 1, "q", 5, 1.0, 1, 2, 5)]
    df = spark.createDataFrame(rows, "target string, tlen int, query string, qlen int, score double, hmm_from int, hmm_to int, ordinal long")
    got = {r.target: r for r in C.best_profiles(df).collect()}
    assert (got["t"].query, got["t"].coverage, got["t"].rt_class) == ("retron_1", 0.8, "retron")
    assert (got["u"].bitscore, got["u"].coverage, got["u"].rt_class) == (22.0, 1.0, "group II-like")


def test_verdicts_at_the_boundaries(spark):
    rows = [(24.0, 0.3, 300, False), (24.0, 0.3, 300, None), (24.0, 0.75, 225, False), (90.0, 0.7499, 300, True), (90.0, 0.9, 224, True), (90.0, 0.9, None, True), (90.0, None, 300, True)]
    df = spark.createDataFrame(rows, "s double, c double, n int, m boolean")
    got = [r.v for r in df.select(C.verdict(F.col("s"), F.col("c"), F.col("n"), F.col("m")).alias("v")).collect()]
    assert got == ["weak", "fragment", "kept", "fragment", "short", "short", "fragment"]


def test_protein_quality(spark):
    good = "MKLVACDEFG"
    rows = [("a", "x partial=00", good, 3), ("b", "x partial=00", good, 1), ("c", "partial=10", good, 0), ("d", "partial=00", "MMMMMMMM", 4), ("e", "partial=00", "MKX" + good, 5), ("f", "partial=00", good[::-1], 6), ("g", "partial=00", "A" * 7900 + good * 20, 7), ("h", "partial=00", None, 8), ("i", "partial=00", "", 9)]
    df = spark.createDataFrame(rows, "id string, header string, seq string, ordinal long")
    assert {r.id for r in C.protein_quality(df, "header", "seq").collect()} == {"b", "f"}
    mask = spark.createDataFrame([("f", "gfedcaVLKM"), ("b", good)], "id string, seq string")
    assert {r.id for r in C.protein_quality(df, "header", "seq", mask).collect()} == {"b"}


def test_family(spark):
    hits = spark.createDataFrame([("s", "x", 140.0), ("y", "x", 200.0), ("y", "z", 139.9), ("q", "r", 900.0)], "query string, subject string, bitscore double")
    clusters = spark.createDataFrame([("x", "x"), ("x", "m1"), ("y", "m2"), ("z", "m3")], "representative string, member string")
    lengths = spark.createDataFrame([("s", 400), ("x", 350), ("m1", 900), ("m2", 901), ("y", 349), ("m3", 500)], "id string, length int")
    got = C.family_of_seed(hits, spark.createDataFrame([("s",)], "node string"), clusters, lengths)
    assert {r.id for r in got.collect()} == {"s", "x", "m1"}


def test_expression(spark):
    features = spark.createDataFrame([("f1", "c", "+", 1, 100), ("f2", "c", "+", 90, 289), ("f3", "c", "-", 1, 100)], "feature string, ref string, strand string, lo int, hi int")
    a = [("L", "c", "+", 5, 50, "r1"), ("L", "c", "+", 95, 99, "both"), ("L", "c", "+", 200, 250, "r2"), ("L", "c", "+", 201, 250, "r2"), ("L", "d", "+", 1, 9, "none")]
    al = spark.createDataFrame([(*r, 30, 3, 200) for r in a] + [("L", "c", "-", 1, 9, "bad", 5, 3, 1)], "library string, ref string, strand string, lo int, hi int, fragment string, mapq int, flag int, tlen int")
    got = {r.feature: (r.fragments, round(r.tpm, 3)) for r in C.expression(al, features).collect()}
    assert got == {"f1": (1, 666666.667), "f2": (1, 333333.333)}


def test_repeat_groups_and_numbers(spark):
    df = spark.createDataFrame([("a", "ACGGTTCAGC"), ("b", "TTACGGTTCATT"), ("c", "GCTGAACCGT"), ("d", "CCCCCCCCCC"), ("e", None)], "locus string, rep string")
    assert {tuple(r) for r in C.shared_repeat_groups(df, "locus", "rep").collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert [r.name for r in C.numbered(df, [], [F.col("locus")]).orderBy("locus").collect()] == ["L01", "L02", "L03", "L04", "L05"]
