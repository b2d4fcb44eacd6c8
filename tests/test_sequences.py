import random

from pyspark.sql import functions as F

from strandmill.functions import gamma, sequences as S
from strandmill.operators import words


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


def test_scalar_functions(spark):
    assert one(spark, S.reverse_complement("s"), s="ACGTNacg") == "cgtNACGT"
    assert one(spark, S.gc_fraction("s"), s="GGAT") == 0.5 and one(spark, S.gc_fraction("s"), s="") is None
    assert one(spark, S.kmers("s", 3), s="abcde") == ["abc", "bcd", "cde"] and one(spark, S.kmers("s", 3), s="ab") == [] and one(spark, S.kmers("s", 3), s=None) is None
    text = "".join(random.Random(1).choice("abé") for _ in range(500))
    assert one(spark, S.kmers("s", 12), s=text) == [text[i : i + 12] for i in range(489)]
    assert one(spark, S.usable_seed("s"), s="ACGACG") and not one(spark, S.usable_seed("s"), s="ACACAC") and not one(spark, S.usable_seed("s"), s="ACGAAAAAA")
    assert one(spark, S.mismatches("a", "b"), a="ACGT", b="ACCTTT") == 1
    assert one(spark, S.translate_codons("s"), s="ATGTAANNNGC") == "M*X" and one(spark, S.translate_codons("s"), s="AT") == ""
    assert one(spark, S.upstream_window("s", F.lit(4), F.lit(6), F.lit("+"), 2), s="AACGGGTC") == "AC"
    assert one(spark, S.upstream_window("s", F.lit(4), F.lit(6), F.lit("-"), 2), s="AACGGGTC") == "GA"
    assert one(spark, S.upstream_window("s", F.lit(2), F.lit(6), F.lit("+"), 9), s="AACGGGTC") == "A"


def test_hypergeometric_tail(spark):
    from math import comb

    for x, n, k, m in ((2, 20, 5, 6), (0, 9, 3, 3), (4, 10, 3, 9), (1, 5, 5, 2), (7, 400, 30, 60), (3, 5, 4, 4)):
        want = sum(comb(k, i) * comb(n - k, m - i) for i in range(max(x, 0), min(m, k) + 1)) / comb(n, m)
        got = one(spark, gamma.hypergeometric_tail(F.lit(x), F.lit(n), F.lit(k), F.lit(m)), z=1)
        assert abs(got - want) < 1e-9
    # Pools of a billion: no row holds more than a few standard deviations of terms.
    big = [one(spark, gamma.hypergeometric_tail(F.lit(x).cast("bigint"), F.lit(10**9), F.lit(10**8), F.lit(10**8)), z=1) for x in (10**7 - 9000, 10**7, 10**7 + 3000, 10**7 + 10**6)]
    assert big[0] > 0.99 and abs(big[1] - 0.5) < 0.01 and 0.12 < big[2] < 0.16 and big[3] == 0.0


def test_open_reading_frames(spark):
    rng = random.Random(3)
    protein = "M" + "".join(rng.choice("AGLK") for _ in range(30))
    dna = "".join({"M": "ATG", "A": "GCT", "G": "GGA", "L": "CTT", "K": "AAA"}[a] for a in protein) + "TAA"
    rows = [("plus", "CC" + dna + "C"), ("minus", "G" + dna[::-1].translate(str.maketrans("ACGT", "TGCA")) + "TT"), ("open", dna[:-3]), ("none", ""), ("null", None)]
    got = {(r.id, r.strand, r.start, r.end) for r in words.open_reading_frames(spark.createDataFrame(rows, "id string, seq string"), "id", "seq", 25).collect() if r.protein == protein}
    n = len(dna)
    assert got == {("plus", "+", 2, 2 + n), ("minus", "-", 1, 1 + n), ("open", "+", 0, n - 3)}


def test_exact_word_arrays(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    unit = "ACGGTTCAGCTA"
    planted = noise(50) + unit.join(noise(150) for _ in range(6)) + noise(40)
    df = spark.createDataFrame([("yes", planted), ("no", noise(900)), ("short", "AC"), ("null", None)], "id string, seq string")
    got = words.exact_word_arrays(df, "id", "seq", 12).collect()
    assert [(r.id, r.word, r.copies) for r in got] == [("yes", unit, 5)]
    assert list(got[0].positions) == [i for i in range(len(planted)) if planted.startswith(unit, i)]


def test_exact_words_stay_in_their_row(spark):
    rng = random.Random(8)
    make = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    unit = make(14, "abcdefghé\U0001f600")
    texts = [unit.join(make(rng.choice([40, 120, 150, 300]), "abcd é\U0001f600") for _ in range(9)) for _ in range(12)] + [make(900, "ab") for _ in range(12)] + ["", "short", None, "x" * 1500]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, body string")
    for k in (12, 5, 3, 24):
        kind = ["id", "word", "copies", "positions"]
        got, want = (sorted(map(tuple, x.select(*kind).collect())) for x in (words.exact_word_arrays(df, "id", "body", k), words._arrays_by_word(df.where("body is not null"), "id", "body", k, 3)))
        assert got == want and (k > 12 or len(got) > 8)
    assert "Exchange" not in words.exact_word_arrays(df, "id", "body", 12)._jdf.queryExecution().toString()
    # Rows of one id are one text's positions, whatever the id.
    twice = spark.createDataFrame([*rows, (3, texts[4]), (None, texts[5]), (None, texts[6])], "id int, body string")
    got, want = ({(r.id, r.word, r.copies, tuple(r.positions)) for r in x.collect()} for x in (words.exact_word_arrays(twice, "id", "body", 12), words._arrays_by_word(twice.where("body is not null"), "id", "body", 12, 3)))
    assert got == want
