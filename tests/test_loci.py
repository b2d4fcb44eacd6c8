import random

from pyspark.sql import functions as F

from strandmill.operators import anchors, arrays, loci, words
from strandmill.sources import delimited, sequences


def noise(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def repeats(rng, copies, spacer, unit_len=20):
    unit = noise(rng, unit_len)
    return "".join(unit + noise(rng, spacer) for _ in range(copies))


def flip(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def record(name, cds, seq):
    lines = [f"LOCUS       {name}", f"VERSION     {name}", "  ORGANISM  Some phage", "FEATURES             Location/Qualifiers"]
    for i, lo, hi, strand in cds:
        place = f"{lo}..{hi}" if strand == "+" else f"complement({lo}..{hi})"
        lines += [f"     CDS             {place}", f'                     /protein_id="{i}"']
    return "\n".join([*lines, "ORIGIN", f"        1 {seq.lower()}", "//"])


def test_scan_of_wanted_loci_on_both_strands(spark, tmp_path):
    rng = random.Random(12)
    before = noise(rng, 1200) + repeats(rng, 9, 130) + noise(rng, 1100)
    gene = noise(rng, 600)
    seq = before + gene + noise(rng, 300)
    lo, hi = len(before) + 1, len(before) + len(gene)
    other = (len(before) - 420, len(before) - 60)
    n = len(seq)
    rows = [record("R1", [("up", *other, "+"), ("rt1", lo, hi, "+")], seq), record("R2", [("rt2", n - hi + 1, n - lo + 1, "-")], flip(seq)), record("R3", [("rt3", 700, 900, "+")], noise(rng, 1000)), record("R4", [("else", 700, 900, "+")], seq)]
    (tmp_path / "x.gbff").write_text("\n".join(rows) + "\n")
    parsed = sequences.parse_genbank(sequences.read_genbank_records(spark, str(tmp_path / "x.gbff")))
    wanted = spark.createDataFrame([("rt1|x",), ("rt2",), ("rt3",), ("gone",)], "id string")
    w = {r.rt: r for r in loci.upstream_windows(parsed, wanted, "id").collect()}
    assert w["rt1"].seq == w["rt2"].seq == before and w["rt2"].genes == [] and len(w["rt3"].seq) == 699
    assert [tuple(g) for g in w["rt1"].genes] == [(other[0] - 1, other[1])]
    got = {r.rt: r for r in loci.scan_loci(parsed, wanted, "id", shuffles=10, retest=0).collect()}
    assert set(got) == {"rt1", "rt2", "rt3"}
    assert (got["rt3"].status, got["rt3"].delim_copies, got["rt3"].rt_adjacent) == ("not_assessed", 0, None)
    for rt, adjacent in (("rt1", False), ("rt2", True)):
        r = got[rt]
        assert r.status == "array" and r.r >= 8 and r.delim_copies >= 8 and r.rt_adjacent == adjacent and not r.coding_repeat and r.upstream_nt == len(before)


def test_scan_of_genomes(spark):
    rng = random.Random(5)
    a = noise(rng, 49_000) + repeats(rng, 10, 140) + noise(rng, 30_000) + repeats(rng, 7, 110) + noise(rng, 20_000)
    df = spark.createDataFrame([("g1", a, 1), ("none", noise(rng, 20_000), 2), ("empty", "", 3), ("null", None, 4)], "name string, seq string, piece int")
    got = sorted((r.name, r.start, r.end, r.r) for r in loci.scan_genomes(df, "name", "seq", shuffles=20).collect())
    assert [g[0] for g in got] == ["g1", "g1"]
    for (_, start, end, r), (at, copies, step) in zip(got, ((49_000, 10, 160), (49_000 + 1600 + 30_000, 7, 130))):
        assert r == copies and at - 2 <= start <= at + 20 and abs(end - start - (copies - 1) * step) <= 20


def test_flags_of_delimited_arrays(spark):
    chains = spark.createDataFrame([("in", [30, 90, 150]), ("odd", [30, 91, 150]), ("far", [30, 90, 150]), ("short", [30, 90, 150]), ("bare", [30, 90, 150])], "locus string, chain array<bigint>")
    genes = spark.createDataFrame([("in", 0, 160), ("odd", 0, 400), ("far", 160, 460), ("short", 160, 459)], "locus string, a int, b int")
    sizes = spark.createDataFrame([("in", 500), ("odd", 500), ("far", 460), ("short", 500), ("bare", 500)], "locus string, size int")
    got = {r.locus: (r.coding_repeat, r.rt_adjacent) for r in arrays.delimitation_flags(chains, genes, sizes.where("locus <> 'bare'")).collect()}
    assert got == {"in": (True, True), "odd": (False, True), "far": (False, False), "short": (False, True), "bare": (False, None)}


def test_exact_words_where_the_scan_finds_none(spark):
    rng = random.Random(3)
    word = "ACGTTGCAAGCT"
    seq = noise(rng, 900) + word + noise(rng, 200) + word + noise(rng, 210) + word + noise(rng, 700)
    df = spark.createDataFrame([("w", seq), ("n", noise(rng, 2000)), ("s", noise(rng, 200))], "id string, seq string")
    got = {r.locus: (r.status, r.r, r.seed) for r in arrays.scan_with_words(df, "id", "seq", shuffles=40).collect()}
    assert got == {"w": ("array", 3, word), "n": ("no_array", 0, None), "s": ("not_assessed", 0, None)}


def test_anchor_plan(spark):
    rows = [(f"a{i:04d}", "Abi", None, "member") for i in range(700)] + [("ctl2", "retron", None, "control"), ("ctl1", "retron", "", "control")] + [(f"r{i}", "retron", None, None) for i in range(5)]
    rows += [(f"u{c}_{i}", "UG", f"c{c}", "member") for c, n in ((1, 29), (2, 900), (3, 400)) for i in range(n)] + [(f"n{c}_{i}", "novel", f"c{c}", "singleton") for c, n in ((1, 70), (2, 5)) for i in range(n)]
    rows += [(f"x{c}_{i}", "unplaced", f"l{c:03d}", "member") for c in range(450) for i in range(1 + c % 2)] + [(f"s{i}", "unplaced", "", "singleton") for i in range(250)] + [(None, "Abi", None, "member"), ("z", "unknown", "q", "member")]
    got = anchors.plan_anchors(spark.createDataFrame(rows, "rt_id string, rt_class string, clade string, kind string"))
    n = {(r.rt_class, r.part): r["count"] for r in got.groupBy("rt_class", "part").count().collect()}
    assert n == {("Abi", "first"): 680, ("retron", "random"): 5, ("retron", "control"): 1, ("UG", "proportional"): 700, ("novel", "clade"): 65, ("unplaced", "lineage"): 440, ("unplaced", "singleton"): 200}
    assert [r.rt_id for r in got.where("control").collect()] == ["ctl1"] and got.where("clade = 'c1' and rt_class = 'UG'").count() == 29
    assert got.where("part = 'lineage' and clade in ('l000', 'l440')").count() == 1


def test_clade_totals_and_motif_frames(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# c\na\t3\nb\t4\nshort\na\t 5\n\n")
    assert {tuple(r) for r in delimited.clade_totals(spark, str(tmp_path / "t.tsv")).collect()} == {("a", 5), ("b", 4)}
    rng = random.Random(1)
    protein = "M" + "".join(rng.choice("AGLK") for _ in range(20)) + "YADD" + "".join(rng.choice("AGLK") for _ in range(20))
    code = {"M": "ATG", "A": "GCT", "G": "GGA", "L": "CTT", "K": "AAA", "Y": "TAT", "D": "GAC"}
    dna = "CC" + "".join(code[x] for x in protein) + "TAA" + "CCC"
    df = spark.createDataFrame([("f", dna), ("r", flip(dna)), ("o", dna.replace("TATGCTGACGAC", "CTTGCTGACGAC"))], "id string, seq string")
    got = {(r.id, r.strand, r.start, r.end, r.motif) for r in words.motif_frames(df, "id", "seq", min_aa=30).collect()}
    end = 2 + 3 * (len(protein) + 1)
    assert got == {("f", "+", 2, end, "YADD"), ("r", "-", len(dna) - end, len(dna) - 2, "YADD")}
    assert {(r.id, r.length_nt) for r in words.inventory(df, "id", "seq").where(F.col("gc").between(0, 1)).collect()} == {(k, len(dna)) for k in "fro"}
