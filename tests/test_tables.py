import pytest
from pyspark.sql import functions as F

from strandmill.operators import abundance, best, graph, logs, ranking, sampling, textscan, tiers
from strandmill.plans import reference
from strandmill.sources import delimited, logs as log_files, sequences
from strandmill.streaming import ledger


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    p = write(tmp_path / "a.fa", ">x first > one\nAC\ngt \n>y\n\n>x second\nTT\n")
    got = sequences.read_fasta(spark, p).orderBy("ordinal").collect()
    assert [(r.id, r.header, r.seq) for r in got] == [("x", "x first > one", "ACGT"), ("y", "y", ""), ("x", "x second", "TT")]
    assert {r.id: r.seq for r in sequences.last_of_each(sequences.read_fasta(spark, p)).collect()} == {"x": "TT", "y": ""}
    sequences.write_fasta(sequences.read_fasta(spark, p), "header", "seq", str(tmp_path / "out"))
    assert sequences.read_fasta(spark, str(tmp_path / "out")).count() == 3


def test_domain_hits(spark, tmp_path):
    line = "t1 - 300 prof - 120 1e-9 50.0 0.1 1 2 1e-9 1e-9 40.5 0.1 5 100 7 110 3 120 0.9 some text"
    got = sequences.read_domain_hits(spark, write(tmp_path / "d", f"# head\n\n{line}\nshort line\n")).drop("ordinal").collect()
    assert [tuple(r) for r in got] == [("t1", 300, "prof", 120, 40.5, 5, 100)]


GB = '''LOCUS       A
VERSION     A.1
  ORGANISM  Some bug
FEATURES             Location/Qualifiers
     CDS             complement(join(3..5,
                     8..9))
                     /protein_id="P1"
     gene            1..2
     CDS             1..2
                     /locus_tag="L2"
ORIGIN
        1 acgt nn
//
LOCUS       B
VERSION     B.1
FEATURES
     CDS             4..6
ORIGIN
        1 tt
'''


def test_genbank_and_gtf(spark, tmp_path):
    records = sequences.read_genbank_records(spark, write(tmp_path / "g", GB))
    got = {r.version: r for r in sequences.parse_genbank(records).collect()}
    assert [tuple(c) for c in got["A.1"].cds] == [("P1", 3, 9, "-"), ("L2", 1, 2, "+")]
    assert got["A.1"].seq == "ACGTNN" and got["A.1"].organism == "Some bug" and got["B.1"].seq == "TT"
    with pytest.raises(Exception, match="joined location"):
        sequences.parse_genbank(records, strict=True).collect()
    ids = spark.createDataFrame([("P1|x",), ("Q",)], "id string")
    assert sequences.wanted_records(records, ids, "id").count() == 1
    lines = [r.value for r in sequences.gtf_lines(sequences.parse_genbank(records)).collect()]
    assert len(lines) == 3 and any("\t3\t9\t.\t-\t" in x and 'gene_id "P1"' in x for x in lines)


def test_delimited(spark, tmp_path):
    p = write(tmp_path / "t", "# c\ng1\tl\tf\tc\tk\tn\tb\t1\t0\t-\n\nshort\trow\ng2\tl\t\tc\tk\tn\tb\t0\t1\t12\n")
    got = delimited.positional_table(spark, p, delimited.NEIGHBOUR_GENES).collect()
    assert [(r.gene_id, r.family, r.rt_adjacent, r.distance_to_adjacent_bp) for r in got] == [("g1", "f", 1, None), ("g2", "", 0, 12)]
    h = delimited.header_table(spark, write(tmp_path / "h", "a\tb\n1\t2\n"), ["a", "b"])
    assert [tuple(r) for r in h.collect()] == [("1", "2")]
    with pytest.raises(Exception):
        delimited.header_table(spark, write(tmp_path / "r", "a\tb\n1\n"), ["a", "b"]).collect()
    n = delimited.neighbour_lists(spark, write(tmp_path / "n", "t\tx\ty\nt\tz\n")).orderBy("target", "rank").collect()
    assert [r.label for r in n] == ["x", "y", "z"]
    fc = delimited.feature_counts(spark, write(tmp_path / "f", "# p\nGeneid\tChr\tS\tE\tStrand\tLength\tA\tB\nf1\tc\t1\t9\t+\t9\t4\t0\n")).collect()
    assert sorted(tuple(r) for r in fc) == [("f1", 9, 0, 4), ("f1", 9, 1, 0)]
    assert {r.id for r in delimited.identifiers(spark, write(tmp_path / "i", " SRR1 \n\nbad id\nSRR1\n"), "[A-Z]{3}[A-Za-z0-9_-]{0,20}").collect()} == {"SRR1"}


def test_logs(spark, tmp_path):
    assert log_files.read_json_log(spark, str(tmp_path / "none*.jsonl"), log_files.LEDGER).collect() == []
    p = write(tmp_path / "r.jsonl", '{"model": "m", "attempt": 1}\n{broken\n')
    assert log_files.read_json_log(spark, p, log_files.RESULTS, "DROPMALFORMED").count() == 1
    for t in ("t1", "t2"):
        (tmp_path / "tasks" / t).mkdir(parents=True)
        write(tmp_path / "tasks" / t / "meta.json", f'{{\n"task_id": "{t}", "extra": {{"kind": "k"}}\n}}')
    assert sorted(r.task_id for r in log_files.read_task_records(spark, str(tmp_path / "tasks")).collect()) == ["t1", "t2"]
    assert log_files.read_texts(spark, str(tmp_path / "tasks")).count() == 2


def test_stream_closes_windows(spark, tmp_path):
    rows = [(f"2026-01-01 0{h}:00:00", "a", 1.0) for h in (0, 0, 1, 3)]
    spark.createDataFrame(rows, "ts string, kind string, v double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    s = ledger.stream_table(spark, str(tmp_path / "in"), "ts timestamp, kind string, v double")
    ledger.run_to_end(ledger.windowed_summary(s, "ts", "kind", "v"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_best_and_quantiles(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("k", "c", 3), ("k", "d", 10), ("z", "e", None), (None, "f", 1)], "k string, id string, v int")
    assert {(r.key, r.value) for r in best.floor_rank_quantile(df, "k", "v", 0.8).collect()} == {("k", 3), ("z", 0)}
    assert {tuple(r) for r in best.nearest_to_quantile(df, "k", "id", "v").collect()} == {("k", "c"), ("z", "e")}
    up = best.upsert(df, df.where("id = 'b'").withColumn("v", F.lit(9)), ["k", "id"], [F.col("v")])
    assert up.where("id = 'b'").first().v == 9 and up.count() == 6
    assert {tuple(r) for r in best.set_difference_report(df, df.where("k = 'z'"), "k").collect()} == {("k", "left")}


def test_tiers(spark):
    hits = spark.createDataFrame([("a", "X", 50.0), ("a", "Y", 40.0), ("b", "X", 50.0), ("b", "Y", 40.1), ("c", "X", 5.0), ("d", "X", float("nan")), (None, "X", 9.0)], "target_id string, rt_class string, bitscore double")
    assert {tuple(r) for r in tiers.tier1_margin(hits).collect()} == {("a", "X"), ("c", "X")}
    t2 = spark.createDataFrame([("e", "L", 150.0, 0.5, 0.3), ("f", "L", 149.9, 1.0, 1.0), ("g", "low", 200.0, 0.4, 0.9), ("g", "ok", 160.0, 0.9, 0.9)], "target_id string, label string, bitscore double, coverage double, seq_identity double")
    assert {tuple(r) for r in tiers.tier2_best(t2).collect()} == {("e", "L")}
    near = lambda t, labels: [(t, i, x) for i, x in enumerate(labels)]
    n = spark.createDataFrame(near("five", ["A"] * 5 + ["B"]) + near("four", ["A"] * 4 + ["B"]) + near("few", ["A"] * 4) + near("none", ["unplaced"] * 5) + near("most", ["-", "", None, "A", "A"]), "target string, rank int, label string")
    t3 = tiers.tier3_neighbours(n)
    assert {tuple(r) for r in t3.collect()} == {("five", "A"), ("none", "novel"), ("most", "novel")}
    placed = tiers.classify(tiers.tier1_margin(hits), tiers.tier2_best(t2), t3, spark.createDataFrame([(x,) for x in ("a", "b", "e", "five")], "target string"))
    assert {tuple(r) for r in placed.collect()} == {("a", "tier1", "X"), ("b", "none", "unplaced"), ("e", "tier2", "L"), ("five", "tier3", "A")}


def test_tier1_floor(spark):
    rows = [("at", "X", 100.0), ("under", "X", 99.9), ("margin", "X", 120.0), ("margin", "Y", 110.0), ("near", "X", 120.0), ("near", "Y", 110.1), ("own", "Z", 60.0), ("own", "X", 45.0), ("strict", "S", 150.0)]
    hits = spark.createDataFrame(rows, "target_id string, rt_class string, bitscore double")
    assert {tuple(r) for r in tiers.tier1_assign(hits).collect()} == {("at", "X"), ("margin", "X"), ("strict", "S")}
    assert {tuple(r) for r in tiers.tier1_assign(hits, {"Z": 60.0, "S": 150.1}).collect()} == {("at", "X"), ("margin", "X"), ("own", "Z")}


def test_tier3_whole_families_and_few_neighbours(spark, tmp_path):
    loci = {"same": ["PF00078", " pf00078", "PF00078 ", "pf00078", "PF00078"], "kin": ["PF00078", "PF00079", "PF00078", "PF00078", "PF00078"], "few": [None, "", "PF00078"], "half": [None, "PF00078"], "four": ["PF00078"] * 4, "lone": ["CLUSTER:1"]}
    rows = [(f"{t}{i}", t, f, 10 * i) for t, fs in loci.items() for i, f in enumerate(fs)]
    spark.createDataFrame(rows, "gene_id string, locus_id string, family string, distance_to_adjacent_bp int").write.parquet(str(tmp_path / "neighbor_genes.parquet"))
    got = reference.tier3_families(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {("same", "PF00078"), ("few", "novel"), ("lone", "novel")}


def test_quotas(spark):
    sizes = spark.createDataFrame([("s", "a", 10), ("s", "b", 100), ("s", "c", 50), ("t", "d", 20), ("t", "e", 25)], "scope string, g string, size int")
    got = {r.g: r.quota for r in sampling.proportional_quotas(sizes, ["scope"], "g", "size", 40).collect()}
    assert got == {"a": 10, "b": 20, "c": 10, "d": 18, "e": 22}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (7, 7), (3, 1), (None, 4), (10, 9), (9, 8), (8, 11)], "src int, dst int")
    assert {tuple(r) for r in graph.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (8, 8), (9, 8), (10, 8), (11, 8)}
    got = {(r.node, r.hops) for r in graph.reachable(e, spark.createDataFrame([(1,), (99,)], "node int")).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (99, 0)}
    assert graph.components(e.limit(0)).collect() == []


def test_ranking(spark):
    s = spark.createDataFrame([("g1", "a", 3.0), ("g1", "b", 1.0), ("g1", "c", 1.0), ("g2", "a", 2.0), ("g2", "b", 5.0), ("g3", "c", None), ("g3", "a", 1.0)], "game string, name string, score double")
    pairs = ranking.pair_wins(s, "game", "name", "score")
    assert {tuple(r) for r in pairs.collect()} == {("a", "b", 1, 1), ("a", "c", 1, 0)}
    strength = {r.name: r.strength for r in ranking.bradley_terry(pairs).collect()}
    large = {r.name: r.strength for r in ranking.bradley_terry(pairs, 12, small=0).collect()}
    assert all(abs(v - large[k]) < 1e-9 for k, v in {r.name: r.strength for r in ranking.bradley_terry(pairs, 12).collect()}.items())
    assert abs(strength["a"] - strength["b"]) < 0.05 and strength["c"] < 0.01 and abs(sum(strength.values()) - 3) < 1e-4


def test_abundance_and_logs(spark):
    c = spark.createDataFrame([("l", "x", 10, 5), ("l", "y", 20, 10), ("l", "z", 0, 9), ("m", "x", 10, 0)], "lib string, f string, len int, n int")
    assert {(r.lib, r.f): r.tpm for r in abundance.tpm(c, "lib", "len", "n").collect()} == {("l", "x"): 5e5, ("l", "y"): 5e5, ("l", "z"): 0.0, ("m", "x"): 0.0}
    a = spark.createDataFrame([(10, 3, 1500), (9, 3, 1), (10, 1, 1), (20, 2, -1501)], "mapq int, flag int, tlen int")
    assert abundance.proper_alignments(a).count() == 1
    planned = spark.createDataFrame([("a", 1), ("a", 2), (None, 1)], "m string, n int")
    assert {tuple(r) for r in logs.pending(planned, planned.where("n = 1"), ["m", "n"]).collect()} == {("a", 2)}


def test_texts(spark):
    df = spark.createDataFrame([(1, "Hello, World! SRR_12 x"), (2, None), (3, "VERDICT: revise\nVERDICT: accept")], "id int, text string")
    assert [r.x for r in df.select(textscan.terms("text").alias("x")).collect()] == [["hello", "world", "srr_12"], [], ["verdict", "revise", "accept"]]
    assert [r.x for r in df.select(textscan.slug("text").alias("x")).collect()][:2] == ["hello-world-srr-12-x", "entry"]
    assert [r.x for r in df.select(textscan.last_match("text", "VERDICT: (accept|revise)").alias("x")).collect()] == [None, None, "accept"]
    ids = spark.createDataFrame([("SRR_12",), ("world",), ("orl",), (None,)], "name string")
    assert {tuple(r) for r in textscan.mentions(df, "id", "text", ids, "name").collect()} == {(1, "srr_12"), (1, "world")}
    claims = spark.createDataFrame([("c1", "hello world again"), ("c2", "hello srr_12 x world"), ("c3", "verdict")], "cid string, wording string")
    assert {tuple(r) for r in textscan.match_claims(df, "id", "text", claims, "cid", "wording").collect()} == {(1, "c2", 5)}


def test_claims_by_name_before_words(spark):
    schema = "id int, text string, evidence string, claim string"
    rows = [(1, " C2 ", "alpha beta gamma", ""), (2, "Alpha Beta of gamma", "", ""), (3, "alpha", "beta c-1x here", ""), (4, "the of", "delta", ""), (5, None, None, ""), (6, "", "", ""), (7, "delta epsilon", "", ""), (8, "see alpha", "beta " * 5000, "")]
    df = spark.createDataFrame(rows, schema)
    claims = [("c1", "alpha beta of gamma"), ("c1", "alpha beta of gamma"), ("c0", "the of alpha beta"), ("c2", "delta epsilon"), ("c3", "Delta Epsilon"), (None, "alpha beta"), ("c4", None)]
    claims = spark.createDataFrame(claims, "claim string, wording string")
    # claim is a column of both tables: findings keep none of theirs.
    got = textscan.match_claims(df, "id", "text", claims, "claim", "wording", evidence="evidence", stop=["the", "of"])
    assert {tuple(r) for r in got.collect()} == {(1, "c2", None), (2, "c1", None), (3, "c0", 2), (7, "c2", None), (8, "c0", 2)}
    none = textscan.match_claims(df.limit(0), "id", "text", claims, "claim", "wording")
    assert none.isEmpty() and textscan.match_claims(df, "id", "text", claims.limit(0), "claim", "wording").isEmpty()
    hit = textscan.screened(F.concat_ws(" ", "text", "evidence"), F.col("text"), ["C-1"], ["see alpha", "epsilon"], ["alpha beta of gamma"])
    assert [r.id for r in df.where(hit).orderBy("id").collect()] == [2, 3, 7, 8]
    assert df.where(textscan.screened(F.col("text"), F.col("text"))).isEmpty()
