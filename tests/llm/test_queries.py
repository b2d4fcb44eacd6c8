import math
import os

import duckdb
import pytest
from oracle import same, sql_rows

queries = pytest.importorskip("strandmill.llm.queries")
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
DIRECT = ("p5_percentiles", "p8_ids", "p9_mix", "p9_shares", "p9_short", "p10_found", "p10_statistics")


def test_every_query_has_sql_or_a_check():
    assert set(queries.QUERIES) - set(queries.ORACLES) == set(DIRECT)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_equals_sql(spark, data, name):
    same(queries.QUERIES[name](spark, data), data, queries.ORACLES[name])


def test_percentile_errors_are_those_of_exact_counts(spark, data):
    got = queries.p5_percentiles(spark, data).toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute(f"create view proteins as select * from '{data}/proteins.parquet'")
    one = queries.ORACLES["p5_found"].split("m as (")[0].rstrip().rstrip(",")
    rows = con.sql(f"""{one}
select got.cluster_id, q, got.n, count(*), rank_error, greatest(0, avg((length < estimate)::int) - q, q - avg((length <= estimate)::int))
from got join one on one.cluster_id = got.cluster_id group by got.cluster_id, q, got.n, rank_error""").fetchall()
    assert len(rows) == len(got) > 0 and len({r[0] for r in rows}) * 5 == len(rows)
    assert all(n == m and math.isclose(e, x, abs_tol=1e-9) and e <= 0.02 for _, _, n, m, e, x in rows)


def test_ids_are_those_of_the_library(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    texts = dict(duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall())
    got = {r.doc_id: list(r.ids) for r in queries.p8_ids(spark, data).collect()}
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}


@pytest.mark.parametrize("name", ["p9_shares", "p9_short"])
def test_shares_follow_weights_within_repeats(spark, data, name):
    rows = queries.QUERIES[name](spark, data).collect()
    sizes = {r["doc_id"]: r["n_tokens"] for r in queries._sizes(spark, data).collect()}
    assert math.isclose(sum(r["share"] for r in rows), 1, abs_tol=1e-9)
    # A source has as many leaves as languages; each misses its budget by half a document at most.
    slack = max(sizes.values()) / 2 * 12
    for r in rows:
        assert r["most_uses"] <= r["max_repeats"] and abs(r["tokens"] - r["budget"]) <= slack
        assert r["budget"] <= r["tokens_held"] * r["max_repeats"]
    free = [r for r in rows if 0 < r["budget"] < r["tokens_held"] * r["max_repeats"] - 12]
    assert free
    per_weight = [r["budget"] / r["target_share"] for r in free]
    assert max(per_weight) - min(per_weight) <= 12 / min(r["target_share"] for r in free)


def test_mix_adds_up_to_its_shares(spark, data):
    used = {}
    for r in queries.p9_mix(spark, data).collect():
        used[r["source"]] = used.get(r["source"], 0) + r["n_tokens"] * r["uses"]
    assert used == {r["source"]: r["tokens"] for r in queries.p9_shares(spark, data).collect() if r["tokens"]}


def test_parts_add_up_to_the_distance(spark, data):
    rows = queries.p10_statistics(spark, data).collect()
    found = {(r.doc_id, r.kind) for r in queries.p10_found(spark, data).collect()}
    parts = [c for c in rows[0].__fields__ if c.startswith("part_")]
    assert found == {(r.doc_id, r.kind) for r in rows if r.kind is not None} and found and len(parts) == 10
    assert all(math.isclose(sum(r[c] for c in parts), r.distance, rel_tol=1e-6, abs_tol=1e-6) for r in rows)
    # Null, empty and blank texts have no row; every other document has one.
    full = sql_rows(data, "select doc_id from documents where text is not null and regexp_matches(text, '[^\\s]')")[1]
    assert {str(r.doc_id) for r in rows} == {b[0] for b in full}
