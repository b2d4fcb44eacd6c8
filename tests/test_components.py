import pyarrow.parquet as pq

from strandmill.plans import reference


def closed(folder, least=140.0):
    """Node to the smallest node of its component, by union and find over the table's edges."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    t = pq.read_table(f"{folder}/tier2_hits.parquet", columns=["target_id", "label", "bitscore"]).to_pydict()
    for a, b, v in zip(t["target_id"], t["label"], t["bitscore"]):
        if a is not None and b is not None and v is not None and v >= least:
            low, high = sorted((find(a), find(b)))
            up[high] = low
    return {x: find(x) for x in list(up)}


def test_family_components_by_union_and_find(spark, data):
    got = [tuple(r) for r in reference.family_components(spark, data).select("node", "component").collect()]
    want = closed(data)
    assert len(got) == len(want) and dict(got) == want
    assert len(want) > len(closed(data, 450.0))
