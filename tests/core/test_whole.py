"""Queries over whole tables, against brute force."""

import random
from collections import defaultdict

import pyarrow.parquet as pq

from mdlake.operators import relations
from mdlake.queries import collect

SF = "/root/testdata/sf0.01"


def test_evidence_of_all_orders(spark):
    rows = pq.read_table(f"{SF}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).to_pylist()
    contents = defaultdict(set)
    for o in rows:
        contents[o["o_custkey"], o["o_orderstatus"] == "P"].add(o["o_orderpriority"])

    def cause(o):
        if o["o_custkey"] % 5 == 0:
            return "invalid-target"
        if o["o_orderstatus"] == "P":
            return "wrong-revision"
        if len(contents[o["o_custkey"], False]) > 1:
            return "record-conflict"
        return "failed" if o["o_orderpriority"] == "5-LOW" else None

    got = collect()[0]["evidence_causes"](spark, SF).collect()
    assert sorted((r["record"], r["cause"] or "") for r in got) == sorted((o["o_orderkey"], cause(o) or "") for o in rows)


def test_tuples_of_all_parts(spark):
    rows = pq.read_table(f"{SF}/part.parquet", columns=["p_brand", "p_size"]).to_pylist()
    brands, sizes = {p["p_brand"] for p in rows}, {str(p["p_size"]) for p in rows}
    want = [(b, s) for b in brands for s in sizes] + [(v, x) for v in brands | sizes for x in "ab" if (v, x) != ("1", "a")]
    got = collect()[0]["combinatorial_tuples"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert len(sizes) > 3


def _shortest(edges, start):
    """Hops of a shortest cycle through a start and larger nodes, or None."""
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    seen, front, hops = set(), {start}, 0
    while front:
        hops += 1
        front = {b for a in front for b in after[a] if b >= start} - seen
        if start in front:
            return hops
        seen |= front
    return None


def test_cycles_of_any_length(spark):
    ring = [(f"A{i:02}", f"A{(i + 1) % 27:02}") for i in range(27)]
    chain = [(f"B{i:02}", f"B{i + 1:02}") for i in range(9)]
    rng = random.Random(5)
    mixed = [(f"C{rng.randrange(40):02}", f"C{rng.randrange(40):02}") for _ in range(60)]
    edges = ring + chain + [("B05", "A03"), ("D", "D")] + mixed
    rows = [(a, b, "precedes", "resolved") for a, b in edges] + [("E1", "E2", "precedes", "resolved"), ("E2", "E1", "precedes", "dangling"), ("E2", "E1", "follows", "resolved")]
    got = relations.cycles(spark.createDataFrame(rows, "source string, target string, edge_type string, resolution string"), "precedes").collect()
    want = [(s, _shortest(edges, s)) for s in sorted({x for e in edges for x in e})]
    assert [tuple(r) for r in got] == [w for w in want if w[1]]
    assert ("A00", 27) in want
