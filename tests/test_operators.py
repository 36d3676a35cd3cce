"""Joins, graph search and windows against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from provspark.operators import anchors, graph, joins, truth, type_names

B = ["b"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rnd_ranges(rng, n, top):
    starts = rng.sample(range(top), n)
    return [(rng.choice("xy"), s, s + rng.choice([0, 1, 5, 40, 700])) for s in starts]


@pytest.mark.parametrize("seed", range(3))
def test_range_and_asof_joins(spark, seed):
    rng = random.Random(seed)
    ranges = rnd_ranges(rng, 60, 3000)
    points = [(rng.choice("xyz"), rng.randrange(3200), i) for i in range(200)]
    p, r = frame(spark, points, "b string, p long, i long"), frame(spark, ranges, "b string, s long, e long")
    got = {tuple(x) for x in joins.range_join(p, r, "p", "s", "e", B, bits=6).select("i", "s").collect()}
    assert got == {(i, s) for b, v, i in points for c, s, e in ranges if b == c and s <= v < e}
    semi = sorted(x["i"] for x in joins.range_join(p, r, "p", "s", "e", B, bits=6, how="left_semi").collect())
    assert semi == sorted({i for i, _ in got})
    best = {}
    for b, v, i in points:
        near = [(s, e) for c, s, e in ranges if c == b and s <= v]
        if near and v < max(near)[1]:
            best[i] = max(near)[0]
    got = {x["i"]: x["s"] for x in joins.asof_containing(p, r, "p", "s", "e", B, bits=6).collect()}
    assert got == best
    locs = [(c, s) for c, s, _ in ranges]
    want = {}
    for b, v, i in points:
        near = [s for c, s in locs if c == b and s <= v]
        if near and v < max(near) + 24:
            want[i] = max(near)
    got = {x["i"]: x["s"] for x in joins.asof_within(p, frame(spark, locs, "b string, s long"), "p", "s", 24, B).collect()}
    assert got == want


def test_asof_edges(spark):
    locs = frame(spark, [("a", 100, "n"), ("a", 110, "m")], "b string, s long, f string")
    pts = frame(spark, [("a", p) for p in (99, 100, 109, 110, 123, 124, 133, 134, 134)], "b string, p long")
    got = sorted((x["p"], x["s"]) for x in joins.asof_within(pts, locs, "p", "s", 24, B).collect())
    assert got == [(100, 100), (109, 100), (110, 110), (123, 110), (124, 110), (133, 110)]


def plain_bfs(edges, seeds, barrier, nodes, depth):
    seen = {s: 0 for s in seeds if s in nodes}
    front, d = set(seen), 0
    while front and (depth is None or d < depth):
        d += 1
        front = {y for x, y in edges if x in front and y in nodes and y not in barrier and y not in seen}
        seen |= dict.fromkeys(front, d)
    return seen


@pytest.mark.parametrize(("seed", "depth"), [(0, None), (1, 0), (2, 1), (3, 2)])
def test_attribution(spark, seed, depth):
    rng = random.Random(seed)
    nodes = set(range(40))
    edges = {(rng.randrange(45), rng.randrange(45)) for _ in range(70)} | {(3, 3)}
    seeds, barrier = set(rng.sample(range(42), 5)), set(rng.sample(range(42), 6))
    barrier |= {next(iter(seeds))}
    fns = frame(spark, [(n, n + 1) for n in nodes], "fn_start long, fn_end long")
    one = [frame(spark, [(s,) for s in x], "fn_start long") for x in (seeds, barrier)]
    calls = frame(spark, sorted(edges), "caller long, callee long")
    seen = plain_bfs(edges, seeds, barrier, nodes, depth)
    outside = {y for x, y in edges if x not in seen}
    want = {n: "library" if n not in seen else "certain" if seen[n] == 0 else "indeterminate" if n in outside else "inferred" for n in nodes}
    got = graph.attribute(fns, one[0], calls, one[1], depth)
    assert {r["fn_start"]: r["attribution"] for r in got.collect()} == want
    back = plain_bfs({(y, x) for x, y in edges}, seeds, barrier, nodes, depth)
    got = graph.backtrace(fns, one[0], calls, one[1], depth)
    assert {r["fn_start"]: r["depth"] for r in got.collect()} == {n: d for n, d in back.items() if d}


def test_graph_cases(spark):
    edges = frame(spark, [("a", 1, 2), ("a", 1, 3), ("b", 1, 9)], "b string, src long, dst long")
    assert {tuple(r) for r in graph.reverse_edges(edges).collect()} == {("a", 2, 1), ("a", 3, 1), ("b", 9, 1)}
    fns = frame(spark, [(x, x + 1) for x in (0x10, 0x20, 0x30, 0x40)], "fn_start long, fn_end long")
    calls = frame(spark, [(0x30, 0x20), (0x20, 0x10), (0x40, 0x30)], "caller long, callee long")
    seed, none = frame(spark, [(0x10,)], "fn_start long"), frame(spark, [], "fn_start long")

    def walk(depth, barrier=none):
        return {r["fn_start"] for r in graph.backtrace(fns, seed, calls, barrier, depth).collect()}

    assert [walk(0), walk(1), walk(2)] == [set(), {0x20}, {0x20, 0x30}]
    assert walk(10, frame(spark, [(0x20,)], "fn_start long")) == set()


def test_binaries_stay_apart(spark):
    edges = frame(spark, [("a", 1, 2), ("b", 2, 3)], "b string, src long, dst long")
    got = graph.bfs(edges, frame(spark, [("a", 1)], "b string, node long"), by=B)
    assert {tuple(r) for r in got.collect()} == {("a", 1, 0), ("a", 2, 1)}


def test_tiers(spark):
    hits = frame(spark, [(1, 10, "user"), (1, 20, "user"), (1, 20, "user"), (2, 10, "user"), (3, 30, "dep")], "fn_start long, struct_vaddr long, kind string")
    locs = frame(spark, [(10, "b.rs"), (20, "a.rs"), (30, "c.rs")], "struct_vaddr long, file string")
    fns = frame(spark, [(1, 5), (2, 1), (3, 9)], "fn_start long, fn_end long")
    got = {r["fn_start"]: tuple(r) for r in anchors.tier_functions(fns, hits, locs).collect()}
    assert got == {1: (1, 5, 4, "strong", 2, ["a.rs", "b.rs"]), 2: (2, 1, 0, "single", 1, ["b.rs"])}
    assert {r["tier"] for r in anchors.tier_functions(fns, hits, locs, 1).collect()} == {"strong"}
    assert {r["tier"] for r in anchors.tier_functions(fns, hits, locs, 3).collect()} == {"single"}
    assert anchors.tier_functions(fns, hits, locs, precision=True).count() == 1


def test_first_slot_hides_later_ones(spark):
    relocs = frame(spark, [(0, 8, 5), (1, 16, 5), (2, 24, 6)], "reloc_idx int, offset long, addend long")
    assert {tuple(r) for r in anchors.first_slot_wins(relocs).select("addend", "offset").collect()} == {(5, 8), (6, 24)}


@pytest.mark.parametrize(
    ("paths", "stem", "want"),
    [
        (["r/cargo/registry/src/i/bat-0.24.0/src/main.rs", "r/cargo/registry/src/i/serde-1.0.0/src/lib.rs"], "x", "bat"),
        (["r/cargo/registry/src/i/fd-find-10.2.0/src/bin/fd.rs"], "fd", "fd-find"),
        (["r/cargo/registry/src/i/hyperfine-1.18.0/src/lib.rs", "r/cargo/registry/src/i/serde-1.0.0/src/lib.rs"], "hyperfine", "hyperfine"),
        (["r/cargo/registry/src/i/a-1.0/src/main.rs", "r/cargo/registry/src/i/b-1.0/src/main.rs"], "x", None),
        (["r/cargo/registry/src/i/a-1.0/src/main.rs", "r/cargo/registry/src/i/a-2.0/src/main.rs"], "x", None),
        (["src/main.rs"], "x", None),
    ],
)
def test_root_detection(spark, paths, stem, want):
    got = anchors.detect_roots(frame(spark, [("b", stem, p) for p in paths], "b string, stem string, path string"), B).collect()
    assert [(r["outcome"], r["root_crate"]) for r in got] == [("detected" if want else "fallback", want)]


def test_runs_and_pairs(spark):
    rng = random.Random(7)
    fns = [("a", 100 * i, 100 * i + 70) for i in range(6)]
    ops = [("a", ip, rng.choice(["lea", "lea", "mov", "call"]), rng.randrange(110), ip * 2) for ip in sorted(rng.sample(range(600), 200))]
    inside = [(ip, op, imm, t, next(s for _, s, e in fns if s <= ip < e)) for _, ip, op, imm, t in ops if any(s <= ip < e for _, s, e in fns)]
    want, run, window, last = set(), 0, [], None
    for ip, op, imm, _, fn in inside:
        if last is not None and fn != last:
            run, window = run + 1, []
        last = fn
        if op == "lea":
            window = [*window, ip][-6:]
        elif op == "mov" and 2 <= imm <= 100:
            want |= {(run, ip, x) for x in window}
    x = type_names.runs(frame(spark, ops, "b string, ip long, op string, imm long, target long"), frame(spark, fns, "b string, fn_start long, fn_end long"), B)
    got = {(r["run_id"], r["mov_ip"], r["lea_ip"]) for r in type_names.load_constant_pairs(x, B).collect()}
    assert got == want


def test_scores(spark):
    rows = frame(spark, [("certain", "TP"), ("certain", "FP"), ("certain", "UNK"), ("inferred", "UNK")], "attribution string, label string")
    got = {r["attribution"]: (r["precision"], r["tp_over_predicted"]) for r in truth.bucket_metrics(rows).collect()}
    assert got == {"certain": (0.5, 1 / 3), "inferred": (None, 0.0)}
    steps = frame(spark, [(1, "TP"), (2, "TP"), (3, "FP")], "anchor_count long, label string")
    got = {r["min_anchors"]: (r["tp"], r["fp"], r["recall_retained"]) for r in truth.ladder(steps).collect()}
    assert got == {1: (2, 1, 1.0), 2: (1, 1, 0.5), 3: (0, 1, 0.0)}
    med = frame(spark, [(1.0,), (2.0,), (4.0,), (9.0,)], "v double").agg(truth.upper_median(F.col("v")).alias("m")).first()["m"]
    assert med == 4.0
