import random

import pytest
from helpers import INF, Walker, grid, model
from pyspark.sql import functions as F

from tidepath.operators import heuristics, search
from tidepath.operators.cost import CostOptions
from tidepath.operators.search import Budget
from tidepath.sources.model import ModelError

SLOTS = "edge_idx int, speed_factor float, valid_from long, valid_until long"
CELLS = "request_id string, source_pos int, target_pos int, source int, target int, departure long"
REQ = "request_id int, source int, target int, departure long"


def answers(df):
    return {r.request_id: r for r in df.collect()}


def test_two_criteria(spark):
    m = model(spark, [(0, 1, 1.1), (0, 2, 3.0), (1, 2, 1.9)])
    r = answers(search.routes(spark.createDataFrame([(1, 0, 2, 0)], REQ), m))[1]
    assert (r.cost, r.arrival, list(r.edge_path)) == (3.0, 3, [1])


def test_edge_cases(spark):
    m = model(spark, [(0, 1, 5), (0, 1, 4), (1, 1, 1), (1, 2, 3)], n=5, turns=[(1, 3, INF)])
    over = spark.createDataFrame([(0, 0.0, 100, 200)], SLOTS)
    asked = spark.createDataFrame([(1, 0, 0, 7), (2, 0, 4, 7), (3, 0, 2, 0), (4, 0, 2, 100), (5, None, 2, 0)], REQ)
    a = answers(search.routes(asked, m, over))
    assert (a[1].cost, a[1].arrival, list(a[1].node_path)) == (0.0, 7, [0])
    assert (a[2].reachable, a[2].cost, a[2].arrival, list(a[2].edge_path)) == (False, INF, 7, [])
    # the turn from the cheaper parallel edge is forbidden; the loop in between allows it
    assert (a[3].cost, list(a[3].edge_path)) == (8.0, [0, 3]) or (a[3].cost, list(a[3].edge_path)) == (8.0, [1, 2, 3])
    assert (a[4].cost, list(a[4].edge_path)) == (8.0, [1, 2, 3])
    assert a[5].reason_code == "REQUEST_INCOMPLETE" and a[5].cost is None


def test_equal_routes_take_the_smallest_path(spark):
    m = model(spark, [(0, 2, 2), (0, 1, 1), (1, 3, 2), (2, 3, 1)])
    assert list(answers(search.routes(spark.createDataFrame([(1, 0, 3, 0)], REQ), m))[1].edge_path) == [0, 3]


def test_against_walker(spark):
    rng = random.Random(11)
    edges = [(a, b, rng.choice([1.5, 2.25, 7.0, 30.0]), rng.choice([1, 2])) for a in range(7) for b in range(7) if a != b and rng.random() < 0.45]
    buckets = {1: [1.0 + (i * 5 % 16) / 16 for i in range(24)], 2: [1.0 + (i * 11 % 16) / 16 for i in range(24)]}
    turns = [(a, b, rng.choice([5.0, INF])) for a in range(len(edges)) for b in range(len(edges)) if edges[a][1] == edges[b][0] and rng.random() < 0.15]
    over = [(e, rng.choice([0.0, 0.5, 0.25]), 0, 10**6) for e in range(0, len(edges), 4)]
    m = model(spark, edges, n=7, profiles=[(k, 127, v) for k, v in buckets.items()], turns=turns)
    w = Walker(edges, over, turns, buckets)
    asked = [(i, a, b, 1000 * i) for i, (a, b) in enumerate((a, b) for a in range(7) for b in range(7))]
    got = answers(search.routes(spark.createDataFrame(asked, REQ), m, spark.createDataFrame(over, SLOTS)))
    driven = search.replay(spark.createDataFrame([(i, list(got[i].edge_path), t) for i, _, _, t in asked if got[i].reachable], "path_id int, edge_path array<int>, departure long"), m, spark.createDataFrame(over, SLOTS))
    driven = {r.path_id: r for r in driven.collect()}
    for i, a, b, t in asked:
        # forbidden turns may need a walk through a node twice, which the walker does not do: it can only be dearer
        cost = w.best(a, b, t)[0]
        assert got[i].cost <= cost
        if got[i].reachable and a != b:
            assert (driven[i].cost, driven[i].arrival) == (got[i].cost, got[i].arrival)
            nodes = list(got[i].node_path)
            if len(set(nodes)) == len(nodes):
                assert got[i].cost == cost


def test_grid_matrix_and_stats(spark):
    m = model(spark, grid(5, 4))
    cells = spark.createDataFrame([("r", i, j, s, t, 0) for i, s in enumerate((0, 7, 0)) for j, t in enumerate((19, 0, 19))], CELLS)
    out = search.matrix(cells, m)
    got = {(r.source_pos, r.target_pos): r.cost for r in out.collect()}
    far = lambda a, b: abs(a % 5 - b % 5) + abs(a // 5 - b // 5)
    assert got == {(i, j): float(far(s, t)) for i, s in enumerate((0, 7, 0)) for j, t in enumerate((19, 0, 19))}
    assert search.matrix_stats(out).first().n_cells == 9


def test_budgets_stop_one_request(spark):
    m, asked = model(spark, grid(4, 4)), spark.createDataFrame([(1, 0, 15, 0), (2, 0, 1, 0), (3, 5, 5, 0)], REQ)
    for budget, code in ((Budget(rounds=2), "ROUNDS"), (Budget(labels=12), "LABELS"), (Budget(frontier=3), "FRONTIER")):
        got = answers(search.routes(asked, m, budget=budget))
        assert got[1].reason_code == f"SEARCH_{code}_EXCEEDED" and got[1].cost is None and got[1].reachable is None
        assert (got[2].cost, got[2].reason_code) == (1.0, None) and got[3].cost == 0.0
    cells = spark.createDataFrame([("r", 0, 0, 0, 15, 0), ("r", 1, 0, 14, 15, 0), ("r", 0, 1, 0, 0, 0)], CELLS)
    out = {(r.source, r.target): r for r in search.matrix(cells, m, budget=Budget(rounds=3), strategy="PAIRWISE").collect()}
    assert out[0, 15].reason_code == "SEARCH_ROUNDS_EXCEEDED" and out[14, 15].cost == 1.0 and out[0, 0].cost == 0.0


def test_cells_keep_their_reason(spark):
    m = model(spark, grid(2, 2))
    cells = spark.createDataFrame([("r", 0, 0, 0, 3, 0, None), ("r", 0, 1, 0, None, 0, "ADDRESS_TARGET_UNKNOWN"), ("r", 0, 2, 0, 3, None, None)], CELLS + ", reason_code string")
    got = {r.target_pos: r for r in search.matrix(cells, m).collect()}
    assert got[0].cost == 2.0 and got[1].reason_code == "ADDRESS_TARGET_UNKNOWN" and got[2].reason_code == "REQUEST_INCOMPLETE" and got[1].reachable is None


def test_guides_change_no_answer_and_look_at_less(spark):
    rng = random.Random(5)
    w, h = 4, 3
    edges = [(a, b, 10 * rng.uniform(1.0, 1.6), 1) for a, b, _ in grid(w, h)]
    m = model(spark, edges, profiles=[(1, 127, [1.0 + (i * 7 % 5) / 10 for i in range(24)])], turns=[(0, 2, 5.0), (4, 9, INF)], xy=[(10 * (i % w), 10 * (i // w)) for i in range(w * h)])
    over = spark.createDataFrame([(7, 0.5, 0, 10**6), (11, 0.0, 0, 10**6)], SLOTS)
    asked = spark.createDataFrame([(i, rng.randrange(w * h), rng.randrange(w * h), 3000 * i) for i in range(4)], REQ)
    plain, effort = search.find_routes(asked, m, over)
    want, n = sorted(map(tuple, plain.collect())), effort.agg(F.sum("n_labels")).first()[0]
    for guide, backward in ((heuristics.guide_for(m, "EUCLIDEAN"), False), (None, True)):
        got, less = search.find_routes(asked, m, over, guide=guide, backward=backward)
        assert sorted(map(tuple, got.collect())) == want
        assert less.agg(F.sum("n_labels")).first()[0] < n
    cells = spark.createDataFrame([("r", i, j, s, t, 0) for i, s in enumerate((0, 7)) for j, t in enumerate((11, 4))], CELLS)
    want = sorted(map(str, search.matrix(cells, m, over).collect()))
    assert sorted(map(str, search.matrix(cells, m, over, guide=heuristics.guide_for(m, "LANDMARK", heuristics.landmark_table(m, 2))).collect())) == want
    assert sorted(map(str, search.matrix(cells, m, over, backward=True, strategy="PAIRWISE").collect())) == want


def test_guide_checks(spark, tmp_path):
    m = model(spark, grid(2, 2), xy=[(0, 0), (200, 0), (0, 1), (1, 1)])
    assert heuristics.guide_for(m, "NONE") is None and heuristics.guide_for(m, "EUCLIDEAN") is not None
    with pytest.raises(ModelError, match="COORDINATES"):
        heuristics.guide_for(m, "SPHERICAL")
    with pytest.raises(ModelError, match="TYPE"):
        heuristics.guide_for(m, "OTHER")
    path = f"file://{tmp_path}/landmarks"
    table = heuristics.landmark_table(m, 2)
    heuristics.save_landmarks(table, m, path)
    assert sorted(map(tuple, heuristics.load_landmarks(spark, path, m).collect())) == sorted((r.landmark_pos, r.landmark, r.node_idx, r.fwd, r.bwd) for r in table.collect())
    with pytest.raises(ModelError, match="LANDMARK"):
        heuristics.load_landmarks(spark, path, model(spark, grid(3, 2)))


def test_replay_reasons(spark):
    m = model(spark, [(0, 1, 1), (2, 3, 1)])
    rows = search.replay(spark.createDataFrame([(1, [0, 1], 0), (2, [7], 0), (3, [], 5)], "path_id int, edge_path array<int>, departure long"), m)
    got = {r.path_id: (r.feasible, r.reason_code) for r in rows.collect()}
    assert got == {1: (False, "PATH_DISCONNECTED"), 2: (False, "PATH_EDGE_UNKNOWN"), 3: (True, None)}


def test_bounds_are_below_costs(spark):
    rng = random.Random(3)
    edges = [(a, b, rng.uniform(5, 50)) for a in range(8) for b in range(8) if a != b and rng.random() < 0.4]
    m = model(spark, edges, n=8, profiles=[(1, 31, [0.8 + i % 5 / 10 for i in range(24)])], xy=[(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(8)])
    pairs = m.nodes.select(F.col("node_idx").alias("source")).crossJoin(m.nodes.select(F.col("node_idx").alias("target")))
    asked = pairs.filter("source <> target").withColumn("request_id", F.col("source") * 100 + F.col("target")).withColumn("departure", F.lit(0).cast("long"))
    cost = {(r.request_id // 100, r.request_id % 100): r.cost for r in search.routes(asked, m).collect()}
    table = heuristics.landmark_table(m, 3)
    for bounds in (heuristics.landmark_bounds(pairs, table), heuristics.geometry_bounds(pairs, m, "EUCLIDEAN"), heuristics.geometry_bounds(pairs, m, "SPHERICAL"), heuristics.geometry_bounds(pairs, m, "NONE")):
        for r in bounds.collect():
            if r.source != r.target:
                assert 0 <= r.bound <= cost[r.source, r.target] + 1e-3
    meta = heuristics.signature(m).first().asDict()
    heuristics.check_compatible(meta, m)
    with pytest.raises(ModelError):
        heuristics.check_compatible(meta | {"signature": "0"}, m)


def test_reachability(spark):
    m = model(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1)], n=4)
    got = {(r.source, r.node): r.hops for r in search.reachable_nodes(m.nodes, m.edges).collect()}
    assert got[0, 2] == 2 and got[3, 3] == 0 and (3, 0) not in got


def test_calendar_engine_differs_from_linear(spark):
    m = model(spark, [(0, 1, 10)], profiles=[(1, 1, [3.0] * 24)])
    asked = spark.createDataFrame([(1, 0, 1, 0)], REQ)  # a Thursday, not in the mask
    assert answers(search.routes(asked, m))[1].cost == 30.0
    assert answers(search.routes(asked, m, opts=CostOptions(calendar=True)))[1].cost == 10.0
