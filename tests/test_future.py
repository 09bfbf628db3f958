import random

import pytest
from helpers import INF, Walker, grid, model, percentile
from pyspark.sql import functions as F

from tidepath.operators import future, scenario, search
from tidepath.operators.cost import CostOptions

SLOTS = "scenario_id string, edge_idx int, speed_factor float, valid_from long, valid_until long"
NAMED = {
    "alternative": ([(0, 1, 1.0), (0, 2, 2.0), (1, 3, 1.0), (2, 3, 1.0)], 0, 3, [(0.6, []), (0.4, [(2, 0.4)])]),
    "compromise": ([(0, 1, 5), (0, 2, 5), (0, 3, 20), (1, 4, 5), (2, 4, 5), (3, 4, 20)], 0, 4, [(0.5, [(1, 0.1), (4, 0.1)]), (0.5, [(0, 0.1), (3, 0.1)])]),
    "dense_terminal": ([(0, 1, 1.5), (0, 2, 2.0), (0, 3, 2.5), (1, 4, 1.5), (2, 4, 1.0), (3, 4, 0.8), (4, 5, 1.0)], 0, 5, [(0.4, []), (0.3, [(0, 0.5), (3, 0.5)]), (0.3, [(2, 0.4), (5, 0.4)])]),
    "blocked": ([(0, 1, 1), (0, 2, 4), (1, 3, 1), (2, 3, 4)], 0, 3, [(0.5, []), (0.5, [(2, 0.0)])]),
}


def setup(spark, name):
    edges, source, target, worlds = NAMED[name]
    m = model(spark, edges)
    scenarios = spark.createDataFrame([(1, f"s{i}", p) for i, (p, _) in enumerate(worlds)], "request_id int, scenario_id string, probability double")
    over = spark.createDataFrame([(f"s{i}", e, float(s), 0, 10**9) for i, (_, us) in enumerate(worlds) for e, s in us], SLOTS)
    asked = spark.createDataFrame([(1, source, target, 0)], "request_id int, source int, target int, departure long")
    walkers = [(p, Walker(edges, [(e, s, 0, 10**9) for e, s in us])) for p, us in worlds]
    return m, scenarios, over, asked, walkers, source, target


@pytest.mark.parametrize("name", NAMED)
def test_products_against_enumeration(spark, name):
    m, scenarios, over, asked, walkers, source, target = setup(spark, name)
    out = future.future_routes(asked, m, scenarios, over)
    paths = list(walkers[0][1].paths(source, target))
    costs = {p: [(w.drive(p, 0)[0], q) for q, w in walkers] for p in paths}
    mean = {p: sum(q * c for c, q in v) for p, v in costs.items()}
    p90 = {p: percentile(v, 0.9) for p, v in costs.items()}
    expected, robust = out["expected"].first(), out["robust"].first()
    assert expected.expected_cost == pytest.approx(min(mean.values()))
    assert robust.p90_cost == pytest.approx(min(p90.values()))
    for r in out["candidates"].collect():
        p = tuple(r.edge_path)
        assert r.expected_cost == pytest.approx(mean[p]) and r.p90_cost == pytest.approx(p90[p]) and r.p50_cost == pytest.approx(percentile(costs[p], 0.5))
        best = [min(costs[x][i][0] for x in paths) for i in range(len(walkers))]
        assert r.expected_regret == pytest.approx(sum(q * (c - b) for (c, q), b in zip(costs[p], best)))
    assert out["alternatives"].filter("place = 0").first().signature == expected.signature
    assert out["density"].count() == 1
    if name == "compromise":
        assert out["density"].first().n_optimal == 2


def test_unreachable_request_has_no_product(spark):
    m = model(spark, [(0, 1, 1)], n=3)
    s = spark.createDataFrame([(1, "a", 1.0)], "request_id int, scenario_id string, probability double")
    asked = spark.createDataFrame([(1, 0, 2, 0)], "request_id int, source int, target int, departure long")
    out = future.future_routes(asked, m, s, spark.createDataFrame([], SLOTS))
    assert out["expected"].count() == 0 and out["candidates"].count() == 0 and not out["optima"].first().reachable


def test_matrix_cells(spark):
    m, scenarios, over, _, walkers, source, target = setup(spark, "blocked")
    cells = spark.createDataFrame([(1, 0, 0, 0, 3, 0), (1, 0, 1, 0, 1, 0), (1, 1, 0, 1, 3, 0)], "request_id int, source_pos int, target_pos int, source int, target int, departure long")
    got = {(r.source, r.target): r for r in future.future_matrix(cells, m, scenarios, over).collect()}
    assert (got[0, 3].expected_cost, got[0, 3].p50_cost, got[0, 3].p90_cost) == (5.0, 2.0, 8.0)
    assert got[1, 3].reach_probability == 0.5 and got[1, 3].expected_cost == INF and got[1, 3].min_cost == 1.0 and got[1, 3].max_arrival == search.FAR


def test_overlap_and_density(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x]) if x else F.array().cast("array<int>")
    r = spark.range(1).select(future.overlap(a(1, 2, 3), a(2, 3, 4)).alias("x"), future.overlap(a(), a()).alias("e"), future.density(F.lit(4), F.lit(3), F.lit(3)).alias("h"), future.density(F.lit(4), F.lit(2), F.lit(2)).alias("l")).first()
    assert (r.x, r.e, r.h, r.l) == (0.5, 1.0, "HIGH_DENSITY", "LOW_DENSITY")


PEAK = [1.0] * 8 + [2.0] + [1.0] * 15


def requests(spark, departure=7 * 3600, horizon=4 * 3600):
    return spark.createDataFrame([(1, departure, horizon)], "request_id int, departure long, horizon long")


def test_bundles(spark):
    m = model(spark, [(0, 1, 100), (1, 0, 50)], profiles=[(1, 127, PEAK)])
    calendar = CostOptions(calendar=True)
    scenarios, updates = scenario.resolve_bundle(requests(spark), m, calendar)
    got = {r.scenario_id: r.probability for r in scenarios.collect()}
    assert set(got) == {"baseline", "periodic_peak"} and sum(got.values()) == pytest.approx(1)
    u = {r.edge_idx: r for r in updates.collect()}
    assert u[0].speed_factor == 0.5 and (u[0].valid_from, u[0].valid_until) == (8 * 3600, 9 * 3600)
    assert scenario.check_bundle(scenarios, updates, m.edges).count() == 0
    assert scenario.bundle_id(scenarios, updates).first().bundle_id == scenario.bundle_id(scenarios.orderBy(F.desc("scenario_id")), updates).first().bundle_id
    # without a calendar there is no recurring signal
    assert scenario.resolve_bundle(requests(spark), m, CostOptions())[0].count() == 1


def test_incident_bundle(spark):
    m = model(spark, grid(3, 2), profiles=[(1, 127, PEAK)])
    failed = spark.createDataFrame([(0, 0.0, 0, 10**6)], "edge_idx int, speed_factor float, valid_from long, valid_until long")
    scenarios, updates = scenario.resolve_bundle(requests(spark), m, CostOptions(calendar=True), failed, observed_at=7 * 3600)
    p = {r.scenario_id: r.probability for r in scenarios.collect()}
    assert set(p) == {"incident_persists", "clearing_fast"} and 0.35 <= p["incident_persists"] <= 0.85
    u = {(r.scenario_id, r.edge_idx): r for r in updates.collect()}
    assert u["incident_persists", 0].valid_until == 10**6 and u["clearing_fast", 0].speed_factor == 0.0
    assert u["clearing_fast", 0].valid_until == 7 * 3600 + 2 * 3600
    assert u["clearing_fast", 1].speed_factor == 0.5


def test_bundle_checks(spark):
    m = model(spark, [(0, 1, 1)])
    s = spark.createDataFrame([(1, "a", 0.7), (1, "a", 0.7)], "request_id int, scenario_id string, probability double")
    u = spark.createDataFrame([(1, "a", 5, 0.5, 0, 9), (1, "a", 5, 0.5, 0, 9)], "request_id int, scenario_id string, edge_idx int, speed_factor float, valid_from long, valid_until long")
    good = scenario.audit("profiles", F.lit(10).cast("long"), F.lit(4), F.lit(0.5), F.lit(0.5), F.lit(0.7), F.col("probability"))
    bad = scenario.audit("profiles", F.lit(10).cast("long"), F.lit(4), F.lit(1.5), F.lit(0.5), F.lit(0.7), F.col("probability"))
    audited = s.limit(1).withColumn("probability", F.lit(1.0))
    assert scenario.check_bundle(audited.withColumn("audit", good), u.limit(0), m.edges).count() == 0
    assert scenario.check_bundle(audited.withColumn("audit", bad), u.limit(0), m.edges).first().reason_code == "SCENARIO_AUDIT"
    assert {r.reason_code for r in scenario.check_bundle(s, u, m.edges).collect()} == {"SCENARIO_DUPLICATE", "SCENARIO_PROBABILITY_SUM", "SCENARIO_EDGE_UNKNOWN", "SCENARIO_EDGE_DUPLICATE"}


def test_weights(spark):
    rng = random.Random(1)
    for _ in range(3):
        fresh, far = rng.random(), rng.random()
        r = spark.range(1).select(scenario.incident_probability(F.lit(fresh), F.lit(far), F.lit(0.0)).alias("p"), scenario.freshness(F.lit(100), F.lit(None).cast("long")).alias("f"), scenario.update_budget(F.lit(1.0), F.lit(10_000)).alias("b")).first()
        assert r.p == pytest.approx(min(0.85, max(0.35, 0.35 + 0.5 * fresh * far))) and r.f == 0.2 and r.b == 64
