import pytest
from helpers import INF, Walker, model
from pyspark.sql import functions as F

from tidepath.operators import cost, overlay
from tidepath.operators.cost import CostOptions
from tidepath.sources.model import Model

SLOTS = "edge_idx int, speed_factor float, valid_from long, valid_until long"


def slots(spark, rows):
    return spark.createDataFrame([(e, float(s), a, z) for e, s, a, z in rows], SLOTS)


def updates(spark, rows):
    return spark.createDataFrame([(e, float(s), a, z, i) for i, (e, s, a, z) in enumerate(rows)], overlay.UPDATES)


def edges_of(df):
    return {r.edge_idx: (r.speed_factor, r.valid_from, r.valid_until) for r in df.collect()}


@pytest.mark.parametrize(("tick", "state", "penalty"), [(9, "SCHEDULED", 1.0), (10, "ACTIVE", 4.0), (19, "ACTIVE", 4.0), (20, "EXPIRED", 1.0)])
def test_interval(spark, tick, state, penalty):
    at = (F.lit(0.25).cast("float"), F.lit(10), F.lit(20), F.lit(tick))
    r = spark.range(1).select(overlay.state(*at).alias("s"), overlay.penalty(*at).alias("p")).first()
    assert (r.s, r.p) == (state, penalty)


def test_blocked_and_missing(spark):
    r = spark.range(1).select(overlay.penalty(F.lit(0.0).cast("float"), F.lit(0), F.lit(5), F.lit(1)).alias("b"), overlay.state(F.lit(None).cast("float"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(1)).alias("m")).first()
    assert (r.b, r.m) == (INF, "MISSING")


def test_merge_last_wins_and_rejects_expired(spark):
    now = edges_of(overlay.merge(slots(spark, [(1, 1.0, 0, 99), (2, 0.5, 0, 99)]), updates(spark, [(1, 0.5, 0, 50), (1, 0.25, 0, 60), (2, 0.1, 0, 10), (3, 0.0, 0, 70)]), 10))
    assert now == {1: (0.25, 0, 60), 2: (0.5, 0, 99), 3: (0.0, 0, 70)}


def test_policies(spark):
    cur, new = slots(spark, [(1, 1.0, 0, 5), (2, 1.0, 0, 90)]), updates(spark, [(3, 1.0, 0, 50), (4, 1.0, 0, 95), (2, 0.5, 0, 91)])
    run = lambda cap, policy: set(edges_of(overlay.merge_capped(cur, new, 10, cap, policy)))
    assert run(3, "REJECT_BATCH") == {1, 2} and run(4, "REJECT_BATCH") == {1, 2, 3, 4}
    assert run(2, "EVICT_EXPIRED") == {2, 3}
    assert run(2, "EVICT_OLDEST_EXPIRY") == {2, 4}
    with pytest.raises(ValueError):
        run(2, "OTHER")


def test_checked_reasons(spark):
    bad = overlay.checked(updates(spark, [(-1, 0.5, 0, 9), (1, 1.5, 0, 9), (1, 0.5, 9, 9), (7, 0.5, 0, 9), (1, 0.5, 0, 9)]), edge_count=5).orderBy("ordinal")
    assert [r.reason_code for r in bad.collect()] == ["OVERLAY_EDGE_ID", "OVERLAY_SPEED_FACTOR", "OVERLAY_INTERVAL", "OVERLAY_EDGE_UNKNOWN", None]


def test_empty_overlay(spark):
    empty = slots(spark, [])
    assert overlay.merge(empty, updates(spark, []), 0).count() == 0 and overlay.oldest_expiry(empty).count() == 0 and overlay.snapshot(empty, 0).count() == 0


def test_cost_with_turns(spark):
    m = model(spark, [(0, 1, 10), (1, 2, 10)], turns=[(0, 1, 5)])
    asked = spark.createDataFrame([(1, 0, 0), (1, None, 0), (9, None, 0)], "edge_idx int, from_edge int, tick long")
    got = {(r.edge_idx, r.from_edge): (r.cost, r.reason_code) for r in cost.explain(asked, m).collect()}
    assert got[1, 0] == (15.0, None) and got[1, None] == (10.0, None) and got[9, None][1] == "COST_EDGE_UNKNOWN"
    node = cost.explain(asked, m, opts=CostOptions(turns="NODE_BASED")).filter("from_edge = 0").first()
    assert node.cost == 10.0


def test_forbidden_turn_blocks_in_both(spark):
    m = model(spark, [(0, 1, 10), (1, 2, 10)], turns=[(0, 1, INF)])
    asked = spark.createDataFrame([(1, 0, 0)], "edge_idx int, from_edge int, tick long")
    for kind in ("EDGE_BASED", "NODE_BASED"):
        assert cost.explain(asked, m, opts=CostOptions(turns=kind)).first().cost == INF


def test_cost_agrees_with_walker(spark):
    buckets = [1.0 + (i * 7 % 16) / 16 for i in range(24)]
    edges = [(0, 1, 31.5), (1, 2, 17.25)]
    m = model(spark, edges, profiles=[(1, 127, buckets)])
    over = [(0, 0.3, 1000, 90000)]
    w = Walker(edges, over, buckets={1: buckets})
    ticks = list(range(0, 200_000, 3_333))
    rows = cost.explain(spark.createDataFrame([(e, None, t) for e in (0, 1) for t in ticks], "edge_idx int, from_edge int, tick long"), m, slots(spark, over)).collect()
    assert len(rows) == 2 * len(ticks)
    for r in rows:
        assert r.cost == w.drive([r.edge_idx], r.tick)[0]


def test_fifo_breach_and_wrap(spark):
    good, bad = [1.0] * 24, [1.0] * 10 + [4.0] + [1.0] * 13
    m = model(spark, [(0, 1, 100, 1), (0, 1, 3000, 2), (0, 1, 100, 2), (0, 1, 5, 9)], profiles=[(1, 127, good), (2, 127, bad)])
    assert {(r.edge_idx, r.position) for r in cost.fifo_breaches(m).collect()} == {(1, 10)}
    last = Model(m.nodes, m.edges, spark.createDataFrame([(2, 64, [4.0] * 24)], "profile_id int, day_mask int, buckets array<float>"), m.turns)
    assert {(r.edge_idx, r.position) for r in cost.fifo_breaches(last, weekly=True).collect()} == {(1, 167)}
