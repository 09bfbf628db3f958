import random

import pytest
from helpers import grid, model
from pyspark.sql import functions as F

from tidepath.operators import address, graph, results, topology
from tidepath.operators.heuristics import Guide
from tidepath.operators.topology import ChangeSet, Publisher
from tidepath.plans import config
from tidepath.plans.engine import Engine, Hooks
from tidepath.sources import model as models
from tidepath.sources.model import Metadata, Model, ModelError


def test_csr_and_incidence(spark):
    m = model(spark, [(0, 1, 1), (1, 1, 1), (2, 0, 1)], n=4)
    off = models.csr_offsets(m.nodes, m.edges)
    assert [(r.first_edge, r.next_edge) for r in off.orderBy("node_idx").collect()] == [(0, 1), (1, 2), (2, 3), (3, 3)]
    assert {(r.edge_idx, r.origin) for r in models.origins_from_offsets(off).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert graph.incident_edges(m.edges).filter("edge_idx = 1").count() == 1
    assert {r.node_idx: r.terminal for r in graph.degrees(m.nodes, m.edges).collect()}[3]


def test_diagnostics(spark):
    bad = model(spark, [(0, 1, -1), (1, 9, 1, 5)], n=3, profiles=[(0, 127, [2.0]), (1, 0, []), (1, 3, [1.0])], xy=[(float("nan"), 0), (0, 0), (0, 0)])
    codes = {(r.level, r.code) for r in models.diagnose(bad).collect()}
    assert {("error", c) for c in ("DUPLICATE_PROFILE_ID", "UNKNOWN_NODE", "BASE_WEIGHT", "UNKNOWN_PROFILE", "DAY_MASK", "BUCKETS", "PROFILE_ZERO_NOT_NEUTRAL", "NAN_COORDINATES")} <= codes
    assert ("warning", "ISOLATED_NODE") in codes
    assert models.diagnose(model(spark, grid(3, 3))).count() == 0


def test_metadata(spark):
    Metadata(zone="Europe/Berlin").check()
    for bad in (Metadata(schema_version=2), Metadata(tick_ns=5), Metadata(zone=" "), Metadata(zone="Nowhere/Land")):
        with pytest.raises(ModelError):
            bad.check()


def test_calibration_rows(spark):
    rows = spark.createDataFrame([(1, 0.5, 3, "ROUTINE_PERIODIC"), (2, None, None, None), (3, 0.5, None, None), (4, 2.0, 3, "ROUTINE_PERIODIC"), (5, 0.5, 0, "ROUTINE_PERIODIC"), (6, 0.5, 1, "NONE")], "profile_id int, confidence float, observation_count int, flavor string")
    assert {r.profile_id for r in models.check_calibration(rows).collect()} == {3, 4, 5, 6}


def test_last_turn_and_scaled_profile(spark):
    turns = spark.createDataFrame([(0, 1, 5.0, 0), (0, 1, 7.0, 1)], "from_edge int, to_edge int, penalty float, ordinal int")
    assert models.last_turns(turns).first().penalty == 7.0
    raw = spark.createDataFrame([(1, 127, [1.0, 2.0], 1.5)], "profile_id int, day_mask int, buckets array<float>, multiplier float")
    assert list(models.scaled_profiles(raw).first().buckets) == [1.5, 3.0]


def test_nearest_and_snap(spark):
    rng = random.Random(2)
    nodes = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(150)] + [(1.0, 1.0), (1.0, 1.0)]
    m = model(spark, [(0, 1, 1)], n=len(nodes), xy=nodes)
    points = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(200)] + [(900, 1.0, 1.0), (901, 4000.0, -3000.0)]
    got = {r.point_id: r.node_idx for r in address.nearest(spark.createDataFrame(points, "point_id int, x double, y double"), m.nodes).collect()}
    for i, x, y in points:
        assert got[i] == min(range(len(nodes)), key=lambda k: ((nodes[k][0] - x) ** 2 + (nodes[k][1] - y) ** 2, k))
    asked = spark.createDataFrame([(1, 1.0, 1.0, None), (2, 900.0, 0.0, 10.0), (3, float("nan"), 0.0, None), (4, 0.0, 0.0, -1.0)], "point_id int, x double, y double, max_snap double")
    snapped = {r.point_id: (r.node_idx, r.reason_code) for r in address.snap(asked, m.nodes, "XY").collect()}
    assert snapped[1] == (150, None) and snapped[2][1] == "ADDRESS_SNAP_EXCEEDED" and snapped[3][1] == "ADDRESS_COORDINATES_INVALID" and snapped[4][1] == "ADDRESS_SNAP_RANGE"


def test_endpoint_dedup(spark):
    ends = spark.createDataFrame([("ID", " a", None, None, "XY"), ("ID", "a", None, None, "XY"), ("XY", None, 0.0, 1.0, "XY"), ("XY", None, -0.0, 1.0, "XY")], "kind string, id string, x double, y double, strategy string")
    assert address.distinct_endpoints(ends).count() == 2


def _engine(spark):
    return model(spark, grid(4, 3), turns=[(0, 3, 5)])


def test_changes_and_compile(spark):
    m = _engine(spark)
    gone = spark.createDataFrame([("N5",)], "node_id string")
    nodes, edges, turns = topology.apply_changes(*topology.external(m), ChangeSet(remove_nodes=gone))
    assert nodes.count() == 11 and edges.filter("origin_id = 'N5' or dest_id = 'N5'").count() == 0
    new = topology.compile_model(nodes, edges, m.profiles, turns, m.meta)
    ids = [r.edge_idx for r in new.edges.orderBy("edge_idx").collect()]
    assert ids == list(range(len(ids))) and models.diagnose(new).filter("level = 'error'").count() == 0
    kept = topology.carry_over(spark.createDataFrame([(0, 1.0)], "edge_idx int, x double"), "edge_idx", m.edges, new.edges, "edge_id", "edge_idx")
    assert kept.join(new.edges, "edge_idx").first().edge_id == "E0"
    clash = topology.check_changes(ChangeSet(remove_nodes=gone, add_nodes=spark.createDataFrame([("N5", 0.0, 0.0), ("X", 0.0, 0.0), ("X", 0.0, 0.0)], "node_id string, x double, y double")))
    assert {(r.reason_code, r.subject) for r in clash.collect()} == {("CHANGE_CONFLICT", "N5"), ("CHANGE_DUPLICATE", "X")}


def test_publication(spark, tmp_path):
    m = _engine(spark)
    pub = Publisher(spark, f"file://{tmp_path}/topology")
    with pytest.raises(ModelError, match="NONE"):
        pub.current()
    v1 = pub.publish(m)
    assert pub.current().meta.model_version == v1 and pub.current().edges.count() == m.edges.count()
    heavier = Model(m.nodes, m.edges.withColumn("base_weight", F.col("base_weight") * 2), m.profiles, m.turns, Metadata())
    checked = pub.publish(heavier, policy="VALIDATE_ONLY")
    assert checked != v1 and pub.current().meta.model_version == v1
    assert pub.publish(heavier) == checked == pub.current().meta.model_version
    with pytest.raises(ModelError, match="refused"):
        Publisher(spark, pub.root, [lambda _: "refused"]).publish(m)
    known = spark.createDataFrame([(1, 0.9, 3, "ROUTINE_PERIODIC", 5)], models.CALIBRATION)
    calibrated = Model(m.nodes, m.edges, m.profiles, m.turns, Metadata(), known)
    assert pub.publish(calibrated) != v1 and pub.current().calibration.first().confidence == pytest.approx(0.9)
    broken = Model(m.nodes, m.edges.withColumn("dest", F.lit(99)), m.profiles, m.turns, Metadata())
    with pytest.raises(ModelError, match="UNKNOWN_NODE"):
        pub.publish(broken)
    assert topology.granularity_ok(3600, 1, 1800) and not topology.granularity_ok(3600, 1, 1799)


def test_quarantine(spark):
    m = model(spark, [(0, 1, 1), (1, 2, 1), (2, 2, 1)])
    q = topology.last_failures(spark.createDataFrame([("node", 2, 50, 1, "flood", "a"), ("edge", 0, 10, 1, "old", "a"), ("edge", 1, 90, 2, "crash", "b"), ("edge", 7, 90, 2, "crash", "b")], topology.QUARANTINE))
    assert {r.edge_idx: r.valid_until for r in topology.failed_edges(q, m.edges, 20).collect()} == {1: 90, 2: 50}
    assert {r.edge_idx: r.valid_until for r in topology.failure_updates(q, m.edges, 20, F.lit(60)).collect()} == {1: 60, 2: 50}
    assert topology.clear_failures(q).count() == 0 and topology.clear_failures(q).columns == q.columns
    one = topology.failure_summary(q, 20).first()
    assert one.n_active == 3 and list(one.tags) == ["a", "b", "crash", "flood"] and one.observed_at == 2


def test_results(spark):
    rows = spark.createDataFrame([("a", "v1", 0, 100, 5, 10, "x"), ("b", "v1", 0, 100, 9, 10, "x"), ("c", "v2", 0, 50, 99, 10, "x"), ("d", "v1", 0, 5, 99, 10, "x")], results.RESULTS)
    ids = lambda df: {r.result_id for r in df.collect()}
    assert ids(results.purge(rows, 10)) == {"a", "b", "c"}
    assert ids(results.within_budget(rows, 20)) == {"a", "b"} and ids(results.within_budget(rows, 19)) == {"b"}
    new = spark.createDataFrame([("a", "v2", 10, 300, 10, 5, "y"), (" ", "v2", 10, 300, 10, 5, "y")], results.RESULTS)
    assert ids(results.put(rows, new, 10, 25)) == {"a", "b", "c"}
    assert results.get(rows, spark.createDataFrame([("d",), ("a",)], "result_id string"), 10).first().result_id == "a"
    assert ids(results.after_reload(rows, "v1", "INVALIDATE_STALE")) == {"a", "b", "d"}
    assert results.touch(rows, spark.createDataFrame([("a",)], "result_id string"), 77).filter("result_id = 'a'").first().last_read == 77
    packed = results.as_result(spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), "k", F.lit("v1"), 5, 10).first()
    assert packed.expires_at == 15 and packed.bytes == len(packed.payload)


def test_config(spark):
    meta = Metadata(zone="Europe/Berlin")
    a, b = config.bind(meta), config.bind(meta, bundle="GEODETIC_CALENDAR", zone_policy="MODEL")
    assert a.bundle_hash != b.bundle_hash and b.zone == "Europe/Berlin" and b.cost_options().calendar
    for bad in ({"bundle": "X"}, {"bundle": "DEFAULT", "temporal": "LINEAR"}, {"temporal": "CALENDAR"}, {"zone_policy": "MODEL"}, {"algorithm": None}, {"heuristic": "LANDMARK"}, {"transition": "OTHER"}, {"temporal": "CALENDAR", "zone_policy": "No/Where"}):
        with pytest.raises(ModelError):
            config.bind(meta, **bad)
    probe = config.probe_transition(spark)
    config.bind(meta, transition="NODE_BASED", probe=probe)
    catalog = config.Catalog()
    catalog.transition["FREE"] = config.TransitionStrategy(lambda p, has: F.lit(0.0), True)
    with pytest.raises(ModelError, match="PROBE"):
        config.bind(meta, catalog, transition="FREE", probe=probe)
    rows = spark.createDataFrame([(1, 5, 3, 9), (2, 0, 3, 9), (3, 5, 0, 9), (4, 5, 3, None)], "request_id int, horizon long, top_k int, ttl long")
    assert {r.request_id for r in config.check_future_requests(rows).collect()} == {2, 3, 4}


def test_engine_end_to_end(spark):
    e = Engine(_engine(spark))
    asked = spark.createDataFrame([(1, "N0", "N11", 0), (2, "N0", "nope", 0), (3, None, "N1", 0)], "request_id int, source_id string, target_id string, departure long")
    got = {r.request_id: (r.cost, r.reason_code) for r in e.routes(asked).collect()}
    assert got == {1: (5.0, None), 2: (None, "ADDRESS_TARGET_UNKNOWN"), 3: (None, "ADDRESS_SOURCE_REQUIRED")}
    block = spark.createDataFrame([(i, 0.0, 0, 10**6, i) for i in range(40)], "edge_idx int, speed_factor float, valid_from long, valid_until long, ordinal long")
    assert not e.apply(block, 0).routes(asked).filter("request_id = 1").first().reachable
    cells = e.matrix(spark.createDataFrame([(1, ["N0", "N3"], ["N3", "N3"], 0)], "request_id int, source_ids array<string>, target_ids array<string>, departure long"))
    assert {(r.source_pos, r.target_pos): r.cost for r in cells.collect()} == {(0, 0): 3.0, (0, 1): 3.0, (1, 0): 0.0, (1, 1): 0.0}


END = "struct<id:string,x:double,y:double,strategy:string>"


def test_engine_by_coordinates(spark):
    m = model(spark, grid(4, 3), xy=[(10.0 * (i % 4), 10.0 * (i // 4)) for i in range(12)])
    e = Engine(m)
    point = lambda x, y, hint=None: (None, x, y, hint)
    name = lambda i: (i, None, None, None)
    rows = [(1, point(1.0, 1.0), point(29.0, 19.0), None), (2, name("N0"), name("N11"), None), (3, name("N0"), point(29.0, 19.0), None), (4, point(1.0, 1.0, "LAT_LON"), point(2.0, 2.0), None), (5, point(4.0, 4.0), point(29.0, 19.0), 2.0), (6, ("N0", 1.0, 1.0, None), name("N1"), None), (7, name(None), name("N1"), None), (8, name("N0"), name("gone"), None), (9, point(float("nan"), 0.0), point(1.0, 1.0), None)]
    asked = spark.createDataFrame([(*r, 0) for r in rows], f"request_id int, source_end {END}, target_end {END}, max_snap double, departure long")
    got = {r.request_id: (r.cost, r.reason_code) for r in e.routes(asked).collect()}
    assert got[1] == got[2] == (5.0, None)
    assert {k: v[1] for k, v in got.items() if k > 2} == {3: "ADDRESS_MIXED", 4: "ADDRESS_STRATEGY", 5: "ADDRESS_SNAP_EXCEEDED", 6: "ADDRESS_MIXED", 7: "ADDRESS_SOURCE_REQUIRED", 8: "ADDRESS_TARGET_UNKNOWN", 9: "ADDRESS_COORDINATES_INVALID"}
    assert Engine(m, mixed=True).route_requests(asked.filter("request_id = 3")).first().reason_code is None
    cells = spark.createDataFrame([(1, [point(1.0, 1.0), name("N3")], [point(29.0, 19.0)], None, 0)], f"request_id int, source_ends array<{END}>, target_ends array<{END}>, max_snap double, departure long")
    assert {(r.source_pos, r.cost, r.reason_code) for r in e.matrix(cells).collect()} == {(0, 5.0, None), (1, None, "ADDRESS_MIXED")}


def test_engine_strategies_and_execution(spark):
    m = model(spark, [(0, 1, 4), (1, 2, 4), (0, 2, 10)], turns=[(0, 1, 5)], profiles=[(1, 127, [1.0] * 8 + [2.0] + [1.0] * 15)], xy=[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)])
    catalog = config.Catalog()
    catalog.transition["FREE"] = config.TransitionStrategy(lambda p, has: F.when(p == float("inf"), p).otherwise(F.lit(0.0)), True)
    catalog.temporal["EIGHT"] = config.TemporalStrategy(lambda sec, zone: F.lit(8 * 3600), False)
    catalog.coordinates["WIDE"] = config.CoordinateStrategy(lambda a, b, c, d: F.abs(a - c) / 100, lambda x, y: x >= 0, 1.0)
    catalog.heuristics["ZERO"] = lambda model, landmarks: Guide(model.nodes.select("node_idx", F.lit(0).alias("info")), lambda a, b: F.lit(0.0))
    asked = spark.createDataFrame([(1, "N0", "N2", 0)], "request_id int, source_id string, target_id string, departure long")
    cost = lambda **kw: Engine(m, config.bind(m.meta, catalog, **kw)).routes(asked).first().cost
    assert (cost(), cost(transition="FREE")) == (10.0, 8.0)
    # at eight all costs double, and a little less eight seconds later
    assert cost(transition="FREE", temporal="EIGHT", algorithm="A_STAR", heuristic="ZERO") == pytest.approx(16.0, abs=0.05)
    wide = Engine(m, config.bind(m.meta, catalog, addressing="WIDE"))
    far = spark.createDataFrame([(1, (None, 90.0, 0.0, None), (None, -1.0, 0.0, None), 0)], f"request_id int, source_end {END}, target_end {END}, departure long")
    assert wide.route_requests(far).first().reason_code == "ADDRESS_COORDINATES_INVALID"
    fast = Engine(m, config.bind(m.meta, catalog)).with_execution("BIDIRECTIONAL", "EUCLIDEAN")
    assert fast.routes(asked).first().cost == 10.0 and fast.bound.algorithm == "BIDIRECTIONAL"
    with pytest.raises(ModelError):
        fast.with_execution("DIJKSTRA", "EUCLIDEAN")
    hooked = Engine(m, hooks=Hooks(plan_routes=lambda requests, *_, **how: requests.withColumn("how", F.lit(",".join(sorted(how))))))
    assert hooked.routes(asked).first().how == "backward,budget,guide"
    kept = Engine(m).keep(spark.createDataFrame([(1, 2)], "k int, v int"), "k", 5, 10, 1000)
    ids = spark.createDataFrame([("1",), ("2",)], "result_id string")
    assert kept.kept_results(ids, 6).count() == 1 and kept.kept_results(ids, 15).count() == 0 and Engine(m).kept_results(ids, 6).count() == 0
