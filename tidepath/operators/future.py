"""Routes and matrices under weighted scenarios: per-scenario search, aggregate objectives, scores, alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.model import Model
from ..staging import stage
from . import cost as costs
from . import heuristics
from . import overlay as live
from .cost import CostOptions
from .search import FAR, _advance, matrix, replay, routes

# Tolerances and thresholds.
P_TOLERANCE, COST_TOLERANCE = 1e-6, 1e-6
OVERLAP, COST_DELTA = 0.85, 1.0
INF = float("inf")


def _running(samples: DataFrame, by: list[str], value: str, weight: str = "probability") -> DataFrame:
    """samples with _cum, the weight of a group's samples up to each in order of value, and _all, the weight of its group."""
    order = Window.partitionBy(*by).orderBy(value, "scenario_id")
    return samples.withColumn("_cum", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(weight).over(Window.partitionBy(*by)))


def _percentile(q: float, value: str) -> Column:
    """Aggregate of rows of _running: the first value whose cumulative weight + 1e-6 reaches the quantile of the total."""
    return F.min(F.when(F.col("_cum") + P_TOLERANCE >= q * F.col("_all"), F.col(value)))


def percentiles(samples: DataFrame, by: list[str], value: str, quantiles: dict[str, float], weight: str = "probability") -> DataFrame:
    """Weighted percentiles per group."""
    return _running(samples, by, value, weight).groupBy(*by).agg(*[_percentile(q, value).alias(name) for name, q in quantiles.items()])


def expected(cost: Column, probability: Column) -> Column:
    """Aggregate: sum of probability times cost, infinite if any cost of positive probability is."""
    return F.when(F.max(F.when(probability > 0, cost.cast("double"))) == INF, F.lit(INF)).otherwise(F.sum(F.when(probability > 0, probability * cost.cast("double")).otherwise(0.0)))


def matrix_cells(results: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Per cell over scenarios: reach_probability, expected, p50, p90, least and most cost, first and last arrival (the last long and infinity where some scenario does not reach), reason_code. A cell that some scenario could not answer has a reason and nulls."""
    by = ["request_id", "source_pos", "target_pos", "source", "target"]
    rows = results.join(scenarios.select("request_id", "scenario_id", "probability"), ["request_id", "scenario_id"])
    p, c = F.col("probability"), F.col("cost")
    arrival = F.when(F.col("reachable"), F.col("arrival")).otherwise(F.lit(FAR))
    whole = lambda x, name: F.when(F.max("reason_code").isNull(), x).alias(name)
    return _running(rows, by, "cost").groupBy(*by).agg(
        F.max("reason_code").alias("reason_code"), whole(F.sum(F.when(F.col("reachable"), p).otherwise(0.0)), "reach_probability"), whole(expected(c, p), "expected_cost"), whole(F.min("cost"), "min_cost"), whole(F.max("cost"), "max_cost"),
        whole(F.min(arrival), "min_arrival"), whole(F.max(arrival), "max_arrival"), whole(_percentile(0.5, "cost"), "p50_cost"), whole(_percentile(0.9, "cost"), "p90_cost"),
    )


def future_matrix(cells: DataFrame, model: Model, scenarios: DataFrame, overlay: DataFrame | None, opts: CostOptions = CostOptions()) -> DataFrame:
    """matrix_cells of one search per scenario; scenarios: request_id, scenario_id, probability; overlay: scenario_id and entries."""
    rows = cells.join(scenarios.select("request_id", "scenario_id"), "request_id")
    return matrix_cells(matrix(rows, model, overlay, opts), scenarios)


def score(candidates: DataFrame, optima: DataFrame, scenarios: DataFrame, model: Model, overlay: DataFrame | None, opts: CostOptions) -> DataFrame:
    """One row per candidate (request_id, signature, edge_path, departure): its costs over all scenarios.

    expected_cost, p50_cost, p90_cost, min_cost, max_cost, min_arrival, max_arrival, eta_low and eta_high (10th
    and 90th percentile of arrival), optimality_probability, expected_regret (to each scenario's optimum),
    dominant_scenario_id and its probability (the likeliest it is optimal in, else the likeliest, then least regret).
    """
    runs = candidates.join(scenarios.select("request_id", "scenario_id", "probability"), "request_id").withColumn("path_id", F.concat_ws("#", "request_id", "signature"))
    runs = stage(runs, "runs")
    driven = replay(runs.select("path_id", "scenario_id", "edge_path", "departure"), model, overlay, opts)
    best = optima.select("request_id", "scenario_id", F.col("cost").alias("best_cost"), F.concat(F.lit("E:"), F.array_join(F.transform("edge_path", lambda e: e.cast("string")), ",")).alias("best_signature"), F.col("reachable").alias("best_reachable"))
    rows = runs.join(driven, ["path_id", "scenario_id"]).join(best, ["request_id", "scenario_id"])
    regret = F.when(~F.col("feasible"), F.lit(INF)).when(~F.col("best_reachable"), F.col("cost").cast("double")).otherwise(F.greatest(F.lit(0.0), F.col("cost").cast("double") - F.col("best_cost").cast("double")))
    rows = stage(rows.withColumn("regret", regret).withColumn("optimal", F.col("signature") == F.col("best_signature")), "scored")
    by = ["request_id", "signature"]
    p = F.col("probability")
    dominant = F.max(F.struct(F.col("optimal"), p, F.when(F.col("optimal"), F.lit(0.0)).otherwise(-F.col("regret")).alias("r"), "scenario_id"))
    one = rows.groupBy(*by).agg(
        F.first("edge_path").alias("edge_path"), expected(F.col("cost"), p).alias("expected_cost"), F.min("cost").alias("min_cost"), F.max("cost").alias("max_cost"), F.min("arrival").alias("min_arrival"), F.max("arrival").alias("max_arrival"),
        F.sum(F.when(F.col("optimal"), p).otherwise(0.0)).alias("optimality_probability"), expected(F.col("regret"), p).alias("expected_regret"), dominant.alias("d"),
    )
    one = one.join(percentiles(rows, by, "cost", {"p50_cost": 0.5, "p90_cost": 0.9}), by).join(percentiles(rows, by, "arrival", {"eta_low": 0.1, "eta_high": 0.9}), by)
    return one.withColumn("dominant_scenario_id", F.col("d.scenario_id")).withColumn("dominant_probability", F.col("d.probability")).drop("d")


def _objective(kind: str, vector: Column) -> Column:
    """EXPECTED or P90 of an array of structs (p, cost)."""
    live_ones = F.filter(vector, lambda s: s["p"] > 0)
    if kind == "EXPECTED":
        return F.when(F.exists(live_ones, lambda s: s["cost"] == INF), F.lit(INF)).otherwise(F.aggregate(live_ones, F.lit(0.0), lambda a, s: a + s["p"] * s["cost"].cast("double")))
    total = F.aggregate(vector, F.lit(0.0), lambda a, s: a + s["p"])
    ordered = F.array_sort(F.transform(vector, lambda s: F.struct(s["cost"].cast("double").alias("cost"), s["p"].alias("p"))))
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("v"))
    step = lambda a, s: F.struct((a["cum"] + s["p"]).alias("cum"), F.coalesce(a["v"], F.when(a["cum"] + s["p"] + P_TOLERANCE >= 0.9 * total, s["cost"])).alias("v"))
    return F.aggregate(ordered, start, step, lambda a: a["v"])


def aggregate_routes(requests: DataFrame, model: Model, scenarios: DataFrame, overlay: DataFrame | None, kind: str, opts: CostOptions = CostOptions(), known: DataFrame | None = None) -> DataFrame:
    """request_id, edge_path, objective, max_arrival of the route with the best EXPECTED cost or P90 cost over scenarios.

    Labels carry a cost and an arrival for every scenario and advance together, a row per label. A label goes if
    another of the same edge is no worse in all of them and better in one, or if its objective, with the least
    cost that is left to the target added, is above the best one of its request; known (request_id, bound) gives
    objectives that some route is known to reach. Ties (within 1e-6): earlier greatest arrival, smaller last edge, smaller path.
    A request without a scenario that reaches its target gives no row.
    """
    s = scenarios.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("scenario_id", F.col("probability").alias("p")))).alias("scenarios"))
    asked = stage(requests.filter("source <> target").join(s, "request_id"), "asked")
    entries = None
    if overlay is not None:
        entries = overlay.groupBy("edge_idx").agg(F.map_from_entries(F.collect_list(F.struct("scenario_id", F.struct("speed_factor", "valid_from", "valid_until")))).alias("entries"))
    edges = model.edges.select("edge_idx", "origin", "dest", "base_weight", "profile_id").join(model.profiles, "profile_id", "left")
    edges = edges.withColumn("entries", F.lit(None).cast("map<string,struct<speed_factor:float,valid_from:bigint,valid_until:bigint>>")) if entries is None else edges.join(entries, "edge_idx", "left")
    edges = stage(edges, "edges")
    # no route from a node to a target costs less than this in any scenario
    left = heuristics.distances(asked.select(F.col("target").alias("landmark")).distinct(), heuristics.bound_weights(model), backward=True).select(F.col("source").alias("target"), "node", F.col("distance").alias("ahead"))
    left = stage(left, "ahead")
    sample = lambda x, cost, arrival: F.struct(x["scenario_id"].alias("scenario_id"), x["p"].alias("p"), cost.alias("cost"), arrival.alias("arrival"))
    front = asked.select("request_id", "target", F.lit(0).alias("round"), F.col("source").alias("node"), F.lit(None).cast("int").alias("from_edge"), F.transform("scenarios", lambda x: sample(x, F.lit(0.0).cast("float"), F.col("departure"))).alias("v"), F.array().cast("array<int>").alias("path"))
    seen = reached = None
    while True:
        rows = front.join(edges.withColumnRenamed("origin", "node"), "node").join(model.turns.select("from_edge", F.col("to_edge").alias("edge_idx"), "penalty"), ["from_edge", "edge_idx"], "left")
        turn = costs.turn_cost(F.col("penalty"), F.col("from_edge").isNotNull(), opts)

        def extend(x: Column) -> Column:
            e = F.element_at("entries", x["scenario_id"])
            mult = costs.multiplier(x["arrival"], model.meta, opts)
            pen = live.penalty(e["speed_factor"], e["valid_from"], e["valid_until"], x["arrival"])
            c = costs.with_turn(costs.travel_cost(F.col("base_weight"), mult, pen), turn)
            dead = (x["cost"] == INF) | (c == INF)
            return sample(x, F.when(dead, F.lit(INF)).otherwise(x["cost"].cast("double") + c.cast("double")).cast("float"), F.when(dead, F.lit(FAR)).otherwise(_advance(x["arrival"], c)))

        fresh = rows.select("request_id", "target", "edge_idx", F.col("dest").alias("node"), F.transform("v", extend).alias("v"), F.concat("path", F.array("edge_idx")).alias("path"), (F.col("round") + 1).alias("round"))
        fresh = fresh.filter(F.exists("v", lambda x: x["cost"] < INF)).withColumn("objective", _objective(kind, F.col("v")))
        fresh = fresh.join(left, ["target", "node"])
        bound = known
        if reached is not None:
            own = reached.select("request_id", F.col("objective").alias("bound"))
            bound = own if known is None else own.unionByName(known.select("request_id", "bound"))
        if bound is not None:
            least = bound.groupBy("request_id").agg(F.min("bound").alias("bound"))
            # sums of floats along a route may round below the bound in doubles, by less than a millionth
            fresh = fresh.join(least, "request_id", "left").filter(F.col("bound").isNull() | (F.col("objective") + F.col("ahead") * (1 - 1e-6) <= F.col("bound") + COST_TOLERANCE)).drop("bound")
        fresh = fresh.drop("ahead")
        fresh = stage(fresh, "vectors")
        every = fresh if seen is None else seen.unionByName(fresh)
        # only new vectors are judged: an old one that a new one beats has gone on already
        other = every.select("request_id", "edge_idx", F.col("v").alias("w"), F.col("path").alias("other_path"))
        no_worse = F.forall(F.zip_with("v", "w", lambda a, b: (b["cost"] <= a["cost"]) & (b["arrival"] <= a["arrival"])), lambda t: t)
        better = F.exists(F.zip_with("v", "w", lambda a, b: (b["cost"] < a["cost"]) | (b["arrival"] < a["arrival"])), lambda t: t)
        kept = stage(fresh.alias("a").join(other.alias("b"), (F.col("a.request_id") == F.col("b.request_id")) & (F.col("a.edge_idx") == F.col("b.edge_idx")) & no_worse & better, "left_anti"), "vectors")
        seen = kept if seen is None else seen.unionByName(kept)
        new = kept.filter(F.size(F.array_distinct("path")) == F.size("path"))
        hits = new.filter("node = target")
        reached = stage(hits if reached is None else reached.unionByName(hits), "goals")
        if new.isEmpty():
            break
        front = new.filter("node <> target").select("request_id", "target", "round", "node", F.col("edge_idx").alias("from_edge"), "v", "path")
    top = reached.withColumn("max_arrival", F.array_max(F.transform("v", lambda x: x["arrival"]))).withColumn("last", F.element_at("path", -1))
    floor = top.join(top.groupBy("request_id").agg(F.min("objective").alias("least")), "request_id").filter((F.col("objective") <= F.col("least") + COST_TOLERANCE) | (F.col("objective") == F.col("least")))
    w = Window.partitionBy("request_id").orderBy("max_arrival", "last", "path")
    return floor.withColumn("n", F.row_number().over(w)).filter("n = 1").select("request_id", F.col("path").alias("edge_path"), "objective", "max_arrival")


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two edge paths; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def alternatives(scored: DataFrame, seeds: DataFrame, top_k: int) -> DataFrame:
    """request_id, place, signature of up to top_k candidates that differ: seeds (request_id, signature, seed_rank) first, then by optimality, regret, cost, P90 cost.

    A candidate is left out if it overlaps 85% with a chosen one at an expected cost within 1. The choice folds
    over a request's ordered candidates, which are at most its scenarios and two more.
    """
    ranked = scored.join(seeds, ["request_id", "signature"], "left").withColumn("seed_rank", F.coalesce("seed_rank", F.lit(1 << 30)))
    item = F.struct("seed_rank", (-F.col("optimality_probability")).alias("a"), F.col("expected_regret").alias("b"), F.col("expected_cost").alias("c"), F.col("p90_cost").alias("d"), "signature", "edge_path")
    lists = ranked.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    like = lambda x, y: (overlap(x["edge_path"], y["edge_path"]) >= OVERLAP) & (F.abs(x["c"] - y["c"]) <= COST_DELTA)
    empty = F.slice("items", 1, 0)
    chosen = F.aggregate("items", empty, lambda acc, x: F.when((F.size(acc) < top_k) & ~F.exists(acc, lambda y: F.coalesce(like(x, y), F.lit(False))), F.concat(acc, F.array(x))).otherwise(acc))
    return lists.select("request_id", F.posexplode(chosen).alias("place", "i")).select("request_id", "place", "i.signature")


def density(n_optimal: Column, n_unique: Column, n_candidates: Column) -> Column:
    """LOW_DENSITY or HIGH_DENSITY of a candidate set."""
    coverage = F.when(n_optimal <= 0, F.lit(0.0)).otherwise(n_unique / n_optimal)
    return F.when(n_candidates <= 1, "LOW_DENSITY").when((n_candidates > n_unique) | (coverage >= 0.75), "HIGH_DENSITY").otherwise("LOW_DENSITY")


def future_routes(requests: DataFrame, model: Model, scenarios: DataFrame, overlay: DataFrame | None, opts: CostOptions = CostOptions(), top_k: int = 3) -> dict[str, DataFrame]:
    """The products of requests (request_id, source, target, departure) under scenarios: `optima` of each scenario, scored `candidates`, the `expected` and `robust` winners, `alternatives`, and a `density` report."""
    runs = requests.join(scenarios.select("request_id", "scenario_id"), "request_id")
    optima = stage(routes(runs, model, overlay, opts), "optima")
    sign = F.concat(F.lit("E:"), F.array_join(F.transform("edge_path", lambda e: e.cast("string")), ","))
    found = optima.filter("reachable").select("request_id", "edge_path", sign.alias("signature"))
    departures = requests.select("request_id", "departure")
    first = stage(score(found.dropDuplicates(["request_id", "signature"]).join(departures, "request_id"), optima, scenarios, model, overlay, opts), "first")
    known = {kind: first.groupBy("request_id").agg(F.min(F.col(c).cast("double")).alias("bound")) for kind, c in (("EXPECTED", "expected_cost"), ("P90", "p90_cost"))}
    winners = {kind: stage(aggregate_routes(requests, model, scenarios, overlay, kind, opts, known[kind]).withColumn("signature", sign), kind.lower()) for kind in ("EXPECTED", "P90")}
    added = winners["EXPECTED"].select("request_id", "edge_path", "signature").unionByName(winners["P90"].select("request_id", "edge_path", "signature"))
    new = added.dropDuplicates(["request_id", "signature"]).join(found.select("request_id", "signature"), ["request_id", "signature"], "left_anti")
    scored = stage(first.unionByName(score(new.join(departures, "request_id"), optima, scenarios, model, overlay, opts)), "candidates")
    pick = lambda kind: scored.join(winners[kind].select("request_id", "signature"), ["request_id", "signature"])
    seeds = winners["EXPECTED"].select("request_id", "signature", F.lit(0).alias("seed_rank")).unionByName(winners["P90"].select("request_id", "signature", F.lit(1).alias("seed_rank"))).groupBy("request_id", "signature").agg(F.min("seed_rank").alias("seed_rank"))
    counts = found.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_optimal"), F.countDistinct("signature").alias("n_unique")).join(scored.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_candidates")), "request_id")
    report = counts.withColumn("density_class", density(F.col("n_optimal"), F.col("n_unique"), F.col("n_candidates")))
    return {"optima": optima, "candidates": scored, "expected": pick("EXPECTED"), "robust": pick("P90"), "alternatives": alternatives(scored, seeds, top_k), "density": report}
