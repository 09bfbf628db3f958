"""Route and matrix search as a relaxation over tables.

All requests (and scenarios) advance together. A label is a way to be at the end of an edge: its cost and its
arrival, which are two criteria, as costs are fractional and arrivals are rounded up. Each round joins the
frontier with the edges that leave its ends, prices them at the label's own arrival, drops labels that cannot
lead to a better answer than the request has, by what they cost and a lower bound of what is left, or that
another label of the same edge beats in both criteria, and goes on with the new ones. A round appends its new
labels to a table in the shared folder; of earlier ones it reads keys and criteria, never paths. A search ends
when no label is new.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.model import Model, ModelError
from ..staging import drop_stage, stage, stage_path
from . import cost as costs
from . import heuristics
from .cost import CostOptions
from .heuristics import Guide

FAR = 2**63 - 1
KEYS = ["request_id", "scenario_id"]
#: Costs are sums of floats: a bound in doubles is taken a little lower, so that rounding prunes no answer.
SLACK = 1e-5
#: A guided round takes the labels whose cost and bound are within this share of its request's least.
WIDTH = 0.1


@dataclass(frozen=True)
class Budget:
    """Bounds on rounds, labels and frontier rows of each request (for a matrix: each source of it); None is unbounded.

    A request that passes one stops with that reason code and no answer; the others of the batch go on.
    """

    rounds: int | None = None
    labels: int | None = None
    frontier: int | None = None


@dataclass
class Found:
    """What a search leaves: labels at goals, requests that passed a budget (request_id, scenario_id, reason_code), and labels and rounds per request."""

    reached: DataFrame
    failed: DataFrame
    effort: DataFrame


def _advance(arrival: Column, cost: Column) -> Column:
    """Arrival after a cost: rounded up, unchanged for no cost, and the last long where it would pass it."""
    step = F.ceil(cost.cast("double")).cast("long")
    return F.when(cost <= 0, arrival).when(cost.cast("double") >= float(FAR), F.lit(FAR)).when(arrival > F.lit(FAR) - step, F.lit(FAR)).otherwise(arrival + step)


def undominated(labels: DataFrame) -> DataFrame:
    """Labels that no other of the same request, scenario and edge beats in cost and arrival; of equals the earliest round, then the smallest path."""
    w = Window.partitionBy(*KEYS, "edge_idx").orderBy("cost", "arrival", "round", "path").rowsBetween(Window.unboundedPreceding, -1)
    return labels.withColumn("_best", F.min("arrival").over(w)).filter("_best is null or arrival < _best").drop("_best")


def _expand(front: DataFrame, edges: DataFrame, model: Model, overlay: DataFrame | None, pricing: list[dict[str, Column]]) -> DataFrame:
    """New labels of the frontier: front has node, edge_idx (null at a source), cost, arrival, round, path; edges are priced edges.

    The frontier is dealt out first: it is much smaller than what it expands to, and may lie in few files.
    """
    front = front.repartition(int(front.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS, "edge_idx")
    left = front.select(*KEYS, F.col("node").alias("origin"), F.col("edge_idx").alias("from_edge"), F.col("cost").alias("g"), "arrival", (F.col("round") + 1).alias("round"), "path")
    rows = left.join(edges, "origin")
    if overlay is not None:
        rows = rows.join(overlay, ["scenario_id", "edge_idx"], "left")
    rows = rows.join(model.turns.select("from_edge", F.col("to_edge").alias("edge_idx"), "penalty"), ["from_edge", "edge_idx"], "left")
    for step in pricing:
        rows = rows.withColumns(step)
    priced = rows.filter(F.col("cost") < costs.INF)
    total = (F.col("g").cast("double") + F.col("cost").cast("double")).cast("float")
    known = [c for c in ("info",) if c in edges.columns]
    return priced.select(*KEYS, "edge_idx", "dest", total.alias("total"), _advance(F.col("arrival"), F.col("cost")).alias("arrival"), "round", F.concat("path", F.array("edge_idx")).alias("path"), *known).withColumnRenamed("total", "cost")


def _search(requests: DataFrame, model: Model, overlay: DataFrame | None, opts: CostOptions, budget: Budget, through_targets: bool, guide: Guide | None = None, backward: bool = False) -> Found:
    """Labels that reach a target: requests has request_id, scenario_id, source, targets (array of nodes), departure.

    guide bounds what a label has left to pay, to the nearest of its request's targets. backward does so by a
    search from the targets over the least costs of edges, which also drops labels that lead to no target.
    """
    spark = requests.sparkSession
    requests = stage(requests.withColumn("targets", F.array_distinct("targets")), "requests")
    goals = requests.select(*KEYS, F.explode("targets").alias("dest"))
    n_goals = requests.select(*KEYS, F.size("targets").alias("n_goals"))
    per_scenario = overlay is not None and "scenario_id" in overlay.columns
    edges = costs.priced_edges(model, None if per_scenario else overlay)
    slots = ["speed_factor", "valid_from", "valid_until"]
    if per_scenario:
        edges, overlay = edges.drop(*slots), stage(overlay.select("scenario_id", "edge_idx", *slots), "overlay")
    aims = None
    if guide is not None:
        info = guide.nodes.select("node_idx", "info")
        edges = edges.join(info.withColumnRenamed("node_idx", "dest"), "dest", "left")
        aims = stage(goals.join(info.withColumnRenamed("node_idx", "dest"), "dest").groupBy(*KEYS).agg(F.collect_list("info").alias("aims"), F.count(F.lit(1)).alias("n_aims")), "aims")
    edges = stage(edges, "edges")
    left = None
    if backward:
        ends = goals.select(F.col("dest").alias("landmark")).distinct()
        left = heuristics.distances(ends, heuristics.bound_weights(model), backward=True).select(F.col("source").alias("goal"), F.col("node").alias("dest"), F.col("distance").alias("behind"))
        left = stage(goals.withColumnRenamed("dest", "goal").join(left, "goal").groupBy(*KEYS, "dest").agg(F.min("behind").alias("behind")), "behind")
    front = requests.select(*KEYS, F.col("source").alias("node"), F.lit(None).cast("int").alias("edge_idx"), F.lit(0.0).cast("float").alias("cost"), F.col("departure").alias("arrival"), F.lit(0).alias("round"), F.array().cast("array<int>").alias("path"))
    pricing = costs.cost_columns("arrival", model.meta, opts, "from_edge")
    root, number, labels, schema, failed, waiting = stage_path(spark, "labels"), 0, None, None, None, None
    guided = guide is not None or backward
    while True:
        number += 1
        fresh = _expand(front, edges, model, overlay if per_scenario else None, pricing)
        ahead = F.lit(0.0)
        if aims is not None:
            fresh = fresh.join(aims, KEYS, "left").join(n_goals, KEYS)
            # a target without a place could be anywhere
            near = F.array_min(F.transform("aims", lambda a: F.greatest(F.lit(0.0), F.coalesce(guide.bound(F.col("info"), a), F.lit(0.0)))))
            ahead = F.when(F.col("info").isNotNull() & (F.col("n_aims") == F.col("n_goals")), near).otherwise(F.lit(0.0))
        if left is not None:
            fresh = fresh.join(left, [*KEYS, "dest"])
            ahead = F.greatest(ahead, F.col("behind"))
        total = (F.col("cost") + ahead * (1 - SLACK)) if guided else F.col("cost").cast("double")
        fresh = fresh.withColumn("total", total).drop("info", "aims", "n_aims", "n_goals", "behind").withColumn("new", F.lit(True))
        if labels is not None:
            fresh = _within(fresh, labels, n_goals)
            old = labels.select(*KEYS, "edge_idx", F.lit(None).cast("int").alias("dest"), "cost", "arrival", "round", F.lit(None).cast("array<int>").alias("path"), "total", F.lit(False).alias("new"))
            fresh = old.unionByName(fresh)
        new = undominated(fresh).filter("new").drop("new")
        new = new.join(goals.withColumn("hit", F.lit(True)), [*KEYS, "dest"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        schema = schema or new.schema
        new.write.parquet(f"{root}/round={number:06d}")
        read = lambda lo: spark.read.schema(schema).parquet(*[f"{root}/round={k:06d}" for k in range(lo, number + 1)])
        labels, new = read(1), read(number)
        onward = new if through_targets else new.filter("not hit")
        if guided:
            # the most promising labels go first; what they reach bounds the others, which wait
            onward = onward.drop("hit") if waiting is None else onward.drop("hit").unionByName(_within(waiting, labels, n_goals))
            least = F.min("total").over(Window.partitionBy(*KEYS))
            onward = stage(onward.withColumn("go", F.col("total") <= least * (1 + WIDTH)), "open")
            onward, waiting = onward.filter("go").drop("go"), onward.filter("not go").drop("go")
        if onward.isEmpty():
            break
        if budget.labels is not None or budget.frontier is not None or (budget.rounds is not None and number >= budget.rounds):
            over = _over(labels, onward, budget, number)
            failed = over if failed is None else stage(failed.unionByName(over), "failed")
            onward = onward.join(failed, KEYS, "left_anti")
            waiting = None if waiting is None else waiting.join(failed, KEYS, "left_anti")
            if onward.isEmpty():
                break
        front = onward.select(*KEYS, F.col("dest").alias("node"), "edge_idx", "cost", "arrival", "round", "path")
    # what a goal got in earlier rounds stays an answer even if a later label beats it at its edge
    reached = stage(labels.filter("hit").select(*KEYS, "edge_idx", "dest", "cost", "arrival", "path"), "reached")
    effort = stage(labels.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_labels"), F.max("round").alias("n_rounds")), "effort")
    failed = failed if failed is not None else requests.select(*KEYS, F.lit(None).cast("string").alias("reason_code")).limit(0)
    drop_stage(spark, root)
    return Found(reached, failed, effort)


def _within(rows: DataFrame, labels: DataFrame, n_goals: DataFrame) -> DataFrame:
    """Rows whose total is not above the dearest of the best labels at their request's goals; all of them while a goal is not met."""
    best = labels.filter("hit").groupBy(*KEYS, "dest").agg(F.min("cost").alias("c")).groupBy(*KEYS).agg(F.max("c").alias("bound"), F.count(F.lit(1)).alias("met"))
    bound = best.join(n_goals, KEYS).filter("met = n_goals").select(*KEYS, "bound")
    return rows.join(bound, KEYS, "left").filter("bound is null or total <= bound").drop("bound")


def _over(labels: DataFrame, onward: DataFrame, budget: Budget, number: int) -> DataFrame:
    """Requests that pass a budget, and the code of the first they pass; the last round is one too few only where labels would go on."""
    now = onward.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("now"))
    counts = labels.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).join(now, KEYS)
    reason = F.lit(None).cast("string")
    if budget.labels is not None:
        reason = F.coalesce(reason, F.when(F.col("n") > budget.labels, "SEARCH_LABELS_EXCEEDED"))
    if budget.frontier is not None:
        reason = F.coalesce(reason, F.when(F.col("now") > budget.frontier, "SEARCH_FRONTIER_EXCEEDED"))
    if budget.rounds is not None and number >= budget.rounds:
        reason = F.coalesce(reason, F.lit("SEARCH_ROUNDS_EXCEEDED"))
    return stage(counts.select(*KEYS, reason.alias("reason_code")).filter("reason_code is not null"), "over")


def _with_scenario(df: DataFrame) -> DataFrame:
    return df if "scenario_id" in df.columns else df.withColumn("scenario_id", F.lit(""))


def _with_reason(df: DataFrame) -> DataFrame:
    """Rows keep the reason they come with; without a node or a departure they get one."""
    incomplete = F.col("source").isNull() | F.col("target").isNull() | F.col("departure").isNull()
    own = F.col("reason_code") if "reason_code" in df.columns else F.lit(None).cast("string")
    return df.withColumn("reason_code", F.coalesce(own, F.when(incomplete, "REQUEST_INCOMPLETE")))


def find_routes(requests: DataFrame, model: Model, overlay: DataFrame | None = None, opts: CostOptions = CostOptions(), budget: Budget = Budget(), guide: Guide | None = None, backward: bool = False) -> tuple[DataFrame, DataFrame]:
    """The answers of `routes`, and request_id, scenario_id, n_labels, n_rounds: what the search of each request took."""
    requests = _with_reason(_with_scenario(requests))
    requests = stage(requests.select(*KEYS, "source", "target", "departure", "reason_code"), "requests")
    asked = requests.filter("reason_code is null and source <> target").select(*KEYS, "source", F.array("target").alias("targets"), "departure")
    found = _search(asked, model, overlay, opts, budget, False, guide, backward)
    best = stage(found.reached.groupBy(*KEYS).agg(F.min(F.struct("cost", "arrival", "path")).alias("b")).join(found.failed, KEYS, "left_anti"), "best")
    rows = requests.join(best, KEYS, "left").join(found.failed.withColumnRenamed("reason_code", "failed"), KEYS, "left").withColumn("reason_code", F.coalesce("reason_code", "failed"))
    own = F.col("reason_code").isNull() & (F.col("source") == F.col("target"))
    ok = F.col("reason_code").isNull()
    steps = best.select(*KEYS, F.posexplode("b.path").alias("pos", "edge_idx")).join(model.edges.select("edge_idx", "dest"), "edge_idx")
    nodes = steps.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dest"))), lambda s: s["dest"]).alias("ends"))
    none = F.array().cast("array<int>")
    rows = rows.join(nodes, KEYS, "left")
    return rows.select(
        *KEYS, F.when(ok, own | F.col("b").isNotNull()).alias("reachable"),
        F.when(own, F.lit(0.0)).when(ok, F.coalesce("b.cost", F.lit(costs.INF))).cast("float").alias("cost"),
        F.when(ok, F.coalesce("b.arrival", "departure")).alias("arrival"), F.when(ok, F.coalesce("b.path", none)).alias("edge_path"),
        F.when(own, F.array("source")).when(ok & F.col("ends").isNotNull(), F.concat(F.array("source"), "ends")).when(ok, none).alias("node_path"), "reason_code",
    ), found.effort


def routes(requests: DataFrame, model: Model, overlay: DataFrame | None = None, opts: CostOptions = CostOptions(), budget: Budget = Budget(), guide: Guide | None = None, backward: bool = False) -> DataFrame:
    """request_id, scenario_id, reachable, cost, arrival, edge_path, node_path, reason_code for requests request_id, source, target, departure (and scenario_id, reason_code).

    The least cost wins, then the earliest arrival, then the smallest edge path. A request from a node to itself
    costs 0 and has a path of one node. Unreachable ones cost infinity, arrive at their departure and have empty
    paths. Rows with a reason_code, or without a node or departure, get no answer but keep the reason, and so do
    requests that pass the budget. guide and backward make the search smaller and never change an answer.
    overlay: one row per edge, or per scenario_id and edge where requests have scenarios.
    """
    return find_routes(requests, model, overlay, opts, budget, guide, backward)[0]


def find_matrix(cells: DataFrame, model: Model, overlay: DataFrame | None = None, opts: CostOptions = CostOptions(), budget: Budget = Budget(), guide: Guide | None = None, backward: bool = False, strategy: str = "NATIVE") -> tuple[DataFrame, DataFrame]:
    """The cells of `matrix`, and row_key, scenario_id, n_labels, n_rounds of its searches."""
    if strategy not in ("NATIVE", "PAIRWISE"):
        raise ModelError("CONFIG_UNKNOWN", strategy)
    pair = ["target"] if strategy == "PAIRWISE" else []
    cells = _with_reason(_with_scenario(cells)).withColumn("row_key", F.concat_ws("|", "request_id", "source", "departure", *pair))
    cells = stage(cells.select(*KEYS, "source_pos", "target_pos", "source", "target", "departure", "reason_code", "row_key"), "cells")
    rows = cells.filter("reason_code is null and source <> target").groupBy("row_key", "scenario_id", "source", "departure").agg(F.collect_set("target").alias("targets"))
    found = _search(rows.withColumnRenamed("row_key", "request_id"), model, overlay, opts, budget, strategy == "NATIVE", guide, backward)
    named = lambda df: df.withColumnRenamed("request_id", "row_key")
    best = named(found.reached).groupBy("row_key", "scenario_id", F.col("dest").alias("target")).agg(F.min(F.struct("cost", "arrival")).alias("b"))
    out = cells.join(best, ["row_key", "scenario_id", "target"], "left").join(named(found.failed).withColumnRenamed("reason_code", "failed"), ["row_key", "scenario_id"], "left")
    own = F.col("source") == F.col("target")
    out = out.withColumn("reason_code", F.coalesce("reason_code", F.when(~own, F.col("failed"))))
    ok = F.col("reason_code").isNull()
    return out.select(
        *KEYS, "source_pos", "target_pos", "source", "target", F.when(ok, own | F.col("b").isNotNull()).alias("reachable"),
        F.when(ok & own, F.lit(0.0)).when(ok, F.coalesce("b.cost", F.lit(costs.INF))).cast("float").alias("cost"), F.when(ok, F.coalesce("b.arrival", "departure")).alias("arrival"), "reason_code",
    ), named(found.effort)


def matrix(cells: DataFrame, model: Model, overlay: DataFrame | None = None, opts: CostOptions = CostOptions(), budget: Budget = Budget(), guide: Guide | None = None, backward: bool = False, strategy: str = "NATIVE") -> DataFrame:
    """request_id, scenario_id, source_pos, target_pos, source, target, reachable, cost, arrival, reason_code of cells request_id, source_pos, target_pos, source, target, departure (and scenario_id, reason_code).

    NATIVE: one search per distinct source, departure and scenario serves all its distinct targets. PAIRWISE: one
    per distinct source and target, which a guide or backward search makes small where targets are few or far
    apart. Order and duplicates of the request come back by a join. Unreachable cells cost infinity and arrive at
    the departure; cells that cannot be asked, or whose row passes the budget, keep their reason and have no answer.
    """
    return find_matrix(cells, model, overlay, opts, budget, guide, backward, strategy)[0]


def matrix_stats(cells: DataFrame) -> DataFrame:
    """request_id, n_cells, n_reachable, n_sources, n_targets of a matrix result."""
    return cells.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if("reachable").alias("n_reachable"), F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets"))


def replay(paths: DataFrame, model: Model, overlay: DataFrame | None = None, opts: CostOptions = CostOptions()) -> DataFrame:
    """path_id, scenario_id, feasible, cost, arrival, reason_code of edge paths driven from their departure: path_id, edge_path, departure.

    All paths advance one edge a round. A path whose edges do not connect, or with an unknown edge, gets a
    reason; one that meets an infinite cost is not feasible and costs infinity.
    """
    paths = _with_scenario(paths)
    overlay = None if overlay is None else _with_scenario(overlay)
    state = stage(paths.select("path_id", "scenario_id", "edge_path", "departure", F.lit(0).alias("pos"), F.lit(0.0).cast("float").alias("g"), F.col("departure").alias("t"), F.lit(None).cast("int").alias("prev"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("reason_code")), "replay")
    longest = state.agg(F.max(F.size("edge_path"))).first()[0] or 0
    edges = costs.priced_edges(model) if overlay is None else model.edges.select("edge_idx", "origin", "dest", "base_weight", "profile_id").join(model.profiles, "profile_id", "left")
    for i in range(longest):
        rows = state.withColumn("edge_idx", F.get("edge_path", "pos")).join(edges, "edge_idx", "left")
        if overlay is not None:
            rows = rows.join(overlay.select("scenario_id", "edge_idx", "speed_factor", "valid_from", "valid_until"), ["scenario_id", "edge_idx"], "left")
        rows = rows.join(model.turns.select(F.col("from_edge").alias("prev"), F.col("to_edge").alias("edge_idx"), "penalty"), ["prev", "edge_idx"], "left")
        rows = costs.with_cost(rows, "t", model.meta, opts, "prev")
        here = F.size("edge_path") > F.col("pos")
        moves = here & F.col("reason_code").isNull() & (F.col("g") < costs.INF)
        reason = F.when(F.col("base_weight").isNull(), "PATH_EDGE_UNKNOWN").when(F.col("at").isNotNull() & (F.col("at") != F.col("origin")), "PATH_DISCONNECTED")
        good = moves & reason.isNull()
        state = rows.select(
            "path_id", "scenario_id", "edge_path", "departure", (F.col("pos") + 1).alias("pos"),
            F.when(good, (F.col("g").cast("double") + F.col("cost").cast("double")).cast("float")).otherwise(F.col("g")).alias("g"),
            F.when(good & (F.col("cost") < costs.INF), _advance(F.col("t"), F.col("cost"))).otherwise(F.col("t")).alias("t"),
            F.when(good, F.col("edge_idx")).otherwise(F.col("prev")).alias("prev"), F.when(good, F.col("dest")).otherwise(F.col("at")).alias("at"),
            F.coalesce("reason_code", F.when(moves, reason)).alias("reason_code"),
        )
        if i % 4 == 3:
            state = stage(state, "replay")
    fine = F.col("reason_code").isNull() & (F.col("g") < costs.INF)
    return state.select("path_id", "scenario_id", fine.alias("feasible"), F.when(fine, F.col("g")).otherwise(F.lit(costs.INF)).cast("float").alias("cost"), F.when(fine, F.col("t")).otherwise(F.lit(FAR)).alias("arrival"), "reason_code")


def reachable_nodes(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """source, node, hops: every node that each source reaches, with the least number of edges."""
    seen = stage(sources.select(F.col("node_idx").alias("source"), F.col("node_idx").alias("node"), F.lit(0).alias("hops")), "reach")
    number = 0
    while True:
        number += 1
        front = seen.filter(F.col("hops") == number - 1)
        step = front.join(edges.select(F.col("origin").alias("node"), "dest"), "node").select("source", F.col("dest").alias("node")).distinct()
        new = stage(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(number)), "reach")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
