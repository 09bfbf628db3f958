"""Scenarios of the near future: recurring peaks from profiles, incidents from quarantine, and their probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patternfn, timefn
from ..sources.model import Model
from .cost import CostOptions, multiplier


@dataclass(frozen=True)
class Calibration:
    """Probabilities, half-lives in seconds, floors and ranges."""

    least: float = 0.15
    most: float = 0.75
    peak_ratio: float = 1.10
    most_updates: int = 64
    fresh_half_life: int = 45 * 60
    horizon_half_life: int = 6 * 3600
    fresh_floor: float = 0.20
    horizon_floor: float = 0.35
    scale_floor: float = 0.40
    scale_range: float = 0.60
    incident_base: float = 0.35
    incident_range: float = 0.50
    incident_least: float = 0.35
    incident_most: float = 0.85
    degree_range: float = 0.06
    homophily_low: float = 0.25
    homophily_high: float = 0.75


DEFAULT = Calibration()


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def freshness(departure: Column, observed: Column, c: Calibration = DEFAULT, ticks: int = 1) -> Column:
    """From 1 for evidence of now down to the floor, halving its excess every half-life; without an observation the floor."""
    age = F.greatest(F.lit(0), departure - observed)
    decayed = c.fresh_floor + (1 - c.fresh_floor) * F.pow(F.lit(0.5), age / float(c.fresh_half_life * ticks))
    return F.when(observed.isNull(), F.lit(c.fresh_floor)).otherwise(decayed)


def horizon_weight(horizon: Column, c: Calibration = DEFAULT, ticks: int = 1) -> Column:
    return c.horizon_floor + (1 - c.horizon_floor) * F.pow(F.lit(0.5), F.greatest(F.lit(0), horizon) / float(c.horizon_half_life * ticks))


def recency_scale(fresh: Column, horizon: Column, c: Calibration = DEFAULT) -> Column:
    return c.scale_floor + c.scale_range * fresh * horizon


def peak_probability(confidence: Column, observations: Column, peak_ratio: Column, c: Calibration = DEFAULT) -> Column:
    severity = clamp((peak_ratio - c.peak_ratio) / 1.5, 0.0, 1.0)
    observed = clamp(F.log1p(F.greatest(F.lit(0), observations).cast("double")) / F.log(F.lit(17.0)), 0.0, 1.0)
    return clamp(c.least + 0.30 * confidence + 0.20 * severity + 0.10 * observed, c.least, c.most)


def update_budget(confidence: Column, observations: Column, c: Calibration = DEFAULT) -> Column:
    return F.greatest(F.lit(4), F.least(F.lit(c.most_updates), F.ceil(4.0 + 12.0 * confidence + F.sqrt(F.greatest(F.lit(0), observations).cast("double"))))).cast("int")


def incident_probability(fresh: Column, horizon: Column, prior: Column, c: Calibration = DEFAULT) -> Column:
    return clamp(c.incident_base + c.incident_range * fresh * horizon + prior, c.incident_least, c.incident_most)


def confidence_tag(confidence: Column) -> Column:
    return F.when(confidence >= 0.80, "recurrent_confidence_high").when(confidence >= 0.55, "recurrent_confidence_medium").otherwise("recurrent_confidence_low")


def peak_windows(requests: DataFrame, model: Model, opts: CostOptions) -> DataFrame:
    """request_id, profile_id, current, peak, valid_from, valid_until: the strongest multiplier among the bucket steps up to the horizon, the first of equals; the departure itself if none is stronger."""
    step = model.meta.bucket_seconds * timefn.TICKS[model.meta.unit]
    each = requests.select("request_id", "departure", F.greatest(F.lit(0).cast("long"), F.col("horizon")).alias("horizon"), F.lit(0).alias("_k")).join(model.profiles.withColumn("_k", F.lit(0)), "_k").drop("_k")
    now = each.withColumn("current", multiplier(F.col("departure"), model.meta, opts))
    offsets = F.when(F.col("horizon") >= step, F.sequence(F.lit(step).cast("long"), F.col("horizon"), F.lit(step).cast("long")))
    samples = now.withColumn("offset", F.explode_outer(offsets)).withColumn("tick", F.col("departure") + F.col("offset"))
    samples = samples.withColumn("m", multiplier(F.col("tick"), model.meta, opts))
    stronger = F.when(F.col("m") > F.col("current"), F.struct(F.col("m").alias("m"), (-F.col("tick")).alias("t")))
    best = samples.groupBy("request_id", "profile_id", "departure", "horizon", "current").agg(F.max(stronger).alias("s"))
    start = F.coalesce(-F.col("s.t"), F.col("departure"))
    end = F.least(start + step, F.col("departure") + F.col("horizon") + 1)
    return best.select("request_id", "profile_id", "current", F.coalesce("s.m", "current").alias("peak"), start.alias("valid_from"), F.greatest(end, start + 1).alias("valid_until"))


def profile_signals(requests: DataFrame, model: Model, opts: CostOptions, c: Calibration = DEFAULT) -> DataFrame:
    """peak_windows of profiles with a periodic pattern, with pattern, peak_ratio, speed_factor and has_signal."""
    patterns = patternfn.profile_patterns(model.profiles).select("profile_id", "pattern", "confidence", "support_windows", "flavor")
    rows = peak_windows(requests, model, opts).join(patterns, "profile_id")
    ratio = F.col("peak").cast("double") / F.col("current").cast("double")
    speed = clamp(F.col("current").cast("double") / F.col("peak").cast("double"), 0.0, 1.0).cast("float")
    rows = rows.withColumn("peak_ratio", ratio).withColumn("speed_factor", speed)
    periodic = F.col("pattern").isin("STRICT_PERIODIC", "MIXED_PERSISTENT_AND_PERIODIC")
    return rows.withColumn("has_signal", periodic & (F.col("peak_ratio") >= c.peak_ratio) & (F.col("speed_factor") < 1))


def calibrated(signals: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Signals with confidence, observation_count, flavor, posture and calibration_source: explicit rows by profile win over derived values, and the posture is that of the confidence that counts."""
    derived = signals.withColumn("observation_count", F.col("support_windows"))
    if overrides is None:
        return derived.withColumn("calibration_source", F.lit("DERIVED")).withColumn("last_observed_at", F.lit(None).cast("long")).withColumn("posture", patternfn.posture(F.col("pattern"), F.col("confidence")))
    o = overrides.select("profile_id", F.col("confidence").alias("o_conf"), F.col("observation_count").alias("o_n"), F.col("flavor").alias("o_flavor"), "last_observed_at")
    rows = derived.join(o, "profile_id", "left")
    given = F.col("o_conf").isNotNull()
    return rows.withColumns({"confidence": F.coalesce("o_conf", "confidence"), "observation_count": F.coalesce("o_n", "observation_count"), "flavor": F.coalesce("o_flavor", "flavor"), "calibration_source": F.when(given, "EXPLICIT").otherwise("DERIVED")}).drop("o_conf", "o_n", "o_flavor").withColumn("posture", patternfn.posture(F.col("pattern"), F.col("confidence")))


def recurring_edges(requests: DataFrame, model: Model, opts: CostOptions, overrides: DataFrame | None = None, c: Calibration = DEFAULT) -> DataFrame:
    """Edges that a recurring signal slows, per request, with severity = base weight times (peak ratio - 1)."""
    signals = calibrated(profile_signals(requests, model, opts, c).filter("has_signal"), overrides)
    edges = model.edges.select("edge_idx", "profile_id", "origin", "dest", "base_weight")
    return edges.join(signals, "profile_id").withColumn("severity", F.col("base_weight").cast("double") * (F.col("peak_ratio") - 1))


def recurring_summary(requests: DataFrame, model: Model, opts: CostOptions, overrides: DataFrame | None = None, c: Calibration = DEFAULT) -> DataFrame:
    """request_id, n_edges, confidence, freshness, n_observations, peak_ratio, incident, probability, n_updates, confidence_tag, observed_at, horizon_weight, base_probability: one row per request with a signal."""
    ticks = timefn.TICKS[model.meta.unit]
    edges = recurring_edges(requests, model, opts, overrides, c).join(requests.select("request_id", "departure", "horizon"), "request_id")
    s = F.col("severity")
    fresh = freshness(F.col("departure"), F.col("last_observed_at"), c, ticks)
    total = edges.groupBy("request_id", "departure", "horizon").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum(s).alias("s"), F.sum(s * F.col("confidence").cast("double")).alias("sc"), F.sum(s * fresh).alias("sf"), F.sum("observation_count").alias("n_observations"), F.max("last_observed_at").alias("observed_at"),
        F.max(F.greatest("peak_ratio", F.lit(c.peak_ratio))).alias("peak_ratio"), F.sum(F.when(F.col("flavor") == "RECURRING_INCIDENT", s).otherwise(-s)).alias("lean"),
    )
    some = F.col("s") > 0
    rows = total.withColumns({"confidence": F.when(some, F.col("sc") / F.col("s")).otherwise(F.lit(0.0)), "freshness": F.when(some, F.col("sf") / F.col("s")).otherwise(F.lit(c.fresh_floor)), "incident": F.col("lean") > 0})
    base = peak_probability(F.col("confidence"), F.col("n_observations"), F.col("peak_ratio"), c)
    far = horizon_weight(F.col("horizon"), c, ticks)
    scaled = clamp(base * recency_scale(F.col("freshness"), far, c), c.least, c.most)
    return rows.select("request_id", "n_edges", "confidence", "freshness", "n_observations", "peak_ratio", "incident", scaled.alias("probability"), F.least(update_budget(F.col("confidence"), F.col("n_observations"), c).cast("long"), F.col("n_edges")).alias("n_updates"), confidence_tag(F.col("confidence")).alias("confidence_tag"), "observed_at", far.alias("horizon_weight"), base.alias("base_probability"))


def recurring_updates(requests: DataFrame, model: Model, opts: CostOptions, overrides: DataFrame | None = None, c: Calibration = DEFAULT) -> DataFrame:
    """request_id, edge_idx, speed_factor, valid_from, valid_until, severity of the most severe edges, as many as the budget allows; ties by smaller edge index."""
    summary = recurring_summary(requests, model, opts, overrides, c).select("request_id", "n_updates")
    order = Window.partitionBy("request_id").orderBy(F.desc("severity"), "edge_idx")
    rows = recurring_edges(requests, model, opts, overrides, c).withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= c.most_updates)
    return rows.join(summary, "request_id").filter(F.col("turn") <= F.col("n_updates")).select("request_id", "edge_idx", "speed_factor", "valid_from", "valid_until", "severity")


def node_structure(model: Model) -> DataFrame:
    """node_idx, degree and, per profile of its out-edges, same (their share): the base of degree and homophily scores."""
    return model.edges.groupBy(F.col("origin").alias("node_idx"), "profile_id").agg(F.count(F.lit(1)).alias("n")).withColumn("degree", F.sum("n").over(Window.partitionBy("node_idx"))).withColumn("same", F.col("n") / F.col("degree"))


def edge_structure(model: Model) -> DataFrame:
    """edge_idx, degree_score, homophily_score: mean normalised out-degree of both ends, and mean share of out-edges with the edge's profile (0.5 if neither end has any)."""
    by_profile = node_structure(model)
    deg = by_profile.groupBy("node_idx").agg(F.max("degree").alias("degree"))
    top = F.broadcast(deg.agg(F.max("degree").alias("top")))  # one row
    rows = model.edges.select("edge_idx", "origin", "dest", "profile_id").join(top, F.lit(True))
    for side in ("origin", "dest"):
        rows = rows.join(deg.select(F.col("node_idx").alias(side), F.col("degree").alias(f"{side}_degree")), side, "left")
        rows = rows.join(by_profile.select(F.col("node_idx").alias(side), "profile_id", F.col("same").alias(f"{side}_same")), [side, "profile_id"], "left")
    norm = lambda d: clamp((F.coalesce(d, F.lit(0)) - 1) / (F.col("top") - 1), 0.0, 1.0)
    degree = F.when(F.col("top") <= 1, F.lit(0.0)).otherwise((norm(F.col("origin_degree")) + norm(F.col("dest_degree"))) / 2)
    share = lambda side: F.when(F.col(f"{side}_degree").isNotNull(), F.coalesce(f"{side}_same", F.lit(0.0)))
    a, b = share("origin"), share("dest")
    same = F.when(a.isNull() & b.isNull(), F.lit(0.5)).when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2)
    return rows.select("edge_idx", degree.alias("degree_score"), same.alias("homophily_score"), (F.col("top") > 1).alias("spread"))


def structural_prior(weighted: DataFrame, model: Model, fresh: Column, horizon: Column, c: Calibration = DEFAULT) -> DataFrame:
    """group_id, n_edges, degree_score, centered, adjustment, homophily_score, degree_tag, homophily_tag of weighted edges (group_id, edge_idx, weight); weights that are not positive count for nothing."""
    rows = weighted.filter("weight > 0 and weight < double('infinity')").join(edge_structure(model), "edge_idx")
    w = F.col("weight")
    one = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(w).alias("w"), F.sum(w * F.col("degree_score")).alias("d"), F.sum(w * F.col("homophily_score")).alias("h"), F.max("spread").alias("spread"))
    one = one.withColumns({"degree_score": clamp(F.col("d") / F.col("w"), 0.0, 1.0), "homophily_score": clamp(F.col("h") / F.col("w"), 0.0, 1.0)})
    one = one.withColumn("centered", F.when(F.col("spread"), clamp(2 * F.col("degree_score") - 1, -1.0, 1.0)).otherwise(F.lit(0.0)))
    degree_tag = F.when(~F.col("spread"), "degree_prior_neutral").when(F.col("degree_score") <= 0.25, "degree_prior_low").when(F.col("degree_score") >= 0.75, "degree_prior_high").otherwise("degree_prior_neutral")
    homophily_tag = F.when(F.col("homophily_score") <= c.homophily_low, "homophily_low").when(F.col("homophily_score") >= c.homophily_high, "homophily_high").otherwise("homophily_neutral")
    return one.select("group_id", "n_edges", "degree_score", "centered", (F.col("centered") * c.degree_range * fresh * horizon).alias("adjustment"), "homophily_score", degree_tag.alias("degree_tag"), homophily_tag.alias("homophily_tag"))


def merge_updates(left: DataFrame, right: DataFrame) -> DataFrame:
    """One update per edge of two sets: overlapping ones take the lower speed and the union of their times, else the earlier one stays (left on a tie)."""
    named = lambda df, s: df.select("edge_idx", F.struct("speed_factor", "valid_from", "valid_until").alias(s))
    both = named(left, "l").join(named(right, "r"), "edge_idx", "full")
    overlap = (F.col("l.valid_from") < F.col("r.valid_until")) & (F.col("r.valid_from") < F.col("l.valid_until"))
    union = F.struct(F.least("l.speed_factor", "r.speed_factor").alias("speed_factor"), F.least("l.valid_from", "r.valid_from").alias("valid_from"), F.greatest("l.valid_until", "r.valid_until").alias("valid_until"))
    pick = F.when(F.col("l").isNull(), F.col("r")).when(F.col("r").isNull(), F.col("l")).when(overlap, union).when(F.col("l.valid_from") <= F.col("r.valid_from"), F.col("l")).otherwise(F.col("r"))
    return both.select("edge_idx", pick.alias("u")).select("edge_idx", "u.*")


def merge_tags(a: Column, b: Column) -> Column:
    """Tags of both in order, each once, blank ones left out."""
    return F.filter(F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))), lambda t: t.isNotNull() & (F.trim(t) != ""))


#: How a probability came about; observed_at and evidence_age are both null where nothing was observed.
AUDIT = "struct<policy:string,evidence:string,observed_at:bigint,evidence_age:bigint,freshness:double,horizon:double,base:double,adjusted:double,structural:double>"
POLICY = "recency-1"


def audit(evidence: str, departure: Column, observed: Column, fresh: Column, far: Column, base: Column, adjusted: Column, structural: Column | None = None) -> Column:
    """The audit record of a scenario's probability, as AUDIT."""
    observed = observed.cast("long")
    age = F.when(observed.isNotNull(), F.greatest(F.lit(0).cast("long"), departure - observed))
    parts = {"policy": F.lit(POLICY), "evidence": F.lit(evidence), "observed_at": observed, "evidence_age": age, "freshness": fresh, "horizon": far, "base": base, "adjusted": adjusted, "structural": F.lit(None) if structural is None else structural}
    return F.struct(*[x.alias(k) for k, x in parts.items()]).cast(AUDIT)


def resolve_bundle(requests: DataFrame, model: Model, opts: CostOptions, quarantine_updates: DataFrame | None = None, observed_at: int | None = None, overrides: DataFrame | None = None, c: Calibration = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Scenarios (request_id, scenario_id, probability, tags, audit) and their updates (request_id, scenario_id, and update columns).

    Without active failures: baseline, and a recurring peak where profiles show one. With them (quarantine_updates
    has rows: edge_idx, speed_factor, valid_from, valid_until): incident_persists, and clearing_fast, in which
    failures end at half of the horizon; both also carry the recurring updates. Recurring signals need a
    calendar: without day masks there are none.
    """
    ticks = timefn.TICKS[model.meta.unit]
    empty_tags = F.array().cast("array<string>")
    if opts.calendar:
        summary = recurring_summary(requests, model, opts, overrides, c)
        peaks = recurring_updates(requests, model, opts, overrides, c).drop("severity")
    else:
        summary = requests.select("request_id", F.lit(0.0).alias("probability"), F.lit(False).alias("incident"), F.lit("").alias("confidence_tag"), F.lit(None).cast("long").alias("observed_at"), F.lit(0.0).alias("freshness"), F.lit(0.0).alias("horizon_weight"), F.lit(0.0).alias("base_probability")).limit(0)
        peaks = requests.select("request_id", F.lit(0).alias("edge_idx"), F.lit(0.0).cast("float").alias("speed_factor"), F.lit(0).cast("long").alias("valid_from"), F.lit(0).cast("long").alias("valid_until")).limit(0)
    known = requests.select("request_id", "departure", "horizon").join(summary.select("request_id", F.col("probability").alias("p"), "incident", "confidence_tag", "observed_at", "freshness", "horizon_weight", "base_probability"), "request_id", "left")
    name = F.when(F.col("incident"), "recurring_incident_peak").otherwise("periodic_peak")
    if quarantine_updates is None or quarantine_updates.isEmpty():
        about = lambda base, adjusted: F.when(F.col("p").isNotNull(), audit("profiles", F.col("departure"), F.col("observed_at"), F.col("freshness"), F.col("horizon_weight"), base, adjusted)).alias("audit")
        base = known.select("request_id", F.lit("baseline").alias("scenario_id"), (1 - F.coalesce("p", F.lit(0.0))).alias("probability"), F.when(F.col("p").isNull(), empty_tags).otherwise(F.array("confidence_tag")).alias("tags"), about(1 - F.col("base_probability"), 1 - F.col("p")))
        peak = known.filter("p is not null").select("request_id", name.alias("scenario_id"), F.col("p").alias("probability"), F.array(name, "confidence_tag").alias("tags"), about(F.col("base_probability"), F.col("p")))
        return base.unionByName(peak), peaks.join(peak.select("request_id", "scenario_id"), "request_id")
    fresh = freshness(F.col("departure"), F.lit(observed_at).cast("long"), c, ticks)
    far = horizon_weight(F.col("horizon"), c, ticks)
    prior = structural_prior(quarantine_updates.select(F.lit(0).alias("group_id"), "edge_idx", F.lit(1.0).alias("weight")), model, F.lit(1.0), F.lit(1.0), c).select(F.col("adjustment").alias("prior"), F.array("degree_tag", "homophily_tag").alias("structure"))
    rows = known.join(F.broadcast(prior), F.lit(True), "left")  # one row
    persists = incident_probability(fresh, far, F.coalesce("prior", F.lit(0.0)) * fresh * far, c)
    tags = merge_tags(F.when(F.col("p").isNull(), empty_tags).otherwise(F.array(name, "confidence_tag")), F.col("structure"))
    structural = F.coalesce("prior", F.lit(0.0)) * fresh * far
    about = lambda adjusted, base: audit("quarantine", F.col("departure"), F.lit(observed_at), fresh, far, base, adjusted, structural)
    start = F.lit(c.incident_base)
    kinds = rows.select("request_id", "departure", "horizon", persists.alias("q"), tags.alias("tags"), about(persists, start).alias("stays"), about(1 - persists, 1 - start).alias("clears"))
    scenarios = kinds.select("request_id", F.lit("incident_persists").alias("scenario_id"), F.col("q").alias("probability"), "tags", F.col("stays").alias("audit"))
    scenarios = scenarios.unionByName(kinds.select("request_id", F.lit("clearing_fast").alias("scenario_id"), (1 - F.col("q")).alias("probability"), merge_tags(F.col("tags"), F.array(F.lit("recovery_expected"))).alias("tags"), F.col("clears").alias("audit")))
    clear = F.col("departure") + F.greatest(F.lit(1).cast("long"), F.floor(F.col("horizon") / 2))
    held = requests.select("request_id", "departure", "horizon", F.lit(0).alias("_k")).join(quarantine_updates.withColumn("_k", F.lit(0)), "_k").drop("_k")
    stays = held.select("request_id", F.lit("incident_persists").alias("scenario_id"), "edge_idx", "speed_factor", "valid_from", "valid_until")
    clears = held.withColumn("valid_until", F.least("valid_until", clear)).filter("valid_until > valid_from").select("request_id", F.lit("clearing_fast").alias("scenario_id"), "edge_idx", "speed_factor", "valid_from", "valid_until")
    named = lambda df: df.withColumn("key", F.struct("request_id", "scenario_id", "edge_idx"))
    both = peaks.withColumn("scenario_id", F.explode(F.array(F.lit("incident_persists"), F.lit("clearing_fast"))))
    merged = merge_updates(named(stays.unionByName(clears)).drop("edge_idx").withColumnRenamed("key", "edge_idx"), named(both).drop("edge_idx").withColumnRenamed("key", "edge_idx"))
    return scenarios, merged.select(F.col("edge_idx.request_id").alias("request_id"), F.col("edge_idx.scenario_id").alias("scenario_id"), F.col("edge_idx.edge_idx").alias("edge_idx"), "speed_factor", "valid_from", "valid_until")


def bundle_id(scenarios: DataFrame, updates: DataFrame) -> DataFrame:
    """request_id, bundle_id: SHA-256 over the scenarios and updates in canonical order; equal bundles have equal ids."""
    s = scenarios.groupBy("request_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws("|", "scenario_id", F.format_number("probability", 9), F.concat_ws(",", "tags"))))).alias("s"))
    u = updates.groupBy("request_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws("|", "scenario_id", F.lpad(F.col("edge_idx").cast("string"), 12, "0"), F.col("speed_factor").cast("string"), "valid_from", "valid_until")))).alias("u"))
    return s.join(u, "request_id", "left").select("request_id", F.sha2(F.concat_ws("\n\n", "s", F.coalesce("u", F.lit(""))), 256).alias("bundle_id"))


def check_bundle(scenarios: DataFrame, updates: DataFrame, edges: DataFrame) -> DataFrame:
    """request_id, reason_code of bundles that break a rule: unique scenarios, probabilities that sum to 1 within 1e-6, known edges, one update per edge and scenario, audits (if scenarios have them) in range that agree with their probabilities."""
    row = lambda df, code: df.select("request_id", F.lit(code).alias("reason_code"))
    audits = scenarios.limit(0)
    if "audit" in scenarios.columns:
        share = lambda c: F.coalesce(F.col(f"audit.{c}").between(0.0, 1.0), F.lit(False))
        named = lambda c: F.coalesce(F.trim(f"audit.{c}") != "", F.lit(False))
        fine = named("policy") & named("evidence") & share("freshness") & share("horizon") & share("base") & share("adjusted") & (F.col("audit.adjusted") > 0)
        fine = fine & (F.abs(F.col("audit.adjusted") - F.col("probability")) <= 1e-6) & (F.col("audit.observed_at").isNull() == F.col("audit.evidence_age").isNull()) & (F.coalesce("audit.evidence_age", F.lit(0)) >= 0)
        audits = scenarios.filter(F.col("audit").isNotNull() & ~fine)
    return (
        row(scenarios.groupBy("request_id", "scenario_id").count().filter("count > 1"), "SCENARIO_DUPLICATE")
        .unionByName(row(scenarios.groupBy("request_id").agg(F.sum("probability").alias("p")).filter("abs(p - 1) > 1e-6"), "SCENARIO_PROBABILITY_SUM"))
        .unionByName(row(scenarios.filter("probability is null or isnan(probability) or probability < 0 or probability > 1"), "SCENARIO_PROBABILITY"))
        .unionByName(row(updates.join(edges.select("edge_idx"), "edge_idx", "left_anti"), "SCENARIO_EDGE_UNKNOWN"))
        .unionByName(row(audits, "SCENARIO_AUDIT"))
        .unionByName(row(updates.groupBy("request_id", "scenario_id", "edge_idx").count().filter("count > 1"), "SCENARIO_EDGE_DUPLICATE"))
        .distinct()
    )


def scenario_overlay(overlay: DataFrame, scenarios: DataFrame, updates: DataFrame, now: int) -> DataFrame:
    """scenario_id and overlay columns: each scenario sees the active overlay with its own updates in place of those edges' entries. There is no cap."""
    keys = scenarios.select("scenario_id").distinct().withColumn("_k", F.lit(0))
    base = keys.join(overlay.filter(F.col("valid_until") > now).withColumn("_k", F.lit(0)), "_k").drop("_k")
    own = updates.select("scenario_id", "edge_idx", "speed_factor", "valid_from", "valid_until")
    kept = base.join(own.select("scenario_id", "edge_idx"), ["scenario_id", "edge_idx"], "left_anti")
    return kept.select("scenario_id", "edge_idx", "speed_factor", "valid_from", "valid_until").unionByName(own)
