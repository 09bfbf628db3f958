"""Options bound once when an engine is built, and the registries that user code extends."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, timefn
from ..operators import heuristics
from ..operators.cost import CostOptions, turn_cost
from ..operators.heuristics import Guide
from ..sources.model import Metadata, Model, ModelError

#: Codes that rows or exceptions carry, by the part of a request or option they speak of.
REASONS = {
    "CONFIG_REQUIRED": "an option without default is missing",
    "CONFIG_UNKNOWN": "an option names nothing registered",
    "CONFIG_CONFLICT": "two options exclude each other",
    "CONFIG_TIMEZONE": "CALENDAR needs a time zone, LINEAR takes none",
    "CONFIG_PROBE": "a transition strategy does not keep the built-in meaning of forbidden and neutral turns",
    "REQUEST_INCOMPLETE": "a request lacks an end or its departure",
    "REQUEST_DEPARTURE_REQUIRED": "a request has no departure",
    "REQUEST_HORIZON": "the horizon must be positive",
    "REQUEST_TOP_K": "the number of alternatives must be positive",
    "REQUEST_TTL": "the time to live must be positive",
    "ADDRESS_SOURCE_REQUIRED": "a source id is missing or blank",
    "ADDRESS_TARGET_REQUIRED": "a target id is missing or blank",
    "ADDRESS_SOURCE_UNKNOWN": "no node has the source id",
    "ADDRESS_TARGET_UNKNOWN": "no node has the target id",
    "ADDRESS_MIXED": "ids and coordinates are mixed without leave",
    "ADDRESS_STRATEGY": "a hint differs from the strategy bound",
    "ADDRESS_COORDINATES_INVALID": "coordinates are not finite or out of range",
    "ADDRESS_SNAP_RANGE": "the snap distance is out of range",
    "ADDRESS_SNAP_EXCEEDED": "the nearest node is too far",
    "ADDRESS_NO_NODE": "no node has coordinates",
    "COST_EDGE_UNKNOWN": "no edge has the index",
    "PATH_EDGE_UNKNOWN": "a path has an edge that does not exist",
    "PATH_DISCONNECTED": "an edge of a path does not start where the one before ends",
    "SEARCH_ROUNDS_EXCEEDED": "a search passed its bound on rounds",
    "SEARCH_LABELS_EXCEEDED": "a search passed its bound on labels",
    "SEARCH_FRONTIER_EXCEEDED": "a search passed its bound on frontier rows",
    "HEURISTIC_TYPE": "no such lower bound",
    "HEURISTIC_COORDINATES": "a node has no coordinates, or none that the lower bound can use",
    "LANDMARK_INCOMPATIBLE": "landmarks belong to another graph",
    "OVERLAY_EDGE_ID": "an update has no valid edge",
    "OVERLAY_EDGE_UNKNOWN": "an update's edge does not exist",
    "OVERLAY_SPEED_FACTOR": "a speed factor is not in [0, 1]",
    "OVERLAY_INTERVAL": "an update ends before it starts",
    "SCENARIO_AUDIT": "an audit record is out of range or differs from its scenario's probability",
    "SCENARIO_DUPLICATE": "two scenarios have one id",
    "SCENARIO_PROBABILITY": "a probability is not in [0, 1]",
    "SCENARIO_PROBABILITY_SUM": "probabilities do not sum to 1",
    "SCENARIO_EDGE_UNKNOWN": "a scenario's update names an unknown edge",
    "SCENARIO_EDGE_DUPLICATE": "a scenario has two updates of one edge",
    "RESULT_ID_REQUIRED": "a result has no id",
    "RESULT_EXPIRY": "a result ends before it begins",
    "RESULT_PAYLOAD_REQUIRED": "a result has no payload",
    "CHANGE_DUPLICATE": "a change set names an id twice",
    "CHANGE_CONFLICT": "a change set removes and adds one id",
    "TOPOLOGY_INVALID": "a candidate model breaks its contract",
    "TOPOLOGY_GATE": "a gate refused a candidate model",
    "TOPOLOGY_NONE": "nothing has been published",
}


@dataclass(frozen=True)
class CoordinateStrategy:
    """Column functions: distance(x1, y1, x2, y2), valid(x, y); and the default snap distance."""

    distance: Callable[..., Column]
    valid: Callable[..., Column]
    default_snap: float


@dataclass(frozen=True)
class TemporalStrategy:
    """offset(sec, zone) in seconds added to UTC, and whether day masks count."""

    offset: Callable[..., Column]
    day_mask_aware: bool


@dataclass(frozen=True)
class TransitionStrategy:
    """turn(penalty, has_predecessor) as float Column."""

    turn: Callable[..., Column]
    finite_penalties: bool


@dataclass
class Catalog:
    """Built-in and user strategies by name; user entries win."""

    coordinates: dict[str, CoordinateStrategy] = field(default_factory=lambda: {
        "XY": CoordinateStrategy(geo.euclidean, lambda x, y: geo.finite(x, y), 1_000.0),
        "LAT_LON": CoordinateStrategy(geo.great_circle_m, lambda x, y: geo.finite(x, y) & geo.valid_lat_lon(x, y), 250.0),
    })
    temporal: dict[str, TemporalStrategy] = field(default_factory=lambda: {
        "LINEAR": TemporalStrategy(lambda sec, zone: F.lit(0), False),
        "CALENDAR": TemporalStrategy(lambda sec, zone: timefn.zone_offset(sec, zone), True),
    })
    transition: dict[str, TransitionStrategy] = field(default_factory=lambda: {
        "EDGE_BASED": TransitionStrategy(lambda p, has: turn_cost(p, has, CostOptions(turns="EDGE_BASED")), True),
        "NODE_BASED": TransitionStrategy(lambda p, has: turn_cost(p, has, CostOptions(turns="NODE_BASED")), False),
    })
    #: Names of zone policies; any other name is taken for a zone.
    zones: dict[str, Callable[[Metadata], str]] = field(default_factory=lambda: {"MODEL": lambda meta: meta.zone})
    #: Lower bounds by name: a function of the model (and of landmarks, if the engine has some) that gives a guide, or None.
    heuristics: dict[str, Callable[[Model, DataFrame | None], Guide | None]] = field(default_factory=lambda: {
        kind: lambda model, landmarks, kind=kind: heuristics.guide_for(model, kind, landmarks) for kind in ("NONE", "EUCLIDEAN", "SPHERICAL", "LANDMARK")
    })


@dataclass(frozen=True)
class Bound:
    """Options after binding, and a hash that names them."""

    addressing: str
    temporal: str
    transition: str
    zone: str | None
    algorithm: str
    heuristic: str
    bundle_hash: str
    catalog: Catalog = field(default_factory=Catalog, compare=False, repr=False)

    def cost_options(self, interpolate: bool = True) -> CostOptions:
        """Costs as the bound strategies say, built-in or the user's own."""
        time, turn = self.catalog.temporal[self.temporal], self.catalog.transition[self.transition]
        return CostOptions(interpolate, time.day_mask_aware, self.transition, time.offset, turn.turn)

    @property
    def coordinates(self) -> CoordinateStrategy:
        return self.catalog.coordinates[self.addressing]

    def guide(self, model: Model, landmarks: DataFrame | None = None) -> Guide | None:
        return self.catalog.heuristics[self.heuristic](model, landmarks)


#: DIJKSTRA relaxes all labels, A_STAR is led by the heuristic, BIDIRECTIONAL also by a search back from the targets.
ALGORITHMS = ("DIJKSTRA", "A_STAR", "BIDIRECTIONAL")
# Named bundles of addressing, temporal and transition.
BUNDLES = {"DEFAULT": ("XY", "LINEAR", "EDGE_BASED"), "GEODETIC_CALENDAR": ("LAT_LON", "CALENDAR", "EDGE_BASED"), "NODE_LINEAR": ("XY", "LINEAR", "NODE_BASED")}


def bind(meta: Metadata, catalog: Catalog | None = None, bundle: str | None = None, addressing: str | None = None, temporal: str | None = None, transition: str | None = None, zone_policy: str | None = None, algorithm: str | None = "DIJKSTRA", heuristic: str | None = "NONE", probe: Callable[[str, TransitionStrategy], bool] | None = None) -> Bound:
    """Check all options together; a bundle and single options exclude each other. zone_policy: a policy of the catalog (MODEL takes the model's zone), else a zone's name."""
    catalog = catalog or Catalog()
    given = [x for x in (addressing, temporal, transition) if x is not None]
    if bundle is not None and given:
        raise ModelError("CONFIG_CONFLICT", "a bundle and single options")
    if bundle is not None and bundle not in BUNDLES:
        raise ModelError("CONFIG_UNKNOWN", bundle)
    names = BUNDLES[bundle] if bundle else tuple(x or d for x, d in zip((addressing, temporal, transition), BUNDLES["DEFAULT"]))
    for name, known in zip(names, (catalog.coordinates, catalog.temporal, catalog.transition)):
        if name not in known:
            raise ModelError("CONFIG_UNKNOWN", name)
    aware = catalog.temporal[names[1]].day_mask_aware
    if aware != (zone_policy is not None):
        raise ModelError("CONFIG_TIMEZONE", f"{names[1]} with {zone_policy}")
    zone = catalog.zones[zone_policy](meta) if zone_policy in catalog.zones else zone_policy
    if zone is not None:
        try:
            ZoneInfo(zone)
        except Exception as e:
            raise ModelError("CONFIG_TIMEZONE", zone) from e
    if algorithm is None or heuristic is None:
        raise ModelError("CONFIG_REQUIRED", "algorithm and heuristic")
    if algorithm not in ALGORITHMS or heuristic not in catalog.heuristics:
        raise ModelError("CONFIG_UNKNOWN", f"{algorithm}, {heuristic}")
    if algorithm == "DIJKSTRA" and heuristic != "NONE":
        raise ModelError("CONFIG_CONFLICT", "DIJKSTRA takes no heuristic")
    if probe is not None and not probe(names[2], catalog.transition[names[2]]):
        raise ModelError("CONFIG_PROBE", names[2])
    text = "\n".join([*names, zone or "-", algorithm, heuristic, meta.unit, str(meta.bucket_seconds)])
    return Bound(*names, zone, algorithm, heuristic, hashlib.sha256(text.encode()).hexdigest(), catalog)


def probe_transition(spark) -> Callable[[str, TransitionStrategy], bool]:
    """A probe that runs a strategy on a finite, a forbidden and a neutral turn, and on one without predecessor."""

    def run(name: str, strategy: TransitionStrategy) -> bool:
        rows = spark.createDataFrame([(0, 5.0, True), (1, float("inf"), True), (2, None, True), (3, 5.0, False)], "k int, p float, has boolean")
        got = {r.k: r.t for r in rows.select("k", strategy.turn(F.col("p"), F.col("has")).alias("t")).collect()}
        return got == {0: 5.0 if strategy.finite_penalties else 0.0, 1: float("inf"), 2: 0.0, 3: 0.0}

    return run


def check_future_requests(requests):
    """request_id, reason_code of future requests whose horizon, top_k or ttl is not positive."""
    reason = F.when(~(F.coalesce("horizon", F.lit(0)) > 0), "REQUEST_HORIZON").when(~(F.coalesce("top_k", F.lit(0)) > 0), "REQUEST_TOP_K").when(~(F.coalesce("ttl", F.lit(0)) > 0), "REQUEST_TTL")
    return requests.withColumn("reason_code", reason).filter("reason_code is not null").select("request_id", "reason_code")
