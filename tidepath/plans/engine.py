"""An engine: a model, bound options, the current overlay and kept results, with the four kinds of query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import address, future, results, scenario, search
from ..operators import overlay as live
from ..operators.search import Budget
from ..sources.model import Metadata, Model, ModelError
from .config import Bound, bind


@dataclass(frozen=True)
class Hooks:
    """Parts of an engine that user code may replace.

    route_requests and matrix_requests turn what users ask into rows of nodes and reasons, and get the engine and
    the requests; plan_routes and plan_matrix are called as search.routes and search.matrix are; scenarios is
    called as scenario.resolve_bundle is.
    """

    route_requests: Callable[[Engine, DataFrame], DataFrame] | None = None
    matrix_requests: Callable[[Engine, DataFrame], DataFrame] | None = None
    plan_routes: Callable[..., DataFrame] = search.routes
    plan_matrix: Callable[..., DataFrame] = search.matrix
    scenarios: Callable[..., tuple[DataFrame, DataFrame]] = scenario.resolve_bundle


@dataclass
class Engine:
    """Every change gives a new engine; an engine in use never changes.

    landmarks: the table for the heuristic LANDMARK, else computed when first needed. kept: results, as in results.RESULTS.
    """

    model: Model
    bound: Bound | None = None
    overlay: DataFrame | None = None
    landmarks: DataFrame | None = None
    kept: DataFrame | None = None
    budget: Budget = Budget()
    hooks: Hooks = Hooks()
    mixed: bool = False
    _guide: list = field(default_factory=list, repr=False)

    def __post_init__(self):
        self.bound = self.bound or bind(self.model.meta)
        if self.bound.zone:
            self.model = replace(self.model, meta=Metadata(**{**vars(self.model.meta), "zone": self.bound.zone}))

    @property
    def options(self):
        return self.bound.cost_options()

    def _how(self) -> dict:
        """What the bound algorithm and heuristic mean for a search."""
        if not self._guide:
            self._guide.append(self.bound.guide(self.model, self.landmarks))
        return {"budget": self.budget, "guide": self._guide[0], "backward": self.bound.algorithm == "BIDIRECTIONAL"}

    def route_requests(self, requests: DataFrame) -> DataFrame:
        """request_id, source, target, departure, reason_code. Requests name their ends by source_id and target_id, or by source_end and target_end (address.END)."""
        if self.hooks.route_requests is not None:
            return self.hooks.route_requests(self, requests)
        if "source_end" not in requests.columns:
            return address.resolve_routes(requests, self.model.nodes)
        pairs = requests.select("request_id", "source_end", "target_end", self._snap(requests), "departure")
        return address.resolve_pairs(pairs, self.model.nodes, self.bound.addressing, self.bound.coordinates, self.mixed)

    def matrix_requests(self, requests: DataFrame) -> DataFrame:
        """A row per cell of requests with lists source_ids and target_ids, or source_ends and target_ends."""
        if self.hooks.matrix_requests is not None:
            return self.hooks.matrix_requests(self, requests)
        if "source_ends" not in requests.columns:
            return address.resolve_matrix(requests, self.model.nodes)
        cells = requests.select("request_id", "departure", self._snap(requests), "target_ends", F.posexplode("source_ends").alias("source_pos", "source_end"))
        cells = cells.select("request_id", "departure", "max_snap", "source_pos", "source_end", F.posexplode("target_ends").alias("target_pos", "target_end"))
        return address.resolve_pairs(cells, self.model.nodes, self.bound.addressing, self.bound.coordinates, self.mixed)

    @staticmethod
    def _snap(requests: DataFrame):
        return F.col("max_snap").cast("double") if "max_snap" in requests.columns else F.lit(None).cast("double").alias("max_snap")

    def routes(self, requests: DataFrame) -> DataFrame:
        """Answers of route requests; node paths by index."""
        return self.hooks.plan_routes(self.route_requests(requests), self.model, self.overlay, self.options, **self._how())

    def matrix(self, requests: DataFrame, strategy: str = "NATIVE") -> DataFrame:
        """Cells of matrix requests; those that cannot be answered keep their reason."""
        return self.hooks.plan_matrix(self.matrix_requests(requests), self.model, self.overlay, self.options, strategy=strategy, **self._how())

    def scenarios(self, requests: DataFrame, quarantine: DataFrame | None = None, observed_at: int | None = None) -> tuple[DataFrame, DataFrame]:
        return self.hooks.scenarios(requests, self.model, self.options, quarantine, observed_at, self.model.calibration)

    def _scenario_overlay(self, scenarios: DataFrame, updates: DataFrame, now: int) -> DataFrame:
        base = self.overlay if self.overlay is not None else updates.select(*live.SLOTS).limit(0)
        return scenario.scenario_overlay(base, scenarios, updates, now)

    def future_routes(self, requests: DataFrame, scenarios: DataFrame, updates: DataFrame, now: int, top_k: int = 3) -> dict[str, DataFrame]:
        return future.future_routes(requests, self.model, scenarios, self._scenario_overlay(scenarios, updates, now), self.options, top_k)

    def future_matrix(self, cells: DataFrame, scenarios: DataFrame, updates: DataFrame, now: int) -> DataFrame:
        return future.future_matrix(cells, self.model, scenarios, self._scenario_overlay(scenarios, updates, now), self.options)

    def apply(self, updates: DataFrame, now: int) -> Engine:
        """An engine that also has a batch of live updates."""
        current = self.overlay if self.overlay is not None else updates.select(*live.SLOTS).limit(0)
        return replace(self, overlay=live.merge(current, updates, now), _guide=self._guide)

    def with_execution(self, algorithm: str, heuristic: str, landmarks: DataFrame | None = None) -> Engine:
        """An engine with another algorithm and heuristic, checked as when the first was bound."""
        b = self.bound
        aware = b.catalog.temporal[b.temporal].day_mask_aware
        bound = bind(self.model.meta, b.catalog, addressing=b.addressing, temporal=b.temporal, transition=b.transition, zone_policy=b.zone if aware else None, algorithm=algorithm, heuristic=heuristic)
        return replace(self, bound=bound, landmarks=landmarks if landmarks is not None else self.landmarks, _guide=[])

    def keep(self, rows: DataFrame, key: str, now: int, ttl: int, bytes_budget: int) -> Engine:
        """An engine that also keeps the rows of each key as a result, for ttl ticks and within a budget of bytes."""
        if ttl <= 0:
            raise ModelError("REQUEST_TTL", str(ttl))
        new = results.as_result(rows, key, F.lit(self.model.meta.model_version), now, ttl)
        store = new.limit(0) if self.kept is None else self.kept
        return replace(self, kept=results.put(store, new, now, bytes_budget), _guide=self._guide)

    def kept_results(self, ids: DataFrame, now: int) -> DataFrame:
        """Kept results of the ids (result_id) that have not expired."""
        if self.kept is None:
            return ids.sparkSession.createDataFrame([], results.RESULTS)
        return results.get(self.kept, ids, now)
