"""The job queue: submission, order, state changes, periodic triggers, and a registry of what runs."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("done", "error", "cancelled", "interrupted")
#: Allowed changes of a job's status (a fixed value).
CHANGES = {"queued": {"running", "cancelled", "interrupted"}, "running": {"done", "error", "cancelled", "interrupted"}}


class Cancelled(Exception):
    """Raised by a handler that was asked to stop."""


@dataclass(frozen=True)
class Spec:
    """What a job type is: its handler, which root a job of it owns, and whether an open merge may hold that root."""

    kind: str
    handler: Callable
    owned_root: Callable[[dict], int | None] = lambda params: params.get("root_id")
    ignore_merge_holder: bool = False


@dataclass
class Context:
    """What a handler sees: its parameters, the settings as they were when the job began, and whether it shall stop."""

    params: dict
    config: object = None
    stop: Callable[[], bool] = lambda: False
    events: list = field(default_factory=list)

    def check(self) -> None:
        """Raise if the job was cancelled."""
        if self.stop():
            raise Cancelled

    def emit(self, event: dict) -> None:
        """Tell the job's followers something."""
        self.events.append(event)


class Registry:
    """Job types by name."""

    def __init__(self):
        self.specs: dict[str, Spec] = {}

    def add(self, kind: str, handler: Callable, **more) -> None:
        if kind in self.specs:
            raise ValueError(f"job type {kind} is registered already")
        self.specs[kind] = Spec(kind, handler, **more)

    def run(self, kind: str, context: Context, spark=None) -> tuple[str, object]:
        """(status, result): what the handler gave, its error, or that it was cancelled; an unknown type is an error.

        With a session, the Spark jobs of the handler carry a tag, and go when the job is cancelled.
        """
        if kind not in self.specs:
            return "error", f"unknown job type {kind}"
        tag = f"job-{random.getrandbits(64):x}"
        if spark is not None:
            spark.addTag(tag)
        try:
            context.check()
            return "done", self.specs[kind].handler(context)
        except Cancelled:
            if spark is not None:
                spark.interruptTag(tag)
            return "cancelled", None
        except KeyboardInterrupt:
            return "interrupted", None
        except Exception as e:  # noqa: BLE001  a job's failure is its result
            return "error", str(e)[:500]
        finally:
            if spark is not None:
                spark.removeTag(tag)


def submit(jobs: DataFrame, new: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """Append jobs; a probe of a root that has one queued, or of which another comes along, is not submitted again.

    With ``kinds`` (the registered types), a job of any other type is refused with an error.
    """
    if kinds is not None and (strange := [r[0] for r in new.where(~F.col("type").isin(*kinds)).select("type").distinct().limit(5).collect()]):
        raise ValueError(f"unknown job types {sorted(map(str, strange))}")
    waiting = jobs.where("type = 'probe' AND status = 'queued'").select("root_id", "type").distinct()
    probes = new.where("type = 'probe'").join(waiting, ["root_id", "type"], "left_anti")
    row = F.struct(*[F.col(c) for c in jobs.columns])
    first = probes.groupBy("root_id", "type").agg(F.min_by(row, F.col("id")).alias("r")).select("r.*").select(*jobs.columns)
    others = new.where("type <> 'probe' OR type IS NULL")
    return jobs.unionByName(others.select(*jobs.columns)).unionByName(first)


def changed(jobs: DataFrame, ids: list[int], status: str) -> DataFrame:
    """Jobs with a new status where that change is allowed."""
    allowed = [s for s, to in CHANGES.items() if status in to]
    hit = F.col("id").isin(ids) & F.col("status").isin(allowed)
    return jobs.withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def cancel_queued(jobs: DataFrame) -> DataFrame:
    """All waiting jobs cancelled."""
    return jobs.withColumn("status", F.when(F.col("status") == "queued", "cancelled").otherwise(F.col("status")))


def shut_down(jobs: DataFrame) -> DataFrame:
    """What runs when the engine stops is interrupted; what waits stays."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def restarted(jobs: DataFrame) -> DataFrame:
    """Jobs as a start finds them: what ran is interrupted, and so is what waited to destroy something."""
    flag = lambda k: F.coalesce(F.get_json_object("params_json", f"$.{k}") == "true", F.lit(False))
    destructive = F.col("type").isin("dedup", "cleanup") & flag("confirm")
    stops = (F.col("status") == "running") | ((F.col("status") == "queued") & destructive)
    return jobs.withColumn("status", F.when(stops, "interrupted").otherwise(F.col("status")))


def rolled_back(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pending reviews whose first analysis was interrupted before anything was applied: they go, so that it can run again."""
    flag = lambda k: F.coalesce(F.get_json_object("params_json", f"$.{k}") == "true", F.lit(False))
    broken = jobs.where("status = 'running'").where((F.col("type") == "dedup") & ~flag("confirm") & ~flag("cancel") & ~flag("dry_run")).select("root_id").distinct()
    fresh = runs.where("status = 'pending' AND stage = 1 AND coalesce(phase, 'staged') <> 'applied'")
    return runs.join(fresh.join(broken, "root_id", "left_semi").select("run_id"), "run_id", "left_anti")


def prioritized(jobs: DataFrame, job_id: int) -> DataFrame:
    """A queued job before all other queued ones."""
    top = jobs.where("status = 'queued'").agg(F.coalesce(F.max("priority"), F.lit(0)) + 1).first()[0]
    return jobs.withColumn("priority", F.when((F.col("id") == job_id) & (F.col("status") == "queued"), F.lit(top)).otherwise(F.col("priority")).cast(jobs.schema["priority"].dataType))


def runnable(jobs: DataFrame, held: DataFrame) -> DataFrame:
    """The next job: highest priority, longest waiting, of a root that nothing holds."""
    return jobs.where("status = 'queued'").join(held, "root_id", "left_anti").orderBy(F.col("priority").desc(), "enqueued_at", "id").limit(1)


def pages(rows, per_page: int):
    """How many pages so many rows take, one at least."""
    return F.greatest(F.lit(1), F.ceil(rows / per_page)).cast("long")


def anchored_page(place, per_page: int, rows):
    """The page that shows the row at ``place`` (from 0), or the last one if that row has gone."""
    return F.least(F.floor(place / per_page), pages(rows, per_page) - 1).cast("long")


# Seconds of the shortest interval, the largest jitter, and how late a run may still start.
LEAST_INTERVAL, MOST_JITTER, GRACE = 900, 300, 3600


@dataclass(frozen=True)
class Periodic:
    """A job submitted again and again."""

    kind: str
    interval: float
    enabled: bool = True

    @property
    def every(self) -> float:
        return max(LEAST_INTERVAL, self.interval)

    @property
    def jitter(self) -> float:
        return min(MOST_JITTER, self.every / 2)


class Schedule:
    """Periodic jobs by name.  Runs that were missed are made up for once, and not at all when they are too late."""

    def __init__(self, seed: int = 0):
        self.tasks: dict[str, Periodic] = {}
        self._due: dict[str, float] = {}
        self._random = random.Random(seed)

    def add(self, task: Periodic, now: float) -> None:
        if task.kind in self.tasks:
            raise ValueError(f"{task.kind} is scheduled already")
        self.tasks[task.kind] = task
        self._due[task.kind] = self._next(task, now)

    def _next(self, task: Periodic, now: float) -> float:
        return now + task.every + self._random.uniform(0, task.jitter)

    def due(self, now: float) -> list[str]:
        """What is to be submitted now; each at most once, however many of its times have passed."""
        out = []
        for kind, task in self.tasks.items():
            if self._due[kind] <= now:
                if task.enabled and now - self._due[kind] <= GRACE:
                    out.append(kind)
                self._due[kind] = self._next(task, now)
        return out
