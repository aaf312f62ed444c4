"""Jobs that change a library, each one commit of new tables to the store: scan, trash, merge, duplicate reviews, cleanup.

Tables: ``roots`` (root_id, path, kind, enabled, needs_dedup, probe_new), ``assets`` (asset_id, hash, status, size,
undecodable, complete, media_type, pixels), ``instances`` (root_id, path, asset_id, size, mtime), ``edges`` (a, b,
media_type, distance, algo, created_at), ``runs`` (run_id, root_id, run_type, status, stage, phase, prefer_internal, t_rec,
t_edit, t_video, deleted_count) and ``actions`` (see ``operators.review``).  What touches files happens outside: a job
gives the plan, and takes what became of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.functions import exprs as X
from prismcat.operators import rank, reconcile, review, scan
from prismcat.operators.cluster import connected_components
from prismcat.operators.store import Store, placed_names
from prismcat.plans.scratch import Scratch, numbered

ACTIONS = (
    "run_id int, stage int, kind string, reason string, default_action string, asset_id long, path string, survivor string, group_no long, "
    "member_no int, is_external int, is_lead int, lead_reason string, distance int, shortcut_name string"
)


class Library:
    """A store with the jobs that may change it."""

    def __init__(self, store: Store, t_rec: int = 10, t_edit: int = 32, t_video: int = 90):
        self.store, self.spark = store, store.spark
        self.bands = {"t_rec": t_rec, "t_edit": t_edit, "t_video": t_video}

    def _table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _hold(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` as it is now, whatever the store's next version is."""
        return Scratch(self.spark, "library").write(df, label)

    # --- scan -----------------------------------------------------------------------------------------------------

    def scan(self, root_ids: list[int], incoming: DataFrame, suppressed: DataFrame, full: bool = False) -> DataFrame:
        """Take in what a walk of the roots found (see ``operators.scan``); the report per root."""
        roots, assets, instances = (self._table(t) for t in ("roots", "assets", "instances"))
        resolved = self._hold(scan.resolve(incoming, assets, full), "resolved")
        made = scan.created(resolved, assets).withColumn("media_type", F.lit("photo")).withColumn("pixels", F.lit(0).cast("long"))
        later = self._hold(scan.backfilled(assets, resolved).unionByName(made.select(*assets.columns)), "assets")
        attached = scan.attached(instances, resolved, later)
        ours = attached.where(F.col("root_id").isin(root_ids))
        missing = ours.join(incoming.select("root_id", "path"), ["root_id", "path"], "left_anti")
        gone = missing.join(reconcile.below(missing, suppressed), ["root_id", "path"], "left_anti").select("root_id", "path")
        kept = self._hold(attached.join(gone, ["root_id", "path"], "left_anti"), "instances")
        lost = scan.forgotten(later, instances.unionByName(attached), kept)
        dirty = scan.dirty_roots(resolved).withColumn("_dirty", F.lit(1))
        walked = F.col("root_id").isin(root_ids)
        after = roots.join(dirty, "root_id", "left").withColumns(
            {"needs_dedup": F.coalesce("_dirty", "needs_dedup"), "probe_new": F.when(walked, 0).otherwise(F.col("probe_new"))}
        )
        self.store.commit({"assets": later.join(lost, "asset_id", "left_anti"), "instances": kept, "roots": after.select(*roots.columns)})
        return scan.report(resolved, self._table("assets"), self._table("instances"))

    # --- trash ----------------------------------------------------------------------------------------------------

    def refresh_trash(self, inbox: DataFrame) -> DataFrame:
        """Remember the contents of trash folders (hash, rel, size); the files, with their outcome, may be deleted afterwards."""
        assets = self._table("assets")
        told = self._hold(reconcile.absorb(inbox, assets.select("hash", "status")), "trash")
        top = assets.agg(F.coalesce(F.max("asset_id"), F.lit(0))).first()[0]
        new = numbered(told.where("outcome = 'new_trashed'").select("hash", "size"), ["hash"], "nth")
        rows = {"asset_id": F.col("nth") + top, "status": F.lit("trashed"), "undecodable": F.lit(0), "complete": F.lit(False), "media_type": F.lit("photo"), "pixels": F.lit(0).cast("long")}
        flipped = told.where("outcome = 'flipped'").select("hash", F.lit("trashed").alias("_s"))
        old = assets.join(flipped, "hash", "left").withColumn("status", F.coalesce("_s", "status")).select(*assets.columns)
        self.store.commit({"assets": old.unionByName(new.withColumns(rows).select(*assets.columns))})
        return told

    def untrash(self, files: DataFrame) -> DataFrame:
        """Bring contents (hash, rel) back: active if a file is left, else forgotten."""
        assets, instances = self._table("assets"), self._table("instances")
        counts = instances.join(assets.select("asset_id", "hash"), "asset_id").groupBy("hash").agg(F.count(F.lit(1)).alias("instances"))
        told = self._hold(reconcile.untrash(files, assets.select("hash", "status"), counts), "untrash")
        back = told.where("outcome = 'untrashed'").select("hash", F.lit("active").alias("_s"))
        drop = told.where("outcome = 'forgotten'").select("hash")
        self.store.commit({"assets": assets.join(drop, "hash", "left_anti").join(back, "hash", "left").withColumn("status", F.coalesce("_s", "status")).select(*assets.columns)})
        return told

    # --- merge ----------------------------------------------------------------------------------------------------

    def merge_plan(self, incoming: DataFrame, root_id: int, ignore: list[str] = ()) -> DataFrame:
        """What becomes of source files (hash, rel, mtime, size): class, the place of a copy, and its state after registration."""
        assets, instances = self._table("assets"), self._table("instances")
        root = self._table("roots").where(F.col("root_id") == root_id).first()
        told = self._hold(reconcile.classify(incoming, assets.select("hash", "status")), "merge")
        base = F.lit(root.path.rstrip("/") + "/")
        split = lambda c: (F.regexp_replace(c, "/?[^/]*$", ""), F.regexp_extract(c, "([^/]*)$", 1))
        folder, name = split(F.col("rel"))
        held = instances.where(F.col("root_id") == root_id).join(assets.select("asset_id", "hash"), "asset_id").withColumn("rel", F.substring("path", len(root.path.rstrip("/")) + 2, 1 << 20))
        taken_folder, taken_name = split(F.col("rel"))
        new = told.where("class = 'new'").select(folder.alias("folder"), name.alias("name"), "hash")
        placed = placed_names(new, held.select(taken_folder.alias("folder"), taken_name.alias("name"), "hash"))
        to = placed.select("hash", F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), "placed").alias("to"), "reused")
        rows = told.join(to, "hash", "left").withColumn("to", F.when(F.col("class") == "new", F.col("to")))
        hidden = X.ignored(F.col("to"), [*X.BUILTIN_GLOBS, *ignore])
        state = F.when(F.col("class") != "new", "skipped").when(hidden, "copied-unindexed").otherwise("registered")
        return rows.select("hash", "rel", "size", "mtime", "class", F.concat(base, "to").alias("dest"), "reused", state.alias("state"))

    def register(self, items: DataFrame, root_id: int) -> None:
        """Take copied files into the catalog: items of state ``registered``, as planned."""
        roots, assets, instances = (self._table(t) for t in ("roots", "assets", "instances"))
        done = self._hold(items.where("state = 'registered'"), "items")
        top = assets.agg(F.coalesce(F.max("asset_id"), F.lit(0))).first()[0]
        fresh = done.join(assets.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.max("size").alias("size"))
        rows = {"asset_id": F.col("nth") + top, "status": F.lit("active"), "undecodable": F.lit(0), "complete": F.lit(False), "media_type": F.lit("photo"), "pixels": F.lit(0).cast("long")}
        later = self._hold(assets.unionByName(numbered(fresh, ["hash"], "nth").withColumns(rows).select(*assets.columns)), "assets")
        new = done.join(later.select("hash", "asset_id"), "hash").select(F.lit(root_id).cast(instances.schema["root_id"].dataType).alias("root_id"), F.col("dest").alias("path"), "asset_id", "size", "mtime")
        changed = {"assets": later, "instances": reconcile.upsert(instances, new.select(*instances.columns), ["root_id", "path"])}
        if not done.isEmpty():
            changed["roots"] = roots.withColumn("needs_dedup", F.when(F.col("root_id") == root_id, 1).otherwise(F.col("needs_dedup")))
        self.store.commit(changed)

    # --- duplicate reviews ----------------------------------------------------------------------------------------

    def _members(self, root_id: int) -> DataFrame:
        """Files of active assets that have one in the root."""
        instances, assets = self._table("instances"), self._table("assets").where("status = 'active'")
        ours = instances.where(F.col("root_id") == root_id).select("asset_id")
        rows = instances.join(ours, "asset_id", "left_semi").join(assets.select("asset_id", "media_type", "pixels", F.col("size").alias("asset_size")), "asset_id")
        return rows.withColumn("is_external", (F.col("root_id") != root_id).cast("int"))

    def plan_stage(self, root_id: int, run_id: int, stage: int, prefer_internal: bool) -> DataFrame:
        """The actions of one stage."""
        blank = self.spark.createDataFrame([], ACTIONS)
        if stage == 1:
            plan = numbered(rank.exact_plan(self._members(root_id).select("asset_id", "path", "mtime", "is_external"), prefer_internal), ["asset_id", "path"], "nth")
            values = {"kind": F.lit("exact"), "default_action": F.lit("delete"), "is_lead": F.lit(0), "shortcut_name": X.shortcut(F.col("nth"), 3)}
            rows = plan.withColumns(values)
        else:
            lo, hi = (-1, self.bands["t_rec"]) if stage == 2 else (self.bands["t_rec"], self.bands["t_edit"])
            active = self._table("assets").where("status = 'active'").select("asset_id")
            ours = self._table("instances").where(F.col("root_id") == root_id).select("asset_id").distinct()
            video = (F.col("media_type") == "video") & F.lit(stage == 2)
            near = self._table("edges").where(video | ((F.col("media_type") == "photo") & (F.col("distance") > lo) & (F.col("distance") <= hi)))
            for end in ("a", "b"):
                near = near.join(active.withColumnRenamed("asset_id", end), end, "left_semi")
            marks = ours.withColumn("_o", F.lit(True))
            near = near.join(marks.toDF("a", "_a"), "a", "left").join(marks.toDF("b", "_b"), "b", "left").where("_a OR _b").select("a", "b", "distance")
            near = self._hold(near, "edges")
            groups = connected_components(near)
            firsts = numbered(groups.where("node = component").select("component"), ["component"], "group_no")
            instances, assets = self._table("instances"), self._table("assets")
            live = rank.representative(instances.join(groups.select(F.col("node").alias("asset_id")), "asset_id", "left_semi"), root_id)
            live = live.withColumn("is_external", (F.col("root_id") != root_id).cast("int")).join(assets.select("asset_id", "pixels", F.col("size").alias("asset_size")), "asset_id")
            rows = live.join(groups.toDF("asset_id", "component"), "asset_id").join(firsts, "component").withColumn("format", X.format_rank(F.col("path")))
            from pyspark.sql import Window

            rows = rows.withColumn("member_no", F.row_number().over(Window.partitionBy("group_no").orderBy("asset_id")))
            if stage == 2:
                keys = ["pixels", "format", "asset_size"]
                rows = rank.leads(rows.withColumn("_p", F.abs(F.col("is_external") - int(prefer_internal))), keys, "_p")
                level = rank.levels(rows, keys, ["resolution", "format", "size"], "_p").select("group_no", F.col("level").alias("lead_reason"))
                rows = rows.join(level, "group_no").withColumn("lead_reason", F.when(F.col("is_lead") == 1, F.col("lead_reason")))
            else:
                rows = rows.withColumn("is_lead", F.lit(0))
            ends = near.select(F.col("a").alias("asset_id"), "distance").unionByName(near.select(F.col("b").alias("asset_id"), "distance"))
            rows = rows.join(ends.groupBy("asset_id").agg(F.min("distance").alias("distance")), "asset_id", "left")
            name = X.group_shortcut(F.col("group_no"), F.col("member_no"), F.col("is_lead"), F.col("is_external"))
            rows = rows.withColumns({"kind": F.lit("perceptual"), "reason": F.lit("perceptual"), "default_action": F.lit("keep"), "shortcut_name": name})
        rows = rows.withColumns({"run_id": F.lit(run_id), "stage": F.lit(stage)})
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in blank.schema.fields])

    def _stage_from(self, root_id: int, run_id: int, start: int, prefer_internal: bool) -> tuple[int, DataFrame] | None:
        for stage in range(start, 4):
            plan = self._hold(self.plan_stage(root_id, run_id, stage, prefer_internal), f"stage{stage}")
            if not plan.isEmpty():
                return stage, plan
        return None

    def _run(self, root_id: int):
        return self._table("runs").where((F.col("root_id") == root_id) & (F.col("run_type") == "dedup") & (F.col("status") == "pending")).first()

    def _with_run(self, run_id: int, **values) -> DataFrame:
        runs = self._table("runs")
        mine = F.col("run_id") == run_id
        return runs.withColumns({c: F.when(mine, F.lit(v).cast(runs.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})

    def _clean(self, root_id: int) -> DataFrame:
        return self._table("roots").withColumn("needs_dedup", F.when(F.col("root_id") == root_id, 0).otherwise(F.col("needs_dedup")))

    def analyze(self, root_id: int, prefer_internal: bool = False) -> int | None:
        """Open a review of a root at its first stage that holds something; None if the root is clean."""
        if self._run(root_id):
            raise ValueError("the root has a review already")
        runs, actions = self._table("runs"), self._table("actions")
        run_id = runs.agg(F.coalesce(F.max("run_id"), F.lit(0)) + 1).first()[0]
        found = self._stage_from(root_id, run_id, 1, prefer_internal)
        stage, plan = found or (1, None)
        new = {"run_id": run_id, "root_id": root_id, "run_type": "dedup", "status": "pending" if found else "completed", "stage": stage, "phase": "staged" if found else "applied",
               "prefer_internal": int(prefer_internal), "deleted_count": 0, **(self.bands if found else dict.fromkeys(self.bands))}
        row = self.spark.range(1).select(*[F.lit(new[f.name]).cast(f.dataType).alias(f.name) for f in runs.schema.fields])
        changed = {"runs": runs.unionByName(row)}
        if found:
            changed["actions"] = actions.unionByName(plan)
        else:
            changed["roots"] = self._clean(root_id)
        self.store.commit(changed)
        return stage if found else None

    def dry_run(self, root_id: int, prefer_internal: bool = False) -> dict[int, int]:
        """Actions by stage, nothing written."""
        return {s: self.plan_stage(root_id, 0, s, prefer_internal).count() for s in (1, 2, 3)}

    def confirm(self, root_id: int, present: DataFrame, results: DataFrame, keep_suggested: bool = False) -> dict:
        """Apply the current stage (``present``: shortcuts that are still there; ``results``: what became of the files) and go on."""
        run = self._run(root_id)
        if run is None:
            raise ValueError("nothing to confirm")
        if keep_suggested and run.stage != 2:
            raise ValueError("only the second stage suggests leads")
        deleted = 0
        if run.phase != "applied":
            self.store.backup(f"run{run.run_id}-stage{run.stage}")
            here = self._table("actions").where((F.col("run_id") == run.run_id) & (F.col("stage") == run.stage))
            wanted = review.intended(here, present, keep_suggested)
            done = self._hold(review.dispositions(wanted, results, X.is_network(F.col("path"))), "done")
            assets, instances = self._table("assets"), self._table("instances")
            fate = self._hold(review.applied(done, assets, instances), "fate")
            removed = done.where("disposition IN ('deleted', 'already-gone')").select("path")
            trashed = fate.where("fate = 'trashed'").select("asset_id", F.lit("trashed").alias("_s"))
            left = assets.join(fate.where("fate = 'forgotten'").select("asset_id"), "asset_id", "left_anti").join(trashed, "asset_id", "left").withColumn("status", F.coalesce("_s", "status"))
            deleted = done.where("disposition = 'deleted'").count()
            self.store.commit(
                {"assets": left.select(*assets.columns), "instances": instances.join(removed, "path", "left_anti").select(*instances.columns), "runs": self._with_run(run.run_id, phase="applied", deleted_count=run.deleted_count + deleted)}
            )
        found = self._stage_from(root_id, run.run_id, run.stage + 1, bool(run.prefer_internal))
        if found is None:
            self.store.commit({"runs": self._with_run(run.run_id, status="completed"), "roots": self._clean(root_id)})
            return {"confirmed_stage": run.stage, "deleted": deleted, "stage": None}
        stage, plan = found
        others = self._table("actions").where(~((F.col("run_id") == run.run_id) & (F.col("stage") == stage)))
        self.store.commit({"actions": others.unionByName(plan), "runs": self._with_run(run.run_id, stage=stage, phase="staged")})
        return {"confirmed_stage": run.stage, "deleted": deleted, "stage": stage}

    def cancel(self, root_id: int) -> None:
        """Close a review; nothing is deleted."""
        if run := self._run(root_id):
            self.store.commit({"runs": self._with_run(run.run_id, status="cancelled")})

    # --- cleanup --------------------------------------------------------------------------------------------------

    def cleanup_plan(self, root_id: int, mode: str) -> DataFrame:
        """Files (asset_id, path, kind) that a one-shot cleanup deletes: of trashed contents, or of undecodable ones."""
        what = {"exact": "status = 'trashed'", "undecodable": "undecodable = 1 AND status = 'active'"}[mode]
        bad = self._table("assets").where(what).select("asset_id")
        kind = "exact" if mode == "exact" else "perceptual"
        return self._table("instances").where(F.col("root_id") == root_id).join(bad, "asset_id", "left_semi").select("asset_id", "path", F.lit(kind).alias("kind"))

    def cleanup(self, root_id: int, mode: str, results: DataFrame) -> dict[str, int]:
        """Apply a one-shot cleanup; files by disposition."""
        self.store.backup(f"cleanup-{mode}-{root_id}")
        done = self._hold(review.dispositions(self.cleanup_plan(root_id, mode), results, X.is_network(F.col("path"))), "done")
        assets, instances = self._table("assets"), self._table("instances")
        fate = review.applied(done, assets, instances).select("asset_id", F.lit("trashed").alias("_s"))
        removed = done.where("disposition IN ('deleted', 'already-gone')").select("path")
        self.store.commit({"assets": assets.join(fate, "asset_id", "left").withColumn("status", F.coalesce("_s", "status")).select(*assets.columns), "instances": instances.join(removed, "path", "left_anti").select(*instances.columns)})
        kind = F.when(F.startswith("disposition", F.lit("error")), "error").otherwise(F.col("disposition"))
        return {r[0]: r[1] for r in done.groupBy(kind).count().collect()}
