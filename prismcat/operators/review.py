"""Reviews of duplicates: what a stage holds, its statistics as numbers and text, and what a confirmation does.

``actions``: run_id, stage, kind, reason, default_action, asset_id, path, group_no, member_no, is_external, is_lead,
lead_reason, distance, shortcut_name.  ``runs``: run_id, root_id, run_type, status, stage, phase and the thresholds that
were taken down when the run began.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcat.functions import exprs as X

#: Thresholds of a run without usable ones (fixed values).
DEFAULTS = {"t_rec": 10, "t_edit": 32, "t_video": 90}
OPEN = 1_000_000_000
PERCEPTUAL_SUMS = ("groups", "members", "all_internal", "mixed", "suggest_external", "suggest_internal", "ks_delete", "ks_network")


def thresholds(runs: DataFrame) -> DataFrame:
    """run_id and the three thresholds; what is missing or no whole number has its default."""
    return runs.select("run_id", *[F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(d)).alias(c) for c, d in DEFAULTS.items()])


def current(actions: DataFrame, runs: DataFrame, assets: DataFrame) -> DataFrame:
    """The actions of each run's current stage with their medium; an asset that has gone counts as a photo."""
    here = actions.join(runs.select("run_id", "stage"), ["run_id", "stage"], "left_semi")
    medium = assets.select("asset_id", F.col("media_type").alias("medium"))
    return here.join(medium, "asset_id", "left").withColumn("medium", F.when(F.col("medium") == "video", "video").otherwise("photo"))


def counts(rows: DataFrame, is_network: Column) -> DataFrame:
    """Per run: to_delete_exact, groups, members, network.  Network counts what goes if nothing is changed, never what stays."""
    perceptual = F.col("kind") == "perceptual"
    return rows.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "exact").alias("to_delete_exact"),
        F.count_distinct(F.when(perceptual, F.col("group_no"))).alias("groups"),
        F.count_if(perceptual).alias("members"),
        F.count_if((F.col("default_action") == "delete") & is_network).alias("network"),
    )


def exact_split(rows: DataFrame) -> DataFrame:
    """Per run: files to delete, inside and outside the root, and groups that are internal only or mixed."""
    per = rows.where("kind = 'exact'").groupBy("run_id", "asset_id").agg(F.count(F.lit(1)).alias("n"), F.sum("is_external").alias("ext"), F.bool_or(F.col("reason") != "exact-internal").alias("mixed"))
    return per.groupBy("run_id").agg(
        F.sum("n").alias("to_delete"), F.sum(F.col("n") - F.col("ext")).alias("internal"), F.sum("ext").alias("external"),
        F.count_if(~F.col("mixed")).alias("groups_internal_only"), F.count_if("mixed").alias("groups_mixed"),
    )


def perceptual(rows: DataFrame, is_network: Column) -> DataFrame:
    """Per run: groups, members, what they are made of, whom the leads favour, and what keeping only leads would delete."""
    other = F.col("is_lead") == 0
    per = rows.where("kind = 'perceptual'").groupBy("run_id", "group_no").agg(
        F.count(F.lit(1)).alias("n"), F.max("is_external").alias("ext"), F.max(1 - F.col("is_external")).alias("int"), F.max("is_lead").alias("led"),
        F.max(F.when(~other, F.col("is_external"))).alias("lead_ext"), F.count_if(other).alias("rest"), F.count_if(other & is_network).alias("rest_network"),
    )
    mixed = (F.col("ext") == 1) & (F.col("int") == 1)
    return per.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("members"), F.count_if(F.col("ext") == 0).alias("all_internal"), F.count_if(mixed).alias("mixed"),
        F.count_if(mixed & (F.col("lead_ext") == 1)).alias("suggest_external"), F.count_if(mixed & (F.col("lead_ext") == 0)).alias("suggest_internal"),
        F.sum("rest").alias("ks_delete"), F.sum("rest_network").alias("ks_network"),
    )


def lead_tally(rows: DataFrame) -> DataFrame:
    """Per run, medium and what decided it: how many leads."""
    return rows.where("kind = 'perceptual' AND is_lead = 1").groupBy("run_id", "medium", F.coalesce("lead_reason", F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _thirds(lo: Column, hi: Column) -> list[tuple[Column, Column]]:
    n = hi - lo + 1
    cuts = [lo, lo + F.floor(n / 3), lo + F.floor(2 * n / 3), hi + 1]
    return [(a.cast("int"), (b - 1).cast("int")) for a, b in zip(cuts, cuts[1:])]


def bins(runs: DataFrame) -> DataFrame:
    """run_id, medium, bin, lo, hi of each run's current stage: thirds of its band, and an open one for videos."""
    t = thresholds(runs).join(runs.select("run_id", "stage"), "run_id")
    edit, rec, video = F.col("t_edit"), F.col("t_rec"), F.col("t_video")
    second, zero = F.col("stage") == 2, F.lit(0)
    photo = _thirds(F.when(second, zero).otherwise(rec + 1), F.when(second, rec).otherwise(edit))
    moving = [*_thirds(zero, video), (video + 1, F.lit(OPEN))]
    entry = lambda medium, k, lo, hi: F.struct(F.lit(medium).alias("medium"), F.lit(k).alias("bin"), lo.alias("lo"), hi.alias("hi"))
    photos = [entry("photo", k, lo, hi) for k, (lo, hi) in enumerate(photo)]
    videos = [F.when(second, entry("video", k, lo, hi)) for k, (lo, hi) in enumerate(moving)]
    return t.where("stage > 1").select("run_id", F.explode(F.array_compact(F.array(*photos, *videos))).alias("b")).select("run_id", "b.*")


def histogram(rows: DataFrame, bins_: DataFrame) -> DataFrame:
    """``bins_`` with n, the members whose distance lies in a bin; empty bins stay, distances in none go."""
    # one row per distance first: what meets the bins is small however many members there are
    each = rows.where("kind = 'perceptual' AND distance IS NOT NULL").groupBy("run_id", "medium", "distance").agg(F.count(F.lit(1)).alias("m"))
    met = bins_.join(each, ["run_id", "medium"], "left").withColumn("m", F.when(F.col("distance").between(F.col("lo"), F.col("hi")), F.col("m")).otherwise(0))
    return met.groupBy("run_id", "medium", "bin", "lo", "hi").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))


def bar_lines(filled: DataFrame, width: int = 90) -> DataFrame:
    """run_id, medium, bin, line: a label, a bar as long as its share of the fullest bin, and the count."""
    dash = F.lit("–")
    label = F.when(F.col("hi") >= OPEN, F.concat("lo", F.lit("+"))).when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat("lo", dash, "hi"))
    rows = filled.withColumn("label", label)
    per = rows.groupBy("run_id", "medium").agg(F.max("n").alias("peak"), F.max(F.length("label")).alias("label_w"))
    most = F.greatest(F.lit(4), F.least(F.lit(16), F.lit(width) - F.col("label_w") - 8))
    bar = F.when(F.col("peak") > 0, F.repeat(F.lit("█"), F.bround(most * F.col("n") / F.col("peak")).cast("int"))).otherwise("")
    line = F.rtrim(F.concat(F.lit("  "), F.rpad("label", F.col("label_w"), F.lit(" ")), F.lit(" "), bar, F.lit(" "), "n"))
    return rows.join(per, ["run_id", "medium"]).select("run_id", "medium", "bin", F.when(F.col("peak") > 0, line).when(F.col("bin") == 0, "  (none)").alias("line")).where("line IS NOT NULL")


def _makeup(internal: Column, mixed: Column, name: str) -> Column:
    return F.format_string(f"group make-up:  %d {name} · %d mixed (internal+external)", internal, mixed)


def exact_lines(split: DataFrame) -> DataFrame:
    """run_id, no, line of the exact stage."""
    first = F.format_string("to delete (exact): %d file(s)  ·  %d internal, %d external", "to_delete", "internal", "external")
    lines = F.array(first, _makeup(F.col("groups_internal_only"), F.col("groups_mixed"), "internal-only"))
    return split.select("run_id", F.posexplode(lines).alias("no", "line")).select("run_id", "no", F.concat(F.lit("  "), "line").alias("line"))


def group_lines(bundle: DataFrame, ranked: Column) -> DataFrame:
    """run_id, no, line of the group stages: size, make-up, and, where leads are suggested, whom they favour and the tip."""
    size = F.format_string("%d near-dup groups / %d members (default-keep)", "groups", "members")
    favour = F.when(ranked, F.format_string("  of the %d mixed groups →  %d suggest external · %d suggest internal", "mixed", "suggest_external", "suggest_internal"))
    favour = F.when(F.col("mixed") > 0, F.coalesce(favour, F.format_string("  of the %d mixed groups, an external copy is present", "mixed")))
    network = F.when(F.col("ks_network") > 0, F.format_string(" (%d on network)", "ks_network")).otherwise("")
    tip = F.when(ranked & (F.col("ks_delete") > 0), F.concat(F.format_string("tip: confirm · keep suggested — deletes %d non-leads", "ks_delete"), network))
    lines = F.array_compact(F.array(size, _makeup(F.col("all_internal"), F.col("mixed"), "all-internal"), favour, tip))
    return bundle.select("run_id", F.posexplode(lines).alias("no", "line")).select("run_id", "no", F.concat(F.lit("  "), "line").alias("line"))


def first_stage(planned: DataFrame, start: Column) -> DataFrame:
    """run_id, next_stage: the first stage from ``start`` on that has actions, null if none has.  ``planned``: run_id, stage, n."""
    return planned.groupBy("run_id").agg(F.min(F.when((F.col("stage") >= start) & (F.col("n") > 0), F.col("stage"))).alias("next_stage"))


def intended(actions: DataFrame, present: DataFrame, keep_suggested: bool = False) -> DataFrame:
    """The actions that delete: exact ones whose shortcut is still there, others whose shortcut is gone; or all but the leads."""
    if keep_suggested:
        led = actions.where("is_lead = 1").select("run_id", "stage", "group_no").distinct()
        return actions.where("is_lead = 0").join(led, ["run_id", "stage", "group_no"], "left_semi")
    there = present.select("run_id", "stage", "shortcut_name").distinct()
    keys = ["run_id", "stage", "shortcut_name"]
    return actions.where("stage = 1").join(there, keys, "left_semi").unionByName(actions.where("stage > 1").join(there, keys, "left_anti"))


def materialized(plan: DataFrame, live: DataFrame) -> DataFrame:
    """``plan`` (asset_id, path, survivor, ...) as it can be staged: vanished files go, and where the survivor has vanished the
    first file left takes its place.  ``live``: the paths that exist."""
    alive = live.select(F.col("path").alias("_p")).distinct()
    here = plan.join(alive, F.col("path") == F.col("_p"), "left_semi")
    kept = here.join(alive, F.col("survivor") == F.col("_p"), "left").withColumn("_dead", F.col("_p").isNull()).drop("_p")
    heir = kept.where("_dead").groupBy("asset_id").agg(F.min("path").alias("_heir"))
    return kept.join(heir, "asset_id", "left").where("NOT _dead OR path <> _heir").withColumn("survivor", F.when(F.col("_dead"), F.col("_heir")).otherwise(F.col("survivor"))).drop("_dead", "_heir")


def dispositions(deletions: DataFrame, results: DataFrame, is_network: Column) -> DataFrame:
    """``deletions`` with disposition and recycle.  ``results``: path, result (done, missing, or an error's text); no result is missing."""
    told = results.select(F.col("path").alias("_p"), "result").dropDuplicates(["_p"])
    rows = deletions.join(told, F.col("path") == F.col("_p"), "left").drop("_p")
    result = F.coalesce("result", F.lit("missing"))
    state = F.when(result == "done", "deleted").when(result == "missing", "already-gone").otherwise(F.concat(F.lit("error: "), result))
    return rows.withColumn("disposition", state).withColumn("recycle", F.when(state == "deleted", F.when(is_network, "permanent").otherwise("recycle-bin"))).drop("result")


def outcome(done: DataFrame, is_network: Column) -> DataFrame:
    """Per run: files deleted by kind, of them outside the root and for good, files that had gone, and errors."""
    deleted = F.col("disposition") == "deleted"
    return done.groupBy("run_id").agg(
        F.count_if(deleted & (F.col("kind") == "exact")).alias("exact_deleted"), F.count_if(deleted & (F.col("kind") == "perceptual")).alias("perceptual_deleted"),
        F.count_if(deleted & (F.col("is_external") == 1)).alias("external_deleted"), F.count_if(deleted & is_network).alias("network_deleted"),
        F.count_if(F.col("disposition") == "already-gone").alias("already_gone"), F.count_if(F.startswith("disposition", F.lit("error"))).alias("errors"),
    )


def result_text(action: Column, status: Column, stage: Column, applied_stage: Column, deleted: Column, counts_: Column) -> Column:
    """A review job's outcome as one line; ``counts_``: the phrase of what the current stage holds."""
    went = F.format_string("%s: applied stage %d (%d deleted) · ", action, applied_stage, deleted)
    confirm, pending = action == "confirm", status == "pending"
    return (
        F.when(pending & confirm, F.concat(went, F.format_string("advanced to stage %d · ", stage), counts_))
        .when(pending, F.concat(action, F.format_string(": staged stage %d · ", stage), counts_))
        .when((status == "completed") & (action == "analyze"), "analyze: already clean (nothing to review)")
        .when((status == "completed") & confirm, F.concat(went, F.lit("run completed")))
        .otherwise(F.concat(action, F.lit(": run "), status))
    )


def count_text(stage: Column, exact: Column, groups: Column, members: Column) -> Column:
    """What a stage holds: exact copies in the first, groups and members in the others."""
    return F.when(stage == 1, F.format_string("%d exact", exact)).otherwise(F.format_string("%d grp/%d mbr", groups, members))


def applied(done: DataFrame, assets: DataFrame, instances: DataFrame) -> DataFrame:
    """asset_id, fate of the assets that a confirmation changes: trashed, when a group stage deleted the last file of an
    active asset; forgotten, when its last file had gone by itself or as an exact copy."""
    removed = done.where("disposition IN ('deleted', 'already-gone')")
    left = instances.join(removed.select("path"), "path", "left_anti").select("asset_id").distinct()
    hit = removed.groupBy("asset_id").agg(F.bool_or((F.col("kind") == "perceptual") & (F.col("disposition") == "deleted")).alias("chosen"))
    empty = assets.where("status = 'active'").select("asset_id").join(hit, "asset_id").join(left, "asset_id", "left_anti")
    return empty.select("asset_id", F.when(F.col("chosen"), "trashed").otherwise("forgotten").alias("fate"))


def cards(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """id, state, live_stage of review jobs: current, advanced or closed, null where nothing waits for a review.

    ``jobs``: id, type, root_id, review_status, stage, run_id as the job's result froze them.  The run is the one named,
    else the newest of the root and type.
    """
    kind = F.when(F.col("type") == "cleanup", "cleanup-perceptual").otherwise("dedup")
    waiting = jobs.where("review_status = 'pending'").withColumn("_kind", kind)
    named = runs.select(F.col("run_id"), F.struct("status", "stage").alias("_named"))
    newest = runs.groupBy("root_id", F.col("run_type").alias("_kind")).agg(F.max_by(F.struct("status", "stage"), "run_id").alias("_newest"))
    rows = waiting.join(named, "run_id", "left").join(newest, ["root_id", "_kind"], "left").withColumn("_run", F.coalesce("_named", "_newest"))
    pending = F.coalesce(F.col("_run.status") == "pending", F.lit(False))
    moved = F.coalesce(F.col("stage") != F.col("_run.stage"), F.lit(False))
    state = F.when(~pending, "closed").when(moved, "advanced").otherwise("current")
    told = rows.select("id", state.alias("state"), F.when(pending, F.col("_run.stage")).alias("live_stage"))
    return jobs.select("id").join(told, "id", "left")


def low_confidence(edges: DataFrame, quality: DataFrame, hint: int) -> DataFrame:
    """id, distance, quality, low_confidence per member: nearest neighbour, and whether it or a neighbour is below the hint.

    ``quality``: id, quality; null never flags.  It may be as large as the catalog whatever its file's size, so it is never broadcast.
    """
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "distance").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "distance"))
    poor = F.coalesce(F.col("quality") < hint, F.lit(False))
    near = ends.join(quality.select(F.col("id").alias("other"), poor.alias("poor")).hint("merge"), "other", "left")
    per = near.groupBy("id").agg(F.min("distance").alias("distance"), F.coalesce(F.bool_or("poor"), F.lit(False)).alias("poor"))
    return per.join(quality.hint("merge"), "id", "left").select("id", "distance", "quality", (F.col("poor") | poor).alias("low_confidence"))


def is_network(column: str = "path") -> Column:
    """The predicate that the statistics take for a place without a recycle bin."""
    return X.is_network(F.col(column))
