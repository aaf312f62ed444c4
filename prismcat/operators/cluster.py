"""Connected components by hooking and pointer jumping.

Every live component root takes the smallest root among its neighbours as its
parent; pointer jumping flattens the resulting forest; edges are relabelled to
roots and edges inside one component go.  The edge table shrinks each round,
so the rounds are logarithmic in the longest chain.  No group is ever gathered:
minima are partial aggregates, and every other step is an equi join of two
written tables, which adaptive execution can split where a root is hot.  A write
counts its rows as it goes, so no job only asks whether a round was the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from prismcat.plans.scratch import Scratch


def _counted(scratch: Scratch, df: DataFrame, what, label: str) -> tuple[DataFrame, int]:
    """``df`` written, and how many of its rows hold ``what``."""
    seen, n = Observation(), F.coalesce(F.sum(what.cast("long")), F.lit(0)).alias("n")
    out = scratch.write(df.observe(seen, n), label)
    # a plan that turns out to be empty may lose its observation
    told = seen.get
    return out, int(told["n"] if "n" in told else out.select(n).first()[0])


def _flatten(scratch: Scratch, forest: DataFrame) -> DataFrame:
    """Point every ``node`` of (node, parent) at its root, two jumps to a write."""
    while True:
        one = forest.toDF("parent", "up")
        two = forest.toDF("up", "top")
        jumped = forest.join(one, "parent", "left").join(two, "up", "left").select("node", F.coalesce("top", "up", "parent").alias("to"), "parent")
        written, moved = _counted(scratch, jumped, F.col("to") != F.col("parent"), "jump")
        scratch.drop(forest)
        forest = written.select("node", F.col("to").alias("parent"))
        forest._scratch_path = written._scratch_path
        if not moved:
            return forest


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of an undirected edge table.

    ``component`` is the smallest node reachable.  Self loops and repeated
    edges change nothing (a node with only self loops is a component of its
    own); rows with a null end are ignored; an empty table gives no rows.
    With ``scratch`` the written tables are the caller's, who may drop them.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    live, left = _counted(
        scratch,
        edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where("_a IS NOT NULL AND _b IS NOT NULL")
        .select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v"))
        .distinct(),
        F.lit(True),
        "edges",
    )
    labels = None
    while True:
        both = live.select(F.col("u").alias("node"), F.col("v").alias("m")).union(live.select("v", "u"))
        hooks = scratch.write(both.groupBy("node").agg(F.least(F.col("node"), F.min("m")).alias("parent")), "hooks")
        roots = _flatten(scratch, hooks)
        if labels is None:
            labels = roots.toDF("node", "component")
        else:
            last = labels
            labels = scratch.write(labels.join(roots.toDF("component", "_p"), "component", "left").select("node", F.coalesce("_p", "component").alias("component")), "labels")
            scratch.drop(last)
        if not left:
            return labels
        last = live
        live, left = _counted(
            scratch,
            live.where("u <> v")
            .join(roots.toDF("u", "pu"), "u")
            .join(roots.toDF("v", "pv"), "v")
            .where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct(),
            F.lit(True),
            "edges",
        )
        scratch.drop(last)
        if not left:
            return labels
