"""Jobs of a library from scan to cleanup, on a store of their own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prismcat.operators import scan
from prismcat.operators.store import Conflict, Store
from prismcat.plans.lifecycle import ACTIONS, Library

ROOTS = "root_id int, path string, kind string, enabled int, needs_dedup int, probe_new int"
ASSETS = "asset_id long, hash string, status string, size long, undecodable int, complete boolean, media_type string, pixels long"
INSTANCES = "root_id int, path string, asset_id long, size long, mtime double"
EDGES = "a long, b long, media_type string, distance int, algo string, created_at string"
RUNS = "run_id int, root_id int, run_type string, status string, stage int, phase string, prefer_internal int, t_rec int, t_edit int, t_video int, deleted_count long"
INCOMING = "root_id int, path string, hash string, size long, mtime double, readable boolean, decodable boolean"


@pytest.fixture
def library(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    make = spark.createDataFrame
    store.commit(
        {
            "roots": make([(1, "/lib", "library", 1, 0, 5), (2, "/ext", "library", 1, 0, 0)], ROOTS),
            "assets": make([], ASSETS), "instances": make([], INSTANCES), "edges": make([], EDGES), "runs": make([], RUNS), "actions": make([], ACTIONS),
        }
    )
    return Library(store)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def listed(spark, *files):
    """Files as (root, path, hash[, readable, decodable])."""
    full = [(r, p, h, 10, 1.0, *(more or (True, True))) for r, p, h, *more in files]
    return spark.createDataFrame(full, INCOMING)


def nothing(spark):
    return spark.createDataFrame([], "root_id int, dir string")


def test_scan_writes_everything(spark, library):
    s = library.store
    library.scan([1, 2], listed(spark, (1, "/lib/a", "A"), (1, "/lib/a2", "A"), (1, "/lib/b", "B"), (1, "/lib/bad", "X", True, False), (2, "/ext/c", "C"), (1, "/lib/no", None, False, True)), nothing(spark))
    assert rows(s.read("assets"), "hash", "status", "undecodable") == [("A", "active", 0), ("B", "active", 0), ("C", "active", 0), ("X", "active", 1)]
    assert rows(s.read("roots"), "root_id", "needs_dedup", "probe_new") == [(1, 1, 0), (2, 1, 0)]
    assert rows(s.read("instances"), "path") == [("/ext/c",), ("/lib/a",), ("/lib/a2",), ("/lib/b",), ("/lib/bad",)]
    # b is edited in place, a2 gone, c below a folder that could not be read
    unread = spark.createDataFrame([(2, "/ext")], "root_id int, dir string")
    report = library.scan([1, 2], listed(spark, (1, "/lib/a", "A"), (1, "/lib/b", "D"), (1, "/lib/bad", "X", True, False)), unread)
    assert rows(report, "root_id", "new", "exact_dup", "errors", "undecodable") == [(1, 1, 2, 0, 1)]
    assert rows(s.read("assets"), "hash") == [("A",), ("C",), ("D",), ("X",)]
    assert rows(s.read("instances"), "path") == [("/ext/c",), ("/lib/a",), ("/lib/b",), ("/lib/bad",)]


def test_resolve_ladder(spark):
    assets = spark.createDataFrame([("K", 1, "active", 0, True), ("T", 2, "trashed", 0, True), ("L", 3, "active", 0, False), ("U", 4, "active", 1, True), ("M", 5, "trashed", 0, False)], "hash string, asset_id long, status string, undecodable int, complete boolean")
    files = listed(spark, *[(1, f"/{h}{k}", h) for h in "KTLUMN" for k in (1, 2)], (1, "/e", None, False, True), (1, "/x", "N2", True, False))
    got = {r.path: r.outcome for r in scan.resolve(files, assets).collect()}
    want = {"/K1": "exact_dup", "/K2": "exact_dup", "/T1": "matches_trashed", "/T2": "matches_trashed", "/L1": "backfilled", "/L2": "exact_dup", "/U1": "exact_dup", "/U2": "exact_dup",
            "/M1": "matches_trashed", "/M2": "matches_trashed", "/N1": "new", "/N2": "exact_dup", "/e": "errors", "/x": "undecodable"}
    assert got == want
    assert {r.path: r.outcome for r in scan.resolve(files, assets, full=True).collect()} == want | {"/U1": "backfilled"}


def test_review_from_analysis_to_completion(spark, library):
    s = library.store
    library.scan([1, 2], listed(spark, (1, "/lib/a", "A"), (2, "/ext/a", "A"), (1, "/lib/b.png", "B"), (1, "/lib/b.jpg", "C"), (1, "/lib/e", "E"), (1, "/lib/f", "F")), nothing(spark))
    ids = {r.hash: r.asset_id for r in s.read("assets").collect()}
    edge = lambda x, y, d: (min(ids[x], ids[y]), max(ids[x], ids[y]), "photo", d, "pdq", "now")
    s.commit({"edges": spark.createDataFrame([edge("B", "C", 4), edge("E", "F", 20), edge("B", "E", 40)], EDGES)})
    assert library.dry_run(1) == {1: 1, 2: 2, 3: 2}
    assert library.analyze(1) == 1
    with pytest.raises(ValueError):
        library.analyze(1)
    act = lambda: s.read("actions")
    assert rows(act(), "path", "survivor", "shortcut_name") == [("/lib/a", "/ext/a", "001.lnk")]
    done = spark.createDataFrame([("/lib/a", "done"), ("/lib/b.jpg", "done")], "path string, result string")
    told = library.confirm(1, act().select("run_id", "stage", "shortcut_name"), done)
    assert told == {"confirmed_stage": 1, "deleted": 1, "stage": 2}
    assert rows(act().where("stage = 2"), "path", "is_lead", "lead_reason", "distance") == [("/lib/b.jpg", 0, None, 4), ("/lib/b.png", 1, "resolution + format", 4)]
    none = act().limit(0)
    told = library.confirm(1, none, done, keep_suggested=True)
    assert told == {"confirmed_stage": 2, "deleted": 1, "stage": 3}
    assert rows(s.read("assets").where("status = 'trashed'"), "hash") == [("C",)]
    assert rows(act().where("stage = 3"), "path", "is_lead", "shortcut_name") == [("/lib/e", 0, "group0001_0001.lnk"), ("/lib/f", 0, "group0001_0002.lnk")]
    with pytest.raises(ValueError):
        library.confirm(1, none, done, keep_suggested=True)
    told = library.confirm(1, act().where("stage = 3").select("run_id", "stage", "shortcut_name"), done)
    assert told == {"confirmed_stage": 3, "deleted": 0, "stage": None}
    assert rows(s.read("runs"), "status", "deleted_count") == [("completed", 2)]
    assert rows(s.read("roots"), "root_id", "needs_dedup") == [(1, 0), (2, 1)]
    assert library.analyze(1) is None or library.cancel(1) is None


def test_trash_merge_and_cleanup(spark, library):
    s = library.store
    library.scan([1], listed(spark, (1, "/lib/a", "A"), (1, "/lib/sub/b.jpg", "B"), (1, "/lib/u", "U", True, False)), nothing(spark))
    inbox = spark.createDataFrame([("A", "x", 1), ("N", "y", 1), ("N", "z", 1)], "hash string, rel string, size long")
    assert rows(library.refresh_trash(inbox), "rel", "outcome") == [("x", "flipped"), ("y", "new_trashed"), ("z", "already_trashed")]
    assert rows(s.read("assets").where("status = 'trashed'"), "hash") == [("A",), ("N",)]
    incoming = [("B", "sub/c.jpg", 1.0, 1), ("Q", "sub/b.jpg", 1.0, 1), ("Q", "sub/q.jpg", 2.0, 1), ("A", "a.jpg", 1.0, 1), ("R", "r.lnk", 1.0, 1)]
    plan = library.merge_plan(spark.createDataFrame(incoming, "hash string, rel string, mtime double, size long"), 1)
    assert rows(plan, "rel", "class", "dest", "state") == [
        ("a.jpg", "trashed", None, "skipped"), ("r.lnk", "new", "/lib/r.lnk", "copied-unindexed"), ("sub/b.jpg", "new", "/lib/sub/b (1).jpg", "registered"),
        ("sub/c.jpg", "exact-known", None, "skipped"), ("sub/q.jpg", "dup-in-source", None, "skipped"),
    ]
    library.register(plan, 1)
    assert ("/lib/sub/b (1).jpg",) in rows(s.read("instances"), "path")
    assert library.untrash(spark.createDataFrame([("N", "n"), ("A", "a"), ("?", "o")], "hash string, rel string")).count() == 3
    assert rows(s.read("assets"), "hash", "status") == [("A", "active"), ("B", "active"), ("Q", "active"), ("U", "active")]
    got = library.cleanup(1, "undecodable", spark.createDataFrame([("/lib/u", "done")], "path string, result string"))
    assert got == {"deleted": 1} and rows(s.read("assets").where("status = 'trashed'"), "hash") == [("U",)]
    assert library.cleanup(1, "exact", spark.createDataFrame([], "path string, result string")) == {}


def test_two_writers(spark, tmp_path):
    a, b = (Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    a.commit({"t": spark.range(3)})
    b._claim(2)
    with pytest.raises(Conflict):
        a.commit({"t": spark.range(5)})
    assert a.version() == 1 and a.read("t").count() == 3
    a.abandon()
    assert a.commit({"t": spark.range(5)}) == 2
    assert a.read("t", 1).count() == 3 and a.backup("x").startswith("BACKUP-x-v000002")


def test_names_of_copies(spark, tmp_path):
    from prismcat.operators.store import placed_names

    taken = [("d", "a.jpg", "1"), ("d", "a (1).jpg", "2"), ("d", "a (4).jpg", "3"), ("e", "b", "4")]
    incoming = [("d", "a.jpg", h) for h in "56789"] + [("d", "a.jpg", "2"), ("d", "n.jpg", "x"), ("e", "b", "y"), ("f", "a.jpg", "z")]
    schema = "folder string, name string, hash string"
    got = placed_names(spark.createDataFrame(incoming, schema), spark.createDataFrame(taken, schema))
    assert rows(got, "folder", "hash", "placed", "reused") == [
        ("d", "2", "a (1).jpg", True), ("d", "5", "a (2).jpg", False), ("d", "6", "a (3).jpg", False), ("d", "7", "a (5).jpg", False), ("d", "8", "a (6).jpg", False), ("d", "9", "a (7).jpg", False),
        ("d", "x", "n.jpg", False), ("e", "y", "b (1)", False), ("f", "z", "a.jpg", False),
    ]


def test_relink_keeps_size_and_time(spark):
    old = spark.createDataFrame([("f", "/a/x.jpg", "x.jpg", "then", 5), ("g", "/a/y.jpg", "y.jpg", "then", 6)], "fid string, path string, filename string, last_seen string, size long")
    moves = spark.createDataFrame([("f", "/a/x.jpg", "/b/X.jpg")], "fid string, old_path string, new_path string")
    assert rows(scan.relinked(old, moves, F.lit("now")), *old.columns) == [("f", "/b/X.jpg", "X.jpg", "now", 5), ("g", "/a/y.jpg", "y.jpg", "then", 6)]
