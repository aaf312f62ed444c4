"""Decoders, fingerprints, headers of videos, names and texts, schedules."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismcat.functions import exprs as X
from prismcat.operators import review
from prismcat.plans import jobs as J
from prismcat.sources import decode, probe, sinks


def png_of(pixels, filters):
    height, width = pixels.shape[:2]
    rows, before = b"", np.zeros(width * 3, dtype=int)
    for y in range(height):
        line = pixels[y].reshape(-1).astype(int)
        left = np.concatenate([np.zeros(3, dtype=int), line[:-3]])
        corner = np.concatenate([np.zeros(3, dtype=int), before[:-3]])
        kind = filters[y % len(filters)]
        p = left + before - corner
        near = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = {0: 0 * line, 1: left, 2: before, 3: (left + before) // 2, 4: near}[kind]
        rows += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4]])
def test_png(filters):
    pixels = np.random.default_rng(1).integers(0, 256, (11, 7, 3)).astype(np.uint8)
    assert (decode.png(png_of(pixels, filters)) == pixels).all()


def smooth(seed, n=256):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:n, 0:n] / n
    out = np.zeros((n, n, 3))
    for _ in range(12):
        a, b, r, c = rng.random(4)
        out += (np.exp(-((x - a) ** 2 + (y - b) ** 2) / (0.01 + 0.05 * r)) * 255 * (c - 0.3))[:, :, None]
    return np.clip(out + 128, 0, 255).astype(np.uint8)


def test_pdq_is_stable_and_tells_apart():
    base = smooth(1)
    bits, quality = decode.pdq(base)
    assert len(bits) == 32 and 0 <= quality <= 100
    far = lambda other: int(np.bitwise_count(np.frombuffer(bits, np.uint8) ^ np.frombuffer(decode.pdq(other)[0], np.uint8)).sum())
    noisy = np.clip(base.astype(int) + np.random.default_rng(2).integers(-3, 4, base.shape), 0, 255).astype(np.uint8)
    assert far(noisy) <= 32 < 70 < far(smooth(5))
    assert far(decode.downscale(base, 128)) <= 32
    assert decode.pdq(np.full((64, 64, 3), 9, dtype=np.uint8))[1] == 0


def test_downscale():
    pixels = np.full((100, 40, 3), 77, dtype=np.uint8)
    small = decode.downscale(pixels, 50)
    assert small.shape == (50, 20, 3) and (small == 77).all()
    assert decode.downscale(pixels, 0) is pixels and decode.downscale(pixels, 100) is pixels


def test_fingerprints_of_a_folder(spark):
    good, bad = decode.sample_ppm(3), b"no picture"
    df = spark.createDataFrame([("/x/a.ppm", bytearray(good)), ("/x/b.png", bytearray(bad)), ("/x/c.heic", bytearray(bad)), ("/x/d.ppm", None)], "path string, content binary")
    got = {r.path: r for r in decode.fingerprints(df).collect()}
    a = got["/x/a.ppm"]
    assert (a.width, a.height, a.undecodable, a.decode_error, a.size) == (64, 48, False, None, len(good))
    assert struct.pack(">4q", a.l0, a.l1, a.l2, a.l3) == decode.pdq(decode.netpbm(good))[0]
    assert all(got[p].undecodable and got[p].decode_error and got[p].content_hash for p in got if p != "/x/a.ppm")


def exif(order, tags):
    entries, extra, at = b"", b"", 8 + 2 + 12 * len(tags) + 4
    for tag, text in tags:
        body = text.encode() + b"\0"
        entries += struct.pack(order + "HHII", tag, 2, len(body), at + len(extra))
        extra += body
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    return b"\xff\xd8\xff\xe1\0\0Exif\0\0" + head + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize("order", ["<", ">"])
def test_capture_time(order):
    assert decode.capture_time(exif(order, [(0x0132, "2020:05:06 07:08:09")])) == "2020-05-06 07:08:09"
    assert decode.capture_time(exif(order, [(0x0132, "2020:05:06 07:08:09"), (0x9003, "2019:01:02 03:04:05")])) == "2019-01-02 03:04:05"
    assert decode.capture_time(exif(order, [(0x9003, "0000:00:00 00:00:00")])) is None
    assert decode.capture_time(b"nothing") is None


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_mp4_header():
    clock = lambda made, ticks, length: struct.pack(">IIIII", 0, made, 0, ticks, length)
    entry = box(b"hvc1", b"\0" * 24, struct.pack(">HH", 1920, 1080), b"\0" * 50)
    video = box(b"trak", box(b"mdia", box(b"mdhd", clock(0, 1000, 12_500)), box(b"hdlr", b"\0" * 8 + b"vide" + b"\0" * 12), box(b"minf", box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry)))))
    sound = box(b"trak", box(b"mdia", box(b"mdhd", clock(0, 10, 90)), box(b"hdlr", b"\0" * 8 + b"soun" + b"\0" * 12)))
    data = box(b"ftyp", b"isom") + box(b"mdat", b"x" * 99) + box(b"moov", box(b"mvhd", clock(86_400, 600, 6000)), sound, video)
    assert probe.mp4_header(data) == {"duration_s": 12.5, "width": 1920, "height": 1080, "codec": "hevc", "captured_at": "1904-01-02 00:00:00"}
    assert set(probe.mp4_header(b"\0\0\0\xffmoov").values()) == {None}


def test_frames_by_seeking_and_in_sequence(spark):
    videos = spark.createDataFrame([(1, 8.0), (2, 0.0)], "id long, duration double")
    frames = spark.createDataFrame([(1, k, float(k), k % 4 == 0, k != 3) for k in range(9)], "id long, frame int, pts double, key boolean, ok boolean")
    grid = probe.midpoints(videos, 4)
    assert sorted(r.target for r in grid.collect()) == [1.0, 3.0, 5.0, 7.0]
    assert sorted((r.k, r.frame) for r in probe.sequential_frames(grid, frames).collect()) == [(0, 1), (1, 3), (2, 5), (3, 7)]
    assert sorted((r.k, r.frame) for r in probe.seek_frames(grid, frames).collect()) == [(0, 1), (2, 5), (3, 7)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sets_in_globs(spark):
    hit = lambda glob, path: one(spark, F.lit(path).rlike(X.glob_regex(glob)[0]))
    assert hit("[[]x.jpg", "d/[x.jpg") and not hit("[[]x.jpg", "x.jpg")
    assert hit("[a&&b].jpg", "a.jpg") and hit("[a&&b].jpg", "&.jpg") and not hit("[a&&b].jpg", "c.jpg")
    assert hit("[]a].jpg", "].jpg") and hit("[!]a].jpg", "b.jpg") and not hit("[!]a].jpg", "].jpg")
    assert hit("[a-c^].jpg", "b.jpg") and hit("[a-c^].jpg", "^.jpg") and hit("[-a].jpg", "-.jpg")
    assert hit("x[.jpg", "x[.jpg") and hit("**/cache/**", "a/cache/b") and hit("/top/*.jpg", "top/a.jpg") and not hit("/top/*.jpg", "x/top/a.jpg")


def test_cells(spark):
    text = F.lit("ab照片cd")
    assert one(spark, X.cell_width(text)) == 8
    assert [one(spark, X.cell_cut(text, n)) for n in (0, 2, 3, 4, 8, 20)] == ["", "ab", "ab", "ab照", "ab照片cd", "ab照片cd"]
    assert one(spark, X.cell_pad(text, 5)) == "ab照 " and one(spark, X.cell_pad(F.lit("x"), 3, right=True)) == "  x"
    assert one(spark, X.middle_elide(F.lit("abcdefghij"), 6)) == "abc…ij" and one(spark, X.end_elide(F.lit("abcdefghij"), 6)) == "abcde…"
    assert one(spark, X.middle_elide(F.lit("abc"), 1)) == "…" and one(spark, X.end_elide(F.lit("abc"), 3)) == "abc"
    assert one(spark, X.masked(F.lit("A Secret 照片"), ["secret", "照片"])) == "A ░░░░░░ ░░░░"


def test_paths(spark):
    assert one(spark, X.canonical(F.lit("/a//b/./c/../d/"))) == "/a/b/d" and one(spark, X.canonical(F.lit("/../.."))) == "/"
    net = lambda p: one(spark, X.is_network(F.lit(p)))
    assert net("\\\\nas\\x") and net("\\\\?\\UNC\\nas\\x") and not net("\\\\?\\C:\\x") and not net("/r/x")
    assert one(spark, X.same_path(F.lit("/A"), F.lit("/a"), fold=True)) and not one(spark, X.same_path(F.lit("/A"), F.lit("/a")))
    assert one(spark, X.pruned(F.lit("a/cache"), ["**/cache/**"])) and one(spark, X.pruned(F.lit("x"), ["x/"])) and not one(spark, X.pruned(F.lit("y"), ["x/", "*.jpg"]))
    assert X.thirds(0, 10) == [(0, 2), (3, 6), (7, 10)] and X.thirds(0, 90) == [(0, 29), (30, 59), (60, 90)] and X.thirds(11, 32) == [(11, 17), (18, 24), (25, 32)]


def test_shortcut_numbers_are_never_cut(spark):
    assert [one(spark, X.shortcut(F.lit(n), 3)) for n in (7, 1234567)] == ["007.lnk", "1234567.lnk"]


def test_schedule():
    s = J.Schedule(seed=1)
    s.add(J.Periodic("probe", 60), now=0)
    with pytest.raises(ValueError):
        s.add(J.Periodic("probe", 60), now=0)
    first = s._due["probe"]
    assert 900 <= first <= 1200 and s.due(first - 1) == [] and s.due(first) == ["probe"]
    # many missed times make one run, and none if it is too late
    assert s.due(first + 1200 + 3000) == ["probe"]
    assert s.due(s._due["probe"] + 3601) == []
    assert J.Periodic("probe", 100_000).jitter == 300


def test_registry():
    r = J.Registry()
    r.add("ok", lambda c: c.params["x"], ignore_merge_holder=True)
    r.add("bad", lambda c: 1 / 0)
    with pytest.raises(ValueError):
        r.add("ok", print)
    assert r.run("ok", J.Context({"x": 3})) == ("done", 3) and r.run("bad", J.Context({}))[0] == "error" and r.run("?", J.Context({}))[0] == "error"
    assert r.run("ok", J.Context({"x": 3}, stop=lambda: True)) == ("cancelled", None)
    assert r.specs["ok"].ignore_merge_holder and r.specs["ok"].owned_root({"root_id": 4}) == 4


def test_submission(spark):
    schema = "id long, type string, root_id int, status string"
    jobs = spark.createDataFrame([(1, "probe", 1, "queued")], schema)
    new = spark.createDataFrame([(2, "probe", 1, "queued"), (3, "probe", 2, "queued"), (4, "probe", 2, "queued"), (5, "scan", 1, "queued")], schema)
    assert sorted(r.id for r in J.submit(jobs, new, {"probe", "scan"}).collect()) == [1, 3, 5]
    with pytest.raises(ValueError):
        J.submit(jobs, new, {"probe"})
    runs = spark.createDataFrame([(1, 1, "pending", 1, "staged"), (2, 2, "pending", 2, "staged"), (3, 3, "pending", 1, "applied")], "run_id int, root_id int, status string, stage int, phase string")
    running = spark.createDataFrame([(k, "dedup", k, "running", "{}") for k in (1, 2, 3)], "id long, type string, root_id int, status string, params_json string")
    assert sorted(r.run_id for r in J.rolled_back(runs, running).collect()) == [2, 3]


def test_materialize_promotes(spark):
    plan = spark.createDataFrame([(1, "/a", "/s1"), (1, "/b", "/s1"), (2, "/c", "/s2"), (3, "/d", "/s3"), (3, "/e", "/s3")], "asset_id long, path string, survivor string")
    live = spark.createDataFrame([("/a",), ("/b",), ("/s2",), ("/e",)], "path string")
    assert sorted(tuple(r) for r in review.materialized(plan, live).select("asset_id", "path", "survivor").collect()) == [(1, "/b", "/a")]


def test_audit_document(spark, tmp_path):
    sinks.audit_document(spark, f"file://{tmp_path}", "applied.json", {"b": 1, "a": "é"})
    assert (tmp_path / "applied.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}'
    with pytest.raises(FileExistsError):
        sinks.audit_document(spark, f"file://{tmp_path}", "applied.json", {})


def test_followers_lag_and_leave():
    from prismcat.streaming.events import BEAT, END, Fanout

    fan = Fanout()
    a, b = fan.follow(1, buffer=3), fan.follow(1)
    for k in range(5):
        fan.send(1, k)
        fan.send(2, k)
    assert [a.get(0) for _ in range(4)] == [0, 1, 2, BEAT] and a.dropped == 2
    fan.leave(a)
    assert a.get(0) is END
    fan.close(1)
    assert [b.get(0) for _ in range(6)] == [0, 1, 2, 3, 4, END]
    fan.send(1, "late")


def test_workers():
    from prismcat.sources.config import Config, load, workers

    assert workers(Config(), 2) == (4, 2) and workers(Config(), 16) == (8, 14) and workers(load("io_workers = 3\ncpu_workers = 5"), 16) == (3, 5)
    assert Config().include_raw is False


def test_smoke_of_decoders(spark):
    df = spark.createDataFrame([("/a.ppm", bytearray(decode.sample_ppm(1))), ("/b.ppm", bytearray(b"?")), ("/c.avif", bytearray(b"?"))], "path string, content binary")
    assert sorted(tuple(r) for r in decode.smoke(df).collect()) == [("avif", 1, 0), ("ppm", 2, 1)]
    assert decode.available()["png"] and decode.available()["ppm"]
