"""Videos: headers of MP4 files, durations, sampling grids, and frames by seeking or in sequence."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duration(stream: Column, tick: Column, container: Column, container_ticks: Column, packets: Column) -> Column:
    """Seconds from the first source that knows them: stream, container, then packets.  Zero is unknown, a length of nothing too."""
    known = lambda x: F.when(x > 0, x)
    return F.coalesce(known(stream) * tick, known(container) / container_ticks, known(packets))


def container_stamp(raw: Column) -> Column:
    """A creation time as date and time without zone; null if too short to be a date."""
    text = F.replace(F.rtrim(raw, F.lit("Z")), F.lit("T"), F.lit(" "))
    return F.when(F.length(text) >= 10, F.substring(text, 1, 19))


def midpoints(videos: DataFrame, frames: int) -> DataFrame:
    """(id, k, target): the middle of each of so many equal segments; ``videos``: id, duration (and start)."""
    start = F.coalesce("start", F.lit(0.0)) if "start" in videos.columns else F.lit(0.0)
    k = F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("k")
    return videos.where("duration > 0").select("id", start.alias("_s"), "duration", k).select("id", "k", (F.col("_s") + F.col("duration") * (F.col("k") + 0.5) / frames).alias("target"))


def sequential_frames(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """(id, k, frame): each target takes the first frame at or after it; one frame may serve several."""
    return targets.join(frames, "id").where("pts >= target").groupBy("id", "k").agg(F.min_by("frame", F.struct("pts", "frame")).alias("frame"))


def seek_frames(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """(id, k, frame): as ``sequential_frames``, but decoding begins at the last key frame at or before the target, and a
    target whose frame can't be decoded is left out.  ``frames``: id, frame, pts, key, ok."""
    met = targets.join(frames, "id")
    seek = met.where("key AND pts <= target").groupBy("id", "k").agg(F.max("pts").alias("_seek"))
    after = met.join(seek, ["id", "k"], "left").where((F.col("pts") >= F.col("target")) & (F.col("pts") >= F.coalesce("_seek", F.lit(0.0))))
    return after.groupBy("id", "k").agg(F.min(F.struct("pts", "frame", "ok")).alias("m")).where("m.ok").select("id", "k", F.col("m.frame").alias("frame"))


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the boxes of an MP4 file between two places; a box that does not fit ends the list."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _inside(data: bytes, path: tuple[bytes, ...], at: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    for kind, a, b in boxes(data, at, end):
        if kind == path[0]:
            if len(path) == 1:
                yield a, b
            else:
                yield from _inside(data, path[1:], a, b)


def _clock(data: bytes, at: int) -> tuple[int, int, int]:
    """(created, ticks a second, length in ticks) of an mvhd or mdhd box."""
    if data[at] == 1:
        created, _, ticks, length = struct.unpack(">QQIQ", data[at + 4 : at + 32])
    else:
        created, _, ticks, length = struct.unpack(">IIII", data[at + 4 : at + 20])
    return created, ticks, length


def mp4_header(data: bytes) -> dict:
    """duration_s, width, height, codec, captured_at of an MP4 file; what its headers don't tell is None."""
    out: dict = dict.fromkeys(("duration_s", "width", "height", "codec", "captured_at"))
    for at, _ in _inside(data, (b"moov", b"mvhd")):
        created, ticks, length = _clock(data, at)
        if created:
            out["captured_at"] = (datetime(1904, 1, 1) + timedelta(seconds=created)).isoformat(" ")
        if ticks and length:
            out["duration_s"] = length / ticks
    for at, end in _inside(data, (b"moov", b"trak")):
        if not any(data[a + 8 : a + 12] == b"vide" for a, _ in _inside(data, (b"mdia", b"hdlr"), at, end)):
            continue
        for a, _ in _inside(data, (b"mdia", b"mdhd"), at, end):
            _, ticks, length = _clock(data, a)
            if ticks and length:
                out["duration_s"] = length / ticks  # the stream knows better than the container
        for a, _ in _inside(data, (b"mdia", b"minf", b"stbl", b"stsd"), at, end):
            kind = data[a + 12 : a + 16]
            out["codec"] = CODECS.get(kind, kind.decode("latin-1"))
            out["width"], out["height"] = struct.unpack(">HH", data[a + 40 : a + 44])
        break
    return out


#: Names of sample entries (fixed values).
CODECS = {b"avc1": "h264", b"avc3": "h264", b"hvc1": "hevc", b"hev1": "hevc", b"vp08": "vp8", b"vp09": "vp9", b"av01": "av1", b"mp4v": "mpeg4", b"vvc1": "vvc"}
