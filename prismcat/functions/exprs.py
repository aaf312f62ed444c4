"""Column builders of the catalog: names, paths, globs, distances, labels."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by medium, and weights of video codecs against h264.
PHOTO = ("jpg", "jpeg", "jfif", "png", "gif", "bmp", "tif", "tiff", "webp", "avif", "heic", "heif")
VIDEO = ("mp4", "m4v", "mov", "avi", "mkv", "webm", "wmv", "flv", "mpg", "mpeg", "m2ts", "mts", "ts", "3gp")
RAW = ("dng", "cr2", "cr3", "nef", "arw", "raf", "orf", "rw2", "pef", "srw")
CODEC_WEIGHTS = {
    "mpeg2video": 0.5, "mpeg4": 0.5, "msmpeg4v3": 0.5, "wmv3": 0.6, "vc1": 0.7, "h264": 1.0, "avc": 1.0, "vp8": 1.2,
    "vp9": 1.5, "hevc": 2.0, "h265": 2.0, "av1": 2.5, "vvc": 3.0, "h266": 3.0,
}
JUNK_NAMES = ("thumbs.db", "desktop.ini", ".ds_store")
#: Folder of the review shortcuts, and what no root ever indexes (the folder's name is this engine's own).
REVIEW_DIR = "_prismcat_review"
BUILTIN_GLOBS = ("*.lnk", REVIEW_DIR + "/")
# Photo formats that keep everything, and those that keep much for their size.
LOSSLESS = ("png", "tif", "tiff", "bmp")
EFFICIENT = ("heic", "heif", "avif")


def leaf(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def ext(name: Column) -> Column:
    """Extension in lower case without the dot; none for names that only begin with one."""
    return F.lower(F.regexp_extract(name, r"[^/\\]\.([^./\\]+)$", 1))


def media_type(name: Column) -> Column:
    """photo, video or null by extension."""
    e = ext(name)
    return F.when(e.isin(*PHOTO, *RAW), "photo").when(e.isin(*VIDEO), "video")


def is_within(child: Column, parent: Column) -> Column:
    """Whether a path is a folder or lies below it; boundaries are separators."""
    root = F.regexp_replace(parent, "/+$", "")
    return (child == root) | F.startswith(child, F.concat(root, F.lit("/")))


_TOKEN = re.compile(r"(?P<deep>\*\*/)|(?P<all>\*\*)|(?P<star>\*)|(?P<one>\?)|\[(?P<neg>[!^]?)(?P<set>.[^\]]*)\]|(?P<plain>.)", re.S)
_WILD = {"deep": "(?:.*/)?", "all": ".*", "star": "[^/]*", "one": "[^/]"}


def _quoted(c: str) -> str:
    return c if c.isalnum() or c in "_/" else "\\" + c


def _set(negated: str, members: str) -> str:
    """A character set; every member but the hyphen of a range stands for itself."""
    inside = "".join("-" if c == "-" and 0 < k < len(members) - 1 else _quoted(c) for k, c in enumerate(members))
    return f"[{'^' if negated else ''}{inside}]"


def glob_regex(pattern: str) -> tuple[str, bool]:
    """A gitignore-like glob as (regular expression of Java and Python for a relative path, directories only).

    ``*`` and ``?`` stay within one part, ``**`` spans parts, ``[..]`` and ``[!..]`` are sets, an open ``[`` is itself; a
    slash at the beginning or inside anchors the pattern at the root, one at the end makes it match directories only.
    """
    body = pattern[:-1] if pattern.endswith("/") else pattern
    anchored = "/" in body

    def piece(m: re.Match) -> str:
        if m["set"] is not None:
            return _set(m["neg"], m["set"])
        return _quoted(m["plain"]) if m["plain"] is not None else _WILD[m.lastgroup]

    found = _TOKEN.sub(piece, body.removeprefix("/"))
    return ("(?i)^" + ("" if anchored else "(?:.*/)?") + found + "\\z"), pattern.endswith("/")


def _matches(regex: str):
    return lambda path: path.rlike(regex)


def ignored(rel: Column, patterns: list[str]) -> Column:
    """Whether a file's relative path is ignored: itself, its name, or a folder above it."""
    out = F.lower(leaf(rel)).isin(*JUNK_NAMES)
    parts = F.split(rel, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    has_above = F.size(parts) > 1
    for p in patterns:
        regex, dirs = glob_regex(p)
        out = out | (has_above & F.exists(above, _matches(regex)))
        if not dirs:
            out = out | rel.rlike(regex)
    return out


def junk(size: Column, attrs: Column) -> Column:
    """Why an entry is left out: hidden, system, zero-byte, or null."""
    return F.when(attrs.bitwiseAND(2) != 0, "hidden").when(attrs.bitwiseAND(4) != 0, "system").when(size == 0, "zero-byte")


def is_media(name: Column, raw: bool = False) -> Column:
    """Whether a name's extension is on the allowlist; camera raw files only if asked for."""
    return ext(name).isin(*PHOTO, *VIDEO, *(RAW if raw else ()))


def complete(undecodable: Column, medium: Column, has_photo: Column, has_video: Column) -> Column:
    """Fully fingerprinted: undecodable (nothing more can be had), or the medium's signature is there."""
    return F.coalesce(undecodable.cast("boolean"), F.lit(False)) | F.when(medium == "video", has_video).otherwise(has_photo)


def canonical(path: Column) -> Column:
    """An absolute path without empty parts, ``.`` and ``..``."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def same_path(a: Column, b: Column, fold: bool = False) -> Column:
    """Equality of paths; ``fold``: in any case."""
    return F.lower(a) == F.lower(b) if fold else a == b


def is_network(path: Column) -> Column:
    """Whether a path names a network share, plainly or by the long prefix."""
    share, long = "\\\\", "\\\\?\\"
    return (F.startswith(path, F.lit(share)) & ~F.startswith(path, F.lit(long))) | F.startswith(path, F.lit(long + "UNC\\"))


def pruned(rel: Column, patterns: list[str]) -> Column:
    """Whether a folder need not be walked: it matches, or all that could lie in it does."""
    out = F.lit(False)
    for regex, dirs in map(glob_regex, patterns):
        out = out | rel.rlike(regex)
        if not dirs:
            out = out | F.concat(rel, F.lit("/\x00")).rlike(regex)
    return out


def format_rank(path: Column) -> Column:
    """How much of a picture its format keeps: 2 all of it, 1 much for its size, 0 the rest."""
    e = ext(path)
    return F.when(e.isin(*LOSSLESS, *RAW), 2).when(e.isin(*EFFICIENT), 1).otherwise(0)


def shortcut(number: Column, digits: int) -> Column:
    """``007.lnk``: at least so many digits, never cut."""
    return F.format_string(f"%0{digits}d.lnk", number.cast("long"))


def group_shortcut(group: Column, member: Column, lead: Column, external: Column) -> Column:
    """``group0001_0002_suggested_external.lnk``."""
    marks = F.concat(F.when(lead == 1, "_suggested").otherwise(""), F.when(external == 1, "_external").otherwise(""))
    return F.concat(F.format_string("group%04d_%04d", group.cast("long"), member.cast("long")), marks, F.lit(".lnk"))


def bitrate(size: Column, seconds: Column) -> Column:
    """Megabits a second with two decimals, empty if unknown."""
    return F.when((F.coalesce(size, F.lit(0)) > 0) & (F.coalesce(seconds, F.lit(0.0)) > 0), F.format_string("%.2f Mb/s", size * 8.0 / seconds / 1e6)).otherwise("")


def utc_stamp(ts: Column) -> Column:
    """ISO 8601 to the second; a timestamp without zone is taken as UTC."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def fmt_eta(seconds: Column) -> Column:
    """``ETA 45s``, ``ETA 4m``, ``ETA 2h05m``, or nothing."""
    s = seconds.cast("long")
    hours = F.format_string("ETA %dh%02dm", F.floor(s / 3600).cast("long"), (F.floor(s / 60) % 60).cast("long"))
    return F.when(seconds.isNull(), "").when(s < 60, F.format_string("ETA %ds", s)).when(s < 3600, F.format_string("ETA %dm", F.floor(s / 60).cast("long"))).otherwise(hours)


#: East Asian wide and fullwidth characters, as a set of a regular expression (fixed values, the main blocks).
WIDE_CHARS = "[\u1100-\u115F\u2E80-\u303E\u3041-\u33FF\u3400-\u4DBF\u4E00-\u9FFF\uA000-\uA4CF\uAC00-\uD7A3\uF900-\uFAFF\uFE30-\uFE6F\uFF00-\uFF60\uFFE0-\uFFE6]"


def cell_width(text: Column) -> Column:
    """Cells of a terminal that a text takes: wide characters count twice."""
    return (F.length(text) + F.regexp_count(text, F.lit(WIDE_CHARS))).cast("int")


def cell_cut(text: Column, width: int) -> Column:
    """The longest beginning of at most ``width`` cells."""
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(text), F.lit(width))), lambda n: cell_width(F.substring(text, F.lit(1), n)) <= width)
    return F.substring(text, F.lit(1), F.array_max(fits))


def cell_tail(text: Column, width: int) -> Column:
    """The longest end of at most ``width`` cells."""
    return F.reverse(cell_cut(F.reverse(text), width))


def cell_pad(text: Column, width: int, right: bool = False) -> Column:
    """A text in exactly ``width`` cells, cut or filled with spaces at its end (``right``: before it)."""
    cut = cell_cut(text, width)
    fill = F.repeat(F.lit(" "), F.lit(width) - cell_width(cut))
    return F.concat(fill, cut) if right else F.concat(cut, fill)


def middle_elide(text: Column, width: int, mark: str = "\u2026") -> Column:
    """A text of at most ``width`` cells that keeps both ends, the beginning a cell more."""
    if width <= 1:
        return F.when(cell_width(text) <= width, text).otherwise(mark[:width])
    tail = (width - 1) // 2
    return F.when(cell_width(text) <= width, text).otherwise(F.concat(cell_cut(text, width - 1 - tail), F.lit(mark), cell_tail(text, tail) if tail else F.lit("")))


def end_elide(text: Column, width: int, mark: str = "\u2026") -> Column:
    """A text of at most ``width`` cells that loses its end."""
    if width <= 1:
        return F.when(cell_width(text) <= width, text).otherwise(mark[:width])
    return F.when(cell_width(text) <= width, text).otherwise(F.concat(cell_cut(text, width - 1), F.lit(mark)))


def masked(text: Column, keywords: list[str], mark: str = "\u2591") -> Column:
    """A text with every occurrence of a keyword, in any case, replaced cell by cell; its width stays."""
    out = text
    for word in keywords:
        cells = sum(2 if re.match(WIDE_CHARS, c) else 1 for c in word)
        out = F.regexp_replace(out, "(?iu)" + re.escape(word), mark * cells)
    return out


def thirds(lo: int, hi: int) -> list[tuple[int, int]]:
    """A range of whole numbers in three parts as even as can be."""
    n = hi - lo + 1
    edges = [lo, lo + n // 3, lo + 2 * n // 3, hi + 1]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits over 64-bit lanes."""
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for x, y in zip(a[1:], b[1:]):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out.cast("int")


def codec_weight(codec: Column) -> Column:
    """Weight of a codec, 1 if unknown."""
    table = F.create_map(*[F.lit(v) for kv in CODEC_WEIGHTS.items() for v in kv])
    return F.coalesce(F.element_at(table, F.lower(codec)), F.lit(1.0))


def effective_rate(size: Column, duration: Column, weight: Column) -> Column:
    """Bytes a second by codec weight; bytes by weight where the duration is unknown."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.lit(0.0)).when(duration > 0, size / duration * weight).otherwise(size * weight)


def log_band(rate: Column, pct: float) -> Column:
    """Rates within about ``pct`` per cent share a band; -1 for none."""
    if pct <= 0:
        return F.lit(-1).cast("long")
    return F.when(rate <= 0, F.lit(-1)).otherwise(F.bround(F.log(rate) / F.lit(math.log(1 + pct / 100)))).cast("long")


def fmt_size(n: Column) -> Column:
    """Bytes for people: 1024 to a unit, one decimal below ten."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        x = n / float(1024**k)
        text = F.when(x >= 10, F.format_string(f"%.0f {unit}", F.bround(x))).otherwise(F.format_string(f"%.1f {unit}", F.bround(x * 10) / 10))
        out = F.when(n >= float(1024**k), text).otherwise(out)
    return out


def reltime(then: Column, now: Column) -> Column:
    """How long ago: now, minutes, hours, the time today, the day, the day and year."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    return (
        F.when(then.isNull(), "never")
        .when((s >= 0) & (s < 90), "now")
        .when((s >= 0) & (s < 3600), F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when((s >= 0) & (s < 6 * 3600), F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .when((s >= 0) & (F.to_date(then) == F.to_date(now)), F.date_format(then, "HH:mm"))
        .when(F.year(then) == F.year(now), F.date_format(then, "MMM dd"))
        .otherwise(F.date_format(then, "yyyy MMM dd"))
    )


def status_dot(kind: Column, probe_new: Column, last_scan: Column, needs_dedup: Column, has_dedup: Column) -> Column:
    """Freshness of a root, first that holds."""
    return (
        F.when(kind == "trash", "")
        .when(probe_new > 0, "new")
        .when(last_scan.isNull(), "never")
        .when(needs_dedup == 1, "dirty")
        .when(has_dedup, "deduped")
        .otherwise("scanned")
    )


def job_label(kind: Column, params: Column) -> Column:
    """A job's verb with its qualifier."""
    flag = lambda k: F.coalesce(F.get_json_object(params, f"$.{k}") == "true", F.lit(False))
    return F.concat(kind, F.when(flag("confirm"), " (apply)").when(flag("dry_run"), " (dry run)").when(flag("full"), " (full)").otherwise(""))
