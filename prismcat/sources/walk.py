"""A folder tree as a table, by a Python data source.

``spark.read.format("file_walk").option("root", ...).load()`` lists media files below a root that driver and executors
see.  Built-in file sources drop names that begin with ``_`` or ``.``; this one does not.  The folders right below the
root are the partitions.  A folder that can't be listed, an entry that can't be read and a pruned folder give rows of
kind ``suppressed``: nothing below them may be taken for deleted.  A root that can't be listed gives one ``offline`` row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prismcat.functions.exprs import BUILTIN_GLOBS, JUNK_NAMES, PHOTO, RAW, REVIEW_DIR, VIDEO, glob_regex

SCHEMA = "kind string, path string, rel string, size long, mtime double, reason string"


def _rules(patterns: list[str]) -> list[tuple[re.Pattern, bool]]:
    """Compiled rules, the built-in ones first; blank patterns mean nothing."""
    given = [p for p in (*BUILTIN_GLOBS, *patterns) if p.strip()]
    return [(re.compile(regex.removesuffix("\\z") + "\\Z"), dirs) for regex, dirs in map(glob_regex, given)]


def _pruned(rel: str, rules) -> bool:
    return os.path.basename(rel) == REVIEW_DIR or any(r.match(rel) or (not dirs and r.match(f"{rel}/\x00")) for r, dirs in rules)


def _ext(name: str) -> str:
    stem, dot, end = name.rpartition(".")
    return end.lower() if dot and stem else ""


def entry(path: str, rel: str, raw: bool, rules, info: os.stat_result) -> tuple | None:
    """A file's row, or None if it is no media file or ignored; junk has a reason."""
    name = os.path.basename(path)
    if _ext(name) not in PHOTO + VIDEO + (RAW if raw else ()):
        return None
    if name.lower() in JUNK_NAMES or any(not dirs and r.match(rel) for r, dirs in rules):
        return None
    attrs = getattr(info, "st_file_attributes", 0)
    why = "hidden" if attrs & 2 else "system" if attrs & 4 else "zero-byte" if info.st_size == 0 else None
    return ("junk" if why else "file", path, rel, info.st_size, info.st_mtime, why)


def walk(root: str, start: str, patterns: list[str], raw: bool = False) -> Iterator[tuple]:
    """Rows of everything below ``start``, a folder relative to ``root``; ``.`` is the root's own files only."""
    rules = _rules(patterns)
    stack, deep = [start], start != "."
    while stack:
        rel_dir = stack.pop()
        here = root if rel_dir == "." else os.path.join(root, rel_dir)
        try:
            names = sorted(os.listdir(here))
        except OSError as e:
            yield ("suppressed", here, rel_dir, None, None, type(e).__name__)
            continue
        for name in names:
            path = os.path.join(here, name)
            rel = name if rel_dir == "." else f"{rel_dir}/{name}"
            try:
                info = os.stat(path)
            except OSError as e:
                yield ("suppressed", path, rel, None, None, type(e).__name__)
                continue
            if stat.S_ISDIR(info.st_mode):
                if _pruned(rel, rules):
                    yield ("suppressed", path, rel, None, None, "ignored")
                elif deep:
                    stack.append(rel)
            elif (row := entry(path, rel, raw, rules, info)) is not None:
                yield row


class _Folder(InputPartition):
    def __init__(self, rel: str | None):
        super().__init__(rel)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"]
        self.patterns = json.loads(options.get("ignore", "[]"))
        self.raw = options.get("raw", "false") == "true"

    def partitions(self):
        try:
            names = sorted(os.listdir(self.root))
        except OSError:
            return [_Folder(None)]
        rules = _rules(self.patterns)
        folders = [n for n in names if os.path.isdir(os.path.join(self.root, n)) and not _pruned(n, rules)]
        return [_Folder("."), *map(_Folder, folders)]

    def read(self, partition):
        if partition.value is None:
            yield ("offline", self.root, ".", None, None, "root")
        else:
            yield from walk(self.root, partition.value, self.patterns, self.raw)


class FileWalk(DataSource):
    """The ``file_walk`` format; options: root, ignore (a JSON list of globs), raw."""

    @classmethod
    def name(cls) -> str:
        return "file_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def listing(spark: SparkSession, root: str, ignore: list[str] = (), raw: bool = False) -> DataFrame:
    """Everything below a root."""
    from prismcat.plans.ship import ship

    ship(spark)
    spark.dataSource.register(FileWalk)
    return spark.read.format("file_walk").options(root=root, ignore=json.dumps(list(ignore)), raw=str(raw).lower()).load()


def hashed(files: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """path, content_hash (SHA-256, an opaque key) and error of files, read in chunks on the executors."""

    def run(batches):
        for batch in batches:
            paths, sums, errors = batch.column("path").to_pylist(), [], []
            for path in paths:
                digest = hashlib.sha256()
                try:
                    with open(path, "rb") as f:
                        while data := f.read(chunk):
                            digest.update(data)
                    sums.append(digest.hexdigest())
                    errors.append(None)
                except (OSError, TypeError) as e:
                    sums.append(None)
                    errors.append(str(e)[:500])
            yield pa.record_batch({"path": pa.array(paths, pa.string()), "content_hash": pa.array(sums, pa.string()), "error": pa.array(errors, pa.string())})

    return files.select("path").mapInArrow(run, "path string, content_hash string, error string")
