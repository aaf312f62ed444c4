"""Files copied and deleted on the executors, each with a row that says what became of it.

Paths must be visible to all executors.  A task that is run again does no harm: a copy that is there with the right bytes is
found again, a file that has gone counts as gone.
"""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ERROR_CHARS = 500


def digest(path: str, chunk: int = 1 << 20) -> str | None:
    """SHA-256 of a file, or None if it can't be read."""
    out = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while data := f.read(chunk):
                out.update(data)
    except OSError:
        return None
    return out.hexdigest()


def copy_verified(source: str, target: str, content: str) -> str:
    """Copy beside the target, compare with the planned content, then take the target's place, which must still be free.

    Gives ``copied``, or ``identical`` if the target has that content already.
    """
    if os.path.exists(target):
        if digest(target) == content:
            return "identical"
        raise FileExistsError(target)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.part-{os.getpid()}"
    try:
        shutil.copyfile(source, part)
        if digest(part) != content:
            raise ValueError("the copy differs from what was planned")
        os.link(part, target)  # fails if somebody was faster, where a rename would replace
    finally:
        if os.path.exists(part):
            os.remove(part)
    return "copied"


def remove(path: str) -> str:
    """Delete a file: ``done``, or ``missing`` if it was not there."""
    try:
        os.remove(path)
    except FileNotFoundError:
        return "missing"
    return "done"


def _told(files: DataFrame, columns: list[str], act: Callable[..., str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in columns)))
            said = []
            for row in rows:
                try:
                    said.append(act(*row))
                except (OSError, ValueError, TypeError) as e:
                    said.append(f"{type(e).__name__}: {e}"[:ERROR_CHARS])
            yield pa.record_batch({"path": pa.array([r[-1] if len(r) == 1 else r[1] for r in rows], pa.string()), "result": pa.array(said, pa.string())})

    return files.select(*columns).mapInArrow(run, "path string, result string")


def copies(plan: DataFrame) -> DataFrame:
    """(path, result) of planned copies (source, dest, hash): copied, identical, or an error's text."""
    return _told(plan, ["source", "dest", "hash"], copy_verified)


def removals(files: DataFrame) -> DataFrame:
    """(path, result) of files to delete: done, missing, or an error's text."""
    return _told(files, ["path"], remove)
