"""Still pictures: decoding, capture time, downscaling, the PDQ fingerprint, and a table of fingerprints.

Decoders are looked up by extension.  PNG and binary PPM/PGM are read here; ``register`` adds others, and Pillow is used
for the rest where it is installed.  A picture that no decoder can read gives a row with ``undecodable`` and a reason,
never an error of the task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Longest edge of a picture before it is fingerprinted; characters of a kept error.
MAX_EDGE, ERROR_CHARS = 512, 500

_decoders: dict[str, Callable[[bytes], np.ndarray]] = {}


def register(ext: str, decoder: Callable[[bytes], np.ndarray]) -> None:
    """Use ``decoder`` (bytes to a height x width x 3 array of bytes) for an extension."""
    _decoders[ext.lower()] = decoder


def png(data: bytes) -> np.ndarray:
    """An 8-bit PNG that is not interlaced, as red, green and blue; transparency goes."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("only 8-bit PNG files without interlacing are read")
    width, height, _, kind = head[:4]
    each = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, 1 + width * each)
    rows = np.zeros((height + 1, (width + 1) * each), dtype=np.int32)  # a row above and a pixel before, of zeros
    for y in range(height):
        line, up = raw[y, 1:].astype(np.int32), rows[y]
        own = rows[y + 1]
        how = raw[y, 0]
        if how == 0:
            own[each:] = line
        elif how == 2:
            own[each:] = (line + up[each:]) & 255
        else:
            for x in range(0, width * each, each):
                a, b, c = own[x : x + each], up[x + each : x + 2 * each], up[x : x + each]
                if how == 1:
                    guess = a
                elif how == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                own[x + each : x + 2 * each] = (line[x : x + each] + guess) & 255
    pixels = rows[1:, each:].astype(np.uint8).reshape(height, width, each)
    if kind == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if kind in (0, 4) else pixels[:, :, :3]


def netpbm(data: bytes) -> np.ndarray:
    """A binary PGM or PPM picture of 8 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    each = {b"P5": 1, b"P6": 3}[fields[0]]
    width, height, top = map(int, fields[1:])
    if top > 255:
        raise ValueError("only 8-bit pictures are read")
    pixels = np.frombuffer(data, dtype=np.uint8, count=width * height * each, offset=at + 1).reshape(height, width, each)
    return np.repeat(pixels, 3, axis=2) if each == 1 else pixels


def _pillow(data: bytes) -> np.ndarray:
    import io

    from PIL import Image  # not a requirement; without it the picture counts as undecodable

    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


for _ext, _decoder in (("png", png), ("ppm", netpbm), ("pgm", netpbm)):
    register(_ext, _decoder)


def available() -> dict[str, bool]:
    """Extensions, and whether something here can decode them."""
    import importlib.util

    from prismcat.functions.exprs import PHOTO

    other = importlib.util.find_spec("PIL") is not None
    return {e: e in _decoders or other for e in (*PHOTO, *(x for x in _decoders if x not in PHOTO))}


def smoke(files: DataFrame) -> DataFrame:
    """Per extension of (path, content): files, and how many could be decoded."""
    from pyspark.sql import functions as F

    from prismcat.functions.exprs import ext

    made = fingerprints(files).groupBy(ext(F.col("path")).alias("ext"))
    return made.agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("undecodable")).alias("decoded"))


def decode(data: bytes, ext: str) -> np.ndarray:
    """A picture as height x width x 3 bytes."""
    return _decoders.get(ext.lower(), _pillow)(data)


def capture_time(data: bytes) -> str | None:
    """The capture time of a JPEG or TIFF from its EXIF tags: the original time, else the time of change."""
    at = data.find(b"Exif\0\0") + 6
    block = data[at:] if at >= 6 else data
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(block[:4])
    if order is None:
        return None

    def tags(offset: int) -> dict[int, tuple[int, int, bytes]]:
        (n,) = struct.unpack(order + "H", block[offset : offset + 2])
        out = {}
        for k in range(n):
            entry = block[offset + 2 + 12 * k : offset + 14 + 12 * k]
            tag, kind, many = struct.unpack(order + "HHI", entry[:8])
            out[tag] = (kind, many, entry[8:])
        return out

    def text(entry) -> str:
        _, many, place = entry
        start = struct.unpack(order + "I", place)[0]
        body = place[:many] if many <= 4 else block[start : start + many]
        return body.split(b"\0")[0].decode("latin-1").strip()

    try:
        main = tags(struct.unpack(order + "I", block[4:8])[0])
        sub = tags(struct.unpack(order + "I", main[0x8769][2])[0]) if 0x8769 in main else {}
        raw = next((text(t[tag]) for t, tag in ((sub, 0x9003), (main, 0x9003), (main, 0x0132)) if tag in t), "")
    except struct.error:
        return None
    if len(raw) < 10 or raw.startswith("0000"):
        return None
    return raw[:10].replace(":", "-") + raw[10:]


def _lanczos(n: int, m: int, taps: int = 3) -> np.ndarray:
    """Weights (m, n) that resample n values to m by Lanczos windows."""
    scale = max(1.0, n / m)
    x = ((np.arange(m) + 0.5) * n / m - 0.5)[:, None] - np.arange(n)[None]
    w = np.where(np.abs(x / scale) < taps, np.sinc(x / scale) * np.sinc(x / scale / taps), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def downscale(pixels: np.ndarray, edge: int = MAX_EDGE) -> np.ndarray:
    """A picture whose longest edge is ``edge`` at most (0: as it is)."""
    height, width = pixels.shape[:2]
    if not edge or max(height, width) <= edge:
        return pixels
    h, w = (max(1, round(x * edge / max(height, width))) for x in (height, width))
    out = np.einsum("ah,hwc->awc", _lanczos(height, h), pixels.astype(float))
    out = np.einsum("bw,awc->abc", _lanczos(width, w), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _box(x: np.ndarray, width: int) -> np.ndarray:
    """Means over a window along the last axis, cut at the ends."""
    half = width // 2
    upto = np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum(x, axis=-1)], axis=-1)
    n = x.shape[-1]
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + width - half, n)
    return (upto[..., hi] - upto[..., lo]) / (hi - lo)


def pdq(pixels: np.ndarray) -> tuple[bytes, int]:
    """The 256-bit PDQ fingerprint (32 bytes) and its quality of 0 to 100, after the published description.

    Luminance, two passes of box filters both ways, 64 x 64 samples, the lowest 16 x 16 terms of a cosine transform but
    the constant ones, and a bit for each above the median.
    """
    x = pixels.astype(float) @ np.array([0.299, 0.587, 0.114])
    height, width = x.shape
    for _ in range(2):
        x = _box(x, max(1, (width + 127) // 128))
        x = _box(x.T, max(1, (height + 127) // 128)).T
    rows, cols = (((np.arange(64) + 0.5) * n / 64).astype(int) for n in (height, width))
    small = x[np.ix_(rows, cols)]
    steps = np.abs(np.trunc(np.diff(small, axis=0) * 100 / 255)).sum() + np.abs(np.trunc(np.diff(small, axis=1) * 100 / 255)).sum()
    k, n = np.arange(1, 17)[:, None], np.arange(64)[None]
    basis = np.sqrt(2 / 64) * np.cos(np.pi / 128 * k * (2 * n + 1))
    terms = basis @ small @ basis.T
    bits = (terms > np.median(terms)).reshape(-1)
    return np.packbits(bits[::-1]).tobytes(), int(min(100, steps / 90))


SCHEMA = "path string, content_hash string, size long, width int, height int, captured_at string, l0 long, l1 long, l2 long, l3 long, quality int, undecodable boolean, decode_error string"


def fingerprint(path: str, data: bytes, edge: int = MAX_EDGE) -> tuple:
    """A row of SCHEMA for one file's bytes."""
    row = (path, hashlib.sha256(data).hexdigest(), len(data))
    try:
        pixels = decode(data, path.rpartition(".")[2])
        bits, quality = pdq(downscale(pixels, edge))
    except Exception as e:  # noqa: BLE001  whatever a decoder raises, the file is undecodable
        return (*row, None, None, None, None, None, None, None, None, True, f"{type(e).__name__}: {e}"[:ERROR_CHARS])
    return (*row, pixels.shape[1], pixels.shape[0], capture_time(data), *struct.unpack(">4q", bits), quality, False, None)


def fingerprints(files: DataFrame, edge: int = MAX_EDGE) -> DataFrame:
    """Fingerprints of files (path, content), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                row = fingerprint(path, data.as_py() or b"", edge)
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, row))], schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in SCHEMA.split(", ")])


def sample_ppm(seed: int, width: int = 64, height: int = 48) -> bytes:
    """A small made-up picture, the same for the same seed: what a test of the decoders reads."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 256, (height // 8 + 1, width // 8 + 1, 3)).astype(np.uint8)
    pixels = np.kron(x, np.ones((8, 8, 1), dtype=np.uint8))[:height, :width]
    return b"P6\n%d %d\n255\n" % (width, height) + pixels.tobytes()
