"""Settings from TOML: what is missing has its default, what is unknown is warned of, what has a wrong type is an error."""

from __future__ import annotations

import tomllib
import warnings
from dataclasses import dataclass, field, fields, replace

from prismcat.functions.exprs import CODEC_WEIGHTS


@dataclass(frozen=True)
class Config:
    """The engine's thresholds.  Names and defaults are fixed values: they must equal those of existing settings files."""

    mtime_tolerance_s: float = 2.0
    t_photo_recompress: int = 10
    t_photo_edit: int = 32
    t_match_video: int = 90
    pdq_max_edge: int = 512
    video_bitrate_tie_pct: float = 10.0
    sample_frames: int = 12
    duration_tol_s: float = 1.0
    duration_tol_pct: float = 5.0
    frame_match_fraction: float = 0.60
    min_frame_quality: int = 50
    min_comparable_frames: int = 5
    low_quality_hint: int = 50
    include_raw: bool = False
    io_workers: int = 0
    cpu_workers: int = 0
    codec_weights: dict[str, float] = field(default_factory=lambda: dict(CODEC_WEIGHTS))


def workers(config: Config, cores: int) -> tuple[int, int]:
    """(readers, computers): as set, else enough readers to fill a link without disturbing a disk, and all cores but two."""
    return config.io_workers or min(8, max(4, cores)), config.cpu_workers or max(2, cores - 2)


def load(text: str) -> Config:
    """Settings from TOML text; tables only group keys, but ``codec_weights`` is merged over the defaults."""
    known = {f.name: f.default for f in fields(Config)}
    got: dict = {}

    def take(table: dict, at: str) -> None:
        for key, value in table.items():
            where = f"{at}{key}"
            if key == "codec_weights":
                if not isinstance(value, dict) or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value.values()):
                    raise TypeError(f"{where}: a table of numbers is expected")
                got[key] = CODEC_WEIGHTS | {k.lower(): float(v) for k, v in value.items()}
            elif isinstance(value, dict):
                take(value, f"{where}.")
            elif key not in known:
                warnings.warn(f"unknown setting {where}", stacklevel=3)
            else:
                want = type(known[key])
                fits = isinstance(value, want) and (want is bool or not isinstance(value, bool))
                if not fits and not (want is float and isinstance(value, int) and not isinstance(value, bool)):
                    raise TypeError(f"{where}: {want.__name__} is expected")
                got[key] = want(value)

    take(tomllib.loads(text), "")
    return replace(Config(), **got)
