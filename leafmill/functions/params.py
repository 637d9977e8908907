"""Request options, server settings, their precedence and validation."""

from __future__ import annotations

import math
import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

_INT, _FLOAT = r"\+?[0-9]+", r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _parsed(raw: str, kind: type):
    """A setting's value; ValueError if it can't be parsed. Booleans are `true` or `false`, numbers have no blanks."""
    if kind is bool:
        return {"true": True, "false": False}[raw] if raw in ("true", "false") else _refuse(raw)
    if kind is int:
        return int(raw) if re.fullmatch(_INT, raw, re.A) else _refuse(raw)
    if kind is float:
        return float(raw) if re.fullmatch(_FLOAT, raw, re.A) or raw.lower().lstrip("+-") in ("inf", "infinity", "nan") else _refuse(raw)
    return raw


def _refuse(raw: str):
    raise ValueError(raw)


#: Names that a log level may have, and what it then is.
LOG_LEVELS = {"trace": "trace", "debug": "debug", "info": "info", "warn": "warn", "warning": "warn", "error": "error"}


@dataclass(frozen=True)
class Settings:
    """Server settings; `from_env` reads them from the environment, and a value that can't be parsed falls back."""

    server_port: int = 1420
    server_host: str = "0.0.0.0"
    log_level: str = "info"
    confidence_threshold: float = 0.3
    iou_threshold: float = 0.7
    target_size: int = 640
    inference_backend: str | None = None
    detector_model_path: str = "models/detector.onnx"
    gemini_api_keys: tuple[str, ...] = ()
    ocr_translation_model: str = "gemini-2.5-flash"
    banana_image_model: str = "gemini-2.5-flash-image"
    banana_mode_enabled: bool = False
    max_retries: int = 3
    batch_size_n: int = 5
    api_batch_size_m: int = 5
    max_concurrent_batches: int = 100
    onnx_pool_size: int = field(default_factory=lambda: max((os.cpu_count() or 1) // 2, 8))
    simple_bg_white_threshold: float = 0.6
    upscale_factor: int = 3
    adaptive_upscale: bool = True
    text_stroke_enabled: bool = False
    text_stroke_width: int = 2
    blur_free_text: bool = False
    blur_radius: float = 10.0
    text_alignment: str = "center"
    cjk_font_size_multiplier: float = 1.15
    font_size_min_ratio: float = 0.028
    font_size_max_ratio: float = 0.050
    cache_dir: str = ".cache"
    rate_limit_enabled: bool = False
    rate_limit_max_requests: int = 100
    rate_limit_window_seconds: int = 60
    text_cleaner_threshold: float = 0.3
    use_visual_numbering: bool = True

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env, got, plain = dict(os.environ) if env is None else env, {}, cls()
        special = {
            "log_level": lambda x: LOG_LEVELS.get(x.lower(), "info"),
            "text_alignment": lambda x: x.lower() if x.lower() in ("left", "center", "right") else "center",
            "inference_backend": lambda x: x.strip().upper() or None,
            "gemini_api_keys": lambda x: tuple(k.strip() for k in x.split(",") if k.strip()),
        }
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None:
                continue
            try:
                got[f.name] = special[f.name](raw) if f.name in special else _parsed(raw, type(getattr(plain, f.name)))
            except ValueError:
                continue
        return cls(**got)

    def problems(self) -> list[str]:
        """Rules that the settings break."""
        share = lambda x: not math.isnan(x) and 0 <= x <= 1
        folder = Path(self.cache_dir).parent
        rules = {
            f"Confidence threshold must be in [0.0, 1.0], got {self.confidence_threshold}": share(self.confidence_threshold),
            f"IoU threshold must be in [0.0, 1.0], got {self.iou_threshold}": share(self.iou_threshold),
            f"target_size must be between 320 and 2048, got {self.target_size}": 320 <= self.target_size <= 2048,
            f"batch_size_n must be > 0, got {self.batch_size_n}": self.batch_size_n > 0,
            f"api_batch_size_m must be > 0, got {self.api_batch_size_m}": self.api_batch_size_m > 0,
            f"max_concurrent_batches must be > 0, got {self.max_concurrent_batches}": self.max_concurrent_batches > 0,
            f"simple_bg_white_threshold must be between 0.0 and 1.0, got {self.simple_bg_white_threshold}": share(self.simple_bg_white_threshold),
            f"Parent directory does not exist: {folder}": folder.exists(),
            f"upscale_factor must be between 1 and 10, got {self.upscale_factor}": 1 <= self.upscale_factor <= 10,
            "rate_limit_max_requests must be > 0 when rate limiting is enabled": not self.rate_limit_enabled or self.rate_limit_max_requests > 0,
            "rate_limit_window_seconds must be > 0 when rate limiting is enabled": not self.rate_limit_enabled or self.rate_limit_window_seconds > 0,
        }
        return [text for text, holds in rules.items() if not holds]


def bool_or(raw: Column, default: bool) -> Column:
    """`true` or `false`; anything else is the default."""
    return F.when(raw == "true", F.lit(True)).when(raw == "false", F.lit(False)).otherwise(F.lit(default))


def int_or(raw: Column, default: int) -> Column:
    """A whole number without a sign but +, within 32 bits, or the default."""
    value = F.when(raw.rlike(f"^{_INT}$"), raw.try_cast("decimal(38,0)"))
    return F.when(value < (1 << 32), value.cast("long")).otherwise(F.lit(default).cast("long"))


def float_or(raw: Column, default: float) -> Column:
    return F.coalesce(F.when(raw.rlike(f"^{_FLOAT}$"), raw.try_cast("double")), F.lit(default))


def text_or_null(raw: Column) -> Column:
    """Trimmed upper case; null if that is empty."""
    return F.nullif(F.upper(trimmed(raw)), F.lit(""))


#: Rules on a row's settings, as (name, least, most); null bounds nothing.
RANGES = (
    ("confidence_threshold", 0, 1), ("iou_threshold", 0, 1), ("target_size", 320, 2048), ("batch_size_n", 1, None), ("api_batch_size_m", 1, None), ("max_concurrent_batches", 1, None),
    ("simple_bg_white_threshold", 0, 1), ("upscale_factor", 1, 10),
)


def broken_rules(columns: dict[str, Column], limited: Column) -> Column:
    """Names of the settings out of their range, for rows of settings; `limited` says if rate limiting is on."""
    out = []
    for name, least, most in RANGES:
        v = columns[name]
        bad = (v < least) if most is None else ~v.between(least, most)
        out.append(F.when(bad, F.lit(name)))
    out += [F.when(limited & (columns[name] < 1), F.lit(name)) for name in ("rate_limit_max_requests", "rate_limit_window_seconds")]
    return F.array_compact(F.array(*out))


def option(request: Column, server: Column, default: object) -> Column:
    """Request, then server, then constant."""
    return F.coalesce(request, server, F.lit(default))


def reuse_factor(request: Column) -> Column:
    return F.least(F.greatest(F.coalesce(request, F.lit(4)), F.lit(1)), F.lit(8))


def session_limit(request: Column) -> Column:
    return F.least(F.greatest(request, F.lit(1)), F.lit(32))


def session_memory_mb(limit: Column) -> Column:
    return limit * 42 + limit * 40


def target_size(request: Column, width: Column, height: Column, config: int = 640) -> Column:
    """0: the larger side; null: the setting; else as asked."""
    return F.when(request.isNull(), F.lit(config)).when(request == 0, F.greatest(width, height)).otherwise(request)


def batch_target_size(request: Column, largest_side: Column, config: int = 640) -> Column:
    """As `target_size` for a batch: 0 is the largest side of all its pages, as a window or aggregate gives it."""
    return F.when(request.isNull(), F.lit(config)).when(request == 0, F.coalesce(largest_side, F.lit(config))).otherwise(request)
