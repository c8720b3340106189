"""Thresholds, boundaries and expected hubs from a TOML file, with defaults for what it leaves out."""

from __future__ import annotations

import tomllib
import warnings
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from ..errors import ConfigError
from ..plans.detect import BOUNDARIES, EXPECTED_HIGH_COUPLING, Boundary, Thresholds


@dataclass(frozen=True)
class Config:
    thresholds: Thresholds = field(default_factory=Thresholds)
    boundaries: list[Boundary] = field(default_factory=lambda: list(BOUNDARIES))
    expected_high_coupling: list[str] = field(default_factory=lambda: list(EXPECTED_HIGH_COUPLING))


def parse(text: str) -> Config:
    """A configuration from TOML. Boundaries of the text replace the default ones; empty lists count as left out.

    ConfigError if the text is no TOML or lacks what a boundary needs.
    """
    try:
        return _read(tomllib.loads(text))
    except (AttributeError, KeyError, TypeError, ValueError) as e:
        raise ConfigError(f"{type(e).__name__}: {e}") from e


def _read(raw: dict) -> Config:
    known = {f.name for f in fields(Thresholds)}
    given = {("lines_per_export" if k == "fat_module_lines_per_export" else k): v for k, v in raw.get("thresholds", {}).items()}
    thresholds = replace(Thresholds(), **{k: v for k, v in given.items() if k in known})
    usual = {b.name.lower(): b for b in BOUNDARIES}
    boundaries = [
        Boundary(b.get("name") or key[:1].upper() + key[1:], b["indicators"], b.get("allowed_in") or (usual[key].allowed_in if key in usual else []), b.get("ownership_threshold", 0.5))
        for key, b in raw.get("boundaries", {}).items()
    ]
    return Config(thresholds, boundaries or list(BOUNDARIES), raw.get("expected_high_coupling") or list(EXPECTED_HIGH_COUPLING))


def load(path: str | Path) -> Config:
    """The file's configuration; defaults with a warning if it can't be read, without one if there is none."""
    try:
        return parse(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return Config()
    except (OSError, ValueError) as e:
        warnings.warn(f"{path}: {e}", stacklevel=2)
        return Config()


def template() -> str:
    """A configuration file with the default values."""
    usual, quote = Thresholds(), lambda xs: "[" + ", ".join(f'"{x}"' for x in xs) + "]"
    out = ["# Limits of the detectors. Lists at the top level must stand before the first table.", f"expected_high_coupling = {quote(EXPECTED_HIGH_COUPLING)}", "", "[thresholds]"]
    out += [f"{'fat_module_lines_per_export' if f.name == 'lines_per_export' else f.name} = {getattr(usual, f.name)}" for f in fields(Thresholds)]
    out += ["", "# Tables here replace all default boundaries. A module with this share of the hits owns the boundary."]
    for b in BOUNDARIES:
        out += ["", f"[boundaries.{b.name.lower()}]", f'name = "{b.name}"', f"indicators = {quote(b.indicators)}", f"allowed_in = {quote(b.allowed_in)}", f"ownership_threshold = {b.ownership}"]
    return "\n".join(out) + "\n"
