"""Settings of a triage run, from two YAML files or their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


def _defaults() -> dict:
    import yaml

    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "defaults.yaml"), encoding="utf-8") as f:
        return yaml.safe_load(f)


def _fixed(v):
    """Lists as tuples; mappings as pairs, in order."""
    if isinstance(v, dict):
        return tuple((k, _fixed(x)) for k, x in v.items())
    return tuple(_fixed(x) for x in v) if isinstance(v, (list, tuple)) else v


_DEFAULTS = _defaults()
TRACE_LABELS, STATUSES, STRUCTURAL = (_fixed(_DEFAULTS[k]) for k in ("trace_labels", "statuses", "structural"))
LAYERS, KEYWORDS = ({k: tuple(v) for k, v in _DEFAULTS[name].items()} for name in ("layers", "keywords"))
RULES = {k: _fixed(v) for k, v in _DEFAULTS["rules"].items()}
SSL_LIKE, HIGH_GRADE = (_fixed(_DEFAULTS[k]) for k in ("ssl_like_labels", "dysplasia_grades"))


@dataclass(frozen=True)
class Settings:
    """Fractions are whole ten-thousandths, so that rounding is exact in every engine."""

    grid: int = 16
    min_cell_tissue: int = 800
    min_area: int = 100
    background_tissue: int = 800
    artifact: int = 2800
    pale: int = 1000
    pale_high: int = 1800
    hint_overlap: int = 500
    area_low: int = 200
    area_high: int = 3500
    max_clusters: int = 4
    max_steps: int = 8
    overlap_threshold: float = 0.30
    max_attempts: int = 2
    #: Magnification to region size; another magnification takes default_region.
    regions: tuple[tuple[float, int], ...] = ((1.0, 1024), (2.5, 512), (5.0, 256))
    default_region: int = 256
    #: Labels that a region may have; criteria of each layer and the words that show one in a text, as pairs.
    trace_labels: tuple[str, ...] = TRACE_LABELS
    layers: tuple[tuple[str, tuple[str, ...]], ...] = _fixed(LAYERS)
    keywords: tuple[tuple[str, tuple[str, ...]], ...] = _fixed(KEYWORDS)
    #: Criterion to its ordered (condition, status); what a runtime file says of a criterion replaces that criterion's alone.
    rules: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = _fixed(RULES)
    #: Names of the providers that a stage asks, in order.
    chains: tuple[tuple[str, tuple[str, ...]], ...] = ()
    serrated_labels: tuple[str, ...] = ()
    ssl_like_labels: tuple[str, ...] = SSL_LIKE
    dysplasia_grades: tuple[str, ...] = HIGH_GRADE

    def __post_init__(self):
        # an empty list counts as a missing one
        for name, default in (("ssl_like_labels", SSL_LIKE), ("dysplasia_grades", HIGH_GRADE)):
            if not getattr(self, name):
                object.__setattr__(self, name, default)


def env(name: str, default: str | None = None) -> str | None:
    """An environment variable; an empty one counts as unset."""
    return os.environ.get(name) or default


def adapted(settings: Settings, found: dict) -> Settings:
    """``settings`` with the fields of ``found``; rules are replaced one criterion at a time."""
    if unknown := set(found) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    made = {k: _fixed(v) for k, v in found.items()}
    if "rules" in found:
        made["rules"] = tuple({**dict(settings.rules), **dict(_fixed(found["rules"] or {}))}.items())
    return replace(settings, **made)


def load(runtime: str | None = None, budget: str | None = None) -> Settings:
    """Explicit path, then TESSERA_RUNTIME / TESSERA_BUDGET, then defaults. Keys are Settings' fields."""
    import yaml

    found: dict = {}
    for path in (runtime or env("TESSERA_RUNTIME"), budget or env("TESSERA_BUDGET")):
        if path:
            with open(path, encoding="utf-8") as f:
                found |= yaml.safe_load(f) or {}
    return adapted(Settings(), found)
