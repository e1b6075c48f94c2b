"""Settings of a crawl: defaults, a file, a site's own, and overrides, in that order."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import get_args, get_origin, get_type_hints


@dataclass(frozen=True)
class Crawl:
    """What a crawl may do; limits are checked when one is made."""

    most_pages: int = 500
    most_depth: int = 10
    concurrency: int = 8
    timeout_ms: int = 15_000
    delay_ms: int = 0
    respect_robots: bool = True
    follow_external: bool = False
    user_agent: str = "sitequarry"
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    least_words: int = 250

    #: Least and greatest value of the numbers.
    LIMITS = {"most_pages": (1, 1_000_000), "most_depth": (0, 100), "concurrency": (1, 64), "timeout_ms": (100, 600_000), "delay_ms": (0, 600_000), "least_words": (0, 100_000)}


def problems(settings: dict) -> list[str]:
    """What is wrong with settings, by name; empty if nothing is."""
    hints = {k: v for k, v in get_type_hints(Crawl).items() if k in {f.name for f in fields(Crawl)}}
    out = [f"{k}: unknown" for k in settings if k not in hints]
    for name, value in settings.items():
        kind = hints.get(name)
        if kind is None:
            continue
        if get_origin(kind) is list:
            well = isinstance(value, list) and all(isinstance(x, get_args(kind)[0]) for x in value)
        else:
            well = isinstance(value, kind) and (kind is bool or not isinstance(value, bool))
        if not well:
            out.append(f"{name}: not of type {getattr(kind, '__name__', kind)}")
        elif name in Crawl.LIMITS and not Crawl.LIMITS[name][0] <= value <= Crawl.LIMITS[name][1]:
            out.append(f"{name}: not within {Crawl.LIMITS[name]}")
    return out


def merged(*layers: dict | None) -> Crawl:
    """The settings of all layers, later ones first; None in a layer sets nothing."""
    settings = {k: v for layer in layers for k, v in (layer or {}).items() if v is not None}
    if wrong := problems(settings):
        raise ValueError("; ".join(wrong))
    return Crawl(**settings)


def load(text: str, domain: str = "", overrides: dict | None = None) -> Crawl:
    """Of a JSON text {crawl: {...}, domains: {name: {...}}}: defaults, then crawl, then the domain's own, then overrides."""
    found = json.loads(text or "{}")
    if not isinstance(found, dict):
        raise ValueError("settings are no object")
    return merged(found.get("crawl"), (found.get("domains") or {}).get(domain), overrides)


def schema() -> dict:
    """A JSON schema of the settings."""
    names = {int: "integer", bool: "boolean", str: "string"}
    hints = get_type_hints(Crawl)
    out = {}
    for f in fields(Crawl):
        kind = hints[f.name]
        out[f.name] = {"type": "array", "items": {"type": names[get_args(kind)[0]]}} if get_origin(kind) is list else {"type": names[kind]}
        if f.name in Crawl.LIMITS:
            out[f.name] |= dict(zip(("minimum", "maximum"), Crawl.LIMITS[f.name], strict=True))
    defaults = asdict(Crawl())
    return {"type": "object", "additionalProperties": False, "properties": {k: v | {"default": defaults[k]} for k, v in out.items()}}
