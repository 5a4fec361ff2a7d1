"""Layered configuration."""

from __future__ import annotations

import re
from collections.abc import Mapping


def spread_all(config: Mapping) -> dict:
    """Every key `all` goes into its siblings; what a sibling says itself wins."""
    out = {k: spread_all(v) if isinstance(v, Mapping) else v for k, v in config.items()}
    common = out.pop("all", None)
    if isinstance(common, Mapping):
        out = {k: merged(common, v) if isinstance(v, Mapping) else v for k, v in out.items()}
    return out


def merged(low: Mapping, high: Mapping) -> dict:
    """Nested dictionaries, the second one's values winning."""
    out = dict(low)
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def layered(*layers: Mapping) -> dict:
    """Layers from the weakest to the strongest, each with its `all` keys spread."""
    out: dict = {}
    for layer in layers:
        out = merged(out, layer)
    return spread_all(out)


def seconds(walltime: str) -> int:
    """[days-]hours:minutes:seconds in seconds."""
    if not (m := re.fullmatch(r"(?:(\d+)-)?(\d+):(\d\d):(\d\d)", walltime)):
        raise ValueError(f"not a duration: {walltime!r}")
    d, h, mi, s = (int(x or 0) for x in m.groups())
    return ((d * 24 + h) * 60 + mi) * 60 + s


def megabytes(memory: str) -> int:
    """A size such as 512MB or 15 GB in MB."""
    if not (m := re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(MB|GB|TB)\s*", memory, re.I)):
        raise ValueError(f"not a size: {memory!r}")
    return int(float(m[1]) * {"MB": 1, "GB": 1000, "TB": 1_000_000}[m[2].upper()])
