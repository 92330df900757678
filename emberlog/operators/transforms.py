"""A registry of per-event transforms: named functions from events to events."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from emberlog.operators import indicators as ind

Transform = Callable[[DataFrame], DataFrame]
_known: dict[str, Transform] = {
    "base64_decoder": ind.decode_base64,
    "lolbin": ind.lolbin,
    "inline_iocs": ind.inline_iocs,
    "dns_entropy": ind.entropy_level,
    "obfuscation_score": ind.obfuscation_score,
    "deobfuscate": ind.deobfuscate,
}


def register_transform(name: str, transform: Transform) -> None:
    """Adds a transform under a name that is still free."""
    if name in _known:
        raise ValueError(f"a transform named {name} is there")
    _known[name] = transform


def transforms() -> list[str]:
    return list(_known)


def apply_transforms(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """The events with all transforms of `names` (all known ones) applied in order."""
    for name in names if names is not None else transforms():
        df = _known[name](df)
    return df
