"""Rollup tiers: configuration, choice by step, and which source serves which part of a query."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from ..errors import BadQuery

HOUR = 3_600_000
#: Raw samples are read this far before a tier's newest buckets, which the next refresh may still change.
RAW_OVERLAP = 2 * HOUR

_UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": HOUR, "d": 24 * HOUR, "w": 168 * HOUR, "y": 8760 * HOUR}
_PART = re.compile(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|[smhdwy])")


def duration_ms(text: str) -> int:
    """90s, 1h30m, 2d."""
    raw = text.strip()
    parts = _PART.findall(raw.lstrip("+-"))
    if not parts or "".join(a + b for a, b in parts) != raw.lstrip("+-"):
        raise BadQuery(f"invalid duration {text!r}")
    total = sum(float(a) * _UNITS[b] for a, b in parts)
    return round(-total if raw.startswith("-") else total)


@dataclass(frozen=True)
class Tier:
    name: str
    resolution: int
    compact_after: int
    min_step: int
    retention: int | None = None

    @property
    def table(self) -> str:
        return f"samples_{self.name}"


@dataclass(frozen=True)
class Segment:
    """Part of a query's time range, served by a tier or by raw samples (tier None)."""

    tier: Tier | None
    start: int
    end: int


@dataclass(frozen=True)
class RollupConfig:
    enabled: bool = True
    raw_retention: int = 90 * 24 * HOUR
    tiers: tuple[Tier, ...] = field(default_factory=tuple)

    def validate(self) -> "RollupConfig":
        if not self.enabled:
            return self
        if not self.tiers:
            raise ValueError("rollups are enabled but there are no tiers")
        if self.raw_retention <= self.tiers[0].compact_after:
            raise ValueError("raw_retention must exceed the first tier's compact_after, or samples go before they are rolled up")
        for a, b in zip(self.tiers, self.tiers[1:]):
            for name in ("compact_after", "min_step", "resolution"):
                if getattr(b, name) <= getattr(a, name):
                    raise ValueError(f"{name} of tier {b.name} must exceed that of tier {a.name}")
            if b.resolution % a.resolution:
                raise ValueError(f"the resolution of tier {b.name} must be a multiple of that of tier {a.name}")
        return self

    def checksum(self) -> str:
        """Changes when a tier has to be built anew."""
        text = ";".join(f"{t.name},{t.resolution},{t.compact_after}" for t in self.tiers)
        return hashlib.sha256(text.encode()).hexdigest()

    def select(self, step: int, range_ms: int | None = None, origin: int = 0) -> Tier | None:
        """The coarsest tier for this step whose buckets tile every window: range, step and the first window's end (origin) are multiples of its resolution."""
        tiles = lambda t: range_ms is None or not (range_ms % t.resolution or step % t.resolution or origin % t.resolution)
        fit = [t for t in self.tiers if self.enabled and step >= t.min_step and (range_ms is None or t.resolution <= range_ms) and tiles(t)]
        return fit[-1] if fit else None

    def segments(self, start: int, end: int, tier: Tier | None, now: int) -> list[Segment]:
        """Coarsest tiers for the oldest part, raw samples for the newest. Parts join without gaps; tiers coarser than `tier` are left out."""
        out: list[Segment] = []
        at = start
        if self.enabled and tier is not None:
            for t in reversed([t for t in self.tiers if t.resolution <= tier.resolution]):
                upto = min(end, (now - t.compact_after - RAW_OVERLAP) // t.resolution * t.resolution)
                if at < upto:
                    out.append(Segment(t, at, upto))
                    at = upto
        if at < end:
            out.append(Segment(None, at, end))
        return out


DEFAULT = RollupConfig(
    tiers=(
        Tier("5m", 300_000, 24 * HOUR, 300_000),
        Tier("1h", HOUR, 72 * HOUR, HOUR),
    )
)
