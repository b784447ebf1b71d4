"""Choosing runs before a plan is built: key ranges of the manifest against the asked range."""

from __future__ import annotations

from collections.abc import Sequence

from keylog.plans.manifest import Run


def runs_for(runs: Sequence[Run], low: bytes | None = None, high: bytes | None = None) -> list[Run]:
    """The runs whose key range meets [low, high]; an empty range meets none."""
    if low is not None and high is not None and low > high:
        return []
    return [r for r in runs if r.overlaps(low, high)]
