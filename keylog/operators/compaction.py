"""Compaction: which runs to merge, and the merge.

A strategy scores levels from the catalogue (level, run_id, bytes) and picks a job.
Policies work on the driver, on the few rows of the manifest; ``score_frame`` gives the
same numbers for a catalogue held in a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylog.operators.resolve import latest
from keylog.plans.manifest import Run


@dataclass
class Job:
    """Inputs and where their merge goes; no inputs and level -1: nothing to do."""

    inputs: list[Run] = field(default_factory=list)
    output_level: int = -1

    def __bool__(self) -> bool:
        return bool(self.inputs)


class Strategy(Protocol):
    def score(self, runs: Sequence[Run], level: int) -> float: ...

    def pick(self, runs: Sequence[Run], num_levels: int) -> Job: ...

    def score_column(self) -> Column: ...


def at_level(runs: Sequence[Run], level: int) -> list[Run]:
    return [r for r in runs if r.level == level]


@dataclass
class Leveled:
    """A level may hold base * multiplier^level bytes. A job takes the whole level and the overlapping runs below."""

    base_bytes: int = 256 << 20
    multiplier: int = 10

    def score(self, runs: Sequence[Run], level: int) -> float:
        return sum(r.bytes for r in at_level(runs, level)) / (self.base_bytes * self.multiplier**level)

    def pick(self, runs: Sequence[Run], num_levels: int) -> Job:
        for level in range(num_levels - 1):
            if self.score(runs, level) > 1.0:
                upper = at_level(runs, level)
                low, high = min(r.min_key for r in upper), max(r.max_key for r in upper)
                return Job(upper + [r for r in at_level(runs, level + 1) if r.overlaps(low, high)], level + 1)
        return Job()

    def score_column(self) -> Column:
        return F.sum("bytes") / (F.lit(float(self.base_bytes)) * F.pow(F.lit(float(self.multiplier)), F.col("level")))

    def due(self, score: Column) -> Column:
        return score > 1.0


@dataclass
class Tiered:
    """A level is merged once it has ``ratio`` runs."""

    ratio: int = 4

    def score(self, runs: Sequence[Run], level: int) -> float:
        return len(at_level(runs, level)) / self.ratio

    def pick(self, runs: Sequence[Run], num_levels: int) -> Job:
        for level in range(num_levels - 1):
            if len(found := at_level(runs, level)) >= self.ratio:
                return Job(found, level + 1)
        return Job()

    def score_column(self) -> Column:
        return F.count("*") / F.lit(float(self.ratio))

    def due(self, score: Column) -> Column:
        return score >= 1.0


def score_frame(catalogue: DataFrame, strategy: Leveled | Tiered) -> DataFrame:
    """(level, score) of a catalogue (level, run_id, bytes)."""
    return catalogue.groupBy("level").agg(strategy.score_column().alias("score"))


def pick_frame(catalogue: DataFrame, strategy: Leveled | Tiered, num_levels: int) -> DataFrame:
    """(from_level, to_level): the lowest level that is due, the last one excepted; no row if none is."""
    due = score_frame(catalogue, strategy).where(strategy.due(F.col("score")) & (F.col("level") < num_levels - 1))
    return due.agg(F.min("level").alias("from_level")).where("from_level is not null").select("from_level", (F.col("from_level") + 1).alias("to_level"))


def is_bottom(inputs: Sequence[Run], all_runs: Sequence[Run], output_level: int) -> bool:
    """Whether no other run at or below the output level can hold an older version of an input's key.

    With runs at upper levels only, a tombstone has nothing left to hide. A run outside the job that holds older
    versions of these keys keeps the tombstones alive wherever it stands.
    """
    chosen = {r.run_id for r in inputs}
    newest = max(r.max_seq for r in inputs)
    return not any(o.run_id not in chosen and o.min_seq <= newest and any(o.overlaps(r.min_key, r.max_key) for r in inputs) for o in all_runs)


def merge(ops: DataFrame, drop_tombstones: bool) -> DataFrame:
    """One row per key; deletes go only where nothing older can remain."""
    out = latest(ops)
    return out.where(~F.col("is_delete")) if drop_tombstones else out


def replace_level(catalogue: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The catalogue without the input runs, at whatever level, and with the outputs."""
    return catalogue.join(inputs.select("run_id"), "run_id", "left_anti").select(*catalogue.columns).unionByName(outputs)
