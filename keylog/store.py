"""The store: a directory of sorted runs and a manifest, with put, delete, get, scan and compaction."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylog.operators import lookup
from keylog.operators.compaction import Leveled, Strategy, Tiered, is_bottom, merge
from keylog.operators.layout import held, sizes
from keylog.operators.resolve import history, latest, live
from keylog.plans.manifest import Conflict, Manifest, Run, State
from keylog.plans.pruning import runs_for
from keylog.schema import OP_SCHEMA, as_key, ops
from keylog.sources.runs import read_runs, write_run


@dataclass
class StoreOptions:
    """style: "leveled" or "tiered"; the rest bounds sizes. ``auto_compact`` merges after each batch."""

    flush_bytes: int = 64 << 20
    num_levels: int = 7
    bloom_fpp: float = 0.01
    row_group_bytes: int = 128 << 20
    style: str = "leveled"
    fanout: int = 4
    base_bytes: int = 256 << 20
    multiplier: int = 10
    partitions: int | None = None
    auto_compact: bool = False

    def strategy(self) -> Strategy:
        return {"leveled": Leveled(self.base_bytes, self.multiplier), "tiered": Tiered(self.fanout)}[self.style]


class Store:
    """Newest version wins, a delete hides all older versions, committed batches survive.

    Batches (``put_df``, ``delete_df``) are the way in; ``put`` and ``delete`` of single keys gather in
    a buffer on the driver that reads of this object see, and that ``flush`` commits.
    """

    def __init__(self, spark: SparkSession, path: str, options: StoreOptions) -> None:
        self.spark, self.options = spark, options
        self.manifest = Manifest(spark, path)
        self.path = path.rstrip("/")
        self._buffer: dict[bytes, bytes | None] = {}
        self._buffer_bytes = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: StoreOptions | None = None) -> Store:
        """Open or create. Without ``options`` those of the last commit hold."""
        store = cls(spark, path, options or StoreOptions())
        found = store.manifest.read().options
        if options is None and found:
            store.options = StoreOptions(**found)
        if store.options.style not in ("leveled", "tiered"):
            raise ValueError(f"unknown style {store.options.style}")
        return store

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- writing

    def put_df(self, df: DataFrame, order: str | None = None, unique: bool = False, batch_id: str | None = None) -> State:
        """Commit a batch of (key, value), optionally with is_delete.

        order: the column by which the last of a key's rows wins. Without it keys must not repeat, which
        is checked unless ``unique`` vouches for it. batch_id: a batch with an id that is already committed is skipped.
        """
        state = self.manifest.read()
        if batch_id is not None and state.has(batch_id):
            return state
        rows = ops(df, is_delete="is_delete" if "is_delete" in df.columns else False, seq=order)
        if order is not None:
            rows = latest(rows)
        elif not unique and rows.groupBy("key").count().where("count > 1").limit(1).count():
            raise ValueError("a key repeats in the batch and no order column was named")
        return self._commit_run(rows.withColumn("seq", F.lit(None).cast("long")), batch_id)

    def delete_df(self, keys: DataFrame, batch_id: str | None = None) -> State:
        """Commit deletes of the column ``key``; keys that are absent do no harm."""
        gone = keys.select("key").distinct().withColumns({"value": F.lit(None).cast("binary"), "is_delete": F.lit(True)})
        return self.put_df(gone, unique=True, batch_id=batch_id)

    def _run_path(self) -> str:
        return f"{self.path}/runs/{uuid.uuid4().hex}"

    def _commit_run(self, rows: DataFrame, batch_id: str | None) -> State:
        o = self.options
        run = write_run(rows, self._run_path(), 0, seq=0, partitions=o.partitions, bloom_fpp=o.bloom_fpp, row_group_bytes=o.row_group_bytes)

        def add(old: State) -> State:
            if batch_id is not None and old.has(batch_id):
                return old
            new = replace(old, runs=list(old.runs), batches=old.batches if batch_id is None else old.with_batch(batch_id), options=asdict(o))
            if run is not None:
                new.runs.append(replace(run, seq=old.next_seq, min_seq=old.next_seq, max_seq=old.next_seq))
                new.next_seq = old.next_seq + 1
            return new

        state = self.manifest.commit(add)
        return self.compact() if o.auto_compact else state

    def put(self, key: str | bytes, value: str | bytes) -> None:
        self._buffered(as_key(key), as_key(value))

    def delete(self, key: str | bytes) -> None:
        self._buffered(as_key(key), None)

    def _buffered(self, key: bytes, value: bytes | None) -> None:
        old = self._buffer.get(key)
        self._buffer_bytes += len(value or b"") - len(old or b"") + (0 if key in self._buffer else len(key))
        self._buffer[key] = value
        if self._buffer_bytes >= self.options.flush_bytes:  # deletes count as well
            self.flush()

    def buffer_bytes(self) -> int:
        return self._buffer_bytes

    def is_full(self) -> bool:
        return self._buffer_bytes >= self.options.flush_bytes

    def _buffer_df(self, seq: int | None) -> DataFrame:
        rows = [(bytearray(k), None if v is None else bytearray(v), v is None, seq) for k, v in self._buffer.items()]
        return self.spark.createDataFrame(rows, OP_SCHEMA)

    def flush(self) -> State:
        """Commit the buffer as a run; the buffer is emptied only once that succeeded."""
        if not self._buffer:
            return self.manifest.read()
        state = self._commit_run(self._buffer_df(None), None)
        self._buffer, self._buffer_bytes = {}, 0
        return state

    # -- reading

    def ops(self, low: bytes | None = None, high: bytes | None = None, version: int | None = None) -> DataFrame:
        """The op-log rows of the runs that can hold keys in [low, high], and the buffer."""
        state = self.manifest.read(version)
        rows = read_runs(self.spark, runs_for(state.runs, low, high))
        if self._buffer and version is None:
            rows = rows.unionByName(self._buffer_df(state.next_seq))
        return rows

    def table(self, version: int | None = None) -> DataFrame:
        """(key, value) of all live keys, now or as of a manifest version."""
        state = self.manifest.read(version)
        if len(state.runs) == 1 and state.runs[0].unique and not (self._buffer and version is None):
            return read_runs(self.spark, state.runs).where(~F.col("is_delete")).select("key", "value")  # nothing to resolve: no shuffle
        return live(self.ops(version=version))

    def get(self, key: str | bytes) -> bytes | None:
        key = as_key(key)
        if key in self._buffer:
            return self._buffer[key]
        rows = lookup.get(self.ops(key, key), key).collect()
        return bytes(rows[0].value) if rows[0].found else None

    def multi_get(self, keys: DataFrame | Iterable[str | bytes]) -> DataFrame:
        """(key, found, value) for each key."""
        if not isinstance(keys, DataFrame):
            keys = self.spark.createDataFrame([(bytearray(as_key(k)),) for k in keys], "key binary")
        rows, held = self._ops_of(keys)
        return lookup.multi_get(rows, keys, held)

    def contains(self, keys: DataFrame) -> DataFrame:
        rows, held = self._ops_of(keys)
        return lookup.contains(rows, keys, held)

    def _ops_of(self, keys: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
        """The op-log rows between the least and the greatest asked key, runs outside are not planned; bytes in memory of the rows of the others, and of the keys."""
        asked = keys.select(F.col("key").cast("binary").alias("key"))
        ends = asked.agg(F.min("key").alias("low"), F.max("key").alias("high"), *sizes(asked)).collect()[0]
        low, high = (None, None) if ends.low is None else (bytes(ends.low), bytes(ends.high))
        runs = runs_for(self.manifest.read().runs, low, high)
        size = held(sum(r.rows for r in runs) + len(self._buffer), sum(r.bytes for r in runs) + self._buffer_bytes), held(ends.rows, ends.bytes)
        return self.ops(low, high).where(lookup.between(low, high)), size

    def scan(self, start: str | bytes | None = None, end: str | bytes | None = None, version: int | None = None) -> DataFrame:
        """Live keys in [start, end], ascending; runs outside the range are not even planned."""
        low, high = (None if x is None else as_key(x) for x in (start, end))
        return lookup.scan(self.ops(low, high, version), start, end)

    def history(self, version: int | None = None) -> DataFrame:
        return history(self.ops(version=version))

    def runs(self, version: int | None = None) -> DataFrame:
        return self.manifest.runs_frame(version)

    def files(self) -> DataFrame:
        """(path, bytes) of every data file of the current runs."""
        paths = [r.path for r in self.manifest.read().runs]
        if not paths:
            return self.spark.createDataFrame([], "path string, bytes long")
        meta = self.spark.read.schema(OP_SCHEMA).parquet(*paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return meta.distinct()

    # -- levels and compaction

    def add_run(self, df: DataFrame, level: int) -> State:
        """Write op-log rows (with their own seq) as a run of a level; a level that does not exist is an error."""
        if not 0 <= level < self.options.num_levels:
            raise ValueError(f"level {level} of {self.options.num_levels}")
        run = write_run(df, self._run_path(), level, unique=False, partitions=self.options.partitions, bloom_fpp=self.options.bloom_fpp)
        return self.manifest.commit(lambda old: replace(old, runs=old.runs + ([run] if run else []), next_seq=max(old.next_seq, (run.max_seq if run else 0) + 1), options=asdict(self.options)))

    def compact(self) -> State:
        """Run jobs until the strategy has none; each leaves fewer runs above the last level, so they end."""
        while True:
            state = self.manifest.read()
            job = self.options.strategy().pick(state.runs, self.options.num_levels)
            if not job:
                return state
            try:
                self.run_job(state, job.inputs, job.output_level)
            except Conflict:
                continue  # another compaction took the inputs

    def compact_all(self) -> State:
        """Merge everything into one run of the last level."""
        state = self.manifest.read()
        return self.run_job(state, state.runs, self.options.num_levels - 1) if state.runs else state

    def run_job(self, state: State, inputs: list[Run], output_level: int) -> State:
        """Merge the inputs into a run of a level. A single run that the merge would leave as it is keeps its files and moves by name."""
        o, bottom, one = self.options, is_bottom(inputs, state.runs, output_level), inputs[0]
        layout = {"partitions": o.partitions, "bloom_fpp": o.bloom_fpp, "row_group_bytes": o.row_group_bytes}
        if len(inputs) == 1 and one.unique and not (bottom and one.n_tombstones):
            run = replace(one, run_id=uuid.uuid4().hex, level=output_level)  # a new id: a job that has taken the old one must notice
        elif all(r.unique for r in inputs):  # few versions of a key: they meet in its range
            size = held(sum(r.rows for r in inputs), sum(r.bytes for r in inputs))
            run = write_run(read_runs(self.spark, inputs), self._run_path(), output_level, size=size, resolve=lambda rows: merge(rows, bottom), **layout)
        else:
            run = write_run(merge(read_runs(self.spark, inputs), bottom), self._run_path(), output_level, **layout)
        gone = {r.run_id for r in inputs}

        def swap(old: State) -> State:
            if not gone <= {r.run_id for r in old.runs}:
                raise Conflict("an input was merged by another job")
            return replace(old, runs=[r for r in old.runs if r.run_id not in gone] + ([run] if run else []), options=asdict(self.options))

        return self.manifest.commit(swap)

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete run folders that none of the last ``keep_versions`` versions names. Do not run beside writers."""
        files, versions = self.manifest.files, self.manifest.versions()[-keep_versions:]
        used = {r.path.rsplit("/", 1)[-1] for v in versions for r in self.manifest.read(v).runs}
        gone = [n for n in files.names(f"{files.root}/runs") if n not in used]
        for n in gone:
            files.remove(f"{files.root}/runs/{n}")
        for v in self.manifest.versions()[:-keep_versions]:
            files.remove(f"{self.manifest.folder}/{v:020d}.json")
        return gone
