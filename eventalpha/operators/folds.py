"""User-defined folds that stay distributed: states that merge, and states that are carried along an order.

``merged`` is for functions whose state does not depend on the order of rows: each task folds what it reads into
one state a group, and only states are shuffled and merged, in two steps. ``carried`` is for functions that
depend on it: rows are sorted by range over all tasks, each part is folded from a guessed state, and only parts
whose guess was wrong are folded again."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from eventalpha.sources.tables import scratch

HELD = 10_000  # states that a task holds before it sends them on
SALTS = 32


@dataclass
class Fold:
    """``init()`` -> state; ``update(state, frame)`` -> state with a pandas frame of the group's rows, in any
    order and number; ``merge(a, b)`` -> state; ``finish(state)`` -> rows, tuples in order of the schema."""

    init: Callable[[], Any]
    update: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], list[tuple]]


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _partial(by: list[str], fold: Fold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        states: dict[tuple, Any] = {}

        def out() -> pa.RecordBatch:
            keys = list(zip(*states)) or [()] * len(by)
            columns = [pa.array(k, schema.field(c).type) for k, c in zip(keys, by)]
            packed = pa.array([pickle.dumps(s) for s in states.values()], pa.binary())
            made = pa.RecordBatch.from_arrays([*columns, pa.array([salt] * len(states), pa.int32()), packed], names=[*by, "_salt", "_state"])
            states.clear()
            return made

        schema = None
        for batch in batches:
            schema = batch.schema
            frame = batch.to_pandas(types_mapper=None)
            for key, rows in frame.groupby(by, dropna=False, sort=False):
                key = tuple(None if k != k else k for k in key)
                states[key] = fold.update(states[key] if key in states else fold.init(), rows)
            if len(states) > HELD:
                yield out()
        if states:
            yield out()

    return run


def _joined(n_keys: int, fold: Fold, last: bool, names: list[str]):
    """Over (keys..., state) in order of the keys: one state a key, or its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, made, types = None, None, [], None

        def done() -> None:
            made.extend([(*key, *row) for row in fold.finish(state)] if last else [(*key, pickle.dumps(state))])

        def out() -> pa.RecordBatch:
            rows = [dict(zip(names, r)) for r in made]
            made.clear()
            return pa.RecordBatch.from_pylist(rows, schema=types)

        for batch in batches:
            if types is None:
                keys = [batch.schema.field(i) for i in range(n_keys)]
                kept = [pa.field(n, f.type) for n, f in zip(names, keys)]
                types = pa.schema(kept + [pa.field("_state", pa.binary())]) if not last else pa.schema(kept + [pa.field(n, t) for n, t in zip(names[n_keys:], last)])
            for *here, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and tuple(here) == key:
                    state = fold.merge(state, pickle.loads(packed))
                    continue
                if key is not None:
                    done()
                key, state = tuple(here), pickle.loads(packed)
            if len(made) >= HELD:
                yield out()
        if key is not None:
            done()
            yield out()

    return run


def merged(df: DataFrame, by: list[str], fold: Fold, schema: str) -> DataFrame:
    """``by`` and the fold's rows (``schema``) of each group. A group's states, at most one a task and HELD,
    merge in two steps (by salt, then all), so no task sees a group's rows, and a hot group is no burden."""
    from pyspark.sql.pandas.types import to_arrow_type

    of = StructType.fromDDL(schema)
    keys = _fields(df, by)
    states = df.mapInArrow(_partial(by, fold), f"{keys}, _salt int, _state binary")
    some = states.repartition(*by, "_salt").sortWithinPartitions(*by, "_salt")
    # The salt is a key as well, for the first step only.
    once = some.select(*by, "_salt", "_state").mapInArrow(_joined(len(by) + 1, fold, None, [*by, "_salt", "_state"]), f"{keys}, _salt int, _state binary")
    types = [to_arrow_type(f.dataType) for f in of]
    every = once.select(*by, "_state").repartition(*by).sortWithinPartitions(*by)
    return every.mapInArrow(_joined(len(by), fold, types, [*by, *of.names]), f"{keys}, {schema}")


Step = Callable[[Any, tuple], tuple[Any, tuple | None]]


def _walk(n_keys: int, start, step: Step, seeds: dict[int, Any], ends_only: bool, types: pa.Schema):
    """Over (part, keys..., values...) in order: the rows that ``step`` makes, or for each part its first and last
    key and the state after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key = first = state = None
        nth, made = 0, []

        def end() -> None:
            if ends_only and part is not None:
                made.append((part, pickle.dumps(first), pickle.dumps(key), pickle.dumps(state)))

        def out() -> pa.RecordBatch:
            rows = [dict(zip(types.names, r)) for r in made]
            made.clear()
            return pa.RecordBatch.from_pylist(rows, schema=types)

        for batch in batches:
            for at, *row in zip(*(c.to_pylist() for c in batch.columns)):
                here = tuple(row[:n_keys])
                if at != part:
                    end()
                    part, key, first, nth = at, here, here, 0
                    state = seeds.get(at, start)
                elif here != key:
                    key, state, nth = here, start, 0
                state, result = step(state, tuple(row[n_keys:]))
                if result is not None and not ends_only:
                    made.append((at, *here, nth, *result))
                    nth += 1
            if len(made) >= HELD:
                yield out()
        end()
        if made:
            yield out()

    return run


def carried(df: DataFrame, by: list[str], order: list[str], values: list[str], start, step: Step, schema: str, parts: int | None = None) -> DataFrame:
    """``by``, nth (from 0) and the rows (``schema``) that ``step(state, values)`` -> (state, row or None) makes along
    each group's order, from ``start``. ``order`` must tell the rows of a group apart.

    Rows are sorted by range, so a group of any size is spread over tasks, and a task holds one state. Each part
    begins from ``start``, as if the group before had ended there; then the parts that a group runs into begin from
    the state that the part before ended with, and where that was another one than was taken, the part is folded
    again. A state that comes to depend on what lies before its last reset only (a closed position) is right after
    one round; in the worst case there are as many rounds as parts of one group, with one part each. Only the
    parts' end states (one row each) meet on the driver."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, path = df.sparkSession, scratch(df.sparkSession, "carried")
    columns = list(dict.fromkeys([*by, *order, *values]))
    ranged = df.select(*columns)
    ranged = ranged.repartitionByRange(parts, *by, *order) if parts else ranged.repartitionByRange(*by, *order)
    ranged.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)

    def walked(some: DataFrame, seeds: dict[int, Any], ends_only: bool) -> DataFrame:
        of = StructType.fromDDL("part int, first binary, last binary, state binary" if ends_only else f"_part int, {_fields(df, by)}, nth long, {schema}")
        types = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in of])
        sorted_ = some.repartition("_part").sortWithinPartitions("_part", *by, *order).select("_part", *by, *values)
        return sorted_.mapInArrow(_walk(len(by), start, step, seeds, ends_only, types), of)

    def ends_of(some: DataFrame, seeds: dict[int, Any]) -> dict[int, tuple]:
        return {r[0]: tuple(pickle.loads(x) for x in r[1:]) for r in walked(some, seeds, True).collect()}

    taken: dict[int, Any] = {}
    ends = ends_of(rows, taken)
    while True:
        numbers = sorted(ends)
        wrong = {}
        for before, at in zip(numbers, numbers[1:]):
            wanted = ends[before][2] if ends[before][1] == ends[at][0] else start
            if wanted != taken.get(at, start):
                wrong[at] = wanted
        if not wrong:
            break
        taken |= wrong
        ends |= ends_of(rows.filter(F.col("_part").isin(list(wrong))), taken)
    made = walked(rows, taken, False)
    counts = made.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).drop("_n")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ["_part", *by]]
    joined = made.alias("m").join(offsets.alias("o"), same)
    names = StructType.fromDDL(schema).names
    return joined.select(*[f"m.{c}" for c in by], (F.col("m.nth") + F.col("o._before")).cast("int").alias("nth"), *[f"m.{c}" for c in names])
