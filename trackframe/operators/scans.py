"""Ordered scans: state handed on from frame to frame, in bounded memory at any length of a clip.

Spark deals the rows by key and sorts them (on disk where they are many); a task then reads them batch by batch. What it holds is
one Arrow batch, the rows of one frame and the state of one key, never a clip. Where a scan starts afresh at frames that SQL can
tell, those parts are keys of their own and run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def scan_frames(rows: DataFrame, by: Sequence[str], values: Sequence[str], begin: Callable[[tuple], Callable], schema: str, order: Sequence[Column] = (), lists: bool = False) -> DataFrame:
    """``begin(key)`` gives a function that is called with each frame of the key, in order, as (frame, arrays of ``values``); it returns rows.

    A returned row, put behind the key's values, is a row of ``schema``. Inside a frame rows stand in ``order``. Rows without a frame are left out.
    With ``lists`` the values come as lists, which cost less than arrays where a frame has few rows.
    """
    ordered = rows.where("frame IS NOT NULL").select(*by, "frame", *values).repartition(*by).sortWithinPartitions(*by, "frame", *order)
    kinds, n = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema), len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        step: Callable | None = None
        frame, held = None, []
        out: list[tuple] = []

        def finished() -> None:
            if held:
                join = (lambda c: sum(c, [])) if lists else np.concatenate
                out.extend([(*key, *r) for r in step(frame, [join(c) for c in zip(*held)] if len(held) > 1 else held[0])])

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy() for i in range(n)]
            frames, columns = batch.column(n).to_numpy(), [c.to_numpy(zero_copy_only=False) for c in batch.columns[n + 1 :]]
            changes = np.any([c[1:] != c[:-1] for c in (*codes, frames)], axis=0)
            starts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
            new_key = np.any([np.diff(c, prepend=c[0] - 1) != 0 for c in codes], axis=0).tolist()
            frames = frames.tolist()
            if lists:
                columns = [c.tolist() for c in columns]
            for a, b in zip(starts, starts[1:]):
                of = tuple(batch.column(i)[a].as_py() for i in range(n)) if new_key[a] else key
                if frames[a] != frame or of != key:
                    finished()
                    held = []
                    if step is None or of != key:
                        key, step = of, begin(of)
                    frame = frames[a]
                held.append([c[a:b] for c in columns])
            if out:
                yield _batch(out, kinds)
                out.clear()
        finished()
        if out:
            yield _batch(out, kinds)

    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
