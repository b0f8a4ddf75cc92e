"""Packing documents into sequences by length patterns and non-negative least squares.

Only lengths matter for how full sequences get, so the plan is made on the histogram of lengths, which has ``capacity`` entries at
any size of the corpus:

1. Documents become ids, an end id is added, and longer ones are cut into pieces of ``capacity`` tokens; the first may be shorter.
   A task numbers its pieces within each length.
2. All patterns of up to three lengths that fill a sequence exactly are enumerated. Non-negative least squares (an active set with the
   inverse of its normal equations) finds how often each should repeat for the histogram; the numbers are rounded and cut to what is left.
3. What no pattern took is packed by best fit decreasing, on the histogram as well: equal sequences are filled together.
4. The places of a length are numbered through over the plan, and the n-th piece of a length over all tasks takes the n-th place.

Null and empty texts are a document of the end id alone. A very long text is a run of full sequences and one shorter piece. Repeated rows and
rows that share a key or have none are each packed. Ties between patterns go to the first enumerated. An empty table gives an empty one.
Only key and text are read, so other columns can have any names. Sequence numbers run from 0 without gaps.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import keyed, slices, written
from trackframe.llm.tokens import ByteLevel, loaded

#: Lengths in a pattern.
FEW = 3
#: Bytes of text that are encoded at once: the more, the more often a word is found again.
SLICE = 16_000_000
#: The fit ends where the best pattern's gradient is this part of the first one's.
GAIN = 0.002
#: Up to so many (task, length) rows are broadcast; more are joined.
BROADCAST = 500_000


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of up to FEW present lengths, in falling order with 0 for none, that sum to ``capacity``."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    have[0] = True
    a, b = np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij")
    c = capacity - a - b
    ok = (a >= b) & (b >= c) & (c >= 0) & have[np.maximum(c, 0)]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nnls(choices: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with least |W (A x - b)|: column j of A counts the lengths of pattern j, W weighs a length by itself, as a long piece left over costs most.

    The active set grows by the pattern with the steepest gradient, until none gains half a piece of full length, or ``GAIN`` of the
    first one. The inverse of the active normal equations is bordered when a pattern enters and shrunk when one leaves, so a step
    costs the square of the set's size.
    """
    n, size = len(b), min(len(b), len(choices)) + 1
    weight = (np.arange(n) / (n - 1)) ** 2
    b = b * (weight > 0)
    inverse, columns, x, active, barred = np.zeros((size, size)), np.zeros((size, n)), np.zeros(len(choices)), [], np.zeros(len(choices), bool)
    residual, enough = b.astype(float), 0.0
    for step in range(6 * n if len(choices) else 0):
        gradient = (residual * weight)[choices].sum(1)
        gradient[active] = gradient[barred] = -np.inf
        j = int(gradient.argmax())
        enough = enough or max(0.5, GAIN * gradient[j])
        if gradient[j] <= enough:
            break
        column = np.bincount(choices[j], minlength=n) * (weight > 0)
        k = len(active)
        v = columns[:k] @ (weight * column)
        u = inverse[:k, :k] @ v
        s = (weight * column) @ column - v @ u
        if s < 1e-9:  # a sum of active patterns
            barred[j] = True
            continue
        inverse[:k, :k] += np.outer(u, u) / s
        inverse[:k, k] = inverse[k, :k] = -u / s
        inverse[k, k], columns[k] = 1 / s, column
        active.append(j)
        while active:
            k = len(active)
            z = inverse[:k, :k] @ (columns[:k] @ (weight * b))
            if z.min() > 0:
                x[active] = z
                break
            now, low = x[active], np.flatnonzero(z <= 0)
            ratio = now[low] / np.maximum(now[low] - z[low], 1e-300)
            now = now + ratio.min() * (z - now)
            x[active] = now
            for gone in np.union1d(np.flatnonzero(now <= 1e-10 * b.max()), low[[ratio.argmin()]])[::-1].tolist():
                last = len(active) - 1  # the pattern that leaves changes places with the last
                for table in (inverse, inverse.T, columns):
                    table[[gone, last]] = table[[last, gone]]
                active[gone], active[last] = active[last], active[gone]
                inverse[:last, :last] -= np.outer(inverse[:last, last], inverse[last, :last]) / inverse[last, last]
                x[active.pop()] = 0
        k = len(active)
        if step % 200 == 199:
            inverse[:k, :k] = np.linalg.inv((columns[:k] * weight) @ columns[:k].T)
        residual = b - x[active] @ columns[:k]
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit decreasing over a histogram: (lengths with how many of each, number of such sequences)."""
    room: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            least = min((r for r in room if r >= length), default=None)
            bins, had = room[least].pop() if least else ([], n)
            space = least or capacity
            if least and not room[least]:
                del room[least]
            each = space // length
            full = min(had, n // each)
            if full:
                room[space - each * length].append(([*bins, (length, each)], full))
                n -= full * each
            else:
                full = 1
                room[space - n * length].append(([*bins, (length, n)], 1))
                n = 0
            if least and had > full:
                room[least].append((bins, had - full))
    return [x for r in sorted(room) for x in room[r]]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences as (lengths with how many of each, repeats): fitted patterns, then best fit for the rest."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = [([(capacity, 1)], int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    choices = patterns(np.flatnonzero(left), capacity)
    x = nnls(choices, left)
    for j in np.argsort(-x, kind="stable")[: int((x >= 0.5).sum())].tolist():
        lengths, times = np.unique(choices[j][choices[j] > 0], return_counts=True)
        n = int(min(round(x[j]), (left[lengths] // times).min()))
        if n:
            left[lengths] -= n * times
            out.append((list(zip(lengths.tolist(), times.tolist())), n))
    return out + best_fit(left, capacity)


class Places:
    """For each length its places in order: runs of them by the place's number, with what gives sequence and offset."""

    def __init__(self, planned: list[tuple[list[tuple[int, int]], int]]):
        rows, taken, base = defaultdict(list), defaultdict(int), 0
        for lengths, repeats in planned:
            offset = 0
            for length, times in lengths:
                rows[length].append((taken[length], base, times, offset))
                taken[length] += times * repeats
                offset += length * times
            base += repeats
        self.rows = {length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in rows.items()}
        self.sequences = base

    def find(self, length: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the places of a length."""
        first, base, times, offset = self.rows[length]
        at = np.searchsorted(first, place, "right") - 1
        n = place - first[at]
        return base[at] + n // times[at], offset[at] + n % times[at] * length


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, end: int = 2, ids: bool = False, paths: tuple[str | None, ...] = ()) -> DataFrame:
    """(key, piece, start, length, ids_crc32, task, nth): ``nth`` counts the task's pieces of a length; with ``ids``, the piece's ids too."""
    docs = keyed(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = loaded(ByteLevel, *paths), TaskContext.get().partitionId()
        seen: dict[int, Iterator[int]] = defaultdict(counter)
        for b in batches:
            texts = b.column(1).fill_null("")
            sizes = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
            for i, j in slices(sizes, SLICE):
                rows: list[tuple] = []
                parts: list[np.ndarray] = []
                for k, found in enumerate(encoder.batch(texts.slice(i, j - i))):
                    all_ids = np.append(found, np.uint32(end)).astype("<u4")
                    bounds = [0, *range(len(all_ids) % capacity or capacity, len(all_ids) + 1, capacity)]
                    for p, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                        rows.append((i + k, p, lo, hi - lo, zlib.crc32(all_ids[lo:hi].tobytes()), next(seen[hi - lo])))
                        if ids:
                            parts.append(all_ids[lo:hi])
                at, piece, start, length, crc, nth = zip(*rows)
                columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(rows), pa.int64()), pa.array(nth, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(np.concatenate(parts).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    extra = ", ids array<int>" if ids else ""
    return written(docs.mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long{extra}"), "pieces")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, end: int = 2, ids: bool = False, paths: tuple[str | None, ...] = (), broadcast: int = BROADCAST) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece; with ``ids``, its ids too, for ``sequences``.

    ``paths`` are the files of the tokenizer, of the same vocabulary as ranks, and the pattern of its words.
    """
    found = pieces(docs, key, text, capacity, end, ids, paths)
    kind = found.schema[key].dataType.simpleString()
    cells = written(found.groupBy("task", "length").agg(F.count("*").alias("n")), "cells")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = found.join(F.broadcast(before) if cells.count() <= broadcast else before, ["task", "length"])
    names = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, place = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "place"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for value, at in zip(values.tolist(), np.split(order, first[1:])):
                sequence[at], offset[at] = places.value.find(value, place[at])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    extra = ", ids array<int>" if ids else ""
    return numbered.select(*(F.col(f"`{c}`") for c in names), (F.col("nth") + F.col("before")).alias("place")).mapInArrow(put, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long{extra}, sequence_id long, offset long")


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, parts): each sequence's ids in a row and which piece of which document stands where, from ``pack(..., ids=True)``."""
    part = F.struct("offset", F.col(f"`{key}`"), "piece", "length", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))  # at most ``capacity`` pieces
    spans = F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x[key].alias(key), x["piece"].alias("piece"), x["length"].alias("length")))
    return grouped.select("sequence_id", F.flatten("p.ids").alias("ids"), spans.alias("parts"))
