"""Alignment of two tokenizers' tokens over the same bytes, with counts of the id pairs that meet.

Both tokenizers read " " + text. Tokens are byte ranges; a token of A and one of B are linked where their ranges overlap, and places where
both have an end cut a document into groups. Four steps:

1. In a batch, pandas' merge_asof keyed by document finds for each token start the other side's covering token, in both directions. The union is
   all overlaps: of two that overlap, the later start lies in the other. Equal starts (and so ends before them) part the groups.
   A document's row keeps its distinct id pairs and how often each links; rows are written.
2. Pairs are counted over the corpus, partial sums by task first, and for each B id the highest count is marked.
3. The most frequent pairs, at most ``KNOWN``, go to all tasks, which sum what they know.
4. Pairs outside that table are joined with the counts by pair. None of those can hold more than 1/KNOWN of all links, so no key is hot.

Null and empty texts, and those whose tokens by either side do not give the bytes again, have no tokens: zeros and an empty digest. Very long
texts are aligned whole, alone in their batch. Rows that share a key or have none are documents of their own. Ties for a B id's highest
count all count as highest. An empty table gives an empty one. Only key and text are read. Vocabularies whose sizes multiply to
2^31 or more are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import keyed, slices, text_bytes, written
from trackframe.llm.tokens import Pair, loaded

#: Pairs that all tasks know, at most (13 bytes each).
KNOWN = 2_000_000
#: Bytes of text whose words are encoded together, and bytes that are aligned together.
ENCODED, ALIGNED = 8_000_000, 1_500_000
#: Pairs that a task gathers before it counts them.
GATHERED = 4_000_000


class Aligned:
    """Links and groups of the documents of a batch, laid end to end."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], lengths_a: np.ndarray, lengths_b: np.ndarray):
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a, self.b = (np.concatenate([*side, np.zeros(0, np.uint32)]).astype(np.int64) for side in (a, b))
        self.docs = len(a)
        doc_a, doc_b = (np.repeat(np.arange(self.docs), n) for n in (self.n_a, self.n_b))
        left = pd.DataFrame({"doc": doc_a, "start": np.cumsum(lengths_a[self.a]) - lengths_a[self.a]})
        right = pd.DataFrame({"doc": doc_b, "start": np.cumsum(lengths_b[self.b]) - lengths_b[self.b]})
        left["a"], left["a_start"] = np.arange(len(left)), left["start"]
        right["b"], right["b_start"] = np.arange(len(right)), right["start"]
        to_b = pd.merge_asof(left, right[["doc", "start", "b", "b_start"]], on="start", by="doc")
        to_a = pd.merge_asof(right, left[["doc", "start", "a", "a_start"]], on="start", by="doc")
        opens = (to_b["start"] == to_b["b_start"]).to_numpy()  # both have an end before this token of A
        alone = (to_a["start"] != to_a["a_start"]).to_numpy()  # links that the other direction has not found
        self.link_a = np.concatenate([to_b["a"].to_numpy(), to_a["a"].to_numpy()[alone]])
        self.link_b = np.concatenate([to_b["b"].to_numpy(), to_a["b"].to_numpy()[alone]])
        self.link_doc = np.concatenate([doc_a, doc_b[alone]])
        self.n_links, self.n_groups = np.bincount(self.link_doc, minlength=self.docs), np.bincount(doc_a[opens], minlength=self.docs)
        self.group_a = np.cumsum(opens) - 1
        self.opens_b = ~alone
        self.group_b = np.cumsum(self.opens_b) - 1
        self.opens_a = opens

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times) of each document's distinct id pairs in order; a pair is a * width + b."""
        found, times = np.unique(self.link_doc << 31 | self.a[self.link_a] * width + self.b[self.link_b], return_counts=True)
        return found >> 31, found & (1 << 31) - 1, times

    def groups(self, said: list[list[bytes]]) -> list[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``. ``said`` has ids as text after ';', ',' and '|'."""
        n = int(self.opens_a.sum())
        in_a, in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        kind, ids = np.ones(len(self.a) + len(self.b), np.int64), np.zeros(len(self.a) + len(self.b), np.int64)
        at_a, at_b = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a], np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]
        kind[at_a[self.opens_a]], kind[at_b[self.opens_b]] = 0, 2
        ids[at_a], ids[at_b] = self.a, self.b
        table, bounds = [*said[0], *said[1], *said[2]], [0, *np.cumsum(self.n_a + self.n_b).tolist()]
        texts = list(map(table.__getitem__, (kind * len(said[0]) + ids).tolist()))
        return [b"".join(texts[i:j])[1:] for i, j in zip(bounds, bounds[1:])]


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: bool = False, paths: tuple[str | None, ...] = ()) -> DataFrame:
    """(row, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), written; ``pairs`` and ``times`` hold packed numbers, for ``pair_counts``. With ``groups``, their text too."""
    docs = keyed(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    names = ["row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups"] if groups else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = loaded(Pair, *paths), TaskContext.get().partitionId() << 33
        if both.a.size * both.n_b >= 1 << 31:
            raise ValueError("the vocabularies' sizes multiply to 2^31 or more")
        numbers = [str(i).encode() for i in range(max(both.a.size, both.n_b))]
        said = [[mark + x for x in numbers] for mark in (b";", b",", b"|")]
        for batch in batches:
            texts, sizes = batch.column(1).fill_null(""), text_bytes(batch, text)
            for i, j in slices(sizes, ENCODED):
                all_a, all_b = both.batch(texts.slice(i, j - i))
                for lo, hi in slices(sizes[i:j], ALIGNED):
                    found = Aligned(all_a[lo:hi], all_b[lo:hi], both.a.lengths, both.b_lengths)
                    doc, pairs, times = found.pairs(both.n_b)
                    steps = np.diff(pairs, prepend=0)
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    steps[first] = pairs[first]
                    bounds = np.searchsorted(doc, np.arange(hi - lo + 1)).tolist()
                    said_groups = found.groups(said)
                    packed = [[x[s:e].tobytes() for s, e in zip(bounds, bounds[1:])] for x in (steps.astype("<i4"), times.astype("<i4"))]
                    digests = [hashlib.sha256(g).hexdigest() if g else "" for g in said_groups]
                    columns = [pa.array(np.arange(row, row + hi - lo)), batch.column(0).slice(i + lo, hi - lo), *(pa.array(x.astype(np.int64)) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)), pa.array(digests, pa.string()), *(pa.array(x, pa.binary()) for x in packed)]
                    row += hi - lo
                    if groups:
                        columns.append(pa.array([g.decode() for g in said_groups], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    extra = ", groups string" if groups else ""
    return written(docs.mapInArrow(read, f"row long, `{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary{extra}"), "aligned")


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of each row, pair, times) of a batch with the columns ``pairs`` and ``times``."""
    packed, times = ([x or b"" for x in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in ("pairs", "times"))
    bounds = np.cumsum([0, *(len(x) // 4 for x in packed)])
    sums = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(packed), "<i4"), dtype=np.int64)])
    return bounds, sums[1:] - np.repeat(sums[bounds[:-1]], np.diff(bounds)), np.frombuffer(b"".join(times), "<i4").astype(np.int64)


def pair_counts(found: DataFrame, paths: tuple[str | None, ...] = ()) -> DataFrame:
    """(pair, a, b, n, best): how many links of the corpus hold each pair of ids, and whether no pair of its B id has more; written."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, held, size = loaded(Pair, *paths).n_b, [], 0

        def counted() -> pa.RecordBatch:
            pairs, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, at, np.concatenate([h[1] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array((pairs % width).astype(np.int32)), pa.array(n)], ["pair", "b", "n"])

        for batch in batches:
            _, pairs, times = unpacked(batch)
            held.append((pairs, times))
            size += len(pairs)
            if size >= GATHERED:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    sums = found.select("pairs", "times").mapInArrow(gather, "pair int, b int, n long").groupBy("pair", "b").agg(F.sum("n").alias("n"))
    best = F.col("n") == F.max("n").over(Window.partitionBy("b"))  # a B id has at most as many pairs as A has ids
    width = F.lit(loaded(Pair, *paths).n_b)
    return written(sums.select("pair", ((F.col("pair") - F.col("b")) / width).cast("int").alias("a"), "b", "n", best.alias("best")), "counts")


def scored(found: DataFrame, counts: DataFrame, known: int = KNOWN) -> DataFrame:
    """``found`` without its packed columns, with n_best (links whose pair has its B id's highest count) and count_sum (counts over links)."""
    kept = [c for c in found.columns if c not in ("pairs", "times")]
    grade = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["grade"], r["size"]) for r in counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("size")).collect()), reverse=True)  # some hundred rows
    taken = np.cumsum([s for _, s in sizes])
    fits = int(np.searchsorted(taken, known, "right"))
    table = counts.where(grade >= sizes[fits - 1][0] if fits else F.lit(False)).select("pair", "n", "best").toArrow().sort_by("pair")  # at most ``known`` rows
    shared = found.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name in kept)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            bounds, pairs, times = unpacked(batch)
            at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
            hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            at = at[hit]
            row = np.zeros((2, len(pairs) + 1), np.int64)
            row[0, 1:][hit], row[1, 1:][hit] = best[at] * times[hit], n[at] * times[hit]
            sums = np.diff(np.cumsum(row, axis=1)[:, bounds], axis=1)
            rest = np.concatenate([[0], np.cumsum(~hit)])[bounds].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~hit])) for x in (pairs.astype(np.int32), times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sums[0]), pa.array(sums[1]), *lists], [*kept, "n_best", "count_sum", "rest", "rest_times"])

    out = found.mapInArrow(add, f"{kinds}, n_best long, count_sum long, rest array<int>, rest_times array<long>")
    if fits == len(sizes):  # every pair is in the table
        return out.drop("rest", "rest_times")
    out = written(out, "scored")
    links = out.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("l")).select("row", F.col("l.rest").alias("pair"), F.col("l.rest_times").alias("t"))
    more = links.join(counts.select("pair", "n", "best"), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more_sum"))
    joined = out.drop("rest", "rest_times").join(more, "row", "left")
    return joined.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: bool = False, paths: tuple[str | None, ...] = (), known: int = KNOWN) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document; with ``groups``, the groups' text too.

    ``paths`` are the byte-level vocabulary as ranks, the piece model, and the pattern of words.
    """
    found = aligned(docs, key, text, groups, paths)
    out = scored(found, pair_counts(found, paths), known)
    return out.select(*(F.col(f"`{c}`") for c in (key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []))))
