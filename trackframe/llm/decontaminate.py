"""Benchmark decontamination by spaced seeds.

A fixed mask keeps some of the words in a span and ignores the others, so a hash over the kept words survives
substitutions at the ignored places. Four steps:

1. Every item's masked hashes become a table of seeds. A bit table of bounded size (16 MB at most) tells which hashes can be among them, and
   up to ``KNOWN`` seeds are sent to the tasks, which spares hits that are none; the result is the same without.
2. One scan hashes all documents and keeps, of those with a hash that passes the bit table, their words' hashes and the hits.
3. Hits and seeds are joined on the hash. A document, an item and a diagonal (where the item would start) that share
   at least as many hits as any allowed overlap has are a candidate. A seed of more than ``COMMON`` items would give all documents with a
   common phrase with all its items. So where an overlap has several hits, such seeds are left out of this join: an overlap that has any
   other hit is found by that, and counts the item's common seeds as hits. One that has common hits alone has two of them as far apart as
   ``WITHIN`` tells, so those are joined in pairs, on both hashes and their distance.
4. Around the hits the words are compared along the diagonal, and an overlap of at least ``least`` words of which ``share``
   agree is reported. Words are compared in lower case without punctuation at their ends.

The masks miss none, for a share of 0.8 or more, and a smaller share is refused: of L words at most L // 5 differ, so the equal ones lie in at most L // 5 + 1
runs, and from 6 words on one run has four words or two runs of at least two are parted by a single word. Items of five words have
two masks more; shorter ones must stand in the text word by word.

Items of fewer than ``least`` words must agree as a whole to the same share. Null or empty texts and items match nothing, and empty
tables give an empty one. Repeated documents are each reported; repeated items are reported by the smallest id. Very long texts are
hashed whole. Only keys and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import REMEMBERED, bit_table, keyed, mix, passing, slices, text_bytes, unused, written

#: 1 keeps a word, 0 ignores it.
MASKS = ("1111", "11011")
#: By words of an item: the masks of shorter ones.
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: (*MASKS, "10111", "11101")}
#: The least number of hits on a diagonal for an item's words to be allowed an overlap, 1 where none is given; the last for all longer items.
LEAST_HITS = {8: 2, 9: 3, 11: 2, 12: 3, 13: 3}
#: Seeds of more items than this are joined in pairs.
COMMON = 16
#: By words of an item, as above: every allowed overlap has two hits whose starts are so many words apart, from and to.
WITHIN = {8: (2, 3), 9: (3, 3), 11: (1, 7), 12: (2, 7), 13: (3, 13)}
#: Up to so many distinct seeds (16 MB) tasks know them all, and a hash that is none of them is no hit; of more they know the bit table alone.
KNOWN = 2_000_000
#: Characters stripped from the ends of words.
EDGES = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


class _Plain(dict):
    """Hash of a lower-case word without the punctuation at its ends, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.strip(EDGES) or word)
        return value


_plain = _Plain()


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(_plain.__getitem__, words), np.uint64, len(words))


def masked(h: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each position: kept words' hashes times odd numbers, added and mixed."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return h[:0]
    out, factor = np.full(n, int(mask, 2), np.uint64), 0x9E3779B97F4A7C15
    for i, keep in enumerate(mask):
        if keep == "1":
            out += h[i : i + n] * np.uint64(factor)
            factor = (factor * 0xD1342543DE82EF95 + 2) & (2**64 - 1) | 1
    return mix(out)


def masks_of(words: int) -> tuple[str, ...]:
    return SHORT.get(words, MASKS)


def seeds_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An item's masked hashes, and where each starts. Each mask hashes differently, so one table serves all."""
    rows = [masked(h, m) for m in masks_of(len(h))] if len(h) else [h]
    return np.concatenate(rows), np.concatenate([np.arange(len(r)) for r in rows]).astype(np.int32)


def hits_of(h: np.ndarray, masks: list[str], table: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Masked hashes of ``h`` that pass the bit table, and are among the ``known`` ones where those are few, and where they start."""
    found, places = [h[:0]], [np.zeros(0, np.int64)]
    for mask in masks:
        x = masked(h, mask)
        at = np.flatnonzero(passing(table, x))
        if known is not None and len(at):
            near = np.minimum(np.searchsorted(known, x[at]), len(known) - 1)
            at = at[known[near] == x[at]]
        found.append(x[at])
        places.append(at)
    return np.concatenate(found), np.concatenate(places)


def paired(seeds: np.ndarray, places: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each two hits that start ``low`` to ``high`` words apart, of both and their distance, and where the first starts."""
    order = np.argsort(places, kind="stable")
    seeds, places = seeds[order].view(np.uint64), places[order].astype(np.int64)
    begin, end = np.searchsorted(places, places + low), np.searchsorted(places, places + high, "right")
    n = end - begin
    first = np.repeat(np.arange(len(seeds)), n)
    second = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    apart = (places[second] - places[first]).astype(np.uint64)
    return mix(seeds[first] + mix(seeds[second] + apart * np.uint64(0x9E3779B97F4A7C15))).view(np.int64), places[first]


def pairs_of(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """(pair, key, start) of rows (key, n, hits): hits are structs of seed and place, n the words of an item, null for a document."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widest = min(a for a, _ in WITHIN.values()), max(b for _, b in WITHIN.values())
        for b in batches:
            each = []
            for n, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                low, high = widest if n is None else WITHIN[min(n, max(WITHIN))]
                each.append(paired(np.array([h["seed"] for h in hits], np.int64), np.array([h["place"] for h in hits], np.int64), low, high))
            times = pa.array(np.repeat(np.arange(len(each)), [len(x) for x, _ in each]))
            if each:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in each])), b.column(0).take(times), pa.array(np.concatenate([p for _, p in each]))], ["pair", key, "start"])

    return rows.mapInArrow(pair, f"pair long, {key} {kind}, start long")


def overlap(h: np.ndarray, item: np.ndarray, diagonal: int, least: int, share: float) -> int:
    """Words that agree in the best stretch of the item along the diagonal that starts and ends with a match; 0 if too few."""
    lo, hi = max(0, -diagonal), min(len(item), len(h) - diagonal)
    same = h[diagonal + lo : diagonal + hi] == item[lo:hi]
    need = min(least, len(item))
    if hi - lo < need:
        return 0
    # The longest stretch with enough agreement: prefix sums of (agree - share), earliest smaller-or-equal start.
    sums = np.concatenate([[0.0], np.cumsum(same - share)])
    low = np.minimum.accumulate(sums)
    first = np.searchsorted(-low, -(sums + 1e-9), "left")
    length = np.arange(len(sums)) - first
    end = int(length.argmax())
    if length[end] < need:
        return 0
    return int(same[first[end] : end].sum())


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 13, share: float = 0.8, known: int = KNOWN, common: int = COMMON) -> DataFrame:
    """(key, item, n_agree, item_words): overlaps of documents with benchmark items, the best for each pair."""
    if not 0.8 <= share <= 1:
        raise ValueError("the masks find overlaps of which 0.8 or more agree")
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()

    def to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [word_hashes(t) for t in text_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in each], pa.int32()), pa.array([h.tobytes() for h in each], pa.binary())], ["item", "n", "item_words"])

    distinct = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where(F.length(F.trim("text")) > 0).groupBy("text").agg(F.min("item").alias("item")).select("item", "text")
    items = written(distinct.mapInArrow(to_words, f"item {item_kind}, n int, item_words binary"), "items")

    def to_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [seeds_of(np.frombuffer(w, np.uint64)) for w in b.column(2).to_pylist()]
            if each:
                times = np.repeat(np.arange(len(each)), [len(x) for x, _ in each])
                seeds, places = np.concatenate([x for x, _ in each]), np.concatenate([p for _, p in each])
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), b.column(0).take(pa.array(times)), b.column(1).take(pa.array(times)), pa.array(places, pa.int32())], ["seed", "item", "n", "place"])

    seeds = written(items.mapInArrow(to_seeds, f"seed long, item {item_kind}, n int, place int"), "seeds")
    per_seed = written(seeds.groupBy("seed").agg(F.count_distinct("item").alias("items")), "per_seed")
    total, most = per_seed.agg(F.count("*"), F.coalesce(F.max("items"), F.lit(0))).first()
    table = bit_table(per_seed, "seed")
    lengths = [r[0] for r in items.select(F.least("n", F.lit(6))).distinct().collect()]
    every = np.sort(per_seed.select("seed").toArrow().column(0).to_numpy().view(np.uint64)) if total <= known else None
    shared = spark.sparkContext.broadcast((sorted({m for n in lengths for m in masks_of(n)}), table, every))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (masks, bits, exact), task, number = shared.value, TaskContext.get().partitionId(), 0
        for b in batches:
            texts = text_bytes(b, text)
            for i, j in slices(texts):
                rows: list[tuple] = []
                each = [word_hashes(t) for t in texts[i:j]]
                begin = np.cumsum([0, *(len(h) for h in each)])
                found, at = hits_of(np.concatenate(each), masks, bits, exact)
                doc = np.searchsorted(begin, at, "right") - 1
                order = np.argsort(doc, kind="stable")
                docs_of, first = np.unique(doc[order], return_index=True)
                for d, some in zip(docs_of.tolist(), np.split(order, first[1:])):
                    rows.append((number, i + d, each[d].tobytes(), found[some].view(np.int64), (at[some] - begin[d]).astype(np.int32)))  # one over the border of two documents finds no agreement
                    number += 1
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[k]) for r in rows)]).astype(np.int32)), pa.array(np.concatenate([r[k] for r in rows] or [np.zeros(0, t)]))) for k, t in ((3, np.int64), (4, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{r[0]}" for r in rows], pa.string()), b.column(0).take(pa.array([r[1] for r in rows], pa.int64())), pa.array([r[2] for r in rows], pa.binary()), *lists], ["row", key, "words", "seeds", "places"])

    found = written(keyed(docs, key, text).mapInArrow(scan, f"row string, `{key}` {kind}, words binary, seeds array<long>, places array<int>"), "hits")
    hits = found.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("row", F.col("h.seeds").alias("seed"), F.col("h.places").alias("position"))
    enough = F.lit(1)
    for n, h in LEAST_HITS.items():
        enough = F.when(F.col("n") >= n if n == max(LEAST_HITS) else F.col("n") == n, h).otherwise(enough)
    counted = written(seeds.join(per_seed, "seed"), "counted")
    shares = F.col("items") > common
    extra = counted.where(shares).groupBy("item").agg(F.count("*").alias("extra"))
    direct = counted.where(~shares | (enough == 1)).join(extra, "item", "left").fillna(0, ["extra"])
    diagonal = (F.col("position") - F.col("place")).alias("diagonal")
    diagonals = hits.join(direct, "seed").groupBy("row", "item", "n", "extra", diagonal).agg(F.count("*").alias("hits")).where(F.col("hits") + F.col("extra") >= enough).select("row", "item", "diagonal")
    if most > common:
        of = lambda place: F.collect_list(F.struct("seed", F.col(place).alias("place"))).alias("hits")
        in_items = pairs_of(counted.where(shares & (enough > 1)).groupBy("item", "n").agg(of("place")), "item", item_kind)
        in_docs = hits.join(per_seed.where(shares).select("seed"), "seed", "left_semi").groupBy("row").agg(F.lit(None).cast("int").alias("n"), of("position"))
        pairs = pairs_of(in_docs, "row", "string").withColumnRenamed("start", "position").join(in_items.withColumnRenamed("start", "place"), "pair")
        diagonals = diagonals.unionByName(pairs.select("row", "item", diagonal))
    candidates = diagonals.groupBy("row", "item").agg(F.collect_set("diagonal").alias("diagonals"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = []
            for words, of, diagonals in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                h, other = np.frombuffer(words, np.uint64), np.frombuffer(of, np.uint64)
                best.append(max(overlap(h, other, d, least, share) for d in diagonals))
            n = pa.array([len(x) // 8 for x in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int64()), n], [key, item, "n_agree", "item_words"]).filter(pa.array([x > 0 for x in best], pa.bool_()))

    both = candidates.join(items.select("item", "item_words"), "item").join(found.select("row", F.col(f"`{key}`").alias("key"), "words"), "row")
    return both.select("key", "item", "words", "item_words", "diagonals").mapInArrow(verify, f"`{key}` {kind}, `{item}` {item_kind}, n_agree long, item_words long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item; a null key is never dropped."""
    gone = unused(docs, "gone")
    found = contaminated(docs, benchmark, key, **options).select(F.col(key).alias(gone)).distinct()
    return docs.join(found, F.col(f"`{key}`") == F.col(gone), "left_anti")
