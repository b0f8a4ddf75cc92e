"""Language-model scores by Katz backoff over word pairs.

Good-Turing discounts (counts up to ``K``) free probability for unseen events; every history's backoff weight is exactly
what makes its probabilities sum to one. A token is evaluated recursively: the discounted pair count, else the
history's backoff weight times the word's own probability, which again is a discounted count or a share of the unseen words' mass.

Every pair is counted, whatever its words. The ``vocabulary`` most frequent words have dense tables that go to every
task and have a fixed bound, as has the table of the ``TOP`` most frequent pairs of such words, which tasks score where they read the text;
both numbers change where a number is kept, never the number. A rarer word meets its own count and its pairs in the bucket of
its hash, as a successor and again as a history: there its share of a pair's probability is added (a count and the successor's own
probability in the successor's bucket, a total and a backoff weight in the history's). Keys of ever more words or pairs only add rows.

Words are lower-case (A-Z) runs of characters other than white space; a document ends with one end token, which is also
the history of its first word. Null and empty texts are the end token alone. Rows that share a key, and repeated rows, are scored each. A very
long text is scored whole, in a slice of its own. With nothing to train on every word is unknown; an empty table gives an empty one. Words are
told by 64-bit hashes; sums are of 64-bit numbers, partial ones too. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import SLICE_BYTES, hash_words, keyed, mix, shuffle_partitions, slices, text_bytes, written

K = 5
CLASSES = 1 << 16
OTHER, END = CLASSES - 1, CLASSES - 2
END_WORD = b"\n"
CHUNKS = 16
#: Pair entries that one bucket should hold.
BUCKET = 2_000_000
#: Most frequent pairs of frequent words, kept in every task (2 MB).
TOP = 200_000
#: Documents of a slice at most, so that a place and a mark fit in 16 bits.
SLICE_DOCS = 32_000


def discounts(n: list[int], k: int = K) -> np.ndarray:
    """Factors for counts 0..k+1 (the last for all above k) from the numbers n[1..k+1] of events seen 1..k+1 times.

    Katz's formula; where counts of counts are too few for factors between 0 and 1, one absolute discount serves instead.
    """
    d = np.ones(k + 2)
    n1 = n[1]
    if n1 and all(n[r] for r in range(1, k + 2)):
        cut = (k + 1) * n[k + 1] / n1
        d[1 : k + 1] = [((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut) if cut != 1 else 0 for r in range(1, k + 1)]
    if not n1 or (d[1:-1] <= 0).any() or (d[1:-1] >= 1).any():
        b = n1 / (n1 + 2 * n[2]) if n1 else 0.5
        b = min(max(b, 0.05), 0.95)
        d = np.array([1.0, *((r - b) / r for r in range(1, k + 1)), 1.0])
    return d


class Words:
    """Counts of the training words, their discounts, and the frequent words' classes."""

    def __init__(self, total: int, distinct: int, n: list[int], frequent: list[tuple[int, int]], end_count: int):
        self.total, self.distinct, self.end_count = total, distinct, end_count
        self.d = discounts(n)
        seen = sum(self.d[r] * r * n[r] for r in range(1, K + 1)) + (total - sum(r * n[r] for r in range(1, K + 1)))
        self.unseen = max(1 - seen / total, 0.5 / total) if total else 1.0
        self.scale = (1 - self.unseen) / (seen / total) if total else 0.0
        order = sorted(frequent, key=lambda x: np.uint64(x[0] & (2**64 - 1)))
        self.hashes = np.array([h for h, _ in order], np.int64).view(np.uint64)
        self.counts = np.zeros(CLASSES, np.int64)
        self.counts[: len(order)] = [c for _, c in order]
        self.counts[END] = end_count
        self.p = self.own(self.counts)
        self.p[len(order) : END] = 0
        self.p[OTHER] = max(1 - self.p[:OTHER].sum(), 1e-12)

    def own(self, count: np.ndarray) -> np.ndarray:
        """A word's probability by its count; a count of 0 is the class of all unseen words."""
        c = np.asarray(count)
        seen = self.d[np.minimum(c, K + 1)] * c * self.scale / max(self.total, 1)
        return np.where(c > 0, seen, self.unseen)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((np.asarray(count) + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def classes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), OTHER, np.uint32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, OTHER).astype(np.uint32)


class Pairs:
    """Discounts and, by history, totals, backoff weights and scales."""

    def __init__(self, words: Words, by_count: np.ndarray, n_last: int, lower: np.ndarray):
        """by_count: (CLASSES, K+1) sums of pair counts by size, the last above K; lower: the seen successors' own probability."""
        n = [0, *(int(by_count[:, r - 1].sum()) // r for r in range(1, K + 1)), n_last]
        self.d = discounts(n)
        self.total = by_count.sum(1)
        self.backoff, self.scale = self.weights(self.total, (by_count * self.d[1 : K + 2]).sum(1), lower)

    @staticmethod
    def weights(total: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backoff weights and scales of histories by their counts' sum, that sum discounted, and the seen successors' own probability."""
        some = total > 0
        seen = np.where(some, kept / np.maximum(total, 1), 0)
        rest = 1 - lower
        # Frequent successors are not discounted: a history that has no others keeps half an event for the rest.
        free = np.where(rest > 1e-9, np.maximum(1 - seen, 0.5 / (total + 1)), 0)
        return np.where(some, free / np.maximum(rest, 1e-9), 1.0), np.where(some, (1 - free) / np.maximum(seen, 1e-12), 1.0)

    def log10(self, words: Words, history: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        seen = self.scale[history] * self.d[np.minimum(count, K + 1)] * count / np.maximum(self.total[history], 1)
        return np.log10(np.maximum(np.where(count > 0, seen, self.backoff[history] * words.p[word]), 1e-300))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' tokens end to end, and the number of each."""
    words = [t.lower().split() + [END_WORD] for t in texts]
    return hash_words([w for ws in words for w in ws]), np.array([len(w) for w in words], np.int64)


def pair_ids(words: Words, h: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """History and word of every token: a frequent word's class, else the word's hash."""
    c = words.classes(h)
    word = np.where(h == END_HASH, np.uint64(END), np.where(c == OTHER, h, c.astype(np.uint64)))
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[np.cumsum(lengths) - lengths] = END
    return history, word


END_HASH = hash_words([END_WORD])[0]


def packed(order: np.ndarray, part: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Cut arrays, taken in ``order``, where ``part`` changes: one binary value a part."""
    part = part[order]
    ids, at = np.unique(part, return_index=True)
    cuts = np.append(at, len(order)).tolist()
    return ids, [pa.array([y[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()) for y in (x[order] for x in arrays)]


def pair_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def grouped(owner: np.ndarray, buckets: int, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Rows by owner, cut by the owner's bucket: owners, the number of rows of each (an owner with more than 255 stands again), and the columns."""
    order = np.argsort(owner, kind="stable")
    o = owner[order]
    first = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
    size = np.diff(np.append(first, len(o)))
    again = (size - 1) // 255 + 1
    keys, sizes = np.repeat(o[first], again), np.full(int(again.sum()), 255, np.uint8)
    sizes[np.cumsum(again) - 1] = size - 255 * (again - 1)
    key_part = pair_bucket(keys, buckets)
    part = np.repeat(key_part, sizes)
    ids, out = packed(np.argsort(key_part, kind="stable"), key_part, keys, sizes)
    return ids, out + packed(np.argsort(part, kind="stable"), part, *(c[order] for c in columns))[1]


def counted(owner: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with their numbers in 16 bits; a pair with more stands again."""
    order = np.lexsort((other, owner))
    o, x = owner[order], other[order]
    first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (x[1:] != x[:-1])))
    n = np.diff(np.append(first, len(o)))
    again = (n - 1) // 65_535 + 1
    most = np.full(int(again.sum()), 65_535, np.uint16)
    most[np.cumsum(again) - 1] = n - 65_535 * (again - 1)
    return np.repeat(o[first], again), np.repeat(x[first], again), most


def pieces(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    for i, j in slices(texts, limit):
        yield from ((k, min(k + SLICE_DOCS, j)) for k in range(i, j, SLICE_DOCS))


#: Types of partial sums: score, pairs seen, words known, base score.
SUMS = (np.float64, np.uint32, np.uint32, np.float64)
#: Kinds of rows by what the other word of a pair is: a frequent one's class, or a hash.
OTHERS = {2: np.uint16, 4: np.uint64, 3: np.uint16, 5: np.uint64}


def joined(values: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind)


class Tally:
    """Entries (owner, other, number) of a bucket: each entry's pair and owner, and by pair and owner the sum of what counts."""

    def __init__(self, owner: np.ndarray, other: np.ndarray, n: np.ndarray):
        order = np.lexsort((other, owner))
        o, x = owner[order], other[order]
        new_owner = np.append(True, o[1:] != o[:-1])
        new = np.append(True, (o[1:] != o[:-1]) | (x[1:] != x[:-1]))
        self.pair, self.owner = np.empty(len(o), np.int64), np.empty(len(o), np.int64)
        self.pair[order], self.owner[order] = np.cumsum(new) - 1, np.cumsum(new_owner) - 1
        self.owners, self.others = o[new_owner], x[new]
        self.owner_of_pair = (np.cumsum(new_owner) - 1)[new]
        self.count = np.bincount(self.pair, n).astype(np.int64)
        self.total = np.bincount(self.owner, n).astype(np.int64)


def count_words(training: DataFrame, text: str = "text", vocabulary: int = 50_000) -> tuple[Words, DataFrame]:
    """Word counts of all training documents, as statistics and as a table (word, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b, text)
            for i, j in slices(texts, 12_000_000):
                h, n = np.unique(tokens(texts[i:j])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "count"])

    table = written(training.select(text).mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count")), "words")
    ends = F.sum(F.when(F.col("word") == int(END_HASH.view(np.int64)), F.col("count")))
    few = [F.sum((F.col("count") == r).cast("long")) for r in range(1, K + 2)]
    s = table.agg(F.sum("count"), F.count("*"), ends, *few).first()
    # The frequent words: all above the least count (in steps of a twentieth of a doubling) that leaves at most ``vocabulary``.
    step = F.floor(F.log2("count") * 20)
    limit, held = None, 0
    for row in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += row["count"]
        if held > vocabulary:
            break
        limit = row["step"]
    frequent = [] if limit is None else [(r[0], r[1]) for r in table.where((step >= limit) & (F.col("word") != int(END_HASH.view(np.int64)))).collect()]
    return Words(s[0] or 0, s[1], [0, *(x or 0 for x in s[3:])], frequent, s[2] or 0), table


def count_rare(training: DataFrame, words: Words, buckets: int, text: str = "text") -> DataFrame:
    """Of all training pairs with a word outside the vocabulary, by bucket: sums for the frequent histories, and rare histories' seen rare successors' own probability."""
    shared = training.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b, text)
            for i, j in slices(texts, 12_000_000):
                history, word = pair_ids(shared.value, *tokens(texts[i:j]))
                tail = word >= CLASSES
                after = history >= CLASSES
                for kind, some, owner, other in ((2, tail & ~after, word, history), (4, tail & after, word, history), (3, ~tail & after, history, word)):
                    if some.any():
                        o, x, n = counted(owner[some], other[some])
                        ids, (k, size, x, n) = grouped(o, buckets, x.astype(OTHERS[kind]), n)
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([kind] * len(ids), pa.int32()), k, size, x, n], ["bucket", "kind", "keys", "sizes", "others", "counts"])

    def merge(bucket: pa.Table) -> pa.Table:
        model, cells, last, lower = shared.value, [], 0, (np.zeros(0, np.uint64), np.zeros(0))
        for kind, kinds in ((2, (2, 4)), (3, (3,))):
            entries = []
            for k in kinds:
                rows = bucket.filter(pa.compute.equal(bucket.column("kind"), k))
                keys, sizes, others, n = (joined(rows.column(c).to_pylist(), x) for c, x in (("keys", np.uint64), ("sizes", np.uint8), ("others", OTHERS[k]), ("counts", np.uint16)))
                entries.append((np.repeat(keys, sizes), others.astype(np.uint64), n))
            owner, other, n = (np.concatenate([e[i] for e in entries]) for i in range(3))
            if not len(owner):
                continue
            t = Tally(owner, other, n)
            history = np.minimum(t.others, OTHER).astype(np.int64) if kind == 2 else np.full(len(t.others), OTHER)  # rare ones in one row: only their counts' counts are needed
            cells.append((history * (K + 1) + np.minimum(t.count, K + 1) - 1, t.count))
            last += int((t.count == K + 1).sum())
            if kind == 2:
                ids, place = np.unique(t.others, return_inverse=True)
                lower = ids, np.bincount(place, model.own(t.total)[t.owner_of_pair], len(ids))
        cell, place = np.unique(np.concatenate([c for c, _ in cells]), return_inverse=True)
        sums = np.bincount(place, np.concatenate([n for _, n in cells]), len(cell))
        values = [cell.astype(np.uint32), sums, *lower]
        return pa.table([pa.array([last], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=["last", "cells", "sums", "histories", "lower"])

    found = training.select(text).mapInArrow(run, "bucket long, kind int, keys binary, sizes binary, others binary, counts binary")
    return written(found.groupBy("bucket").applyInArrow(merge, "last long, cells binary, sums binary, histories binary, lower binary"), "rare")


def count_pairs(training: DataFrame, words: Words, buckets: int, text: str = "text", rare: DataFrame | None = None) -> tuple[Pairs, DataFrame]:
    """Pair counts of all training documents, as statistics by frequent history and, of frequent words, as a table partitioned by bucket. ``rare``: what ``count_rare`` found."""
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b, text)
            for i, j in slices(texts, 12_000_000):
                history, word = pair_ids(shared.value, *tokens(texts[i:j]))
                both = (history < CLASSES) & (word < CLASSES)
                if not both.any():
                    continue
                keys, n = np.unique((history[both] << np.uint64(16) | word[both]).astype(np.uint32), return_counts=True)
                part = pair_bucket(keys, buckets)
                ids, (k, c) = packed(np.argsort(part, kind="stable"), part, keys, n.astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array(ids), k, c], ["bucket", "keys", "counts"])

    def merge(bucket: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(bucket.column("keys").to_pylist()), np.uint32)
        n = np.frombuffer(b"".join(bucket.column("counts").to_pylist()), np.uint32)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
        sums = np.add.reduceat(n[order].astype(np.int64), at) if len(keys) else n.astype(np.int64)
        return pa.table({"bucket": pa.array([bucket.column("bucket")[0].as_py()], pa.int64()), "keys": pa.array([keys[at].tobytes()], pa.binary()), "counts": pa.array([sums.tobytes()], pa.binary())})

    schema = "bucket long, keys binary, counts binary"
    table = written(training.select(text).mapInArrow(run, schema).groupBy("bucket").applyInArrow(merge, schema), "pairs")

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_count, lower, last = np.zeros((CLASSES, K + 1)), np.zeros(CLASSES), 0
        for b in batches:
            for keys, n in zip(b.column(1), b.column(2)):
                k, n = np.frombuffer(keys.as_buffer(), np.uint32), np.frombuffer(n.as_buffer(), np.int64)
                h, w = k >> np.uint32(16), k & np.uint32(CLASSES - 1)
                by_count += np.bincount(h.astype(np.int64) * (K + 1) + np.minimum(n, K + 1) - 1, n, CLASSES * (K + 1)).reshape(CLASSES, K + 1)
                lower += np.bincount(h, shared.value.p[w], CLASSES)
                last += int((n == K + 1).sum())
        yield chunks(by_count, lower, last)

    def rare_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_count, lower, last = np.zeros(CLASSES * (K + 1)), np.zeros(CLASSES), 0
        for b in batches:
            for more, *values in zip(*(b.column(i).to_pylist() for i in range(5))):
                cell, n, h, p = (np.frombuffer(v, t) for v, t in zip(values, (np.uint32, np.float64, np.uint64, np.float64)))
                by_count += np.bincount(cell, n, CLASSES * (K + 1))
                dense = h < CLASSES
                lower += np.bincount(h[dense].astype(np.int64), p[dense], CLASSES)
                last += more
        yield chunks(by_count.reshape(CLASSES, K + 1), lower, last)

    def chunks(by_count: np.ndarray, lower: np.ndarray, last: int) -> pa.RecordBatch:
        all_of = np.concatenate([by_count, lower[:, None], np.eye(1, CLASSES).T * last], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([x.tobytes() for x in np.split(all_of, CHUNKS)], pa.binary())], ["chunk", "sums"])

    def add(chunk: pa.Table) -> pa.Table:
        total = np.zeros(CLASSES // CHUNKS * (K + 3))
        for x in chunk.column("sums").to_pylist():
            total += np.frombuffer(x)
        return pa.table({"chunk": pa.array([chunk.column("chunk")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = table.mapInArrow(stats, "chunk int, sums binary")
    if rare is not None:
        parts = parts.unionByName(rare.mapInArrow(rare_stats, "chunk int, sums binary"))
    rows = parts.groupBy("chunk").applyInArrow(add, "chunk int, sums binary").collect()  # 65 536 histories, 4 MB
    sums = np.concatenate([np.frombuffer(r["sums"]).reshape(-1, K + 3) for r in sorted(rows, key=lambda r: r["chunk"])]) if rows else np.zeros((CLASSES, K + 3))
    return Pairs(words, sums[:, : K + 1], int(sums[:, K + 2].sum()), sums[:, K + 1]), table


def top_pairs(table: DataFrame, most: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Of a table of pairs, those with the highest counts: all above the least count (in steps of a twentieth of a doubling) that leaves at most ``most``."""
    step = lambda n: np.floor(np.log2(n) * 20).astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64 * 20, np.int64)
        for b in batches:
            for n in b.column(0).to_pylist():
                total += np.bincount(step(np.frombuffer(n, np.int64)), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["step", "n"])

    limit, held = None, 0
    for row in table.select("counts").mapInArrow(spread, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect():
        held += row["n"]
        if held > most:
            break
        limit = row["step"]

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k, n = np.frombuffer(keys, np.uint32), np.frombuffer(n, np.int64)
                some = step(n) >= limit
                yield pa.RecordBatch.from_arrays([pa.array([k[some].tobytes()], pa.binary()), pa.array([n[some].tobytes()], pa.binary())], ["keys", "counts"])

    rows = [] if limit is None else table.select("keys", "counts").mapInArrow(above, "keys binary, counts binary").collect()
    keys, n = joined([r["keys"] for r in rows], np.uint32), joined([r["counts"] for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", vocabulary: int = 50_000) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_pairs_seen) of every document; the model learns from those not held out."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    docs = keyed(docs, key, text).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    training = docs.where(~F.col("held_out"))
    words, _ = count_words(training, text, vocabulary)
    buckets = max(2 * shuffle_partitions(spark), -(-words.total // BUCKET))
    rare = count_rare(training, words, buckets, text)
    pairs, table = count_pairs(training, words, buckets, text, rare)
    shared = spark.sparkContext.broadcast((words, pairs, *top_pairs(table)))  # fixed size: 65 536 classes, 200 000 pairs
    row = "slice string, bucket long, kind int, keys binary, sizes binary, others binary, at binary"
    names = ["slice", "bucket", "kind", "keys", "sizes", "others", "at"]

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: documents of a slice with what is known of them. By document, kind 1: pairs of frequent words; kinds 2 and 4: other words, each with its histories; kinds 3 and 5: other histories, each with its successors."""
        model, pair_model, top, top_counts = shared.value
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            texts, ids, held = text_bytes(b, text), b.column(0), b.column(2).to_numpy(zero_copy_only=False)
            for i, j in pieces(texts, SLICE_BYTES):
                h, lengths = tokens(texts[i:j])
                doc = np.repeat(np.arange(j - i), lengths)
                history, word = pair_ids(model, h, lengths)
                tail, after = word >= CLASSES, history >= CLASSES
                c = np.minimum(word, OTHER).astype(np.int64)
                base = np.bincount(doc[~tail], model.base(model.counts[c[~tail]]), j - i)
                known = np.bincount(doc[~tail], model.counts[c[~tail]] > 0, j - i)
                name = f"{task}-{number}"
                number += 1
                both = ~tail & ~after
                keys = (history << np.uint64(16) | word).astype(np.uint32)
                at = np.minimum(np.searchsorted(top, keys), max(len(top) - 1, 0))
                often = both & (top[at] == keys) if len(top) else np.zeros(len(keys), bool)
                value = pair_model.log10(model, history[often].astype(np.int64), word[often].astype(np.int64), top_counts[at[often]])
                sums = np.bincount(doc[often], value, j - i).astype(float), np.bincount(doc[often], minlength=j - i)
                both &= ~often
                plain = pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(held[i:j]), pa.array(lengths), pa.array(base), pa.array(known.astype(np.int64)), *map(pa.array, sums)], ["key", "held_out", "n", "base", "known", "score", "pairs"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, plain.schema) as w:
                    w.write_batch(plain)
                none = pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([crc32(name.encode()) % buckets], pa.int64()), pa.array([0], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), none, none, none], names)
                mark = (doc << 1 | np.where(held[i:j], 0, 1)[doc]).astype(np.uint16)
                for what, some, owner, other in ((1, both, keys, None), (2, tail & ~after, word, history), (4, tail & after, word, history), (3, after & ~tail, history, word), (5, after & tail, history, word)):
                    if not some.any():
                        continue
                    ids_of, (k, s, *x, a) = grouped(owner[some], buckets, *([] if other is None else [other[some].astype(OTHERS[what])]), mark[some])
                    m = len(ids_of)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(ids_of), pa.array([what] * m, pa.int32()), k, s, x[0] if x else pa.nulls(m, pa.binary()), a], names)

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """By slice and document, the sums of a bucket's occurrences; kind 0 passes through."""
        model, pair_model, _, _ = shared.value
        of = [right.filter(pa.compute.equal(right.column("kind"), kind)) for kind in (1, 3)]
        (known_keys, known_counts), (low_keys, low_sums) = ([joined(t.column(c).to_pylist(), x) for c, x in zip(("keys", "counts"), kinds)] for t, kinds in zip(of, ((np.uint32, np.int64), (np.uint64, np.float64))))
        out: list[tuple] = []
        rest: dict[int, list[tuple]] = {2: [], 3: []}
        for name, what, k, s, x, a in zip(*(left.column(c).to_pylist() for c in ("slice", "kind", "keys", "sizes", "others", "at"))):
            if what == 0:
                out.append((name, k, None, None, None, None, None))
                continue
            keys, size, at = np.frombuffer(k, np.uint32 if what == 1 else np.uint64), np.frombuffer(s, np.uint8), np.frombuffer(a, np.uint16)
            if what != 1:
                rest[2 + what % 2].append((name, np.repeat(keys, size), np.frombuffer(x, OTHERS[what]).astype(np.uint64), at))
                continue
            place = np.minimum(np.searchsorted(known_keys, keys), max(len(known_keys) - 1, 0))
            count = np.where(known_keys[place] == keys, known_counts[place], 0) if len(known_keys) else np.zeros(len(keys), np.int64)
            value = pair_model.log10(model, (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(CLASSES - 1)).astype(np.int64), count)
            out.append((name, None, *sums_of(at >> 1, np.repeat(value, size), np.repeat(count > 0, size))))
        for what, entries in rest.items():
            if not entries:
                continue
            owner, other, at = (np.concatenate([e[i] for e in entries]) for i in range(1, 4))
            t = Tally(owner, other, at & 1)
            c, seen = t.count, t.count > 0
            kept = pair_model.d[np.minimum(c, K + 1)] * c
            dense = t.others < CLASSES
            other_class = np.where(dense, t.others, OTHER).astype(np.int64)
            known = base = None
            if what == 2:  # by the word: counts, and the share of frequent histories
                total = t.total[t.owner_of_pair]
                backoff, scale = (np.where(dense, v[other_class], 1.0) for v in (pair_model.backoff, pair_model.scale / np.maximum(pair_model.total, 1)))
                value = np.where(seen, kept * scale, model.own(total) * backoff)
                known, base = (total > 0)[t.pair], model.base(total)[t.pair]
            else:  # by the history: its backoff weight, and counts of frequent words
                lower = np.bincount(t.owner_of_pair, np.where(dense & seen, model.p[other_class], 0.0), len(t.owners))
                if len(low_keys):
                    place = np.searchsorted(t.owners, low_keys)  # each is there, since training documents are scored too
                    lower += np.bincount(place, low_sums, len(t.owners))
                backoff, scale = Pairs.weights(t.total, np.bincount(t.owner_of_pair, kept, len(t.owners)), lower)
                scale = (scale / np.maximum(t.total, 1))[t.owner_of_pair]
                value = np.where(seen, scale * np.where(dense, kept, 1.0), backoff[t.owner_of_pair] * np.where(dense, model.p[other_class], 1.0))
            value = np.log10(np.maximum(value, 1e-300))[t.pair]
            found = (seen & (dense if what == 3 else True))[t.pair]
            begin = 0
            for name, _, _, a in entries:
                e = slice(begin, begin + len(a))
                begin += len(a)
                out.append((name, None, *sums_of(a >> 1, value[e], found[e], *(() if base is None else (known[e], base[e])))))
        kinds = [pa.string(), *[pa.binary()] * 6]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["slice", "docs", "at", "score", "pairs", "known", "base"])

    def sums_of(doc: np.ndarray, value: np.ndarray, pairs: np.ndarray, known: np.ndarray | None = None, base: np.ndarray | None = None) -> tuple:
        ids, inverse = np.unique(doc, return_inverse=True)
        sums = ((v, t) for v, t in zip((value, pairs, known, base), SUMS))
        return ids.astype(np.uint16).tobytes(), *(None if v is None else np.bincount(inverse, v, len(ids)).astype(t).tobytes() for v, t in sums)

    def gather(part: pa.Table) -> pa.Table:
        plain, sums = None, []
        for docs_of, at, *values in zip(*(part.column(c).to_pylist() for c in ("docs", "at", "score", "pairs", "known", "base"))):
            if docs_of is not None:
                plain = pa.ipc.open_stream(docs_of).read_all().combine_chunks()
            else:
                sums.append((np.frombuffer(at, np.uint16), *(None if v is None else np.frombuffer(v, t) for v, t in zip(values, SUMS))))
        base, known = plain.column("base").to_numpy().copy(), plain.column("known").to_numpy().copy()
        value, pairs_seen = plain.column("score").to_numpy().copy(), plain.column("pairs").to_numpy().astype(np.int64)
        for at, s, q, k, b in sorted(sums, key=lambda x: (x[4] is None, x[0].tobytes(), x[1].tobytes(), x[2].tobytes())):  # in a fixed order, for equal sums
            value[at] += s
            pairs_seen[at] += q
            if b is not None:
                base[at] += b
                known[at] += k.astype(np.int64)
        n = len(base)
        return pa.table({key: plain.column("key").cast(key_type), "held_out": plain.column("held_out"), "n_tokens": plain.column("n"), "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, words.total)), "base_score": pa.array(base), "score": pa.array(value), "n_pairs_seen": pa.array(pairs_seen.astype(np.int64))})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rare histories' sums to their own buckets."""
        for b in batches:
            for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, p = np.frombuffer(h, np.uint64), np.frombuffer(p)
                h, p = h[h >= CLASSES], p[h >= CLASSES]
                if len(h):
                    part = pair_bucket(h, buckets)
                    ids, (k, v) = packed(np.argsort(part, kind="stable"), part, h, p)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([3] * len(ids), pa.int32()), k, v], ["bucket", "kind", "keys", "counts"])

    lows = rare.select("histories", "lower").mapInArrow(spread, "bucket long, kind int, keys binary, counts binary")
    counted = table.select("bucket", F.lit(1).alias("kind"), "keys", "counts").unionByName(lows)
    found = docs.select(key, text, "held_out").mapInArrow(occurrences, row)
    looked = found.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(look_up, "slice string, docs binary, at binary, score binary, pairs binary, known binary, base binary")
    return looked.groupBy("slice").applyInArrow(gather, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_pairs_seen long")
