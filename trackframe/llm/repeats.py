"""Passages that repeat across documents, located by Aho-Corasick automata.

A window is ``window`` consecutive words of one document; each word that is covered by a window whose words also start
in a document with a smaller key is removed. Four steps:

1. In every window the phrase of ``PHRASE`` words with the smallest hash is its anchor, so equal windows have equal anchors.
   Anchors that stand in two different texts are confirmed as recurring; exact copies are told by their digest (128 bits),
   different texts by 64 bits of it.
2. Documents are dealt to shards of bounded bytes by key. A shard gets each recurring anchor that stands in it with one place (key
   and position), reads the passage's words there and compiles them into its automaton, over numbers for words. All documents
   stream through the automaton of the phrases that can stand in them, and every occurrence is one that the automaton reports.
3. Windows around occurrences are told by 96 bits; per window the smallest key is found by a partial aggregate,
   and later windows are joined with it. They meet the texts in buckets by shard, which are not shuffled again.
4. Covered words go. A copy of a document with a smaller key is covered as a whole if it has a window.

Null text has no words. A document shorter than the window stays whole; a very long one is one document of its shard and is
located and cut whole. Rows that share a key are one document in the comparison and are returned each. Rows with a null key
are compared with nothing, go to no shard and stay whole. An empty table gives an empty one. Only key and text are read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import bucketed, hash_words, keyed, mix, rolling, shuffle_partitions, text_bytes, written

PHRASE = 8
#: Bytes of text that a shard should hold.
SHARD_BYTES = 16_000_000
OTHER = np.uint64(0x5851F42D4C957F2D)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchor phrases of all windows, and the first position of each."""
    if len(h) < window:
        return h[:0], np.zeros(0, np.int32)
    phrases = rolling(h, PHRASE)
    found = np.unique(sliding_min(phrases, window - PHRASE + 1))
    at = np.minimum(np.searchsorted(found, phrases), len(found) - 1)
    places = np.flatnonzero(found[at] == phrases)
    return found, places[np.unique(at[places], return_index=True)[1]].astype(np.int32)


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()



def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, kept): ``kept`` has the words that stay, joined by one space."""
    docs = keyed(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(2 * shuffle_partitions(docs.sparkSession), -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(shards)).cast("int")

    def to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, shard_of, texts = b.column(0).to_pylist(), b.column(2).to_pylist(), text_bytes(b, text)
            for i in range(0, len(texts), 500):
                rows = []
                for k, s, t in zip(keys[i : i + 500], shard_of[i : i + 500], texts[i : i + 500]):
                    words = t.split()
                    if k is not None and len(words) >= window:
                        d, (a, at) = digest(words), anchors(hash_words(words), window)
                        rows.append((k, s, d, int.from_bytes(d[:8], "little", signed=True), a.view(np.int64), at))
                if rows:
                    n, each = [len(r[4]) for r in rows], np.arange(len(rows))
                    where, none = pa.array(np.concatenate([each, np.repeat(each, n)])), np.repeat([False, True], [len(rows), sum(n)])
                    take = lambda x, t: pa.array(x, t).take(where)
                    digests = pa.array([*(r[2] for r in rows), *[None] * sum(n)], pa.binary())
                    found, at = (pa.array(np.concatenate([np.zeros(len(rows), t), *(r[i] for r in rows)]), mask=~none) for i, t in ((4, np.int64), (5, np.int32)))
                    yield pa.RecordBatch.from_arrays([take([r[0] for r in rows], key_type), take([r[1] for r in rows], pa.int32()), digests, take([r[3] for r in rows], pa.int64()), found, at], [key, "shard", "digest", "text_hash", "anchor", "at"])

    seen = written(docs.select(key, text, shard.alias("shard")).mapInArrow(to_anchors, f"`{key}` {kind}, shard int, digest binary, text_hash long, anchor long, at int"), "anchors")

    # Copies: the rows with a digest, one a document. What is joined is written first, so that the join can split a frequent key's rows.
    texts = seen.where(F.col("digest").isNotNull()).select(key, "shard", "digest")
    firsts = written(texts.groupBy("digest").agg(F.min(key).alias("first"), F.max(key).alias("last")).where(F.col("first") < F.col("last")).select("digest", "first"), "firsts")
    copies = texts.join(firsts, "digest").where(F.col(key) > F.col("first")).select("shard", F.col(key).alias("place"), F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("int").alias("at"))
    # Recurring anchors, and one place of each in every shard where it stands.
    stood = seen.where(F.col("anchor").isNotNull())
    texts_of = stood.groupBy("anchor").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"))
    recurring = written(texts_of.where(F.col("low") != F.col("high")).select("anchor"), "recurring")
    places = stood.select("anchor", "shard", key, "at").join(recurring, "anchor", "left_semi").groupBy("shard", "anchor").agg(F.min(key).alias("place"), F.min_by("at", key).alias("at")).select("shard", "place", "anchor", "at")

    found_type = pa.struct([("a", pa.int64()), ("b", pa.int32()), ("at", pa.int32())])
    found_schema = f"`{key}` {kind}, n_words long, n_removed long, kept binary, text binary, found array<struct<a:long,b:int,at:int>>, shard int"

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        places, wanted, positions = (right.column(c).to_pylist() for c in ("place", "anchor", "at"))
        copied = {k for k, x in zip(places, wanted) if x is None}
        table = left.combine_chunks()
        keys, lists = table.column(key).to_pylist(), [(t or b"").split() for t in table.column(text).cast(pa.binary()).to_pylist()]
        rows_of: dict = {}
        for i, k in enumerate(keys):
            rows_of.setdefault(k, []).append(i)
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, x, at in zip(places, wanted, positions):
            for i in rows_of.get(k, ()) if x is not None else ():
                phrase = lists[i][at : at + PHRASE]
                if len(phrase) == PHRASE:
                    automaton.add_word(tuple(map(number.__getitem__, phrase)), 1)
        if len(automaton):
            automaton.make_automaton()
        wanted = np.unique(np.array([x for x in wanted if x is not None], np.int64).view(np.uint64))
        none = len(number)  # a word of no phrase
        out: list[tuple] = []
        for k, words in zip(keys, lists):
            n = len(words)
            if n < window:
                out.append((k, n, 0, b" ".join(words), None, None))
                continue
            if k in copied:
                out.append((k, n, n, b"", None, None))
                continue
            starts = np.zeros(0, np.int64)
            ends = np.fromiter((e for e, _ in automaton.iter(tuple([number.get(w, none) for w in words]))), np.int64) if len(automaton) else starts
            if len(ends):
                last = n - window
                mark = np.zeros(last + 2, np.int32)
                np.add.at(mark, np.clip(ends + 1 - window, 0, last + 1), 1)
                np.add.at(mark, np.clip(ends - PHRASE + 2, 0, last + 1), -1)
                starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            if len(starts):  # a window can recur only if its own anchor does
                h = hash_words(words)
                own = sliding_min(rolling(h, PHRASE), window - PHRASE + 1)[starts]
                starts = starts[wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own]
            if not len(starts):
                out.append((k, n, 0, b" ".join(words), None, None))
                continue
            a, b = rolling(h, window)[starts].view(np.int64), (rolling(mix(h ^ OTHER), window)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            out.append((k, n, 0, None, b" ".join(words), pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(starts.astype(np.int32))], fields=list(found_type))))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[5]) if r[5] is not None else 0 for r in out)]).astype(np.int32)), pa.concat_arrays([r[5] for r in out if r[5] is not None] or [pa.array([], found_type)]))
        kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        shard_of = pa.array(table.column("shard").to_pylist(), pa.int32())
        return pa.Table.from_arrays([*(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)), lists, shard_of], [key, "n_words", "n_removed", "kept", "text", "found", "shard"])

    keyless = docs.where(F.col(key).isNull())
    dealt = docs.where(F.col(key).isNotNull()).select(key, text, shard.alias("shard")).groupBy("shard")
    located = bucketed(dealt.cogroup(copies.unionByName(places).groupBy("shard")).applyInArrow(locate, found_schema), "located", "shard")

    pending = located.where(F.col("text").isNotNull())
    windows = pending.select(key, F.explode("found").alias("w")).select(key, "w.a", "w.b", "w.at")
    # As above: written, so that the join can split a common window's rows. Windows of one document alone have no later one.
    firsts_of = windows.groupBy("a", "b").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    owners = written(firsts_of.where(F.col("first") < F.col("last")).select("a", "b", "first"), "owners")
    later = windows.join(owners, ["a", "b"]).where(F.col(key) > F.col("first")).select(F.col(key).alias("later_key"), "at", shard.alias("shard"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        order = right.select(["later_key", "at"]).group_by("later_key").aggregate([("at", "list")])
        starts_of = dict(zip(order.column("later_key").to_pylist(), order.column("at_list").combine_chunks() if order.num_rows else []))
        keys, counts, texts = (left.column(c).to_pylist() for c in (key, "n_words", "text"))
        removed, kept = [], []
        for k, n, t in zip(keys, counts, texts):
            if k not in starts_of:
                removed.append(0)
                kept.append(t)
                continue
            at = np.unique(starts_of[k].values.to_numpy())
            at = at[at <= n - window]  # rows that share a key can differ in length
            mark = np.zeros(n + 1, np.int32)
            mark[at] += 1
            mark[at + window] -= 1
            gone = np.cumsum(mark[:-1]) > 0
            removed.append(int(gone.sum()))
            kept.append(b" ".join(w for w, g in zip(t.split(b" "), gone.tolist()) if not g))
        return pa.Table.from_arrays([pa.array(keys, key_type), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], [key, "n_words", "n_removed", "kept"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [t.split() for t in text_bytes(b, text)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in lists], pa.int64()), pa.array([0] * len(lists), pa.int64()), pa.array([b" ".join(w) for w in lists], pa.binary())], [key, "n_words", "n_removed", "kept"])

    out_schema = f"`{key}` {kind}, n_words long, n_removed long, kept binary"
    done = located.where(F.col("text").isNull()).select(key, "n_words", "n_removed", "kept")
    both = done.unionByName(pending.select(key, "n_words", "text", "shard").groupBy("shard").cogroup(later.groupBy("shard")).applyInArrow(cut, out_schema)).unionByName(keyless.mapInArrow(whole, out_schema))
    return both.select(key, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept").cast("string").alias("kept"))
