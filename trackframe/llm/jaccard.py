"""N-gram Jaccard self-join with set-relation skipping, and the components of its links.

A document's set holds the hashes of its distinct shingles (runs of ``words`` lower-case words). Two sets link when their
Jaccard similarity is ``percent`` or more. Steps:

1. Equal sets become one class, with its smallest key. A sketch of bounded size counts how many documents hold a shingle of each hash bucket.
2. Every class puts its rarest shingles (by the sketch, then by hash), as many as a linked set must share at least two of,
   into index lists, with set size and position. Lists that the sketch tells to be long are dealt to several groups by class.
3. Index lists are ordered by position in blocks. A block whose position or size bound cannot reach the similarity is skipped whole.
   Short lists give all other pairs. In long lists every set first meets only the list's first set, its most typical one.
4. Pairs that the first round gives twice are checked exactly; of a linked pair that it gives once at most, a shared shingle is in a long list. A set that links to a long list's first set takes over its answers: in the second round, long
   lists give pairs of sets of different components only; what the first set links to is derived, not searched again. There a list is
   cut into blocks of bounded size, each of one component or of small components together, and each pair of blocks that can hold
   a pair of different components is a group of its own: no list, however long, comes to one task.
5. ``near_links``, which gives every link, pairs the classes of a long list in such blocks without regard to components.
6. Components by smallest label with pointer jumping, over written tables.

With fewer words than a shingle the whole sequence is the set's one element; without words the set is empty and links with
nothing. Null text counts as empty. Rows that share a key are one document: what each of them links to is one component. An empty
table gives an empty one. A very long text is one set, whole. Shingles and classes are told by 64-bit hashes. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import hash_words, keyed, mix, rolling, shuffle_partitions, slices, text_bytes, unused, written

#: Buckets of the sketch: 2 ** SKETCH_BITS for small inputs, 2 ** MOST_BITS (64 MB) at most.
SKETCH_BITS, MOST_BITS = 20, 24
SKETCH_PARTS = 64
#: Bytes of text whose index entries make one group of lists.
BUCKET_BYTES = 12_000_000
#: Entries of a block of a long list.
BLOCK = 512
#: Entries of a list in one group, as told by the sketch.
LIST = 50_000
#: Lists of more sets than this take two rounds.
SHORT = 8


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    h = hash_words(text.lower().split())
    if not len(h):
        return h
    return np.unique(rolling(h, words if len(h) >= words else len(h)))


def class_of(s: np.ndarray) -> int:
    """64-bit digest of a set; 0 for the empty one."""
    if not len(s):
        return 0
    total = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(keepdims=True)
    return int(mix(total + np.uint64(len(s))).view(np.int64)[0])


def bucket_of(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def needed(n: int, percent: int) -> int:
    """The least overlap with any linked set."""
    return -(-n * percent // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_overlap(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that linked sets of these sizes share at least."""
    return -(-(x + y) * percent // (100 + percent))


def block_pairs(pos: np.ndarray, size: np.ndarray, group: np.ndarray | None, percent: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of a list ordered by position that can reach the similarity if they share at most one shingle before; blocks that cannot are skipped."""
    least = lambda x, y: least_overlap(x, y, percent) - 1
    for i in range(0, len(pos), block):
        p, n, g = pos[i : i + block], size[i : i + block], None if group is None else group[i : i + block]
        for j in range(i, len(pos), block):
            q, m = pos[j : j + block], size[j : j + block]
            # The largest rest of this block against the smallest need of both.
            if min((n - p).max(), (m - q).max()) < least(int(n.min()), int(m.min())):
                continue
            can = np.minimum((n - p)[:, None], (m - q)[None, :]) >= least(n[:, None], m[None, :])
            if g is not None:
                can &= g[:, None] != group[j : j + block][None, :]
            if i == j:
                can &= np.tri(len(p), len(q), -1, dtype=bool).T
            a, b = np.nonzero(can)
            if len(a):
                yield a + i, b + j


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links``, itself included."""
    both = links.select(F.col(left).alias("u"), F.col(right).alias("v"))
    edges = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    while True:
        told = edges.join(labels, F.col("u") == F.col("node")).select(F.col("v").alias("node"), "component")
        near = told.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        over = near.alias("x").join(labels.select(F.col("node").alias("at"), F.col("component").alias("next")), F.col("component") == F.col("at"), "left")
        new = written(over.select("node", F.least("component", "next").alias("component")), "labels")
        moved = new.join(labels.withColumnRenamed("component", "was"), "node").where(F.col("component") != F.col("was")).limit(1).count()
        labels = new
        if not moved:
            return labels


def block_members(lists: DataFrame, so_far: DataFrame | None, block: int = BLOCK) -> DataFrame:
    """Entries of index lists (token, class, size, pos), with their component as ``group``, in every pair of blocks (one, two) they take part in.

    Lists of one component are left out. A component with more than ``block`` entries in a list has blocks of its own, which are
    paired with all but each other; the others share blocks, which are paired with all and with themselves (side 0).
    Without ``so_far`` each class is a component.
    """
    if so_far is None:
        grouped = lists.withColumn("group", F.col("class"))
    else:
        grouped = lists.join(so_far.select(F.col("node").alias("class"), F.col("component").alias("group")), "class", "left").withColumn("group", F.coalesce("group", "class"))
    grouped = written(grouped.select("token", "class", "size", "pos", "group"), "lists")
    # Most lists are of one component by now: only the others go on.
    tokens = written(grouped.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where(F.col("low") < F.col("high")).select("token"), "tokens")
    grouped = written(grouped.join(tokens, "token"), "open")
    sizes = grouped.groupBy("token", "group").agg(F.count("*").alias("n"))
    small = F.col("n") <= block
    several = sizes.groupBy("token").agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("rest")).where("groups > 1")
    # By component in a list: its first block's name and how many it has; the shared ones count from 0.
    shared = F.greatest(F.ceil(F.col("rest") / block), F.lit(1)).cast("long")
    of = written(sizes.join(several, "token").select("token", "group", F.when(small, F.lit(0)).otherwise(F.col("group")).alias("owner"), F.when(small, F.lit(None)).otherwise(F.ceil(F.col("n") / block)).cast("long").alias("parts"), shared.alias("shared")), "blocks")
    number = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("group"), F.col("shared"))).otherwise(F.pmod(F.xxhash64("class"), F.col("parts")))
    name = F.struct(F.col("parts").isNotNull().alias("own"), "owner", number.alias("number"))
    placed = grouped.join(of, ["token", "group"]).withColumn("block", name).select("token", "class", "size", "pos", "group", "block")
    every = written(placed.select("token", "block").distinct(), "every")
    other = every.select("token", F.col("block").alias("two"))
    apart = (F.col("one.own") == F.col("two.own")) & F.col("one.own") & (F.col("one.owner") == F.col("two.owner"))
    pairs = every.select("token", F.col("block").alias("one")).join(other, "token").where((F.col("one") <= F.col("two")) & ~apart)
    each = pairs.select("token", "one", "two", F.explode(F.when(F.col("one") == F.col("two"), F.array(F.struct(F.col("one").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("one").alias("block"), F.lit(1).alias("side")), F.struct(F.col("two").alias("block"), F.lit(2).alias("side"))))).alias("m"))
    return placed.join(each.select("token", "one", "two", "m.block", "m.side"), ["token", "block"]).select("token", F.xxhash64("one").alias("one"), F.xxhash64("two").alias("two"), "class", "size", "pos", "group", "side")


def join_sets(docs: DataFrame, key: str, text: str, words: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, n_shingles, class), (class, rep: its smallest key) and links (a, b) of different classes: ``every`` one, or enough for the components."""
    spark = docs.sparkSession
    docs = keyed(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    total_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(2 * shuffle_partitions(spark), -(-total_bytes // BUCKET_BYTES))
    bits = min(max(SKETCH_BITS, (total_bytes // 4096).bit_length()), MOST_BITS)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        names = [key, "n_shingles", "class", "part", "counts"]
        for b in batches:
            sets = [shingles(t, words) for t in text_bytes(b, text)]
            for s in sets:
                np.add.at(counts, bucket_of(s, bits), 1)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        p = SKETCH_PARTS
        yield pa.RecordBatch.from_arrays([pa.nulls(p, key_type), pa.nulls(p, pa.int64()), pa.nulls(p, pa.int64()), pa.array(range(p), pa.int32()), pa.array([x.tobytes() for x in counts.reshape(p, -1)], pa.binary())], names)

    surveyed = written(docs.mapInArrow(survey, f"`{key}` {kind}, n_shingles long, class long, part int, counts binary"), "survey")
    meta = surveyed.where(F.col("part").isNull()).select(key, "n_shingles", "class")

    def total(part: pa.Table) -> pa.Table:
        counts = np.zeros((1 << bits) // SKETCH_PARTS, np.int64)
        for x in part.column("counts").to_pylist():
            counts += np.frombuffer(x, np.int32)
        return pa.table({"part": pa.array([part.column("part")[0].as_py()], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    rows = surveyed.where(F.col("part").isNotNull()).select("part", "counts").groupBy("part").applyInArrow(total, "part int, counts binary").collect()
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["part"])]) if rows else np.zeros(1 << bits, np.int64)
    sketch = spark.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))  # 4 to 64 MB, by ``bits``
    limit = max(LIST, 8 * int(counts.mean()))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b, text)
            for i, j in slices(texts):
                done, cols = set(), []
                for t in texts[i:j]:
                    s = shingles(t, words)
                    c = class_of(s)
                    if not len(s) or c in done:
                        continue
                    done.add(c)
                    seen = sketch.value[bucket_of(s, bits)]
                    order = np.lexsort((s, seen))[: len(s) - needed(len(s), percent) + 2]
                    cols.append((s[order], np.full(len(order), c, np.int64), np.full(len(order), len(s), np.int32), np.arange(len(order), dtype=np.int32), seen[order] // limit + 1))
                if not cols:
                    continue
                token, cls, size, pos, deal = (np.concatenate(x) for x in zip(*cols))
                salt = mix(cls.view(np.uint64)) % deal.astype(np.uint64)
                part = (mix(token + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                ids, at = np.unique(part[order], return_index=True)
                cuts = np.append(at, len(order))
                pack = lambda x: pa.array([x[order[k:m]].tobytes() for k, m in zip(cuts[:-1], cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pack(token), pack(cls), pack(size), pack(pos)], ["bucket", "token", "class", "size", "pos"])

    entries = docs.select(key, text).mapInArrow(index, "bucket long, token binary, class binary, size binary, pos binary")

    def search(bucket: pa.Table) -> pa.Table:
        deal = sketch.value
        get = lambda name, t: np.frombuffer(b"".join(bucket.column(name).to_pylist()), t)
        token, cls, size, pos = get("token", np.uint64), get("class", np.int64), get("size", np.int32).astype(np.int64), get("pos", np.int32).astype(np.int64)
        order = np.lexsort((cls, pos, token))
        token, cls, size, pos = token[order], cls[order], size[order], pos[order]
        keep = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))[: len(token)]
        token, cls, size, pos = token[keep], cls[keep], size[keep], pos[keep]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))[: len(token)]
        length = np.diff(np.append(starts, len(token)))
        pairs, long = [], []
        some = (length > 1) | (deal[bucket_of(token[starts], bits)] > limit)
        for at, n in zip(starts[some].tolist(), length[some].tolist()):
            run = slice(at, at + n)
            c = cls[run]
            if n <= SHORT and deal[int(bucket_of(token[at : at + 1], bits)[0])] <= limit:
                for i, j in block_pairs(pos[run], size[run], None, percent):
                    pairs.append(np.stack([c[i], c[j]]))
            else:
                first, rest = np.zeros(n - 1, np.int64), np.arange(1, n)
                can = np.minimum(size[at] - pos[at], (size[run] - pos[run])[1:]) >= least_overlap(size[at], size[run][1:], percent) - 1
                pairs.append(np.stack([c[first[can]], c[rest[can]]]))
                long.append((int(token[at].astype(np.int64)), c, size[run], pos[run]))
        p = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        p.sort(axis=0)
        p, times = np.unique(p, axis=1, return_counts=True)
        n, m = p.shape[1], sum(len(x[1]) for x in long)
        wide = lambda k, t: np.concatenate([x[k] for x in long]).astype(t) if long else np.zeros(0, t)
        tokens = np.repeat(np.array([x[0] for x in long], np.int64), [len(x[1]) for x in long]) if long else np.zeros(0, np.int64)
        cat = lambda x, y: pa.concat_arrays([x, y])
        return pa.table({"a": cat(pa.array(p[0]), pa.array(wide(1, np.int64))), "b": cat(pa.array(p[1]), pa.nulls(m, pa.int64())), "token": cat(pa.nulls(n, pa.int64()), pa.array(tokens)), "size": cat(pa.array(times.astype(np.int32)), pa.array(wide(2, np.int32))), "pos": cat(pa.nulls(n, pa.int32()), pa.array(wide(3, np.int32)))})

    searched = written(entries.groupBy("bucket").applyInArrow(search, "a long, b long, token long, size int, pos int"), "searched")
    # Of a pair, ``size`` is how often a bucket gives it.
    pairs = written(searched.where(F.col("token").isNull()).groupBy("a", "b").agg(F.sum("size").alias("times")).where("times > 1").select("a", "b"), "pairs")
    lists = searched.where(F.col("token").isNotNull()).select("token", F.col("a").alias("class"), "size", "pos")

    reps = written(meta.where(F.col("n_shingles") > 0).groupBy("class").agg(F.min(key).alias("rep")), "classes")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(lists.select("class")).distinct()
    wanted = reps.join(involved, "class").select("rep", F.col("class"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, words) for t in text_bytes(b, text)]
            own = b.column(0).to_pylist()
            rows = [(c, s.tobytes()) for c, s in zip(own, sets) if class_of(s) == c]  # rows that share a key may differ
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["class", "set"])

    texts = docs.join(wanted, docs[key] == wanted["rep"]).select("class", text)
    sets = written(texts.mapInArrow(to_sets, "class long, set binary"), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verified(candidates: DataFrame) -> DataFrame:
        one = candidates.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a")
        two = one.join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
        return two.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")

    first = written(verified(pairs), "links")
    so_far = None if every else components(first)

    def across(part: pa.Table) -> pa.Table:
        cls, size, pos, group, side = (part.column(k).to_numpy().astype(np.int64) for k in ("class", "size", "pos", "group", "side"))
        order = np.lexsort((cls, pos))
        cls, size, pos, group, side = cls[order], size[order], pos[order], group[order], side[order]
        out = []
        for i, j in block_pairs(pos, size, group, percent):
            apart = (side[i] == 0) | (side[i] != side[j])  # side 0: one block of small components with itself
            out.append(np.stack([cls[i][apart], cls[j][apart]]))
        p = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        p.sort(axis=0)
        return pa.table({"a": pa.array(p[0]), "b": pa.array(p[1])})

    second = written(verified(block_members(lists, so_far).groupBy("token", "one", "two").applyInArrow(across, "a long, b long").distinct()), "links")
    return meta, reps, first.unionByName(second)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id): components by their smallest key."""
    meta, reps, links = join_sets(docs, key, text, words, percent, False)
    # Links in keys; the class with the smallest key gives the component's name.
    rep = lambda c, name: reps.select(F.col("class").alias(c), F.col("rep").alias(name))
    # Rows that share a key tie their classes together.
    by_key = meta.where((F.col("n_shingles") > 0) & F.col(key).isNotNull()).groupBy(key).agg(F.min("class").alias("a"), F.max("class").alias("last")).where(F.col("a") < F.col("last"))
    tied = meta.where(F.col("n_shingles") > 0).join(by_key, key).where(F.col("class") > F.col("a")).select("a", F.col("class").alias("b"))
    links = links.unionByName(tied).join(rep("a", "x"), "a").join(rep("b", "y"), "b").select("x", "y")
    final = components(links, "x", "y")
    named = reps.join(final, F.col("rep") == F.col("node"), "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    return meta.join(named, "class", "left").select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))


def near_links(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The whole join: (key, n_shingles, class, n_links) by row, and (a, b), every link of two classes once, the smaller class first.

    Rows of equal sets are one class, 0 for the empty set. ``n_links`` counts the other rows that a row is linked with, those of its
    class included; rows that share a key count one by one. No list is cut: pairs of a long list are made in blocks.
    """
    meta, _, links = join_sets(docs, key, text, words, percent, True)
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    rows = written(meta.where(F.col("n_shingles") > 0).groupBy("class").agg(F.count("*").alias("rows")), "rows")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(rows, F.col("b") == F.col("class")).groupBy("a").agg(F.sum("rows").alias("others"))
    count = rows.join(others, F.col("class") == F.col("a"), "left").select("class", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return meta.join(count, "class", "left").select(key, "n_shingles", "class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), links


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest key. A null key stays."""
    gone = unused(docs, "gone")
    found = near_duplicates(docs, key, text, words, percent)
    later = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(gone)).distinct()
    return docs.join(later, F.col(f"`{key}`") == F.col(gone), "left_anti")
