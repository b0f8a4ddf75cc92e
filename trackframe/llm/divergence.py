"""How far the sources of a language are apart in the words they use, with late materialisation of strings.

Terms are runs of letters (ASCII letters in lower case, and all characters beyond ASCII). Only fixed-width digests of terms are shuffled:

1. A scan counts, for each language and digest, the documents that hold it; digests in at least ``least`` documents stay. Terms
   that share a digest can only raise that number, so no term is lost.
2. A second scan, behind a bit table of the digests that stayed, counts them by language and source, and names the smallest and
   the largest string seen under each. Those strings are rows of their own, once a task as a rule, and are not shuffled with the counts.
3. Where the smallest and largest string of a digest differ, it stands for several terms: a third scan counts those by their strings,
   and each gets a number beside the digest. With 64 bits that is rare, and exact when it happens.
4. Probabilities in billionths are exact whole numbers. Differences between sources are summed in blocks of sources and chunks of terms;
   terms are ranked by number and digest, and strings are joined to the ranked rows alone, where they break the ties.

Null text, language and source are ''. Empty texts have no terms but their group counts. Very long texts are one document, read whole.
Repeated rows are documents of their own. A language without kept terms has value 0 for each pair. An empty table gives an empty
one. Only the three columns are read, so other columns can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import bit_table, distinct, keyed, mix, passing, runs, values_of, written

#: ASCII letters in lower case, bytes beyond ASCII as they are, all else a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text that a task handles at once: the more, the fewer rows are shuffled.
SLICE = 8_000_000
#: Counts that a task holds, and strings that it remembers to have given.
HELD, TOLD = 1_500_000, 1_000_000
#: Sources and terms that a task compares at once.
BLOCK, CHUNK = 128, 1024
#: Up to so many groups of language and source are broadcast; more are joined.
BROADCAST = 100_000


class Terms:
    """The terms of a slice of documents: distinct ones with their digests, and which stands where."""

    def __init__(self, texts: pa.Array, bits: int):
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        letters = pa.py_buffer(bytes(memoryview(data)[ends[0] : ends[-1]]).translate(LETTERS) if data else b"")
        lists = pc.split_pattern(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends - ends[0]), letters]), b" ")
        words, places = lists.flatten(), np.asarray(lists.offsets)
        some = pc.binary_length(words).to_numpy() > 0
        found = words.filter(pa.array(some)).dictionary_encode()
        self.index, self.terms = found.indices.to_numpy().astype(np.int64), found.dictionary
        self.doc = np.repeat(np.arange(len(texts)), np.diff(places))[some]
        self.names = values_of(self.terms)
        self.digest = (np.fromiter(map(xxhash.xxh64_intdigest, self.names), np.uint64, len(self.names)) >> np.uint64(64 - bits)).view(np.int64)
        self.distinct, self.of_term = np.unique(self.digest, return_inverse=True)
        self.width = max(len(self.names), 1)

    def counted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, term, how often) over all places, given each document's group; in order."""
        found, n = np.unique(group[self.doc] * self.width + self.index, return_counts=True)
        return found // self.width, found % self.width, n

    def documents(self, group: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, what, documents), ``of`` telling what a term counts as; in order."""
        seen = distinct(self.doc * self.width + of[self.index])
        found, n = np.unique(group[seen // self.width] * self.width + seen % self.width, return_counts=True)
        return found // self.width, found % self.width, n


def _sliced(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[Terms, list[pa.Array], list[np.ndarray]]]:
    """The terms of slices of rows (text, group columns), with each group column's distinct values and rows' indices."""
    for b in batches:
        texts = b.column(0).cast(pa.binary())
        for i, j in runs(pc.binary_length(texts).to_numpy(), SLICE):
            columns = [b.column(k).slice(i, j - i).dictionary_encode() for k in range(1, b.num_columns)]
            yield Terms(texts.slice(i, j - i), bits), [c.dictionary for c in columns], [c.indices.to_numpy().astype(np.int64) for c in columns]


def frequent(docs: DataFrame, least: int, bits: int) -> DataFrame:
    """(lang, digest): digests that stand in at least ``least`` documents of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, (langs,), (lang,) in _sliced(batches, bits):
            group, at, n = t.documents(lang, t.of_term)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), pa.array(t.distinct[at]), pa.array(n)], ["lang", "digest", "df"])

    counted = docs.select("text", "lang").mapInArrow(count, "lang string, digest long, df long")
    return written(counted.groupBy("lang", "digest").agg(F.sum("df").alias("df")).where(F.col("df") >= least).select("lang", "digest"), "frequent")


class Sums:
    """Counts of a task by group and digest, added up over its slices until they are many."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, langs: list[str], sources: list[str], group: np.ndarray, digest: np.ndarray, n: np.ndarray) -> None:
        own, at = np.unique(group, return_inverse=True)
        codes = [self.groups.setdefault((langs[g // len(sources)], sources[g % len(sources)]), len(self.groups)) for g in own.tolist()]
        self.held.append((np.array(codes, np.int64)[at], digest, n))
        self.rows += len(n)

    def taken(self) -> pa.RecordBatch | None:
        """All that is held, in rows (lang, source, digest, n, null, null)."""
        if not self.rows:
            return None
        code, digest, n = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((digest, code))
        code, digest = code[order], digest[order]
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (digest[1:] != digest[:-1])))
        names, at = list(self.groups), pa.array(code[first])
        self.held, self.rows = [], 0
        return pa.RecordBatch.from_arrays([*(pa.array([g[k] for g in names], pa.string()).take(at) for k in (0, 1)), pa.array(digest[first]), pa.array(np.add.reduceat(n[order], first)), *(pa.nulls(len(first), pa.string()) for _ in range(2))], ROWS)


ROWS = ["lang", "source", "digest", "n", "first", "last"]


def counted(docs: DataFrame, table: np.ndarray, bits: int) -> DataFrame:
    """Rows (lang, source, digest, n, null, null) of counts and (lang, '', digest, 0, first, last) of strings, for digests that pass the bit table.

    A task adds its counts up, and gives a digest's strings again only where they are others than before.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, told = Sums(), np.zeros(0, np.uint64)
        for t, (langs, sources), (lang, source) in _sliced(batches, bits):
            group, term, n = t.counted(lang * len(sources) + source)
            keep = passing(shared.value, t.digest)[term]
            group, term, n = group[keep], term[keep], n[keep]
            names = langs.to_pylist()
            sums.add(names, sources.to_pylist(), group, t.digest[term], n)
            if sums.rows > HELD:
                yield sums.taken()
            # Strings: by language, digest and place in string order, those at the ends of each digest's run.
            width, order = len(t.distinct), pc.sort_indices(t.terms).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            seen = distinct((group // len(sources) * width + t.of_term[term]) * len(order) + place[term])
            kind, ends = seen // max(len(order), 1), order[seen % max(len(order), 1)]
            at = np.flatnonzero(np.diff(kind, prepend=-1))
            first, last, kind = ends[at], ends[np.append(at[1:], len(kind))[: len(at)] - 1], kind[at]
            known = np.fromiter((xxhash.xxh3_64_intdigest(x, 1) for x in t.names), np.uint64, len(order))
            spoken = np.array([xxhash.xxh64_intdigest(x or "") for x in names], np.uint64)
            key = mix(mix(t.distinct[kind % max(width, 1)].view(np.uint64) ^ spoken[kind // max(width, 1)]) ^ known[first]) ^ known[last]
            fresh = ~np.isin(key, told)
            told = distinct(np.concatenate([told, key[fresh]]))[-TOLD:]
            kind, first, last = kind[fresh], first[fresh], last[fresh]
            strings = [t.terms.take(pa.array(x)).cast(pa.string()) for x in (first, last)]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(kind // max(width, 1))), pa.array([""] * len(kind), pa.string()), pa.array(t.distinct[kind % max(width, 1)]), pa.array(np.zeros(len(kind), np.int64)), *strings], ROWS)
        if sums.rows:
            yield sums.taken()

    return written(docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, digest long, n long, first string, last string"), "counted")


def split_terms(docs: DataFrame, mixed: DataFrame, least: int, bits: int) -> DataFrame:
    """(lang, source, digest, number, n, term): the terms of digests that several share, counted by their strings."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(mixed, "digest"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, (langs, sources), (lang, source) in _sliced(batches, bits):
            both = lang * len(sources) + source
            group, at, n = t.counted(both)
            _, _, df = t.documents(both, np.arange(t.width))
            keep = passing(shared.value, t.digest)[at]
            group, at, n, df = group[keep], at[keep], n[keep], df[keep]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources))), pa.array(t.digest[at]), t.terms.take(pa.array(at)).cast(pa.string()), pa.array(n), pa.array(df)], ["lang", "source", "digest", "term", "n", "df"])

    rows = docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, digest long, term string, n long, df long")
    rows = written(rows.join(mixed, ["lang", "digest"], "left_semi").groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "split")
    numbers = rows.groupBy("lang", "digest", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least).drop("df")
    numbers = numbers.withColumn("number", F.row_number().over(Window.partitionBy("lang", "digest").orderBy("term")))
    return written(rows.drop("df").join(numbers, ["lang", "digest", "term"]), "numbered")


def vocabulary(docs: DataFrame, least: int = 30, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, digest, number, total, term) and their counts (lang, digest, number, source, n); ``docs`` has text, lang and source without nulls."""
    kept = frequent(docs, least, bits)
    partial = counted(docs, bit_table(kept, "digest"), bits)
    ends = partial.where("first IS NOT NULL").groupBy("lang", "digest").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    known = written(ends.join(kept, ["lang", "digest"]), "ends")
    alone, mixed = known.where("first = last"), known.where("first <> last").select("lang", "digest")
    terms = alone.select("lang", "digest", F.lit(0).alias("number"), F.col("first").alias("term"))
    counts = partial.where("first IS NULL").groupBy("lang", "digest", "source").agg(F.sum("n").alias("n")).join(alone.select("lang", "digest"), ["lang", "digest"]).select("lang", "digest", F.lit(0).alias("number"), "source", "n")
    if not mixed.isEmpty():
        split = split_terms(docs, mixed, least, bits)
        terms = terms.unionByName(split.select("lang", "digest", "number", "term").distinct())
        counts = counts.unionByName(split.select("lang", "digest", "number", "source", "n"))
    counts = written(counts, "counts")
    totals = counts.groupBy("lang", "digest", "number").agg(F.sum("n").alias("total"))
    return written(terms.join(totals, ["lang", "digest", "number"]), "terms"), counts


def share(n: str, of: str) -> Column:
    """Billionths of the smoothed probability of a term with ``n`` of ``of`` places, of the kept terms, from 1: exact whole numbers."""
    return F.expr(f"1 + (CAST({n} + 5 AS DECIMAL(20,0)) * CAST(1000000000 AS DECIMAL(10,0))) div CAST({of} + 5 * kept AS DECIMAL(20,0))")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 30, top: int = 50, bits: int = 64, broadcast: int = BROADCAST, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank): for each language and source, how far each other source is (``pair``), and the terms it has most above its language (``term``).

    ``bits`` is the width of a digest; ``block`` sources and about ``chunk`` terms are compared at once. A source's probability of a term is smoothed by 5 places.
    """
    docs = keyed(docs, text, lang, source).select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    terms, counts = vocabulary(docs, least, bits)
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("everywhere"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("places"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row a source
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["places", "kept", "everywhere"])
    groups = groups.select("*", place.alias("place"), F.count("*").over(Window.partitionBy("lang")).alias("sources"))
    groups = written(groups.withColumns({"none": F.when(F.col("kept") > 0, share("0", "places")).otherwise(0), "chunks": F.greatest(F.ceil(F.col("kept") / chunk), F.lit(1)), "blocks": F.ceil(F.col("sources") / block)}), "groups")
    small = groups.count() <= broadcast
    few = F.broadcast(groups) if small else groups
    of_group = counts.join(few, ["lang", "source"]).withColumn("p", share("n", "places"))

    # Terms: ranked by number first, by string where that ties.
    lang_share = terms.join(F.broadcast(langs) if small else langs, "lang").select("lang", "digest", "number", share("total", "everywhere").alias("q"))
    above = of_group.join(lang_share, ["lang", "digest", "number"]).where("p > q").select("lang", "source", "digest", "number", (F.col("p") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    leading = above.withColumn("place", F.rank().over(by_value)).where(F.col("place") <= top)
    named = leading.join(terms.select("lang", "digest", "number", F.col("term").alias("item")), ["lang", "digest", "number"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")

    pairs = compared(of_group, groups, terms, block).select("lang", F.explode(F.array(F.struct(F.col("i").alias("one"), F.col("j").alias("other")), F.struct(F.col("j").alias("one"), F.col("i").alias("other")))).alias("x"), "value").select("lang", "x.one", "x.other", "value")
    names = few.select("lang", F.col("place"), "source")
    pairs = pairs.join(names.withColumnRenamed("place", "one"), ["lang", "one"]).join(names.select("lang", F.col("place").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(named.withColumn("rank", rank).where(F.col("rank") <= top))


def compared(of_group: DataFrame, groups: DataFrame, terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, i, j, value): summed differences of all terms between the sources with places i < j, block by block and chunk by chunk.

    A task gets the terms that its sources have, and how many the chunk has in all: in the others both sources have their least share.
    """
    mine = F.floor(F.col("place") / block)
    sides = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(mine, o).alias("low"), F.greatest(mine, o).alias("high")))).alias("side")
    chunk = F.pmod(F.xxhash64("digest", "number"), F.col("chunks")).alias("chunk")
    rows = of_group.select("lang", chunk, "place", "digest", "number", "p", F.lit(0).cast("long").alias("terms"), sides)
    sizes = terms.join(groups.select("lang", "chunks").distinct(), "lang").groupBy("lang", chunk).agg(F.count("*").alias("terms"))
    none = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "place", "blocks", F.col("none").alias("p")).join(sizes, ["lang", "chunk"], "left").fillna(0, ["terms"])
    none = none.select("lang", "chunk", "place", F.lit(None).cast("long").alias("digest"), F.lit(None).cast("int").alias("number"), "p", "terms", sides)
    every = rows.unionByName(none).select("lang", "chunk", "side.low", "side.high", "place", "digest", "number", "p", "terms")

    def compare(table: pa.Table) -> pa.Table:
        lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
        place, p = table.column("place").to_numpy(), table.column("p").to_numpy()
        base = pc.is_null(table.column("digest")).to_numpy(zero_copy_only=False)
        order = np.argsort(place[base])
        places, none = place[base][order], p[base][order]
        digest, number = (pc.fill_null(table.column(c), 0).to_numpy()[~base] for c in ("digest", "number"))
        _, term = np.unique(np.stack([digest, number.astype(np.int64)]), axis=1, return_inverse=True)
        term = term.reshape(-1)
        shares = np.repeat(none[:, None], int(term.max(initial=-1)) + 1, axis=1)
        shares[np.searchsorted(places, place[~base]), term] = p[~base]
        others_too = int(table.column("terms").to_numpy().max()) - shares.shape[1]
        of, out = places // block, []
        for k in np.flatnonzero(of == low).tolist():
            others = np.flatnonzero((of == high) & (places > places[k]))
            out.append((np.full(len(others), places[k]), places[others], np.abs(shares[others] - shares[k]).sum(1) + others_too * np.abs(none[others] - none[k])))
        i, j, value = (np.concatenate(x).astype(np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "i": i, "j": j, "value": value})

    parts = every.groupBy("lang", "chunk", "low", "high").applyInArrow(compare, "lang string, i long, j long, value long")
    return parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
