"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded block selection.

A source's target is its weight's share of all words, held at ``max_epochs`` times its own words; what that frees is
shared again by weight. Whole blocks of ``block`` words go to sources, and within a source to shards, by highest
quotients. A shard's documents stand in seeded order as one stream of words cut into blocks; full passes come first,
the rest are blocks picked by a seeded step.

Null and empty texts have no words; a very long one spans as many blocks as it fills. A null source is a source of its own, ordered
last. Rows that share a key (a null one too) are separate documents, dealt to shards and ordered by key and text; repeated rows stand
beside each other. Equal quotients go to the earlier source or shard. Empty input gives an empty result. One task sees a row a source,
and a row a shard of one source. Only key, text and source are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import WORD, keyed, written

#: A prime above any number of blocks in a shard: steps of this size visit each block once.
STEP = 2**31 - 1


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes/(2k+1); equal quotients go to the earlier entry."""
    votes = np.asarray(votes, float)
    won = np.zeros(len(votes), np.int64)
    if seats <= 0 or not votes.sum():
        return won
    # With this divisor no entry gets more than the quotients allow; the few seats left go one by one.
    won = np.maximum(0, np.floor(votes * max(0.0, seats - len(votes)) / votes.sum() + 0.5).astype(np.int64))
    while won.sum() > seats:
        won = np.maximum(0, won - 1)
    heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, won)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(won.sum())):
        _, i = heap[0]
        won[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size) with ``target``; one row a source, so its windows over all rows stay small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap, weight = F.lit(float(max_epochs)) * F.col("source_size"), F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    out = sources.withColumns({"cap": cap, "weight": weight.cast("double")})
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return out.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).drop("cap", "level", "weight")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, key: str = "doc_id", block: int = 64, shard_docs: int = 2000, seed: int = 17, max_epochs: int = 3) -> DataFrame:
    """(key, source, size, source_size, target, taken): how many words of each document the mix takes, repeats counted."""
    sized = written(keyed(docs, key, "source", "text").select(key, "source", word_count(F.col("text")).alias("size"), F.xxhash64(key, "text").alias("mark")), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), max_epochs=max_epochs)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    def to_sources(all_sources: pd.DataFrame) -> pd.DataFrame:
        all_sources = all_sources.sort_values("source", na_position="last").reset_index(drop=True)
        all_sources["seats"] = sainte_lague(all_sources["target"].to_numpy(), int(round(all_sources["source_size"].sum() / block)))
        return all_sources

    names = ["source", "source_size", "docs", "target"]
    granted = written(sources.select(*names).groupBy().applyInPandas(to_sources, "source string, source_size long, docs long, target double, seats long"), "sources")
    place = F.pmod(F.xxhash64(F.lit(seed), "mark"), F.ceil(F.col("docs") / shard_docs))
    dealt = sized.join(granted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("shard", place)
    shards = dealt.groupBy("source", "shard", "seats").agg(F.sum("size").alias("shard_size"))

    def to_shards(shards_of_one: pd.DataFrame) -> pd.DataFrame:
        shards_of_one = shards_of_one.sort_values("shard").reset_index(drop=True)
        shards_of_one["quota"] = sainte_lague(shards_of_one["shard_size"].to_numpy(), int(shards_of_one["seats"].iloc[0]))
        return shards_of_one[["source", "shard", "shard_size", "quota"]]

    quotas = shards.groupBy("source").applyInPandas(to_shards, "source string, shard long, shard_size long, quota long")
    in_order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "mark"), F.col(key), "size")
    spans = dealt.withColumn("end", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    q = quotas.select(F.col("source").alias("of"), F.col("shard").alias("at"), "shard_size", "quota")
    spans = spans.join(q, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at")), "left").drop("of", "at")
    blocks = F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1)).cast("long")
    quota = F.least("quota", blocks * max_epochs)
    passes, rest = F.floor(quota / blocks), F.pmod(quota, blocks)
    offset = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("shard")), blocks)
    picked = lambda b: F.pmod(b * F.lit(STEP) + offset, blocks) < rest
    overlap = lambda b: F.least(F.col("end"), (b + 1) * block) - F.greatest(F.col("start"), b * block)
    partial = F.aggregate(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)), F.lit(0).cast("long"), lambda s, b: s + F.when(picked(b), overlap(b)).otherwise(F.lit(0)))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(passes * F.col("size") + partial).cast("long")
    return spans.select(key, "source", "size", "source_size", "target", taken.alias("taken"))
