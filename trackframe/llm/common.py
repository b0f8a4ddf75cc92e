"""Helpers that the training-data operators share: tables, scratch tables, words and their hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators.scratch import shared_path

#: Runs of characters other than ASCII white space; ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Words whose hash a Python worker remembers; beyond that it starts anew.
REMEMBERED = 300_000
#: A bit table has 2 to the power of this many bits at most.
MOST_BITS = 27
#: Bytes of text that a task handles at once.
SLICE_BYTES = 6_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share."""
    return shared_path(spark, label)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, column: str) -> DataFrame:
    """As ``written``, in buckets by ``column``: grouping by it afterwards needs no shuffle."""
    spark, path, name = df.sparkSession, scratch(df.sparkSession, label), f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(min(shuffle_partitions(spark), 100_000), column).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive values, in doubling steps; empty if there are fewer."""
    if len(h) < width:
        return h[:0]
    out, done, power, size = None, 0, h, 1
    while True:
        if width & size:
            out = power if out is None else mix(out[: len(h) - done - size + 1]) + power[done:] * np.uint64(0x9E3779B97F4A7C15)
            done += size
            out = out[: len(h) - done + 1]
        if done == width:
            return mix(out)
        power = mix(power[:-size]) * np.uint64(0xD6E8FEB86659FD93) + power[size:]
        size *= 2


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; empty where it is null."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting, which is many times faster than a hash table here."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def values_of(x: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls."""
    _, offsets, data = x.buffers()
    ends = np.frombuffer(offsets, np.int32)[x.offset : x.offset + len(x) + 1].tolist() if len(x) else []
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def runs(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of about ``limit`` together; a larger row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``limit`` bytes each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def keyed(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: other columns, whatever their names, stay out of the plan."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def bit_table(df: DataFrame, column: str) -> np.ndarray:
    """Which 64-bit numbers can be in a column: by their first bits, 16 bits a number up to 2^MOST_BITS. Tasks make the parts, the driver puts 256 together."""
    bits = min(max(16, (df.count() * 16).bit_length()), MOST_BITS)

    def to_bits(part: pa.Table) -> pa.Table:
        table = np.zeros(1 << bits - 8, bool)
        table[(_spread(part.column("x").to_numpy()) >> np.uint64(64 - bits)).astype(np.int64) & (1 << bits - 8) - 1] = True
        return pa.table([pa.array([part.column("part")[0].as_py()], pa.int32()), pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0)
            yield pa.RecordBatch.from_arrays([x, pa.array((_spread(x.to_numpy()) >> np.uint64(56)).astype(np.int32))], ["x", "part"])

    parts = df.select(F.col(column).alias("x")).mapInArrow(parted, "x long, part int").groupBy("part").applyInArrow(to_bits, "part int, bits binary").collect()
    table = np.zeros((256, 1 << bits - 11), np.uint8)
    for r in parts:
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return table.reshape(-1)


def _spread(x: np.ndarray) -> np.ndarray:
    return mix(x.view(np.uint64))


def passing(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of the numbers can be in the column that a bit table was made of."""
    slot = _spread(x) >> np.uint64(64 - (len(table).bit_length() + 2))
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
