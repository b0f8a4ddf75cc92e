"""Training runs: best epochs, composite scores, leaderboards, artifact lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_filled(*columns: str) -> Column:
    """The first of several columns that is not empty, as a number; 0 where all are empty, null where it is unreadable.

    Values come trimmed, as the reader of metrics gives them; one of blanks alone is unreadable.
    """
    first = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))
    return F.when(first.isNull(), F.lit(0.0)).otherwise(F.trim(first).try_cast("double"))


def best_epochs(metrics: DataFrame, score: Column) -> DataFrame:
    """Each run's epoch with the first largest score; scores must exceed -1; unreadable ones are skipped."""
    rows = metrics.withColumn("score", score).where("score > -1")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("score"), "epoch"))).where("_r = 1").select("run", "epoch", "score")


def leaderboard(best: DataFrame, n: int | None = None) -> DataFrame:
    """Runs by score, ties by name, with their rank."""
    top = best if n is None else best.orderBy(F.desc("score"), "run").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "run")))  # a row a run


def composite(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of min-max normalised metrics: a constant one counts 0.5, a negative weight inverts, 4 places."""
    stats = candidates.agg(*(f(m).alias(f"_{k}_{m}") for m in weights for k, f in (("lo", F.min), ("hi", F.max))))
    rows, total = candidates.join(F.broadcast(stats), F.lit(True)), F.lit(0.0)
    for m, w in weights.items():
        lo, hi = F.col(f"_lo_{m}"), F.col(f"_hi_{m}")
        unit = F.when(hi == lo, F.lit(0.5)).otherwise((F.col(m) - lo) / (hi - lo))
        total = total + (unit if w >= 0 else 1 - unit) * abs(w)
    return rows.withColumn("score", F.round(total, 4)).select(*candidates.columns, "score")


def lineage(artifacts: DataFrame, metadata: DataFrame, levels: int = 10) -> DataFrame:
    """Each artifact's nearest directory with metadata, at most ``levels`` up: path prefixes joined by equality."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.least(F.lit(levels), F.size(parts) - 1)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, F.size(parts) - k), "/").alias("dir")))
    steps = artifacts.select("path", F.explode(up).alias("u")).select("path", "u.depth", "u.dir")
    nearest = steps.join(metadata, "dir").groupBy("path").agg(F.min_by(F.struct("dir", "kind", "depth"), "depth").alias("n"))
    return artifacts.join(nearest, "path", "left").select("path", F.col("n.dir").alias("dir"), F.coalesce("n.kind", F.lit("unknown")).alias("kind"), F.col("n.depth").alias("depth"))


#: Levels that experiments and batches are searched upwards.
EXPERIMENT_LEVELS, BATCH_LEVELS = 10, 5
#: Endings of files for which a batch is asked first.
BATCH_FILES = r"(?i)\.(parquet|txt|csv)$"


def trace(artifacts: DataFrame, experiments: DataFrame, batches: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """(path, kind, experiment_dir, batch_dir, dataset_dir): where each artifact comes from, by the first rule that fits.

    eval: a file ``eval_config.yaml``, with the nearest experiment. batch_output: a file ``_meta.json``, or a parquet, txt or csv file with a batch
    at most five levels up, with that batch's experiment. dataset: a file ``manifest.csv`` or a folder of ``datasets`` (dir).
    experiment_artifact: anything with an experiment at most ten levels up. unknown: the rest.

    artifacts: path, and ``is_dir`` where folders are among them, which are searched from themselves on. experiments: (dir, root, chamber_type,
    name). batches: (dir, root, chamber_type, experiment_name); one whose experiment is not there keeps a null experiment.
    """
    rows = artifacts.select("path", F.coalesce(F.col("is_dir"), F.lit(False)).alias("is_dir") if "is_dir" in artifacts.columns else F.lit(False).alias("is_dir")).distinct()
    inside = rows.select("path", F.when(F.col("is_dir"), F.concat("path", F.lit("/"))).otherwise(F.col("path")).alias("from"))

    def nearest(meta: DataFrame, levels: int, name: str) -> DataFrame:
        found = lineage(inside.select(F.col("from").alias("path")).distinct(), meta.select("dir", F.lit(name).alias("kind")), levels)
        return inside.join(found.withColumnRenamed("path", "from"), "from").select("path", F.col("dir").alias(f"_{name}"))

    of_batch = batches.select(F.col("dir").alias("batch_dir"), "root", "chamber_type", F.col("experiment_name").alias("name")).join(experiments.select(F.col("dir").alias("_of_batch"), "root", "chamber_type", "name"), ["root", "chamber_type", "name"], "left").groupBy("batch_dir").agg(F.min("_of_batch").alias("_of_batch"))
    sets = rows.select("path").limit(0).withColumnRenamed("path", "_set") if datasets is None else datasets.select(F.col("dir").alias("_set")).distinct()
    found = rows.join(nearest(experiments, EXPERIMENT_LEVELS, "experiment"), "path").join(nearest(batches, BATCH_LEVELS, "batch"), "path").join(sets, F.col("is_dir") & (F.col("path") == F.col("_set")), "left")
    file, parent = ~F.col("is_dir"), F.regexp_replace("path", "/[^/]*$", "")
    name = F.regexp_extract("path", "[^/]*$", 0)
    own_meta, asked = file & (name == "_meta.json"), file & F.col("path").rlike(BATCH_FILES) & F.col("_batch").isNotNull()
    kind = F.when(file & (name == "eval_config.yaml"), "eval").when(own_meta | asked, "batch_output").when((name == "manifest.csv") | F.col("_set").isNotNull(), "dataset").when(F.col("_experiment").isNotNull(), "experiment_artifact").otherwise("unknown")
    batch = F.when(F.col("kind") == "batch_output", F.when(own_meta, parent).otherwise(F.col("_batch")))
    out = found.withColumn("kind", kind).withColumn("batch_dir", batch).join(of_batch, "batch_dir", "left")
    experiment = F.when(F.col("kind").isin("eval", "experiment_artifact"), F.col("_experiment")).when(F.col("kind") == "batch_output", F.col("_of_batch"))
    dataset = F.when(F.col("kind") == "dataset", F.when(F.col("is_dir"), F.col("path")).otherwise(parent))
    return out.select("path", "kind", experiment.alias("experiment_dir"), "batch_dir", dataset.alias("dataset_dir"))
