from pyspark.sql import functions as F

from trackframe.plans import fixtures
from trackframe.plans.fixtures import view


def test_interval_views_take_every_user(spark, tmp_path):
    events = spark.range(2000).select(
        F.col("id").alias("event_id"),
        (F.col("id") % 200).alias("user_id"),
        F.when(F.col("id") < 1000, "error").otherwise("view").alias("event_type"),
        F.timestamp_seconds(F.col("id") * 1000).alias("ts"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    stimuli, valid = (view(spark, str(tmp_path), name) for name in ("stimuli", "valid"))
    assert stimuli.count() == 1000 and valid.count() == 800  # each user's last view has no next one
    assert {r.grp for r in stimuli.collect()} == {r.grp for r in valid.collect()} == set(range(200))


def test_boxes_are_dealt_to_more_tasks_as_the_table_grows(spark, tmp_path, monkeypatch):
    lines = spark.range(2000).select((F.col("id") * 7).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 50 + 1.0).alias("l_quantity"), F.lit(0.02).alias("l_discount"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    whole = sorted(map(tuple, view(spark, str(tmp_path), "gt").collect()))
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 100)
    gt = view(spark, str(tmp_path), "gt")
    tasks = gt.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 20 and max(r["count"] for r in tasks) < 200
    assert sorted(map(tuple, gt.collect())) == whole and len(whole) == 2000
