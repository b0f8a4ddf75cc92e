"""Views of the given tables that have the shape of tracking data, for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

#: SQL by name. ``DIV`` is integer division, ``EPOCH(x)`` unix seconds, ``T12(x)`` and others of ``CLOCKS`` texts of a time; {name} is a table or another view.
VIEWS = {
    "gt": """SELECT clip, frame, id, CAST(90*id + 2*abs((frame + 3*id) % 20 - 10) AS DOUBLE) AS x, CAST(40 + 3*abs((frame + id) % 30 - 15) AS DOUBLE) AS y, CAST(40 + id AS DOUBLE) AS w, CAST(36 + id AS DOUBLE) AS h, q, d
FROM (SELECT ok DIV 2000 AS clip, ok % 2000 + 1 AS frame, id, q, d FROM (SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS id, CAST(min(l_quantity) AS BIGINT) AS q, CAST(round(100*min(l_discount)) AS BIGINT) AS d FROM {lineitem} GROUP BY l_orderkey, l_linenumber) a) b""",
    "pred": """SELECT clip, frame, CASE WHEN id IN (1, 2) AND (frame DIV 40 + clip) % 3 = 0 THEN 3 - id ELSE id END AS id, x + q % 5 - 2 AS x, y + (q DIV 5) % 5 - 2 + CASE WHEN q % 25 = 0 THEN 30 ELSE 0 END AS y, w, h, CAST(50 + q AS DOUBLE) / 100 AS conf FROM {gt} g WHERE d % 10 <> 0
UNION ALL SELECT clip, frame, 90 + id, CAST(720 + 60*id AS DOUBLE), CAST(300 AS DOUBLE), CAST(40 AS DOUBLE), CAST(40 AS DOUBLE), CAST(50 AS DOUBLE) / 100 FROM {gt} g WHERE q = 49""",
    "anchors": """SELECT video, frame, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN t - 864000 ELSE t END AS unix, event_id
FROM (SELECT user_id AS video, 1000*(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS frame, EPOCH(ts) AS t, event_id FROM {events}) a""",
    "known": "SELECT video, frame, unix, event_id FROM {anchors} k WHERE unix IS NOT NULL",
    "probes": "SELECT DISTINCT video, frame + 500 * (event_id % 3) - 1 AS frame FROM {anchors} p",
    "ocr": """SELECT event_id, user_id AS video, event_id AS frame, EPOCH(ts) AS t, CASE event_id % 16 WHEN 0 THEN '[no text]'
WHEN 1 THEN T12(ts) || ' ' || DMY_NAME2(ts) WHEN 2 THEN T12(ts) || ' EST ' || DMY_NAME4(ts) WHEN 3 THEN T12(ts) || ' ' || DMY4(ts) WHEN 4 THEN T12(ts) || ' ' || DMY2(ts) WHEN 5 THEN T12(ts) || ' ' || MDY4(ts)
WHEN 6 THEN T24(ts) || ' ' || DMY_NAME2(ts) WHEN 7 THEN T24(ts) || ' est ' || DMY_NAME4(ts) WHEN 8 THEN T24(ts) || ' ' || DMY4(ts) WHEN 9 THEN T24(ts) || ' ' || DMY2(ts)
WHEN 10 THEN T12(ts) || ' EST' WHEN 11 THEN T24(ts) WHEN 12 THEN S12(ts) || '  Est' WHEN 13 THEN S24(ts) || ' GMT' WHEN 14 THEN replace(T12(ts), '0', 'O') || '  EST' ELSE T24(ts) || ' utc-05:00' END AS text FROM {events}""",
    "stimuli": "SELECT grp, start_ts, start_ts + 100 + n AS end_ts FROM (SELECT user_id AS grp, EPOCH(ts) AS start_ts, event_id % 90 AS n FROM {events} WHERE event_type = 'error') a",
    "valid": """SELECT grp, start_ts, nxt - 60*(event_id % 5) AS end_ts FROM (SELECT user_id AS grp, event_id, EPOCH(ts) AS start_ts, lead(EPOCH(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events} WHERE event_type = 'view') a WHERE nxt IS NOT NULL AND nxt - 60*(event_id % 5) > start_ts""",
    "clips": """SELECT o_orderkey AS clip_id, 'ch_' || CAST(o_custkey % 5 AS STRING) AS chamber, 'wave' || CAST(o_custkey % 3 AS STRING) AS wave, CASE WHEN o_orderstatus = 'P' THEN 'legacy' ELSE 'structured' END AS layout, 'vid_' || CAST(o_custkey % 40 AS STRING) || '_RGB.mkv' AS source_video, 'vid_' || CAST(o_custkey % 40 AS STRING) AS video, 'clips/c' || CAST(o_orderkey AS STRING) || '.mp4' AS clip_path, CAST(o_orderkey % 7200 AS DOUBLE) AS start_sec, CAST(o_orderkey % 7200 + 3 AS DOUBLE) AS end_sec FROM {orders}""",
    "taken": "SELECT video, start_sec, end_sec FROM {clips} c WHERE clip_id % 32 = 0",
    "candidates": "SELECT DISTINCT video, start_sec, end_sec FROM {clips} c WHERE clip_id % 2 = 1",
    "ranges": "SELECT DISTINCT video, CAST(lo AS DOUBLE) AS range_start, CAST(lo + 1500 AS DOUBLE) AS range_end FROM (SELECT video, 600 + 50*(CAST(substr(video, 5) AS BIGINT) % 7) AS lo FROM {clips} c WHERE CAST(substr(video, 5) AS BIGINT) < 30 UNION ALL SELECT video, 4000 + 10*(CAST(substr(video, 5) AS BIGINT) % 11) FROM {clips} c WHERE CAST(substr(video, 5) AS BIGINT) < 30) r",
    "anchored": "SELECT DISTINCT video FROM {clips} c WHERE CAST(substr(video, 5) AS BIGINT) NOT BETWEEN 20 AND 29",
    "frames": "SELECT DISTINCT clip, frame FROM {gt} g",
    "images": "SELECT 'c' || CAST(clip AS STRING) AS clip, 'f' || CAST(frame AS STRING) AS stem, CASE frame % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'jpeg' ELSE 'bmp' END AS ext FROM {frames} f WHERE frame % 97 <> 0 UNION ALL SELECT 'c' || CAST(clip AS STRING), 'f' || CAST(frame AS STRING), 'png' FROM {frames} f WHERE frame % 5 = 0 AND frame % 4 <> 0 AND frame % 97 <> 0",
    "labels_of": "SELECT 'c' || CAST(clip AS STRING) AS clip, 'f' || CAST(frame AS STRING) AS stem, frame FROM {frames} f WHERE frame % 7 <> 0",
    "lines": "SELECT clip, frame, id, CASE q % 29 WHEN 1 THEN '0 0.5 0.5 0.1' WHEN 2 THEN '0 0.5 word 0.1 0.1' WHEN 3 THEN '7 0.5 0.5 0.1 0.1' WHEN 4 THEN '0 1.5 0.5 0.1 0.1' ELSE '0 0.25 0.5 0.125 0.125' END AS line, q FROM {gt} g",
    "metrics": "SELECT 'run' || CAST(run AS STRING) AS run, epoch, CASE WHEN run % 3 = 0 THEN '' ELSE score END AS a, CASE WHEN run % 3 = 0 THEN score ELSE '' END AS b FROM (SELECT l_suppkey AS run, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS epoch, CASE WHEN l_quantity = 13 THEN ' ' WHEN l_quantity = 14 THEN '' ELSE CAST(CAST(round(l_discount*100) AS INT) AS STRING) END AS score FROM {lineitem}) m",
    "totals_of": "SELECT l_suppkey AS candidate, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS quality, CAST(count(*) AS DOUBLE) AS cost, CAST(1 AS DOUBLE) AS fixed FROM {lineitem} GROUP BY l_suppkey",
    "old_catalog": "SELECT p_name || CAST(p_partkey AS STRING) AS path, CAST(p_size AS BIGINT) AS size, p_partkey % 8 = 0 AS missing FROM {part} WHERE p_partkey % 10 <> 0",
    "new_listing": "SELECT p_name || CAST(p_partkey AS STRING) AS path, CAST(p_size + 1 AS BIGINT) AS size, p_partkey % 33 <> 0 AS readable FROM {part} WHERE p_partkey % 10 <> 1",
    "artifacts": "SELECT DISTINCT '/ws/' || p_brand || '/models/exp' || CAST(p_size AS STRING) || '/phase' || CAST(p_partkey % 3 AS STRING) || '/run' || CAST(p_partkey AS STRING) || '/weights/best.pt' AS path FROM {part}",
    "meta": "SELECT DISTINCT '/ws/' || p_brand || '/models/exp' || CAST(p_size AS STRING) AS dir, 'experiment' AS kind FROM {part} WHERE p_size % 2 = 0 UNION SELECT DISTINCT '/ws/' || p_brand || '/models/exp' || CAST(p_size AS STRING) || '/phase1', 'batch' FROM {part} WHERE p_size % 5 = 0",
    "experiments": "SELECT DISTINCT '/ws/' || p_brand || '/models/exp' || CAST(p_size AS STRING) AS dir, p_brand AS root, 'collective' AS chamber_type, 'exp' || CAST(p_size AS STRING) AS name FROM {part} WHERE p_size % 2 = 0",
    "runs_of": "SELECT DISTINCT '/ws/' || p_brand || '/models/exp' || CAST(p_size AS STRING) || '/phase1' AS dir, p_brand AS root, 'collective' AS chamber_type, 'exp' || CAST(p_size + 1 AS STRING) AS experiment_name FROM {part} WHERE p_size % 3 = 0",
    "traced": """SELECT DISTINCT path, CAST(is_dir = 1 AS BOOLEAN) AS is_dir FROM (SELECT path, 0 AS is_dir FROM {artifacts} a
UNION ALL SELECT '/ws/' || p_brand || '/models/exp' || CAST(p_size AS STRING) || '/phase1/out' || CAST(p_partkey % 9 AS STRING) || '/tracks.' || CASE p_partkey % 3 WHEN 0 THEN 'parquet' WHEN 1 THEN 'TXT' ELSE 'png' END, 0 FROM {part}
UNION ALL SELECT '/ws/' || p_brand || '/models/exp' || CAST(p_size AS STRING) || '/phase1/_meta.json', 0 FROM {part}
UNION ALL SELECT '/ws/' || p_brand || '/models/exp' || CAST(p_size AS STRING) || '/eval/ds/eval_config.yaml', 0 FROM {part}
UNION ALL SELECT '/ws/' || p_brand || '/sets/d' || CAST(p_size AS STRING) || '/manifest.csv', 0 FROM {part}
UNION ALL SELECT '/ws/' || p_brand || '/sets/d' || CAST(p_size AS STRING), 1 FROM {part}) z""",
    "datasets": "SELECT DISTINCT '/ws/' || p_brand || '/sets/d' || CAST(p_size AS STRING) AS dir FROM {part} WHERE p_size % 3 = 0",
    "videos": "SELECT video, count(*) * 900 AS frames, CAST(count(*) * 30 AS DOUBLE) AS seconds, CAST(min(clip_id) % 2 * 30 AS DOUBLE) AS fps FROM {clips} c GROUP BY video",
    "customers": "SELECT c_custkey, 'Cam' || CAST(c_custkey AS STRING) || CASE c_custkey % 5 WHEN 0 THEN '_RGB' WHEN 1 THEN '_IR' WHEN 2 THEN '_RGB_IR' WHEN 3 THEN '_Bird' ELSE '' END || '.mkv' AS file, c_nationkey AS nation FROM {customer}",
}


#: Texts of a time: name, Spark pattern, pattern of the other engine.
CLOCKS = (
    ("T12", "hh:mm:ss a", "%I:%M:%S %p"),
    ("T24", "HH:mm:ss", "%H:%M:%S"),
    ("S12", "hh:mm a", "%I:%M %p"),
    ("S24", "HH:mm", "%H:%M"),
    ("DMY_NAME2", "dd-MMM-yy", "%d-%b-%y"),
    ("DMY_NAME4", "dd-MMM-yyyy", "%d-%b-%Y"),
    ("DMY4", "dd/MM/yyyy", "%d/%m/%Y"),
    ("DMY2", "dd/MM/yy", "%d/%m/%y"),
    ("MDY4", "MM/dd/yyyy", "%m/%d/%Y"),
)


def spark_text(sql: str) -> str:
    sql = re.sub(r"EPOCH\((\w+)\)", r"(unix_micros(CAST(\1 AS TIMESTAMP)) / 1000000D)", sql)
    for name, pattern, _ in CLOCKS:
        sql = re.sub(rf"\b{name}\((\w+)\)", rf"date_format(\1, '{pattern}')", sql)
    return sql


def duck_text(sql: str) -> str:
    sql = sql.replace(" DIV ", " // ")
    sql = re.sub(r"EPOCH\((\w+)\)", r"epoch(\1)", sql)
    for name, _, pattern in CLOCKS:
        sql = re.sub(rf"\b{name}\((\w+)\)", rf"strftime(\1, '{pattern}')", sql)
    return sql


def needs(sql: str) -> list[str]:
    """Views that a text names, each after those it names itself."""
    out: list[str] = []
    for name in re.findall(r"\{(\w+)\}", sql):
        if name in VIEWS:
            for x in (*needs(VIEWS[name]), name):
                if x not in out:
                    out.append(x)
    return out


#: Rows of a table that one task groups, more or less: tasks grow in number with the table, not in size.
ROWS_A_TASK = 500_000

#: Keys by which a view groups or orders nearly every row of a table, which is dealt by them to tasks of ROWS_A_TASK.
DEALT = {("gt", "lineitem"): ("l_orderkey", "l_linenumber"), ("metrics", "lineitem"): ("l_suppkey",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, rows: DataFrame) -> int | None:
    """Tasks that share a table of so many rows; None for a table that one task could take, which is left to Spark."""
    n = -(-rows.count() // ROWS_A_TASK)  # Parquet's own counts
    return max(n, spark.sparkContext.defaultParallelism) if n > 1 else None


def source(spark: SparkSession, sf_dir: str, name: str, of: str) -> DataFrame:
    """A view or table as the view ``of`` reads it."""
    if name in VIEWS:
        return view(spark, sf_dir, name)
    rows, keys = table(spark, sf_dir, name), DEALT.get((of, name))
    n = parts(spark, rows) if keys else None
    return rows.repartition(n, *keys) if n else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables in ``sf_dir``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sql = spark_text(VIEWS[name])
    return spark.sql(sql, **{n: source(spark, sf_dir, n, name) for n in set(re.findall(r"\{(\w+)\}", sql))})


def oracle(sql: str) -> str:
    """The SQL for the other engine: the views it names come first as common table expressions."""
    names = needs(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", lambda m: f"fx_{m[1]}" if m[1] in VIEWS else m[1], duck_text(s))
    head = ",\n".join(f"fx_{n} AS ({plain(VIEWS[n])})" for n in names)
    text = plain(sql).strip()
    if not head:
        return text
    return f"WITH {head},\n{text[5:]}" if text.upper().startswith("WITH ") else f"WITH {head}\n{text}"
