"""The reference entities as projections of the driver's tables, in SQL that Spark and DuckDB share.

$micros(x) and $div stand for what the two engines write differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BINDINGS = {
    "frames": """
SELECT concat('v', lpad(cast(user_id AS string), 6, '0')) AS video_id,
       cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bigint) AS frame_index,
       $micros(ts) - min($micros(ts)) OVER (PARTITION BY user_id) AS frame_time_us,
       value AS sharpness, cast(event_id % 10 AS double) / 10 AS clipped, event_id
FROM {events}""",
    "descriptors": "SELECT concat('o', lpad(cast(vec_id AS string), 6, '0')) AS observation_id, embedding AS descriptor, label FROM {embeddings}",
    "sequence": """
SELECT concat('c', lpad(cast(conv_id AS string), 6, '0')) AS sequence_id, concat('t', lpad(cast((n * 7919) % 100003 AS string), 6, '0')) AS observation_id, n - 1 AS position
FROM (SELECT conv_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS bigint) AS n FROM {conversations}) t""",
    "points": """
SELECT concat('g', lpad(cast(c_custkey AS string), 6, '0')) AS observation_id,
       cast((c_custkey * 7919) % 110000 AS double) / 1000 - 55 AS latitude_deg,
       cast((c_custkey * 104729) % 360000 AS double) / 1000 - 180 AS longitude_deg,
       CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'NAD-27' WHEN c_custkey % 2 = 0 THEN 'WGS-84' ELSE 'wgs 84' END AS map_datum,
       CASE WHEN c_custkey % 17 = 0 THEN 'absent' WHEN c_custkey % 19 = 0 THEN 'invalid' WHEN c_custkey % 23 = 0 THEN 'incomplete' ELSE 'resolved' END AS status
FROM {customer}""",
    "track_elements": """
SELECT l_orderkey AS point_id, concat('s', lpad(cast(l_suppkey AS string), 6, '0')) AS observation_id, l_linenumber AS feature_index
FROM {lineitem}""",
    "artifact_edges": """
SELECT concat('nation:', cast(n_nationkey AS string)) AS artifact, concat('region:', cast(n_regionkey AS string)) AS dependency FROM {nation}
UNION ALL SELECT concat('customer:', cast(c_custkey AS string)), concat('nation:', cast(c_nationkey AS string)) FROM {customer}
UNION ALL SELECT concat('supplier:', cast(s_suppkey AS string)), concat('nation:', cast(s_nationkey AS string)) FROM {supplier}
UNION ALL SELECT concat('order:', cast(o_orderkey AS string)), concat('customer:', cast(o_custkey AS string)) FROM {orders}""",
    "artifact_nodes": """
SELECT concat('region:', cast(r_regionkey AS string)) AS artifact, 'region' AS kind FROM {region}
UNION ALL SELECT concat('nation:', cast(n_nationkey AS string)), 'nation' FROM {nation}
UNION ALL SELECT concat('customer:', cast(c_custkey AS string)), 'customer' FROM {customer}
UNION ALL SELECT concat('supplier:', cast(s_suppkey AS string)), 'supplier' FROM {supplier}
UNION ALL SELECT concat('order:', cast(o_orderkey AS string)), 'order' FROM {orders}""",
    "pixels": """
SELECT concat('d', lpad(cast(l_orderkey AS string), 8, '0')) AS camera,
       cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS int) AS pixel,
       l_quantity AS depth, l_returnflag <> 'R' AS valid, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount * 10 END AS confidence,
       l_quantity + (l_partkey % 7) - 3 AS reference_depth, l_linestatus = 'O' OR l_tax > 0.02 AS reference_valid
FROM {lineitem}""",
    "poses": """
SELECT concat('A', '') AS solution, concat('s', lpad(cast(s_suppkey AS string), 6, '0')) AS camera,
       radians(cast((s_suppkey * 37) % 360 AS double)) AS angle, cast(s_suppkey % 7 AS double) AS tx, cast(s_suppkey % 5 AS double) AS ty, cast(s_suppkey % 3 AS double) AS tz FROM {supplier}
UNION ALL SELECT 'B', concat('s', lpad(cast(s_suppkey AS string), 6, '0')), radians(cast((s_suppkey * 37) % 360 + (s_suppkey % 5) * 0.25 AS double)), cast(s_suppkey % 7 AS double) + 0.125, cast(s_suppkey % 5 AS double), cast(s_suppkey % 3 AS double) - 0.25 FROM {supplier} WHERE s_suppkey % 4 <> 0
UNION ALL SELECT 'C', concat('s', lpad(cast(s_suppkey AS string), 6, '0')), radians(cast((s_suppkey * 37) % 360 - (s_suppkey % 3) * 0.5 AS double)), cast(s_suppkey % 7 AS double), cast(s_suppkey % 5 AS double) + 0.5, cast(s_suppkey % 3 AS double) FROM {supplier}""",
    "assets": """
SELECT concat('i', lpad(cast(doc_id AS string), 8, '0')) AS observation_id, text AS content, source FROM {documents}""",
    "subject_metrics": """
SELECT concat('s', lpad(cast(l_suppkey AS string), 6, '0')) AS subject, 'mean_discount' AS metric, 'lower_is_better' AS direction, round(avg(l_discount), 9) AS value FROM {lineitem} GROUP BY l_suppkey
UNION ALL SELECT concat('s', lpad(cast(l_suppkey AS string), 6, '0')), 'mean_quantity', CASE WHEN l_suppkey % 9 = 0 THEN 'informational' ELSE 'higher_is_better' END, round(avg(l_quantity), 9) FROM {lineitem} GROUP BY l_suppkey
UNION ALL SELECT concat('s', lpad(cast(l_suppkey AS string), 6, '0')), 'row_count', 'informational', cast(count(*) AS double) FROM {lineitem} WHERE l_suppkey % 4 <> 0 GROUP BY l_suppkey
UNION ALL SELECT concat('s', lpad(cast(l_suppkey AS string), 6, '0')), 'unheard_of', 'informational', 1.0 FROM {lineitem} WHERE l_suppkey % 13 = 0 GROUP BY l_suppkey""",
    "subject_failures": """
SELECT DISTINCT concat('s', lpad(cast(l_suppkey AS string), 6, '0')) AS subject, CASE WHEN l_suppkey % 3 = 0 THEN 'timeout' ELSE 'invalid_input' END AS failure FROM {lineitem} WHERE l_suppkey % 5 = 0
UNION ALL SELECT DISTINCT concat('s', lpad(cast(l_suppkey AS string), 6, '0')), 'strange_failure' FROM {lineitem} WHERE l_suppkey % 21 = 0""",
    "metric_rules": """
SELECT 'mean_discount' AS metric, true AS required, 'lower_is_better' AS direction, cast(0.0495 AS double) AS threshold, 'retry' AS decision
UNION ALL SELECT 'mean_quantity', true, 'higher_is_better', cast(25.0 AS double), 'warn'
UNION ALL SELECT 'row_count', true, 'informational', NULL, NULL""",
    "failure_rules": "SELECT 'timeout' AS failure, 'escalate' AS decision UNION ALL SELECT 'invalid_input', 'warn'",
    "raw_metadata": """
SELECT concat('e', lpad(cast(event_id AS string), 8, '0')) AS observation_id, k.position AS position,
       CASE WHEN k.position = 9 AND event_id % 7 = 0 THEN 'XMP' ELSE 'EXIF' END AS namespace,
       CASE k.position WHEN 0 THEN 'GPS GPSLatitude' WHEN 1 THEN 'GPS GPSLatitudeRef' WHEN 2 THEN 'GPS GPSLongitude' WHEN 3 THEN 'GPS GPSLongitudeRef' WHEN 4 THEN 'GPS GPSMapDatum'
            WHEN 5 THEN 'EXIF DateTimeOriginal' WHEN 6 THEN 'EXIF OffsetTimeOriginal' WHEN 7 THEN 'Image Model' WHEN 8 THEN 'GPS GPSLatitude' ELSE 'Lens Model' END AS key,
       CASE k.position
            WHEN 0 THEN CASE WHEN event_id % 29 = 0 THEN '[91, x]' ELSE concat('[', cast(event_id % 95 AS string), ', ', cast(event_id % 60 AS string), ', ', cast(event_id % 119 AS string), '/2]') END
            WHEN 1 THEN CASE WHEN event_id % 31 = 0 THEN 'Q' WHEN event_id % 2 = 0 THEN 'N' ELSE ' s ' END
            WHEN 2 THEN concat('[', cast(event_id % 181 AS string), ', ', cast(event_id % 60 AS string), ', ', cast(event_id % 60 AS string), ']')
            WHEN 3 THEN CASE WHEN event_id % 3 = 0 THEN 'E' ELSE 'w' END
            WHEN 4 THEN 'WGS-84'
            WHEN 5 THEN CASE WHEN event_id % 37 = 0 THEN '2024-01-05' WHEN event_id % 41 = 0 THEN '2024:02:30 10:00:00' ELSE concat('2024:0', cast(1 + event_id % 9 AS string), ':1', cast(event_id % 10 AS string), ' 0', cast(event_id % 10 AS string), ':3', cast(event_id % 10 AS string), ':15') END
            WHEN 6 THEN CASE WHEN event_id % 43 = 0 THEN '+25:00' WHEN event_id % 2 = 0 THEN '+05:30' ELSE '-08:00' END
            WHEN 7 THEN CASE WHEN event_id % 6 = 0 THEN 'DJI Mavic-3' WHEN event_id % 6 = 1 THEN 'Skydio X2' ELSE 'Camera 5' END
            WHEN 8 THEN '[1, 2, 3]' ELSE CASE WHEN event_id % 4 = 0 THEN 'Fish-Eye fisheye 8mm' ELSE 'Rolling_Shutter mode' END END AS value
FROM {events}, (SELECT 0 AS position UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9) k
WHERE NOT (k.position < 5 AND event_id % 14 = 0) AND NOT (k.position = 3 AND event_id % 10 = 0) AND NOT (k.position = 8 AND event_id % 23 <> 0)
  AND NOT (k.position = 4 AND event_id % 12 = 0) AND NOT (k.position IN (5, 6) AND event_id % 18 = 0) AND NOT (k.position = 5 AND event_id % 22 = 0) AND NOT (k.position = 6 AND event_id % 8 = 0)""",
    "rasters": """
SELECT concat('r', lpad(cast(p_partkey AS string), 6, '0')) AS raster_id, i.x AS x, i.y AS y, cast((p_partkey * 37 + p_size * (i.x + 3) * (i.y + 1) + i.x * i.y * 11) % 256 AS int) AS luma
FROM {part}, (SELECT a.v AS x, b.v AS y FROM (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) a, (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) b) i""",
    "samples": """
SELECT concat('p', lpad(cast(user_id AS string), 6, '0')) AS pair_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS int) AS n,
       cast((event_id * 7919 + user_id * 13) % 2001 AS int) - 1000 AS first, cast(((event_id + 3) * 7919 + user_id * 13) % 2001 AS int) - 1000 AS second
FROM {events}""",
}

#: Bindings that make many rows of each one; their tables are dealt out first, as a small file is read by one task.
DEALT = ("rasters", "raw_metadata")

_SPARK = ((r"\$micros\((\w+)\)", r"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', \1)"), (r"\$div", "div"))
_DUCK = ((r"\$micros\((\w+)\)", r"epoch_us(\1)"), (r"\$div", "//"), (r"\{(\w+)\}", r"\1"))


def _translated(sql: str, rules: tuple) -> str:
    for pattern, to in rules:
        sql = re.sub(pattern, to, sql)
    return sql


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a binding. Only the tables that it names are read."""
    sql = _translated(BINDINGS[name], _SPARK)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    if name in DEALT:
        tables = {t: rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) for t, rows in tables.items()}
    return spark.sql(sql, **tables)


def duck(*names: str) -> str:
    """WITH RECURSIVE and the bindings as common table expressions, in DuckDB's words."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_translated(BINDINGS[n], _DUCK)})" for n in names)
