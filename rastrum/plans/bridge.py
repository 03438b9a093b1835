"""Domain relations made from the generic test tables.

Each text is plain SQL that Spark and DuckDB read alike, so that both engines
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IMG_W, IMG_H = 960, 540
GRID_W, GRID_H = 32, 24

FRAMES = """
SELECT lpad(CAST(event_id AS STRING), 9, '0') AS frame_id, event_id AS ord, ts,
  CASE WHEN event_id % 31 = 0 THEN NULL
       WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'clear' ELSE 'cloudy' END
       WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'snow-rain' ELSE 'fog' END
       WHEN event_type = 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'Thunderstorm' ELSE 'rain' END
       WHEN event_type = 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'Light Drizzle' ELSE 'clear' END
       ELSE CASE WHEN event_id % 7 = 0 THEN 'windy' WHEN event_id % 7 = 1 THEN 'snow' ELSE 'cloudy' END END AS scraped_weather,
  CASE WHEN event_id % 29 = 0 THEN NULL
       WHEN hour(ts) < 6 OR hour(ts) >= 20 THEN 'Night'
       WHEN hour(ts) IN (6, 19) THEN 'twilight' ELSE 'day' END AS time_of_day,
  event_id % 23 <> 0 AS has_metadata,
  CASE user_id % 5 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'east' WHEN 3 THEN 'west' ELSE 'unknown' END AS region
FROM events"""

OBJECTS = f"""
SELECT lpad(CAST(l_orderkey AS STRING), 9, '0') AS frame_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq,
  CASE l_partkey % 10 WHEN 0 THEN 'Vehicle' WHEN 1 THEN 'VulnerableVehicle' WHEN 2 THEN 'Pedestrian' WHEN 3 THEN 'PoleObject' WHEN 4 THEN 'TrafficSign'
    WHEN 5 THEN 'TrafficLight' WHEN 6 THEN 'Vehicle' WHEN 7 THEN 'TrafficGuide' WHEN 8 THEN 'Animal' ELSE 'TrafficSignal' END AS name,
  CASE l_suppkey % 6 WHEN 0 THEN 'Car' WHEN 1 THEN 'Bicycle' WHEN 2 THEN 'Person' WHEN 3 THEN 'Van' WHEN 4 THEN 'Rectangle' ELSE 'unknown' END AS type,
  CASE l_linenumber % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Light' WHEN 2 THEN 'Medium' ELSE 'Heavy' END AS occlusion,
  CASE l_partkey % 7 WHEN 0 THEN 'EgoLane' WHEN 1 THEN 'LeftAndEgoLane' WHEN 2 THEN 'RightAndEgoLane' WHEN 3 THEN 'OnRoad' WHEN 4 THEN 'OffRoad' WHEN 5 THEN 'LeftMainlyEgo' ELSE 'unknown' END AS relative_position,
  (l_partkey + l_linenumber) % 29 <> 0 AS has_box,
  CAST((l_partkey % 24) * 40 AS DOUBLE) - 5.9 AS xmin,
  CAST((l_suppkey % 12) * 40 AS DOUBLE) - 3.5 AS ymin,
  CAST((l_partkey % 24) * 40 AS DOUBLE) + 2.35 + l_quantity * 8 AS xmax,
  CAST((l_suppkey % 12) * 40 AS DOUBLE) + 2.5 + CAST((l_linenumber * 37 + l_partkey * 3) % 230 AS DOUBLE) AS ymax,
  CAST(l_quantity AS DOUBLE) / 10 AS length, l_discount * 20 + 0.5 AS width, l_tax * 30 + 1 AS height
FROM lineitem"""

POINTS = """
SELECT lpad(CAST(label AS STRING), 9, '0') AS frame_id, CAST(vec_id * 21 + k AS BIGINT) AS idx,
  CAST({get}(3 * k + 1){end} AS DOUBLE) * 40 AS x, CAST({get}(3 * k + 2){end} AS DOUBLE) * 20 AS y, CAST({get}(3 * k + 3){end} AS DOUBLE) * 150 + 10 AS z
FROM {rows}"""

POINTS_SPARK = POINTS.format(get="element_at(embedding, ", end=")", rows="embeddings LATERAL VIEW explode(sequence(0, 20)) t AS k")
POINTS_DUCK = POINTS.format(get="embedding[", end="]", rows="embeddings, (SELECT unnest(range(21)) AS k)")

PATHS = """
SELECT page_id AS ord, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('frame_', lpad(CAST(page_id AS STRING), 6, '0'))
  WHEN 2 THEN url ELSE concat('  camera/frame_', lpad(CAST(page_id AS STRING), 6, '0'), '.png ') END AS line
FROM pages"""


def read(spark: SparkSession, sf_dir: str, table: str, text: str) -> DataFrame:
    """A domain relation over one table of a data directory."""
    return spark.sql(text.replace(f"FROM {table}", "FROM {src}"), src=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events", FRAMES)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated objects; box2d is null where there is none."""
    df = read(spark, sf_dir, "lineitem", OBJECTS)
    return df.selectExpr(
        "frame_id", "CAST(seq AS INT) AS seq", "name", "type", "occlusion", "relative_position", "length", "width", "height", "CASE WHEN has_box THEN named_struct('xmin', xmin, 'ymin', ymin, 'xmax', xmax, 'ymax', ymax) END AS box2d"
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings", POINTS_SPARK)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", PATHS)
