"""Derived tables that stand in for segmentations; the same SQL runs in Spark and in the oracle's engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

WIDTH = 4160  # of an image row in ``runs`` and ``planes``
PIXEL_WIDTH = 128
DIVISOR = 1000

_VIEWS = "(SELECT CAST(0 AS BIGINT) AS view UNION ALL SELECT CAST(1 AS BIGINT) UNION ALL SELECT CAST(2 AS BIGINT)) v"
_KEYS = "SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS obj, CAST(l_linenumber AS BIGINT) AS ln FROM lineitem"

RUNS = f"""
SELECT v.view AS view, CAST(1 + CAST(FLOOR(l.obj/64.0) AS BIGINT) % 2 AS BIGINT) AS class_id, l.obj AS label, l.y AS y,
  l.y*4160 + (l.obj % 64)*64 + (l.obj*7 + v.view*13 + l.ln*5) % 9 AS s,
  l.y*4160 + (l.obj % 64)*64 + (l.obj*7 + v.view*13 + l.ln*5) % 9 + 44 + (l.obj*5 + v.view*3) % 17 AS e
FROM (SELECT obj, ln, CAST(FLOOR(obj/64.0) AS BIGINT)*8 + ln - 1 AS y FROM ({_KEYS}) q) l
CROSS JOIN {_VIEWS} WHERE (l.obj + v.view) % 5 <> 0"""

PLANES = f"""
SELECT ln AS z, obj AS true_id, CAST(DENSE_RANK() OVER (PARTITION BY ln ORDER BY obj) AS BIGINT) AS label,
  CAST(FLOOR(obj/64.0) AS BIGINT)*4160 + (obj % 64)*64 + (ln*3) % 11 AS s,
  CAST(FLOOR(obj/64.0) AS BIGINT)*4160 + (obj % 64)*64 + (ln*3) % 11 + 40 AS e
FROM ({_KEYS}) q"""

_BLOCK = "CAST(FLOOR((FLOOR(event_id/128.0)+{d})/8.0) AS BIGINT)"
_COL = "CAST(FLOOR((event_id % 128 + {d})/8.0) AS BIGINT)"
_CELL = f"CASE WHEN ({_BLOCK} + {_COL}) % 3 = 0 THEN 0 ELSE 1 + {_BLOCK}*17 + {_COL} END"
PIXELS = f"""
SELECT CAST(FLOOR(event_id/128.0) AS BIGINT) AS y, CAST(event_id % 128 AS BIGINT) AS x, value AS v, event_type AS cls,
  CAST({_CELL.format(d=0)} AS BIGINT) AS gt, CAST({_CELL.format(d=1)} AS BIGINT) AS pred FROM events"""

BOXES = f"""
SELECT view, label, min(y) AS y1, min(s - y*4160) AS x1, max(y) + 1 AS y2, max(e - y*4160) AS x2 FROM ({RUNS}) r GROUP BY view, label"""

PRED_MAPS = f"""
SELECT y, x, v/490.02 AS sem, v/490.02 AS ctr, CAST((y*3 + x*5) % 7 - 3 AS BIGINT) AS oy, CAST((y*5 + x*3) % 7 - 3 AS BIGINT) AS ox, gt, pred FROM ({PIXELS}) p"""

TILES = "SELECT * FROM (VALUES (0, 0, 512), (1, 448, 960), (2, 896, 1408), (3, 1344, 1856), (4, 1792, 2304), (5, 2240, 2752), (6, 2688, 3200), (7, 3136, 3648), (8, 3584, 4160)) AS t(tile, xs, xe)"

ALL = {"runs": RUNS, "planes": PLANES, "pixels": PIXELS, "boxes": BOXES, "pred_maps": PRED_MAPS, "tiles": TILES}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the driver's tables in ``sf_dir``."""
    text = ALL[name]
    used = sorted(set(re.findall(r"\bFROM (lineitem|events)\b", text)))
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    return spark.sql(re.sub(r"\bFROM (lineitem|events)\b", r"FROM {\1}", text), **frames) if frames else spark.sql(text)


def with_tables(sql: str) -> str:
    """``sql`` for the oracle, with the derived tables that it names as common table expressions."""
    used = [n for n in ALL if re.search(rf"\b(FROM|JOIN|,)\s+{n}\b", sql)]
    head = ", ".join(f"{n} AS ({ALL[n]})" for n in used)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
