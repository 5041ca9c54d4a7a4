"""Canonical tables derived from the star-schema test tables.

The texts are SQL that Spark and DuckDB both accept. ``{name}`` stands for a
test table; Spark fills in a DataFrame, the SQL checks fill in the name.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from presswork.sources.tables import Tables

# Column types of the test tables; given, so that no file is opened to plan a query.
SOURCES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}

_SCRAPPED = "CAST(FLOOR(l_quantity * ROUND(l_discount * 100) / 100) AS BIGINT)"
_SHIFT = "CASE WHEN HOUR(ts) < 8 THEN 'N' WHEN HOUR(ts) < 16 THEN 'R' ELSE 'A' END"
_DAY = "CAST(CAST(ts AS DATE) AS {ntz})"

# The columns of production_results; p_, s_ and n_ tell which dimension they come from.
_RESULT_COLUMNS = {
    "machine_code": "CAST(l_suppkey AS VARCHAR(50))",
    "machine_name": "s_name",
    "mold_code": "p_brand",
    "mold_name": "CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE CONCAT('Mold ', p_brand) END",
    "product_code": "CAST(l_partkey AS VARCHAR(50))",
    "product_name": "p_name",
    "workshop": "n_name",
    "shift": "l_returnflag",
    "order_code": "CAST(l_orderkey AS VARCHAR(50))",
    "bom_revision": "CAST(l_linenumber % 2 AS INT)",
    "shift_start": "l_shipdate",
    "shift_end": "l_shipdate + INTERVAL '8' HOUR",
    "qty_made": "CAST(l_quantity AS BIGINT)",
    "qty_good": f"CAST(l_quantity AS BIGINT) - {_SCRAPPED}",
    "qty_scrap": _SCRAPPED,
    "availability": "(100 - ROUND(l_tax * 100)) / 100",
    "performance": "CASE WHEN l_linenumber = 7 THEN NULL "
                   "ELSE (100 - ROUND(l_discount * 100)) / 100 END",
    "quality": "(100 - ROUND(l_discount * 100)) / 100",
    "time_open": "CAST(28800 AS DOUBLE)",
    "time_useful": "288 * (100 - ROUND(l_tax * 100) - ROUND(l_discount * 100))",
}
_PRODUCTION_RESULTS = f"""
        SELECT {", ".join(f"{sql} AS {name}" for name, sql in _RESULT_COLUMNS.items())}
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
        JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey"""


BINDINGS = {
    "production_results": _PRODUCTION_RESULTS,
    # The runs of the mold-change operators: times within the day that meet the downtimes.
    "production_runs": """
        SELECT CAST(user_id AS VARCHAR(50)) AS machine_code, event_type AS mold_code,
               CAST(event_id % 50 AS VARCHAR(50)) AS product_code, ts AS shift_start,
               ts + INTERVAL '1' SECOND * CAST(ROUND(value) AS INT) AS shift_end
        FROM {events} WHERE event_type IN ('click', 'view', 'purchase')""",
    "downtimes": f"""
        SELECT CAST(user_id AS VARCHAR(50)) AS machine_code,
               CONCAT(event_type, '-', CAST(event_id % 10 AS VARCHAR(10))) AS reason_code,
               CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN NULL
                    ELSE CONCAT('Stop ', event_type, '-', CAST(event_id % 10 AS VARCHAR(10)))
               END AS reason_label,
               CAST(ROUND(value * 60) AS BIGINT) - 120 AS duration_s, ts AS start_ts,
               ts + INTERVAL '1' SECOND * CAST(ROUND(value * 60) AS INT) AS end_ts,
               {_SHIFT} AS shift, event_id AS order_id, event_id % 4 AS reason_id
        FROM {{events}} WHERE event_type IN ('error', 'signup')""",
    "downtime_orders": """
        SELECT o_orderkey AS id, CONCAT('OF', CAST(o_orderkey AS VARCHAR(20))) AS order_code
        FROM {orders} WHERE o_orderkey % 2 = 0""",
    "downtime_reasons": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS reason
        FROM {region} WHERE r_regionkey < 3""",
    "scraps": f"""
        SELECT CAST(l_suppkey AS VARCHAR(50)) AS machine_code,
               CAST(l_partkey AS VARCHAR(50)) AS product_code, l_returnflag AS shift,
               CONCAT(l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR(5))) AS defect_code,
               CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN NULL
                    ELSE CONCAT('Defect ', l_returnflag, l_linestatus,
                                CAST(l_linenumber AS VARCHAR(5))) END AS defect_label,
               {_SCRAPPED} AS qty, l_shipdate AS shift_start
        FROM {{lineitem}}""",
    "energy_alerts": f"""
        SELECT {_DAY} AS shift_start, {_DAY} + INTERVAL '8' HOUR AS shift_end,
               CAST(user_id AS VARCHAR(50)) AS machine_code, {_SHIFT} AS shift,
               'P' AS order_type, event_type, ts AS alert_start,
               CASE WHEN event_id % 10 = 0 THEN NULL
                    ELSE ts + INTERVAL '1' SECOND * (CAST(ROUND(value * 60) AS INT) - 60)
               END AS alert_end,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS kwh
        FROM {{events}} WHERE event_type = 'error'""",
    "energy_readings": f"""
        SELECT CAST(user_id AS VARCHAR(50)) AS machine_code, {_DAY} AS reading_ts, value AS kw
        FROM {{events}}""",
    # The readings of the power per minute: their times within the day.
    "power_readings": """
        SELECT CAST(user_id AS VARCHAR(50)) AS machine_code, ts AS reading_ts, value AS kw
        FROM {events}""",
    "energy_stops": f"""
        SELECT CAST(user_id AS VARCHAR(50)) AS machine_code, event_type AS stop_code,
               {_DAY} AS shift_start, ts AS stop_start,
               ts + INTERVAL '1' SECOND * CAST(ROUND(value * 60) AS INT) AS stop_end,
               value - 5 AS kwh
        FROM {{events}} WHERE event_type IN ('error', 'signup')""",
    "operator_log": """
        SELECT CASE WHEN event_id % 97 = 0 THEN NULL
                    ELSE CAST(user_id AS VARCHAR(50)) END AS operator_code,
               event_type AS machine_code, ts AS shift_start,
               CAST(ROUND(value * 300 * (1 + (user_id % 4) * (user_id % 4))) AS BIGINT) - 60
               AS duration_s
        FROM {events}""",
    "order_headers": """
        SELECT CAST(o_orderkey AS VARCHAR(50)) AS order_code,
               CASE WHEN o_custkey % 10 = 0 THEN NULL
                    ELSE CAST(o_custkey % 100 AS VARCHAR(50)) END AS machine_code,
               CASE WHEN o_custkey % 3 = 0 THEN NULL
                    ELSE CONCAT('Press ', CAST(o_custkey % 100 AS VARCHAR(50))) END AS machine_name,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL
                    ELSE CONCAT('Brand#', CAST(1 + o_orderkey % 25 AS VARCHAR(10))) END AS mold_code,
               CAST(NULL AS VARCHAR(50)) AS mold_name,
               CAST(FLOOR(o_totalprice / 1000) AS INT) AS strokes,
               CASE WHEN o_orderstatus = 'O' THEN 'L' WHEN o_orderstatus = 'P' THEN 'D'
                    WHEN o_orderkey % 2 = 0 THEN 'S' ELSE 'T' END AS status_code,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS actual_start,
               o_orderdate AS planned_start, o_orderkey AS seq_no
        FROM {orders}""",
    "order_lines": f"""
        SELECT CAST(l_orderkey AS VARCHAR(50)) AS order_code,
               CAST(l_partkey AS VARCHAR(50)) AS product_code,
               CAST(l_linenumber % 2 AS INT) AS bom_revision,
               CAST(l_quantity AS BIGINT) AS qty_planned,
               CASE WHEN l_linenumber = 7 THEN CAST(l_quantity AS BIGINT) + 5
                    ELSE CAST(l_quantity AS BIGINT) - {_SCRAPPED} END AS qty_good,
               {_SCRAPPED} AS qty_scrap
        FROM {{lineitem}}""",
    "products": """
        SELECT CAST(p_partkey AS VARCHAR(50)) AS product_code,
               CASE WHEN p_size = 1 THEN NULL ELSE p_name END AS product_name
        FROM {part}""",
    "bom": """
        SELECT CAST(p_partkey AS VARCHAR(50)) AS product_code, 0 AS bom_revision,
               p_type AS material_code, CAST(p_size AS DOUBLE) / 1000 AS qty_per_piece,
               0 AS recyclable
        FROM {part}
        UNION ALL
        SELECT CAST(p_partkey AS VARCHAR(50)), 1, p_type, CAST(p_size + 1 AS DOUBLE) / 1000, 0
        FROM {part}
        UNION ALL
        SELECT CAST(p_partkey AS VARCHAR(50)), 0, p_brand, CAST(p_size AS DOUBLE) / 4000, 1
        FROM {part} WHERE p_partkey % 3 = 0""",
    "consumables": """
        SELECT DISTINCT p_type AS material_code, CONCAT('Resin ', p_type) AS material_name,
               'KG' AS unit, 'T' AS type_code
        FROM {part}
        UNION ALL
        SELECT DISTINCT p_brand, CAST(NULL AS VARCHAR(100)), CAST(NULL AS VARCHAR(20)), 'B'
        FROM {part}
        UNION ALL
        SELECT CONCAT('UNUSED ', r_name), 'Not in any BOM', 'KG', 'T' FROM {region}""",
    # The second type is in no use.
    "consumable_types": """
        SELECT 'T' AS type_code, 'Resin' AS type_label UNION ALL SELECT 'C', 'Colour'""",
    "order_status": """
        SELECT 'L' AS status_code, 'Running' AS status_label
        UNION ALL SELECT 'D', 'Planned' UNION ALL SELECT 'S', 'Done'""",
}


def bound_sql(text: str, timestamp: str, **names: str) -> str:
    """A binding with the engine's name for zoneless timestamps, and table names, filled in."""
    text = text.replace("{ntz}", timestamp)
    return text.format(**names) if names else text


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table."""
    return spark.read.schema(SOURCES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = bound_sql(text, "TIMESTAMP_NTZ")
    used = [name for name in SOURCES if f"{{{name}}}" in text]
    return spark.sql(text, **{name: source(spark, sf_dir, name) for name in used})


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One canonical table (or ``production_runs``) over the test tables in ``sf_dir``."""
    return _run(spark, sf_dir, BINDINGS[name])


def bound_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All canonical tables over the test tables in ``sf_dir``."""
    return Tables(partial(bound, spark, sf_dir))
