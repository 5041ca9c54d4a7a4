"""Canonical input tables.

Every operator takes frames with these columns. String columns carry the
number of characters that is kept of them, as metadata; see
:func:`presswork.sources.tables.canonical`.
"""

from pyspark.sql import types as T

CODE, NAME, UNIT, STATUS = 50, 100, 20, 10

#: The day of a fact's time, a partition column that stored facts have beside their own.
DAY = "day"


def _text(name: str, width: int = CODE) -> T.StructField:
    return T.StructField(name, T.StringType(), True, {"width": width})


def _int(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType())


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def _double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def _time(name: str) -> T.StructField:
    return T.StructField(name, T.TimestampNTZType())


SCHEMAS: dict[str, T.StructType] = {
    # One row per machine x mold x product x shift run.
    "production_results": T.StructType([
        _text("machine_code"), _text("machine_name", NAME),
        _text("mold_code"), _text("mold_name", NAME),
        _text("product_code"), _text("product_name", NAME),
        _text("workshop"), _text("shift"), _text("order_code"), _int("bom_revision"),
        _time("shift_start"), _time("shift_end"),
        _long("qty_made"), _long("qty_good"), _long("qty_scrap"),
        _double("availability"), _double("performance"), _double("quality"),
        _double("time_open"), _double("time_useful"),
    ]),
    "downtimes": T.StructType([
        _text("machine_code"), _text("reason_code"), _text("reason_label", NAME),
        _long("duration_s"), _time("start_ts"), _time("end_ts"), _text("shift"),
        _long("order_id"), _long("reason_id"),
    ]),
    "downtime_orders": T.StructType([_long("id"), _text("order_code")]),
    "downtime_reasons": T.StructType([_long("id"), _text("reason", NAME)]),
    "scraps": T.StructType([
        _text("machine_code"), _text("product_code"), _text("shift"),
        _text("defect_code"), _text("defect_label", NAME), _long("qty"), _time("shift_start"),
    ]),
    "energy_alerts": T.StructType([
        _time("shift_start"), _time("shift_end"), _text("machine_code"), _text("shift"),
        _text("order_type"), _text("event_type"), _time("alert_start"), _time("alert_end"),
        _double("kwh"),
    ]),
    # One reading per machine per minute.
    "energy_readings": T.StructType([
        _text("machine_code"), _time("reading_ts"), _double("kw"),
    ]),
    "energy_stops": T.StructType([
        _text("machine_code"), _text("stop_code"), _time("shift_start"),
        _time("stop_start"), _time("stop_end"), _double("kwh"),
    ]),
    "operator_log": T.StructType([
        _text("operator_code"), _text("machine_code"), _time("shift_start"), _long("duration_s"),
    ]),
    "order_headers": T.StructType([
        _text("order_code"), _text("machine_code"), _text("machine_name", NAME),
        _text("mold_code"), _text("mold_name", NAME), _int("strokes"),
        _text("status_code", STATUS), _time("actual_start"), _time("planned_start"),
        _long("seq_no"),
    ]),
    "order_lines": T.StructType([
        _text("order_code"), _text("product_code"), _int("bom_revision"),
        _long("qty_planned"), _long("qty_good"), _long("qty_scrap"),
    ]),
    "products": T.StructType([_text("product_code"), _text("product_name", NAME)]),
    "bom": T.StructType([
        _text("product_code"), _int("bom_revision"), _text("material_code"),
        _double("qty_per_piece"), _int("recyclable"),
    ]),
    "consumables": T.StructType([
        _text("material_code"), _text("material_name", NAME), _text("unit", UNIT),
        _text("type_code"),
    ]),
    "consumable_types": T.StructType([_text("type_code"), _text("type_label")]),
    "order_status": T.StructType([_text("status_code", STATUS), _text("status_label")]),
}
