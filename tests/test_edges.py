"""Single rules on hand-made rows."""

import pytest
from conftest import at, rows

from presswork import FilterSpec, Tables
from presswork import operators as ops

pytestmark = pytest.mark.usefixtures("interpreted")


def run(**values):
    return {"machine_code": "M1", "shift_start": at("06:00"), "qty_made": 10, **values}


def test_padded_code_is_found_and_shown_clean(table):
    results = table("production_results", run(machine_code=" M1 ", machine_name="Press "))
    found = ops.machine_kpi(results, FilterSpec(machines=[" M1"]))
    assert rows(found, "machine_code", "machine_name") == [("M1", "Press")]


def test_blank_code_is_no_choice_but_has_kpis(table):
    results = table("production_results", run(machine_code="   "), run(machine_code=None), run())
    assert rows(ops.filter_machines(results)) == [("M1", "M1")]
    assert sorted(rows(ops.machine_kpi(results), "machine_code"), key=str) == ["", "M1", None]


def test_label_falls_back_to_code(table):
    results = table("production_results", run(machine_name="Zeta"), run(machine_code="M2"))
    assert rows(ops.filter_machines(results)) == [("M2", "M2"), ("M1", "Zeta")]


def test_same_code_with_two_labels_gives_two_rows(table):
    results = table("production_results", run(machine_name="A"), run(machine_name=None))
    assert sorted(rows(ops.machine_kpi(results), "machine_name")) == ["A", "M1"]


def test_long_code_is_cut(table):
    results = table("production_results", run(machine_code="x" * 60))
    assert rows(ops.filter_machines(results), "machine_code") == ["x" * 50]


def test_missing_quantities_and_times_count_as_zero(table):
    results = table("production_results", run(qty_made=None, qty_scrap=None, time_open=0.0,
                                              time_useful=5.0))
    kpi = ops.machine_kpi(results)
    assert rows(kpi, "pieces", "scrap_pieces", "scrap_pct", "oee_pct") == [(0, 0, 0.0, 0.0)]


def test_missing_rate_counts_in_the_mean(table):
    results = table("production_results", run(availability=0.5), run(availability=None))
    assert rows(ops.machine_kpi(results), "availability_pct") == [25.0]


def test_summary_weighs_rounded_oee_by_pieces(table):
    results = table(
        "production_results",
        run(time_open=3.0, time_useful=1.0),
        run(machine_code="M2", qty_made=30, qty_scrap=1, time_open=3.0, time_useful=2.0))
    summary = ops.machine_kpi_summary(ops.machine_kpi(results))
    # (33.33 * 10 + 66.67 * 30) / 40
    assert rows(summary) == [("CELKEM", "Souhrn za výběr", 40, 1, 2.5, 58.34)]


def test_summary_without_pieces_is_a_plain_mean(table):
    results = table(
        "production_results",
        run(qty_made=0, time_open=4.0, time_useful=1.0),
        run(machine_code="M2", qty_made=0, time_open=4.0, time_useful=2.0))
    assert rows(ops.machine_kpi_summary(ops.machine_kpi(results)), "scrap_pct", "oee_pct") == [
        (0.0, 37.5)]


def test_no_summary_of_nothing(table):
    empty = table("production_results")
    assert rows(ops.machine_kpi_summary(ops.machine_kpi(empty))) == []


def test_mold_without_code(table):
    results = table("production_results", run())
    assert rows(ops.mold_kpi(results), "mold_code", "mold_name") == [("Nespecifikováno", None)]


def stop(**values):
    return {"machine_code": "M1", "start_ts": at("10:00"), "duration_s": 3600, **values}


def test_blank_and_missing_label_are_two_groups_shown_alike(table):
    downtimes = table("downtimes", stop(reason_code="R", reason_label=" "),
                      stop(reason_code="R", duration_s=7200),
                      stop(reason_code="X", duration_s=0))
    pareto = ops.downtime_pareto(downtimes, table("production_results"))
    assert rows(pareto) == [("R", 2.0, 1, 2.0, 66.67), ("R", 1.0, 1, 1.0, 33.33)]


def test_shares_are_of_all_rows_or_of_those_shown(table):
    downtimes = table("downtimes", *(stop(reason_code=c, duration_s=s * 3600)
                                     for c, s in (("A", 6), ("B", 2), ("C", 2))))
    results = table("production_results")
    assert rows(ops.downtime_pareto(downtimes, results, limit=2), "share_pct") == rows(
        ops.downtime_pareto(downtimes, results, limit=None), "share_pct")[:2]
    assert rows(ops.downtime_pareto(downtimes, results, limit=2, share_of="shown"),
                "reason", "share_pct") == [
        ("A", 75.0), ("B", 25.0)]
    assert rows(ops.downtime_pareto(downtimes, results, limit=None), "share_pct") == [
        60.0, 20.0, 20.0]


def test_workshop_and_molds_may_come_from_different_runs(table):
    results = table("production_results",
                    run(workshop="W", mold_code="F1"), run(workshop="V", mold_code="F2"),
                    run(machine_code="M2", workshop="W", mold_code="F3"))
    downtimes = table("downtimes", stop(reason_code="A"), stop(machine_code="M2", reason_code="B"),
                      stop(machine_code="M3", reason_code="C"))
    spec = FilterSpec(workshop="W", molds=["F2"])
    assert rows(ops.downtime_pareto(downtimes, results, spec), "reason") == ["A"]
    assert rows(ops.downtime_pareto(downtimes, results, FilterSpec(workshop="W")), "reason") == [
        "A", "B"]


def test_downtime_log_keeps_stops_without_match(table):
    downtimes = table("downtimes", stop(order_id=1, reason_id=9),
                      stop(start_ts=at("11:00"), order_id=2, reason_id=1))
    log = ops.downtime_log(
        downtimes, table("downtime_orders", {"id": 1, "order_code": "O1"}),
        table("downtime_reasons", {"id": 1, "reason": "wait"}))
    assert rows(log, "order_code", "start_ts", "reason") == [
        (None, at("11:00"), "wait"), ("O1", at("10:00"), None)]


def test_downtime_log_counts_rows_that_a_repeated_id_adds(table):
    downtimes = table("downtimes", *(stop(start_ts=at(f"{h}:00"), order_id=1)
                                     for h in (10, 11, 12)))
    orders = table("downtime_orders", {"id": 1, "order_code": "A"}, {"id": 1, "order_code": "B"})
    log = ops.downtime_log(downtimes, orders, table("downtime_reasons"), limit=3)
    assert rows(log, "order_code", "start_ts") == [
        ("A", at("12:00")), ("B", at("12:00")), ("A", at("11:00"))]


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 9])
def test_newest_rows_across_days_and_without_time(table, limit):
    times = [at("2024-01-01 05:00"), at("2024-01-03 05:00"), at("2024-01-03 07:00"), None]
    downtimes = table("downtimes", *(stop(start_ts=t) for t in times))
    log = ops.downtime_log(
        downtimes, table("downtime_orders"), table("downtime_reasons"), limit=limit)
    assert rows(log, "start_ts") == [times[2], times[1], times[0], None][:limit]


def test_alert_without_positive_duration_has_no_hours(table):
    alert = {"machine_code": "M1", "shift_start": at("06:00"), "alert_start": at("10:00"),
             "kwh": 1.0}
    alerts = table("energy_alerts", {**alert, "alert_end": at("10:30")},
                   {**alert, "alert_end": at("10:00")}, {**alert, "alert_end": at("09:00")},
                   {**alert, "kwh": None}, {**alert, "machine_code": " "})
    assert rows(ops.energy_alert_rollup(alerts)) == [
        ("M1", 4, 0.5, 3.0), ("Neznámý lis", 1, 0.0, 1.0)]


def test_missing_power_is_shown_but_not_summed(table):
    reading = {"machine_code": "M1", "reading_ts": at("10:00")}
    readings = table("energy_readings", {**reading, "kw": None}, {**reading, "kw": 1.004},
                     {**reading, "kw": 2.5}, {**reading, "reading_ts": at("09:59"), "kw": 9.0})
    live = ops.energy_live(readings)
    assert rows(live, "kw") == [2.5, 1.0, None]
    assert rows(ops.energy_live_summary(live)) == [(at("10:00"), 3.5, 1, 3)]


def test_no_power_readings(table):
    live = ops.energy_live(table("energy_readings"))
    assert rows(ops.energy_live_summary(live)) == [(None, 0.0, 0, 0)]


def test_energy_stops_use_the_day_of_the_shift(table):
    shared = {"machine_code": "M1", "shift_start": at("2024-02-29 22:00")}
    stops = table("energy_stops", {**shared, "stop_start": at("01:00"), "kwh": 1.005},
                  {**shared, "kwh": 0.0}, {**shared, "kwh": None})
    assert rows(ops.energy_stops(stops, FilterSpec(end_date="2024-02-29")), "kwh") == [1.01]
    assert rows(ops.energy_stops(stops, FilterSpec(start_date="2024-03-01"))) == []


@pytest.mark.parametrize("seconds, level", [
    (143_999, "I"), (144_000, "L"), (288_000, "U"), (1_728_000, "O")])
def test_levels(table, seconds, level):
    log = table("operator_log", {"operator_code": "a1", "machine_code": "M", "duration_s": seconds})
    matrix = ops.iluo_matrix(ops.operator_time(log))
    assert rows(matrix, "level", "hours") == [(level, round(seconds / 3600, 1))]


def test_operator_filters(table):
    entry = {"machine_code": "M1", "shift_start": at("06:00"), "duration_s": 60}
    log = table("operator_log", {**entry, "operator_code": "Ab"},
                {**entry, "operator_code": "c", "machine_code": "M2"},
                {**entry, "operator_code": None}, {**entry, "operator_code": "d", "duration_s": 0})
    assert rows(ops.operator_time(log), "operator_code") == ["Ab", "c"]
    assert rows(ops.operator_time(log, operator=" c "), "operator_code") == ["c"]
    assert rows(ops.operator_time(log, machine="M1"), "operator_code") == ["Ab"]
    assert rows(ops.operator_time(log, machine="ALL", operator=""), "operator_code") == ["Ab", "c"]
    assert rows(ops.operator_time(log, from_date="2024-03-02")) == []
    assert rows(ops.iluo_matrix(ops.operator_time(log), operator_like="aB"), "operator_code") == [
        "Ab"]
    assert rows(ops.operator_list(log)) == [("Ab",), ("c",), ("d",)]


def header(**values):
    return {"order_code": "O1", "status_code": "L", "seq_no": 1, **values}


def line(**values):
    return {"order_code": "O1", "product_code": "P1", "bom_revision": 1, "qty_planned": 10, **values}


def test_overproduced_line(table):
    headers, lines = table("order_headers", header()), table("order_lines", line(qty_good=15))
    orders = ops.sap_orders(headers, lines)
    assert rows(orders, "progress_pct", "status", "is_active") == [(150.0, "Běží", True)]
    bom = table("bom", {"product_code": "P1", "bom_revision": 1, "material_code": "A",
                        "qty_per_piece": 0.5})
    need = ops.planned_material_need(
        headers, lines, table("products"), bom, table("consumables", {"material_code": "A"}),
        table("order_status"))
    assert rows(need, "remaining_pieces", "needed_kg", "planned_kg", "used_kg", "unit",
                "machine_code", "product_name", "status") == [
        (0, 0.0, 5.0, 7.5, "KG", "-", "P1", "L")]


def test_order_without_lines(table):
    orders = ops.sap_orders(table("order_headers", header(strokes=5)), table("order_lines"))
    assert rows(orders, "planned_pieces", "progress_pct", "machine_code", "machine_name") == [
        (0, 0.0, "-", None)]


def test_progress_against_strokes(table):
    orders = ops.sap_orders(table("order_headers", header(strokes=8)),
                            table("order_lines", line(qty_planned=0, qty_good=3)))
    assert rows(orders, "progress_pct") == [37.5]


def test_order_status_and_sequence(table):
    headers = table(
        "order_headers",
        *(header(order_code=code or "none", status_code=code, seq_no=n)
          for n, code in enumerate(["T", "D", None, "L", "P", "l"])))
    orders = ops.sap_orders(headers, table("order_lines"))
    assert rows(orders, "order_code", "status_code", "status", "is_active") == [
        ("L", "L", "Běží", True), ("D", "D", "Naplánováno", False),
        ("l", "L", "Běží", True), ("P", "P", "P", False),
        ("none", "D", "Naplánováno", False), ("T", "T", "Dokončeno", False)]


def test_order_filters(table):
    headers = table(
        "order_headers",
        header(machine_code="M1", mold_code="F1", planned_start=at("06:00")),
        header(order_code="O2", status_code="S", planned_start=at("06:00"), seq_no=2),
        header(order_code="O3", status_code="S", actual_start=at("2024-04-01 06:00"),
               planned_start=at("06:00"), seq_no=3))
    lines = table("order_lines", line(), line(product_code="P2"), line(order_code="O2"))

    def codes(**spec):
        return rows(ops.sap_orders(headers, lines, FilterSpec(**spec)), "order_code")
    assert codes() == ["O1", "O3", "O2"]
    assert codes(start_date="2024-03-01") == ["O1", "O3", "O2"]
    assert codes(start_date="2024-03-01", end_date="2024-03-31") == ["O1", "O2"]
    assert codes(start_date="2030-01-01", end_date="2030-01-01") == ["O1"]
    assert codes(articles=["P1"]) == ["O2"]
    assert codes(articles=["P2"]) == ["O1"]
    assert codes(machines=["M1"], molds=["F1"]) == ["O1"]


@pytest.mark.parametrize("limit", [1, 2, None])
def test_cutting_orders_first_changes_nothing(table, limit):
    headers = table("order_headers", *(header(order_code=f"O{n}", seq_no=n % 2) for n in range(4)))
    lines = table("order_lines", *(line(order_code=f"O{n}", qty_good=n) for n in range(4)))
    found = rows(ops.sap_orders(headers, lines, limit=limit), "order_code", "good_pieces")
    assert found == [("O1", 1), ("O3", 3), ("O0", 0), ("O2", 2)][:limit]


def used(table, spec=FilterSpec(), *materials, **values):
    results = table("production_results", run(
        order_code="O1", product_code="P1", bom_revision=1, qty_made=10, qty_good=8, qty_scrap=2,
        shift_end=at("14:00"), **values))
    bom = table("bom", *({"product_code": "P1", "bom_revision": 1, "qty_per_piece": 0.5, **m}
                         for m in materials))
    consumables = table("consumables", *({"material_code": m["material_code"]} for m in materials))
    return results, bom, consumables, spec


@pytest.mark.parametrize("recyclable, kilos", [(0, 5.0), (1, 4.0), (None, 4.0)])
def test_scrap_of_recyclable_material_is_not_consumed(table, recyclable, kilos):
    case = used(table, FilterSpec(), {"material_code": "A", "recyclable": recyclable})
    by_order = ops.material_use_by_order(*case)
    assert rows(by_order, "total_kg", "good_kg", "scrap_kg", "dose", "first_start", "last_end") == [
        (kilos, 4.0, 1.0, 0.5, at("06:00"), at("14:00"))]
    results, bom, consumables, spec = case
    assert rows(ops.material_daily_trend(results, bom, spec), "total_kg") == [kilos]
    assert rows(ops.material_summary(*case), "total_kg", "scrap_kg") == [(kilos, 1.0)]


def test_pieces_count_per_material(table):
    results, bom, _, _ = used(table, FilterSpec(), {"material_code": "A"}, {"material_code": "B"})
    assert rows(ops.material_daily_trend(results, bom), "pieces", "orders") == [(20, 1)]
    only = FilterSpec(material=" A ")
    assert rows(ops.material_daily_trend(results, bom, only), "pieces") == [10]
    assert rows(ops.material_daily_trend(results, bom, FilterSpec(material="ALL")), "pieces") == [
        20]


def test_use_without_pieces_is_left_out(table):
    results, bom, consumables, _ = used(table, FilterSpec(), {"material_code": "A"})
    idle = results.selectExpr(*(c if c != "qty_made" else "0L AS qty_made" for c in results.columns))
    assert rows(ops.material_use_by_order(idle, bom, consumables)) == []
    assert rows(ops.material_summary(idle, bom, consumables), "material_code") == ["A"]


def test_repeated_material_text_repeats_the_rows(table):
    results, bom, consumables, _ = used(table, FilterSpec(), {"material_code": "A"})
    twice = consumables.union(consumables)
    assert rows(ops.material_use_by_order(results, bom, twice), "pieces", "dose") == [(20, 0.5)]
    assert rows(ops.material_summary(results, bom, twice), "orders", "total_kg") == [(1, 8.0)]


def test_totals_count_machines(table):
    results, bom, consumables, _ = used(
        table, FilterSpec(), {"material_code": "A", "recyclable": 0}, machine_code=None)
    need = ops.planned_material_need(
        table("order_headers", header()), table("order_lines", line(qty_good=4)),
        table("products"), bom, consumables, table("order_status"))
    totals = ops.material_totals(need, ops.material_use_by_order(results, bom, consumables))
    assert rows(totals) == [(3.0, 5.0, 2.0, 6, 1, 0, 5.0, 4.0, 1.0, 10, 1, 1, 20.0)]


def test_totals_of_nothing(table):
    none = ops.planned_material_need(
        table("order_headers"), table("order_lines"), table("products"), table("bom"),
        table("consumables"), table("order_status"))
    use = ops.material_use_by_order(
        table("production_results"), table("bom"), table("consumables"))
    assert rows(ops.material_totals(none, use)) == [
        (0.0, 0.0, 0.0, 0, 0, 0, 0.0, 0.0, 0.0, 0, 0, 0, 0.0)]


def test_unused_material_is_not_listed(table):
    consumables = table("consumables", {"material_code": "A", "type_code": "T"},
                        {"material_code": "B"}, {"material_code": "C"})
    bom = table("bom", {"material_code": "A"}, {"material_code": "B"}, {"material_code": "A"})
    types = table("consumable_types", {"type_code": "T", "type_label": "Resin"})
    assert rows(ops.materials_list(consumables, types, bom)) == [
        ("A", "A", "KG", "Resin"), ("B", "B", "KG", "Ostatní")]


def test_row_counts_leave_empty_tables_out(table):
    tables = {"b": table("products", {}, {}), "a": table("products", {}, {}),
              "c": table("products", {}), "none": table("products")}
    assert rows(ops.table_row_counts(tables)) == [("a", 2), ("b", 2), ("c", 1)]
    assert rows(ops.table_row_counts(tables, limit=1)) == [("a", 2)]


def changed(table, old_end, new_start, *stops, spec=FilterSpec()):
    runs = table(
        "production_results",
        run(mold_code="F1", shift_start=at("2024-02-20 06:00"), shift_end=at(old_end)),
        run(mold_code="F2", shift_start=at(new_start), shift_end=at("2024-03-09 14:00")))
    downtimes = table("downtimes", *(
        {"machine_code": "M1", "start_ts": at(start), "duration_s": s} for start, s in stops))
    return ops.mold_changes(runs, downtimes, spec)


@pytest.mark.parametrize("old_end, new_start, minutes", [
    ("10:00:59", "10:01:00", [1]), ("10:00:00", "10:00:59", []), ("10:00", "18:00:59", [480]),
    ("10:00", "18:01", []), ("10:00", "09:00", [])])
def test_change_takes_a_minute_to_eight_hours(table, old_end, new_start, minutes):
    assert rows(changed(table, old_end, new_start), "minutes") == minutes


@pytest.mark.parametrize("stop, found", [
    (("09:30", 3600), True),            # starts 30 minutes before the old end
    (("09:29:59", 3600), False),
    (("2024-03-02 01:59", 60), True),   # ends 16 hours after it
    (("2024-03-02 01:59", 61), False),
    (("09:30", 59_400), True),          # fills the window
    (("09:30", 59_401), False),
    (("12:00", 0), False), (("12:00", -60), False), (("12:00", None), False)])
def test_window_of_the_stops(table, stop, found):
    changes = changed(table, "10:00", "10:05", stop)
    # Changes over 8 hours are dropped, so look at what decides them.
    stops = ops.changeover.latest_end_within(
        table("downtimes", {"machine_code": "M1", "start_ts": at(stop[0]), "duration_s": stop[1]})
        .selectExpr("machine_code AS key", "start_ts AS start", "duration_s AS seconds"),
        table("downtimes", {"machine_code": "M1", "start_ts": at("10:00")})
        .selectExpr("machine_code AS key", "start_ts AS probe"), 1800, 57_600)
    assert (rows(stops) != []) == found
    source = rows(changes, "time_source")
    assert source == (["DEBEQU"] if not found else source)


def test_new_mold_starts_after_the_last_stop(table):
    changes = changed(table, "10:00", "12:00", ("10:10", 600), ("10:40", 1200), ("09:00", 60))
    assert rows(changes) == [(
        "M1", "F1", "F2", "", at("10:00"), at("11:00"), "PROSTOJ", 60)]


def test_stops_are_not_filtered_by_day(table):
    spec = FilterSpec(start_date="2024-02-20", end_date="2024-02-21")
    runs = table("production_results",
                 run(mold_code="F1", shift_start=at("2024-02-20 06:00"),
                     shift_end=at("2024-02-21 23:00")),
                 run(mold_code="F2", shift_start=at("2024-02-21 23:30"),
                     shift_end=at("2024-02-22 06:00")))
    downtimes = table("downtimes", stop(start_ts=at("2024-02-22 00:00")))
    assert rows(ops.mold_changes(runs, downtimes, spec), "minutes", "time_source") == [
        (120, "PROSTOJ")]


def test_one_change_has_no_deviation(table):
    runs = table("production_results",
                 run(mold_code="F1", shift_end=at("10:00")),
                 run(mold_code="F2", shift_start=at("10:30"), shift_end=at("11:00")),
                 run(machine_code="M2", mold_code="F1", shift_end=at("10:00")),
                 run(machine_code="M2", mold_code="F2", shift_start=at("10:10"),
                     shift_end=at("11:00")),
                 run(machine_code="M2", mold_code="F1", shift_start=at("11:20"),
                     shift_end=at("12:00")))
    kpi = ops.mold_change_kpi(runs, table("downtimes"))
    assert rows(kpi) == [
        ("M1", 1, 0, 30.0, 30.0, 30.0, None), ("M2", 2, 0, 15.0, 10.0, 20.0, 7.1)]
    assert rows(ops.mold_change_kpi_summary(kpi)) == [(3, 20.0)]
    assert rows(ops.mold_change_trend(runs, table("downtimes"))) == [
        (at("00:00").date(), 3, 20.0)]


def test_no_changes(table):
    none = table("production_results"), table("downtimes")
    assert rows(ops.mold_change_kpi_summary(ops.mold_change_kpi(*none))) == [(0, 0.0)]
    assert rows(ops.mold_change_quality(ops.mold_changes(*none))) == [(0, 0, 0)]


def test_mold_filter_applies_before_runs_are_compared(table):
    runs = table("production_results", *(
        run(mold_code=mold, shift_start=at(f"{hour}:00"), shift_end=at(f"{hour}:30"))
        for hour, mold in (("10", "F1"), ("11", "F2"), ("12", "F1"), ("13", "F3"))))
    stops, spec = table("downtimes"), FilterSpec(molds=["F1", "F3"])
    assert rows(ops.mold_changes(runs, stops, spec), "old_mold", "new_mold") == [("F1", "F3")]
    assert rows(ops.mold_change_kpi(runs, stops, spec), "changes") == [3]
    assert rows(ops.mold_change_trend(runs, stops, spec), "changes") == [3]


def test_raw_columns_are_renamed(spark):
    source = spark.createDataFrame([(" A ", "x ")], "ref string, lib string")
    tables = Tables.raw(lambda name: source,
                        {"products": {"product_code": "ref", "product_name": "lib"}})
    assert rows(tables.products) == [("A", "x")]
    assert "products" in tables and len(tables) == 16


def test_totals_cover_more_rows_than_the_lists(spark, table):
    runs = table("production_results", *(
        {"machine_code": f"M{n}", "qty_made": 2, "qty_scrap": 1} for n in range(150)))
    assert ops.machine_kpi(runs).count() == 100
    total = ops.machine_kpi_summary(ops.machine_kpi(runs, limit=None))
    assert rows(total, "pieces", "scrap_pieces") == [(300, 150)]
    alerts = table("energy_alerts", *(
        {"machine_code": "M", "shift_start": at("10:00"), "kwh": 1.0} for _ in range(5200)))
    assert ops.energy_alerts(alerts).count() == 5000
    assert rows(ops.energy_alert_rollup(alerts), "alerts", "kwh") == [(5200, 5200.0)]
    assert rows(ops.energy_alert_rollup(alerts, limit=5000), "alerts") == [5000]


def test_share_of_a_negative_total_is_zero(spark):
    from presswork.functions import percent, share
    df = spark.createDataFrame([(5, -10), (5, 0), (5, None), (5, 10)], "part int, whole int")
    assert rows(df, share(df.part, df.whole).alias("x"), percent(df.part, df.whole).alias("y")) == [
        (0.0, -50.0), (0.0, 0.0), (0.0, 0.0), (50.0, 50.0)]
