"""The steered plans against plain ones, and what the plans look like."""

import random
import re
from datetime import datetime, timedelta

import pytest
from conftest import SMALL, at, rows
from pyspark.sql import Window, functions as F

from checks import registry
from presswork import FilterSpec, Tables
from presswork import operators as ops
from presswork.operators import materials
from presswork.plans import reports
from presswork.plans.containment import latest_end_within
from presswork.plans.sequence import value_switches
from presswork.sources.bindings import bound, bound_tables

START = datetime(2024, 1, 1)
BEFORE, AFTER = 1800, 57_600


def moment(rng, days=3.0, micros=True):
    seconds = rng.uniform(0, days * 86_400)
    return START + timedelta(seconds=seconds if micros else int(seconds))


def latest_by_trying_all(spans, probes):
    found = {}
    for key, probe in probes:
        low, high = probe - timedelta(seconds=BEFORE), probe + timedelta(seconds=AFTER)
        ends = [start + timedelta(seconds=s) for k, start, s in spans if k == key and s > 0
                and start >= low and start + timedelta(seconds=s) <= high]
        if ends:
            found[key, probe] = max(ends)
    return found


def durations(rng):
    """Short and long stops, and such that just fit the window, at every grid."""
    return rng.choice([
        rng.randint(-5, 300), rng.randint(1, 70_000), BEFORE + AFTER - rng.randint(-2, 4),
        BEFORE + AFTER - rng.randint(0, 130), BEFORE + AFTER - rng.randint(0, 9_000)])


@pytest.mark.parametrize("seed, micros, grids", [
    (1, True, (4096, 64, 1)), (2, False, (4096, 64, 1)), (3, False, (4096, 64, 1)),
    (4, True, (8192, 512, 32, 2, 1)), (5, False, (30_000, 500, 20, 1))])
def test_latest_end_within(spark, seed, micros, grids):
    rng = random.Random(seed)
    # Key "hot" holds a third of the spans.
    keys = ["hot"] * 4 + [f"k{n}" for n in range(8)]
    spans = [(rng.choice(keys), moment(rng, 3, micros), durations(rng)) for _ in range(3000)]
    probes = [(rng.choice(keys), moment(rng, 3, micros)) for _ in range(1000)]
    # Probes whose window starts or ends exactly where a span does.
    for key, start, seconds in rng.sample(spans, 600):
        end = start + timedelta(seconds=seconds)
        probes += [(key, start + timedelta(seconds=BEFORE)), (key, end - timedelta(seconds=AFTER))]
    found = latest_end_within(
        spark.createDataFrame(spans, "key string, start timestamp_ntz, seconds long"),
        spark.createDataFrame(probes, "key string, probe timestamp_ntz"), BEFORE, AFTER, grids)
    assert {(k, p): end for k, p, end in rows(found)} == latest_by_trying_all(spans, probes)


@pytest.mark.parametrize("bucket_s", [60, 3600, 10**9])
def test_value_switches(spark, bucket_s):
    rng = random.Random(bucket_s)
    keys = ["hot"] * 4 + [f"k{n}" for n in range(8)]
    # Times are coarse, so that there are ties; some times and ends are missing.
    data = [
        (rng.choice(keys), rng.choice([START + timedelta(minutes=rng.randint(0, 2000))] * 30 + [None]),
         rng.choice("abc"), rng.choice([moment(rng, micros=False)] * 9 + [None]), n)
        for n in range(3000)]
    df = spark.createDataFrame(
        data, "k string, t timestamp_ntz, v string, c timestamp_ntz, tie long")
    window = Window.partitionBy("k").orderBy("t", "tie")
    plain = df.withColumns({
        "previous_v": F.lag("v").over(window), "previous_c": F.lag("c").over(window),
    }).where("v <> previous_v AND previous_c IS NOT NULL")
    found = value_switches(df, "k", "t", "v", "c", ["tie"], bucket_s)
    assert found.columns == plain.columns
    assert sorted(rows(found), key=str) == sorted(rows(plain), key=str)
    assert plain.count() > 1000


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", registry.queries())
def test_no_join_without_keys_and_no_python(spark, name):
    plan = plan_of(registry.queries()[name](spark, SMALL))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Cross", "Python", "RDDScan"):
        assert unwanted not in plan


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The canonical tables as Parquet files."""
    root = str(tmp_path_factory.mktemp("tables"))
    for name, df in bound_tables(spark, SMALL).items():
        df.write.parquet(f"{root}/{name}")
    return Tables(lambda name: spark.read.parquet(f"{root}/{name}"))


def test_filters_and_columns_reach_the_scan(stored):
    spec = FilterSpec("1997-01-01", "1999-12-31", "A", machines=["3", "4"], molds=["Brand#2"])
    plan = plan_of(ops.mold_kpi(stored.production_results, spec))
    for pushed in ("GreaterThanOrEqual(shift_start,1997-01-01T00:00)",
                   "LessThan(shift_start,2000-01-01T00:00)", "EqualTo(shift,A)",
                   "In(machine_code, [3,4])", "EqualTo(mold_code,Brand#2)"):
        assert pushed in plan
    assert "product_name" not in plan.split("== Physical Plan ==")[1]
    assert "TakeOrderedAndProject(limit=30" in plan
    choices = plan_of(ops.filter_shifts(stored.production_results))
    assert "Not(EqualTo(shift,))" in choices and "ReadSchema: struct<shift:string>" in choices


def test_latest_times_reach_the_scan(stored):
    live = plan_of(ops.energy_live(stored.energy_readings))
    assert "EqualTo(reading_ts,ScalarSubquery" in live
    alerts = plan_of(ops.energy_alerts(stored.energy_alerts, limit=20))
    assert "Or(GreaterThanOrEqual(shift_start,ScalarSubquery" in alerts


def test_times_of_the_runs_reach_the_scan_of_the_stops(stored):
    spec = FilterSpec(start_date="1997-01-01", machines=["3"])
    plan = plan_of(ops.mold_changes(stored.production_results, stored.downtimes, spec))
    assert "GreaterThanOrEqual(start_ts,ScalarSubquery" in plan
    assert "LessThanOrEqual(start_ts,ScalarSubquery" in plan
    assert plan.count("EqualTo(machine_code,3)") > 2
    free = plan_of(ops.mold_changes(stored.production_results, stored.downtimes))
    assert "ScalarSubquery" not in free


@pytest.fixture
def small_partitions(spark):
    """Joins that shuffle, and partitions that count as skewed from a few kilobytes."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.shuffle.partitions": "24",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_hot_product_and_order_are_split(spark, table, small_partitions):
    n = 60_000
    hot = "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END"
    rows_of = spark.range(0, n, 1, 8).selectExpr(
        "id", f"{hot} AS product_code", "CAST(id % 2 AS INT) AS bom_revision",
        "CAST(id % 10 AS STRING) AS machine_code",
        "CAST(id AS STRING) AS order_code", "1L AS qty_made", "1L AS qty_good", "0L AS qty_scrap",
        "CAST(NULL AS STRING) AS machine_name", "CAST(NULL AS STRING) AS product_name",
        "TIMESTAMP_NTZ'2024-03-01 06:00:00' AS shift_start", "shift_start AS shift_end")
    bom = rows_of.selectExpr("product_code", "bom_revision", "'A' AS material_code",
                             "1.0D AS qty_per_piece", "0 AS recyclable").distinct().checkpoint()
    consumables = table("consumables", {"material_code": "A"})

    use = ops.material_use_by_order(rows_of, bom, consumables, limit=None)
    assert use.agg(F.sum("pieces"), F.count("pieces")).collect()[0] == (n, n)
    trend = ops.material_daily_trend(rows_of, bom)
    assert rows(trend, "pieces", "orders") == [(n, n)]

    headers = rows_of.selectExpr(
        f"{hot} AS order_code", "'M' AS machine_code", "'M' AS machine_name",
        "'F' AS mold_code", "'L' AS status_code").distinct().checkpoint()
    lines = rows_of.selectExpr(f"{hot} AS order_code", "product_code", "bom_revision",
                               "3L AS qty_planned", "1L AS qty_good", "0L AS qty_scrap")
    need = ops.planned_material_need(
        headers, lines, table("products"), bom, consumables, table("order_status"), limit=None)
    assert need.agg(F.sum("remaining_pieces")).collect()[0][0] == 2 * n
    # Joins by product and by material; by product; by order and by material (the lines of
    # one product all look alike here, and are too few bytes to be split).
    for df, joins in ((use, 2), (trend, 1), (need, 2)):
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("SortMergeJoin(skew=true)") >= joins, final


def test_changes_are_found_once(spark):
    df = ops.mold_changes(bound(spark, SMALL, "production_runs"), bound(spark, SMALL, "downtimes"))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def below_exchange(plan, key):
    """The part of a physical plan under the shuffle by a column."""
    plan = plan.split("== Physical Plan ==")[1]
    return re.split(rf"Exchange hashpartitioning\({key}#", plan)[1:]


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_orders_are_ranked_once_and_lines_cut_to_them(stored):
    query = ops.sap_orders(stored.order_headers, stored.order_lines)
    final = final_plan(query)
    # headers and lines meet one broadcast of the codes shown
    assert final.count("LeftSemi") == 2 and final.count("TakeOrderedAndProject(limit=100") == 1
    assert "ReusedExchange [_named" in final
    assert "LeftSemi" in below_exchange(plan_of(query), "order_code")[0].split("Exchange hash")[0]
    full = plan_of(ops.sap_orders(stored.order_headers, stored.order_lines, limit=None))
    assert "LeftSemi" not in full
    assert rows(query) == rows(ops.sap_orders(stored.order_headers, stored.order_lines, limit=None))[:100]


def test_looked_up_tables_are_filtered_before_their_join(stored):
    log = plan_of(ops.downtime_log(stored.downtimes, stored.downtime_orders, stored.downtime_reasons))
    need = plan_of(ops.planned_material_need(
        stored.order_headers, stored.order_lines, stored.products, stored.bom, stored.consumables,
        stored.order_status))
    assert log.split("== Physical Plan ==")[1].count("LeftSemi") == 2
    assert need.split("== Physical Plan ==")[1].count("LeftSemi") >= 1


def test_no_task_holds_the_values_looked_up(stored, small_partitions):
    """Without broadcasts, as for a limit of millions, both sides of a lookup are shuffled by the value."""
    reports_ = {
        "log": lambda n: ops.downtime_log(
            stored.downtimes, stored.downtime_orders, stored.downtime_reasons, n),
        "orders": lambda n: ops.sap_orders(stored.order_headers, stored.order_lines, limit=n),
        "need": lambda n: ops.planned_material_need(
            stored.order_headers, stored.order_lines, stored.products, stored.bom,
            stored.consumables, stored.order_status, limit=n)}
    for make in reports_.values():
        plan = plan_of(make(1_000_000)).split("== Physical Plan ==")[1]
        assert "collect_set" not in plan and "array_contains" not in plan and "Broadcast" not in plan
        assert "SortMergeJoin" in plan and "LeftSemi" in plan
        whole = rows(make(None))
        for limit in (7, 1_000_000):
            assert rows(make(limit)) == whole[:limit]


def test_lookups_keep_missing_codes(spark, table):
    headers = table("order_headers", {"order_code": None, "status_code": "L", "seq_no": 3},
                    {"order_code": "A", "status_code": "L", "seq_no": 2},
                    {"order_code": None, "status_code": "T", "seq_no": 1})
    lines = table("order_lines", {"order_code": "A", "qty_planned": 5}, {"order_code": None, "qty_planned": 7})
    found = rows(ops.sap_orders(headers, lines, limit=2), "order_code", "planned_pieces")
    assert found == [(None, 0), ("A", 5)]


def detected_first(runs, spec):
    """(machine, old mold, new mold, old end, new start) of all changes, then the filters; no stops."""
    found = []
    for machine in {r[0] for r in runs}:
        own = sorted((r for r in runs if r[0] == machine and r[0] is not None and r[1] is not None),
                     key=lambda r: [(x is not None, x) for x in (r[2], r[3], r[1], r[4] or "")])
        for old, new in zip(own, own[1:]):
            if old[1] == new[1] or old[3] is None or new[2] is None:
                continue
            minutes = (new[2].replace(second=0) - old[3].replace(second=0)).total_seconds() / 60
            if (1 <= minutes <= 480 and (not spec.start_date or new[2].date() >= spec.start_date)
                    and (not spec.end_date or new[2].date() <= spec.end_date)
                    and (not spec.molds or new[1] in spec.molds)
                    and (not spec.machines or machine in spec.machines)):
                found.append((machine, old[1], new[1], old[3], new[2]))
    return sorted(found)


@pytest.mark.parametrize("spec", [
    FilterSpec(), FilterSpec("2024-01-02"), FilterSpec("2024-01-02", "2024-01-02", molds=["a", "b"]),
    FilterSpec(end_date="2024-01-01"), FilterSpec("2024-01-03", machines=["k1", "hot"]),
    FilterSpec("2025-01-01")])
@pytest.mark.parametrize("by_day", [False, True])
def test_changes_found_before_the_filters(spark, table, spec, by_day):
    rng = random.Random(9)
    runs = []
    for _ in range(1500):
        start = START + timedelta(minutes=rng.randint(0, 4000))
        runs.append((rng.choice(["hot"] * 4 + ["k1", "k2", "k3", None]), rng.choice("abc") if rng.random() < .97 else None,
                     rng.choice([start] * 30 + [None]), rng.choice([start - timedelta(minutes=rng.randint(0, 300))] * 9 + [None]),
                     rng.choice(["p", None])))
    df = spark.createDataFrame(runs, "machine_code string, mold_code string, shift_start timestamp_ntz,"
                                     " shift_end timestamp_ntz, product_code string")
    df = df.withColumn("day", F.to_date("shift_start")) if by_day else df
    found = ops.mold_changes(df, table("downtimes"), spec, limit=None, detect_before_filter=True)
    assert sorted(rows(found, "machine_code", "old_mold", "new_mold", "old_end", "new_start")) == detected_first(runs, spec)


def test_look_back_reads_one_run_per_machine(stored):
    spec = FilterSpec("1998-01-01", "1998-02-01")
    plan = plan_of(ops.mold_changes(
        stored.production_results, stored.downtimes, spec, detect_before_filter=True))
    # history: machine and time alone; then whole runs from the time that is needed on
    assert re.search(r"LessThan\(shift_start,1998-01-01T00:00\).*ReadSchema: "
                     r"struct<machine_code:string,mold_code:string,shift_start:timestamp_ntz>", plan)
    assert "GreaterThanOrEqual(shift_start,ScalarSubquery" in plan


def test_skills_as_a_table(spark):
    def made(*cells):
        df = spark.createDataFrame(list(cells), "operator_code string, machine_code string, seconds long")
        return ops.iluo_matrix(df)

    cells = [("2", "M1", 3600), ("1", "M1", 300_000), ("1", "M0", 150_000), ("1", None, 7200), ("3", "M 2", 1_728_000)]
    pivot = ops.iluo_pivot(made(*cells))
    assert pivot.columns == ["operator_code", "M 2", "M0", "M1", "-"]
    assert rows(pivot) == [("1", None, "L", "U", "I"), ("2", None, None, "I", None), ("3", "O", None, None, None)]
    assert rows(ops.iluo_pivot(made(*cells), "hours").select("`-`", "M1")) == [(2.0, 83.3), (None, 1.0), (None, None)]
    empty = ops.iluo_pivot(made(*cells).limit(0))
    assert empty.columns == ["operator_code"] and rows(empty) == []
    assert ops.iluo_pivot(made(*cells), most=4).count() == 3
    with pytest.raises(ValueError, match="more than 3 machines"):
        ops.iluo_pivot(made(*cells), most=3)
    with pytest.raises(ValueError, match="name of another column"):
        ops.iluo_pivot(made(("1", "operator_code", 5)))
    with pytest.raises(ValueError, match="cells show"):
        ops.iluo_pivot(made(*cells), "machine_code")


def needs_of(spark, seed, lines=400):
    """Tables of planned needs with ties, few and missing doses, and repeated orders and materials."""
    rng = random.Random(seed)
    products = [f"P{n}" for n in range(12)]
    headers = [(f"O{n}", rng.choice(["M1", None]), rng.choice("LDPSTX")) for n in range(60)]
    headers += headers[:3] + [("", "M1", "L"), (None, "M1", "L")]
    items = [(f"O{rng.randint(0, 62)}", rng.choice([*products, "", None, "none"]), rng.randint(0, 1),
              rng.choice([None, 0, 5, 100, rng.randint(0, 10**seed)]), rng.choice([None, 0, 3, 200])) for _ in range(lines)]
    bom = [(p, r, rng.choice("ABCD"), rng.choice([None, 0.0, 0.5, 0.5, 0.004, -1.0, rng.random()]))
           for p in products[1:] for r in (0, 1) for _ in range(rng.randint(0, 4))]
    return (
        spark.createDataFrame(headers, "order_code string, machine_code string, status_code string")
        .selectExpr("*", "'x' AS machine_name", "'y' AS mold_code"),
        spark.createDataFrame(items, "order_code string, product_code string, bom_revision int,"
                                     " qty_planned long, qty_good long").selectExpr("*", "1L AS qty_scrap"),
        spark.createDataFrame([("P3", "three")], "product_code string, product_name string"),
        spark.createDataFrame(bom, "product_code string, bom_revision int, material_code string,"
                                   " qty_per_piece double"),
        spark.createDataFrame([("A", "a"), ("A", "again"), ("B", None), ("C", "c")],
                              "material_code string, material_name string").selectExpr("*", "'KG' AS unit"),
        spark.createDataFrame([("L", "Running")], "status_code string, status_label string"))


@pytest.mark.parametrize("seed", range(1, 5))
def test_needs_within_reach_are_the_first_of_all(spark, interpreted, seed):
    tables = needs_of(spark, seed)
    whole = rows(ops.planned_material_need(*tables, limit=None))
    assert len({r[16] for r in whole}) < len(whole)
    for limit in (1, 2, 5, 17, 60, len(whole) - 1, len(whole), len(whole) + 5):
        assert rows(ops.planned_material_need(*tables, limit=limit)) == whole[:limit]
    assert rows(ops.planned_material_need(*(t.limit(0) for t in tables))) == []


def test_few_lines_meet_the_bill_of_materials(spark, stored):
    t = stored
    query = ops.planned_material_need(
        t.order_headers, t.order_lines, t.products, t.bom, t.consumables, t.order_status, limit=10)
    plan = plan_of(query).split("== Physical Plan ==")[1]
    # the floor is in the scan of the lines, and once more over the largest dose of the product
    assert plan.count(">= Subquery") + plan.count(">= scalar-subquery") + plan.count(
        ">= ReusedSubquery") >= 2
    met = []
    real = materials._within_reach

    def seen(*args):
        met.append((args[0].count(), (found := real(*args)).count()))
        return found

    materials._within_reach = seen
    try:
        ops.planned_material_need(
            t.order_headers, t.order_lines, t.products, t.bom, t.consumables, t.order_status, limit=10)
    finally:
        materials._within_reach = real
    (all_lines, within), = met
    assert 10 <= within * 10 < all_lines


@pytest.mark.parametrize("name", [
    "machine_kpi_summary", "energy_alert_rollup", "mold_change_quality", "mold_change_kpi_summary",
    "material_totals"])
def test_totals_sort_nothing_over_all_tasks(spark, name):
    assert "rangepartitioning" not in plan_of(registry.queries()[name](spark, SMALL))


def test_order_of_whole_reports_is_up_to_the_caller(spark, stored):
    for operator, inputs in (
            (ops.machine_kpi, ("production_results",)), (ops.energy_alerts, ("energy_alerts",)),
            (ops.energy_alert_rollup, ("energy_alerts",)),
            (ops.mold_changes, ("production_results", "downtimes")),
            (ops.mold_change_kpi, ("production_results", "downtimes")),
            (ops.material_use_by_order, ("production_results", "bom", "consumables")),
            (ops.planned_material_need, ("order_headers", "order_lines", "products", "bom",
                                         "consumables", "order_status"))):
        inputs = [stored[name] for name in inputs]
        limit = {} if operator is ops.mold_change_kpi else {"limit": None}
        plain, sorted_ = (operator(*inputs, ordered=o, **limit) for o in (False, True))
        assert "rangepartitioning" not in plan_of(plain)
        assert "rangepartitioning" in plan_of(sorted_)
        assert sorted(rows(plain), key=str) == sorted(rows(sorted_), key=str)
        if limit:
            assert rows(operator(*inputs, limit=3, ordered=False)) == rows(operator(*inputs, limit=3))


def test_share_reads_the_facts_once(spark, stored):
    for limit in (3, None):
        df = ops.scrap_pareto(stored.scraps, stored.production_results, limit=limit)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("FileScan parquet") - final.count("ReusedExchange") <= 1, final


@pytest.mark.parametrize("zone", ["America/New_York", "Pacific/Apia"])
def test_session_zone_does_not_matter(spark, zone):
    names = ["mold_changes__all", "energy_alert_rollup", "energy_live", "operator_time__filtered",
             "material_daily_trend", "downtime_log"]

    def results():
        return {name: rows(registry.queries()[name](spark, SMALL)) for name in names}
    before = spark.conf.get("spark.sql.session.timeZone")
    expected = results()
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert results() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_minutes_across_a_clock_change(spark, table):
    runs = table(
        "production_results",
        {"machine_code": "M", "mold_code": "A", "shift_start": at("2024-03-09 22:00"),
         "shift_end": at("2024-03-10 01:30")},
        {"machine_code": "M", "mold_code": "B", "shift_start": at("2024-03-10 03:30"),
         "shift_end": at("2024-03-10 06:00")})
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert rows(ops.mold_changes(runs, table("downtimes")), "minutes") == [120]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("share", [False, True])
def test_reports(spark, stored, share):
    def first(df):
        return rows(df)[0]
    results = stored.production_results
    machines = reports.machine_report(stored, share=share)
    assert rows(machines["data"]) == rows(ops.machine_kpi(results))
    assert first(machines["summary"]) == first(ops.machine_kpi_summary(ops.machine_kpi(results)))
    assert ("ExistingRDD" in plan_of(machines["summary"])) == share
    few = reports.machine_report(stored, limit=2, share=share)
    assert few["data"].count() == 2 and rows(few["summary"]) == rows(machines["summary"])

    materials = reports.material_report(stored, planned_limit=None, orders_limit=None, share=share)
    assert set(materials) == {"summary", "planned_orders", "orders", "trend", "materials_summary"}
    by_order = rows(materials["orders"], "total_kg")
    assert first(materials["summary"].select("total_kg")) == (round(sum(by_order), 2),)
    needed = rows(materials["planned_orders"], "needed_kg")
    assert first(materials["summary"].select("needed_kg")) == (round(sum(needed), 2),)
    few = reports.material_report(stored, planned_limit=3, orders_limit=4, share=share)
    assert few["planned_orders"].count() == 3 and few["orders"].count() == 4
    assert rows(few["summary"]) == rows(materials["summary"])
    for name in ("trend", "materials_summary"):
        assert ("FileScan" in plan_of(materials[name]).split("ExistingRDD")[0]) or share
    cut = reports.material_report(stored, share=share)
    t = stored
    assert rows(cut["planned_orders"]) == rows(ops.planned_material_need(
        t.order_headers, t.order_lines, t.products, t.bom, t.consumables, t.order_status))

    changes = reports.mold_change_report(stored, limit=None, share=share)
    assert first(changes["quality"])[0] == changes["data"].count()
    kpi = reports.mold_change_kpi_report(stored, share=share)
    assert first(kpi["summary"])[0] == sum(rows(kpi["data"], "changes"))
    live = reports.live_power_report(stored)
    assert first(live["summary"])[3] == live["data"].count()
    assert {name: df.count() for name, df in reports.filter_options(
        stored, share=share).items()} == {
        "machines": 10, "shifts": 3, "workshops": 10, "articles": 200, "molds": 25}


@pytest.mark.parametrize("spec", [FilterSpec(), FilterSpec(molds=["click", "view"])])
def test_mold_changes_are_shared_by_all_their_results(spark, spec):
    runs, stops = bound(spark, SMALL, "production_runs"), bound(spark, SMALL, "downtimes")
    tables = Tables({"production_results": runs, "downtimes": stops}.__getitem__)
    expected = {
        "data": ops.mold_changes(runs, stops, spec),
        "quality": ops.mold_change_quality(ops.mold_changes(runs, stops, spec, None)),
        "kpi": ops.mold_change_kpi(runs, stops, spec),
        "summary": ops.mold_change_kpi_summary(ops.mold_change_kpi(runs, stops, spec)),
        "trend": ops.mold_change_trend(runs, stops, spec),
    }
    found = reports.mold_change_overview(tables, spec, share=True)
    assert set(found) == set(expected)
    for name, df in found.items():
        assert rows(df) == rows(expected[name]), name
        assert "FileScan" not in plan_of(df) and df.count() > 0


def test_shares_add_up_and_counts_agree(spark):
    queries = registry.queries()

    def column(name, column):
        return rows(queries[name](spark, SMALL), column)
    for name in ("downtime_pareto__shown", "downtime_pareto__all", "scrap_pareto__shown",
                 "scrap_pareto__all"):
        assert sum(column(name, "share_pct")) == pytest.approx(100, abs=0.3)
    changes = len(column("mold_changes__all", "minutes"))
    assert sum(column("mold_change_kpi", "changes")) == changes
    assert sum(column("mold_change_trend", "changes")) == changes
    assert column("mold_change_kpi_summary", "changes") == [changes]


def test_runs_are_shuffled_narrow_and_once_per_join(stored):
    """Use by order sums no runs before the bill of materials, and ships pieces and doses, not kilos."""
    plan = ops.material_use_by_order(
        stored.production_results, stored.bom, stored.consumables, limit=None,
    )._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan.split("RepartitionByExpression")
    assert len(dealt) == 2
    above, below = dealt
    assert "total_kg" in above and "_kg" not in below and "_doses" not in below
    assert "sum(qty_made" not in below


def test_sums_per_order_and_machine_start_from_the_dealt_runs(stored):
    """What totals sum of the use by order is shuffled no second time."""
    use = ops.material_use_by_order(
        stored.production_results, stored.bom, stored.consumables, limit=None, ordered=False)
    sums = use.groupBy("order_code", "machine_code").agg(F.sum("total_kg"), F.sum("pieces"))
    shuffles = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
                for df in (use, sums)]
    assert shuffles[0] == shuffles[1]


def test_product_texts_meet_the_bill_of_materials_only(stored):
    """Without a limit no line of an order is shuffled for the text of its product."""
    plan = ops.planned_material_need(
        stored.order_headers, stored.order_lines, stored.products, stored.bom, stored.consumables,
        stored.order_status, limit=None, ordered=False)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join LeftOuter, (product_code")
    assert "product_name" in below and "qty_planned" in above and "qty_planned" not in below


def test_repeated_and_missing_product_texts(table):
    """A product with two texts has each row twice, one without texts once, with a limit or not."""
    headers = table("order_headers", {"order_code": "O", "machine_code": "M", "status_code": "L"})
    lines = table("order_lines", *({"order_code": "O", "product_code": p, "bom_revision": 0, "qty_planned": 9}
                                   for p in "ABC"))
    products = table("products", {"product_code": "A", "product_name": "x"}, {"product_code": "A", "product_name": "y"},
                     {"product_code": "B"})
    bom = table("bom", *({"product_code": p, "bom_revision": 0, "material_code": m, "qty_per_piece": d}
                         for p, m, d in (("A", "m", 1.0), ("A", "n", 2.0), ("B", "m", 3.0), ("C", "n", 4.0))))
    rest = (bom, table("consumables", {"material_code": "m"}, {"material_code": "n"}), table("order_status"))
    found = [rows(ops.planned_material_need(headers, lines, products, *rest, limit=limit),
                  "product_code", "product_name", "material_code", "needed_kg") for limit in (None, 50)]
    assert found[0] == found[1] == [
        ("C", "C", "n", 36.0), ("B", "B", "m", 27.0), ("A", "x", "n", 18.0), ("A", "y", "n", 18.0),
        ("A", "x", "m", 9.0), ("A", "y", "m", 9.0)]
