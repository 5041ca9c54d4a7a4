"""Every registered query against its SQL, and known figures of the test tables."""

import pytest

import __spark_entry__ as registered
from checks import compare, oracle, registry
from checks.registry import HEADLINE
from conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SMALL)


def test_every_query_has_sql_and_every_operator_a_query():
    from presswork import operators
    assert set(registry.queries()) == set(oracle.statements())
    assert set(registry.queries()) <= set(registered.queries())
    assert set(oracle.statements()) <= set(registered.oracle_sql()) <= set(registered.queries())
    # a view of the skill matrix, registered with it
    assert set(HEADLINE) | {"iluo_pivot"} == set(operators.__all__)


@pytest.mark.parametrize("name", registry.queries())
def test_query_matches_sql(spark, duck, name):
    assert compare.difference(spark, duck, SMALL, name) is None


def test_entry(spark):
    assert registered.entry(spark).count() == 10


@pytest.mark.parametrize("name, figure, expected", [
    ("downtime_pareto__all", "count(*)", 20),
    ("downtime_pareto__all", "sum(stops)", 384),
    ("scrap_pareto__all", "count(*)", 42),
    ("scrap_pareto__all", "sum(pieces)", 5186),
    ("energy_alert_rollup", "sum(alerts)", 201),
    ("energy_alerts", "count_if(alert_end > alert_start)", 177),
    ("energy_live_summary", "max(machines)", 40),
    ("energy_live_summary", "max(active_machines)", 40),
    ("energy_stops__all", "count(*)", 363),
    ("iluo_matrix", "count_if(level = 'I')", 5),
    ("iluo_matrix", "count_if(level = 'L')", 17),
    ("iluo_matrix", "count_if(level = 'U')", 45),
    ("iluo_matrix", "count_if(level = 'O')", 8),
    ("sap_orders__all", "count_if(planned_pieces = 0)", 27),
    ("downtime_log__all", "count(*)", 400),
    ("downtime_log__all", "count(order_code)", 202),
    ("downtime_log__all", "count(reason)", 302),
    ("materials_list", "count(*)", 30),
    ("materials_list", "count_if(type = 'Resin')", 6),
    ("planned_material_need__all", "count(*)", 5675),
    ("planned_material_need__all", "sum(remaining_pieces)", 4283),
    ("material_use_by_order__all", "count(*)", 6833),
    ("mold_changes__all", "count(*)", 165),
    ("mold_changes__all", "count_if(time_source = 'PROSTOJ')", 80),
    ("mold_changes__all", "sum(minutes)", 37968),
])
def test_known_figure(spark, name, figure, expected):
    df = registered.queries()[name](spark, SMALL)
    assert df.selectExpr(figure).collect()[0][0] == expected
