"""Past and planned consumption of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presswork.filters import EVERYTHING, FilterSpec, not_blank
from presswork.functions import label_or_code, or_zero, round_to, share
from presswork.operators.orders import MISSING
from presswork.plans.distinct import counted
from presswork.plans.ranking import named_by, ranked

# Fixed values of the result: orders in these states still need material.
OPEN_STATES = ("L", "D", "P", "S")
# Fixed values of the result.
DEFAULT_UNIT = "KG"
OTHER_TYPE = "Ostatní"

_BOM_KEY = ["product_code", "bom_revision"]


def materials_list(consumables: DataFrame, types: DataFrame, bom: DataFrame) -> DataFrame:
    """Materials used by at least one bill of materials."""
    used = bom.select("material_code").distinct()
    return (
        consumables.join(used, "material_code", "left_semi")
        .join(types.select("type_code", "type_label"), "type_code", "left")
        .select(
            "material_code",
            label_or_code("material_name", "material_code").alias("material_name"),
            F.coalesce("unit", F.lit(DEFAULT_UNIT)).alias("unit"),
            F.coalesce("type_label", F.lit(OTHER_TYPE)).alias("type"),
        )
        .orderBy("material_code", "material_name", "unit", "type")
    )


def _texts(consumables: DataFrame) -> DataFrame:
    """Material texts, and how often each occurs: a repeated one repeats the rows it meets."""
    return consumables.groupBy("material_code", "material_name", "unit").agg(
        F.count(F.lit(1)).alias("_times"))


def _unit() -> Column:
    return F.coalesce("unit", F.lit(DEFAULT_UNIT)).alias("unit")


def _needed(dose: str, pieces: str = "remaining_pieces") -> Column:
    return round_to(F.col(dose) * F.col(pieces), 2)


def _within_reach(
    items: DataFrame, orders: DataFrame, doses: DataFrame, consumables: DataFrame, limit: int
) -> DataFrame:
    """The lines that can be among the ``limit`` largest needs, ties included.

    What is left of a line times the largest dose of its product is the most
    that any of its rows can need. The ``limit`` lines of open orders with most
    in that sense are worked out first; the need at place ``limit`` among their
    rows is a floor that no row of the result is below. Lines that cannot reach
    it with the largest dose of all fall in their scan, and those that cannot
    with the largest of their product before they meet the bill of materials.
    Where the first lines have fewer rows than ``limit``, all lines stay.
    """
    most = doses.groupBy(*_BOM_KEY).agg(F.max("_dose").alias("_most"))
    first = (
        items.select("order_code", *_BOM_KEY, "remaining_pieces")
        .join(orders.select("order_code"), "order_code", "left_semi")
        .join(most, _BOM_KEY)
        .orderBy(F.desc(_needed("_most"))).limit(limit)
    )
    best = (
        first.join(doses, _BOM_KEY)
        .join(consumables.select("material_code"), "material_code", "left_semi")
        .select(_needed("_dose").alias("kg")).orderBy(F.desc("kg")).limit(limit)
    )
    floor = best.agg(F.when(F.count("kg") == limit, F.min("kg"))).scalar()
    largest = doses.agg(F.max("_dose")).scalar()

    def reaches(kilos: Column) -> Column:
        return F.coalesce(kilos >= floor, floor.isNull())

    near = items.where(reaches(round_to(largest * F.col("remaining_pieces"), 2)))
    return near.join(most, _BOM_KEY).where(reaches(_needed("_most"))).select(items.columns)


def planned_material_need(
    headers: DataFrame, lines: DataFrame, products: DataFrame, bom: DataFrame,
    consumables: DataFrame, status: DataFrame, spec: FilterSpec = EVERYTHING,
    limit: int | None = 500, ordered: bool = True,
) -> DataFrame:
    """Material per line of an open order: planned, used and still needed; most needed first.

    With a limit only lines that can reach the result meet the bill of materials.
    Product and status texts are looked up for the rows shown only, and of the
    products only those that these rows name are read for it. Without a limit
    product texts join the bill of materials, which has far fewer rows than
    the lines that meet it.
    """
    orders = spec.apply(
        headers.where(F.col("status_code").isin(*OPEN_STATES) & not_blank("order_code")),
        machines="machine_code",
    ).select("order_code", "machine_code", "machine_name", "mold_code", "status_code")
    doses = spec.apply(bom, material="material_code").select(
        *_BOM_KEY, "material_code", F.col("qty_per_piece").alias("_dose"))

    planned, good = or_zero("qty_planned"), or_zero("qty_good")
    items = lines.where(not_blank("product_code")).select(
        "order_code", *_BOM_KEY,
        planned.alias("planned_pieces"), good.alias("good_pieces"),
        or_zero("qty_scrap").alias("scrap_pieces"),
        F.greatest(planned - good, F.lit(0)).alias("remaining_pieces"),
    )

    if limit is not None:
        items = _within_reach(items, orders, doses, consumables, limit)
    else:
        doses = doses.join(products.select("product_code", "product_name"), "product_code", "left")

    keys = ["order_code", "product_code", "material_code"]
    needs = (
        orders.join(items, "order_code")
        .join(doses, _BOM_KEY)
        .join(consumables.select("material_code", "material_name", "unit"), "material_code")
        .select(
            *keys, "planned_pieces", "good_pieces", "scrap_pieces", "remaining_pieces", "_dose",
            "machine_code", "machine_name", "mold_code", "status_code", "material_name", "unit",
            _needed("_dose").alias("needed_kg"), *["product_name"] * (limit is None),
        )
    )
    columns = [c for c in needs.columns if c != "product_name"]
    if limit is not None:
        needs = ranked(needs, F.desc("needed_kg"), limit=limit)
        products = named_by(products, needs, "product_code")
        needs = needs.join(products.select("product_code", "product_name"), "product_code", "left")
    named = (
        needs.join(status.select("status_code", "status_label"), "status_code", "left")
        .select(*columns, "product_name", "status_label")
    )
    return ranked(named, F.desc("needed_kg"), limit=limit, ordered=ordered).select(
        "order_code",
        F.coalesce("machine_code", F.lit(MISSING)).alias("machine_code"),
        label_or_code("machine_name", "machine_code").alias("machine_name"),
        F.coalesce("mold_code", F.lit(MISSING)).alias("mold_code"),
        "product_code", label_or_code("product_name", "product_code").alias("product_name"),
        "material_code", label_or_code("material_name", "material_code").alias("material_name"),
        _unit(), round_to(F.col("_dose"), 4).alias("dose"),
        "planned_pieces", "good_pieces", "scrap_pieces", "remaining_pieces",
        _needed("_dose", "planned_pieces").alias("planned_kg"),
        _needed("_dose", "good_pieces").alias("used_kg"),
        "needed_kg",
        "status_code", label_or_code("status_label", "status_code").alias("status"),
    )


def _runs(results: DataFrame, spec: FilterSpec) -> DataFrame:
    """The runs of orders and products, each with the columns of :func:`consumption_base` but the day."""
    return spec.apply(
        results.where(not_blank("order_code") & not_blank("product_code")),
        days="shift_start", shift="shift", workshop="workshop", machines="machine_code",
    ).select("order_code", "machine_code", "machine_name", "product_code", "product_name", "bom_revision",
             *(or_zero(f"qty_{kind}").alias(f"qty_{kind}") for kind in ("made", "good", "scrap")),
             F.lit(1).alias("_runs"),
             F.col("shift_start").alias("first_start"), F.col("shift_end").alias("last_end"))


def consumption_base(results: DataFrame, spec: FilterSpec = EVERYTHING) -> DataFrame:
    """Pieces per day, order, machine and product revision: what the consumption reports start from.

    What a run consumed is its pieces times a dose that depends on product,
    revision and material alone. So runs are summed before they meet the bill of
    materials, which multiplies only the sums.
    """
    return (
        spec.apply(
            results.where(not_blank("order_code") & not_blank("product_code")),
            days="shift_start", shift="shift", workshop="workshop", machines="machine_code")
        .groupBy("order_code", "machine_code", "machine_name", "product_code", "product_name",
                 "bom_revision", F.to_date("shift_start").alias("day"))
        .agg(*(F.sum(or_zero(f"qty_{kind}")).alias(f"qty_{kind}") for kind in ("made", "good", "scrap")),
             F.count(F.lit(1)).alias("_runs"),
             F.min("shift_start").alias("first_start"), F.max("shift_end").alias("last_end"))
    )


def _used(base: DataFrame, bom: DataFrame, spec: FilterSpec) -> DataFrame:
    """The sums of :func:`consumption_base`, once per material of the product.

    Both sides of the join come straight from a shuffle or a scan, so that a
    product with very many orders is split at run time where the join shuffles.
    """
    return base.join(spec.apply(bom, material="material_code"), _BOM_KEY)


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt to tasks by these columns, to two where a session has one: a single one counts as sorted."""
    alone = rows.sparkSession.conf.get("spark.sql.shuffle.partitions") == "1"
    return rows.repartition(2, *by) if alone else rows.repartition(*by)


def _spent_pieces() -> Column:
    """Pieces that consumed new material: scrap of a recyclable material does not."""
    return F.when(F.col("recyclable") == 0, F.col("qty_made")).otherwise(F.col("qty_good"))


def _kilos(pieces: Column) -> Column:
    return F.col("qty_per_piece") * pieces


def material_use_by_order(
    results: DataFrame, bom: DataFrame, consumables: DataFrame, spec: FilterSpec = EVERYTHING,
    limit: int | None = 500, base: DataFrame | None = None, ordered: bool = True,
) -> DataFrame:
    """Consumption per order, machine, product and material, most first unless not ``ordered``.

    Rows are summed before the material texts are joined, and not regrouped
    after it: the join on a frequent material can then be split at run time.
    Runs of one order, machine and product are few. So they meet the bill of
    materials as they are, and are dealt to the tasks that sum them as pieces and
    doses: sums of kilos in advance are no fewer rows, and wider ones. They are
    dealt by order and machine alone, so that sums of these need no shuffle.
    ``base`` is :func:`consumption_base` of the same results and filter, if it
    is at hand.
    """
    groups = ["order_code", "machine_code", "machine_name", "product_code", "product_name",
              "material_code"]
    made, good, scrap = map(F.col, ("qty_made", "qty_good", "qty_scrap"))
    dose = F.col("qty_per_piece")
    sums = {
        "pieces": made, "good_pieces": good, "scrap_pieces": scrap,
        "total_kg": _kilos(_spent_pieces()), "good_kg": _kilos(good), "scrap_kg": _kilos(scrap),
        "_doses": dose * F.col("_runs"), "_dosed": F.when(dose.isNotNull(), F.col("_runs")).otherwise(0),
    }
    use = (
        _dealt(_used(_runs(results, spec) if base is None else base, bom, spec), "order_code", "machine_code")
        .groupBy(*groups)
        .agg(*(F.sum(c).alias(name) for name, c in sums.items()),
             F.min("first_start").alias("first_start"), F.max("last_end").alias("last_end"))
        .where(F.col("pieces") > 0)
        .join(_texts(consumables), "material_code")
        .withColumns({name: F.col(name) * F.col("_times") for name in sums})
        .withColumns({name: round_to(F.col(name), 2) for name in ("total_kg", "good_kg", "scrap_kg")})
        .withColumn("dose", round_to(F.when(F.col("_dosed") > 0, F.col("_doses") / F.col("_dosed")), 4))
        .select(*groups, "material_name", "unit", "dose", "pieces", "good_pieces", "scrap_pieces",
                "total_kg", "good_kg", "scrap_kg", "first_start", "last_end")
    )
    return ranked(use, F.desc("total_kg"), limit=limit, ordered=ordered).select(
        "order_code", "machine_code",
        label_or_code("machine_name", "machine_code").alias("machine_name"),
        "product_code", label_or_code("product_name", "product_code").alias("product_name"),
        "material_code", label_or_code("material_name", "material_code").alias("material_name"),
        _unit(), "dose", "pieces", "good_pieces", "scrap_pieces", "total_kg", "good_kg", "scrap_kg",
        "first_start", "last_end",
    )


def material_daily_trend(
    results: DataFrame, bom: DataFrame, spec: FilterSpec = EVERYTHING,
    base: DataFrame | None = None,
) -> DataFrame:
    """Consumption, pieces and orders per day of the shift.

    Pieces count once per material of the product. Rows are summed per day and
    order first; orders are counted over those sums. ``base`` as in
    :func:`material_use_by_order`.
    """
    return (
        _used(consumption_base(results, spec) if base is None else base, bom, spec)
        .groupBy("day", "order_code")
        .agg(F.sum(_kilos(_spent_pieces())).alias("total_kg"), F.sum("qty_made").alias("pieces"))
        .groupBy("day")
        .agg(round_to(F.sum("total_kg"), 2).alias("total_kg"),
             F.sum("pieces").alias("pieces"), F.count("order_code").alias("orders"))
        .orderBy("day")
    )


def material_summary(
    results: DataFrame, bom: DataFrame, consumables: DataFrame, spec: FilterSpec = EVERYTHING,
    limit: int | None = 50, base: DataFrame | None = None,
) -> DataFrame:
    """Orders, machines and consumption per material, most first.

    A material may hold most of the rows; they are summed per order and
    machine before anything is gathered by material, and orders and machines
    are both counted over these sums. ``base`` as in
    :func:`material_use_by_order`.
    """
    per_order = (
        _used(consumption_base(results, spec) if base is None else base, bom, spec)
        .groupBy("material_code", "order_code", "machine_code")
        .agg(F.sum(_kilos(_spent_pieces())).alias("total_kg"),
             F.sum(_kilos(F.col("qty_scrap"))).alias("scrap_kg"))
    )
    materials = (
        counted(per_order, ["material_code"], {"order_code": "orders", "machine_code": "machines"},
                ["total_kg", "scrap_kg"])
        .join(_texts(consumables), "material_code")
        .select("material_code", "material_name", "unit", "orders", "machines",
                *(round_to(F.col(c) * F.col("_times"), 2).alias(c)
                  for c in ("total_kg", "scrap_kg")))
    )
    return ranked(materials, F.desc("total_kg"), limit=limit).select(
        "material_code", label_or_code("material_name", "material_code").alias("material_name"),
        _unit(), "orders", "machines", "total_kg", "scrap_kg")


def material_totals(planned: DataFrame, by_order: DataFrame) -> DataFrame:
    """One row over the rows of both reports: what is still needed and what was used.

    For the totals of all orders give it both reports without a limit, and not
    ordered. Rows are summed per order and machine once, and orders, machines
    and totals are taken from these sums. A missing code counts as one, but for
    the machines of open orders.
    """
    def sums(df: DataFrame, kilos: tuple[str, ...], pieces: str) -> DataFrame:
        per_order = df.groupBy("order_code", "machine_code").agg(
            *(F.sum(c).alias(c) for c in (*kilos, pieces)))
        return per_order.withColumns({
            # counted are values that are there
            "order_": F.struct("order_code"), "machine_": F.struct("machine_code"),
            "named": F.when(F.col("machine_code") != MISSING, F.col("machine_code"))})

    def totals(per_order: DataFrame, codes: dict[str, str], kilos: tuple[str, ...], pieces: str) -> DataFrame:
        return counted(per_order, [], codes, [*kilos, pieces]).withColumns(
            {c: round_to(or_zero(c), 2) for c in kilos} | {pieces: or_zero(pieces)})

    needed, used = ("needed_kg", "planned_kg", "used_kg"), ("total_kg", "good_kg", "scrap_kg")
    future = totals(sums(planned, needed, "remaining_pieces"),
                    {"order_": "open_orders", "named": "open_machines"}, needed, "remaining_pieces")
    past = totals(sums(by_order, used, "pieces"), {"order_": "orders", "machine_": "machines"}, used, "pieces")
    columns = [*needed, "remaining_pieces", "open_orders", "open_machines",
               *used, "pieces", "orders", "machines"]
    return (
        future.unionByName(past, allowMissingColumns=True)
        .agg(*(F.max(c).alias(c) for c in columns))
        .withColumn("scrap_share_pct", share(F.col("scrap_kg"), F.col("total_kg")))
    )
