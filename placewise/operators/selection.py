"""Choice of postcodes under a budget and a count limit, many scenarios at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewise.functions.flags import location_cost
from placewise.operators.common import order_bucket, running_best, skew_join
from placewise.session import checkpointed

LAMBDA_STEPS = 200
#: Fixed value: the share of the bound that a choice may miss before the search goes on.
MAX_GAP = 0.09
#: Ranked codes that one row of the list of blocks stands for.
BLOCK_CODES = 64
GROUP = ["type", "area_m2"]


def top_k_profit(candidates: DataFrame, budget: float, k: int) -> DataFrame:
    """Best k profitable codes that each fit the budget; exact selection for k = 1."""
    profit = F.col("revenue") - F.col("total_cost")
    return (
        candidates.select("postal_code", "revenue", "total_cost", profit.alias("profit"))
        .where((F.col("total_cost") <= budget) & (F.col("profit") > 0))
        .orderBy(F.desc("profit"), "postal_code")
        .limit(k)
    )


def selection_totals(selected: DataFrame) -> DataFrame:
    """Number, cost and profit of a selection; each cost rounded up as it is shown."""
    return selected.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.ceil("total_cost")), F.lit(0)).alias("total_cost"),
        F.coalesce(F.sum("profit"), F.lit(0.0)).alias("total_profit"),
    )


def totals_by_scenario(selected: DataFrame) -> DataFrame:
    """The same totals for each scenario of a selection."""
    return selected.groupBy("scenario_id").agg(
        F.count("*").alias("n"), F.sum(F.ceil("total_cost")).alias("total_cost"), F.sum("profit").alias("total_profit")
    )


def select_locations_exact_k2(candidates: DataFrame, budget: float) -> DataFrame:
    """The pair of codes with the largest joint profit whose costs fit together.

    No pair is formed.  Ordered by (cost, code), a later code's partner is the
    best earlier one among those its remaining budget covers, a running best.
    Of one cost only the two best codes can be in the pair: tasks keep no more
    before the shuffle, so none gets all codes of a cost.
    """
    items = candidates.select(
        F.col("total_cost").cast("double").alias("cost"),
        "postal_code",
        (F.col("revenue") - F.col("total_cost")).cast("double").alias("profit"),
    ).where(F.col("cost") <= budget)
    place = F.row_number().over(Window.partitionBy("cost").orderBy(F.desc("profit"), "postal_code"))
    items = checkpointed(items.withColumn("place", place).where(F.col("place") <= 2).drop("place"))
    offer = F.struct(F.col("profit"), F.col("postal_code"))
    left = F.lit(float(budget)) - F.col("cost")
    offers = items.select(
        F.col("cost").alias("at"), F.lit(0).alias("asks"), "postal_code", offer.alias("offer"),
        F.when(left >= F.col("cost"), offer).alias("mine"),
    )
    asks = items.where(left < F.col("cost")).select(
        left.alias("at"), F.lit(1).alias("asks"), "postal_code",
        F.lit(None).cast("struct<profit:double,postal_code:string>").alias("offer"), offer.alias("mine"),
    )
    met = running_best(offers.unionByName(asks), [], "at", ["asks", "postal_code"], "offer", "partner")
    pair = F.struct(
        (F.col("mine.profit") + F.col("partner.profit")).alias("profit"),
        F.least("mine.postal_code", "partner.postal_code").alias("pc_a"),
        F.greatest("mine.postal_code", "partner.postal_code").alias("pc_b"),
    )
    best = met.where(F.col("mine").isNotNull() & F.col("partner").isNotNull()).agg(
        F.min_by(pair, F.struct(-pair["profit"], pair["pc_a"], pair["pc_b"])).alias("p")
    )
    return best.where(F.col("p").isNotNull()).select("p.pc_a", "p.pc_b", "p.profit")


def _paths(items: DataFrame, max_k: int, n_lambda: int) -> DataFrame:
    """For each multiplier, the first max_k codes by profit - multiplier * cost, with running sums."""
    ratio = F.col("profit") / F.greatest(F.col("cost"), F.lit(1e-9))
    # Multipliers at even steps of the codes' ratios, from bucket counts: exact
    # counts and minima, so every evaluation of this plan gets the same grid.
    buckets = (
        items.select(*GROUP, ratio.alias("ratio"), order_bucket(ratio).alias("b"))
        .groupBy(*GROUP, "b")
        .agg(F.count("*").alias("n"), F.min("ratio").alias("lam"))
    )
    below = Window.partitionBy(*GROUP).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("n").over(below), F.lit(0)) / F.sum("n").over(Window.partitionBy(*GROUP))
    grid = (
        buckets.withColumn("step", F.floor(share * n_lambda))
        .groupBy(*GROUP, "step")
        .agg(F.min("lam").alias("lam"))
        .groupBy(*GROUP)
        .agg(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.sort_array(F.collect_set("lam")))).alias("grid"))
    )
    priced = (
        skew_join(items, grid, GROUP)
        .withColumn("lam", F.explode("grid"))
        .drop("grid")
        .withColumn("reduced", F.col("profit") - F.col("lam") * F.col("cost"))
        .where(F.col("reduced") > 0)
    )
    by_value = Window.partitionBy(*GROUP, "lam").orderBy(F.desc("reduced"), "postal_code")
    top = priced.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= max_k)
    upto = Window.partitionBy(*GROUP, "lam").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return top.withColumns(
        {
            "sum_cost": F.sum("cost").over(upto),
            "sum_profit": F.sum("profit").over(upto),
            "sum_reduced": F.sum("reduced").over(upto),
            "length": F.count("*").over(Window.partitionBy(*GROUP, "lam")),
        }
    )


def _latest(asks: DataFrame, offers: DataFrame, by: list[str]) -> DataFrame:
    """``asks`` (by, budget, ...) with ``offer``: the largest one of ``offers`` (by, at, offer) that costs no more.

    Budgets and costs are sorted into one stream, so no ask meets more than one offer.
    """
    rows = asks.select(*by, F.col("budget").alias("at"), F.lit(1).alias("asks"), F.struct(*asks.columns).alias("ask"))
    names = dict(offers.dtypes)
    events = rows.withColumn("offer", F.lit(None).cast(names["offer"])).unionByName(
        offers.select(*by, "at", F.lit(0).alias("asks"), F.lit(None).cast(dict(rows.dtypes)["ask"]).alias("ask"), "offer")
    )
    met = running_best(events, by, "at", ["asks"], "offer", "best")
    return met.where("asks = 1").select("ask.*", F.col("best").alias("offer"))


def _best_prefixes(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """Per scenario the best affordable prefix of any ranking, and the least bound with its multiplier.

    Scenario rows times multipliers is all that is ever made: the longest prefix
    a budget pays for comes from a merge of budgets and running costs, the one
    of ``k`` codes from an equi-join.
    """
    by = [*GROUP, "lam"]
    grid = paths.groupBy(*GROUP).agg(F.sort_array(F.collect_set("lam")).alias("grid"))
    asks = skew_join(asked, grid, GROUP).withColumn("lam", F.explode("grid")).drop("grid")
    prefix = F.struct(F.col("rank"), F.col("sum_profit"), F.col("sum_cost"))
    paid = _latest(asks, paths.select(*by, F.col("sum_cost").alias("at"), prefix.alias("offer")), by)
    counts = asked.select(*GROUP, "k").distinct()
    counted = (
        paths.join(counts, GROUP)
        .where(F.col("rank") == F.least("k", "length"))
        .select(*by, "k", "sum_reduced", prefix.alias("most"), F.when(F.col("rank") == F.col("k"), F.col("reduced")).otherwise(0.0).alias("edge"))
    )
    met = skew_join(paid, counted, [*by, "k"])
    fits = F.when(F.col("offer.rank") > F.col("k"), F.col("most")).otherwise(F.col("offer"))
    choice = F.when(
        F.col("offer").isNotNull(),
        F.struct(fits["sum_profit"].alias("profit"), (-fits["sum_cost"]).alias("c"), F.col("lam"), fits["rank"].alias("size")),
    )
    bound = F.struct((F.col("sum_reduced") + F.col("lam") * F.col("budget")).alias("bound"), F.col("lam"), F.col("edge"))
    return met.groupBy("scenario_id").agg(F.max(choice).alias("best"), F.min(bound).alias("top"))


def _core(asked: DataFrame, items: DataFrame, ahead: int) -> DataFrame:
    """Codes that may stand in a choice better than ``value``, per scenario of ``asked``, ranked by reduced profit.

    A code whose reduced profit is lower than that of the last one in the
    relaxed choice by as much as the gap can't make up for it.  Rankings are cut
    into blocks; a scenario first meets one row per block and then only codes
    of blocks that hold one it needs.  ``next`` lists what follows a code.
    """
    by = [*GROUP, "lam"]
    wanted = asked.withColumn("least", F.col("edge") - (F.col("ub") - F.col("value")) - F.lit(1e-9) * F.col("ub"))
    lowest = wanted.groupBy(*by).agg(F.min("least").alias("lowest"))
    priced = skew_join(items, lowest.groupBy(*GROUP).agg(F.collect_list(F.struct("lam", "lowest")).alias("wanted")), GROUP)
    priced = priced.select(*items.columns, F.explode("wanted").alias("w")).select(*items.columns, "w.lam", "w.lowest")
    priced = priced.withColumn("r", F.col("profit") - F.col("lam") * F.col("cost")).where(F.col("r") > F.col("lowest"))
    order = Window.partitionBy(*by).orderBy(F.desc("r"), "postal_code")
    ranked = checkpointed(
        priced.drop("lowest").withColumn("pos", F.row_number().over(order)).withColumn("block", F.floor((F.col("pos") - 1) / BLOCK_CODES))
    )
    heads = ranked.groupBy(*by, "block").agg(F.max("r").alias("head"))
    blocks = skew_join(wanted.select("scenario_id", *by, "least"), heads, by).where(F.col("head") > F.col("least")).drop("head")
    core = skew_join(blocks, ranked, [*by, "block"]).where((F.col("r") > F.col("least")))
    one = F.struct("pos", "r", "cost", "profit")
    follow = Window.partitionBy("scenario_id").orderBy("pos").rowsBetween(1, ahead)
    return core.select("scenario_id", "pos", "r", "postal_code", "revenue", "cost", "profit").withColumn("next", F.collect_list(one).over(follow))


def _children(nodes: DataFrame, core: DataFrame, limits: DataFrame, max_gap: float) -> DataFrame:
    """Every node with one more code, of a later place than all it has, where that may still beat ``value``.

    A node is a set of codes.  Its bound adds the best codes after its last one,
    as many as the count allows, at the multiplier's price for the budget left.
    ``filled`` is its set and whichever of the next codes can be paid, in order.
    """
    here = nodes.select("scenario_id", *[F.col(c).alias(f"n_{c}") for c in ("pos", "cost", "profit", "r", "picks")])
    step = (
        here.join(limits, "scenario_id")
        .join(core.select("scenario_id", "pos", "r", "cost", "profit", "next"), "scenario_id")
        .where((F.col("pos") > F.col("n_pos")) & (F.col("n_cost") + F.col("cost") <= F.col("budget")) & (F.size("n_picks") < F.col("k")))
    )
    room = F.col("k") - F.size("n_picks") - 1
    rest = F.aggregate(F.slice("next", F.lit(1), room), F.lit(0.0), lambda a, x: a + F.greatest(x["r"], F.lit(0.0)))
    step = step.withColumn("bound", F.col("lam") * F.col("budget") + F.col("n_r") + F.col("r") + rest)
    step = step.where(F.col("bound") * (1 - max_gap) > F.col("value") * (1 + 1e-12))
    picks = F.concat("n_picks", F.array("pos"))
    start = F.struct((F.col("n_cost") + F.col("cost")).alias("cost"), (F.col("n_profit") + F.col("profit")).alias("profit"), picks.alias("picks"))

    def fill(a, x):
        fits = (F.size(a["picks"]) < F.col("k")) & (a["cost"] + x["cost"] <= F.col("budget"))
        more = F.struct((a["cost"] + x["cost"]).alias("cost"), (a["profit"] + x["profit"]).alias("profit"), F.concat(a["picks"], F.array(x["pos"])).alias("picks"))
        return F.when(fits, more).otherwise(a)

    return step.select(
        "scenario_id",
        "pos",
        start["cost"].alias("cost"),
        start["profit"].alias("profit"),
        (F.col("n_r") + F.col("r")).alias("r"),
        start["picks"].alias("picks"),
        "bound",
        F.aggregate("next", start, fill).alias("filled"),
    )


def _searched(plan: DataFrame, core: DataFrame, max_k: int, max_gap: float) -> DataFrame:
    """(scenario_id, value, picks) of scenarios where branching found more than ``plan`` has.

    Round n holds the sets of n codes whose bound leaves room above the best
    value known; rounds end when there is none, at the latest after ``max_k``.
    """
    zero = F.lit(0.0)
    nodes = plan.select(
        "scenario_id", F.lit(0).alias("pos"), zero.alias("cost"), zero.alias("profit"), zero.alias("r"), F.array().cast("array<int>").alias("picks")
    )
    known = plan.select("scenario_id", "value", F.lit(None).cast("array<int>").alias("picks"))
    fixed = plan.select("scenario_id", "lam", "budget", "k")
    for _ in range(max_k):
        children = checkpointed(_children(nodes, core, fixed.join(known.drop("picks"), "scenario_id"), max_gap))
        if children.isEmpty():
            break
        found = children.groupBy("scenario_id").agg(F.max(F.struct("filled.profit", (-F.col("filled.cost")).alias("less"), "filled.picks")).alias("f"))
        better = F.coalesce(F.col("f.profit") > F.col("value"), F.lit(False))
        known = checkpointed(
            known.join(found, "scenario_id", "left").select(
                "scenario_id",
                F.when(better, F.col("f.profit")).otherwise(F.col("value")).alias("value"),
                F.when(better, F.col("f.picks")).otherwise(F.col("picks")).alias("picks"),
            )
        )
        left = children.join(known.select("scenario_id", "value"), "scenario_id")
        nodes = left.where(F.col("bound") * (1 - max_gap) > F.col("value") * (1 + 1e-12)).drop("bound", "filled", "value")
    return known.where("picks IS NOT NULL")


def select_locations(
    candidates: DataFrame, scenarios: DataFrame, n_lambda: int = LAMBDA_STEPS, max_gap: float = MAX_GAP
) -> DataFrame:
    """Affordable set of codes per scenario whose profit is proven to lie within ``max_gap`` of the best.

    candidates: postal_code, type, revenue, avg_price_m2.
    scenarios: scenario_id, type, budget, area_m2, k.
    Result: scenario_id, postal_code, revenue, total_cost, profit, and on every
    row the scenario's ``bound`` on any set's profit and its ``gap``, the share
    of the bound that the choice misses; 0 means the best set.  With ``max_gap``
    0 every choice is the best one.

    First Lagrangian relaxation: what a multiplier ranks first depends on type
    and floor area only, so rankings are made once for those, and scenarios look
    up the prefix their budget pays for.  The best single code that fits is
    found exactly.  Then branch and bound, one table of open sets for all
    scenarios whose gap is still too wide.
    """
    max_k = scenarios.agg(F.max("k")).first()[0] or 0
    wanted = scenarios.select(*GROUP).distinct()
    cost = location_cost(F.col("avg_price_m2").cast("double"), F.col("area_m2").cast("double"))
    # Read by the rankings, the single choices and the search: kept, not redone.
    items = checkpointed(
        candidates.join(wanted, "type")
        .select(*GROUP, "postal_code", F.col("revenue").cast("double").alias("revenue"), cost.alias("cost"))
        .withColumn("profit", F.col("revenue") - F.col("cost"))
        .where(F.col("profit") > 0)
    )
    paths = checkpointed(_paths(items, max_k, n_lambda))
    asked = scenarios.where("k >= 1").select("scenario_id", *GROUP, F.col("budget").cast("double").alias("budget"), "k")

    # Codes better than every cheaper one: where the best single fit must be.
    each_cost = items.groupBy(*GROUP, "cost").agg(
        F.min_by(F.struct("profit", "postal_code", "revenue"), F.struct(-F.col("profit"), "postal_code")).alias("one")
    )
    stairs = running_best(
        each_cost.select(*GROUP, "one.postal_code", "one.revenue", "cost", "one.profit", F.col("one.profit").alias("offer")),
        GROUP, "cost", ["postal_code"], "offer", "before",
    ).where(F.col("before").isNull() | (F.col("profit") > F.col("before")))
    single = F.struct("profit", "postal_code", "revenue", "cost")
    singles = _latest(asked, stairs.select(*GROUP, F.col("cost").alias("at"), single.alias("offer")), GROUP)
    plan = (
        singles.where("offer IS NOT NULL")
        .withColumnRenamed("offer", "single")
        .join(_best_prefixes(asked, paths), "scenario_id")
        .withColumn("alone", F.col("single.profit") > F.coalesce(F.col("best.profit"), F.lit(0.0)))
        .withColumn("value", F.greatest("single.profit", F.coalesce(F.col("best.profit"), F.lit(0.0))))
        .select("*", F.col("top.bound").alias("ub"), F.col("top.lam").alias("lam"), F.col("top.edge").alias("edge"))
        # The best single code is the best choice of one.
        .withColumn("open", (F.col("k") > 1) & (F.col("ub") * (1 - max_gap) > F.col("value") * (1 + 1e-12)))
    )
    plan = checkpointed(plan.drop("top"))
    unsure = plan.where("open")
    columns = ["scenario_id", "postal_code", "revenue", "cost", "profit"]
    if unsure.isEmpty():
        plan = plan.withColumn("searched", F.lit(False))
        from_search = None
    else:
        core = checkpointed(_core(unsure.select("scenario_id", *GROUP, "lam", "edge", "ub", "value"), items, 2 * max_k))
        sets = checkpointed(_searched(unsure, core, max_k, max_gap).withColumnRenamed("value", "found"))
        plan = plan.join(sets.select("scenario_id", "found"), "scenario_id", "left").withColumn("searched", F.col("found").isNotNull())
        plan = checkpointed(plan.withColumn("value", F.coalesce("found", "value")).drop("found"))
        members = sets.select("scenario_id", F.explode("picks").alias("pos"))
        from_search = members.join(core, ["scenario_id", "pos"]).select(columns)
    # Whatever branching left out is not above the value by more than the gap allowed.
    proven = F.when(F.col("k") == 1, F.col("value")).when(F.col("open"), F.least(F.col("ub"), F.col("value") / (1 - max_gap))).otherwise(F.col("ub"))
    verdict = plan.select("scenario_id", "value", F.greatest(proven, "value").alias("bound")).select(
        "scenario_id", "bound", ((F.col("bound") - F.col("value")) / F.col("bound")).alias("gap")
    )
    kept = plan.where("NOT searched")
    from_path = skew_join(
        kept.where("NOT alone").select("scenario_id", *GROUP, F.col("best.lam").alias("lam"), F.col("best.size").alias("size")),
        paths.select(*GROUP, "lam", "rank", "postal_code", "revenue", "cost", "profit"),
        [*GROUP, "lam"],
    ).where(F.col("rank") <= F.col("size"))
    chosen = from_path.select(columns).unionByName(kept.where("alone").select("scenario_id", "single.*").select(columns))
    if from_search is not None:
        chosen = chosen.unionByName(from_search)
    return chosen.join(verdict, "scenario_id").select(
        "scenario_id", "postal_code", "revenue", F.col("cost").alias("total_cost"), "profit", "bound", "gap"
    )
