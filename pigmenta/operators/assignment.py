"""Minimum-cost assignment of flavours to sheets by auction, and matching around locks.

The smaller side of a project bids for the larger one. A bidder only ever needs as many of its cheapest items as there are bidders: the
others hold fewer than that, so one of them is free. That keeps n * n of n * m pairs, which a ranked filter does before any
pair is sent to a project's task.

Costs are squared differences as whole millionths. Bidders without an item bid the price at which their second choice would be
as good, and a little more (the step); the highest bid takes the item. The step falls to one part in n + 1 of the smallest
difference of two totals, so the last result is the optimum of the rounded costs. Items that lost their bidder keep too high
a price; those then bid for bidders in the same way until none is left above the lowest price of a held item. Prices are
kept: with any prices, each bidder's least cost plus price, less the prices, is a lower bound of all assignments, so they prove the result
(``certify``).

A project of up to ``TASK_PAIRS`` kept pairs is auctioned in one task on arrays, larger ones in rounds over DataFrames in which no task
holds more than a bidder's pairs. Both follow the same steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pigmenta.operators.tables import checkpointed

#: Kept pairs of a project that are auctioned in one task (24 bytes each); beyond it rounds over DataFrames do the same.
TASK_PAIRS = 4_000_000
#: Projects or locks up to which these are broadcast.
BROADCAST_ROWS = 500_000
#: Whole units of cost to one of squared difference.
UNITS = 1_000_000
#: Division of the step from one pass to the next.
FALL = 6
ALTERNATES = 5
#: Difference beyond which a project's worst match is named.
WORST_SHOWN = 5.0

_NONE = np.iinfo(np.int64).min // 4


def _offers(cost: np.ndarray, other: np.ndarray, step: int, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of pairs (cost, weight of the other side): the best pair, its value, and the weight offered to it."""
    value = -cost - other
    rows = np.arange(len(cost))
    best = value.argmax(1)
    top = value[rows, best]
    value[rows, best] = _NONE
    second = value.max(1)
    return best, top, -cost[rows, best] - np.maximum(floor, np.where(second == _NONE, top, second) - step)


def auction(cost: np.ndarray, at: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray]:
    """Item of each bidder, and prices of the items, those that nobody holds at 0.

    cost: whole numbers, (bidders, k), times (bidders + 1); at: the item of each. Every set of bidders must reach as many items.
    """
    n = len(cost)
    held, owner, price = np.full(n, -1), np.full(items, -1), np.zeros(items, np.int64)
    place = np.argsort(at, axis=None, kind="stable")
    first = np.searchsorted(at.ravel()[place], np.arange(items + 1))
    step = max(1, int(cost.max(initial=0)) // FALL)
    while True:
        held[:], owner[:] = -1, -1
        while len(free := np.flatnonzero(held < 0)):
            best, _, bid = _offers(cost[free], price[at[free]], step, _NONE)
            item = at[free, best]
            order = np.lexsort((free, -bid, item))  # of equal bids the first bidder's
            order = order[np.concatenate(([True], item[order][1:] != item[order][:-1]))]
            won, by = item[order], free[order]
            lost = owner[won]
            held[lost[lost >= 0]] = -1
            held[by], owner[won], price[won] = won, by, bid[order]
        floor = int(price[held].min())
        profit = -cost[np.arange(n), (at == held[:, None]).argmax(1)] - price[held]
        todo = np.flatnonzero((owner < 0) & (price > floor)).tolist()
        while todo:
            j = todo.pop()
            pairs = place[first[j] : first[j + 1]]
            rows = pairs // at.shape[1]
            best, top, gain = _offers(cost.ravel()[pairs][None], profit[rows][None], step, floor)
            if top[0] <= floor + step:
                price[j] = floor
                continue
            i, old = int(rows[best[0]]), int(held[rows[best[0]]])
            price[j] = -int(cost.ravel()[pairs[best[0]]]) - int(gain[0])
            owner[old], owner[j], held[i], profit[i] = -1, i, j, gain[0]
            if price[old] > floor:
                todo.append(old)
        price = np.maximum(price - floor, 0)
        if step == 1:
            return held, price
        step = max(1, step // FALL)


def _kept(costs: DataFrame) -> DataFrame:
    """Pairs (project, bidder side ``by_paper``, bidder, item, cost) that an optimum needs; flavours bid where there are no more of them than sheets."""
    pairs = costs.groupBy("project", "flavor", "paper").agg(F.min("delta_e").alias("delta_e")).where("delta_e IS NOT NULL")
    sides = checkpointed(pairs.groupBy("project").agg(F.countDistinct("flavor").alias("flavors"), F.countDistinct("paper").alias("papers")))
    projects, most = sides.agg(F.count("*"), F.max(F.least("flavors", "papers"))).first()
    joined = pairs.join(F.broadcast(sides) if projects <= BROADCAST_ROWS else sides, "project").withColumn("by_paper", F.col("flavors") > F.col("papers")).withColumn("n", F.least("flavors", "papers"))
    flavor, paper = F.struct("flavor", F.lit(None).cast("long").alias("paper")), F.struct(F.lit(None).cast("string").alias("flavor"), "paper")
    sided = joined.select("project", "by_paper", "n", F.when(F.col("by_paper"), paper).otherwise(flavor).alias("bidder"), F.when(F.col("by_paper"), flavor).otherwise(paper).alias("item"), F.round(F.col("delta_e") * F.col("delta_e") * UNITS).cast("long").alias("cost"), "delta_e")
    nearest = Window.partitionBy("project", "bidder").orderBy("cost", "item")
    # The plain number lets Spark drop a task's pairs before the shuffle; else all pairs of a bidder would meet in one task.
    return sided.withColumn("place", F.row_number().over(nearest)).where((F.col("place") <= (most or 0)) & (F.col("place") <= F.col("n"))).drop("place")


ASSIGNED = "project long, flavor string, paper long, delta_e double, flavor_price double, paper_price double"


def _in_tasks(kept: DataFrame) -> DataFrame:
    """(project, bidder, item, price) of the items that are held, one project to a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        bidders, row = np.unique(pdf["b"].to_numpy(object), return_inverse=True)
        items, col = np.unique(pdf["i"].to_numpy(object), return_inverse=True)
        order = np.argsort(row, kind="stable")
        k = len(pdf) // len(bidders)
        cost = pdf["cost"].to_numpy(np.int64)[order].reshape(len(bidders), k) * (len(bidders) + 1)
        held, price = auction(cost, col[order].reshape(len(bidders), k), len(items))
        return pd.DataFrame({"project": pdf["project"].iloc[0], "b": bidders, "i": items[held], "price": price[held] / (UNITS * (len(bidders) + 1))})

    text = kept.select("project", F.to_json("bidder").alias("b"), F.to_json("item").alias("i"), "cost")
    return text.groupBy("project").applyInPandas(one, "project long, b string, i string, price double")


def _round(cells: DataFrame, who: str, other: str, weights: DataFrame, step: str, floor: str) -> DataFrame:
    """Best pair of each ``who`` in ``cells`` with its value ``top`` and the weight ``offer`` for the other side, the highest offer to each of these alone."""
    value = cells.join(weights, ["project", other]).withColumn("value", -F.col("cost") - F.col("weight"))
    ranked = value.withColumn("place", F.row_number().over(Window.partitionBy("project", who).orderBy(F.desc("value"), other))).where("place <= 2")
    two = ranked.groupBy("project", who).agg(F.min_by(other, "place").alias(other), F.min_by("cost", "place").alias("cost"), F.max("value").alias("top"), F.max_by("value", "place").alias("second"), F.first("step").alias("step"), F.first("floor").alias("floor"))
    return two.withColumn("offer", -F.col("cost") - F.greatest(F.expr(floor), F.col("second") - F.expr(step)))


def in_rounds(kept: DataFrame) -> DataFrame:
    """As ``_in_tasks``, in rounds over DataFrames: all free bidders of all projects bid at once; a round ends in a checkpoint of the items' prices."""
    wide = kept.select("project", F.to_json("bidder").alias("b"), F.to_json("item").alias("i"), (F.col("cost") * (F.col("n") + 1)).alias("cost"), "n")
    cells = checkpointed(wide)
    sizes = cells.groupBy("project").agg(F.greatest(F.lit(1), F.floor(F.max("cost") / FALL)).cast("long").alias("top_step"), F.max("n").alias("n"))
    sizes = checkpointed(sizes)
    bidders = checkpointed(cells.select("project", "b").distinct())
    state = checkpointed(cells.select("project", "i").distinct().select("project", "i", F.lit(0).cast("long").alias("price"), F.lit(None).cast("string").alias("b")))
    passes, most = 0, sizes.agg(F.max("top_step")).first()[0] or 1
    nobody, cells = F.lit(None).cast("string"), cells.drop("n")
    while True:
        steps = sizes.select("project", F.greatest(F.lit(1), F.floor(F.col("top_step") / FALL**passes)).cast("long").alias("step"), F.lit(_NONE).alias("floor"))
        while True:
            free = bidders.join(state.where("b IS NOT NULL"), ["project", "b"], "left_anti").join(steps, "project")
            offers = _round(cells.join(free, ["project", "b"]), "b", "i", state.select("project", "i", F.col("price").alias("weight")), "step", "floor")
            won = checkpointed(offers.groupBy("project", "i").agg(F.max("offer").alias("price"), F.max_by("b", F.struct("offer", "b")).alias("b")))
            if won.isEmpty():
                break
            state = checkpointed(state.join(won, ["project", "i"], "left_anti").select("project", "i", "price", "b").unionByName(won))
        floors = checkpointed(state.where("b IS NOT NULL").groupBy("project").agg(F.min("price").alias("floor")).join(steps.select("project", "step"), "project"))
        while True:
            todo = state.where("b IS NULL").join(floors, "project").where("price > floor").select("project", "i", "floor", "step")
            profit = state.where("b IS NOT NULL").join(cells, ["project", "b", "i"]).select("project", "b", (-F.col("cost") - F.col("price")).alias("weight"))
            offers = checkpointed(_round(cells.join(todo, ["project", "i"]), "i", "b", profit, "step", "floor"))
            if offers.isEmpty():
                break
            tired = offers.where("top <= floor + step").select("project", "i", F.col("floor").alias("price"), nobody.alias("b"))
            chosen = offers.where("top > floor + step").groupBy("project", "b").agg(F.max_by(F.struct("i", (-F.col("cost") - F.col("offer")).alias("price")), F.struct("offer", "i")).alias("of"))
            eager = chosen.select("project", "of.i", "of.price", "b")
            rest = state.join(tired.unionByName(eager), ["project", "i"], "left_anti").join(eager.select("project", "b", F.lit(True).alias("gone")), ["project", "b"], "left")
            state = checkpointed(rest.select("project", "i", "price", F.when(F.col("gone").isNull(), F.col("b")).alias("b")).unionByName(tired).unionByName(eager))
        last = most // FALL**passes <= 1
        state = checkpointed(state.join(floors, "project").select("project", "i", F.greatest(F.col("price") - F.col("floor"), F.lit(0)).alias("price"), (F.col("b") if last else nobody).alias("b")))
        if last:
            break
        passes += 1
    out = state.where("b IS NOT NULL").join(sizes, "project")
    return out.select("project", "b", "i", (F.col("price") / (UNITS * (F.col("n") + 1))).alias("price"))


def assign_projects(costs: DataFrame, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(project, flavor, paper, delta_e), all pairs of a project, to each flavour's sheet at least total squared difference (see ``ASSIGNED``).

    A flavour for which no sheet is left has a null ``paper``. Of a repeated pair the least difference counts; pairs with a null
    difference don't count. Flavours or sheets that nobody bids for have the price 0; of several optima any one is returned.
    """
    kept = checkpointed(_kept(costs))
    large = kept.groupBy("project").agg(F.count("*").alias("pairs")).where(F.col("pairs") > task_pairs).select("project")
    large = checkpointed(large)
    found = _in_tasks(kept.join(large, "project", "left_anti"))
    if not large.isEmpty():
        found = found.unionByName(in_rounds(kept.join(large, "project", "left_semi")))
    at = found.join(kept.select("project", "by_paper", "bidder", "item", "delta_e", F.to_json("bidder").alias("b"), F.to_json("item").alias("i")), ["project", "b", "i"])
    zero = F.lit(0.0)
    pairs = at.select("project", F.coalesce("bidder.flavor", "item.flavor").alias("flavor"), F.coalesce("bidder.paper", "item.paper").alias("paper"), "delta_e", F.when(F.col("by_paper"), F.col("price")).otherwise(zero).alias("flavor_price"), F.when(F.col("by_paper"), zero).otherwise(F.col("price")).alias("paper_price"))
    flavors = costs.select("project", "flavor").distinct()
    out = flavors.join(pairs, ["project", "flavor"], "left")
    return out.select("project", "flavor", "paper", "delta_e", F.coalesce("flavor_price", zero).alias("flavor_price"), F.coalesce("paper_price", zero).alias("paper_price"))


def certify(costs: DataFrame, assigned: DataFrame) -> DataFrame:
    """A row for each project: matched pairs, their total squared difference, and the lower bound that the prices prove over all pairs."""
    pairs = costs.groupBy("project", "flavor", "paper").agg(F.min("delta_e").alias("delta_e"))
    priced = pairs.join(assigned.select("project", "flavor", "flavor_price"), ["project", "flavor"]).join(assigned.where("paper IS NOT NULL").select("project", "paper", "paper_price"), ["project", "paper"], "left")
    reduced = priced.select("project", "flavor", "paper", (F.col("delta_e") * F.col("delta_e") + F.col("flavor_price") + F.coalesce("paper_price", F.lit(0.0))).alias("r"))
    sides = pairs.groupBy("project").agg(F.countDistinct("flavor").alias("flavors"), F.countDistinct("paper").alias("papers"))
    least = lambda who: reduced.groupBy("project", who).agg(F.min("r").alias("r")).groupBy("project").agg(F.sum("r").alias(f"by_{who}"))
    held = assigned.groupBy("project").agg(F.count("paper").alias("matched"), F.countDistinct("paper").alias("sheets"), F.sum(F.col("delta_e") * F.col("delta_e")).alias("total"), F.sum(F.col("flavor_price") + F.col("paper_price")).alias("prices"))
    joined = sides.join(least("flavor"), "project").join(least("paper"), "project").join(held, "project")
    bound = F.when(F.col("flavors") > F.col("papers"), F.col("by_paper")).otherwise(F.col("by_flavor")) - F.col("prices")
    return joined.select("project", "flavors", "papers", "matched", "sheets", "total", bound.alias("bound"))


def _worst() -> Column:
    return F.min_by("flavor", F.when(F.col("delta_e").isNotNull(), F.struct(-F.col("delta_e"), "flavor")))


def summarise_projects(matched: DataFrame, available: DataFrame, shown: float = WORST_SHOWN) -> DataFrame:
    """A row for each project of (project, flavor, paper, delta_e) and (project, available), the number of its sheets: flavours, matched, mean difference, worst match, spare sheets.

    The mean of nothing is 0. The worst match is named only beyond ``shown``; of equally bad ones the first by name.
    """
    worst = _worst()
    bad = F.max("delta_e") > shown
    found = matched.groupBy("project").agg(F.count("*").alias("flavors"), F.count("paper").alias("matched"), F.round(F.coalesce(F.avg("delta_e"), F.lit(0.0)), 6).alias("mean_delta_e"), F.when(bad, worst).alias("worst"), F.when(bad, F.round(F.max("delta_e"), 6)).alias("worst_delta_e"))
    spare = F.greatest(F.coalesce("available", F.lit(0)) - F.col("matched"), F.lit(0)).cast("long")
    return found.join(available, "project", "left").select("*", spare.alias("spare")).drop("available")


def summarise(matched: DataFrame, available: DataFrame) -> DataFrame:
    """One row over (flavor, paper, delta_e), with the one row of ``available`` sheets: flavours, matched, mean and worst difference, spare sheets.

    The mean of nothing is 0. Of equally bad flavours the first by name is the worst.
    """
    found = matched.agg(F.count("*").alias("flavors"), F.count("paper").alias("matched"), F.round(F.coalesce(F.avg("delta_e"), F.lit(0.0)), 6).alias("mean_delta_e"), _worst().alias("worst"), F.round(F.max("delta_e"), 6).alias("worst_delta_e"))
    return found.crossJoin(available).select("*", F.greatest(F.col("available") - F.col("matched"), F.lit(0)).alias("spare")).drop("available")


def match_projects(flavors: DataFrame | None, costs: DataFrame, locks: DataFrame) -> DataFrame:
    """A row for each flavour: project, ord, flavor, paper and delta_e (null without a sheet), locked, and the closest sheets as alternates.

    flavors: project, ord (place in the input), flavor, label; None if ``costs`` has these columns and every flavour a pair. costs: project, flavor, paper, available, delta_e, for all pairs. locks: project, flavor,
    paper; those of unknown flavours or sheets are ignored. Locked pairs stay as they are; the other flavours are assigned the
    available sheets that no lock holds. Alternates are the ``ALTERNATES`` nearest available or locked sheets, of equally near ones the
    smaller id; taken_by is the label of the flavour that holds one, null if that is the own label. If locks give several flavours one
    sheet, the last of them in input order counts as its holder.
    """
    costs = checkpointed(costs)
    flavors = costs.select("project", "ord", "flavor", "label").distinct() if flavors is None else flavors
    pair = ["project", "flavor", "paper"]
    wanted = checkpointed(locks.select(*pair).distinct())
    small = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda df: df  # so the pairs of all projects stay where they were made
    locked = costs.join(small(wanted), pair, "left_semi").select(*pair, "delta_e")
    locked = checkpointed(locked.join(flavors, ["project", "flavor"], "left_semi"))
    held = locked.select("project", "paper").distinct()
    free = costs.where("available").join(small(locked.select("project", "flavor").distinct()), ["project", "flavor"], "left_anti").join(small(held), ["project", "paper"], "left_anti")
    solved = assign_projects(free.select(*pair, "delta_e")).where("paper IS NOT NULL").select(*pair, "delta_e")
    chosen = checkpointed(locked.withColumn("locked", F.lit(True)).unionByName(solved.withColumn("locked", F.lit(False))))
    owners = chosen.join(flavors, ["project", "flavor"]).groupBy("project", "paper").agg(F.max_by("label", "ord").alias("holder"))
    sheets = costs.join(small(held.withColumn("held", F.lit(True))), ["project", "paper"], "left").where("available OR held")
    nearest = Window.partitionBy("project", "flavor").orderBy("delta_e", "paper")
    near = sheets.select(*pair, "delta_e", F.row_number().over(nearest).alias("place")).where(F.col("place") <= ALTERNATES)
    near = near.join(owners, ["project", "paper"], "left").join(flavors, ["project", "flavor"])
    taken = F.when(F.col("holder") != F.col("label"), F.col("holder")).alias("taken_by")
    alternates = near.groupBy("project", "flavor").agg(F.array_sort(F.collect_list(F.struct("place", "paper", "delta_e", taken))).alias("alternates"))
    out = flavors.join(chosen, ["project", "flavor"], "left").join(alternates, ["project", "flavor"], "left")
    return out.select("project", "ord", "flavor", "label", "paper", "delta_e", F.coalesce("locked", F.lit(False)).alias("locked"), F.coalesce("alternates", F.array()).alias("alternates"))
