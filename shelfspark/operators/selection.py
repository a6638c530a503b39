"""Choosing within quotas and budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions import rules as R
from shelfspark.functions import vocab as V
from shelfspark.functions.text import contains_any
from shelfspark.operators.keyed import exact_rank, first_per_key, top_per_key
from shelfspark.session import materialise


# --- first origin, longest label, latest copy --------------------------------------------------

def first_origin(rows: DataFrame, key, list_rank, position) -> DataFrame:
    """An item is credited to the first list containing it."""
    return first_per_key(rows, [key], [list_rank, position])


def longest_label(links: DataFrame, url, label) -> DataFrame:
    """Most explicit label per address."""
    best = F.max(F.struct(F.length(label).alias("n"), F.col(label).alias("label")))
    return links.groupBy(url).agg(best["label"].alias("label"))


def latest_copy(copies: DataFrame, key, entered, tie) -> DataFrame:
    """The copy entered last represents its title."""
    return top_per_key(copies, [key], [F.col(entered).desc_nulls_last(), tie], 1)


# --- rotation ---------------------------------------------------------------------------------

def list_family(name) -> Column:
    bare = F.lower(F.col(name) if isinstance(name, str) else name)
    return (F.when(contains_any(bare, V.YOUTH_LIST_WORDS), "youth")
            .when(contains_any(bare, V.PRIZE_LIST_WORDS), "prize").otherwise("other"))


def rotating_quota(lists: DataFrame, family, order, week: int, quotas: dict[str, int], total: int,
                   rest: str) -> DataFrame:
    """A window of each family, moving with the week and wrapping once.

    The window of a family of n lists starts at (week * size) mod n; when the
    size exceeds n a list appears twice, as in a list laid end to end twice.
    The ``rest`` family gets what the others leave of ``total``."""
    ranked = exact_rank(lists, [family], order, "place")
    sizes = lists.groupBy(family).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.coalesce(R.lookup(F.col(family), quotas), F.lit(0)).cast("bigint")
    sizes = sizes.withColumn("_q", wanted)
    # lists taken by the quota families (a window has at most 2n entries)
    taken = sizes.where(F.col(family) != rest).agg(
        F.coalesce(F.sum(F.least("_q", 2 * F.col("n"))), F.lit(0)).alias("_taken")).withColumn(
        family, F.lit(rest))
    left_over = taken.select(family, F.greatest(F.lit(total) - F.col("_taken"), F.lit(0)).alias("_left"))
    sizes = (sizes.join(F.broadcast(left_over), family, "left")
             .withColumn("size", F.coalesce("_left", "_q"))
             .withColumn("start", F.pmod(F.lit(week) * F.col("size"), F.col("n"))))
    twice = (ranked.join(sizes.select(family, "n", "size", "start"), family)
             .withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(1))))
             .withColumn("slot", F.col("place") - 1 + F.col("_turn") * F.col("n") - F.col("start")))
    return (twice.where((F.col("slot") >= 0) & (F.col("slot") < F.col("size")))
            .drop("_turn", "n", "size", "start", "place"))


# --- budget -------------------------------------------------------------------------------------

def acceptable(cands: DataFrame, price, origin, title, support) -> DataFrame:
    """Candidates with an acceptable price, title and support."""
    return cands.where(R.price_acceptable(price, origin) & ~R.title_excluded(title)
                       & ~R.support_excluded(support))


SLACK = 16          # rows listed of one slot in a round
LISTED = 20_000     # rows of a group listed in a round


def _fold(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Greedy pass over one group's listed rows in order (a task-local helper): the rows taken, and
    the row behind which rows that are not listed may be taken."""
    pdf = pdf.sort_values("_pos").reset_index(drop=True)
    left, floor = int(pdf["_left"].iloc[0]), int(pdf["_floor"].iloc[0])
    owned, filled_slots, steps = set(), set(), set()
    taken, stop = [], None
    listed = zip(pdf["_cents"], pdf["_more"], pdf["_end"], pdf["_slot"], pdf["_chain"], pdf["_step"], pdf["_ready"], *[pdf[k] for k in keys])
    for i, (cents, more, end, slot, chain, step, ready, *values) in enumerate(listed):
        if left <= floor:
            break
        mine = {(n, v) for n, v in enumerate(values) if v is not None}
        ready = ready or (chain, step - 1) in steps
        if cents <= left and not mine & owned and slot not in filled_slots and ready:
            taken.append(i)
            left -= int(cents)
            owned |= mine
            if slot is not None:
                filled_slots.add(slot)
            if chain is not None:
                steps.add((chain, step))
        if end or (more and ready and slot not in filled_slots):
            stop = i
            break
    told = pdf.assign(_taken=False, _open=False, _rest=left)
    told.loc[taken, "_taken"] = True
    if stop is not None and left > floor:
        told.loc[stop, "_open"] = True
    return told[told["_taken"] | told["_open"]]


def _shortlist(cands: DataFrame, group: str) -> DataFrame:
    """The rows a greedy pass without refusals can take: of each price the first floor(money left /
    price) ones.  Once an item of a price does not fit, no later one of that price does, so this loses
    nothing; its size depends on the budget and the prices, not on the number of candidates."""
    most = F.floor(F.col("_left") / F.col("_cents")).cast("int")
    fits = cands.where(F.col("_cents") <= F.col("_left"))
    kept = top_per_key(fits.withColumn("_most", most), [group, "_cents"], ["_at"], F.col("_most"))
    return kept.withColumn("_pos", F.row_number().over(Window.partitionBy(group).orderBy("_at"))).withColumns(
        {"_more": F.lit(False), "_end": F.lit(False)})


def _next_listed(cands: DataFrame, group: str) -> DataFrame:
    """The next rows of a pass with refusals, a fixed number for each group: of the rows of a slot that
    ask for the same step of a chain the first SLACK, and of what is left the first LISTED.  ``_more``
    and ``_end`` tell the rows behind which others follow that are not listed."""
    fits = cands.where(F.col("_cents") <= F.col("_left"))
    slotted = top_per_key(fits.where(F.col("_slot").isNotNull()), [group, "_slot", "_chain", "_step"], ["_at"], SLACK, rank="_nth")
    both = slotted.unionByName(fits.where(F.col("_slot").isNull()).withColumn("_nth", F.lit(0)))
    return (top_per_key(both, [group], ["_at"], LISTED, rank="_pos")
            .withColumn("_more", F.col("_nth") == SLACK).withColumn("_end", F.col("_pos") == LISTED).drop("_nth"))


def budget_select(cands: DataFrame, group: str, price: str, order, budget: float, keys=(), stop_share: float = 1.0,
                  slot: str | None = None, chain: str | None = None, step: str | None = None) -> DataFrame:
    """Greedy choice in order within each group's budget.

    An item is refused if it does not fit the money left or shares a key with an item taken
    before; the pass ends once ``stop_share`` of the budget is spent.  ``slot``: of the items of a
    slot only one is taken.  ``chain`` and ``step`` (1, 2, ...): an item of step n is refused unless
    one of step n - 1 of its chain was taken, so the first refusal ends the chain; the order must
    list the steps of a chain one behind the other.  NULL slots and chains bind nothing.

    Without refusals a shortlist bounded by the budget and the prices reaches the per-group fold (see
    ``_shortlist``).  With them the pass goes in rounds of a fixed number of rows (``_next_listed``):
    it stops at the first row behind which a row that is not listed could be taken, and goes on from
    there over all candidates, on what the taken items leave: without their keys and slots, without
    prices above the money left, and without chains whose next step has no item left."""
    cents = F.round(F.col(price) * 100).cast("bigint")
    whole = int(round(budget * 100))
    floor = whole - int(round(whole * stop_share))
    at = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    columns, keys = cands.columns, list(keys)
    none = F.lit(None).cast("string")
    work = (cands.withColumn("_cents", cents).where(F.col("_cents") > 0).withColumn("_at", at)
            .withColumn("_left", F.lit(whole).cast("bigint")).withColumn("_floor", F.lit(floor).cast("bigint"))
            .withColumn("_slot", F.col(slot).cast("string") if slot else none)
            .withColumn("_chain", F.col(chain).cast("string") if chain else none)
            .withColumn("_step", F.coalesce(F.col(step).cast("bigint"), F.lit(1)) if step else F.lit(1).cast("bigint"))
            .withColumn("_ready", F.col("_chain").isNull() | (F.col("_step") == 1)))
    inner = ["_cents", "_left", "_floor", "_more", "_end", "_slot", "_chain", "_step", "_ready"]

    def folded(listed):
        """The rows taken and those the pass stopped at, with ``_taken``, ``_open`` and ``_rest``."""
        slim = listed.select(group, F.col("_pos").cast("bigint").alias("_pos"), *inner, *keys)
        schema = T.StructType([*slim.schema.fields, T.StructField("_taken", T.BooleanType()),
                               T.StructField("_open", T.BooleanType()), T.StructField("_rest", T.LongType())])
        judged = slim.groupBy(group).applyInPandas(lambda pdf: _fold(pdf, keys), schema)
        return listed.join(judged.select(group, "_pos", "_taken", "_open", "_rest"), [group, "_pos"])

    if not (keys or slot or chain):
        return folded(_shortlist(work, group)).where("_taken").select(*columns)
    rows, out, taken = work, None, None
    while True:
        met = materialise(folded(materialise(_next_listed(rows, group), "listed")), "basket")
        certain = met.where("_taken")
        out = certain.select(*columns) if out is None else out.unionByName(certain.select(*columns))
        open_groups = met.where("_open").select(group, F.col("_at").alias("_from"), F.col("_rest").alias("_money"))
        if open_groups.isEmpty():
            return out
        binding = certain.select(group, "_slot", "_chain", "_step", *keys)
        taken = binding if taken is None else taken.unionByName(binding)
        rows = (work.join(open_groups, group).where(F.col("_at") > F.col("_from"))
                .withColumn("_left", F.col("_money")).drop("_from", "_money"))
        for k in [*keys, "_slot"]:
            # NULL keys never meet in an equi-join, as wanted
            rows = rows.join(taken.select(group, k).where(F.col(k).isNotNull()).distinct(), [group, k], "left_anti")
        if chain:
            rows = _open_chains(rows, taken, group)


def _open_chains(work: DataFrame, taken: DataFrame, group: str) -> DataFrame:
    """Rows of chains that may go on: the step behind the last one taken still has an item."""
    chained = work.where(F.col("_chain").isNotNull())
    reached = taken.where(F.col("_chain").isNotNull()).groupBy(group, "_chain").agg(F.max("_step").alias("_reached"))
    ahead = chained.groupBy(group, "_chain").agg(F.min("_step").alias("_ahead"))
    state = (ahead.join(reached, [group, "_chain"], "left").withColumn("_reached", F.coalesce("_reached", F.lit(0)))
             .where(F.col("_ahead") <= F.col("_reached") + 1).select(group, "_chain", "_reached"))
    going_on = (chained.join(state, [group, "_chain"])
                .withColumn("_ready", F.col("_step") <= F.col("_reached") + 1).drop("_reached"))
    return work.where(F.col("_chain").isNull()).unionByName(going_on)


def order_phases(phases: list[DataFrame]) -> DataFrame:
    """Candidates of successive phases under one order: phase, then its own."""
    out = None
    for i, df in enumerate(phases, 1):
        df = df.withColumn("phase", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
