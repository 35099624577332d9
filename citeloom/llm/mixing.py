"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each source gets a target number of words. Document rates r in (0, most) are those closest in (bounded) entropy to
the neutral rate most / 2 under the constraint that a source's expected words sum to its target. The convex dual has
one multiplier per constraint, and its solution is an exponential tilt, r = most / (1 + exp(-lambda x)), with x the
document's size in units of its source's mean. Newton steps with a bracket solve for all multipliers at once: each
step is one aggregation over the table of distinct (source, size) pairs, which is all that the dual depends on.
Rates are then rounded into whole copies by a hash of each row, whose threshold is shifted per source so that the rounded
words meet the target as closely as whole documents allow.

Defined results: null text has size 0, null is a source of its own (sorted last), rows that repeat in id and text move
together, a source without words has target 0, an empty table gives no rows, other columns are passed on by
``with_copies`` and ignored by ``mix_sources``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import Scratch

WORD = r"[^\\x20\\x09-\\x0D]+"
#: Per-source tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Bins of each pass that narrows the rounding threshold, and passes; together finer than the hash.
BINS, PASSES = 4096, 3


def word_count(text: str) -> Column:
    return F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')"), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source: source, source_size, target. ``sizes`` has one row per source.

    Filling to a common level per weight, with a ceiling of ``most`` times the size, is what repeated resharing of the
    excess arrives at; the level is found by one ordered pass over the sources: their code point order gives the weights, so this table of
    three columns is sorted in one task, however many sources there are.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_w", F.element_at(listed, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("_before", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_at", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("_before")) / F.col("_rest"))
        .withColumn("_level", F.min(F.when(F.col("_ratio") > F.col("_at"), F.struct("_ratio", "_at"))).over(everything)["_at"])
    )
    return ranked.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def _rate(most: float) -> Column:
    z = F.col("lam") * F.col("size") / F.col("scale")
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.lit(float(most)) / (F.lit(1.0) + F.exp(-z)))


def _in_one(per_source: DataFrame, few: bool) -> DataFrame:
    """A per-source table in one file while it is small."""
    return per_source.coalesce(1) if few else per_source


def _joined(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    right = per_source.withColumnRenamed("source", "_source")
    right = F.broadcast(right) if few else right
    return rows.join(right, rows["source"].eqNullSafe(right["_source"])).drop("_source")


def solve_rates(scratch: Scratch, pairs: DataFrame, wanted: DataFrame, most: float, few: bool, steps: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """Multipliers of the dual, one per source: Newton steps kept inside a bracket that halves when a step leaves it."""
    moment = pairs.groupBy("source").agg(F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size")).cast("double"), F.sum(F.col("n") * F.col("size"))).alias("scale"))
    state = _joined(wanted, moment, few).select(
        "source",
        "source_size",
        "target",
        F.coalesce("scale", F.lit(1.0)).alias("scale"),
        ((F.col("target") >= most * F.col("source_size")) | (F.col("source_size") == 0)).alias("full"),
        F.lit(0.0).alias("lam"),
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        F.lit(None).cast("double").alias("gap"),
    )
    state = scratch.keep(_in_one(state, few), "dual")
    r = F.col("r")
    for _ in range(steps):
        rated = _joined(pairs, state, few).withColumn("r", _rate(most)).withColumn("tokens", F.col("n") * F.col("size"))
        sums = rated.groupBy("source").agg(
            F.sum(F.col("tokens") * r).alias("_sum"),
            F.sum(F.col("tokens") * (F.col("size") / F.col("scale")) * r * (F.lit(1.0) - r / F.lit(float(most)))).alias("_slope"),
        )
        at = _joined(state, sums, few).withColumn("_error", F.col("_sum") - F.col("target"))
        at = (
            at.withColumn("gap", F.when(F.col("full"), 0.0).otherwise(F.abs("_error") / F.greatest("target", F.lit(1.0))))
            .withColumn("lo", F.when(F.col("_error") < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(F.col("_error") > 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("_newton", F.col("lam") - F.try_divide("_error", "_slope"))
        )
        halved = (
            F.when(F.col("lo").isNull(), 2 * F.col("hi") - 1)
            .when(F.col("hi").isNull(), 2 * F.col("lo") + 1)
            .otherwise((F.col("lo") + F.col("hi")) / 2)
        )
        inside = (
            F.col("_newton").isNotNull()
            & ~F.isnan("_newton")
            & (F.abs("_newton") < 1e6)
            & (F.col("lo").isNull() | (F.col("_newton") > F.col("lo")))
            & (F.col("hi").isNull() | (F.col("_newton") < F.col("hi")))
        )
        step = F.when(F.col("full") | (F.col("gap") <= tolerance), F.col("lam")).when(inside, F.col("_newton")).otherwise(halved)
        before, state = state, scratch.keep(_in_one(at.withColumn("lam", step).select(state.columns), few), "dual")
        scratch.drop(before)
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= tolerance:
            break
    # sums of doubles depend on the order of tasks; what follows must not
    return state.withColumn("lam", F.round("lam", 9))


def _threshold(scratch: Scratch, rows: DataFrame, solved: DataFrame, most: float, few: bool) -> DataFrame:
    """``shift`` per source that brings its rows' words nearest to ``aim``: copies are floor(rate + hash + shift) within 0..most.

    A row reaches its c-th copy where the shift passes c - rate - hash, so the shift wanted is the quantile, weighted
    by words, of these points at the target. It is narrowed by histograms of BINS cells, PASSES times.
    """
    top = int(most)
    low, width = -float(top), 2.0 * top / BINS
    state = solved.withColumn("low", F.lit(low)).withColumn("below", F.lit(0.0))
    rated = _joined(rows.where("size > 0"), solved, few).withColumn("at", _rate(most) + F.col("u"))
    steps = rated.select("source", "size", F.explode(F.sequence(F.lit(1), F.lit(top))).alias("c"), "at").select(
        F.col("source"), F.col("size"), (F.col("c") - F.col("at")).alias("point")
    )
    for _ in range(PASSES):
        place = F.floor((F.col("point") - F.col("low")) / width)
        counted = _joined(steps, state.select("source", "low"), few).withColumn("bin", place).where((F.col("bin") >= 0) & (F.col("bin") < BINS))
        counted = counted.groupBy("source", "bin").agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bin")
        cells = _joined(counted, state.select("source", "below", "aim"), few).withColumn("sum", F.col("below") + F.sum("words").over(running))
        chosen = (
            cells.where(F.col("sum") >= F.col("aim"))
            .groupBy("source")
            .agg(F.min(F.struct("bin", "sum", "words")).alias("cell"))
            .select("source", F.col("cell.bin").alias("_bin"), F.col("cell.sum").alias("_sum"), F.col("cell.words").alias("_words"))
        )
        right = chosen.withColumnRenamed("source", "_source")
        state = state.drop("_sum", "_words").join(F.broadcast(right) if few else right, state["source"].eqNullSafe(right["_source"]), "left").drop("_source")
        state = (
            state.withColumn("low", F.coalesce(F.col("low") + F.col("_bin") * width, F.col("low") + BINS * width))
            .withColumn("below", F.coalesce(F.col("_sum") - F.col("_words"), F.col("below")))
            .drop("_bin")
        )
        state = scratch.keep(_in_one(state, few), "threshold")
        width /= BINS
    # the last cell holds one document's step or equal ones: take it or not, whichever is nearer
    after = F.col("_sum").isNotNull() & (F.abs(F.col("_sum") - F.col("aim")) <= F.abs(F.col("below") - F.col("aim")))
    shift = F.when(F.col("full"), 0.0).when(after, F.col("low") + width * BINS).otherwise(F.col("low"))
    return state.select("source", shift.alias("shift"))


def _round(scratch: Scratch, rows: DataFrame, solved: DataFrame, most: float, few: bool) -> DataFrame:
    """Adds the shifts: one for all rows, then, for rows of at most a quarter of the source's mean size, another that
    makes up for what the large ones leave over or under."""
    first = _threshold(scratch, rows, solved.withColumn("aim", F.col("target")), most, few)
    solved = _joined(solved, first.withColumnRenamed("shift", "shift_large"), few).withColumn("small", F.col("scale") / 4)
    held = _joined(rows, solved, few)
    large = held.where(F.col("size") > F.col("small")).groupBy("source").agg(F.sum(_copied(most, F.col("shift_large")) * F.col("size")).alias("_taken"))
    right = large.withColumnRenamed("source", "_source")
    aimed = solved.join(F.broadcast(right) if few else right, solved["source"].eqNullSafe(right["_source"]), "left").drop("_source")
    aimed = scratch.keep(_in_one(aimed.withColumn("aim", F.col("target") - F.coalesce("_taken", F.lit(0))).drop("_taken"), few), "aims")
    small = _joined(rows, aimed.select("source", "small"), few).where(F.col("size") <= F.col("small")).drop("small")
    second = _threshold(scratch, small, aimed, most, few)
    return _joined(aimed.drop("aim"), second.withColumnRenamed("shift", "shift_small"), few)


def _copied(most: float, shift: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.floor(_rate(most) + F.col("u") + shift))).cast("int")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column, Column]:
    u = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 11) / F.lit(float(1 << 53))
    return word_count(text_col), u, F.col(source_col).cast("string")


def _solve(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, DataFrame, bool]:
    """The sized rows (doc_id, source, size, u), the solved parameters per source, and whether these are few."""
    scratch = Scratch(docs.sparkSession, "mixing")
    size, u, source = _sized(docs, id_col, text_col, source_col)
    rows = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), size.alias("size"), u.alias("u")), "sized")
    pairs = scratch.keep(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "pairs")
    sizes = scratch.keep(pairs.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), "sources")
    few = sizes.count() <= BROADCAST_ROWS
    wanted = scratch.keep(_in_one(targets(sizes, weights, share, most), few), "targets")
    solved = solve_rates(scratch, pairs, wanted, most, few)
    return rows, _round(scratch, rows, solved, most, few), few


def _copies(rows: DataFrame, solved: DataFrame, most: float, few: bool) -> DataFrame:
    held = _joined(rows, solved, few).withColumn("rate", _rate(most))
    shift = F.when(F.col("size") > F.col("small"), F.col("shift_large")).otherwise(F.col("shift_small"))
    return held.withColumn("copies", _copied(most, shift))


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    rows, solved, few = _solve(docs, id_col, text_col, source_col, weights, share, most)
    held = _copies(rows, solved, most, few)
    return held.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def with_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it, with the columns they came with."""
    _, solved, few = _solve(docs, id_col, text_col, source_col, weights, share, most)
    size, u, source = _sized(docs, id_col, text_col, source_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), source.alias("source"), size.alias("size"), u.alias("u"))
    held = _copies(packed, solved, most, few).where("copies > 0")
    return held.select(F.explode(F.array_repeat("_row", F.col("copies"))).alias("_row")).select("_row.*")
