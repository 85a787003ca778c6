"""Exact quantiles of groups of any size, by passes that narrow the place of a rank.

``percentile`` keeps every distinct value of a group in one buffer.  Here only
groups of at most ``few`` values use it.  For a larger group each pass reads the
values once: it counts how many lie below, at and between two bounds and sketches
those between (``percentile_approx``, a mergeable buffer of bounded size).  The
counts are exact, so they tell whether the wanted rank is a bound or lies between;
the sketch gives the next two bounds, close to the rank.  A pass leaves under a
hundredth of the values, and when ``few`` or fewer are left these are ranked as
they are.  No pass shuffles values, only counts and sketches of each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kmerlake.operators.stage import written

_STEPS = 500


def _mixed(place: Column, low: Column, high: Column) -> Column:
    """Linear interpolation between the values of the two ranks around ``place``."""
    under, over = F.floor(place), F.ceil(place)
    return F.when(under == over, low).otherwise((over - place) * low + (place - under) * high)


def _sent(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A narrow written table, marked for broadcasting if it has few rows (counted)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ranked_values(df: DataFrame, group: list[str], value: str, wanted: DataFrame, few: int = 100_000) -> DataFrame:
    """(group, rank, found): the value of each rank (from 0) in ``wanted`` (group, rank), both narrow tables.

    Values are doubles without nulls; a rank must exist in its group.
    """
    if not group:
        whole = lambda x: x.withColumn("_whole", F.lit(0))
        return ranked_values(whole(df), ["_whole"], value, whole(wanted), few).drop("_whole")
    keys = [*group, "rank"]
    none = F.lit(None).cast("double")
    state = written(wanted.select(*keys).distinct().withColumns({"_a": none, "_b": none, "_lo": none, "_hi": none, "_found": none, "_between": F.lit(None).cast("long")}))
    v = F.col("_v")
    values = df.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(value).cast("double").alias("_v"))
    same = lambda: [F.col(f"_g{i}").eqNullSafe(F.col(g)) for i, g in enumerate(group)]
    percents = [i / _STEPS for i in range(_STEPS + 1)]
    while True:
        open_ = state.where("_found is null and (_between is null or _between > %d)" % few)
        if open_.isEmpty():
            break
        met = values.join(_sent(open_), same())
        # The rank lies between a and b; lo and hi are the bounds under test (none in the first pass).
        beyond = (F.col("_a").isNull() | (v > F.col("_a"))) & (F.col("_b").isNull() | (v < F.col("_b")))
        within = beyond & (F.col("_lo").isNull() | (v > F.col("_lo"))) & (F.col("_hi").isNull() | (v < F.col("_hi")))
        told = met.groupBy(*keys, "_a", "_b", "_lo", "_hi").agg(
            F.count_if(v < F.col("_lo")).alias("_under"), F.count_if(v == F.col("_lo")).alias("_at_lo"), F.count_if(within).alias("_n"), F.count_if(v == F.col("_hi")).alias("_at_hi"), F.percentile_approx(F.when(within, v), percents, 20 * _STEPS).alias("_sketch")
        )
        place = F.col("rank") - F.when(F.col("_lo").isNull(), 0).otherwise(F.col("_under"))
        inner = place - F.col("_at_lo")
        is_lo = F.col("_lo").isNotNull() & (place >= 0) & (inner < 0)
        is_hi = F.col("_hi").isNotNull() & (inner >= F.col("_n")) & (inner - F.col("_n") < F.col("_at_hi"))
        # A bound that the sketch has set on the wrong side of the rank only costs a pass.
        low_side, high_side = F.col("_lo").isNotNull() & (place < 0), F.col("_hi").isNotNull() & (inner - F.col("_n") >= F.col("_at_hi"))
        at = F.when(low_side | high_side, 0.5).otherwise((inner + 0.5) / F.greatest(F.col("_n"), F.lit(1)))
        near = lambda shift: F.get("_sketch", F.least(F.lit(_STEPS), F.greatest(F.lit(0), F.floor(at * _STEPS) + shift)).cast("int"))
        a = F.when(high_side, F.col("_hi")).when(low_side, F.col("_a")).otherwise(F.coalesce("_lo", "_a"))
        b = F.when(low_side, F.col("_lo")).when(high_side, F.col("_b")).otherwise(F.coalesce("_hi", "_b"))
        off = low_side | high_side
        next_ = told.select(
            *keys, a.alias("_a"), b.alias("_b"), F.when(~off, near(-1)).alias("_lo"), F.when(~off, near(2)).alias("_hi"), F.when(is_lo, F.col("_lo")).when(is_hi, F.col("_hi")).alias("_found"), F.when(~off, F.col("_n")).alias("_between")
        )
        state = written(state.where("_found is not null or _between <= %d" % few).unionByName(next_))

    # What is left between the bounds is ranked as it is: ``few`` values a rank at most.
    rest = state.where("_found is null")
    met = values.join(_sent(rest), same())
    below = F.col("_a").isNotNull() & (v <= F.col("_a"))
    inside = ~F.coalesce(below, F.lit(False)) & (F.col("_b").isNull() | (v < F.col("_b")))
    left = met.groupBy(*keys).agg(F.count_if(below).alias("_before"), F.array_sort(F.collect_list(F.when(inside, v))).alias("_left"))
    last = left.select(*keys, F.get("_left", (F.col("rank") - F.col("_before")).cast("int")).alias("found"))
    return state.where("_found is not null").select(*keys, F.col("_found").alias("found")).union(last)


def quantiles(df: DataFrame, group: list[str], value: str, at: dict[str, float | None], few: int = 100_000) -> DataFrame:
    """(group, n, names): exact quantiles of ``value`` in each group; nulls and NaN count for nothing.

    ``at`` maps a name to a share between 0 and 1, interpolated between neighbours,
    or to None for the upper median.  Groups without values are left out.  The rows
    are read once a pass: give a written table where they are dear.
    """
    if not group:
        return quantiles(df.withColumn("_whole", F.lit(0)), ["_whole"], value, at, few).drop("_whole")
    sound = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*group, F.col(value).cast("double").alias("_x"))
    sizes = written(sound.groupBy(*group).agg(F.count("*").alias("n")))
    same = lambda x, y: [x[g].eqNullSafe(y[g]) for g in group]
    place = lambda q: F.floor(F.col("n") / 2).cast("double") if q is None else F.lit(q) * (F.col("n") - 1)

    def by_buffer(rows: DataFrame) -> DataFrame:
        ranked = F.array_sort(F.collect_list("_x"))
        upper = F.get(ranked, F.floor(F.count("*") / 2).cast("int"))
        return rows.groupBy(*group).agg(F.count("*").alias("n"), *[(upper if q is None else F.percentile("_x", F.lit(q))).alias(name) for name, q in at.items()])

    if sizes.where(F.col("n") > few).isEmpty():
        return by_buffer(sound).where("n > 0")
    large = sizes.where(F.col("n") > few)
    small_groups = sizes.where(F.col("n") <= few).drop("n")
    light = by_buffer(sound.join(small_groups, same(sound, small_groups), "left_semi"))
    ranks = large.select(*group, F.explode(F.array(*[f(place(q)).cast("long") for q in at.values() for f in (F.floor, F.ceil)])).alias("rank"))
    found = written(ranked_values(sound, group, "_x", ranks, few))
    held = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("_values"))
    of = lambda q, f: F.try_element_at(F.col("_values"), f(place(q)).cast("long"))
    heavy = large.join(held, same(large, held))
    heavy = heavy.select(*[large[g] for g in group], "n", *[_mixed(place(q), of(q, F.floor), of(q, F.ceil)).alias(name) for name, q in at.items()])
    return light.union(heavy)
