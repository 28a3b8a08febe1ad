"""Mix sources to target weights by entropy balancing.

Every document gets a rate, its expected number of copies. Among all rates that meet the token
constraint of each source and stay at or below ``most``, entropy balancing takes those nearest to one
in relative entropy: ``min(most, exp(l * size / mean size))``. The multiplier ``l`` of each source
solves the convex dual; Newton steps on it are aggregates over the table of distinct (source, size), to
which the documents are reduced first, so a hot source costs no more than its distinct sizes.

Rates become whole copies in two steps. Within a source, cumulative copies over falling size are
rounded, which keeps the error under half of the largest document; single copies are then added or
taken where that brings the source nearer to its target. Inside a (source, size) group the documents
with the smallest hashes get the one copy more, up to a hash that is found by counting, not sorting.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.llm.common import blank_words, numbered, stored

WEIGHTS = (5, 2, 1)
MOST = 3
STEPS, TOLERANCE = 400, 1e-7
REPAIRS = 6
BUCKET_BITS = 12


def size_of(text: Column) -> Column:
    return F.size(blank_words(text)).cast("long")


def keys(id_col: Column, source: Column, text: Column) -> list[Column]:
    """Source key (never null), size and hash of a document; the copies are a function of them."""
    return [
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("skey"),
        size_of(text).alias("size"),
        F.xxhash64(id_col, text).alias("h"),
    ]


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``skey, source, source_size, target`` from ``skey, source, source_size``.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target stops at ``most`` times its source's size and the others share the rest by weight.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = numbered(by_source, order, "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = stored(ranked.withColumn("weight", weight).drop("rank"), "weights")
    cap = most * F.col("source_size")
    unit = 0.0
    while True:  # the set of stopped sources only grows
        stopped = cap <= F.col("weight") * F.lit(unit)
        total, fixed, free = weighed.agg(
            F.sum("source_size"),
            F.sum(F.when(stopped, cap).otherwise(0)),
            F.sum(F.when(stopped, 0).otherwise(F.col("weight"))),
        ).first()
        new = (total - fixed) / free if free else unit
        if new <= unit:
            break
        unit = new
    return weighed.select(
        "skey", "source", "source_size", F.least(cap, F.col("weight") * F.lit(unit)).cast("double").alias("target")
    )


def multipliers(groups: DataFrame, aims: DataFrame, most: float = MOST) -> DataFrame:
    """``skey, target, unit, l``: the dual solution of each source with 0 < target < most * size."""
    means = groups.groupBy("skey").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("unit"))
    state = aims.where((F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-9))).join(
        means, "skey"
    )
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    state = stored(state.select("skey", "target", "unit", zero.alias("l"), none.alias("lo"), none.alias("hi")), "dual")
    for _ in range(STEPS):
        x = F.col("size") / F.col("unit")
        tokens = F.col("n") * F.col("size") * rate(F.col("l"), x, most)
        slope = F.when(F.col("l") * x < log(most), tokens * x).otherwise(0.0)
        sums = (
            groups.join(state.select("skey", "unit", "l"), "skey")
            .groupBy("skey")
            .agg(F.sum(tokens).alias("got"), F.sum(slope).alias("slope"))
        )
        state = stored(_newton(state.join(sums, "skey")), "dual")
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    # sums of doubles differ in their last digits with the order of rows; the rates must not
    return state.select("skey", "target", "unit", F.round("l", 9).alias("l"))


def _newton(state: DataFrame) -> DataFrame:
    """One safeguarded step: bisect where Newton leaves the bracket, bounded where there is none."""
    over = F.col("got") > F.col("target")
    gap = F.abs(F.col("got") - F.col("target")) / F.col("target")
    state = state.select(
        "skey", "target", "unit", "l", "got", "slope", gap.alias("gap"),
        F.when(over, F.col("lo")).otherwise(F.col("l")).alias("lo"),
        F.when(over, F.col("l")).otherwise(F.col("hi")).alias("hi"),
    )
    reach = 2 * F.greatest(F.abs("l"), F.lit(1.0))
    step = F.when(F.col("slope") > 0, (F.col("target") - F.col("got")) / F.col("slope")).otherwise(reach)
    new = F.col("l") + F.greatest(-reach, F.least(reach, step))
    inside = (new > F.coalesce("lo", new - 1)) & (new < F.coalesce("hi", new + 1))
    new = F.when(inside, new).otherwise((F.col("lo") + F.col("hi")) / 2)
    new = F.when(F.col("gap") <= TOLERANCE, F.col("l")).otherwise(new)
    return state.select("skey", "target", "unit", new.alias("l"), "lo", "hi", "gap")


def rate(multiplier: Column, x: Column, most: float = MOST) -> Column:
    return F.exp(F.least(multiplier * x, F.lit(log(most))))


def whole_copies(groups: DataFrame, aims: DataFrame, solved: DataFrame, most: int = MOST) -> DataFrame:
    """``skey, size, n, copies``: whole copies of each group that bring its source near its target."""
    joined = groups.join(aims.select("skey", "target", "source_size"), "skey").join(
        solved.select("skey", "unit", "l"), "skey", "left"
    )
    full = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)  # no multiplier: all or nothing
    r = F.when(F.col("size") == 0, 1.0).otherwise(
        F.coalesce(rate(F.col("l"), F.col("size") / F.col("unit"), most), full)
    )
    falling = Window.partitionBy("skey").orderBy(F.desc("size"))
    upto = F.floor(F.sum(F.col("n") * r).over(falling) + 0.5)
    rounded = joined.select("skey", "size", "n", "target", upto.cast("long").alias("upto"))
    copies = F.col("upto") - F.coalesce(F.lag("upto").over(falling), F.lit(0))
    copies = F.greatest(F.lit(0), F.least(copies, most * F.col("n")))
    table = stored(rounded.select("skey", "size", "n", "target", copies.alias("copies")), "copies")
    for _ in range(REPAIRS):
        table = stored(_repair(table, most), "copies")
    return table.select("skey", "size", "n", "copies")


def _repair(table: DataFrame, most: int) -> DataFrame:
    """Add or take the one copy that brings each source nearest to its target, if any does."""
    rest = table.groupBy("skey").agg(
        (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest")
    )
    sign = F.signum("rest")
    free = F.when(sign > 0, F.col("copies") < most * F.col("n")).otherwise(F.col("copies") > 0)
    left = F.abs(F.abs("rest") - F.col("size"))
    better = free & (F.col("size") > 0) & (left < F.abs("rest"))
    best = (
        table.join(rest, "skey")
        .where(better)
        .groupBy("skey")
        .agg(F.min_by(F.struct("size", sign.cast("long").alias("sign")), F.struct(left, "size")).alias("best"))
    )
    moved = F.when(F.col("best.size") == F.col("size"), F.col("best.sign")).otherwise(0)
    return table.join(best, "skey", "left").select(
        "skey", "size", "n", "target", (F.col("copies") + F.coalesce(moved, F.lit(0))).alias("copies")
    )


def cut_hashes(sized: DataFrame, copies: DataFrame) -> DataFrame:
    """``skey, size, each, upto``: copies of every document of a group, and one more up to a hash.

    The hash is found in two counts: by its leading bits, then within the one range that decides.
    """
    wanted = copies.select(
        "skey", "size", F.expr("copies div n").alias("each"), (F.col("copies") % F.col("n")).alias("extra")
    )
    part = F.shiftright("h", 64 - BUCKET_BITS)
    # a copy of the group's key goes with each count, as null keys do not occur here
    counted = sized.groupBy("skey", "size", part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("skey", "size").orderBy("part")) - F.col("n")
    deciding = (
        counted.join(wanted.where("extra > 0").select("skey", "size", "extra"), ["skey", "size"])
        .select("skey", "size", "part", "extra", "n", before.alias("before"))
        .where("before < extra and extra <= before + n")
        .select("skey", "size", "part", (F.col("extra") - F.col("before")).alias("at"))
    )
    inside = sized.select("skey", "size", part.alias("part"), "h").join(deciding, ["skey", "size", "part"])
    place = F.row_number().over(Window.partitionBy("skey", "size", "part").orderBy("h"))
    cuts = inside.withColumn("place", place).where("place = at").select("skey", "size", F.col("h").alias("upto"))
    return wanted.join(cuts, ["skey", "size"], "left").select("skey", "size", "each", "upto")


def copies_of(each: Column, upto: Column, h: Column) -> Column:
    return (each + F.when(upto.isNotNull() & (h <= upto), 1).otherwise(0)).cast("long")


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``skey, size, source_size, target, each, upto``, to read the copies of any document from.

    ``sized`` has ``source`` and the ``keys`` of every document, repeated rows each counting. Null
    sources are one source, last in order. Documents without words get one copy, which takes nothing.
    Rows alike in id and text get the same number of copies. An empty table gives no rows.
    """
    groups = stored(sized.groupBy("skey", "source", "size").agg(F.count("*").alias("n")), "sizes")
    by_source = groups.groupBy("skey", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = stored(targets(by_source, weights, most), "targets")
    solved = multipliers(groups, aims, most)
    cuts = cut_hashes(sized, whole_copies(groups, aims, solved, most))
    return stored(cuts.join(aims.select("skey", "source_size", "target"), "skey"), "mix")
