"""Mixing sources to target weights under weight schedules that change during training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.llm.common import keep_others, n_words

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Rates at the start, middle and end of training, dealt to the sources in turn; straight between.
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
#: A source's documents are summed within 16^4 ranges of their hash and over these ranges.
RANGE_DIGITS = 4


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> also rank, weight, target.

    Sources in code-point order, null last, get the weights in turn and share all sizes; no target
    exceeds MAX_EPOCHS times its source's size.  With the sources in the order of cap over weight,
    those before the first whose share fits under its cap are full; the rest share what is left by
    weight.  The windows without a key see one row per source.
    """
    ranked = sizes.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    )
    turn = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ranked.withColumn("weight", F.get(turn, F.col("rank") % len(weights)))
    ranked = ranked.withColumn("cap", (F.col("source_size") * MAX_EPOCHS).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    so_far = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = ranked.withColumns({
        "all_size": F.sum("source_size").over(everything),
        "cap_before": F.sum("cap").over(so_far) - F.col("cap"),
        "weight_left": F.sum("weight").over(everything) - F.sum("weight").over(so_far) + F.col("weight"),
        "turn_at": F.row_number().over(by_cap),
    }).withColumn("level", (F.col("all_size") - F.col("cap_before")) / F.col("weight_left"))
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    first = F.min(F.when(fits, F.struct("turn_at", "level"))).over(everything)["level"]
    return steps.withColumn("target", F.least("cap", first * F.col("weight"))).select(
        "source", "source_size", "rank", "weight", "target"
    )


def time_of(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """Training time in 0..1 at which a source has met ``share`` of its whole demand.

    Demand is the integral of the schedule, a parabola on each half; the time is its inverse, in the
    form that also holds for a flat half.
    """
    out = None
    for i, (a, b, c) in enumerate(schedules):
        first, second = (a + b) / 4, (b + c) / 4
        need = share * (first + second)

        def solve(need: Column, start: float, end: float) -> Column:
            slope = (end - start) / 0.5
            root = F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * slope * need))
            return F.when(need <= 0, 0.0).otherwise(2 * need / (start + root))

        when = F.when(need <= first, solve(need, a, b)).otherwise(0.5 + solve(need - first, b, c))
        out = F.when(kind == i, when) if out is None else out.when(kind == i, when)
    return out


def _plan(sized: DataFrame) -> DataFrame:
    """Targets, words taken and training times of each (source, doc_id, size).

    Equal rows are one item with a count, so repeated rows cost one row here.  Words before an item
    are summed in two steps, within a hash range of its source and over the ranges, so that a source
    with a third of all rows is no task's burden.
    """
    items = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    items = items.withColumns({
        "order_key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
        "words": F.col("size") * F.col("copies"),
    }).withColumn("part", F.substring("order_key", 1, RANGE_DIGITS))
    parts = items.groupBy("source", "part").agg(F.sum("words").alias("part_words"))
    over_parts = Window.partitionBy("source").orderBy("part")
    parts = parts.withColumn("part_start", F.sum("part_words").over(over_parts) - F.col("part_words"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_words").alias("source_size")))
    p, t = parts.alias("p"), targets.alias("t")
    starts = p.join(t, F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        F.col("p.source").alias("p_source"), F.col("p.part").alias("p_part"), "part_start",
        "t.source_size", "rank", "target",
    )
    inside = Window.partitionBy("source", "part").orderBy("order_key", "doc_id", "size")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = items.withColumn("in_part", F.sum("words").over(running) - F.col("words"))
    at = summed.join(
        starts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part"))
    ).withColumns({
        "start": F.col("part_start") + F.col("in_part"), "quota": F.round("target").cast("long")
    })
    zero = F.lit(0).cast("long")
    rounds = F.array(*(
        F.greatest(zero, F.least("words", F.col("quota") - F.col("start") - e * F.col("source_size")))
        for e in range(MAX_EPOCHS)
    ))
    begins = F.array(*(F.col("start") + e * F.col("source_size") for e in range(MAX_EPOCHS)))
    each = at.withColumn("rounds", rounds).withColumn("begins", begins)
    kind = F.col("rank") % len(SCHEDULES)
    passes = F.array(*(
        F.struct(
            F.floor(F.get("rounds", F.lit(e)) / F.col("copies")).cast("long").alias("words"),
            F.when(
                F.get("rounds", F.lit(e)) > 0,
                time_of(F.get("begins", F.lit(e)) / F.col("target"), kind),
            ).alias("time"),
        )
        for e in range(MAX_EPOCHS)
    ))
    return each.select(
        "source", "doc_id", "size", "source_size", "target", "order_key",
        F.filter(passes, lambda p: p["words"] > 0).alias("passes"),
    )


NEW = ["size", "source_size", "target", "taken", "passes", "position", "order_key"]


def _mixed(df: DataFrame) -> DataFrame:
    """What ``mix`` returns, in no order."""
    base = df.select(*keep_others(df, NEW)).withColumn("size", n_words())
    plan = _plan(base.select("source", F.col("doc_id").cast("long").alias("doc_id"), "size")).alias("p")
    b = base.alias("b")
    same = (
        F.col("b.source").eqNullSafe(F.col("p.source"))
        & F.col("b.doc_id").cast("long").eqNullSafe(F.col("p.doc_id"))
        & (F.col("b.size") == F.col("p.size"))
    )
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda acc, p: acc + p["words"])
    joined = b.join(plan, same).select("b.*", "p.source_size", "p.target", "p.passes", "p.order_key")
    return joined.withColumns({"taken": taken, "position": F.get("passes", F.lit(0))["time"]})


def mix(df: DataFrame) -> DataFrame:
    """df with size, source_size, target, taken, passes (words and time of each use of the text),
    position (time of the first use) and order_key, range-sorted by position.

    A source's documents run in the order of a hash of doc_id, again and again up to three times,
    until its target is met; only the last one may be taken in part.  Position is the training time
    at which the source's schedule asks for the document's first word.  Documents that are not
    reached have taken 0, a null position and sort last, in hash order, so that they are dealt over
    all partitions like the others.  Null texts have size 0 and are never taken; null sources are one
    source, null ids one id.  Rows equal in id, source and size are used alike.  Reruns agree.
    Columns of the input that bear one of the new names are replaced.
    """
    return _mixed(df).orderBy(F.asc_nulls_last("position"), "order_key", "doc_id")


def training_rows(df: DataFrame) -> DataFrame:
    """The mixture itself: a row of df for each use of a document, range-sorted by training time.

    A text is used whole; a last use of which less than half is asked for is left out, but never a
    source's first text, so that no source with a share vanishes.  All columns of df come back as they
    were, whatever their names.
    """
    rows = df.select(F.struct(*df.columns).alias("_row"), "doc_id", "source", "text")
    uses = _mixed(rows).withColumn("use", F.explode("passes")).filter(
        (F.col("use")["words"] * 2 >= F.col("size")) | (F.col("use")["time"] == 0)
    )
    return uses.orderBy(F.col("use")["time"], "order_key", "doc_id").select("_row.*")
