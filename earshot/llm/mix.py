"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Sources get shares of all words by weight, none beyond `most` times its own size; what
a full source cannot take is shared again among the rest. A document of a source is
expected target / size times in the mix. The running sum of these expectations, moved
by one random offset per source, passes an integer once per copy to emit.

No window ever holds a source. Documents lie in cells of a source: their size class
(the three leading binary digits), then a hash slice, as many as the cell's count asks
for. Positions are numbered inside cells and the cells' counts are summed before, so
the running sum is exact over the whole source however hot it is. Because classes
follow each other, every class is sampled at the rate of its source, and the words
taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.frames import without
from earshot.plans.sizing import broadcast_if_bounded, materialize

WEIGHTS = (1, 2, 3)
MOST = 3
CELL_ROWS = 500
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source of a table (source, size), as one small table.

    Sources in code-point order, null last, have the weights in turn. The capped ones are
    those of the smallest size per weight: filled in that order, a source is capped when
    its share of what is left exceeds its cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    weighed = totals.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn + 1).alias("weight"))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    shared = weighed.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(up_to), F.lit(0))).alias("left"),
        F.sum("weight").over(rest).alias("weights_left"),
        F.row_number().over(filling).alias("place"),
    )
    # Capped sources are a prefix of the filling order, so the first that is not sets the rate.
    free = (F.col("left") * F.col("weight")) <= (most * F.col("source_size") * F.col("weights_left"))
    first = F.min(F.when(free & (F.col("source_size") > 0), F.struct("place", "left", "weights_left"))).over(whole)
    level = shared.select("source", "source_size", "weight", "place", first.alias("first"))
    capped = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return level.select(
        "source", "source_size",
        F.when(capped, (most * F.col("source_size")).cast("double"))
        .otherwise((F.col("first.left") * F.col("weight")).cast("double") / F.col("first.weights_left")).alias("target"),
    )


def mix_sources(
    docs: DataFrame, source: str = "source", text: str | None = "text", key: str = "doc_id",
    size: Column | None = None, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 7, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """docs with size, source_size, target (of its source), copies int and taken = copies * size.

    size is the number of words of the text unless given. A null source is a source of
    its own, last in order. A source without words has target 0 and emits nothing, as
    does an empty table. Null or repeated keys only make ties in a hash order: rows that
    are equal are interchangeable. The same rows give the same mix, however they are
    partitioned. Columns of the five names are replaced.
    """
    base = without(docs, *ADDED)
    name = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    sized = base.withColumn("size", word_count(F.col(text)) if size is None else size)
    binary = F.bin("size")
    marked = sized.select(
        "*", digest.alias("__draw"), name.alias("__name"),
        F.length(binary).alias("__digits"), F.substring(binary, 1, 3).alias("__lead"),
    )
    cell = ["__name", "__digits", "__lead"]
    classes = materialize(
        marked.groupBy(F.col(source).alias("__source"), *cell).agg(F.count("*").alias("__n"), F.sum("size").alias("__words")),
        "classes",
    )
    targets = source_targets(
        classes.select(F.col("__source").alias("source"), F.col("__words").alias("size")), weights, most
    ).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("__name"), "source_size", "target")
    slices = classes.select(*cell, F.ceil(F.col("__n") / cell_rows).cast("long").alias("__slices"))
    draw = F.conv(F.substring("__draw", 1, 8), 16, 10).cast("long")
    placed = marked.join(broadcast_if_bounded(slices), cell).withColumn("__slice", F.pmod(draw, F.col("__slices"))).drop("__slices")
    cells = [*cell, "__slice"]
    order = Window.partitionBy("__name").orderBy(F.desc("__digits"), F.desc("__lead"), "__slice")
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = placed.groupBy(*cells).agg(F.count("*").alias("__n"))
    plan = materialize(counted.select(*cells, before.alias("__before")).join(targets, "__name"), "cells")
    inside = Window.partitionBy(*cells).orderBy(F.desc("size"), "__draw", F.col(key))
    ranked = placed.withColumn("__place", F.row_number().over(inside).cast("long"))
    joined = ranked.join(broadcast_if_bounded(plan), cells)
    offset_text = F.md5(F.concat_ws("|", F.lit(f"offset-{seed}"), F.col("__name")))
    offset = F.conv(F.substring(offset_text, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("__before") + F.col("__place")
    copies = (F.floor(at * rate + offset) - F.floor((at - 1) * rate + offset)).cast("int")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(
        *[F.col(f"`{c}`") for c in base.columns], *ADDED
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it has copies."""
    repeated = mixed.filter("copies > 0").select(
        "*", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("__copy")
    )
    return repeated.drop("__copy", *ADDED)
