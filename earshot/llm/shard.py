"""A uniform shuffle into shards of exact sizes, in DataFrame operations only.

Rows lie in logical partitions, by a hash of key and text. How many of each partition's
rows go to each shard is the communication matrix: a random matrix with the partitions'
counts as row sums and the shards' exact sizes as column sums, distributed as under a
uniform permutation of all rows. It is drawn before anything moves, a row at a time by
hypergeometric draws from what the shards still lack, in a tree of at most 256 children
a node, so that no task draws a large part of it.

Then each partition is permuted (a rank by hash) and cut by its row of the matrix; the
rows travel once, to a slice of their shard chosen by a second hash; each slice is
permuted, and the slices' counts, summed before, turn ranks into gapless slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.frames import without
from earshot.plans.sizing import broadcast_if_bounded, materialize

FAN_OUT = 256
PARTITION_ROWS = 2_000


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hypergeometric(good: str, bad: str, draws: str, uniform: str) -> str:
    """SQL for one hypergeometric draw by inversion.

    Weights are walked over twelve standard deviations around the mode, each from the
    one before, with the first as unit: their sum, then the place where the uniform
    number falls. What is left out has a chance below 1e-30.
    """
    spread = f"""cast(ceil(12 * sqrt(cast(z.m as double) * z.k / greatest(z.k + z.r, 1L) * z.r / greatest(z.k + z.r, 1L)
        * greatest(z.k + z.r - z.m, 0L) / greatest(z.k + z.r - 1, 1L))) + 4 as bigint)"""
    mode = "cast(floor((z.m + 1D) * (z.k + 1D) / (z.k + z.r + 2D)) as bigint)"
    low, high = f"greatest(0L, z.m - z.r, {mode} - {spread})", f"least(z.m, z.k, {mode} + {spread})"
    ratio = "((z.k - x) * 1D * (z.m - x) / ((x + 1D) * (z.r - z.m + x + 1)))"
    total = f"""aggregate(sequence(y.a, y.b), named_struct('w', 1D, 't', 0D), (s, x) ->
        named_struct('w', s.w * {ratio}, 't', s.t + s.w), s -> s.t)"""
    place = f"""aggregate(sequence(y.a, y.b), named_struct('w', 1D, 'c', 0D, 'n', 0L), (s, x) ->
        named_struct('w', s.w * {ratio}, 'c', s.c + s.w, 'n', s.n + if(s.c + s.w <= t, 1L, 0L)), s -> s.n)"""
    return _let(
        f"named_struct('k', {good}, 'r', {bad}, 'm', {draws})", "z",
        _let(f"named_struct('a', {low}, 'b', {high})", "y", _let(f"{total} * {uniform}", "t", f"least(y.b, y.a + {place})")),
    )


def _row_draw(have: str, size: str, key: str, seed: int, n_shards: int) -> str:
    """SQL for one row of the matrix: size rows drawn from what the shards have."""
    uniform = f"((xxhash64({seed}L, {key}, c) & 9007199254740991L) / 9007199254740992D)"
    good = f"element_at({have}, c)"
    x = _hypergeometric(good, f"(u.rest - {good})", "u.todo", uniform)
    step = _let(x, "v", f"named_struct('todo', u.todo - v, 'rest', u.rest - {good}, 'out', concat(u.out, array(v)))")
    return f"""aggregate(sequence(1, {n_shards}),
        named_struct('todo', {size}, 'rest', aggregate({have}, 0L, (p, q) -> p + q), 'out', cast(array() as array<bigint>)),
        (u, c) -> {step}, u -> u.out)"""


def communication_matrix(counts: DataFrame, n_partitions: int, totals: list[int], seed: int) -> DataFrame:
    """part long, counts array<long>: how many rows of each partition go to each shard.

    counts has part long (0 to n_partitions - 1, absent ones hold nothing) and n long.
    """
    spark = counts.sparkSession
    levels = 1
    while FAN_OUT**levels < n_partitions:
        levels += 1
    spread = spark.range(1).select(
        F.col("id").alias("node"), F.array(*[F.lit(t).cast("long") for t in totals]).alias("have")
    )
    for level in reversed(range(levels)):
        width = FAN_OUT**level
        child = F.floor(F.col("part") / width).cast("long")
        below = counts.groupBy(child.alias("child")).agg(F.sum("n").alias("n"))
        rows = below.groupBy(F.floor(F.col("child") / FAN_OUT).cast("long").alias("node")).agg(
            F.sort_array(F.collect_list(F.struct("child", "n"))).alias("children")
        )
        row = _row_draw("s.have", "e.n", f"{level}L, e.child", seed, len(totals))
        drawn = f"""aggregate(children,
            named_struct('have', have, 'out', cast(array() as array<struct<node:bigint,have:array<bigint>>>)),
            (s, e) -> {_let(row, "d", '''named_struct('have', zip_with(s.have, d, (h, g) -> h - g),
                'out', concat(s.out, array(named_struct('node', e.child, 'have', d))))''')},
            s -> s.out)"""
        spread = spread.join(rows, "node").select(F.explode(F.expr(drawn)).alias("e")).select("e.node", "e.have")
    return spread.select(F.col("node").alias("part"), F.col("have").alias("counts"))


def _unit(*of: Column | str) -> Column:
    """A number in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def shard_rows(
    docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = 11,
    partition_rows: int = PARTITION_ROWS,
) -> DataFrame:
    """docs with shard int (0 to n_shards - 1) and slot long (gapless from 0 in each shard).

    Shard sizes differ by one row at most and every assignment of that shape is equally
    likely, as far as the hashes are random. The same rows give the same shards. Rows
    equal in key and text are ties and may stand for each other; null keys and texts
    are values like others. An empty table gives no rows; with fewer rows than shards
    some shards are empty. Columns of the two names are replaced.

    docs is scanned three times, twice for narrow counts, and shuffled twice.
    """
    base = without(docs, "shard", "slot")
    n = base.count()
    n_partitions = max(1, -(-n // partition_rows))
    totals = [n // n_shards + (i < n % n_shards) for i in range(n_shards)]
    hashed = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    n_slices = max(1, -(-n // (n_shards * partition_rows)))
    marked = base.select(
        "*", hashed.alias("__h"), F.floor(_unit(F.lit("part"), hashed) * n_partitions).cast("long").alias("__part")
    )
    counts = materialize(marked.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("n")), "counts")
    matrix = materialize(
        communication_matrix(counts, n_partitions, totals, seed).select(
            F.col("part").alias("__part"),
            F.expr("transform(counts, (v, i) -> aggregate(slice(counts, 1, i + 1), 0L, (p, q) -> p + q))").alias("__cuts"),
        ),
        "matrix",
    )
    local = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit("local"), "__h"), "__h", F.col(key))
    sent = (
        marked.withColumn("__rank", F.row_number().over(local) - 1)
        .join(broadcast_if_bounded(matrix, 100_000), "__part")
        .withColumn("shard", F.expr("cast(size(filter(__cuts, c -> c <= __rank)) as int)"))
        .withColumn("__slice", F.floor(_unit(F.lit("slice"), "__h") * n_slices).cast("long"))
        .drop("__cuts", "__rank", "__part")
    )
    order = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        sent.groupBy("shard", "__slice").agg(F.count("*").alias("n"))
        .select("shard", "__slice", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__before")),
        "offsets",
    )
    again = Window.partitionBy("shard", "__slice").orderBy(F.xxhash64(F.lit("slot"), "__h"), "__h", F.col(key))
    return (
        sent.withColumn("__place", F.row_number().over(again) - 1)
        .join(broadcast_if_bounded(offsets), ["shard", "__slice"])
        .select(*[F.col(f"`{c}`") for c in base.columns], "shard", (F.col("__before") + F.col("__place")).alias("slot"))
    )
