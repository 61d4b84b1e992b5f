"""The prefix trie of conversations, as tables: whole sequences collapsed first.

A conversation is a sequence of turns; a node of the trie is a distinct sequence of first
turns. Nobody walks a tree. A running hash names every prefix of every conversation:
the exclusive or of 64-bit hashes of (place, turn), twice over, so 128 bits in all.
Conversations with the same whole sequence are collapsed to one weighted sequence with the
list of its members; only these go on. A sequence that is no proper prefix of another one
(an anti-join says which) is a leaf. All figures of a node are then sums over the weighted
sequences that pass it:

 - members: the sum of weights; the smallest member: the least; leaves: a count.
 - For sums over a subtree, let T be the running number of words along a sequence. The
   words below a node, every turn times its members, are the sum of weight * T(end) less
   members * T before the node. Every turn once: each node belongs to the sequence of its
   smallest member, and a sequence's own nodes are the last of it, from where it leaves the
   sequences of smaller members; so a node's subtree has the own words of the sequences
   that pass it, and, of the one it belongs to, those from the node on.

A conversation's turns are cut into cells, so one that holds a third of all turns is scanned
by many tasks; cells are then put together by their sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.plans.sizing import broadcast_if_bounded, materialize

#: Turns of one cell, and conversation ids in a piece of a list of members: 2 to this power.
CELL_BITS = 12
#: Nodes that more sequences pass than this are joined by broadcast; there are few such nodes.
BUSY = 20_000


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest (16 bytes) and words of every turn, from conv_id, turn, role and text.

    Turns of a conversation are ordered by turn, null first, then by digest, the first
    half of the SHA-256 of role and text; rows that agree in all are turns of their own.
    A null role or text is empty. Rows with a null conv_id take no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        _words(text).alias("words"),
    )
    # Turns without a number come first of all, in a cell of their own.
    turns = turns.withColumn("cell", F.coalesce(F.shiftright("turn", CELL_BITS), F.lit(-(1 << 62)).cast("long")))
    order = Window.partitionBy("conv_id", "cell").orderBy(F.asc_nulls_first("turn"), "digest")
    placed = turns.withColumn("place", F.row_number().over(order).cast("long"))
    return _after_earlier_cells(placed, {"place": F.max("place")}, {"place": F.sum}, {"place": _plus}).select(
        "conv_id", "place", "digest", "words"
    )


def _plus(mine: Column, before: Column) -> Column:
    return mine + F.coalesce(before, F.lit(0))


def _xor(mine: Column, before: Column) -> Column:
    return mine.bitwiseXOR(F.coalesce(before, F.lit(0).cast("long")))


def _after_earlier_cells(df: DataFrame, whole: dict, running: dict, put: dict) -> DataFrame:
    """df with figures that run within a cell made to run through all cells of a conversation.

    whole: a figure of a cell; running: its sum over earlier cells; put: both together.
    """
    cells = df.groupBy("conv_id", "cell").agg(*(c.alias(f"cell_{n}") for n, c in whole.items()))
    earlier = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("conv_id", "cell", *(f(f"cell_{n}").over(earlier).alias(f"before_{n}") for n, f in running.items()))
    return df.join(before.filter(f"before_{next(iter(whole))} is not null"), ["conv_id", "cell"], "left").select(
        *(put[c](F.col(c), F.col(f"before_{c}")).alias(c) if c in put else F.col(c) for c in df.columns)
    )


def share_openings(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Turns of conversations whose openings were replaced by those of the conversation their group of `every` starts with.

    Conversation c takes the first h turns of conversation c - c % every (all if it has
    fewer, none if there is none) and then its own after its first h, where h is the
    CRC-32 of c in decimal modulo `most`. Returns conv_id, place, digest and words, and a
    row with a null digest for a conversation that is left without turns.
    """
    conv = F.col("conv_id")
    heads = F.pmod(F.crc32(conv.cast("string")), F.lit(most))
    everyone = turns.groupBy("conv_id").agg(F.max("place").alias("held")).select(
        "conv_id", heads.alias("heads"), (conv - conv % every).alias("base"), "held"
    )
    openings = turns.filter((conv % every == 0) & (F.col("place") < most)).groupBy(conv.alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("opening")
    )
    # An opening has fewer than `most` turns, and some 2 * `every` conversations at most take it.
    nothing = F.array().cast(openings.schema["opening"].dataType)
    plan = everyone.join(openings, "base", "left").withColumn(
        "opening", F.coalesce(F.slice("opening", F.lit(1), F.col("heads").cast("int")), nothing)
    )
    taken = plan.select("conv_id", F.inline("opening")).select("conv_id", "place", "digest", "words")
    # The rest of a conversation moves only if the opening is shorter than what it replaces.
    shorter = plan.select("conv_id", (F.size("opening") - F.col("heads")).alias("shift"), "held", "heads").filter("shift < 0 and held > heads")
    own = turns.filter(F.col("place") > heads).join(shorter.select("conv_id", "shift"), "conv_id", "left").select(
        "conv_id", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"), "digest", "words"
    )
    bare = plan.filter((F.size("opening") == 0) & (F.col("held") <= F.col("heads"))).select(
        "conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words")
    )
    return taken.unionByName(own).unionByName(bare)


def _prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix but the empty one: conv_id, depth, p and q (its name), up_p and up_q (its parent's), words and words_before."""
    named = turns.filter(F.col("digest").isNotNull()).select(
        "conv_id", F.shiftright("place", CELL_BITS).alias("cell"), F.col("place").alias("depth"),
        F.xxhash64("place", "digest").alias("a"), F.xxhash64("digest", F.lit("second"), "place").alias("b"), F.col("words").alias("own"),
    )
    order = Window.partitionBy("conv_id", "cell").orderBy("depth")
    so_far = named.withColumns({"p": F.bit_xor("a").over(order), "q": F.bit_xor("b").over(order), "words": F.sum("own").over(order)})
    whole = {c: F.max_by(c, "depth") for c in ("p", "q", "words")}
    through = _after_earlier_cells(
        so_far, whole, {"p": F.bit_xor, "q": F.bit_xor, "words": F.sum}, {"p": _xor, "q": _xor, "words": _plus}
    )
    return through.select(
        "conv_id", "depth", "p", "q", _xor(F.col("p"), F.col("a")).alias("up_p"), _xor(F.col("q"), F.col("b")).alias("up_q"),
        "words", (F.col("words") - F.col("own")).alias("words_before"),
    )


def _owner_of(passing: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """passing with columns of its node; nodes that very many sequences pass are broadcast."""
    node = ["depth", "p", "q"]
    busy = nodes.filter(F.col("n_sequences") > BUSY).select(*node, *(F.col(c).alias(f"_{c}") for c in columns))
    marked = passing.join(broadcast_if_bounded(busy), node, "left")
    there = F.col(f"_{columns[0]}").isNotNull()
    rest = marked.filter(~there).select(*passing.columns).join(
        nodes.filter(F.col("n_sequences") <= BUSY).select(*node, *columns), node
    )
    return marked.filter(there).select(*passing.columns, *(F.col(f"_{c}").alias(c) for c in columns)).unionByName(rest)


def prefix_trie(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and the lists of conversations that end at them.

    turns: conv_id, place from 1 without gaps, digest, words, as by ordered_turns or
    share_openings; a conversation without turns is one row with a null digest.

    Nodes, all long: conv_id, the smallest member; depth; parent_conv_id, the parent's
    conv_id (null at the root); n_convs, members; n_children; n_leaves, nodes without
    children in the subtree, itself included; saved_tokens, the sum over the subtree of
    (members - 1) times words of the last turn. conv_id and depth name a node.

    Ends: conv_id and depth of the node, piece, and members (ascending, an array of at
    most 2 ** CELL_BITS ids): the conversations that are this sequence and no more; pieces in order
    make up the list. Without conversations there are no nodes, not even a root.
    """
    turns = materialize(turns, "turns")
    prefixes = materialize(_prefixes(turns), "prefixes")
    # Whole sequences: those of one name are one.
    end = F.max(F.struct("depth", "p", "q", "words"))
    zero = F.lit(0).cast("long")
    wholes = prefixes.groupBy("conv_id").agg(end.alias("e")).select("conv_id", "e.*").unionByName(
        turns.filter(F.col("digest").isNull()).select("conv_id", *(zero.alias(c) for c in ("depth", "p", "q", "words")))
    )
    name = ["depth", "p", "q"]
    sequences = materialize(wholes.groupBy(*name).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.first("words").alias("total")
    ), "sequences")
    pieces = wholes.groupBy(*name, F.shiftright("conv_id", CELL_BITS).alias("piece")).agg(F.array_sort(F.collect_list("conv_id")).alias("members"))

    # The prefixes of one conversation for each sequence, and the empty prefix of each.
    chosen = sequences.select("conv_id", F.col("depth").alias("length"), "weight", "total")
    none = F.lit(None).cast("long")
    empty = sequences.select(
        "conv_id", *(zero.alias(c) for c in name), none.alias("up_p"), none.alias("up_q"), zero.alias("words"), zero.alias("words_before")
    )
    paths = prefixes.unionByName(empty).join(chosen, "conv_id")
    proper = paths.filter(F.col("depth") < F.col("length")).select(*name).distinct()
    leaves = sequences.join(proper, name, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    passing = materialize(paths.join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", zero)), "passing")
    nodes = materialize(passing.groupBy(*name).agg(
        F.min("conv_id").alias("owner"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * F.col("total")).alias("all_words"), F.count(F.lit(1)).alias("n_sequences"),
        F.first("up_p").alias("up_p"), F.first("up_q").alias("up_q"), F.first("words_before").alias("words_before"),
    ), "nodes")
    # A sequence's own nodes are the last of it; its own words are those from the first of them on.
    owned = _owner_of(passing, nodes, ["owner"]).filter("owner = conv_id")
    own = owned.groupBy("conv_id").agg(F.min("words_before").alias("own_from"), F.first("total").alias("total"))
    own = own.select("conv_id", "own_from", (F.col("total") - F.col("own_from")).alias("own_words"))
    shares = passing.select("conv_id", *name).join(own, "conv_id").groupBy(*name).agg(F.sum("own_words").alias("own_words"))
    below = nodes.join(shares, name).join(own.select(F.col("conv_id").alias("owner"), "own_from"), "owner")
    # Of the owner's own words, those before the node are not below it.
    once = F.col("own_words") - (F.col("words_before") - F.col("own_from"))
    saved = F.col("all_words") - F.col("n_convs") * F.col("words_before") - once
    counted = materialize(below.withColumn("saved_tokens", saved), "figures")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    full = counted.join(children, name, "left").select(
        F.col("owner").alias("conv_id"), "depth", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        "p", "q", "up_p", "up_q",
    )
    parents = nodes.select(*name, F.col("owner").alias("parent_conv_id"), "n_sequences")
    asking = full.filter("depth > 0").withColumnsRenamed({"depth": "own_depth", "p": "own_p", "q": "own_q", "up_p": "p", "up_q": "q"})
    below_root = _owner_of(asking.withColumn("depth", F.col("own_depth") - 1), parents, ["parent_conv_id"]).drop(*name)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "p", "q"]
    out = below_root.withColumnsRenamed({"own_depth": "depth", "own_p": "p", "own_q": "q"}).select(*columns).unionByName(
        full.filter("depth = 0").withColumn("parent_conv_id", none).select(*columns)
    )
    trie = materialize(out, "trie")
    ends = pieces.join(trie.select(*name, F.col("conv_id").alias("node")), name).select(
        F.col("node").alias("conv_id"), "depth", "piece", "members"
    )
    return trie.drop("p", "q"), ends


def ends_digest(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256: SHA-256 of each node's list, decimal ids joined by commas.

    Pieces of a list reach one task in order and are hashed one by one: a list is never held whole.
    """
    rows = ends.select(
        F.concat_ws(":", "conv_id", "depth").alias("key"), "conv_id", "depth", "piece",
        F.array_join(F.col("members").cast("array<string>"), ",").alias("list"),
    ).repartition("key").sortWithinPartitions("key", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for conv, depth, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "list"))):
                if key != (conv, depth):
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (conv, depth), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(part.encode())
            yield _digests(done)
        if key is not None:
            yield _digests([(*key, digest.hexdigest())])

    return rows.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["conv_id", "depth", "ends_sha256"]
    )
