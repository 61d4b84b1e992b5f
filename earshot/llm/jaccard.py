"""Documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, and their components.

A pair must agree on most of its smallest hashes. So of each document only the smallest
share of its shingle hashes travels, packed (see packets); a document goes on if enough
of these occur in other documents too. That drops what shares a passage or nothing with
others, and loses no pair (see _region).

Of the few that go on, equal sets are one class. A class's prefix is so many of its
rarest shingles, by how many classes have them, that a pair must share one of them;
passages that many documents quote are frequent and so in hardly any prefix. Classes
that share a shingle of their prefixes lie in one cluster, and only pairs inside a
cluster can link. Classes of a cluster are banded by set size, so that a class
can only link within its band and the next; bands are cut into blocks, and a tile is a
pair of blocks. In a tile a bitmap of hashed shingles is made for each set, as wide as
the sets of its bands ask for; differing bits bound the overlap from above, and what
passes is decided by intersecting the sorted arrays. Pairs already joined are skipped.

A cluster larger than a block first compares everybody with its leader. What links to
it needs no tile with its like: a large group of near copies costs one comparison each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import packets
from earshot.llm import textbytes as tb
from earshot.llm.components import connected_components
from earshot.llm.frames import runs_by_key
from earshot.plans.sizing import broadcast_if_bounded, materialize

WORDS = 5
PERCENT = 80
BLOCK = 128
WIDEST = 1 << 16
BUCKET_BYTES = 32_000_000  # of text whose hashes a bucket gets, at most
BROADCAST_BYTES = 64_000_000


def _sets(part: tb.Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin."""
    hashed, text = tb.shingles(tb.words(part, tb.NOT_SPACE), words)
    return tb.distinct_per_text(hashed, text, len(part))


def _region(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its smallest hashes a set of n sends: twice the share that a pair may differ in.

    With similarity t, sets x and y of a pair miss at most (1 - t) of either in the other,
    and |y| >= t |x|. Up to the smaller of the two regions' largest hash both are known
    whole, so x finds there at least 2 (1 - t) |y| - (1 - t) |y| >= (1 - t) t |x| hashes of y.
    """
    return -(-n * 2 * (100 - percent) // 100)


def count_shingles(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and n_shingles long, the size of each document's set; 0 without words or text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.zeros(0, np.int64)]
            for part in tb.slices(batch.column(1)):
                counts.append(np.diff(_sets(part, words)[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts))], names=["doc_id", "n_shingles"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long")


def _packer(words: int, percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in tb.slices(batch.column(1), 2 * tb.SLICE_BYTES):
                tokens, begins = _sets(part, words)
                n = np.diff(begins)
                sent = _region(n, percent)
                # Sets are sorted: the smallest come first.
                place = np.arange(len(tokens)) - np.repeat(begins[:-1], n)
                keep = place < np.repeat(sent, n)
                of = np.repeat(np.arange(len(part)), n)[keep]
                out = packets.pack(tokens[keep], of, np.zeros(len(of), np.uint8), ids[part.first : part.first + len(part)], n, buckets)
                if out is not None:
                    yield out

    return run


def _matched(groups: int):
    """How many of each document's hashes in a bucket occur in other documents."""

    def work(bucket: packets.Bucket) -> pa.RecordBatch | None:
        at = np.flatnonzero(bucket.shared)
        if not len(at):
            return None
        order = np.lexsort((bucket.sizes[at], bucket.ids[at]))
        ids, sizes = bucket.ids[at][order], bucket.sizes[at][order]
        heads = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (sizes[1:] != sizes[:-1])]))
        return packets.scatter(ids[heads], sizes[heads], np.diff(np.append(heads, len(ids))).astype(np.int32), groups)

    return work


def _enough(percent: int):
    """The documents of which enough hashes occur elsewhere."""

    def work(ids: np.ndarray, sizes: np.ndarray, matched: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((sizes, ids))
        ids, sizes, matched = ids[order], sizes[order].astype(np.int64), matched[order]
        heads = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (sizes[1:] != sizes[:-1])]))
        total = np.add.reduceat(matched.astype(np.int64), heads)
        good = total * 10_000 >= sizes[heads] * ((100 - percent) * percent)
        return pa.RecordBatch.from_arrays([pa.array(np.unique(ids[heads][good]))], names=["id"])

    return work


def _set_maker(words: int):
    names = ["id", "n", "d1", "d2", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch.column(1)):
                tokens, begins = _sets(part, words)
                n = np.diff(begins)
                at = np.flatnonzero(n)
                rows = [tokens[begins[i] : begins[i + 1]] for i in at.tolist()]
                digests = [(int(tb.mix(r).sum(dtype=np.uint64)), int(tb.mix(r ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))) for r in rows]
                signed = lambda i: pa.array(np.array([d[i] for d in digests], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, len(part)).take(pa.array(at)), pa.array(n[at].astype(np.int32)), signed(0), signed(1),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ], names=names)

    return run


_RARITY = np.dtype([("count", "<u4"), ("token", "<u8")])


def _class_packer(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            for a in range(0, batch.num_rows, 500):
                own = sizes[a : a + 500]
                tokens = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("tokens")[a : a + 500]])
                of = np.repeat(np.arange(len(own)), own)
                yield packets.pack(tokens, of, np.zeros(len(of), np.uint8), batch.column("cls")[a : a + 500].to_numpy(), own, buckets)

    return run


def _frequent(groups: int):
    """The shingles that several classes have, with their counts, class by class."""

    def work(bucket: packets.Bucket) -> pa.RecordBatch | None:
        at = np.flatnonzero(bucket.shared)
        if not len(at):
            return None
        rarity = np.empty(len(at), _RARITY)
        rarity["count"], rarity["token"] = bucket.count[at], bucket.tokens[at]
        return packets.scatter(bucket.ids[at], bucket.sizes[at], rarity, groups)

    return work


def _prefix_of(percent: int):
    def work(ids: np.ndarray, sizes: np.ndarray, rarity: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((rarity["token"], rarity["count"], ids))
        ids, n, tokens = ids[order], sizes[order].astype(np.int64), rarity["token"][order]
        heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        shared = np.diff(np.append(heads, len(ids)))
        # Shingles of one class alone come first of all, and match nothing.
        more = n[heads] - -(-n[heads] * percent // 100) + 1 - (n[heads] - shared)
        keep = np.arange(len(ids)) - np.repeat(heads, shared) < np.repeat(more, shared)
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(tokens[keep].view(np.int64))], names=["cls", "token"])

    return work


def _prefixes(classes: DataFrame, percent: int, buckets: int) -> DataFrame:
    """cls and token: the shingles of each class's prefix that other classes have."""
    packed = classes.mapInArrow(_class_packer(buckets), packets.PACKED)
    found = packets.shared_tokens(packed, buckets, np.uint8, _frequent(buckets), packets.SCATTERED)
    return packets.gather(found, buckets, (np.int32, _RARITY), _prefix_of(percent), "cls long, token long")


def _overlaps(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = _overlaps(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap of hashed shingles per set, twice as wide as the largest set up to a bound."""
    width = min(WIDEST, max(512, 1 << (2 * max(map(len, sets)) - 1).bit_length()))
    out = np.zeros((len(sets), width // 64), np.uint64)
    for row, s in zip(out, sets):
        bits = np.zeros(width, bool)
        bits[(s % np.uint64(width)).astype(np.int64)] = True
        row[:] = np.packbits(bits).view(np.uint64)
    return out


def tile_links(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join up what is linked in a tile. With two sides only pairs across are asked for."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sides, sets = ids[order], sides[order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets], np.int64)
    maps = _bitmaps(sets)
    group = np.arange(len(sets))
    across = bool((sides != sides[0]).any())
    out = []
    for i in range(len(sets) - 1):
        stop = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
        rest = np.arange(i + 1, stop)
        rest = rest[group[rest] != group[i]]
        if across:
            rest = rest[sides[rest] != sides[i]]
        if not len(rest):
            continue
        # A differing bit is the mark of a shingle that only one of the two has.
        differ = np.bitwise_count(maps[rest] ^ maps[i]).sum(axis=1, dtype=np.int64)
        bound = (n[i] + n[rest] - differ) // 2
        for j in rest[100 * bound >= percent * (n[i] + n[rest] - bound)].tolist():
            if group[j] != group[i] and _linked(sets[i], sets[j], percent):
                out.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return out


def _tiler(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs_by_key(batches):
            if tile.num_rows < 2:
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile.column("tokens")]
            links = tile_links(tile.column("cls").to_numpy(), tile.column("side").to_numpy(), sets, percent)
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"]
                )

    return run


def _leader_test(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda name: [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(name)]
            hit = [_linked(a, b, percent) for a, b in zip(read("tokens"), read("leader"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cluster"), batch.column("cls"), batch.column("n"), pa.array(hit, pa.bool_())], names=["cluster", "cls", "n", "linked"]
            )

    return run


def _large_clusters(members: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links to the leaders of large clusters, and rows (key, side, cls) of the tiles that are still to do."""
    leaders = classes.join(broadcast_if_bounded(members.filter("cls = cluster").select("cls", "cluster")), "cls").select(
        "cluster", F.col("tokens").alias("leader")
    )
    # One set per large cluster: broadcast only if their bytes are few.
    size = leaders.agg(F.sum(F.octet_length("leader"))).first()[0] or 0
    leaders = F.broadcast(leaders) if size <= BROADCAST_BYTES else leaders
    pairs = classes.join(broadcast_if_bounded(members), "cls").join(leaders, "cluster")
    tested = materialize(
        pairs.select("cluster", "cls", "n", "tokens", "leader").mapInArrow(_leader_test(percent), "cluster long, cls long, n int, linked boolean"),
        "leaders",
    )
    links = tested.filter("linked and cls <> cluster").select(F.col("cluster").alias("a"), F.col("cls").alias("b"))
    apart = tested.filter("not linked").select("cluster").distinct()
    banded = tested.join(apart, "cluster").withColumn("band", F.floor(F.log(F.col("n")) / math.log(100 / percent)).cast("int"))
    sizes = banded.groupBy("cluster", "band", "linked").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # At most two entries per band, and a band is a factor of set size.
    layout = sizes.groupBy("cluster").agg(F.collect_list(F.struct("band", "linked", "blocks")).alias("layout"))
    placed = banded.join(layout, "cluster").withColumn(
        "block", F.expr("element_at(filter(layout, e -> e.band = band and e.linked = linked), 1).blocks")
    ).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("block")).cast("int"))
    others = F.expr("""flatten(transform(filter(layout, e -> abs(e.band - band) <= 1 and not (e.linked and linked)),
        e -> transform(sequence(0, e.blocks - 1), i -> struct(e.band as band, e.linked as linked, i as block))))""")
    own = F.struct("band", "linked", "block")
    spread = placed.withColumn("own", own).withColumn("other", F.explode(others))
    tiles = spread.select(
        F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "cls",
    )
    return links, tiles


def similar_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id long and component_id long of every document in a component of two or more.

    Shingles are runs of `words` words (anything but ASCII white space, A-Z lower-cased);
    a text of fewer words is one shingle as a whole; one without words has none and links
    with nothing, like a null. Rows with a null id take no part; rows that share an id
    are one document, which has the links of each of its texts. Ties cannot arise: equal
    sets are one class. An empty table has no components. Only the two columns are read,
    so others may have any name. component_id is the smallest id reachable by links. Shingles are
    64-bit hashes: a false link would take a fifth of a set to collide.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).dropna()
    buckets = _buckets(rows)
    packed = rows.mapInArrow(_packer(words, percent, buckets), packets.PACKED)
    groups = buckets // 4
    found = packets.shared_tokens(packed, buckets, np.uint8, _matched(groups), packets.SCATTERED)
    chosen = materialize(packets.gather(found, groups, (np.int32, np.int32), _enough(percent), "id long"), "chosen")
    made = rows.join(broadcast_if_bounded(chosen), "id").mapInArrow(_set_maker(words), "id long, n int, d1 long, d2 long, tokens binary")
    # The number of a row, once written, names its set; sets are not moved to find equal ones.
    sets = materialize(made.withColumn("row", F.monotonically_increasing_id()), "sets")
    same = materialize(sets.groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "row")).alias("first")).select("n", "d1", "d2", "first.*"), "classes")
    reps = same.select(F.col("row").alias("cls"), F.col("id").alias("rep"))
    belongs = sets.select("id", "n", "d1", "d2").join(same.withColumnRenamed("id", "rep"), ["n", "d1", "d2"]).select("id", "rep").distinct()
    classes = materialize(
        sets.select(F.col("row").alias("cls"), "n", "tokens").join(broadcast_if_bounded(reps.select("cls")), "cls"), "representatives"
    )
    prefixes = materialize(_prefixes(classes, percent, groups), "prefixes")
    least = prefixes.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low < high")
    clusters = connected_components(prefixes.join(least, "token").filter("cls > low").select("low", "cls"), "low", "cls")
    members = materialize(clusters.select(F.col("node").alias("cls"), F.col("component").alias("cluster")), "clusters")
    counts = members.groupBy("cluster").agg(F.count("*").alias("m"))
    large = materialize(counts.filter(F.col("m") > BLOCK).select("cluster"), "large")
    small = members.join(broadcast_if_bounded(large), "cluster", "left_anti")
    links, tiles = _large_clusters(materialize(members.join(broadcast_if_bounded(large), "cluster"), "large-members"), classes, percent)
    tiles = materialize(tiles.unionByName(small.select(F.xxhash64(F.lit("small"), "cluster").alias("key"), F.lit(0).alias("side"), "cls")), "tiles")
    dealt = classes.select("cls", "tokens").join(broadcast_if_bounded(tiles), "cls").repartition("key").sortWithinPartitions("key")
    within = dealt.select("key", "side", "cls", "tokens").mapInArrow(_tiler(percent), "a long, b long")
    linked = links.unionByName(within)
    for end in ("a", "b"):
        linked = linked.join(reps.select(F.col("cls").alias(end), F.col("rep").alias(f"{end}_rep")), end)
    twins = belongs.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    edges = linked.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).unionByName(twins)
    return connected_components(edges, "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def _buckets(rows: DataFrame) -> int:
    """Buckets to deal hashes into: some for every shuffle partition, more for more text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(packets.buckets_of(rows.sparkSession), 4 * -(-size // (4 * BUCKET_BYTES)))
