import collections
import random

import duckdb
import numpy as np
import pytest
from brute import components, targets
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from earshot.llm import mix, shard, warc
from earshot.llm.components import connected_components
from earshot.llm.neardup import near_vectors
from earshot.plans.sizing import scratch_dir

DATA = "/root/testdata/sf0.001"


def test_components_equal_brute_force(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (None, None), (7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    proper = [(a, b) for a, b in links if None not in (a, b) and a != b]
    nodes = {n for e in proper for n in e}
    assert got == components(nodes, proper)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("n,shards", [(1000, 24), (5, 24), (1, 1), (0, 3)])
def test_shards_are_exact_and_gapless(spark, n, shards):
    df = spark.range(n).select(
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 5 > 0, F.lit("same")).alias("text"), F.lit(9).alias("SLOT")
    )
    rows = shard.shard_rows(df, shards, partition_rows=30).collect()
    assert len(rows) == n
    slots = collections.defaultdict(list)
    for x in rows:
        slots[x.shard].append(x.slot)
    sizes = [len(slots[i]) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = shard.shard_rows(df.repartition(3), shards, partition_rows=30).collect()
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.text or "", x.shard, x.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_shards_look_uniform(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shard.shard_rows(df, 6, partition_rows=200).collect()
    # Chi-square of shard against id range; 25 degrees of freedom.
    table = np.zeros((6, 6))
    for x in rows:
        table[x.shard, x.doc_id // 1000] += 1
    assert ((table - 1000 / 6) ** 2 / (1000 / 6)).sum() < 60
    order = np.corrcoef([x.doc_id for x in rows], [x.slot for x in rows])[0, 1]
    assert abs(order) < 0.06


def test_matrix_has_its_margins_and_spread(spark):
    counts = spark.createDataFrame([(i, 50 + i) for i in range(600)], "part long, n long")
    n = sum(50 + i for i in range(600))
    totals = [n // 5 + (i < n % 5) for i in range(5)]
    rows = {x.part: x.counts for x in shard.communication_matrix(counts, 600, totals, 3).collect()}
    assert all(sum(rows[i]) == 50 + i for i in range(600))
    assert [sum(r[c] for r in rows.values()) for c in range(5)] == totals
    z = [(r[0] - sum(r) / 5) / np.sqrt(sum(r) * 0.2 * 0.8) for r in rows.values()]
    assert 0.85 < np.std(z) < 1.15 and abs(np.mean(z)) < 0.15


def mix_rows(seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(3000):
        source = r.choice(["a", "a", "a", "a", "b", "c", "é", "Z", None])
        rows.append((i, source, None if r.random() < 0.05 else "w " * r.choice([0, 1, 5, 30, 200])))
    return [*rows, (3001, "empty", ""), (None, "a", "x y"), (5, "a", rows[5][2])]


def test_mix_meets_its_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("TARGET", F.lit(1))
    got = mix.mix_sources(df, cell_rows=100).collect()
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    taken = collections.Counter()
    assert len(got) == len(rows)
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source]
        assert 0 <= x.taken <= 3 * x.size and x.taken == x.copies * x.size
        taken[x.source] += x.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 200
    again = mix.mix_sources(df.repartition(5), cell_rows=100)
    count = lambda rs: collections.Counter((x.doc_id, x.source, x.text, x.copies) for x in rs)
    assert count(got) == count(again.collect())
    emitted = mix.emit(again)
    assert emitted.count() == sum(x.copies for x in got) and set(emitted.columns) == {"doc_id", "source", "text"}
    assert mix.mix_sources(df.limit(0)).count() == 0
    assert {x.taken for x in mix.mix_sources(df.filter("source = 'empty'")).collect()} == {0}


def test_archive_round_trip(spark):
    long = "<p>Grüße, " + "x" * 200
    pages = [(5, "u5", long), (2, "u2", long), (9, "u9\r\nbad: y", long), (1, "a", "short"), (3, "b", "short"), (4, None, None), (6, "e", ""),
             (None, "n", long), (2, "u2", long), (8, "w", "\r\n\r\nWARC/1.1\r\n" * 20), (7, "z", "y" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    paths = [scratch_dir(spark, "archive") for _ in range(2)]
    manifests = [warc.write_archive(d, p, file_bytes=2000, shard_bytes=60_000).collect() for d, p in zip((df, df.repartition(3)), paths)]
    assert manifests[0] == manifests[1] and len(manifests[0]) > 1  # the same rows make the same bytes
    rows = warc.read_archive(spark, paths[0]).collect()
    assert len(rows) == len(pages)
    got = collections.Counter((x.page_id, x.payload_bytes, x.record_type, x.refers_to) for x in rows)
    size = len(long.encode())
    assert got == collections.Counter([
        (5, size, "revisit", 2), (2, size, "response", None), (2, size, "response", None), (9, size, "revisit", 2), (None, size, "revisit", 2),
        (1, 5, "response", None), (3, 5, "response", None), (4, 0, "response", None), (6, 0, "response", None),
        (8, len(pages[9][2]), "response", None), (7, 300_000, "response", None),
    ])
    text = {x.page_id: x.payload for x in rows if x.payload is not None}
    assert bytes(text[2]).decode() == long and bytes(text[7]).decode() == "y" * 300_000
    empty = scratch_dir(spark, "archive")
    assert warc.write_archive(df.limit(0), empty).count() == 0


def test_damaged_archive_is_refused(spark):
    path = scratch_dir(spark, "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 500)], "page_id long, url string, html string"), path)
    import glob

    (file,) = glob.glob(f"{path}/part-*.warc.gz")
    data = bytearray(open(file, "rb").read())
    data[-20] ^= 1
    open(file, "wb").write(bytes(data))
    with pytest.raises(Exception, match="manifest"):
        warc.read_archive(spark, path).collect()


def vectors(seed=2):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(60):
        base = r.standard_normal(16)
        for _ in range(int(r.choice([1, 1, 2, 6]))):
            rows.append((base + r.standard_normal(16) * 0.12 * r.random(), int(i % 3)))
    rows += [(rows[0][0], 0)] * 3 + [(rows[0][0] * 2, 0), (rows[0][0], None)]
    out = [(i, [float(np.float32(x)) for x in v], l) for i, (v, l) in enumerate(rows)]
    return out + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [], 1), (905, [1.0], 1), (None, out[0][1], 0)]


@pytest.mark.parametrize("block", [256, 3])
def test_near_vectors_equal_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("x"))
    good = [(i, np.array(v, np.float64), l) for i, v, l in rows if i is not None and v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [
        (a[0], b[0]) for x, a in enumerate(good) for b in good[x + 1 :]
        if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.98
    ]
    n = collections.Counter(i for e in links for i in e)
    parts = components([r[0] for r in rows if r[0] is not None], links)
    got = near_vectors(df, block=block).collect()
    assert len(got) == len(rows) and links
    for x in got:
        assert (x.n_links, x.component_id) == (n[x.vec_id], parts.get(x.vec_id))
        assert x.kept == (x.vec_id == x.component_id)
    assert near_vectors(df.limit(0)).count() == 0


def expected(spark, docs):
    """The pipeline's stages on small rows, each by brute force where it has one."""
    from brute import contamination, jaccard

    from earshot.llm import langid

    plain = spark.createDataFrame(docs, corpus_schema(spark))
    known = langid.identify(plain, langid.fit(plain.filter(~langid.held_out()))).filter("not rejected")
    rows = {x.doc_id: x for x in known.collect()}
    parts = jaccard([(i, x.text) for i, x in rows.items()])[1]
    rows = {i: x for i, x in rows.items() if parts[i] == i}
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    return {i for i, n, hit, _ in contamination([(i, x.text) for i, x in rows.items()], items) if not (hit > 0 and 20 * hit >= n)}


def corpus_schema(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").schema


#: Names that the operators give their own columns, and some that are odd.
CLASHES = [
    "size", "score", "n_words", "SHARD", "slot", "Rejected", "lang_pred", "copies", "target", "taken", "source_size", "hit_spans", "item_ids",
    "contaminated", "component_id", "set_aside", "tokens", "cls", "row", "n", "a.b", "id",
]


def test_pipeline_stages_leave_other_columns_alone(spark):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    df = source.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in CLASHES])
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_dir(spark, "stage")
        stage(spark, df, DATA).write.parquet(path)
        df = spark.read.parquet(path)
        if name == "shards":
            columns = [c for c in columns if c.lower() not in ("shard", "slot")] + ["shard", "slot"]
        assert df.columns == columns
        kept = [c for c in CLASHES if c in columns and c.lower() not in ("shard", "slot")]
        rows = df.select("doc_id", *[F.col(f"`{c}`") for c in kept]).collect()
        assert rows and all(x[i + 1] == f"{c}-{x[0]}" for x in rows for i, c in enumerate(kept))


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, repeated ids, very long texts and empty tables."""
    schema = corpus_schema(spark)
    real = [tuple(x) for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    at = schema.names.index
    blank = lambda **v: tuple(v.get(n) for n in schema.names)
    long = " ".join(x[at("text")] or "" for x in real[:60])
    odd = [
        blank(), blank(doc_id=9001), blank(doc_id=9002, text=""), blank(text="no id at all"), blank(text="no id at all"),
        blank(doc_id=9003, text=long, source="s"), blank(doc_id=9004, text="one text", lang="en"), blank(doc_id=9004, text="another one", lang="en"),
        blank(doc_id=9004, text="another one", lang="en"), real[0], real[0],
    ]
    df = spark.createDataFrame(real + odd, schema)
    by_id = lambda d: collections.Counter(x.doc_id for x in d.select("doc_id").collect())
    apart = by_id(corpus_pipeline.distinct(spark, df, DATA))
    assert apart[None] == 3 and all(n == 1 for i, n in apart.items() if i is not None)
    assert {9001, 9002, 9003, 9004} <= set(apart)
    known = by_id(corpus_pipeline.recognised(spark, df, DATA))
    assert not {9001, 9002} & set(known) and known[real[0][at("doc_id")]] in (0, 3)
    clean = by_id(corpus_pipeline.uncontaminated(spark, df, DATA))
    assert {9001, 9002} <= set(clean) and clean[None] == 3
    assert by_id(corpus_pipeline.mixed(spark, df, DATA)).total() > 0
    rows = corpus_pipeline.sharded(spark, df, DATA).collect()
    assert collections.Counter(x.doc_id for x in rows) == by_id(df)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df.limit(0), DATA)
        assert out.count() == 0 and out.columns[: len(schema.names)] == schema.names


def test_pipeline_equals_brute_force(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    kept = expected(spark, docs)
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, DATA)
        assert df.columns == corpus_schema(spark).names
    assert {x.doc_id for x in df.select("doc_id").collect()} == kept
    out = corpus_pipeline.run(spark, DATA)
    rows = out.collect()
    assert {x.doc_id for x in rows} <= kept
    want = {x.doc_id: x.copies for x in mix.mix_sources(df).collect()}
    assert collections.Counter(x.doc_id for x in rows) == collections.Counter({i: n for i, n in want.items() if n})
    sizes = collections.Counter(x.shard for x in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1


@pytest.mark.parametrize("name", ["op2_warc", "op3_neardup", "op4_decontaminate", "op7_jaccard", "op10_mix"])
def test_query_equals_its_sql(spark, name):
    import pandas as pd
    from check import TABLES, canonical

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = entry.queries()[name](spark, DATA)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    rel = con.sql(entry.oracle_sql()[name])
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["op1_shard", "op5_toxicity", "op6_langid", "op8_html", "op9_substring"])
def test_query_covers_its_table(spark, name):
    df = entry.queries()[name](spark, DATA)
    key = "page_id" if name == "op8_html" else "doc_id"
    table = "pages" if name == "op8_html" else "documents"
    n = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert (df.select(key).distinct().count() == n) or name == "op9_substring" and df.count() > 0
