"""The registered queries of the operators here, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.registry import query
from earshot.llm import bpe, htmltext, jaccard, langid, neardup, search, substring, toxicity, trie, warc
from earshot.llm.decontam import find_passages
from earshot.llm.mix import mix_sources
from earshot.llm.shard import shard_rows
from earshot.plans.sizing import materialize, scratch_dir

SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_shard")
def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 and its slot there."""
    whole = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"),
        F.xxhash64("text").alias("h"),
    )
    return shard_rows(docs, SHARDS, text="h").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


WINDOW_WORDS = 13
_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query("op4_decontaminate", f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW_WORDS}) AS n,
         array_to_string(list_slice(w, s, s + least(len(w), {WINDOW_WORDS}) - 1), ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), {WINDOW_WORDS}) + 2)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window, and the items they come from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_passages(docs, table(spark, sf_dir, "benchmark"), window=WINDOW_WORDS)
    return contamination(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def contamination(found: DataFrame) -> DataFrame:
    """Figures of a document from its hit spans: contaminated if they hold a twentieth of its words."""
    n_hit = F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.past - s.first)")
    names = F.array_sort(F.expr("transform(item_ids, i -> cast(i as string))"))
    return found.withColumns({
        "n_hit": n_hit, "n_items": F.size("item_ids").cast("long"), "items_sha256": F.sha2(F.array_join(names, ","), 256),
    }).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


@query("op10_mix", r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, row_number() OVER f AS place,
        CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remain,
        CAST(sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights_left
      FROM w WINDOW f AS (ORDER BY source_size / weight, source ASC NULLS LAST)),
l AS (SELECT place, remain, weights_left FROM o
      WHERE source_size > 0 AND remain * weight <= 3 * source_size * weights_left ORDER BY place LIMIT 1),
t AS (SELECT o.source, o.source_size,
        CASE WHEN l.place IS NULL OR o.place < l.place THEN CAST(3 * o.source_size AS DOUBLE)
             ELSE CAST(l.remain * o.weight AS DOUBLE) / l.weights_left END AS target
      FROM o LEFT JOIN l ON true),
c AS (SELECT *, md5('7|' || doc_id) AS draw, length(bin(size)) AS digits, substr(bin(size), 1, 3) AS lead FROM d),
n AS (SELECT source, digits, lead, ceil(count(*) / 500) AS slices FROM c GROUP BY 1, 2, 3),
p AS (SELECT c.*, CAST(('0x' || substr(draw, 1, 8)) AS BIGINT) % slices AS slice FROM c JOIN n
      ON c.source IS NOT DISTINCT FROM n.source AND c.digits = n.digits AND c.lead = n.lead),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY digits DESC, lead DESC, slice, size DESC, draw) AS place FROM p),
x AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.place,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        CAST(('0x' || substr(md5('offset-7|' || coalesce('s' || r.source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS shift
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(place * rate + shift) - floor((place - 1) * rate + shift)) AS BIGINT) AS taken
FROM x
""")
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of a mix of the sources by weights 1, 2, 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_langid")
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op8_html")
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", "n_chars"
    )


@query("op2_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN page_id <> g.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> g.first THEN g.first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    path = scratch_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_neardup", """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = node LEFT JOIN n ON vec_id = a
""")
def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal embeddings of one label: links and components."""
    return neardup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_substring")
def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the documents that repeats in another one."""
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


@query("op7_jaccard", r"""
WITH RECURSIVE w AS (SELECT doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS g, len(w) AS words
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d JOIN c ON d.doc_id = node LEFT JOIN n ON n.doc_id = d.doc_id
""")
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size of every document and the component of near copies it is in."""
    docs = table(spark, sf_dir, "documents")
    parts = jaccard.similar_documents(docs)
    return jaccard.count_shingles(docs).join(parts, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from the labels of four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~langid.held_out())
    found = toxicity.score(docs.withColumn("held_out", langid.held_out()), toxicity.fit(docs, labels))
    return found.select("doc_id", "held_out", "score", "predicted", "evidence")


@query("op11_trie", r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        substr(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), 1, 32)) AS j FROM t),
crc AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, 3988292384::BIGINT * (v & 1))))) AS v
      FROM (SELECT DISTINCT conv_id FROM t)),
c AS (SELECT conv_id, v % 4 AS h, conv_id - conv_id % 20 AS base FROM crc),
r AS (SELECT c.conv_id, 0 AS part, j, role, text FROM c JOIN o ON o.conv_id = base AND j <= h
      UNION ALL SELECT c.conv_id, 1, j, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND j > h),
q AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY part, j) AS s FROM r GROUP BY 1),
a AS (SELECT c.conv_id, coalesce(s, []) AS s FROM c LEFT JOIN q USING (conv_id)),
w AS (SELECT conv_id, CAST(d AS BIGINT) AS depth, md5(CAST(list_slice(s, 1, d) AS VARCHAR) || d) AS node, len(s) AS n,
        CASE WHEN d > 0 THEN CAST(len(regexp_extract_all(s[d].text, '[^\x20\x09-\x0D]+')) AS BIGINT) ELSE 0 END AS words
      FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM a)),
up AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM w),
nodes AS MATERIALIZED (SELECT node, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
        coalesce(string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM up GROUP BY 1, 2),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
above AS (SELECT node AS below, node FROM nodes UNION ALL SELECT below, parent FROM above JOIN nodes USING (node) WHERE parent IS NOT NULL),
sums AS (SELECT above.node, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (kids.node IS NULL) AS n_leaves
  FROM above JOIN nodes ON nodes.node = below LEFT JOIN kids ON kids.node = below GROUP BY 1)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.node = x.parent LEFT JOIN kids ON kids.node = x.node JOIN sums ON sums.node = x.node
""")
def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of conversations that share openings."""
    turns = trie.ordered_turns(table(spark, sf_dir, "conversations"))
    nodes, ends = trie.prefix_trie(trie.share_openings(materialize(turns, "ordered")))
    return nodes.join(trie.ends_digest(ends), ["conv_id", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))
    )


BEST = 10


@query("op12_search", f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS words FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
n AS MATERIALIZED (SELECT doc_id, r, words, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
f AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM n) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, g GROUP BY term, docs),
s AS (SELECT item_id, n.r, n.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n.n * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN n ON n.r = f.r, g GROUP BY 1, 2, 3),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= {BEST}
""")
def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item."""
    index = search.build_index(table(spark, sf_dir, "documents"))
    return search.search(index, table(spark, sf_dir, "benchmark"), BEST)


@query("op13_bpe")
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as tokens of a public vocabulary, and back."""
    import public_tokenizers

    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.encode_texts(docs, vocabulary).drop("text")
    return bpe.decode_ids(coded, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
