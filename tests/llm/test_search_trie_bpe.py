import collections
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import ALNUM, LOWER, NOT_SPACE
from pyspark.sql import functions as F

from earshot.llm import bpe, search, trie
from earshot.llm import textbytes as tb

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- prefix trie -------------------------------------------------------------------


def brute_trie(rows, rebuilt=True):
    """Every node by walking all prefixes of all conversations."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    if rebuilt:
        whole = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            base = c - int(math.fmod(c, 20))
            whole[c] = own.get(base, [])[:h] + turns[h:]
        own = whole
    members = collections.defaultdict(list)
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    below = collections.Counter()
    leaves = collections.Counter()
    for p, cs in members.items():
        words = len(NOT_SPACE.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]] += (len(cs) - 1) * words
            leaves[p[:d]] += p not in children
    return {
        (min(cs), len(p)): (
            min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], below[p],
            hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(own[c]) == len(p)).encode()).hexdigest(),
        )
        for p, cs in members.items()
    }


def found_trie(spark, rows, rebuilt=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = trie.ordered_turns(df.withColumn("place", F.lit("clash")).withColumn("DIGEST", F.lit(1)))
    nodes, ends = trie.prefix_trie(trie.share_openings(turns) if rebuilt else turns)
    empty = hashlib.sha256(b"").hexdigest()
    digests = {(x.conv_id, x.depth): x.ends_sha256 for x in trie.ends_digest(ends).collect()}
    out = {}
    for x in nodes.collect():
        key = x.conv_id, x.depth
        assert key not in out
        out[key] = (x.parent_conv_id, x.n_convs, x.n_children, x.n_leaves, x.saved_tokens, digests.get(key, empty))
    return out


def some_conversations(n=90, seed=3):
    r = random.Random(seed)
    rows = []
    for c in range(-25, n):
        for t in range(r.choice([1, 1, 2, 3, 4, 6])):
            text = r.choice(["a", "a b", "", None, "c d e", "a\tb\x0bc"])
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "user", None, "assistant"]), text))
    rows += [(3, 0, "user", "a")] * 3 + [(None, 0, "user", "lost")]
    # Many copies of one conversation, from one group of twenty on.
    rows += [(1000 + c, t, "user", f"turn {t}") for c in range(150) for t in range(5)]
    return rows


@pytest.mark.parametrize("rebuilt", [True, False])
def test_trie_equals_brute_force(spark, monkeypatch, rebuilt):
    monkeypatch.setattr(trie, "BUSY", 20)
    rows = some_conversations()
    assert found_trie(spark, rows, rebuilt) == brute_trie(rows, rebuilt)


def test_trie_of_long_conversations_goes_through_cells(spark, monkeypatch):
    monkeypatch.setattr(trie, "CELL_BITS", 2)
    r = random.Random(5)
    rows = [(c, 7 * t - 40, "u", r.choice("ab") if t > 30 else "same") for c in range(12) for t in range(60 if c else 300)]
    assert found_trie(spark, rows, False) == brute_trie(rows, False)


def test_trie_without_conversations_has_no_nodes(spark):
    assert found_trie(spark, []) == {} == brute_trie([])
    lost = [(None, 1, "u", "x")]
    assert found_trie(spark, lost) == {}


def test_a_turnless_conversation_ends_at_the_root(spark):
    # 1 takes three turns of conversation 0, which there is none of, and loses all of its own.
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1, 20)}
    c = next(c for c, h in heads.items() if h >= 1)
    rows = [(c, 0, "u", "x")]
    assert found_trie(spark, rows) == brute_trie(rows)
    assert list(found_trie(spark, rows)) == [(c, 0)]


# --- search ------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    words = [(i, ALNUM.findall((t or "").translate(LOWER))) for i, t in docs if i is not None]
    words = [(i, w) for i, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    counts = [(i, len(w), collections.Counter(w)) for i, w in words]
    df = collections.Counter(t for _, _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(ALNUM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, n, c in counts:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms if t in c
            )
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found_search(spark, docs, items, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("TERM", F.lit(1))
    index = search.build_index(frame.repartition(5), **options)
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("rank", F.lit(0))
    return sorted(tuple(r) for r in search.search(index, asked).select("item_id", "rank", "doc_id", "score").collect())


def test_a_file_of_the_index_holds_few_shards(spark):
    rows = [(i, f"word{i} text{i % 7} " + "filler " * 300) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = search.build_index(frame, shard_bytes=1_000_000)
    per_file = index.shards.groupBy(F.input_file_name()).count().collect()
    assert index.shards.count() > 4 and max(r["count"] for r in per_file) <= 2
    queries = spark.createDataFrame([(1, "word17"), (2, "text3 word10")], "item_id long, text string")
    got = {(r.item_id, r.rank): r.doc_id for r in search.search(index, queries, 1).collect()}
    assert got == {(1, 1): 17, (2, 1): 10}


def some_texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "Straße", "日本", "X1"]
    weights = [1 / (1 + i) for i in range(len(words))]
    return [" ".join(r.choices(words, weights, k=r.choice([1, 5, 20, 60]))) for _ in range(n)]


@pytest.mark.parametrize("shard_bytes", [2_000, 10_000_000])
def test_search_equals_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(search, "BLOCK", 8)
    docs = list(enumerate(some_texts(700, 1)))
    # Copies tie, ids repeat, and one text is very long.
    docs += [(2000 + i, docs[7][1]) for i in range(30)] + [(5, docs[5][1]), (6, "w1 w2 other")]
    docs += [(3000, " ".join(some_texts(3000, 2))), (3001, None), (3002, ""), (3003, "-- !"), (None, "w1 w2")]
    items = list(enumerate(some_texts(25, 4))) + [(100, None), (101, "..."), (102, "nowhere"), (None, "w1"), (3, "w3 W4 w3")]
    assert found_search(spark, docs, items, shard_bytes=shard_bytes) == brute_search(docs, items)


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "TERMS_AT_ONCE", 40)
    docs, items = list(enumerate(some_texts(200, 8))), list(enumerate(some_texts(20, 9)))
    assert found_search(spark, docs, items) == brute_search(docs, items)


def test_search_of_empty_tables(spark):
    assert found_search(spark, [], [(1, "w1")]) == []
    assert found_search(spark, [(1, None)], [(1, "w1")]) == []
    assert found_search(spark, [(1, "w1")], []) == []


def one_shard(docs):
    words = [ALNUM.findall(t.translate(LOWER)) for _, t in docs]
    totals = len(docs), sum(map(len, words))
    builder = search._Builder(*totals)
    ids = np.array([i for i, _ in docs])
    for part in tb.slices(pa.array([t for _, t in docs])):
        builder.add(ids[part.first : part.first + len(part)], part)
    row = builder.shard()
    return search.Shard({n: memoryview(row.column(n)[0].as_buffer()) for n in search._PARTS}, *totals)


def test_block_maxima_spare_most_blocks():
    # One rare term decides; the common ones lie in hundreds of blocks.
    docs = [(i, "common often " + ("rare rare" if i % 5000 == 7 else "x") + " y" * (i % 11)) for i in range(40_000)]
    shard = one_shard(docs)
    terms = [b"common", b"often", b"rare"]
    lists = shard.find(terms, search._hashes(terms))
    got, scores = search.best_of(shard, lists, np.array([3, 4, 9000]), 5)
    assert set(shard.ids[got].tolist()) <= {i for i, _ in docs if i % 5000 == 7} and len(got) >= 5
    assert shard.decompressed < 30 < int(shard.lists[-1])


def test_wide_gaps_and_high_counts_survive_compression():
    docs = [(i, "a " * (70_000 if i == 5 else 300 if i == 9 else 1) + ("b" if i in (0, 69_999) else "")) for i in range(70_000)]
    shard = one_shard(docs)
    at = shard.find([b"a", b"b", b"c"], search._hashes([b"a", b"b", b"c"]))
    assert at[2] == -1
    doc, gain = shard.whole(int(at[1]))
    assert doc.tolist() == [0, 69_999]
    doc, gain = shard.whole(int(at[0]))
    assert doc.tolist() == list(range(70_000))
    m = shard.m
    assert gain[5] == 10**9 * 70_000 // (1000 * 70_000 + 8 * int(m[5])) and gain[9] == 10**9 * 300 // (300_000 + 8 * int(m[9]))


# --- byte-level BPE ----------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(open(PATH, encoding="utf-8").read())


def naive_merge(vocab, piece):
    """The leftmost lowest-ranked merge, found anew each time."""
    ids = [vocab.byte_id[b] for b in piece]
    while True:
        ranked = [(vocab.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in vocab.merges]
        if not ranked:
            return ids
        _, i = min(ranked)
        ids[i : i + 2] = [vocab.merges[ids[i], ids[i + 1]][1]]


def test_both_trees_equal_naive_merging(vocab):
    r = random.Random(1)
    pieces = [bytes(r.choice(b"theraning sto\xc3\xa9") for _ in range(r.randrange(1, 66))) for _ in range(400)]
    for piece in pieces:
        assert vocab.merge(piece) == naive_merge(vocab, piece)
    for leaves in (2, 4, 16, 64):
        some = [p for p in pieces if len(p) <= leaves + 1]
        ids, counts = vocab.merge_many(some, leaves)
        assert np.split(ids, np.cumsum(counts)[:-1]) is not None
        ends = np.cumsum(counts).tolist()
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [naive_merge(vocab, p) for p in some]


def test_tree_gives_the_leftmost_lowest():
    tree = bpe.PairTree([5, None, 3, 3, 9])
    assert tree.root() == 2
    tree.put(2, None)
    assert tree.root() == 3
    tree.put(3, 9)
    tree.put(0, 9)
    assert tree.root() == 0
    for i in range(5):
        tree.put(i, None)
    assert tree.root() == -1


def test_every_character_is_cut_as_the_library_does(library, vocab):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}." for c in chars[i : i + 40]) for i in range(0, len(chars), 40)]
    for a in range(0, len(texts), 5000):
        theirs = library.encode_batch(texts[a : a + 5000], add_special_tokens=False)
        for text, mine, e in zip(texts[a:], vocab.encode_many(texts[a : a + 5000]), theirs):
            assert mine.tolist() == e.ids, ascii(text)


ODD = [
    None, "", " ", "\n\n  x", "it's we'LL they'd  '", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|",
    "  <|endoftext|>  ", "é" * 70, "a" * 5000, "ab" * 3000, " " * 3000 + "x", "日本語のテキスト", "͸㐀�\x00\x1c\x85", "2²½٣", "👩‍👩‍👧",
]


def test_texts_equal_the_library_and_come_back(spark, library):
    r = random.Random(2)
    texts = ODD + ["".join(r.choices("ab '\n\t  sthelr.1é<|>", k=r.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("IDS", F.lit("clash")).repartition(3)
    vocabulary = bpe.read_vocabulary(PATH)
    coded = bpe.decode_ids(bpe.encode_texts(df, vocabulary), vocabulary)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == len(texts)
    for x in rows:
        if texts[x.doc_id] is None:
            assert x.ids is None and x.decoded is None
        else:
            ids = library.encode(texts[x.doc_id], add_special_tokens=False).ids
            assert x.ids == ids and x.decoded == texts[x.doc_id] == library.decode(ids, skip_special_tokens=False)


def test_any_ids_decode_as_in_the_library(library, vocab):
    r = random.Random(3)
    for _ in range(2000):
        ids = [r.randrange(50_257) for _ in range(r.randrange(12))]
        assert vocab.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_ids_outside_the_vocabulary_are_an_error(spark):
    vocabulary = bpe.read_vocabulary(PATH)
    for bad in ([50_257], [-1], [None]):
        with pytest.raises(Exception, match="outside of the vocabulary"):
            bpe.decode_ids(spark.createDataFrame([(bad,)], "ids array<int>"), vocabulary).collect()


def test_empty_tables_and_long_texts_in_runs(spark, monkeypatch, library, vocab):
    vocabulary = bpe.read_vocabulary(PATH)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode_ids(bpe.encode_texts(none, vocabulary), vocabulary).collect() == []
    monkeypatch.setattr(bpe, "RUN", 100)
    monkeypatch.setattr(bpe, "REMEMBERED_PIECES", 150)
    text = " ".join(some_texts(200, 3)) + "<|endoftext|>" + "zq" * 500
    assert vocab.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level"):
        bpe.read_vocabulary(str(other))
