import random

import numpy as np
import pyarrow as pa
import pytest
from brute import ALNUM, LOWER, NOT_SPACE, contamination, jaccard, shingles

from earshot.llm import htmltext, jaccard as jac, langid, packets, substring, toxicity
from earshot.llm import textbytes as tb
from earshot.llm.decontam import find_passages
from earshot.llm.queries import contamination as figures

DOCS = "doc_id long, text string"
ODD = [None, "", " \t\n", "one", "One  TWO\vthree", "é È ß", " x y", "a" * 5000, "ÀB c.D-e_f 12"]


def vocabulary(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeéüñ") for _ in range(r.randint(2, 8))) for _ in range(n)]


def prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.mark.parametrize("table,pattern", [(tb.NOT_SPACE, NOT_SPACE), (tb.ALNUM, ALNUM)])
@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_words_are_those_of_the_pattern(table, pattern, limit):
    texts = [*ODD, *(prose(random.Random(i), vocabulary(50), i) for i in range(12))]
    got, hashes = [], {}
    for part in tb.slices(pa.array(texts), limit):
        w = tb.words(part, table)
        for i in range(len(part)):
            mine = np.flatnonzero(w.text == i)
            got.append([w.low[w.start[k] : w.end[k]].tobytes().decode() for k in mine])
            for k in mine:
                assert hashes.setdefault(got[-1][list(mine).index(k)], w.hash[k]) == w.hash[k]
    assert got == [pattern.findall((t or "").translate(LOWER)) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_shingle_sets_have_the_right_sizes():
    texts = [*ODD, "a b c d e a b c d e a b c d e", "a b c d e", "a b c d", prose(random.Random(1), vocabulary(9), 900)]
    sizes = []
    for part in tb.slices(pa.array(texts), 200):
        sizes.extend(np.diff(jac._sets(part, 5)[1]).tolist())
    assert sizes == [len(shingles(t)) for t in texts]


def near_copies(seed=3):
    r, words = random.Random(seed), vocabulary(300)
    docs = []
    for _ in range(25):
        base = prose(r, words, r.randint(3, 200)).split()
        for _ in range(r.choice([1, 1, 3, 8])):
            copy = list(base)
            for _ in range(r.randint(0, 1 + len(base) // 30)):
                copy[r.randrange(len(copy))] = r.choice(words)
            docs.append(" ".join(copy))
    docs += docs[:6] + ODD + ["short text", "SHORT text", "short  text "]
    return list(enumerate(docs))


def test_jaccard_components_equal_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, DOCS)
    sizes, parts = jaccard(rows)
    assert {r.doc_id: r.n_shingles for r in jac.count_shingles(df).collect()} == sizes
    got = {r.doc_id: r.component_id for r in jac.similar_documents(df).collect()}
    assert {i: got.get(i, i) for i in parts} == parts
    assert len(set(parts.values())) < len(parts)


def test_jaccard_large_cluster_uses_leader_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(jac, "BLOCK", 4)
    r, words = random.Random(5), vocabulary(400)
    base = prose(r, words, 120).split()
    rows = []
    for i in range(40):
        copy = list(base)
        for k in range(r.randint(0, 4)):
            copy[r.randrange(len(copy))] = r.choice(words)
        rows.append((i, " ".join(copy)))
    assert {x.doc_id: x.component_id for x in jac.similar_documents(spark.createDataFrame(rows, DOCS)).collect()} == {
        i: c for i, c in jaccard(rows)[1].items() if list(jaccard(rows)[1].values()).count(c) > 1
    }


def test_tile_links_join_what_brute_force_links():
    r = random.Random(2)
    sets = []
    for _ in range(60):
        base = r.sample(range(5000), 60)
        sets += [np.array(sorted({*base[: r.randint(48, 60)], *r.sample(range(5000), 5)}), np.uint64) for _ in range(3)]
    ids = np.arange(len(sets))
    links = jac.tile_links(ids, np.zeros(len(sets), int), sets)
    true = [(a, b) for a in range(len(sets)) for b in range(a) if jac._linked(sets[a], sets[b], 80)]
    from brute import components

    assert all(jac._linked(sets[a], sets[b], 80) for a, b in links)
    assert components(range(len(sets)), links) == components(range(len(sets)), true)


def test_jaccard_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jac.similar_documents(empty).count() == 0 and jac.count_shingles(empty).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    assert jac.similar_documents(spark.createDataFrame(rows, DOCS)).count() == 0


def test_jaccard_of_an_id_with_two_texts(spark):
    """The quoted text's shingles are frequent, so its prefix is not that of the id's other text."""
    r, words = random.Random(21), vocabulary(3000)
    x, y = prose(r, words, 260), prose(r, words, 120)
    cut = lambda t, n: " ".join(t.split(" ")[:-n])
    docs = [(1, x), (1, y), (2, cut(x, 12)), (9, cut(y, 6))]
    docs += [(20 + i, prose(r, words, 900) + " " + y + " " + prose(r, words, 900)) for i in range(6)]
    docs += [(40, "Short text"), (41, "short  TEXT"), (42, "short text one"), (43, None), (44, prose(r, words, 60_000))]
    docs.append((45, docs[-1][1] + " end"))
    df = spark.createDataFrame(docs, DOCS).selectExpr("doc_id", "text", "'x' as CLS", "1 as tokens", "2 as rep", "3 as n")
    assert {c.doc_id: c.component_id for c in jac.similar_documents(df).collect()} == {1: 1, 2: 1, 9: 1, 40: 40, 41: 40, 44: 44, 45: 44}


def test_contamination_equals_brute_force(spark):
    r, words = random.Random(9), vocabulary(120)
    items = [(i, prose(r, words, r.choice([1, 2, 5, 12, 13, 14, 40]))) for i in range(30)] + [(30, None), (31, ""), (None, "zz yy xx ww")]
    items.append((7, items[3][1]))
    docs = []
    for i in range(120):
        text = prose(r, words, r.randint(0, 60))
        if i % 3 == 0:
            text += " " + (r.choice(items)[1] or "").upper() + ", " + prose(r, words, 10)
        docs.append((i, text))
    docs += [(200 + i, t) for i, t in enumerate(ODD)] + [(0, docs[0][1]), (300, "a zz, yy xx-WW b")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("doc_id", "text", "'old' as n_words", "1 as ITEM_IDS")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(contamination(docs, items))
    for size in (1 << 20, 300):  # one slice of the benchmark, and several
        found = figures(find_passages(df, bench, slice_bytes=size))
        got = sorted((x.doc_id, x.n_words, x.n_hit, list(x.item_ids)) for x in found.collect())
        assert got == want
    none = figures(find_passages(df, bench.limit(0)))
    assert {x.n_hit for x in none.collect()} == {0}
    assert find_passages(df.limit(0), bench).count() == 0


def test_repeated_passages(spark):
    r, words = random.Random(4), vocabulary(2000)
    passage = prose(r, words, 60)
    docs = [(i, prose(r, words, 150)) for i in range(40)]
    for i in (3, 11, 25):
        docs[i] = (i, prose(r, words, r.randint(1, 60)) + " " + passage + "  " + prose(r, words, 50))
    docs += [(50, docs[20][1]), (51, None), (52, ""), (53, "x"), (54, "x"), (None, passage), (55, passage + " " + passage)]
    df = spark.createDataFrame(docs, DOCS)
    found = substring.repeated_passages(df).collect()
    assert {x.doc_id for x in found} == {3, 11, 25, 20, 50, 55}
    text = {i: (t or "").encode() for i, t in docs if i is not None}
    for x in found:
        span = text[x.doc_id][x.start_byte : x.start_byte + x.n_bytes]
        assert len(span) == x.n_bytes >= substring.PASSAGE_BYTES
        assert any(span in t for i, t in text.items() if i != x.doc_id)
        assert x.kept == (x.first_doc_id == x.doc_id)
        if x.doc_id in (3, 11, 25):
            assert span in passage.encode() and x.n_bytes > 0.6 * len(passage.encode())
    cut = {x.doc_id: x.kept_text for x in substring.remove_passages(df, substring.repeated_passages(df)).collect()}
    assert cut[3] == text[3].decode() and cut[50] == "" and cut[51] is None
    assert len(cut[11]) < len(text[11].decode()) - 200
    assert substring.repeated_passages(df.limit(0)).count() == 0


def test_passages_of_short_words_are_found(spark):
    """51 words of one to three letters are less than 160 bytes, of which chunk borders take some."""
    r = random.Random(31)
    words = "a i of to in is it on no we he so up the and for you was but not are all can had her one our out day get".split()
    filler = vocabulary(3000)
    passages = [" ".join(r.choice(words) for _ in range(51)) for _ in range(60)]
    docs = []
    for i, passage in enumerate(passages):
        for j in range(2):
            docs.append((2 * i + j, prose(r, filler, r.randint(20, 60)) + " " + passage + " " + prose(r, filler, 30)))
    found = {x.doc_id for x in substring.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()}
    whole = [i for i in range(60) if {2 * i, 2 * i + 1} <= found]
    assert len(whole) >= 57
    # Documents that share only a few of the same short words are left alone.
    alone = [(i, prose(r, filler, 40) + " " + " ".join(r.choice(words) for _ in range(51))) for i in range(80)]
    assert substring.repeated_passages(spark.createDataFrame(alone, DOCS)).count() == 0


def test_chunks_resist_insertions():
    r = random.Random(8)
    text = prose(r, vocabulary(3000), 800)
    chunks = []
    for t in (text, text[:700] + "inserted" + text[700:]):
        part = next(tb.slices(pa.array([t])))
        starts, _ = substring._cuts(part)
        ends = [*starts[1:].tolist(), len(part.data)]
        chunks.append({part.data[a:b].tobytes() for a, b in zip(starts.tolist(), ends)})
    assert len(chunks[0] & chunks[1]) > 0.95 * len(chunks[0])


def test_packets_keep_every_token():
    r = np.random.default_rng(0)
    tokens, of = r.integers(0, 2**64, 500, np.uint64), np.sort(r.integers(0, 20, 500))
    batch = packets.pack(tokens, of, np.arange(500, dtype=np.uint32), np.arange(100, 120), np.ones(20, int), 7)
    back = []
    for i in range(batch.num_rows):
        rows = pa.Table.from_batches([batch.slice(i, 1)])
        b = packets._bucket(rows, np.uint32)
        back += list(zip(b.tokens.tolist(), b.ids.tolist(), b.extra.tolist()))
    assert sorted(back) == sorted(zip(tokens.tolist(), (of + 100).tolist(), range(500)))


LANGUAGES = {"aa": "the of and with ing tion", "bb": "der und nicht schei lich", "cc": "los que cion mente ado"}


def spoken(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(LANGUAGES))
        parts = LANGUAGES[lang].split()
        rows.append((i, " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(r.randint(2, 60))), lang))
    return rows


def test_language_of_held_out_texts(spark):
    df = spark.createDataFrame(spoken(400, 1), "doc_id long, text string, lang string")
    model = langid.fit(df.filter(~langid.held_out()))
    found = langid.identify(df, model).filter(langid.held_out()).collect()
    assert sum(x.lang == x.lang_pred for x in found) >= 0.97 * len(found)
    assert all(0 <= x.score <= 1 and x.lang_pred in LANGUAGES for x in found)
    assert sum(x.rejected for x in found) <= 0.02 * len(found)


def test_every_label_is_learned_within_the_budget(spark):
    r, letters = random.Random(7), "abcdefghijklmnopqrstuvwxyz"
    stems = ["".join(r.choice(letters) for _ in range(6)) for _ in range(230)]
    rows = [(10 * i + j, f"{stem} " * (j + 2), f"l{i:03}") for i, stem in enumerate(stems) for j in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.fit(df, sample_rows=230, epochs=1).languages) == {x[2] for x in rows}
    for budget in (100, 460, 1200):
        _, labels = langid._sample(df, "text", "lang", budget)
        assert len(set(labels)) == 230 and len(labels) <= max(budget, 230)


def test_language_edges(spark):
    df = spark.createDataFrame(spoken(60, 2), "doc_id long, text string, lang string")
    model = langid.fit(df)
    odd = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, "", "12 .", "é", "ß und nicht", "der " * 200_000])], "doc_id long, text string, Score string")
    found = sorted(langid.identify(odd, model).collect())
    assert [x.lang_pred == "und" for x in found] == [True, True, True, False, False, False]
    assert all(x.rejected and x.score == 0 for x in found[:3])
    assert found[5].lang_pred == "bb"
    assert langid.fit(df.limit(0)) is None
    assert {x.lang_pred for x in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def toxic_rows(n, seed):
    r, words = random.Random(seed), vocabulary(500, 1)
    bad = ["vileword", "nastier", "grimness"]
    docs, labels = [], []
    for i in range(n):
        t = prose(r, words, r.randint(5, 80)).split()
        toxic = int(r.random() < 0.25)
        if toxic:
            for _ in range(r.randint(1, 4)):
                t.insert(r.randrange(len(t)), r.choice(bad))
        docs.append((i, " ".join(t)))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_of_held_out_texts(spark):
    docs, labels = toxic_rows(600, 3)
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, l.filter(~langid.held_out()))
    found = toxicity.score(d, model).filter(langid.held_out()).collect()
    truth = dict(labels)
    assert sum(x.predicted == truth[x.doc_id] for x in found) >= 0.97 * len(found)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in found)
    assert all(x.evidence for x in found if x.predicted)


def test_nearest_examples_are_exact(spark):
    docs, labels = toxic_rows(500, 4)
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, l)
    whole = np.concatenate(model.blocks)
    part = next(tb.slices(pa.array([t for _, t in docs])))
    for terms, weights in model.vocabulary.vectors(part):
        if len(terms):
            found, cosine = model.nearest(terms, weights)
            every = whole[:, terms] @ weights
            order = np.lexsort((np.arange(len(every)), -every))[: model.k]
            order = order[every[order] > 0]
            assert np.allclose(cosine, every[order]) and len(found) == len(order)


def test_texts_without_toxic_words_are_compared_too(spark):
    docs, labels = toxic_rows(300, 6)
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, l.filter(~langid.held_out()))
    part = next(tb.slices(pa.array([t for _, t in docs])))
    hashes, _ = toxicity._terms(next(tb.slices(pa.array([t for i, t in docs if str(i) in set(model.ids)]))))
    assert np.array_equal(model.vocabulary.terms, np.unique(hashes))
    assert all(len(terms) for terms, _ in model.vocabulary.vectors(part))
    truth = dict(labels)
    found = [x for x in toxicity.score(d, model).filter(langid.held_out()).collect() if not truth[x.doc_id]]
    assert found and all(len(x.evidence) == 3 and x.similarity[0] > 0 for x in found)


def test_toxicity_edges(spark):
    docs, labels = toxic_rows(120, 5)
    d = spark.createDataFrame(docs, DOCS)
    l = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 7), (5, labels[5][1])], "doc_id long, toxic int")
    model = toxicity.fit(d.unionAll(d.limit(5)), l)
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("*", "'x' as Predicted")
    found = toxicity.score(odd, model).collect()
    assert len(found) == len(ODD) and all(x.predicted == 0 and x.evidence == [] for x in found)
    assert toxicity.fit(d, l.limit(0)) is None and toxicity.fit(d, l.filter("toxic = 1")) is None
    assert {x.score for x in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.score(d.limit(0), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><a href=/>Site</a></header><nav><ul><li><a>Home</a><li><a>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as you know, to make this better.</p></div>
<article><header class="entry-header"><h1>A title &amp; more</h1></header><p>First   para,\nwith <b>bold</b>,&nbsp;and so on.<p>Second one: 1 &lt; 2.
<aside>Read also, please.</aside><ul><li>an item</li></ul><div class="comments"><p>I disagree, strongly, with all of it.</p></div></article>
<form>Your mail <input> <button>Send</button></form><div class="sidebar">Other, things.</div><footer>&copy; us</footer>"""


def test_html_article():
    assert htmltext.extract(PAGE) == "A title & more First para, with bold, and so on. Second one: 1 < 2. an item"


def test_html_without_article_tag():
    page = (
        "<body><div><a>Home</a></div><div><a>News</a></div><div id=main><h2>The title here</h2>"
        + "".join(f"<p>This is paragraph {i}, with commas, and it is long enough. It ends here.</p>" for i in range(6))
        + "</div><div><div class=footer-links>x y</div></div>"
    )
    got = htmltext.extract(page)
    assert got.startswith("The title here This is paragraph 0") and got.endswith("It ends here.") and "Home" not in got


@pytest.mark.parametrize("page", [None, "", "<", "<p", "plain", "<!-- never closed", "</div></p>", "<script>x", "<p>&#x110000;&bogus;</p>", "<b>" * 300])
def test_html_odd_pages(page):
    assert isinstance(htmltext.extract(page), str)


LONG = "".join(f"<p>This is paragraph {i}, with commas, and it is long enough to be read. It ends here.</p>" for i in range(6))
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8)) + "</ul>"


def test_html_ratios_decide_inside_and_outside_of_articles():
    teasers = "".join(f"<article><h3><a href=/{i}>Teaser {i}</a></h3></article>" for i in range(3))
    for page in (f"<body>{LINKS}<div>{LONG}</div>{teasers}", f"<body><main>{LINKS}<div>{LONG}</div>{LINKS}</main>", f"<body>{LINKS}<div>{LONG}</div>{LINKS}"):
        got = htmltext.extract(page)
        assert got.startswith("This is paragraph 0") and got.endswith("It ends here.") and got.count("paragraph") == 6
        assert "Link" not in got and "Teaser" not in got


@pytest.mark.parametrize("opening", ["<section id='related-work'>", "<section id='discussion'>", "<div class='legal'>", "<div class='form'>", "<div class='responses'>"])
def test_html_names_do_not_outweigh_long_texts(opening):
    page = f"<body><nav>{LINKS}</nav><article><h1>Title</h1>{LONG}{opening}<p>A part of its own, which is long, has commas, and is to stay.</p></{opening[1:].split()[0]}></article>"
    assert htmltext.extract(page).endswith("and is to stay.")


def test_html_self_closed_graphics_and_formulas():
    page = f"<article><svg width=1 />{LONG}<svg><path d=x /></svg><p>With a formula, <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, in it. <math/> It ends, too.</p></article>"
    got = htmltext.extract(page)
    assert got.count("paragraph") == 6 and got.endswith("With a formula, x=2, in it. It ends, too.")


PARAGRAPH = "<p>" + "This is a long paragraph, with words and marks. " * 8 + "</p>"


@pytest.mark.parametrize("page,kept,dropped", [
    (f"<article><h1>Title one</h1><h3>Sub three</h3><h4>Sub four</h4>{PARAGRAPH}{PARAGRAPH}</article>", ["Title one", "Sub three", "Sub four"], []),
    (f"<main>{PARAGRAPH}{PARAGRAPH}<h2>Closing list</h2><ul><li>one</li><li>two</li><li>three</li><li>four</li></ul></main>", ["Closing list one two three four"], []),
    (f"<article>{PARAGRAPH}<p>See <a href='x'>the full report of the committee</a>.</p></article>", ["See the full report of the committee."], []),
    ("<p>Short text.</p><p>And more of it.</p><div class='footer'>All rights reserved.</div>", ["Short text. And more of it."], ["rights"]),
    (f"<article><div class='comments'><p>First! Nice one.</p></div>{PARAGRAPH}<div class='cookie-notice'>We use them.</div></article>", [], ["First", "We use"]),
    (f"<div class='teaser'><article><a href='x'>A teaser</a></article></div><div id='story'><h2>Headline</h2>{PARAGRAPH}{PARAGRAPH}</div>", ["long paragraph"], ["teaser"]),
])
def test_html_keeps_an_article_whole(page, kept, dropped):
    text = htmltext.extract(f"<html><body><nav><a href='x'>Home</a></nav>{page}</body></html>")
    assert all(x in text for x in kept) and not any(x in text for x in [*dropped, "Home"])


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "u", "<p>Hi, there.</p>", "z")], "page_id long, url string, html string, TEXT string")
    got = {x.page_id: x for x in htmltext.extract_text(df).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[None].text == "Hi, there."
    assert got[1].n_chars == len(got[1].text) and "TEXT" not in df.columns[:3]
    assert htmltext.extract_text(df.limit(0)).count() == 0
