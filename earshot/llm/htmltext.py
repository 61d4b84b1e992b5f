"""Main text of web pages by tag-path ratios.

A page is a sequence of text nodes, each under a path of tags from the root. For every
path the lengths of its texts and their punctuation are summed and set against the
number of its nodes: article paths carry long, punctuated texts, navigation paths many
short ones. The two ratios are smoothed over the neighbouring nodes in page order,
fused into one figure, and what lies above the gap between the page's two groups of
figures is content. Tags and names are weights of a path: an article's text weighs more,
the larger its part of the page; what names itself as something else (menus, footers,
forms, comments, by tag, class, id or role) and what is a link weighs less. Plain texts
of an article that lie between its content stay. Only what a browser does not show is
left out whatever its ratio.

Each page is worked on alone inside a Spark task, in Arrow batches.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from earshot.llm.frames import append_columns

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*)>"
    r"|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# HTML's own sets of elements, fixed values.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead tr ul video audio canvas".split()
)
#: Elements that end an open p before them.
_ENDS_P = _BLOCK - {"br", "option", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An element that is closed by the next of its kind, up to the container it lies in.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "optgroup", "datalist"}),
}
_OTHER_TAGS = frozenset(
    "nav aside footer form button select option input textarea label fieldset menu dialog script style noscript template "
    "svg iframe object embed canvas audio video head title search".split()
)
_OTHER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog tablist "
    "presentation-ad doc-footnote status note".split()
)
# Words of a class or id that name something beside the article.
_OTHER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adbox adsense sponsor sponsored sponsors promo promos promotion promoted "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer foot "
    "footers masthead topbar toolbar header headers share sharing social related recommended recommendations more-stories "
    "comment comments commentlist disqus discussion reply replies respond responses reactions pagination pager copyright "
    "legal disclaimer skip hidden form search tags tagcloud".split()
)
#: Of those, words that an article's own sections may bear: they count as a whole name or beside one of _PARTS.
_EITHER_WORDS = frozenset(
    "ad ads related recommended discussion reply replies respond responses reactions legal notice notices alert search tags "
    "form social share sharing foot promotion subscription copyright disclaimer overlay skip consent".split()
)
_PARTS = frozenset(
    "posts articles links link stories list box bar block buttons button icons media content items section wrapper container "
    "area slot unit text title".split()
)
# Weights of a path.
ARTICLE, NAMED, EITHER, LINKED = 3.0, 0.005, 0.3, 0.1
APART = 8.0  # two groups differ by so much at least
# At the top of an article these hold its title; and "has-sidebar" speaks of the layout around.
_HEADER_WORDS = frozenset("header headers masthead".split())
_LAYOUT_WORDS = frozenset("has with no without".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
_LETTER = re.compile(r"[^\W\d_]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    __slots__ = ("article", "hidden", "link", "tag", "weight")

    def __init__(self, tag: str, hidden: bool, weight: float, article: int, link: bool) -> None:
        self.tag, self.hidden, self.weight, self.article, self.link = tag, hidden, weight, article, link


def _name_weight(name: str, in_article: bool) -> float:
    """Weight of a class or id: less than 1 if it names something beside the article."""
    words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
    other = [w for w in words if w in _OTHER_WORDS and not (in_article and w in _HEADER_WORDS)]
    if not other or _LAYOUT_WORDS.intersection(words):
        return 1.0
    if any(w not in _EITHER_WORDS for w in other):
        return NAMED
    if len(other) == len(words):
        return EITHER if in_article and len(words) == 1 else NAMED
    return NAMED if any(w in _PARTS for w in words) else 1.0


def _named_other(tag: str, attrs: str, in_article: bool) -> tuple[bool, float, bool]:
    """Whether an element is not shown, its weight, and whether it says it is the article."""
    weight = NAMED if tag in _OTHER_TAGS or tag == "header" and not in_article else 1.0
    if not attrs or attrs.isspace():
        return False, weight, tag in ("article", "main")
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True, 0.0, False
    role = found.get("role", "").lower()
    article = tag in ("article", "main") or role in ("article", "main")
    if article or tag in ("body", "html"):
        return False, weight, article
    if role in _OTHER_ROLES:
        return False, NAMED, False
    names = [*found.get("class", "").split(), *found.get("id", "").split()]
    return False, min([weight, *(_name_weight(x, in_article) for x in names)]), False


def _texts(page: str) -> list[tuple[tuple, str, int, _Node | None]]:
    """Every text that is shown: (path, raw text, block, its element). A new block begins at each block element."""
    out = []
    stack: list[_Node] = []
    path: tuple = ()
    block, position, n = 0, 0, len(page)

    def close(down_to: int) -> None:
        nonlocal path
        del stack[down_to:]
        path = tuple(x.tag for x in stack)

    while position < n:
        m = _TOKEN.match(page, position)
        position = m.end()
        tag = m["tag"]
        if tag is None:
            text = m[0]
            if text.startswith(("<!", "<?")):
                if text.startswith("<![CDATA["):
                    continue
                continue
            if not (stack and stack[-1].hidden):
                out.append((path, text, block, stack[-1] if stack else None))
            continue
        tag = tag.lower()
        block += tag in _BLOCK
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "article", "table") and tag not in _BLOCK:
                    break  # a stray end tag doesn't close what it lies in
            continue
        if tag in ("svg", "math") and m["attrs"].endswith("/"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
            position = end.end() if end else (n if tag in ("script", "style", "textarea", "title") else position)
            continue
        if tag in _ENDS_P and any(x.tag == "p" for x in stack):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("table", "td", "th", "button", "object"):
                    break
        if tag in _SIBLINGS:
            ends, within = _SIBLINGS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag in ends:
                    close(i)
                    break
        if tag in _VOID or m["attrs"].endswith("/") and tag not in _BLOCK:
            continue
        above = stack[-1] if stack else None
        if above and above.hidden:
            node = _Node(tag, True, 0.0, 0, False)
        else:
            inside = above.article if above else 0
            hidden, weight, article = _named_other(tag, m["attrs"], bool(inside))
            # The innermost mark counts: articles in a main are told apart.
            node = _Node(tag, hidden, min(weight, above.weight if above else 1.0), m.end() if article else inside, tag == "a" or bool(above and above.link))
        stack.append(node)
        path = (*path, tag)
    return out


def _tidy(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def extract(page: str | None) -> str:
    """The main text of one page; blocks in page order, joined by one space."""
    if not page:
        return ""
    # Inline elements take no part in a path: their text belongs to the block around them.
    blocks: dict[int, list] = {}
    for path, text, block, node in _texts(page):
        entry = blocks.setdefault(block, [tuple(t for t in path if t in _BLOCK), [], 1.0, 0, 0, 0])
        entry[1].append(text)
        shown = len(text.strip())
        if node and shown:
            entry[2], entry[3] = min(entry[2], node.weight), node.article
            entry[4] += node.link * shown
        entry[5] += shown
    kept = []
    for path, texts, weight, article, linked, shown in blocks.values():
        text = " ".join(_SPACE.sub(" ", entities.unescape("".join(texts))).replace("\xa0", " ").split())
        if text:
            # A paragraph that leads into a link is no entry of a list of links.
            led = linked < shown and path[-1:] != ("li",) and bool(_LETTER.search("".join(texts)))
            kept.append(((path, weight, article, 2 * linked > shown), text, led))
    if not kept:
        return ""
    length, marks, count, part = {}, {}, {}, {}
    for key, text, _ in kept:
        length[key] = length.get(key, 0) + len(text)
        marks[key] = marks.get(key, 0) + len(_PUNCTUATION.findall(text))
        count[key] = count.get(key, 0) + 1
        part[key[2]] = part.get(key[2], 0) + len(text)
    whole = sum(part.values())
    weigh = {
        k: min(k[1], LINKED if k[3] else 1.0) * (1 + ARTICLE * part[k[2]] / whole if k[2] else 1.0) for k in count
    }
    # Length and punctuation per node of the path, smoothed over the neighbours in page order.
    fused = [(length[k] / count[k]) * (1 + marks[k] / count[k]) for k, _, _ in kept]
    score: dict = {}
    for i, (k, _, _) in enumerate(kept):
        # A menu does not gain by the article it stands beside.
        around = [fused[j] for j in range(max(0, i - 1), min(i + 2, len(kept))) if (kept[j][0][1] < EITHER) == (k[1] < EITHER)]
        score[k] = score.get(k, 0.0) + weigh[k] * sum(around) / len(around) / count[k]
    threshold = _between(list(score.values()))
    content = [score[k] >= threshold for k, _, _ in kept]
    # An article with content is kept from its first plain block to its last, titles and short lists too.
    articles = {k[2] for (k, _, _), c in zip(kept, content) if c and k[2]}
    own = [k[2] in articles and k[1] == 1 and (not k[3] or led) for k, _, led in kept]
    return " ".join(text for (_, text, _), c, o in zip(kept, content, own) if c or o)


def _between(scores: list[float]) -> float:
    """The least score of the upper of two groups (least variance within, of logarithms); of all if they are not apart.

    Scores below 1 say no more than 1, unless that leaves nothing apart.
    """
    for least in (1.0, 1e-6):
        logs = sorted(math.log(max(x, least)) for x in scores)
        best, cut, total, low = 0.0, 0, sum(logs), 0.0
        for i in range(1, len(logs)):
            low += logs[i - 1]
            gap = (total - low) / (len(logs) - i) - low / i
            if gap >= math.log(APART) and i * (len(logs) - i) * gap * gap > best:
                best, cut = i * (len(logs) - i) * gap * gap, i
        if cut:
            return math.exp(logs[cut]) * (1 - 1e-9)
    return 0.0


def extract_text(pages: DataFrame, html: str = "html", out: str = "text", length: str = "n_chars") -> DataFrame:
    """pages with the main text of each and its length in code points.

    The whole page is read, however long. A null or empty page, or one without content,
    gives the empty text and length 0. Character references are decoded, white space
    inside a block becomes one space, blocks are joined by one space. Repeated pages
    are worked on one by one. Columns of the two names are replaced.
    """

    def work(column: pa.Array) -> list[pa.Array]:
        texts = [extract(page.as_py()) for page in column]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return append_columns(pages, html, [T.StructField(out, T.StringType()), T.StructField(length, T.LongType())], work)
