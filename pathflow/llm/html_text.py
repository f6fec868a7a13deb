"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tags and words.  Words score above zero, tags below
zero, and the contiguous run of the highest total is the content region; one
linear scan finds it.  The scores come from labelled pages, those that mark their
content with ``<article>`` or ``<main>``: with the marks hidden, each tag's score
follows from how often it stands inside and outside of the content, and the
words' score is the one with which the scan finds the content best.

On a page that marks its content the scan goes over what is marked, of all such
elements.  Elements that are no content by their tag or their whole name, and
reader comments, are no part of any page.  A name of which only a part tells, a
name that labelled pages show outside of their content, and a form are doubtful:
they may as well wrap the content.  Doubtful words score a tenth and their
borders cost, so the scan decides; a doubtful element that begins within the run
is left out.  No rule asks for an element's size.  Where nothing would be left
of a page that has words, doubtful elements stay, and if need be named ones.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name

_RAW = "script|style|title|textarea|iframe|noembed|noframes|xmp|template|noscript"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>|[^>]*(?:>|\Z)))",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_EMPTY = frozenset("svg canvas math".split())  # without content where they end in />
#: Prior: tags that aren't content by their meaning.
_NEVER = frozenset("nav footer aside head button select option menu dialog svg canvas object audio video map datalist search math".split())
#: Tags that any part of a page is made of, and that tell nothing by themselves.
_PLAIN = frozenset("html body main article section div span p a b i em strong u s small sub sup br hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre code blockquote q cite figure figcaption img picture time details summary abbr font center mark".split())
#: Prior: words that name readers' comments, in whatever company.
_COMMENTS = frozenset("comment comments commentlist disqus discussion discussions reply replies respond".split())
#: Words of a name that tell of an element's state, as in "comments-open".
_STATES = frozenset("open closed on off enabled disabled allowed active".split())
#: Prior: words in class, id or role that name something other than the article.
_ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation footer header "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "share sharing social related recommended recommendations subscribe subscription newsletter breadcrumb breadcrumbs pagination pager widget "
    "login signup search searchbox skip contentinfo complementary".split()
)
#: First words of a class that tell of a layout or a topic and don't name the element.
_MODIFIERS = frozenset("no not has have with without is hide hidden show category tag type format status".split())
_KEPT = frozenset("html body main".split())
_SCORED = frozenset("p b i em strong a br span div ul ol li dl dt dd table tr td th tbody thead h1 h2 h3 h4 h5 h6 section header nav footer aside form blockquote pre code img figure figcaption hr article main body html".split())

#: Scores used where no page is labelled.
DEFAULT_WEIGHTS = {"word": 1.0, "tag": -0.15, "cut": -5.0, "doubt": -2.5}
#: Scores that are tried for a word.
WORD_SCORES = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)
#: Words in links and in doubtful elements score this part of others.
LESS = 0.1
#: Tags score at most this; the method asks for the sign alone.
MOST_TAG = -0.02
#: An element's name or tag is learned as no content from this log-odds of its words, and from so many labelled pages.
ASIDE_ODDS, ASIDE_PAGES = -2.0, 3
#: What is left out of a page, from all that is known as no content to what is so by its tag alone.
LEVELS = (frozenset({"always", "named", "doubtful"}), frozenset({"always", "named"}), frozenset({"always"}))


def _names(attrs: str) -> Iterator[list[str]]:
    """The words of every name in class, id or role."""
    if "=" in attrs:
        for m in _NAMES.finditer(attrs):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                words = [w for w in re.split(r"[^a-z]+", name) if w]
                if words and words[0] not in _MODIFIERS:
                    yield words


def _kind(tag: str, attrs: str, marked: bool, weights: dict[str, float]) -> str:
    """How an element is known as no content: "always" by its tag, "named" by a whole name or as comments, "doubtful" by a word of a name, a learned name or as a form, or "".

    An article's own header is content.
    """
    if tag in _NEVER or (tag == "header" and not marked):
        return "always"
    found = "doubtful" if tag == "form" or weights.get(f"<{tag}>", 0.0) <= ASIDE_ODDS and not (marked and tag == "header") else ""
    for words in _names(attrs):
        if not _STATES.isdisjoint(words):
            continue
        aside = _ASIDE.intersection(words) - ({"header"} if marked else set())
        if not _COMMENTS.isdisjoint(words) or (aside and len(words) == 1):
            return "named"
        if aside or any(weights.get("." + w, 0.0) <= ASIDE_ODDS for w in words):
            found = "doubtful"
    return found


def _extents(found: list[re.Match], kind: Callable[[str, str, bool], str]) -> tuple[dict[int, str], dict[int, tuple[int, bool]], list[bool]]:
    """Elements of a kind: their kinds and ends by the position of the start tag in ``found``; and whether each tag stands in marked content.

    An end is a position and whether that is the element's own end tag.  An
    element reaches to its end tag, but not out of the marked content around it
    nor over a ``<main>``; without an end tag it reaches to the next article or
    main at most, a paragraph to the next block.
    """
    n = len(found)
    tags = [((m["tag"] or "").lower(), bool(m["end"])) for m in found]
    closed, opened = [n] * n, {}
    for i, (tag, end) in enumerate(tags):
        if tag and tag not in _VOID and not (tag in _EMPTY and found[i]["attrs"].endswith("/>")):
            if not end:
                opened.setdefault(tag, []).append(i)
            elif opened.get(tag):
                closed[opened[tag].pop()] = i
    around, kinds, inside, marked, marks = [n] * n, {}, [], 0, []
    for i, (tag, end) in enumerate(tags):
        while inside and inside[-1] <= i:
            inside.pop()
        around[i] = inside[-1] if inside else n
        if tag and not end and tag not in _VOID and tag not in _KEPT:
            known = kind(tag, found[i]["attrs"], marked > 0)
            if known:
                kinds[i] = known
        if tag in ("article", "main"):
            marked = max(0, marked + (-1 if end else 1))
            if not end and closed[i] < n:
                inside.append(min(closed[i], around[i]))
        marks.append(marked > 0)
    ends, main, stop, block = {}, n, n, n
    for i in range(n - 1, -1, -1):
        tag, end = tags[i]
        if i in kinds:
            at = min(closed[i], around[i], main, block if tag == "p" else n, stop if closed[i] == n else n)
            ends[i] = at, at == closed[i] < n
        if tag == "main" and not end or tag == "body" and end:
            main = i
        if tag in ("article", "main") or tag == "body" and end:
            stop = i
        if tag in _BLOCKS and not (tag == "p" and end):
            block = i
    return kinds, ends, marks


def _gap_words(page: str, found: list[re.Match]) -> list[int]:
    """Words before each tag and after the last one."""
    borders = [0, *(m.end() for m in found)], [*(m.start() for m in found), len(page)]
    return [len(page[x:y].split()) if y > x else 0 for x, y in zip(*borders, strict=True)]


def _no_content(found: list[re.Match], i: int) -> bool:
    """Whether a start tag is its whole element."""
    return (found[i]["tag"] or "").lower() in _EMPTY and found[i]["attrs"].endswith("/>")


@dataclass(frozen=True)
class Item:
    """A piece of a page: a ``tag`` (name, a leading ``/`` on end tags), a ``word`` or ``link word`` (a run of decoded text), a ``cut`` (an element left out), or a ``doubt`` (a border of a doubtful element)."""

    kind: str
    value: str
    inside: bool  # within marked content
    doubt: int = 0  # number of the innermost doubtful element around it
    outer: int = 0  # and of the outermost


def items(page: str, weights: dict[str, float] | None = None, level: frozenset = LEVELS[0]) -> Iterator[Item]:
    """The pieces of a page in order, without what ``level`` leaves out; with no weights, all of them."""
    found = list(_TOKEN.finditer(page))
    kinds, ends = {}, {}
    if weights is not None:
        kinds, ends, _ = _extents(found, lambda tag, attrs, marked: _kind(tag, attrs, marked, weights))
        kinds = {i: k for i, k in kinds.items() if k in level}
    at, links, marked, until, own = 0, 0, 0, -1, False
    doubts: list[tuple[int, int, bool]] = []  # numbers and ends, and whether these are their own end tags

    def piece(kind: str, value: str) -> Item:
        return Item(kind, value, marked > 0, doubts[-1][0] if doubts else 0, doubts[0][0] if doubts else 0)

    def text(run: str) -> Iterator[Item]:
        if run:
            yield piece("link word" if links else "word", html.unescape(run) if "&" in run else run)

    for i, m in enumerate(found):
        while doubts and doubts[-1][2] and i > doubts[-1][1]:
            yield piece("doubt", "/")
            doubts.pop()
        if m.start() > at and i > until:
            yield from text(page[at : m.start()])
        at = m.end()
        while doubts and i >= doubts[-1][1] + doubts[-1][2]:
            yield piece("doubt", "/")
            doubts.pop()
        tag = m["tag"]
        if i < until or (i == until and own) or tag is None:
            continue
        tag, end = tag.lower(), bool(m["end"])
        if kinds.get(i) in ("always", "named"):
            if not _no_content(found, i):
                until, own = ends[i]
            yield piece("cut", tag)
            continue
        if i in kinds and not _no_content(found, i):
            doubts.append((i + 1, *ends[i]))
            yield piece("doubt", tag)
        if tag == "a":
            links = max(0, links + (-1 if end else 1))
        elif tag in _BLOCKS and links:
            links = 0  # an unclosed link ends with its block
        if tag in ("article", "main"):
            marked = max(0, marked + (-1 if end else 1))
        yield piece("tag", "/" + tag if end else tag)
    while doubts and doubts[-1][2]:
        yield piece("doubt", "/")
        doubts.pop()
    if at < len(page) and until < len(found):
        yield from text(page[at:])


def best_region(scores: list[float]) -> tuple[int, int]:
    """Half-open bounds of the run of the highest sum, the longest of equals; (0, 0) if no sum is above zero."""
    best, at, low, low_at, total = 0.0, (0, 0), 0.0, 0, 0.0
    for i, s in enumerate(scores):
        total += s
        if total - low > best or (total - low == best and best > 0 and low_at == at[0]):
            best, at = total - low, (low_at, i + 1)
        if total < low:
            low, low_at = total, i + 1
    return at


def scores_of(pieces: list[Item], weights: dict[str, float]) -> list[float]:
    """The pieces' scores, as if no content were marked."""
    out = []
    for x in pieces:
        if x.kind == "tag":
            name = x.value.removeprefix("/")
            out.append(MOST_TAG if x.doubt else weights.get("div" if name in ("article", "main") else name, weights["tag"]))
        elif x.kind in ("cut", "doubt"):
            out.append(weights[x.kind])
        else:
            out.append(weights["word"] * (LESS if x.kind == "link word" else 1.0) * (LESS if x.doubt else 1.0) * len(x.value.split()))
    return out


def _has_words(x: Item) -> bool:
    return x.kind.endswith("word") and bool(x.value.strip())


def _within_marks(own: list[Item]) -> list[Item]:
    """Marked pieces from the first word to the last: all tags together cost less than a word."""
    start, end = best_region([len(x.value.split()) if x.kind.endswith("word") else -0.5 / len(own) for x in own])
    return own[start:end]


def region(pieces: list[Item], weights: dict[str, float], *, hidden: bool = False) -> list[Item]:
    """The pieces of the best run; with ``hidden``, marks are of no account.

    Marks count where they don't stand in a doubtful element.  The scan decides
    between a doubtful element and what is around it.
    """
    if not hidden and any(x.inside and not x.outer and _has_words(x) for x in pieces):
        return _within_marks([x for x in pieces if x.inside and not x.doubt])
    start, end = best_region(scores_of(pieces, weights))
    run = pieces[start:end]
    around = {x.outer for x in run}
    if len(around) == 1 and (d := around.pop()):
        # the content lies in a doubtful element, which so is a wrapper: scan again within it
        plain = [replace(x, doubt=0, outer=0) if x.doubt == d else replace(x, outer=x.doubt) for x in pieces if x.outer == d and not (x.kind == "doubt" and x.doubt == d)]
        return region(plain, weights, hidden=hidden)
    within = {x.doubt for x in run if x.kind == "doubt" and x.value != "/"}
    return [x for x in run if x.doubt not in within]


def joined(run: list[Item]) -> str:
    """Text of pieces: blocks joined by two newlines, white space within a block as one space."""
    blocks, now = [], []
    for x in run:
        if x.kind.endswith("word"):
            now.append(x.value)
            continue
        name = x.value.removeprefix("/")
        if name == "br":
            now.append(" ")
        elif (name in _BLOCKS or x.kind == "doubt") and now:
            blocks.append(now)
            now = []
    texts = (" ".join("".join(b).split()) for b in [*blocks, now])
    return "\n\n".join(b for b in texts if b)


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Text of the best run, with as much left out as leaves any word."""
    for level in LEVELS if page else ():
        text = joined(region(list(items(page, weights, level)), weights))
        if text:
            return text
    return ""


def evidence(page: str) -> Counter:
    """What a labelled page tells: counts by (feature, inside).

    Features are tags and ``word`` by their numbers; ``<tag>`` and ``.name`` of
    elements by their words; with None for inside, the page itself under each of
    the latter.
    """
    seen: Counter = Counter()
    for x in items(page):
        n, name = 1 if x.kind == "tag" else len(x.value.split()), x.value.removeprefix("/")
        if x.kind != "tag":
            seen["word", x.inside] += n
        elif name in ("article", "main"):
            seen["div", False] += 1  # hidden, the mark is a border
        else:
            seen[name if name in _SCORED else "tag", x.inside] += 1
    found = list(_TOKEN.finditer(page))
    kinds, ends, marks = _extents(found, lambda tag, attrs, marked: "any" if tag not in _PLAIN or "=" in attrs else "")
    words, told = _gap_words(page, found), set()
    inside = [0, *itertools.accumulate(n if i and marks[i - 1] else 0 for i, n in enumerate(words))]
    whole = [0, *itertools.accumulate(words)]
    for i in kinds:
        at = i if _no_content(found, i) else ends[i][0]
        within, total = inside[at + 1] - inside[i + 1], whole[at + 1] - whole[i + 1]
        tag = found[i]["tag"].lower()
        features = {"." + w for names in _names(found[i]["attrs"]) for w in names} | ({f"<{tag}>"} if tag not in _PLAIN else set())
        for f in features if total else ():
            seen[f, True] += within
            seen[f, False] += total - within
            told.add(f)
    seen.update({(f, None): 1 for f in told})
    return seen


def agreement(page: str, weights: dict[str, float], level: frozenset = frozenset()) -> list[float]:
    """For every score of a word, how well the scan with the marks hidden finds a page's marked words (F1)."""
    pieces = list(items(page, weights, level))
    whole = sum(len(x.value.split()) for x in pieces if x.inside and x.kind.endswith("word"))
    out = []
    for score in WORD_SCORES:
        run = [x for x in region(pieces, weights | {"word": score, "cut": DEFAULT_WEIGHTS["cut"] * score, "doubt": DEFAULT_WEIGHTS["doubt"] * score}, hidden=True) if x.kind.endswith("word")]
        right = sum(len(x.value.split()) for x in run if x.inside)
        out.append(2 * right / max(1, whole + sum(len(x.value.split()) for x in run)))
    return out


def learn_weights(pages: DataFrame, *, html_column: str = "html", key: str = "page_id", label_pages: int = 500, smoothing: float = 0.1) -> dict[str, float]:
    """Scores of tags and words, and elements that are no content, from labelled pages.

    At most ``label_pages`` different pages with ``<article>`` or ``<main>``
    serve, those of the smallest hash of key and page; that bound is the only
    sample, and the pages stay where they are read.  A tag's score is the
    log-odds of its rate inside against that outside, both smoothed by a share of
    their mean, and below zero.  The score of a word is then the one of
    ``WORD_SCORES`` with which the scan alone, without lists and marks, agrees
    best with the marks.
    """
    text = F.col(f"`{html_column}`")
    marked = pages.where(text.rlike(r"(?i)<(article|main)[\s>]")).select(F.xxhash64(F.col(f"`{key}`"), text).alias("h"), text.alias("page"))
    # at most label_pages hashes, hence the broadcasts; of repeated pages any one serves
    chosen = marked.select("h").distinct().orderBy("h").limit(label_pages)
    sample = marked.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"]).select("page")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column("page").to_pylist():
                seen.update(evidence(page))
        if seen:
            yield pa.RecordBatch.from_pydict({"feature": [k[0] for k in seen], "inside": pa.array([k[1] for k in seen], pa.bool_()), "n": list(seen.values())})

    # the features are the tags and names of so many pages
    rows = sample.mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    seen = {(r["feature"], r["inside"]): r["n"] for r in rows}
    weights = dict(DEFAULT_WEIGHTS)
    kinds = [f for f in {k[0] for k in seen} if f[0] not in "<."]
    inside, outside = (sum(seen.get((f, side), 0) for f in kinds) for side in (True, False))
    if not inside:
        return weights
    for f in sorted({k[0] for k in seen} - {"word"}):
        within, without = (seen.get((f, side), 0) for side in (True, False))
        if f[0] in "<.":
            if seen[f, None] >= ASIDE_PAGES:
                weights[f] = math.log((within + 1) / (without + 1))
            continue
        own, other = within / inside, without / max(1, outside)
        more = smoothing * (own + other) / 2
        weights[f] = min(MOST_TAG, math.log((own + more) / (other + more)))

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column("page").to_pylist():
                yield pa.RecordBatch.from_pydict({"score": list(WORD_SCORES), "f1": agreement(page, weights)})

    found = sample.mapInArrow(tried, "score double, f1 double").groupBy("score").agg(F.sum("f1").alias("f1")).collect()
    # of scores that do as well the largest, which bears most tags within the content
    most = max(r["f1"] for r in found)
    best = max(r["score"] for r in found if r["f1"] >= most * (1 - 1e-3))
    return weights | {"word": best, "cut": DEFAULT_WEIGHTS["cut"] * best, "doubt": DEFAULT_WEIGHTS["doubt"] * best}


def extract_main_text(pages: DataFrame, *, html_column: str = "html", into: str = "text", keep: tuple[str, ...] = ("page_id", "url"), weights: dict[str, float] | None = None) -> DataFrame:
    """The columns ``keep`` and the main text of every page.

    A null or empty page, and one without words, has the empty text.  Pages are
    independent: repeated rows give repeated rows, an empty table gives an empty
    one, other columns are left out.  No shuffle; the page is read once and
    whole.
    """
    weights = weights or learn_weights(pages, html_column=html_column)
    kept = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_column}`").alias(free_name(keep, "__html")))
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes[:-1]] + [f"`{into}` string"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p.as_py(), weights) for p in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], names=[*keep, into])

    return kept.mapInArrow(extract, schema)
