"""Operator 1: the main text of web pages, from flat blocks and a decision tree.

A page is cut into flat text blocks at its block-level tags.  Each block has a few numbers:
its words and link density, those of the blocks before and after it, whether it lies in page
furniture (nav, footer, aside, form, ...), in an element whose class or id names such, under
a heading or label that says so, or in an article, and how the words of its container compare
with the page's richest one.  A decision tree, grown on a small labelled table (``labelled``)
by Gini impurity, keeps the blocks of the article.

A null or empty page has no blocks and an empty text; an empty table stays empty.  Unclosed
and cut-off markup is read as far as it goes.  Rows are pages of their own, whether ids repeat
or are null.  Only ``url`` and ``page_id`` are carried along.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.shared import tidy
from marginalia.llm.units import slices

# Element names of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style noscript template svg math iframe object canvas title textarea select head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu button dialog select option".split())
SPACING = frozenset("br td th img".split())
CONTAINERS = frozenset("html body article main section div aside nav header footer form center".split())
# Parts of class names and ids, and first words of labels, that name what is not the article.
COMMENTS = frozenset("comment comments commentlist respond reply replies discussion disqus responses feedback".split())
OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner sidebar sidebars cookie cookies consent notice alert popup modal overlay nav navbar navigation menu breadcrumb"
    " breadcrumbs footer share sharing social related recommended subscribe newsletter signup login pagination pager copyright legal disclaimer".split()
)
WEAK = frozenset("header masthead topbar foot tag tags search side widget top bottom toolbar".split())  # inside an article they say nothing
LABEL = re.compile(
    r"(?i)(?:\d+\s+)?(?:(?:reader |user )?comments?|responses?|replies|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?|related(?: \w+)?|you (?:may|might) also like|more from .*|read more|advertisement|sponsored(?: \w+)?|anzeige|werbung|publicité|publicidad"
    r"|share this.*|subscribe.*|sign up.*|newsletter)\s*(?:\(\d+\))?\s*[:.…]?"
)
NOTICE = re.compile(r"(?i)(?:we|this (?:web)?site|our (?:web)?site) uses? cookies|(?:by continuing|you agree) .{0,60}(?:cookies|terms)|©|copyright \d|all rights reserved")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z0-9]+")


class Block:
    __slots__ = ("text", "words", "linked", "furniture", "hinted", "noted", "article", "heading", "container")

    def __init__(self, text: str, linked: int, heading: bool, place: "_Place"):
        self.text, self.words, self.linked, self.heading = text, len(text.split()), linked, heading
        self.furniture, self.hinted, self.article, self.container = place.furniture, place.hinted > 0, place.article, place.container
        self.noted = place.noted


class _Place:
    """An open element: what it and those around it say of its text."""

    __slots__ = ("name", "furniture", "hinted", "article", "container", "noted")

    def __init__(self, name: str, around: "_Place | None", attrs: dict[str, str], number: int):
        self.name = name
        self.article = (around is not None and around.article) or name in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        self.furniture = (around is not None and around.furniture) or name in FURNITURE or (name == "header" and not self.article)
        own = hint(" ".join(attrs.get(k, "") for k in ("class", "id", "role")), around is not None and around.article)
        if _HIDDEN.search(attrs.get("style", "")) or attrs.get("aria-hidden") == "true":
            own = 2
        if name in ("html", "body", "main", "article"):  # their classes speak of the page, unless they are a comment
            own = own if own == 2 else 0
            self.hinted = max(own, around.hinted if around is not None and around.hinted == 2 else 0)
        else:
            self.hinted = max(own, around.hinted if around is not None else 0)
        own_container = name in CONTAINERS and (self.furniture or self.hinted or around is None or not around.article)
        self.container = number if own_container or around is None else around.container  # an article is one container
        self.noted = around is not None and around.noted


def hint(named: str, inside: bool) -> int:
    """What class, id and role name: 2 comments, 1 other things beside the article, 0 neither.  ``inside``: of an article."""
    found = 0
    for token in named.lower().split() if named else ():
        parts = _PARTS.split(token)
        if parts[0] in ("with", "has", "no", "show", "is"):
            continue
        for x in parts:
            if x in COMMENTS:
                return 2
            if x in OTHERS or (x in WEAK and not inside):
                found = 1
    return found


class _RawEnds:
    """Where raw elements of a page end; the end tags of each name are looked for once."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def __call__(self, at: int, name: str) -> int:
        """End of the content that starts at ``at``; without an end tag script, style, textarea and title end with the page."""
        if name not in self.found:
            tags = [(m.start(), m.end()) for m in re.finditer(rf"</{re.escape(name)}\s*>", self.page, re.I)]
            self.found[name] = ([a for a, _ in tags], [z for _, z in tags])
        starts, ends = self.found[name]
        k = bisect_left(starts, at)
        if k < len(ends):
            return ends[k]
        if name == "head":  # ends where the body starts
            body = re.compile(r"<body", re.I).search(self.page, at)
            return body.start() if body else len(self.page)
        return len(self.page) if name in ("script", "style", "textarea", "title") else at


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks in page order, white space already made single."""
    page = page or ""
    out: list[Block] = []
    root, raw_end = _Place("", None, {}, 0), _RawEnds(page)
    open_tags: list[_Place] = []
    parts: list[str] = []
    linked, in_link, heading, number = 0, 0, False, 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                place = open_tags[-1] if open_tags else root
                block = Block(text, linked, heading, place)
                within = next((x.name for x in reversed(open_tags) if x.name in CONTAINERS), "")
                if within in ("article", "main"):
                    pass  # the words of the article itself are no notices and no labels
                elif block.words <= 8 and LABEL.fullmatch(text):
                    block.noted = True
                    for x in reversed(open_tags):  # it speaks for what follows in its container
                        x.noted = True
                        if x.name in CONTAINERS:
                            break
                elif NOTICE.match(text):
                    block.noted = True
                out.append(block)
        parts.clear()
        linked = 0

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            parts.append(page[at:stop])
            if in_link:
                linked += len(page[at:stop].split())
        if not m:
            break
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1] is not None:
                parts.append(html.escape(m[1]))
            continue
        if m[2]:  # an end tag
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in BLOCK_TAGS:
                close_block()
                heading = False
                for k in range(len(open_tags) - 1, -1, -1):
                    if open_tags[k].name == name:
                        del open_tags[k:]
                        break
            continue
        if name in RAW_TAGS:
            if name in BLOCK_TAGS:
                close_block()
            if not m[4].endswith("/"):
                at = raw_end(at, name)
            continue
        if name in SPACING:
            parts.append(" ")
        if name == "a":
            in_link += 1
        if name in BLOCK_TAGS:
            close_block()
            while open_tags and open_tags[-1].name == "option":  # holds no other element
                open_tags.pop()
            in_link = 0 if name in FURNITURE else in_link
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if name in VOID_TAGS or m[4].endswith("/"):
                continue
            if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):  # these end their open like
                for k in range(len(open_tags) - 1, -1, -1):
                    if open_tags[k].name == name:
                        del open_tags[k:]
                        break
                    if open_tags[k].name not in ("p", "b"):
                        break
            attrs = {a.lower(): x or y or z for a, x, y, z in _ATTR.findall(m[4])} if m[4].strip() else {}
            number += 1
            open_tags.append(_Place(name, open_tags[-1] if open_tags else root, attrs, number))
    close_block()
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "furniture", "hinted", "noted", "article", "heading", "page has article", "container")


def features(found: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` for each block; container: its plain words over those of the page's richest container."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in found], float)
    density = np.array([min(1.0, b.linked / max(1, b.words)) for b in found])
    shift = lambda v, k: np.concatenate([[0.0], v[:-1]]) if k > 0 else np.concatenate([v[1:], [0.0]])
    flags = [np.array([getattr(b, n) for b in found], float) for n in ("furniture", "hinted", "noted", "article", "heading")]
    plain = np.where(flags[0] + flags[1] + flags[2] > 0, 0.0, words * (1 - density))
    place = np.unique([b.container for b in found], return_inverse=True)[1]
    held = np.bincount(place, plain)
    has_article = np.full(len(found), float(any(b.article and not b.hinted for b in found)))
    return np.stack([words, density, shift(words, 1), shift(density, 1), shift(words, -1), shift(density, -1), *flags, has_article, held[place] / max(1.0, held.max())], 1)


# The labelled table: small pages in which the blocks of the article end with a mark.
_MARK = "✓"
_P = "A sentence of plain prose that goes on for a while, with a clause and another one. It is followed by a second. "
_LINKS = "<a href=a>One of them</a> <a href=b>Another one</a> <a href=c>A third</a>"
# what surrounds an article, or stands within one
_BESIDE = (
    "<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>", "<div class=menu><p>Go here</p></div>", f"<div>{_LINKS}</div>", "<ul><li><a href=a>First story of the day</a></li><li><a href=b>Second story of the day</a></li></ul>",
    f"<div class=ad>{_P}</div>", f"<div><p>Advertisement</p><p>{_P}</p></div>", f"<aside><p>{_P}</p></aside>", f"<div id=sidebar><p>{_P}</p><a href=x>Latest story</a></div>", "<form>Your name <input> <button>Send it</button></form>",
    f"<footer><p>{_P}</p></footer>", f"<div class='cookie notice'>We use cookies. {_P}</div>", f"<div><p>We use cookies on these pages. {_P}</p></div>", f"<section id=comments><h3>Comments</h3><p>{_P}</p><p>No.</p></section>", f"<section><h3>2 comments</h3><p>{_P * 2}</p><p>Me too</p></section>",
    "<p>&copy; the site, all of it</p>", "<div><a href=a>Terms</a> | <a href=b>Privacy</a></div>", "<select><option>a</option></select><button>Go</button>",
)
_BODY = (
    f"<h1>Some title{_MARK}</h1><p>{_P * 2}{_MARK}<p>Short.{_MARK}<p>{_P}{_MARK}", f"<h2>Plain heading{_MARK}</h2><p>{_P * 3}{_MARK}</p><p>{_P}{_MARK}</p><p>End.{_MARK}</p>",
    f"<p>{_P}{_MARK}</p><ul><li>An item of a list{_MARK}</li><li>Another item{_MARK}</li></ul><p>With <a href=q>a linked part</a> in it, and more of it. {_P}{_MARK}</p>", f"<h1>T{_MARK}</h1><p><b>{_P}{_MARK}<br><p>One.{_MARK}<p>{_P * 4}{_MARK}</p><blockquote>{_P}{_MARK}</blockquote>",
    f"<p>{_P}{_MARK}</p><p><a href=q>A linked sentence that stands alone in its block</a>{_MARK}</p><p>x{_MARK}</p><p>{_P}{_MARK}</p>",
)
_FRAMES = (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<div class=content><div class=post>", "</div></div>"), ("<article class='post header-large tag-news'>", "</article>"), ("<section>", "</section>"))


def labelled() -> list[str]:
    """Every frame with every body, two things before, one within and two after it, which take turns."""
    pages, k = [], 0
    for low, high in _FRAMES:
        for body in _BODY:
            take = [_BESIDE[(k + j * 5) % len(_BESIDE)] for j in range(5)]
            within = take[2] if "article" in low or "main" in low else ""
            pages.append(f"<body>{take[0]}{take[1]}{low}{body}{within}{high}{take[3]}{take[4]}")
            k += 1
    for low, high in _FRAMES[:2]:  # short articles
        pages += [f"<body>{low}<p>Alone{_MARK}</p>{high}", f"<body>{_BESIDE[0]}{low}<h1>Only a title{_MARK}</h1>{high}{_BESIDE[9]}", f"<body>{low}<p>y{_MARK}</p><p>z{_MARK}</p>{high}<div>Text after it, of some length. {_P}</div><div>Tail</div>"]
        pages += [f"<body>{low}{x}<h1>Title{_MARK}</h1><p>{_P}{_MARK}</p>{high}" for x in _BESIDE]
    pages += [f"<body><h1>Headline{_MARK}</h1><p>{_P}{_MARK}</p><p>Brief words.{_MARK}</p><p>{_P * 2}{_MARK}</p>{x}" for x in _BESIDE]
    return pages


class Tree:
    """A binary decision tree on rows of features, grown by Gini impurity."""

    LEAST = 3  # rows of a leaf

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6):
        self.value = float(y.mean()) if len(y) else 0.0
        self.split = None
        if depth == 0 or self.value in (0.0, 1.0):
            return
        best = (self._impurity(y) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            levels = np.unique(x[:, f])
            for t in (levels[:-1] + levels[1:]) / 2:
                low = x[:, f] <= t
                if min(low.sum(), (~low).sum()) < self.LEAST:
                    continue
                cost = (low.sum() * self._impurity(y[low]) + (~low).sum() * self._impurity(y[~low])) / len(y)
                if cost < best[0] - 1e-12:
                    best = (cost, f, float(t))
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            self.split = (best[1], best[2], Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1))

    @staticmethod
    def _impurity(y: np.ndarray) -> float:
        p = y.mean()
        return float(2 * p * (1 - p))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.value)
        f, t, low, high = self.split
        out, is_low = np.empty(len(x)), x[:, f] <= t
        out[is_low], out[~is_low] = low.predict(x[is_low]), high.predict(x[~is_low])
        return out


def train(pages: list[str] | None = None) -> Tree:
    """The tree grown on labelled pages."""
    xs, ys = [], []
    for page in pages or labelled():
        found = blocks(page)
        xs.append(features(found))
        ys.append(np.array([b.text.endswith(_MARK) for b in found], float))
    return Tree(np.concatenate(xs), np.concatenate(ys))


@lru_cache(1)
def default_tree() -> Tree:
    return train()


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The kept blocks, one on each line."""
    found = blocks(page)
    keep = (tree or default_tree()).predict(features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; each row stands alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for part in slices(batch.column(2)) for h in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
