"""Main text of HTML pages by tree scoring.

A tolerant scanner builds a flat tree: elements in page order with their parents, and pieces of text.
Menus, headers, footers, side bars, notices, adverts, forms, comments and what a page does not show
are cut off.  Each paragraph then passes points for its length and commas to its parent and, halved,
to its grandparent; a container's points are discounted by the share of its text that is in links.
The container with most points is raised to its ancestors as long as what they add is no links, and
those of its siblings that look like content are kept, and headings right before it.  What holds most of a page's text
is not cut for being a form or for a word in a compound class as has-sidebar, and such words count for nothing where
little text would be left.  A mild word in a compound class as related-work cuts only what has many links or is named
as a widget, of any length.  Reader comments are also known by their shape: an author or a time and a link to reply.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|/?[A-Za-z][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "option", "optgroup", "legend"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"table", "ul", "ol", "dl", "article", "main", "body", "select", "td", "th", "div", "section"}
_PARAGRAPH = {"p", "pre", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption", "summary"}
#: Never content, by element.
_CUT = {"head", "nav", "aside", "footer", "form", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "button", "select", "textarea", "menu", "dialog", "title"} | {"noembed", "noframes", "fieldset", "audio", "video", "map"}
#: Never content, by a word of the class or id.
_CUT_WORDS = set(
    "ad ads adsbygoogle adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist reply replies respond discussion disqus sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead toolbar "
    "share sharing social related recommended recommendations widget pager pagination skip tags copyright disclaimer".split()
)
#: Those of them that prose may have in a compound class.
_MILD_WORDS = set("alert banner copyright disclaimer discussion foot menu modal notice notices overlay promotion recommended recommendations related replies reply respond share sharing skip social tags toolbar widget".split())
#: Words that make a mild word the name of a widget, as in share-buttons.
_WIDGET_WORDS = set("bar block box button buttons cloud count counter form icon icons item items label line link links list panel posts stories widget".split())
#: Class words, and the texts of links, that a reader's comment has.
_AUTHOR_WORDS = {"author", "avatar", "byline", "commenter", "user", "username", "date", "time", "timestamp", "meta"}
_REPLY = {"reply", "reply to this", "reply to comment", "antworten", "répondre", "responder"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words beside "header" in the class or id of a whole page's header.
_SITE_WORDS = {"site", "page", "top", "global", "main", "wrapper", "container", "wrap"}
_CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Cut unless they hold most of the page's text.
_FORMS = {"form", "fieldset"}
_GOOD_WORDS = set("article body content entry main page post story text blog".split())


class _Page:
    """Elements in page order: tag, parent, whether cut; and texts as (element, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.words, self.cut, self.soft, self.plain, self.hidden = ["#root"], [-1], [frozenset()], [False], [False], [False], [False]
        self.texts: list[tuple[int, str]] = []
        self._read(source)
        self.comment = _comments(self)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        words, hidden = frozenset(), False
        role, whole = "", False
        if attributes.strip(" /\t\r\n"):
            given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            words = frozenset(x.lower() for x in _WORD.findall(given.get("class", "") + " " + given.get("id", "")))
            whole = any(x.lower() in _CUT_WORDS for x in (given.get("class", "") + " " + given.get("id", "")).split())
            role = given.get("role", "").strip().lower()
            style = given.get("style", "").replace(" ", "").lower()
            hidden = "hidden" in given or "display:none" in style or "visibility:hidden" in style
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.cut.append(tag in _CUT or hidden)
        self.hidden.append(hidden)
        self.soft.append(tag not in ("html", "body", "article", "main") and (bool(words & _CUT_WORDS) or role in _CUT_ROLES))
        self.plain.append(self.soft[-1] and (role in _CUT_ROLES or (whole and not words & _GOOD_WORDS)))
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        at, stack, size = 0, [0], len(source)
        self.open = _Open()
        while at < size:
            here = source.find("<", at)
            if here < 0:
                here = size
            if here > at:
                self.texts.append((stack[-1], source[at:here]))
            if here == size:
                break
            m = _TAG.match(source, here)
            if not m:
                self.texts.append((stack[-1], "<"))
                at = here + 1
                continue
            at = m.end()
            if not m[2] or not source.endswith(">", here, at):
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(stack, tag)
                continue
            if tag in _ENDS_P:
                self._close(stack, "p", fenced=True)
            for other in _CLOSES.get(tag, ()):
                self._close(stack, other, fenced=True)
            i = self._open(tag, m[3] or "", stack[-1])
            if tag in ("br", "hr", "img", "wbr"):
                self.texts.append((stack[-1], " " if tag != "wbr" else ""))
            if tag in _VOID:
                continue
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = end.start() if end else size
                if end:
                    close = source.find(">", at)
                    at = size if close < 0 else close + 1
                continue
            if (m[3] or "").endswith("/") and tag not in _BLOCK:
                continue
            self.open.add(tag, len(stack))
            stack.append(i)

    def _close(self, stack: list[int], tag: str, fenced: bool = False) -> None:
        """Closes the innermost open ``tag``, if it may be closed from here."""
        k = self.open.innermost(tag, fenced)
        if k:
            for i in reversed(range(k, len(stack))):
                self.open.drop(self.tag[stack[i]])
            del stack[k:]


class _Open:
    """Where on the stack each tag is open, and which of them a close can't pass; each step is as long for any depth."""

    def __init__(self) -> None:
        self.at: dict[str, list[int]] = {}
        self.fences: list[int] = []
        self.blocks: list[int] = []

    def add(self, tag: str, place: int) -> None:
        self.at.setdefault(tag, []).append(place)
        if tag in _FENCE:
            self.fences.append(place)
        if tag in _BLOCK:
            self.blocks.append(place)

    def drop(self, tag: str) -> None:
        self.at[tag].pop()
        if tag in _FENCE:
            self.fences.pop()
        if tag in _BLOCK:
            self.blocks.pop()

    def innermost(self, tag: str, fenced: bool) -> int:
        """The place of the innermost open ``tag``, 0 if there is none or something stands before it."""
        places = self.at.get(tag)
        if not places:
            return 0
        k = places[-1]
        shut = (fenced and self.fences and self.fences[-1] > k) or (tag not in _BLOCK and self.blocks and self.blocks[-1] > k)
        return 0 if shut else k


def _comments(page: _Page) -> list[bool]:
    """Whether each element is a reader's comment: the smallest with a link to reply that also names an author or a time, and what holds nothing but such."""
    n = len(page.tag)
    own: dict[int, list[str]] = {}
    for i, t in page.texts:
        if t.strip():
            own.setdefault(i, []).append(t)
    found = [False] * n
    shown = lambda i: " ".join(html.unescape("".join(own.get(i, ()))).split())
    replies = [i for i in own if page.tag[i] in ("a", "button") and shown(i).lower() in _REPLY]
    replies = [i for i in replies if page.tag[page.parent[i]] not in _PARAGRAPH - {"li"} or len(shown(page.parent[i])) < 4]  # not a word in a sentence
    if not replies:
        return found
    signed, large = [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        signed[i] |= page.tag[i] == "time" or bool(page.words[i] & _AUTHOR_WORDS)
        large[i] |= page.tag[i] in ("h1", "main", "body", "html", "article")
        signed[page.parent[i]] |= signed[i]
        large[page.parent[i]] |= large[i]
    for i in replies:
        up = page.parent[i]
        while up > 0 and not signed[up] and not large[up]:
            up = page.parent[up]
        if up > 0 and not large[up]:
            found[up] = True
    # an element of comments, and headings if any, is one itself; text of its own or other parts keep it
    other, some = [False] * n, found[:]
    for i in range(n - 1, 0, -1):
        if not found[i] and some[i] and not other[i] and page.tag[i] not in ("article", "main", "body", "html"):
            found[i] = True
        if not found[i] and (other[i] or (i in own and page.tag[i] not in _HEADINGS)):
            other[page.parent[i]] = True
        some[page.parent[i]] |= some[i]
    return found


def _weighed(page: _Page) -> tuple[list[bool], list[bool]]:
    """Whether each element holds most of the text that is not cut for what it is, links left out, and whether few of its words are links."""
    n = len(page.tag)
    gone, linked, size, links = [False] * n, [False] * n, [0] * n, [0] * n
    for i in range(1, n):
        up = page.parent[i]
        gone[i] = gone[up] or (page.cut[i] and page.tag[i] not in _FORMS) or page.hidden[i]
        linked[i] = linked[up] or page.tag[i] == "a"
    for i, t in page.texts:
        if not gone[i]:
            (links if linked[i] else size)[i] += len(" ".join(t.split()))
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        links[page.parent[i]] += links[i]
    return [2 * x > size[0] for x in size], [x and 4 * y <= x for x, y in zip(size, links)]


def _kept(page: _Page, soft: list[bool] | None) -> list[bool]:
    """Whether each element stays when the cut ones and what is in them go, and so the ``soft`` ones that hold no article."""
    n = len(page.tag)
    most, prose = _weighed(page)
    holds = [t in ("article", "main") for t in page.tag]
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] |= holds[i]
    stays, inside = [True] * n, [False] * n
    for i in range(1, n):
        up = page.parent[i]
        inside[i] = inside[up] or page.tag[i] in ("article", "main")
        header = page.tag[i] == "header" or (soft is not None and page.tag[i] != "body" and page.words[i] - _SITE_WORDS == {"header"})
        cut = page.cut[i] and not (page.tag[i] in _FORMS and not page.hidden[i] and (most[i] or holds[i]))
        mild = prose[i] and not page.plain[i] and page.words[i] & _CUT_WORDS <= _MILD_WORDS and not page.words[i] & _WIDGET_WORDS - _MILD_WORDS
        named = soft is not None and soft[i] and not holds[i] and not mild and (page.plain[i] or not most[i])
        stays[i] = stays[up] and not (cut or named or page.comment[i] or (header and not inside[i] and not holds[i]))
    return stays


def main_text(source: str | None) -> str:
    """The main text: a line for each block, in page order; empty if there is none."""
    if not source:
        return ""
    page = _Page(source)
    text = _extract(page, _kept(page, page.soft))
    if page.soft != page.plain:
        more = _extract(page, _kept(page, page.plain))
        text = more if len(text) < 0.2 * len(more) else text
    return text or _extract(page, _kept(page, None))


def _extract(page: _Page, stays: list[bool]) -> str:
    n, tag, parent = len(page.tag), page.tag, page.parent
    block, linked = [0] * n, [False] * n
    for i in range(1, n):
        block[i] = i if tag[i] in _BLOCK else block[parent[i]]
        linked[i] = linked[parent[i]] or tag[i] == "a"
    texts = [(i, html.unescape(t)) for i, t in page.texts if stays[i]]
    length, links, commas = [0] * n, [0] * n, [0] * n
    for i, t in texts:
        size = len(" ".join(t.split()))
        length[block[i]] += size
        commas[block[i]] += t.count(",") + t.count("，") + t.count("、")
        if linked[i]:
            links[block[i]] += size
    points, scored = [0.0] * n, False
    for i in range(n):
        if length[i] < 25 or not stays[i]:
            continue
        value = 1 + commas[i] + min(length[i] / 100, 3)
        value *= 1 - links[i] / length[i]
        to = parent[i] if tag[i] in _PARAGRAPH and i else i
        for share in (1, 0.5):
            if to < 0:
                break
            points[to] += value * share
            to = parent[to]
        scored = True
    whole, whole_links = length[:], links[:]
    for i in range(n - 1, 0, -1):
        whole[parent[i]] += whole[i]
        whole_links[parent[i]] += whole_links[i]
    best, chosen = -1.0, 0
    for i in range(n):
        if not stays[i] or not whole[i] or tag[i] in ("ul", "ol", "html", "#root") and scored and tag[i] != "#root":
            continue
        bonus = 25 if tag[i] in ("article", "main") else 5 if page.words[i] & _GOOD_WORDS and tag[i] not in ("body", "html") else 0
        points[i] = (points[i] + bonus) * (1 - whole_links[i] / whole[i]) if points[i] or bonus else 0.0
        if points[i] > best:
            best, chosen = points[i], i
    top = ("body", "html", "#root")
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        if stays[i] and whole[i]:
            kids[parent[i]].append(i)
    while tag[chosen] not in (*top, "article", "main") and tag[up := parent[chosen]] not in top:
        if any(i != chosen and 5 * whole_links[i] > whole[i] for i in kids[up]) or 5 * links[up] > length[up] > 0:
            break
        chosen = up
    keep = [False] * n
    keep[chosen] = True
    if chosen:  # headings right before the container
        for i in reversed([i for i in kids[parent[chosen]] if i < chosen]):
            if tag[i] not in _HEADINGS or whole_links[i]:
                break
            keep[i] = True
    inside = bool(chosen) and tag[parent[chosen]] not in top and tag[chosen] not in ("article", "main")
    if chosen:
        for i in kids[parent[chosen]]:
            if i != chosen and not keep[i]:
                density = whole_links[i] / whole[i]
                alike = inside or (tag[i] == tag[chosen] and page.words[i] == page.words[chosen])
                if tag[i] in _PARAGRAPH:
                    keep[i] = density < 0.25 and (alike or whole[i] > 80 or (density == 0 and tag[i] in ("h1", "h2", "p"))) and tag[chosen] not in ("article", "main")
                elif tag[chosen] not in ("article", "main"):
                    keep[i] = density < 0.5 and (alike or points[i] >= 0.1 * best) and (points[i] > 0 or density < 0.2)
                else:
                    keep[i] = points[i] > 0 and points[i] >= 0.2 * best and density < 0.5
    for i in range(chosen + 1 if not chosen else 1, n):
        keep[i] = keep[i] or keep[parent[i]]
    out, at, parts = [], -1, []
    for i, t in texts:
        if not (keep[i] or (inside and i == parent[chosen])):  # text between siblings stays too
            continue
        if block[i] != at:
            out.append(parts)
            at, parts = block[i], []
        parts.append(t)
    out.append(parts)
    return "\n".join(x for x in (" ".join("".join(parts).split()) for parts in out) if x)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url, text, n_chars)`` per row of ``pages``; n_chars counts code points.

    Null and empty pages, and pages without text, give an empty text.  Null and repeated ids give a
    row each.  A page cut off in the middle gives the text up to there; other columns are not read.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col)
