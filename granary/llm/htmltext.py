"""Main text of HTML pages by minimum-cut labelling of their blocks.

A page becomes blocks of text, each with the open elements around it. A logistic classifier, fitted here on generated pages of
known labels, gives every block the costs of the two labels, which become capacities to the two terminals; neighbours in page order
and blocks of the same kind under the same parent are tied by smoothness edges, the stronger the more of their ancestors they share. Costs are
bounded and edges are of their order, so a short paragraph or a heading goes with its surroundings. The minimum cut is
the labelling of least cost. Blocks whose own costs outweigh all their edges are settled first, which keeps the cut
exact; what is left goes through max-flow.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter, deque

import numpy as np
from pyspark.sql import DataFrame

from .common import clean, mapped

#: Elements that don't end a block; all others do. <br> counts as white space.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr"
    " math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())  # fmt: skip
#: Elements whose content isn't text of the page: up to the first end tag or the page's end, as HTML reads them, and up to
#: the end tag that belongs to them; without one of these the tag alone goes. Elements that have no content.
RAW = frozenset("script style noscript title textarea iframe".split())
DROPPED = frozenset("template select svg object audio video canvas annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, up to the nearest of the boundaries.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words of class, id and role names that speak against content, those among them that readers' comments have, words that speak for
#: it, and words that make a name tell the state of a page ("menu-open") instead of what the element is.
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion comment comments disqus replies reply cookie cookies consent gdpr notice notification alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager copyright legal form search".split())
COMMENT_WORDS = frozenset("comment comments disqus replies reply".split())
GOOD_WORDS = frozenset("article content entry post story text body main".split())
STATE_WORDS = frozenset("has no not with without is open opened closed enabled disabled active fixed hidden layout".split())
ROOT = frozenset(("html", "body"))
#: Capacities of the edges, and the most that a block's own costs may differ by.
ADJACENT, SIBLING, MOST = 1.5, 1.0, 4.0
#: Generated pages that the classifier is fitted on, and the strength that holds its weights down.
PAGES, RIDGE, SEED = 400, 2.0, 4

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|(\Z)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+)")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {x: re.compile(rf"</{x}\s*+>", re.I) for x in RAW}


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes of a tag whose name ends at `at`, whether it closes itself, and where it ends: at the page's end when it isn't
    closed. Every character is looked at once."""
    out: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        if m[3] is None:
            return out, "/" in m[0], at
        name = m[3].lower()
        if name in ("class", "id", "role"):
            out.setdefault(name, m[4] or m[5] or m[6] or "")


def _tags(page: str, at: int = 0):
    """(start, end, name, closing, attributes, closes itself) of the page's tags, and of comments and the like with an empty name. What
    raw-text elements hold is passed over."""
    while m := _MARK.search(page, at):
        name = (m[2] or "").lower()
        if not name:
            at = m.end()
            yield m.start(), at, "", False, {}, False
            continue
        if page.startswith(">", m.end()):
            attributes, itself, at = {}, False, m.end() + 1
        else:
            attributes, itself, at = _attributes(page, m.end())
        if name in RAW and not m[1] and not itself:
            e = _ENDS[name].search(page, at)
            at = e.end() if e else len(page)
        yield m.start(), at, name, bool(m[1]), attributes, itself


class Element:
    """An open element: tag, what its names say, and later what its text holds."""

    __slots__ = ("tag", "number", "bad", "comment", "good", "chars", "holds")

    def __init__(self, tag: str, number: int, attributes: dict[str, str]) -> None:
        self.tag, self.number, self.chars, self.holds = tag, number, 0, False
        self.bad = self.comment = self.good = False
        if attributes and tag not in ("html", "body", "article", "main"):
            for name in " ".join(attributes.values()).split():
                words = {w.lower() for w in _WORDS.findall(name)}
                if words & BAD_WORDS and not words & STATE_WORDS:
                    self.bad = True
                    self.comment |= bool(words & COMMENT_WORDS)
                self.good |= bool(words & GOOD_WORDS)


class Block:
    __slots__ = ("text", "path", "linked", "chars")

    def __init__(self, text: str, path: tuple[Element, ...], linked: int, chars: int) -> None:
        self.text, self.path, self.linked, self.chars = text, path, linked, chars


def blocks(page: str) -> list[Block]:
    """The page's blocks in order: runs of text that only inline elements interrupt. path holds the elements around a block."""
    tags = list(_tags(page))
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    count, linked, in_link, at = 0, 0, 0, 0
    # where the elements that have an end tag end, by the number of their opening tag
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for i, (_, _, tag, closing, _, itself) in enumerate(tags):
        if tag in DROPPED or tag == "button":
            if closing:
                if waiting.get(tag):
                    ends[waiting[tag].pop()] = i
            elif not itself:
                waiting.setdefault(tag, []).append(i)

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(stack), min(linked, len(text)), len(text)))
        parts, linked = [], 0

    i = -1
    while (i := i + 1) < len(tags):
        start, end, tag, closing, attributes, _ = tags[i]
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked += len(page[at:start].strip())
        at = end
        if tag == "a":
            in_link = 0 if closing else 1
        if not tag or tag in RAW:
            continue
        if tag in DROPPED:
            if i in ends:
                i = ends[i]
                at = tags[i][1]
            continue
        if tag == "button" and not closing and i not in ends:
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        end_block()
        in_link = 0 if closing else in_link
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1].tag == "p" and tag != "button":  # a block-level element ends an open paragraph
            stack.pop()
        if tag in CLOSES:
            shut, until = CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in until:
                    break
                if stack[k].tag in shut:
                    del stack[k:]
                    break
        if tag not in VOID:
            count += 1
            stack.append(Element(tag, count, attributes))
    parts.append(page[at:])
    end_block()
    for b in out:
        main = False
        for e in reversed(b.path):
            e.chars += b.chars
            e.holds |= main or e.tag == "h1"
            main |= e.tag in ("article", "main", "h1")
    return out


def _features(b: Block, total: int) -> list[float]:
    """What the classifier sees of a block: its ancestors, what their names say, its own element, length, links and marks. A bad name of
    an element around the page's title or main element and half its text is one of the page, not of boilerplate."""
    tags = {e.tag for e in b.path}
    bad = [e for e in b.path if e.bad and not (e.holds and not e.comment and 2 * e.chars >= total)]
    own = b.path[-1].tag if b.path else ""
    article = "article" in tags
    return [
        1.0,
        article,
        "main" in tags,
        any(e.good for e in b.path),
        bool(tags & {"nav", "menu"}),
        "footer" in tags,
        "header" in tags and not article,
        "header" in tags and article,
        "aside" in tags,
        bool(tags & {"form", "fieldset", "dialog"}),
        bool(bad),
        any(e.comment for e in bad),
        own in ("p", "pre", "blockquote"),
        own in ("h1", "h2", "h3", "h4", "h5", "h6"),
        own == "h1",
        own in ("li", "td", "th", "dd", "dt"),
        "button" in tags,
        min(1.0, math.log1p(b.chars) / 7),
        b.linked / b.chars,
        b.text[-1] in ".!?…:;\"'”»",
        "©" in b.text or "all rights reserved" in b.text.lower(),
    ]


def example(rng: random.Random) -> tuple[str, set[str]]:
    """A generated page and the texts of its blocks that are content. Each text occurs once. A part of the pages is made of elements and
    names that tell nothing."""
    used, content = Counter(), set()
    pick, bare = rng.choice, rng.random() < 0.35

    def text(least: int, most: int, stop: str = "", own: bool = False) -> str:
        words = ["".join(pick("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(least, most))]
        out = " ".join(words).capitalize() + f" q{len(used)}" + stop
        used[out] += 1
        if own:
            content.add(out)
        return out

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{text(1, 4)}</a></li>' for _ in range(n))

    def named(words: str, tag: str = "div") -> str:
        return f'<{tag} {pick(("class", "id"))}="{pick(("", "c1 ", "site-", "box "))}{pick(words.split())}{pick(("", "", " wide", "-inner"))}">'

    def some(p: float, *made) -> str:
        return pick(made)() if rng.random() < p else ""

    stop = lambda: pick((".", ".", "!", "?", ""))
    head = lambda: pick((lambda: f"<header><h1>{text(1, 4)}</h1><p>{text(2, 8)}</p></header>", lambda: f"{named('header masthead banner')}<p>{text(1, 9)}</p></div>"))()
    menu = lambda: pick((lambda: f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>", lambda: f"{named('menu navigation navbar breadcrumbs')}<ul>{links(rng.randint(2, 9))}</ul></div>"))()
    notice = lambda: f"{named('cookie-notice alert consent notice')}<p>{text(4, 25, stop())}</p><button>{text(1, 2)}</button></div>"
    ad = lambda: pick((lambda: f"{named('ad ads advert sponsored promo')}{text(3, 20, stop())}</div>", lambda: f"{named('ad sponsored')}<p>{text(3, 30, stop())}</p></div>"))()
    side = lambda: pick((lambda: f"<aside><h3>{text(1, 3)}</h3><p>{text(3, 30, stop())}</p><ul>{links(3)}</ul></aside>", lambda: f"{named('sidebar widget related')}<h3>{text(1, 3)}</h3><p>{text(3, 30, stop())}</p></div>"))()
    comments = lambda: f"{named('comments replies', 'section')}<h3>{text(1, 2)}</h3>" + "".join(f"<{t}><p>{text(3, 40, stop())}</p></{t}>" for t in [pick(("div", "li", "article"))] * rng.randint(1, 5)) + "</section>"
    form = lambda: pick((lambda: f"<form><p>{text(2, 14, stop())}</p><label>{text(1, 2)}</label><input></form>", lambda: f"{named('newsletter signup search')}<p>{text(2, 14, stop())}</p></div>"))()
    foot = lambda: f"<footer><p>{pick(('© 2020 ', '', 'All rights reserved. '))}{text(2, 15, stop())}</p></footer>"

    def prose() -> str:
        out = []
        for _ in range(rng.randint(2, 9)):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{text(1, pick((6, 40, 90)), pick(('.', '.', '.', '?', ':')), True)}</p>")
            elif kind < 0.8:
                out.append(f"<h2>{text(1, 7, '', True)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{text(2, 20, stop(), True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<{'blockquote'}>{text(4, 30, '.', True)}</blockquote>")
            elif kind < 0.96:
                out.append("<table><tr>" + "".join(f"<td>{text(1, 5, '', True)}</td>" for _ in range(4)) + "</tr></table>")
            else:
                out.append(pick((ad, form, side))())
        return "".join(out)

    title = f"<h1>{text(2, 9, '', True)}</h1>"
    inner = pick((title, f"<header>{title}</header>")) + prose() + some(0.3, comments)
    kind = rng.random()
    if kind < 0.45:
        main = f"<article>{inner}</article>"
    elif kind < 0.6:
        main = f"<main>{inner}</main>"
    elif kind < 0.9:
        main = f"{named('content post entry story article-body main-text')}{inner}</div>"
    else:
        main = f"<div>{inner}</div>"
    if rng.random() < 0.2:
        main = f'<div class="{pick(("menu-open", "has-sidebar", "page search", "layout"))}">{main}</div>'
    page = some(0.6, head) + some(0.8, menu) + some(0.4, notice) + some(0.5, ad) + main + some(0.4, side) + some(0.3, comments) + some(0.3, form) + some(0.8, foot)
    if bare:
        page = re.sub(r"(</?)(?:nav|aside|footer|header|article|main|section|form)\b", r"\1div", re.sub(r" (?:class|id)=\"[^\"]*\"", lambda _: pick(("", ' class="css-1x"', ' class="c2 row"')), page))
    return f"<html><body>{page}</body></html>", content


@functools.cache
def classifier(pages: int = PAGES, ridge: float = RIDGE, seed: int = SEED) -> tuple[float, ...]:
    """The classifier's weights: logistic regression by Newton's method on the blocks of generated pages."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        page, content = example(rng)
        found = blocks(page)
        total = sum(b.chars for b in found)
        x += [_features(b, total) for b in found]
        y += [b.text in content for b in found]
    x, y = np.array(x, float), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def log_odds(found: list[Block], weights: tuple[float, ...]) -> list[float]:
    """The classifier's log-odds that the blocks are main text, bounded by MOST."""
    total = sum(b.chars for b in found)
    return [max(-MOST, min(MOST, sum(w * f for w, f in zip(weights, _features(b, total)) if f))) for b in found]


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours in page order, by the part of their ancestors that they share; and between a block and
    the one before it of the same kind under the same parent."""
    out, last = [], {}
    for j, b in enumerate(found):
        if j:
            a = found[j - 1]
            own, other = [e for e in a.path if e.tag not in ROOT], [e for e in b.path if e.tag not in ROOT]
            shared = sum(p is q for p, q in zip(own, other))
            out.append((j - 1, j, ADJACENT * (shared + 0.1) / (max(len(own), len(other), 1) + 0.1)))
        kind = (b.path[-2].number, b.path[-1].tag) if len(b.path) > 1 else None
        if kind in last:
            out.append((last[kind], j, SIBLING))
        last[kind] = j
    return out


def minimum_cut(unary: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: unary[i] is what False costs more than True, a link costs its weight where its
    ends differ. A node on which no cut depends is True when unary is 0 or more."""
    near: list[list[tuple[int, float]]] = [[] for _ in unary]
    for i, j, w in links:
        if w > 0:
            near[i].append((j, w))
            near[j].append((i, w))
    u, fixed = list(unary), [None] * len(unary)
    open_ = [sum(w for _, w in x) for x in near]
    todo = deque(range(len(u)))
    while todo:
        i = todo.popleft()
        if fixed[i] is None and abs(u[i]) >= open_[i]:
            fixed[i] = u[i] >= 0
            for j, w in near[i]:
                if fixed[j] is None:
                    u[j] += w if fixed[i] else -w
                    open_[j] -= w
                    todo.append(j)
    rest = [i for i, x in enumerate(fixed) if x is None]
    if rest:
        for i, on in zip(rest, _source_side(rest, u, near, fixed)):
            fixed[i] = on
    return fixed


def _source_side(rest: list[int], u: list[float], near: list, fixed: list) -> list[bool]:
    """Max-flow by shortest augmenting paths over levels (Dinic); which of the nodes stay with the source."""
    number = {i: k for k, i in enumerate(rest)}
    n = len(rest)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def arc(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(there)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, i in enumerate(rest):
        arc(s, k, u[i], 0.0) if u[i] >= 0 else arc(k, t, -u[i], 0.0)
        for j, w in near[i]:
            if j > i and fixed[j] is None:
                arc(k, number[j], w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        place = [0] * (n + 2)
        while True:  # one augmenting path after another, without recursion
            path, a = [], s
            while a != t:
                while place[a] < len(head[a]):
                    e = head[a][place[a]]
                    if cap[e] > 1e-12 and level[to[e]] == level[a] + 1:
                        break
                    place[a] += 1
                else:
                    if a == s:
                        break
                    e = path.pop()
                    a = to[e ^ 1]
                    place[a] += 1
                    continue
                path.append(e)
                a = to[e]
            if a != t:
                break
            low = min(cap[e] for e in path)
            for e in path:
                cap[e] -= low
                cap[e ^ 1] += low


def labels(found: list[Block], weights: tuple[float, ...]) -> list[bool]:
    """Which blocks are main text: the minimum cut."""
    return minimum_cut(log_odds(found, weights), edges(found))


def main_text(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    """The blocks labelled content, one a line; the empty string for a null or empty page. Of a tag that the page's end cuts off
    nothing is text."""
    found = blocks(page) if page else []
    return "\n".join(b.text for b, k in zip(found, labels(found, weights or classifier())) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    A null or empty page, or one of boilerplate alone, gives the empty text and 0. Rows that repeat give
    repeated rows.
    """
    weights = classifier()

    def run(rows: dict[str, list]) -> dict[str, list]:
        text = [main_text(x, weights) for x in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": text, "n_chars": [len(x) for x in text]}

    return mapped(clean(pages, "page_id", "url", "html"), lambda: run, "page_id long, url string, text string, n_chars long")
