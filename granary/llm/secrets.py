"""Secret scans: three base patterns, and an assignment-aware lexer beside them.

The lexer looks at every `:` and `=` of a text, reads the name before it and the value expression after it (quoted literals with
prefixes, escapes, one or three quotes, block scalars of configuration files, bare words, names, joined by + or .), and keeps what names
were given, so a secret that is put together from constants is seen whole. What a name stands for is kept as references to the
literals that it is made of, never as a joined text, so names that refer to themselves or to one another cost a reference each.
A value is reported when its target's name is sensitive and it looks like a secret. Of a value of several literals that is told from
facts about each of them, which give what the joined text would give, however long that is.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import clean, mapped

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough

#: How much a part of a name says that its value is secret; of several parts the largest counts, and the pairs
#: below count as well.
NAME_PARTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.9, "signature": 0.6, "salt": 0.6, "dsn": 0.6}
NAME_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("signing", "key"): 1.0, ("encryption", "key"): 1.0, ("account", "key"): 0.9, ("client", "key"): 0.8, ("shared", "key"): 0.9, ("auth", "key"): 1.0}
#: What stands where a secret would: marks anywhere in a value, and words of which the whole value is made.
PLACEHOLDERS = ("changeme", "example", "placeholder", "xxxx", "redacted", "${", "{{", "%(", "***")
PLACEHOLDER_WORDS = ("password", "passwd", "secret", "token", "api", "key", "my", "here", "none", "null", "true", "false", "todo", "dummy")
LEAST_SCORE, LEAST_CHARS = 0.5, 8
#: A mark that runs over the end of a literal has at most so many characters on either side.
_EDGE = max(map(len, PLACEHOLDERS)) - 1

_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NAME = re.compile(r"[A-Za-z_$][\w$.\-]*")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]#<>&|]+")
_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_LIST = re.compile(rf"\[\s*(?:(?:{_STRING})\s*(?:,\s*)?)+\]")
_LINE_ENDS = re.compile(r"[ \t]*\r?\n[ \t]*")
_NEXT_LINE = re.compile(rf"\r?\n[ \t]+(?=(?:{_STRING})(?![ \t]*[:=])|\()")
_PLUS_BELOW = re.compile(r"\\?\r?\n[ \t]+(?=\+[ \t]*[\"'`])")
_NO_SECRET = re.compile(rf"(?:(?:{'|'.join(PLACEHOLDER_WORDS)})[\W_]*)+|your[\W_].*|<[^<>]*>", re.I | re.S)
_PREFIX = re.compile(r"(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR]|\$@?|@\$?|L)(?=[\"'])")
_TRIPLE = re.compile(r"\"\"\"|'''|```")
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", re.S)
_SCALAR = re.compile(r"[|>][+-]?\d?[ \t]*\r?\n((?:(?P<in>[ \t]+)\S[^\n]*)(?:\n(?P=in)[^\n]*)*)")
_HINT = re.compile(r"passw|passp|pwd|secret|token|key|cred|auth|bearer|signature|salt|dsn|pass", re.I | re.A)


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [NAME_PAIRS.get(x, 0.0) for x in zip(parts, parts[1:])]
    return max([NAME_PARTS.get(p, 0.0) for p in parts] + pairs + [0.0])


def _looks(counts: Iterable[float], kinds: int) -> float:
    """The score of so many characters of each sort and so many kinds of characters."""
    counts = list(counts)
    n = sum(counts)
    entropy = -sum(p * math.log2(p) for p in (c / n for c in counts) if p)
    return min(1.0, entropy / 3.5) * (0.4 + 0.2 * min(kinds, 3) if kinds > 1 else 0.4)


def _kinds(value: str) -> list[bool]:
    return [bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]


def literal_score(value: str) -> float:
    """0 to 1: how much the value looks like a secret: its length, its entropy a character, and kinds of characters."""
    if len(value) < LEAST_CHARS or any(p in value.lower() for p in PLACEHOLDERS) or _NO_SECRET.fullmatch(value) or re.search(r"\s", value):
        return 0.0
    return _looks(Counter(value).values(), sum(_kinds(value)))


#: How far a value is in being made of PLACEHOLDER_WORDS alone: at the beginning of a word (_BEGIN at the value's, _AFTER after a whole
#: word and what separates words), or in a word, told by its first letters. No word begins another, so there is one state at a time.
_BEGIN, _AFTER = "", " "
_STATES = [_BEGIN, _AFTER, *sorted({w[:n] for w in PLACEHOLDER_WORDS for n in range(1, len(w))})]
_LETTERS = sorted(set("".join(PLACEHOLDER_WORDS)))


@lru_cache(4096)
def _letter(c: str) -> str:
    """The letter that c is to _NO_SECRET, _AFTER for what separates words, nothing for others."""
    return _AFTER if re.fullmatch(r"[\W_]", c, re.I) else next((x for x in _LETTERS if re.fullmatch(x, c, re.I)), "")


_STEPS = {(s, x): _AFTER if s.strip() + x in PLACEHOLDER_WORDS else s.strip() + x for s in _STATES for x in _LETTERS if s.strip() + x in {*PLACEHOLDER_WORDS, *_STATES}} | {(_AFTER, _AFTER): _AFTER}


class Facts:
    """What literal_score looks at, in a form that is joined without the texts: numbers of characters, in the order of their first
    places and in units of 2 ** scale (0 till they no longer fit a float), the lower-case edges, and where the states end."""

    __slots__ = ("counts", "scale", "head", "tail", "marked", "white", "kinds", "opened", "closed", "moves")

    @classmethod
    def of(cls, text: str) -> Facts:
        out, low = cls(), text.lower()
        out.counts, out.scale = {c: float(n) for c, n in Counter(text).items()}, 0
        out.head, out.tail, out.marked = low[:_EDGE], low[-_EDGE:], any(p in low for p in PLACEHOLDERS)
        out.white, out.kinds, out.opened, out.closed = bool(re.search(r"\s", text)), _kinds(text), min(2, text.count("<")), min(2, text.count(">"))
        out.moves = {}
        for s in _STATES:
            end = s
            for c in text:
                end = _STEPS.get((end, _letter(c)))
                if end is None:
                    break
            else:
                out.moves[s] = end
        return out

    @classmethod
    def joined(cls, parts: list[Facts]) -> Facts:
        out, first = cls(), parts[0]
        for name in cls.__slots__:
            setattr(out, name, getattr(first, name))
        out.scale = max(f.scale for f in parts)
        out.counts = dict(first.counts) if first.scale == out.scale else {c: n * 2.0 ** (first.scale - out.scale) for c, n in first.counts.items()}
        for f in parts[1:]:
            unit = 2.0 ** (f.scale - out.scale)
            for c, n in f.counts.items():
                out.counts[c] = out.counts.get(c, 0.0) + n * unit
            out.marked = out.marked or f.marked or any(p in out.tail + f.head for p in PLACEHOLDERS)
            out.head = out.head if len(out.head) == _EDGE else (out.head + f.head)[:_EDGE]
            out.tail = (out.tail + f.tail)[-_EDGE:]
            out.white, out.kinds = out.white or f.white, [a or b for a, b in zip(out.kinds, f.kinds)]
            out.opened, out.closed = min(2, out.opened + f.opened), min(2, out.closed + f.closed)
            out.moves = {s: f.moves[end] for s, end in out.moves.items() if end in f.moves}
        if (over := math.frexp(sum(out.counts.values()))[1] - 53) > 0:
            out.scale += over
            out.counts = {c: n * 2.0**-over for c, n in out.counts.items()}
        return out

    def score(self) -> float:
        """literal_score of the text, if that has LEAST_CHARS."""
        hint = self.moves.get(_BEGIN) == _AFTER or re.match(r"your[\W_]", self.head) or self.head[0] == "<" and self.tail[-1] == ">" and self.opened == self.closed == 1
        return 0.0 if self.marked or self.white or hint else _looks(self.counts.values(), sum(self.kinds))


def _name_before(text: str, at: int) -> str:
    """The name that ends before position at; in `name: type =` the first of the two, in `x["name"] =` the subscript."""

    def subscript(end: int) -> tuple[int, str] | None:
        """The quoted name in the brackets of which the closing one is at end, and where the opening one is."""
        while end and text[end - 1] in " \t":
            end -= 1
        start = end = end - 1
        while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_$.-"):
            start -= 1
        if not 0 < start < end or text[end] not in "\"'" or text[start - 1] != text[end]:
            return None
        at = start - 1
        while at and text[at - 1] in " \t":
            at -= 1
        return (at - 1, text[start:end]) if at and text[at - 1] == "[" else None

    def word(end: int) -> tuple[int, str]:
        while end and text[end - 1] in " \t":
            end -= 1
        if end and text[end - 1] == "]" and (m := subscript(end - 1)):
            return m
        quote = end and text[end - 1] in "\"'"
        end -= bool(quote)
        start = end
        while start and (text[start - 1].isalnum() or text[start - 1] in "_$.-"):
            start -= 1
        return start - bool(quote and start and text[start - 1] in "\"'"), text[start:end]

    start, name = word(at)
    if text[at] == "=":
        back = start
        while back and text[back - 1] in " \t":
            back -= 1
        if back and text[back - 1] == ":" and name:
            outer = word(back - 1)[1]
            name = outer or name
    return name


class Rope:
    """Spans of literals in order: one, or those of other ropes. `told` once they were given out."""

    __slots__ = ("span", "parts", "told")

    def __init__(self, span: tuple[int, int] | None, parts: tuple[Rope, ...] = ()) -> None:
        self.span, self.parts, self.told = span, parts, False

    def untold(self) -> Iterator[tuple[int, int]]:
        """The spans that weren't given out before, by this rope or another, so all ropes of a text cost a step for each reference."""
        todo = [self]
        while todo:
            r = todo.pop()
            if not r.told:
                r.told = True
                if r.span:
                    yield r.span
                todo.extend(r.parts)
                r.parts = ()


class Value:
    """What a name stands for: a literal (its text and span) or parts that are values themselves; its size is counted up to LEAST_CHARS."""

    __slots__ = ("text", "rope", "parts", "size", "_facts", "_score")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None, parts: tuple[Value, ...] = ()) -> None:
        self.text, self.parts, self._facts, self._score = text, parts, None, None
        self.rope = Rope(span, tuple(p.rope for p in parts))
        self.size = min(LEAST_CHARS, len(text) if span else sum(p.size for p in parts))

    def facts(self) -> Facts:
        """Told once. Of the parts only the literals are kept then, so what a name stood for before goes."""
        todo = [self]
        while todo:
            v = todo[-1]
            if v._facts is None:
                if missing := [p for p in v.parts if p._facts is None]:
                    todo += missing
                    continue
                v._facts = Facts.of(v.text) if v.rope.span else Facts.joined([p._facts for p in v.parts])
                v.parts = tuple(p for p in v.parts if p.rope.span)
            todo.pop()
        return self._facts

    def score(self) -> float:
        if self._score is None:
            self._score = literal_score(self.text) if self.rope.span else self.facts().score() if self.size >= LEAST_CHARS else 0.0
        return self._score

    def untold(self, weight: float) -> Iterator[tuple[int, int]]:
        """The spans, as far as not given out before, of all its literals if together they score enough for a name of so much weight, or
        else of those literals at its own place that do by themselves."""
        if weight * self.score() >= LEAST_SCORE:
            yield from self.rope.untold()
        else:
            for p in self.parts:
                if p.rope.span and weight * p.score() >= LEAST_SCORE:
                    yield from p.rope.untold()


def _unescaped(text: str) -> str:
    """A literal's text with its escapes read; unknown ones stay for what follows the backslash."""
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else {"n": "\n", "t": "\t", "r": "\r", "\n": ""}.get(m[3], m[3]), text)


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """Name and value for each name-value pair in the order of the text. Names that were given a value before stand for it."""
    known: dict[str, Value] = {}
    skip = 0
    for m in re.finditer("[:=]", text):
        at = m.start()
        if at < skip:
            continue
        name = _name_before(text, at)
        if not name:
            continue
        pos, parts, direct = at + 1, [], False
        if text[pos : pos + 1] in ("=", ">") and text[at] in ":=":
            if text[at : pos + 1] == "==":
                continue
            pos += 1
        depth, goes_on = 0, False  # open parentheses; whether the expression goes on after a line's end
        while True:
            while pos < len(text) and text[pos] in (" \t\r\n" if depth or goes_on else " \t"):
                pos += 1
            if text[pos : pos + 1] == "\\" and (m := _LINE_ENDS.match(text, pos + 1)):
                pos = m.end()
            if not parts and text[pos : pos + 1] in ("\r", "\n") and (m := _NEXT_LINE.match(text, pos)):
                pos = m.end()  # a quoted value below its name, unless it is a name itself
            if pos >= len(text) or text[pos] in "\r\n":
                break
            c = text[pos]
            if c == "(" and not parts:
                depth += 1
                pos += 1
                continue
            if c == "[" and not parts and (m := _LIST.match(text, pos)):
                for x in re.finditer(_STRING, m[0]):
                    yield name, Value(_unescaped(x[0][1:-1]), (pos + x.start() + 1, pos + x.end() - 1))
                break
            if c in "|>" and not parts and (m := _SCALAR.match(text, pos)):
                lines = [(m.start(1) + x.start(1), x[1]) for x in re.finditer(r"[ \t]*([^\r\n]+)", m[1])]
                parts = [Value(x, (a, a + len(x))) for a, x in lines]
                break
            if m := _PREFIX.match(text, pos):
                pos = m.end()
                c = text[pos]
            if m := _TRIPLE.match(text, pos):
                end = text.find(m[0], m.end())
                end = len(text) if end < 0 else end
                parts.append(Value(_unescaped(text[m.end() : end]).strip(), (m.end(), end)))
                direct = True
                pos = min(len(text), end + 3)
            elif c in "\"'`":
                end = pos + 1
                while end < len(text) and text[end] not in (c, "\n"):
                    end += 2 if text[end] == "\\" else 1
                end = min(end, len(text))
                parts.append(Value(_unescaped(text[pos + 1 : end]), (pos + 1, end)))
                direct = True
                pos = end + 1
            else:
                word = _BARE.match(text, pos)
                if not word:
                    break
                ref = _NAME.match(text, pos)
                ref = ref and ref[0].rstrip(".-")
                if ref in known:
                    parts.append(known[ref])
                    pos += len(ref)
                elif parts:
                    break
                else:
                    parts, pos = [Value(word[0], word.span())], word.end()
            while pos < len(text) and text[pos] in (" \t\r\n" if depth else " \t"):
                pos += 1
            goes_on = False
            while depth and text[pos : pos + 1] == ")":
                depth, pos = depth - 1, pos + 1
                while pos < len(text) and text[pos] in " \t":
                    pos += 1
            if depth and text[pos : pos + 1] in ("'", '"') and direct:  # strings side by side
                continue
            if direct and (m := _PLUS_BELOW.match(text, pos)):
                pos = m.end()
            if pos < len(text) and text[pos] in "+." and (direct or text[pos] == "+"):
                goes_on = text[pos] == "+" and direct
                pos += 1
                continue
            break
        if parts:
            parts = [p for p in parts if p.size] or parts[:1]
            value = known[name] = parts[0] if len(parts) == 1 else Value(parts=tuple(parts))
            yield name, value
            if direct:
                skip = pos


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans in code points, in order. Base spans come as the patterns find them; lexed
    ones are added where no base span covers them."""
    if not text:
        return []
    assigns = ":" in text or "=" in text  # without either there is no assignment, and most texts have none
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12] if assigns else []
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if assigns and _HINT.search(text):
        base, added = list(out), set()
        for name, value in pairs(text):
            if value.size >= LEAST_CHARS and (n := name_score(name)):
                added |= {(a, 3, b) for a, b in value.untold(n) if not any(s <= a and b <= e for s, _, e in base)}
        out += added
    return sorted(out)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_lexed, base_sha256, spans of every row of docs (doc_id, text).

    spans joins kind:start:end of all spans by commas, base_sha256 digests those of the base patterns alone.
    A null text counts as empty; texts without spans have the empty string and its digest. One rule holds for values of any length.
    Work and memory follow the text, times the number of different characters of a value, also where names refer to themselves or to
    each other: a name's value is a list of references, scored by facts about its parts.
    """

    def start():
        told = lambda x: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x)

        def run(rows: dict[str, list]) -> dict[str, list]:
            found = [scan(t) for t in rows["text"]]
            out = {"doc_id": rows["doc_id"], "spans": [told(x) for x in found]}
            out["base_sha256"] = [hashlib.sha256(told([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found]
            return out | {f"n_{kind}": [sum(s[1] == k for s in x) for x in found] for k, kind in enumerate(KINDS)}

        return run

    return mapped(clean(docs, "doc_id", "text"), start, "doc_id long, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string")
