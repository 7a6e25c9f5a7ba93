"""Configuration text as leaves: the path of enclosing keys of every value, and where the value stands.

One tolerant reader takes JSON and the object literals of programming languages, YAML, TOML and INI, XML, ``.env`` and shell
assignments, connection strings, URL queries, call arguments and table rows, whole or in fragments. It keeps a stack of open
scopes (section, indented mapping, bracket, element), so a value gets the keys of all scopes around it. ``Scopes`` carries the
stack from line to line. Nothing is rejected: text that is no configuration has few leaves or none.

Offsets count characters of the text; ``byte_offsets`` turns them into bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple


class Leaf(NamedTuple):
    """A value with its keys from the outermost to its own; ``form`` is quoted, plain, element, cell or item."""

    path: tuple[str, ...]
    start: int
    end: int
    form: str
    sep: str = ""


class Frame(NamedTuple):
    """An open bracket: its sign, the key it is the value of, and the name it follows."""

    sign: str
    key: str | None
    callee: str


@dataclass
class Scopes:
    """What is open at the end of a line."""

    section: tuple[str, ...] = ()
    indents: list[tuple[int, str]] = field(default_factory=list)
    frames: list[Frame] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)

    def path(self) -> tuple[str, ...]:
        keys = [k for _, k in self.indents] + self.tags
        for f in self.frames:
            if f.key:
                keys += _parts(f.key)
        return (*self.section, *keys)

    def dump(self) -> list:
        return [list(self.section), [list(x) for x in self.indents], [list(f) for f in self.frames], self.tags]

    @classmethod
    def load(cls, d: list) -> Scopes:
        return cls(tuple(d[0]), [(int(a), b) for a, b in d[1]], [Frame(*f) for f in d[2]], list(d[3]))


NAME = r"[^\W\d][\w.\-]*"
_SECTION = re.compile(r"^\s*\[\[?\s*([^\[\]=,'\"{}()<>]*(?:[\"'][^\"'\[\]]*[\"'])?)\s*\]\]?\s*(?:[#;].*)?$")
_MAPPING = re.compile(r"^(?P<lead>[ \t]*(?:-[ \t]+)*)(?P<q>[\"']?)(?P<key>[^\W\d][\w.\-/]*+(?: [\w.\-/]++)*+)(?P=q)[ \t]*+:(?=[ \t]|$)[ \t]*(?P<rest>.*?)[ \t]*$")
_SCALAR = re.compile(r"^(?:[|>][+-]?\d?|&\w+|!\w*)?\s*(?:#.*)?$")
_ELEMENT = re.compile(rf"<(?P<close>/?)(?P<tag>{NAME}(?::{NAME})?)(?P<attrs>(?:\s+[\w.:\-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?P<empty>/?)>")
_ATTRIBUTE = re.compile(r"([\w.:\-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_TOKEN = re.compile(
    rf"""(?P<esc>\\["'](?P<ev>.*?)\\["'])
    | (?<!\w)(?P<q>["'`])(?P<v>(?:[^\\]|\\.)*?)(?P=q)
    | (?P<name>{NAME})
    | (?P<sep>=>|:=|<-|===?|!=|[<>]=|[=:])
    | (?P<open>[{{\[(]) | (?P<close>[}}\])])
    | (?P<end>[,;&|?]) | (?P<space>\s+) | (?P<other>.)""",
    re.X | re.S,
)
_PLAIN = re.compile(r"(?!//)[^\s\"'`;&<>|]+(?:;[^\s\"'`;&<>|=]++(?!=))?")
_KEY_LIKE = re.compile(r"^[\w.\-]{1,64}$")
_LOOKUP = re.compile(r"(?i)(?:^|[._])(?:get|env|read|load|lookup|input|prompt|ask)[^.]*$")  # a call that looks its argument up
_MOST_NESTED = 8  # texts within quotes within quotes


def _parts(key: str) -> list[str]:
    return [p for p in key.split(".") if p] or [key]


def _elements(line: str, at: int, scopes: Scopes, out: list[Leaf]) -> bool:
    """Leaves of the elements of a line; True if the line consists of them."""
    found = list(_ELEMENT.finditer(line))
    if not found:
        return False
    whole = line.lstrip().startswith("<")
    depth = len(scopes.tags)
    for m, following in zip(found, [*found[1:], None]):
        if m["close"]:
            if m["tag"] in scopes.tags:
                del scopes.tags[len(scopes.tags) - 1 - scopes.tags[::-1].index(m["tag"]) :]
            continue
        named, values = None, []
        for a in _ATTRIBUTE.finditer(m["attrs"]):
            span = a.span(2) if a[2] is not None else a.span(3)
            if a[1].lower() in ("key", "name", "id") and named is None:
                named = a[2] if a[2] is not None else a[3]
            values.append((a[1], span))
        base = m.start("attrs") + at
        for key, (x, y) in values:
            own = (named,) if named and key.lower() in ("value", "val", "content", "default") else (key,)
            out.append(Leaf((*scopes.path(), m["tag"], *own), base + x, base + y, "quoted", "="))
        if m["empty"]:
            continue
        scopes.tags.append(m["tag"])
        text_end = following.start() if following else len(line)
        text = line[m.end() : text_end]
        if text.strip() and (whole if following is None else following["close"]):
            lead = len(text) - len(text.lstrip())
            out.append(Leaf((*scopes.path(), *([named] if named else [])), at + m.end() + lead, at + m.end() + len(text.rstrip()), "element"))
    if not whole:
        del scopes.tags[depth:]
    return whole


def _tokens(line: str, at: int, scopes: Scopes, out: list[Leaf], prefix: tuple[str, ...] = (), nested: int = 0) -> None:
    """Leaves of assignments, mappings, indexes and calls of a line."""
    frames = scopes.frames
    key: str | None = None  # waits for its value
    last: tuple[str, str] | None = None  # kind and text of the token before
    index: str | None = None  # text within a closed index
    positional: list[str | None] = [None]
    pos, size = 0, len(line)

    def where(*own: str) -> tuple[str, ...]:
        return (*prefix, *scopes.path(), *own)

    def quoted(text: str, a: int, b: int) -> None:
        nonlocal key, last
        frame = frames[-1] if frames else None
        if key is not None:
            out.append(Leaf(where(*_parts(key)), at + a, at + b, "quoted", sep))
        elif frame and frame.sign == "(":
            named = positional[-1]
            if named:
                out.append(Leaf(where(named), at + a, at + b, "quoted", "("))
            elif frame.callee and not _LOOKUP.search(frame.callee):
                out.append(Leaf((*prefix, *scopes.path(), *([] if frame.key else [frame.callee])), at + a, at + b, "quoted", "("))
            positional[-1] = text if _KEY_LIKE.match(text) else None
        elif frame and frame.sign == "[":
            out.append(Leaf(where("[]"), at + a, at + b, "quoted", "["))
        if nested < _MOST_NESTED and re.search(r"[:=]", text):
            _tokens(text, at + a, Scopes(), out, where(*(_parts(key) if key is not None else ())), nested + 1)
        last, key = ("string", text), None

    sep = ""
    while pos < size:
        m = _TOKEN.match(line, pos)
        start, pos = pos, m.end()
        kind = m.lastgroup
        if m["space"] is not None:
            if last and last[0] == "name":
                last = ("spaced", last[1])
            continue
        if m["esc"] is not None:
            quoted(m["ev"], *m.span("ev"))
        elif m["q"] is not None:
            quoted(m["v"], *m.span("v"))
        elif m["name"] is not None:
            if key is not None:
                value = _PLAIN.match(line, start)
                follows = line[pos : pos + 1]
                if value and not (follows == "(" and value[0].endswith("(")):
                    out.append(Leaf(where(*_parts(key)), at + start, at + value.end(), "plain", sep))
                if follows == "(":
                    last = ("name", m["name"])
                    continue
                key = None
            last = ("name", m["name"])
        elif m["sep"] is not None:
            name = index if index is not None else last[1] if last and last[0] in ("name", "spaced", "string") else None
            key = name if m["sep"] in ("=", ":", ":=", "=>", "<-") and name else None
            left = len(line[:start]) - len(line[:start].rstrip())
            right = len(line[pos:]) - len(line[pos:].lstrip())
            sep = " " * left + m["sep"] + " " * right
            last = index = None
            value = _PLAIN.match(line, pos + right) if key is not None else None
            if value and not re.match(rf"{NAME}|[{{\[(\\]", value[0]):
                out.append(Leaf(where(*_parts(key)), at + value.start(), at + value.end(), "plain", sep))
        elif m["open"] is not None:
            callee = last[1] if last and (last[0] == "name" or last[0] == "spaced" and m["open"] == "(") else ""
            frames.append(Frame(m["open"], key, callee))
            positional.append(None)
            key = last = None
        elif m["close"] is not None:
            text = last[1] if last and last[0] == "string" else None
            if frames:
                closed = frames.pop()
                index = f"{closed.callee}.{text}" if text and closed.sign == "[" and closed.callee else None
                if len(positional) > 1:
                    positional.pop()
            key = last = None
            continue
        elif m["end"] is not None:
            key = last = None
        else:
            last = None
        if kind != "sep":
            index = None


def _rows(line: str, at: int, out: list[Leaf]) -> None:
    """Leaves of a table row: the first cell names the others."""
    cells = [(c.start(), c[0]) for c in re.finditer(r"[^|]+", line)]
    cells = [(s + len(c) - len(c.lstrip()), c.strip()) for s, c in cells if c.strip()]
    if len(cells) < 2 or not _KEY_LIKE.match(cells[0][1].strip("`*_")):
        return
    for s, c in cells[1:]:
        marks = 1 if len(c) > 2 and c[0] == c[-1] and c[0] in "`\"'" else 0
        out.append(Leaf((cells[0][1].strip("`*_"),), at + s + marks, at + s + len(c) - marks, "cell", "|"))


def read_line(line: str, at: int, scopes: Scopes) -> list[Leaf]:
    """Leaves of one line; ``scopes`` moves on to what is open after it."""
    out: list[Leaf] = []
    body = line.strip()
    if not body:
        return out
    if not scopes.frames:
        if m := _SECTION.match(line):
            scopes.section, scopes.indents, scopes.tags = tuple(_parts(m[1].strip().strip("\"'"))), [], []
            return out
        lead = len(line) - len(line.lstrip(" \t"))
        y = _MAPPING.match(line)
        column = len(y["lead"]) if y else lead
        while scopes.indents and scopes.indents[-1][0] >= column and not (body.startswith("-") and scopes.indents[-1][0] == column and not y):
            scopes.indents.pop()
        if y and _SCALAR.match(y["rest"]):
            scopes.indents.append((column, y["key"]))
            return out
        if not y and scopes.indents:
            item = re.sub(r"^-\s+", "", body).strip("\"'")
            begin = line.find(item)
            if item and not re.search(r"[=:{\[<]", item):
                out.append(Leaf((*scopes.path(), "[]"), at + begin, at + begin + len(item), "item", ":"))
    if body.startswith("|"):
        _rows(line, at, out)
        return out
    if "<" in line and _elements(line, at, scopes, out):
        return out
    if scopes.tags and not re.search(r"[<>=]", body):
        begin = line.find(body)
        out.append(Leaf(scopes.path(), at + begin, at + begin + len(body), "element"))
    _tokens(line, at, scopes, out)
    # Arguments on later lines are no values of the key that the call is assigned to.
    scopes.frames = [f._replace(key=None) if f.sign == "(" else f for f in scopes.frames]
    return out


def read_text(text: str, scopes: Scopes | None = None) -> list[Leaf]:
    """Leaves of a text of one or more lines, in order of their lines."""
    scopes = Scopes() if scopes is None else scopes
    out, at = [], 0
    for line in text.split("\n"):
        out += read_line(line.removesuffix("\r"), at, scopes)
        at += len(line) + 1
    return out


def byte_offsets(text: str, places: list[int]) -> list[int]:
    """Byte offsets of character offsets given in rising order."""
    out, at, size = [], 0, 0
    for p in places:
        size += len(text[at:p].encode("utf-8", "surrogatepass"))
        out.append(size)
        at = p
    return out
