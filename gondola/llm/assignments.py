"""Assignments in source and configuration text, read from tokens in one linear pass.

What is assigned to may be a name with dots, a subscript (``config["key"]``), a quoted key,
or a name with a type; the value a string, strings put together with ``+`` or side by side,
a bare word, a YAML block scalar, the text of an XML element, or the name of something
assigned before, as long as its block lasts: an assignment is forgotten when a line is
indented less.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Span = tuple[int, int]

# Every repetition is possessive, so that no stretch is scanned once for each of its places.
STRING = (
    r"(?<![A-Za-z0-9_])(?P<prefix>[A-Za-z]{0,2})(?:"
    r'"""(?P<long>(?:[^"\\]|\\.|"(?!""))*+)"""'
    r"|'''(?P<longs>(?:[^'\\]|\\.|'(?!''))*+)'''"
    r'|"(?P<double>(?:[^"\\\n]|\\[^\n])*+)"'
    r"|'(?P<single>(?:[^'\\\n]|\\[^\n])*+)')")
TOKEN = re.compile(
    rf"(?P<string>{STRING})"
    r"|(?P<name>[A-Za-z_][A-Za-z0-9_\-]*+)"
    r"|(?P<line>\n[\x20\t]*+)"
    r"|(?P<op>=>|:=|[=!<>]=|->|[=:+.,;\[\]<>|&?(){}])"
    r"""|(?P<other>[^\s"'=:+.,;\[\]<>|&?(){}!A-Za-z_]++|\S)""", re.ASCII | re.DOTALL)
BARE = re.compile(r"""[^\s"',;#(){}\[\]]++""")
BLOCK_SCALAR = re.compile(r"[|>][+\-0-9]{0,2}[\x20\t]*+\n")
ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]{0,99}+)(?:\s[^<>]*+)?>([^<>]++)</\1>", re.ASCII)
KEY = re.compile(r"[A-Za-z_][\w.\-\x20]{0,99}\Z", re.ASCII)

ASSIGNS = frozenset(["=", ":=", "=>", ":"])
TYPE_TOKENS = frozenset([".", "[", "]", "|", ",", "?", "&", "<", ">"])

#: Tokens looked back over for a type, parts of a dotted name, pieces of a value.
MOST_TYPE_TOKENS, MOST_PARTS, MOST_PIECES = 24, 8, 64


class Reader:
    """Which pieces of text are assigned to which names, constants put in their place.

    ``reached`` gives, for every value (a tuple of spans), the weightiest name it reaches;
    ``quoted`` the values that are quoted as a whole.
    """

    def __init__(self, text: str, weight: Callable[[str], float]):
        self.text, self.weight = text, weight
        self.tokens = list(TOKEN.finditer(text))
        self.kinds = ["string" if m["string"] is not None else m.lastgroup for m in self.tokens]
        self.held: dict[str, list[tuple[Span, ...]]] = {}
        self.open: list[tuple[int, str]] = []  # indent and name of what is in force
        self.reached: dict[tuple[Span, ...], tuple[float, str]] = {}
        self.quoted: set[tuple[Span, ...]] = set()
        self._read()
        for m in ELEMENT.finditer(text):
            self._give(m[1], (m.span(2),), True)

    def _kind(self, at: int) -> str | None:
        return self.kinds[at] if 0 <= at < len(self.kinds) else None

    def _is_op(self, at: int, *ops: str) -> bool:
        return self._kind(at) == "op" and self.tokens[at][0] in ops

    def _inside(self, at: int) -> Span:
        """Where the text of a string token lies."""
        m = self.tokens[at]
        return next(m.span(g) for g in ("long", "longs", "double", "single") if m[g] is not None)

    # Targets

    def _dotted(self, at: int) -> str:
        """The name that ends at a token, with the names before its dots."""
        parts = [self.tokens[at][0]]
        while self._is_op(at - 1, ".") and self._kind(at - 2) == "name" and len(parts) < MOST_PARTS:
            at -= 2
            parts.append(self.tokens[at][0])
        return ".".join(reversed(parts))

    def _typed(self, at: int) -> str | None:
        """The name before ``: type`` if that stands before an equals sign."""
        if not self._is_op(at, "=", ":="):
            return None
        for back in range(at - 1, max(at - 2 - MOST_TYPE_TOKENS, 0), -1):
            if self._is_op(back, ":"):
                return self._dotted(back - 1) if self._kind(back - 1) == "name" else None
            if self._kind(back) != "name" and not self._is_op(back, *TYPE_TOKENS):
                return None
        return None

    def _target(self, at: int) -> str | None:
        """What the operator at a token assigns to."""
        before = self._kind(at - 1)
        if before == "string":
            start, end = self._inside(at - 1)
            return self.text[start:end] if KEY.match(self.text[start:min(end, start + 101)]) else None
        if before == "name":
            return self._typed(at) or self._dotted(at - 1)
        if self._is_op(at - 1, "]") and self._kind(at - 2) == "string" and self._is_op(at - 3, "["):
            start, end = self._inside(at - 2)
            owner = self._dotted(at - 4) if self._kind(at - 4) == "name" else ""
            return f"{owner}.{self.text[start:min(end, start + 100)]}"
        return self._typed(at)

    # Values

    def _constant(self, at: int) -> tuple[int, tuple[Span, ...]] | None:
        """The token after a name with its dots, and the value that the name stands for."""
        name, end = self.tokens[at][0], at + 1
        while self._is_op(end, ".") and self._kind(end + 1) == "name" and end - at < 2 * MOST_PARTS:
            name += "." + self.tokens[end + 1][0]
            end += 2
        kept = self.held.get(name)
        return (end, kept[-1]) if kept else None

    def _value(self, at: int) -> tuple[tuple[Span, ...], bool]:
        """Pieces of the value that starts at a token, and whether all of it is quoted."""
        spans: list[Span] = []
        quoted = True
        while len(spans) < MOST_PIECES:
            kind = self._kind(at)
            if kind == "string":
                spans.append(self._inside(at))
                at += 1
            elif kind == "name" and (known := self._constant(at)):
                at, pieces = known
                spans += pieces
                quoted = quoted and pieces in self.quoted
            elif not spans and kind in ("name", "other"):
                bare = BARE.match(self.text, self.tokens[at].start())
                return ((bare.span(),) if bare else ()), False
            else:
                break
            if self._is_op(at, "+"):
                at += 1
            elif self._kind(at) != "string":
                break
        return tuple(s for s in spans if s[0] < s[1]), quoted

    def _block_scalar(self, at: int, indent: int) -> tuple[Span, ...]:
        """Lines indented further than their key, one piece each."""
        header = BLOCK_SCALAR.match(self.text, self.tokens[at].start())
        start, spans = header.end() if header else len(self.text), []
        while start < len(self.text):
            stop = self.text.find("\n", start)
            stop = len(self.text) if stop < 0 else stop
            line = self.text[start:stop]
            depth = len(line) - len(line.lstrip())
            if depth < len(line):
                if depth <= indent:
                    break
                spans.append((start + depth, start + len(line.rstrip())))
            start = stop + 1
        return tuple(spans)

    # Reading

    def _give(self, name: str, spans: tuple[Span, ...], quoted: bool) -> None:
        if quoted:
            self.quoted.add(spans)
        weight = self.weight(name)
        if weight > self.reached.get(spans, (0.0, ""))[0]:
            self.reached[spans] = (weight, name)

    def _read(self) -> None:
        indent = scalar_ends = 0
        for at, (kind, m) in enumerate(zip(self.kinds, self.tokens)):
            if kind == "line":
                indent = len(m[0]) - 1
                if self._kind(at + 1) not in ("line", None):
                    while self.open and self.open[-1][0] > indent:
                        self.held[self.open.pop()[1]].pop()
            elif kind == "op" and m[0] in ASSIGNS and m.start() >= scalar_ends:
                name = self._target(at)
                if not name:
                    continue
                spans, quoted = (), True
                if m[0] == ":" and self._is_op(at + 1, "|", ">"):
                    spans = self._block_scalar(at + 1, indent)
                    scalar_ends = spans[-1][1] if spans else 0
                elif self._kind(at + 1) != "line":
                    spans, quoted = self._value(at + 1)
                if spans:
                    self._give(name, spans, quoted)
                    self.held.setdefault(name, []).append(spans)
                    self.open.append((indent, name))

