"""User patterns: read by a small grammar, refused where matching could take more than polynomial time, and written anew in a form that Spark's engine accepts.

Java's engine backtracks. A loop inside a loop is safe only if at every step the next character decides how to go on, so such loops must be
*deterministic*: no two places that could come next share a character (Glushkov's automaton). Loops that are not nested cost a power of the text's
length each, so there may be ``MOST_LOOPS`` of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _constants as K
from re import _parser as P

MOST_LOOPS, MANY = 3, 16
_ALL = frozenset(range(129))  # ASCII, and 128 for all beyond
_KINDS = {K.CATEGORY_DIGIT: (r"\d", "0123456789"), K.CATEGORY_SPACE: (r"\s", " \t\n\r\f\v"), K.CATEGORY_WORD: (r"\w", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")}
_NOT = {K.CATEGORY_NOT_DIGIT: (r"\D", K.CATEGORY_DIGIT), K.CATEGORY_NOT_SPACE: (r"\S", K.CATEGORY_SPACE), K.CATEGORY_NOT_WORD: (r"\W", K.CATEGORY_WORD)}
_EDGES = {K.AT_BEGINNING: "^", K.AT_END: "$", K.AT_BOUNDARY: r"\b", K.AT_NON_BOUNDARY: r"\B", K.AT_BEGINNING_STRING: r"\A", K.AT_END_STRING: r"\z"}


class Refused(ValueError):
    """A construct outside the grammar, or too many loops."""


@dataclass
class Part:
    """A piece of a pattern: its new text, the characters it can begin and end with by place, whether it can be empty, and what can follow each place."""

    text: str
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    empty: bool = True
    loops: int = 0


class _Reader:
    def __init__(self):
        self.chars: list[frozenset[int]] = []
        self.after: list[set[int]] = []

    def place(self, text: str, chars: frozenset[int]) -> Part:
        self.chars.append(chars)
        self.after.append(set())
        k = len(self.chars) - 1
        return Part(text, [k], [k], False)

    def clear(self, places) -> bool:
        """No two of the places share a character."""
        seen: set[int] = set()
        for k in places:
            if seen & self.chars[k]:
                return False
            seen |= self.chars[k]
        return True

    def join(self, a: Part, b: Part) -> Part:
        for k in a.last:
            self.after[k].update(b.first)
        return Part(a.text + b.text, a.first + (b.first if a.empty else []), b.last + (a.last if b.empty else []), a.empty and b.empty, a.loops + b.loops)

    def read(self, items) -> Part:
        out = Part("")
        for op, value in items:
            out = self.join(out, self.one(op, value))
        return out

    def one(self, op, value) -> Part:
        if op is K.LITERAL:
            return self.place(_literal(value), frozenset([min(value, 128)]))
        if op is K.NOT_LITERAL:
            return self.place(f"[^{_literal(value)}]", _ALL - {value})
        if op is K.ANY:
            return self.place(".", _ALL - {10})
        if op is K.IN:
            return self.place(*_class(value))
        if op is K.AT and value in _EDGES:
            return Part(_EDGES[value])
        if op is K.SUBPATTERN:
            _, add, drop, inner = value
            if add or drop:
                raise Refused("flags in a group")
            p = self.read(inner)
            return Part(f"(?:{p.text})", p.first, p.last, p.empty, p.loops)
        if op is K.BRANCH:
            ps = [self.read(x) for x in value[1]]
            if sum(p.empty for p in ps) > 1:
                raise Refused("two alternatives that can be empty")
            return Part("(?:" + "|".join(p.text for p in ps) + ")", [k for p in ps for k in p.first], [k for p in ps for k in p.last], any(p.empty for p in ps), max(p.loops for p in ps))
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            return self.loop(*value, op is K.MIN_REPEAT)
        raise Refused(f"{op} is not supported")

    def loop(self, least, most, inner, lazy) -> Part:
        start = len(self.chars)
        p = self.read(inner)
        many = most is K.MAXREPEAT or most > MANY
        simple = len(self.chars) - start == 1 and not p.loops
        if least == 0 and p.empty:
            raise Refused("a part that may be left out and may be empty")
        if most is K.MAXREPEAT or most > 1:
            if p.empty or any(x in self.after[k] for k in p.last for x in p.first):
                raise Refused("a loop around a loop of the same characters")
            for k in p.last:
                self.after[k].update(p.first)
            if not simple and not (self.clear(p.first) and all(self.clear(x for x in self.after[k] if x >= start) for k in range(start, len(self.chars)))):
                raise Refused("a repeated group in which the next character does not decide how to go on")
        top = "" if most is K.MAXREPEAT else str(most)
        text = f"(?:{p.text}){{{least},{top}}}" + "?" * lazy
        return Part(text, p.first, p.last, p.empty or least == 0, p.loops + int(many))


def _literal(c: int) -> str:
    return chr(c) if chr(c).isalnum() or c > 127 else f"\\x{c:02x}"


def _class(items) -> tuple[str, frozenset[int]]:
    text, chars, negated = "", frozenset(), False
    for op, value in items:
        if op is K.NEGATE:
            negated = True
        elif op is K.LITERAL:
            text, chars = text + _literal(value), chars | {min(value, 128)}
        elif op is K.RANGE:
            text, chars = f"{text}{_literal(value[0])}-{_literal(value[1])}", chars | {min(c, 128) for c in range(value[0], min(value[1], 128) + 1)} | ({128} if value[1] > 127 else set())
        elif op is K.CATEGORY and value in _KINDS:
            text, chars = text + _KINDS[value][0], chars | set(map(ord, _KINDS[value][1]))
        elif op is K.CATEGORY and value in _NOT:
            text, chars = text + _NOT[value][0], chars | (_ALL - set(map(ord, _KINDS[_NOT[value][1]][1])))
        else:
            raise Refused(f"{op} in a class")
    return f"[{'^' if negated else ''}{text}]", (_ALL - chars | {128} if negated else frozenset(chars))


def safe_pattern(pattern: str | None) -> str | None:
    """The pattern, lower-cased, in a form that Spark's engine compiles and matches in polynomial time; None if it does not compile, uses look-around, back references, flags or atomic groups, or could run without end."""
    p = (pattern or "").strip().lower()
    try:
        read = _Reader().read(P.parse(p))
    except (re.error, Refused, OverflowError, RecursionError):
        return None
    return read.text if read.loops <= MOST_LOOPS else None
