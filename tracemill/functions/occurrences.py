"""Which of many patterns which of many texts hold, for a slice of texts at a time.

Texts are one run of UTF-8 bytes, with a byte between them that UTF-8 does not have. Its places are sorted by the eight
bytes that begin there, once; all places of a literal are then a range, found by bisection, and longer literals are
checked eight bytes at a time from their rarest eight. A pattern is a list of parts, found one after the other, each at
its first place; in a part `_` is any one code point. The work follows what occurs, and not the number of patterns
times the number of texts.
"""

from __future__ import annotations

import re

import numpy as np

#: Bytes of texts that are sorted at a time; sorting takes some thirty times as much memory.
SLICE = 4 << 20
#: Numbers of parts that are kept for other patterns with the same part.
_KEPT = 4 << 20
_NEVER = np.iinfo(np.int32).max
_BETWEEN = 0xFF

_CHAR = rb"(?:[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*)"
_SIZE = np.ones(256, np.int32)
_SIZE[0xC0:0xE0], _SIZE[0xE0:0xF0], _SIZE[0xF0:] = 2, 3, 4


def _runs(part: str) -> tuple[list[bytes], list[int]]:
    """Literals of a part, and the number of `_` before each and after the last."""
    pieces = re.findall("(_*)([^_]*)", part)
    literals, gaps = [run.encode() for _, run in pieces if run], [len(gap) for gap, run in pieces if run]
    return literals, [*gaps, len(part) - len(part.rstrip("_"))]


def _chunk(literal: bytes) -> tuple[int, int]:
    """First and last key that begins with up to eight bytes."""
    low = int.from_bytes(literal[:8].ljust(8, b"\0"), "big")
    return low, low | ((1 << 8 * max(0, 8 - len(literal))) - 1)


def in_turn(text: bytes, parts: list[str]) -> bool:
    """Whether one text holds the parts in turn; takes no memory beside the text."""
    at = 0
    for part in parts:
        found = re.compile(re.escape(part.encode()).replace(b"_", _CHAR), re.S).search(text, at)
        if found is None:
            return False
        at = found.end()
    return True


class Patterns:
    """Patterns, each a list of parts that are not empty."""

    def __init__(self, patterns: list[list[str]]):
        self.patterns = patterns
        number: dict[str, int] = {}
        self.own = [[number.setdefault(p, len(number)) for p in parts] for parts in patterns]
        self.runs = [_runs(p) for p in number]
        self.times = np.bincount(np.array([i for own in self.own for i in own], np.int64), minlength=len(number))
        # every eight bytes of every literal that are looked up, and whose they are
        self.ranges, low, high, whose = [], [], [], []
        for i, (literals, _) in enumerate(self.runs):
            self.ranges.append([])
            for literal in literals:
                offsets = sorted({*range(0, max(1, len(literal) - 7), 8), max(0, len(literal) - 8)})
                self.ranges[-1].append((len(low), offsets))
                for at in offsets:
                    first, last = _chunk(literal[at : at + 8])
                    low.append(first)
                    high.append(last)
                    whose.append(i)
        self.low, self.high, self.whose = np.array(low, np.uint64), np.array(high, np.uint64), np.array(whose, np.int64)
        self.flat = np.array([i for own in self.own for i in own], np.int64)
        sizes = np.array([len(own) for own in self.own], np.int64)
        self.by = np.repeat(np.arange(len(patterns)), sizes)

    def found(self, texts: list[bytes]):
        """(number of a pattern, places of the texts that hold it, ascending) of every pattern that any text holds."""
        whole = _Slice(self, texts)
        alive = np.ones(len(self.patterns), bool)
        alive[self.by[~whole.alive[self.flat]]] = False
        for n in np.flatnonzero(alive).tolist():
            if len(held := whole.holders(self.own[n])):
                yield n, held


class _Slice:
    def __init__(self, patterns: Patterns, texts: list[bytes]):
        self.patterns, self.kept, self.room, self.n = patterns, {}, _KEPT, len(texts)
        between = bytes([_BETWEEN])
        self.bytes = np.frombuffer(between + between.join(texts) + between + bytes(8), np.uint8)
        n = len(self.bytes) - 8
        self.wide = any(not text.isascii() for text in texts)
        sizes = np.fromiter(map(len, texts), np.int32, len(texts)) + 1
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        self.text = np.r_[np.zeros(n - len(self.text), np.int32), self.text]  # the byte before the first text
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key <<= np.uint64(8)
            key |= self.bytes[i : i + n]
        self.key = key
        self.order = np.argsort(key).astype(np.int32)
        ordered = key[self.order]
        self.first = np.searchsorted(ordered, patterns.low, "left")
        self.last = np.searchsorted(ordered, patterns.high, "right")
        self.text_in_order = self.text[self.order]
        self.alive = np.ones(len(patterns.runs), bool)  # parts all of whose eight bytes occur
        self.alive[patterns.whose[self.first == self.last]] = False

    def _is(self, at: np.ndarray, literal: bytes, but: int = -1) -> np.ndarray:
        """Whether a literal is at places; `but` is an offset that is known to fit."""
        fits = None
        for i in range(0, len(literal), 8):
            if i != but:
                low, high = _chunk(literal[i : i + 8])
                there = self.key.take(at + np.int32(i), mode="clip")
                own = (there & np.uint64(low ^ high ^ (1 << 64) - 1)) == np.uint64(low)
                fits = own if fits is None else fits & own
        return np.ones(len(at), bool) if fits is None else fits

    def _places(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a part begins and ends, in any order, and in which texts."""
        literals, gaps = self.patterns.runs[i]
        if not literals:
            begin = np.flatnonzero(((self.bytes[: len(self.key)] & 0xC0) != 0x80) & (self.bytes[: len(self.key)] != _BETWEEN))
            begin, end = self._forward(begin.astype(np.int32), begin.astype(np.int32), [], gaps)
            return begin, end, self.text[begin]
        ranges = ((k + j, n, at) for n, (k, offsets) in enumerate(self.patterns.ranges[i]) for j, at in enumerate(offsets))
        k, n, at = min(ranges, key=lambda r: self.last[r[0]] - self.first[r[0]])
        here, literal = self.order[self.first[k] : self.last[k]], literals[n]
        if len(literals) == 1 and len(literal) <= 8 and not any(gaps):
            return here, here + np.int32(len(literal)), self.text_in_order[self.first[k] : self.last[k]]
        here = np.sort(here)  # what stands beside them is then looked up in one direction
        if len(literal) > 8:
            here = here - np.int32(at)
            here = here[here > 0] if at else here
            here = here[self._is(here, literal, at)]
        begin, anchor = self._backward(here, literals[:n], gaps[: n + 1])
        begin, end = self._forward(begin, anchor + np.int32(len(literal)), literals[n + 1 :], gaps[n + 1 :])
        return begin, end, self.text[begin]

    def _forward(self, begin, at, literals, gaps):
        """Places of which `gaps[0]` code points, a literal, and so on follow in the same text, with where that ends."""
        for n, gap in enumerate(gaps):
            for _ in range(gap):
                there = self.bytes[at]
                more = there != _BETWEEN
                begin, at = begin[more], at[more] + _SIZE[there[more]]
            if n < len(literals):
                more = self._is(at, literals[n])
                begin, at = begin[more], at[more] + np.int32(len(literals[n]))
        return begin, at

    def _backward(self, anchor, literals, gaps):
        """(begin, anchor) of the places before which literals and code points stand in the same text."""
        at = anchor
        for n in range(len(gaps) - 1, -1, -1):
            for _ in range(gaps[n]):
                at = at - np.int32(1)
                more = self.bytes[at] != _BETWEEN
                at, anchor = at[more], anchor[more]
                while self.wide and (inner := (self.bytes[at] & 0xC0) == 0x80).any():
                    at = at - inner
            if n:
                literal = literals[n - 1]
                more = at > len(literal)  # before all texts stands a byte
                at, anchor = at[more] - np.int32(len(literal)), anchor[more]
                more = self._is(at, literal)
                at, anchor = at[more], anchor[more]
        return at, anchor

    def _keep(self, kind: str, i: int, *made: np.ndarray):
        size = sum(map(len, made))
        if self.patterns.times[i] > 1 and size <= self.room:
            self.room -= size
            self.kept[kind, i] = made
        return made

    def _first_ends(self, i: int) -> np.ndarray:
        """Where the first place of a part ends in each text."""
        if ("first", i) in self.kept:
            return self.kept["first", i][0]
        _, end, text = self._places(i)
        first = np.full(self.n, _NEVER, np.int32)
        np.minimum.at(first, text, end)
        return self._keep("first", i, first)[0]

    def _last_begins(self, i: int) -> np.ndarray:
        """Where the last place of a part begins in each text, -1 where it has none."""
        if ("last", i) in self.kept:
            return self.kept["last", i][0]
        begin, _, text = self._places(i)
        last = np.full(self.n, -1, np.int32)
        np.maximum.at(last, text, begin)
        return self._keep("last", i, last)[0]

    def _ascending(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if ("all", i) in self.kept:
            return self.kept["all", i]
        begin, end, text = self._places(i)
        by = np.argsort(begin)
        return self._keep("all", i, begin[by], end[by], text[by])

    def _next_ends(self, i: int, at: np.ndarray) -> np.ndarray:
        """Where the first place of a part that begins at or after `at` ends in each text."""
        begin, end, text = self._ascending(i)
        place = np.searchsorted(begin, at)
        inside = np.flatnonzero(place < len(begin))
        inside = inside[text[place[inside]] == inside]
        after = np.full(self.n, _NEVER, np.int32)
        after[inside] = end[place[inside]]
        return after

    def holders(self, parts: list[int]) -> np.ndarray:
        """Places of the texts that hold the parts in turn."""
        if not parts:
            return np.arange(self.n)
        if len(parts) == 1:
            held = np.zeros(self.n, bool)
            held[self._places(parts[0])[2]] = True
            return np.flatnonzero(held)
        at = self._first_ends(parts[0])
        for part in parts[1:-1]:
            at = self._next_ends(part, at)
        return np.flatnonzero(at <= self._last_begins(parts[-1]))
