"""Secret scans by one deterministic automaton over bytes.

All rules are parsed to one position automaton, made deterministic by subset construction over byte classes, minimised by
partition refinement and laid out as a transition array. A batch of documents is cut into lanes at bytes that lead to the
start state from every state, so lanes are independent; the array then steps all lanes at once, one byte each, and the last few
long ones by themselves. An accepting state says which rules match. Lanes that reach one (few) are read once more, backwards, by the
combined automaton of the reversed rules, which marks the places where a match of each rule begins. From these, leftmost, longest
and without overlaps, the rules' own automata find the ends. No rule's automaton goes on after a match's end without matching still, so
all of it is linear in the text, whatever the text.

Nulls and empty texts have no spans. Texts of any length are scanned whole; a worker holds about 12 bytes for each of a slice's own, and
a slice is ``SLICE_BYTES`` or one text. Spans count code points, with the end excluded. Spans of different rules may overlap; they
are ordered by start and, where starts tie, by rule. Repeated rows are scanned alike. An empty table gives an empty result. Extra columns
don't matter, whatever their names; :func:`redact` carries them along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, byte_slices, map_rows

LANE = 512
#: Lanes up to which each is stepped by itself.
ALONE = 48


@dataclass(frozen=True)
class Rule:
    """``pattern``: matched leftmost and longest. A match counts if its group (0: all of it) has ``least`` characters.

    ``detect``: a pattern that matches within each match that counts, for the combined automaton; the pattern itself if None.
    """

    kind: str
    pattern: str
    least: int = 1
    tail: str | None = None  # the class of the last group's characters; None: the length is that of the whole match
    detect: str | None = None
    fold: bool = False


# The three base rules, then rules that this method adds.
RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, "group", fold=True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16, detect=r"[0-9a-f]{16}[0-9a-f]*"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
BASE = 3


class Nfa:
    """Thompson's construction from a small regex dialect: classes, groups, |, ?, *, +, {m}, escapes \\xHH and \\c."""

    def __init__(self) -> None:
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append(None)
        self.free.append([])
        return len(self.moves) - 1

    def add(self, pattern: str, fold: bool) -> tuple[int, int, dict[int, int]]:
        """Start and end state; for each group its number and start state."""
        self.p, self.i, self.fold, self.groups, self.n = pattern, 0, fold, {}, 0
        start, end = self.alternatives()
        if self.i != len(pattern):
            raise ValueError(f"can't parse {pattern!r} at {self.i}")
        return start, end, self.groups

    def alternatives(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.free[start].append(a)
            self.free[b].append(end)
            if self.p[self.i : self.i + 1] != "|":
                return start, end
            self.i += 1

    def sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            at = self.i
            a, b = self.atom()
            op = self.p[self.i : self.i + 1]
            if op == "{":
                close = self.p.index("}", self.i)
                times = int(self.p[self.i + 1 : close])
                for _ in range(times - 1):
                    self.i = at
                    c, d = self.atom()
                    self.free[b].append(c)
                    b = d
                self.i = close + 1
            elif op and op in "?*+":
                self.i += 1
                s, e = self.state(), self.state()
                self.free[s].append(a)
                self.free[b].append(e)
                if op in "?*":
                    self.free[s].append(e)
                if op in "*+":
                    self.free[b].append(a)
                a, b = s, e
            self.free[end].append(a)
            end = b
        return start, end

    def atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            self.n += 1
            number = self.n
            a, b = self.alternatives()
            self.i += 1
            self.groups[number] = a
            return a, b
        found = self.bytes_of_class() if c == "[" else self.folded({self.char()})
        a, b = self.state(), self.state()
        self.moves[a] = (frozenset(found), b)
        return a, b

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def bytes_of_class(self) -> set[int]:
        self.i += 1
        out: set[int] = set()
        while self.p[self.i] != "]":
            a = self.char()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                out |= set(range(a, self.char() + 1))
            else:
                out.add(a)
        self.i += 1
        return self.folded(out)

    def folded(self, of: set[int]) -> set[int]:
        return of | {x ^ 32 for x in of if chr(x).isalpha() and x < 128} if self.fold else of

    def closure(self, of: set[int]) -> frozenset[int]:
        todo, seen = list(of), set(of)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


    def reversed(self) -> Nfa:
        """The same states with all moves the other way round."""
        out = Nfa()
        for _ in self.moves:
            out.state()
        for x, move in enumerate(self.moves):
            for t in self.free[x]:
                out.free[t].append(x)
            if move:
                out.free[move[1]].append(mid := out.state())
                out.moves[mid] = (move[0], x)
        return out


@dataclass(frozen=True)
class Dfa:
    """``table[state, classes[byte]]``; state 0 is the start. ``accepts[state]``: a bit for each end; ``dead``: a state that nothing leaves, or -1."""

    table: np.ndarray
    classes: np.ndarray
    accepts: np.ndarray
    dead: int


def determine(nfa: Nfa, starts: set[int], ends: dict[int, int], search: bool) -> Dfa:
    """Subset construction and minimisation. ``ends``: states and their bits. ``search``: a match may begin at any byte."""
    kinds: dict[tuple[bool, ...], int] = {}
    sets = [m[0] for m in nfa.moves if m]
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    example = [int(np.flatnonzero(classes == k)[0]) for k in range(len(kinds))]
    first = nfa.closure(starts)
    known, todo, rows = {first: 0}, [first], []
    while todo:
        now, todo = todo, []
        for s in now:
            row = []
            for b in example:
                t = nfa.closure({m[1] for x in s if (m := nfa.moves[x]) and b in m[0]}) | (first if search else frozenset())
                if t not in known:
                    known[t] = len(known)
                    todo.append(t)
                row.append(known[t])
            rows.append(row)
    table = np.array(rows, np.int64)
    accepts = np.array([sum(1 << b for b in {ends[x] for x in s if x in ends}) for s in known], np.int64)
    block = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:  # refine until states of a block go to the same blocks
        key = np.column_stack([block, block[table]])
        _, new = np.unique(key, axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == block.max():
            break
        block = new
    order = {}
    for b in block[np.arange(len(block))]:
        order.setdefault(int(b), len(order))  # the start's block comes first
    block = np.array([order[int(b)] for b in block])
    keep = np.array([int(np.flatnonzero(block == k)[0]) for k in range(len(order))])
    table, accepts = block[table[keep]], accepts[keep]
    stuck = np.flatnonzero((table == np.arange(len(table))[:, None]).all(1) & (accepts == 0))
    return Dfa(table.astype(np.int32), classes, accepts, int(stuck[0]) if len(stuck) and not search else -1)


class Scanner:
    """The combined automaton of ``rules`` and, for resolving, one automaton for each rule."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules, both, whole = rules, Nfa(), Nfa()
        starts, ends, begins, stops = set(), {}, {}, set()
        for k, r in enumerate(rules):
            a, b, _ = both.add(r.detect or r.pattern, r.fold)
            starts.add(a)
            ends[b] = k
            a, b, _ = whole.add(r.pattern, r.fold)
            begins[a] = k
            stops.add(b)
        self.all = determine(both, starts, ends, search=True)
        back = determine(whole.reversed(), stops, begins, search=True)
        self.back, self.begins = back.table[:, back.classes].tolist(), back.accepts.tolist()
        own = []
        for r in rules:
            nfa = Nfa()
            a, b, _ = nfa.add(r.pattern, r.fold)
            d = determine(nfa, {a}, {b: 0}, search=False)
            after = np.isin(d.table[d.accepts > 0], [d.dead, *np.flatnonzero(d.accepts)])
            if not after.all():
                raise ValueError(f"rule {r.kind}: after a match's end its automaton may go on without matching")
            own.append((r, d.table[:, d.classes].tolist(), d.accepts.tolist(), d.dead))
        self.own = own
        t, k = self.all.table, self.all.table.shape[1]
        self.flat = np.ascontiguousarray((t * k).ravel().astype(np.int32))
        self.hit = np.zeros(len(t) * k, np.int64)
        self.hit[np.arange(len(t)) * k] = self.all.accepts
        self.step, self.ends = t[:, self.all.classes].tolist(), self.all.accepts.tolist()
        self.resets = (t == 0).all(0)[self.all.classes]

    def lanes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of documents in which some rule may match, and the bits of these rules."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        resets = np.flatnonzero(self.resets[data]) + 1
        cut = resets[np.minimum(np.searchsorted(resets, np.arange(LANE, n, LANE)), len(resets) - 1)] if len(resets) else np.zeros(0, np.int64)
        starts = np.unique(np.concatenate([offsets[:-1], cut]))
        starts = starts[starts < n]
        ends = np.append(starts[1:], n)
        order = np.argsort(starts - ends, kind="stable")  # long lanes first: those that go on are a prefix
        at, length = starts[order], (ends - starts)[order]
        state, hit = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        classes, flat = self.all.classes, self.flat
        codes = classes[data]
        longest = int(length[min(ALONE, len(length) - 1)]) if len(length) > ALONE else 0
        going = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
        for j, k in enumerate(going.tolist()):
            s = flat[state[:k] + codes[at[:k] + j]]
            state[:k] = s
            hit[:k] |= self.hit[s]
        step, ends_of, width = self.step, self.ends, self.all.table.shape[1]
        for lane in np.flatnonzero(length > longest).tolist():
            s, bits = int(state[lane]) // width, int(hit[lane])
            for c in data[at[lane] + longest : at[lane] + length[lane]].tobytes():
                s = step[s][c]
                bits |= ends_of[s]
            hit[lane] = bits
        found = np.flatnonzero(hit)
        found = found[np.argsort(order[found])]
        return starts[order[found]], ends[order[found]], hit[found]

    def resolve(self, text: bytes, bits: int) -> list[tuple[int, int, int]]:
        """(start, end, rule's place) of the matches that count, of the rules in ``bits``, in a text at whose ends no match is under way."""
        back, begins, state, marks = self.back, self.begins, 0, []
        for i in range(len(text) - 1, -1, -1):
            state = back[state][text[i]]
            if begins[state] & bits:
                marks.append((i, begins[state]))
        marks.reverse()
        out = []
        for k, (rule, step, accepts, dead) in enumerate(self.own):
            if not bits >> k & 1:
                continue
            done = 0
            for i, at in marks:
                if i < done or not at >> k & 1:
                    continue
                state, last, begun = 0, -1, -1
                for j in range(i, len(text)):
                    state = step[state][text[j]]
                    if state == dead:
                        break
                    if accepts[state]:
                        begun = j if begun < 0 else begun
                        last = j + 1
                if last - (begun if rule.tail else i) >= rule.least:
                    out.append((i, last, k))
                done = last
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each document with matches its spans in code points, by start and then by rule."""
        starts, ends, bits = self.lanes(data, offsets)
        docs = np.searchsorted(offsets, starts, side="right") - 1
        found: dict[int, list[tuple[int, int, int]]] = {}
        for d, a, b, of in zip(docs.tolist(), starts.tolist(), ends.tolist(), bits.tolist(), strict=True):
            if got := self.resolve(data[a:b].tobytes(), of):
                base = offsets[d]
                found.setdefault(d, []).extend((a - base + s, a - base + e, k) for s, e, k in got)
        out = {}
        for d, spans in found.items():
            chars = np.cumsum((data[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)
            place = lambda x, chars=chars: int(chars[x - 1]) if x else 0
            out[d] = [(place(int(s)), place(int(e)), k) for s, e, k in sorted(spans, key=lambda x: (x[0], x[2]))]
        return out


@cache
def scanner() -> Scanner:
    return Scanner()


def joined(spans: list[tuple[int, int, int]], below: int | None = None) -> str:
    return ",".join(f"{RULES[k].kind}:{s}:{e}" for s, e, k in spans if below is None or k < below)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, and ``found``, a list of (kind, start, end) by start and then rule. Other columns don't matter.

    Map only: nothing is shuffled. A null or empty text has an empty list; repeated ids and texts are repeated rows.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, found array<struct<kind:string,start:int,stop:int>>"
    shape = arrow(schema)
    shipped = docs.sparkSession.sparkContext.broadcast(scanner())  # compiled once; its size is that of the rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = shape
        for part, data, offsets in byte_slices(batches, text_col):
            spans = shipped.value.spans(data, offsets)
            rows = [[{"kind": RULES[k].kind, "start": s, "stop": e} for s, e, k in spans.get(i, ())] for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(rows, to.field("found").type)], schema=to)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query: counts and the base spans' SHA-256, and all spans."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    shape = arrow(schema)
    shipped = docs.sparkSession.sparkContext.broadcast(scanner())  # compiled once; its size is that of the rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, none = shape, hashlib.sha256(b"").hexdigest()
        for part, data, offsets in byte_slices(batches):
            n = part.num_rows
            counts, sha, text = np.zeros((BASE, n), np.int64), [none] * n, [""] * n
            for i, spans in shipped.value.spans(data, offsets).items():
                for _, _, k in spans:
                    if k < BASE:
                        counts[k, i] += 1
                sha[i], text[i] = hashlib.sha256(joined(spans, BASE).encode()).hexdigest(), joined(spans)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, counts), pa.array(sha), pa.array(text)], schema=to)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the same columns; in ``text`` each span (overlapping ones as one) is replaced by ``mark``.

    ``n_chars``, if there is such a column, follows the text. Rows without spans are unchanged, and no row is dropped.
    """
    columns = docs.columns
    shipped = docs.sparkSession.sparkContext.broadcast(scanner())  # compiled once; its size is that of the rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in byte_slices(batches):
            spans = shipped.value.spans(data, offsets)
            text = part.column("text").to_pylist()
            chars = part.column("n_chars").to_pylist() if "n_chars" in columns else []
            for i, found in spans.items():
                out, at, t = [], 0, text[i]
                for s, e, _ in found:
                    if e > at:
                        out += [t[at:s], mark] if s >= at else []
                        at = e
                text[i] = "".join(out) + t[at:]
                if chars:
                    chars[i] = len(text[i])
            new = {"text": pa.array(text, part.column("text").type)} | ({"n_chars": pa.array(chars, part.column("n_chars").type)} if chars else {})
            yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(k) for k, c in enumerate(columns)], names=columns)

    return map_rows(docs, run)
