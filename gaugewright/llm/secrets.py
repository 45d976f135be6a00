"""Secret scan with one combined deterministic automaton.

Every rule is a head (a regular expression) followed by a greedy run of one character class. The triggers of all rules
(head plus the shortest run that can matter) become one NFA; subset construction and minimisation turn it into a
transition array over byte classes, which reads each text once. At a trigger, the head's reversed automaton finds the
leftmost start and the run is extended to its end. Matches are leftmost and do not overlap within a kind, and those
whose run is too short are dropped after they have consumed their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser, compile as re_compile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``kind`` matches ``head`` then ``run`` repeated; kept if the run has ``least`` characters or more."""

    kind: str
    head: str
    run: str
    least: int


BASE_RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]", 6),
    Rule("access", r"AKIA", r"[A-Z0-9]", 16),
    Rule("hex", r"", r"[0-9a-f]", 24),
)
MORE_RULES = (
    Rule("github", r"gh[oprsu]_", r"[A-Za-z0-9]", 36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]", 10),
    Rule("jwt", r"eyJ", r"[A-Za-z0-9_.-]", 40),
    Rule("private_key", r"-----BEGIN (?:RSA |DSA |EC |OPENSSH )?PRIVATE KEY", r"-", 5),
)


class _Nfa:
    """Thompson construction over byte sets."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, items, at: int, flags: int, backward: bool) -> int:
        """Append a parsed sequence after state ``at``; returns its end state."""
        for op, arg in reversed(list(items)) if backward else items:
            if op in (C.LITERAL, C.IN, C.ANY):
                to = self.state()
                self.moves[at].append((_bytes(op, arg, flags), to))
                at = to
            elif op is C.SUBPATTERN:
                at = self.add(arg[3], at, (flags | arg[1]) & ~arg[2], backward)
            elif op is C.BRANCH:
                end = self.state()
                for option in arg[1]:
                    begin = self.state()
                    self.empty[at].append(begin)
                    self.empty[self.add(option, begin, flags, backward)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self.add(body, at, flags, backward)
                if high is C.MAXREPEAT:
                    begin = self.state()
                    self.empty[at].append(begin)
                    self.empty[self.add(body, begin, flags, backward)].append(begin)
                    at = begin
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.empty[at].append(end)
                        at = self.add(body, at, flags, backward)
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"not supported in a secret rule: {op}")
        return at

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _bytes(op, arg, flags: int) -> frozenset[int]:
    if op is C.ANY:
        return frozenset(range(256))
    out: set[int] = set()
    negate = False
    for kind, x in [(op, arg)] if op is C.LITERAL else arg:
        if kind is C.NEGATE:
            negate = True
        elif kind is C.LITERAL:
            out.add(x)
        elif kind is C.RANGE:
            out.update(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"not supported in a secret rule: {kind}")
    if flags & C.SRE_FLAG_IGNORECASE:
        out |= {ord(f(chr(x))) for x in out if x < 128 for f in (str.lower, str.upper)}
    return frozenset(range(256)) - out if negate else frozenset(out)


@dataclass
class Automaton:
    """``table[state * width + byte class]`` is the next state times ``width``; state 0 begins, ``accepts`` names rules."""

    classes: bytes
    width: int
    table: list[int]
    accepts: dict[int, tuple[int, ...]]
    hot: int
    dead: int


def _automaton(nfa: _Nfa, begin: int, ends: dict[int, int]) -> Automaton:
    """Subset construction over byte classes, then minimisation by partition refinement."""
    sets = {s for moves in nfa.moves for s, _ in moves}
    of = {b: tuple(b in s for s in sets) for b in range(256)}
    names = {sig: k for k, sig in enumerate(dict.fromkeys(of.values()))}
    classes = bytes(names[of[b]] for b in range(256))
    sample = {names[sig]: b for b, sig in of.items()}
    first = nfa.closure([begin])
    ids, rows, todo = {first: 0}, [], [first]
    while todo:
        now = todo.pop(0)
        row = []
        for k in range(len(names)):
            to = nfa.closure({t for s in now for chars, t in nfa.moves[s] if sample[k] in chars})
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows)
    labels = [tuple(sorted({ends[s] for s in subset if s in ends})) for subset in ids]
    kinds = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    part = np.array([kinds[x] for x in labels])
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    n = int(part.max()) + 1
    member = {int(p): k for k, p in reversed(list(enumerate(part)))}
    order = sorted(range(n), key=lambda p: (p != part[0], bool(labels[member[p]])))
    place = {p: k for k, p in enumerate(order)}
    width = len(names)
    small = [[place[int(part[t])] * width for t in table[member[p]]] for p in order]
    accepts = {place[p] * width: labels[member[p]] for p in range(n) if labels[member[p]]}
    dead = next((k * width for k, row in enumerate(small) if k * width not in accepts and set(row) == {k * width}), -1)
    return Automaton(classes, width, [x for row in small for x in row], accepts, min(accepts, default=n * width), dead)


class Scanner:
    """All rules compiled together; ``spans`` scans one text."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        nfa, ends = _Nfa(), {}
        begin = nfa.state()
        nfa.moves[begin].append((frozenset(range(256)), begin))
        self.trigger = [1 if r.head else r.least for r in rules]
        self.back, self.after = [], []
        for k, r in enumerate(rules):
            at = nfa.state()
            nfa.empty[begin].append(at)
            ends[nfa.add(_parser.parse(f"{r.head}{r.run}{{{self.trigger[k]}}}"), at, 0, False)] = k
            behind = _Nfa()
            start = behind.state()
            end = behind.add(_parser.parse(r.head), start, 0, True)
            self.back.append(_automaton(behind, start, {end: k}) if r.head else None)
            self.after.append(re_compile(f"{r.run}*".encode()))
        self.all = _automaton(nfa, begin, ends)

    def _start(self, k: int, text: bytes, at: int, floor: int) -> int:
        """The smallest start >= floor of a head of rule k that ends before ``at``, or -1."""
        a, found = self.back[k], -1
        state = 0
        while at > floor:
            at -= 1
            state = a.table[state + a.classes[text[at]]]
            if state == a.dead:
                break
            if state in a.accepts:
                found = at
        return found

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and then rule."""
        table, state, hot, hits = self.all.table, 0, self.all.hot, []
        for i, c in enumerate(text.translate(self.all.classes)):
            state = table[state + c]
            if state >= hot:
                hits.append((i, state))
        done, out = [0] * len(self.rules), []
        for i, state in hits:
            for k in self.all.accepts[state]:
                run_at = i - self.trigger[k] + 1
                if run_at < done[k]:
                    continue
                start = self._start(k, text, run_at, done[k]) if self.rules[k].head else run_at
                if start < 0:
                    continue
                done[k] = end = self.after[k].match(text, run_at).end()
                if end - run_at >= self.rules[k].least:
                    out.append((start, k, end))
        return sorted(out)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_<kind> for the first ``base`` rules, base_sha256, spans), a row per input row.

    ``spans`` lists kind:start:end (code points, end exclusive) by start and then rule order; ``base_sha256`` is the
    SHA-256 of that list for the base rules alone. Null and empty texts have no spans. Repeated rows are each scanned,
    a null doc_id is kept, other columns are ignored. Texts of any length are read whole, once.
    """
    kinds = [r.kind for r in rules]
    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in range(base)]
            digests, texts = [], []
            for text in batch.column(1).to_pylist():
                found = scanner.spans(text) if text else []
                if found and not text.isascii():
                    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                    at = lambda x, p=points: int(p[x - 1]) if x else 0
                    found = [(at(a), k, at(b)) for a, k, b in found]
                for k in range(base):
                    counts[k].append(sum(f[1] == k for f in found))
                said = [(k, f"{kinds[k]}:{a}:{b}") for a, k, b in found]
                digests.append(hashlib.sha256(",".join(s for k, s in said if k < base).encode()).hexdigest())
                texts.append(",".join(s for _, s in said))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", *(f"n_{k}" for k in kinds[:base]), "base_sha256", "spans"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"n_{k} long" for k in kinds[:base])
    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(run, f"doc_id {key}, {columns}, base_sha256 string, spans string")
