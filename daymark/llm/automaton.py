"""Rule regexes compiled together into deterministic byte automata, and scans of many texts by their tables alone.

A rule is parsed into a tree and a nondeterministic automaton; subset construction and minimisation (partition
refinement) make one table of all rules, whose states know every rule at once. Three tables are used:

- search: every state holds the start as well, so one pass over the bytes marks where any rule matches. Bytes after which
  every state is the start ("breaks") cut texts into pieces that are scanned side by side, which is exact however long a
  text is, as no match crosses one.
- starts: the same of the reversed rules, run backwards over marked pieces: where a match of each rule may begin.
- ends: of the rules without the start in every state, run from a place where a match begins: how far the longest one
  reaches, and whether it meets the rule's strict form too.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

BREAK = 0xFF  # stands between texts; no rule can match it
_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_SHORT = {"d": frozenset(b"0123456789"), "w": _WORD, "s": frozenset(b" \t\n\r\f\v")}
_ASCII, _MORE = frozenset(range(0x80)), ("set", frozenset(range(0x80, 0xC0)))
#: Characters of two, three and four bytes.
_LONG = [("cat", [("set", frozenset(range(lo, hi))), *[_MORE] * n]) for lo, hi, n in ((0xC2, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF5, 3))]


def _but(members: set[int]) -> tuple:
    """Any character but these ASCII ones."""
    return ("alt", [("set", _ASCII - members), *_LONG])


class _Parser:
    """Regex text to a tree: ('set', bytes) | ('cat', parts) | ('alt', parts) | ('rep', part, least, most or None)."""

    def __init__(self, text: str, ignore_case: bool):
        self.s, self.i, self.fold = text, 0, ignore_case

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"unexpected end of rule {self.s!r}")
        self.i += 1
        return c

    def parse(self):
        tree = self.alternatives()
        if self.peek():
            raise ValueError(f"unbalanced ) in rule {self.s!r}")
        return tree

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.atom()
        while (c := self.peek()) and c in "*+?{":
            self.take()
            if c == "{":
                spec = ""
                while (x := self.take()) != "}":
                    spec += x
                low, comma, high = spec.partition(",")
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            part = ("rep", part, least, most)
        return part

    def chars(self, members: set[int]) -> tuple:
        if self.fold:
            members = members | {b ^ 32 for b in members if chr(b).isalpha() and b < 128}
        return ("set", frozenset(members))

    def escape(self) -> set[int]:
        c = self.take()
        if c == "x":
            return {int(self.take() + self.take(), 16)}
        if c in _SHORT:
            return set(_SHORT[c])
        if c.isalnum():
            if c in "ntrfv":
                return {ord({"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}[c])}
            raise ValueError(f"\\{c} isn't supported in rules")
        return set(c.encode())

    def atom(self):
        c = self.take()
        if c == "(":
            if self.s[self.i : self.i + 2] == "?:":
                self.i += 2
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"missing ) in rule {self.s!r}")
            return tree
        if c == "[":
            return self.bracket()
        if c == ".":
            return _but({10})
        if c == "\\":
            return self.chars(self.escape())
        if c in "*+?{^$":
            raise ValueError(f"{c} isn't supported there in rule {self.s!r}")
        return ("cat", [self.chars({b}) for b in c.encode()])

    def bracket(self):
        negated = self.peek() == "^"
        if negated:
            self.take()
        members: set[int] = set()
        first = True
        while (c := self.take()) != "]" or first:
            first = False
            got = self.escape() if c == "\\" else set(c.encode())
            if len(got) > 1 and c != "\\":
                raise ValueError("bracket members must be ASCII")
            if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] not in ("]", ""):
                self.take()
                d = self.take()
                high = self.escape() if d == "\\" else set(d.encode())
                got = set(range(min(got), max(high) + 1))
            members |= got
        tree = self.chars(members)
        return _but(tree[1]) if negated else tree


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []  # moves without a byte
        self.on: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append(None)
        return len(self.free) - 1

    def build(self, tree, start: int) -> int:
        """Append the tree behind start; returns its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.on[start] = (tree[1], end)
            out = self.state()
            self.free[end].append(out)
            return out
        if kind == "cat":
            for part in tree[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                s = self.state()
                self.free[start].append(s)
                self.free[self.build(part, s)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.build(part, start)
        end = self.state()
        if most is None:
            head = self.state()
            self.free[start] += [head]
            self.free[head].append(end)
            body = self.state()
            self.free[head].append(body)
            self.free[self.build(part, body)].append(head)
            return end
        self.free[start].append(end)
        for _ in range(most - least):
            s = self.state()
            self.free[start].append(s)
            start = self.build(part, s)
            self.free[start].append(end)
        return end


def _reversed(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", _reversed(tree[1]), *tree[2:])
    return (kind, [_reversed(t) for t in (tree[1][::-1] if kind == "cat" else tree[1])])


class Table:
    """Transition arrays of trees together: `move[state * width + kind[byte]]`, states kept multiplied by width.

    accepts: a bit per tree that ends in the state; alive: a bit per tree that can still end after more bytes.
    With loop, the start is in every state, so trees may begin anywhere.
    """

    def __init__(self, trees: list, loop: bool):
        if len(trees) > 32:
            raise ValueError("at most 32 trees")
        nfa = _Nfa()
        root = nfa.state()
        ends = {}
        for k, tree in enumerate(trees):
            s = nfa.state()
            nfa.free[root].append(s)
            ends[nfa.build(tree, s)] = k
        sets = list(dict.fromkeys(x[0] for x in nfa.on if x))
        kinds: dict[tuple, int] = {}
        self.kind = np.zeros(256, np.uint8)
        samples: list[int] = []
        for b in range(256):
            key = tuple(b in s for s in sets)
            if key not in kinds:
                kinds[key] = len(kinds)
                samples.append(b)
            self.kind[b] = kinds[key]
        self.width = len(kinds)

        close_of: dict[int, frozenset] = {}

        def close(s: int) -> frozenset:
            if s not in close_of:
                seen, todo = {s}, [s]
                while todo:
                    for t in nfa.free[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                close_of[s] = frozenset(x for x in seen if nfa.on[x] or x in ends)
            return close_of[s]

        hits = [[b in s for b in samples] for s in sets]
        at = {s: k for k, s in enumerate(sets)}
        steps = {s: (hits[at[m[0]]], close(m[1])) for s, m in enumerate(nfa.on) if m}
        begin = close(root)
        always = begin if loop else frozenset()
        ids, rows, queue = {begin: 0}, [], [begin]
        for now in queue:  # subset construction
            row = []
            active = [steps[s] for s in now if s in steps]
            for c in range(self.width):
                nxt = always.union(*(to for ok, to in active if ok[c]))
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    queue.append(nxt)
                row.append(ids[nxt])
            rows.append(row)
        move = np.array(rows, np.int64)
        accept = np.array([sum({1 << ends[s] for s in now if s in ends}) for now in queue], np.uint32)
        group = np.unique(accept, return_inverse=True)[1].reshape(-1)
        while True:  # minimisation: split groups until members agree on the groups they move to
            _, new = np.unique(np.column_stack([group, group[move]]), axis=0, return_inverse=True)
            if new.max() == group.max():
                break
            group = new.reshape(-1)
        first = np.unique(group, return_index=True)[1]
        self.n_states = len(first)
        small, accept = group[move[first]], accept[first]
        alive = np.zeros(len(first), np.uint32)
        while (more := alive | np.bitwise_or.reduce((accept | alive)[small], axis=1)).tolist() != alive.tolist():
            alive = more
        self.start = int(group[0]) * self.width
        self.move = (small * self.width).astype(np.int32).reshape(-1)
        self.accepts, self.alive = np.repeat(accept, self.width), np.repeat(alive, self.width)
        self.breaks = (small == group[0]).all(axis=0)[self.kind]

    @cached_property
    def lists(self) -> tuple[list[int], list[int], list[int]]:
        """move, accepts and alive as lists, for one text at a time."""
        return self.move.tolist(), self.accepts.tolist(), self.alive.tolist()


#: Pieces scanned side by side at least; fewer are finished one by one.
_LANES = 12


class Automaton:
    """The tables of a list of rules, and scans by them."""

    def __init__(self, rules: list[tuple[str, str, bool]]):
        """rules: (regex, strict regex, ignore case), at most 16; a match of the first passes if it is one of the second as well."""
        if len(rules) > 16:
            raise ValueError("at most 16 rules")
        plain = [_Parser(text, fold).parse() for text, _, fold in rules]
        strict = [_Parser(text, fold).parse() for _, text, fold in rules]
        loose = Table(plain, True)
        # strict forms that count in the middle would multiply the states of a search: those that only lengthen a loop at the start don't
        counted = [s if _repeats_itself(s) else p for p, s in zip(plain, strict, strict=True)]
        self.search = Table(counted, True)
        self.starts = Table([_reversed(t) for t in plain], True)
        self.ends = Table(plain + strict, False)
        self.n_rules = len(rules)
        self.breaks = self.search.breaks & loose.breaks
        assert self.breaks[BREAK]

    def _pieces(self, data: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of pieces of about stride bytes, longer where no break is."""
        stops = self.breaks[data]
        stops[:-1] &= (data[1:] & 0xC0) != 0x80  # never inside a character
        stops = np.flatnonzero(stops)
        keep = np.unique(stops // stride, return_index=True)[1]
        ends = stops[keep] + 1
        if not len(ends) or ends[-1] != len(data):
            ends = np.append(ends, len(data))
        return np.concatenate(([0], ends[:-1])), ends

    @staticmethod
    def _sweep(table: Table, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, back: bool, seen) -> None:
        """Run a table over pieces (backwards with back), many at a time; seen() gets every byte's piece (or one for all), place and accept bits."""
        order = np.argsort(starts - ends, kind="stable")  # longest first
        size = (ends - starts)[order]
        at, way = (ends[order] - 1, -1) if back else (starts[order], 1)
        kinds = table.kind[data]
        state = np.full(len(order), table.start, np.int32)
        live = np.searchsorted(-size, -np.arange(size[0]), side="left") if len(size) else []  # pieces longer than t
        t = 0
        while t < len(live) and live[t] >= _LANES:
            n = live[t]
            place = at[:n] + way * t
            state[:n] = now = table.move[state[:n] + kinds[place]]
            seen(order[:n], place, table.accepts[now])
            t += 1
        move, accepts, _ = table.lists
        for k in range(live[t] if t < len(live) else 0):  # a few long ones
            lo, hi = starts[order[k]], ends[order[k]]
            part = kinds[lo : hi - t][::-1] if back else kinds[lo + t : hi]
            now, bits = int(state[k]), []
            for c in part.tolist():
                now = move[now + c]
                bits.append(accepts[now])
            place = np.arange(hi - t - 1, lo - 1, -1) if back else np.arange(lo + t, hi)
            seen(order[k], place, np.array(bits, np.uint32))

    def spans(self, texts: list[bytes], stride: int = 256) -> list[tuple[int, int, int, int]]:
        """(text, start byte, end byte, rule) of passing matches: per rule leftmost, longest and non-overlapping; failing ones are dropped without a retry."""
        data = np.frombuffer(bytes([BREAK]).join(texts) + bytes([BREAK]), np.uint8)
        starts, ends = self._pieces(data, stride)
        marks = np.zeros(len(starts), np.uint32)

        def mark(piece, _, bits):
            marks[piece] |= bits if np.ndim(piece) else np.bitwise_or.reduce(bits)

        self._sweep(self.search, data, starts, ends, False, mark)
        hit = np.flatnonzero(marks)
        if not len(hit):
            return []
        starts, ends, marks = starts[hit], ends[hit], marks[hit]
        base = np.cumsum(ends - starts) - (ends - starts)  # marked pieces laid end to end
        begins = np.zeros(int((ends - starts).sum()), np.uint32)

        def begin(piece, place, bits):
            begins[place - starts[piece] + base[piece]] = bits

        self._sweep(self.starts, data, starts, ends, True, begin)
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=first[1:])
        out = []
        for lo, hi, bits, at in zip(starts.tolist(), ends.tolist(), marks.tolist(), base.tolist(), strict=True):
            flags, codes = begins[at : at + hi - lo], self.ends.kind[data[lo:hi]].tolist()
            for k in range(self.n_rules):
                if bits >> k & 1:
                    for a, b in self._matches(codes, np.flatnonzero(flags >> np.uint32(k) & 1).tolist(), k):
                        i = int(np.searchsorted(first, lo + a, side="right")) - 1
                        out.append((i, lo + a - int(first[i]), lo + b - int(first[i]), k))
        return out

    def _matches(self, codes: list[int], places: list[int], k: int):
        """Passing matches of rule k in a piece, from the places where one begins."""
        move, accepts, alive = self.ends.lists
        done, plain, strict = 0, 1 << k, 1 << k + self.n_rules
        for a in places:
            if a < done:
                continue
            state, passing = self.ends.start, False
            for at in range(a, len(codes)):
                state = move[state + codes[at]]
                if accepts[state] & plain:
                    done, passing = at + 1, accepts[state] & strict
                if not alive[state] & plain:
                    break
            if passing:
                yield a, done


def _repeats_itself(tree) -> bool:
    """Whether a tree is one set repeated: its states in a search are the lengths of a run."""
    return tree[0] == "rep" and tree[1][0] == "set" or tree[0] == "cat" and len(tree[1]) == 1 and _repeats_itself(tree[1][0])
