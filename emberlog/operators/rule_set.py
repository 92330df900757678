"""A set of rules over events, batch by batch: every text is searched once for all patterns.

All texts of all rules on one field make one Aho-Corasick automaton (for contains) and tables of
prefixes, suffixes and whole values; all networks make one table of disjoint intervals.  A
batch's distinct values go through them once, and what they hit becomes bit sets over the
batch's events.  A rule is looked at only if one of the tests that it cannot do without hit
anything; its condition is then set algebra, in which regexes, numbers and references run
only over the events that the rest of the condition has left.

The rule set goes to the executors once.  `matches` is one Arrow function of the fields that the
rules name, so other columns of the events stay out of Python.  Regexes run in Python's `regex`
module with ASCII classes; `rules.rule_predicate` runs them in Java.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.columns import field
from emberlog.operators import rule_parts as rp
from emberlog.operators.log_sources import ALIASES, PROCESS_PROVIDER, Route, format_column

MEMO = 1 << 16  # values of a field whose tests a worker remembers
SHORT = 3  # texts that are shorter hit too often to choose rules by
_FORMAT = "\0format"  # the field with the format, whatever its column's name
_NUMBER = re.compile(r"\s*(?:([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)[df]?|([+-]?inf(?:inity)?|nan))\s*\Z", re.ASCII | re.IGNORECASE)
_COMPARE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def _compiled(node: tuple):
    """The regex of a re or like test."""
    if node[0] == "re":
        return regex.compile(node[2], regex.ASCII)
    kind, body = node[2], node[3]
    return re.compile(("\\A" if kind in ("", "startswith") else "") + body + ("\\Z" if kind in ("", "endswith") else ""), re.DOTALL)


def check(node: tuple) -> None:
    """Raises if a test cannot be evaluated."""
    for test in rp.walk(node):
        if test[0] in ("re", "like"):
            _compiled(test)


def _needed(node: tuple, number: dict) -> tuple[int, frozenset] | None:
    """(cost, tests): the node cannot hold unless one of these tests of the tables hits; None if it can."""
    kind = node[0]
    if kind == "const":
        return None if node[1] else (0, frozenset())
    if kind == "text" or kind == "like" and node[4]:
        text = node[3] if kind == "text" else node[4]
        return 1 + 1000 * (node[1] == "eventid") + 100 * (len(text) < SHORT), frozenset([number[node]])
    if kind == "cidr":
        return 5, frozenset([number[node]])
    if kind == "and":
        return min((x for x in (_needed(c, number) for c in node[1]) if x), key=lambda x: (x[0], len(x[1])), default=None)
    if kind == "or" or kind == "least" and node[1] >= 1:
        parts = [_needed(c, number) for c in node[-1]]
        return None if any(p is None for p in parts) else (sum(p[0] for p in parts), frozenset().union(*(p[1] for p in parts)))
    return None


def _intervals(networks: list[tuple[int, int, int]]) -> tuple[list[int], list[tuple]]:
    """(starts, tests) of the disjoint intervals of (first, last, test)."""
    edges = sorted({e for first, last, _ in networks for e in (first, last + 1)})
    return edges, [tuple(t for first, last, t in networks if first <= e <= last) for e in edges]


class FieldTests:
    """All tests of one field's text, or of its lower-case text."""

    def __init__(self, tests: list[tuple[int, tuple]]):
        self.whole: dict[str, list[int]] = defaultdict(list)
        self.prefixes: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.suffixes: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        words: dict[str, list[tuple[int, object]]] = defaultdict(list)
        networks: dict[int, list] = {4: [], 6: []}
        for number, test in tests:
            if test[0] == "text":
                _, _, kind, text, _ = test
                if kind == "contains":
                    words[text].append((number, None))
                else:
                    table = self.whole if kind == "" else (self.prefixes if kind == "startswith" else self.suffixes)[len(text)]
                    table[text].append(number)
            elif test[0] == "like":
                words[test[4]].append((number, _compiled(test)))
            else:
                net = ipaddress.ip_network(test[2])
                networks[net.version].append((int(net.network_address), int(net.broadcast_address), number))
        self.intervals = {v: _intervals(n) for v, n in networks.items() if n}
        self.memo: dict[str, tuple] = {}
        self.automaton = None
        if words:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for text, found in words.items():
                self.automaton.add_word(text, (tuple(n for n, r in found if r is None), tuple((n, r) for n, r in found if r is not None)))
            self.automaton.make_automaton()

    def _of(self, value: str) -> tuple:
        out = list(self.whole.get(value, ()))
        for size, table in self.prefixes.items():
            out += table.get(value[:size], ())
        for size, table in self.suffixes.items():
            out += table.get(value[-size:], ())
        if self.automaton is not None:
            for plain, patterns in {x for _, x in self.automaton.iter(value)}:
                out += plain
                out += [n for n, r in patterns if r.search(value)]
        if self.intervals and value[0] in "0123456789abcdefABCDEF:" and not ("." in value and ":" in value or "%" in value):
            try:
                address = ipaddress.ip_address(value)
            except ValueError:
                return tuple(out)
            edges, tests = self.intervals.get(address.version, ((), ()))
            at = bisect.bisect_right(edges, int(address)) - 1
            out += tests[at] if at >= 0 else ()
        return tuple(out)

    def hits(self, values: list[str]) -> dict[int, list[int]]:
        """test -> places of the values that pass it."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        out: dict[int, list[int]] = defaultdict(list)
        memo = self.memo
        for place, value in enumerate(values):
            if not value:
                continue
            found = memo.get(value)
            if found is None:
                found = memo[value] = self._of(value)
            for test in found:
                out[test].append(place)
        return out


class RuleSet:
    """Rules that executors share: numbered tests, conditions over them, and routes."""

    def __init__(self, rules: list[tuple[int, tuple, Route]]):
        self.key = uuid.uuid4().hex
        number: dict[tuple, int] = {}
        for _, node, _ in rules:
            for test in rp.walk(node):
                number.setdefault(test, len(number))
        self.tests = list(number)
        self.rules = [(i, self._numbered(node, number), way) for i, node, way in rules]
        self.always, self.by_test = [], defaultdict(list)
        for at, (_, node, _) in enumerate(rules):
            needed = _needed(node, number)
            if needed is None:
                self.always.append(at)
            else:
                for test in needed[1]:
                    self.by_test[test].append(at)
        self.by_test = dict(self.by_test)
        self.fields = sorted(set().union(*(rp.fields_of(node) for _, node, _ in rules)))

    def _numbered(self, node: tuple, number: dict):
        """Tests as their numbers; in conjunctions the tests of the tables come first."""
        if node[0] in ("and", "or"):
            parts = [self._numbered(x, number) for x in node[1]]
            return (node[0], tuple(sorted(parts, key=lambda x: self._late(x))))
        if node[0] == "least":
            return ("least", node[1], tuple(self._numbered(x, number) for x in node[2]))
        if node[0] == "not":
            return ("not", self._numbered(node[1], number))
        return node if node[0] == "const" else number[node]

    def _late(self, node) -> bool:
        """Whether evaluating a node may run a regex, a number or a reference."""
        if isinstance(node, int):
            return not self.eager(self.tests[node])
        return node[0] != "const" and any(map(self._late, [node[1]] if node[0] == "not" else node[-1]))

    @staticmethod
    def eager(test: tuple) -> bool:
        return test[0] in ("text", "cidr") or test[0] == "like" and bool(test[4])


class Matcher:
    """A rule set in a worker, with its automata."""

    def __init__(self, rules: RuleSet):
        self.rules = rules
        by_field: dict[tuple[str, bool], list] = defaultdict(list)
        for number, test in enumerate(rules.tests):
            if rules.eager(test):
                by_field[test[1], bool(test[0] in ("text", "like") and not test[-1])].append((number, test))
        self.tables = {key: FieldTests(tests) for key, tests in by_field.items()}
        self.regexes = {n: _compiled(t) for n, t in enumerate(rules.tests) if t[0] == "re" or t[0] == "like" and not t[4]}

    def match(self, columns: dict[str, pa.Array], n: int) -> pa.Array:
        """The numbers of the rules that each of n events hits."""
        batch = _Batch(self, columns, n)
        chosen = set(self.rules.always)
        for test in batch.hits:
            chosen.update(self.rules.by_test.get(test, ()))
        places, rules = [], []
        for at in sorted(chosen):
            number, node, way = self.rules.rules[at]
            within = batch.route(way)
            bits = batch.holds(node, within) if within else 0
            if bits:
                found = batch.places(bits)
                places.append(found)
                rules.append(np.full(len(found), number, np.int32))
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(n + 1))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array((np.concatenate(rules) if rules else np.zeros(0, np.int32))[order]))


class _Batch:
    """One batch of events: sets of events are integers, one bit an event."""

    def __init__(self, matcher: Matcher, columns: dict[str, pa.Array], n: int):
        self.matcher, self.n, self.all = matcher, n, (1 << n) - 1
        self.values: dict[tuple[str, bool], list[str]] = {}
        self.codes: dict[str, np.ndarray] = {}
        for name, column in columns.items():
            found = pc.dictionary_encode(column)
            self.codes[name] = found.indices.to_numpy(zero_copy_only=False)
            self.values[name, False] = found.dictionary.to_pylist()
        self.hits: dict[int, tuple] = {}
        for (name, low), table in matcher.tables.items():
            if name in self.codes:
                self.hits.update((test, (name, places)) for test, places in table.hits(self._text(name, low)).items())
        self.sets: dict[int, int] = {}
        self.known: dict[int, np.ndarray] = {}
        self.routes: dict[Route, int] = {}

    def _text(self, name: str, low: bool) -> list[str]:
        if (name, low) not in self.values:
            self.values[name, low] = [v.lower() for v in self.values[name, False]] if low else self.values[name, False]
        return self.values[name, low]

    def _bits(self, flags: np.ndarray) -> int:
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    def places(self, bits: int) -> np.ndarray:
        raw = np.frombuffer(bits.to_bytes((self.n + 7) // 8, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, count=self.n, bitorder="little"))

    def _where(self, name: str, passes) -> int:
        """Events whose value of a field passes."""
        if name not in self.codes:
            return self.all if passes("") else 0
        return self._bits(np.array([bool(passes(v)) for v in self._text(name, True)], bool)[self.codes[name]])

    def route(self, way: Route) -> int:
        if way not in self.routes:
            out = self.all
            if way.formats is not None:
                out &= self._where(_FORMAT, lambda v: ALIASES.get(v, v) in way.formats)
            if way.event_ids is not None:
                number = self._where("eventid", lambda v: v in way.event_ids)
                if way.process and "provider_name" in self.codes:
                    number &= ~self._where("eventid", lambda v: v == "1") | self._where("provider_name", lambda v: PROCESS_PROVIDER in v)
                out &= number
            if way.channel_words:
                out &= self._where("channel", lambda v: any(w in v for w in way.channel_words))
            self.routes[way] = out
        return self.routes[way]

    def holds(self, node, within: int) -> int:
        """The events of `within` for which a node holds."""
        if not within:
            return 0
        if isinstance(node, int):
            return self._test(node, within)
        kind = node[0]
        if kind == "const":
            return within if node[1] else 0
        if kind == "not":
            return within & ~self.holds(node[1], within)
        if kind == "and":
            for part in node[1]:
                within = self.holds(part, within)
            return within
        if kind == "or":
            found = 0
            for part in node[1]:
                found |= self.holds(part, within & ~found)
            return found
        counts = np.zeros(self.n, np.int32)
        for part in node[2]:
            counts[self.places(self.holds(part, within))] += 1
        return within & self._bits(counts >= node[1])

    def _test(self, number: int, within: int) -> int:
        test = self.matcher.rules.tests[number]
        name = test[1]
        if RuleSet.eager(test):
            if number not in self.sets:
                bits = 0
                if number in self.hits:
                    places = self.hits[number][1]
                    flags = np.zeros(len(self.values[name, False]), bool)
                    flags[places] = True
                    bits = self._bits(flags[self.codes[name]])
                self.sets[number] = bits
            return self.sets[number] & within
        if test[0] == "ref":
            return self._reference(test, within)
        if name not in self.codes:
            return within if self._passes(number, test)("") else 0
        known = self.known.setdefault(number, np.full(len(self.values[name, False]), -1, np.int8))
        asked = np.unique(self.codes[name][self.places(within)])
        passes, values = self._passes(number, test), self._text(name, test[0] == "like" and not test[-1])
        for at in asked[known[asked] < 0].tolist():
            known[at] = passes(values[at])
        return within & self._bits((known == 1)[self.codes[name]])

    def _passes(self, number: int, test: tuple):
        if test[0] == "empty":
            return lambda v: v == ""
        if test[0] == "number":
            compare, limit = _COMPARE[test[2]], test[3]

            def passes(v: str) -> bool:
                found = _NUMBER.match(v)
                return found is not None and _compared(compare, float(found[1] or found[2]), limit)

            return passes
        search = self.matcher.regexes[number].search
        return lambda v: search(v) is not None

    def _reference(self, test: tuple, within: int) -> int:
        _, name, other, kind = test
        if other not in self.codes:
            return 0
        a = self._text(name, True) if name in self.codes else [""]
        b = self._text(other, True)
        compare = {"": str.__eq__, "contains": str.__contains__, "startswith": str.startswith, "endswith": str.endswith}[kind]
        at, own = self.places(within), self.codes.get(name, np.zeros(self.n, np.int32))
        flags = np.zeros(self.n, bool)
        flags[at] = [bool(b[j]) and compare(a[i], b[j]) for i, j in zip(own[at].tolist(), self.codes[other][at].tolist(), strict=True)]
        return self._bits(flags)


def _compared(compare, value: float, limit: float) -> bool:
    """Spark orders NaN above all numbers."""
    return compare((value != value, value), (limit != limit, limit)) if value != value or limit != limit else compare(value, limit)


_matchers: dict[str, Matcher] = {}


def _matcher(rules: RuleSet) -> Matcher:
    if rules.key not in _matchers:
        if len(_matchers) > 4:
            _matchers.clear()
        _matchers[rules.key] = Matcher(rules)
    return _matchers[rules.key]


def matches(df: DataFrame, rules: list[tuple[int, tuple, Route]]) -> Column:
    """An array of the numbers of the rules that an event hits; rules are (number, node, route)."""
    found = RuleSet(rules)
    known = {c.lower() for c in df.columns}
    names = {n for n in found.fields if n in known}
    for _, _, way in rules:
        names |= {n for n, asked in (("eventid", way.event_ids), ("provider_name", way.process), ("channel", way.channel_words)) if asked and n in known}
    columns = {n: field(df, n) for n in sorted(names)}
    if (named := format_column(df)) and any(way.formats is not None for _, _, way in rules):
        columns[_FORMAT] = field(df, named)
    order = list(columns)
    shared = df.sparkSession.sparkContext.broadcast(found)  # grows with the rules, not with the events

    @F.arrow_udf("array<int>")
    def numbers(some: pa.Array, *more: pa.Array) -> pa.Array:
        return _matcher(shared.value).match(dict(zip(order, (some, *more)[: len(order)], strict=True)), len(some))

    return numbers.asNondeterministic()(*columns.values() or [F.lit("")])  # once an event, whatever is done with the hits
