"""Rules taken apart: tests of one field each, selections and conditions as one tree.

A rule is a mapping with title, level, tags, logsource and detection, as read from YAML.
Nodes are tuples, so that equal tests are one test:

    ("const", bool)  ("not", x)  ("and", nodes)  ("or", nodes)  ("least", n, nodes)
    ("text", field, kind, text, cased)     kind: "", contains, startswith, endswith
    ("like", field, kind, regex, literal, cased)   wildcards; the literal is in every text that matches
    ("re", field, regex)                   ("cidr", field, network)
    ("number", field, operator, number)    ("empty", field)    ("ref", field, other, kind)

Field names are in lower case; missing fields count as ''.
"""

from __future__ import annotations

import base64
import ipaddress
import re
from functools import reduce

WIDE = {"wide", "utf16", "utf16le"}
MODIFIERS = {"contains", "startswith", "endswith", "re", "i", "cidr", "gt", "gte", "lt", "lte", "base64", "base64offset", "windash", "all", "fieldref", "exists", "cased"} | WIDE
RAW = "_raw"


def wildcard(value: str) -> tuple[str, str] | None:
    """(regex, longest literal piece) of a value with * or ?, None without (a backslash escapes both)."""
    if "*" not in value and "?" not in value:
        return None
    out, pieces, i = "", [""], 0
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value) and value[i + 1] in "*?\\":
            i += 1
            out += re.escape(value[i])
            pieces[-1] += value[i]
        elif c in "*?":
            out += ".*" if c == "*" else "."
            pieces.append("")
        else:
            out += re.escape(c)
            pieces[-1] += c
        i += 1
    return (out, max(pieces, key=len)) if len(pieces) > 1 else None


def both(parts) -> tuple:
    parts = tuple(parts)
    return parts[0] if len(parts) == 1 else ("and", parts) if parts else ("const", True)


def either(parts) -> tuple:
    parts = tuple(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", parts) if parts else ("const", False)


def text_test(name: str, value: str, kind: str = "", cased: bool = False) -> tuple:
    """equals, contains, startswith or endswith; * and ? are wildcards."""
    value = value if cased else value.lower()
    found = wildcard(value)
    if found is None:
        return ("text", name, kind, re.sub(r"\\([*?])", r"\1", value), cased)
    return ("like", name, kind, *found, cased)


def _base64_offsets(data: bytes) -> list[str]:
    return [base64.b64encode(b" " * i + data).decode()[(0, 2, 3)[i] : (None, -3, -2)[(len(data) + i) % 3]] for i in range(3)]


def value_test(name: str, value, modifiers: list[str]) -> tuple:
    """One value of a field with its modifiers."""
    unknown = set(modifiers) - MODIFIERS
    if unknown:
        raise ValueError(f"modifiers not supported: {sorted(unknown)}")
    name = name.lower()
    if "exists" in modifiers:
        return ("not", ("empty", name)) if value else ("empty", name)
    if value is None or value == "":
        return ("empty", name)
    if isinstance(value, bool):
        return ("text", name, "", str(value).lower(), False)
    for m in modifiers:
        if m in ("gt", "gte", "lt", "lte"):
            return ("number", name, m, float(value))
    given = str(value)
    kind = next((m for m in modifiers if m in ("contains", "startswith", "endswith")), "")
    if "re" in modifiers:
        return ("re", name, f"(?i){given}" if "i" in modifiers else given)
    if "cidr" in modifiers:
        return ("cidr", name, str(ipaddress.ip_network(given, strict=False)))
    if "fieldref" in modifiers:
        return ("ref", name, given.lower(), kind)
    variants = [given]
    if "windash" in modifiers:
        variants += [x for x in (re.sub(r"(^|\s)-", r"\1/", given), given.replace("-", "/")) if x not in variants]
    coding = "utf-16-le" if WIDE & set(modifiers) else "utf-8"
    if "base64offset" in modifiers:
        variants = [o for v in variants for o in _base64_offsets(v.encode(coding))]
        kind = kind or "contains"
    elif "base64" in modifiers:
        variants = [base64.b64encode(v.encode(coding)).decode() for v in variants]
    elif coding != "utf-8":
        variants = ["".join(c + "\0" for c in v) for v in variants]
    return either(text_test(name, v, kind, "cased" in modifiers) for v in variants if v)


def field_test(key: str, value) -> tuple:
    """`Field|modifier...: value or list`; without a field name, keywords of the raw event."""
    name, *modifiers = str(key).split("|")
    name, kind = (name, []) if name else (RAW, [] if {"re", "contains"} & set(modifiers) else ["contains"])
    if not isinstance(value, list):
        return value_test(name, value, modifiers + kind)
    parts = [value_test(name, v, modifiers + kind) for v in value]
    return both(parts) if "all" in modifiers and parts else either(parts)


def selection(body) -> tuple:
    """A mapping is AND, a list is OR, a bare text is a keyword of the raw event."""
    if isinstance(body, dict):
        return both(field_test(k, v) for k, v in body.items())
    if isinstance(body, list):
        return either(selection(x) for x in body)
    return text_test(RAW, str(body), "contains")


class Nodes:
    """What a condition is made of: nodes."""

    false = staticmethod(lambda: ("const", False))
    both = staticmethod(lambda a, b: ("and", (a, b)))
    either = staticmethod(lambda a, b: ("or", (a, b)))
    negated = staticmethod(lambda a: ("not", a))
    least = staticmethod(lambda parts, n: ("least", n, tuple(parts)))


def meet(a, b):
    """What two sets of values leave, None being any value."""
    return b if a is None else a if b is None else a & b


class Values(Nodes):
    """What a condition is made of: the values of a field that an event must have one of, None for any."""

    false = staticmethod(lambda: frozenset())
    both = staticmethod(meet)
    either = staticmethod(lambda a, b: None if a is None or b is None else a | b)
    negated = staticmethod(lambda a: None)
    least = staticmethod(lambda parts, n: reduce(Values.either, parts))


def condition(text: str, selections: dict, algebra: type[Nodes] = Nodes):
    """and, or, not, ( ), `N of x*`, `1|any|all of them`."""
    words = re.findall(r"\(|\)|[^\s()]+", text)
    at = 0

    def peek():
        return words[at].lower() if at < len(words) else ""

    def several():
        nonlocal at
        if not (at + 2 < len(words) and words[at + 1].lower() == "of" and (peek() in ("all", "any") or peek().isdigit())):
            return False, None
        count, target = peek(), words[at + 2]
        at += 3
        prefix = target.rstrip("*")
        chosen = [c for n, c in selections.items() if target.lower() == "them" or (n.startswith(prefix) if target.endswith("*") else n == target)]
        if not chosen:
            return True, algebra.false()
        if count == "all":
            return True, reduce(algebra.both, chosen)
        if count in ("any", "1"):
            return True, reduce(algebra.either, chosen)
        return True, algebra.least(chosen, int(count))

    def term():
        nonlocal at
        if peek() == "not":
            at += 1
            return algebra.negated(term())
        if peek() == "(":
            at += 1
            inner = any_term()
            at += 1
            return inner
        found, value = several()
        if found:
            return value
        name = words[at]
        at += 1
        return selections[name] if name in selections else algebra.false()

    def all_terms():
        nonlocal at
        out = term()
        while peek() == "and":
            at += 1
            out = algebra.both(out, term())
        return out

    def any_term():
        nonlocal at
        out = all_terms()
        while peek() == "or":
            at += 1
            out = algebra.either(out, all_terms())
        return out

    out = any_term()
    if at < len(words):
        raise ValueError(f"condition not understood: {text!r}")
    return out


def detection(rule: dict) -> tuple[str, dict]:
    """The condition's text and the bodies of the selections."""
    found = rule["detection"]
    text = found.get("condition", "")
    return text[0] if isinstance(text, list) else text, {k: v for k, v in found.items() if k not in ("condition", "timeframe")}


def rule_node(rule: dict) -> tuple:
    """The rule's own condition, without its log source."""
    text, bodies = detection(rule)
    return condition(text, {k: selection(v) for k, v in bodies.items()})


def _asked(body, name: str) -> frozenset | None:
    """The values that a selection asks of a field by plain equality, None for any; in lower case."""
    if isinstance(body, dict):
        out = None
        for key, value in body.items():
            values = value if isinstance(value, list) else [value]
            plain = all(isinstance(v, int) and not isinstance(v, bool) or isinstance(v, str) and v and wildcard(v) is None for v in values)
            if str(key).lower() == name and values and plain:
                out = meet(out, frozenset(re.sub(r"\\([*?])", r"\1", str(v).lower()) for v in values))
        return out
    if isinstance(body, list) and body and all(isinstance(x, dict) for x in body):
        return reduce(Values.either, [_asked(x, name) for x in body])
    return None


def asked(rule: dict, name: str) -> frozenset | None:
    """Values of a field outside of which the rule's own condition cannot hold, None if there are none."""
    text, bodies = detection(rule)
    return condition(text, {k: _asked(v, name) for k, v in bodies.items()}, Values)


def walk(node: tuple):
    """All tests below a node."""
    if node[0] in ("and", "or", "least"):
        for x in node[-1]:
            yield from walk(x)
    elif node[0] == "not":
        yield from walk(node[1])
    elif node[0] != "const":
        yield node


def fields_of(node: tuple) -> set[str]:
    """Names of the fields that a node compares."""
    return {name for test in walk(node) for name in ((test[1], test[2]) if test[0] == "ref" else (test[1],))}
