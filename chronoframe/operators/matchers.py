"""Label matchers as predicates.

A series without the label matches none of the four kinds: SQL's three-valued
logic gives that without further tests.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from chronoframe.errors import QueryError
from chronoframe.model import label
from chronoframe.plans.nodes import Matcher

#: Wire numbers of the kinds; an unknown number counts as 0.
WIRE = {0: "=", 1: "!=", 2: "=~", 3: "!~"}


def from_wire(label_name: str, number: int, value: str) -> Matcher:
    return Matcher(label_name, WIRE.get(number, "="), value)


#: POSIX classes and what they hold in the target's syntax.
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}
_CATEGORY = re.compile(r"\\([pP])(?:\{(\^?)(\w+)\}|(\w))")
_GROUP = re.compile(r"\(\?(?:P?<([A-Za-z_]\w*)>|([ims]*(?:-[ims]+)?)([:)]))")
_REPEAT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")
_ESCAPE = re.compile(r"\\(?:x\{([0-9A-Fa-f]+)\}|x[0-9A-Fa-f]{2}|([0-7]{3}|0[0-7]{0,2})|([aftnrvdDwWsSAzbB])|([^A-Za-z0-9]))", re.S)


class _Re2:
    """One pass over an RE2 pattern that gives the same pattern for java.util.regex."""

    def __init__(self, pattern: str):
        self.text, self.at, self.out = pattern, 0, []
        self.names = 0
        self.lines = bool(re.search(r"\(\?[is]*m", pattern))

    def fail(self, why: str):
        raise QueryError(f"invalid regular expression {self.text!r}: {why}")

    def escape(self, inside: bool) -> str:
        """An escape at the current place; `inside` a character class."""
        if self.text.startswith("\\Q", self.at) and not inside:
            end = self.text.find("\\E", self.at + 2)
            end = len(self.text) if end < 0 else end
            quoted, self.at = self.text[self.at + 2 : end], end + 2
            return "".join(c if c.isalnum() or c.isspace() or ord(c) > 127 or c == "_" else "\\" + c for c in quoted)
        if found := _CATEGORY.match(self.text, self.at):
            self.at = found.end()
            kind, negated, name, letter = found.groups()
            name = name or letter
            kind = {"p": "P", "P": "p"}[kind] if negated else kind
            return f"\\{kind}{{{name if len(name) <= 2 else 'IsAny' if name == 'Any' else 'Is' + name}}}".replace("{IsAny}", "{IsAssigned}")
        found = _ESCAPE.match(self.text, self.at)
        if not found:
            self.fail("unknown escape")
        self.at = found.end()
        wide, octal, letter, _ = found.groups()
        if wide:
            return f"\\x{{{wide}}}"
        if octal:
            return f"\\x{{{int(octal, 8):x}}}"
        if letter in ("A", "z", "b", "B") and inside:
            self.fail("an assertion in a class")
        # the target's \\s and \\v hold more
        return {"s": "\\t\\n\\f\\r " if inside else "[\\t\\n\\f\\r ]", "S": "[^\\t\\n\\f\\r ]", "v": "\\x0B"}.get(letter, found[0])

    def bracket(self) -> str:
        """A character class; brackets and && inside are plain characters."""
        self.at += 1
        out, first = ["["], True
        if self.text.startswith("^", self.at):
            out.append("^")
            self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "]" and not first:
                self.at += 1
                return "".join(out) + "]"
            first = False
            if found := re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.at):
                if found[2] not in POSIX:
                    self.fail(f"unknown class {found[2]}")
                made = POSIX[found[2]]
                out.append(made[0] + made[1].upper() + made[2:] if found[1] else made)
                self.at = found.end()
            elif c == "\\":
                out.append(self.escape(True))
            else:
                out.append("\\" + c if c in "[]&^" else c)
                self.at += 1
        self.fail("missing ]")

    def translate(self) -> str:
        may_repeat = False
        while self.at < len(self.text):
            c = self.text[self.at]
            repeat = _REPEAT.match(self.text, self.at) if c == "{" else None
            if c in "*+?" or repeat:
                if not may_repeat:
                    self.fail("nothing to repeat")
                if repeat:
                    low, high = int(repeat[1]), int(repeat[3] or 0)
                    if max(low, high) > 1000 or repeat[3] and high < low:
                        self.fail("bad repetition")
                self.at = repeat.end() if repeat else self.at + 1
                self.out.append(repeat[0] if repeat else c)
                if self.text.startswith("?", self.at):
                    self.out.append("?")
                    self.at += 1
                may_repeat = False
                continue
            may_repeat = c not in "|("
            if c == "\\":
                self.out.append(self.escape(False))
            elif c == "[":
                self.out.append(self.bracket())
            elif c == "(" and self.text.startswith("?", self.at + 1):
                found = _GROUP.match(self.text, self.at)
                if not found:
                    self.fail("unknown group")
                self.names += found[1] is not None
                self.out.append(f"(?<g{self.names}>" if found[1] else found[0])
                self.at = found.end()
            else:
                self.out.append("\\z" if c == "$" and not self.lines else "\\" + c if c in "{}]" else c)
                self.at += 1
        return "".join(self.out)


def whole_match(pattern: str) -> str:
    """A pattern for rlike that matches a whole value as RE2 would.

    (?d) makes the dot exclude only the newline; \\z, unlike $, does not stand
    before one. What RE2 lacks, look-around, back-references, possessive and atomic
    groups, is an error, as anything malformed is.
    """
    made = rf"(?d)\A(?:{_Re2(pattern).translate()})\z"
    if spark := SparkSession.getActiveSession():
        try:
            spark._jvm.java.util.regex.Pattern.compile(made)
        except IllegalArgumentException as e:
            raise QueryError(f"invalid regular expression {pattern!r}: {e}") from None
    return made


def predicate(m: Matcher) -> Column:
    value = label(m.label)
    if m.op == "=":
        return value == m.value
    if m.op == "!=":
        return value != m.value
    found = value.rlike(whole_match(m.value))
    return found if m.op == "=~" else ~found


def all_of(matchers) -> Column:
    """Conjunction; no matcher at all matches every series."""
    return reduce(lambda a, b: a & b, map(predicate, matchers), F.lit(True))


def in_range(start: int, end: int) -> Column:
    """Both ends belong to the range."""
    return F.col("ts").between(start, end)


def name_contains(text: str) -> Column:
    """Case-insensitive search in metric names."""
    return F.lower("name").contains(text.lower())


def valid_name(name: Column) -> Column:
    return name.rlike(r"\A[a-zA-Z_:][a-zA-Z0-9_:]*\z")


def valid_label(name: Column) -> Column:
    return name.rlike(r"\A[a-zA-Z_][a-zA-Z0-9_]*\z")
