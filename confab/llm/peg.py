"""Parsing-expression grammars: rules as text, parsers as closures, results as trees.

    Rule   <- Choice per line:   Name <- a b / c
    terms  /regex/ , 'literal', Name, (group), !x (not ahead), x? x* x+

Choices are ordered and never tried again once one has matched; repetition is
greedy. A rule's match is a node (name, start, end, children); rules whose name
begins with '_' leave no node, their children move up.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Node = tuple[str, int, int, list]
#: A parser takes (text, position, nodes to add to) and returns the position after, or -1.
Parser = Callable[[str, int, list], int]

DEPTH = 30
_TOKEN = re.compile(r"\s*(?:/((?:\\.|[^/\\])+)/|'((?:\\.|[^'\\])*)'|(\w+)|(<-|[()!?*+/]))")


class Grammar:
    """`brackets`: rules that hold themselves, by their two signs ('()').

    Where such a rule has failed it is not tried again, and it is not tried at signs without a partner or more
    than DEPTH deep, so that unclosed brackets cost linear and not exponential time.
    """

    def __init__(self, rules: str, flags: int = re.IGNORECASE, brackets: dict[str, str] | None = None):
        self.flags, self.rules, self.brackets, self.failed = flags, {}, brackets or {}, set()
        self.once = set(self.brackets.values())
        self.signs = re.compile("[" + re.escape("".join(self.brackets)) + "]")
        for line in re.split(r"\n(?=\s*\w+\s*<-)", rules.strip()):
            name, _, body = line.strip().partition("<-")
            # a slash between blanks is a choice, any other opens a regex
            self.tokens = self._scan(body)
            self.at = 0
            self.rules[name.strip()] = self._node(name.strip(), self._choice())

    def _scan(self, body: str) -> list[tuple[str, str]]:
        out, i = [], 0
        while i < len(body):
            if body[i].isspace():
                i += 1
            elif body.startswith("/ ", i):
                out.append(("op", "/"))
                i += 1
            elif m := _TOKEN.match(body, i):
                for kind, v in zip(("regex", "literal", "name", "op"), m.groups()):
                    if v is not None:
                        out.append((kind, v))
                i = m.end()
            else:
                raise ValueError(f"can't read the grammar at {body[i:]!r}")
        return out

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _choice(self) -> Parser:
        options = [self._sequence()]
        while self._peek() == ("op", "/"):
            self.at += 1
            options.append(self._sequence())
        if len(options) == 1:
            return options[0]

        def parse(t: str, i: int, out: list) -> int:
            n = len(out)
            for o in options:
                if (j := o(t, i, out)) >= 0:
                    return j
                del out[n:]
            return -1

        return parse

    def _sequence(self) -> Parser:
        parts = []
        while self._peek()[0] != "end" and self._peek() not in (("op", ")"), ("op", "/")):
            parts.append(self._suffixed())
        if len(parts) == 1:
            return parts[0]

        def parse(t: str, i: int, out: list) -> int:
            n = len(out)
            for p in parts:
                if (i := p(t, i, out)) < 0:
                    del out[n:]
                    return -1
            return i

        return parse

    def _suffixed(self) -> Parser:
        if self._peek() == ("op", "!"):
            self.at += 1
            inner = self._suffixed()
            return lambda t, i, out: i if inner(t, i, []) < 0 else -1
        one = self._primary()
        kind, v = self._peek()
        if kind != "op" or v not in "?*+":
            return one
        self.at += 1
        least, most = {"?": (0, 1), "*": (0, 0), "+": (1, 0)}[v]

        def parse(t: str, i: int, out: list) -> int:
            n = 0
            while not most or n < most:
                j = one(t, i, out)
                if j < 0 or j == i:
                    n += j == i
                    break
                i, n = j, n + 1
            return i if n >= least else -1

        return parse

    def _primary(self) -> Parser:
        kind, v = self._peek()
        self.at += 1
        if (kind, v) == ("op", "("):
            inner = self._choice()
            self.at += 1
            return inner
        if kind == "name":
            return self._rule(v)
        match = re.compile(v if kind == "regex" else re.escape(v), self.flags).match

        def parse(t: str, i: int, out: list) -> int:
            m = match(t, i)
            return m.end() if m else -1

        return parse

    def _rule(self, name: str) -> Parser:
        if name in self.once:

            def parse(t: str, i: int, out: list) -> int:
                if (name, i) in self.failed:
                    return -1
                if (j := self.rules[name](t, i, out)) < 0:
                    self.failed.add((name, i))
                return j

            return parse
        rule: Parser | None = None

        def parse_first(t: str, i: int, out: list) -> int:  # the rule may be defined further down
            nonlocal rule
            rule = rule or self.rules[name]
            return rule(t, i, out)

        return parse_first

    def _node(self, name: str, body: Parser) -> Parser:
        if name[0] == "_":
            return body

        def parse(t: str, i: int, out: list) -> int:
            children: list = []
            j = body(t, i, children)
            if j >= 0:
                out.append((name, i, j, children))
            return j

        return parse

    def _unpaired(self, text: str) -> None:
        open_: dict[str, list[int]] = {b[1]: [] for b in self.brackets}
        rule = {b[0]: (b[1], name) for b, name in self.brackets.items()}
        depth = 0
        for m in self.signs.finditer(text):
            sign = m.group()
            if sign in open_:
                if open_[sign]:
                    open_[sign].pop()
                    depth -= 1
                continue
            closer, name = rule[sign]
            open_[closer].append(m.start())
            depth += 1
            if depth > DEPTH:
                self.failed.add((name, m.start()))
        for b, name in self.brackets.items():
            self.failed.update((name, i) for i in open_[b[1]])

    def parse(self, rule: str, text: str) -> Node | None:
        """The tree of the longest start of the text that the rule matches."""
        out: list = []
        self.failed.clear()
        if self.brackets:
            self._unpaired(text)
        return out[0] if self.rules[rule](text, 0, out) >= 0 and out else None
