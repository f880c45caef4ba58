"""Tokens of TypeScript and JavaScript, with comments kept apart and brackets paired."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SPACE = re.compile(r"[\s\ufeff]+")
_NAME = re.compile(r"#?[^\W\d][\w$]*|#?\$[\w$]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?n?|\d+\.")
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#\\]")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_OPEN = {"(": ")", "[": "]", "{": "}", "${": "}$"}
#: After these a slash begins a regular expression and ``<`` an element.
_BEFORE_VALUE = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "await", "default", "extends"}


@dataclass
class Token:
    kind: str  # name, str, tmpl, num, regex, punct
    text: str
    start: int
    end: int


@dataclass
class Tokens:
    source: str
    items: list[Token] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)
    match: dict[int, int] = field(default_factory=dict)

    def pair(self) -> None:
        """Pair brackets; a stray one stays alone."""
        stack: list[int] = []
        for i, t in enumerate(self.items):
            if t.kind != "punct":
                continue
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in _OPEN.values():
                while stack and _OPEN[self.items[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    self.match[i], self.match[j] = j, i


class Lexer:
    def __init__(self, source: str, jsx: bool):
        self.out, self.s, self.jsx, self.i = Tokens(source), source, jsx, 0

    def run(self) -> Tokens:
        if self.s.startswith("#!"):
            self.i = self.s.find("\n") if "\n" in self.s else len(self.s)
        self._code(None)
        self.out.pair()
        return self.out

    def _put(self, kind: str, start: int, end: int, text: str | None = None) -> None:
        self.out.items.append(Token(kind, self.s[start:end] if text is None else text, start, end))
        self.i = end

    def _value_next(self) -> bool:
        last = self.out.items[-1] if self.out.items else None
        if last is None:
            return True
        if last.kind == "punct":
            return last.text not in (")", "]", "}", "++", "--")
        return last.kind == "name" and last.text in _BEFORE_VALUE

    def _code(self, close: str | None) -> None:
        """Tokens up to an unpaired closing brace, which stays unread."""
        depth, s, n = 0, self.s, len(self.s)
        while self.i < n:
            i = self.i
            if m := _SPACE.match(s, i):
                self.i = m.end()
                continue
            c = s[i]
            if s.startswith("//", i):
                j = s.find("\n", i)
                j = n if j < 0 else j
                self.out.comments.append((i, j))
                self.i = j
            elif s.startswith("/*", i):
                j = s.find("*/", i + 2)
                j = n if j < 0 else j + 2
                self.out.comments.append((i, j))
                self.i = j
            elif c in "\"'":
                j = i + 1
                while j < n and s[j] not in (c, "\n"):
                    j += 2 if s[j] == "\\" else 1
                self._put("str", i, min(n, j + 1))
            elif c == "`":
                self._template()
            elif m := _NAME.match(s, i):
                self._put("name", i, m.end())
            elif c.isdigit() or (c == "." and i + 1 < n and s[i + 1].isdigit()):
                m = _NUMBER.match(s, i)
                self._put("num", i, m.end() if m else i + 1)
            elif c == "/" and self._value_next() and (m := _REGEX.match(s, i)):
                self._put("regex", i, m.end())
            elif c == "<" and self.jsx and self._value_next() and re.match(r"<(?:>|[A-Za-z_$])", s[i : i + 2]) and not re.match(r"<[\w$]+(?:\s+extends\b[^>]*|\s*,\s*[^>]*)>\s*\(", s[i : i + 200]):
                self._element()
            elif m := _PUNCT.match(s, i):
                if m[0] == "{":
                    depth += 1
                elif m[0] == "}":
                    if close and depth == 0:
                        return
                    depth -= 1
                self._put("punct", i, m.end())
            else:
                self.i += 1

    def _hole(self, at: int, width: int) -> None:
        """An expression inside a template or an element."""
        self._put("punct", at, at + width, "${")
        self._code("}")
        self._put("punct", self.i, min(len(self.s), self.i + 1), "}$")

    def _template(self) -> None:
        s, n, start = self.s, len(self.s), self.i
        j = start + 1
        while j < n and s[j] != "`":
            if s[j] == "\\":
                j += 2
            elif s.startswith("${", j):
                self._put("tmpl", start, j)
                self._hole(j, 2)
                start = j = self.i
            else:
                j += 1
        self._put("tmpl", start, min(n, j + 1))

    def _element(self) -> None:
        """A JSX element: only its expressions become tokens."""
        s, n = self.s, len(self.s)
        depth = 0
        self._put("tmpl", self.i, self.i + 1)
        inside_tag, closing = True, False
        while self.i < n:
            c = s[self.i]
            if inside_tag:
                if c in "\"'":
                    j = s.find(c, self.i + 1)
                    self.i = n if j < 0 else j + 1
                elif c == "{":
                    self._hole(self.i, 1)
                elif s.startswith("/>", self.i):
                    self.i += 2
                    inside_tag = False
                    if depth == 0:
                        break
                elif c == ">":
                    self.i += 1
                    inside_tag = False
                    depth += -1 if closing else 1
                    if depth <= 0:
                        break
                else:
                    self.i += 1
            elif c == "{":
                self._hole(self.i, 1)
            elif c == "<":
                closing = s.startswith("</", self.i)
                inside_tag = True
                self.i += 1
            else:
                self.i += 1
        self._put("tmpl", self.i, self.i)


def tokenize(source: str, jsx: bool = False) -> Tokens:
    return Lexer(source, jsx).run()
