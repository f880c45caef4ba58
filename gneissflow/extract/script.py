"""Symbols, imports, calls, routes and rationale comments of one TypeScript or JavaScript text.

A scanner over tokens, not a parser.  It finds declarations by their keywords, bodies by paired
brackets, and calls by parentheses that follow an expression.  What it does not do: types that look
like calls in unusual places, decorators with computed names, and statements that only a full
grammar tells apart; where it is unsure it takes no symbol.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from .lexer import Token, tokenize

# Fixed values.
VERBS = {"get", "post", "put", "patch", "delete", "all", "head", "options"}
BASES = {"app", "router", "server", "route", "routes", "api", "this"}
DECORATORS = {"Get", "Post", "Put", "Patch", "Delete", "All", "Head", "Options"}
TEST = re.compile(r"(?:^|/)(?:__tests__|test|tests|__mocks__|__fixtures__)/|\.(?:test|spec)\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs)$", re.I)
RATIONALE = re.compile(r"\b(WHY|NOTE|HACK|TODO|FIXME)\b[:\s]*(.*)", re.I | re.A)
MODIFIERS = {"export", "default", "declare", "async", "abstract", "public", "private", "protected", "static", "readonly", "override", "accessor", "get", "set"}
NOT_CALLED = {"if", "for", "while", "switch", "catch", "return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "await", "yield", "case", "do", "else", "function", "with", "extends", "as", "default", "export", "const", "let", "var", "satisfies"}
NOT_STATEMENT = {"return", "typeof", "new", "yield", "await", "throw", "void", "in", "of", "case", "extends", "delete", "instanceof"}
ENDS_VALUE = {")", "]", "}", "}$", "++", "--"}


def _cut(text: str, most: int) -> str:
    """By UTF-16 code units."""
    raw = text.encode("utf-16-le", "surrogatepass")
    return text if len(raw) <= 2 * most else raw[: 2 * most].decode("utf-16-le", "ignore")


class Script:
    def __init__(self, path: str, source: str):
        self.path, self.source = path, source
        self.tk = tokenize(source, bool(re.search(r"\.(tsx|jsx|js|mjs|cjs)$", path, re.I)))
        self.t, self.match = self.tk.items, self.tk.match
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.comment_at = [a for a, _ in self.tk.comments]
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.calls: list[tuple[int, int, dict]] = []
        self.routes: list[tuple[int, int, dict]] = []
        self.rationale: list[dict] = []
        self.regions: list[tuple[int, int, str]] = []  # token span and name of what can call
        self.closed: list[tuple[int, int]] = []  # token spans without calls
        self.names: set[int] = set()  # tokens that name a declaration, before its parameters

    # ---- small helpers

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind in ("name", "punct") else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name"

    def line(self, pos: int) -> int:
        return bisect_left(self.breaks, pos) + 1

    def range(self, a: int, b: int) -> dict:
        return {"startLine": self.line(a), "endLine": self.line(b)}

    def newline(self, i: int) -> bool:
        """A line break before token ``i``."""
        return i > 0 and self.line(self.t[i].start) > self.line(self.t[i - 1].end)

    def close(self, i: int) -> int:
        return self.match.get(i, len(self.t) - 1)

    def skip_angles(self, i: int) -> int:
        """Behind ``<...>`` that begins at ``i``, or ``i``."""
        if self.text(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.t):
            x = self.text(j)
            if x in ("(", "[", "{"):
                j = self.close(j)
            elif x == "<":
                depth += 1
            elif x in (">", ">>", ">>>"):
                depth -= len(x)
                if depth <= 0:
                    return j + 1
            elif x in (";", ")", "}", "]", "&&", "||"):
                return i
            j += 1
        return i

    def ends(self, i: int, type_: bool = False) -> int:
        """Index behind the expression or type that begins at ``i``."""
        j = i
        while j < len(self.t):
            x = self.text(j)
            if x in (",", ";", ")", "]", "}", "}$"):
                return j
            if type_ and x == "<" and (k := self.skip_angles(j)) > j:
                j = k
                continue
            if j > i and self.newline(j):
                prev, cur = self.t[j - 1], self.t[j]
                open_ = prev.kind == "punct" and prev.text not in ENDS_VALUE and not (type_ and prev.text == ">")
                open_ = open_ or (prev.kind == "name" and prev.text in (NOT_STATEMENT | {"keyof", "as", "is"}))
                goes_on = (cur.kind == "punct" and cur.text not in ("{", "++", "--", "@", "!", "~", "${", "#")) or cur.text in ("instanceof", "in", "as", "satisfies", "extends") or (cur.kind == "tmpl" and cur.text[:1] == "`")
                if not open_ and not goes_on:
                    return j
            j = self.close(j) + 1 if x in ("(", "[", "{", "${") else j + 1
        return len(self.t)

    def body_after(self, i: int) -> tuple[int, int]:
        """(open brace or -1, index behind) of what follows a parameter list that ends before ``i``."""
        j = i
        if self.text(j) == ":":
            j += 1
            fresh = True
            while j < len(self.t):
                x = self.text(j)
                if x == "{" and not fresh:
                    break
                if x in (";", ",", "}", ")"):
                    break
                if not fresh and self.newline(j) and self.t[j].kind == "name":
                    break
                if x in ("(", "[", "{"):
                    j, fresh = self.close(j) + 1, False
                elif x == "<" and (k := self.skip_angles(j)) > j:
                    j, fresh = k, False
                else:
                    fresh = x in ("|", "&", "=>", "is", "extends", "keyof", "typeof", "?", ":", "asserts", ".")
                    j += 1
        if self.text(j) == "{":
            return j, self.close(j) + 1
        return -1, j + 1 if self.text(j) == ";" else j

    def modifiers_before(self, i: int) -> int:
        """First token of the modifiers and decorators before ``i``."""
        j = i
        while j > 0:
            if self.is_name(j - 1) and self.t[j - 1].text in MODIFIERS | {"const"} and self.text(j - 2) != ".":
                j -= 1
                continue
            k = j - 1
            if self.text(k) == ")" and k in self.match:
                k = self.match[k] - 1
            while k > 1 and self.is_name(k) and self.text(k - 1) == ".":
                k -= 2
            if self.is_name(k) and self.text(k - 1) == "@":
                j = k - 1
                continue
            break
        return j

    def in_statement(self, first: int) -> bool:
        """Whether a declaration may begin at token ``first``."""
        if first == 0:
            return True
        p = self.t[first - 1]
        if p.kind == "punct":
            return p.text in (";", "{", "}", ")", "}$") or (p.text in ("]",) and self.newline(first))
        if p.kind == "name":
            return p.text not in NOT_STATEMENT and (p.text in ("else", "do") or self.newline(first))
        return self.newline(first)

    # ---- facts

    def leading(self, first: int) -> list[tuple[int, int]]:
        """Comments before a token that stand on lines of their own (or open the text)."""
        a = self.t[first - 1].end if first else 0
        b = self.t[first].start
        found = self.tk.comments[bisect_left(self.comment_at, a) : bisect_right(self.comment_at, b)]
        return [(x, y) for x, y in found if a == 0 or "\n" in self.source[a:x]]

    def jsdoc(self, first: int) -> str:
        found = self.leading(first)
        if not found:
            return ""
        c = self.source[found[-1][0] : found[-1][1]]
        if not c.startswith("/**"):
            return ""
        lines = [re.sub(r"^\s*\*\s?", "", x).strip() for x in re.sub(r"\*/$", "", c[3:]).split("\n")]
        return _cut(" ".join(x for x in lines if x), 200)

    def symbol(self, kind: str, name: str, first: int, last: int, qname: str, exported: bool, heritage: dict | None = None) -> None:
        a, b = self.t[first].start, self.t[last].end
        whole = self.source[a:b].strip()
        line = whole.split("\n", 1)[0]
        head = _cut(line, 160)
        self.symbols.append({
            "kind": kind, "name": name, "qualified_name": f"{self.path}#{qname}", "signature": line if head == line else head + "…", "jsdoc": self.jsdoc(first), "source": whole,
            "range": self.range(a, b), "exported": exported, "confidence": 1.0, "is_test": bool(TEST.search(self.path)), "heritage": heritage or {"extends": [], "implements": []}, "_at": a,
        })
        for x, y in self.leading(first):
            if m := RATIONALE.search(self.source[x:y]):
                text = _cut((m[2] or "").strip(), 300)
                self.rationale.append({"marker": m[1], "symbol_qualified_name": f"{self.path}#{qname}", "text": text or m[1], "range": self.range(x, y), "_at": a})

    def exports(self) -> None:
        """Names that leave the module otherwise than by a modifier of their own."""
        out: set[str] = set()
        self.reachable = out
        for i, t in enumerate(self.t):
            if t.kind != "name":
                continue
            if t.text == "export" and self.text(i - 1) != ".":
                j = i + 1
                if self.text(j) == "type" and self.text(j + 1) == "{":
                    j += 1
                if self.text(j) == "{":
                    part: list[Token] = []
                    for k in range(j + 1, self.close(j) + 1):
                        if self.text(k) in (",", "}"):
                            if part and part[-1].kind == "name":
                                out.add(part[-1].text)
                            part = []
                        else:
                            part.append(self.t[k])
                elif self.text(j) in ("default", "="):
                    k = j + 1
                    if self.is_name(k) and self.text(k) not in ("class", "function", "async", "abstract", "interface", "new") and self.text(k + 1) in (";", "", "}"):
                        out.add(self.text(k))
                    elif self.is_name(k) and self.is_name(k + 1) and self.newline(k + 1) and self.text(k) not in ("class", "function", "async", "abstract"):
                        out.add(self.text(k))
                    elif self.text(j) == "=" and self.text(k) in ("class", "function") and self.is_name(k + 1):
                        out.add(self.text(k + 1))
                elif self.text(j) in ("const", "let", "var") or (self.text(j) == "declare" and self.text(j + 1) in ("const", "let", "var")):
                    k = j + 1 + (self.text(j) == "declare")
                    while k < len(self.t):
                        if self.is_name(k):
                            out.add(self.text(k))
                        k = self.declarator(k)[2]
                        if self.text(k) != ",":
                            break
                        k += 1
                else:
                    k = j
                    while self.text(k) in ("declare", "abstract", "async", "const", "function", "class", "interface", "type", "enum", "*"):
                        k += 1
                    if k > j and self.is_name(k):
                        out.add(self.text(k))
            elif t.text == "exports":
                own = self.text(i - 1) != "." or (self.text(i - 2) == "module" and self.text(i - 3) != ".")
                whole = self.text(i - 1) == "." and own
                if own and self.text(i + 1) == "." and self.is_name(i + 2) and self.text(i + 3) == "=":
                    out.add(self.text(i + 2))
                elif whole and self.text(i + 1) == "=":
                    if self.is_name(i + 2) and self.text(i + 3) in (";", "") or self.is_name(i + 2) and self.newline(i + 3):
                        out.add(self.text(i + 2))
                    elif self.text(i + 2) == "{":
                        k, end = i + 3, self.close(i + 2)
                        while k < end:
                            if self.is_name(k) and self.text(k + 1) in (",", "}", ":"):
                                out.add(self.text(k))
                            k = self.ends(k) + 1 if self.text(k + 1) != ":" else self.ends(k + 2) + 1

    def declarator(self, i: int) -> tuple[int, int, int]:
        """(first token of the initializer or -1, its end, end of the declarator) for one that begins at ``i``."""
        j = self.close(i) + 1 if self.text(i) in ("{", "[") else i + 1
        if self.text(j) == "!":
            j += 1
        if self.text(j) == ":":
            j += 1
            while j < len(self.t) and self.text(j) not in ("=", ",", ";", ")", "}"):
                if self.text(j) in ("of", "in") or (self.newline(j) and self.t[j].kind == "name" and self.text(j - 1) not in ("|", "&", "=>", ":", "<", ",")):
                    return -1, j, j
                x = self.text(j)
                j = self.close(j) + 1 if x in ("(", "[", "{") else max(j + 1, self.skip_angles(j))
        if self.text(j) != "=":
            return -1, j, j
        end = self.ends(j + 1)
        return j + 1, end, end

    def function_value(self, i: int) -> tuple[int, int] | None:
        """(body or -1, index behind) if a function or arrow function begins at ``i``."""
        j = i + 1 if self.text(i) == "async" and not self.newline(i + 1) else i
        if self.text(j) == "function":
            j += 1
            if self.text(j) == "*":
                j += 1
            if self.is_name(j) and self.text(j) != "(":
                j += 1
            j = self.skip_angles(j)
            return self.body_after(self.close(j) + 1) if self.text(j) == "(" else None
        j = self.skip_angles(j)
        if self.text(j) == "(":
            k = self.close(j) + 1
            if self.text(k) == ":":
                k += 1
                while k < len(self.t) and self.text(k) not in ("=>", ";", ",", ")", "}"):
                    k = self.close(k) + 1 if self.text(k) in ("(", "[", "{") else max(k + 1, self.skip_angles(k))
                    if self.text(k) == "=>" and self.text(k - 1) == ")" and self.text(k + 1) not in ("{", "("):
                        pass
        elif self.is_name(j):
            k = j + 1
        else:
            return None
        if self.text(k) != "=>":
            return None
        return (k + 1, self.close(k + 1) + 1) if self.text(k + 1) == "{" else (-1, self.ends(k + 1))

    def import_at(self, i: int) -> int:
        """The import declaration at ``i``; index behind it."""
        j, found = i + 1, []
        if self.text(j) == "type" and self.text(j + 1) not in (",", "from"):
            j += 1
        if self.is_name(j) and self.text(j) != "from" or (self.text(j) == "from" and self.text(j + 1) == "from"):
            found.append(("default", self.text(j)))
            j += 1
            if self.text(j) == "=":  # import x = require("y") is no import declaration
                return j
        if self.text(j) == ",":
            j += 1
        if self.text(j) == "*" and self.text(j + 1) == "as":
            found.append(("namespace", self.text(j + 2)))
            j += 3
        elif self.text(j) == "{":
            end, last = self.close(j), None
            for k in range(j + 1, end + 1):
                if self.text(k) in (",", "}"):
                    if last is not None:
                        found.append(("named", last))
                    last = None
                elif self.t[k].kind == "name":
                    last = self.t[k].text
            j = end + 1
        if self.text(j) == "from":
            j += 1
        elif found:
            return i + 1
        if j >= len(self.t) or self.t[j].kind != "str":
            return i + 1
        end = j + 1
        if self.text(end) in ("with", "assert") and self.text(end + 1) == "{":
            end = self.close(end + 1) + 1
        if self.text(end) == ";":
            end += 1
        span = self.range(self.t[i].start, self.t[end - 1].end)
        for kind, name in found or [("side-effect", None)]:
            self.imports.append({"kind": kind, "imported_name": name, "module_specifier": _unquote(self.t[j].text), "range": span})
        self.closed.append((i, end))
        return end

    def class_at(self, i: int, first: int) -> None:
        name = self.text(i + 1)
        j = self.skip_angles(i + 2)
        heritage: dict[str, list[str]] = {"extends": [], "implements": []}
        while j < len(self.t) and self.text(j) != "{":
            if self.text(j) in heritage:
                part, j = self.text(j), j + 1
                while j < len(self.t) and self.text(j) not in ("{", "implements", "extends"):
                    a = j
                    while j < len(self.t) and self.text(j) not in ("{", ",", "implements", "<"):
                        j = self.close(j) + 1 if self.text(j) in ("(", "[") else j + 1
                    if j > a:
                        heritage[part].append(self.source[self.t[a].start : self.t[j - 1].end])
                    j = self.skip_angles(j) if self.text(j) == "<" else j
                    if self.text(j) == ",":
                        j += 1
                    elif j == a:
                        j += 1
            else:
                j += 1
        body, end = j, self.close(j)
        out = "export" in {self.text(k) for k in range(first, i)} or name in self.reachable
        self.symbol("class", name, first, end, name, out, heritage)
        inner = [(first, body)]  # what lies outside methods and constructors has no calls
        j = at = body + 1
        while j < end:
            start = j
            while j < end:  # decorators and modifiers
                if self.text(j) == "@":
                    j += 2
                    while self.text(j) == ".":
                        j += 2
                    j = self.close(j) + 1 if self.text(j) == "(" else j
                elif self.is_name(j) and self.text(j) in MODIFIERS and self.text(j + 1) not in ("(", "=", ";", ":", "?", "!", "<", "}", ",") and not (self.newline(j + 1) and self.text(j) in ("get", "set", "static")):
                    j += 1
                elif self.text(j) == "*":
                    j += 1
                else:
                    break
            if j >= end:
                break
            if self.text(j) in (";", ","):
                j += 1
                continue
            if self.text(j) == "{":  # static block
                j = self.close(j) + 1
                continue
            accessor = any(self.text(k) in ("get", "set") for k in range(start, j)) and self.text(j - 1) in ("get", "set")
            label, after = self.t[j], self.close(j) + 1 if self.text(j) == "[" else j + 1
            title = _unquote(label.text) if label.kind == "str" else self.source[label.start : self.t[after - 1].end]
            if self.text(after) in ("?", "!"):
                after += 1
            params = self.skip_angles(after)
            if self.text(params) == "(":
                _, stop = self.body_after(self.close(params) + 1)
                if not accessor:
                    ctor = title == "constructor" and "static" not in {self.text(k) for k in range(start, j)}
                    kind = "constructor" if ctor else "method"
                    self.symbol(kind, title, start, stop - 1, f"{name}.{title}", out)
                    self.regions.append((start, stop, f"{self.path}#{name}.{title}"))
                    self.names.add(after - 1 if self.text(after - 1) not in ("?", "!") else after - 2)
                    self.names.add(params)
                    inner.append((at, start))
                    at = stop
                j = max(stop, j + 1)
            else:
                _, _, j = self.declarator(j) if self.text(after) in ("=", ":", "!") else (0, 0, max(self.ends(j), j + 1))
                if self.text(j) == ";":
                    j += 1
        inner.append((at, end + 1))
        self.closed += [(a, b) for a, b in inner if a < b]

    def declarations(self) -> None:
        t, i = self.t, 0
        for i in range(len(t)):
            if t[i].kind != "name" or self.text(i - 1) in (".", "?."):
                continue
            w = t[i].text
            if w == "import" and self.in_statement(i) and self.text(i + 1) not in ("(", "."):
                self.import_at(i)
            elif w == "function":
                first = self.modifiers_before(i)
                j = i + 1 + (self.text(i + 1) == "*")
                if self.is_name(j) and self.in_statement(first):
                    params = self.skip_angles(j + 1)
                    if self.text(params) == "(":
                        _, stop = self.body_after(self.close(params) + 1)
                        name = self.text(j)
                        self.symbol("function", name, first, stop - 1, name, "export" in {self.text(k) for k in range(first, i)} or name in self.reachable)
                        self.regions.append((first, stop, f"{self.path}#{name}"))
                        self.names.add(params)
                else:
                    params = self.skip_angles(j + (1 if self.is_name(j) else 0))
                    self.names.add(params)
            elif w == "class" and self.is_name(i + 1) and self.text(i + 1) not in ("extends", "implements"):
                first = self.modifiers_before(i)
                if self.in_statement(first):
                    self.class_at(i, first)
            elif w in ("interface", "type", "enum") and self.is_name(i + 1):
                first = self.modifiers_before(i)
                k = self.skip_angles(i + 2)
                if not self.in_statement(first) or self.text(k) not in {"interface": ("{", "extends"), "type": ("=",), "enum": ("{",)}[w]:
                    continue
                heritage = None
                if w == "type":
                    end = self.ends(k + 1, True)
                    end = end if self.text(end) == ";" else end - 1
                else:
                    base, a = [], k + 1
                    if self.text(k) == "extends":
                        j = k + 1
                        while j < len(t) and self.text(j) != "{":
                            if self.text(j) in (",", "<"):
                                if j > a:
                                    base.append(self.source[t[a].start : t[j - 1].end])
                                j = self.skip_angles(j) if self.text(j) == "<" else j
                                j += self.text(j) == ","
                                a = j
                            else:
                                j += 1
                        if j > a:
                            base.append(self.source[t[a].start : t[j - 1].end])
                        k = j
                    end = self.close(k)
                    heritage = {"extends": base, "implements": []}
                name = self.text(i + 1)
                self.symbol(w, name, first, end, name, "export" in {self.text(x) for x in range(first, i)} or name in self.reachable, heritage if w == "interface" else None)
                if w != "enum":
                    self.closed.append((first, end + 1))
            elif w in ("const", "let", "var") and self.text(i + 1) != "enum":
                j = i + 1
                while j < len(t) and (self.is_name(j) or self.text(j) in ("{", "[")):
                    init, _, stop = self.declarator(j)
                    if init >= 0 and self.is_name(j) and (f := self.function_value(init)) and f[1] >= stop:
                        last, name = max(f[1], init + 1) - 1, self.text(j)
                        self.symbol("callable-variable", name, j, last, name, name in self.reachable)
                        self.regions.append((j, last + 1, f"{self.path}#{name}"))
                    if self.text(stop) != ",":
                        break
                    j = stop + 1

    def chain_start(self, j: int) -> tuple[int, bool]:
        """(first token, whether it is a bare ``new`` target) of the expression that ends at ``j``."""
        called = False
        while True:
            x = self.t[j]
            if x.kind == "punct" and x.text in (")", "]", "}$") and j in self.match:
                j = self.match[j]
                called = called or self.text(j) == "("
                if x.text == "}$":
                    j -= 1
                    continue
                p = j - 1
                if p >= 0 and self.text(p) in (">", ">>") and (k := self.angles_back(p)) is not None:
                    p = k
                if p >= 0 and (self.t[p].kind in ("str", "tmpl") or (self.t[p].kind == "name" and self.t[p].text not in NOT_CALLED) or self.text(p) in (")", "]", "!") or self.text(p) == "?."):
                    j = p - 1 if self.text(p) == "?." else p
                    continue
                break
            if x.text == "!" and x.kind == "punct":
                j -= 1
                continue
            if x.kind == "tmpl" and not x.text.startswith("`") and j > 0 and self.text(j - 1) == "}$":
                j -= 1
                continue
            if self.text(j - 1) in (".", "?.") and j > 1:
                j -= 2
                continue
            break
        if self.text(j - 1) == "new":
            return j - 1, not called
        return j, False

    def angles_back(self, p: int) -> int | None:
        """Token before ``<...>`` that ends at ``p``, if type arguments stand there."""
        depth, j = 0, p
        while j >= 0 and p - j < 200:
            x = self.text(j)
            if x in (">", ">>", ">>>"):
                depth += len(x)
            elif x == "<":
                depth -= 1
                if depth == 0:
                    return j - 1 if self.is_name(j - 1) and self.t[j - 1].end == self.t[j].start else None
            elif x in (")", "]", "}") and j in self.match:
                j = self.match[j]
            elif x in (";", "&&", "||", "(", "{"):
                return None
            j -= 1
        return None

    def find_calls(self) -> None:
        shut = sorted(self.closed)
        held = sorted(self.regions)
        starts = [a for a, _, _ in held]
        open_: list[tuple[int, int]] = []  # closed spans without what regions open again
        for a, b in shut:
            open_.append((a, b))
        for i, t in enumerate(self.t):
            if t.kind != "punct" or t.text != "(" or i in self.names or i == 0 or i not in self.match:
                continue
            j = i - 1
            if self.text(j) == "?.":
                j -= 1
            elif self.text(j) in (">", ">>"):
                k = self.angles_back(j)
                if k is None:
                    continue
                j = k
            p, after = self.t[j], self.match[i] + 1
            if p.kind == "punct" and p.text not in (")", "]", "!", "}$") or p.kind in ("num", "regex", "str"):
                continue
            if p.kind == "punct" and p.text == ")" and self._control(j):
                continue
            if p.kind == "punct" and p.text == "!" and not (j > 0 and (self.t[j - 1].kind == "name" or self.text(j - 1) in (")", "]")) and self.t[j - 1].end == p.start):
                continue
            if p.kind == "name":
                if self.text(j - 1) not in (".", "?.") and p.text in NOT_CALLED:
                    continue
                if p.text == "async" and self.text(after) in ("=>", ":"):
                    continue
                if self.text(after) == "{" and not self.newline(after) and self.text(j - 1) not in (".", "?.", "extends"):
                    continue  # a method of an object
                if self.text(after) == ":" and self.text(j - 1) in ("{", ",") and self.body_after(after)[0] >= 0 and self.text(self.match.get(self._brace(j), -1)) == "}" and self._is_object(j):
                    continue
            first, fresh = self.chain_start(j)
            if fresh:
                continue
            if self._shut(i, open_, held, starts):
                continue
            callee = self.source[self.t[first].start : p.end]
            if p.kind == "name" and self.text(j - 1) in (".", "?."):
                receiver = "this" if self.text(j - 2) == "this" and first == j - 2 else "property"
            elif p.kind == "name" and p.text not in ("super", "import", "this") and first == j:
                receiver = "identifier"
            else:
                receiver = "unresolved"
            a, b = self.t[first].start, self.t[self.match[i]].end
            caller = self._caller(i, held)
            span = self.range(a, b)
            self.calls.append((a, -b, {"caller_qualified_name": caller, "callee_text": _cut(callee, 120), "receiver": receiver, "range": span}))
            if route := self._route(j, i, receiver, caller):
                self.routes.append((a, -b, route | {"range": span}))

    def _control(self, j: int) -> bool:
        k = self.match.get(j, 0) - 1
        return k >= 0 and self.is_name(k) and self.text(k) in ("if", "for", "while", "switch", "catch", "with") and self.text(k - 1) not in (".", "?.")

    def _brace(self, j: int) -> int:
        while j >= 0:
            x = self.text(j)
            if x in (")", "]", "}", "}$") and j in self.match:
                j = self.match[j]
            elif x in ("{", "(", "[", "${"):
                return j
            j -= 1
        return -1

    def _is_object(self, j: int) -> bool:
        k = self._brace(j)
        return k > 0 and self.text(k) == "{" and self.text(k - 1) in ("=", "(", ",", ":", "return", "[", "=>", "?", "&&", "||", "??")

    def _shut(self, i: int, shut: list, held: list, starts: list[int]) -> bool:
        """In a span without calls, and in no method that the span's class opens again."""
        inner = max((a for a, b in shut if a <= i < b), default=-1)
        if inner < 0:
            return False
        best = max((a for a, b, _ in held if a <= i < b), default=-1)
        return best < inner

    def _caller(self, i: int, held: list) -> str:
        best, name = -1, ""
        for a, b, n in held:
            if a <= i < b and a >= best:
                best, name = a, n
        return name

    def _route(self, j: int, i: int, receiver: str, caller: str) -> dict | None:
        word = self.text(j)
        if receiver in ("property", "this"):
            base = self.t[j - 2].text if self.t[j - 2].kind == "name" else ""
            if word.lower() not in VERBS or base not in BASES:
                return None
        elif receiver != "identifier" or word not in DECORATORS:
            return None
        args, k, end = [], i + 1, self.match[i]
        while k < end:
            stop = self.ends(k)
            while stop < end and self.text(stop) != ",":
                stop = self.ends(stop + 1) if self.text(stop) == ";" else stop + 1
            args.append((k, min(stop, end)))
            k = stop + 1
        if not args or args[0][1] - args[0][0] != 1 or self.t[args[0][0]].kind != "str":
            return None
        a, b = args[-1]
        handler = None
        if b - a == 1 and self.is_name(a):
            handler = self.text(a)
        elif self.function_value(a):
            handler = caller or None
        elif b - a > 1 and self.is_name(b - 1) and self.text(b - 2) in (".", "?.") and self.chain_start(b - 1)[0] == a:
            handler = self.text(b - 1)
        return {"method": word.upper(), "route_path": _unquote(self.t[args[0][0]].text), "handler_name": handler}

    def facts(self) -> dict[str, list[dict]]:
        self.exports()
        self.declarations()
        self.find_calls()
        order = lambda rows: [{k: v for k, v in r.items() if k != "_at"} for r in sorted(rows, key=lambda r: r["_at"])]
        return {
            "symbols": order(self.symbols), "imports": self.imports, "calls": [c for _, _, c in sorted(self.calls, key=lambda c: c[:2])],
            "rationale": order(self.rationale), "routes": [r for _, _, r in sorted(self.routes, key=lambda r: r[:2])],
        }


def _unquote(text: str) -> str:
    body = text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]
    simple = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
    return re.sub(r"\\(u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.|\n))", lambda m: chr(int(m[2] or m[3] or m[4], 16)) if m[2] or m[3] or m[4] else simple.get(m[5], m[5]), body)


def extract(path: str, source: str) -> dict[str, list[dict]]:
    """Facts of one file; files of other kinds have none."""
    if not re.search(r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$", path, re.I):
        return {"symbols": [], "imports": [], "calls": [], "rationale": [], "routes": []}
    return Script(path, source).facts()
