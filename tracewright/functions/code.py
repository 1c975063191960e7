"""Source code as tokens outside quotes and comments, and what they form: symbols, calls and function bodies.

A token is a name, a mark or a whole quote. Brackets are paired, so that a
definition ends at its own bracket; in Python it ends where the indentation
does. Code that doesn't parse gives what can be told: nothing here fails.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from typing import NamedTuple

# Languages by file type, words that are no names of callees, words before a definition.
LANGUAGES = {"rs": "rs", "py": "py", "go": "go", "java": "java", "js": "js", "jsx": "js", "ts": "js", "tsx": "js"}
SYMBOLS = {"rs", "py", "go", "js"}
KEYWORDS = {
    "rs": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type unsafe use where while",
    "py": "and as assert async await break class continue def del elif else except False finally for from global if import in is lambda None nonlocal not or pass raise return True try while with yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "js": "await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null of return super switch this throw true try typeof var void while with yield",
    "java": "",
}
MODIFIERS = {"rs": "pub async unsafe const extern default", "py": "async", "go": "", "js": "async static get set public private protected readonly override accessor", "java": ""}
_KEYWORDS, _MODIFIERS = ({k: frozenset(v.split()) for k, v in d.items()} for d in (KEYWORDS, MODIFIERS))
_KINDS = {"struct": "Struct", "enum": "Enum", "trait": "Trait", "class": "Class"}
#: What may stand before an expression: there a slash opens a pattern, and a brace an object.
_BEFORE_VALUE = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => && || ?? == === != !== += -= return typeof case in of delete void throw new else do".split())

_NUMBER, _MARKS = r"(?P<number>\d\w*(?:\.\d\w*)?)", r"(?P<mark>=>|->|::|\?\.|\?\?|&&|\|\||[-+*/%&|^!=<>]=+|\.\.\.|\S)"
_SLASHED, _PLAIN = r"(?P<comment>//[^\n]*)|(?P<block>/\*)", r'"(?:\\.|[^"\\])*"?'
_PATTERNS = {
    "rs": rf"""{_SLASHED}|(?P<raw>b?r(?P<hashes>#*)")|(?P<quote>b?{_PLAIN}|b?'(?:\\(?:u\{{[^}}]*\}}|x..|.)|[^\\'\n])')|'\w+|(?P<name>r\#\w+|[^\W\d]\w*)""",
    "go": rf"""{_SLASHED}|(?P<quote>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`[^`]*`?)|(?P<name>[^\W\d]\w*)""",
    "java": rf"""{_SLASHED}|(?P<quote>\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<name>[^\W\d]\w*)""",
    "js": rf"""{_SLASHED}|(?P<text>`)|(?P<quote>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<name>[#$]?[^\W\d][\w$]*|\$[\w$]*)""",
    "py": r"""(?P<comment>\#[^\n]*)|(?P<text>(?i:rf|fr|f|t|rt|tr)(?:\"\"\"|'''|"|'))|(?P<quote>(?i:[rbu]|rb|br)?(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?))|(?P<name>[^\W\d]\w*)""",
}
_JS_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_OPEN, _CLOSE = "([{", {")": "(", "]": "[", "}": "{"}
QUOTE = '"'


@cache
def _pattern(lang: str) -> re.Pattern:
    return re.compile(rf"\s*(?:{_PATTERNS[lang]}|{_NUMBER}|{_MARKS})", re.S)


class Token(NamedTuple):
    text: str
    start: int
    end: int
    is_name: bool = False


def _after_block(text: str, at: int, nested: bool) -> int:
    if not nested:
        return end + 2 if (end := text.find("*/", at + 2)) >= 0 else len(text)
    depth = 0
    for m in re.finditer(r"/\*|\*/", text[at:]):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return at + m.end()
    return len(text)


def tokens(text: str, lang: str) -> list[Token]:
    """Names, marks and quotes in order. Code inside of f-strings and templates is code; comments and the rest of quotes are not."""
    out: list[Token] = []
    texts: list[list] = []  # open quotes with code in them: [their end, braces open in that code, where they begin]
    at, pattern = 0, _pattern(lang)

    def text_from(at: int) -> int:
        """Goes on in the innermost open quote, to its end or to code in it."""
        ends, _, begin = texts[-1]
        if ends == "`":
            found = re.compile(r"(?:\\.|(?!`|\$\{).)*(`|\$\{|\Z)", re.S).match(text, at)
            code = found[1] == "${"
        else:
            line = "" if len(ends) == 3 else r"|\n"
            found = re.compile(rf"(?:\\.|\{{\{{|(?!{ends}{line}|\{{).)*({ends}{line}|\{{|\Z)", re.S).match(text, at)
            code = found[1] == "{"
        if not code:
            out.append(Token(QUOTE, begin, found.end()))
            texts.pop()
        return found.end()

    while at < len(text):
        m = pattern.match(text, at)
        if not m:  # blanks at the end
            break
        kind, at = m.lastgroup, m.end()
        if kind is None:
            continue
        start = m.start(kind)
        if kind == "block":
            at = _after_block(text, start, lang == "rs")
        elif kind == "raw":
            end = text.find('"' + m["hashes"], at)
            at = len(text) if end < 0 else end + 1 + len(m["hashes"])
            out.append(Token(QUOTE, start, at))
        elif kind == "text":
            texts.append(["`" if lang == "js" else m[kind].lstrip("rRfFtT"), 0, start])
            at = text_from(at)
        elif kind == "quote" or kind == "number":
            out.append(Token(QUOTE, start, at))
        elif kind == "name":
            out.append(Token(m[kind], start, at, True))
        elif kind == "mark":
            mark = m[kind]
            if mark[0] == "/" and lang == "js" and (not out or out[-1].text in _BEFORE_VALUE) and (found := _JS_PATTERN.match(text, start)):
                at = found.end()
                out.append(Token(QUOTE, start, at))
                continue
            if texts and mark == "}" and not texts[-1][1]:
                at = text_from(at)
                continue
            if texts and mark in "{}":
                texts[-1][1] += 1 if mark == "{" else -1
            out.append(Token(mark, start, at))
    return out


class Symbol(NamedTuple):
    kind: str
    name: str
    first: int  # tokens, both included
    last: int
    line_start: int
    line_end: int


class Code:
    """The tokens of a text, with their pairs, lines, symbols, calls and function bodies."""

    def __init__(self, text: str, ext: str) -> None:
        self.text, self.lang = text, LANGUAGES[ext.lower()]
        self.t = tokens(text, self.lang)
        self.n = len(self.t)
        self._breaks = [m.start() for m in re.finditer("\n", text)]
        self.lines = [self.line(x.start) for x in self.t]
        self.pair: dict[int, int] = {}
        self.around: list[int] = []  # the innermost bracket that a token stands in, -1 outside of all
        held: list[int] = []
        for i, x in enumerate(self.t):
            if x.text in _CLOSE and any(self.t[j].text == _CLOSE[x.text] for j in held[-3:]):
                while self.t[j := held.pop()].text != _CLOSE[x.text]:
                    pass
                self.pair[i], self.pair[j] = j, i
            self.around.append(held[-1] if held else -1)
            if x.text in _OPEN and len(x.text) == 1:
                held.append(i)
        self.symbols: list[Symbol] = []
        self.bodies: list[tuple[int, int]] = []  # of functions, in tokens
        self.silent: list[tuple[int, int]] = []  # where brackets are no calls
        self.declared: set[int] = set()  # the names that are being defined
        {"rs": self._rust, "py": self._python, "go": self._go, "js": self._script, "java": self._java}[self.lang]()
        self.symbols.sort(key=lambda s: s.first)

    def line(self, at: int) -> int:
        return bisect_right(self._breaks, at - 1) + 1

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.n and self.t[i].text in texts

    def named(self, i: int) -> bool:
        return 0 <= i < self.n and self.t[i].is_name and self.t[i].text not in _KEYWORDS[self.lang]

    def over(self, i: int) -> int:
        """The next token at this depth."""
        return self.pair.get(i, i) + 1 if self.t[i].text in _OPEN else i + 1

    def back(self, i: int) -> int:
        """The token before at this depth."""
        return self.pair.get(i, i) - 1 if self.t[i].text in _CLOSE else i - 1

    def find(self, i: int, *texts: str) -> int:
        """The first of these marks from here on at this depth, else the end."""
        while i < self.n and self.t[i].text not in texts and self.t[i].text not in _CLOSE:
            i = self.over(i)
        return min(i, self.n)

    def close(self, i: int) -> int:
        return self.pair.get(i, self.n - 1)

    def add(self, kind: str, name: int, first: int, last: int, body: tuple[int, int] | None = None) -> None:
        last = min(last, self.n - 1)
        end = self.line(self.t[last].end - 1)
        while self.is_(first - 1, *_MODIFIERS[self.lang]) or (self.lang == "rs" and self.is_(first - 1, ")", QUOTE) and self.is_(self.back(first - 1), "pub", "extern")):
            first = first - 1 if self.t[first - 1].is_name else self.back(first - 1)
        self.declared.add(name)
        if self.lang in SYMBOLS and kind:
            self.symbols.append(Symbol(kind, self.t[name].text, first, last, self.lines[first], end))
        if body:
            self.bodies.append(body)

    def _rust(self) -> None:
        for i, x in enumerate(self.t):
            if x.text == "fn" and self.named(i + 1):
                at = self.find(i + 2, "{", ";")
                self.declared.add(i + 1)
                self.silent.append((i, at))
                if self.is_(at, "{"):
                    self.add("Function", i + 1, i, self.close(at), (at, self.close(at)))
            elif x.text in ("struct", "enum", "trait") and self.named(i + 1):
                at = self.find(i + 2, "{", ";")
                last = self.close(at) if self.is_(at, "{") else at
                self.add(_KINDS[x.text], i + 1, i, last)
                self.silent.append((i, at if x.text == "trait" else last))
            elif x.text == "impl":
                self.silent.append((i, self.find(i + 1, "{", ";")))
            elif x.text == "#" and (self.is_(i + 1, "[") or (self.is_(i + 1, "!") and self.is_(i + 2, "["))):
                self.silent.append((i, self.close(i + 1 if self.is_(i + 1, "[") else i + 2)))
            elif x.text == "!" and i and self.t[i - 1].is_name and self.is_(i + 1, "(", "[", "{"):
                self.silent.append((i, self.close(i + 1)))  # the arguments of a macro are no expressions yet
            elif x.text == "let":
                self.silent.append((i, self.find(i + 1, "=", ";", ":")))
            elif x.text == "=>":  # the pattern of an arm, up to its guard
                j = self.back(i - 1) if self.is_(i - 1, "}") else i - 1
                end = i
                while j >= 0 and self.t[j].text not in ("{", "}", ",", ";", "("):
                    end = j if self.t[j].text == "if" else end
                    j = self.back(j)
                self.silent.append((j, end))

    def _python(self) -> None:
        starts = [i for i in range(self.n) if self.around[i] < 0 and (not i or (self.lines[i] > self.line(self.t[i - 1].end - 1) and not self.text[: self.t[i].start].rstrip(" \t").endswith("\\\n")))]
        depth = [len(self.text[self.text.rfind("\n", 0, self.t[i].start) + 1 : self.t[i].start].expandtabs(8)) for i in starts]
        after = [len(starts)] * len(starts)  # the next statement that isn't deeper
        held: list[int] = []
        for k, d in enumerate(depth):
            while held and depth[held[-1]] >= d:
                after[held.pop()] = k
            held.append(k)
        for k, first in enumerate(starts):
            i = first + self.is_(first, "async")
            if self.is_(i, "def", "class") and self.named(i + 1):
                at = self.find(i + 2, ":")
                last = (starts[after[k]] if after[k] < len(starts) else self.n) - 1
                body = (min(at + 1, last), last) if at < self.n else None
                self.add("Class" if self.t[i].text == "class" else "Function", i + 1, i, last, body if self.t[i].text == "def" else None)

    def _go(self) -> None:
        def body(i: int) -> int:
            while i < self.n and not self.is_(i, "{"):
                i = self.over(i + 1 if self.is_(i, "interface", "struct") and self.is_(i + 1, "{") else i)
            return i

        def spec(i: int) -> None:
            last = i
            while last + 1 < self.n and self.lines[last + 1] == self.line(self.t[last].end - 1) and not self.is_(last + 1, ")", "}", ";"):
                last = self.over(last + 1) - 1
            if not self.is_(i + 1, "="):
                self.add("Struct", i, i, last)
            self.silent.append((i, last))

        for i, x in enumerate(self.t):
            if x.text == "func":
                method = self.is_(i + 1, "(") and self.named(self.over(i + 1)) and self.is_(self.over(i + 1) + 1, "(", "[")
                name = self.over(i + 1) if method else i + 1
                known = self.named(name) and (method or self.is_(name + 1, "(", "["))
                at = body(self.over(self.find(name, "(")) if self.find(name, "(") < self.n else self.n)
                if known and at < self.n:
                    self.add("Method" if method else "Function", name, i, self.close(at), (at, self.close(at)))
                elif at < self.n and self.lines[at] == self.lines[i]:
                    self.bodies.append((at, self.close(at)))
            elif x.text == "type" and self.named(i + 1):
                spec(i + 1)
            elif x.text == "type" and self.is_(i + 1, "("):
                j = i + 2
                while j < self.close(i + 1):
                    if self.named(j):
                        spec(j)
                        j = self.silent[-1][1]
                    j += 1

    def _typed_body(self, i: int) -> int:
        """From behind the parameters: the brace of the body, past a type or a list of exceptions."""
        if self.is_(i, ":"):
            i = self.over(i + 1) if self.is_(i + 1, "{") else i + 1
            while i < self.n and not self.is_(i, "{", ";", "=", "}", ")"):
                i = self.over(i)
        elif self.is_(i, "throws"):
            i = self.find(i, "{", ";")
        return i

    def _methods(self, holder: set[int], typed: bool = False) -> None:
        """What stands with parameters and a body in a class or an object; ``typed`` ones behind a type, as constructors are not."""
        for i in range(self.n):
            if self.is_(i, "(") and i and self.around[i] in holder and self.t[i - 1].is_name and not self.is_(i - 1, "function", "if", "for", "while", "switch", "catch", "with"):
                before = i - 2 if i > 1 else 0
                if typed and not (self.is_(before, ">", "]") or (self.t[before].is_name and not self.is_(before, "public", "private", "protected"))):
                    continue
                at = self._typed_body(self.close(i) + 1)
                if self.is_(at, "{") and not self.is_(i - 2, "new", ".", "?."):
                    first = i - 1
                    self.add("Method", i - 1, first, self.close(at), (at, self.close(at)))

    def _script(self) -> None:
        holder = set()
        for i, x in enumerate(self.t):
            if x.text == "{" and self.is_(i - 1, "(", ",", "=", ":", "[", "return", "?", "??", "||", "&&") and not (self.is_(i - 1, ":") and self.is_(i - 2, ")")):
                holder.add(i)  # an object
            elif x.text == "class" and not self.is_(i - 1, ".", "?."):
                at = i + 1 + self.named(i + 1)
                while at < self.n and not self.is_(at, "{"):
                    at = self.over(at)
                holder.add(at)
                if self.named(i + 1) and not self.is_(i - 1, "=", "(", ",", ":", "return", "?", "=>", "["):
                    self.add("Class", i + 1, i, self.close(at))
            elif x.text == "function":
                star = self.is_(i + 1, "*")
                name = i + 1 + star
                at = self._typed_body(self.over(opened) if (opened := self.find(name, "(")) < self.n else self.n)
                if not self.is_(at, "{"):
                    continue
                before = i - 1 - self.is_(i - 1, "async")
                if self.named(name) and not star and not self.is_(before, "=", "(", ",", ":", "return", "?", "=>", "[", "!", "+", "-", "&&", "||", "??", "new", "typeof", "void"):
                    self.add("Function", name, i, self.close(at), (at, self.close(at)))
                else:
                    self.bodies.append((at, self.close(at)))
                    self.declared.add(name)
            elif x.text == "=>" and self.is_(i + 1, "{"):
                self.bodies.append((i + 1, self.close(i + 1)))
        self._methods(holder)

    def _java(self) -> None:
        holder = set()
        for i, x in enumerate(self.t):
            if x.text in ("class", "interface", "enum", "record") and self.named(i + 1):
                holder.add(self.find(i + 2, "{"))
        self._methods(holder, typed=True)

    def _callee(self, i: int) -> int | None:
        """The token that names what is called by what ends at ``i``: the last part in Python and of a field in Rust, else the first name."""
        last_part = None
        while i >= 0:
            if self.is_(i, ")", "]") or (self.is_(i, "}") and self.lang == "rs"):
                inner, i = i, self.back(i)
                if self.is_(i, "!") and self.lang == "rs":
                    i -= 1
                if i < 0 or not (self.t[i].is_name or self.t[i].text in _CLOSE or self.is_(i, ">")) or (self.t[i].is_name and self.t[i].text in _KEYWORDS[self.lang] and not self.is_(i, "this", "super", "self")):
                    return next((k for k in range(self.pair.get(inner, inner) + 1, inner) if self.named(k)), None)
                continue
            if self.is_(i, ">"):
                depth, j = 0, i
                while j >= 0 and (depth or j == i) and not self.is_(j, ";", "{", "}"):
                    depth += self.is_(j, ">") - self.is_(j, "<")
                    j -= 1
                if depth or j < 0:
                    return last_part
                i = j - 1 if self.is_(j, "::") else j
                continue
            if not self.t[i].is_name:
                return last_part
            before = self.t[i - 1].text if i else ""
            if self.named(i) and (self.lang == "py" or (self.lang == "rs" and before == ".")):
                return i
            if self.named(i) or (self.lang == "js" and before in (".", "?.")):
                last_part = i if self.named(i) and before not in (".", "?.") else last_part
            if before not in (".", "::", "?."):
                return last_part if self.named(i) or self.lang == "rs" else None
            i -= 2
        return last_part

    def calls(self) -> list[tuple[Symbol, str]]:
        """(symbol, name) of every call, for the symbol that opened last before it; not a symbol's own name."""
        quiet = sorted(self.silent)
        starts, ends, far = [a for a, _ in quiet], [], -1
        for _, b in quiet:
            ends.append(far := max(far, b))
        opened = [s.first for s in self.symbols]
        out: dict[tuple[Symbol, str], None] = {}
        for i in range(1, self.n):
            if not self.is_(i, "(") or i - 1 in self.declared or not self.symbols:
                continue
            k, s = bisect_right(starts, i) - 1, bisect_right(opened, i) - 1
            if s < 0 or (k >= 0 and ends[k] >= i):
                continue
            before = self.t[i - 1]
            if not (before.is_name or before.text in (")", "]", ">")) or (before.is_name and not self.named(i - 1) and not self.is_(i - 2, ".", "::", "?.")):
                continue
            if self.lang == "go" and before.is_name and self.is_(i - 2, "]"):
                continue  # a conversion to a list
            if self.lang == "js":
                j = i - 1
                while self.t[j].is_name and self.is_(j - 1, ".", "?."):
                    j -= 2
                if self.is_(j - 1, "new"):
                    continue
            found = self._callee(i - 1)
            if found is not None and self.t[found].text != self.symbols[s].name:
                out[self.symbols[s], self.t[found].text] = None
        return list(out)

    def sites(self, name: str) -> list[tuple[int, int, int]]:
        """(line, start, end) of every token with this name, in characters."""
        return [(self.lines[i], x.start, x.end) for i, x in enumerate(self.t) if x.is_name and x.text == name]

    def outer_bodies(self) -> list[tuple[int, int]]:
        """Function bodies that stand in no other one, as ranges of characters."""
        out, far = [], -1
        for a, b in sorted(self.bodies):
            if a > far:
                out.append((self.t[a].start, self.t[b].end))
                far = b
        return out
