"""String literals, static templates and JSX text of JavaScript and TypeScript, with what is around them.

One pass over the tokens keeps a stack of the constructs that decide whether a string is visible: blocks, object
literals, type bodies, enums, import and export statements, JSX elements and attributes. That isn't a parser: an error
is reported for what doesn't close (strings, templates, comments, brackets, JSX), for an operator without a right side
and for a declaration without a name; other wrong syntax is passed over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

VISIBLE = frozenset(("aria-label", "title", "placeholder", "alt", "label"))
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "\\": "\\"}
_WORD = re.compile(r"[\w$#@]+", re.U)
_TAG = re.compile(r"[\w$.:-]+", re.U)
_SPACE = re.compile(r"\s+", re.U)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_NUMBER = re.compile(r"(?:0[xXbBoO][\w]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)")
_OPERATOR = re.compile(r"=>|\.\.\.|\?\.|\?\?=?|[=!]==?|&&=?|\|\|=?|\*\*=?|\+\+|--|<<=?|[-+*/%&|^]=|<=|>=|.", re.S)
#: Brackets of type arguments; arrows and strings are passed over as a whole.
_ANGLE = re.compile(r"""=>|"[^"\n]*"|'[^'\n]*'|<|>""")
#: Words after which an expression begins.
_BEFORE_VALUE = frozenset("return typeof case in of do else instanceof new delete void throw await yield default extends as satisfies".split())
_CONTINUES = frozenset(". , ? : + - * / % & | ^ = < > ( [ ` => ?. ?? && || == === != !== <= >= in instanceof as satisfies ) ] } { of from".split())


#: Operators that want something behind them.
_DANGLING = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= == === != !== <= >= && || ?? + - % => . ?. ...".split())
#: Words whose parenthesis isn't a value, so that a regular expression may follow it.
_HEADS = frozenset(("if", "while", "for", "with"))


class SyntaxProblem(ValueError):
    """Something that doesn't close, or lacks a part."""


@dataclass(frozen=True)
class Found:
    line: int
    column: int
    kind: str
    raw: str


def unescape(text: str, quote: str) -> str:
    """The escapes of a quoted text decoded; with any that isn't one, the text as it is."""
    if "\\" not in text:
        return text
    out, i = [], 0
    while i < len(text):
        if text[i] != "\\":
            out.append(text[i])
            i += 1
            continue
        c = text[i + 1 : i + 2]
        if c in _SIMPLE:
            out.append(_SIMPLE[c])
            i += 2
        elif c and c in "xuU":
            n = {"x": 2, "u": 4, "U": 8}[c]
            digits = text[i + 2 : i + 2 + n]
            if not re.fullmatch(f"[0-9a-fA-F]{{{n}}}", digits):
                return text
            v = int(digits, 16)
            if c != "x" and (0xD800 <= v < 0xE000 or v > 0x10FFFF):
                return text
            out.append(chr(v))
            i += 2 + n
        elif re.fullmatch("[0-7]{3}", text[i + 1 : i + 4]) and int(text[i + 1 : i + 4], 8) < 256:
            out.append(chr(int(text[i + 1 : i + 4], 8)))
            i += 4
        elif c and c == quote and quote in "'\"":
            out.append(c)
            i += 2
        else:
            return text
    return "".join(out)


class Frame:
    """A construct on the stack. what: program, block, object, type, enum, class, clause, paren, bracket, hole, statement, element, attribute or container."""

    __slots__ = ("what", "name", "prev", "types", "pending", "ternary", "case", "ends", "start")

    def __init__(self, what: str, name: str = ""):
        self.what, self.name, self.prev = what, name, ""
        self.types = False  # in a type alias
        self.pending = ""  # class, interface, enum: whose body comes next
        self.ternary, self.case, self.ends, self.start = 0, False, False, True


class Lexer:
    def __init__(self, text: str, jsx: bool, typed: bool):
        self.s, self.n, self.i = text, len(text), 0
        self.jsx, self.typed = jsx, typed
        self.out: list[tuple[int, str, str]] = []
        self.stack = [Frame("program")]
        self.newline = False

    @property
    def top(self) -> Frame:
        return self.stack[-1]

    def run(self) -> list[tuple[int, str, str]]:
        self.code(len(self.stack))
        if len([f for f in self.stack if f.what != "statement"]) != 1:
            raise SyntaxProblem(f"{self.top.what} isn't closed")
        return self.out

    def skip(self) -> None:
        s = self.s
        while self.i < self.n:
            if m := _SPACE.match(s, self.i):
                self.newline |= "\n" in m[0]
                self.i = m.end()
            elif s.startswith("//", self.i) or s.startswith("#!", self.i) and self.i == 0:
                end = s.find("\n", self.i)
                self.i = self.n if end < 0 else end
            elif s.startswith("/*", self.i):
                end = s.find("*/", self.i + 2)
                if end < 0:
                    raise SyntaxProblem("a comment isn't closed")
                self.newline |= "\n" in s[self.i : end]
                self.i = end + 2
            else:
                return

    def value_next(self) -> bool:
        """Whether an expression may begin here."""
        p = self.top.prev
        return p in ("", "head)") or p in _BEFORE_VALUE or not (p[-1].isalnum() or p[-1] in "_$)]\"'`" or p in ("}", "value", "++", "--"))

    def code(self, depth: int) -> None:
        """Tokens until the frame at this depth closes (or the end)."""
        while True:
            self.newline = False
            self.skip()
            if self.i >= self.n:
                return
            c = self.s[self.i]
            if self.newline:
                self.maybe_end(c)
            if c in "\"'":
                self.string(c)
            elif c == "`":
                self.template()
            elif c in "([":
                self.open(c)
            elif c == "{":
                self.brace()
            elif c in ")]}":
                self.close(c)
                if len(self.stack) < depth:
                    return
            elif m := _NUMBER.match(self.s, self.i) if c.isdigit() or c == "." and self.s[self.i + 1 : self.i + 2].isdigit() else None:
                self.i = m.end()
                self.top.prev = "value"
            elif m := _WORD.match(self.s, self.i):
                self.word(m[0])
            elif c == "<" and self.jsx and self.value_next() and self.tag_next():
                self.element()
                self.top.prev = "value"
            elif c == "/" and self.value_next() and (m := _REGEX.match(self.s, self.i)):
                self.i = m.end()
                self.top.prev = "value"
            else:
                self.operator()

    def maybe_end(self, c: str) -> None:
        """A line end may end an import, an export or a type alias."""
        while self.top.what == "statement":
            p = self.top.prev
            done = p in (")", "]", "}", "value") or p != "" and (p[-1].isalnum() or p[-1] in "_$\"'`") and p not in _BEFORE_VALUE and p not in ("import", "export", "from", "type", "const", "let", "var", "function", "class", "async", "abstract", "declare", "interface", "enum", "=")
            m = _WORD.match(self.s, self.i) or _OPERATOR.match(self.s, self.i)
            if not done or m[0] in _CONTINUES or c in "?.+-*/%&|^=<>([`,:":
                return
            if self.top.pending:
                return
            self.stack.pop()
            self.top.prev, self.top.types = ";", False
        if self.top.types:
            m = _WORD.match(self.s, self.i)
            if m and m[0] not in _CONTINUES and self.top.prev not in ("=", "|", "&"):
                self.top.types, self.top.prev = False, ";"

    def word(self, w: str) -> None:
        t = self.top
        begins = t.what in ("program", "block") and t.prev in ("", ";", "}", "block}", "{")
        self.i += len(w)
        if begins and w in ("import", "export"):
            ahead = self.i
            while ahead < self.n and self.s[ahead].isspace():
                ahead += 1
            if w == "export" or self.s[ahead : ahead + 1] not in ("(", "."):
                self.stack.append(Frame("statement", w))
                self.top.prev = w
                return
        if t.prev not in (".", "?."):
            if w in ("class", "interface", "enum"):
                t.pending = w
            elif w == "type" and self.typed and t.prev in ("", ";", "}", "block}", "{", "export", "declare"):
                if re.compile(r"\s+[\w$]+\s*(<[^=]*>)?\s*=").match(self.s, self.i):
                    t.types = True
            elif w in ("case", "default"):
                t.case = True
        t.prev = "." + w if t.prev in (".", "?.") else w

    def operator(self) -> None:
        m = _OPERATOR.match(self.s, self.i)
        op, t = m[0], self.top
        self.i = m.end()
        if t.prev in ("const", "var") and t.what != "type" or op == ";" and t.prev == ",":
            raise SyntaxProblem(f"{op} stands where a name or a value should")
        if op == ";":
            self.whole()
            while self.top.what == "statement":
                self.stack.pop()
            t = self.top
            t.types, t.case, t.ternary, t.pending = False, False, 0, ""
        elif op == "?" and self.s[self.i : self.i + 1] not in (":", ",", ")"):
            t.ternary += 1
        elif op == ":" and t.ternary:
            t.ternary -= 1
            op = "?:"
        elif op == ":" and t.case:
            t.case, op = False, ";"
        elif op == "," and t.what in ("object", "enum", "type"):
            t.types = False
        t.prev = op

    def whole(self) -> None:
        """What ends here must not end with an operator."""
        if self.top.prev in _DANGLING or self.top.what == "object" and self.top.prev == ":":
            raise SyntaxProblem(f"nothing follows {self.top.prev}")

    def open(self, c: str) -> None:
        p = self.top.prev
        self.i += 1
        self.stack.append(Frame("paren" if c == "(" else "bracket", p if c == "(" and (p == "require" or p in _HEADS) else ""))

    def brace(self) -> None:
        t = self.top
        p = t.prev
        self.i += 1
        if t.pending:
            what = {"class": "class", "interface": "type", "enum": "enum"}[t.pending]
            t.pending = ""
        elif p in ("import", "export") or t.what == "statement" and t.name == "import" and p in (",", "type"):
            what = "clause"
        elif t.types or t.what == "type" or p in ("as", "satisfies") and self.typed:
            what = "type"
        elif p == ":" and t.what == "object":
            what = "object"
        elif p == ":" and self.typed:
            what = "type"
        elif p in ("=>", ")", "head)") or p in ("", ";", "{", "}", "block}", "else", "try", "finally", "do", "catch", "static") and t.what in ("program", "block", "class", "switch"):
            what = "block"
        elif not self.value_next() and p not in _BEFORE_VALUE:
            what = "block"
        else:
            what = "object"
        self.stack.append(Frame(what, "arrow" if p == "=>" else ""))

    def close(self, c: str) -> None:
        self.whole()
        while self.top.what == "statement":
            self.stack.pop()
        t = self.top
        fits = {")": ("paren",), "]": ("bracket",), "}": ("block", "object", "type", "enum", "class", "clause", "hole", "container")}[c]
        if t.what not in fits:
            raise SyntaxProblem(f"{c} closes nothing")
        self.i += 1
        self.stack.pop()
        if t.what in ("hole", "container"):
            return
        self.top.prev = "head)" if t.name in _HEADS else c
        # a body ends the exported declaration it belongs to
        if self.top.what == "statement" and t.what in ("block", "class", "enum") and self.ahead() not in (".", ",", ")", "(", ";", "from"):
            self.stack.pop()
            self.top.prev = "}"
        elif t.what == "block" and t.name != "arrow" and self.top.what in ("program", "block"):
            self.top.prev = "block}"  # a statement's end: what follows begins anew

    def ahead(self) -> str:
        m = re.compile(r"\s*(\w+|.)?").match(self.s, self.i)
        return m[1] or ""

    def string(self, q: str) -> None:
        start, j = self.i, self.i + 1
        while j < self.n and self.s[j] != q:
            if self.s[j] == "\n":
                raise SyntaxProblem("a string isn't closed")
            j += 2 if self.s[j] == "\\" else 1
        if j >= self.n:
            raise SyntaxProblem("a string isn't closed")
        self.i = j + 1
        t = self.top
        follows = self.ahead()
        key = t.what == "object" and t.prev in ("", ",") and follows == ":"
        direct = t.what == "paren" and t.name == "require" and t.prev in ("", ",") and follows in (")", ",")
        if not key and not direct and self.visible():
            self.out.append((start, "string", unescape(self.s[start + 1 : j], q)))
        t.prev = "value"

    def visible(self) -> bool:
        """Whether what is around a string lets it be seen."""
        types = imports = jsx = True
        attribute = None
        for f in reversed(self.stack):
            if f.what == "type" or f.what == "enum" and f.prev == "=":
                if types:
                    return False
            elif f.what == "statement":
                if imports:
                    return False
            elif f.what == "attribute":
                if jsx:
                    attribute, jsx = f, False
            elif f.what == "element":
                jsx = False
            elif f.what == "object":
                types = False
            elif f.what in ("block", "program"):
                break
        return attribute is None or attribute.name in VISIBLE

    def template(self) -> None:
        start, j, holes = self.i, self.i + 1, False
        while True:
            if j >= self.n:
                raise SyntaxProblem("a template isn't closed")
            if self.s[j] == "\\":
                j += 2
            elif self.s[j] == "`":
                break
            elif self.s.startswith("${", j):
                holes = True
                self.i = j + 2
                self.stack.append(Frame("hole"))
                depth = len(self.stack)
                self.code(depth)
                if len(self.stack) >= depth:
                    raise SyntaxProblem("a template isn't closed")
                j = self.i
            else:
                j += 1
        self.i = j + 1
        if not holes:
            self.out.append((start, "template", unescape(self.s[start + 1 : j], "`")))
        self.top.prev = "value"

    def tag_next(self) -> bool:
        if self.s.startswith("<>", self.i):
            return True
        m = re.compile(r"<\s*([\w$][\w$.:-]*)(\s*,|\s+extends\b)?").match(self.s, self.i)
        return bool(m) and not (m[2] and self.typed)

    def expect(self, c: str) -> None:
        self.skip()
        if not self.s.startswith(c, self.i):
            raise SyntaxProblem(f"{c} is missing in JSX")
        self.i += len(c)

    def container(self) -> None:
        """A braced expression."""
        self.i += 1
        self.stack.append(Frame("container"))
        depth = len(self.stack)
        self.code(depth)
        if len(self.stack) >= depth:
            raise SyntaxProblem("braces in JSX aren't closed")

    def element(self) -> None:
        self.i += 1
        self.stack.append(Frame("element"))
        self.skip()
        m = _TAG.match(self.s, self.i)
        name = m[0] if m else ""
        self.i += len(name)
        if name and self.s.startswith("<", self.i):
            self.type_arguments()
        while True:
            self.skip()
            if self.s.startswith("/>", self.i):
                self.i += 2
                self.stack.pop()
                return
            if self.s.startswith(">", self.i):
                self.i += 1
                break
            if self.s.startswith("{", self.i):
                self.container()
                continue
            m = _TAG.match(self.s, self.i)
            if not m:
                raise SyntaxProblem("a tag isn't closed")
            self.i = m.end()
            self.attribute("" if ":" in m[0] else m[0])
        while True:
            start = self.i
            while self.i < self.n and self.s[self.i] not in "<{":
                self.i += 1
            if self.i >= self.n:
                raise SyntaxProblem(f"<{name}> isn't closed")
            if text := self.s[start : self.i]:
                self.out.append((start, "jsx_text", text.strip()))
            if self.s[self.i] == "{":
                self.container()
            elif self.s.startswith("</", self.i):
                self.i += 2
                self.skip()
                m = _TAG.match(self.s, self.i)
                if (m[0] if m else "") != name:
                    raise SyntaxProblem(f"<{name}> isn't closed")
                self.i += len(name)
                self.expect(">")
                self.stack.pop()
                return
            else:
                self.element()

    def type_arguments(self) -> None:
        depth = 0
        for m in _ANGLE.finditer(self.s, self.i):
            depth += {"<": 1, ">": -1}.get(m[0], 0)
            if not depth:
                self.i = m.end()
                return
        raise SyntaxProblem("type arguments aren't closed")

    def attribute(self, name: str) -> None:
        self.skip()
        if not self.s.startswith("=", self.i):
            return
        self.i += 1
        self.skip()
        self.stack.append(Frame("attribute", name))
        c = self.s[self.i : self.i + 1]
        if c and c in "\"'":
            end = self.s.find(c, self.i + 1)
            if end < 0:
                raise SyntaxProblem("a string isn't closed")
            if self.visible():
                self.out.append((self.i, "string", unescape(self.s[self.i + 1 : end], c)))
            self.i = end + 1
        elif c == "{":
            self.container()
        elif c == "<":
            self.element()
        else:
            raise SyntaxProblem("an attribute has no value")
        self.stack.pop()


def literals(path: str, content: bytes, marker: str) -> list[Found]:
    """The literals of a file, by place, without those on a line with the marker or after one."""
    text = content.decode("utf-8", "surrogateescape")
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    found = Lexer(text, ext != "ts", ext in ("ts", "tsx")).run()
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    rows = text.split("\n")
    marked = {i for i, r in enumerate(rows) if marker and marker in r}
    out, row = [], 0
    for at, kind, raw in sorted(found):
        while row + 1 < len(starts) and starts[row + 1] <= at:
            row += 1
        if row in marked or row - 1 in marked:
            continue
        column = len(text[starts[row] : at].encode("utf-8", "surrogateescape")) + 1
        out.append(Found(row + 1, column, kind, raw.encode("utf-8", "surrogateescape").decode("utf-8", "replace")))
    return out
