"""Problem 4: source files that do not parse.

A file is cut into tokens and its balanced braces into regions; a region becomes one token that names every
nonterminal its inside can be (block, object, class body, ...), and a region's inside is taken statement by
statement. Each of these short token sequences is decided by the GLL recogniser (gll.py) and remembered: a
sequence of token classes is parsed once a worker, however many files repeat it. A file is flagged if every
dialect of its extension rejects it. Unresolved names and types play no part.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import dialects
from loomgraph.llm.codetext import extension
from loomgraph.llm.gll import Grammar

DEPTH = 1_000_000  # nested calls
MEMORY = 400_000  # token sequences a worker remembers a grammar

_COMMENT = r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_DQ = r'"(?:[^"\\\n]|\\(?:.|\n))*"'
_SQ = r"'(?:[^'\\\n]|\\(?:.|\n))*'"
_NUM = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"


def _ops(text: str) -> str:
    return "|".join(re.escape(o) for o in sorted(text.split(), key=len, reverse=True))


#: Reserved words by language (fixed values).
JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)
JS_SOFT = frozenset("async get set of from as static let await yield type interface declare namespace module abstract implements public private protected readonly override keyof unique infer is asserts satisfies accessor global out assert undefined".split())
JAVA_WORDS = frozenset(
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try volatile while null true false".split()
)
JAVA_SOFT = frozenset("record sealed permits non yield when module var".split())
JAVA_PRIM = frozenset("boolean byte char short int long float double void".split())
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
CPP_WORDS = frozenset(
    "alignas asm auto break case catch class co_await co_return co_yield const const_cast constexpr consteval constinit continue decltype default delete do dynamic_cast else enum explicit extern false for friend goto if inline mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast requires return sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union using virtual volatile while".split()
)
CPP_PRIM = frozenset("bool char char8_t char16_t char32_t wchar_t short int long signed unsigned float double void".split())
CPP_SOFT = frozenset("override final".split())
PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
PY_SOFT = frozenset("match case type".split())


class Braces:
    """A brace language: its lexer, the kinds its regions can be, and the grammar that decides them."""

    def __init__(self, text: str, words, soft, prim, ops: str, extra: str, kinds: dict[str, tuple[str, ...]], chunked, top: str, lines: str = "", before: str = "", readings=None):
        read = {w: ("kw",) for w in words} | {w: ("id",) for w in soft} | (readings or {})
        self.grammar = Grammar(text, read)
        self.words, self.soft, self.prim = words, soft, prim
        self.kinds, self.chunked, self.top, self.lines = kinds, frozenset(chunked), top, lines
        self.lex = re.compile(
            # blanks belong to the token they stand before: half as many matches
            rf"{before}[^\S\n]*(?:(?P<id>(?:[^\W\d]|\$)[\w$]*+)(?![\"'])|(?P<nl>\n)|(?P<ws>{_COMMENT}|\\\n|\Z)|{extra}|(?P<num>{_NUM}[nNfFdDlLuUi]*)(?![\w$])|(?P<op>{_ops(ops)})|(?P<id2>(?:[^\W\d]|\$)[\w$]*))",
            re.S,
        )
        self.conditional: Callable[[str], list[str]] | None = None
        self.known: dict[tuple, bool] = {}
        self.region: dict[tuple, str] = {}
        self.every = "{" + "|".join(kinds) + "}"

    # what may stand before and after a line end that counts
    _ENDS = frozenset("id num str tpl rx ) ] ++ -- return break continue this super null true false debugger yield".split())
    _GOES_ON = frozenset(". ?. , ; ) ] } ( [ { + - * / % = == === != !== < > <= >= && bar || ?? & ^ << => ? : += -= *= /= instanceof in of else catch finally as from extends implements tpl is **".split())

    def tokens(self, code: str) -> list[str] | None:
        out: list[str] = []
        words, soft, prim, lines = self.words, self.soft, self.prim, self.lines
        lex, at, size, line = self.lex, 0, len(code), False
        step = lex.scanner(code).match
        last = ""
        plain = self.lines != "js" or "`" not in code
        while at < size:
            m = step()
            if m is None:
                return None
            kind = m.lastgroup
            at = m.end()
            if kind == "ws":
                continue
            if kind == "nl":
                line = True
                continue
            if kind == "id" or kind == "id2":
                t = m[kind]
                if t in prim:
                    t = "prim"
                elif t not in words and t not in soft:
                    t = "id"
            elif kind == "op":
                t = m["op"]
                if "|" in t and t != "||" and t != "||=":
                    t = t.replace("|", "bar")
                elif t in ("/", "/=") and lines == "js" and not (last in self._ENDS or last == "}" or last in soft):
                    r = _REGEX.match(code, m.start("op"))
                    if r is None:
                        return None
                    at, t = r.end(), "rx"
                    step = lex.scanner(code, at).match
            else:
                t = kind
                if not plain and kind == "tpl":
                    got = self.template(code, m.start("tpl"))
                    if got is None:
                        return None
                    at = got
                    step = lex.scanner(code, at).match
            if line and out:
                line = False
                if lines == "js":
                    if (last in self._ENDS or last == "}" or last in soft) and (t not in self._GOES_ON or (t == "else" and last != "}")):
                        out.append("NL")
                elif lines == "go" and last in _GO_ENDS:
                    out.append(";")
            line = False
            out.append(t)
            last = t
        if lines == "go" and last in _GO_ENDS:
            out.append(";")
        return out

    _INSIDE = re.compile(rf"[^{{}}`\"'/]+|{_DQ}|{_SQ}|{_COMMENT}|/")

    def template(self, code: str, at: int) -> int | None:
        """The place after a template literal that begins at `at`; None if it or an expression in it is wrong."""
        at += 1
        while at < len(code):
            c = code[at]
            if c == "`":
                return at + 1
            if c == "\\":
                at += 2
            elif code.startswith("${", at):
                start = at = at + 2
                depth = 1
                while depth:
                    c = code[at : at + 1]
                    if c == "{" or c == "}":
                        depth += 1 if c == "{" else -1
                        at += 1
                    elif c == "`":
                        got = self.template(code, at)
                        if got is None:
                            return None
                        at = got
                    else:
                        m = self._INSIDE.match(code, at)
                        if m is None:
                            return None
                        at = m.end()
                if not self.judge(code[start : at - 1], "Expr"):
                    return None
            else:
                k = at + 1
                while k < len(code) and code[k] not in "`\\$":
                    k += 1
                at = k
        return None

    def ok(self, start: str, seq: tuple) -> bool:
        key = (start, seq)
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            got = self.known[key] = self.grammar.accepts(start, seq)
        return got

    @staticmethod
    def _in_header(cur: list[str]) -> bool:
        """Whether a Go if, for or switch has begun whose block is still to come."""
        for t in reversed(cur):
            if t[0] == "{":
                return False
            if t in ("if", "for", "switch"):
                return True
        return False

    def pieces(self, seq: list[str]) -> list[tuple]:
        """Statements: cut after ';' and line ends outside parentheses, and after a region that ends one."""
        out, cur, depth = [], [], 0
        n = len(seq)
        for k, t in enumerate(seq):
            cur.append(t)
            if t == "(" or t == "[":
                depth += 1
            elif t == ")" or t == "]":
                depth -= 1
            elif depth == 0:
                if t == ";" or t == "NL":
                    follow = seq[k + 1] if k + 1 < n else ""
                    if follow == "else" or (follow == "while" and "do" in cur):
                        continue  # the statement goes on
                    if self.lines == "go" and self._in_header(cur):
                        continue
                    out.append(tuple(cur))
                    cur = []
                elif t[0] == "{" and not self.lines and k + 1 < n and seq[k + 1] not in _AFTER and "=" not in cur and cur[0] not in _HELD:
                    out.append(tuple(cur))
                    cur = []
        if cur:
            out.append(tuple(cur))
        return out

    def whole(self, start: str, seq: list[str]) -> bool:
        if start in self.chunked:
            return all(self.ok(start, p) for p in self.pieces(seq))
        return self.ok(start, tuple(seq))

    def classify(self, seq: list[str]) -> str:
        """The token of a region: '{' + the kinds its inside can be + '}'."""
        if not seq:
            return self.every
        key = tuple(seq) if len(seq) <= 24 else None
        got = self.region.get(key) if key else None
        if got is None:
            flat = ";" in seq or "NL" in seq
            can = [k for k, starts in self.kinds.items() if any((s in self.chunked or not flat or s == "Enumb" or self.lines == "go") and self.whole(s, seq) for s in starts)]
            got = "{" + "|".join(can) + "}"
            if key:
                if len(self.region) >= MEMORY:
                    self.region.clear()
                self.region[key] = got
        return got

    def valid(self, code: str) -> bool:
        if self.judge(code, self.top):
            return True
        # what only one branch of the preprocessor's conditions makes whole is whole
        return self.conditional is not None and any(t != code and self.judge(t, self.top) for t in self.conditional(code))

    def judge(self, code: str, top: str) -> bool:
        toks = self.tokens(code)
        if toks is None:
            return False
        stack: list[tuple[list[str], int]] = []
        cur: list[str] = []
        opened: list[str] = []
        for t in toks:
            if t == "{":
                stack.append((cur, len(opened)))
                opened.append("}")
                cur = []
                continue
            if t == "(":
                opened.append(")")
            elif t == "[":
                opened.append("]")
            elif t == ")" or t == "]":
                if not opened or opened.pop() != t:
                    return False
            elif t == "}":
                if not opened or opened.pop() != "}":
                    return False
                token = self.classify(cur)
                if token == "{}":
                    return False
                cur, _ = stack.pop()
                cur.append(token)
                continue
            elif t == "NL" and opened and opened[-1] != "}":
                continue
            cur.append(t)
        if opened or (self.lines == "go" and (cur[:1] != ["package"] or "package" in cur[1:])):
            return False
        if top == "Expr":
            cur = [t for t in cur if t != "NL"]
        return self.whole(top, cur)


_GO_ENDS = frozenset("id num str chr ) ] } break continue fallthrough return ++ --".split())
_AFTER = frozenset("else catch finally while ; , ) ] . = ( [ : ? -> :: + - * / && || == instanceof id <".split()) - {"id"}
_HELD = frozenset("class struct union enum typedef using do".split())
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")


def _js(ts: bool) -> Braces:
    ops = "=> ... ?. ?? ??= && || &&= ||= === !== == != <= >= << <<= += -= *= /= %= **= ** &= |= ^= ++ -- + - * / % = < > ! ~ & | ^ ? : ; , . ( ) [ ] { } @"
    extra = rf"(?P<str>{_DQ}|{_SQ})|(?P<tpl>`)|(?P<priv>\#[^\W\d][\w$]*)"
    kinds = {"BLOCK": ("Stmts",), "OBJ": ("Obj",), "CBODY": ("Members",), "PAT": ("Pat",), "NAMES": ("Names",)}
    if ts:
        kinds |= {"TYPE": ("Types",), "ENUM": ("Enum",)}
    return Braces(dialects.TS if ts else dialects.JS, JS_WORDS, JS_SOFT, frozenset(), ops, extra, kinds, ("Stmts", "Members", "Types"), "Stmts", "js", readings={"void": ("kw",)})


def _java() -> Braces:
    ops = "... -> :: && || == != <= += -= *= /= %= &= |= ^= <<= << >= ++ -- + - * / % = < > ! ~ & | ^ ? : ; , . ( ) [ ] { } @"
    extra = rf'(?P<str>"""(?:[^\\]|\\.)*?"""|{_DQ})|(?P<chr>\'(?:[^\'\\\n]|\\u+[\da-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)\')'
    kinds = {"BLOCK": ("Stmts",), "CBODY": ("Members", "Enumb"), "AINIT": ("Ainit",)}
    return Braces(dialects.JAVA, JAVA_WORDS, JAVA_SOFT, JAVA_PRIM, ops, extra, kinds, ("Stmts", "Members", "Unit"), "Unit")


def _go() -> Braces:
    ops = "... := <- && || == != <= >= += -= *= /= %= &= |= ^= <<= >>= &^= &^ << ++ -- + - * / % = < > ! ~ & | ^ : ; , . ( ) [ ] { }"
    extra = rf"(?P<str>{_DQ}|`[^`]*`)|(?P<chr>'(?:[^'\\\n]|\\x[\da-fA-F]{{2}}|\\u[\da-fA-F]{{4}}|\\U[\da-fA-F]{{8}}|\\[0-7]{{3}}|\\.)')"
    kinds = {"BLOCK": ("Stmts",), "FIELDS": ("Fields",), "METHODS": ("Methods",), "LIT": ("Lit",)}
    return Braces(dialects.GO, GO_WORDS, frozenset(), frozenset(), ops, extra, kinds, ("Stmts", "Unit", "Fields", "Methods"), "Unit", "go")


def _cpp() -> Braces:
    ops = "... -> ->* .* :: <=> && || == != <= >= += -= *= /= %= &= |= ^= <<= << ++ -- + - * / % = < > ! ~ & | ^ ? : ; , . ( ) [ ] { }"
    before = r"(?:(?:(?<=\n)|(?<![\s\S]))[^\S\n]*(?P<pp>\#(?:[^\n\\]|\\.|\\\n)*))|"
    extra = rf'(?P<str>(?:u8|[uUL])?(?:R"(?P<d>[^()\s\\]{{0,16}})\((?:.*?)\)(?P=d)"|{_DQ}))|(?P<chr>(?:u8|[uUL])?\'(?:[^\'\\\n]|\\.[\da-fA-F]*)+\')'
    kinds = {"BLOCK": ("Stmts",), "CBODY": ("Members",), "ENUM": ("Enum",), "INIT": ("Initl",)}
    made = Braces(dialects.CPP, CPP_WORDS, CPP_SOFT, CPP_PRIM, ops, extra, kinds, ("Stmts", "Members", "Unit"), "Unit", before=before, readings={"pp": ()})
    made.conditional = branches
    return made


_DIRECTIVE = re.compile(r"\s*#\s*(if|ifdef|ifndef|elif|else|endif)\b\s*(\S*)")


def branches(code: str) -> list[str]:
    """A C++ text with the first, and with the last branch of its preprocessor conditions only; dead ones are out."""
    if "#" not in code or not re.search(r"(?m)^\s*#\s*if", code):
        return []
    out = []
    for last in (False, True):
        kept, stack = [], []  # of each open condition: is its branch kept, may a later one be
        for line in code.split("\n"):
            m = _DIRECTIVE.match(line)
            if not m:
                if all(on for on, _ in stack):
                    kept.append(line)
                continue
            word = m[1]
            if word.startswith("if"):
                dead = word == "if" and m[2] in ("0", "false")
                stack.append((not dead and not last, last or dead))
            elif not stack:
                return []
            elif word == "endif":
                stack.pop()
            else:
                on, later = stack[-1]
                stack[-1] = (later and (word == "else" or not last), later and not (word != "else" and not last))
        if stack:
            return []
        out.append("\n".join(kept))
    # conditions without an else: both readings of the last-branch text leave them out
    return out


class Python:
    """Logical lines decided one by one, their blocks by a stack of indents.

    Strings, names and numbers are masked for the whole text at once, so a line is a short string of token
    classes; what the grammar says of it is remembered.
    """

    _FOLLOWS = {"elif": {"if", "elif"}, "else": {"if", "elif", "for", "while", "except"}, "except": {"try", "except"}, "finally": {"try", "except", "else"}}
    _COMPOUND = frozenset("if elif else while for try except finally with def class".split())
    _STRING, _NAME, _NUMBER = "\x01", "\x02", "\x03"

    def __init__(self):
        self.grammar = Grammar(dialects.PYTHON, {w: ("id",) for w in PY_SOFT} | {"_": ("id",)})
        pre = r"(?<![\w])(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?"
        self.quoted = re.compile(
            rf"(\#[^\n]*)|(\\\n)|(?:{pre})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?!\"\")(?:[^\"\\\n]|\\(?:.|\n))*\"|'(?!'')(?:[^'\\\n]|\\(?:.|\n))*'|\"\"(?!\")|''(?!'))",
            re.S,
        )
        self.names = re.compile(rf"\b(?!(?:{'|'.join(sorted(PY_WORDS | PY_SOFT))})\b)[^\W\d]\w*+")
        self.numbers = re.compile(r"(?<![\w])(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?!0[\d_]*[1-9][\d_]*(?![\d_.eEjJ]))(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)(?![\w])")
        self.wrong = re.compile(r"[^\x00-\x7f]|[\d$?`\"'\\]|!(?!=)")
        self.token = re.compile(rf"[\x01\x02\x03]|[a-zA-Z]+|{_ops('... -> := **= //= <<= >>= == != <= >= += -= *= /= %= @= &= |= ^= ** // << >> + - * / % @ = < > ~ & | ^ : ; , . ( ) [ ] { }')}|\S")
        self.known: dict[str, tuple[bool, str, str, bool, bool]] = {}
        self.net: dict[str, int] = {}
        self.held: dict[str, bool] = {}

    def line(self, body: str) -> tuple[bool, str, str, bool, bool]:
        """(accepted, first token, leading word, opens a block, may follow a decorator) of a masked logical line."""
        got = self.known.get(body)
        if got is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            classes = {self._STRING: "str", self._NAME: "id", self._NUMBER: "num"}
            seq = tuple(classes.get(t) or (t.replace("|", "bar") if "|" in t else t) for t in self.token.findall(body))
            if not seq:
                return False, "", "", False, False
            word = seq[1] if seq[0] == "async" and len(seq) > 1 else seq[0]
            compound = word in self._COMPOUND or (word in PY_SOFT and seq[-1] == ":")
            decorated = seq[0] in ("def", "class", "@") or seq[:2] == ("async", "def")
            got = self.known[body] = (self.grammar.accepts("Line", seq), seq[0], word if compound else "", compound and seq[-1] == ":", decorated)
        return got

    def _mask(self, m: re.Match) -> str:
        if m.group(1) is not None:
            return ""
        if m.group(2) is not None:
            return " "
        t = m.group()
        return "$" if t[0] in "bBrR" and not t.isascii() and "b" in t[:2].lower() else self._STRING  # bytes are ASCII

    _F = re.compile(r"(?<!\w)(?:[fF][rR]?|[rR][fF])(?=[\"'])")

    def _masked(self, code: str) -> str:
        """The text with comments gone and strings masked; formatted strings are read with the expressions they hold."""
        if not self._F.search(code):
            return self.quoted.sub(self._mask, code)
        out, at = [], 0
        while m := self.quoted.search(code, at):
            out.append(code[at : m.start()])
            p = self._F.match(code, m.start())
            if p is None:
                out.append(self._mask(m))
                at = m.end()
                continue
            got = self._formatted(code, p.end(), "r" in p.group().lower())
            if got is None:
                return "$"
            out.append(self._STRING)
            at = got
        return "".join([*out, code[at:]])

    def _formatted(self, s: str, at: int, raw: bool) -> int | None:
        """The place after a formatted string whose quotes begin at `at`; None if it is wrong."""
        end = s[at] * 3 if s.startswith(s[at] * 3, at) else s[at]
        at += len(end)
        while at < len(s):
            if s.startswith(end, at):
                return at + len(end)
            c = s[at]
            if c == "\\" and not (raw and s[at + 1 : at + 2] in "{}"):
                at += 2 + (s.find("}", at) - at - 1 if s.startswith("\\N{", at) and not raw and "}" in s[at:] else 0)
            elif s.startswith(("{{", "}}"), at):
                at += 2
            elif c == "}" or (c == "\n" and len(end) == 1):
                return None
            elif c == "{":
                got = self._hole(s, at + 1, end)
                if got is None:
                    return None
                at = got
            else:
                at += 1
        return None

    def _hole(self, s: str, at: int, end: str) -> int | None:
        """The place after a replacement field whose expression begins at `at`."""
        start, depth = at, 0
        while at < len(s):
            c = s[at]
            if c in "\"'":
                p = self._F.match(s, at - 1) or self._F.match(s, at - 2) if at > 1 else None
                if p is not None and p.end() == at:
                    got = self._formatted(s, at, "r" in p.group().lower())
                else:
                    m = self.quoted.match(s, at)
                    got = m.end() if m else None
                if got is None:
                    return None
                at = got
                continue
            if c == "\n" and len(end) == 1 and not depth:
                return None
            if c in "([{":
                depth += 1
            elif depth and c in ")]}":
                depth -= 1
            elif not depth and (c == "}" or c == ":" or (c == "!" and s[at + 1 : at + 2] != "=")):
                break
            at += 1
        body = s[start:at].strip()
        if body.endswith("=") and body[-2:-1] not in ("=", "!", "<", ">"):
            body = body[:-1]
        if not self._expression(body):
            return None
        if s[at : at + 1] == "!":
            m = re.compile(r"!\s*[rsa]\s*(?=[:}])").match(s, at)
            if m is None:
                return None
            at = m.end()
        if s[at : at + 1] == ":":
            at += 1
            while at < len(s) and s[at] != "}":
                if s.startswith(end, at):
                    return None
                if s[at] == "{":
                    got = self._hole(s, at + 1, end)
                    if got is None:
                        return None
                    at = got
                else:
                    at += 1
        return at + 1 if s[at : at + 1] == "}" else None

    def _expression(self, body: str) -> bool:
        got = self.held.get(body)
        if got is None:
            if len(self.held) >= MEMORY:
                self.held.clear()
            items = list(self.lines(f"({body})")) if body.strip() else [None]
            got = self.held[body] = len(items) == 1 and items[0] is not None and self.line(items[0][1])[0]
        return got

    def lines(self, code: str) -> Iterator[tuple[int, str] | None]:
        """(indent, masked body) of the logical lines; None where brackets or characters are wrong."""
        text = self.numbers.sub(self._NUMBER, self.names.sub(self._NAME, self._masked(code)))
        if self.wrong.search(text):
            yield None
            return
        net, cur, depth, width = self.net, "", 0, 0
        for raw in text.split("\n"):
            body = raw.strip(" \t\f")
            if not body:
                continue
            n = net.get(body)
            if n is None:
                if len(net) >= MEMORY:
                    net.clear()
                n = net[body] = sum(map(body.count, "([{")) - sum(map(body.count, ")]}"))
            if not depth:
                width = len(raw) - len(raw.lstrip(" "))
                if raw[width] in "\t\f":
                    width = 0
                    for ch in raw[: len(raw) - len(raw.lstrip(" \t\f"))]:
                        width = (width // 8 + 1) * 8 if ch == "\t" else 0 if ch == "\f" else width + 1
                cur = body
            else:
                cur += " " + body
            depth += n
            if depth < 0:
                yield None
                return
            if not depth:
                yield width, cur
        if depth:
            yield None

    def valid(self, code: str) -> bool:
        indents, last, want, deco = [0], [""], False, False
        for item in self.lines(code.lstrip("\ufeff")):
            if item is None:
                return False
            width, body = item
            if want:
                if width <= indents[-1]:
                    return False
                indents.append(width)
                last.append("")
            elif width > indents[-1]:
                return False
            else:
                while indents[-1] > width:
                    if last[-1] == "try":
                        return False
                    indents.pop()
                    last.pop()
                if indents[-1] != width:
                    return False
            ok, first, word, want, decorated = self.line(body)
            if not ok or (deco and not decorated):
                return False
            if first in self._FOLLOWS:
                if last[-1] not in self._FOLLOWS[first]:
                    return False
            elif last[-1] == "try":
                return False
            deco = first == "@"
            last[-1] = word
        return not want and not deco and "try" not in last


class Json:
    def __init__(self):
        self.grammar = Grammar(dialects.JSON)
        self.lex = re.compile(r'[ \t\r\n]*(?:(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<op>[{}\[\],:]|true\b|false\b|null\b))')
        self.known: dict[tuple, bool] = {}

    def ok(self, start: str, seq: tuple) -> bool:
        # values are alike to their surroundings: one name keeps the sequences few
        got = self.known.get((start, seq))
        if got is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            got = self.known[start, seq] = self.grammar.accepts(start, seq)
        return got

    def valid(self, code: str) -> bool:
        code = code.rstrip()
        at, size, stack, cur = 0, len(code), [], []
        while at < size:
            m = self.lex.match(code, at)
            if m is None:
                return False
            at = m.end()
            t = m.group("op") if m.lastgroup == "op" else m.lastgroup
            if t in ("{", "["):
                stack.append((t, cur))
                cur = []
            elif t in ("}", "]"):
                if not stack or stack[-1][0] != ("{" if t == "}" else "["):
                    return False
                if not self.ok("Obj" if t == "}" else "Arr", tuple(cur)):
                    return False
                cur = stack.pop()[1]
                cur.append("OBJ" if t == "}" else "ARR")
            else:
                cur.append(t)
        return not stack and self.ok("Doc", tuple(cur))


class Shell:
    """POSIX shell: words scanned with their quotes and expansions, simple commands reduced to one token."""

    RESERVED = frozenset("if then elif else fi while until do done for case esac { } ! in".split())

    def __init__(self):
        self.grammar = Grammar(dialects.SHELL)
        self.known: dict[tuple, bool] = {}
        self.plain = re.compile(r"[^\s;&|<>()\"'`$\\#{}!]+|[#{}!]")

    class Bad(Exception):
        pass

    def _quoted(self, s: str, i: int, end: str) -> int:
        """Position after a double quote or backtick section that begins at i."""
        i += 1
        while i < len(s):
            c = s[i]
            if c == "\\":
                i += 2
            elif c == end:
                return i + 1
            elif c == "$":
                i = self._dollar(s, i)
            elif c == "`" and end != "`":
                i = self._quoted(s, i, "`")
            else:
                i += 1
        raise Shell.Bad

    def _dollar(self, s: str, i: int) -> int:
        n = s[i + 1 : i + 2]
        if s.startswith("$((", i):
            depth, j = 2, i + 3
            while j < len(s) and depth:
                depth += (s[j] == "(") - (s[j] == ")")
                j += 1
            if depth:
                raise Shell.Bad
            return j
        if n == "(":
            toks, j = self._scan(s, i + 2, ")")
            if not self._list(toks):
                raise Shell.Bad
            return j
        if n == "{":
            j = i + 2
            while j < len(s):
                c = s[j]
                if c == "}":
                    return j + 1
                if c == "\\":
                    j += 2
                elif c == '"':
                    j = self._quoted(s, j, '"')
                elif c == "'":
                    k = s.find("'", j + 1)
                    if k < 0:
                        raise Shell.Bad
                    j = k + 1
                elif c == "$":
                    j = self._dollar(s, j)
                elif c == "\n":
                    raise Shell.Bad
                else:
                    j += 1
            raise Shell.Bad
        return i + 1

    def _word(self, s: str, i: int) -> int:
        start = i
        while i < len(s):
            c = s[i]
            if c in " \t\n;&|<>()":
                break
            if c == "\\":
                i += 2
            elif c == "'":
                k = s.find("'", i + 1)
                if k < 0:
                    raise Shell.Bad
                i = k + 1
            elif c == '"' or c == "`":
                i = self._quoted(s, i, c)
            elif c == "$":
                i = self._dollar(s, i)
            elif c == "#" and i == start:
                break
            else:
                i += 1
        return i

    def _scan(self, s: str, i: int, until: str = "") -> tuple[list[str], int]:
        out: list[str] = []
        heredocs: list[tuple[str, bool]] = []
        place, depth = "cmd", 0  # cmd: a command may begin; arg: inside one; for, case, pat: their words
        parens = 0
        cases = 0
        while i < len(s):
            c = s[i]
            if c in " \t":
                i += 1
            elif s.startswith("\\\n", i):
                i += 2
            elif c == "#":
                k = s.find("\n", i)
                i = len(s) if k < 0 else k
            elif c == "\n":
                i += 1
                for tag, strip in heredocs:
                    while True:
                        k = s.find("\n", i)
                        line = s[i : k if k >= 0 else len(s)]
                        i = k + 1 if k >= 0 else len(s)
                        if (line.lstrip("\t") if strip else line) == tag:
                            break
                        if k < 0 or i >= len(s):
                            raise Shell.Bad
                heredocs = []
                out.append("NL")
                if place != "pat":
                    place = "cmd" if place != "casein" else "casein"
            elif c in "<>" or (c.isdigit() and re.match(r"\d+[<>]", s[i:])):
                m = re.match(r"\d*(?:<<-?|>>|>\||<&|>&|<>|<|>)", s[i:])
                op = m.group().lstrip("0123456789")
                i += m.end()
                while i < len(s) and s[i] in " \t":
                    i += 1
                j = self._word(s, i)
                if j == i:
                    raise Shell.Bad
                if op in ("<<", "<<-"):
                    heredocs.append((re.sub(r"[\"'\\]", "", s[i:j]), op == "<<-"))
                i = j
                if place == "cmd" and not (out and out[-1] in ("fi", "done", "esac", "}", ")", "r")):
                    out.append("c")
                    place = "arg"
                elif place == "cmd":
                    out.append("r")
            elif s.startswith(";;", i):
                out.append(";;")
                i += 2
                place = "pat"
            elif c in ";&|":
                two = s[i : i + 2]
                if two in ("&&", "||"):
                    out.append(two)
                    i += 2
                else:
                    out.append("bar" if c == "|" else c)
                    i += 1
                if not (place == "pat" and c == "|"):
                    place = "cmd"
            elif c == "(":
                if place == "pat":
                    out.append("(")
                    i += 1
                elif place == "arg" and out and out[-1] == "c" and (m := re.match(r"\(\s*\)", s[i:])):
                    out[-1:] = ["w", "(", ")"]
                    i += m.end()
                    place = "cmd"
                elif place == "cmd":
                    out.append("(")
                    parens += 1
                    i += 1
                else:
                    raise Shell.Bad
            elif c == ")":
                if place == "pat":
                    out.append(")")
                    i += 1
                    place = "cmd"
                elif parens:
                    parens -= 1
                    out.append(")")
                    i += 1
                    place = "cmd"
                elif until == ")":
                    if heredocs:
                        raise Shell.Bad
                    return out, i + 1
                else:
                    raise Shell.Bad
            else:
                j = self._word(s, i)
                if j == i:
                    raise Shell.Bad
                w = s[i:j]
                i = j
                if place in ("cmd", "pat") and w == "esac" and cases:
                    cases -= 1
                    out.append(w)
                    place = "cmd"
                elif place == "pat":
                    out.append("w")
                elif place == "cmd" and w in self.RESERVED and w != "in":
                    out.append(w)
                    place = {"for": "for", "case": "case"}.get(w, "cmd")
                    cases += w == "case"
                elif place == "for":
                    out.append("w")
                    place = "forin"
                elif place == "case":
                    out.append("w")
                    place = "casein"
                elif place in ("forin", "casein") and w == "in":
                    out.append("in")
                    place = "words" if place == "forin" else "pat"
                elif place == "cmd" and w == "in" and len(out) > 1 and out[-1] == "NL":
                    out.append("in")
                    place = "words"
                elif place == "words":
                    out.append("w")
                elif place == "cmd":
                    out.append("c")
                    place = "arg"
                elif place == "arg":
                    pass
                else:
                    raise Shell.Bad
        if heredocs or until:
            raise Shell.Bad
        return out, i

    def _list(self, toks: list[str]) -> bool:
        # a run of simple commands is to its surroundings as one
        out: list[str] = []
        for t in toks:
            if t == "c" and len(out) > 1 and out[-1] in ("NL", ";") and out[-2] == "c":
                out.pop()
                continue
            if t in ("NL", ";") and t == "NL" and out and out[-1] == "NL":
                continue
            out.append(t)
        # top-level items by nesting depth
        depth, cur = 0, []
        for t in [*out, "NL"]:
            cur.append(t)
            depth += (t in ("if", "do", "case", "{", "(")) - (t in ("fi", "done", "esac", "}"))
            depth -= t == ")" and "(" in cur and depth > 0 and "case" not in cur
            if t == "NL" and depth <= 0 and len(cur) > 1 and cur[-2] not in ("&&", "||", "bar", ")", "w"):
                if not self.ok(tuple(cur)):
                    return False
                cur, depth = [], 0
        return self.ok(tuple(cur)) if cur else True

    def ok(self, seq: tuple) -> bool:
        got = self.known.get(seq)
        if got is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            got = self.known[seq] = self.grammar.accepts("List", seq)
        return got

    def valid(self, code: str) -> bool:
        try:
            toks, _ = self._scan(code, 0)
        except Shell.Bad:
            return False
        return self._list(toks)


class Yaml:
    """YAML by lines: each line's shape by the grammar, the nesting by a stack of indents."""

    def __init__(self):
        self.grammar = Grammar(dialects.YAML)
        self.known: dict[tuple, bool] = {}
        self.lex = re.compile(
            r"(?P<ws>[ \t]+)|(?P<com>(?:(?<=\s)|^)#.*)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')|(?P<dash>-(?=\s|$))|(?P<colon>:(?=\s|$))|(?P<q>\?(?=\s|$))|(?P<alias>\*[^\s,\[\]{}]+)|(?P<anchor>&[^\s,\[\]{}]+)|(?P<tag>![^\s,\[\]{}]*)"
            r"|(?P<block>[|>][-+\d]{0,2}(?=\s*(?:\s#.*)?$))|(?P<open>[\[{])|(?P<plain>[^\s\-?:,\[\]{}#&*!|>'\"%@`](?:[^\n:#]|:(?!\s|$)|(?<!\s)#)*|[-?:](?=\S)(?:[^\n:#]|:(?!\s|$)|(?<!\s)#)*)"
        )
        self.flow = re.compile(r"\s*(?:(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')|(?P<op>[\[\]{},]|:(?=[\s,\]}\"'\[{]|$))|(?P<com>(?<=\s)#[^\n]*)|(?P<alias>\*[^\s,\[\]{}]+)|(?P<anchor>&[^\s,\[\]{}]+)|(?P<tag>![^\s,\[\]{}]*)|(?P<plain>(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s,\[\]{}]))(?:[^,\[\]{}:#\n]|:(?![\s,\[\]{}]|$)|(?<!\s)#)*))")

    def ok(self, seq: tuple) -> bool:
        got = self.known.get(seq)
        if got is None:
            got = self.known[seq] = self.grammar.accepts("Line", seq)
        return got

    def valid(self, code: str) -> bool:
        lines = code.lstrip("﻿").split("\n")
        stack: list[list] = []  # [indent, kind]; kind: map or seq
        k, hold = 0, -2  # hold: indent of the key or item whose plain scalar may go on, -2 if none may
        opened = False  # the last key or item has no value yet
        asked: set[int] = set()  # columns of the '?' that wait for their ':'
        while k < len(lines):
            line = lines[k]
            k += 1
            bare = line.strip()
            if not bare or bare.startswith("#"):
                continue
            if re.match(r"(---|\.\.\.)(\s|$)", line):
                stack, hold, opened = [], -2, False
                line = "   " + line[3:]
                if not line.strip() or line.strip().startswith("#"):
                    continue
            elif line.startswith("%") and not stack:
                continue
            indent = len(line) - len(line.lstrip(" "))
            if line[indent] == "\t":
                return False
            # tokens of the line; a flow collection or a quoted scalar may run over several lines
            toks: list[tuple[str, int]] = []
            at = indent
            text = line
            while at < len(text):
                m = self.lex.match(text, at)
                if m is None:
                    if text[at] in "\"'" and k < len(lines):
                        text += "\n" + lines[k]
                        k += 1
                        continue
                    return False
                kind = m.lastgroup
                if kind == "open":
                    got = None
                    while True:
                        got = self._flow(text, at)
                        if got is not None or k >= len(lines):
                            break
                        text += "\n" + lines[k]
                        k += 1
                    if not got:
                        return False
                    part, at = got
                    toks += [(p, indent) for p in part]
                    continue
                if kind not in ("ws", "com"):
                    toks.append(({"dash": "-", "colon": ":", "q": "?"}.get(kind, kind), at))
                at = m.end()
            shape = tuple(t for t, _ in toks)
            if not shape:
                continue
            entry = ":" in shape and shape[0] != "[" and shape[0] != "{" or shape[0] in ("-", "?")
            if not entry and hold > -2 and indent > hold and shape[0] in ("plain", "str", "-", "alias", "tag", "anchor") or (hold > -2 and indent > hold and not entry):
                if not opened and shape[0] != "plain":
                    return False
                opened = False
                continue  # the scalar goes on
            if not self.ok(shape):
                return False
            if shape[0] == ":":
                if indent not in asked:
                    return False
                asked.discard(indent)
            asked |= {c for t, c in toks if t == "?"}
            if not entry:
                if stack and not (opened and indent > stack[-1][0]):
                    return False
                if not stack and hold > -2:
                    return False
                hold, opened = (stack[-1][0] if stack else -1), False
                if shape[-1] == "block":
                    while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip(" ")) > hold):
                        k += 1
                continue
            # the columns at which this line opens collections: one a dash, one a key
            lead = [(toks[0][1], "map")] if shape[0] in ("?", ":") else []
            inner = toks[len(lead) :]
            cols = lead + [(c, "seq") for t, c in inner if t == "-"]
            rest = [(t, c) for t, c in inner if t != "-"]
            if any(t in (":", "?") for t, _ in inner):
                cols.append((rest[0][1], "map"))
            first = True
            for c, kind in cols:
                if first:
                    while stack and stack[-1][0] > c:
                        stack.pop()
                    if stack and stack[-1][0] == c:
                        if stack[-1][1] != kind:
                            if kind == "seq" and stack[-1][1] == "map" and opened:
                                stack.append([c, kind])  # a sequence may stand at its key's indent
                            elif kind == "map" and len(stack) > 1 and stack[-2] == [c, "map"]:
                                stack.pop()
                            else:
                                return False
                    else:
                        if stack and not opened:
                            return False
                        if not stack and hold > -2 and not opened:
                            return False
                        stack.append([c, kind])
                    first = False
                else:
                    stack.append([c, kind])
            tail = shape[-1]
            opened = tail in (":", "-", "?", "anchor", "tag")
            hold = stack[-1][0]
            if tail == "block":
                while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip(" ")) > hold):
                    k += 1
                hold = stack[-1][0]
            elif tail in ("str", "]", "}", "alias"):
                hold = -2 if tail != "str" else 10**9
                hold = 10**9
        return True

    def _flow(self, text: str, at: int):
        """(tokens, end) of a flow collection; None if it isn't closed yet; () if it is wrong."""
        out, depth = [], []
        while at < len(text):
            m = self.flow.match(text, at)
            if m is None:
                if not text[at:].strip():
                    return None
                return None if text[at:].lstrip()[:1] in "\"'" else ()
            at = m.end()
            kind = m.lastgroup
            if kind == "com":
                continue
            t = m.group("op") if kind == "op" else kind
            out.append(t)
            if t in ("[", "{"):
                depth.append("]" if t == "[" else "}")
            elif t in ("]", "}"):
                if not depth or depth.pop() != t:
                    return ()
                if not depth:
                    return out, at
        return None


_MAKERS: dict[str, tuple[Callable, ...]] = {
    "py": (Python,), "pyi": (Python,),
    "js": (lambda: _js(False),), "mjs": (lambda: _js(False),), "cjs": (lambda: _js(False),),
    # a TypeScript file may also be plain JavaScript: both grammars get their say
    "ts": (lambda: _js(True), lambda: _js(False)), "mts": (lambda: _js(True), lambda: _js(False)), "cts": (lambda: _js(True), lambda: _js(False)),
    "java": (_java,), "go": (_go,),
    "cpp": (_cpp,), "cc": (_cpp,), "cxx": (_cpp,), "hpp": (_cpp,), "h": (_cpp,),
    "sh": (Shell,), "json": (Json,), "yml": (Yaml,), "yaml": (Yaml,),
}
#: The language an extension claims, for reports (fixed values).
LANGUAGE = {"py": "Python", "pyi": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "java": "Java", "go": "Go", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "h": "C++", "sh": "Shell", "json": "JSON", "yml": "YAML", "yaml": "YAML"}
_LOADED: dict[str, tuple] = {}


def valid(path: str | None, code: str | None) -> bool | None:
    """Whether code parses in some dialect of its extension; None if it is null, blank or of no known language."""
    ext = extension(path)
    if ext not in _MAKERS or code is None or not code.strip():
        return None
    if ext not in _LOADED:
        _LOADED[ext] = tuple(make() for make in _MAKERS[ext])
    text = code.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("﻿"):
        text = text[1:]
    if text.startswith("#!"):
        text = "\n" + text.partition("\n")[2]
    # calls between Python functions take no room on the machine's stack: nesting is bounded by memory
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    return any(d.valid(text) for d in _LOADED[ext])


def checked(sources: DataFrame) -> DataFrame:
    """(repo_url, filepath, claimed, ok): ok is null where nothing can be said. Code never leaves its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = pd.array([valid(p, c) for p, c in zip(b["filepath"], b["code"], strict=True)], dtype="boolean")
            yield pd.DataFrame({"repo_url": b["repo_url"], "filepath": b["filepath"], "claimed": [LANGUAGE.get(extension(p)) for p in b["filepath"]], "ok": ok})

    return sources.select("repo_url", "filepath", "code").mapInPandas(run, "repo_url string, filepath string, claimed string, ok boolean")


def invalid(sources: DataFrame) -> DataFrame:
    """(repo_url, filepath) of the files that every dialect rejects; repeated keys yield one row each."""
    return checked(sources).where("NOT ok").select("repo_url", "filepath")


def rates(sources: DataFrame, file_index: DataFrame) -> DataFrame:
    """Per repository and claimed language: files judged, files rejected, their rate, and what file_index reports.

    Of repeated index rows a file counts as reported bad if its latest row (seen_at, then ord) says not
    analysed for a reason of syntax.
    """
    keys = F.struct("seen_at", "ord")
    latest = file_index.groupBy("repo_url", "filepath").agg(F.max_by(F.struct("analysed", "reason"), keys).alias("r"))
    said = latest.select("repo_url", "filepath", (~F.coalesce("r.analysed", F.lit(True)) & F.coalesce(F.col("r.reason").rlike("(?i)syntax|parse failed"), F.lit(False))).alias("said_bad"))
    both = checked(sources).where("ok IS NOT NULL").join(said, ["repo_url", "filepath"], "left")
    bad = F.sum((~F.col("ok")).cast("bigint"))
    return both.groupBy("repo_url", "claimed").agg(
        F.count(F.lit(1)).alias("n_files"),
        bad.alias("n_invalid"),
        F.round(bad / F.count(F.lit(1)), 6).alias("rate"),
        F.sum(F.coalesce("said_bad", F.lit(False)).cast("bigint")).alias("n_reported"),
        F.sum((F.coalesce("said_bad", F.lit(False)) & ~F.col("ok")).cast("bigint")).alias("n_reported_right"),
    )
