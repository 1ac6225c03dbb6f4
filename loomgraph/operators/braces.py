"""Records of brace languages (JavaScript, TypeScript, Go, Java, C, C++) without a parser: tokens, and scopes by braces.

A lexical reading, of lower fidelity than a parse: what stands before a brace tells whether it opens a class, a
function or a block; calls, flows and assignments belong to the innermost named function around them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

STYLE = {"js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "go": "go", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp"}
_TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*#[^\n]*(?:\\\n[^\n]*)*)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)"
    r"|(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|===?|!==?|<=|>=|&&|\|\||\?\.|::|->|:=|\+\+|--|[-+*/%&|^]=|\.\.\.|[^\s\w])|(?P<nl>\n)",
    re.S | re.M,
)
#: Words before a parenthesis that call nothing.
NOT_CALLS = {
    "js": frozenset("if for while switch catch return function await typeof delete throw else do case super new in of instanceof yield void".split()),
    "go": frozenset("if for switch return func else case go defer select range var const type import".split()),
    "java": frozenset("if for while switch catch return throw else do case super synchronized new instanceof assert this".split()),
    "c": frozenset("if for while switch return sizeof else do case goto defined __attribute__".split()),
    "cpp": frozenset("if for while switch catch return sizeof alignof decltype static_assert throw else do case new delete noexcept alignas typeid".split()),
}
#: What a brace follows that belongs to an expression.
_VALUE_BEFORE = frozenset("= ( , : [ return ? && || ?? ... in of".split())
_VALUES = frozenset("this null true false undefined nil nullptr super".split())
_HEADS = frozenset("if for while switch catch try else do finally synchronized namespace extern enum return".split())
_MODIFIERS = frozenset("public private protected readonly static final const override abstract async get set export default".split())


@dataclass
class _Class:
    bases: list[str] = field(default_factory=list)
    attributes: set[str] = field(default_factory=set)
    methods: list[str] = field(default_factory=list)


@dataclass
class _Scope:
    kind: str  # class, function, block, expression
    name: str = ""
    params: list[str] = field(default_factory=list)
    depth: int = 0  # brackets open around an expression
    receiver: tuple[str, str] | None = None  # name and type a Go method is for
    saved: list[int] | None = None  # the statement that goes on behind the brace


class Reader:
    def __init__(self, code: str, style: str):
        self.style = style
        self.kind: list[str] = []
        self.text: list[str] = []
        for m in _TOKEN.finditer(code):
            k = m.lastgroup
            if k == "skip" or (k == "op" and m.group() == "\\"):
                continue
            self.kind.append(k)
            self.text.append(m.group())
        self.pair = self._pairs()
        self.calls: dict[str, list[str]] = {}
        self.flows: list[tuple[str, str, str, int]] = []
        self.variables: dict[str, list[str]] = {}
        self.classes: dict[str, _Class] = {}
        self.marks: list[tuple[int, str, str, list[tuple[str, int]]]] = []  # calls: place of the name, function, callee, flows
        self._read()

    def _pairs(self) -> dict[int, int]:
        out, stack = {}, []
        for i, t in enumerate(self.text):
            if self.kind[i] != "op":
                continue
            if t in "([{":
                stack.append(i)
            elif t in ")]}" and stack:
                out[stack[-1]] = i
                out[i] = stack.pop()
        return out

    # ---- names and parameters ----------------------------------------------------------------------
    def _split(self, lo: int, hi: int) -> list[list[int]]:
        """Places of the tokens between two brackets, parted at commas outside further brackets and angles."""
        out, cur, i, angle = [], [], lo, 0
        while i < hi:
            t = self.text[i]
            if self.kind[i] == "op" and t in ("(", "[", "{") and i in self.pair:
                cur += range(i, self.pair[i] + 1)
                i = self.pair[i] + 1
                continue
            angle += (t == "<") - (t == ">")
            if t == "," and angle <= 0:
                out.append(cur)
                cur = []
            elif self.kind[i] != "nl":
                cur.append(i)
            i += 1
        return [p for p in [*out, cur] if p]

    def params(self, lo: int, hi: int) -> list[str]:
        out = []
        groups = self._split(lo, hi)
        typed = any(len(g) > 1 for g in groups)
        for g in groups:
            ids = [i for i in g if self.kind[i] == "id" and self.text[i] not in _MODIFIERS]
            if not ids:
                continue
            if self.style == "js":
                first = next((i for i in ids if self.text[i - 1] != "@"), None)
                name = self.text[first] if first is not None else None
            elif self.style == "go":
                name = self.text[g[0]] if self.kind[g[0]] == "id" and (len(g) > 1 and self.text[g[1]] != "." if len(g) > 1 else typed) else None
            else:
                cut = next((k for k, i in enumerate(g) if self.text[i] == "="), len(g))
                ids = [i for i in g[:cut] if self.kind[i] == "id"]
                name = self.text[ids[-1]] if len(ids) > 1 or (ids and ids[-1] != g[0]) else None
            if name:
                out.append(name)
        return out

    def _bases(self, head: list[int]) -> list[str]:
        words = [self.text[i] for i in head]
        out: list[str] = []
        if self.style == "js" and "extends" in words:
            k = words.index("extends") + 1
            name = ""
            while k < len(words) and (re.match(r"[\w$]+$", words[k]) or words[k] == ".") and words[k] != "implements":
                name += words[k]
                k += 1
            out = [name] if name else []
        elif self.style == "java":
            on, angle = False, 0
            for w in words:
                angle += (w == "<") - (w == ">")
                if w in ("extends", "implements"):
                    on = True
                elif w == "permits":
                    on = False
                elif on and not angle and re.match(r"[A-Za-z_]\w*$", w):
                    out.append(w)
        elif self.style == "cpp" and ":" in words:
            angle = 0
            for i in head[words.index(":") + 1 :]:
                w = self.text[i]
                angle += (w == "<") - (w == ">")
                if self.kind[i] == "id" and not angle and w not in ("public", "private", "protected", "virtual") and self.text[i + 1] != "::":
                    out.append(w)
        return out

    def _classify(self, head: list[int], inside: _Scope | None) -> _Scope:
        """What a brace after these tokens opens."""
        words = [self.text[i] for i in head]
        st = self.style
        class_words = {"js": ("class",), "java": ("class", "interface"), "c": ("struct",), "cpp": ("class", "struct"), "go": ()}[st]
        for w in class_words:
            if w in words and "(" not in words[: words.index(w)] and not (st in ("c", "cpp") and ("(" in words or "=" in words)):
                k = words.index(w) + 1
                name = words[k] if k < len(words) and re.match(r"[A-Za-z_$][\w$]*$", words[k]) and words[k] not in ("extends", "implements") else ""
                return _Scope("class", name)
        if st == "go":
            if words[-1:] == ["struct"] and len(words) > 1 and self.kind[head[-2]] == "id":
                return _Scope("class", words[-2])
            if words[:1] == ["func"]:
                k, receiver = 1, None
                if k < len(words) and words[k] == "(":
                    close = self.pair.get(head[k], head[k])
                    ids = [self.text[i] for i in range(head[k], close) if self.kind[i] == "id"]
                    receiver = (ids[0] if len(ids) > 1 else "", ids[-1]) if ids else None
                    k = next((j for j, i in enumerate(head) if i > close), len(head))
                if k + 1 < len(words) and self.kind[head[k]] == "id":
                    p = next((j for j in range(k + 1, len(words)) if words[j] == "("), None)
                    if p is not None:
                        return _Scope("function", words[k], self.params(head[p] + 1, self.pair.get(head[p], head[p])), receiver=receiver)
            return _Scope("block")
        if not words or (words[0] in _HEADS and st != "js") or (st == "js" and words[0] in _HEADS - {"return"} and "=>" not in words[-1:]):
            return _Scope("block")
        if st == "js":
            return self._js_function(head, words, inside)
        # Java, C, C++: name '(' params ')' and what may follow it
        p = next((j for j, i in enumerate(head) if self.text[i] == "(" and j and self.kind[head[j - 1]] == "id" and words[j - 1] not in NOT_CALLS[self.style]), None)
        if p is None or "=" in words[:p] or (inside is not None and inside.kind == "function" and st != "java") or "new" in words[:p] or words[-1] in ("->", "=", "return") or not head[p] < self.pair.get(head[p], 0) <= head[-1]:
            return _Scope("block")
        if st == "java" and not (inside is not None and inside.kind == "class"):
            return _Scope("block")
        return _Scope("function", words[p - 1], self.params(head[p] + 1, self.pair.get(head[p], head[p])))

    def _js_function(self, head: list[int], words: list[str], inside: _Scope | None) -> _Scope:
        def named_before(k: int) -> str:
            """The name a value at that place is declared under."""
            if k >= 2 and words[k - 1] == "=":
                j = k - 2
                while j >= 0 and words[j] not in ("const", "let", "var", ",", ";"):
                    j -= 1
                if j >= 0 and words[j] in ("const", "let", "var", ",") and self.kind[head[j + 1]] == "id":
                    return words[j + 1]
            return ""

        if words[-1] == "=>":
            close = len(words) - 2
            while close >= 0 and words[close] != ")" and not (self.kind[head[close]] == "id" and (close == 0 or words[close - 1] in ("=", "(", ",", "async"))):
                close -= 1
            if close < 0:
                return _Scope("function")
            start = close
            if words[close] == ")":
                o = self.pair.get(head[close])
                start = next((j for j, i in enumerate(head) if i == o), 0)
                params = self.params(head[start] + 1, head[close])
            else:
                params = [words[close]]
            if start and words[start - 1] == "async":
                start -= 1
            return _Scope("function", named_before(start), params)
        if "function" in words:
            k = len(words) - 1 - words[::-1].index("function")
            j = k + 1
            if j < len(words) and words[j] == "*":
                j += 1
            name = words[j] if j < len(words) and self.kind[head[j]] == "id" else named_before(k - (k > 0 and words[k - 1] == "async"))
            p = next((i for i in range(j, len(words)) if words[i] == "("), None)
            return _Scope("function", name, self.params(head[p] + 1, self.pair.get(head[p], head[p])) if p is not None else [])
        # a method: name '(' params ')' directly in a class or an object
        p = next((j for j in range(len(words)) if words[j] == "("), None)
        if p and self.kind[head[p - 1]] == "id" and words[p - 1] not in NOT_CALLS[self.style] | _HEADS and "=" not in words[:p] and "." not in words[:p]:
            close = self.pair.get(head[p], head[p])
            after = [self.text[i] for i in head if i > close]
            if head[p] < close <= head[-1] and ((inside is not None and inside.kind == "class") or not after):
                return _Scope("function", words[p - 1], self.params(head[p] + 1, close))
        return _Scope("block")

    # ---- the pass ----------------------------------------------------------------------------------
    def _read(self) -> None:
        text, kind, n = self.text, self.kind, len(self.text)
        stack: list[_Scope] = []
        head: list[int] = []
        classes: list[str] = []
        functions: list[str] = []
        depth = 0
        i = 0
        while i < n:
            t, k = text[i], kind[i]
            top = stack[-1] if stack else None
            if k == "op" and t in ("(", "["):
                depth += 1
                if t == "(" and i and kind[i - 1] == "id" and functions and text[i - 1] not in NOT_CALLS[self.style] and not (i > 1 and text[i - 2] in ("function", "func")):
                    self._call(i, functions[-1])
            elif k == "op" and t in (")", "]"):
                depth -= 1
            if top is not None and top.kind == "expression" and depth <= top.depth and (k == "nl" and text[i - 1] not in ("=>", "(", ",") or (k == "op" and (t in (";", "}") or (t in (",", ")", "]") and depth <= top.depth - (t != ","))))):
                functions.pop()
                stack.pop()
                continue
            if k == "op" and t == "{":
                s = self._classify(head, top)
                if s.kind == "class" and s.name:
                    classes.append(s.name)
                    c = self.classes[s.name] = _Class(self._bases(head))
                    if self.style == "go":
                        c.bases = []
                if s.kind == "function":
                    if s.name:
                        self._enter(s, classes, functions, head, top)
                if depth or (s.kind == "block" and head and text[head[-1]] in _VALUE_BEFORE):
                    s.saved = [*head, i]
                stack.append(s)
                s.depth = depth
                depth = 0
                head = []
            elif k == "op" and t == "}":
                self._field(head, top)
                after: list[int] = []
                if stack:
                    s = stack.pop()
                    depth = s.depth
                    if s.saved is not None:
                        after = [*s.saved, i]
                    if s.kind == "class" and s.name:
                        classes.pop()
                    elif s.kind == "function" and s.name:
                        functions.pop()
                head = after
            elif (k == "op" and t == ";" and not depth) or (k == "nl" and not depth and self._ends(head, i)):
                self._field(head, top)
                head = []
            elif k != "nl":
                head.append(i)
                if k == "op" and t in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="):
                    self._assigned(i, functions[-1] if functions else None, stack)
                elif k == "id" and functions and t in ("let", "const", "var") and self.style == "js":
                    self._declared(i, functions[-1])
                elif k == "op" and t == "=>" and self.style == "js" and i + 1 < n and text[i + 1] != "{":
                    s = self._js_function(head, [text[j] for j in head], top)
                    if s.name:
                        s.kind = "expression"
                        self._enter(s, classes, functions, head, top)
                        s.depth = depth
                        stack.append(s)
            i += 1
        for place, fn, callee, flows in self.marks:
            if place >= 0:
                self.calls.setdefault(fn, []).append(callee)
                self.flows += [(fn, v, callee, p) for v, p in flows]

    def _ends(self, head: list[int], i: int) -> bool:
        """Whether a line end ends a statement: where the language has no semicolons and nothing asks for more."""
        if self.style not in ("js", "go") or not head:
            return False
        last = self.text[head[-1]]
        return not (self.kind[head[-1]] == "op" and last not in (")", "]", "++", "--")) and last not in ("return", "else", "extends", "implements", "struct")

    def _enter(self, s: _Scope, classes: list[str], functions: list[str], head: list[int], top: _Scope | None) -> None:
        """A named function begins: what looked like a call of its name is none."""
        q = ".".join([*classes, s.name])
        if head and self.marks and self.marks[-1][2] == s.name and self.marks[-1][0] >= head[0]:
            place, fn, callee, flows = self.marks[-1]
            self.marks[-1] = (-1, fn, callee, flows)
        functions.append(q)
        self.calls.setdefault(q, [])
        self.variables.setdefault(q, []).extend(f"param:{p}" for p in s.params)
        signature = f"{s.name}({', '.join(s.params)})"
        if top is not None and top.kind == "class" and top.name in self.classes:
            self.classes[top.name].methods.append(signature)
        elif s.receiver is not None:
            self.classes.setdefault("", _Class())
            self.classes[""].methods.append(f"{s.receiver[1]}\x00{s.receiver[0]}\x00{signature}\x00{q}")

    def _call(self, i: int, fn: str) -> None:
        close = self.pair.get(i)
        flows = []
        if close is not None:
            for pos, g in enumerate(self._split(i + 1, close)):
                if len(g) == 1 and self.kind[g[0]] == "id" and self.text[g[0]] not in _VALUES:
                    flows.append((self.text[g[0]], pos))
        self.marks.append((i - 1, fn, self.text[i - 1], flows))

    def _assigned(self, i: int, fn: str | None, stack: list[_Scope]) -> None:
        text, kind = self.text, self.kind
        j = i - 1
        plain = text[i] == "="
        if self.style in ("js", "java") and not plain:
            return
        if j >= 1 and kind[j] == "id" and text[j - 1] in (".", "->", "?."):
            # this.x = .., or a Go receiver's field
            if j >= 2 and plain:
                if text[j - 2] == "this" and self.style in ("js", "java"):
                    c = next((s.name for s in reversed(stack) if s.kind == "class" and s.name), None)
                    if c:
                        self.classes[c].attributes.add(text[j])
                elif self.style == "go":
                    s = next((s for s in reversed(stack) if s.kind == "function" and s.receiver), None)
                    if s is not None and s.receiver[0] == text[j - 2]:
                        self.classes.setdefault("", _Class()).attributes.add(f"{s.receiver[1]}\x00{text[j]}")
            if self.style not in ("c", "cpp"):
                return
        if fn is None or self.style == "go":
            return
        if text[j] == "]" and self.style in ("c", "cpp") and j in self.pair:
            j = self.pair[j] - 1
        while j >= 2 and text[j - 1] in (".", "->") and kind[j - 2] == "id":
            j -= 2
        if j >= 0 and kind[j] == "id" and text[j] not in _VALUES and not (self.style == "js" and j >= 1 and text[j - 1] == ":"):
            self.variables.setdefault(fn, []).append(text[j])
        elif self.style == "js" and j >= 0 and kind[j] == "id":
            # a typed declaration: name ':' type '='
            if j >= 2 and text[j - 1] == ":" and kind[j - 2] == "id":
                self.variables.setdefault(fn, []).append(text[j - 2])

    def _declared(self, i: int, fn: str) -> None:
        """Declarations without a value."""
        j = i + 1
        if j + 1 < len(self.text) and self.kind[j] == "id" and (self.kind[j + 1] == "nl" or self.text[j + 1] in (";", ",")):
            self.variables.setdefault(fn, []).append(self.text[j])

    def _field(self, head: list[int], top: _Scope | None) -> None:
        """A statement of a class body: fields, and methods without a body."""
        while len(head) > 1 and self.text[head[0]] in ("public", "private", "protected") and self.text[head[1]] == ":":
            head = head[2:]
        words = [self.text[i] for i in head]
        if not words or words[0] == "=" or top is None or top.kind != "class" or top.name not in self.classes:
            return
        c = self.classes[top.name]
        st = self.style
        if st == "go":
            k = 0
            while k < len(head) and self.kind[head[k]] == "id":
                if k + 1 < len(words) and words[k + 1] == ",":
                    c.attributes.add(words[k])
                    k += 2
                    continue
                if k + 1 < len(words) and self.kind[head[k + 1]] != "str" and words[k + 1] != ".":
                    c.attributes.add(words[k])
                break
            return
        eq = words.index("=") if "=" in words else len(words)
        before = words[:eq]
        if "(" in before:
            p = before.index("(")
            if p and self.kind[head[p - 1]] == "id":
                if st == "java":
                    c.methods.append(f"{before[p - 1]}({', '.join(self.params(head[p] + 1, self.pair.get(head[p], head[p])))})")
                elif st in ("c", "cpp"):
                    c.attributes.add(before[p - 1])
            return
        if st == "js":
            ids = [w for w, i in zip(before, head, strict=False) if self.kind[i] == "id" and w not in _MODIFIERS]
            if ids and words[0] != "@":
                c.attributes.add(ids[0])
            return
        if before[0] in ("using", "typedef", "friend"):
            return
        for g in self._split(head[0], head[-1] + 1):
            cut = next((k for k, i in enumerate(g) if self.text[i] in ("=", "[")), len(g))
            ids = [i for i in g[:cut] if self.kind[i] == "id"]
            if ids:
                c.attributes.add(self.text[ids[-1]])

    def records(self) -> list[tuple]:
        # methods and fields that a receiver names belong to its struct
        loose = self.classes.pop("", None)
        if loose is not None:
            for m in loose.methods:
                kind, _, signature, _ = m.split("\x00")
                if kind in self.classes:
                    self.classes[kind].methods.append(signature)
            for a in loose.attributes:
                kind, name = a.split("\x00")
                if kind in self.classes:
                    self.classes[kind].attributes.add(name)
        out: list[tuple] = [("call_flow", f, None, None, None, c) for f, c in self.calls.items()]
        out += [("data_flow", f, v, c, i, None) for f, v, c, i in self.flows]
        out += [("variables", f, None, None, None, v) for f, v in self.variables.items()]
        for name, c in self.classes.items():
            out += [("class_bases", name, None, None, None, c.bases), ("class_attributes", name, None, None, None, sorted(c.attributes)), ("class_methods", name, None, None, None, c.methods)]
        return out


def records(code: str, ext: str) -> list[tuple]:
    """(kind, name, a, b, pos, items) of a text, as for Python; functions without calls and repeated calls are kept."""
    style = STYLE.get(ext)
    return Reader(code, style).records() if style else []
