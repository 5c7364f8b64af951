"""Definitions, calls, imports and heritage of source text in thirteen languages.

A lexical automaton (one pattern for each family of languages) leaves out comments and keeps strings whole, brackets are matched once,
and a walk over the tokens with a stack of open scopes gives a row for each finding.  Everything about a text as a whole
set of rows (forms of calls, exports, resolution) is columns over these rows.

Defined cases: null, empty or unknown-language text gives no rows; a bracket that is never closed ends with the text; a broken text gives
what can be read of it (Python: nothing).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import call_form

ROW = T.StructType([
    T.StructField("seq", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("receiver", T.StringType()), T.StructField("arguments", T.IntegerType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("wildcard", T.BooleanType()),
])

_LINE = r'"(?:\\.|[^"\\\n])*"?'
_LONG = r'"(?:\\.|[^"\\])*"?'
_CHAR = r"'(?:\\[^'\n]+|[^'\\\n])'"
_ONE = r"'(?:\\.|[^'\\])*'?"
_SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_TRIPLE = r'"""(?:\\.|.)*?(?:"""|\Z)'
#: language -> patterns of comments and of strings, tried in this order.
LEXICON = {
    **dict.fromkeys(("typescript", "javascript"), (_SLASHES, _LINE + r"|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?")),
    "go": (_SLASHES, _LINE + r"|`[^`]*`?|" + _CHAR), "java": (_SLASHES, _TRIPLE + "|" + _LINE + "|" + _CHAR), "kotlin": (_SLASHES, _TRIPLE + "|" + _LINE + "|" + _CHAR),
    "csharp": (_SLASHES + r"|^[ \t]*#[^\n]*", _TRIPLE + r'|\$?@\$?"(?:""|[^"])*"?|\$?' + _LINE + "|" + _CHAR), "swift": (_SLASHES, _TRIPLE + r'|#".*?"#|' + _LINE),
    **dict.fromkeys(("c", "cpp"), (_SLASHES, r'R"(?P<d>\w*)\(.*?\)(?P=d)"|' + _LINE + "|" + _CHAR + r"|^[ \t]*#(?:\\\n|[^\n])*")),
    "rust": (_SLASHES, r'b?r(?P<h>#*)".*?"(?P=h)|b?' + _LONG + r"|b?'(?:\\[^']+|[^'\\])'|'\w+"), "php": (_SLASHES + r"|\#(?!\[)[^\n]*", r"<<<[ ]*(?P<q>['\"]?)(?P<w>\w+)(?P=q)\n.*?\n[ ]*(?P=w)\b|" + _LONG + "|" + _ONE),
    "ruby": (r"\#[^\n]*|^=begin\b.*?(?:^=end\b[^\n]*|\Z)", r"<<[~-]?(?P<q>['\"]?)(?P<w>[A-Z_]+)(?P=q)[^\n]*\n.*?\n[ \t]*(?P=w)\b|" + _LONG + "|" + _ONE),
}
_WORD = {"ruby": r"@{0,2}[^\W\d]\w*[?!]?", "php": r"\$?[^\W\d]\w*"}
_PATTERNS = {lang: re.compile(rf"(?P<comment>{c})|(?P<string>{s})|(?P<word>{_WORD.get(lang, r'[^\W\d][\w$]*|[$][\w$]*')})|(?P<number>\d(?:\w|[.](?=\d))*)|(?P<op>=>|->|::|[?][.]|&&|[|][|]|[<>=!]=|<<|[^\s])", re.S | re.M) for lang, (c, s) in LEXICON.items()}
_KINDS = {"string", "word", "number", "op"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}

#: Words that open a type, and what it is called; words of functions; words before a bracket that are no calls.  By language.
TYPES = {
    **dict.fromkeys(("typescript", "javascript"), {"class": "Class", "interface": "Interface", "enum": "Enum"}), "java": {"class": "Class", "interface": "Interface", "enum": "Enum", "record": "Class"},
    "kotlin": {"class": "Class", "interface": "Interface", "object": "Class"}, "csharp": {"class": "Class", "interface": "Interface", "enum": "Enum", "struct": "Struct", "record": "Class"},
    "swift": {"class": "Class", "struct": "Struct", "enum": "Enum", "protocol": "Interface", "extension": "", "actor": "Class"}, "c": {"struct": "Struct", "enum": "Enum", "union": "Struct"},
    "cpp": {"class": "Class", "struct": "Struct", "enum": "Enum", "union": "Struct", "namespace": ""}, "rust": {"struct": "Struct", "enum": "Enum", "trait": "Trait", "union": "Struct"},
    "php": {"class": "Class", "interface": "Interface", "trait": "Trait", "enum": "Enum"}, "ruby": {"class": "Class", "module": "Module"}, "go": {},
}
FUNCTIONS = {**dict.fromkeys(("typescript", "javascript", "php"), "function"), "go": "func", "rust": "fn", "kotlin": "fun", "swift": "func", "ruby": "def"}
NO_CALL = {
    "if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "fun", "match", "when", "elseif", "elsif", "and", "or", "not", "in", "throw", "sizeof", "typeof", "await", "yield", "using", "lock", "foreach",
    "synchronized", "guard", "do", "else", "case", "new", "with", "import", "constructor", "init", "unless", "until", "def", "class", "struct", "enum", "interface", "array", "list", "isset", "empty", "unset", "defined", "where", "as", "let", "var", "const", "fixed", "checked", "delegate", "operator", "alignof", "decltype", "static_assert", "noexcept", "assert", "loop", "pub", "impl", "mut", "try", "is", "get", "set", "async", "super",
} - {"super", "list", "get", "set", "assert", "operator"}
HEAD = 400  # tokens between a name and its body, or of a statement that imports; what is longer isn't taken for one
BY_SHAPE = ("java", "csharp", "c", "cpp", "typescript", "javascript")  # where a method has no word of its own
_AFTER = {"const", "override", "noexcept", "final", "volatile", "async", "throws", "where", "&", "mutable", "throw", "rethrows", "try"}


class Tokens:
    """Words, strings and signs of a text, each with its line and whether it is the line's first; and matched brackets."""

    def __init__(self, text: str, lang: str) -> None:
        self.text: list[str] = []
        self.kind: list[str] = []
        self.line: list[int] = []
        self.first: list[bool] = []
        before, line, at = 0, 1, 0  # lines are counted on from the last token's
        for m in _PATTERNS[lang].finditer(text):
            kind = m.lastgroup
            if kind == "comment":
                continue
            start, end = m.span()
            if kind not in _KINDS:  # a named part of a string or of a comment
                kind = next(k for k in ("comment", "string", "word", "number", "op") if m[k] is not None)
                if kind == "comment":
                    continue
            line += text.count("\n", at, start)
            at = start
            self.text.append(m[0])
            self.kind.append(kind)
            self.line.append(line)
            self.first.append(line != before)
            before = line
            if kind == "string" and end - start > 1:
                before += text.count("\n", start, end - 1)
        self.n = len(self.text)
        self.last_line = text.count("\n") + (not text.endswith("\n"))
        self.match: dict[int, int] = {}
        self.after: dict[int, int] = {}
        stack: list[int] = []
        for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)):
            if k != "op":
                continue
            if t in _OPEN:
                stack.append(i)
            elif t in _CLOSE:
                while stack and _OPEN[self.text[stack[-1]]] != t:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    self.match[i], self.match[j] = j, i

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < self.n and self.kind[i] != "string" else ""

    def word(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == "word"

    def end(self, i: int) -> int:
        """The bracket that closes the one at i, or the end of the text."""
        return self.match.get(i, self.n)

    def end_line(self, i: int) -> int:
        return self.line[i] if i < self.n else self.last_line

    def angles(self, i: int) -> int:
        """The place after a list in angle brackets that begins at i, if one does."""
        if self.at(i) != "<":
            return i
        if i not in self.after:
            self.after[i] = self._angles(i)
        return self.after[i]

    def _angles(self, i: int) -> int:
        depth, j = 0, i
        while j < min(self.n, i + 200):
            t = self.at(j)
            depth += (t == "<") + 2 * (t == "<<") - (t == ">")
            if t in ("(", "["):
                j = self.end(j)
            elif t in (";", "{", "}"):
                return i
            if depth <= 0:
                return j + 1
            j += 1
        return i


def _string(t: str) -> str:
    return t.lstrip("@$bru#").strip("\"'`")


def _arguments(k: Tokens, i: int) -> int:
    """Between the brackets at i."""
    end, n, some, j = k.end(i), 0, False, i + 1
    if end == k.n:  # never closed
        return 0
    while j < end:
        if k.at(j) == ",":
            n, some = n + some, False
        else:
            some = True
            j = k.end(j) if k.at(j) in _OPEN else j
        j += 1
    return n + some


def _use_tree(k: Tokens, i: int, end: int, prefix: str, sep: str) -> Iterator[tuple[str, bool]]:
    """(path, wildcard) of each leaf of a tree of names with braces; names after ``as`` are left out."""
    path, done = prefix, False
    while i < end:
        t = k.at(i)
        if t == "{":
            yield from _use_tree(k, i + 1, k.end(i), path, sep)
            i, done = k.end(i), True
        elif t == ",":
            if path != prefix and not done:
                yield path, False
            path, done = prefix, False
        elif t == "*":
            yield path, True
            done = True
        elif t == "as":
            i += 1
        elif t not in (sep, ""):
            path = path if t == "self" and path else (path + sep + t if path else t)
            done = done or (t == "self" and path == prefix and (yield from _leaf(path)))
        i += 1
    if path != prefix and not done:
        yield path, False


def _leaf(path: str):
    yield path, False
    return True


def _script_import(k: Tokens, i: int) -> tuple[str, list[str], bool] | None:
    """Of an import or export ... from at i: module, names, wildcard."""
    j, names, wild = i + 1, [], False
    while j < min(k.n, i + 400):
        if k.kind[j] == "string":
            return (_string(k.text[j]), names, wild) if j == i + 1 or k.at(j - 1) == "from" else None
        t = k.at(j)
        if t in (";", "(", "=") or (j > i + 1 and t in ("const", "function", "class", "let", "var", "default")):
            return None
        if t == "*":
            wild = True
        elif t == "as" and k.at(j - 1) != "*":
            j += 1  # the alias
        elif k.word(j) and t not in ("from", "type", "as", "typeof"):
            names.append(t)
        j += 1
    return None


def _imports(k: Tokens, i: int, lang: str, in_type: bool) -> Iterator[tuple[str, list[str], bool]]:
    t = k.at(i)
    if lang in ("typescript", "javascript"):
        if t in ("require", "import") and k.at(i + 1) == "(" and k.end(i + 1) == i + 3 and k.kind[i + 2] == "string" and k.at(i - 1) != ".":
            yield _string(k.text[i + 2]), [], False
        elif t in ("import", "export") and k.at(i - 1) != "." and (found := _script_import(k, i)):
            yield found
    elif lang == "go" and t == "import" and k.first[i]:
        end = min(k.end(i + 1), i + 20 * HEAD) if k.at(i + 1) == "(" else i + 3
        for j in range(i + 1, min(end, k.n)):
            if k.kind[j] == "string":
                yield _string(k.text[j]), [], k.at(j - 1) == "."
                if k.at(i + 1) != "(":
                    break
    elif lang in ("java", "kotlin", "swift", "csharp") and k.first[i] and t == ("using" if lang == "csharp" else "import") or (lang == "csharp" and t == "using" and k.at(i - 1) == "global"):
        j = i + 1
        while k.at(j) in ("static", "class", "struct", "enum", "protocol", "func", "var", "typealias", "let"):
            j += 1
        if lang == "csharp" and k.at(j + 1) == "=":
            j += 2
        if k.at(i + 1) in ("(", "var") or not k.word(j) or (lang == "csharp" and k.word(j + 1)):
            return
        parts = [k.at(j)]
        while k.at(j + 1) == "." and (k.word(j + 2) or k.at(j + 2) == "*"):
            parts.append(k.at(j + 2))
            j += 2
        yield ".".join(parts), [], parts[-1] == "*"
    elif lang in ("rust", "php") and t == "use" and k.at(i + 1) != "(" and not (lang == "php" and in_type):
        sep, end = ("::", ";") if lang == "rust" else ("\\", ";")
        j = i + 1 + (lang == "php" and k.at(i + 1) in ("function", "const"))
        stop = next((x for x in range(j, min(k.n, j + HEAD)) if k.at(x) == end), j)
        for path, wild in _use_tree(k, j + (k.at(j) == sep), stop, "", sep):
            yield path, [], wild
    elif lang == "ruby" and t in ("require", "require_relative", "load") and k.first[i]:
        j = i + 1 + (k.at(i + 1) == "(")
        if j < k.n and k.kind[j] == "string":
            yield _string(k.text[j]), [], False


def _listed(k: Tokens, i: int, end: int) -> list[str]:
    """Names of a list of types: what stands in brackets or before a space is left out."""
    out, name, j = [], "", i
    while j < end:
        t = k.at(j)
        if t == "<":
            j = max(j, k.angles(j) - 1)
        elif t in _OPEN:
            j = k.end(j)
        elif t in (",", "+", "&"):
            out, name = out + [name], ""
        elif t in ("where", "by", "requires"):
            break
        elif k.kind[j] == "word":
            name = name + t if name.endswith((".", "::", "\\")) else t
        elif t in (".", "::", "\\"):
            name += t
        j += 1
    return [x for x in [*out, name] if x]


def _heritage(k: Tokens, i: int, end: int, lang: str) -> Iterator[tuple[str, str]]:
    """(parent, kind) from the head of a type: the tokens from after its name to its body."""
    j, marks = i, []
    while j < end:
        t = k.at(j)
        if t == "<" and lang != "ruby":
            j = max(j, k.angles(j) - 1)
        elif t in _OPEN:
            j = k.end(j)
        elif t in ("extends", "implements") or (t == ":" and lang in ("kotlin", "csharp", "swift", "cpp", "rust")) or (t == "<" and lang == "ruby"):
            marks.append(j)
            if t == ":":
                break
        j += 1
    for m, stop in zip(marks, [*marks, end][1:], strict=True):
        for parent in _listed(k, m + 1, stop):
            yield parent, "IMPLEMENTS" if k.at(m) == "implements" else "EXTENDS"


def _receiver(k: Tokens, i: int) -> str:
    """What stands before the dot before i."""
    if k.at(i - 1) not in (".", "?.", "->", "::"):
        return ""
    j, parts = i - 2, []
    while j >= max(0, i - HEAD):
        tail = ""
        while k.at(j) in (")", "]") and j in k.match:
            tail, j = ("()" if k.at(j) == ")" else "[]") + tail, k.match[j] - 1
            if k.at(j) == ">":  # of a type with parameters
                depth = 0
                while j >= 0 and (depth := depth + (k.at(j) == ">") - (k.at(j) == "<")):
                    j -= 1
                j -= 1
        if k.word(j) and (not tail or k.at(j) == "new" or k.at(j) not in NO_CALL):
            parts.append(k.at(j) + tail)
        elif 0 <= j < k.n and k.kind[j] == "string" and not tail:
            parts.append(k.text[j])
        elif tail:
            parts.append(tail)
        if not k.word(j) or k.at(j - 1) not in (".", "?.", "->", "::"):
            break
        j -= 2
    return ".".join(reversed(parts))[:200]


def _body(k: Tokens, i: int, lang: str) -> tuple[int, int]:
    """From i, after a head: (place of the body's brace or -1, place where the definition ends)."""
    j = i
    while j < min(k.n, i + HEAD):
        t = k.at(j)
        if t == "{":
            return j, k.end(j)
        if t in (";", "}", ")") or (j > i and k.first[j] and (t in NO_CALL or t in TYPES[lang] or t == FUNCTIONS.get(lang) or t in ("@", "val", "public", "private", "protected", "internal", "open", "data", "type", "package"))):
            return -1, max(i - 1, j - (t != ";"))
        if t == "=" and lang in ("kotlin", "swift") or t == "=>":
            line = k.line[j]
            while j + 1 < min(k.n, i + HEAD) and (k.line[j + 1] == line or k.at(j) in _OPEN):
                j = min(k.end(j), k.n - 1) if k.at(j) in _OPEN else j + 1
                line = k.line[j]
            return -1, j
        j = k.end(j) if t in ("(", "[") else j
        j += 1
    return -1, min(j, k.n - 1)


def _shaped(k: Tokens, i: int, lang: str, scope: tuple | None) -> tuple[int, int] | None:
    """Body and end, if the word at i, before a bracket, is the name of a method or function without a word of its own."""
    if k.at(i) in NO_CALL - {"constructor", "set", "get"} or k.at(i - 1) in (".", "?.", "->", "new", "return", "=", "(", ",", "&&", "||", "!", "?", "throw"):
        return None
    within = scope[2] if scope else "top"
    if lang in ("java", "csharp", "typescript", "javascript") and within != "type" or lang in ("c", "cpp") and within == "body":
        return None
    j = k.end(i + 1) + 1
    typed = k.word(i - 1) or k.at(i - 1) in (">", "]", "*", "&", "::", "~", "?")
    stop = j + HEAD
    while j < min(k.n, stop):
        t = k.at(j)
        if t == "{":
            return j, k.end(j)
        if t == ";" and lang in ("java", "csharp") and typed and not k.at(i - 1) in ("return", "else"):
            return -1, j
        if t == "=>" and lang == "csharp":
            return _body(k, j, lang)
        if t == ":" and lang in ("cpp", "csharp", "typescript") or t in ("->",) or t in _AFTER:
            while j + 1 < min(k.n, stop) and k.at(j + 1) not in ("{", ";", "}", "=>"):
                j = k.end(j + 1) if k.at(j + 1) in ("(", "[") else j + 1
                if lang == "cpp" and k.word(j) and k.at(j + 1) == "{" and k.at(k.end(j + 1) + 1) in (",", "{"):
                    j = k.end(j + 1)  # a member's braces in a list of initial values
            if lang == "typescript" and k.at(j + 1) == "{" and k.at(j) == ":":
                j = k.end(j + 1)  # a type of braces
        elif not (k.word(j) or t in ("[", "]")):
            return None
        j += 1
    return None


def _arrow(k: Tokens, i: int) -> int | None:
    """The place after the head of a function that is given to the name at i (const f = (x) => ...)."""
    j = i + 1
    if k.at(j) == ":":
        while j < min(k.n, i + HEAD) and k.at(j) not in ("=", ";"):
            j = k.end(j) + 1 if k.at(j) in _OPEN else j + 1
    if k.at(j) != "=":
        return None
    j += 1 + (k.at(j + 1) == "async")
    if k.at(j) == "function":
        return next((k.end(x) + 1 for x in range(j, min(j + 4, k.n)) if k.at(x) == "("), None)
    j = k.angles(j)
    if k.word(j) and k.at(j + 1) == "=>":
        return j + 1
    if k.at(j) != "(":
        return None
    j = k.end(j) + 1
    while j < min(k.n, i + HEAD) and k.at(j) not in ("=>", ";", ",", ")", "}", "="):
        j = k.end(j) + 1 if k.at(j) in _OPEN else j + 1
    return j if k.at(j) == "=>" else None


def _ruby_ends(k: Tokens) -> dict[int, int]:
    """For each word that opens a block, the place of its ``end``."""
    out, stack = {}, []
    for i in range(k.n):
        t = k.at(i)
        if k.at(i - 1) in (".", "::") or not k.word(i) or k.at(i + 1) == ":" and k.at(i + 2) != ":":
            continue
        starts = k.first[i] or k.at(i - 1) in (";", "=", "(", "then", "do", "{", "|")
        loop = t == "do" and any(k.at(j) in ("while", "until", "for") for j in stack if k.line[j] == k.line[i])
        if t in ("def", "class", "module", "begin", "case") and (starts or t in ("def", "begin", "case")) or t in ("if", "unless", "while", "until", "for") and starts or t == "do" and not loop:
            stack.append(i)
        elif t == "end" and stack:
            out[stack.pop()] = i
    return out


def _walk(k: Tokens, lang: str) -> Iterator[tuple]:
    scopes: list[tuple[int, str, str]] = []  # place of the end, name, type | func | body
    ends = _ruby_ends(k) if lang == "ruby" else {}
    kinds, word = TYPES[lang], FUNCTIONS.get(lang)
    skip: set[int] = set()

    def row(kind: str, name: str, parent: str, i: int, end: int, receiver: str = "", arguments: int | None = None, names=(), wild: bool = False) -> tuple:
        return kind, name, parent, k.line[i], k.end_line(end), receiver, arguments, list(names), wild

    for i in range(k.n):
        while scopes and i > scopes[-1][0]:
            scopes.pop()
        if k.kind[i] in ("op", "number"):
            continue
        t, scope = k.at(i), scopes[-1] if scopes else None
        parent = next((s[1] for s in reversed(scopes) if s[1]), "")
        if k.kind[i] == "string":
            if lang in ("c", "cpp") and (m := re.match(r"\s*#\s*include\s*[<\"]([^>\"]+)", k.text[i])):
                yield row("IMPORT", m[1], "", i, i)
            continue
        if not k.word(i) or i in skip:
            continue
        dotted = k.at(i - 1) in (".", "?.", "->", "::") or (lang == "php" and t.startswith("$"))
        found = [] if dotted else list(_imports(k, i, lang, bool(scope) and scope[2] == "type"))
        for module, names, wild in found:
            yield row("IMPORT", module, parent, i, i, names=names, wild=wild)
        if found and t not in ("require", "load", "require_relative"):
            stop = i
            while stop + 1 < k.n and k.at(stop + 1) != ";" and (k.line[stop + 1] == k.line[stop] or k.at(stop) in ("{", "(", ",") or k.at(stop + 1) in ("}", ")")):
                stop += 1
                skip.add(stop)
            continue
        if lang == "go" and t == "type" and k.word(i + 1) and (k.at(j := k.angles(i + 2) if k.at(i + 2) == "<" else (k.end(i + 2) + 1 if k.at(i + 2) == "[" else i + 2)) in ("struct", "interface")):
            end = k.end(j + 1)
            yield row("Struct" if k.at(j) == "struct" else "Interface", k.at(i + 1), parent, i, end)
            scopes.append((end, "", "body"))
            continue
        if lang == "rust" and t == "impl" and k.first[i]:
            j = k.angles(i + 1)
            b = next((x for x in range(j, min(k.n, j + HEAD)) if k.at(x) in ("{", ";")), j)
            over = next((x for x in range(j, b) if k.at(x) == "for"), None)
            owner = _listed(k, over + 1 if over else j, b)[:1]
            if over and owner:
                for p in _listed(k, j, over)[:1]:
                    yield row("IMPLEMENTS", owner[0], parent, i, i, p)
            scopes.append((k.end(b), owner[0] if owner else "", "type"))
            continue
        named = i + 1 + (t == "enum" and k.at(i + 1) in ("class", "struct")) + (lang == "kotlin" and t == "companion")
        if t in kinds and not dotted and k.word(named) and k.at(i - 1) not in ("enum",) and (lang != "ruby" or i in ends) and not (t == "record" and k.at(named + 1) not in ("(", "<", "{", ":", ";")):
            name = k.at(named)
            while k.at(named + 1) in ("::", ".") and k.word(named + 2):
                named += 2
                name = k.at(named) if lang != "cpp" else name + "::" + k.at(named)
            if lang == "ruby":
                stop = next((x for x in range(named + 1, min(k.n, named + HEAD)) if k.first[x] or k.at(x) == ";"), named + 1)
                b, end = stop, ends[i]
            else:
                b, end = _body(k, named + 1, lang)
                stop = b if b >= 0 else end + 1
                if lang in ("c", "cpp") and (b < 0 or any(k.at(x) in ("(", "=") for x in range(named + 1, b))):
                    continue  # a use of the type
            skip.add(named)
            if kinds[t]:
                yield row(kinds[t], name, parent, i, end)
            for up, kind in _heritage(k, named + 1, stop, lang):
                yield row(kind, name, parent, i, i, up)
            scopes.append((end, name, "type" if t != "namespace" else "top"))
            continue
        if t == word and not dotted and lang != "ruby":
            j, owner = i + 1, parent if scope and scope[2] == "type" else ""
            if lang == "go" and k.at(j) == "(":
                owner = next((k.at(x) for x in range(k.end(j) - 1, j, -1) if k.word(x) and k.at(x - 1) in ("*", "(") or k.word(x) and k.word(x - 1)), "")
                j = k.end(j) + 1
            j += k.at(j) == "&"
            j = k.angles(j)
            if not k.word(j):
                continue
            while k.at(j + 1) == "." and k.word(j + 2):  # an extension
                j += 2
            p = k.angles(j + 1) if k.at(j + 1) != "[" else k.end(j + 1) + 1
            b, end = _body(k, (k.end(p) if k.at(p) == "(" else p) + 1, lang)
            yield row("Method" if owner else "Function", k.at(j), owner or parent, i, end)
            skip.add(j)
            scopes.append((max(end, p), k.at(j), "body"))
            continue
        if lang == "ruby" and t == "def" and i in ends:
            j = i + 1 + 2 * (k.at(i + 2) == ".")
            yield row("Method" if parent and scope[2] == "type" else "Function", k.at(j), parent, i, ends[i])
            skip.update((i + 1, j))
            scopes.append((ends[i], k.at(j), "body"))
            continue
        if lang == "ruby" and t in ("include", "extend", "prepend") and scope and scope[2] == "type" and k.first[i]:
            stop = next((x for x in range(i + 1, min(k.n, i + HEAD)) if k.first[x]), min(k.n, i + HEAD))
            for up in _listed(k, i + 1, stop):
                yield row("IMPLEMENTS", scope[1], parent, i, i, up)
            continue
        if lang == "php" and t == "use" and scope and scope[2] == "type":
            stop = next((x for x in range(i, min(k.n, i + HEAD)) if k.at(x) in (";", "{")), i)
            for up in _listed(k, i + 1, stop):
                yield row("IMPLEMENTS", scope[1], parent, i, i, up)
            continue
        if lang in ("typescript", "javascript") and k.at(i - 1) in ("const", "let", "var") and (j := _arrow(k, i)):
            b, end = (j, k.end(j)) if k.at(j) == "{" else ((j + 1, k.end(j + 1)) if k.at(j + 1) == "{" else _body(k, j, lang))
            yield row("Function", t, parent, i, end)
            scopes.append((end, t, "body"))
            continue
        if lang in ("swift", "kotlin") and t in ("init", "constructor") and k.at(i + 1) == "(" and scope and scope[2] == "type" and not dotted and k.at(i - 1) != "class":
            b, end = _body(k, k.end(i + 1) + 1, lang)
            yield row("Constructor", t, parent, i, end)
            scopes.append((end, t, "body"))
            continue
        p = i + 1
        if lang == "rust" and k.at(p) == "!" and k.at(p + 1) in _OPEN:
            p += 1
        elif lang == "rust" and k.at(p) == "::" and k.at(p + 1) == "<":
            p = k.angles(p + 1)
        elif lang in BY_SHAPE and k.at(p) == "<" and lang != "c":
            p = k.angles(p)
        bare = lang == "ruby" and k.at(i - 1) in (".", "?.", "&.") and k.at(p) != "("
        if k.at(p) != "(" and not (lang == "rust" and p == i + 2 and k.at(p) in _OPEN) and not bare:
            continue
        if lang in BY_SHAPE and p == i + 1 and (shape := _shaped(k, i, lang, scope)):
            b, end = shape
            owner = k.at(i - 2) if k.at(i - 1) == "::" else (scope[1] if scope and scope[2] == "type" else "")
            kind = "Constructor" if owner == t and lang in ("java", "csharp", "cpp") else ("Method" if owner else "Function")
            yield row(kind, t, owner or parent, i, end)
            scopes.append((max(end, k.end(p)), t, "body"))
            j = k.end(p) + 1
            while lang == "cpp" and j < b:  # members of a list of initial values
                skip.update([j] if k.word(j) else [])
                j = k.end(j) + 1 if k.at(j) in _OPEN else j + 1
            continue
        before = k.at(i - 1)
        if lang in BY_SHAPE and (not scope or scope[2] != "body"):  # a declaration without a body
            if lang in ("typescript", "javascript"):
                declared = scope is not None and scope[2] == "type" and (k.first[i] or before in ("{", ";", "}", ",") or (k.word(i - 1) and before not in NO_CALL))
            else:
                declared = lang in ("c", "cpp") and (k.first[i] and bool(scope) or before in ("*", "&", ">") or (k.word(i - 1) and before not in NO_CALL))
            if declared:
                continue
        if t in NO_CALL - ({"new"} if lang == "ruby" else set()) or k.at(i - 1) in (word, "fun", "func", "def"):
            continue
        made = k.at(i - 1) == "new" or (k.at(i - 1) in (".", "\\") and _made(k, i))
        yield row("NEW" if made else "CALL", t, parent, i, i, "" if made else _receiver(k, i), 0 if bare else _arguments(k, p))


def _made(k: Tokens, i: int) -> bool:
    while k.at(i - 1) in (".", "\\") and k.word(i - 2):
        i -= 2
    return k.at(i - 1) == "new"


def _python(text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    todo = [(n, "", False) for n in reversed(tree.body)]
    while todo:
        node, parent, in_class = todo.pop()
        inner, is_class, line = parent, in_class, getattr(node, "lineno", 0)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield "Method" if in_class else "Function", node.name, parent, line, node.end_lineno, "", None, [], False
            inner, is_class = node.name, False
        elif isinstance(node, ast.ClassDef):
            yield "Class", node.name, parent, line, node.end_lineno, "", None, [], False
            for b in node.bases:
                yield "EXTENDS", node.name, parent, line, line, ast.unparse(b).split("[")[0].split(".")[-1], None, [], False
            inner, is_class = node.name, True
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield "IMPORT", a.name, parent, line, line, "", None, [], False
        elif isinstance(node, ast.ImportFrom):
            names = [a.name for a in node.names if a.name != "*"]
            yield "IMPORT", "." * node.level + (node.module or ""), parent, line, line, "", None, names, len(names) < len(node.names)
        elif isinstance(node, ast.Call):
            f, n = node.func, len(node.args) + len(node.keywords)
            if isinstance(f, ast.Name):
                yield "CALL", f.id, parent, line, line, "", n, [], False
            elif isinstance(f, ast.Attribute):
                yield "CALL", f.attr, parent, f.end_lineno, f.end_lineno, ast.unparse(f.value)[:200], n, [], False
        todo += [(n, inner, is_class) for n in reversed(list(ast.iter_child_nodes(node)))]


@F.udtf(returnType=ROW)
class Scan:
    """Rows of one text."""

    def eval(self, content: str, language: str):
        if not content or (language != "python" and language not in _PATTERNS):
            return
        rows = _python(content) if language == "python" else _walk(Tokens(content, language), language)
        for n, r in enumerate(rows):
            yield (n, *r)


def scan(files: DataFrame) -> DataFrame:
    """files(path, language, content) -> path, language, and a row for each definition (kind is its label, parent what it stands in), call
    (CALL, or NEW after ``new``; receiver, arguments, form), import (IMPORT; name is the module; names, wildcard) and heritage (EXTENDS or IMPLEMENTS;
    receiver is the parent type)."""
    spark = files.sparkSession
    spark.udtf.register("scan_source", Scan)
    # small tables come as few tasks, but their texts take long
    files = files.select("path", "language", "content").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    found = spark.sql("SELECT path, language, s.* FROM {files}, LATERAL scan_source(content, language) s", files=files)
    form = F.when(F.col("kind") == "NEW", "constructor").when(F.col("kind") == "CALL", call_form(F.col("name"), F.col("receiver"), F.col("language")))
    return found.withColumn("form", form)
