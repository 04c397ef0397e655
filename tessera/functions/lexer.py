"""A lexer for the source languages: comments, strings, numbers, names and signs with their lines. It never fails on broken input.

It stands in for a grammar: what the inventories need (imports, exported names, tests, metrics) is told by words, signs and nesting. What only a
parser could tell apart, such as a keyword used as a name, is not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

EXTENSIONS = {"rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go"}
_NAME, _NUMBER = r"[^\W\d]\w*", r"\d[\w.]*"
_QUOTED = r'"(?:\\.|[^"\\\n])*"?'
_SIGNS = r"=>|->|::|\.\.\.|[=!<>]==?|&&=?|\|\|=?|\?\?=?|\?\.|\*\*=?|<<=?|>>=?|[-+*/%&|^:]=|\+\+|--|\S"
_PARTS = {
    "rust": (r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", rf"b?r(?P<h>#*)\"[\s\S]*?(?:\"(?P=h)|\Z)|b?{_QUOTED}|b?'(?:\\[^\n]{{1,9}}?|[^\\'\n])'"),
    "go": (r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", rf"`[^`]*`?|{_QUOTED}|'(?:\\[^\n]{{1,9}}?|[^\\'\n])'"),
    "python": (r"#[^\n]*", r"(?i:[rbuf]{0,2})(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"),
    "javascript": (r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", rf"`(?:\\.|[^`\\])*`?|{_QUOTED}|'(?:\\.|[^'\\\n])*'?"),
}
_PARTS |= {k: _PARTS["javascript"] for k in ("typescript", "tsx")}
_LEXERS = {k: re.compile(rf"(?P<comment>{c})|(?P<string>{s})|(?P<number>{_NUMBER})|(?P<name>{_NAME})|(?P<sign>{_SIGNS})") for k, (c, s) in _PARTS.items()}
KEYWORDS = {
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case",
    "javascript": "async await break case catch class const continue debugger default delete do else enum export extends false finally for from function if implements import in instanceof interface let new null of package private protected public return static super switch this throw true try type typeof var void while with yield",
}
KEYWORDS |= {k: KEYWORDS["javascript"] for k in ("typescript", "tsx")}
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(frozen=True, slots=True)
class Token:
    kind: str
    text: str
    line: int
    end_line: int
    column: int


def lex(text: str, language: str) -> list[Token]:
    """Tokens of ``text``, comments included. Lines count from 1, columns from 0."""
    out, line, at, start = [], 1, 0, 0
    for m in _LEXERS[language].finditer(text):
        gap = text.count("\n", at, m.start())
        if gap:
            line, start = line + gap, text.rfind("\n", at, m.start()) + 1
        word = m.group()
        inside = word.count("\n")
        out.append(Token(m.lastgroup if m.lastgroup != "h" else "string", word, line, line + inside, m.start() - start))
        if inside:
            line, start = line + inside, m.start() + word.rfind("\n") + 1
        at = m.end()
    return out


def code(tokens: list[Token]) -> list[Token]:
    return [t for t in tokens if t.kind != "comment"]


def balanced(tokens: list[Token]) -> bool:
    """Whether all brackets match; a text in which they do not has a syntax error."""
    stack = []
    for t in tokens:
        if t.kind == "sign":
            if t.text in OPEN:
                stack.append(OPEN[t.text])
            elif t.text in CLOSE and (not stack or stack.pop() != t.text):
                return False
    return not stack


def normalized(tokens: list[Token], language: str) -> list[tuple[str, int, int]]:
    """(token, line, end line) without comments: names and literals by their type, keywords and signs as they are."""
    words = KEYWORDS[language]
    return [({"string": "$string", "number": "$number"}.get(t.kind) or ("$name" if t.kind == "name" and t.text not in words else t.text), t.line, t.end_line) for t in code(tokens)]


def closing(tokens: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at ``at``; the last token if none does."""
    depth = 0
    for k in range(at, len(tokens)):
        if tokens[k].kind == "sign":
            depth += (tokens[k].text in OPEN) - (tokens[k].text in CLOSE)
            if not depth:
                return k
    return len(tokens) - 1
