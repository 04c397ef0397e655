"""What a source file declares, told from its tokens: imports, exported names, tests and size metrics. Each function takes a text and a language and returns rows."""

from __future__ import annotations

from tessera.functions.lexer import OPEN, Token, closing, code, lex

JS = ("javascript", "typescript", "tsx")


def _text_of(tokens: list[Token]) -> str:
    return "".join((" " if t.text == "as" or k and tokens[k - 1].text == "as" else "") + t.text for k, t in enumerate(tokens))


def _unquoted(s: str) -> str:
    return s.strip().strip("'\"`")


def imports(text: str, language: str) -> list[tuple[int, str, str]]:
    """(line, specifier, kind) of every declaration that names another file or package, in order."""
    t, out = code(lex(text, language)), []
    for k, x in enumerate(t):
        after = t[k + 1] if k + 1 < len(t) else Token("sign", "", 0, 0, 0)
        ahead = t[k - 1].text if k else ""
        if language == "rust":
            if x.text == "mod" and after.kind == "name" and k + 2 < len(t) and t[k + 2].text == ";":
                out.append((x.line, after.text, "rust-mod"))
            elif x.text == "use" and ahead in ("", ";", "}", "{", "pub", ")", "]"):
                stop = next((j for j in range(k, len(t)) if t[j].text == ";"), len(t))
                root = _text_of(t[k + 1 : stop]).split("::{")[0].split(" as ")[0].strip()
                if root:
                    out.append((x.line, root, "rust-use"))
            elif x.text == "extern" and after.text == "crate" and k + 2 < len(t):
                out.append((x.line, t[k + 2].text, "rust-extern-crate"))
        elif language == "python":
            first = not k or t[k - 1].end_line < x.line or ahead in (";", ":")
            if first and x.text == "import":
                end = next((j for j in range(k + 1, len(t)) if t[j].line > x.line or t[j].text == ";"), len(t))
                names, fresh = [], True
                for j in range(k + 1, end):
                    if t[j].text == ",":
                        fresh = True
                    elif fresh and t[j].text != "as" and (t[j].kind == "name" or t[j].text == "."):
                        if t[j - 1].text in (",", "import"):
                            names.append(t[j].text)
                        elif names:
                            names[-1] += t[j].text
                    else:
                        fresh = False
                out += [(x.line, n, "python-import") for n in names]
            elif first and x.text == "from":
                end = next((j for j in range(k, len(t)) if t[j].text == "import"), None)
                if end is not None and end > k + 1:
                    out.append((x.line, "".join(y.text for y in t[k + 1 : end]), "python-from"))
        elif language in JS:
            if x.text in ("require", "import") and after.text == "(" and ahead != "." and k + 2 < len(t) and t[k + 2].kind == "string":
                out.append((x.line, _unquoted(t[k + 2].text), "js-require" if x.text == "require" else "js-dynamic-import"))
            elif x.text in ("import", "export") and ahead != "." and after.text != "(":
                kind = "js-import" if x.text == "import" else "js-export-from"
                if x.text == "import" and after.kind == "string":
                    out.append((x.line, _unquoted(after.text), kind))
                    continue
                j = k + 1
                while j < len(t) and t[j].text != "from" and t[j].text not in (";", "=", "(", "class", "function", "const", "let", "var"):
                    j = closing(t, j) + 1 if t[j].text == "{" else j + 1
                if j + 1 < len(t) and t[j].text == "from" and t[j + 1].kind == "string":
                    out.append((x.line, _unquoted(t[j + 1].text), kind))
        elif language == "go" and x.text == "import":
            stop = closing(t, k + 1) if after.text == "(" else k + 3
            for y in t[k + 1 : min(stop, len(t))]:
                if y.kind == "string" and (after.text == "(" or y.line == x.line):
                    out.append((y.line, _unquoted(y.text), "go-import"))
    return sorted(out, key=lambda r: (r[0], r[2], r[1]))


def _documented(tokens: list[Token], k: int, language: str) -> bool:
    """Whether a documentation comment ends on the line ahead; attributes and decorators between do not count."""
    line, j = tokens[k].line, k - 1
    while j >= 0:
        t = tokens[j]
        if t.kind != "comment":
            if language == "rust" and t.text == "]":
                depth = 0
                while j >= 0:
                    depth += (tokens[j].text == "]") - (tokens[j].text == "[")
                    if not depth:
                        break
                    j -= 1
                line, j = tokens[max(j - 1, 0)].line, j - 2
                continue
            return False
        marks = {"rust": ("///", "/**", "//!"), "go": ("//", "/*")}.get(language, ("/**",))
        return t.end_line >= line - 1 and t.text.startswith(marks)
    return False


RUST_ITEMS = {"fn": "function", "struct": "type", "enum": "type", "union": "type", "trait": "type", "type": "type", "const": "constant", "static": "constant", "mod": "module"}
JS_ITEMS = {"function": "function", "class": "type", "interface": "type", "type": "type", "enum": "type", "const": "constant", "let": "constant", "var": "constant", "namespace": "module"}


def exported(text: str, language: str) -> list[tuple[int, str, str, bool]]:
    """(line, name, kind, documented) of every public name of a file. Kinds: function, type, constant, module, reexport."""
    every = lex(text, language)
    t = [x for x in every if x.kind != "comment"]
    place = [k for k, x in enumerate(every) if x.kind != "comment"]
    depth, out = 0, []

    def add(k: int, name: str, kind: str) -> None:
        out.append((t[k].line, name, kind, _documented(every, place[k], language)))

    for k, x in enumerate(t):
        rest = [y.text for y in t[k + 1 : k + 9]]
        if language == "rust" and x.text == "pub" and rest[:1] != ["("]:
            j = next((j for j, w in enumerate(rest) if w not in ("async", "unsafe", "extern", "default") and not w.startswith('"') and not (w == "const" and rest[j + 1 : j + 2] in (["fn"], ["unsafe"], ["async"], ["extern"]))), None)
            word = rest[j] if j is not None else ""
            if word in RUST_ITEMS and j + 1 < len(rest):
                add(k, rest[j + 1] if rest[j + 1] != "mut" else rest[j + 2], RUST_ITEMS[word])
            elif word == "use":
                stop = next((i for i in range(k, len(t)) if t[i].text == ";"), len(t))
                add(k, _text_of(t[k + 2 : stop]), "reexport")
        elif language in JS and x.text == "export" and not depth:
            words = [w for w in rest if w not in ("default", "declare", "abstract", "async")]
            if words[:1] == ["{"]:
                stop = closing(t, k + 1 + rest.index("{"))
                inner = [y.text for y in t[k + 2 + rest.index("{") : stop]]
                names, fresh = [], True
                for i, w in enumerate(inner):
                    if w == ",":
                        fresh = True
                    elif w == "as" and i + 1 < len(inner):
                        names[-1:] = [inner[i + 1]]
                        fresh = False
                    elif fresh and w != "type":
                        names.append(w)
                        fresh = False
                for n in names:
                    add(k, n, "reexport")
            elif words[:1] == ["*"]:
                add(k, "*", "reexport")
            elif words and words[0] in JS_ITEMS:
                name = next((w for w in words[1:] if w != "*"), "default")
                add(k, name if name[:1].isidentifier() or name[:1] in "$_" else "default", JS_ITEMS[words[0]])
            elif "default" in rest[:1]:
                add(k, "default", "constant")
        elif language == "go" and not depth and x.column == 0 and x.text in ("func", "type", "const", "var"):
            if x.text == "func":
                j = closing(t, k + 1) + 1 if rest[:1] == ["("] else k + 1
                if j < len(t) and t[j].text[:1].isupper():
                    add(k, t[j].text, "function")
            elif rest[:1] == ["("]:
                stop, deep = closing(t, k + 1), 0
                for j in range(k + 2, stop):
                    deep += (t[j].text in OPEN) - (t[j].text in ")]}")
                    if not deep and t[j].kind == "name" and t[j].line > t[j - 1].end_line and t[j].text[:1].isupper():
                        add(j, t[j].text, "type" if x.text == "type" else "constant")
            elif rest and rest[0][:1].isupper():
                add(k, rest[0], "type" if x.text == "type" else "constant")
        elif language == "python" and x.column == 0:
            word = rest[0] if x.text == "async" and rest else x.text
            name = (rest[1] if x.text == "async" and len(rest) > 1 else rest[0]) if rest else ""
            if word in ("def", "class") and name and not name.startswith("_"):
                j = k
                while j < len(t) and not (t[j].text == ":" and not nested):
                    nested = (nested if j > k else 0) + (t[j].text in OPEN) - (t[j].text in ")]}")
                    j += 1
                doc = j + 1 < len(t) and t[j + 1].kind == "string"
                out.append((x.line, name, "function" if word == "def" else "type", doc))
            elif x.kind == "name" and x.text.isupper() and rest[:1] in (["="], [":"]):
                out.append((x.line, x.text, "constant", _documented(every, place[k], language)))
        depth += (x.text in OPEN) - (x.text in (")", "]", "}")) if x.kind == "sign" else 0
    return out


PY_SKIPS = ("skip", "skipif", "skipUnless", "skipIf", "xfail")


def tests(text: str, language: str) -> tuple[list[tuple[int, str, bool]], int]:
    """(line, name, ignored) of every test case, and the number of assertions of the file."""
    t, cases, checks = code(lex(text, language)), [], 0
    skipped: list[int] = []  # ends of suites that are skipped as a whole
    for k, x in enumerate(t):
        rest = [y.text for y in t[k + 1 : k + 4]] + [""] * 3
        skipped = [e for e in skipped if e >= k]
        if language == "rust":
            if x.text.startswith(("assert", "debug_assert")) and rest[0] == "!":
                checks += 1
            if x.text == "fn" and x.kind == "name":
                j, marks = k - 1, []
                while j >= 0 and t[j].text not in ("}", ";", "{"):
                    marks.append(t[j].text)
                    j -= 1
                marks = marks[::-1]
                if any(m == "test" and marks[i + 1 : i + 2] in (["]"], ["("]) for i, m in enumerate(marks)):
                    cases.append((x.line, rest[0], "ignore" in marks))
        elif language == "python":
            if x.kind == "name" and (x.text == "assert" and (not k or t[k - 1].text != ".") or x.text.startswith("assert") and k and t[k - 1].text == "." and rest[0] == "(" or x.text == "raises" and rest[0] == "("):
                checks += 1
            if x.text == "def" and rest[0].startswith("test"):
                j, marks = k - 1, []
                while j >= 0 and (t[j].column > x.column or t[j].text == "@" or t[j].text == "async") and len(marks) < 200:
                    marks.append(t[j].text)
                    if t[j].text == "@" and t[j].column == x.column and (not j or t[j - 1].text != ")" and t[j - 1].column < x.column):
                        break
                    j -= 1
                cases.append((x.line, rest[0], "@" in marks and any(m in PY_SKIPS for m in marks)))
        elif language in JS:
            if x.text in ("expect", "assert") and (rest[0] == "(" or x.text == "assert" and rest[0] == "."):
                checks += 1
            if k and t[k - 1].text == ".":
                continue
            call = rest[0] == "(" or rest[0] == "." and rest[2] == "("
            off = x.text in ("xit", "xtest", "xdescribe") or rest[0] == "." and rest[1] in ("skip", "todo")
            if call and x.text in ("describe", "suite", "xdescribe") and off:
                skipped.append(closing(t, k + 1 if rest[0] == "(" else k + 3))
            elif call and x.text in ("it", "test", "xit", "xtest") and (rest[0] == "(" or rest[1] in ("skip", "only", "todo", "each", "concurrent")):
                at = k + 2 if rest[0] == "(" else k + 4
                name = _unquoted(t[at].text) if at < len(t) and t[at].kind == "string" else ""
                cases.append((x.line, name, off or bool(skipped)))
        elif language == "go":
            if x.text == "func" and x.column == 0 and rest[0].startswith(("Test", "Benchmark", "Fuzz", "Example")) and rest[1] == "(":
                stop = next((j for j in range(k, len(t)) if t[j].text == "{"), k)
                body = t[stop : closing(t, stop)]
                cases.append((x.line, rest[0], any(y.text in ("Skip", "SkipNow", "Skipf") for y in body)))
            if x.text in ("Error", "Errorf", "Fatal", "Fatalf", "Fail", "FailNow") and k > 1 and t[k - 1].text == "." and t[k - 2].text in ("t", "b", "f", "tb"):
                checks += 1
            elif k > 1 and t[k - 1].text == "." and t[k - 2].text in ("assert", "require") and rest[0] == "(":
                checks += 1
    return cases, checks


BRANCHES = {"rust": {"if", "while", "for", "match", "loop"}, "go": {"if", "for", "switch", "select"}, "python": {"if", "elif", "for", "while", "except", "match"}, "javascript": {"if", "for", "while", "switch", "catch"}}
DECISIONS = {"rust": {"if", "while", "for", "=>", "?", "&&", "||"}, "go": {"if", "for", "case", "&&", "||"}, "python": {"if", "elif", "for", "while", "except", "and", "or", "case"}, "javascript": {"if", "for", "while", "case", "catch", "&&", "||", "??", "?"}}
for _k in ("typescript", "tsx"):
    BRANCHES[_k], DECISIONS[_k] = BRANCHES["javascript"], DECISIONS["javascript"]


def measures(text: str, language: str) -> dict[str, int]:
    """Lines by kind, functions, arguments, exits, decisions (cyclomatic: one more for each function) and cognitive: each branch weighs 1 and its depth of braces or indentation."""
    every = lex(text, language)
    t = code(every)
    lines = text.count("\n") + (1 if text and not text.endswith("\n") else 0)
    with_code = {n for x in t for n in range(x.line, x.end_line + 1)}
    with_comment = {n for x in every if x.kind == "comment" for n in range(x.line, x.end_line + 1)}
    functions = exits = arguments = cognitive = 0
    depth, base = 0, 0
    word = {"rust": "fn", "go": "func", "python": "def"}.get(language, "function")
    for k, x in enumerate(t):
        if language == "python":
            depth = x.column // 4
        elif x.kind == "sign":
            depth += (x.text == "{") - (x.text == "}")
        if x.kind == "name" and x.text == word or language in JS and x.text == "=>":
            functions, base = functions + 1, depth + 1
            a = next((j for j in range(k, min(k + 40, len(t))) if t[j].text == "("), None) if x.text != "=>" else None
            if a is not None:
                b, deep, parts = closing(t, a), 0, 0
                for y in t[a + 1 : b]:
                    deep += (y.text in OPEN) - (y.text in (")", "]", "}"))
                    parts += y.text == "," and not deep
                arguments += parts + (b > a + 1 and t[b - 1].text != ",")
        if x.kind == "name" and x.text in ("return", "throw", "raise"):
            exits += 1
        if x.kind == "name" and x.text in BRANCHES[language]:
            cognitive += 1 + max(0, depth - base)
    return {
        "lines": lines, "sloc": len(with_code), "cloc": len(with_comment), "blank": lines - len(with_code | with_comment), "functions": functions, "arguments": arguments, "exits": exits,
        "cyclomatic": functions + sum(x.text in DECISIONS[language] for x in t if x.kind != "string"), "cognitive": cognitive,
    }
