"""Call graphs from source code: Python by its syntax tree, TypeScript and JavaScript by a lexer.

Parsing is per file in Arrow batches; keys and callees are then resolved with
joins (see ``operators.callgraph``). The lexer for TypeScript and JavaScript
knows declarations, methods, function expressions, arrow functions and calls by
name. As in the published behaviour arrow functions, and function expressions
without a name of their own, are anonymous. It doesn't know types, so a call
resolves by name alone: to a function of the same file first, else to the first
that bears the name.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import callgraph as C
from lodestrata.sources.files import walk

_NAME = r"[A-Za-z_$][\w$]*"
#: Declarations of a script: functions and function expressions, arrow functions (named by what they are assigned to, or
#: not at all), classes, methods.
_TS = re.compile(
    rf"(?P<fn>\bfunction\b\s*\*?\s*(?P<fname>{_NAME})?\s*(?:<[^>(]*>)?\()"
    rf"|(?P<arrow>(?:\([^()]*\)|(?<![\w$.]){_NAME})\s*(?::\s*[^=;{{}}()]+)?=>)"
    rf"|(?P<cls>\bclass\s+(?P<cname>{_NAME}))"
    rf"|(?P<method>^[ \t]+(?:public |private |protected |static |async |readonly |override |get |set )*\*?(?P<mname>#?{_NAME})\s*(?:<[^>(]*>)?\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?::[^{{;=]+)?\{{)",
    re.M,
)
_ACCESSOR = re.compile(r"\b[gs]et\s+#?[A-Za-z_$][\w$]*\s*\(")
#: What stands before a function that is an expression.
_EXPRESSION = re.compile(r"(?:[=(,:?&|\[!]|\breturn|=>)\s*(?:async\s+)?\Z")
ANONYMOUS = "<anonymous>"
_CALL = re.compile(r"(?:\.|\b)([A-Za-z_$][\w$]*)\s*\(")
_WORDS = frozenset("if for while switch catch return function typeof await new super import constructor".split())


def python_functions(source: str) -> list[tuple[str, list[str], int, int]]:
    """(name with classes, called names in order, first line, last line); nothing for text that doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found: list[tuple[str, list[str], int, int]] = []

    def visit(node: ast.AST, scope: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                names = []
                for call in ast.walk(child):
                    if isinstance(call, ast.Call):
                        f = call.func
                        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                        if name and name not in names:
                            names.append(name)
                found.append((".".join([*scope, child.name]), names, child.lineno, child.end_lineno or child.lineno))
                visit(child, [*scope, child.name])
            else:
                visit(child, [*scope, child.name] if isinstance(child, ast.ClassDef) else scope)

    visit(tree, [])
    return found


def script_functions(source: str) -> list[tuple[str, list[str], int, int]]:
    """As ``python_functions`` for TypeScript and JavaScript; bodies end where their braces close."""
    clean = re.sub(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", lambda m: re.sub(r"[^\n]", " ", m.group()), source, flags=re.S)
    found: list[tuple[int, tuple[str, list[str], int, int]]] = []
    classes: list[tuple[str, int]] = []

    def close(at: int) -> int:
        depth = 0
        for i in range(at, len(clean)):
            if clean[i] == "{":
                depth += 1
            elif clean[i] == "}":
                depth -= 1
                if depth == 0:
                    return i
        return len(clean) - 1

    line_of = lambda at: clean.count("\n", 0, at) + 1
    def expression_end(at: int) -> int:
        depth = 0
        for i in range(at, len(clean)):
            c = clean[i]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth < 0:
                    return i - 1
            elif depth == 0 and c in ",;":
                return i - 1
            elif depth == 0 and c == "\n" and not re.match(r"\s*[.?:&|+\-*/)\]]", clean[i:]):
                return i - 1
        return len(clean) - 1

    for m in _TS.finditer(clean):
        if m["cls"]:
            brace = clean.find("{", m.end())
            if brace >= 0:
                classes.append((m["cname"], close(brace)))
            continue
        if m["method"] and (m["mname"] in _WORDS or _ACCESSOR.search(m.group())):
            continue
        if m["arrow"]:
            # a block, or an expression up to the end of its statement or list
            rest = re.match(r"\s*", clean[m.end() :]).end() + m.end()
            end = close(rest) if clean[rest : rest + 1] == "{" else expression_end(rest)
            name = ANONYMOUS
        else:
            brace = clean.find("{", m.end() - 1 if m["method"] else m.end())
            end = close(brace) if brace >= 0 else len(clean) - 1
            name = m["fname"] or m["mname"] or ANONYMOUS
        calls = [c for c in dict.fromkeys(_CALL.findall(clean[m.end() : end + 1])) if c not in _WORDS]
        owner = next((c for c, last in reversed(classes) if m.start() < last), None) if m["method"] else None
        kind = 1 if m["method"] else 2 if m["arrow"] else 3 if _EXPRESSION.search(clean, max(0, m.start() - 40), m.start()) else 0
        found.append((kind, (f"{owner}.{name}" if owner else name, calls, line_of(m.start() + len(m.group()) - len(m.group().lstrip())), line_of(min(end, len(clean))))))
    # declared functions first, then methods, arrow functions and function expressions; so repeated keys are numbered
    return [f for _, f in sorted(found, key=lambda x: x[0])]


def extract(files: DataFrame, root: str) -> DataFrame:
    """``functions`` of ``files`` (path, text): unique keys, callees resolved by name where one is known."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = root.rstrip("/") + "/"
        for part in parts:
            rows = []
            for path, text, no in zip(part["path"], part["text"], part["file_no"]):
                parse = python_functions if path.endswith(".py") else script_functions
                module = re.sub(r"\.(?:[tj]sx?|[mc]js|py)$", "", path.removeprefix(base)).replace("/", ".")
                rows += [(f"{module}.{name}", path, calls, first, last, (int(no) << 20) + i) for i, (name, calls, first, last) in enumerate(parse(text or ""))]
            yield pd.DataFrame(rows, columns=["key", "filepath", "callees", "lineno", "end_lineno", "ord"])

    raw = files.mapInPandas(run, "key string, filepath string, callees array<string>, lineno int, end_lineno int, ord bigint")
    return C.resolve_names(C.unique_keys(raw))


def repository_functions(spark: SparkSession, root: str, language: str = "python") -> DataFrame:
    """The call graph of a repository's Python, or TypeScript and JavaScript, files."""
    endings = [".py"] if language == "python" else [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
    return extract(walk(spark, root).where(T.extension("path").isin(endings)).select("path", "text", "file_no"), root)


def functions_json(spark: SparkSession, path: str) -> DataFrame:
    """A call graph stored as one JSON object from key to function."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    rows = [(k, v.get("filepath"), list(v.get("callees") or []), v.get("lineno"), v.get("end_lineno"), i) for i, (k, v) in enumerate(data.items())]
    return spark.createDataFrame(rows, "key string, filepath string, callees array<string>, lineno int, end_lineno int, ord bigint")
