"""Entities and imports of source files in seven languages, line by line; Python by its own syntax tree where it parses."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: By language: (pattern, kind) of lines that define an entity; group 1 is its name. Imports have the kind 'import' and group 1 their source.
_ID = r"([A-Za-z_$][A-Za-z0-9_$]*)"
_RUST = r"^\s*(?:pub(?:\([^)]*\))?\s+)?"
_JS = r"^\s*(?:export\s+)?(?:default\s+)?"
_ACCESS = r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|readonly)\s+)*"
RULES: dict[str, list[tuple[str, str]]] = {
    "rust": [(_RUST + r"(?:async\s+|unsafe\s+|const\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+" + _ID, "function"), (_RUST + r"struct\s+" + _ID, "struct"), (_RUST + r"enum\s+" + _ID, "enum"), (_RUST + r"trait\s+" + _ID, "trait"),
             (_RUST + r"type\s+" + _ID, "type"), (_RUST + r"(?:const|static)\s+(?:mut\s+)?" + _ID + r"\s*:", "constant"), (r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?" + _ID, "impl"), (_RUST + r"use\s+([^;]+);", "import"), (_RUST + r"mod\s+" + _ID + r"\s*;", "import")],
    "python": [(r"^\s*class\s+" + _ID, "class"), (r"^\s*(?:async\s+)?def\s+" + _ID, "function"), (r"^" + _ID + r"\s*(?::[^=]+)?=(?!=)", "constant"), (r"^\s*import\s+(.+)$", "import"), (r"^\s*(from\s+\S+\s+import\s+.+)$", "import")],
    "go": [(r"^func\s+(?:\([^)]*\)\s*)?" + _ID, "function"), (r"^type\s+" + _ID + r"\s+struct\b", "struct"), (r"^type\s+" + _ID + r"\s+interface\b", "interface"), (r"^type\s+" + _ID, "type"), (r"^(?:const)\s+" + _ID, "constant"), (r"^(?:var)\s+" + _ID, "variable"), (r"^(?:import\s+(?:\w+\s+)?|\s+(?:\w+\s+)?)\"([^\"]+)\"\s*$", "import")],
    "javascript": [(_JS + r"class\s+" + _ID, "class"), (_JS + r"(?:async\s+)?function\s*\*?\s*" + _ID, "function"), (_JS + r"(?:const|let|var)\s+" + _ID + r"\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", "function"), (_JS + r"(?:const|let|var)\s+" + _ID, "variable"), (r"^\s*(?:import|export)\s.*?from\s+['\"]([^'\"]+)['\"]", "import"), (r"^\s*import\s+['\"]([^'\"]+)['\"]", "import")],
    "java": [(_ACCESS + r"class\s+" + _ID, "class"), (_ACCESS + r"@?interface\s+" + _ID, "interface"), (_ACCESS + r"enum\s+" + _ID, "enum"), (_ACCESS + r"record\s+" + _ID, "class"), (_ACCESS + r"(?:<[^>]+>\s+)?[\w<>\[\], .]+\s+" + _ID + r"\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{?\s*$", "function"), (r"^\s*import\s+(?:static\s+)?([^;]+);", "import")],
    "csharp": [(_ACCESS + r"class\s+" + _ID, "class"), (_ACCESS + r"interface\s+" + _ID, "interface"), (_ACCESS + r"struct\s+" + _ID, "struct"), (_ACCESS + r"enum\s+" + _ID, "enum"), (_ACCESS + r"record\s+" + _ID, "class"), (r"^\s*namespace\s+([\w.]+)", "module"), (_ACCESS + r"[\w<>\[\], .?]+\s+" + _ID + r"\s*\([^;]*\)\s*(?:=>.*|\{)?\s*$", "function"), (r"^\s*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", "import")],
}
RULES["typescript"] = [(_JS + r"(?:declare\s+)?interface\s+" + _ID, "interface"), (_JS + r"(?:declare\s+)?type\s+" + _ID + r"\b.*=", "type"), (_JS + r"(?:declare\s+)?(?:const\s+)?enum\s+" + _ID, "enum"), (_JS + r"abstract\s+class\s+" + _ID, "class"), *RULES["javascript"]]
_COMPILED = {k: [(re.compile(p), kind) for p, kind in v] for k, v in RULES.items()}
_WORDS = {"if", "for", "while", "switch", "return", "catch", "else", "new", "throw", "using", "lock", "foreach", "do", "try"}
_VISIBLE = re.compile(r"^\s*(pub(?:\([^)]*\))?|public|private|protected|internal|export)\b")
_DOC = re.compile(r"^\s*(?:///|//!|//|#(?!\[)|\*)\s?(.*)$")
Entity = tuple[str, str, int, int, str | None, str, str | None]


def _end(lines: list[str], i: int, braces: bool) -> int:
    """The last line of an entity: where its braces close, else where its indentation ends."""
    if braces:
        depth, seen = 0, False
        for j in range(i, len(lines)):
            depth += lines[j].count("{") - lines[j].count("}")
            seen |= "{" in lines[j]
            if (seen and depth <= 0) or (not seen and ";" in lines[j]):
                return j + 1
        return i + 1 if not seen else len(lines)
    indent, last = len(lines[i]) - len(lines[i].lstrip()), i
    for j in range(i + 1, len(lines)):
        if lines[j].strip():
            if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                break
            last = j
    return last + 1


def _doc(lines: list[str], i: int, most: int = 3) -> str | None:
    """Comment lines right above line i, blanks and attributes skipped for up to three lines."""
    j = i - 1
    while j >= 0 and i - j <= most and (not lines[j].strip() or lines[j].lstrip().startswith(("#[", "@", "["))):
        j -= 1
    out = []
    while j >= 0 and (m := _DOC.match(lines[j])):
        out.append(m[1].strip())
        j -= 1
    return "\n".join(reversed(out)) or None


def by_lines(source: str, language: str) -> tuple[list[Entity], list[tuple[str, str | None, int]]]:
    entities, imports = [], []
    lines = source.replace("\r", "").split("\n")
    for i, line in enumerate(lines):
        for pattern, kind in _COMPILED.get(language, ()):
            if m := pattern.match(line):
                if kind == "import":
                    what, _, alias = m[1].strip().partition(" as ") if not m[1].startswith("from ") else (m[1].strip(), "", "")
                    imports.append((what.strip(), alias.strip() or None, i + 1))
                elif m[1] not in _WORDS and line.split("(")[0].split()[0] not in _WORDS:
                    seen = _VISIBLE.match(line)
                    end = _end(lines, i, language != "python") if kind not in ("constant", "variable") else i + 1
                    entities.append((m[1], kind, i + 1, end, _doc(lines, i), re.split(r"[{;]|:\s*$", line)[0].strip(), seen[1] if seen else None))
                break
    return entities, imports


def by_syntax(source: str) -> tuple[list[Entity], list[tuple[str, str | None, int]]]:
    """Python by its syntax tree; raises SyntaxError."""
    tree, lines = ast.parse(source), source.split("\n")
    entities, imports = [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            entities.append((node.name, kind, node.lineno, node.end_lineno, ast.get_docstring(node), lines[node.lineno - 1].strip().rstrip(":"), None))
        elif isinstance(node, ast.Import):
            imports += [(a.name, a.asname, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append((ast.get_source_segment(source, node), None, node.lineno))
    for node in tree.body:
        if isinstance(node, ast.Assign | ast.AnnAssign):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name):
                    entities.append((t.id, "constant", node.lineno, node.end_lineno, None, lines[node.lineno - 1].strip(), None))
    return sorted(entities, key=lambda e: e[2:4]), sorted(imports, key=lambda e: e[2])


def parse_source(source: str, language: str) -> tuple[list[Entity], list[tuple[str, str | None, int]]]:
    if language == "python":
        try:
            return by_syntax(source)
        except (SyntaxError, ValueError):
            pass
    return by_lines(source, language)


_ENTITY = "name string, kind string, line_start int, line_end int, doc string, signature string, visibility string"


def entities(files: DataFrame) -> DataFrame:
    """(path, pos, name, kind, line_start, line_end, doc, signature, visibility) of files (path, language, source)."""
    return _rows(files, 0, f"path string, pos int, {_ENTITY}")


def imports(files: DataFrame) -> DataFrame:
    """(path, pos, source, alias, line) of files (path, language, source)."""
    return _rows(files, 1, "path string, pos int, source string, alias string, line int")


def _rows(files: DataFrame, which: int, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, *e) for p, lang, s in zip(b["path"], b["language"], b["source"], strict=True) for i, e in enumerate(parse_source(s or "", lang)[which])]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "language", "source").mapInPandas(run, schema)
