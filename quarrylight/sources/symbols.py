"""Symbols and imports of source files.

Python is read by its own parser, the brace languages by line patterns with brace matching, the rest by line patterns.
Both run per Arrow batch and emit flat rows: symbols(path, name, kind, line, end_line, signature, parent_name, depth).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import ship

SCHEMA = "path string, name string, kind string, line int, end_line int, signature string, parent_name string, depth int"
MAX_DEPTH, SIGNATURE_BYTES = 3, 150
_N = r"([A-Za-z_$][\w$]*)"
_TS = [
    ("function", rf"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_N}"),
    ("class", rf"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_N}"),
    ("interface", rf"^(?:export\s+)?interface\s+{_N}"),
    ("enum", rf"^(?:export\s+)?(?:const\s+)?enum\s+{_N}"),
    ("type", rf"^(?:export\s+)?type\s+{_N}\s*[=<]"),
    ("const", rf"^(?:export\s+)?(?:const|let|var)\s+{_N}"),
    ("method", rf"^(?!(?:if|for|while|switch|catch|return|function|new)\b)(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+|readonly\s+)*{_N}\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{{;]+)?\{{\s*(?:.*)$"),
]
_C_FUNCTION = r"^(?!(?:if|for|while|switch|return|else|do|typedef)\b)[A-Za-z_][\w\s*&:<>,~]*?[\s*&]([A-Za-z_~][\w:~]*)\s*\([^;]*$"
_MODIFIED = r"^(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|override|virtual|async|synchronized|default|open|data|inner|suspend|export|inline)\s+)*"
_MEMBER = _MODIFIED + r"(?!(?:if|for|while|switch|catch|return|else|new|throw|class|interface|enum|struct)\b)[\w<>\[\],.?\s]+?\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:throws\s+[\w,\s.]+)?\{?\s*$"
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "typescript": _TS,
    "javascript": [(k, p) for k, p in _TS if k not in ("interface", "enum", "type")],
    "rust": [(k, rf"^(?:pub(?:\([a-z: ]+\))?\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+\"C\"\s+)*{w}\s+{_N}") for k, w in (("function", "fn"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("module", "mod"))] + [("impl", r"^(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+([^{]+?)\s*(?:where\b.*)?\{"), ("macro", rf"^macro_rules!\s*{_N}")],
    "go": [("method", rf"^func\s+\([^)]*\)\s+{_N}"), ("function", rf"^func\s+{_N}"), ("type", rf"^type\s+{_N}")],
    "java": [(k, rf"{_MODIFIED}{k}\s+{_N}") for k in ("class", "interface", "enum")] + [("method", _MEMBER)],
    "csharp": [(k, rf"{_MODIFIED}{k}\s+{_N}") for k in ("class", "interface", "enum", "struct")] + [("method", _MEMBER)],
    "kotlin": [("function", rf"{_MODIFIED}fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{_N}"), ("class", rf"{_MODIFIED}(?:enum\s+)?(?:class|interface|object)\s+{_N}")],
    "php": [("function", rf"{_MODIFIED}function\s+&?{_N}"), *((k, rf"{_MODIFIED}{k}\s+{_N}") for k in ("class", "interface", "enum"))],
    "c": [("struct", rf"^(?:typedef\s+)?struct\s+{_N}\s*\{{?"), ("enum", rf"^(?:typedef\s+)?enum\s+{_N}\s*\{{?"), ("function", _C_FUNCTION)],
    "cpp": [("class", rf"^(?:template\s*<.*>\s*)?class\s+{_N}"), ("struct", rf"^(?:typedef\s+)?struct\s+{_N}"), ("enum", rf"^enum\s+(?:class\s+)?{_N}"), ("function", _C_FUNCTION)],
    "bash": [("function", r"^(?:function\s+)([\w:-]+)"), ("function", r"^([\w:-]+)\s*\(\)")],
    "ruby": [("function", r"^def\s+(?:self\.)?([\w?!=]+)"), ("class", r"^class\s+([\w:]+)"), ("module", r"^module\s+([\w:]+)")],
    "css": [("media", r"^(@media[^{]*?)\s*\{"), ("keyframes", r"^@keyframes\s+([\w-]+)"), ("rule", r"^([^@{}/][^{}]*?)\s*\{")],
    "html": [("script", r"^<(script)\b"), ("style", r"^<(style)\b"), ("element", r"^<([a-z][\w-]*)\b")],
}
LANGUAGE = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "sh": "bash", "bash": "bash", "zsh": "bash", "rb": "ruby", "php": "php", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "html": "html", "htm": "html", "css": "css"}
_COMPILED = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in PATTERNS.items()}
FALLBACK = [("function", re.compile(rf"^(?:export\s+)?(?:pub\s+)?(?:async\s+)?(?:function|fn|def|func)\s+{_N}")), ("class", re.compile(rf"^(?:export\s+)?(?:pub\s+)?(?:abstract\s+)?(?:class|struct|interface|trait)\s+{_N}")), ("enum", re.compile(rf"^(?:export\s+)?(?:pub\s+)?enum\s+{_N}"))]


def _signature(line: str) -> str:
    raw = line.strip().encode()
    return raw.decode() if len(raw) <= SIGNATURE_BYTES else raw[:SIGNATURE_BYTES].decode("utf-8", "ignore") + "..."


def _bare(line: str) -> str:
    """A line without strings and comments, for counting braces."""
    return re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|`(?:\\.|[^`\\])*`|//.*|/\*.*?\*/', "", line)


def block_end(lines: list[str], start: int) -> int:
    """1-based line where the braces opened from a 0-based line on are closed; that line itself if none opens."""
    depth, opened = 0, False
    for i in range(start, len(lines)):
        for c in _bare(lines[i]):
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
        if opened and depth <= 0:
            return i + 1
        if not opened and (i > start + 3 or _bare(lines[i]).rstrip().endswith(";")):
            return start + 1
    return len(lines) if opened else start + 1


def _python(content: str) -> list[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return []
    lines, out = content.splitlines(), []

    def walk(node: ast.AST, parent: str | None, depth: int) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                out.append((x.name, "class" if isinstance(x, ast.ClassDef) else "function", x.lineno, x.end_lineno, _signature(lines[x.lineno - 1]), parent, depth))
                if depth + 1 < MAX_DEPTH:
                    walk(x, x.name, depth + 1)
            else:
                walk(x, parent, depth)

    walk(tree, None, 0)
    return out


def _ruby_end(lines: list[str], start: int) -> int:
    indent = len(lines[start]) - len(lines[start].lstrip())
    return next((i + 1 for i in range(start + 1, len(lines)) if re.match(r"\s*end\b", lines[i]) and len(lines[i]) - len(lines[i].lstrip()) <= indent), start + 1)


def symbols_of(content: str, language: str | None) -> list[tuple]:
    """(name, kind, line, end_line, signature, parent_name, depth) in order."""
    if language == "python":
        return _python(content)
    patterns = _COMPILED.get(language or "", FALLBACK if language is None else [])
    lines, out, open_ = content.split("\n"), [], []
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line or line.startswith(("//", "*", "/*")) or line.startswith("#") and language not in ("css", "c", "cpp"):
            continue
        while open_ and open_[-1][1] <= i:
            open_.pop()
        for kind, p in patterns:
            m = p.match(line)
            if not m or kind == "method" and language in ("typescript", "javascript") and not open_:
                continue
            if kind == "const" and open_ and language in ("typescript", "javascript"):
                break
            end = _ruby_end(lines, i) if language == "ruby" else block_end(lines, i)
            if len(open_) < MAX_DEPTH:
                out.append((m[1].strip(), kind, i + 1, max(end, i + 1), _signature(line), open_[-1][0] if open_ else None, len(open_)))
            if end > i + 1:
                open_.append((m[1].strip(), end))
            break
    return out


def symbols(content: DataFrame, *, fallback: bool = False) -> DataFrame:
    """symbols of content(path, content); with fallback, unknown extensions are read by the plain patterns."""
    ship(content.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lang = LANGUAGE.get((path or "").rsplit(".", 1)[-1].lower())
                if text and (lang or fallback):
                    rows += [(path, *x) for x in symbols_of(text, lang)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return content.select("path", "content").mapInArrow(run, SCHEMA)


_ES = r"""(?m)^\s*(?:import|export)\s+(?!type\b)(?:[^'"`;]*?\sfrom\s+)?['"]([^'"]+)['"]"""
_CJS = r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""
_PY_IMPORT, _PY_FROM = r"(?m)^\s*import\s+([\w.]+)", r"(?m)^\s*from\s+([\w.]+)\s+import\b"
_RUST_USE, _GO = r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$"""


def imports(content: DataFrame) -> DataFrame:
    """(path, specifier) of every import that isn't for types only, by language."""
    from quarrylight.functions.text import extension

    found = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    ext = extension("path")
    script = ext.isin("ts", "tsx", "js", "jsx", "mjs", "cjs")
    specifiers = F.when(script, F.concat(found(_ES), found(_CJS))).when(ext == "py", F.concat(found(_PY_IMPORT), found(_PY_FROM))).when(ext == "rs", found(_RUST_USE)).when(ext == "go", found(_GO))
    return content.select("path", F.explode(F.array_distinct(specifiers)).alias("specifier"))


def imports_fallback(content: DataFrame) -> DataFrame:
    """(path, specifier) by all five patterns, whatever the language."""
    found = [F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in (_ES, _CJS, _PY_IMPORT, _PY_FROM, _RUST_USE)]
    return content.select("path", F.explode(F.array_distinct(F.concat(*found))).alias("specifier"))


def normalised_path(path):
    """A column without ``.`` and ``..`` segments."""
    step = lambda a, s: F.when((s == ".") | (s == ""), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".py", ".rs", "/index.ts", "/index.tsx", "/index.js", "/__init__.py"]


def resolved(found: DataFrame, files: DataFrame) -> DataFrame:
    """imports(src, dst): relative specifiers resolved to files, the first suffix that exists wins."""
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    target = F.when(F.col("specifier").startswith("."), F.when(F.col("path").endswith(".py"), F.concat(folder, F.translate(F.regexp_replace("specifier", r"^\.", ""), ".", "/"))).otherwise(F.concat(folder, F.col("specifier")))).when(F.col("path").endswith(".py"), F.translate("specifier", ".", "/"))
    rows = found.where("specifier is not null").withColumn("base", normalised_path(target)).where("base is not null and base <> ''")
    tried = rows.select(F.col("path").alias("src"), "specifier", "base", F.posexplode(F.array(*map(F.lit, SUFFIXES))).alias("prio", "suffix")).withColumn("dst", F.concat("base", "suffix"))
    hits = tried.join(files.select(F.col("path").alias("dst")), "dst", "left_semi")
    return hits.groupBy("src", "specifier").agg(F.min_by("dst", "prio").alias("dst")).select("src", "dst").distinct()
