"""Text scalars as column expressions: tokenising, headers, snippets, globs, usage patterns, classifiers.

Everything here stays inside whole-stage code generation. Each function takes columns or column names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Fixed values.
IGNORED_DIRS = ["node_modules", ".git", "dist", "build", ".next", "target", ".svn", ".hg", "__pycache__", ".DS_Store", ".nuxt", ".mcp_data", ".mcp-shadow-history", "coverage", ".cache", ".turbo", ".parcel-cache", "vendor", "_build", "obj", "__snapshots__", "htmlcov", "venv"]
IGNORED_FILES = ["package-lock.json", "pnpm-lock.yaml", "npm-shrinkwrap.json"]
IGNORED_SUFFIXES = [".map", ".min.js", ".min.css", ".min.mjs", ".bundle.js", ".bundle.mjs", ".lockb", "_pb.ts", "_pb.js", "_pb.d.ts", ".pb.go", ".pb.cc", ".pb.h", ".connect.ts", ".connect.js", ".snap"]
TEXT_EXTENSIONS = [".md", ".txt", ".json", ".jsonc", ".geojson", ".csv", ".tsv", ".ndjson", ".yaml", ".yml", ".toml", ".lock", ".env"]
NAVIGATE_EXTENSIONS = ["rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "java", "c", "cpp", "h", "hpp", "cc", "rb", "sh", "bash", "zsh", "sql", "graphql", "proto", "yaml", "yml", "toml", "json"]
LANGUAGE_OF = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "rs": "rust", "go": "go", "java": "java", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "rb": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "lua": "lua", "zig": "zig", "sh": "bash", "bash": "bash", "zsh": "bash", "php": "php", "html": "html", "htm": "html", "css": "css", "toml": "toml", "yaml": "yaml", "yml": "yaml"}
LAYERS = [("delivery/http", "HTTP routes"), ("delivery/temporal", "Temporal workflows"), ("delivery/nats", "NATS consumers"), ("repository/pg", "database queries"), ("repository", "data access"), ("service", "business logic"), ("domain", "domain models"), ("delivery", "API delivery"), ("test/integration", "integration tests"), ("tests/integration", "integration tests")]
LABEL_STOP_WORDS = [
    "from", "with", "this", "that", "have", "been", "will", "each", "then", "than", "some", "only", "also", "into", "more", "most", "such", "used", "uses", "using", "file", "files", "type", "types", "data", "code",
    "package", "generated", "module", "index", "export", "header", "description", "param", "parameter", "syntax", "import", "const", "function", "interface", "class", "async", "await", "return", "string", "number", "boolean",
    "undefined", "null", "void", "true", "false", "todo", "fixme", "note", "hack", "section", "default", "config", "options", "settings", "props", "state", "action", "reducer", "store",
    "error", "event", "handler", "callback", "listener", "item", "items", "list", "array", "object", "value", "result", "response", "request",
]
TEST_ENDINGS = r"(\.test\.tsx?|\.spec\.tsx?|_test\.go|_test\.rs)$"
TEST_DIRS = ["/test/", "/tests/", "/__tests__/"]
FILE_TYPES = [(r"\.[tj]sx$", "components"), (r"\.proto$", "proto"), (r"\.sql$", "sql"), (r"\.go$", "go"), (r"\.rs$", "rust"), (r"\.json$", "json"), (r"\.ya?ml$", "yaml"), (r"\.s?css$", "css"), (r"\.schema\.[tj]s$", "schemas")]
API_DOMAIN = r"(?i:apiv1)([A-Za-z][^A-Z0-9.]*)"
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
NAVIGATE_CHARS = 500


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: ColumnLike) -> Column:
    """Lower-case ASCII words of two characters or more; camel case and acronyms are cut."""
    cut = F.regexp_replace(_c(text), "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.filter(F.split(F.lower(cut), "[^a-z0-9]+"), lambda x: F.length(x) > 1)


def tokens_of(text: str) -> list[str]:
    """The same for a literal on the driver."""
    cut = re.sub("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", text)
    return [x for x in re.split("[^a-z0-9]+", cut.lower()) if len(x) > 1]


def code_tokens(text: ColumnLike) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"[\p{IsAlphabetic}\p{N}_]+"), F.lit(0))


def search_text(path: ColumnLike, header: ColumnLike, symbols: ColumnLike, content: ColumnLike) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(_c(path), F.lit("")), F.coalesce(_c(header), F.lit("")), F.array_join(_c(symbols), " "), F.coalesce(_c(content), F.lit(""))))


def identifier_text(name: ColumnLike, kind: ColumnLike, signature: ColumnLike, path: ColumnLike, header: ColumnLike, parent: ColumnLike) -> Column:
    return F.concat_ws(" ", *(F.coalesce(_c(x), F.lit("")) for x in (name, kind, signature, path, header, parent)))


def lines(text: ColumnLike) -> Column:
    """Lines without their ends; the empty tail after a last line end doesn't count."""
    parts = F.split(_c(text), "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def code_header(text: ColumnLike) -> Column:
    """Up to two telling lines of the first ten, without comment marks."""
    stripped = F.transform(F.slice(lines(text), 1, 10), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:///?!?|/\*+|\*/?|#+|--|;+|<!--|\"\"\")\s*", "")))
    kept = F.filter(stripped, lambda x: (x != "") & ~x.startswith("!") & ~x.startswith("use ") & ~x.startswith("import "))
    return F.array_join(F.slice(kept, 1, 2), " | ")


def plain_header(text: ColumnLike) -> Column:
    """The first two lines that aren't blank, each cut to 120 characters."""
    kept = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(F.slice(kept, 1, 2), lambda x: F.substring(x, 1, 120)), " | ")


def leading_comment(text: ColumnLike, first: int = 5, limit: int = 200) -> Column:
    """The comment lines before anything else among the first few, in one line."""
    marked = F.transform(F.slice(lines(text), 1, first), lambda x: F.struct(F.trim(x).rlike(r"^(?://|#|/\*|\*|--|<!--)").alias("is"), F.trim(F.regexp_replace(F.trim(x), r"^(?:///?!?|#+!?|/\*+|\*+/?|--|<!--)\s*", "")).alias("s")))
    taken = F.aggregate(marked, F.struct(F.lit(True).alias("go"), F.lit("").alias("s")), lambda a, x: F.struct((a["go"] & x["is"]).alias("go"), F.when(a["go"] & x["is"], F.concat_ws(" ", F.when(a["s"] != "", a["s"]), x["s"])).otherwise(a["s"]).alias("s")))
    return F.substring(taken["s"], 1, limit)


def snippet(text: ColumnLike, line: ColumnLike, end_line: ColumnLike, most: int = 6) -> Column:
    """Up to ``most`` lines from a 1-based line on, not beyond end_line, with a mark if more follow; NULL if blank."""
    all_lines = lines(text)
    last = F.least(F.greatest(_c(line), _c(end_line)), F.size(all_lines))
    n = F.greatest(F.lit(0), F.least(F.lit(most), last - _c(line) + 1))
    body = F.array_join(F.slice(all_lines, _c(line), n), "\n")
    body = F.when(last - _c(line) + 1 > most, F.concat(body, F.lit("\n…"))).otherwise(body)
    return F.when(F.trim(F.regexp_replace(body, r"\s", "")) != "", body)


def fallback_snippet(text: ColumnLike, limit: int = 160) -> Column:
    return F.substring(F.try_element_at(F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)), 1, limit)


def location(name: ColumnLike, line: ColumnLike, end_line: ColumnLike) -> Column:
    return F.concat(_c(name), F.lit("@L"), _c(line).cast("string"), F.when(_c(end_line) > _c(line), F.concat(F.lit("-L"), _c(end_line).cast("string"))).otherwise(""))


def parse_location(text: ColumnLike) -> Column:
    pattern = r"^(.*)@L(\d+)(?:-L(\d+))?$"
    part = lambda k: F.regexp_extract(_c(text), pattern, k)
    return F.struct(part(1).alias("name"), part(2).try_cast("int").alias("line"), F.coalesce(part(3).try_cast("int"), part(2).try_cast("int")).alias("end_line"))


def glob_regex(glob: str) -> str:
    """``**`` crosses directories, ``*`` and ``?`` don't; everything else is literal; anchored."""
    out = ""
    for part in re.findall(r"\*\*/?|\*|\?|[^*?]+", glob):
        out += ".*" if part.startswith("**") else "[^/]*" if part == "*" else "[^/]" if part == "?" else re.escape(part)
    return f"^{out}$"


def matches_globs(path: ColumnLike, include: list[str], exclude: list[str]) -> Column:
    keep = F.lit(not include)
    for g in include:
        keep |= _c(path).rlike(glob_regex(g))
    for g in exclude:
        keep &= ~_c(path).rlike(glob_regex(g))
    return keep


def tracked(path: ColumnLike, ignored: list[str] = IGNORED_DIRS) -> Column:
    """No hidden or ignored segment, no lock file, no generated suffix."""
    segments = F.split(_c(path), "/")
    name = F.element_at(segments, -1)
    hidden = F.exists(segments, lambda s: s.startswith(".") | s.isin(*ignored))
    generated = F.lit(False)
    for s in IGNORED_SUFFIXES:
        generated |= name.endswith(s)
    return ~hidden & ~name.isin(*IGNORED_FILES) & ~generated


def extension(path: ColumnLike) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1))


def language(path: ColumnLike) -> Column:
    return F.create_map(*(F.lit(x) for kv in LANGUAGE_OF.items() for x in kv))[extension(path)]


def usage_regex(symbol: str) -> str:
    """The symbol with word borders where it begins or ends with a word character (Unicode, for Spark)."""
    head, tail = (r"\b" if re.match(r"\w", x) else "" for x in (symbol[:1], symbol[-1:]))
    return rf"(?U){head}\Q{symbol}\E{tail}"


def call_regex(symbol: str, kind: str) -> str:
    return usage_regex(symbol) + (r"\s*\(" if kind in ("function", "method") else "")


def definition_regex(symbol: str) -> str:
    """A line that defines the symbol."""
    before = r"^\s*(?:(?:export|default|pub(?:\([a-z]+\))?|async|static|public|private|protected|abstract|final|unsafe|declare)\s+)*"
    name = rf"\Q{symbol}\E"
    return rf"{before}(?:(?:function|class|interface|enum|type|struct|trait|impl|fn|def|func|mod|module|macro_rules!)\s*\*?\s+{name}(?:[(<\s:{{]|$)|(?:const|let|var|static)\s+{name}(?:[(<\s:{{=]|$))"


def is_test_file(path: ColumnLike) -> Column:
    p = _c(path)
    out = p.rlike(TEST_ENDINGS)
    for x in TEST_DIRS:
        out |= p.contains(x)
    return out


def file_type(path: ColumnLike) -> Column:
    p = _c(path)
    out = F.when(is_test_file(p), "tests")
    for pattern, name in FILE_TYPES:
        out = out.when(p.rlike(pattern), name)
    return out.otherwise("source")


def layer(path: ColumnLike) -> Column:
    out = F.when(F.lit(False), "")
    for prefix, name in LAYERS:
        out = out.when((_c(path) == prefix) | _c(path).startswith(prefix + "/"), name)
    return out.otherwise(_c(path))


def api_domain(name: ColumnLike) -> Column:
    found = F.lower(F.regexp_extract(_c(name), API_DOMAIN, 1))
    return F.when(F.length(found) >= 3, found)


def label_word(word: ColumnLike) -> Column:
    w = _c(word)
    return (F.length(w) >= 4) & w.rlike(r"^\p{IsAlphabetic}[\p{IsAlphabetic}\p{N}_-]*$") & ~F.lower(w).isin(*LABEL_STOP_WORDS)


def navigate_text(path: ColumnLike, header: ColumnLike, content: ColumnLike) -> Column:
    """What a file is embedded by for navigation: its path three times, its header and the start of its content."""
    return F.concat_ws(" ", _c(path), _c(path), _c(path), F.coalesce(_c(header), F.lit("")), F.substring(_c(content), 1, NAVIGATE_CHARS))


def fnv1a(text: ColumnLike) -> Column:
    """FNV-1a of the UTF-8 bytes, 64 bits as 16 hex digits. The product is taken in halves of 32 bits, which can't overflow."""
    raw, low = F.encode(_c(text), "UTF-8"), 0xFFFFFFFF
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint"))
    codes = F.when(F.octet_length(raw) > 0, codes).otherwise(F.expr("cast(array() as array<bigint>)"))
    start = F.struct(F.lit(FNV_BASIS >> 32).cast("bigint").alias("hi"), F.lit(FNV_BASIS & low).cast("bigint").alias("lo"))

    def step(h: Column, c: Column) -> Column:
        x = h["lo"].bitwiseXOR(c)
        part = x * (FNV_PRIME & 0xFFFF)  # the prime is 2 ** 40 + its low bits
        hi = h["hi"] * (FNV_PRIME & 0xFFFF) + F.shiftleft(x, 8) + F.shiftright(part, 32)
        return F.struct(hi.bitwiseAND(F.lit(low)).alias("hi"), part.bitwiseAND(F.lit(low)).alias("lo"))

    done = F.aggregate(codes, start, step)
    return F.lower(F.concat(F.lpad(F.hex(done["hi"]), 8, "0"), F.lpad(F.hex(done["lo"]), 8, "0")))


def slug(name: ColumnLike) -> Column:
    return F.regexp_replace(F.lower(_c(name)), "[^a-z0-9]+", "-")


def first_json_array(text: ColumnLike) -> Column:
    return F.from_json(F.regexp_extract(_c(text), r"(?s)\[.*\]", 0), "array<string>")


def iso_time(epoch_ms: ColumnLike) -> Column:
    return F.date_format(F.timestamp_millis(_c(epoch_ms)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def query_kind(query: str) -> str:
    q = query.strip()
    if not q or re.search(r"\s", q):
        return "generic"
    if "::" in q or "/" in q or "." in q:
        return "path"
    if q[0].isupper() and "_" not in q:
        return "class"
    return "function" if "_" in q or any(c.isupper() for c in q[1:]) else "generic"


def query_kind_column(query: ColumnLike) -> Column:
    q = F.trim(_c(query))
    return F.when((q == "") | q.rlike(r"\s"), "generic").when(q.rlike(r"::|/|\."), "path").when(q.rlike("^[A-Z]") & ~q.contains("_"), "class").when(q.contains("_") | q.rlike("^.+[A-Z]"), "function").otherwise("generic")


def sanitised(query: str, most: int = 2000) -> str:
    return query.strip().encode()[:most].decode("utf-8", "ignore")
