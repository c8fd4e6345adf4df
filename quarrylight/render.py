"""Reports: the rows of a tool's answer as text. Rows are few by the tools' own limits; they are collected here only.

A report's wording is what users of these tools parse, so the formats are fixed values.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# How many issues and files of a leaf are shown.
ISSUES, LEAF_FILES, PREVIEW = 50, 10, 120


def percent(x: float | None) -> float:
    return round((x or 0.0) * 1000) / 10


def numbered(rows: Iterable[Row]) -> Iterable[tuple[int, Row]]:
    return enumerate(rows, 1)


def search(rows: DataFrame, query: str, indexed: int | None = None) -> str:
    found = rows.collect()
    if not found:
        return "No matching files found for the given query."
    out = [f'Top {len(found)} hybrid matches for: "{query}"\n', *([f"Index: {indexed} document(s)\n"] if indexed is not None else [])]
    for i, r in numbered(found):
        out += [f"{i}. {r.path} ({percent(r.combined)}% total)", f"   Semantic: {percent(r.semantic)}% | Keyword: {percent(r.keyword)}%"]
        out += [f"   Header: {r.header}"] if r.header else []
        out += [f"   Matched symbols: {', '.join(r.matched_symbols)}"] if r.matched_symbols else []
        out += [f"   Definition lines: {', '.join(r.locations)}"] if "locations" in r and r.locations else []
        out += ["   Snippet:", *(f"     {x}" for x in r.snippet.splitlines())] if "snippet" in r and r.snippet else []
        out.append("")
    return "\n".join(out)


def line_range(line: int, end: int | None) -> str:
    return f"L{line}-L{end}" if end and end > line else f"L{line}"


def identifiers(rows: DataFrame, query: str) -> str:
    """rows(name, kind, path, line, end_line, signature, parent_name, score, semantic, keyword, calls, total)."""
    found = rows.collect()
    if not found:
        return "No supported identifiers found for semantic identifier search."
    out = [f'Top {len(found)} identifier matches for: "{query}"', ""]
    for i, r in numbered(found):
        out += [f"{i}. {r.kind} {r.name} - {r.path} ({line_range(r.line, r.end_line)})", f"   Score: {percent(r.score)}% | Semantic: {percent(r.semantic)}% | Keyword: {percent(r.keyword)}%", f"   Signature: {r.signature}"]
        out += [f"   Parent: {r.parent_name}"] if r.parent_name else []
        if r.calls:
            out.append(f"   Calls ({len(r.calls)}/{r.total}):")
            out += [f"     {j}. {c.path}:L{c.line} ({percent(c.score)}%) {c.text}" for j, c in numbered(r.calls)]
        else:
            out.append("   Calls: none found")
        out.append("")
    return "\n".join(out)


def blast_radius(rows: DataFrame, symbol: str) -> str:
    found = rows.orderBy("path", "line").collect()
    if not found:
        return f'Symbol "{symbol}" is not used anywhere in the codebase.'
    out, at = [f'Blast radius for "{symbol}": {len(found)} usages in {len({r.path for r in found})} files\n'], None
    for r in found:
        if r.path != at:
            at = r.path
            out.append(f"  {at}:")
        out.append(f"    L{r.line}: {r.context}")
    if len(found) == 1:
        out.append("\n⚠ LOW USAGE: This symbol is used only 1 time(s). Consider inlining if it's under 20 lines.")
    return "\n".join(out)


def dead_symbols(rows: DataFrame) -> str:
    found = rows.collect()
    if not found:
        return "No dead-symbol candidates found."
    head = [f"Found {len(found)} dead-symbol candidate(s):", "(Heuristic — verify before deletion. Public APIs, trait methods, and reflection-invoked symbols may show up here.)", ""]
    return "\n".join([*head, *(f"{r.path}:{r.line}  {r.kind} {r.name}" for r in found)])


def cycles(rows: DataFrame) -> str:
    found = rows.collect()
    if not found:
        return "No import cycles detected."
    return "".join(f"Cycle {i} ({len(r.files)} files in SCC):\n" + "".join(f"  {x}\n" for x in r.files) for i, r in numbered(found))


def review(rows: DataFrame) -> str:
    found = rows.collect()
    if not found:
        return "PR review: empty diff (no files changed)."
    changed = sum(r.hop == 0 for r in found)
    out = [f"PR review: {changed} changed file(s), {len(found) - changed} dependent file(s) within 2 hops", ""]
    for i, r in numbered(found):
        out.append(f"{i}. {r.path} [{'changed' if r.hop == 0 else f'dependent (hop {r.hop})'}] — risk {r.score:.1f}")
        out += [f"   {'; '.join(r.reasons)}"] if r.reasons else []
        out += [f"   Touched symbols: {', '.join(r.symbols)}"] if "symbols" in r and r.symbols else []
    return "\n".join(out)


def quality(rows: DataFrame, total: int, dim: int) -> str:
    """rows(key, kind): the first issues are listed, the others counted."""
    head = f"Embedding quality report: {total} vector(s), expected dim {dim}\n"
    n = rows.count()
    if not n:
        return head + "  No issues found.\n"
    shown = rows.orderBy("kind", "key").limit(ISSUES).collect()
    groups = rows.where("kind = 'duplicate'").select("group").distinct().count() if "group" in rows.columns else 0
    more = f"  (+{n - ISSUES} more)\n" if n > ISSUES else ""
    return head + f"  Issues: {n} total, {groups} duplicate group(s)\n" + "".join(f"  [{r.kind}] {r.key}\n" for r in shown) + more


def memories(found: DataFrame, nodes: DataFrame) -> str:
    """found(id, depth, score or relevance, path) with their nodes."""
    score = "score" if "score" in found.columns else "relevance"
    rows = found.join(nodes.select("id", "node_type", "label", "content", "access_count"), "id").orderBy("depth", F.desc(score), "id").collect()
    out = []
    for r in rows:
        text = r.content or ""
        out += [f"  [{r.node_type}] {r.label} (depth: {r.depth}, score: {r[score]})", f"    Content: {text[:PREVIEW] + '...' if len(text) > PREVIEW else text}"]
        out += [f"    Path: {r.path}"] if "--[" in (r.path or "") else []
        out.append(f"    ID: {r.id} | Accessed: {r.access_count}x")
    return "\n".join(out)


def navigation(tree: DataFrame) -> str:
    """tree(path, labels and optionally header) as an indented tree; of a leaf the first files are shown, the others counted."""
    steps = tree.select("path", "labels", *(["header"] if "header" in tree.columns else [F.lit("").alias("header")]))
    leaves = steps.groupBy("labels").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("path", "header"))), 1, LEAF_FILES).alias("files"))
    top: dict = {}
    for r in leaves.collect():
        at = top
        for x in r.labels:
            at = at.setdefault(x, {})
        at[None] = r

    def count(node: dict) -> int:
        return sum(v.n if k is None else count(v) for k, v in node.items())

    def lines(node: dict, pad: str) -> Iterable[str]:
        for label in sorted(k for k in node if k is not None):
            size = "" if label[:1].isdigit() else f" ({count(node[label])} files)"
            yield f"{pad}[{label}]{size}"
            yield from lines(node[label], pad + "  ")
        if None in node:
            leaf = node[None]
            yield from (f"{pad}{f.path}" + (f" - {f.header}" if f.header else "") for f in leaf.files)
            if leaf.n > LEAF_FILES:
                yield f"{pad}(+{leaf.n - LEAF_FILES} more files)"

    return "\n".join(lines(top, ""))


def text(rows: DataFrame, column: str = "text", most: int = 10_000) -> str:
    """The lines as one text; if there are more than can be shown, the last line says how many."""
    found = [r[0] for r in rows.select(column).limit(most + 1).collect()]
    return "\n".join(found if len(found) <= most else [*found[:most], f"(+{rows.count() - most} more)"])
