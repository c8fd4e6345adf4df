"""Scores as column expressions, and the parameters' normalisation on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM, SYMBOL, PHRASE = 0.65, 0.20, 0.15
DECAY, DAY_MS = 0.05, 86_400_000


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def weight(x: float | None, default: float) -> float:
    return default if x is None or not math.isfinite(x) or x < 0 else float(x)


def threshold(x: float | None) -> float | None:
    if x is None or not math.isfinite(x):
        return None
    return min(1.0, max(0.0, x / 100 if x > 1 else x))


def top_k(x: int | None, default: int = 5, most: int = 50) -> int:
    return max(1, min(most, x or default))


def coverage(query_terms: list[str], terms: Column) -> Column:
    q = sorted(set(query_terms))
    return F.size(F.array_intersect(F.array(*map(F.lit, q)), terms)) / F.lit(float(len(q))) if q else F.lit(0.0)


def keyword_score(query: str, query_terms: list[str], terms: Column, symbol_terms: Column, search_text: Column) -> Column:
    if not query_terms:
        return F.lit(0.0)
    phrase = F.when(search_text.contains(query.lower()), 1.0).otherwise(0.0)
    return clamp(TERM * coverage(query_terms, terms) + SYMBOL * coverage(query_terms, symbol_terms) + PHRASE * phrase)


def blended(semantic: Column, keyword: Column, semantic_weight: float, keyword_weight: float) -> Column:
    total = semantic_weight + keyword_weight
    positive = F.greatest(semantic, F.lit(0.0))
    return clamp((semantic_weight * positive + keyword_weight * keyword) / total) if total > 0 else positive


def kind_boost(query_kind: Column, matched_kind: Column, score: Column) -> Column:
    """A matched class, function or any match, for the query that looks like one, raises the score; clamped."""
    k = F.lower(matched_kind)
    factor = F.when((query_kind == "path") & k.isNotNull(), 2.0).when((query_kind == "class") & k.isin("class", "struct", "interface", "trait", "enum", "type"), 1.5).when((query_kind == "function") & k.isin("function", "method"), 1.3).otherwise(1.0)
    return clamp(score * factor)


def most_boost(query_kind: str) -> float:
    """The highest factor of kind_boost() for a query's kind."""
    return {"path": 2.0, "class": 1.5, "function": 1.3}.get(query_kind, 1.0)


def recency(score: Column, age_days: Column, window_days: float, most: float = 0.05) -> Column:
    boost = F.when((age_days >= 0) & (age_days < window_days), most * (1 - age_days / window_days)).otherwise(0.0)
    return clamp(score + F.coalesce(boost, F.lit(0.0)))


def percent(x: Column) -> Column:
    return F.round(x * 1000) / 10


def decay(edge_weight: Column, created_ms: Column, now_ms: int) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - created_ms) / F.lit(float(DAY_MS)))
    return edge_weight * F.exp(-DECAY * age)


def depth_penalty(depth: Column) -> Column:
    return 1 / (1 + 0.3 * depth)


def relevance(cosine: Column, decayed: Column, edge_weight: Column) -> Column:
    return 0.6 * cosine + 0.4 * decayed / F.greatest(edge_weight, F.lit(0.01))


def risk(changed_lines: Column, touched: Column, dependents: Column) -> Column:
    return 1.0 * changed_lines + 5.0 * touched + 3.0 * dependents


def risk_reasons(changed_lines: Column, touched: Column, dependents: Column, hops: int = 2) -> Column:
    parts = ((changed_lines, " changed lines"), (touched, " touched symbols"), (dependents, f" dependents within {hops} hops"))
    return F.filter(F.array(*(F.when(n > 0, F.concat(n.cast("string"), F.lit(what))) for n, what in parts)), lambda x: x.isNotNull())


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1
