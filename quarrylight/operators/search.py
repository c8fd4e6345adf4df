"""Lexical search (inverted index, TF-IDF), reciprocal-rank fusion, hybrid document search and identifier search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import scoring as S
from quarrylight.functions import text as T
from quarrylight.functions import vectors as V
from quarrylight.session import checkpoint

# Fixed value: how many times the results an index gives as candidates.
CANDIDATES = 10


def postings(docs: DataFrame, *, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """(token, doc): each token once a document."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(T.tokens(text))).alias("token")).select("token", "doc")


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("df"))


def lexical_scores(post: DataFrame, n_docs: Column | int, query: str) -> DataFrame:
    """(doc, score): summed idf of the query's tokens, each as often as the query has it. Only their postings are read.

    A document's weights are added in the order of their tokens: sums of doubles depend on it, and documents with the same
    tokens must tie exactly, wherever the tokens are in them.
    """
    terms = T.tokens_of(query)
    found = checkpoint(post.where(F.col("token").isin(*sorted(set(terms)))))  # read twice, and far smaller than the texts
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    times = F.create_map(*(F.lit(x) for t in sorted(set(terms)) for x in (t, float(terms.count(t))))) if terms else F.create_map(F.lit(""), F.lit(0.0))
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    weights = df.select("token", (S.idf(n, F.col("df")) * times[F.col("token")]).alias("w"))
    # one row for each token of the query, so its size is the query's
    held = found.join(F.broadcast(weights), "token").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("token", "w"))).alias("held"))
    return held.select("doc", F.aggregate("held", F.lit(0.0), lambda s, x: s + x["w"]).alias("score"))


def lexical_search(docs: DataFrame, query: str, top_k: int = 10, *, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    scores = lexical_scores(postings(docs, id_col=id_col, text=text), docs.count(), query)
    return scores.orderBy(F.desc("score"), "doc").limit(top_k or 10)


def rrf(ranked: list[DataFrame], k: int = 60, id_col: str = "doc") -> DataFrame:
    """(doc, score) from frames with (doc, rank0): the sum of 1 / (k + rank0 + 1)."""
    parts = ranked[0].select(id_col, "rank0")
    for x in ranked[1:]:
        parts = parts.unionByName(x.select(id_col, "rank0"))
    return parts.groupBy(id_col).agg(F.sum(1 / (k + F.col("rank0") + 1)).alias("score"))


def ranked(df: DataFrame, *order: Column, top_k: int) -> DataFrame:
    """The top rows with rank0. Only they are numbered, so the window's single partition is of bounded size."""
    top = df.orderBy(*order).limit(top_k)
    return top.withColumn("rank0", F.row_number().over(Window.orderBy(*order)) - 1)


def with_scores(docs: DataFrame, query: str, vector: list[float] | None, *, semantic_weight: float | None = None, keyword_weight: float | None = None, kind: str | None = None, kernel: bool = False) -> DataFrame:
    """docs (path, header, symbols, content, vec and optionally entries) with semantic, keyword and combined."""
    query = T.sanitised(query)
    terms = T.tokens_of(query)
    full = T.search_text("path", "header", "symbols", "content")
    if "entries" in docs.columns:
        matched = F.filter("entries", lambda e: F.arrays_overlap(T.tokens(e["name"]), F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")))
        names = F.when(F.size(matched) > 0, F.transform(matched, lambda e: e["name"])).otherwise(F.col("symbols"))
        first_kind = F.try_element_at(matched, F.lit(1))["kind"]
        symbol_terms = F.when(F.size(matched) > 0, F.flatten(F.transform(matched, lambda e: T.tokens(e["name"])))).otherwise(F.flatten(F.transform("symbols", lambda s: T.tokens(s))))
    else:
        names, first_kind = F.col("symbols"), F.lit(None).cast("string")
        symbol_terms = F.flatten(F.transform("symbols", lambda s: T.tokens(s)))
    if vector is None:
        semantic = F.lit(0.0)
    else:
        similarity = V.cosine_to(vector)(F.col("vec")) if kernel else V.cosine(F.col("vec"), V.literal(vector))
        semantic = F.when(F.col("vec").isNull(), 0.0).otherwise(similarity)
    keyword = S.keyword_score(query, terms, T.tokens(full), symbol_terms, full)
    out = docs.withColumn("semantic", semantic).withColumn("keyword", keyword).withColumn("matched_symbols", names)
    combined = S.blended(F.col("semantic"), F.col("keyword"), S.weight(semantic_weight, 0.72), S.weight(keyword_weight, 0.28))
    return out.withColumn("combined", S.kind_boost(F.lit(kind or T.query_kind(query)), first_kind, combined))


def candidates(index, query: list[float], top_k: int | None = None, times: int = CANDIDATES) -> DataFrame:
    """(path) of an index's nearest vectors, ``times`` as many as the search returns."""
    return index.search(query, times * S.top_k(top_k)).select(F.col("key").alias("path"))


def most_combined(query: str, vector: list[float], semantic_weight: float | None, keyword_weight: float | None, *, recent: bool) -> Column:
    """What a document's combined score can't exceed, by its vector alone."""
    base = S.blended(V.cosine(F.col("vec"), V.literal(vector)), F.lit(1.0), S.weight(semantic_weight, 0.72), S.weight(keyword_weight, 0.28))
    return base * S.most_boost(T.query_kind(T.sanitised(query))) + (0.05 if recent else 0.0)


def hybrid_search(docs: DataFrame, query: str, vector: list[float] | None, *, index=None, top_k: int | None = None, semantic_weight: float | None = None, keyword_weight: float | None = None, min_semantic: float | None = None, min_keyword: float | None = None, min_combined: float | None = None, require_semantic: bool = False, require_keyword: bool = False, include: list[str] | None = None, exclude: list[str] | None = None, recency_days: float | None = None, now_ms: int | None = None, kernel: bool = False) -> DataFrame:
    """Documents by blended semantic and keyword score. One scan and a bounded top-k; the path breaks ties.

    Documents without a vector compete by keywords alone and must have some. An index over the vectors gives the first
    candidates: documents whose vectors leave them below the last of these, whatever their keywords, aren't read word by word.
    """
    if index is not None and vector is not None:
        options = {"semantic_weight": semantic_weight, "keyword_weight": keyword_weight, "min_semantic": min_semantic, "min_keyword": min_keyword, "min_combined": min_combined, "require_semantic": require_semantic, "require_keyword": require_keyword, "include": include, "exclude": exclude, "recency_days": recency_days, "now_ms": now_ms, "kernel": kernel}
        near = docs.where("vec is not null").join(candidates(index, vector, top_k), "path", "left_semi")
        reached = [r.combined for r in hybrid_search(near, query, vector, top_k=top_k, **options).select("combined").collect()]  # top_k rows at most
        if len(reached) == S.top_k(top_k):
            docs = docs.where(F.col("vec").isNull() | (most_combined(query, vector, semantic_weight, keyword_weight, recent=bool(recency_days)) >= min(reached) - 1e-9))
    docs = docs.where(T.matches_globs("path", include or [], exclude or [])) if include or exclude else docs
    found = with_scores(docs, query, vector, semantic_weight=semantic_weight, keyword_weight=keyword_weight, kernel=kernel)
    if recency_days and now_ms is not None:
        age = (F.lit(now_ms) - F.col("modified_ms")) / F.lit(float(S.DAY_MS))
        found = found.withColumn("combined", S.recency(F.col("combined"), age, recency_days))
    found = found.where(F.col("vec").isNotNull() | (F.col("keyword") > 0))
    if require_semantic:
        found = found.where("semantic > 0")
    if require_keyword:
        found = found.where("keyword > 0")
    for name, bar in (("semantic", S.threshold(min_semantic)), ("keyword", S.threshold(min_keyword)), ("combined", S.threshold(0.1 if min_combined is None else min_combined))):
        if bar is not None:
            found = found.where(F.col(name) >= bar)
    return found.orderBy(F.desc("combined"), F.desc("keyword"), F.desc("semantic"), "path").limit(S.top_k(top_k))


def identifier_scores(identifiers: DataFrame, query: str, vector: list[float] | None, *, semantic_weight: float | None = None, keyword_weight: float | None = None, kinds: list[str] | None = None, top_k: int | None = None) -> DataFrame:
    """identifiers (id, name, kind, token_set and optionally vec) by blended score."""
    terms = T.tokens_of(T.sanitised(query))
    rows = identifiers.where(F.lower("kind").isin(*(k.strip().lower() for k in kinds))) if kinds else identifiers
    semantic = F.coalesce(V.cosine(F.col("vec"), V.literal(vector)), F.lit(0.0)) if vector is not None and "vec" in rows.columns else F.lit(0.0)
    rows = rows.withColumn("semantic", semantic).withColumn("keyword", S.coverage(terms, F.col("token_set")))
    a, b = S.weight(semantic_weight, 0.78), S.weight(keyword_weight, 0.22)
    return rows.withColumn("score", S.blended(F.col("semantic"), F.col("keyword"), a, b)).orderBy(F.desc("score"), "id").limit(S.top_k(top_k))


def call_sites(line_rows: DataFrame, identifiers: DataFrame, query: str, *, limit: int = 10, words: Column | None = None, vector: list[float] | None = None, line_vectors: DataFrame | None = None) -> DataFrame:
    """Where each identifier (id, name, kind, path, line) is used: (id, rank, path, line, text, score, total).

    Lines meet names by an equal token; a function or method needs a call. Two stages: the most fitting lines by keywords,
    three times ten or four times the limit, then the best of these by the blend with the cosine of line_vectors(path, line,
    vec). A name's lines are counted and ranked once, whatever number of identifiers has it; only the best fan out to them.
    """
    terms, keep = T.tokens_of(T.sanitised(query)), max(30, 4 * limit)
    own = identifiers.select("id", F.col("name").alias("token"), F.lower("kind").isin("function", "method").alias("calls"), F.col("path").alias("own_path"), F.col("line").alias("own_line"))
    tokens = F.array_distinct(T.code_tokens("text") if words is None else words)
    called = F.expr("regexp_like(text, concat('(?U)\\\\b\\\\Q', token, '\\\\E\\\\s*\\\\('))")
    used = line_rows.withColumn("token", F.explode(tokens)).join(own.select("token").distinct(), "token", "left_semi")
    used = used.withColumn("calls", F.explode(F.when(called, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    used = checkpoint(used.select("token", "calls", "path", "line", "text", S.coverage(terms, T.tokens(F.concat_ws(" ", "path", "text"))).alias("keyword")))
    totals = used.groupBy("token", "calls").agg(F.count("*").alias("n"))
    itself = used.select("token", "calls", F.col("path").alias("own_path"), F.col("line").alias("own_line"), F.lit(1).alias("self"))
    counted = own.join(totals, ["token", "calls"]).join(itself, ["token", "calls", "own_path", "own_line"], "left").withColumn("total", F.col("n") - F.coalesce("self", F.lit(0)))
    # one more than needed, as an identifier's own line doesn't count
    first = Window.partitionBy("token", "calls").orderBy(F.desc("keyword"), "path", "line")
    best = used.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep + 1)
    met = counted.join(best, ["token", "calls"]).where(~((F.col("path") == F.col("own_path")) & (F.col("line") == F.col("own_line"))))
    met = met.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("r"))).where(F.col("r") <= keep)
    if vector is not None and line_vectors is not None:
        met = met.join(line_vectors.select("path", "line", "vec"), ["path", "line"], "left").withColumn("semantic", F.coalesce(V.cosine(F.col("vec"), V.literal(vector)), F.lit(0.0)))
    else:
        met = met.withColumn("semantic", F.lit(0.0))
    met = met.withColumn("score", S.clamp(0.82 * F.greatest("semantic", F.lit(0.0)) + 0.18 * F.col("keyword")))
    last = Window.partitionBy("id").orderBy(F.desc("score"), "path", "line")
    return met.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= limit).select("id", "rank", "path", "line", "text", "score", "total")
