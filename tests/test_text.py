"""Text functions, scores and vectors with literal expectations."""

import math

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import scoring as S
from quarrylight.functions import text as T
from quarrylight.functions import vectors as V


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "expected"), [("getUserName", ["get", "user", "name"]), ("HTTPServer_v2", ["http", "server", "v2"]), ("snake_case-kebab", ["snake", "case", "kebab"]), ("éFoo a b2", ["foo", "b2"]), ("", [])])
def test_tokens(spark, text, expected):
    assert one(spark, T.tokens("t"), t=text) == expected == T.tokens_of(text)


def test_lines_headers_and_snippets(spark):
    text = "// one\n// two\nuse x;\n\nfn f() {\n}\n"
    assert one(spark, T.lines("t"), t="a\r\nb\n") == ["a", "b"]
    assert one(spark, T.code_header("t"), t=text) == "one | two"
    assert one(spark, T.leading_comment("t"), t=text) == "one two"
    assert one(spark, T.plain_header("t"), t="\n  a  \n\nb\nc") == "a | b"
    assert one(spark, T.snippet("t", F.lit(1), F.lit(6), 2), t=text) == "// one\n// two\n…"
    assert one(spark, T.snippet("t", F.lit(5), F.lit(5)), t=text) == "fn f() {"
    assert one(spark, T.snippet("t", F.lit(4), F.lit(4)), t=text) is None
    assert one(spark, T.fallback_snippet("t"), t="\n  hello") == "hello"


def test_locations_round_trip(spark):
    assert one(spark, T.location("n", F.lit(3), F.lit(9)), n="f") == "f@L3-L9"
    assert one(spark, T.location("n", F.lit(3), F.lit(3)), n="f") == "f@L3"
    r = one(spark, T.parse_location("n"), n="f@L3-L9")
    assert (r.name, r.line, r.end_line) == ("f", 3, 9)


@pytest.mark.parametrize(("glob", "yes", "no"), [("src/**/*.ts", ["src/a.ts", "src/x/y/a.ts"], ["a.ts", "src/a.js"]), ("*.md", ["a.md"], ["x/a.md"]), ("a?c", ["abc"], ["a/c", "abbc"]), ("a.b", ["a.b"], ["axb"])])
def test_globs(spark, glob, yes, no):
    for p in yes:
        assert one(spark, T.matches_globs("p", [glob], []), p=p)
        assert not one(spark, T.matches_globs("p", [], [glob]), p=p)
    for p in no:
        assert not one(spark, T.matches_globs("p", [glob], []), p=p)


@pytest.mark.parametrize(("path", "kept"), [("src/a.ts", True), ("node_modules/a.js", False), (".git/x", False), ("a/.env/x", False), ("package-lock.json", False), ("x.min.js", False), ("generic/gen_pb.ts", False), ("yarn.lock", True)])
def test_tracked(spark, path, kept):
    assert one(spark, T.tracked("p"), p=path) is kept


def test_patterns(spark):
    use = lambda t, s: one(spark, F.col("t").rlike(T.usage_regex(s)), t=t)
    assert use("a foo(b)", "foo") and not use("food", "foo") and not use("éfoo", "foo") and use("x $y", "$y")
    call = lambda t, k: one(spark, F.col("t").rlike(T.call_regex("go", k)), t=t)
    assert call("go (1)", "function") and not call("go = 1", "function") and call("go = 1", "const")
    define = lambda t: one(spark, F.col("t").rlike(T.definition_regex("go")), t=t)
    assert define("export async function go(") and define("const go = 1") and define("pub fn go<T>(") and not define("return go(1)")


def test_classifiers(spark):
    assert [T.query_kind(q) for q in ("a b", "src/x", "a::b", "UserId", "get_x", "getX", "user")] == ["generic", "path", "path", "class", "function", "function", "generic"]
    assert one(spark, T.file_type("p"), p="a/tests/x.go") == "tests" and one(spark, T.file_type("p"), p="a.tsx") == "components"
    assert one(spark, T.layer("p"), p="delivery/http/x") == "HTTP routes" and one(spark, T.layer("p"), p="lib") == "lib"
    assert one(spark, T.api_domain("p"), p="useApiV1orders") == "orders" and one(spark, T.api_domain("p"), p="x") is None
    assert one(spark, T.label_word("p"), p="billing") and not one(spark, T.label_word("p"), p="files") and not one(spark, T.label_word("p"), p="abc")
    assert one(spark, T.language("p"), p="x/A.PY") == "python" and one(spark, T.language("p"), p="x") is None
    assert one(spark, T.first_json_array("p"), p='so: ["a", "b"] ok') == ["a", "b"]
    assert one(spark, T.iso_time("p"), p=86_400_000) == "1970-01-02T00:00:00Z"
    assert T.sanitised("  é" * 2000).encode()[:2].decode() == "é" and len(T.sanitised("é" * 3000).encode()) <= 2000


def test_scores(spark):
    lit = F.lit
    assert one(spark, S.blended(lit(0.5), lit(1.0), 0.72, 0.28)) == pytest.approx(0.64)
    assert one(spark, S.blended(lit(-1.0), lit(1.0), 0, 0)) == 0
    assert one(spark, S.kind_boost(lit("class"), lit("Struct"), lit(0.8))) == 1.0
    assert one(spark, S.recency(lit(0.5), lit(0.0), 10)) == pytest.approx(0.55) and one(spark, S.recency(lit(0.5), lit(None), 10)) == 0.5
    assert one(spark, S.decay(lit(1.0), lit(0), 10 * S.DAY_MS)) == pytest.approx(math.exp(-0.5))
    assert one(spark, S.risk_reasons(lit(2), lit(0), lit(3))) == ["2 changed lines", "3 dependents within 2 hops"]
    assert (S.threshold(25), S.threshold(None), S.weight(float("nan"), 3), S.top_k(0), S.top_k(90)) == (0.25, None, 3, 5, 50)
    terms, text = F.array(lit("a1"), lit("b1")), lit("x a1 b1")
    assert one(spark, S.keyword_score("a1 b1", ["a1", "b1"], terms, F.array(lit("a1")), text)) == pytest.approx(0.65 + 0.1 + 0.15)


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert one(spark, V.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.5**0.5)
    assert one(spark, V.cosine(v(1, 0), v(1))) == 0 and one(spark, V.cosine(v(0, 0), v(1, 1))) == 0
    assert one(spark, V.normalised(v(3, -0.0, 4))) == [0.6, 0.0, 0.8]
    rows = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), (None,)], "v array<float>")
    assert [r.x for r in rows.select(V.cosine_to([1.0, 1.0])("v").alias("x")).collect()] == [pytest.approx(0.5**0.5), 0, 0, 0]
