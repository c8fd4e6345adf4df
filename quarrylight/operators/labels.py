"""Labels of groups of files, by expressions and grouped counts; ties go to the name.

Every fact that a rule asks for is a tagged value of a file (its layer, ending, directory, ...). One count of them per group,
of which the leading three stay, answers all rules; no group's files are ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.session import ship

# Fixed values.
GENERIC = ["src", "lib", "dist", "build", "utils", "helpers", "common", "shared", "core", "types", "config", "internal", "cmd", "pkg"]
ROOTS = ["packages", "domains", "apps", "src", "lib", "internal", "cmd", "pkg"]
NESTED_LAYERS = [("delivery", "http", "HTTP routes"), ("delivery", "temporal", "Temporal workflows"), ("delivery", "nats", "NATS consumers"), ("repository", "pg", "database queries"), ("test", "integration", "integration tests"), ("tests", "integration", "integration tests")]
PLAIN_LAYERS = [(["service"], "business logic"), (["repository", "repo"], "data access"), (["domain"], "domain models"), (["test", "tests", "__tests__"], "tests"), (["delivery"], "API delivery")]
SIBLING_LAYERS = [("service", "service"), ("repository", "repository"), ("repo", "repository"), ("delivery", "delivery"), ("domain", "domain"), ("http", "http"), ("temporal", "temporal")]
TYPE_NAMES = {"tests": "test files", "components": "React components", "proto": "proto definitions", "sql": "SQL migrations", "go": "Go source", "rust": "Rust source", "json": "JSON configs", "yaml": "YAML configs", "css": "stylesheets", "schemas": "schemas"}
ALLOWED_WORDS = [
    "react", "vue", "angular", "svelte", "next", "nuxt", "node", "express", "fastify", "nest", "components", "hooks", "pages", "layouts", "views", "widgets", "api", "rest", "graphql", "grpc", "proto", "template", "templates", "config", "configs", "configuration",
    "server", "client", "frontend", "backend", "typescript", "javascript", "python", "golang", "rust", "source", "modules", "packages", "library", "form", "forms", "modal", "modals", "dialog", "dialogs", "page", "route", "routes", "routing", "navigation", "auth", "authentication",
    "state", "store", "redux", "zustand", "context", "style", "styles", "styled", "css", "scss", "test", "tests", "spec", "specs", "testing", "util", "utils", "utility", "utilities", "helper", "helpers", "service", "services", "handler", "handlers", "model", "models", "entity", "entities",
    "schema", "schemas", "feature", "features", "domain", "domains", "shared", "common", "core", "base", "internal", "dashboard", "admin", "portal", "management", "workflow", "workflows",
]
LEADING, BATCH = 3, 10


def vote(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, share): the most frequent value of each group, ties to the least."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    best = counted.groupBy(group).agg(F.min_by(F.struct(F.col(value).alias("v"), "n"), F.struct((-F.col("n")).alias("k"), value)).alias("b"), F.sum("n").alias("all"))
    return best.select(group, F.col("b.v").alias(value), F.col("b.n").alias("n"), (F.col("b.n") / F.col("all")).alias("share"))


def common_prefix(paths: DataFrame, group: str) -> DataFrame:
    """(group, prefix): the longest directory that all paths of a group share."""
    folder = F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/")))
    sizes = paths.groupBy(group).agg(F.count("*").alias("all"))
    seen = paths.select(group, folder.alias("prefix")).groupBy(group, "prefix").agg(F.count("*").alias("n"))
    return seen.join(sizes, group).where("n = all").groupBy(group).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def path_pattern(paths: DataFrame, group: str) -> DataFrame:
    """(group, pattern): the shared directory and the shared ending, NULL where there is neither."""
    prefix = common_prefix(paths, group)
    ending = paths.select(group, F.regexp_extract("path", r"(\.[^/]+)$", 1).alias("e")).groupBy(group).agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    tail = F.when((F.col("lo") == F.col("hi")) & (F.col("lo") != ""), F.concat(F.lit("*"), F.col("lo"))).otherwise("*")
    pattern = F.when(F.col("prefix") != "", F.concat("prefix", F.lit("/"), tail)).when(tail != "*", tail)
    return prefix.join(ending, group).select(group, pattern.alias("pattern"))


def heuristic(paths: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, label): the shared directory with the kind that half of the group has, at most 64 characters."""
    top = vote(paths, group, kind)
    joined = common_prefix(paths, group).join(top, group)
    has = F.col("prefix") != ""
    label = F.when(has & (F.col("share") >= 0.5), F.concat("prefix", F.lit(" ("), F.col(kind), F.lit(")"))).when(has, F.concat("prefix", F.lit("/*"))).when(F.col("share") >= 0.5, F.concat(F.lit("(mixed) "), F.col(kind))).otherwise("(mixed)")
    return joined.select(group, F.substring(label, 1, 64).alias("label"))


# -- facts: tagged values of files, and what leads in a group

def _named(segment: Column) -> Column:
    """segment, or null where it says nothing: a generic name or a route's parameter."""
    return F.when(~segment.isin(*GENERIC) & ~segment.startswith("[") & ~segment.endswith("]"), segment)


def _without(name: Column, *endings: str) -> Column:
    """name without the first of the endings that it has, else null."""
    out = F.lit(None).cast("string")
    for x in reversed(endings):
        out = F.when(name.endswith(x), F.substring(name, 1, F.length(name) - len(x))).otherwise(out)
    return out


def _layer(folders: Column) -> Column:
    """What the directories of a path say about its layer; the deeper pairs first."""
    own = F.transform(folders, lambda x: F.lower(x))
    has = lambda x: F.array_contains(own, x)
    out = F.when(F.lit(False), "")
    for a, b, name in NESTED_LAYERS:
        out = out.when(has(a) & has(b), name)
    for names, name in PLAIN_LAYERS:
        out = out.when(F.arrays_overlap(own, F.array(*map(F.lit, names))), name)
    return out


def facts(files: DataFrame, group: str, header: str | None = None) -> DataFrame:
    """(group, n, shallow, depth, prefix, stem, lead, firsts) of files(group, path): how many files, whether one lies in no
    directory, the shared directories, the shared start of file names, the leading values of each kind of fact and the first file names."""
    parts = F.split("path", "/")
    shared = common_prefix(files, group).select(F.col(group).alias("__g"), F.col("prefix"), F.when(F.col("prefix") == "", 0).otherwise(F.size(F.split("prefix", "/"))).alias("depth"))
    rows = files.join(shared, F.col(group).eqNullSafe(F.col("__g"))).withColumns({"folders": F.slice(parts, 1, F.size(parts) - 1), "name": F.element_at(parts, -1)})
    name, folders, below = F.col("name"), F.col("folders"), F.col("depth") + 1
    plain = F.coalesce(*(_without(name, x) for x in (".ts", ".tsx", ".go", ".rs")))
    telling = F.when(~plain.contains("test") & ~plain.contains("spec") & ~plain.isin("index", "mod") & ~plain.contains("error"), plain)
    up = F.filter(F.slice(F.reverse(folders), 2, 3), lambda x: ~x.isin(*GENERIC, *ROOTS) & ~x.startswith("[") & ~x.endswith("]"))
    segment, sub = F.try_element_at(folders, below), F.try_element_at(folders, below + 1)
    proto = F.try_element_at(parts, F.array_position(parts, "proto").cast("int") + 1)
    one = {
        "test": F.when(T.is_test_file("path"), F.lit("test")),
        "tested": F.coalesce(*(_without(name, x) for x in (".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx", "_test.go", "_test.rs"))),
        "layer": _layer(folders), "logic": telling, "barrel": F.when(name.isin("index.ts", "index.js", "index.tsx", "mod.rs"), F.lit("index")), "barrel of": F.try_element_at(up, F.lit(1)),
        "ending": F.regexp_extract(name, r"([^.]*)$", 1), "proto": F.when(F.array_contains(parts, "proto"), proto), "segment": segment, "type": T.file_type("path"), "domain": T.api_domain(name),
    }
    many = [
        F.when(sub.isNotNull(), F.array(F.struct(F.concat(F.lit("below "), segment).alias("kind"), sub.alias("value")))),
        F.transform(F.array_distinct(F.filter(F.array(*(F.when(F.col("path").contains(f"/{x}/"), F.lit(y)) for x, y in SIBLING_LAYERS)), lambda x: x.isNotNull())), lambda x: F.struct(F.lit("side").alias("kind"), x.alias("value"))),
        F.transform(F.filter(parts, lambda x: ~x.contains(".") & (F.length(x) > 1)), lambda x: F.struct(F.lit("directory").alias("kind"), x.alias("value"))),
    ]
    if header:
        words = F.transform(F.split(F.coalesce(F.col(header), F.lit("")), r"\s+"), lambda x: F.regexp_replace(x, r"^[^\p{IsAlphabetic}\p{N}_-]+|[^\p{IsAlphabetic}\p{N}_-]+$", ""))
        many.append(F.transform(F.filter(words, lambda x: T.label_word(x)), lambda x: F.struct(F.lit("word").alias("kind"), x.alias("value"))))
    none = F.expr("cast(array() as array<struct<kind:string,value:string>>)")
    tagged = F.concat(F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in one.items())), lambda x: x["value"].isNotNull()), *(F.coalesce(x, none) for x in many))
    counted = rows.select(group, F.explode(tagged).alias("x")).groupBy(group, "x.kind", "x.value").agg(F.count("*").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy(group, "kind").orderBy(F.desc("n"), "value"))).where(F.col("r") <= LEADING)
    lists = top.groupBy(group, "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top"))
    lead = lists.groupBy(F.col(group).alias("__l")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "top"))).alias("lead"))
    stems = F.regexp_extract("name", r"^([^.]*)", 1)
    firsts = rows.where(plain.isNotNull() & ~plain.isin("index", "mod")).select(group, "path", plain.alias("plain")).withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("path"))).where(F.col("r") <= LEADING)
    firsts = firsts.groupBy(F.col(group).alias("__f")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "plain"))), lambda x: x["plain"]).alias("firsts"))
    # the least and the greatest of some strings share what all of them share
    sizes = rows.groupBy(group, "prefix", "depth").agg(F.count("*").alias("n"), F.min(F.size("folders")).alias("shallow"), F.min(stems).alias("lo"), F.max(stems).alias("hi"))
    same = F.length(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length("lo"), F.lit(1))), lambda i: F.when(F.substring(F.col("lo"), F.lit(1), i) == F.substring(F.col("hi"), F.lit(1), i), F.lit("x"))), ""))
    stem = F.when(F.col("n") > 1, F.substring(F.col("lo"), F.lit(1), same))
    own = sizes.join(lead, F.col(group).eqNullSafe(F.col("__l")), "left").join(firsts, F.col(group).eqNullSafe(F.col("__f")), "left")
    return own.select(group, "n", "shallow", "depth", "prefix", stem.alias("stem"), "lead", F.coalesce("firsts", F.expr("cast(array() as array<string>)")).alias("firsts"))


def _top(kind: Column | str, i: int = 1) -> Column:
    return F.try_element_at(F.try_element_at(F.col("lead"), F.lit(kind) if isinstance(kind, str) else kind), F.lit(i))


def _joined(kind: str) -> Column:
    return F.array_join(F.transform(F.try_element_at(F.col("lead"), F.lit(kind)), lambda x: x["value"]), " + ")


def _over(kind: Column | str, part: int) -> Column:
    """Whether the leading value's files are more than such a part of the group, rounded down."""
    return F.coalesce(_top(kind)["n"] > F.floor(F.col("n") / part), F.lit(False))


def _tests() -> Column:
    return F.coalesce(F.concat(F.nullif(_joined("tested"), F.lit("")), F.lit(" tests")), F.lit("tests"))


def derived(files: DataFrame, group: str, header: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """(group, label): the first rule that fits, or null: tests, a layer, index files, schema files, a diverging directory,
    a shared start of names, a header's word, the end of the shared directory. known are facts() of the files, where they were made."""
    segment = _named(_top("segment")["value"])
    under = F.concat(F.lit("below "), _top("segment")["value"])
    deeper = F.when(_over(under, 3), _named(_top(under)["value"]))
    diverging = F.when((F.col("depth") < F.col("shallow")) & _over("segment", 3), F.when(deeper.isNotNull(), T.layer(F.concat(segment, F.lit("/"), deeper))).otherwise(T.layer(segment)))
    border = F.length(F.regexp_extract("stem", r"^(.*)\p{Lu}[^\p{Lu}]*$", 1))
    stem = F.when(F.length("stem") >= 4, F.when(border >= 4, F.substring(F.col("stem"), F.lit(1), border)).otherwise(F.col("stem")))
    layer = _top("layer")["value"]
    logic = F.when((layer == "business logic") & (_joined("logic") != ""), F.concat(_joined("logic"), F.lit(" logic"))).when(layer.startswith("domain") & (F.size("firsts") > 0), F.concat(F.array_join("firsts", " + "), F.lit(" models"))).otherwise(layer)
    proto = F.coalesce(F.concat(F.when(~_top("proto")["value"].contains("."), _top("proto")["value"]), F.lit(" proto")), F.lit("proto definitions"))
    tail = F.split("prefix", "/")
    ends = F.slice(tail, F.greatest(F.size(tail) - 1, F.lit(1)), 2)
    plain = ~F.exists(ends, lambda x: x.startswith("[") | x.endswith("]"))
    label = F.when(F.col("shallow") < 1, F.lit(None).cast("string")).when(_over("test", 2), _tests()).when(_over("layer", 2), logic)
    label = label.when(_over("barrel", 2), F.coalesce(F.concat(_top("barrel of")["value"], F.lit(" exports")), F.lit("barrel exports")))
    label = label.when(_over("ending", 2) & (_top("ending")["value"] == "proto"), proto).when(_over("ending", 2) & (_top("ending")["value"] == "sql"), F.lit("migrations"))
    label = label.otherwise(F.coalesce(diverging, stem, F.when(_over("word", 3), _top("word")["value"]), F.when((F.col("depth") >= 2) & plain, F.array_join(ends, "/"))))
    return (facts(files, group, header) if known is None else known).select(group, label.alias("label"))


def described(files: DataFrame, group: str, known: DataFrame | None = None) -> DataFrame:
    """(group, description) where no rule fits: the leading directory or directories, the type, a count, names."""
    segment = _top("segment")["value"]
    apart = F.col("depth") < F.col("shallow")
    several = F.array_join(F.filter(F.transform(F.try_element_at(F.col("lead"), F.lit("segment")), lambda x: x["value"]), lambda x: ~x.startswith("[") & ~x.endswith("]")), " + ")
    names = F.create_map(*(F.lit(x) for kv in TYPE_NAMES.items() for x in kv))
    kind = F.when(_over("type", 2), F.try_element_at(names, _top("type")["value"]))
    count = F.col("n").cast("string")
    out = F.coalesce(
        F.when(apart, _named(segment)), F.when(_top("segment", 2).isNotNull(), F.nullif(several, F.lit(""))), F.concat(count, F.lit(" "), kind), F.when(apart & ~segment.startswith("[") & ~segment.endswith("]"), F.concat(count, F.lit(" "), segment, F.lit(" modules"))),
        F.nullif(F.array_join("firsts", " + "), F.lit("")), F.concat(count, F.lit(" files")),
    )
    return (facts(files, group) if known is None else known).select(group, out.alias("description"))


def told_apart(files: DataFrame, labels: DataFrame, *, parent: str = "parent", group: str = "group", label: str = "label", known: DataFrame | None = None) -> DataFrame:
    """labels(parent, group, label) unique below each parent, whatever their case.

    Equal ones give way to what their files are (tests, a layer) if that differs; those still equal take what only they
    have: a directory, a type, an API's domain, a common folder, their size or names; the last resort is a number.
    """
    known = facts(files, group) if known is None else known
    side = F.when(_over("test", 2), _tests()).when(_over("side", 3), _top("side")["value"])
    types = F.create_map(*(F.lit(x) for kv in TYPE_NAMES.items() for x in kv), F.lit("source"), F.lit("source"))
    own = known.select(F.col(group).alias("__g"), "n", "firsts", side.alias("side"), F.when(_over("type", 2) & F.try_element_at(types, _top("type")["value"]).isNotNull(), _top("type")["value"]).alias("type"), F.when(_over("domain", 2), F.concat(_top("domain")["value"], F.lit(" API types"))).alias("domain"))
    rows = labels.join(own, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    same = lambda: Window.partitionBy(parent, F.lower(F.col(label)))
    rows = rows.withColumn(label, F.when((F.count("*").over(same()) > 1) & (F.size(F.collect_set("side").over(same())) > 1), F.coalesce("side", label)).otherwise(F.col(label)))
    rows = rows.withColumn("__key", F.lower(F.col(label))).withColumn("__many", F.count("*").over(Window.partitionBy(parent, "__key")))
    alike = rows.where(F.col("__many") > 1).select(parent, "__key", group, F.col("n").alias("__n"))
    inside = files.select(F.col(group).alias("__g"), "path").join(alike, F.col("__g").eqNullSafe(F.col(group)))
    parts = F.split("path", "/")
    counted = inside.select(parent, "__key", group, "__n", F.explode(F.filter(parts, lambda x: ~x.contains(".") & (F.length(x) > 1))).alias("v")).groupBy(parent, "__key", group, "__n", "v").agg(F.count("*").alias("c"))
    counted = counted.withColumn("all", F.sum("c").over(Window.partitionBy(parent, "__key", "v")))
    unique = counted.where((F.col("c") > F.floor(F.col("__n") / 3)) & (F.col("c") == F.col("all"))).groupBy(F.col(group).alias("__u")).agg(F.min_by("v", F.struct((-F.col("c")).alias("k"), "v")).alias("directory"))
    folder = F.try_element_at(parts, F.lit(-2))
    near = inside.where(F.size(parts) > 1).where(~folder.startswith("[") & ~folder.endswith("]")).groupBy(parent, "__key", group, folder.alias("v")).agg(F.count("*").alias("c")).withColumn("all", F.sum("c").over(Window.partitionBy(parent, "__key", "v")))
    near = near.where("c >= 3").groupBy(F.col(group).alias("__v")).agg(F.min_by("v", F.struct((F.col("all") - 2 * F.col("c")).alias("k"), "v")).alias("folder"))
    rows = rows.join(unique, F.col(group).eqNullSafe(F.col("__u")), "left").join(near, F.col(group).eqNullSafe(F.col("__v")), "left")
    only = lambda c: F.when(F.count(c).over(Window.partitionBy(parent, "__key", c)) == 1, F.col(c))
    rows = rows.withColumn("suffix", F.coalesce("directory", only("type"), only("domain"), "folder", F.concat(F.col("n").cast("string"), F.lit(" files"))))
    told = F.size(F.collect_set("suffix").over(Window.partitionBy(parent, "__key"))) == F.col("__many")
    weak = F.contains("__key", F.lower("suffix")) | F.lower("suffix").isin(*GENERIC, "node") | F.col("suffix").contains("files")
    suffix = F.when(weak & (F.size("firsts") > 0), F.array_join("firsts", " + ")).otherwise(F.col("suffix"))
    counts = F.col(label).rlike("^[0-9]") & F.col("suffix").contains("files")
    k = F.row_number().over(Window.partitionBy(parent, "__key").orderBy(group))
    final = F.when(F.col("__many") == 1, F.col(label)).when(told, F.when(counts, F.col(label)).otherwise(F.concat(label, F.lit(" ("), suffix, F.lit(")")))).when(k > 1, F.concat(label, F.lit(" #"), k.cast("string"))).otherwise(F.col(label))
    return rows.select(parent, group, final.alias(label))


def same_as_parent(label: Column, parent: Column) -> Column:
    """Whether a label says no more than its parent: equal, or a part between slashes in common."""
    own, above = F.lower(label), F.lower(parent)
    return (own == above) | F.arrays_overlap(F.split(own, "/"), F.split(above, "/"))


def plausible(files: DataFrame, labels: DataFrame, *, group: str = "group", label: str = "label") -> DataFrame:
    """(group, label, plausible): not if some, but less than a fifth, of five or more files have a word of the label in their path.

    Words of two characters or less, and those that name a nature rather than a place, don't count.
    """
    words = F.filter(F.split(F.trim(F.lower(F.col(label))), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*ALLOWED_WORDS))
    named = labels.select(F.col(group).alias("__g"), label, words.alias("words"))
    hit = F.exists("words", lambda w: F.contains(F.lower("path"), w))
    sizes = files.select(group, "path").join(named, F.col(group).eqNullSafe(F.col("__g"))).groupBy(group, label).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return sizes.select(group, label, ((F.col("n") < 5) | (F.col("hits") == 0) | (F.col("hits") * 5 >= F.col("n"))).alias("plausible"))


def file_label(header: str, path: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(header)), F.lit("")), F.regexp_extract(path, "([^/]*)$", 1))


def navigation(tree: DataFrame, *, header: str | None = None, cached: DataFrame | None = None) -> DataFrame:
    """(path, cluster_path, labels) of tree(path, cluster_path and the header): a label for each step of each path.

    A step's label is a cached one (key, label), if it is plausible, else the derived one, else a description; also where
    it says no more than the step above. Labels are unique among the steps below one.
    """
    steps = tree.select("path", *([header] if header else []), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("cluster_path")), lambda n: F.array_join(F.slice("cluster_path", 1, n), "\0"))).alias("level", "group")).where(F.size("cluster_path") > 0)
    from quarrylight.session import checkpoint

    steps = checkpoint(steps)
    known = checkpoint(facts(steps, "group", header))
    names = derived(steps, "group", header, known).join(described(steps, "group", known).withColumnRenamed("group", "__d"), F.col("group") == F.col("__d")).drop("__d")
    if cached is not None:
        good = plausible(steps, cached.select(F.col("key").alias("group"), "label")).where("plausible").select(F.col("group").alias("__c"), F.col("label").alias("old"))
        names = names.join(good, F.col("group") == F.col("__c"), "left").withColumn("label", F.coalesce("old", "label")).drop("__c", "old")
    names = names.withColumns({"parent": F.regexp_extract("group", "^(.*)\0[^\0]*$", 1), "label": F.coalesce("label", "description")})
    above = names.select(F.col("group").alias("__p"), F.col("label").alias("above"))
    names = names.join(above, F.col("parent") == F.col("__p"), "left").withColumn("label", F.when(same_as_parent(F.col("label"), F.col("above")), F.col("description")).otherwise(F.col("label")))
    final = told_apart(steps, names.select("parent", "group", "label"), known=known).select("group", F.col("label").alias("name"))
    labelled = steps.select("path", "level", "group").join(final, "group").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]).alias("labels"))
    return tree.select("path", "cluster_path").join(labelled, "path", "left").withColumn("labels", F.coalesce("labels", F.expr("cast(array() as array<string>)")))


def merged_label_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, label, quality): llm over heuristic, then the new over the old."""
    rank = F.when(F.col("quality") == "llm", 1).otherwise(0)
    both = old.withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1))).withColumn("rank", F.struct(rank.alias("q"), "o"))
    return both.groupBy("key").agg(F.max_by(F.struct("label", "quality"), "rank").alias("b")).select("key", "b.label", "b.quality")


def read_label_cache(raw: DataFrame, column: str = "json") -> DataFrame:
    """(key, label, quality) of JSON objects whose values are a label, or an object of label and quality."""
    rows = raw.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    inner = F.from_json("value", "label string, quality string")
    new = F.col("value").startswith("{")
    return rows.select("key", F.when(new, inner["label"]).otherwise(F.col("value")).alias("label"), F.when(new, F.coalesce(inner["quality"], F.lit("heuristic"))).otherwise("heuristic").alias("quality")).where("label is not null")


class Labeler(Protocol):
    """Names groups of files, e.g. by a chat model: one answer for each description, null where it has none."""

    def label(self, descriptions: list[str]) -> list[str | None]: ...


def healed(cache: DataFrame, described_groups: DataFrame, labeler: Labeler, *, files: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """The cache(key, label, quality) after the labeler was asked, some at a time, for what has no label of its own yet.

    described_groups(key, description) are the groups wanted. An answer must be plausible for files(group, path) where they are given.
    """
    ship(cache.sparkSession)
    wanted = described_groups.join(cache.where("quality = 'llm'").select("key"), "key", "left_anti").select("key", "description")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(labeler.label(part.column(1).to_pylist()), pa.string())], ["key", "label"])

    new = wanted.mapInArrow(run, "key string, label string").where("label is not null and trim(label) <> ''").withColumn("quality", F.lit("llm"))
    if files is not None:
        new = plausible(files, new.withColumnRenamed("key", "group")).where("plausible").select(F.col("group").alias("key"), "label", F.lit("llm").alias("quality"))
    return merged_label_cache(cache, new)
