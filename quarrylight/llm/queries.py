"""The queries of this package, each over its whole table with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import binpack, chat, decontaminate, kneser_ney, licenses, media_ts, retrieval_packing, simhash, suffix_dedup, toxicity
from quarrylight.session import table

#: A conversation whose texts spell the template's own control strings.
CONTROL = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.packed(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.packed(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.formatted(rows.unionByName(spark.createDataFrame(CONTROL, "conv_id bigint, turn bigint, role string, text string"))))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.digest(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))), ","))


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_bfd_packing, op3_quality, op4_simhash, op5_retrieval_packing, op6_chat_formatting, op7_decontamination, op8_license_scan, op9_suffix_dedup, op10_transport_stream]
    return {f.__name__: f for f in own}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g')) + length('### : </turn>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

WORDS7 = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7 = f"""WITH d AS (SELECT doc_id, coalesce({WORDS7}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS7} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT doc_id, i, size, item FROM dw JOIN bw USING (size, g)),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP9 = r"""WITH d AS (SELECT doc_id, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS owner, count(*) OVER (PARTITION BY coalesce(text, '')) AS copies FROM documents),
v AS (SELECT doc_id, p, md5(array_to_string(w[p + 1:p + 50], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM d WHERE doc_id = owner AND len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS fd FROM v GROUP BY g), e AS (SELECT g, fd, min(p) AS fp FROM v JOIN f USING (g) WHERE doc_id = fd GROUP BY g, fd),
m AS (SELECT g, doc_id, p, fd, fp FROM v JOIN e USING (g) WHERE doc_id <> fd OR p - fp >= 50),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS x FROM m UNION SELECT doc_id, unnest(range(0, len(w))) FROM d WHERE doc_id <> owner AND len(w) >= 50),
o AS (SELECT doc_id, x FROM c UNION SELECT fd, unnest(range(fp, fp + 50)) FROM m UNION SELECT doc_id, unnest(range(0, len(w))) FROM d WHERE copies > 1 AND len(w) >= 50),
s AS (SELECT doc_id, min(x) AS a, max(x) + 1 AS z FROM (SELECT doc_id, x, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS k FROM c) GROUP BY doc_id, k),
r AS (SELECT doc_id, sum(z - a) AS n, count(*) AS k, string_agg(a || '-' || z, ',' ORDER BY a) AS spans FROM s GROUP BY doc_id),
t AS (SELECT doc_id, unnest(range(0, len(w) + 1)) AS j, unnest(string_split_regex(text, '[^\x20\x09-\x0D]+')) AS gap, unnest(list_append(w, '')) AS word FROM d WHERE text IS NOT NULL),
u AS (SELECT t.doc_id, j, CASE WHEN here.x IS NOT NULL AND before.x IS NOT NULL THEN '' ELSE gap END || CASE WHEN here.x IS NOT NULL THEN '' ELSE word END AS piece FROM t LEFT JOIN c here ON here.doc_id = t.doc_id AND here.x = j LEFT JOIN c before ON before.doc_id = t.doc_id AND before.x = j - 1),
l AS (SELECT doc_id, string_agg(piece, '' ORDER BY j) AS rest FROM u GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_shared FROM o GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_repeated, CAST(coalesce(k, 0) AS INTEGER) AS n_spans, coalesce(spans, '') AS spans, CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared, rest AS text
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN l USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The others need tokenizers, XXH64, compression, models or media, so tests hold them against brute force."""
    return {"op6_chat_formatting": OP6, "op7_decontamination": OP7, "op9_suffix_dedup": OP9}
