"""The registered query of each operator, over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import chat, decontaminate, html, language, licenses, lines, packing, secrets, simhash, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(spark, vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licences(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language.identify(spark, docs, language.train(docs), ["doc_id"])
    return told.select("doc_id", language.is_held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicate_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_lines", "n_dropped")


QUERIES = {
    f.__name__: f
    for f in (
        op1_top_k, op2_decontaminate, op3_licences, op4_language, op5_secrets, op6_main_text, op7_packing, op8_chat, op9_simhash, op10_lines,
    )
}

_OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _licence_sql() -> str:
    known = ", ".join(f"'{s}': '{k}'" for k, s in licenses.SENTENCES.items())
    sentences = ", ".join(f"'{s}'" for s in licenses.SENTENCES.values())

    def ids(ends: str) -> str:
        split = f"string_split_regex(coalesce(text, ''), '{ends}')"
        plain = f"list_transform({split}, lambda s: trim(lower(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))))"
        return f"list_transform(list_filter({plain}, lambda s: s IN ({sentences})), lambda s: MAP {{{known}}}[s])"

    ends = [e.replace("\\t", "\t").replace("\\r", "\r").replace("\\n", "\n") for e in licenses.ENDS]
    hits = {
        name: " OR ".join(f"regexp_matches(seq{k}, '{' ' + ' (?:.* )?'.join(r) + ' '}')" for r in rules for k in (0, 1))
        for name, rules in licenses.RULES.items()
    }
    shown = []
    for name, hit in sorted(hits.items()):
        cover = licenses.COVERS.get(name)
        both = f"({hit}) AND NOT ({hits[cover]})" if cover else hit
        shown.append(f"CASE WHEN {both} THEN '{name}' END")
    return f"""
WITH a AS (SELECT doc_id, {ids(ends[0])} AS ids0, {ids(ends[1])} AS ids1 FROM documents),
b AS (
  SELECT doc_id, len(ids0) AS n_known, array_to_string(ids0, ',') AS sentence_ids,
    ' ' || array_to_string(ids0, '  ') || ' ' AS seq0, ' ' || array_to_string(ids1, '  ') || ' ' AS seq1 FROM a
)
SELECT doc_id, n_known, coalesce(sentence_ids, '') AS sentence_ids, concat_ws(',', {", ".join(shown)}) AS licences FROM b
"""


_OP8 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), k AS (
  SELECT *, CAST(ceil(strlen(text) / {chat.BYTES_PER_TOKEN}.0) AS BIGINT) + {chat.TURN_TOKENS} AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM t
), p AS (
  SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CAST(sum(tokens) OVER (PARTITION BY conv_id) AS BIGINT) AS total,
    first_value(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id ORDER BY place) AS system FROM k
), o AS (
  SELECT *, greatest({chat.BUDGET - chat.HISTORY} - coalesce(CAST(ceil(strlen(system) / {chat.BYTES_PER_TOKEN}.0) AS BIGINT) + {chat.TURN_TOKENS}, 0), 1) AS stride FROM p
), s AS (SELECT *, before // stride AS part FROM o),
h AS (SELECT *, min(before) OVER (PARTITION BY conv_id, part) AS head FROM s),
l AS (SELECT *, before > head AND before + tokens - head > stride AS late FROM h),
g AS (SELECT *, 2 * part + CAST(late AS BIGINT) AS span FROM l),
f0 AS (SELECT *, max(before + tokens) OVER (PARTITION BY conv_id, span) AS stop, max(CAST(late AS BIGINT)) OVER (PARTITION BY conv_id, part) AS has_late FROM g),
e AS (SELECT *, CASE WHEN NOT late AND has_late = 1 THEN span + 1 ELSE 2 * (stop // stride) END AS following FROM f0),
w AS (
  SELECT conv_id, span AS win, place, {len(chat.NEW)} AS mark, role, text, system FROM e
  UNION ALL
  SELECT conv_id, following, place, {len(chat.AGAIN)}, role, text, system FROM e
  WHERE stop < total AND stop - before <= {chat.HISTORY} AND NOT (place = 1 AND system IS NOT NULL)
), x AS (
  SELECT conv_id, win, place, mark + {len(chat.TEXT) + len(chat.END)}
    + length(replace(replace(role, '~', '~0'), '<', '~1')) + length(replace(replace(text, '~', '~0'), '<', '~1')) AS chars,
    {len(chat.AGAIN) + len(chat.TEXT) + len(chat.END) + len("system")} + length(replace(replace(system, '~', '~0'), '<', '~1')) AS lead FROM w
), f AS (
  SELECT conv_id, win, sum(chars) + CASE WHEN min(place) > 1 THEN coalesce(any_value(lead), 0) ELSE 0 END AS chars FROM x GROUP BY ALL
), c AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY ALL),
d AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256
  FROM k GROUP BY conv_id
)
SELECT d.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars
FROM d JOIN c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE_SQL = {"op1_top_k": _OP1, "op3_licences": _licence_sql(), "op8_chat": _OP8}
