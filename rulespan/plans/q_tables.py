"""Queries over scans, sinks, row normalisation and key joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespan.functions import columns as cols
from rulespan.functions import text as tx
from rulespan.functions.rules import REGISTERED, conflict_edges
from rulespan.operators import joins as j
from rulespan.operators import normalize as n
from rulespan.operators import profile as p
from rulespan.operators.ranking import dense_index as dense_index_op
from rulespan.plans.catalog import query
from rulespan.plans.testbed import Testbed, with_tables
from rulespan.session import shared_folder
from rulespan.sources import tables as src


def on(*names: str, body: str) -> str:
    return with_tables(*names, body=body)


# --- scans and sinks -------------------------------------------------------------------------------------------


@query("scan_parquet", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_parquet(t: Testbed):
    return src.scan(t.spark, f"{t.dir}/documents.parquet")


@query("scan_pruned", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 1000")
def scan_pruned(t: Testbed):
    return src.scan(t.spark, f"{t.dir}/documents.parquet", ["doc_id", "n_chars"]).filter(F.col("n_chars") >= 1000)


@query("text_scan_stats", on("promptset", body="""
SELECT count(*) AS row_count, CAST(count_if(ok) AS BIGINT) AS selected_row_count, CAST(count_if(ok AND length(v) > 0) AS BIGINT) AS non_empty_text_count,
  CAST(count_if(ok AND length(v) = 0) AS BIGINT) AS empty_text_count, count(DISTINCT CASE WHEN ok AND length(v) > 0 THEN v END) AS unique_text_count,
  CAST(sum(CASE WHEN ok THEN length(v) ELSE 0 END) AS BIGINT) AS total_chars, max(CASE WHEN ok THEN length(v) END) AS max_chars,
  round(sum(CASE WHEN ok THEN length(v) ELSE 0 END)::DOUBLE / count_if(ok AND length(v) > 0), 4) AS mean_chars_non_empty
FROM (SELECT num_constraints <> 5 AS ok, CASE WHEN doc_id % 19 = 0 THEN '' ELSE user_prompt END AS v FROM promptset)"""))
def text_scan_stats(t: Testbed):
    rows = t.promptset().withColumn("user_prompt", F.when(F.col("doc_id") % 19 == 0, "").otherwise(F.col("user_prompt")))
    allowed = t.promptset().filter(F.col("num_constraints") != 5)
    return src.text_scan_stats(rows, "user_prompt", allowed).withColumn("max_chars", F.col("max_chars").cast("bigint"))


@query("distinct_texts", on("promptset", body="SELECT DISTINCT user_prompt AS text FROM promptset WHERE num_constraints <> 5 AND length(user_prompt) > 0"))
def distinct_texts(t: Testbed):
    return src.distinct_texts(t.promptset(), "user_prompt", t.promptset().filter(F.col("num_constraints") != 5))


def _shards(t: Testbed, name: str) -> list[str]:
    """Write the generation records as four shard folders; two of them lack the truncation flag."""
    root = shared_folder(t.spark, name)
    rows = t.table("documents").select(
        "doc_id", F.expr("sha2('doc:' || doc_id, 256)").alias("prompt_id"), F.col("n_chars").alias("output_tokens"),
        (F.col("n_chars") > 2048).alias("output_truncated"), (F.col("doc_id") % 4).alias("shard"),
    )
    rows.filter(F.col("shard") < 2).drop("output_truncated").write.partitionBy("shard").parquet(f"{root}/a")
    rows.filter(F.col("shard") >= 2).write.partitionBy("shard").parquet(f"{root}/b")
    return [f"{root}/{'a' if i < 2 else 'b'}/shard={i}" for i in range(4)]


@query("shard_union", """SELECT doc_id, sha256('doc:' || doc_id) AS prompt_id, n_chars AS output_tokens,
 CASE WHEN doc_id % 4 < 2 THEN false ELSE n_chars > 2048 END AS output_truncated, 'shard=' || (doc_id % 4) AS generation_dir FROM documents""")
def shard_union(t: Testbed):
    return src.shard_union(t.spark, _shards(t, "shards"), ["output_truncated"])


@query("shard_combine", """SELECT 'shard=' || (doc_id % 4) AS generation_dir, count(*) AS row_count, min(doc_id) AS first_id,
 max(doc_id) AS last_id, CAST(sum(n_chars) AS BIGINT) AS output_tokens FROM documents GROUP BY ALL""")
def shard_combine(t: Testbed):
    return src.shard_union(t.spark, _shards(t, "combine"), ["output_truncated"]).groupBy("generation_dir").agg(
        F.count("*").alias("row_count"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
        F.sum("output_tokens").alias("output_tokens"),
    )


@query("source_priority", on("pairs", body="""
known AS (SELECT prompt_id, max(user_prompt) AS input_prompt, max(response_text) AS model_response FROM pairs WHERE conv_id % 2 = 0 GROUP BY 1)
SELECT p.prompt_id, coalesce(k.input_prompt, '') AS input_prompt, coalesce(k.model_response, '') AS model_response
FROM pairs p LEFT JOIN known k USING (prompt_id)"""))
def source_priority(t: Testbed):
    pairs = t.pairs().select(
        "prompt_id", "conv_id", F.col("user_prompt").alias("input_prompt"), F.col("response_text").alias("model_response")
    )
    nothing = pairs.filter(F.col("conv_id") < 0)
    return src.first_available(
        pairs.select("prompt_id"), [nothing, pairs.filter(F.col("conv_id") % 2 == 0), pairs], "prompt_id",
        ["input_prompt", "model_response"], F.col("conv_id"),
    )


@query("csv_roundtrip", """SELECT doc_id, replace(text, chr(10), ' "x", ') AS marked, n_chars / 7.0::DOUBLE AS share,
 lang = 'en' AS english FROM documents""")
def csv_roundtrip(t: Testbed):
    path = shared_folder(t.spark, "csv")
    out = t.table("documents").select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit(' "x", ')).alias("marked"),
        (F.col("n_chars") / 7.0).alias("share"), (F.col("lang") == "en").alias("english"),
    )
    src.write_csv(out, path)
    return src.read_csv(t.spark, path, out.schema)


@query("audit_json")
def audit_json(t: Testbed):
    path = shared_folder(t.spark, "audit")
    record = t.promptset().agg(
        F.count("*").alias("num_rows"),
        F.struct(F.countDistinct("base_key").alias("base_keys"), F.count_if(F.col("base_key").isNull()).alias("missing")).alias("keys"),
    )
    src.write_record(record, path)
    return t.spark.read.schema(record.schema).json(path).select("num_rows", "keys.base_keys", "keys.missing")


@query("sink_zstd", on("promptset", body="SELECT prompt_id, num_constraints, constraint_signature FROM promptset"))
def sink_zstd(t: Testbed):
    path = shared_folder(t.spark, "zstd")
    src.write_zstd(
        t.promptset().select("prompt_id", "num_constraints", "constraint_signature"), path, ["num_constraints"],
        {"table": "promptset"},
    )
    back = t.spark.read.parquet(path)
    return back.withColumn("num_constraints", F.col("num_constraints").cast("bigint"))


@query("resume_antijoin", """WITH done AS (SELECT doc_id FROM documents WHERE doc_id % 100 < 60 OR doc_id // 100 = 3),
want AS (SELECT doc_id // 100 AS shard, count(*) AS expected_rows FROM documents GROUP BY ALL),
have AS (SELECT doc_id // 100 AS shard, count(*) AS output_rows FROM done GROUP BY ALL)
SELECT shard, expected_rows, coalesce(output_rows, 0) AS output_rows,
 CASE WHEN coalesce(output_rows, 0) = expected_rows THEN 'skipped_existing' ELSE 'run' END AS status FROM want LEFT JOIN have USING (shard)""")
def resume_antijoin(t: Testbed):
    docs = t.table("documents").select("doc_id")
    done = docs.filter((F.col("doc_id") % 100 < 60) | (F.floor(F.col("doc_id") / 100) == 3))
    return src.shard_status(docs, done, "doc_id", 100)


@query("resume_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(t: Testbed):
    return src.pending(t.table("documents").select("doc_id"), t.table("labels"), "doc_id")


@query("expect_rows", "SELECT count(*) AS row_count, CAST(1000 AS BIGINT) AS expected_rows, count(*) = 1000 AS matches FROM documents")
def expect_rows(t: Testbed):
    return src.expected_rows(t.table("documents"), 1000)


# --- normalise, project, filter --------------------------------------------------------------------------------

_SPEC = (
    "'[{\"instruction_id\":[\"punctuation:no_comma\",\"length_constraints:number_words\"],\"kwargs\":[{},{\"num_words\":' || (turn + 5) || '}]}]'"
)
RAW_COLUMNS = {
    "key": "'task_' || (conv_id % 20) || '-' || turn",
    "ground_truth": f"CASE WHEN conv_id % 13 = 0 THEN '{{\"a\": 1}}' WHEN conv_id % 7 = 0 THEN '[{{\"instruction_id\":\"keywords:palindrome\"}}]' ELSE {_SPEC} END",
    "dataset": "'talk' || (conv_id % 3)",
    "constraint_type": "CASE WHEN turn % 2 = 0 THEN 'multi' ELSE 'single' END",
    "constraint": "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'Use no \"comma\"' END",
}


def raw_rows(t: Testbed):
    def said(role: str, text):
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    u, a = said("user", F.col("user_prompt")), said("assistant", F.col("response_text"))
    messages = (
        F.when(F.col("conv_id") % 11 == 0, F.array().cast("array<struct<role:string,content:string>>"))
        .when(F.col("conv_id") % 3 == 0, F.array(u))
        .when(F.col("conv_id") % 3 == 1, F.array(u, a))
        .otherwise(F.array(u, a, said("user", F.lit("And then?"))))
    )
    return t.pairs().select("conv_id", "turn", messages.alias("messages"), *[F.expr(e).alias(c) for c, e in RAW_COLUMNS.items()])


U, A = "{'content': user_prompt, 'role': 'user'}", "{'content': response_text, 'role': 'assistant'}"
RAW_SQL = on("pairs", body=f"""
raw AS (SELECT conv_id, turn, user_prompt, response_text,
  CASE WHEN conv_id % 11 = 0 THEN [] WHEN conv_id % 3 = 0 THEN [{U}] WHEN conv_id % 3 = 1 THEN [{U}, {A}]
       ELSE [{U}, {A}, {{'content': 'And then?', 'role': 'user'}}] END AS messages,
  {", ".join(f'{e} AS "{c}"' for c, e in RAW_COLUMNS.items())} FROM pairs),
parsed AS (SELECT *, sha256(CAST(to_json({{'constraint': "constraint", 'ground_truth': ground_truth, 'messages': messages}}) AS VARCHAR)) AS prompt_id,
  CASE WHEN conv_id % 13 = 0 THEN [] WHEN conv_id % 7 = 0 THEN ['keywords:palindrome']
       ELSE ['punctuation:no_comma', 'length_constraints:number_words'] END AS ids,
  CASE WHEN conv_id % 11 = 0 THEN '' WHEN conv_id % 3 < 2 THEN user_prompt
       ELSE 'user: ' || user_prompt || chr(10) || 'assistant: ' || response_text || chr(10) || 'user: And then?' END AS flat
  FROM raw)
""")


@query("prompt_id_hash", RAW_SQL + "SELECT conv_id, turn, prompt_id FROM parsed")
def prompt_id_hash(t: Testbed):
    return raw_rows(t).select(
        "conv_id", "turn", n.prompt_id(F.col("messages"), F.col("ground_truth"), F.col("constraint")).alias("prompt_id")
    )


PARSE_ERROR = "CASE WHEN conv_id % 13 = 0 THEN 'ground_truth must parse to list, got dict' END"


@query("parse_spec", RAW_SQL + f"""SELECT conv_id, turn, ground_truth AS ground_truth_spec, array_to_string(ids, '|') AS instruction_ids,
 conv_id % 13 <> 0 AS parse_ok, {PARSE_ERROR} AS parse_error FROM parsed""")
def parse_spec(t: Testbed):
    p = n.parse_spec(F.col("ground_truth")).alias("p")
    return raw_rows(t).select("conv_id", "turn", p).select(
        "conv_id", "turn", "p.ground_truth_spec", F.array_join("p.instruction_ids", "|").alias("instruction_ids"),
        "p.parse_ok", "p.parse_error",
    )


@query("flatten_prompt", RAW_SQL + "SELECT conv_id, turn, flat AS user_prompt FROM parsed")
def flatten_prompt(t: Testbed):
    return raw_rows(t).select("conv_id", "turn", n.flatten_prompt(F.col("messages")).alias("user_prompt"))


@query("signatures", on("promptset", body="SELECT prompt_id, constraint_signature, constraint_family_signature, num_constraints FROM promptset"))
def signatures(t: Testbed):
    ids = F.col("instruction_ids")
    return t.promptset().select(
        "prompt_id", n.signature(ids).alias("constraint_signature"),
        n.family_signature(ids).alias("constraint_family_signature"), F.size(ids).cast("bigint").alias("num_constraints"),
    )


@query("normalize", RAW_SQL + f"""SELECT prompt_id, key AS base_key, len(messages) AS message_count, flat AS user_prompt, "constraint" AS constraint_text,
 ground_truth AS ground_truth_spec, array_to_string(list_sort(ids), '|') AS constraint_signature,
 array_to_string(list_sort(list_transform(ids, lambda x: split_part(x, ':', 1))), '|') AS constraint_family_signature,
 CAST(len(ids) AS BIGINT) AS num_constraints, dataset AS source_dataset, constraint_type, conv_id % 13 <> 0 AS parse_ok, {PARSE_ERROR} AS parse_error FROM parsed""")
def normalize(t: Testbed):
    out = n.normalize(raw_rows(t))
    return out.withColumns(
        {"message_count": F.size("raw_messages").cast("bigint"), "num_constraints": F.col("num_constraints").cast("bigint")}
    ).drop("raw_messages", "instruction_ids")


@query("length_filter_audit", on("checks", body="""SELECT split, checker_pass, count(*) AS rows_before,
 CAST(count_if(prompt_tokens <= 2048 AND finish_reason <> 'length') AS BIGINT) AS rows_after,
 CAST(count_if(NOT (prompt_tokens <= 2048 AND finish_reason <> 'length')) AS BIGINT) AS rows_removed,
 max(prompt_tokens) AS max_before, max(CASE WHEN prompt_tokens <= 2048 AND finish_reason <> 'length' THEN prompt_tokens END) AS max_after
FROM checks GROUP BY split, checker_pass"""))
def length_filter_audit(t: Testbed):
    rows = t.checks().withColumn("cut", F.col("finish_reason") == "length")
    return n.length_filter_audit(rows, "prompt_tokens", "cut", 2048, ["split", "checker_pass"])


@query("dense_index", on("promptset", body="""
indexed AS (SELECT prompt_id, n_chars AS prompt_tokens, row_number() OVER (ORDER BY prompt_id) - 1 AS row_index FROM promptset WHERE n_chars < 2048)
SELECT prompt_id, prompt_tokens, row_index, row_index - 50 AS batch_position FROM indexed WHERE row_index >= 50 AND row_index < 750"""))
def dense_index(t: Testbed):
    eligible = t.promptset().filter(F.col("n_chars") < 2048).select("prompt_id", F.col("n_chars").alias("prompt_tokens"))
    indexed = dense_index_op(eligible)
    return indexed.filter((F.col("row_index") >= 50) & (F.col("row_index") < 750)).withColumn(
        "batch_position", F.col("row_index") - 50
    )


# Generation records before flags are derived, in SQL both engines read.
RECORDS = {
    "prompt_id": "'d' || doc_id", "prompt_tokens": "n_chars", "ok": "doc_id % 13 <> 0", "output_tokens": "(n_chars * 3) % 1500",
    "finish_reason": "CASE WHEN n_chars % 7 = 0 THEN 'length' WHEN doc_id % 5 = 0 THEN NULL ELSE 'stop' END",
    "error": "CASE WHEN doc_id % 26 = 0 THEN 'This is TOO LONG: ' || text WHEN doc_id % 13 = 0 THEN 'connection reset' END",
}


def records(t: Testbed):
    return t.table("documents").select(*[F.expr(e).alias(c) for c, e in RECORDS.items()])


RECORDS_SQL = "WITH records AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RECORDS.items()) + " FROM documents)\n"
CUT = "(coalesce(finish_reason, '') = 'length' OR (ok AND output_tokens >= 1024))"
CONTEXT_SQL = "(NOT ok AND regexp_matches(lower(coalesce(error, '')), '" + "|".join(cols.CONTEXT_ERRORS) + "'))"


@query("output_flags", RECORDS_SQL + f"""SELECT prompt_id, prompt_tokens, ok, CASE WHEN ok THEN output_tokens ELSE -1 END AS output_tokens, finish_reason,
 ok AND output_tokens >= 1024 AS output_hit_max_tokens, {CUT} AS output_truncated, CASE WHEN {CUT} THEN 'truncated' ELSE 'completed' END AS output_limit_status,
 prompt_tokens + 1024 AS prompt_plus_max_output_tokens, prompt_tokens + 1024 <= 4096 AS within_context_budget,
 {CONTEXT_SQL} AS context_window_error, coalesce(error, '') AS error FROM records""")
def output_flags(t: Testbed):
    out = n.output_flags(records(t))
    return out.withColumn("output_tokens", F.coalesce("output_tokens", F.lit(-1)))


@query("error_class", RECORDS_SQL + f"SELECT {CONTEXT_SQL} AS context_window_error, ok, count(*) AS row_count FROM records GROUP BY ALL")
def error_class(t: Testbed):
    rows = records(t).withColumn("context_window_error", cols.is_context_error(F.col("ok"), F.col("error")))
    return rows.groupBy("context_window_error", "ok").agg(F.count("*").alias("row_count"))


@query("length_bin", on("checks", body="SELECT length_bin, count(*) AS row_count, min(prompt_tokens) AS low, max(prompt_tokens) AS high FROM checks GROUP BY ALL"))
def length_bin(t: Testbed):
    rows = t.table("documents").withColumn("length_bin", cols.length_bin(F.col("n_chars")))
    return rows.groupBy("length_bin").agg(
        F.count("*").alias("row_count"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high")
    )


@query("length_bucket", """SELECT CASE WHEN n_chars <= 64 THEN '0001-0064' WHEN n_chars <= 128 THEN '0065-0128' WHEN n_chars <= 256 THEN '0129-0256'
 WHEN n_chars <= 512 THEN '0257-0512' WHEN n_chars <= 1024 THEN '0513-1024' WHEN n_chars <= 2048 THEN '1025-2048' ELSE '2049+' END AS bucket,
 count(*) AS row_count FROM documents GROUP BY ALL""")
def length_bucket(t: Testbed):
    return t.table("documents").groupBy(cols.length_bucket(F.col("n_chars")).alias("bucket")).agg(F.count("*").alias("row_count"))


@query("token_distribution", """WITH bins AS (SELECT * FROM (VALUES ('<=512', -1, 512), ('513-1024', 512, 1024), ('1025-1536', 1024, 1536),
 ('1537-2048', 1536, 2048), ('>2048', 2048, 1000000000)) b(token_bin, lo, hi))
SELECT token_bin, count(d.doc_id) AS prompt_count, round(count(d.doc_id)::DOUBLE / (SELECT count(*) FROM documents), 9) AS share,
 CAST(count_if(l.doc_id IS NOT NULL) AS BIGINT) AS included_count
FROM bins LEFT JOIN documents d ON d.n_chars > lo AND d.n_chars <= hi LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY token_bin""")
def token_distribution(t: Testbed):
    rows = t.table("documents").select("doc_id", cols.token_bin(F.col("n_chars")).alias("token_bin")).join(
        t.table("labels").select("doc_id", F.lit(1).alias("in")), "doc_id", "left"
    )
    labels = [b for _, b in cols.TOKEN_BINS] + [">2048"]
    one = rows.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("token_bin") == b).alias(f"n{i}") for i, b in enumerate(labels)],
        *[F.count_if((F.col("token_bin") == b) & F.col("in").isNotNull()).alias(f"w{i}") for i, b in enumerate(labels)],
    )
    cells = [
        F.struct(F.lit(b).alias("token_bin"), F.col(f"n{i}").alias("prompt_count"), F.col(f"w{i}").alias("included_count"))
        for i, b in enumerate(labels)
    ]
    return one.select("n", F.inline(F.array(*cells))).select(
        "token_bin", "prompt_count", F.round(F.try_divide("prompt_count", "n"), 9).alias("share"), "included_count"
    )


@query("key_family", """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '<missing>' WHEN doc_id % 7 = 0 THEN '<missing>'
 ELSE regexp_replace(source || '_' || (doc_id % 50) || '#' || doc_id, '([_:\\-#]\\d+)+$', '') END AS key_family FROM documents""")
def key_family(t: Testbed):
    d = F.col("doc_id")
    key = F.when(d % 9 == 0, F.lit(None)).when(d % 7 == 0, "  ").otherwise(
        F.concat("source", F.lit("_"), (d % 50).cast("string"), F.lit("#"), d.cast("string"))
    )
    return t.table("documents").select("doc_id", n.key_family(key).alias("key_family"))


@query("split_ids", on("promptset", body="""SELECT prompt_id, array_to_string(instruction_ids, ',') AS from_list,
 array_to_string(string_split(constraint_signature, '|'), ',') AS from_signature FROM promptset"""))
def split_ids(t: Testbed):
    as_list = F.concat(F.lit("['"), F.array_join("instruction_ids", "', '"), F.lit("']"))
    return t.promptset().select(
        "prompt_id", F.array_join(n.split_ids(as_list), ",").alias("from_list"),
        F.array_join(n.split_ids(F.col("constraint_signature")), ",").alias("from_signature"),
    )


TOP_SQL = "tops AS (SELECT base_key FROM promptset GROUP BY 1 ORDER BY count(*) DESC, base_key LIMIT 50)"


@query("top_levels", on("promptset", body=f"""{TOP_SQL}
SELECT CASE WHEN t.base_key IS NULL THEN '__other__' ELSE p.base_key END AS level, count(*) AS row_count FROM promptset p
LEFT JOIN tops t ON t.base_key = p.base_key GROUP BY ALL"""))
def top_levels(t: Testbed):
    marked = p.top_levels(t.promptset().select("base_key"), "base_key", 50)
    return marked.groupBy(F.col("base_key").alias("level")).agg(F.count("*").alias("row_count"))


SUPPORTED = REGISTERED[::2]


@query("supported_only", on("promptset", body="SELECT prompt_id FROM promptset WHERE len(list_filter(instruction_ids, lambda x: x NOT IN ({}))) = 0".format(
    ", ".join(f"'{r}'" for r in SUPPORTED))))
def supported_only(t: Testbed):
    return j.only_supported(t.promptset(), "instruction_ids", SUPPORTED).select("prompt_id")


FLAT_SQL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("text_preview", rf"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || chr(10) || chr(10) || '...[truncated in audit, '
 || (length(text) - 200) || ' chars omitted]' END AS clipped,
 CASE WHEN length({FLAT_SQL}) <= 60 THEN {FLAT_SQL} ELSE trim(regexp_extract({FLAT_SQL}, '^(.{{0,57}})(?:\s|$)', 1)) || '...' END AS short,
 substr(sha256('doc:' || doc_id), 1, 12) AS short_id FROM documents""")
def text_preview(t: Testbed):
    v = F.col("text")
    return t.table("documents").select(
        "doc_id",
        n.clip(v, 200, "\n\n...[truncated in audit, {omitted} chars omitted]").alias("clipped"),
        n.shorten(v, 60).alias("short"),
        F.substring(F.expr("sha2('doc:' || doc_id, 256)"), 1, 12).alias("short_id"),
    )


KWARGS = "CASE WHEN constraint_index % 2 = 0 THEN '{}' ELSE '{\"num_paragraphs\": ' || (doc_id % 4) || ', \"nth_paragraph\": ' || (doc_id % 5) || '}' END"
LINE = "constraint_index || ':' || {status}instruction_id || ' kwargs=' || kwargs_json"


@query("constraint_rollup", on("constraints", body=f"""
k AS (SELECT *, {KWARGS} AS kwargs_json FROM constraints)
SELECT prompt_id, string_agg({LINE.format(status="CASE WHEN followed THEN 'PASS' ELSE 'FAIL' END || ':' || ")}, ' | ' ORDER BY constraint_index) AS constraint_summary,
 coalesce(string_agg({LINE.format(status="")}, ' | ' ORDER BY constraint_index) FILTER (NOT followed), 'none') AS failed_summary FROM k GROUP BY prompt_id"""))
def constraint_rollup(t: Testbed):
    return n.constraint_rollup(t.constraints().withColumn("kwargs_json", F.expr(KWARGS)))


@query("invalid_params", on("constraints", body="""SELECT prompt_id, constraint_index, constraint_index % 2 = 1 AND doc_id % 5 > doc_id % 4 AS invalid FROM constraints"""))
def invalid_params(t: Testbed):
    return t.constraints().select(
        "prompt_id", F.col("constraint_index").cast("bigint").alias("constraint_index"), n.has_invalid_nth(F.expr(KWARGS)).alias("invalid")
    )


LABELS = ("80k", "80k/full", "train_80k", "train_40k", "20k", "full", "1500")


@query("label_norm", f"""SELECT label, CASE WHEN label IN ('80k', '80k/full', 'train_80k') THEN 'full' ELSE replace(label, 'train_', '') END AS curve_label,
 CASE WHEN regexp_matches(label, '^\\d+k$') THEN CAST(replace(label, 'k', '') AS BIGINT) * 1000 ELSE coalesce(try_cast(label AS BIGINT), -1) END AS size, count(*) AS row_count
 FROM (SELECT (['{"', '".join(LABELS)}'])[doc_id % 7 + 1] AS label FROM documents) GROUP BY ALL""")
def label_norm(t: Testbed):
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return t.table("documents").groupBy(label.alias("label")).agg(F.count("*").alias("row_count")).select(
        "label", n.curve_label(F.col("label")).alias("curve_label"), F.coalesce(n.size_of_label(F.col("label")), F.lit(-1)).alias("size"), "row_count"
    )


@query("predictions_std", on("predictions", body="""SELECT prompt_id, split, label, p_pred, 'one' AS run_id, CAST(7 AS BIGINT) AS seed, model_family, train_size_label,
 CASE WHEN p_pred >= 0.5 THEN 1 ELSE 0 END AS pred_label FROM predictions"""))
def predictions_std(t: Testbed):
    model = t.predictions().select(
        F.col("prompt_id").alias("id"), "split", F.col("label").alias("checker_label"), F.col("p_pred").alias("pred_proba"),
        "model_family", "train_size_label",
    )
    out = n.standard_predictions(model, {"id": "prompt_id", "checker_label": "label", "pred_proba": "p_pred"}, {"run_id": "one", "seed": 7})
    return out.withColumn("seed", F.col("seed").cast("bigint"))


@query("budget_preflight", on("checks", body="""SELECT count(*) AS row_count, CAST(count_if(prompt_tokens + 1024 > 4096) AS BIGINT) AS over_budget_count,
 max(prompt_tokens) AS prompt_tokens_max, max(prompt_tokens + 1024) AS total_max FROM checks"""))
def budget_preflight(t: Testbed):
    total = F.col("prompt_tokens") + 1024
    return t.checks().agg(
        F.count("*").alias("row_count"), F.count_if(total > 4096).alias("over_budget_count"),
        F.max("prompt_tokens").alias("prompt_tokens_max"), F.max(total).alias("total_max"),
    )


# --- joins and set operations ----------------------------------------------------------------------------------


@query("join_one_to_one", "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def join_one_to_one(t: Testbed):
    out = j.join_one_to_one(t.table("documents").select("doc_id", "n_chars"), t.table("labels"), ["doc_id"])
    return out.select("doc_id", "n_chars", "quality", "toxic")


@query("join_left_checked", "SELECT count(*) AS row_count, count(l.doc_id) AS matched_count, count(*) - count(l.doc_id) AS missing_count FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def join_left_checked(t: Testbed):
    return j.match_report(t.table("documents"), t.table("labels"), ["doc_id"])


@query("join_composite", on("checks", "constraints", body="""SELECT c.prompt_id, c.constraint_index, c.instruction_id, c.followed, k.cluster, k.checker_pass
FROM constraints c JOIN checks k ON k.prompt_id = c.prompt_id AND k.doc_id = c.doc_id"""))
def join_composite(t: Testbed):
    parents = j.unique_keys(t.checks().select("prompt_id", "doc_id", "cluster", "checker_pass"), ["prompt_id", "doc_id"])
    out = t.constraints().join(parents, ["prompt_id", "doc_id"])
    return out.select(
        "prompt_id", F.col("constraint_index").cast("bigint").alias("constraint_index"), "instruction_id", "followed", "cluster", "checker_pass"
    )


@query("label_build", on("promptset", "checks", body="""
gen AS (SELECT sha256('doc:' || doc_id) AS prompt_id, text AS response_text, 'dir' || (doc_id % 3) AS generation_dir_from_outputs FROM documents WHERE doc_id % 37 <> 0),
joined AS (SELECT p.prompt_id, p.num_constraints, c.num_constraints_checked, c.checker_error_count, c.generation_dir, g.response_text, g.generation_dir_from_outputs
 FROM promptset p JOIN (SELECT prompt_id, num_constraints + CASE WHEN doc_id % 41 = 0 THEN 1 ELSE 0 END AS num_constraints_checked, checker_error_count,
   'dir' || (doc_id % 3) AS generation_dir FROM checks WHERE NOT output_truncated) c ON c.prompt_id = p.prompt_id LEFT JOIN gen g ON g.prompt_id = p.prompt_id)
SELECT count(*) AS row_count, CAST(count_if(response_text IS NULL) AS BIGINT) AS missing_response_rows,
 CAST(count_if(num_constraints_checked <> num_constraints) AS BIGINT) AS constraint_count_mismatch_rows, CAST(count_if(checker_error_count > 0) AS BIGINT) AS checker_error_rows,
 CAST(count_if(generation_dir IS DISTINCT FROM generation_dir_from_outputs) AS BIGINT) AS provenance_mismatch_rows,
 count(*) - (SELECT count(*) FROM checks WHERE NOT output_truncated) AS row_count_mismatch FROM joined"""))
def label_build(t: Testbed):
    d = F.col("doc_id")
    folder = F.concat(F.lit("dir"), (d % 3).cast("string"))
    checks = t.checks().select(
        "prompt_id", (F.col("num_constraints") + F.when(d % 41 == 0, 1).otherwise(0)).alias("num_constraints_checked"),
        "checker_error_count", "output_truncated", folder.alias("generation_dir"),
    )
    generations = t.table("documents").filter(d % 37 != 0).select(
        F.expr("sha2('doc:' || doc_id, 256)").alias("prompt_id"), F.col("text").alias("response_text"),
        folder.alias("generation_dir_from_outputs"),
    )
    labelled = j.label_build(t.promptset().select("prompt_id", "num_constraints"), checks, generations)
    return j.label_guards(labelled, checks)


@query("semi_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def semi_ids(t: Testbed):
    wanted = t.table("labels").filter(F.col("toxic") == 0)
    return t.table("documents").select("doc_id", "lang").join(wanted, "doc_id", "left_semi")


COVER = "WITH e AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 1), f AS (SELECT doc_id FROM labels)\n"


def cover(t: Testbed):
    return t.table("documents").select("doc_id").filter(F.col("doc_id") % 3 != 1), t.table("labels").select("doc_id")


@query("coverage", COVER + """SELECT (SELECT count(*) FROM e) AS expected_row_count, (SELECT count(*) FROM f) AS found_row_count,
 (SELECT count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM f)) AS missing_count, (SELECT count(*) FROM f WHERE doc_id NOT IN (SELECT doc_id FROM e)) AS extra_count""")
def coverage(t: Testbed):
    return j.coverage(*cover(t), "doc_id")


@query("coverage_preview", COVER + """SELECT * FROM (SELECT doc_id, 'missing_from_split' AS issue FROM e WHERE doc_id NOT IN (SELECT doc_id FROM f) ORDER BY doc_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT doc_id, 'extra_not_in_all' AS issue FROM f WHERE doc_id NOT IN (SELECT doc_id FROM e) ORDER BY doc_id LIMIT 20)""")
def coverage_preview(t: Testbed):
    return j.coverage_preview(*cover(t), "doc_id", 20)


@query("split_intersection", on("checks", body="""SELECT split AS left_part, CASE WHEN cluster < 12 THEN 'train' ELSE 'test' END AS right_part,
 count(DISTINCT prompt_id) AS shared_ids FROM checks GROUP BY ALL"""))
def split_intersection(t: Testbed):
    other = t.checks().select("prompt_id", F.when(F.col("cluster") < 12, "train").otherwise("test").alias("other_split"))
    return j.overlap_counts(t.checks(), other, "prompt_id", "split", "other_split")


HELD = (REGISTERED[3], REGISTERED[17], REGISTERED[40])


@query("heldout_overlap", on("promptset", body="""SELECT prompt_id, array_to_string(list_sort(list_distinct(list_intersect(instruction_ids, ['{}']))), '|') AS overlap
FROM promptset""".format("', '".join(HELD))))
def heldout_overlap(t: Testbed):
    return t.promptset().select("prompt_id", F.array_join(j.ids_within(F.col("instruction_ids"), HELD), "|").alias("overlap"))


@query("union_runs", on("predictions", body="""SELECT run_id, prompt_id, p_pred, CAST(-1 AS BIGINT) AS cluster FROM predictions WHERE seed = 42
UNION ALL SELECT run_id, prompt_id, NULL AS p_pred, cluster FROM predictions WHERE seed = 43"""))
def union_runs(t: Testbed):
    p = t.predictions()
    return j.union_runs([
        p.filter(F.col("seed") == 42).select("run_id", "prompt_id", "p_pred"),
        p.filter(F.col("seed") == 43).select("cluster", "prompt_id", "run_id"),
    ]).withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


@query("dedup_keep", """SELECT user_id, min_by(event_id, (ts, event_id)) AS first_event, max_by(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id""")
def dedup_keep(t: Testbed):
    e = t.table("events").select("user_id", "ts", "event_id")
    order = F.struct("ts", "event_id")
    first = j.keep_one(e, ["user_id"], order).select("user_id", F.col("event_id").alias("first_event"))
    last = j.keep_one(e, ["user_id"], order, last=True).select("user_id", F.col("event_id").alias("last_event"))
    return first.join(last, "user_id")


@query("lookup_map", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def lookup_map(t: Testbed):
    return j.lookup(t.table("documents").select("doc_id"), t.table("labels"), "doc_id", "quality", -1)


EDGES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in conflict_edges() if a != b)


@query("conflict_pairs", on("promptset", body=f"""edges AS (SELECT * FROM (VALUES {EDGES_SQL}) e(a, b)),
x AS (SELECT DISTINCT prompt_id, unnest(instruction_ids) AS id FROM promptset)
SELECT l.prompt_id, e.a AS instruction_a, e.b AS instruction_b FROM x l JOIN edges e ON e.a = l.id JOIN x r ON r.prompt_id = l.prompt_id AND r.id = e.b"""))
def conflict_pairs(t: Testbed):
    return j.conflict_pairs(t.promptset())
