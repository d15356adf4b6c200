"""Inputs of the registered queries, derived from the given tables.

Each derivation exists twice with the same formula: as a DataFrame here and as a SQL common table expression in
``CTE`` for the oracle. Numbers such as a score are integer formulas over ``doc_id``, so both sides hold the
same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulespan.functions.columns import length_bin
from rulespan.functions.rules import REGISTERED
from rulespan.sources.tables import dealt_out

# The runs of the prediction table, (model family, size label, seed, score shift, label gain).
FAMILIES = ("frozen", "tfidf", "tiny")
SIZES = ("40k", "full")
SEEDS = (42, 43, 44)
RUNS = [
    (family, size, seed, seed * 97 + m * 331 + s * 53, 120 + 40 * m + 60 * s)
    for m, family in enumerate(FAMILIES)
    for s, size in enumerate(SIZES)
    for seed in SEEDS
]
# One configuration with a single run.
RUNS.append(("tiny", "20k", 42, 4171, 170))


class Testbed:
    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def texts(self, *columns: str) -> DataFrame:
        """Documents for work that is heavy per row."""
        rows = self.table("documents")
        return dealt_out(rows.select(*columns) if columns else rows)

    def promptset(self) -> DataFrame:
        ids = F.transform(
            F.sequence(F.lit(0), (F.col("doc_id") % 5).cast("int")),
            lambda j: F.element_at(
                F.array(*map(F.lit, REGISTERED)), ((F.col("doc_id") * 7 + j * 11) % len(REGISTERED) + 1).cast("int")
            ),
        )
        families = F.transform(F.col("instruction_ids"), lambda n: F.substring_index(n, ":", 1))
        return (
            self.table("documents")
            .select(
                "doc_id",
                F.sha2(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), 256).alias("prompt_id"),
                F.concat("source", F.lit("_"), (F.col("doc_id") % 50).cast("string")).alias("base_key"),
                F.col("text").alias("user_prompt"),
                (F.col("doc_id") % 5 + 1).alias("num_constraints"),
                F.col("source").alias("source_dataset"),
                F.when(F.col("doc_id") % 2 == 0, "multi").otherwise("single").alias("constraint_type"),
                "lang",
                "n_chars",
            )
            .withColumn("instruction_ids", ids)
            .withColumn("constraint_signature", F.array_join(F.array_sort("instruction_ids"), "|"))
            .withColumn("constraint_family_signature", F.array_join(F.array_sort(families), "|"))
        )

    def checks(self) -> DataFrame:
        """One row per prompt with its label, token counts and truncation flags."""
        quality = self.table("labels").select("doc_id", "quality")
        d = F.col("doc_id")
        return (
            self.promptset()
            .join(quality, "doc_id", "left")
            .select(
                "doc_id", "prompt_id", "base_key", "num_constraints", "instruction_ids", "constraint_signature",
                "constraint_family_signature", "source_dataset", "constraint_type",
                F.coalesce(F.col("quality") == 1, (d * 31) % 10 < 3).alias("checker_pass"),
                F.when(d % 17 == 0, 1).otherwise(0).cast("bigint").alias("checker_error_count"),
                F.col("n_chars").alias("prompt_tokens"),
                ((F.col("n_chars") * 3) % 1500).alias("output_tokens"),
                (F.col("n_chars") > 2048).alias("output_truncated"),
                F.when(F.col("n_chars") % 7 == 0, "length").otherwise("stop").alias("finish_reason"),
                (d % 24).alias("cluster"),
                length_bin(F.col("n_chars")).alias("length_bin"),
                F.when(d % 10 < 7, "train").when(d % 10 == 7, "val").otherwise("test").alias("split"),
            )
        )

    def constraints(self) -> DataFrame:
        """One row per prompt and constraint, with a stored verdict."""
        d, i = F.col("doc_id"), F.col("constraint_index")
        return (
            self.promptset()
            .select("doc_id", "prompt_id", F.posexplode("instruction_ids").alias("constraint_index", "instruction_id"))
            .withColumn("followed", (d * 13 + i * 5) % 7 < 4)
            .withColumn("checker_error", (d + i * 3) % 29 == 0)
        )

    def predictions(self) -> DataFrame:
        """19 runs (3 families x 2 sizes x 3 seeds, and one alone) over val and test rows; scores hold many ties."""
        runs = F.array(
            *[
                F.struct(
                    F.lit(family).alias("model_family"), F.lit(size).alias("train_size_label"),
                    F.lit(seed).cast("bigint").alias("seed"), F.lit(shift).alias("shift"), F.lit(gain).alias("gain"),
                )
                for family, size, seed, shift, gain in RUNS
            ]
        )
        score = F.least(
            F.lit(1000),
            (F.col("doc_id") * 7919 + F.col("shift") * F.col("doc_id") % 503) % 900 + F.col("gain") * F.col("label"),
        )
        return (
            self.checks()
            .filter(F.col("split") != "train")
            .select(
                "doc_id", "prompt_id", "base_key", "split", F.col("checker_pass").cast("int").alias("label"),
                "num_constraints", "instruction_ids", "constraint_family_signature", "cluster", "length_bin",
                "source_dataset", "constraint_type", F.explode(runs).alias("run"),
            )
            .select("*", "run.*")
            .drop("run")
            .withColumn(
                "run_id", F.concat_ws("-", "model_family", "train_size_label", F.col("seed").cast("string"))
            )
            .withColumn("p_pred", score.cast("double") / F.lit(1000.0))
            .drop("shift", "gain")
        )

    def pairs(self) -> DataFrame:
        """User turn joined to the assistant turn that follows it."""
        talk = self.table("conversations")
        user = talk.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user_prompt"))
        answer = talk.filter(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_text")
        )
        return user.join(answer, ["conv_id", "turn"]).withColumn(
            "prompt_id",
            F.sha2(
                F.concat(
                    F.lit("conv:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")
                ),
                256,
            ),
        )


_RULE_LIST = "[" + ", ".join(f"'{n}'" for n in REGISTERED) + "]"
_RUN_VALUES = ", ".join(
    f"('{family}', '{size}', CAST({seed} AS BIGINT), {shift}, {gain})" for family, size, seed, shift, gain in RUNS
)

# The same derivations for the oracle, in dependency order.
CTE = {
    "promptset": f"""promptset AS (
  SELECT *, array_to_string(list_sort(instruction_ids), '|') AS constraint_signature,
         array_to_string(list_sort(list_transform(instruction_ids, lambda x: split_part(x, ':', 1))), '|')
           AS constraint_family_signature
  FROM (SELECT doc_id, sha256('doc:' || doc_id) AS prompt_id, source || '_' || (doc_id % 50) AS base_key,
               text AS user_prompt, doc_id % 5 + 1 AS num_constraints, source AS source_dataset,
               CASE WHEN doc_id % 2 = 0 THEN 'multi' ELSE 'single' END AS constraint_type, lang, n_chars,
               list_transform(range(0, doc_id % 5 + 1),
                              lambda j: ({_RULE_LIST})[(doc_id * 7 + j * 11) % {len(REGISTERED)} + 1]) AS instruction_ids
        FROM documents))""",
    "checks": """checks AS (
  SELECT p.doc_id, prompt_id, base_key, num_constraints, instruction_ids, constraint_signature,
         constraint_family_signature, source_dataset, constraint_type,
         coalesce(l.quality = 1, (p.doc_id * 31) % 10 < 3) AS checker_pass,
         CAST(CASE WHEN p.doc_id % 17 = 0 THEN 1 ELSE 0 END AS BIGINT) AS checker_error_count,
         n_chars AS prompt_tokens, (n_chars * 3) % 1500 AS output_tokens, n_chars > 2048 AS output_truncated,
         CASE WHEN n_chars % 7 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, p.doc_id % 24 AS cluster,
         CASE WHEN n_chars < 128 THEN '001-128' WHEN n_chars < 256 THEN '129-256' WHEN n_chars < 512 THEN '257-512'
              WHEN n_chars < 1024 THEN '513-1024' WHEN n_chars < 2048 THEN '1025-2047' ELSE 'nan' END AS length_bin,
         CASE WHEN p.doc_id % 10 < 7 THEN 'train' WHEN p.doc_id % 10 = 7 THEN 'val' ELSE 'test' END AS split
  FROM promptset p LEFT JOIN labels l ON p.doc_id = l.doc_id)""",
    "constraints": """constraints AS (
  SELECT doc_id, prompt_id, constraint_index, instruction_id,
         (doc_id * 13 + constraint_index * 5) % 7 < 4 AS followed,
         (doc_id + constraint_index * 3) % 29 = 0 AS checker_error
  FROM (SELECT doc_id, prompt_id, unnest(instruction_ids) AS instruction_id,
               unnest(range(0, len(instruction_ids))) AS constraint_index FROM promptset))""",
    "predictions": f"""predictions AS (
  SELECT *, CAST(least(1000, (doc_id * 7919 + shift * doc_id % 503) % 900 + gain * label) AS DOUBLE) / 1000 AS p_pred,
         model_family || '-' || train_size_label || '-' || seed AS run_id
  FROM (SELECT doc_id, prompt_id, base_key, split, CAST(checker_pass AS INTEGER) AS label, num_constraints,
               instruction_ids, constraint_family_signature, cluster, length_bin, source_dataset, constraint_type
        FROM checks WHERE split <> 'train'),
       (VALUES {_RUN_VALUES}) AS runs(model_family, train_size_label, seed, shift, gain))""",
    "pairs": """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS user_prompt, a.text AS response_text,
         sha256('conv:' || u.conv_id || ':' || u.turn) AS prompt_id
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')""",
}
_NEEDS = {"checks": ("promptset",), "constraints": ("promptset",), "predictions": ("promptset", "checks")}


def with_tables(*names: str, body: str) -> str:
    """Prefix a SELECT (or further ``name AS (...)`` expressions, then a SELECT) with the derived tables it reads."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in (*_NEEDS.get(name, ()), name) if n not in wanted]
    head = ",\n".join(CTE[n] for n in CTE if n in wanted)
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {head}\n{body}"
    return f"WITH {head},\n{body}"


def typed(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]
