"""Split and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespan.functions.rules import REGISTERED
from rulespan.operators import joins as j
from rulespan.operators import normalize as n
from rulespan.operators import profile as p
from rulespan.operators import sampling as s
from rulespan.operators import splits as sp
from rulespan.plans.catalog import query
from rulespan.plans.q_metrics import rounded
from rulespan.plans.q_profile import cif, excess_sql
from rulespan.plans.testbed import Testbed, with_tables


def on(*names: str, body: str) -> str:
    return with_tables(*names, body=body)


def label_sql(src: str, out: str, min_count: int) -> str:
    return f"""{out}_c AS (SELECT *, num_constraints || '::' || coalesce(constraint_family_signature, '__missing__') AS raw_label FROM {src}),
{out}_r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY raw_label) < {min_count} THEN num_constraints || '::{sp.RARE}' ELSE raw_label END AS lab FROM {out}_c),
{out} AS (SELECT * EXCLUDE (raw_label, lab), lab AS strat_label FROM {out}_r)"""


def take_sql(src: str, out: str, seed: int, fraction: float | None = None, size: int | None = None, key: str = "prompt_id") -> str:
    k = f"CAST(ceil(count(*) * {fraction!r}::DOUBLE) AS BIGINT)" if fraction is not None else f"least({size}, count(*))"
    return f"""{out}_s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY strat_label) < 2 THEN '' ELSE strat_label END AS st FROM {src}),
{out}_t AS (SELECT count(*) AS total, {k} AS k FROM {src}),
{out}_q AS (SELECT st, count(*) AS n, (SELECT total FROM {out}_t) AS total, (SELECT k FROM {out}_t) AS k FROM {out}_s GROUP BY st),
{out}_b AS (SELECT st, k, n * k // total AS base, (n * k) % total AS rest FROM {out}_q),
{out}_x AS (SELECT st, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, st) <= k - (SELECT sum(base) FROM {out}_b) THEN 1 ELSE 0 END AS quota FROM {out}_b),
{out} AS (SELECT s.* EXCLUDE (st), row_number() OVER (PARTITION BY s.st ORDER BY sha256('{seed}:' || {key}), {key}) <= x.quota AS taken FROM {out}_s s JOIN {out}_x x ON x.st = s.st)"""


IID = f"""{label_sql('promptset', 'l1', 20)},
{take_sql('l1', 't1', 42, 0.1 + 0.1)},
rest AS (SELECT * EXCLUDE (strat_label, taken) FROM t1 WHERE taken),
{label_sql('rest', 'l2', 2)},
{take_sql('l2', 't2', 43, 0.1 / (0.1 + 0.1))},
iid AS (SELECT prompt_id, base_key, num_constraints, instruction_ids, 'train' AS split FROM t1 WHERE NOT taken UNION ALL
 SELECT prompt_id, base_key, num_constraints, instruction_ids, CASE WHEN taken THEN 'test' ELSE 'val' END FROM t2)"""


@query("strat_label", on("promptset", body=label_sql("promptset", "l1", 20) + " SELECT prompt_id, strat_label FROM l1"))
def strat_label(t: Testbed):
    return sp.stratify_labels(t.promptset(), 20).select("prompt_id", "strat_label")


@query("stratified_split", on("promptset", body=label_sql("promptset", "l1", 20) + ", " + take_sql("l1", "t1", 7, 0.25)
       + " SELECT prompt_id, strat_label, taken FROM t1"))
def stratified_split(t: Testbed):
    rows = sp.stratify_labels(t.promptset().select("prompt_id", "num_constraints", "constraint_family_signature"), 20)
    return sp.take_stratified(rows, "strat_label", 7, 0.25).select("prompt_id", "strat_label", "taken")


def shown(df):
    return df.select("prompt_id", "base_key", "split", "split_name", "split_type", "seed", F.array_join("heldout_instruction_ids", "|").alias("heldout"))


def shown_sql(table: str, name: str, kind: str, held: str = "''") -> str:
    return f"SELECT prompt_id, base_key, split, '{name}' AS split_name, '{kind}' AS split_type, 42 AS seed, {held} AS heldout FROM {table}"


@query("split_iid", on("promptset", body=IID + shown_sql("iid", "iid_seed42", "iid_prompt")))
def split_iid(t: Testbed):
    return shown(sp.split_iid(t.promptset()))


GROUP = f"""{label_sql('promptset', 'l1', 20)},
modes AS (SELECT base_key, strat_label FROM (SELECT base_key, strat_label, row_number() OVER (PARTITION BY base_key ORDER BY count(*) DESC, strat_label) AS rn
 FROM l1 GROUP BY base_key, strat_label) WHERE rn = 1),
{take_sql('modes', 't1', 42, 0.2, key='base_key')},
rest AS (SELECT base_key, strat_label FROM t1 WHERE taken),
{take_sql('rest', 't2', 43, 0.5, key='base_key')},
parts AS (SELECT base_key, 'train' AS split FROM t1 WHERE NOT taken UNION ALL SELECT base_key, CASE WHEN taken THEN 'test' ELSE 'val' END FROM t2),
grp AS (SELECT p.*, parts.split FROM promptset p JOIN parts USING (base_key))"""


@query("split_group", on("promptset", body=GROUP + shown_sql("grp", "group_key_seed42", "base_key_group")))
def split_group(t: Testbed):
    return shown(sp.split_group(t.promptset()))


@query("split_c1", on("promptset", body="c AS (SELECT *, CASE WHEN num_constraints <= 3 THEN 'train' WHEN num_constraints = 4 THEN 'val' ELSE 'test' END AS split FROM promptset)"
       + shown_sql("c", "composition_heldout_c1", "composition_heldout")))
def split_c1(t: Testbed):
    return shown(sp.split_composition_c1(t.promptset()))


@query("split_c2", on("promptset", body=f"""held AS (SELECT * FROM promptset WHERE num_constraints = 5), {label_sql('held', 'l1', 2)}, {take_sql('l1', 't1', 42, 0.8)},
c AS (SELECT prompt_id, base_key, 'train' AS split FROM promptset WHERE num_constraints < 5 UNION ALL SELECT prompt_id, base_key, CASE WHEN taken THEN 'test' ELSE 'val' END FROM t1)"""
       + shown_sql("c", "composition_heldout_c2", "composition_heldout")))
def split_c2(t: Testbed):
    return shown(sp.split_composition_c2(t.promptset()))


@query("heldout_ids", on("promptset", body=f"""
freq AS (SELECT id AS instruction_id, split_part(id, ':', 1) AS family, count(*) AS frequency FROM (SELECT unnest(instruction_ids) AS id FROM promptset) GROUP BY ALL),
full_freq AS (SELECT *, CAST(sum(frequency) OVER (PARTITION BY family) AS BIGINT) AS family_frequency FROM freq),
cand AS (SELECT * FROM full_freq WHERE frequency >= 10 AND frequency <= (SELECT floor(quantile_cont(frequency::DOUBLE, 0.9)) FROM freq) AND family_frequency >= 100)
SELECT instruction_id, family, frequency, family_frequency FROM (SELECT *, row_number() OVER (ORDER BY sha256('42:' || instruction_id), instruction_id) AS rn FROM cand)
WHERE rn <= greatest(1, (SELECT round_even(count(*) * 0.1::DOUBLE, 0) FROM cand))"""))
def heldout_ids(t: Testbed):
    return sp.heldout_ids(t.promptset(), min_frequency=10, min_family_frequency=100)


HELD = (REGISTERED[5], REGISTERED[30])
OVERLAP = "array_to_string(list_sort(list_distinct(list_intersect(instruction_ids, ['{}']))), '|')".format("', '".join(HELD))
ATOMIC = f"""o AS (SELECT *, {OVERLAP} AS held FROM promptset), kept AS (SELECT * FROM o WHERE held = ''), {label_sql('kept', 'l1', 20)}, {take_sql('l1', 't1', 42, 0.1)},
atomic AS (SELECT prompt_id, base_key, instruction_ids, 'test' AS split, held FROM o WHERE held <> '' UNION ALL
 SELECT prompt_id, base_key, instruction_ids, CASE WHEN taken THEN 'val' ELSE 'train' END, '' FROM t1)"""


@query("split_atomic", on("promptset", body=ATOMIC + shown_sql("atomic", "atomic_constraint_heldout_seed42", "atomic_constraint_heldout", "held")))
def split_atomic(t: Testbed):
    return shown(sp.split_atomic(t.promptset(), HELD))


@query("split_validate", on("promptset", body=IID + f""" SELECT CAST(abs(count(*) - (SELECT count(*) FROM promptset)) AS BIGINT) AS row_count_gap, CAST(0 AS BIGINT) AS unassigned_rows,
 {cif("split <> 'test' AND len(list_intersect(instruction_ids, ['" + "', '".join(HELD) + "'])) > 0")} AS heldout_leak_rows, CAST(0 AS BIGINT) AS duplicate_prompt_ids,
 (SELECT count(*) FROM (SELECT base_key FROM iid GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS base_key_leaks FROM iid"""))
def split_validate(t: Testbed):
    rows = t.promptset()
    return sp.validate(sp.split_iid(rows), rows.count(), HELD)


@query("heldout_manifest")
def heldout_manifest(t: Testbed):
    rows = t.promptset()
    record = sp.heldout_manifest(sp.split_atomic(rows, HELD), sp.heldout_ids(rows, 10, min_family_frequency=100))
    return record.select(F.to_json(F.struct("*")).alias("manifest"))


TWO = """two AS (SELECT prompt_id, base_key, constraint_signature, cluster, checker_pass, output_truncated, prompt_tokens, split, 'by_row' AS split_name FROM checks UNION ALL
 SELECT prompt_id, base_key, constraint_signature, cluster, checker_pass, output_truncated, prompt_tokens, CASE WHEN CAST(split_part(base_key, '_', 2) AS BIGINT) < 40 THEN 'train' ELSE 'test' END, 'group_key' FROM checks WHERE doc_id % 100 <> 0)"""


def two_splits(t: Testbed):
    cols = ["prompt_id", "base_key", "constraint_signature", "cluster", "checker_pass", "output_truncated", "prompt_tokens"]
    number = F.split_part("base_key", F.lit("_"), F.lit(2)).cast("bigint")
    return t.checks().select(*cols, "split", F.lit("by_row").alias("split_name")).unionByName(
        t.checks().filter(F.col("doc_id") % 100 != 0).select(
            *cols, F.when(number < 40, "train").otherwise("test").alias("split"), F.lit("group_key").alias("split_name")
        )
    )


def leak_sql(column: str) -> str:
    return f"(SELECT split_name, count(*) AS n FROM (SELECT split_name, {column} FROM two GROUP BY ALL HAVING count(DISTINCT split) > 1) GROUP BY split_name)"


@query("split_audit", on("checks", body=TWO + f""",
cells AS (SELECT split_name, split, cluster, count(*) AS n FROM two GROUP BY ALL),
sh AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY split_name, split) AS s, (sum(n) OVER (PARTITION BY split_name, cluster))::DOUBLE / sum(n) OVER (PARTITION BY split_name) AS g FROM cells),
tvd AS (SELECT split_name, max(d) AS d FROM (SELECT split_name, split, 0.5 * (sum(abs(s - g)) + 1 - sum(g)) AS d FROM sh GROUP BY ALL) GROUP BY ALL),
parts AS (SELECT split_name, string_agg(split || ':' || n || ':' || ok || ':' || cut || ':' || CAST(round(ok::DOUBLE / n, 6) AS VARCHAR), ';' ORDER BY split || ':' || n) AS pass_by_split
 FROM (SELECT split_name, split, count(*) AS n, count_if(checker_pass) AS ok, count_if(output_truncated) AS cut FROM two GROUP BY ALL) GROUP BY ALL),
again AS (SELECT split_name, CAST(sum(n) AS BIGINT) AS base_key_duplicate_rows FROM (SELECT split_name, base_key, count(*) AS n FROM two GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
base AS (SELECT split_name, count(*) AS row_count, CAST(0 AS BIGINT) AS prompt_duplicate_rows, CAST(0 AS BIGINT) AS extra_prompt_id_count,
 (SELECT count(*) FROM checks) - count(DISTINCT prompt_id) AS missing_prompt_id_count FROM two GROUP BY ALL)
SELECT b.*, pass_by_split, coalesce(base_key_duplicate_rows, 0) AS base_key_duplicate_rows, coalesce(p.n, 0) AS prompt_leaks, coalesce(k.n, 0) AS base_key_leaks, round(d, 9) AS max_cluster_tvd,
 coalesce(p.n, 0) > 0 OR missing_prompt_id_count > 0 OR (b.split_name LIKE '%group_key%' AND coalesce(k.n, 0) > 0) AS critical
FROM base b LEFT JOIN {leak_sql('prompt_id')} p ON p.split_name = b.split_name LEFT JOIN {leak_sql('base_key')} k ON k.split_name = b.split_name JOIN tvd ON tvd.split_name = b.split_name JOIN parts ON parts.split_name = b.split_name LEFT JOIN again ON again.split_name = b.split_name"""))
def split_audit(t: Testbed):
    return rounded(p.split_audit(two_splits(t), t.checks().select("prompt_id")), "max_cluster_tvd")


@query("split_overview", on("checks", body=TWO + f""" SELECT split_name, {cif("split = 'train'")} AS train_rows, {cif("split = 'val'")} AS val_rows, {cif("split = 'test'")} AS test_rows,
 round(count_if(split = 'test' AND checker_pass)::DOUBLE / count_if(split = 'test'), 9) AS test_positive_rate,
 count(DISTINCT CASE WHEN split = 'test' THEN constraint_signature END) AS test_signature_count FROM two GROUP BY split_name"""))
def split_overview(t: Testbed):
    return rounded(p.split_overview(two_splits(t).drop("checker_pass"), t.checks()), "test_positive_rate")


AUDIT_HELD = "len(list_intersect(instruction_ids, ['" + "', '".join(HELD) + "'])) > 0"


@query("audit_table", on("promptset", "checks", body=ATOMIC + f""",
n AS (SELECT (SELECT {cif(f"split = 'train' AND {AUDIT_HELD}")} FROM atomic) AS tr, (SELECT {cif(f"split = 'val' AND {AUDIT_HELD}")} FROM atomic) AS va, (SELECT {cif(f"split = 'test' AND {AUDIT_HELD}")} FROM atomic) AS te,
 (SELECT count(*) FROM (SELECT base_key FROM atomic GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS keys, (SELECT duplicate_rows FROM ({excess_sql('prompt_id')})) AS dups,
 (SELECT count(*) FROM (SELECT cluster FROM checks GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS cl)
SELECT 'held-out rules stay out of train and val' AS audit_item, CASE WHEN tr + va = 0 THEN 'pass' ELSE 'fail' END AS status, 'train=' || tr || ', val=' || va || ', test=' || te AS evidence FROM n UNION ALL
SELECT 'prompt ids are unique', CASE WHEN dups = 0 THEN 'pass' ELSE 'fail' END, 'duplicate rows=' || dups FROM n UNION ALL
SELECT 'task keys stay in one part', CASE WHEN keys = 0 THEN 'pass' ELSE 'caveat' END, 'leaked keys=' || keys FROM n UNION ALL
SELECT 'clusters stay in one part', CASE WHEN cl = 0 THEN 'pass' ELSE 'caveat' END, 'clusters in several parts=' || cl FROM n"""))
def audit_table(t: Testbed):
    atomic = sp.split_atomic(t.promptset(), HELD)
    hit = F.size(j.ids_within(F.col("instruction_ids"), HELD)) > 0
    counts = atomic.agg(*[F.count_if((F.col("split") == x) & hit).alias(x) for x in ("train", "val", "test")]).withColumns({
        "dups": p.duplicates_excess(t.promptset(), ["prompt_id"]).select("duplicate_rows").scalar(),
        "keys": p.leakage_summary(atomic, "base_key", "split").select("leaked_value_count").scalar(),
        "clusters": p.leakage_summary(t.checks(), "cluster", "split").select("leaked_value_count").scalar(),
    })
    rows = [
        ("held-out rules stay out of train and val", F.col("train") + F.col("val"), "fail",
         F.format_string("train=%d, val=%d, test=%d", "train", "val", "test")),
        ("prompt ids are unique", F.col("dups"), "fail", F.format_string("duplicate rows=%d", "dups")),
        ("task keys stay in one part", F.col("keys"), "caveat", F.format_string("leaked keys=%d", "keys")),
        ("clusters stay in one part", F.col("clusters"), "caveat", F.format_string("clusters in several parts=%d", "clusters")),
    ]
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("audit_item"), F.when(found == 0, "pass").otherwise(bad).alias("status"), text.alias("evidence"))
        for name, found, bad, text in rows
    ])))


# --- samples ---------------------------------------------------------------------------------------------------

def alloc_sql(size: int) -> str:
    return f"""cnt AS (SELECT cluster, count(*) AS n FROM uneven GROUP BY 1),
raw AS (SELECT cluster, n, sqrt(n) / sum(sqrt(n)) OVER () * {size} AS raw FROM cnt), a0 AS (SELECT *, CAST(greatest(floor(raw), 1) AS BIGINT) AS a FROM raw),
gap AS (SELECT CAST({size} - sum(a) AS BIGINT) AS g FROM a0),
units AS (SELECT cluster, 1 AS step, raw - a - (j - 1) AS v FROM a0, (SELECT unnest(range(1, 60)) AS j) WHERE (SELECT g FROM gap) > 0 UNION ALL
 SELECT cluster, -1, a - raw - (j - 1) FROM a0, (SELECT unnest(range(1, 200)) AS j) WHERE (SELECT g FROM gap) < 0 AND j < a),
steps AS (SELECT cluster, sum(step) AS d FROM (SELECT *, row_number() OVER (ORDER BY v DESC, cluster) AS rn FROM units) WHERE rn <= abs((SELECT g FROM gap)) GROUP BY 1),
alloc AS (SELECT a0.cluster, n, CAST(a + coalesce(d, 0) AS BIGINT) AS allocation FROM a0 LEFT JOIN steps ON steps.cluster = a0.cluster)"""


UNEVEN = "uneven AS (SELECT prompt_id, prompt_tokens, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE cluster END AS cluster FROM checks)"


def uneven(t: Testbed):
    """A third of all rows sits in one cluster."""
    return t.checks().select("prompt_id", "prompt_tokens", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("cluster")).alias("cluster"))


@query("alloc_sqrt", on("checks", body=f"{UNEVEN}, {alloc_sql(150)} SELECT * FROM alloc"))
def alloc_sqrt(t: Testbed):
    return s.allocate_sqrt(uneven(t).groupBy("cluster").agg(F.count("*").alias("n")), "cluster", 150)


CHUNK = """placed AS (SELECT u.*, n, allocation, row_number() OVER (PARTITION BY u.cluster ORDER BY prompt_tokens, prompt_id) - 1 AS pos FROM uneven u JOIN alloc a ON a.cluster = u.cluster),
chunked AS (SELECT *, CASE WHEN allocation >= n THEN pos WHEN pos < (n % allocation) * (n // allocation + 1) THEN pos // (n // allocation + 1)
 ELSE n % allocation + (pos - (n % allocation) * (n // allocation + 1)) // (n // allocation) END AS chunk FROM placed),
drawn AS (SELECT prompt_id, prompt_tokens, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster, chunk ORDER BY sha256('5:' || prompt_id), prompt_id) AS rn FROM chunked) WHERE rn = 1)"""


@query("chunk_sample", on("checks", body=f"{UNEVEN}, {alloc_sql(150)}, {CHUNK} SELECT * FROM drawn"))
def chunk_sample(t: Testbed):
    rows = uneven(t)
    alloc = s.allocate_sqrt(rows.groupBy("cluster").agg(F.count("*").alias("n")), "cluster", 150)
    return s.chunk_sample(rows, alloc, "cluster", 5).select("prompt_id", "prompt_tokens", "cluster")


@query("cluster_length_sample", on("checks", body=f"""{UNEVEN}, {alloc_sql(150)}, {CHUNK},
ends AS (SELECT arg_min(prompt_id, (prompt_tokens, prompt_id)) AS prompt_id FROM uneven UNION SELECT arg_min(prompt_id, (-prompt_tokens, prompt_id)) FROM uneven),
merged AS (SELECT u.*, CASE WHEN e.prompt_id IS NULL THEN 0 ELSE 1 END AS keep FROM uneven u LEFT JOIN ends e ON e.prompt_id = u.prompt_id
 WHERE u.prompt_id IN (SELECT prompt_id FROM drawn) OR e.prompt_id IS NOT NULL),
counted AS (SELECT *, greatest(count(*) OVER () - 150, 0) AS over_n, sum(1 - keep) OVER () AS m, sum(1 - keep) OVER (ORDER BY cluster, prompt_tokens, prompt_id) - 1 AS spot FROM merged),
kept AS (SELECT * FROM counted WHERE keep = 1 OR over_n = 0 OR NOT list_contains(list_transform(range(0, over_n), lambda i: CASE WHEN over_n = 1 THEN 0 ELSE CAST(floor(i * ((m - 1)::DOUBLE / (over_n - 1))) AS BIGINT) END), spot))
SELECT prompt_id, prompt_tokens, cluster, row_number() OVER (ORDER BY sha256('5:' || prompt_id), prompt_id) AS position FROM kept"""))
def cluster_length_sample(t: Testbed):
    out = s.cluster_length_sample(uneven(t), 150, 5)
    return out.select("prompt_id", "prompt_tokens", "cluster", F.col("position").cast("bigint").alias("position"))


@query("length_grid_sample", on("checks", body="""
l AS (SELECT prompt_tokens, min(prompt_id) AS prompt_id, row_number() OVER (ORDER BY prompt_tokens) - 1 AS spot FROM checks GROUP BY prompt_tokens),
m AS (SELECT count(*) AS m FROM l), grid AS (SELECT DISTINCT CAST(round_even(i * ((m - 1) / 99.0::DOUBLE), 0) AS BIGINT) AS spot FROM m, (SELECT unnest(range(0, 100)) AS i)),
fill AS (SELECT spot FROM l WHERE spot NOT IN (SELECT spot FROM grid) ORDER BY spot LIMIT (SELECT greatest(100 - count(*), 0) FROM grid))
SELECT prompt_tokens, prompt_id FROM l WHERE spot IN (SELECT spot FROM grid) OR spot IN (SELECT spot FROM fill)"""))
def length_grid_sample(t: Testbed):
    return s.length_grid_sample(t.checks().select("prompt_id", "prompt_tokens"), 100)


@query("outcome_sample", on("checks", body="""
c AS (SELECT cluster, count_if(checker_pass) AS p, count_if(NOT checker_pass) AS f FROM checks GROUP BY 1),
k AS (SELECT cluster, p, f, least(CASE WHEN p::DOUBLE / (p + f) >= 0.2 THEN 20 ELSE 10 END, p, 15) AS take FROM c),
k2 AS (SELECT *, least(30 - take, f) AS fails FROM k), k3 AS (SELECT *, take + least(30 - take - fails, p - take) AS passes FROM k2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster, checker_pass ORDER BY sha256('42:' || prompt_id), prompt_id) AS rn FROM checks)
SELECT prompt_id, r.cluster, checker_pass FROM r JOIN k3 ON k3.cluster = r.cluster WHERE rn <= CASE WHEN checker_pass THEN passes ELSE fails END"""))
def outcome_sample(t: Testbed):
    return s.outcome_sample(t.checks().select("prompt_id", "cluster", "checker_pass"), 30, 42)


@query("audit_sample", on("checks", body="""
r AS (SELECT *, row_number() OVER (PARTITION BY checker_pass, output_truncated ORDER BY sha256('42:' || prompt_id), prompt_id) AS a,
 row_number() OVER (PARTITION BY cluster, checker_pass ORDER BY sha256('43:' || prompt_id), prompt_id) AS b FROM checks)
SELECT prompt_id, cluster, CASE WHEN a <= 8 THEN CASE WHEN checker_pass THEN 'pass' ELSE 'fail' END || '_' || CASE WHEN output_truncated THEN 'truncated' ELSE 'not_truncated' END
 ELSE 'cluster_' || cluster || CASE WHEN checker_pass THEN '_pass' ELSE '_fail' END END AS audit_group FROM r WHERE a <= 8 OR (cluster IN (3, 7, 11) AND b <= 4)"""))
def audit_sample(t: Testbed):
    rows = t.checks().select("prompt_id", "cluster", "checker_pass", "output_truncated")
    return s.audit_sample(rows, 42, 8, 4, [3, 7, 11]).select("prompt_id", "cluster", "audit_group")


@query("per_id_sample", on("constraints", body="""SELECT instruction_id, prompt_id FROM (SELECT *, row_number() OVER (PARTITION BY instruction_id ORDER BY sha256('9:' || prompt_id), prompt_id) AS rn FROM constraints) WHERE rn <= 6"""))
def per_id_sample(t: Testbed):
    return s.per_group_sample(t.constraints().select("instruction_id", "prompt_id"), ["instruction_id"], 6, 9)


@query("inspect_sample", on("promptset", "checks", body="""SELECT c.prompt_id, c.split, CASE WHEN length(user_prompt) <= 100 THEN user_prompt ELSE substr(user_prompt, 1, 100) || '...[truncated]' END AS user_prompt
FROM checks c JOIN promptset p ON p.prompt_id = c.prompt_id WHERE c.split = 'test' ORDER BY sha256('42:' || c.prompt_id), c.prompt_id LIMIT 12"""))
def inspect_sample(t: Testbed):
    picked = s.per_group_sample(t.checks().filter(F.col("split") == "test").select("prompt_id", "split"), [], 12, 42)
    return picked.join(t.promptset().select("prompt_id", "user_prompt"), "prompt_id").withColumn(
        "user_prompt", n.clip(F.col("user_prompt"), 100, "...[truncated]")
    )


@query("size_ladder", on("promptset", body="""
r AS (SELECT prompt_id, row_number() OVER (ORDER BY sha256('42:' || prompt_id), prompt_id) AS rn, count(*) OVER () AS total FROM promptset)
SELECT prompt_id, CASE WHEN size IS NULL THEN 'full' WHEN total < size THEN name || '/full' ELSE name END AS size_label FROM r,
 (VALUES (200, '200'), (1000, '1k'), (2000000, '2000k'), (NULL, '')) s(size, name) WHERE rn <= coalesce(size, total)"""))
def size_ladder(t: Testbed):
    return s.size_ladder(t.promptset().select("prompt_id"), [200, 1000, 2_000_000, None], 42)


@query("budget_sample", on("promptset", body=label_sql("promptset", "l1", 2) + ", " + take_sql("l1", "t1", 42, size=256) + " SELECT prompt_id, strat_label FROM t1 WHERE taken"))
def budget_sample(t: Testbed):
    rows = sp.stratify_labels(t.promptset().select("prompt_id", "num_constraints", "constraint_family_signature"), 2)
    return sp.take_stratified(rows, "strat_label", 42, size=256).filter("taken").select("prompt_id", "strat_label")
