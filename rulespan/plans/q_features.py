"""Feature, vocabulary and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespan.functions import text as tx
from rulespan.operators import features as f
from rulespan.operators import models as ml
from rulespan.operators import normalize as n
from rulespan.operators import profile as p
from rulespan.operators import terms, vocabulary
from rulespan.operators.metrics import area_metrics, curve, score_counts
from rulespan.operators.vocabulary import ngram_ids
from rulespan.plans import sqltext as q
from rulespan.plans.catalog import query
from rulespan.plans.q_metrics import rounded
from rulespan.plans.q_profile import cif
from rulespan.plans.testbed import Testbed, with_tables
from rulespan.session import content_key, publish, published, written


def on(*names: str, body: str) -> str:
    return with_tables(*names, body=body)


PRETOKEN_SQL = r"'''(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+'"


@query("pretoken_freq", f"""SELECT pretoken, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(text, {PRETOKEN_SQL})) AS pretoken FROM documents WHERE doc_id % 10 < 7)
GROUP BY pretoken HAVING count(*) >= 2""")
def pretoken_freq(t: Testbed):
    train = t.texts("doc_id", "text").filter(F.col("doc_id") % 10 < 7)
    return f.pretoken_frequency(train, "text", 2)


# The size of the vocabulary: special tokens, bytes and merges.
VOCABULARY = 8_000


def _training(t: Testbed):
    return t.texts("doc_id", "text").filter(F.col("doc_id") % 10 < 7)


def _learn(t: Testbed, n: int = VOCABULARY - vocabulary.BYTES - len(vocabulary.SPECIAL_TOKENS)):
    return vocabulary.token_table(t.spark, vocabulary.learn(f.pretoken_frequency(_training(t), "text"), n))


def learnt(t: Testbed):
    """The token table of the training documents: the one ``bpe_merges`` published for them, or learnt here."""
    table = published(t.spark, "vocabulary", content_key(_training(t), "doc_id", "text"))
    return _learn(t) if table is None else table


@query("bpe_merges")
def bpe_merges(t: Testbed):
    table = publish(_learn(t), "vocabulary", content_key(_training(t), "doc_id", "text"))
    return table.filter(F.col("kind") == "merge").select("id", "token", "kind")


@query("encode_column")
def encode_column(t: Testbed):
    rows = t.texts("doc_id", "text")
    out = f.encode_column(rows, "text", vocabulary.merges_of(learnt(t)), 2048)
    return out.select("doc_id", "token_count_full", "token_count", "truncated", F.md5(f.ids_text(F.col("input_ids"))).alias("ids_digest"))


@query("truncation_audit", on("checks", body=f"""SELECT split, count(*) AS row_count, {cif('prompt_tokens > 2048')} AS truncated_count, round(count_if(prompt_tokens > 2048)::DOUBLE / count(*), 9) AS truncation_rate,
 max(prompt_tokens) AS token_count_max FROM checks GROUP BY split"""))
def truncation_audit(t: Testbed):
    return rounded(f.truncation_audit(t.checks(), "prompt_tokens", 2048), "truncation_rate")


# The most terms a model keeps.
TERMS = 500_000
WORDS_SQL = q.words("lower(text)")


@query("token_ngrams", f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
g AS (SELECT doc_id, n, list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) AS g FROM w, (VALUES (1), (2), (3)) v(n))
SELECT doc_id, CAST(sum(len(g)) AS BIGINT) AS ngram_count, CAST(sum(len(list_distinct(g))) AS BIGINT) AS distinct_count, max(list_max(g)) AS last_ngram FROM g GROUP BY doc_id""")
def token_ngrams(t: Testbed):
    rows = t.texts("doc_id", "text").withColumn("w", tx.words(F.lower("text"))).withColumn("g", f.ngrams(F.col("w"), 1, 3))
    return rows.select(
        "doc_id", F.size("g").cast("bigint").alias("ngram_count"), F.size(F.array_distinct("g")).cast("bigint").alias("distinct_count"),
        F.array_max("g").alias("last_ngram"),
    )


TFIDF_SQL = f"""WITH counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
terms AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM counts GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.5 * (SELECT n FROM n) ORDER BY cf DESC, term LIMIT {TERMS}),
w AS (SELECT doc_id, term, tf, (1 + ln(tf)) * (ln((1 + (SELECT n FROM n))::DOUBLE / (1 + df)) + 1) AS w FROM counts JOIN terms USING (term))
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM w"""


@query("tfidf", TFIDF_SQL)
def tfidf(t: Testbed):
    rows = t.texts("doc_id", "text")
    tokens = terms.per_key(rows, "doc_id", tx.words(F.lower("text")))
    n = t.table("documents").count()
    found = ml.row_vocabulary(tokens, terms.words, "string", n, 2, 0.5, TERMS)
    return rounded(terms.weights(tokens, "doc_id", "tokens", terms.words, terms.known(found, f.idf(n, F.col("df")))), "weight")


@query("token_tfidf")
def token_tfidf(t: Testbed):
    """Weights of the n-grams of one to three token ids, terms fitted on the training documents."""
    tokens = token_ids(t)
    train = labelled(t).filter(F.col("split") == "train").select("doc_id")
    rows = train.count()
    found = ml.row_vocabulary(tokens.join(train, "doc_id", "left_semi"), TOKEN_NGRAMS, "bigint", rows, 2, 1.0, TERMS)
    shared = terms.known(found, f.idf(rows, F.col("df")))
    out = terms.weights(tokens, "doc_id", "tokens", TOKEN_NGRAMS, shared, "bigint").withColumn("term", ngram_ids(F.col("term")))
    return rounded(out.withColumn("tf", F.col("tf").cast("int")), "weight")


@query("char_ngrams", f"""WITH words AS (SELECT doc_id, ' ' || w || ' ' AS w, count(*) AS c FROM (SELECT doc_id, unnest({WORDS_SQL}) AS w FROM documents) GROUP BY ALL),
g AS (SELECT doc_id, c, unnest(list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))) AS term FROM words, (VALUES (3), (4), (5)) v(n)),
d AS (SELECT doc_id, term, sum(c) AS tf FROM g GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM d GROUP BY term HAVING count(*) >= 2""")
def char_ngrams(t: Testbed):
    return f.char_gram_frequency(t.texts("doc_id", "text"), "doc_id", "text").filter(F.col("df") >= 2)


def labelled(t: Testbed):
    return t.checks().select("doc_id", "split", F.col("checker_pass").cast("int").alias("label"), "num_constraints", "cluster", "length_bin")


TOKEN_NGRAMS = terms.id_ngrams(1, 3)


def _encode(t: Testbed):
    ids = f.encode_column(t.texts("doc_id", "text"), "text", vocabulary.merges_of(learnt(t)), 2048)
    return ids.select("doc_id", F.col("input_ids").alias("tokens"))


def token_ids(t: Testbed):
    """(doc_id, tokens): the token ids of every document: those ``logreg_fit`` published, or encoded here."""
    table = published(t.spark, "token-ids", content_key(t.texts("doc_id", "text"), "doc_id", "text"))
    return written(_encode(t), "token-ids")[0] if table is None else table


def _fit(rows, tokens, key: str, *limits):
    return ml.row_model(rows, tokens, key, TOKEN_NGRAMS, "bigint", *limits)


def text_model(t: Testbed, tokens=None):
    return _fit(labelled(t), token_ids(t) if tokens is None else tokens, "doc_id", 2, 1.0, TERMS)


@query("logreg_fit")
def logreg_fit(t: Testbed):
    tokens = publish(_encode(t), "token-ids", content_key(t.texts("doc_id", "text"), "doc_id", "text"))
    _, _, scored = text_model(t, tokens)
    keys = ["split"]
    return rounded(area_metrics(curve(score_counts(scored, keys), keys), keys), "auroc", "auprc", places=4)


@query("logreg_score")
def logreg_score(t: Testbed):
    _, _, scored = text_model(t)
    return rounded(scored, "p_pred", places=4)


@query("top_coefficients")
def top_coefficients(t: Testbed):
    model, found, _ = text_model(t)
    named = ml.coefficient_table(model, found).withColumn("term", ngram_ids(F.col("term")))
    return rounded(ml.top_coefficients(named, 30), "coefficient", "odds_ratio", places=4)


@query("feature_space")
def feature_space(t: Testbed):
    model, found, _ = text_model(t)
    return ml.feature_space(ml.coefficient_table(model, found))


@query("ngram_logreg")
def ngram_logreg(t: Testbed):
    tokens = terms.per_key(t.texts("doc_id", "text"), "doc_id", tx.words(F.lower("text")))
    _, _, scored = ml.row_model(labelled(t), tokens, "doc_id", terms.words_and_chars(3, 5), "string", 2, 0.9, TERMS)
    keys = ["split"]
    return rounded(area_metrics(curve(score_counts(scored, keys), keys), keys), "auroc", "auprc", places=4)


@query("learning_curve")
def learning_curve(t: Testbed):
    tokens = token_ids(t).withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = labelled(t).withColumn("doc_id", F.col("doc_id").cast("string"))
    out = ml.learning_curve(rows, tokens, "doc_id", [200, None], 42, 2, TERMS, fit=_fit)
    return rounded(out, "auroc", "auprc", "positive_rate", "auprc_lift", places=4)


@query("kmeans")
def kmeans(t: Testbed):
    return ml.kmeans(t.table("embeddings"), "embedding", 24, 42).groupBy("cluster").agg(F.count("*").alias("row_count"))


@query("silhouette")
def silhouette(t: Testbed):
    clustered = ml.kmeans(t.table("embeddings"), "embedding", 24, 42)
    value = ml.cosine_silhouette(clustered)
    return t.table("embeddings").agg(F.count("*").alias("row_count")).withColumn("silhouette_cosine", F.round(F.lit(value), 4))


# The feature sets compared, as (numeric, categorical) columns.
_METADATA = ["length_bin", "source_dataset", "constraint_type", "constraint_family_signature", "key_family"]
FEATURE_SETS = {
    "cluster_only": ([], ["cluster"]),
    "length_and_num_constraints": (["prompt_tokens", "num_constraints"], ["length_bin"]),
    "metadata_no_cluster": (["prompt_tokens", "num_constraints"], _METADATA),
    "cluster_plus_metadata": (["prompt_tokens", "num_constraints"], ["cluster", *_METADATA]),
}


@query("cv_auc")
def cv_auc(t: Testbed):
    rows = t.checks().select(
        "prompt_id", F.col("output_truncated").cast("int").alias("label"), F.col("cluster").cast("string").alias("cluster"),
        "length_bin", "source_dataset", "constraint_type", "num_constraints", "prompt_tokens", "constraint_family_signature",
        n.key_family(F.col("base_key")).alias("key_family"),
    )
    rows = p.top_levels(p.top_levels(rows, "key_family", 50), "constraint_family_signature", 120)
    return rounded(ml.cv_auc(rows, FEATURE_SETS, "label", "prompt_id", 5, 42), "roc_auc_mean", "roc_auc_std", places=4)


def _has(*families: str) -> str:
    return f"len(list_filter(instruction_ids, lambda x: split_part(x, ':', 1) IN ({', '.join(repr(x) for x in families)}))) > 0"


def _named(pattern: str) -> str:
    return f"len(list_filter(instruction_ids, lambda x: regexp_matches(x, '{pattern}'))) > 0"


@query("structural_targets", on("promptset", body=f"""SELECT prompt_id, {_has('length_constraints', 'count', 'letters', 'paragraphs')} AS has_length_count_constraint,
 len(list_filter(instruction_ids, lambda x: starts_with(x, 'keywords:') AND NOT regexp_matches(x, 'forbidden|exclude'))) > 0 AS has_keyword_inclusion_constraint,
 len(list_filter(instruction_ids, lambda x: starts_with(x, 'keywords:') AND regexp_matches(x, 'forbidden|exclude'))) > 0 AS has_keyword_exclusion_constraint,
 {_has('punctuation')} OR {_named('hyphen')} AS has_punctuation_restriction, {_has('detectable_format', 'detectable_content')} AS has_format_constraint,
 {_has('change_case')} AS has_casing_constraint, {_has('startend', 'first_word', 'last_word')} OR {_named('start_end')} AS has_start_end_constraint,
 {_named('bullet|list')} AS has_list_bullet_constraint, CASE WHEN num_constraints >= 4 THEN '4+' ELSE num_constraints || '' END AS num_constraints_bucket FROM promptset"""))
def structural_targets(t: Testbed):
    columns = f.structural_targets(F.col("instruction_ids"), F.col("num_constraints"))
    return t.promptset().select("prompt_id", *[c.alias(n) for n, c in columns.items()])


@query("quote_mask")
def quote_mask(t: Testbed):
    mask = f.quote_digit_mask(F.col("text"))
    return t.texts("doc_id", "text").withColumn("m", mask).select(
        "doc_id", F.size("m").alias("char_count"), F.size(F.filter("m", lambda x: x)).alias("masked_count")
    )


def hex_cut(rate: float) -> str:
    return f"{int(rate * 16**8):08x}"


HASH_SQL = "substr(md5('7:' || doc_id || ':' || (i - 1)), 1, 8)"


@query("mlm_mask", f"""WITH w AS (SELECT doc_id, {q.words('text')} AS w FROM documents),
x AS (SELECT doc_id, i, w[i] AS tok FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
h AS (SELECT doc_id, i, {HASH_SQL} AS h, {HASH_SQL} < CASE WHEN regexp_matches(tok, '[0-9]') THEN '{hex_cut(0.3)}' ELSE '{hex_cut(0.15)}' END AS hit FROM x WHERE tok NOT IN ('the', 'of')),
s AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS any_hit, row_number() OVER (PARTITION BY doc_id ORDER BY h, i) AS rn FROM h)
SELECT doc_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions, count(*) AS masked_count FROM s WHERE hit OR (NOT any_hit AND rn = 1) GROUP BY doc_id""")
def mlm_mask(t: Testbed):
    rows = t.texts("doc_id", "text").select("doc_id", tx.words(F.col("text")).alias("w"))
    category = F.transform("w", lambda x: x.rlike("[0-9]").cast("int"))
    positions = f.mlm_positions(F.col("w"), category, F.col("doc_id").cast("string"), 7, 0.15, 0.3, ("the", "of"))
    masked, _ = f.apply_mask(F.col("w"), F.col("p"), "<mask>")
    replaced = tx.bound_once(masked, lambda m: F.filter("p", lambda at: F.get(m, at - 1) == "<mask>"))
    found = F.struct(
        F.array_join(F.col("p").cast("array<string>"), ",").alias("positions"),
        F.size(replaced).cast("bigint").alias("masked_count"),
    )
    # A filter on the places would be pushed below them and draw them twice.
    out = f.explode_once(rows.withColumn("p", positions), F.when(F.size("p") > 0, F.array(found)), "o", "doc_id")
    return out.select("doc_id", "o.positions", "o.masked_count")


@query("pos_weight", on("checks", body=f"""SELECT {cif('checker_pass')} AS positives, {cif('NOT checker_pass')} AS negatives, round(count_if(NOT checker_pass)::DOUBLE / count_if(checker_pass), 9) AS pos_weight FROM checks"""))
def pos_weight(t: Testbed):
    return rounded(f.positive_weight(labelled(t), "label"), "pos_weight")


@query("clip_tokens", f"""WITH w AS (SELECT doc_id, {q.words('text')} AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS token_count_full, CAST(least(len(w), 128) AS BIGINT) AS token_count,
 len(w) > 128 AS truncated, array_to_string(w[1:128], ' ') AS kept, CAST(least(len(w), 128) AS BIGINT) AS mask_sum FROM w""")
def clip_tokens(t: Testbed):
    rows = t.texts("doc_id", "text").withColumn("w", tx.words(F.col("text"))).withColumns(f.clipped_tokens(F.col("w"), 128))
    return rows.select(
        "doc_id", F.col("token_count_full").cast("bigint").alias("token_count_full"), F.col("token_count").cast("bigint").alias("token_count"),
        "truncated", F.array_join("input_ids", " ").alias("kept"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
    )


@query("head_tail", f"""WITH w AS (SELECT doc_id, {q.words('text')} AS w FROM documents) SELECT doc_id,
 array_to_string(CASE WHEN len(w) <= 96 THEN w ELSE list_concat(w[1:48], w[len(w) - 47:len(w)]) END, ' ') AS kept FROM w""")
def head_tail(t: Testbed):
    rows = t.texts("doc_id", "text").withColumn("w", tx.words(F.col("text")))
    return rows.select("doc_id", F.array_join(f.head_tail(F.col("w"), 48, 48), " ").alias("kept"))


@query("constant_baseline", on("checks", body="""SELECT prompt_id, split, (SELECT round(avg(CAST(checker_pass AS INTEGER)), 9) FROM checks WHERE split = 'train') AS p_pred FROM checks WHERE split <> 'train'"""))
def constant_baseline(t: Testbed):
    rows = t.checks().select("prompt_id", "split", "checker_pass")
    rate = rows.filter(F.col("split") == "train").agg(F.round(F.avg(F.col("checker_pass").cast("int")), 9))
    return rows.filter(F.col("split") != "train").select("prompt_id", "split").withColumn("p_pred", rate.scalar())


SIMPLE_SQL = """SELECT prompt_id, length(user_prompt) AS prompt_length, length(constraint_signature) AS constraint_text_length, num_constraints, CAST(len(instruction_ids) AS BIGINT) AS num_instruction_ids,
 CAST(len(list_distinct(list_transform(instruction_ids, lambda x: split_part(x, ':', 1)))) AS BIGINT) AS num_unique_constraint_families FROM promptset"""


def simple(t: Testbed):
    out = f.simple_features(t.promptset().withColumn("constraint_text", F.col("constraint_signature")))
    return out.select("prompt_id", *[F.col(c).cast("bigint").alias(c) for c in out.columns[1:]])


@query("simple_features", on("promptset", body=SIMPLE_SQL))
def simple_features(t: Testbed):
    return simple(t)


@query("simple_logreg")
def simple_logreg(t: Testbed):
    rows = simple(t).join(t.checks().select("prompt_id", "split", F.col("checker_pass").cast("int").alias("label")), "prompt_id")
    numbers = rows.columns[1:6]
    vectors = rows.withColumn("features", ml.array_to_vector(F.array(*[F.col(c).cast("double") / 1000 for c in numbers])))
    model = ml.fit_logistic(vectors.filter(F.col("split") == "train"))
    keys = ["split"]
    scored = ml.score(model, vectors.select("split", "label", "features"))
    return rounded(area_metrics(curve(score_counts(scored, keys), keys), keys), "auroc", "auprc", places=4)
