"""Search, score, sampling, composition and apply queries."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import ws_tokens
from tokenloom.operators.apply import apply_with_errors, input_fingerprint, score, split_dead_letter
from tokenloom.operators.composition import composition_rollup, path_columns, training_steps
from tokenloom.operators.sampling import binary_balanced, nary_balanced
from tokenloom.operators.scores import (
    argmax,
    batch_perplexity,
    compare_logits,
    cross_entropy,
    last_vector,
    masked_loss,
    next_token_losses,
)
from tokenloom.operators.search import find_subsequences
from tokenloom.plans.registry import query, table
from tokenloom.plans.training import TOKENS_SQL

SEED = 42


@query("subsequence_hits", f"""
WITH d AS (SELECT doc_id, {TOKENS_SQL.format(t='text')} AS t FROM documents),
b AS (SELECT item_id, {TOKENS_SQL.format(t='text')} AS p FROM benchmark WHERE len({TOKENS_SQL.format(t='text')}) > 0),
dp AS (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM d),
c AS (SELECT item_id, doc_id, i - 1 AS pos, list_slice(t, i, i + len(p) - 1) = p AS hit
      FROM dp JOIN b ON dp.t[dp.i] = b.p[1])
SELECT item_id, doc_id, pos::INTEGER AS pos FROM c WHERE hit
""")
def q_subsequence_hits(spark: SparkSession, sf_dir: str):
    """Every occurrence of every whole benchmark item (as tokens) in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ws_tokens("text").alias("tokens"))
    pats = table(spark, sf_dir, "benchmark").select("item_id", ws_tokens("text").alias("pattern"))
    return find_subsequences(docs, pats, anchor=8)


def _logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query("logit_compare", """
SELECT vec_id, label, embedding[1] > embedding[2] AS completion, round(embedding[1]::DOUBLE, 6) AS logit0,
       round(embedding[2]::DOUBLE, 6) AS logit1, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS highest_token
FROM embeddings
""")
def q_logit_compare(spark, sf_dir):
    """H18 + H19: logit of token 0 vs token 1, and the arg-max token."""
    e = _logits(spark, sf_dir)
    comp, a, b = compare_logits("embedding", 0, 1)
    return e.select("vec_id", "label", comp.alias("completion"), F.round(a, 6).alias("logit0"),
                    F.round(b, 6).alias("logit1"), argmax("embedding").alias("highest_token"))


@query("argmax_label", """
SELECT label, count(*)::BIGINT AS n,
       count(*) FILTER (WHERE list_position(embedding, list_max(embedding)) - 1 = label)::BIGINT AS n_hit
FROM embeddings GROUP BY label
""")
def q_argmax_label(spark, sf_dir):
    """How often the arg-max token equals the label, per label."""
    e = _logits(spark, sf_dir)
    return (e.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                   F.count(F.when(argmax("embedding") == F.col("label"), 1)).alias("n_hit")))


CE_SQL = "(list_max(e) + ln(list_sum(list_transform(e, lambda v: exp(v - list_max(e))))) - e[{lab} + 1])"


@query("token_cross_entropy", f"""
WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)
SELECT vec_id, label, round({CE_SQL.format(lab='label')}, 6) AS ce FROM x
""")
def q_token_cross_entropy(spark, sf_dir):
    """Cross entropy of each logit vector against its label."""
    e = _logits(spark, sf_dir)
    return e.select("vec_id", "label", F.round(cross_entropy("embedding", "label"), 6).alias("ce"))


def _seq_losses(spark, sf_dir):
    e = _logits(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).cast("long").alias("seq"), "vec_id",
                                     "embedding", "label", (F.col("label") >= 5).alias("imp"))
    losses = next_token_losses(e, seq="seq", pos="vec_id", logits="embedding", label="label", important="imp")
    return masked_loss(losses, by=["seq"])


MASKED_SQL = f"""
WITH x AS (
  SELECT vec_id // 8 AS seq, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e,
         lead(label) OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS nxt FROM embeddings
), c AS (SELECT seq, nxt >= 5 AS imp, {CE_SQL.format(lab='nxt')} AS ce FROM x WHERE nxt IS NOT NULL),
s AS (SELECT seq, avg(ce) FILTER (WHERE imp) AS loss FROM c GROUP BY seq)
"""


@query("masked_perplexity", MASKED_SQL + """
SELECT seq::BIGINT AS seq, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity FROM s
""")
def q_masked_perplexity(spark, sf_dir):
    """E7 + D5: 8-token sequences, next-token CE on important (label >= 5) positions, mean and exp."""
    m = _seq_losses(spark, sf_dir)
    return m.select("seq", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@query("batch_perplexity", MASKED_SQL + """
SELECT (seq // 16)::BIGINT AS batch_id, round(exp(avg(loss)), 6) AS perplexity FROM s GROUP BY 1
""")
def q_batch_perplexity(spark, sf_dir):
    """exp(mean loss) over batches of 16 sequences."""
    m = _seq_losses(spark, sf_dir).withColumn("batch_id", F.floor(F.col("seq") / 16).cast("long"))
    return batch_perplexity(m, by=["batch_id"]).select("batch_id", F.round("perplexity", 6).alias("perplexity"))


@query("last_vector", """
WITH x AS (SELECT vec_id // 8 AS seq, max(vec_id) AS last_pos, arg_max(embedding, vec_id) AS v FROM embeddings GROUP BY 1)
SELECT seq::BIGINT AS seq, last_pos, round(v[1]::DOUBLE, 6) AS v0, round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 4) AS v_sum
FROM x
""")
def q_last_vector(spark, sf_dir):
    """Vector at the last position of each 8-token sequence."""
    e = _logits(spark, sf_dir).withColumn("seq", F.floor(F.col("vec_id") / 8).cast("long"))
    lv = last_vector(e, by=["seq"], pos="vec_id", vector="embedding")
    return lv.select("seq", "last_pos", F.round(F.get("last_vector", 0).cast("double"), 6).alias("v0"),
                     F.round(F.aggregate("last_vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
                     .alias("v_sum"))


@query("balanced_binary", f"""
WITH x AS (SELECT d.doc_id, d.lang, l.toxic = 1 AS label, md5('{SEED}:' || d.doc_id::VARCHAR) AS order_key
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY order_key) AS rk FROM x)
SELECT doc_id, lang, label, order_key FROM r WHERE rk <= 40
""")
def q_balanced_binary(spark, sf_dir):
    """F2 + E8 (+G1 semantics): 40 toxic and 40 non-toxic labelled documents, seeded."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    x = d.join(lab, "doc_id")
    return binary_balanced(x, F.col("toxic") == 1, n=40, seed=SEED, key=["doc_id"], strict=False).select(
        "doc_id", "lang", "label", "order_key")


@query("balanced_strict", f"""
WITH x AS (SELECT doc_id, n_chars, lang = 'en' AS label, md5('{SEED}:' || doc_id::VARCHAR) AS order_key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY order_key) AS rk FROM x)
SELECT doc_id, n_chars, label, order_key FROM r WHERE rk <= 70
""")
def q_balanced_strict(spark, sf_dir):
    """70 English and 70 other documents, strict: fewer in a class fail the job."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return binary_balanced(d, F.col("lang") == "en", n=70, seed=SEED, key=["doc_id"]).select(
        "doc_id", "n_chars", "label", "order_key")


# The four overlapping class predicates (SQL text, shared by the plan and its oracle).
NARY = ["event_type = 'click'", "event_type = 'view'", "value > 50", "user_id < 50"]


@query("balanced_nary", f"""
WITH x AS (
  SELECT event_id, unnest(list_filter([{", ".join(f"CASE WHEN {s} THEN {i} END" for i, s in enumerate(NARY))}],
                                      lambda c: c IS NOT NULL)) AS class_id,
         md5('{SEED}:' || event_id::VARCHAR) AS order_key FROM events
), r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY order_key) AS rk FROM x)
SELECT class_id::INTEGER AS class_id, event_id, order_key FROM r WHERE rk <= 100
""")
def q_balanced_nary(spark, sf_dir):
    """100 events per overlapping predicate (a row may appear in several classes)."""
    ev = table(spark, sf_dir, "events")
    return nary_balanced(ev, [F.expr(c) for c in NARY], n=100, seed=SEED, key=["event_id"]).select(
        "class_id", "event_id", "order_key")


def _doc_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang",
                                                    F.size(ws_tokens("text")).alias("n_tokens"))


@query("token_totals", f"""
SELECT source, count(*)::BIGINT AS n_docs, sum(len({TOKENS_SQL.format(t='text')}))::BIGINT AS total_tokens
FROM documents GROUP BY source
""")
def q_token_totals(spark, sf_dir):
    """A7 + D3: token total per source (the per-file count summed per directory)."""
    return _doc_tokens(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                                            F.sum("n_tokens").cast("long").alias("total_tokens"))


@query("composition_rollup", f"""
SELECT 'documents' AS data_path, lang AS category, source AS subfolder,
       sum(len({TOKENS_SQL.format(t='text')}))::BIGINT AS total_tokens,
       CASE grouping(lang, source) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END::INTEGER AS level
FROM documents GROUP BY ROLLUP (lang, source)
""")
def q_composition_rollup(spark, sf_dir):
    """D4 + A13: tokens per (language, source) with language subtotals and a grand total."""
    return composition_rollup(_doc_tokens(spark, sf_dir), category="lang", subfolder="source",
                              data_path="documents")


@query("training_steps", """
SELECT source, count(*)::BIGINT AS n_rows, (ceil(count(*) / 32) * 3)::BIGINT AS steps FROM documents GROUP BY source
""")
def q_training_steps(spark, sf_dir):
    """Optimiser steps per source for batch 8, accumulation 4, 3 epochs."""
    c = table(spark, sf_dir, "documents", spread=False).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    return training_steps(c, n="n_rows", batch_size=8, grad_accum=4, epochs=3)


@query("path_columns", """
SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(url, '([^/.]*)[^/]*$', 1) AS stem,
       translate(url, '/.:', '---') AS clean
FROM pages
""")
def q_path_columns(spark, sf_dir):
    """Parent, stem and cleaned form of every page URL."""
    p = table(spark, sf_dir, "pages", spread=False).select("page_id", "url")
    return path_columns(p, "url").select("page_id", "parent", "stem", "clean")


def _parse_k(s):
    return json.loads(s)["k"]


def _dead_letter(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    # Bad rows are injected by key: 'error' events lose their closing brace.
    val = F.when(F.col("event_type") == "error", F.expr("substring(props, 1, length(props) - 1)")).otherwise(
        F.col("props"))
    res = apply_with_errors(ev.select("event_id", val.alias("payload")), _parse_k, "payload", index="event_id")
    return split_dead_letter(res, shared_as=("parse_k", input_fingerprint(spark, [f"{sf_dir.rstrip('/')}/events.parquet"])))


@query("dead_letter_good", """
SELECT event_id AS "index", CAST(json_extract(props, '$.k') AS VARCHAR) AS out FROM events WHERE event_type <> 'error'
""")
def q_dead_letter_good(spark, sf_dir):
    """I1 + I2: JSON-parse every event payload in Arrow batches; the parsed rows."""
    return _dead_letter(spark, sf_dir)[0]


@query("dead_letter_errors", """
SELECT event_id AS "index", 'JSONDecodeError' AS error FROM events WHERE event_type = 'error'
""")
def q_dead_letter_errors(spark, sf_dir):
    """I2 + I3: the rows that failed to parse, classified by error name."""
    return _dead_letter(spark, sf_dir)[1].select("index", "error")


_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def _toy_scorer(prompts, masks):
    """Stand-in for a model: loss = built-in tokens that the target mask keeps per character (+1), perplexity = exp(loss)."""
    out = []
    for p, m in zip(prompts, masks, strict=True):
        n = sum(k for _, k in zip(_WORD.findall(p or ""), m, strict=True))
        loss = n / (len(p or "") + 1)
        out.append({"loss": loss, "perplexity": math.exp(loss)})
    return out


_KEPT = f"len(list_filter({TOKENS_SQL.format(t='text')}, lambda x: regexp_matches(x, '^[A-Z]')))"


@query("scored_prompts", f"""
SELECT doc_id, lang AS label, round({_KEPT} / (length(text) + 1), 6) AS loss,
       round(exp({_KEPT} / (length(text) + 1)), 6) AS perplexity
FROM documents
""")
def q_scored_prompts(spark, sf_dir):
    """Batch scoring surface (get_loss mode) with a stand-in scorer of the tokens that the target mask keeps (those that
    begin with a capital), label carried through."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), F.col("lang").alias("label"),
                                                 ws_tokens("text").alias("tokens"))
    d = d.withColumn("target_mask", F.transform("tokens", lambda t: t.rlike("^[A-Z]").cast("int")))
    s = score(d, _toy_scorer, "get_loss", keep=["doc_id"])
    return s.select("doc_id", "label", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))
