"""Chat, template and conversation-pair queries over ``conversations`` (+ ``documents``/``labels``)."""

from __future__ import annotations

import hashlib
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import templates as T
from tokenloom.functions.templates import format_template, label_text, pair_boundary, reformat_dialogue
from tokenloom.functions.text import completion_suffix
from tokenloom.operators.chat import render_turns, turn_pairs
from tokenloom.operators.pairs import prepare_conversation, tokenize_pairs
from tokenloom.operators.prompts import noisy_channel_expand
from tokenloom.plans.registry import query, table
from tokenloom.plans.training import IDS_SQL

PY_SPACE_SQL = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
                r"\x{205F}\x{3000}]")


def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^{PY_SPACE_SQL}+|{PY_SPACE_SQL}+$', '', 'g')"


def sql_lit(s: str) -> str:
    """A DuckDB string expression for a Python string (newlines through chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) if s else "''"


def sql_format(template: str, **exprs: str) -> str:
    out = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            out.append(sql_lit(literal))
        if field is not None:
            out.append(f"coalesce(CAST({exprs[field]} AS VARCHAR), '')")
    return "(" + " || ".join(out) + ")"


PAIRS_SQL = """
WITH c AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), pairs AS (SELECT conv_id, turn, text AS text1, t2 AS text2 FROM c WHERE role = 'user' AND r2 = 'assistant')
"""


@query("chat_render", """
WITH c AS (
  SELECT c.*, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations c
)
SELECT conv_id, turn, CASE
    WHEN role = 'system' THEN '<|system|>' || chr(10) || text || chr(10)
    WHEN role = 'user' THEN '<|user|>' || chr(10) || text || chr(10)
    WHEN role = 'assistant' THEN '<|assistant|>' || chr(10) || text || '</s>' || CASE WHEN last THEN '' ELSE chr(10) END
    ELSE '' END || CASE WHEN last THEN '<|assistant|>' || chr(10) ELSE '' END AS piece
FROM c
""")
def q_chat_render(spark, sf_dir):
    """D7 + H6: every turn's rendered piece (chat template, generation prompt after the last turn)."""
    return render_turns(table(spark, sf_dir, "conversations"), eos="</s>", add_generation_prompt=True)


def _pair_rows(spark, sf_dir, use_loss_mask=True) -> DataFrame:
    pairs = turn_pairs(table(spark, sf_dir, "conversations"))
    return prepare_conversation(pairs, 128, key_cols=["conv_id", "turn"], use_loss_mask=use_loss_mask, seed=7)


_TRUNC_SQL = PAIRS_SQL + f"""
, tok AS (
  SELECT conv_id, turn, {IDS_SQL.format(t=strip_sql('text1'))} AS i1, {IDS_SQL.format(t=strip_sql('text2'))} AS i2,
         {IDS_SQL.format(t="'User:'")} AS p1, {IDS_SQL.format(t="'Response:'")} AS p2 FROM pairs
), s AS (
  SELECT *, len(i1) AS n1, len(i2) AS n2, len(i1) + len(i2) + len(p1) + len(p2) AS tot FROM tok
), k AS (
  SELECT *, tot - 128 + 1 AS e, n1 - n2 AS d, abs(n1 - n2) AS m, (tot - 128 + 1 - abs(n1 - n2)) // 2 AS r FROM s
), cuts AS (
  SELECT *,
    CASE WHEN tot <= 128 THEN 0 WHEN m >= e AND d >= 0 THEN e WHEN m >= e THEN 0 WHEN d >= 0 THEN m + r ELSE r END AS cut1,
    least(n2, CASE WHEN tot <= 128 THEN 0 WHEN m >= e AND d >= 0 THEN 0 WHEN m >= e THEN e
         WHEN d >= 0 THEN (CASE WHEN r = 0 THEN n2 ELSE r END)
         ELSE (CASE WHEN r = 0 THEN n2 ELSE m + r END) END) AS cut2
  FROM k
), asm AS (
  SELECT *, list_concat(p1, list_slice(i1, cut1 + 1, n1), p2, list_slice(i2, 1, greatest(n2 - cut2, 0))) AS raw,
         len(p1) + greatest(n1 - cut1, 0) AS side1
  FROM cuts
)
"""


@query("pair_truncate", _TRUNC_SQL + """
SELECT conv_id, turn, n1::INTEGER AS n1, n2::INTEGER AS n2, cut1::INTEGER AS cut1, cut2::INTEGER AS cut2 FROM asm
""")
def q_pair_truncate(spark, sf_dir):
    """User->assistant pairs trimmed to 128 tokens (closed form)."""
    return _pair_rows(spark, sf_dir).select("conv_id", "turn", "n1", "n2", "cut1", "cut2")


@query("pair_assemble", _TRUNC_SQL + """
SELECT conv_id, turn, greatest(len(raw), 128)::INTEGER AS n_ids,
       (len(raw) - side1)::INTEGER AS loss_sum, len(raw)::INTEGER AS attn_sum,
       md5(array_to_string(list_concat(raw, list_resize([100277], greatest(128 - len(raw), 0), 100277)), ' ')) AS ids_md5
FROM asm
""")
def q_pair_assemble(spark, sf_dir):
    """H14 + H15: assembled, right-padded training rows; loss on the response side."""
    p = _pair_rows(spark, sf_dir)
    return p.select("conv_id", "turn", F.size("input_ids").alias("n_ids"),
                    F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x).alias("loss_sum"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attn_sum"),
                    F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ")).alias("ids_md5"))


@query("loss_all_but_pad", _TRUNC_SQL + """
SELECT conv_id, turn, len(list_filter(list_concat(raw, list_resize([100277], greatest(128 - len(raw), 0), 100277)),
                                      lambda x: x <> 100277))::INTEGER AS loss_sum
FROM asm
""")
def q_loss_all_but_pad(spark, sf_dir):
    """Loss on every non-pad position."""
    p = _pair_rows(spark, sf_dir, use_loss_mask=False)
    return p.select("conv_id", "turn", F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x).alias("loss_sum"))


_DIALOGUE_NAMES = [("llama", "Llama-2-7b-chat-hf"), ("dynahate", "dynahate"), ("default", "default"),
                   ("other", "instruct")]


def _dialogue_sql() -> str:
    inp, out = "text", "lbl"
    llama_in = f"({sql_lit(T.LLAMA_SYSTEM)} || {inp})"
    forms = {
        "llama_final": f"'<s>' || {strip_sql(sql_format(T.LLAMA_CHAT_TEMPLATE, input=strip_sql(llama_in), output=strip_sql(out)))}",
        "llama_turn": f"'<s>' || {sql_format(T.LLAMA_CHAT_TEMPLATE, input=llama_in, output=out)} || '</s>'",
        "dynahate_final": strip_sql(sql_format(T.HATE_CLASSIFICATION_WITH_LABEL, input=inp, output=out)),
        "dynahate_turn": sql_format(T.HATE_CLASSIFICATION_WITH_LABEL, input=inp, output=out),
        "default_final": strip_sql(sql_format(T.DEFAULT_TOXIC_TEMPLATE_WITH_LABEL, input=inp, output=out)),
        "default_turn": sql_format(T.DEFAULT_TOXIC_TEMPLATE_WITH_LABEL, input=inp, output=out),
        "other_final": strip_sql(sql_format(T.INPUT_TEMPLATE_WITH_OUTPUT, input=inp, output=out)),
        "other_turn": sql_format(T.DEFAULT_TOXIC_TEMPLATE_WITH_LABEL, input=inp, output=out),
    }
    cols = ", ".join(f"md5({v}) AS {k}" for k, v in forms.items())
    return f"""
WITH x AS (SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'safe' END AS lbl
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, {cols} FROM x
"""


@query("dialogue_templates", _dialogue_sql())
def q_dialogue_templates(spark, sf_dir):
    """H5 + H7: every labelled document formatted with each dialogue template, final and non-final."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    x = d.join(lab, "doc_id").withColumn("lbl", label_text(F.col("toxic") == 1, T.CIVIL_COMMENTS_LABELS))
    cols = []
    for short, name in _DIALOGUE_NAMES:
        cols.append(F.md5(reformat_dialogue("text", "lbl", name, True)).alias(f"{short}_final"))
        cols.append(F.md5(reformat_dialogue("text", "lbl", name, False)).alias(f"{short}_turn"))
    return x.select("doc_id", *cols)


def _noisy_sql() -> str:
    rows = []
    for i, (tpl, choices) in enumerate(T.NOISY_CHANNEL_TEMPLATES):
        for ch in (False, True):
            rows.append(f"SELECT {i} AS template_id, {str(ch).upper()} AS choice, "
                        f"{sql_lit(choices[ch])} AS choice_text")
    union = " UNION ALL ".join(rows)
    cases = " ".join(f"WHEN template_id = {i} THEN {sql_format(tpl, choice='choice_text', input='text')}"
                     for i, (tpl, _) in enumerate(T.NOISY_CHANNEL_TEMPLATES))
    return f"""
WITH ch AS ({union}),
x AS (SELECT d.doc_id, d.text, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, template_id::INTEGER AS template_id, choice, choice = (toxic = 1) AS is_gold,
       md5(CASE {cases} END) AS prompt_md5
FROM x, ch
"""


@query("noisy_channel_prompts", _noisy_sql())
def q_noisy_channel_prompts(spark, sf_dir):
    """C6 + H4: one prompt per (labelled document x template x label choice)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    x = noisy_channel_expand(d.join(lab, "doc_id"), input_col="text")
    return x.select("doc_id", "template_id", "choice", (F.col("choice") == (F.col("toxic") == 1)).alias("is_gold"),
                    F.md5("prompt").alias("prompt_md5"))


@query("qa_prompts", PAIRS_SQL + f"""
SELECT conv_id, turn, md5({sql_format(T.TOFU_TEMPLATE, question='text1', answer='text2')}) AS qa_md5,
       md5({sql_format(T.TOFU_QUERY_TEMPLATE, question='text1')}) AS query_md5,
       length({sql_format(T.TOFU_QUERY_TEMPLATE, question='text1')})::INTEGER AS query_chars
FROM pairs
""")
def q_qa_prompts(spark, sf_dir):
    """H4: question/answer prompts from user->assistant pairs."""
    p = turn_pairs(table(spark, sf_dir, "conversations"))
    q = format_template(T.TOFU_QUERY_TEMPLATE, question="text1")
    return p.select("conv_id", "turn", F.md5(format_template(T.TOFU_TEMPLATE, question="text1", answer="text2"))
                    .alias("qa_md5"), F.md5(q).alias("query_md5"), F.length(q).alias("query_chars"))


@query("pair_boundary", PAIRS_SQL + f"""
, b AS (SELECT conv_id, turn, {sql_format(T.HATE_CLASSIFICATION_WITHOUT_LABEL, input='text1')} AS inp, text2 AS out
        FROM pairs)
SELECT conv_id, turn,
  CASE WHEN inp IS NULL OR NOT ends_with(inp, ' ') THEN 'input_no_trailing_space'
       WHEN starts_with(out, ' ') THEN 'output_leading_space' END AS violation,
  md5(CASE WHEN ends_with(inp, ' ') AND NOT starts_with(out, ' ') THEN substr(inp, 1, length(inp) - 1) END) AS input_md5,
  md5(CASE WHEN ends_with(inp, ' ') AND NOT starts_with(out, ' ') THEN ' ' || out END) AS output_md5
FROM b
""")
def q_pair_boundary(spark, sf_dir):
    """H8: boundary space moved from prompt to response for classification prompts."""
    p = turn_pairs(table(spark, sf_dir, "conversations"))
    inp = format_template(T.HATE_CLASSIFICATION_WITHOUT_LABEL, input="text1")
    i2, o2, v = pair_boundary(inp, F.col("text2"))
    return p.select("conv_id", "turn", v.alias("violation"), F.md5(i2).alias("input_md5"),
                    F.md5(o2).alias("output_md5"))


@query("completion_suffix", PAIRS_SQL + """
SELECT conv_id, turn, md5(substr(text1 || text2, length(text1) + 1)) AS completion_md5,
       substr(text1 || text2, length(text1) + 1) = text2 AS matches
FROM pairs
""")
def q_completion_suffix(spark, sf_dir):
    """H9: completion recovered from prompt + generated text."""
    p = turn_pairs(table(spark, sf_dir, "conversations"))
    full = F.concat("text1", "text2")
    comp = completion_suffix(full, "text1")
    return p.select("conv_id", "turn", F.md5(comp).alias("completion_md5"), (comp == F.col("text2")).alias("matches"))


@query("completion_of_text", """
SELECT doc_id, md5(substr(text, length(string_split(text, chr(10))[1]) + 1)) AS completion_md5,
       (length(text) - length(string_split(text, chr(10))[1]))::INTEGER AS n_chars
FROM documents
""")
def q_completion_of_text(spark, sf_dir):
    """H9: what follows a document's first line, the prompt, in its whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("prompt"))
    comp = completion_suffix("text", "prompt")
    return d.select("doc_id", F.md5(comp).alias("completion_md5"), F.length(comp).alias("n_chars"))


def _builtin_ids(texts: list[str]) -> list[np.ndarray]:
    """The built-in tokenizer as a callable."""
    return [np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4]) >> 4 for t in _PLAIN_TOKEN.findall(x)], np.int32)
            for x in texts]


_PLAIN_TOKEN = re.compile(r"[^ \t\n\x0b\f\r]+")


@query("tokenized_pairs", PAIRS_SQL + f"""
, b AS (SELECT conv_id, turn, {sql_format(T.HATE_CLASSIFICATION_WITHOUT_LABEL, input='text1')} AS inp, text2 AS out FROM pairs),
v AS (SELECT *, CASE WHEN starts_with(out, ' ') THEN 'output_leading_space' END AS violation FROM b)
SELECT conv_id, turn, violation,
  CASE WHEN violation IS NULL THEN md5(array_to_string({IDS_SQL.format(t='inp')}, ' ')) END AS input_md5,
  CASE WHEN violation IS NULL THEN md5(array_to_string({IDS_SQL.format(t='out')}, ' ')) END AS output_md5,
  CASE WHEN violation IS NULL THEN list_concat({IDS_SQL.format(t='inp')}, {IDS_SQL.format(t='out')}) = {IDS_SQL.format(t='inp || out')}
  END AS at_boundary
FROM v
""")
def q_tokenized_pairs(spark, sf_dir):
    """H8: classification prompts and responses encoded in one batch, with a check that no token spans the boundary."""
    p = turn_pairs(table(spark, sf_dir, "conversations"))
    p = p.select("conv_id", "turn", format_template(T.HATE_CLASSIFICATION_WITHOUT_LABEL, input="text1").alias("input"),
                 F.col("text2").alias("output"))
    x = tokenize_pairs(p, _builtin_ids, tokenizer="built-in tokens, split as byte-level ones", keep=["conv_id", "turn"])
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda i: i.cast("string")), " "))
    return x.select("conv_id", "turn", "violation", digest("input_ids").alias("input_md5"), digest("output_ids").alias("output_md5"),
                    "at_boundary")


#: name -> (template, values of its placeholders as SQL over the labelled documents and the pair of their first two lines)
_CLASSIFICATION = {
    "toxic_plain": (T.TOXIC_CLASSIFICATION_NO_PROMPT, {"input": "text", "output": "toxic_label"}),
    "toxic_asked": (T.TOXIC_CLASSIFICATION_WITH_PROMPT, {"input": "text", "output": "toxic_label"}),
    "wildguard": (T.WILDGUARD_PROMPT_ONLY_TEMPLATE, {"human_request": "text"}),
    "wildguard_new": (T.WILDGUARD_PROMPT_ONLY_TEMPLATE_NEW, {"human_request": "text"}),
    "paradetox": (T.PARADETOX_PROMPT_ONLY_TEMPLATE, {"toxic_text": "text"}),
    "nli_plain": (T.NLI_CLASSIFICATION_NO_PROMPT, {"input1": "line1", "input2": "line2", "output": "harm_label"}),
    "nli_asked": (T.NLI_CLASSIFICATION_WITH_PROMPT, {"input1": "line1", "input2": "line2", "output": "harm_label"}),
    "nli_chinese": (T.NLI_CLASSIFICATION_WITH_PROMPT_CHINESE, {"input1": "line1", "input2": "line2", "output": "harm_label"}),
    "civil": (T.CIVIL_COMMENTS_TEMPLATE_NO_LABELS, {"input": "text", "output": "fine_label"}),
    "civil_fine": (T.CIVIL_COMMENTS_FINEGRAINED_TEMPLATE_NO_LABELS, {"input": "line1", "output": "fine_label"}),
    "squad": (T.SQUAD_TEMPLATE_NO_LABELS, {"title": "instruction", "context": "text", "question": "line1"}),
    "squad_answered": (T.SQUAD_TEMPLATE_WITH_LABELS, {"title": "instruction", "context": "text", "question": "line1", "answer": "line2"}),
    "dynahate": (T.HATE_CLASSIFICATION_WITH_LABEL, {"input": "text", "output": "dyna_label"}),
}


def _classification_sql() -> str:
    def pick(mapping: dict) -> str:
        return f"CASE WHEN toxic = 1 THEN {sql_lit(str(mapping[True]))} ELSE {sql_lit(str(mapping[False]))} END"
    fine = "[" + ", ".join(sql_lit(x) for x in T.CIVIL_COMMENTS_FINEGRAINED_LABELS) + "]"
    cols = ", ".join(f"md5({sql_format(t, **v)}) AS {k}" for k, (t, v) in _CLASSIFICATION.items())
    return f"""
WITH x AS (SELECT d.doc_id, d.text, l.toxic, string_split(d.text, chr(10)) AS ls FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
y AS (SELECT doc_id, text, ls[1] AS line1, ls[2] AS line2, {sql_lit(T.SQUAD_INSTRUCTION)} AS instruction,
      {pick(T.TOXIC_CLASSIFICATION_LABELS)} AS toxic_label, {pick(T.WILDGUARD_PROMPT_ONLY_LABELS)} AS harm_label,
      {pick(T.DYNAHATE_LABELS)} AS dyna_label, {pick(T.DYNAHATE_LABEL_IDS)} AS dyna_id, {fine}[doc_id % 6 + 1] AS fine_label FROM x)
SELECT doc_id, dyna_id::INTEGER AS dyna_id, {cols} FROM y
"""


@query("classification_prompts", _classification_sql())
def q_classification_prompts(spark, sf_dir):
    """H4 + H7: every labelled document in the toxicity, safety, detoxification, inference and reading templates, labels through
    their maps."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = d.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    lines, toxic = F.split("text", "\n"), F.col("toxic") == 1
    fine = F.array(*map(F.lit, T.CIVIL_COMMENTS_FINEGRAINED_LABELS))
    x = x.select("doc_id", "text", F.get(lines, 0).alias("line1"), F.get(lines, 1).alias("line2"),
                 F.lit(T.SQUAD_INSTRUCTION).alias("instruction"),
                 label_text(toxic, T.TOXIC_CLASSIFICATION_LABELS).alias("toxic_label"),
                 label_text(toxic, T.WILDGUARD_PROMPT_ONLY_LABELS).alias("harm_label"),
                 label_text(toxic, T.DYNAHATE_LABELS).alias("dyna_label"), label_text(toxic, T.DYNAHATE_LABEL_IDS).alias("dyna_id"),
                 F.get(fine, (F.col("doc_id") % 6).cast("int")).alias("fine_label"))
    return x.select("doc_id", "dyna_id", *[F.md5(format_template(t, **v)).alias(k) for k, (t, v) in _CLASSIFICATION.items()])
