"""Prompt expansion (C6) and per-evaluator prompt tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.templates import NOISY_CHANNEL_TEMPLATES, format_template


def noisy_channel_expand(df: DataFrame, *, input_col: str = "text",
                         templates=NOISY_CHANNEL_TEMPLATES) -> DataFrame:
    """One row per (input row x template x label choice) with the rendered ``prompt``.

    The (template, choice) list is a literal array exploded inside each row (a
    generator, not a join), so the expansion is local to the task.
    """
    choices = []
    for i, (_, cmap) in enumerate(templates):
        for ch in (False, True):
            choices.append(F.struct(F.lit(i).alias("template_id"), F.lit(ch).alias("choice"),
                                    F.lit(cmap[ch]).alias("choice_text")))
    x = df.select("*", F.inline(F.array(*choices)))
    prompt = None
    for i, (tpl, _) in enumerate(templates):
        rendered = format_template(tpl, choice=F.col("choice_text"), input=F.col(input_col))
        prompt = (F.when(F.col("template_id") == i, rendered) if prompt is None
                  else prompt.when(F.col("template_id") == i, rendered))
    return x.withColumn("prompt", prompt)


def evaluator_prompts(df: DataFrame, evaluators: dict[str, str], **cols) -> DataFrame:
    """H4 + A14: one prompt per (row x evaluator label); write with ``partitionBy('evaluator')``."""
    arr = F.array(*[F.struct(F.lit(name).alias("evaluator"),
                             format_template(tpl, **cols).alias("prompt")) for name, tpl in evaluators.items()])
    return df.select("*", F.inline(arr))
