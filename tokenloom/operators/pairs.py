"""Conversation-pair training rows: H13 truncation, H14 assembly, H15 preprocessing, H16 loss mask.

H13 is integer column arithmetic (no loop); the closed form reproduces the
reference's trimming, including the case where an even split trims all of
the second text (``fix_empty_reply`` turns that off).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.templates import pair_boundary
from tokenloom.functions.text import col_, order_key, py_strip, token_ids
from tokenloom.operators.packing import PAD_ID
from tokenloom.operators.tokenize import ids_of_pieces


def truncation_cuts(n1, n2, p1, p2, max_seq_len: int, fix_empty_reply: bool = False) -> tuple[Column, Column]:
    """Tokens to cut from the head of text1 and the tail of text2."""
    n1, n2, p1, p2 = (col_(c) if not isinstance(c, int) else F.lit(c) for c in (n1, n2, p1, p2))
    total = n1 + n2 + p1 + p2
    e = total - max_seq_len + 1
    d = n1 - n2
    m = F.abs(d)
    r = F.floor((e - m) / 2).cast("int")
    fits = total <= max_seq_len
    r0_cut = (lambda alt: alt) if fix_empty_reply else (lambda alt: n2)
    cut1 = (F.when(fits, 0)
            .when((m >= e) & (d >= 0), e)
            .when(m >= e, 0)
            .when(d >= 0, m + r)
            .otherwise(r))
    cut2 = (F.when(fits, 0)
            .when((m >= e) & (d >= 0), 0)
            .when(m >= e, e)
            .when(d >= 0, F.when(r == 0, r0_cut(F.lit(0))).otherwise(r))
            .otherwise(F.when(r == 0, r0_cut(m)).otherwise(m + r)))
    return cut1.cast("int"), F.least(cut2, n2).cast("int")


def assemble_pair(prefix1, ids1, prefix2, ids2, max_seq_len: int, *, pad_id: int = PAD_ID,
                  pad: bool = True) -> tuple[Column, Column, Column]:
    """``prefix1+ids1+prefix2+ids2``; loss 0 on side 1, 1 on side 2 incl. its prefix; right-pad."""
    p1, t1, p2, t2 = (col_(c) for c in (prefix1, ids1, prefix2, ids2))
    ids = F.concat(p1, t1, p2, t2)
    loss = F.concat(F.array_repeat(F.lit(0), F.size(p1) + F.size(t1)), F.array_repeat(F.lit(1), F.size(p2) + F.size(t2)))
    attn = F.array_repeat(F.lit(1), F.size(ids))
    if pad:
        k = F.greatest(F.lit(max_seq_len) - F.size(ids), F.lit(0))
        ids = F.concat(ids, F.array_repeat(F.lit(pad_id), k))
        loss = F.concat(loss, F.array_repeat(F.lit(0), k))
        attn = F.concat(attn, F.array_repeat(F.lit(0), k))
    return ids, loss, attn


def loss_all_but_pad(ids, pad_id: int = PAD_ID) -> Column:
    """Loss on every position whose id is not the pad id."""
    return F.transform(col_(ids), lambda x: (x != F.lit(pad_id)).cast("int"))


def prepare_conversation(df: DataFrame, max_seq_len: int, *, text1: str = "text1", text2: str = "text2",
                         role1: str = "User: ", role2: str = "Response: ", seed: int | None = None,
                         key_cols=(), use_loss_mask: bool = True, pad: bool = True, pad_id: int = PAD_ID,
                         fix_empty_reply: bool = False,
                         fn: Callable[[list[str]], list[list[int]]] | None = None) -> DataFrame:
    """Pair rows -> ``input_ids, loss_mask, attention_mask`` (+ cut sizes), optionally an order key.

    Texts and role prefixes are stripped, get a line end each and are tokenised: with ``fn`` (any tokenizer of a
    list of texts, in Arrow batches) or the built-in tokenizer, to which the line end is no token.
    """
    parts = [F.concat(py_strip(text1), F.lit("\n")), F.concat(py_strip(text2), F.lit("\n"))]
    if fn is None:
        x = df.select(*key_cols, *[token_ids(t).alias(c) for t, c in zip(parts, ("_i1", "_i2"))],
                      *[token_ids(F.lit(r.strip() + "\n")).alias(c) for r, c in zip((role1, role2), ("_p1", "_p2"))])
    else:
        roles = [F.array(*map(F.lit, ids)).cast("array<int>") for ids in fn([role1.strip() + "\n", role2.strip() + "\n"])]
        x = df.select(*key_cols, ids_of_pieces(fn)(F.array(*parts)).alias("_ids"))
        x = x.select(*key_cols, F.get("_ids", 0).alias("_i1"), F.get("_ids", 1).alias("_i2"),
                     roles[0].alias("_p1"), roles[1].alias("_p2"))
    c1, c2 = truncation_cuts(F.size("_i1"), F.size("_i2"), F.size("_p1"), F.size("_p2"), max_seq_len,
                             fix_empty_reply)
    x = x.withColumn("cut1", c1).withColumn("cut2", c2)
    t1 = F.slice("_i1", F.col("cut1") + 1, F.greatest(F.size("_i1") - F.col("cut1"), F.lit(0)))
    t2 = F.slice("_i2", F.lit(1), F.greatest(F.size("_i2") - F.col("cut2"), F.lit(0)))
    ids, loss, attn = assemble_pair("_p1", t1, "_p2", t2, max_seq_len, pad_id=pad_id, pad=pad)
    out = x.select(*key_cols, F.size("_i1").alias("n1"), F.size("_i2").alias("n2"), "cut1", "cut2",
                   ids.alias("input_ids"), loss.alias("loss_mask"), attn.alias("attention_mask"))
    if not use_loss_mask:
        out = out.withColumn("loss_mask", loss_all_but_pad("input_ids", pad_id))
    if seed is not None:
        out = out.withColumn("order_key", order_key(seed, *key_cols))
    return out


#: Tokenizer families whose boundary rule is known: a space belongs to the token after it.
PAIR_TOKENIZERS = ("byte-level", "gpt-neox")


def tokenize_pairs(df: DataFrame, fn: Callable[[list[str]], list[list[int]]], *, tokenizer: str, input: str = "input",
                   output: str = "output", keep=()) -> DataFrame:
    """H8 with its tokenise step: ``keep..., violation, input_ids, output_ids, at_boundary``.

    The space at the input's end moves to the output (``pair_boundary``) and both are encoded by the same call of ``fn``,
    with the joined text and other pairs up to a megabyte: ``at_boundary`` tells whether the joined text's ids are the input's followed by the output's,
    i.e. no token spans the boundary. An unknown ``tokenizer`` name fails while the plan is built; ill-formed pairs have a violation
    and no ids.
    """
    if not any(f in tokenizer.lower() for f in PAIR_TOKENIZERS):
        raise ValueError(f"tokenizer {tokenizer!r} is not supported; known families: {PAIR_TOKENIZERS}")
    i, o, violation = pair_boundary(input, output)
    x = df.select(*keep, violation.alias("violation"), F.when(violation.isNull(), F.array(i, o, F.concat(i, o))).alias("_parts"))
    x = x.select(*keep, "violation", ids_of_pieces(fn)("_parts").alias("_ids"))
    ok = F.col("violation").isNull()
    return x.select(*keep, "violation", F.when(ok, F.get("_ids", 0)).alias("input_ids"), F.when(ok, F.get("_ids", 1)).alias("output_ids"),
                    F.when(ok, F.concat(F.get("_ids", 0), F.get("_ids", 1)) == F.get("_ids", 2)).alias("at_boundary"))
