import pytest
from pyspark.sql import functions as F

from tokenloom.functions.templates import format_template, pair_boundary, reformat_dialogue
from tokenloom.functions.text import completion_suffix, py_strip
from tokenloom.operators.chat import render_conversations, render_turns, turn_pairs
from tokenloom.operators.pairs import assemble_pair, loss_all_but_pad, truncation_cuts


def test_chat_render(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"),
                                   (1, 3, "user", "v"), (2, 0, "user", "u"), (2, 1, "assistant", "a"),
                                   (2, 2, "tool", "x")],
                                  "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r.rendered for r in render_conversations(turns, add_generation_prompt=True).collect()}
    pieces = render_turns(turns.where("conv_id = 1"), add_generation_prompt=True).orderBy("turn").collect()
    assert "".join(p.piece for p in pieces) == out[1]
    assert out[1] == "<|system|>\ns\n<|user|>\nu\n<|assistant|>\na</s>\n<|user|>\nv\n<|assistant|>\n"
    two = render_conversations(turns.where("conv_id = 2 AND role <> 'tool'")).first().rendered
    assert two == "<|user|>\nu\n<|assistant|>\na</s>"


@pytest.mark.parametrize("L,n1,n2,kept", [(10, 8, 2, (5, 2)), (10, 5, 5, (4, 4)), (10, 5, 4, (4, 0)),
                                          (10, 4, 5, (4, 0)), (9, 4, 4, (3, 3)), (20, 4, 4, (4, 4))])
def test_truncation_closed_form(spark, L, n1, n2, kept):
    df = spark.createDataFrame([(n1, n2)], "n1 int, n2 int")
    c1, c2 = truncation_cuts("n1", "n2", 1, 1, L)
    r = df.select(c1.alias("c1"), c2.alias("c2")).first()
    assert (n1 - r.c1, n2 - r.c2) == kept


def test_fix_empty_reply(spark):
    df = spark.createDataFrame([(5, 4)], "n1 int, n2 int")
    c1, c2 = truncation_cuts("n1", "n2", 1, 1, 10, fix_empty_reply=True)
    r = df.select(c1.alias("c1"), c2.alias("c2")).first()
    assert (5 - r.c1, 4 - r.c2) == (4, 4)


def test_assemble_pair(spark):
    df = spark.createDataFrame([([1], [2, 3], [4], [5])], "p1 array<int>, t1 array<int>, p2 array<int>, t2 array<int>")
    ids, loss, attn = assemble_pair("p1", "t1", "p2", "t2", 7, pad_id=0)
    r = df.select(ids.alias("i"), loss.alias("l"), attn.alias("a")).first()
    assert r.i == [1, 2, 3, 4, 5, 0, 0] and r.l == [0, 0, 0, 1, 1, 0, 0] and r.a == [1, 1, 1, 1, 1, 0, 0]
    r2 = df.select(loss_all_but_pad(F.array(*[F.lit(x) for x in r.i]), 0).alias("m")).first()
    assert r2.m == [1, 1, 1, 1, 1, 0, 0]


def test_pair_boundary_and_completion(spark):
    df = spark.createDataFrame([("q: ", "yes"), ("q:", "yes"), ("q: ", " yes")], "i string, o string")
    i2, o2, v = pair_boundary("i", "o")
    out = [(r.a, r.b, r.v) for r in df.select(i2.alias("a"), o2.alias("b"), v.alias("v")).collect()]
    assert out[0] == ("q:", " yes", None)
    assert out[1][2] == "input_no_trailing_space" and out[2][2] == "output_leading_space"
    c = spark.createDataFrame([("abc", "abcdef")], "p string, f string").select(completion_suffix("f", "p")).first()[0]
    assert c == "def"


def test_templates_and_strip(spark):
    df = spark.createDataFrame([("hi {x}", "toxic", "  pad \n")], "i string, o string, s string")
    r = df.select(format_template("Q: {input}|{output}", input="i", output="o").alias("t"),
                  py_strip("s").alias("s"),
                  reformat_dialogue("i", "o", "unknown", True).alias("fin"),
                  reformat_dialogue("i", "o", "unknown", False).alias("nf")).first()
    assert r.t == "Q: hi {x}|toxic" and r.s == "pad"
    assert r.fin == "Instruct: hi {x}\nOutput:toxic"
    assert r.nf.startswith("Question: Does the provided text") and r.nf.endswith("Answer: toxic\n")


def test_turn_pairs(spark):
    turns = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "a"), (1, 2, "user", "v")],
                                  "conv_id long, turn long, role string, text string")
    assert [(r.text1, r.text2) for r in turn_pairs(turns).collect()] == [("u", "a")]


def test_turn_numbers_may_have_gaps(spark):
    rows = [(1, 0, "user", "a"), (1, 2, "assistant", "b"), (1, 5, "user", "c"), (2, 7, "user", "d"), (2, 8, "user", "e"),
            (2, 30, "assistant", "f"), (3, 1, "assistant", "g")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.turn, r.text1, r.text2) for r in turn_pairs(t).collect())
    assert got == [(1, 0, "a", "b"), (2, 8, "e", "f")]
    heads = [r.turn for r in render_turns(t.where("conv_id = 1"), add_generation_prompt=True).collect()
             if r.piece.endswith("<|assistant|>\n")]
    assert heads == [5]


def test_prepare_conversation_with_a_callable_tokenizer(spark):
    from tokenloom.operators.pairs import prepare_conversation

    df = spark.createDataFrame([(1, " ab ", "c"), (2, None, "d")], "k int, text1 string, text2 string")
    got = prepare_conversation(df, 12, key_cols=["k"], role1="U: ", role2="R", pad_id=0,
                               fn=lambda texts: [[ord(c) for c in t] for t in texts]).orderBy("k").collect()
    assert got[0].input_ids == [*map(ord, "U:\nab\nR\nc\n"), 0, 0] and got[0].loss_mask == [0] * 6 + [1] * 4 + [0] * 2
    assert got[1].n1 == 0 and got[1].n2 == 2


def test_reserved_token_must_encode_as_itself(spark):
    import pytest

    from tokenloom.operators.corpus import reserved_prefix

    reserved_prefix("t", "allenai/OLMo-2-1124-7B", 3, encode=lambda s: [7] * s.count("<|extra_id_0|>"))
    with pytest.raises(ValueError):
        reserved_prefix("t", "allenai/OLMo-2-1124-7B", 3, encode=lambda s: [len(s)])


def test_turn_pairs_across_buckets(spark):
    """Gaps, negative turns, other roles in between and buckets of a few turns against plain lists."""
    import random

    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "user", "system"]), f"{c}-{t}")
            for c in range(30) for t in sorted(rnd.sample(range(-20, 60), rnd.randint(1, 40)))]
    rows += [(99, t, "user" if t % 2 else "assistant", str(t)) for t in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = sorted((a[0], a[1], a[3], b[3]) for a, b in zip(rows, rows[1:])
                  if a[0] == b[0] and a[2] == "user" and b[2] == "assistant")
    for size in (1, 3, 7, 4096):
        assert sorted(map(tuple, turn_pairs(df, bucket_turns=size).collect())) == want


def test_tokenizers_see_a_piece_of_a_batch_at_a_time():
    """Elements of a row stay together, whatever a batch holds, and no call gets more than a row beyond ``PIECE`` bytes."""
    import pyarrow as pa

    from tokenloom.operators import tokenize as tk

    calls = []

    def fn(texts):
        calls.append(texts)
        return [[len(t)] * (len(t) % 3) for t in texts]

    rows = [["a" * (k * 7919 % 90_000), None, "\u00e9" * (k % 5)] for k in range(300)] + [None, [], ["x" * (3 * tk.PIECE)]]
    batch = pa.array([["before"], *rows], pa.list_(pa.string())).slice(1)
    got = tk.ids_of_pieces(fn).func(batch).to_pylist()
    assert got == [[[len(t or "")] * (len(t or "") % 3) for t in r or []] for r in rows]
    assert len(calls) > 10 and sum(map(len, calls)) == 901
    assert all(sum(len(t.encode()) for t in c) <= tk.PIECE or len(c) == 1 for c in calls)
    flat = pa.array(["b", None, *("y" * 500_000 for _ in range(5))])
    calls.clear()
    assert tk._callable_udf(fn).func(flat).to_pylist() == [[1], [], *[[500_000] * 2] * 5] and len(calls) == 3
    assert tk._callable_udf(fn).func(flat.slice(0, 0)).to_pylist() == [] == tk.ids_of_pieces(fn).func(batch.slice(0, 0)).to_pylist()


def test_tokenize_pairs(spark):
    from tokenloom.operators.pairs import tokenize_pairs

    df = spark.createDataFrame([(1, "a b ", "c d"), (2, "a b", "c"), (3, "a ", " c"), (4, "x ", "")], "k long, input string, output string")
    calls = lambda texts: [[len(w) for w in t.split()] for t in texts]
    got = {r.k: r for r in tokenize_pairs(df, calls, tokenizer="some/GPT-NeoX-20b", keep=["k"]).collect()}
    assert (got[1].input_ids, got[1].output_ids, got[1].at_boundary, got[1].violation) == ([1, 1], [1, 1], True, None)
    assert got[2].violation == "input_no_trailing_space" and got[2].input_ids is None and got[2].at_boundary is None
    assert got[3].violation == "output_leading_space" and got[4].output_ids == []
    merging = lambda texts: [[len(t)] for t in texts]  # noqa: E731  one token a text: it spans the boundary
    assert {r.at_boundary for r in tokenize_pairs(df.where("k = 1"), merging, tokenizer="byte-level").collect()} == {False}
    with pytest.raises(ValueError, match="not supported"):
        tokenize_pairs(df, calls, tokenizer="wordpiece")
