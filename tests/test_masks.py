from pyspark.sql import functions as F

from tokenloom.operators.masks import (
    char_to_token,
    drop_unmaskable,
    mask_to_tokens,
    random_token_budget,
    segment_token_mask,
    span_segments,
    zero_bad_words,
)
from tokenloom.operators.tokenize import token_offsets, token_spans


def test_span_segments(spark):
    df = spark.createDataFrame([("abcdefghij", [(2, 4, 0.9), (3, 6, 0.5), (8, 9, 0.1)])],
                               "text string, spans array<struct<start:int,end:int,score:double>>")
    segs = df.select(span_segments("text", "spans", 0.8, 0.3).alias("s")).first().s
    assert [(s.text, s.label) for s in segs] == [("abcd", 3), ("def", 2), ("ghi", 1), ("j", 1)]


def test_segment_mask_and_drop(spark):
    df = spark.createDataFrame([("a b\nc", [(0, 3, 0.9)]), ("", [])],
                               "text string, spans array<struct<start:int,end:int,score:double>>")
    x = drop_unmaskable(df.withColumn("segments", span_segments("text", "spans", 0.8, 0.3)))
    ids, mask = segment_token_mask("segments")
    rows = x.select(ids.alias("i"), mask.alias("m")).collect()
    assert len(rows) == 1 and rows[0].m == [3, 3, 1] and len(rows[0].i) == 3


def test_char_and_mask_to_token(spark):
    df = spark.createDataFrame([([0, 2, 4], [2, 4, 7], c) for c in (4, 3, 7)], "s array<int>, e array<int>, c int")
    t, a = char_to_token("s", "e", "c")
    out = [tuple(r) for r in df.select(t, a).collect()]
    assert out == [(2, True), (1, False), (2, False)]
    m = spark.createDataFrame([([0, 2, 4, 0], [2, 4, 5, 0], [0, 0, 1, 1, 0])], "s array<int>, e array<int>, m array<int>")
    r = m.select(mask_to_tokens("s", "e", "m").alias("a"), mask_to_tokens("s", "e", "m", shift=True).alias("b")).first()
    assert r.a == [1] and r.b == [0]


def test_token_budget_and_badwords(spark):
    df = spark.createDataFrame([(7, ["The", "a", "b", "c", "d", "e", "f", "g", "h", "i"])], "k long, t array<string>")
    m = df.select(random_token_budget(F.size("t"), 0.25, 1, "k").alias("m")).first().m
    assert len(m) == 10 and sum(m) == 2
    all_on = df.select(zero_bad_words(F.array_repeat(F.lit(1), 10), "t", ["the"]).alias("z")).first().z
    assert all_on == [0] + [1] * 9


def test_token_offsets(spark):
    df = spark.createDataFrame([(1, "  ab cd\n e")], "doc_id long, text string")
    rows = [(r.token_index, r.token, r.start, r.end) for r in token_offsets(df, ["doc_id"]).orderBy("start").collect()]
    assert rows == [(0, "ab", 2, 4), (1, "cd", 5, 7), (2, "e", 9, 10)]


def test_token_spans_in_row(spark):
    df = spark.createDataFrame([(1, "  ab cd\n e"), (2, "")], "doc_id long, text string")
    r = {x.doc_id: (x.o.starts, x.o.ends) for x in df.select("doc_id", token_spans("text").alias("o")).collect()}
    assert r[1] == ([2, 5, 9], [4, 7, 10]) and r[2] == ([], [])


def test_char_to_token_long_form_matches_array_form(spark):
    from tokenloom.operators.masks import char_to_token_long

    docs = spark.createDataFrame([(1, "ab cd  efg"), (2, "x"), (3, "  lead")], "doc_id long, text string")
    chars = spark.createDataFrame([(1, 3), (2, 0), (3, 1)], "doc_id long, char_index int")
    long_form = {r.doc_id: (r.token_index, r.aligned)
                 for r in char_to_token_long(token_offsets(docs, ["doc_id"]), chars, ["doc_id"]).collect()}
    x = docs.join(chars, "doc_id").select("doc_id", "char_index", token_spans("text").alias("o"))
    t, a = char_to_token("o.starts", "o.ends", "char_index")
    arr = {r.doc_id: (r.t, r.a) for r in x.select("doc_id", t.alias("t"), a.alias("a")).collect()}
    assert long_form == arr == {1: (1, True), 2: (0, True), 3: (0, False)}


def test_span_segments_far_into_a_long_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(5000)) + "é€😀" * 400
    ends = [10, 1023, 1024, 1025, 2048, 4999, 5500, 6200]
    spans = [(a, b, 0.5) for a, b in zip([3, *ends], ends)] + [(1000, 6150, 0.9), (6100, 6000, 0.1)]
    df = spark.createDataFrame([(text, spans), (None, spans), (text, None)],
                               "text string, spans array<struct<start:int,end:int,score:double>>")
    got = df.select(span_segments("text", "spans", 0.8, 0.3).alias("s")).collect()
    want, prev = [], 0
    for a, b, _ in spans:
        want.append(text[min(prev, a):b])
        prev = b
    assert [s.text for s in got[0].s] == [*want, text[prev:]]
    assert [s.text for s in got[1].s] == [None] * len(spans) and [s.text for s in got[2].s] == [text]


def test_segment_mask_with_a_callable_tokenizer(spark):
    df = spark.createDataFrame([([("ab", 3), ("", 1), ("c d", 2)],), (None,)], "s array<struct<text:string,label:int>>")
    ids, mask = segment_token_mask("s", lambda texts: [[ord(c) for c in t] for t in texts])
    a = df.select(ids.alias("i"), mask.alias("m")).first()
    assert a.i == [97, 98, 99, 32, 100] and a.m == [3, 3, 2, 2, 2]


def test_spans_by_a_callable_tokenizer(spark):
    from tokenloom.operators.tokenize import spans_by

    df = spark.createDataFrame([("abcd",), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(spans_by(lambda ts: [[(k, k + 2) for k in range(0, len(t), 2)] for t in ts])("text")).collect()]
    assert [(x.starts, x.ends) for x in got] == [([0, 2], [2, 4]), ([], []), ([], [])]


def test_long_forms_against_plain_loops(spark):
    """Tokens with equal and empty spans, chars between and behind tokens, spans that overlap, nest, touch or are empty."""
    import random

    from tokenloom.operators.masks import char_to_token_long, spans_to_tokens_long

    rnd = random.Random(8)
    tokens, chars, spans = [], [], []
    for d in range(40):
        at = 0
        for k in range(rnd.randint(0, 15)):
            start = at + rnd.choice([0, 0, 1, 3])
            at = start + rnd.choice([0, 1, 2, 5])
            tokens.append((d, k, start, at))
        chars += [(d, c) for c in sorted(rnd.sample(range(60), 12))]
        spans += [(d, s, s + rnd.choice([0, 1, 4, 20])) for s in rnd.sample(range(50), rnd.randint(0, 6))]
    t = spark.createDataFrame(tokens, "doc_id long, token_index int, start int, end int")
    by = {}
    for d, k, a, b in tokens:
        by.setdefault(d, []).append((k, a, b))
    want = {}
    for d, c in chars:
        if d in by:
            k, a, _ = next((x for x in by[d] if x[1] <= c < x[2]), by[d][-1])
            want[d, c] = (k, a == c)
    got = char_to_token_long(t, spark.createDataFrame(chars, "doc_id long, char_index int"), ["doc_id"]).collect()
    assert {(r.doc_id, r.char_index): (r.token_index, r.aligned) for r in got} == want
    hit = sorted({(d, k) for d, k, a, b in tokens for e, s, z in spans if e == d and a < z and b > s and s < z and a < b})
    got = spans_to_tokens_long(t, spark.createDataFrame(spans, "doc_id long, start int, end int"), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.token_index) for r in got) == hit


def test_long_forms_are_linear(spark):
    """100,000 tokens, chars and spans in one document: all pairs would be 10^10."""
    import time

    from pyspark.sql import functions as F

    from tokenloom.operators.masks import char_to_token_long, spans_to_tokens_long

    n = 100_000
    t = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("token_index"), (F.col("id") * 5).cast("int").alias("start"),
                              (F.col("id") * 5 + 4).cast("int").alias("end"))
    began = time.time()
    chars = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 5 + 2).cast("int").alias("char_index"))
    assert char_to_token_long(t, chars, ["doc_id"]).where("token_index * 5 + 2 = char_index").count() == n
    spans = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 5 + 3).cast("int").alias("start"), (F.col("id") * 5 + 5).cast("int").alias("end"))
    assert spans_to_tokens_long(t, spans, ["doc_id"]).count() == n
    assert time.time() - began < 60


def test_line_spans_leave_a_piece_of_a_batch_at_a_time():
    """Spans of NULL, blank and long texts, in stretches of ``PIECE`` bytes with the other columns."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from tokenloom.operators.tokenize import PIECE
    from tokenloom.plans.masks import _line_spans, scored_line_spans

    class Docs:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
        columns = ["doc_id", "text"]

        def mapInArrow(self, run, schema):
            return run

    texts = ["a\n\nbé\n", None, "", "\n"] + ["line of text\n" * 20_000] * 12 + ["x" * (2 * PIECE)]
    ids = [None, *range(1, len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array([7, *ids]), pa.array(["left out", *texts])], ["doc_id", "text"]).slice(1)
    got = list(scored_line_spans(Docs())(iter([batch])))
    assert len(got) > 3 and all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b["text"].to_pylist()) <= PIECE for b in got)
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["doc_id"], r["text"]) for r in rows] == list(zip(ids, texts))
    assert [(s["start"], s["end"]) for s in rows[0]["spans"]] == [(0, 1), (3, 5)] and [r["spans"] for r in rows[1:4]] == [[], [], []]
    assert rows[0]["spans"][0]["score"] == int("0cc175b", 16) / 2 ** 28 and len(rows[5]["spans"]) == 20_000
    assert _line_spans([]).to_pylist() == []
