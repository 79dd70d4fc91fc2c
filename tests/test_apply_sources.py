import json
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from tokenloom.operators.apply import apply_with_errors, score, split_dead_letter
from tokenloom.sources.readers import (
    find_files,
    load_jsonl,
    read_any,
    read_lines,
    read_router_records,
    require_one_file,
)
from tokenloom.sources.writers import write_jsonl, write_line_shards, write_shards


def test_dead_letter(spark):
    df = spark.createDataFrame([(0, '{"k":1}'), (1, "{bad")], "index long, v string")
    good, bad = split_dead_letter(apply_with_errors(df, json.loads, "v"))
    assert [(r["index"], json.loads(r.out)) for r in good.collect()] == [(0, {"k": 1})]
    b = bad.collect()
    assert len(b) == 1 and b[0]["index"] == 1 and b[0].error == "JSONDecodeError"
    bare = apply_with_errors(df, lambda v: json.loads(v)["missing"], "v").collect()
    assert {r.error for r in bare} == {"KeyError", "JSONDecodeError"}


def test_score_modes(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "prompt string")
    masked = df.withColumn("target_mask", F.array(F.lit(1)))
    out = score(masked, lambda ps, ms: [{"loss": float(len(p)), "perplexity": 1.0} for p, _ in zip(ps, ms, strict=True)],
                "get_loss").collect()
    with pytest.raises(ValueError, match="target_mask"):
        score(df, lambda ps, ms: [], "get_loss")
    assert sorted(r.loss for r in out) == [1.0, 3.0] and all(r.label is None for r in out)
    lg = score(df, lambda ps: [{"completion": True, "highest_token": 3, "logits": [0.5, 0.1], "generated": p}
                               for p in ps], "logits").collect()
    assert {r.highest_token for r in lg} == {3} and lg[0].logits == [0.5, 0.1]
    with pytest.raises(ValueError, match="unknown inference mode"):
        score(df, lambda ps: ps, "nope")


def test_read_lines_zst_keeps_last_line(spark, tmp_path):
    p = tmp_path / "x.zst"
    p.write_bytes(zstandard.ZstdCompressor().compress(b"one\ntwo\nthree"))
    lines = [r.line for r in read_lines(spark, str(p), fn=F.upper).collect()]
    assert lines == ["ONE", "TWO", "THREE"]


def test_read_any_and_jsonl_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"native_id": str(i)}) + "\n" for i in range(5)))
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n")
    assert read_any(spark, str(tmp_path / "b.tsv")).columns == ["x", "y"]
    rows = load_jsonl(spark, str(tmp_path / "a.jsonl"), "native_id string").orderBy("line_no").collect()
    assert [(r.line_no, r.native_id) for r in rows] == [(i, str(i)) for i in range(5)]
    assert find_files(spark, str(tmp_path), "a.json").count() == 1
    assert require_one_file(find_files(spark, str(tmp_path), "a.json")).count() == 1
    (tmp_path / "a2.jsonl").write_text("{}\n")
    with pytest.raises(Exception, match="exactly one"):
        require_one_file(find_files(spark, str(tmp_path), "a")).collect()


def test_router_files_roundtrip(spark, tmp_path):
    rec = {"prompt": "p", "token_index": 0, "router_logits": [[[1.0, 2.0]]]}
    for dom in ("gsm8k", "mmlu"):
        (tmp_path / f"{dom}-router.jsonl").write_text(json.dumps(rec) + "\n")
    r = read_router_records(spark, str(tmp_path))
    assert sorted(x.domain for x in r.collect()) == ["gsm8k", "mmlu"]


def test_writers(spark, tmp_path):
    df = spark.range(300).withColumnRenamed("id", "k")
    write_line_shards(df, str(tmp_path / "shards"), "k")
    back = spark.read.json(str(tmp_path / "shards"))
    assert back.select("shard").distinct().count() == 150 and back.count() == 300
    write_shards(df, str(tmp_path / "cols"), 4, "k")
    assert spark.read.parquet(str(tmp_path / "cols")).select("shard").distinct().count() == 4
    write_jsonl(df, str(tmp_path / "j"), order=["k"], files=3)
    assert spark.read.json(str(tmp_path / "j")).count() == 300
    assert os.path.isdir(tmp_path / "j")


def test_jsonl_line_numbers_across_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        for f in ("x", "y"):
            (tmp_path / f"{f}.jsonl").write_text("".join(json.dumps({"native_id": f"{f}{i}"}) + "\n"
                                                          for i in range(700)))
        rows = load_jsonl(spark, str(tmp_path / "*.jsonl"), "native_id string").collect()
        assert spark.read.json(str(tmp_path / "*.jsonl")).rdd.getNumPartitions() > 2
        got = {(r.file_path.rsplit("/", 1)[-1][0], r.line_no): r.native_id for r in rows}
        assert got == {(f, i): f"{f}{i}" for f in "xy" for i in range(700)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_evaluator_dirs_report_and_token_stream(spark, tmp_path):
    from tokenloom.operators.composition import composition_rollup, write_report
    from tokenloom.operators.packing import flat_token_stream, pack_sequences, write_token_stream
    from tokenloom.operators.prompts import evaluator_prompts
    from tokenloom.sources.writers import evaluator_samples, write_per_evaluator

    qa = spark.createDataFrame([(1, "q1", "a1"), (2, "q2", "a2")], "k long, question string, answer string")
    p = evaluator_prompts(qa, {"qa": "Question: {question}\nAnswer:", "full": "{question} {answer}"},
                          question="question", answer="answer").withColumn("order_key", F.col("k"))
    write_per_evaluator(p.select("evaluator", "prompt"), str(tmp_path / "eval"))
    assert os.path.isdir(tmp_path / "eval" / "evaluator=qa") and os.path.isdir(tmp_path / "eval" / "evaluator=full")
    samples = {r.evaluator: r.sample_prompt for r in evaluator_samples(p).collect()}
    assert samples == {"qa": "Question: q1\nAnswer:", "full": "q1 a1"}

    docs = spark.createDataFrame([("en", "a", 3), ("fr", "b", 4)], "lang string, src string, n_tokens int")
    write_report(composition_rollup(docs, category="lang", subfolder="src", data_path="/d"), str(tmp_path / "rep"))
    rep = spark.read.option("header", True).csv(str(tmp_path / "rep"))
    assert rep.columns == ["data_path", "category", "subfolder", "total_tokens"] and rep.count() == 2

    ids = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6, 7])], "k long, input_ids array<int>")
    write_token_stream(flat_token_stream(pack_sequences(ids, 4, "k", eos_id=0), 4, max_id=65535),
                       str(tmp_path / "stream"), rows_per_file_block=4)
    back = spark.read.parquet(str(tmp_path / "stream")).orderBy("pos").collect()
    assert [r.token_id for r in back] == [1, 2, 3, 0, 4, 5, 6, 7]


def test_batch_apply_tokenizer_callable_and_optional_columns(spark):
    import pandas as pd

    from tokenloom.operators.apply import apply_per_shard, map_batches
    from tokenloom.operators.checks import optional_column
    from tokenloom.operators.tokenize import decode, tokenize

    df = spark.createDataFrame([(0, 1, "a b"), (1, 1, "c"), (2, 2, "d e f")], "k long, shard int, text string")
    doubled = map_batches(df.select("k"), lambda pdf: pdf.assign(k2=pdf["k"] * 2), "k long, k2 long")
    assert sorted((r.k, r.k2) for r in doubled.collect()) == [(0, 0), (1, 2), (2, 4)]
    per = apply_per_shard(df.select("shard", "k"), "shard",
                          lambda pdf: pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n": [len(pdf)]}),
                          "shard int, n long")
    assert sorted(tuple(r) for r in per.collect()) == [(1, 2), (2, 1)]
    t = tokenize(df, "text", fn=lambda texts: [[len(w) for w in x.split()] for x in texts], tokens_col=None)
    assert [r.input_ids for r in t.orderBy("k").collect()] == [[1, 1], [1], [1, 1, 1]]
    b = tokenize(df, "text").select(decode("tokens").alias("back"), optional_column(df, "label", "string"))
    rows = b.collect()
    assert {r.back for r in rows} == {"a b", "c", "d e f"} and all(r.label is None for r in rows)


def test_ordered_jsonl_in_many_files(spark, tmp_path):
    """Line numbers run over the part files; a missing, cut or added part fails the job."""
    import glob

    from tokenloom.sources.readers import load_ordered_jsonl

    df = spark.range(1000).selectExpr("id AS k", "id % 3 AS d", "repeat('x', 20) AS t")
    write_jsonl(df, p := str(tmp_path / "a"), order=["k"], files=7)
    assert len(glob.glob(p + "/part-*")) == 7
    assert all(r.line_no == r.k for r in load_ordered_jsonl(spark, p, "k long").collect())
    write_jsonl(df, q := str(tmp_path / "b"), order=["k"], files=5, partition_by="d")
    got = load_ordered_jsonl(spark, q, "k long, d int").collect()
    assert sorted((r.d, r.line_no, r.k) for r in got) == sorted((k % 3, k // 3, k) for k in range(1000))
    assert len(glob.glob(q + "/d=0/part-*")) > 1
    part = sorted(glob.glob(p + "/part-*"))[2]
    lines = open(part).read()
    for change in ("", lines[:lines.index("\n") + 1]):
        os.remove(glob.glob(f"{p}/.{os.path.basename(part)}.crc")[0]) if glob.glob(f"{p}/.{os.path.basename(part)}.crc") else None
        open(part, "w").write(change)
        with pytest.raises(Exception, match="manifest"):
            load_ordered_jsonl(spark, p, "k long").collect()
    os.remove(part)
    with pytest.raises(Exception, match="manifest"):
        load_ordered_jsonl(spark, p, "k long").collect()


def test_one_call_a_row_for_both_outcomes(spark, tmp_path):
    """The function runs once a row, whichever outputs are read and however often the same evaluation is asked for."""
    from tokenloom.operators.apply import apply_with_errors, input_fingerprint, split_dead_letter

    spark.range(50).write.parquet(str(tmp_path / "in"))
    log = tmp_path / "calls"

    def half(v):
        with open(log, "a") as f:
            f.write(f"{v}\n")
        if v % 2:
            raise KeyError("odd")
        return v // 2

    def both(**kw):
        df = spark.read.parquet(str(tmp_path / "in"))
        return split_dead_letter(apply_with_errors(df, half, "id", index="id"), **kw)
    good, bad = both()
    assert (good.count(), bad.count(), good.count()) == (25, 25, 25)
    assert sorted(log.read_text().split()) == sorted(str(i) for i in range(50))
    one = lambda: both(shared_as=("half", input_fingerprint(spark, [str(tmp_path / "in")])))
    log.write_text("")
    assert one()[0].count() == 25 and one()[1].count() == 25
    assert len(log.read_text().split()) == 50
    spark.range(50, 60).write.mode("append").parquet(str(tmp_path / "in"))
    assert one()[1].count() == 30 and len(log.read_text().split()) == 110  # another input, another run
    assert "failed=true" in bad.inputFiles()[0] or "failed" in bad._jdf.queryExecution().executedPlan().toString()
