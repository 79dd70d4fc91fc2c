"""Physical-plan properties the scale design relies on (checked on the unexecuted AQE plan)."""

from tokenloom.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_top_n_per_class_is_a_filter(spark):
    for name in ("balanced_binary", "balanced_nary", "balanced_strict"):
        assert "Window" not in plan(spark, name)


def test_specialisation_aggregates_map_side(spark):
    p = plan(spark, "domain_specialization")
    assert "partial_sum" in p and p.count("FileScan parquet") == 1


def test_corpus_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "prepare_corpus_orig")
    assert "PushedFilters: [IsNotNull(text), Not(EqualTo(text,))]" in p
    assert "ReadSchema: struct<text:string,source:string>" in p


def test_in_row_operators_do_not_shuffle(spark):
    for name in ("token_budget_mask", "badword_mask", "char_to_token", "mask_to_token", "span_segments",
                 "token_ids"):
        p = plan(spark, name)
        # The only exchange allowed is the spread of a few-file input (REPARTITION_BY_NUM).
        assert "ENSURE_REQUIREMENTS" not in p, name


def test_chat_pieces_use_no_window_and_turn_pairs_only_bounded_ones(spark):
    assert "Window" not in plan(spark, "chat_render")
    for name in ("pair_truncate", "qa_prompts"):
        windows = [ln for ln in plan(spark, name).splitlines() if "Window [" in ln]
        # a bucket of turns, or the two rows at the ends of each
        assert windows and all(" b#" in ln or "lead(b#" in ln for ln in windows), (name, windows)


def test_no_logits_pass_a_window(spark):
    lines = plan(spark, "masked_perplexity").splitlines()
    assert any("Window [" in ln for ln in lines) and not any("Window [" in ln and "embedding" in ln for ln in lines)


def test_no_cross_products(spark):
    for name in QUERIES:
        if name in ("dead_letter_good", "dead_letter_errors", "router_jsonl_roundtrip"):
            continue  # these stage a table first; covered by the oracle tests
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_single_partition_exchanges_only_over_bucket_totals(spark):
    """Global order never funnels rows into one task: any SinglePartition exchange sits
    directly on an aggregate (the per-bucket totals)."""
    for name in ("named_splits", "batches", "contiguous_chunks", "jsonl_shards", "packed_sequences"):
        lines = [ln for ln in plan(spark, name).splitlines() if ln.strip()]
        for i, ln in enumerate(lines):
            if "Exchange SinglePartition" in ln:
                assert "HashAggregate" in lines[i + 1], (name, lines[i + 1])
