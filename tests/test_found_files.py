"""Files found by name: their number and their records, a directory in several files."""

from collections import Counter

import pytest

from tokenloom.plans import QUERIES, files
from tokenloom.sources.readers import find_files, load_ordered_jsonl
from tokenloom.sources.writers import write_jsonl


def test_found_files_counts_files_and_records(spark, tmp_path, monkeypatch):
    rows = [(i % 97, None if i % 50 == 7 else 0 if i % 3 else i % 4) for i in range(700)]  # repeated ids, a common and a null label
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(files, "PER_FILE", 60)
    got = {r.domain: (r.n_files, r.n_records) for r in QUERIES["found_files"](spark, str(tmp_path)).collect()}
    want = Counter(label for _, label in rows)
    assert got == {k: (-(-n // 60), n) for k, n in want.items()} and got[0][0] > 1 and got[None][1] == want[None]


def test_rows_per_file_keeps_the_order_over_the_files(spark, tmp_path):
    df = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(500)], "d int, k long").repartition(7)
    write_jsonl(df, path := str(tmp_path / "out"), order=["k"], partition_by="d", files=3, rows_per_file=40)
    got = load_ordered_jsonl(spark, path, "k long, d int").orderBy("d", "line_no").collect()
    want = sorted((r.d, r.k) for r in df.collect())
    assert [(r.d, r.k) for r in got] == want
    first = {}
    for r in got:
        first.setdefault(r.d, []).append(r.line_no)
    assert all(v == list(range(len(v))) for v in first.values())
    n = Counter(p.file_path.split("/d=")[1][0] for p in find_files(spark, path, "part-").collect() if "/_manifest/" not in p.file_path)
    assert n == {str(d): -(-len(v) // 40) for d, v in first.items()}
    with pytest.raises(ValueError, match="needs an order"):
        write_jsonl(df, path, rows_per_file=40)
