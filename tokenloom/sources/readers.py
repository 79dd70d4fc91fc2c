"""Readers: A1 zstd/text lines, A2 lines through a function, A3 format dispatch, A4 JSONL with
line numbers, A5 file discovery, A6 domain from file name.

All readers are ``spark.read`` with an explicit schema where the record shape is
known; nothing is listed or opened on the driver except by Spark's own file index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.sources.partitioned import from_generator, read_zstd_lines

# Record shapes of the router-analysis files.
REQUEST_SCHEMA = "native_id string, request struct<context:string>"
PREDICTION_SCHEMA = ("native_id string, model_output array<struct<continuation:string>>, "
                     "metrics map<string,double>")
ROUTER_SCHEMA = "prompt string, token_index int, router_logits array<array<array<double>>>"


def read_lines(spark: SparkSession, path: str, fn: Callable[[Column], Column] | None = None,
               keep_newline: bool = False) -> DataFrame:
    """A1 + A2: one row per line of text files (``.gz`` decompressed by the codec, ``.zst`` by ``read_zstd_lines``).

    Bytes that aren't UTF-8 are dropped; unlike a hand-rolled chunked reader, a final line without ``\\n`` is kept.
    ``fn`` is a column expression applied to each line (identity by default).
    """
    if path.lower().endswith((".zst", ".zstd")):
        df = read_zstd_lines(spark, path)
    else:
        df = spark.read.text(path).select(valid_text("value").alias("line"))
    if keep_newline:
        df = df.withColumn("line", F.concat("line", F.lit("\n")))
    if fn is not None:
        df = df.withColumn("line", fn(F.col("line")))
    return df


#: A well-formed UTF-8 sequence in upper-case hexadecimal (fixed values of the encoding).
UTF8_HEX = ("[0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]|E0[AB][0-9A-F][89AB][0-9A-F]|(?:E[1-9A-CEF])(?:[89AB][0-9A-F]){2}"
            "|ED[89][0-9A-F][89AB][0-9A-F]|F0[9AB][0-9A-F](?:[89AB][0-9A-F]){2}|F[1-3](?:[89AB][0-9A-F]){3}"
            "|F48[0-9A-F](?:[89AB][0-9A-F]){2}")


def valid_text(text: str) -> Column:
    """The text without the bytes that are part of no well-formed sequence; lines without any are left as they are."""
    mended = F.unhex(F.regexp_replace(F.hex(text), f"({UTF8_HEX})|..", "$1")).cast("string")
    return F.when(F.is_valid_utf8(text), F.col(text)).otherwise(mended)


def _format_of(path: str) -> str | None:
    p = path.lower()
    if p.endswith(".json.gz") or p.endswith(".jsonl.gz"):
        return "json"
    parts = p.rsplit("/", 1)[-1].split(".")
    if len(parts) >= 2 and (parts[-1] in ("jsonl", "json") or (len(parts) >= 3 and parts[-2] in ("jsonl", "json"))):
        return "json"
    if parts[-1] == "csv":
        return "csv"
    if parts[-1] == "tsv":
        return "tsv"
    if parts[-1] == "parquet":
        return "parquet"
    return None


def read_any(spark: SparkSession, path: str | Callable, schema: str | None = None, **kw) -> DataFrame:
    """A3: a callable's rows (``from_generator``; needs a schema), else format by suffix: JSON lines (incl.
    ``.json.gz``/``.jsonl.gz`` and a json/jsonl second-to-last extension), CSV with header, TSV, Parquet; otherwise a
    table name. CSV and TSV columns without a schema get the type their values have."""
    if callable(path):
        if schema is None:
            raise ValueError("a callable source needs a schema")
        return from_generator(spark, path, schema, **kw)
    fmt = _format_of(path)
    if fmt in ("csv", "tsv") and schema is None:
        r = spark.read.option("inferSchema", True)
        return r.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    r = spark.read.schema(schema) if schema else spark.read
    if fmt == "json":
        return r.json(path)
    if fmt == "csv":
        return r.option("header", True).csv(path)
    if fmt == "tsv":
        return r.option("header", True).option("sep", "\t").csv(path)
    if fmt == "parquet":
        return r.parquet(path)
    return spark.table(path)


def load_jsonl(spark: SparkSession, path: str, schema: str, *, line_col: str = "line_no") -> DataFrame:
    """A4: JSON lines with ``file_path`` and a 0-based line number per file.

    No window over a whole file: each input split is read by one task in file
    order, so ``monotonically_increasing_id`` is contiguous within a split. A
    group-by per (file, split) (one row per split) gives each split's row count and
    first id; a running sum over the splits of a file gives its first line; the
    line number is that offset plus the row's distance from the split's first id.
    """
    df = (spark.read.schema(schema).json(path)
          .withColumn("file_path", F.col("_metadata.file_path"))
          .withColumn("_blk", F.col("_metadata.file_block_start"))
          .withColumn("_mid", F.monotonically_increasing_id()))
    splits = df.groupBy("file_path", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_mid0"))
    w = Window.partitionBy("file_path").orderBy("_blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = splits.withColumn("_first", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    out = df.join(splits, ["file_path", "_blk"])
    return out.withColumn(line_col, F.col("_first") + F.col("_mid") - F.col("_mid0")).drop("_blk", "_mid", "_mid0",
                                                                                        "_first")


def load_ordered_jsonl(spark: SparkSession, path: str, schema: str, *, line_col: str = "line_no",
                       folders: str | None = None) -> DataFrame:
    """A4 + A8: rows of ``write_jsonl(order=...)`` with the 0-based line number over all part files (of their directory).

    A file's lines are numbered as by ``load_jsonl``, the manifest gives its first one. The job fails if a part of the
    manifest is missing or has another number of rows, or if a file isn't in it.
    """
    from tokenloom.operators.checks import assert_true

    listed = spark.read.schema("file string, rows long, first_line long").json(f"{path.rstrip('/')}/_manifest")
    rows = load_jsonl(spark, f"{path.rstrip('/')}/{folders}" if folders else path, schema, line_col="_at")
    found = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("_n"))
    both = listed.join(found, F.col("file") == F.col("file_path"), "full_outer")
    whole = F.coalesce(F.col("rows") == F.col("_n"), F.lit(False))
    checked = both.where(assert_true(whole, f"the parts below {path} are not those of its manifest"))
    # the check is a join partner of every row, so it can't be left out
    checked = checked.select(F.col("file").alias("_file"), "first_line")
    out = rows.join(checked, F.col("file_path") == F.col("_file"))
    return out.withColumn(line_col, F.col("first_line") + F.col("_at")).drop("_at", "_file", "first_line")


def find_files(spark: SparkSession, directory: str, substring: str) -> DataFrame:
    """A5: files under ``directory`` (recursively) whose name contains ``substring``: one row per file, empty ones
    included. Only the names are read, no contents."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", f"*{substring}*").load(directory))
    return df.select(F.col("path").alias("file_path"))


def require_one_file(files: DataFrame, what: str = "file") -> DataFrame:
    """A5 pairing rule: a one-row frame with the single matching ``file_path``; the job fails
    when there are zero or several matches."""
    from tokenloom.operators.checks import assert_true

    g = files.agg(F.count(F.lit(1)).alias("_n"), F.min("file_path").alias("file_path"))
    return g.where(assert_true(F.col("_n") == 1, f"expected exactly one {what}")).select("file_path")


def domain_of(path_col: Column | str = "file_path", suffix: str = "-router.jsonl") -> Column:
    """domain = name of the file, or of its folder, without ``suffix`` (one glob scan serves all domains)."""
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    return F.regexp_extract(c, r"([^/]+)" + suffix.replace(".", r"\.") + "(?:/[^/]*)?$", 1)


def read_router_records(spark: SparkSession, directory: str, suffix: str = "-router.jsonl", *, ordered: bool = False) -> DataFrame:
    """A6 + A4: every ``<domain><suffix>`` in one scan, with domain and line number. With ``ordered`` they are folders of part files
    as ``write_router_files`` makes them, and lines are numbered over a folder's parts."""
    if ordered:
        df = load_ordered_jsonl(spark, directory, ROUTER_SCHEMA, folders=f"*{suffix}")
    else:
        df = load_jsonl(spark, f"{directory.rstrip('/')}/*{suffix}", ROUTER_SCHEMA)
    return df.withColumn("domain", domain_of("file_path", suffix))
