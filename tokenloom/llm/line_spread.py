"""Removing boilerplate lines that spread over many distinct sites (DataFrame operations only).

Every line but blank ones is hashed; per hash a HyperLogLog sketch of the sites that carry it is built and
merged by aggregation (map-side first, so a line in a third of all documents sends one sketch a task). Lines whose
estimate is clearly above the threshold are boilerplate, clearly below are not, and those within the sketch's error
of the threshold get an exact distinct count. A boilerplate line stays once, in the document with the smallest
id that carries it, and goes everywhere else: no content is lost altogether.

Defined cases: null texts stay null and empty ones empty; a null site is one site of its own; a document
left without lines stays as a row with an empty text; rows equal in id and text are treated alike (the
first document's repeated rows all keep their lines); within the first document every occurrence stays; a line carried by
documents with null ids only is kept in those. An empty table gives an empty one. All other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import staged

BLANK = " \t\r"
LG_K = 12


def line_key(line: str) -> list[Column]:
    """128 bits of a line's hash; blanks at its ends don't count."""
    body = F.trim(F.col(line), F.lit(BLANK))
    return [F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2")]


def _lines(docs: DataFrame, doc_id: str, text: str, site: str, min_chars: int) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"),
                       *_row_key(doc_id, text), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    rows = rows.filter(F.length(F.trim("line", F.lit(BLANK))) >= min_chars)
    return rows.select("doc", "site", "r1", "r2", "pos", *line_key("line"))


def _row_key(doc_id: str, text: str) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(F.lit(7), doc_id, text).alias("r2")]


def spread_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source",
                 min_sites: int = 5, min_chars: int = 1) -> DataFrame:
    """(h1, h2, first_doc) of every line on ``min_sites`` or more distinct sites."""
    lines = _lines(docs, doc_id, text, site, min_chars)
    per = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"),
                                        F.count(F.lit(1)).alias("n"), F.min("doc").alias("first_doc"))
    per = per.filter(F.col("n") >= min_sites).select("h1", "h2", "first_doc",
                                                     F.hll_sketch_estimate("sketch").alias("sites"))
    slack = 1 + min_sites * 4 * 1.04 / (1 << LG_K) ** 0.5  # four standard errors, and one for rounding
    per = staged(per.filter(F.col("sites") >= min_sites - slack), "line-sites")
    sure = per.filter(F.col("sites") > min_sites + slack).select("h1", "h2", "first_doc")
    near = per.filter(F.col("sites") <= min_sites + slack).select("h1", "h2", "first_doc")
    pairs = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
    exact = pairs.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_sites)
    return staged(sure.unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi")), "line-spread")


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source",
                min_sites: int = 5, min_chars: int = 1, counts: bool = False) -> DataFrame:
    """``docs`` with the repeats of widespread lines cut from ``text`` (all columns kept, in order).

    With ``counts`` returns (doc_id, text, n_lines, n_removed) instead. Only line numbers travel: the removed
    places of a row are gathered under a hash of its id and text and joined back to it.
    """
    spread = spread_lines(docs, doc_id=doc_id, text=text, site=site, min_sites=min_sites, min_chars=min_chars)
    lines = _lines(docs, doc_id, text, site, min_chars).join(spread, ["h1", "h2"])
    gone = lines.filter(~F.col("doc").eqNullSafe(F.col("first_doc"))).groupBy("r1", "r2").agg(
        F.array_sort(F.collect_set("pos")).alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row_key(doc_id, text))
    rows = rows.join(gone, ["r1", "r2"], "left")
    body = F.split(F.col("row")[text], "\n")
    # the stretches between removed places, joined again: linear in the number of lines
    ends = F.concat(F.col("gone"), F.array(F.size(body)))
    starts = F.concat(F.array(F.lit(-1)), F.col("gone"))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")),
                                 lambda x: F.slice(body, x["s"] + 2, x["e"] - x["s"] - 1)))
    clean = F.when(F.col("gone").isNull(), F.col("row")[text]).otherwise(F.array_join(kept, "\n"))
    if counts:
        return rows.select(F.col("row")[doc_id].alias(doc_id), clean.alias(text),
                           F.coalesce(F.size(body), F.lit(0)).cast("long").alias("n_lines"),
                           F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return rows.select(*[(clean if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
