"""URL filters by association rules.

The tokens of a labelled URL (host labels, path segments, query keys, fragment) and its label are a basket; Spark's FP-growth
mines frequent token combinations, and those that imply the bad label with enough support and confidence become
rules. Every token of a rule must pay: a combination stays only if it is surer, by ``min_gain``, than each one got by leaving
a token out, and those have stayed as well (a single token must beat the share of bad URLs). Rules are matched through an inverted
index: each is filed under its rarest token, URLs look up their tokens there and the whole combination is then tested.
Given rules of hosts and paths come first: the longest that fits decides, the mined ones judge the rest.

Distinct URLs are matched once, so a URL that a third of the pages share costs one row. All tokens of a URL are mined. Tokens
too rare among bad URLs can't be in a rule and leave the baskets first, of tokens that always come together one stands for all
(any of them matches), and FP-growth lists all combinations of what remains. Where a basket holds more than ``DENSE`` tokens, those that
don't pay leave before it: of optional query keys, which nearly every URL has, none is left, however many there are. Baskets that are
still larger are projected first, as FP-growth itself does, onto the tokens that stayed (the baskets of each, with the tokens after
it), then onto pairs and so on, until FP-growth can list what follows each: the same rules, but of a large basket no combination
is looked at that can't stay. Defined cases: a null URL or one without ``://`` has empty host and path, fits no given
rule and has no tokens, so it is allowed; labels with a null or for absent pages don't count; repeated labels are bad if any is; without
labels no rule is mined; of rules that are equally sure the last by its tokens is named; very long URLs are mined and matched
whole; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import lookup_join, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"
DENSE = 10  # tokens of a basket up to which all their combinations may be listed
GIVEN = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: h:<host label>, p:<path segment>, q:<query key>, f:<fragment>; digits are written #."""
    def parts(s: Column, sep: str, mark: str) -> Column:
        kept = F.filter(F.split(s, sep), lambda x: x != "")
        return F.transform(kept, lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "#")))

    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)", 1), F.lit(""))
    keys = F.transform(F.split(F.regexp_extract(rest, r"(?s)^\?([^#]*)", 1), "&"), lambda x: F.split(x, "=")[0])
    asked = F.transform(F.filter(keys, lambda x: x != ""), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.concat(parts(host_of(url), r"\.", "h:"), parts(path_of(url), "/", "p:"), asked,
                                     parts(F.regexp_extract(rest, r"(?s)#(.*)", 1), "#", "f:")))


def given_rule(host: Column, path: Column, rules=GIVEN) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, longer ones overrule
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def token_classes(baskets: DataFrame, least: int) -> DataFrame:
    """(token, rep), staged: tokens of ``least`` or more bad baskets (id, tokens, bad); those of the very same baskets have the
    first of them as ``rep``. Sets of baskets are told apart by size and two 64-bit hashes."""
    each = baskets.select("id", "bad", F.explode("tokens").alias("token"))
    per = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"),
                                    F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("x2"))
    per = staged(per.filter(F.col("n_bad") >= least), "token-counts")
    reps = per.groupBy("n", "x1", "x2").agg(F.min("token").alias("rep"))
    return staged(per.join(reps, ["n", "x1", "x2"]).select("token", "rep"), "token-classes")


def _kept(level: DataFrame, below: DataFrame, gain: float) -> DataFrame:
    """Those of the combinations (items, n, n_bad) that beat all of one token less, which must be in ``below``; staged."""
    conf = F.col("n_bad") / F.col("n")
    less = level.select("items", "n", "n_bad", F.explode("items").alias("t")).select(
        "items", "n", "n_bad", F.array_remove("items", F.col("t")).alias("sub"))
    less = less.join(below.select(F.col("items").alias("sub"), F.col("confidence").alias("c")), "sub")
    each = less.groupBy("items", "n", "n_bad").agg(F.count(F.lit(1)).alias("k"), F.max("c").alias("c"))
    return staged(each.filter((F.col("k") == F.size("items")) & (conf >= F.col("c") + gain)).select(
        "items", "n", "n_bad", conf.alias("confidence")), "combinations")


def _grown(bases: DataFrame, heads: DataFrame, least: int) -> DataFrame:
    """Combinations (items, n, n_bad) of a head and tokens that follow it, by FP-growth over the heads' baskets (head, bad, items);
    a token is another one with every head. Staged."""
    def tagged(t: Column) -> Column:
        return F.concat(F.col("head").cast("string"), F.lit(" "), t)

    label = F.when(F.col("bad"), F.array(tagged(F.lit(BAD)))).otherwise(F.array().cast("array<string>"))
    baskets = staged(bases.select(F.concat(F.transform("items", tagged), label).alias("items")), "items")
    # half a basket less, as FP-growth rounds the product with the number of baskets up
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / baskets.count()).fit(baskets)
    plain = F.transform("items", lambda t: F.regexp_replace(t, "^[0-9]+ ", ""))
    sets = staged(model.freqItemsets.select(F.substring_index(F.col("items")[0], " ", 1).cast("long").alias("head"),
                                            F.array_sort(plain).alias("items"), F.col("freq").alias("n")), "itemsets")
    bad = sets.filter(F.array_contains("items", BAD)).select("head", F.array_remove("items", BAD).alias("items"),
                                                             F.col("n").alias("n_bad"))
    every = sets.join(bad.filter(F.size("items") > 0), ["head", "items"]).join(heads, "head")
    return staged(every.select(F.concat("prefix", "items").alias("items"), "n", "n_bad"), "combinations")


def _extended(bases: DataFrame, heads: DataFrame, below: DataFrame, least: int, gain: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The combinations of a head and one token that stayed, the heads they make, and the baskets (row, head, bad, next) of the old
    heads with the tokens t that still extend them and the numbers of the new heads."""
    each = staged(bases.withColumn("row", F.monotonically_increasing_id()), "heads-baskets").select(
        "row", "head", "bad", F.explode("items").alias("t"))
    level = _grown(each.select("head", "bad", F.array("t").alias("items")), heads, least)
    kept = _kept(level, below, gain)
    key = F.concat(F.col("head").cast("string"), F.lit(" "), F.col("t"))
    longer = kept.select("items", F.slice("items", F.lit(1), F.size("items") - 1).alias("prefix"), F.element_at("items", -1).alias("t"))
    longer = staged(longer.join(heads, "prefix").select(key.alias("key"), F.monotonically_increasing_id().alias("to"), "items"), "heads")
    more = lookup_join(each.withColumn("key", key), longer.select("key", "to"), "key")
    more = more.groupBy("row", "head", "bad").agg(F.array_sort(F.collect_list(F.struct("t", "to"))).alias("next"))
    return kept, longer.select(F.col("to").alias("head"), F.col("items").alias("prefix")), staged(more, "extended")


def _combinations(bases: DataFrame, root: DataFrame, least: int, gain: float, dense: int) -> list[DataFrame]:
    """Those of each size, from 0 (``root``) on, that stayed, over the baskets (bad, items) of sorted tokens."""
    stayed, size, dense = [root], 0, max(dense, 1)
    heads = root.select(F.lit(0).cast("long").alias("head"), F.col("items").alias("prefix"))
    bases = bases.withColumn("head", F.lit(0).cast("long"))
    while most := bases.agg(F.max(F.size("items"))).first()[0]:
        if most > dense:
            kept, longer, bases = _extended(bases, heads, stayed[-1], least, gain)
            stayed.append(kept)
            most = bases.agg(F.max(F.size("next"))).first()[0]
            if not most:
                break
            if most > dense:  # every token that stayed becomes a head, followed by those after it
                rest = bases.select("bad", "next", F.posexplode("next").alias("at", "x"))
                tokens = F.transform(F.slice("next", F.col("at") + 2, F.size("next")), lambda x: x["t"])
                bases = staged(rest.select("bad", F.col("x.to").alias("head"), tokens.alias("items")).filter(F.size("items") > 0), "bases")
                heads, size = longer, size + 1
                continue
            bases = bases.select("head", "bad", F.transform("next", lambda x: x["t"]).alias("items"))
        grown = _grown(bases, heads, least)
        for k in range(len(stayed), size + most + 1):
            stayed.append(_kept(grown.filter(F.size("items") == k), stayed[-1], gain))
            if stayed[-1].isEmpty():
                break
        break
    return stayed


def mine_rules(pages: DataFrame, bad: DataFrame, *, page_id: str = "page_id", url: str = "url", min_support: float = 0.001,
               min_rows: int = 5, min_confidence: float = 0.5, min_gain: float = 0.01,
               dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """Rules (antecedent, confidence, support) and the tokens (token, rep) that stand for their parts, both staged.
    ``bad``: (page_id, bad), one row an id."""
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("u")).join(bad.withColumnRenamed(page_id, "id"), "id")
    tokens = F.coalesce(tokens_of(F.col("u")), F.array().cast("array<string>"))
    rows = rows.select(tokens.alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad"))
    baskets = staged(rows.select(F.monotonically_increasing_id().alias("id"), "tokens", "bad"), "baskets")
    n, n_bad = baskets.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    least = max(1, math.ceil(max(min_support * n, min_rows)))
    classes = token_classes(baskets, least)
    spark = pages.sparkSession
    root = spark.range(1 if n else 0).select(F.array().cast("array<string>").alias("items"), F.lit(n).cast("long").alias("n"),
                                             F.lit(n_bad).cast("long").alias("n_bad"), F.lit(n_bad / max(n, 1)).alias("confidence"))
    each = lookup_join(baskets.select("id", "bad", F.explode("tokens").alias("token")), classes, "token")
    each = each.filter("token = rep")  # one of a class says what all say
    bases = staged(each.groupBy("id", "bad").agg(F.array_sort(F.collect_list("rep")).alias("items")).select("bad", "items"), "bases")
    stayed = _combinations(bases, root, least, min_gain, dense)
    rules = functools.reduce(DataFrame.unionByName, stayed).filter((F.col("confidence") >= min_confidence) & (F.size("items") > 0))
    rules = staged(rules.select(F.col("items").alias("antecedent"), "confidence", (F.col("n_bad") / F.lit(float(max(n, 1)))).alias("support")),
                   "rules")
    used = rules.select(F.explode("antecedent").alias("rep")).distinct()
    return rules, staged(classes.join(used, "rep", "left_semi").select("token", "rep"), "rule-tokens")


def matched(urls: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """(u, confidence, antecedent): of each distinct URL ``u`` that a rule matches, the surest rule; staged."""
    tokens = urls.select("u", F.explode(tokens_of(F.col("u"))).alias("token"))
    each = staged(lookup_join(tokens, members, "token").groupBy("u").agg(F.collect_set("rep").alias("all")), "url-tokens")
    each = each.select("u", "all", F.explode("all").alias("rep"))
    wanted = rules.select("antecedent", F.explode("antecedent").alias("rep"))
    freq = each.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    filed = wanted.join(freq, "rep").groupBy("antecedent").agg(F.min(F.struct("n", "rep")).alias("r"))
    index = staged(filed.join(rules, "antecedent").select(F.col("r.rep").alias("rep"), "antecedent", "confidence"), "rule-index")
    hits = each.join(index, "rep").filter(F.size(F.array_except("antecedent", "all")) == 0)
    return staged(hits.groupBy("u").agg(F.max(F.struct("confidence", "antecedent")).alias("m")).select(
        "u", "m.confidence", "m.antecedent"), "url-hits")


def judge(pages: DataFrame, bad: DataFrame, *, page_id: str = "page_id", url: str = "url", given=GIVEN, **fit) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) of every page."""
    rules, members = mine_rules(pages, bad, page_id=page_id, url=url, **fit)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("u"))
    hits = matched(rows.select("u").filter("u IS NOT NULL").distinct(), rules, members)
    rows = lookup_join(rows, hits, "u", "left")
    host, path = host_of(F.col("u")), path_of(F.col("u"))
    rule, verdict = given_rule(host, path, given)
    own = F.when(F.col("antecedent").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"),
                       F.coalesce(verdict, own).alias("verdict"), F.array_join("antecedent", " ").alias("mined"), "confidence")
