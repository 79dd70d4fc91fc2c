"""Column-level string, hash and token helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII whitespace as Java's ``\s`` and RE2's ``\s`` would both
# need it (Java's class includes vertical tab, RE2's does not), written out so
# Spark and an SQL oracle split text identically.
WS_CLASS = "[ \\t\\n\\x0B\\f\\r]"
WS_RUN = WS_CLASS + "+"

# The characters Python's ``str.strip()`` removes.
PY_SPACE = ("[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
            "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, although a lambda in it refers to it for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def md5_hex(c) -> Column:
    """H1: md5 hex digest of the UTF-8 text."""
    return F.md5(col_(c).cast("string"))


def fingerprint(*cols, sep: str = "\u001f") -> Column:
    """H2: md5 of a row's values, each written as its length and text (NULL: ``-``), so no two rows collide by
    a separator inside a value or a value moved to the next column."""
    def part(c) -> Column:
        v = col_(c).cast("string")
        return F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    return F.md5(F.concat_ws(sep, *[part(c) for c in cols]))


def py_strip(c) -> Column:
    """H3: Python ``str.strip()`` (all Unicode whitespace), not Spark ``trim``."""
    return F.regexp_replace(col_(c), f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def py_lower_strip(c) -> Column:
    return F.lower(py_strip(c))


def ws_tokens(c) -> Column:
    """I6 built-in tokenizer: maximal runs of non-whitespace, in order."""
    return F.filter(F.split(col_(c), WS_RUN), lambda t: t != F.lit(""))


def token_id(tok: Column) -> Column:
    """I6 built-in vocabulary: first 28 bits of md5(token) as an INT id."""
    return F.conv(F.substring(F.md5(tok), 1, 7), 16, 10).cast("int")


def token_ids(c) -> Column:
    return F.transform(ws_tokens(c), token_id)


def unit_score(c) -> Column:
    """Deterministic score in [0, 1): first 28 bits of md5 divided by 2^28."""
    return F.conv(F.substring(F.md5(col_(c).cast("string")), 1, 7), 16, 10).cast("double") / float(1 << 28)


def order_key(seed, *keys) -> Column:
    """Seeded shuffle key md5('seed:key...'), equal in Spark and SQL engines."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col_(k).cast("string") for k in keys]))


def path_parent(c) -> Column:
    """Parent directory of a path."""
    return F.regexp_extract(col_(c), r"^(.*)/[^/]*$", 1)


def path_stem(c) -> Column:
    """Base name up to its first dot."""
    return F.regexp_extract(col_(c), r"([^/.]*)[^/]*$", 1)


def path_clean(c) -> Column:
    """Path with ``/ . :`` replaced by ``-``."""
    return F.translate(col_(c), "/.:", "---")


def completion_suffix(full, prompt) -> Column:
    """H9: decoded text after the prompt's characters."""
    return F.substr(col_(full), F.length(col_(prompt)) + 1)
