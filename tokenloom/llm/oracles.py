"""DuckDB SQL of operators whose statement is built from their parameters."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string expression."""
    step = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295::BIGINT)"


def merkle_sql(leaf_levels: int = 5, group_levels: int = 3, fan: int = 16) -> str:
    """The Merkle manifest of ``documents`` with levels written out: up to ``fan ** leaf_levels`` leaves a source."""
    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = [f"d AS (SELECT doc_id, source AS g, {leaf('text')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 "
           f"THEN {leaf(f'translate(text, {upper!r}, {lower!r})')} END AS other FROM documents)",
           "a0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d)"]

    def level(name: str, k: int, group: str) -> None:
        run = f"PARTITION BY {group}, p // {fan} ORDER BY p ROWS BETWEEN"
        out.append(f"{name}s{k} AS (SELECT {group}, p, h, p // {fan} AS q, count(*) OVER (PARTITION BY {group}) AS n, "
                   f"coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, "
                   f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT {group}, q AS p, CASE WHEN max(n) = 1 THEN min(h) "
                   f"ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM {name}s{k} GROUP BY {group}, q)")

    for k in range(leaf_levels):
        level("a", k, "g")
    out.append(f"b0 AS (SELECT 0 AS one, g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p FROM a{leaf_levels})")
    for k in range(group_levels):
        level("b", k, "one")
    joins, steps = [], []
    for k in range(leaf_levels):
        joins.append(f"JOIN as{k} ON as{k}.g IS NOT DISTINCT FROM a0.g AND as{k}.p = a0.p // {fan ** k}")
        steps.append(f"as{k}")
    joins.append("JOIN b0 ON b0.g IS NOT DISTINCT FROM a0.g")
    for k in range(group_levels):
        joins.append(f"JOIN bs{k} ON bs{k}.p = b0.p // {fan ** k}")
        steps.append(f"bs{k}")
    joins.append(f"CROSS JOIN b{group_levels} AS r")
    fold = "coalesce(other, leaf)"
    cols = ", ".join(f"{s}.n AS n{i}, {s}.before AS before{i}, {s}.after AS after{i}" for i, s in enumerate(steps))
    out.append(f"j AS (SELECT doc_id, a0.p AS position, leaf, b0.h AS subroot, r.h AS root, {fold} AS x0, {cols} FROM a0 "
               + " ".join(joins) + ")")
    body = "j"
    for i in range(len(steps)):
        body = (f"(SELECT *, CASE WHEN n{i} = 1 THEN x{i} ELSE sha256(before{i} || x{i} || after{i}) END AS x{i + 1} "
                f"FROM {body})")
    proof = " || ".join(f"before{i} || after{i}" for i in range(len(steps)))
    return (f"WITH {', '.join(out)} SELECT doc_id, position, leaf, subroot, root, sha256({proof}) AS proof_sha256, "
            f"x{len(steps)} AS folded_root, x{len(steps)} = root AS verified FROM {body}")


def license_sql(templates, base) -> str:
    """License scans of ``documents``: base phrases by place, templates as regular expressions over the joined words."""
    from tokenloom.llm.license_scan import parse, pattern

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    places = []
    for phrase, label in base:
        at = " AND ".join(f"w[i{f' + {k}' if k else ''}] = '{x}'" for k, x in enumerate(phrase.split()))
        places.append(f"list_filter(range(1, len(w) + 1), lambda i: {at}) AS p_{label}")
    all_places = "list_concat(" + ", ".join(f"p_{label}" for _, label in base[:2]) + ")"
    for _, label in base[2:]:
        all_places = f"list_concat({all_places}, p_{label})"
    has = [f"CASE WHEN len(p_{label}) > 0 THEN '{label}' END" for _, label in base]
    method = [f"CASE WHEN regexp_matches(joined, ' {pattern(parse(t))}') THEN '{label}' END" for label, t in templates]

    def listed(xs: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list_filter({xs}, lambda x: x IS NOT NULL))), ',')"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
j AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined, {', '.join(places)} FROM d),
m AS (SELECT *, {all_places} AS places, [{', '.join(has)}] AS b, [{', '.join(method)}] AS t FROM j)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word,
       (list_max(places) - 1)::BIGINT AS last_word, {listed('b')} AS base_labels, {listed('list_concat(b, t)')} AS labels,
       CASE WHEN len(list_filter(t, lambda x: x IS NOT NULL)) > 0 THEN 1 WHEN len(places) > 0 THEN 0.5 ELSE 0 END::DOUBLE AS score
FROM m
"""
