"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

from sightline.llm import license_scan, pii

_q = lambda s: "'" + s.replace("'", "''") + "'"


def licence_sql() -> str:
    least = license_scan.LEAST
    ratio = (2 - least) / least
    rows = []
    for name, text in sorted(license_scan.TEMPLATES.items()):
        grams = license_scan.bigrams(license_scan.plain(text))
        n = len(grams)
        rows.append(f"({_q(name)}, [{', '.join(map(_q, grams))}], {-(-n * ratio.denominator // ratio.numerator)}, {n * ratio.numerator // ratio.denominator})")
    return rf"""WITH t(name, grams, low, high) AS (VALUES {', '.join(rows)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\n]+', ' ', 'g') AS n FROM documents),
p AS (SELECT rid, unnest(list_distinct(list_transform(list_concat(list_concat(string_split(n, chr(10)), string_split_regex(n, '\n( *\n)+')), [n]), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))))) AS part FROM d),
w AS (SELECT rid, part, string_split(part, ' ') AS words FROM p),
g AS (SELECT rid, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS own FROM w WHERE len(words) > 1),
m AS (SELECT rid, name, len(own) + len(grams) AS size, len(list_intersect(own, grams)) AS hits FROM g JOIN t ON len(own) BETWEEN low AND high),
s AS (SELECT rid, name, 2.0 * hits / size AS dice FROM m WHERE {2 * least.denominator} * hits >= {least.numerator} * size)
SELECT doc_id, first(name ORDER BY dice DESC, name) AS license, round(CAST(max(dice) AS DOUBLE), 6) AS dice, count(name) AS n_matches FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id"""


def private_sql() -> str:
    confirm = {
        "ip": "len(list_filter(string_split(s.v, '.'), lambda p: coalesce(TRY_CAST(p AS INT), 256) > 255)) = 0",
        "card": "length(regexp_replace(s.v, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(regexp_replace(s.v, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(regexp_replace(s.v, '[^0-9]', '', 'g')[-i] AS INT) "
        "WHEN CAST(regexp_replace(s.v, '[^0-9]', '', 'g')[-i] AS INT) > 4 THEN 2 * CAST(regexp_replace(s.v, '[^0-9]', '', 'g')[-i] AS INT) - 9 ELSE 2 * CAST(regexp_replace(s.v, '[^0-9]', '', 'g')[-i] AS INT) END)) % 10 = 0",
        "phone": "length(regexp_replace(s.v, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
        "iban": "length(replace(s.v, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(range(1, length(replace(s.v, ' ', '')) + 1), lambda i: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (substr(replace(s.v, ' ', ''), 5) || left(replace(s.v, ' ', ''), 4))[i]) - 1), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97, 0) = 1",
    }
    found = []
    for kind, (pattern, _, base, words) in pii.KINDS.items():
        p = _q(pattern.replace("++", "+"))
        spans = f"list_transform(range(1, len(regexp_extract_all(text, {p})) + 1), lambda k: {{'v': regexp_extract_all(text, {p})[k], 'a': CAST(list_sum(list_transform(string_split_regex(text, {p})[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(text, {p})[1:k - 1], lambda x: length(x))), 0) AS BIGINT)}})"
        keep = confirm.get(kind, "true")
        if kind not in pii.BASE:
            gained = f"regexp_matches(lower(substr(text, greatest(s.a - {pii.CONTEXT_CHARS}, 0) + 1, s.a - greatest(s.a - {pii.CONTEXT_CHARS}, 0))), {_q(words)}) OR regexp_matches(lower(substr(text, s.a + length(s.v) + 1, {pii.CONTEXT_CHARS})), {_q(words)})"
            keep = f"{keep} AND {base} + CASE WHEN {gained} THEN {pii.CONTEXT_GAIN} ELSE 0 END >= {pii.THRESHOLD}"
        found.append(f"list_transform(list_filter({spans}, lambda s: {keep}), lambda s: '{kind}:' || s.a || ':' || (s.a + length(s.v))) AS _{kind}")
    joined = lambda kinds: "array_to_string(flatten([" + ", ".join(f"_{k}" for k in kinds) + "]), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS (SELECT doc_id, {', '.join(found)} FROM d)
SELECT doc_id, {', '.join(f'len(_{k}) AS n_{k}' for k in pii.BASE)}, sha256({joined(pii.BASE)}) AS base_sha256, {joined(pii.KINDS)} AS spans FROM f"""


def near_sql() -> str:
    """All pairs by shared shingles: fit for the checked scale, not for large tables."""
    return r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach(node, root) AS (SELECT x, x FROM e UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.node),
r AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, w.doc_id) AS component_id, coalesce(root, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = w.doc_id"""


def negatives_sql() -> str:
    """Every anchor against every row: fit for the checked scale, not for large tables."""
    return """WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label,
  coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score FROM r a JOIN r b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, other_id) AS slot FROM s WHERE label = anchor_label QUALIFY slot <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.rid, p.slot ORDER BY s.score DESC, s.other_id) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.rid = p.rid AND s.label <> s.anchor_label AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


SQL = {"op12_hard_negatives": negatives_sql(), "op2_license_scans": licence_sql(), "op5_near_duplicates": near_sql(), "op7_personal_data": private_sql()}
