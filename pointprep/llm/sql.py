"""SQL for the oracle: what it can express of this subpackage over whole tables."""

from __future__ import annotations

from . import licenses, pii

SQL: dict[str, str] = {}

SQL["op3_embedding_dedup"] = """WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, n.component_id, e.vec_id = n.component_id AS kept
FROM embeddings e JOIN named n ON n.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id"""

# Trees are built for the texts and their edited texts alike; likeness is the plain Dice coefficient of distinct pieces.
SQL["op10_merkle"] = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id, text) AS rn, count(*) OVER () AS n FROM documents),
p AS (SELECT a.doc_id, a.rn, b.rn AS next_rn, a.text, left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS new FROM d a JOIN d b ON b.rn = a.rn % a.n + 1),
t AS (SELECT rn, 0 AS kind, text FROM p UNION ALL SELECT rn, 1, new FROM p),
leaves AS (SELECT rn, kind, list_transform(string_split(text, chr(10)), lambda q: {'s': lower(to_hex(length(q))), 'l': list_transform(regexp_extract_all(q, '(?s).{1,32}'), lambda x: md5(x))}) AS q FROM t),
paragraphs AS (SELECT rn, kind, list_transform(q, lambda z: {'s': z.s, 'l': z.l, 'd': sha256(z.s || ',' || coalesce(array_to_string(z.l, ''), ''))}) AS q FROM leaves),
listed AS (SELECT rn, kind, array_to_string(list_transform(q, lambda z: z.d || ',' || z.s || ',' || coalesce(array_to_string(list_transform(z.l, lambda x: left(x, 8)), ''), '') || CASE WHEN z.d < '2' THEN ';' ELSE ':' END), '') AS j FROM paragraphs),
cut AS (SELECT rn, kind, list_filter(string_split(replace(j, ';', ';' || chr(1)), chr(1)), lambda s: s <> '') AS s FROM listed),
sections AS (SELECT rn, kind, list_transform(s, lambda x: {'d': sha256(array_to_string(regexp_extract_all(x, '([0-9a-f]{64}),', 1), '')), 's': regexp_replace(x, '([0-9a-f]{8})[0-9a-f]{56},', '\1,', 'g')}) AS s FROM cut),
prints AS (SELECT rn, kind, sha256(array_to_string(list_transform(s, lambda x: x.d), '')) AS root, array_to_string(list_transform(s, lambda x: left(x.d, 8) || '=' || x.s), '') AS body FROM sections),
trees AS (SELECT rn, kind, root, root || '|' || body AS fp,
  list_distinct(regexp_extract_all(array_to_string(list_transform(regexp_extract_all(body, '[0-9a-f]+,[0-9a-f]+,[0-9a-f]*'), lambda x: split_part(x, ',', 3)), ''), '[0-9a-f]{8}')) AS pieces FROM prints),
near AS (SELECT a.rn, b.rn AS other, b.kind, CASE WHEN a.root = b.root THEN 1.0::DOUBLE WHEN len(a.pieces) + len(b.pieces) = 0 THEN 0.0::DOUBLE ELSE least(
  1.0::DOUBLE - (len(a.pieces) + len(b.pieces) - 2 * len(list_intersect(a.pieces, b.pieces)))::DOUBLE / (len(a.pieces) + len(b.pieces))::DOUBLE, 1.0::DOUBLE - 1.0::DOUBLE / (len(a.pieces) + len(b.pieces) + 1)::DOUBLE) END AS v
  FROM p JOIN trees a ON a.rn = p.rn AND a.kind = 0 JOIN trees b ON (b.rn = p.rn AND b.kind = 1) OR (b.rn = p.next_rn AND b.kind = 0))
SELECT p.doc_id, length(p.text)::BIGINT AS n_chars, sha256(p.new) AS edited_sha256, a.fp AS fingerprint, e.fp AS edited_fingerprint, x.v AS near_edited, y.v AS near_next
FROM p JOIN trees a ON a.rn = p.rn AND a.kind = 0 JOIN trees e ON e.rn = p.rn AND e.kind = 1 JOIN near x ON x.rn = p.rn AND x.kind = 1 JOIN near y ON y.rn = p.rn AND y.kind = 0"""


# Each kind's plain pattern, the check of a match m between the texts before and after it, and the words near it.
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: NOT regexp_full_match(x, '0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])'))) = 0"),
    "card": (
        "[0-9](?:[ -]?[0-9])+",
        "CASE WHEN length(d) BETWEEN 14 AND 19 THEN list_sum(list_transform(string_split(reverse(d), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE (c::INT * 2) % 10 + c::INT // 5 END)) % 10 = 0 ELSE false END",
    ),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
    "iban": (
        "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
        """(i = 1 OR before <> '') AND (i = n OR after <> '') AND NOT regexp_matches(right(before, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9]')
        AND CASE WHEN length(replace(m, ' ', '')) BETWEEN 15 AND 34 THEN list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substr(replace(m, ' ', ''), 5) || left(m, 4), ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), ''), ''), lambda c: c::INT), lambda a, c: (a * 10 + c) % 97) = 1 ELSE false END""",
    ),
    "secret": ("[A-Za-z0-9+/_-]{20,}", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"),
}


def found(kind: str) -> str:
    pattern, check = PLAIN[kind]
    prior = pii.PRIOR[kind]
    near = rf"(?i)(?:^|[^\p{{L}}])(?:{pii.CONTEXT[kind]})(?:$|[^\p{{L}}])"
    return f"""SELECT rn, {pii.KINDS.index(kind)} AS rank, '{kind}' AS kind, s AS start, s + length(m) AS stop, score FROM (
  SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d, CASE WHEN regexp_matches(right(ahead, {pii.NEAR}), '{near}') OR regexp_matches(left(behind, {pii.NEAR}), '{near}') THEN {prior + 0.75 * (1 - prior)!r}::DOUBLE ELSE {prior!r}::DOUBLE END AS score FROM (
  SELECT rn, i, n, g[i] AS before, g[i + 1] AS after, l[i] AS m, CASE WHEN i > 1 THEN g[i - 1] || l[i - 1] ELSE '' END || g[i] AS ahead, g[i + 1] || CASE WHEN i < n THEN l[i + 1] || g[i + 2] ELSE '' END AS behind,
    (sum(length(g[i])) OVER w + sum(length(l[i])) OVER w - length(l[i]))::BIGINT AS s
  FROM (SELECT rn, g, l, len(l) AS n, unnest(generate_series(1, len(l))) AS i FROM (SELECT rn, regexp_split_to_array(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS l FROM t))
  WINDOW w AS (PARTITION BY rn ORDER BY i))) WHERE ({check}){'' if kind in pii.BASE else f' AND score >= {pii.LEAST}'}"""


def counted(kind: str) -> str:
    return f"count(*) FILTER (kind = '{kind}') AS n_{kind}"


LISTED = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){}, '')"
SQL["op2_pii"] = f"""WITH t AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents), f AS ({' UNION ALL '.join(map(found, pii.KINDS))})
SELECT any_value(t.doc_id) AS doc_id, {', '.join(map(counted, pii.KINDS))}, sha256({LISTED.format(f' FILTER (rank < {len(pii.BASE)})')}) AS base_sha256, {LISTED.format('')} AS spans,
coalesce(string_agg(printf('%.3f', score), ',' ORDER BY start, rank), '') AS scores FROM t LEFT JOIN f USING (rn) GROUP BY rn"""


def licence_sql(threshold: float = licenses.THRESHOLD) -> str:
    """Dice coefficients of all passages with an anchor word, without an index."""
    rows = licenses.template_rows(threshold)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    grams = ", ".join(f"({i}, {quoted(name)}, {n}, {quoted(g)})" for i, name, n, gs in rows for g in gs)
    longest = licenses.longest()
    words = "|".join(licenses.anchor_words(threshold))
    anchor = rf"(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{words})(?:$|[^\p{{L}}\p{{N}}])"
    least, most = min(n for *_, n, _ in rows) * threshold / (2 - threshold), max(n for *_, n, _ in rows) * (2 - threshold) / threshold
    return rf"""WITH templates(template, license, size, gram) AS (VALUES {grams}),
t AS (SELECT row_number() OVER () AS rn, doc_id, text FROM documents), hit AS (SELECT rn, text FROM t WHERE regexp_matches(text, '{anchor}')),
blocks AS (SELECT rn, regexp_replace(b, '[ \t\r]*\n', ' ', 'g') AS p FROM (SELECT rn, unnest(regexp_split_to_array(regexp_replace(text, '(?m)^[^\p{{L}}\p{{N}}\n]+', '', 'g'), '\n{{2,}}')) AS b FROM hit) WHERE contains(b, chr(10))),
parts AS (SELECT rn, unnest(string_split(text, chr(10))) AS p FROM hit UNION SELECT rn, p FROM blocks),
sentences AS (SELECT rn, string_split(regexp_replace(p, '([.!?:])[ \t]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM parts WHERE regexp_matches(p, '{anchor}')),
runs AS (SELECT rn, array_to_string(s[i : i + w - 1], ' ') AS p FROM (SELECT rn, s, i, unnest(generate_series(1, {longest})) AS w FROM (SELECT rn, s, unnest(generate_series(1, len(s))) AS i FROM sentences)) WHERE i + w - 1 <= len(s)),
passages AS (SELECT rn, text AS p FROM hit UNION SELECT rn, unnest(regexp_split_to_array(text, '\n\s*\n')) FROM hit UNION SELECT rn, p FROM parts UNION SELECT rn, p FROM runs),
words AS (SELECT rn, p, regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}\p{{M}}]+') AS w FROM passages WHERE regexp_matches(p, '{anchor}')),
grams AS (SELECT rn, p, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
each AS (SELECT rn, p, len(g) AS n, unnest(g) AS gram FROM grams WHERE len(g) BETWEEN {least!r} AND {most!r}),
dice AS (SELECT rn, license, template, p, 2.0::DOUBLE * count(*) / (any_value(n) + any_value(size)) AS dice FROM each JOIN templates USING (gram) GROUP BY rn, license, template, p),
best AS (SELECT rn, license, max(dice) AS dice FROM dice WHERE dice >= {threshold!r}::DOUBLE GROUP BY rn, license)
SELECT any_value(t.doc_id) AS doc_id, count(license) AS n_licenses, arg_min(license, struct_pack(d := -dice, l := license)) AS license, round(max(dice), 6) AS dice, coalesce(string_agg(license, ',' ORDER BY license), '') AS licenses
FROM t LEFT JOIN best USING (rn) GROUP BY rn"""


SQL["op7_licenses"] = licence_sql()
