"""DuckDB SQL for the operators that SQL can express: op2, op3, op4, op6, op12 and op13.

The others have none: op1 learns weights by iteration, op5 uses a tokenizer, op7 and op9 learn models, op8 needs XXH64, and
op10's rounds over parts of every match are tested against a plain version instead.
"""

from __future__ import annotations

from boxoffice.llm.license_texts import STANDARD
from boxoffice.llm.licenses import COPYRIGHT_LINES, KNOWN, SPELLINGS
from boxoffice.llm.mixing import CAP, WEIGHTS
from boxoffice.llm.text import ALNUM, LOWER, UPPER, WHITE

_EMBEDDINGS = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
    SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
    SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, coalesce(v.vec_id = c.component_id, false) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY 1) n ON n.a = v.r
JOIN (SELECT reach.a, min(w.vec_id) AS component_id FROM reach JOIN v w ON w.r = reach.b GROUP BY 1) c ON c.a = v.r"""

_WEIGHT = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))
_MIX = f"""
WITH rows AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source,
           CAST(coalesce(len(regexp_extract_all(text, '{WHITE}')), 0) AS BIGINT) AS size,
           (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '') || CASE WHEN again > 1 THEN '|' || again ELSE '' END), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text) AS again FROM documents)),
sums AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source) - 1) % {len(WEIGHTS)} {_WEIGHT} END::DOUBLE AS weight FROM rows GROUP BY source),
levels AS (
    SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - {CAP} * coalesce(CAST(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
              / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
           row_number() OVER w AS n
    FROM sums WINDOW w AS (ORDER BY source_size / weight, source)),
common AS (SELECT min_by(level, n) AS level FROM levels WHERE level * weight <= {CAP} * source_size),
plan AS (
    SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS whole
    FROM (SELECT source, source_size, least(common.level * weight, CAST({CAP} * source_size AS DOUBLE)) AS target FROM levels, common)),
ranked AS (
    SELECT *, CASE WHEN rest > 0 THEN odds / (1 + odds) END AS rank FROM (
        SELECT *, (u / (1 - u)) / ((rest / source_size) / (1 - rest / source_size)) AS odds FROM (
            SELECT rows.*, source_size, target, whole, target - whole * source_size AS rest FROM rows JOIN plan USING (source)))),
units AS (SELECT source, rank, doc_id, rest, sum(size) AS words FROM ranked WHERE rest > 0 GROUP BY ALL),
runs AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run FROM units),
taken AS (SELECT source, rank, doc_id FROM runs WHERE run - rest <= rest - (run - words))
SELECT r.doc_id, r.size, r.source_size, r.target, r.size * (r.whole + CASE WHEN t.source IS NULL THEN 0 ELSE 1 END) AS taken
FROM ranked r LEFT JOIN taken t ON t.source = r.source AND t.rank = r.rank AND t.doc_id IS NOT DISTINCT FROM r.doc_id"""


def _canonical(text: str) -> str:
    words = rf"trim(regexp_replace(lower(regexp_replace(coalesce({text}, ''), '{COPYRIGHT_LINES}', ' ', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for spelling, variant in SPELLINGS:
        words = rf"regexp_replace({words}, '\b{variant}\b', '{spelling}', 'g')"
    return words


def _digest(text: str) -> str:
    return f"nullif(sha256({_canonical(text)}), sha256(''))"


_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
_STANDARD = ", ".join(f"('{digest}', '{name}')" for name, digests in STANDARD.items() for digest in digests)
_LICENSES = f"""
WITH texts AS (SELECT * FROM (VALUES {_KNOWN}) k(license_id, text)),
known AS (
    SELECT digest, min(license_id) AS license_id FROM (
        SELECT {_digest("text")} AS digest, license_id FROM texts UNION ALL SELECT * FROM (VALUES {_STANDARD}) s(digest, license_id)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
notices AS (
    SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
    FROM (SELECT r, {_digest("line")} AS digest FROM lines) JOIN known USING (digest) GROUP BY r)
SELECT t.doc_id, t.digest, known.license_id, coalesce(notices.notices, '') AS notices
FROM (SELECT r, doc_id, {_digest("text")} AS digest FROM d) t LEFT JOIN known USING (digest) LEFT JOIN notices USING (r)"""


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{ALNUM}')"


_CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[pos:pos + 9], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT r, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS win
    FROM (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT p.r, p.pos, p.size, x.item FROM places p JOIN windows x ON x.size = p.size AND x.win = p.win),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS place FROM found) GROUP BY 1),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM found GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hits.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.list, '')) AS items_sha256, hits.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""

_MIDDLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
    FROM documents),
h AS (
    SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || x[9:16] AS BIGINT) % (len(u) + 1) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                WHEN CAST('0x' || x[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM d),
parts AS (
    SELECT doc_id, n, form, t, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
           array_to_string(u[greatest(a, b) + 1:], '') AS s
    FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""

_TRIE = """
WITH turns AS (
    SELECT CAST(conv_id AS BIGINT) AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
           CAST(length(coalesce(text, '')) AS BIGINT) AS chars
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT c, list({'k': k, 'chars': chars} ORDER BY turn NULLS FIRST, CAST('0x' || k[1:15] AS BIGINT), CAST('0x' || k[16:30] AS BIGINT)) AS l
    FROM turns GROUP BY c),
hashed AS (  -- crc32 of the digits: one byte after the other, eight shifts each
    SELECT c, l, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda a, x: list_reduce([xor(a, x)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda b, i: xor(b >> 1, 3988292384::BIGINT * (b & 1)))), 4294967295::BIGINT) % 6 AS h
    FROM own),
rebuilt AS (
    SELECT a.c, coalesce(b.l[1:a.h], []) || a.l[a.h + 1:] AS l FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 100),
states AS (
    SELECT c, d, len(l) AS size, array_to_string(list_transform(l[1:d], lambda x: x.k), '') AS path, CASE WHEN d > 0 THEN l[d].chars ELSE 0 END AS chars
    FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, string_agg(CASE WHEN d = size THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends
    FROM states GROUP BY d, path),
children AS (SELECT substr(path, 1, 32 * (d - 1)) AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (path)),
sums AS (
    SELECT substr(path, 1, 32 * a) AS path, count_if(n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(sums.n_leaves AS BIGINT) AS n_leaves, sums.saved_tokens,
       sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN sums USING (path) LEFT JOIN nodes p ON n.d > 0 AND p.path = substr(n.path, 1, 32 * (n.d - 1))"""

ORACLE: dict[str, str] = {
    "op2_embedding_groups": _EMBEDDINGS,
    "op3_source_mix": _MIX,
    "op4_licenses": _LICENSES,
    "op6_contamination": _CONTAMINATION,
    "op12_middles": _MIDDLE,
    "op13_prefix_trie": _TRIE,
}
