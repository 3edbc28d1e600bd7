"""DuckDB SQL of the corpus queries that SQL can express; ids are taken to be unique, as in the given tables."""

from __future__ import annotations

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Components of links (a, b), told in both directions, over the ids of a table.
_REACH = "reach(id, other) AS (SELECT {id}, {id} FROM {table} UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a), least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
{_REACH.format(id="doc_id", table="documents")}
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN least ON least.id = s.doc_id
"""

OP3 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i:i + 49], ' '))) AS text FROM w WHERE len(w) >= 50),
firsts AS (SELECT text, min(doc_id) AS first FROM windows GROUP BY text),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM windows JOIN firsts USING (text) WHERE doc_id > first),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP9 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
good AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
{_REACH.format(id="vec_id", table="embeddings")}
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM embeddings v JOIN least ON least.id = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = v.vec_id
"""

#: CRC-32 of the decimal digits of an integer column, by bytes: the 256 remainders, then a fold of the digits.
_CRC_TABLE = "crc_table AS (SELECT list(list_reduce(range(8), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, n) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n))"
_CRC = "xor(list_reduce(list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda r, c: xor(r // 256, t[xor(r % 256, c) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _leaf(n_chars: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


#: Levels of a forest `{base}` (tree, place, total, digest), and of each node the siblings of its level.
_LEVELS = """{name}(tree, level, place, total, digest) AS (SELECT tree, 0, place, total, digest FROM {base}
UNION ALL SELECT tree, level + 1, place // 2, any_value((total + 1) // 2), sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE total > 1 GROUP BY tree, level, place // 2)"""

OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (SELECT doc_id, lang, {_leaf("n_chars")} AS digest, CASE WHEN {_CRC.format(id="doc_id")} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("(n_chars + 1)")} END AS tampered FROM documents, crc_table),
nodes AS (SELECT coalesce('=' || lang, '') AS tree, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY lang) AS total, digest, coalesce(tampered, digest) AS given FROM leaves),
{_LEVELS.format(name="inner_levels", base="nodes")},
subroots AS (SELECT '' AS tree, tree AS own, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS total, digest FROM inner_levels WHERE total = 1),
{_LEVELS.format(name="outer_levels", base="subroots")},
climb AS (SELECT n.doc_id, n.place AS leaf_place, n.tree, l.level, (n.place >> l.level) % 2 = 1 AS from_left, s.digest AS other FROM nodes n JOIN inner_levels l ON l.tree = n.tree AND l.place = n.place >> l.level AND l.total > 1
  LEFT JOIN inner_levels s ON s.tree = l.tree AND s.level = l.level AND s.place = xor(l.place, CAST(1 AS BIGINT))
UNION ALL SELECT n.doc_id, n.place, n.tree, 100 + l.level, (r.place >> l.level) % 2 = 1, s.digest FROM nodes n JOIN subroots r ON r.own = n.tree JOIN outer_levels l ON l.place = r.place >> l.level AND l.total > 1
  LEFT JOIN outer_levels s ON s.level = l.level AND s.place = xor(l.place, CAST(1 AS BIGINT))),
paths AS (SELECT tree, leaf_place, list(coalesce(other, '') ORDER BY level) AS others, list(from_left ORDER BY level) AS lefts FROM climb GROUP BY tree, leaf_place),
fold(tree, place, done, others, lefts, now) AS (SELECT n.tree, n.place, 0, coalesce(others, []), coalesce(lefts, []), given FROM nodes n LEFT JOIN paths p ON p.tree = n.tree AND p.leaf_place = n.place
UNION ALL SELECT tree, place, done + 1, others, lefts, CASE WHEN lefts[done + 1] THEN sha256(others[done + 1] || now) ELSE sha256(now || others[done + 1]) END FROM fold WHERE done < len(others))
SELECT n.doc_id, n.digest AS leaf, s.digest AS subroot, o.digest AS root, sha256(array_to_string(f.others, '')) AS proof_sha256, f.now AS folded_root, f.now = o.digest AS verified
FROM nodes n JOIN subroots s ON s.own = n.tree JOIN outer_levels o ON o.total = 1 JOIN fold f ON f.tree = n.tree AND f.place = n.place AND f.done = len(f.others)
"""

OP13 = f"""
WITH {_CRC_TABLE},
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC.format(id="conv_id")} % 4 AS h, n FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id), crc_table),
parts AS (SELECT c.conv_id, 0 AS part, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.i <= c.h UNION ALL SELECT c.conv_id, 1, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h),
whole AS (SELECT c.conv_id, coalesce(p.seq, []) AS seq FROM convs c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, i) AS seq FROM parts GROUP BY conv_id) p USING (conv_id)),
members AS (SELECT conv_id, seq, d, seq[:d] AS prefix FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM whole)),
nodes AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(seq) = d), '') AS ends,
  CASE WHEN d = 0 THEN 0 ELSE len({_WORDS.format(text="prefix[d].text")}) END AS words FROM members GROUP BY d, prefix),
children AS (SELECT d - 1 AS d, prefix[:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
told AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.prefix = n.prefix),
above AS (SELECT a AS d, prefix[:a] AS prefix, sum((n - 1) * words) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM told) GROUP BY ALL)
SELECT t.conv_id, CAST(t.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, t.n AS n_convs, CAST(t.n_children AS BIGINT) AS n_children, CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM told t JOIN above a ON a.d = t.d AND a.prefix = t.prefix LEFT JOIN nodes p ON p.d = t.d - 1 AND p.prefix = t.prefix[:t.d - 1]
"""
