"""DuckDB SQL for the operators that SQL can express, by their definitions rather than their methods."""

_SPLIT = r"string_split_regex(trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)), '[ \t\r\x0B\f]+')"

#: The words of a line; the letters of a line that is one word of ten letters or more, of a script without spaces.
_WORDS = rf"(CASE WHEN len({_SPLIT}) = 1 AND length({_SPLIT}[1]) >= 10 AND regexp_matches({_SPLIT}[1], '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}]') THEN string_split({_SPLIT}[1], '') ELSE {_SPLIT} END)"

#: Lines equal to an earlier line go, and from five words on those one word's edit from an earlier line.
OP1 = rf"""
WITH ln AS (SELECT doc_id, i, line, {_WORDS} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS r FROM ln WHERE w[1] <> ''),
f AS (SELECT w, min(r) AS r FROM n GROUP BY w),
p AS (SELECT w, r, unnest(range(1, len(w) + 1)) AS k FROM f WHERE len(w) >= 5),
v AS (SELECT r, k, len(w) AS m, w[1:k-1] || w[k+1:] AS less FROM p),
gap AS (SELECT r FROM v QUALIFY min(r) OVER (PARTITION BY k, m, less) < r),
edit AS (SELECT greatest(v.r, f.r) AS r FROM v JOIN f ON v.less = f.w WHERE len(f.w) >= 5),
stay AS (SELECT r FROM f WHERE r NOT IN (SELECT r FROM gap) AND r NOT IN (SELECT r FROM edit)),
kept AS (SELECT ln.doc_id, ln.i, ln.line, ln.w[1] = '' OR stay.r IS NOT NULL AS k FROM ln LEFT JOIN n ON ln.doc_id = n.doc_id AND ln.i = n.i LEFT JOIN stay ON n.r = stay.r)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k), '') AS text, count(*) AS n_lines, count(*) FILTER (k) AS n_kept FROM kept GROUP BY doc_id
"""

_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]"
_TOKENS = rf"list_filter(regexp_split_to_array(regexp_replace(lower(text), '({_UNSPACED})', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x : x <> '')"

#: For each document and item, the longest stretch of at least 13 aligned tokens with at most two substitutions; items of 8 to 12 tokens as a whole with one, of 5 to 7 with none.
OP2 = rf"""
WITH b AS (SELECT DISTINCT item_id, {_TOKENS} AS w FROM benchmark), d AS (SELECT doc_id, {_TOKENS} AS h FROM documents),
bt AS (SELECT item_id, len(w) AS m, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS q FROM b WHERE len(w) >= 5), dt AS (SELECT doc_id, unnest(h) AS t, generate_subscripts(h, 1) - 1 AS p FROM d),
g AS (SELECT doc_id, item_id, p - q AS shift FROM dt JOIN bt USING (t) GROUP BY ALL HAVING count(*) >= least(8, any_value(CASE WHEN m >= 8 THEN m - 1 ELSE m END))),
a AS (SELECT doc_id, item_id, len(w) AS m, h, w, greatest(shift, 0) AS p, greatest(-shift, 0) AS q, least(len(h) - greatest(shift, 0), len(w) - greatest(-shift, 0)) AS n FROM g JOIN d USING (doc_id) JOIN b USING (item_id)),
o AS (SELECT *, [-1] || list_filter(range(0, n), lambda i : h[p + i + 1] <> w[q + i + 1]) || [n] AS off FROM a),
s AS (SELECT *, least(CASE WHEN m >= 13 THEN 2 WHEN m >= 8 THEN 1 ELSE 0 END, len(off) - 2) AS allowed FROM o),
r AS (SELECT doc_id, item_id, m, allowed, p, q, off, unnest(range(1, len(off) - allowed)) AS k FROM s),
x AS (SELECT doc_id, item_id, m, off[k + allowed + 1] - off[k] - 1 AS overlap, off[k + allowed + 1] - off[k] - 1 - allowed AS matches, p + off[k] + 1 AS doc_start, q + off[k] + 1 AS item_start FROM r)
SELECT doc_id, item_id, overlap, matches, doc_start, item_start FROM x WHERE overlap >= least(13, m)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY overlap DESC, matches DESC, doc_start, item_start) = 1
"""
