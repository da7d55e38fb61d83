"""DuckDB SQL for the operators that SQL can express over whole tables."""

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

LINE_DEDUP = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
w AS (SELECT doc_id, i AS line, x[i + 1] AS a, x[i + 2] AS b, x[i + 3] AS c FROM l, unnest(range(0, len(x) - 2)) t(i) WHERE trim(x[i + 1]) <> '' OR trim(x[i + 2]) <> '' OR trim(x[i + 3]) <> ''),
later AS (SELECT doc_id, line FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, line) AS nth FROM w) WHERE nth > 1),
gone AS (SELECT doc_id, list(DISTINCT line + k) AS lines FROM later, unnest([0, 1, 2]) u(k) GROUP BY doc_id)
SELECT l.doc_id, len(x) AS n_lines, coalesce(len(lines), 0) AS n_removed,
CASE WHEN lines IS NULL THEN array_to_string(x, chr(10)) ELSE array_to_string(list_transform(list_filter(range(0, len(x)), lambda i: NOT list_contains(lines, i)), lambda i: x[i + 1]), chr(10)) END AS text
FROM l LEFT JOIN gone USING (doc_id)"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOW.format('text'))} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format(_LOW.format('text'))} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS said FROM b, unnest(range(0, len(w) - least(len(w), 10) + 1)) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS said FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(0, len(w) - n + 1)) t(i) WHERE len(w) >= n),
h AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, said)),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(0, n)) t(k) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)"""

#: Every two documents that share a shingle are counted, exactly and without signatures.
NEAR_DEDUP = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_TOKENS.format(_LOW.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(w[i + 1], w[i + 2]) AS g FROM t, unnest(range(0, len(w) - 1)) u(i) WHERE len(w) >= 2 UNION ALL SELECT doc_id, hash(w[1]) FROM t WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 80 * (a.n + b.n - both_)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM r JOIN both_ways b ON b.x = r.y),
c AS (SELECT x, min(y) AS y FROM r GROUP BY 1)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(y, t.doc_id)) AS component_id, t.doc_id = least(t.doc_id, coalesce(y, t.doc_id)) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = t.doc_id"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(x, 8 * i + 1, 8))::BIGINT) AS h FROM d),
c AS (SELECT doc_id, t, w, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256 FROM p"""

#: Every phrase of up to five words is counted where it stands.
COLLOCATIONS = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW.format('text')}, '[.,;:!?\n-\r]')) AS said FROM documents),
w AS (SELECT lang, regexp_extract_all(said, '[^ \t]+') AS x FROM d),
f AS (SELECT lang, x[i + 1:i + k] AS p, count(*) AS f FROM w, unnest([1, 2, 3, 4, 5]) s(k), unnest(range(0, len(x) - k + 1)) t(i) WHERE len(x) >= k GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(x))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, p, f AS a FROM f WHERE len(p) >= 2),
k AS (SELECT c.lang, c.p, c.a, n.n, k, l.f AS l, r.f AS r, (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
FROM c, unnest(range(1, len(p))) u(k), f l, f r, n WHERE l.lang = c.lang AND r.lang = c.lang AND n.lang = c.lang AND l.p = c.p[1:k] AND r.p = c.p[k + 1:len(c.p)]),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
i AS (SELECT lang, p[s + 1:s + m] AS p, max(a) AS longer FROM c, unnest([2, 3, 4]) q(m), unnest(range(0, len(p) - m + 1)) v(s) WHERE len(p) > m GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM b LEFT JOIN i ON i.lang = b.lang AND i.p = b.p WHERE longer IS NULL OR longer < a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000"""

ORACLE: dict[str, str] = {"op8_line_dedup": LINE_DEDUP, "op9_decontamination": DECONTAMINATION, "op10_minhash_near_dedup": NEAR_DEDUP, "op11_fill_in_middle": FILL_IN_MIDDLE, "op12_collocations": COLLOCATIONS}
