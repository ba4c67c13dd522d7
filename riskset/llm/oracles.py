"""DuckDB SQL for the queries that SQL can express, written apart from the Spark code."""

ORACLES: dict[str, str] = {}

ORACLES["op2_host_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
g AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM g) WHERE k >= 2),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid),
m AS (SELECT d.rid, d.doc_id, coalesce(d.source, 'null-host') AS host, len(ws) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
             coalesce(cov.n, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines AS failed FROM b),
h AS (SELECT host, count(*) AS host_n, sum(failed::INT) AS host_failed FROM f GROUP BY host),
a AS (SELECT sum(host_n)::DOUBLE AS n, sum(host_failed) / sum(host_n) AS mean, count(*) AS hosts FROM h),
v AS (SELECT any_value(mean) AS mean, (sum(host_n * (host_failed / host_n - mean) ** 2)
             - any_value(mean * (1 - mean) * hosts)) / any_value(n) AS excess FROM h, a),
s AS (SELECT mean, least(1000.0, greatest(1.0, CASE WHEN excess > 0 THEN mean * (1 - mean) / excess - 1
             ELSE 1000.0 END)) AS k FROM v),
hv AS (SELECT host, host_n, host_failed, round((host_failed + mean * k) / (host_n + k), 9) AS host_rate FROM h, s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND host_rate <= 0.5 AS kept, host_n::BIGINT AS host_n, host_failed::BIGINT AS host_failed,
       host_rate
FROM f JOIN hv USING (host)
"""

ORACLES["op5_systematic_mix"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3, 1, 2][((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
      FROM d GROUP BY source),
t AS (SELECT 3 * sum(source_size)::BIGINT AS total FROM s),
fill AS (SELECT 0 AS round, 0::BIGINT AS full_, (SELECT sum(w) FROM s)::BIGINT AS free_
    UNION ALL
    SELECT round + 1, n.full_, n.free_ FROM fill, LATERAL (
        SELECT coalesce(sum(CASE WHEN capped THEN 2 * source_size END), 0)::BIGINT AS full_,
               coalesce(sum(CASE WHEN NOT capped THEN w END), 0)::BIGINT AS free_
        FROM (SELECT source_size, w, 2 * source_size * (2 * fill.free_)
                     < w * ((SELECT total FROM t) - 2 * fill.full_) AS capped FROM s)) n
    WHERE n.full_ > fill.full_ AND n.free_ > 0 AND round < 1000),
lvl AS (SELECT (SELECT total FROM t) - 2 * full_ AS num, 2 * free_ AS den FROM fill ORDER BY round DESC LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN 2 * source_size * den < w * num THEN (2 * source_size)::DOUBLE
             ELSE (w * num)::DOUBLE / den::DOUBLE END AS target FROM s, lvl),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(2097152, round(target * 1048576.0 / source_size)::BIGINT)
             ELSE 0 END AS rate FROM g),
o AS (SELECT d.*, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h, bin(size) AS b FROM d),
k AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source
             ORDER BY length(b) DESC, rpad(left(b, 4), 4, '0') DESC, left(h, 2), h, doc_id, size) - 1 AS k FROM o),
u AS (SELECT k.*, r.source_size, r.target, r.rate,
             ('0x' || left(md5('mix|' || coalesce('=' || k.source, 'null')), 5))::BIGINT AS u
      FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * (((rate * (k + 1) + u) >> 20) - ((rate * k + u) >> 20)))::BIGINT AS taken,
       (((rate * (k + 1) + u) >> 20) - ((rate * k + u) >> 20))::BIGINT AS copies
FROM u
"""

ORACLES["op10_reply_tree_chats"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length('<turn>' || replace(replace(replace(role, '\', '\0'), '<', '\1'), chr(10), '\2') || chr(10)
             || replace(replace(text, '\', '\0'), '<', '\1') || '</turn>' || chr(10)) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op7_phrase_decontamination"] = r"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
    FROM benchmark),
bw AS (SELECT item_id, ws[i:i + 9] AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i
    FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
    FROM documents),
dw AS (SELECT doc_id, i, n, ws[i:i + n - 1] AS win
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

ORACLES["op12_bit_sliced_ranking"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT count(*) FILTER (len(ws) > 0)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
q AS (SELECT iid, item_id, term, count(*)::BIGINT AS qn FROM (SELECT iid, item_id, unnest(ws) AS term FROM i)
      GROUP BY iid, item_id, term),
t AS (SELECT rid, doc_id, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, unnest(ws) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY rid, doc_id, term),
f AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM t, g GROUP BY term),
m AS (SELECT rid, 100 - 75 + ((75 * len(ws)::BIGINT * n_docs) // n_terms) AS m FROM d, g WHERE len(ws) > 0),
s AS (SELECT iid, item_id, rid, doc_id, sum(qn * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM t JOIN q USING (term) JOIN f USING (term) JOIN m USING (rid) GROUP BY iid, item_id, rid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES["op13_gram_automata_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1),
                                       lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, k, phrase, a, j, array_to_string(s[1:j], ' ') AS head, array_to_string(s[j + 1:k], ' ') AS tail
        FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
sc AS (SELECT cut.lang, cut.k, cut.phrase, a, h.f AS l, t.f AS r, j,
              ((1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f))::BIGINT AS score
       FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head AND h.k = j
                JOIN f t ON t.lang = cut.lang AND t.phrase = tail AND t.k = cut.k - j),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, part, max(a) AS longer FROM (
             SELECT lang, a, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS part FROM c WHERE k = 3) GROUP BY lang, part),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND part = phrase AND k = 2
         WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
