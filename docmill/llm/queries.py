"""The subpackage's registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from docmill.llm.lmscore import op10_lm_score
from docmill.llm.linefreq import op4_line_frequency
from docmill.llm.merkle import op12_merkle
from docmill.llm.mixing import op1_mixing
from docmill.llm.packing import op9_packing
from docmill.llm.pagetext import op2_page_text
from docmill.llm.phrases import op11_decontamination
from docmill.llm.ranked import op13_ranked_search
from docmill.llm.secrets import op8_secrets
from docmill.llm.sharding import op6_sharding
from docmill.llm.simhash import op3_simhash
from docmill.llm.toxicity import op5_toxicity
from docmill.llm.vectors import op7_vectors

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_page_text, op3_simhash, op4_line_frequency, op5_toxicity,
        op6_sharding, op7_vectors, op8_secrets, op9_packing, op10_lm_score,
        op11_decontamination, op12_merkle, op13_ranked_search,
    )
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda w: w <> '')"
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE = {
    "op4_line_frequency": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                  coalesce('=' || source, '') AS host FROM documents),
w AS (SELECT r, {_WORDS.format("t")} AS ws FROM d),
tri AS (SELECT r, i, unnest(range(1, len(ws) - 1)) AS p, ws FROM (SELECT r, ws, 0 AS i FROM w WHERE len(ws) >= 3)),
tri2 AS (SELECT r, p, [ws[p], ws[p + 1], ws[p + 2]] AS g FROM tri),
twice AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM tri2),
rep AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM
        (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice WHERE n > 1) GROUP BY r),
l0 AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT r, host, t, line, len({_WORDS.format("line")}) AS held,
             trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[0-9]+', '0', 'g'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'), ' ') AS norm FROM l0),
lw AS (SELECT * FROM l WHERE held > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY r),
lim AS (SELECT host, greatest(20.0, 0.02 * count(DISTINCT t)) AS most FROM d GROUP BY host),
freq AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS docs FROM lw WHERE norm <> '' GROUP BY host, norm)
         JOIN lim USING (host) WHERE docs > most),
gone AS (SELECT r, sum(held) AS n FROM lw JOIN freq USING (host, norm) GROUP BY r),
s AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_words,
             (length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(gone.n, 0)::BIGINT AS n_removed_words
      FROM d JOIN w USING (r) LEFT JOIN dup ON dup.r = d.r LEFT JOIN rep ON rep.r = d.r LEFT JOIN gone ON gone.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 0.3 * n_words OR n_words - n_removed_words < 20)) AS kept
FROM s""",
    "op7_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings
  UNION SELECT reach.vec_id, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)""",
    "op10_lm_score": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, 0 AS own FROM documents
  UNION ALL SELECT -item_id - 1, NULL, coalesce(text, ''), 1 FROM benchmark),
w AS (SELECT r, own, {_WORDS.format("translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM d),
g AS (SELECT r, own, ws[p] AS word, CASE WHEN p = 1 THEN NULL ELSE ws[p - 1] END AS h
      FROM (SELECT r, own, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
sums AS (SELECT count(DISTINCT word)::DOUBLE AS v, sum(own)::DOUBLE AS nt, sum(1 - own)::DOUBLE AS nb FROM g),
one AS (SELECT word, sum(own)::DOUBLE AS t, sum(1 - own)::DOUBLE AS b FROM g GROUP BY word
  UNION ALL SELECT NULL, sum(own)::DOUBLE, sum(1 - own)::DOUBLE FROM g WHERE h IS NULL),
two AS (SELECT h, word, sum(own)::DOUBLE AS t, sum(1 - own)::DOUBLE AS b FROM g GROUP BY h, word),
p AS (SELECT two.h, two.word, ln(f.t + cast(4 AS DOUBLE)) - ln(two.t + cast(4 AS DOUBLE) * (s.t + cast(0.01 AS DOUBLE)) / (nt + cast(0.01 AS DOUBLE) * v)) AS tl,
             ln(f.b + cast(4 AS DOUBLE)) - ln(two.b + cast(4 AS DOUBLE) * (s.b + cast(0.01 AS DOUBLE)) / (nb + cast(0.01 AS DOUBLE) * v)) AS bl
      FROM two JOIN one AS s ON s.word = two.word JOIN one AS f ON f.word IS NOT DISTINCT FROM two.h, sums),
s AS (SELECT r, sum(tl) AS tl, sum(bl) AS bl FROM g JOIN p ON g.h IS NOT DISTINCT FROM p.h AND g.word = p.word WHERE own = 0 GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_tokens, round(tl / len(ws), 6) AS target_loss, round(bl / len(ws), 6) AS background_loss,
       round(tl / len(ws) - bl / len(ws), 6) AS score
FROM d JOIN w USING (r) LEFT JOIN s USING (r) WHERE d.own = 0""",
    "op11_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_TERMS.format("text")} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, ws[s:s + least(10, len(ws)) - 1] AS terms
        FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
dw AS (SELECT r, s, n, ws[s:s + n - 1] AS terms
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT len(terms) AS n FROM win))),
m AS (SELECT r, s, n, item FROM dw JOIN win USING (terms)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN o USING (r)""",
    "op12_merkle": f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF} AS leaf, {_LEAF.replace("n_chars", "(n_chars + 1)")} AS other,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS code FROM documents, crc),
k AS (SELECT r, doc_id, leaf, CASE WHEN code % 7 = 0 THEN other ELSE leaf END AS claim,
        dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx FROM d),
level AS (SELECT tree, 0 AS lvl, list(leaf ORDER BY idx) AS l FROM k GROUP BY tree
  UNION ALL SELECT tree, lvl + 1, list_transform(range(1, len(l) + 1, 2), lambda i: sha256(l[i] || coalesce(l[i + 1], ''))) FROM level WHERE len(l) > 1),
sub AS (SELECT tree, l[1] AS subroot FROM level WHERE len(l) = 1),
top AS (SELECT 0 AS lvl, list(subroot ORDER BY tree) AS l FROM sub
  UNION ALL SELECT lvl + 1, list_transform(range(1, len(l) + 1, 2), lambda i: sha256(l[i] || coalesce(l[i + 1], ''))) FROM top WHERE len(l) > 1),
way AS (SELECT r, tree, idx, 0 AS lvl, claim AS now, '' AS beside FROM k
  UNION ALL SELECT r, way.tree, idx // 2, lvl + 1, sha256(CASE WHEN idx % 2 = 0 THEN now || coalesce(l[idx + 2], '') ELSE l[idx] || now END),
    beside || coalesce(l[xor(idx, 1) + 1], '') FROM way JOIN level USING (tree, lvl) WHERE len(l) > 1),
up AS (SELECT way.r, way.tree AS idx, 0 AS lvl, now, beside FROM way JOIN level USING (tree, lvl) WHERE len(l) = 1
  UNION ALL SELECT r, idx // 2, lvl + 1, sha256(CASE WHEN idx % 2 = 0 THEN now || coalesce(l[idx + 2], '') ELSE l[idx] || now END),
    beside || coalesce(l[xor(idx, 1) + 1], '') FROM up JOIN top USING (lvl) WHERE len(l) > 1)
SELECT doc_id, leaf, subroot, l[1] AS root, sha256(beside) AS proof_sha256, now AS folded_root, now = l[1] AS verified
FROM k JOIN sub USING (tree) JOIN up USING (r) JOIN top USING (lvl) WHERE len(l) = 1""",
    "op13_ranked_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS ws FROM documents),
g AS (SELECT sum(CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS total FROM d),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
m AS (SELECT r, doc_id, 75 + (25 * len(ws) * n_docs) // total AS m FROM d, g WHERE len(ws) > 0),
s AS (SELECT item, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20""",
}
