"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op3_decontaminate
from .htmltext import op8_html
from .jaccard import op7_jaccard
from .langid import op1_langid
from .packing import op6_packing
from .pii import op5_pii
from .quality import op2_quality
from .secrets import op9_secrets
from .sharding import op4_sharding
from .toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_langid, op2_quality, op3_decontaminate, op4_sharding, op5_pii, op6_packing, op7_jaccard, op8_html, op9_secrets, op10_toxicity)
}

ORACLES = {
    "op2_quality": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, t, host, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, host, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY doc_id),
often AS (SELECT host, norm FROM ln GROUP BY host, norm HAVING count(DISTINCT doc_id) > 3),
rem AS (SELECT doc_id, sum(len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS removed FROM ln JOIN often USING (host, norm) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN rem USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5 * n_words AS kept, removed_words
FROM b
""",
}
