"""DuckDB statements of the operators that SQL can state."""

from __future__ import annotations

from civiccases.llm.decontaminate import THRESHOLD, WIDTH
from civiccases.llm.hard_negatives import HIGH, LOW, NEGATIVES, POSITIVES
from civiccases.llm.metric_search import SCALE, TOP
from civiccases.llm.spelling import ERODE, MIN_COUNT, MIN_LETTERS, RATIO

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _shingles(table: str, key: str) -> str:
    """Distinct (key, shingle text) of a table; fewer words than the width are one shingle."""
    return f"""
        SELECT DISTINCT {key}, unnest(CASE
            WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH} + 2),
                                                       lambda i: array_to_string(w[i:i + {WIDTH} - 1], ' '))
            WHEN len(w) > 0 THEN ['=' || array_to_string(w, ' ')] ELSE [] END) AS s
        FROM (SELECT {key}, {_WORDS} AS w FROM {table})"""


DECONTAMINATION = f"""
WITH i AS ({_shingles('benchmark', 'item_id')}),
     d AS ({_shingles('documents', 'doc_id')}),
     q AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT d.doc_id, i.item_id, q.n AS item_shingles, count(*) AS shared, count(*) / q.n AS containment
FROM d JOIN i USING (s) JOIN q ON q.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, q.n
HAVING count(*) >= {THRESHOLD} * q.n"""

# crc32 as list operations: the table of 256 entries by the rule of its polynomial, then one step a byte
_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0::BIGINT for _ in range(8)]),
    lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""
_BYTES = """flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
    ELSE [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64] END))"""

SPELLING = f"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS crc),
runs AS (
    SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS s, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                             'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{{MIN_LETTERS},}}')) AS run
          FROM documents) GROUP BY ALL),
hashed AS (
    SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}),
                                   lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1])), 4294967295) AS h
    FROM runs, t),
vocab AS (
    SELECT word, sum(k)::BIGINT AS n
    FROM (SELECT k, CASE WHEN h % {ERODE} = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word FROM hashed)
    WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
cuts AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
shorter AS (SELECT DISTINCT c.word, c.n, v.word AS near, v.n AS near_n FROM cuts c JOIN vocab v ON v.word = c.cut),
pairs AS (
    SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
    UNION ALL SELECT * FROM shorter UNION ALL SELECT near, near_n, word, n FROM shorter),
best AS (
    SELECT word, count(*) OVER (PARTITION BY word) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form,
           CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n
    FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near COLLATE "C") = 1),
steps AS (
    SELECT word, form AS at FROM best WHERE form IS NOT NULL
    UNION ALL SELECT s.word, b.form FROM steps s JOIN best b ON b.word = s.at WHERE b.form IS NOT NULL),
ends AS (SELECT s.word, s.at AS root FROM steps s LEFT JOIN best b ON b.word = s.at WHERE b.form IS NULL)
SELECT v.word, b.form, coalesce(e.root, v.word) AS root, v.n, coalesce(b.n_near, 0) AS n_near, b.form_n
FROM vocab v LEFT JOIN best b USING (word) LEFT JOIN ends e USING (word)"""


def _vectors(scale: int, columns: str = "") -> str:
    return f"""SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS v{columns} FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


TOP_K = f"""
WITH v AS ({_vectors(SCALE)})
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id))::INTEGER AS rank,
       c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) <= {TOP}"""

NEGATIVES_SQL = f"""
WITH v AS ({_vectors(256, ", CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")} AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id AS id, list_inner_product(a.v, x.v)::BIGINT AS score, a.label = x.label AS same
      FROM v a JOIN v x ON a.vec_id % 100 = 0 AND x.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {NEGATIVES}"""

SQL = {"op3_decontamination": DECONTAMINATION, "op11_spelling_variants": SPELLING, "op12_exact_top_k": TOP_K,
       "op13_hard_negatives": NEGATIVES_SQL}
