"""Oracle SQL of the training-data queries that SQL can express on whole tables.

The other queries are tested in tests/llm against brute force.
"""

ORACLE: dict[str, str] = {
    # characters stand for tokens: TESTDATA.md says that the cases are the same
    "p7_found": """
WITH s AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY source)
SELECT t.source FROM source_target t LEFT JOIN s ON s.source = t.source
WHERE t.max_repeat * coalesce(s.size, 0) < t.target_share * (SELECT sum(size) FROM s)
""",
    # brute force over all pairs, as the definition says; fast enough for the sizes at which oracles are run
    "p3_found": """
WITH v AS (
  SELECT id, min(vector) AS v FROM index_row
  WHERE id IS NOT NULL AND len(vector) = 64 AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0)) GROUP BY id
), n AS (SELECT id, list_transform(v::DOUBLE[], lambda x: x / sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[]))) AS u FROM v),
c AS (SELECT a.id AS id, b.id AS other, list_inner_product(a.u, b.u) AS cos FROM n a JOIN n b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, other) AS rank FROM c WHERE cos >= 0.9)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM k WHERE rank <= 10
""",
    "p5_found": r"""
WITH r AS (
  SELECT id, array_to_string(list_sort(regexp_extract_all(lower(concat_ws(' ', question, array_to_string(map_values(options), ' '))), '[\pL\pN_]+')), ' ') AS bag
  FROM mcq_question WHERE id IS NOT NULL AND question IS NOT NULL
), q AS (SELECT id, bag FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(bag)) AS n FROM r) WHERE n = 1),
w AS (SELECT id, word, row_number() OVER (PARTITION BY id, word) AS k FROM (SELECT id, unnest(string_split(bag, ' ')) AS word FROM q WHERE bag <> '')),
s AS (SELECT id, count(*) AS n FROM w GROUP BY id),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM w a JOIN w b ON a.word = b.word AND a.k = b.k AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM c JOIN s x ON x.id = id_a JOIN s y ON y.id = id_b WHERE c.n >= 0.75 * (x.n + y.n - c.n)
UNION SELECT a.id, b.id FROM q a JOIN q b ON a.bag = b.bag AND a.id < b.id
""",
}
