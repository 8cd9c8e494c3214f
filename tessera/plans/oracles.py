"""The catalogue in DuckDB SQL, where SQL can express it."""

from __future__ import annotations

from ..operators.similarity import PRIME, hash_family
from .queries import HASHES

SQL: dict[str, str] = {}

_LINES = r"lines AS (SELECT unnest(regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n')) AS l FROM documents WHERE text IS NOT NULL)"
_WORDS = _LINES + r""", cut AS (SELECT l, regexp_replace(l, '[^\w]+$', '') AS r FROM lines),
words AS (SELECT unnest(regexp_split_to_array(r, '[^\w]+')) AS word FROM cut WHERE l = '' OR r <> '')"""
SQL["line_count"] = f"WITH {_LINES} SELECT count(*) AS n_lines FROM lines"
SQL["word_count"] = f"WITH {_WORDS} SELECT word, count(*) AS count FROM words GROUP BY word"
SQL["letter_count"] = f"WITH {_WORDS} SELECT upper(substr(word, 1, 1)) AS letter, count(*) AS count FROM words WHERE regexp_matches(word, '^[A-Za-z]') GROUP BY 1"

SQL["value_subtract"] = """
SELECT l_suppkey, l_linenumber, l_returnflag FROM lineitem a WHERE NOT EXISTS (
  SELECT 1 FROM lineitem b WHERE b.l_quantity > 49 AND a.l_suppkey IS NOT DISTINCT FROM b.l_suppkey
    AND a.l_linenumber IS NOT DISTINCT FROM b.l_linenumber AND a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag)"""
SQL["bag_union_distinct"] = "SELECT count(*) AS n_rows, count(DISTINCT nation) AS n_nations FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier)"
SQL["join_aggregate"] = """
SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
SQL["top_orders"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"
SQL["anti_and_semi"] = """
SELECT count(*) AS n, 'with' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT count(*), 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)"""

_RATINGS = """ratings AS (
  SELECT CAST(o_custkey AS INTEGER) AS "user", CAST(l_suppkey AS INTEGER) AS item, max(CAST(CAST(floor(l_quantity) AS BIGINT) % 5 + 1 AS DOUBLE)) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
train AS (SELECT * FROM ratings WHERE ("user" * 31 + item * 17) % 10 < 8),
test AS (SELECT * FROM ratings WHERE ("user" * 31 + item * 17) % 10 >= 8)"""
SQL["ratings_split_train"] = f"WITH {_RATINGS} SELECT * FROM train"
SQL["ratings_split_test"] = f"WITH {_RATINGS} SELECT * FROM test"
_CF = _RATINGS + """,
norms AS (SELECT item, sqrt(sum(rating * rating)) AS norm FROM train GROUP BY item),
dots AS (SELECT a.item AS i, b.item AS j, sum(a.rating * b.rating) AS dot FROM train a JOIN train b ON a."user" = b."user" AND a.item < b.item GROUP BY 1, 2),
sim AS (SELECT i, j, dot / (x.norm * y.norm) AS cosine FROM dots JOIN norms x ON i = x.item JOIN norms y ON j = y.item),
either AS (SELECT i, j, cosine FROM sim UNION ALL SELECT j, i, cosine FROM sim)"""
SQL["cf_similarity"] = f"WITH {_CF} SELECT i, j, round(cosine, 6) AS cosine FROM sim WHERE cosine <> 0"
_NEAR = _CF + """,
near AS (
  SELECT t."user", t.item, r.rating, b.cosine, row_number() OVER (PARTITION BY t."user", t.item ORDER BY b.cosine DESC, b.j DESC) AS rn
  FROM test t JOIN train r ON t."user" = r."user" JOIN either b ON b.i = t.item AND b.j = r.item)"""
SQL["cf_predict"] = f"""WITH {_NEAR} SELECT "user", item, round(sum(cosine * rating) / sum(cosine), 5) AS prediction FROM near WHERE rn <= 10 GROUP BY 1, 2"""
SQL["cf_rmse_sweep"] = f"""WITH {_NEAR},
ks AS (SELECT CAST(unnest(range(5, 51, 5)) AS INTEGER) AS k),
p AS (SELECT k, "user", item, sum(cosine * n.rating) / sum(cosine) AS prediction FROM near n JOIN ks ON rn <= k GROUP BY 1, 2, 3)
SELECT k, round(sqrt(avg(power(rating - prediction, 2))), 5) AS rmse FROM p JOIN test USING ("user", item) GROUP BY k"""

_SETS = """basket AS (SELECT DISTINCT l_orderkey AS b, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
size AS (SELECT count(DISTINCT b) AS n FROM basket),
l1 AS (SELECT item, count(*) AS n FROM basket GROUP BY item HAVING count(*) / (SELECT n FROM size) >= 0.002),
kept AS (SELECT * FROM basket WHERE item IN (SELECT item FROM l1)),
l2 AS (SELECT a.item AS x, b.item AS y, count(*) AS n FROM kept a JOIN kept b ON a.b = b.b AND a.item < b.item GROUP BY 1, 2 HAVING count(*) / (SELECT n FROM size) >= 0.002),
sides AS (SELECT x, y, x AS s FROM l2 UNION ALL SELECT x, y, y FROM l2),
c3 AS (SELECT DISTINCT list_sort(list_distinct([p.x, p.y, q.x, q.y])) AS items FROM sides p JOIN sides q ON p.s = q.s AND (p.x, p.y) < (q.x, q.y)),
t3 AS (SELECT [a.item, b.item, c.item] AS items, count(*) AS n FROM kept a JOIN kept b ON a.b = b.b AND a.item < b.item JOIN kept c ON a.b = c.b AND b.item < c.item GROUP BY 1),
l3 AS (SELECT t3.* FROM t3 JOIN c3 USING (items) WHERE len(items) = 3 AND n / (SELECT n FROM size) >= 0.002)"""
SQL["apriori_counts"] = f"""WITH {_SETS}
SELECT 'C1' AS name, count(DISTINCT item) AS size FROM basket UNION ALL SELECT 'L1', count(*) FROM l1
UNION ALL SELECT 'C2', count(*) FROM l1 a JOIN l1 b ON a.item < b.item UNION ALL SELECT 'L2', count(*) FROM l2
UNION ALL SELECT 'C3', count(*) FROM c3 WHERE len(items) = 3 UNION ALL SELECT 'L3', count(*) FROM l3"""
SQL["frequent_pairs"] = f"WITH {_SETS} SELECT x || ',' || y AS items, n FROM l2"
SQL["frequent_triples"] = f"WITH {_SETS} SELECT array_to_string(items, ',') AS items, n FROM l3"
_RULES = _SETS + """,
big AS (SELECT [x, y] AS items, n FROM l2 UNION ALL SELECT items, n FROM l3),
heads AS (SELECT list_filter(items, lambda i: i <> h.head) AS body, h.head, n / (SELECT n FROM size) AS s FROM big, unnest(items) AS h(head)),
alone AS (SELECT [item] AS body, n / (SELECT n FROM size) AS s FROM l1 UNION ALL SELECT [x, y], n / (SELECT n FROM size) FROM l2),
rules AS (SELECT array_to_string(heads.body, ',') AS body, head, heads.s / alone.s AS confidence FROM heads JOIN alone ON heads.body = alone.body WHERE heads.s / alone.s >= 0.15)"""
SQL["assoc_rules"] = f"WITH {_RULES} SELECT body, head, round(confidence, 6) AS confidence FROM rules"
SQL["fp_rules"] = SQL["assoc_rules"]
SQL["fpgrowth_itemsets"] = f"WITH {_SETS} SELECT x || ',' || y AS items, n AS freq FROM l2 UNION ALL SELECT array_to_string(items, ','), n FROM l3"

SQL["lsh_pairs"] = """
WITH s AS (SELECT DISTINCT doc_id, substr(text, CAST(i AS BIGINT), 3) AS g FROM documents, unnest(range(1, length(text) + 1)) AS u(i)),
k AS (SELECT g FROM s GROUP BY g HAVING count(*) >= 2),
f AS (SELECT s.* FROM s JOIN k USING (g)),
n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(common / (x.n + y.n - common), 6) AS jaccard FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE common / (x.n + y.n - common) >= 0.8"""

_FRIENDS = """bought AS (SELECT DISTINCT user_id AS u, time_bucket(INTERVAL '10 minutes', ts) AS w FROM events WHERE event_type = 'purchase'),
e AS (SELECT DISTINCT a.u AS u, b.u AS f FROM bought a JOIN bought b ON a.w = b.w AND a.u <> b.u),
m AS (SELECT x.f AS a, y.f AS b, count(*) AS n FROM e x JOIN e y ON x.u = y.u AND x.f <> y.f WHERE (x.f, y.f) NOT IN (SELECT (u, f) FROM e) GROUP BY 1, 2),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn FROM m),
recs AS (SELECT a AS "user", string_agg(CAST(b AS VARCHAR), ',' ORDER BY rn) AS recommended FROM r WHERE rn <= 10 GROUP BY a
  UNION ALL SELECT DISTINCT user_id, '' FROM events WHERE user_id NOT IN (SELECT u FROM e))"""
SQL["friend_recs"] = f'WITH {_FRIENDS} SELECT "user", recommended FROM recs'
SQL["friend_lines"] = f"""WITH {_FRIENDS} SELECT CAST("user" AS VARCHAR) || chr(9) || recommended AS value FROM recs"""

_EDGES = """e AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL),
v AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
w AS (SELECT src, dst, 0.8::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e),
r0 AS (SELECT node, 1.0::DOUBLE AS rank FROM v)"""


def _rounds(n: int) -> str:
    parts = [_EDGES]
    for i in range(1, n + 1):
        parts.append(f"m{i} AS (SELECT v.node, coalesce(sum(w.w * r.rank), 0.0) AS x FROM v LEFT JOIN w ON w.dst = v.node LEFT JOIN r{i - 1} r ON r.node = w.src GROUP BY v.node)")
        parts.append(f"r{i} AS (SELECT node, x + 1 - (SELECT sum(x) / count(*) FROM m{i}) AS rank FROM m{i})")
    return ",\n".join(parts)


SQL["pagerank_ranks"] = f"WITH {_rounds(5)} SELECT node, round(rank, 6) AS rank FROM r5"

SQL["stream_tumbling"] = "SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type AS word, count(*) AS count FROM events GROUP BY 1, 2"
SQL["stream_sliding"] = """
SELECT time_bucket(INTERVAL '10 minutes', ts) - to_minutes(CAST(i * 10 AS BIGINT)) AS window_start, event_type AS word, count(*) AS count
FROM events, unnest(range(6)) AS u(i) GROUP BY 1, 2"""
SQL["stream_top_words"] = """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY window_start ORDER BY count DESC, word) AS INTEGER) AS rn FROM (
  SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, event_type AS word, count(*) AS count FROM events GROUP BY 1, 2)) WHERE rn <= 2"""
SQL["edw_replay"] = """
WITH RECURSIVE h AS (SELECT event_type AS word, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY 1, 2),
b AS (SELECT min(h) AS a, max(h) AS z FROM h),
s AS (
  SELECT word, (SELECT a FROM b) - 1 AS h, 0.0::DOUBLE AS v FROM (SELECT DISTINCT word FROM h)
  UNION ALL
  SELECT s.word, s.h + 1, CASE WHEN coalesce(h.n, 0) + 0.9 * s.v < 1 THEN 0 ELSE coalesce(h.n, 0) + 0.9 * s.v END
  FROM s LEFT JOIN h ON h.word = s.word AND h.h = s.h + 1 WHERE s.h < (SELECT z FROM b))
SELECT word, round(v, 6) AS value FROM s WHERE h = (SELECT z FROM b) AND v > 0"""
SQL["stream_edw"] = SQL["edw_replay"]

_M = "m AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / 1000 AS l_price, l_discount, l_tax FROM lineitem)"
_C = ("l_quantity", "l_price", "l_discount", "l_tax")
SQL["zscore"] = f"WITH {_M}, s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _C) + " FROM m) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 5) AS {c}" for c in _C) + " FROM m, s"
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
SQL["covariance"] = f"WITH {_M} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_samp({_C[i]}, {_C[j]}), 6) AS value FROM m" for i, j in _PAIRS)
SQL["cost_given_centroids"] = """
WITH x AS (SELECT vec_id, label, i AS d, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)),
c AS (SELECT label, d, avg(x) AS c FROM x GROUP BY 1, 2),
q AS (SELECT vec_id, c.label, sum((x - c) * (x - c)) AS s FROM x JOIN c USING (d) GROUP BY 1, 2)
SELECT round(sum(s), 5) AS cost FROM (SELECT vec_id, min(s) AS s FROM q GROUP BY vec_id)"""

SQL["gram_matrix"] = "WITH m AS (SELECT " + ", ".join(f"CAST({e} AS DECIMAL(18,5)) AS {c}" for e, c in zip(("l_quantity", "l_extendedprice / 1000", "l_discount", "l_tax"), _C, strict=True)) + " FROM lineitem) " + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, CAST(round(CAST(sum({_C[i]} * {_C[j]}) AS DECIMAL(38,10)), 3) AS DOUBLE) AS value FROM m" for i, j in _PAIRS
)
SQL["standardized_vectors"] = """
WITH x AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS d, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)),
s AS (SELECT d, avg(x) AS m, stddev_samp(x) AS s FROM x GROUP BY d)
SELECT vec_id, d, round(CASE WHEN s = 0 THEN 0 ELSE (x - m) / s END, 5) AS scaled FROM x JOIN s USING (d)"""

# eigenvectors of the correlations: squaring the matrix again and again leaves the leading one
_CORR = "[" + ", ".join("[" + ", ".join("1.0::DOUBLE" if i == j else f"corr({_C[i]}, {_C[j]})" for j in range(4)) + "]" for i in range(4)) + "]"


def _leading(name: str, matrix: str) -> str:
    return f"""
{name}_s AS (SELECT 0 AS t, m FROM {matrix} UNION ALL SELECT t + 1, list_transform(p, lambda r: list_transform(r, lambda x: x / (p[1][1] + p[2][2] + p[3][3] + p[4][4])))
  FROM (SELECT t, list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q))) AS p FROM {name}_s WHERE t < 40)),
{name}_c AS (SELECT m[list_position(list_transform(m, lambda r: list_dot_product(r, r)), list_max(list_transform(m, lambda r: list_dot_product(r, r))))] AS v FROM {name}_s WHERE t = 40),
{name}_u AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM {name}_c),
{name}_g AS (SELECT list_transform(v, lambda x: x * CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END) AS v FROM {name}_u),
{name} AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM {name}_g, {matrix})"""


_EIGEN = f"WITH RECURSIVE {_M}, n AS (SELECT count(*) AS n FROM m), c0 AS (SELECT {_CORR} AS m FROM m), {_leading('e0', 'c0')}, c1 AS (SELECT list_transform(range(1, 5), lambda i: list_transform(range(1, 5), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM c0, e0), {_leading('e1', 'c1')}, e AS (SELECT 0 AS component, v, l FROM e0 UNION ALL SELECT 1, v, l FROM e1), names AS (SELECT unnest({list(_C)}) AS column, unnest(range(1, 5)) AS i)"
SQL["svd_v"] = f'{_EIGEN} SELECT CAST(component AS INTEGER) AS component, "column", round(v[i], 5) AS value, round(sqrt(l * (n.n - 1)), 4) AS singular FROM e, names, n'
SQL["pca_pc"] = f'{_EIGEN} SELECT CAST(component AS INTEGER) AS component, "column", round(v[i], 5) AS value FROM e, names'

SQL["assoc_rule_lines"] = f"""WITH {_RULES}
SELECT '[' || array_to_string(string_split(body, ','), ', ') || '] -> [' || head || '] (Confidence: ' || CAST(confidence AS VARCHAR) || ')' AS rule FROM rules"""

#: Rounds that are written out for the ranks at convergence; each shrinks the change by a fifth or more.
_MOST_ROUNDS = 40


def _converging(epsilon: float) -> str:
    parts = [_EDGES]
    for i in range(1, _MOST_ROUNDS + 1):
        parts.append(f"m{i} AS MATERIALIZED (SELECT v.node, coalesce(sum(w.w * r.rank), 0.0) AS x FROM v LEFT JOIN w ON w.dst = v.node LEFT JOIN r{i - 1} r ON r.node = w.src GROUP BY v.node)")
        parts.append(f"r{i} AS MATERIALIZED (SELECT node, x + 1 - (SELECT sum(x) / count(*) FROM m{i}) AS rank FROM m{i})")
    every = " UNION ALL ".join(f"SELECT {i} AS t, sum(abs(a.rank - b.rank)) AS d FROM r{i} a JOIN r{i - 1} b USING (node)" for i in range(1, _MOST_ROUNDS + 1))
    ranks = " UNION ALL ".join(f"SELECT {i} AS t, node, rank FROM r{i}" for i in range(1, _MOST_ROUNDS + 1))
    return ",\n".join(parts) + f",\nchanges AS ({every}), last AS (SELECT min(t) AS t FROM changes WHERE d < {epsilon}), ranks AS ({ranks})"


SQL["pagerank_top10"] = f"WITH {_converging(0.01)} SELECT node, round(rank, 2) AS rank FROM (SELECT node, rank FROM ranks JOIN last USING (t) ORDER BY rank DESC, node LIMIT 10)"

_SHINGLES = """s AS (SELECT DISTINCT doc_id, substr(text, CAST(i AS BIGINT), 3) AS g FROM documents, unnest(range(1, length(text) + 1)) AS u(i)),
k AS (SELECT g FROM s GROUP BY g HAVING count(*) >= 2),
f AS MATERIALIZED (SELECT s.* FROM s JOIN k USING (g)),
n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
alike AS (SELECT a, b, c / (x.n + y.n - c) AS jaccard FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id)"""
_FAMILY = "family AS (SELECT unnest(range(0, {n})) AS i, unnest({a}) AS a, unnest({b}) AS b)".format(n=HASHES, a=[a for a, _ in hash_family(HASHES)], b=[b for _, b in hash_family(HASHES)])
_SIGNED = f"""{_SHINGLES}, {_FAMILY},
numbers AS (SELECT doc_id, list(DISTINCT CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % {PRIME}) AS xs FROM f GROUP BY doc_id),
signed AS MATERIALIZED (SELECT doc_id, CAST(i AS INTEGER) AS i, list_min(list_transform(xs, lambda x: (a * x + b) % {PRIME})) AS low FROM numbers, family),
signature AS MATERIALIZED (SELECT doc_id, list(low ORDER BY i) AS sig FROM signed GROUP BY doc_id)"""


def _banded(bands: int) -> str:
    rows = HASHES // bands
    return f"""keys{bands} AS MATERIALIZED (SELECT doc_id, band, list_slice(sig, band * {rows} + 1, (band + 1) * {rows}) AS key FROM signature, unnest(range(0, {bands})) AS u(band)),
found{bands} AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM keys{bands} x JOIN keys{bands} y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id)"""


def _recall(bands: int) -> str:
    return f"(SELECT avg(CASE WHEN f.a IS NULL THEN 0.0 ELSE 1.0 END) FROM alike t LEFT JOIN found{bands} f ON t.a = f.a AND t.b = f.b WHERE t.jaccard >= 0.8)"


_SWEPT = range(20, 51, 5)
SQL["minhash_signatures"] = f"WITH {_SIGNED} SELECT doc_id, i, low FROM signed"
SQL["lsh_recall"] = f"WITH {_SIGNED}, {_banded(20)} SELECT round({_recall(20)}, 6) AS recall"
SQL["band_sweep"] = f"WITH {_SIGNED}, {', '.join(map(_banded, _SWEPT))} " + " UNION ALL ".join(f"SELECT {b} AS bands, round(coalesce({_recall(b)}, 0.0), 6) AS recall" for b in _SWEPT)
SQL["minhash_error"] = f"""WITH {_SIGNED}, {_banded(30)}
SELECT round(sqrt(avg(power(coalesce(j.jaccard, 0.0) - len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / {HASHES}.0, 2))), 6) AS rmse
FROM found30 p JOIN signature x ON p.a = x.doc_id JOIN signature y ON p.b = y.doc_id LEFT JOIN alike j ON p.a = j.a AND p.b = j.b"""
SQL["bounded_input"] = "SELECT doc_id, length(text) AS n FROM documents ORDER BY doc_id LIMIT 1000"

SQL["parsed_ratings"] = f'WITH {_RATINGS} SELECT "user" - 1 AS "user", item - 1 AS item, rating FROM ratings'
SQL["parsed_vectors"] = "WITH k AS (SELECT unnest(['space', 'comma']) AS kind) " + " UNION ALL ".join(f"SELECT kind, {d} AS d, count(*) AS n, CAST(sum(CAST({c} AS DECIMAL(18,5))) AS DOUBLE) AS total FROM lineitem, k GROUP BY kind" for d, c in enumerate(("l_quantity", "l_discount", "l_tax")))
SQL["parsed_baskets"] = """
WITH b AS (SELECT l_orderkey AS b, string_agg(DISTINCT p_brand, ' ') AS words FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT CAST(len(list_distinct(string_split_regex(words, '\\s+'))) AS INTEGER) AS words, count(*) AS n FROM b GROUP BY 1"""
SQL["parsed_adjacency"] = """
WITH bought AS (SELECT DISTINCT user_id AS u, time_bucket(INTERVAL '10 minutes', ts) AS w FROM events WHERE event_type = 'purchase'),
e AS (SELECT DISTINCT a.u AS u, b.u AS f FROM bought a JOIN bought b ON a.w = b.w AND a.u <> b.u),
l AS (SELECT u, count(*) AS n, string_agg(CAST(f AS VARCHAR), ',' ORDER BY f) AS friends FROM e GROUP BY u)
SELECT CAST(user_id AS INTEGER) AS "user", CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(friends, '') AS friends FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN l ON u = user_id"""
SQL["parsed_texts"] = "SELECT n_nationkey AS doc_id, n_name AS text FROM nation"
