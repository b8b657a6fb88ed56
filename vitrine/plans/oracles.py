"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Written from the definitions, as plain relational SQL over the order tables;
none of the Spark operators' own steps (cut points, blocks, folds) are used.
Only parameters (weights, rates) are shared with the queries.
"""

from vitrine.plans.queries import MF_EPOCHS, MF_RATE, gru_weights


def H(*parts):
    """60-bit hash of the parts joined by ':'."""
    text = " || ':' || ".join(
        f"'{p[1:]}'" if p.startswith("=") else f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 15))::BIGINT)"


def U(*parts):
    return f"({H(*parts)}::DOUBLE / 1152921504606846976::DOUBLE)"


def N(*parts):
    radius = f"(({H(*parts, '=a')} + 1)::DOUBLE / 1152921504606846976::DOUBLE)"
    return f"(sqrt(-2::DOUBLE * ln({radius})) * cos(2::DOUBLE * pi() * {U(*parts, '=b')}))"


def r6(x, digits=6):
    return f"(round({x}, {digits}) + 0::DOUBLE)"


def text(xs, sep=","):
    return f"array_to_string({xs}, '{sep}')"


def millionths(xs):
    return ("array_to_string(list_transform(" + xs
            + ", lambda x: CAST(CAST(floor(x * 1e6 + 0.5::DOUBLE) AS BIGINT) AS VARCHAR)), ',')")


def pdf(x, mean, sd):
    """Log density of a normal."""
    return (f"(-0.5::DOUBLE * (({x} - {mean}) / {sd}) * (({x} - {mean}) / {sd})"
            f" - ln({sd}) - 0.5::DOUBLE * ln(2::DOUBLE * pi()))")


BASE = f"""
visits AS (
  SELECT o_orderkey, o_custkey, o_orderpriority,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
shown AS (
  SELECT l_orderkey,
         CASE WHEN {H('=unk', 'l_orderkey', 'l_partkey')} % 50 = 0 THEN 2
              ELSE 3 + l_partkey END AS item_id, min(l_linenumber) AS ln
  FROM lineitem GROUP BY 1, 2),
placed AS (
  SELECT l_orderkey, item_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY ln, item_id) AS pos,
         count(*) OVER (PARTITION BY l_orderkey) AS n FROM shown),
clicks AS (
  SELECT l_orderkey, max(n) AS n,
         CASE WHEN {H('=click', 'l_orderkey')} % 5 < 2 THEN 0
              ELSE 1 + ({H('=click', 'l_orderkey')} // 5) % max(n) END AS click_idx
  FROM placed GROUP BY l_orderkey),
users AS (
  SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS row_idx
  FROM (SELECT DISTINCT o_custkey AS user_id FROM visits)),
interaction AS (
  SELECT w.row_idx, u.o_custkey AS user_id, CAST(u.t AS INT) AS t,
         CAST(coalesce(p.item_id, 1) AS INT) AS click, CAST(c.click_idx AS INT) AS click_idx,
         CAST(c.n + 1 AS INT) AS slate_length,
         CAST(CAST(substr(u.o_orderpriority, 1, 1) AS INT) % 3 AS INT) AS interaction_type
  FROM visits u JOIN clicks c ON c.l_orderkey = u.o_orderkey
  JOIN users w ON w.user_id = u.o_custkey
  LEFT JOIN placed p ON p.l_orderkey = u.o_orderkey AND p.pos = c.click_idx),
exposure AS (
  SELECT w.row_idx, u.o_custkey AS user_id, CAST(u.t AS INT) AS t, CAST(p.pos AS INT) AS pos,
         CAST(p.item_id AS INT) AS item_id
  FROM visits u JOIN placed p ON p.l_orderkey = u.o_orderkey
  JOIN users w ON w.user_id = u.o_custkey
  UNION ALL
  SELECT w.row_idx, u.o_custkey, CAST(u.t AS INT), 0, 1
  FROM visits u JOIN users w ON w.user_id = u.o_custkey),
step_no AS (
  SELECT row_idx, CAST(unnest(range(greatest(20, count(*)))) AS INT) AS t
  FROM interaction GROUP BY row_idx),
step AS (
  SELECT u.row_idx, u.user_id, g.t, coalesce(i.click, 0) AS click,
         coalesce(i.click_idx, 0) AS click_idx, coalesce(i.slate_length, 0) AS slate_length,
         coalesce(i.interaction_type, 0) AS interaction_type
  FROM users u JOIN step_no g ON g.row_idx = u.row_idx
  LEFT JOIN interaction i ON i.user_id = u.user_id AND i.t = g.t),
slot AS (
  SELECT s.row_idx, s.user_id, s.t, CAST(g.p AS INT) AS pos, coalesce(e.item_id, 0) AS item_id
  FROM step s CROSS JOIN range((SELECT greatest(25, max(pos) + 1) FROM exposure)) g(p)
  LEFT JOIN exposure e ON e.row_idx = s.row_idx AND e.t = s.t AND e.pos = g.p
  WHERE g.p < greatest(25, s.slate_length)),
slate AS (
  SELECT row_idx, t, list(item_id ORDER BY pos) AS slate FROM slot GROUP BY row_idx, t),
widths AS (SELECT max(item_id) + 1 AS n_items FROM exposure),
item_name AS (
  SELECT CAST(3 + p_partkey AS INT) AS item_id, p_type || ',' || p_brand AS category_name
  FROM part
  UNION ALL SELECT 0, 'PAD' UNION ALL SELECT 1, 'noClick' UNION ALL SELECT 2, '<UNK>'),
item AS (
  SELECT item_id, category_name,
         CAST(CASE WHEN item_id < 3 THEN item_id ELSE 2 + dense_rank() OVER (
           PARTITION BY item_id < 3 ORDER BY category_name) END AS INT) AS category_id
  FROM item_name),
vocab AS (
  SELECT DISTINCT 'category' AS attr, category_id AS idx, category_name AS value FROM item
  UNION ALL SELECT 'interaction_type', 0, 'undefined'
  UNION ALL SELECT 'interaction_type', 1, 'search'
  UNION ALL SELECT 'interaction_type', 2, 'recommendation'),
itemvec AS (
  SELECT CAST(3 + p_partkey AS INT) AS id, list_transform(embedding, lambda x: x::DOUBLE)::DOUBLE[] AS vec
  FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)),
uservec AS (
  SELECT u.row_idx, u.user_id AS id, list_transform(e.embedding, lambda x: x::DOUBLE)::DOUBLE[] AS vec
  FROM users u JOIN embeddings e
  ON e.vec_id = {H('=user', 'u.user_id')} % (SELECT count(*) FROM embeddings)),
itemhat AS (
  SELECT a.id, list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] + z[2]) * 0.5::DOUBLE) AS vec
  FROM itemvec a JOIN itemvec b ON b.id = 3 + (a.id - 3 + 1) % (SELECT count(*) FROM itemvec)),
itemdim AS (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS d FROM itemvec),
userdim AS (SELECT row_idx, id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS d FROM uservec),
itemscale AS (SELECT id, 0.05::DOUBLE + 0.01::DOUBLE * (id % 5) AS scale FROM itemvec),
groupdim AS (
  SELECT i.category_id, v.d, avg(v.x) AS x FROM itemdim v JOIN item i ON i.item_id = v.id
  GROUP BY 1, 2),
groupscale AS (
  SELECT DISTINCT category_id, 0.04::DOUBLE + 0.01::DOUBLE * (category_id % 3) AS scale
  FROM groupdim),
ranked AS (
  SELECT row_idx, user_id, {H('=split', '=0', 'row_idx')} AS h,
         row_number() OVER (ORDER BY {H('=split', '=0', 'row_idx')}, row_idx) AS rk FROM users),
split AS (
  SELECT row_idx, user_id, rk,
         CASE WHEN rk <= n THEN 'valid' WHEN rk <= 2 * n THEN 'test' ELSE 'train' END AS split
  FROM ranked, (SELECT floor(count(*)::DOUBLE * 0.05::DOUBLE) AS n FROM users)),
member AS (
  SELECT row_idx, user_id, split, rk, 'train' AS phase FROM split
  UNION ALL SELECT row_idx, user_id, split, rk, split FROM split WHERE split <> 'train'),
phased AS (
  SELECT i.*, CASE WHEN s.split <> 'train' AND i.t >= 5 THEN s.split ELSE 'train' END AS phase
  FROM interaction i JOIN split s ON s.row_idx = i.row_idx),
mask AS (
  SELECT s.row_idx, s.user_id, g.t,
         CASE WHEN g.t >= 5 AND s.split = 'valid' THEN 2
              WHEN g.t >= 5 AND s.split = 'test' THEN 3 ELSE 1 END AS mask_type
  FROM split s JOIN step_no g ON g.row_idx = s.row_idx),
views AS (
  SELECT CAST(g.i AS INT) AS item_id, count(s.item_id) AS views
  FROM range((SELECT n_items FROM widths)) g(i) LEFT JOIN slot s ON s.item_id = g.i GROUP BY 1),
clicked AS (
  SELECT CAST(g.i AS INT) AS item_id, count(s.click) AS clicks
  FROM range((SELECT n_items FROM widths)) g(i) LEFT JOIN step s ON s.click = g.i GROUP BY 1),
ctr AS (
  SELECT item_id, clicks, views, CASE WHEN views < 20 THEN 0::DOUBLE
    ELSE clicks::DOUBLE / views END AS ctr FROM clicked JOIN views USING (item_id)),
score AS (
  SELECT u.row_idx, u.id AS user_id, v.id AS item_id, list_dot_product(u.vec, v.vec) AS s
  FROM uservec u CROSS JOIN itemvec v),
top20 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row_idx ORDER BY s DESC, item_id) AS INT) AS rank
  FROM score QUALIFY rank <= 20),
l2 AS (
  SELECT u.row_idx, v.id AS item_id, -sqrt(greatest(list_dot_product(u.vec, u.vec)
    - 2 * list_dot_product(u.vec, v.vec) + list_dot_product(v.vec, v.vec), 1e-10)) AS s
  FROM uservec u CROSS JOIN itemvec v),
top20l2 AS (
  SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY s DESC, item_id) AS rank
  FROM l2 QUALIFY rank <= 20),
rc AS (
  SELECT row_idx, t, click, row_number() OVER (PARTITION BY row_idx ORDER BY t) AS k
  FROM interaction WHERE click >= 3),
clicks_before AS (
  SELECT u.row_idx, u.user_id, g.t, count(rc.t) AS n
  FROM users u JOIN (SELECT * FROM step_no UNION ALL SELECT row_idx, max(t) + 1 FROM step_no GROUP BY 1) g
  ON g.row_idx = u.row_idx LEFT JOIN rc ON rc.row_idx = u.row_idx AND rc.t < g.t
  GROUP BY ALL),
levels AS (SELECT row_idx, 0 AS n FROM users UNION ALL SELECT row_idx, k FROM rc),
"""


def _states(name, items):
    """Linear profile states in closed form: a sum over earlier clicks."""
    return f"""
{name}_pull AS (
  SELECT l.row_idx, l.n, v.d, sum(0.2::DOUBLE * pow(0.8::DOUBLE, l.n - rc.k) * v.x) AS x
  FROM levels l JOIN rc ON rc.row_idx = l.row_idx AND rc.k <= l.n
  JOIN (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS d FROM {items}) v
  ON v.id = rc.click GROUP BY ALL),
{name}_fold AS (
  SELECT l.row_idx, l.n, u.d, pow(0.8::DOUBLE, l.n) * u.x + coalesce(p.x, 0) AS x
  FROM levels l JOIN userdim u ON u.row_idx = l.row_idx
  LEFT JOIN {name}_pull p ON p.row_idx = l.row_idx AND p.n = l.n AND p.d = u.d),
{name}_vec AS (SELECT row_idx, n, list(x ORDER BY d) AS vec FROM {name}_fold GROUP BY 1, 2),
{name} AS (
  SELECT b.row_idx, b.user_id, b.t, f.vec FROM clicks_before b
  JOIN {name}_vec f ON f.row_idx = b.row_idx AND f.n = b.n),
"""


def _slate_scores(name, items, states):
    return f"""
{name} AS (
  SELECT e.row_idx, e.user_id, e.t, e.pos, e.item_id,
    greatest(-100::DOUBLE, least(20::DOUBLE, CASE
      WHEN e.pos = 0 AND e.item_id = 1 THEN -1::DOUBLE + 0.1::DOUBLE * least(i.slate_length, 25)
      WHEN e.pos = 0 THEN 0::DOUBLE WHEN e.item_id <= 2 OR v.id IS NULL THEN -100::DOUBLE
      ELSE 2::DOUBLE * list_dot_product(s.vec, v.vec) END)) AS score
  FROM exposure e JOIN interaction i ON i.row_idx = e.row_idx AND i.t = e.t
  JOIN {states} s ON s.row_idx = e.row_idx AND s.t = e.t LEFT JOIN {items} v ON v.id = e.item_id),
"""


BASE += _states("state", "itemvec") + _states("hatstate", "itemhat")
BASE += _slate_scores("slatescore", "itemvec", "state")
BASE += _slate_scores("hatslate", "itemhat", "hatstate")
BASE += f"""
observed AS (SELECT * FROM phased WHERE click NOT IN (0, 2)),
prob AS (
  SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY row_idx, t) AS prob FROM slatescore),
hatprob AS (
  SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY row_idx, t) AS prob FROM hatslate),
stepll AS (
  SELECT o.phase, o.row_idx, o.t, max(CASE WHEN s.pos = o.click_idx THEN s.score END)
    - ln(sum(exp(s.score))) AS ll
  FROM observed o JOIN slatescore s ON s.row_idx = o.row_idx AND s.t = o.t GROUP BY 1, 2, 3),
cand AS (
  SELECT p.row_idx, p.user_id, p.t, p.phase, 0 AS c, p.click AS item_id
  FROM phased p WHERE p.click >= 3
  UNION ALL
  SELECT p.row_idx, p.user_id, p.t, p.phase, CAST(g.j AS INT),
    CAST(3 + {H('=cand', '=0', 'p.user_id', 'p.t', 'g.j')} % (n_items - 3) AS INT)
  FROM phased p CROSS JOIN range(1, 5) g(j) CROSS JOIN widths WHERE p.click >= 3),
mfll AS (
  SELECT c.row_idx, c.user_id, c.t, c.phase,
    max(CASE WHEN c = 0 THEN list_dot_product(u.vec, v.vec) END)
      - ln(sum(exp(list_dot_product(u.vec, v.vec)))) AS ll
  FROM cand c JOIN uservec u ON u.row_idx = c.row_idx JOIN itemvec v ON v.id = c.item_id
  GROUP BY 1, 2, 3, 4),
report AS (
  SELECT i.item_id, v.views + 1 AS views, s.scale AS mean_scale, substr(i.category_name, 1, 3) AS vertical,
    count(*) OVER (PARTITION BY i.category_id) AS category_count,
    (SELECT sqrt(sum((a.x - g.x) * (a.x - g.x))) FROM itemdim a JOIN groupdim g
     ON g.d = a.d AND g.category_id = i.category_id WHERE a.id = i.item_id) AS dist_vec,
    sqrt(64 * (s.scale - gs.scale) * (s.scale - gs.scale)) AS dist_scale
  FROM item i JOIN views v ON v.item_id = i.item_id JOIN itemscale s ON s.id = i.item_id
  JOIN groupscale gs ON gs.category_id = i.category_id),
reward AS (
  SELECT ['train', 'valid', 'test'][m.mask_type] AS phase, i.t,
    avg(CAST(i.click >= 3 AS INT)) AS reward FROM interaction i
  JOIN mask m ON m.row_idx = i.row_idx AND m.t = i.t WHERE i.t >= 5 GROUP BY 1, 2),
metric AS (
  SELECT CAST(user_id % 5 AS INT) AS epoch, phase, user_id // 100 AS batch_id, 'click_idx' AS name,
    avg(click_idx) AS value FROM phased GROUP BY 1, 2, 3),
epochs AS (
  SELECT epoch, phase, name, sum(value) / count(*) AS value FROM metric GROUP BY 1, 2, 3),
prior AS (
  SELECT 'item' AS term, sum({pdf('v.x', 'g.x', 'greatest(abs(s.scale), 0.001::DOUBLE)')}) AS log_prior
  FROM itemdim v JOIN item i ON i.item_id = v.id
  JOIN groupdim g ON g.category_id = i.category_id AND g.d = v.d
  JOIN groupscale s ON s.category_id = i.category_id
  UNION ALL SELECT 'groupvec', sum({pdf('x', '0', '0.2::DOUBLE')}) FROM groupdim
  UNION ALL SELECT 'groupscale', 64 * sum({pdf('scale', '0', '0.2::DOUBLE')}) FROM groupscale
  UNION ALL SELECT 'bias', sum({pdf('(-1::DOUBLE + 0.1::DOUBLE * i)', '0', '1::DOUBLE')}) FROM range(26) g(i)
  UNION ALL SELECT 'user', sum({pdf('x', '0', '1::DOUBLE')}) FROM userdim),
mfuser AS (
  SELECT user_id AS id, list(({U('=init', '=1', '=user', 'user_id', 'd')} * 0.1::DOUBLE - 0.05::DOUBLE)
    ORDER BY d) AS vec FROM users CROSS JOIN range(9) g(d) GROUP BY 1),
mfitem AS (
  SELECT id, list(({U('=init', '=1', '=item', 'id', 'd')} * 0.1::DOUBLE - 0.05::DOUBLE)
    ORDER BY d) AS vec FROM itemvec CROSS JOIN range(9) g(d) GROUP BY 1),
mfcand AS (
  SELECT c.*, u.vec AS z, v.vec AS vec, CASE WHEN c = 0 THEN 1 ELSE 0 END
    - exp(list_dot_product(u.vec, v.vec)) / sum(exp(list_dot_product(u.vec, v.vec)))
      OVER (PARTITION BY c.row_idx, c.t) AS q
  FROM cand c JOIN mfuser u ON u.id = c.user_id JOIN mfitem v ON v.id = c.item_id
  WHERE phase = 'train')
"""



def _matrix(weights):
    rows = ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in row) + "]" for row in weights)
    return f"[{rows}]"


def _times(weights, x):
    return f"list_transform({_matrix(weights)}, lambda r: list_dot_product(r, {x}))"


def _gru(w):
    """States after 0, 1, ... real clicks by plain recursion over the clicks."""
    gate = "lambda z: 1 / (1 + exp(-(z[1] + z[2])))"
    return f"""
gru AS (
  SELECT row_idx, CAST(0 AS BIGINT) AS n, vec AS h FROM uservec
  UNION ALL
  SELECT row_idx, n + 1, list_transform(list_zip(list_transform(
      list_zip(reset, {_times(w['in'], 'x')}, {_times(w['hn'], 'h')}), lambda z: tanh(z[2] + z[1] * z[3])),
      keep, h), lambda z: (1 - z[2]) * z[1] + z[2] * z[3])
  FROM (SELECT row_idx, n, h, x,
          list_transform(list_zip({_times(w['ir'], 'x')}, {_times(w['hr'], 'h')}), {gate}) AS reset,
          list_transform(list_zip({_times(w['id'], 'x')}, {_times(w['hd'], 'h')}), {gate}) AS keep
        FROM (SELECT g.row_idx, g.n, g.h, v.vec AS x FROM gru g
              JOIN rc ON rc.row_idx = g.row_idx AND rc.k = g.n + 1 JOIN itemvec v ON v.id = rc.click))),
grustate AS (
  SELECT b.row_idx, b.user_id, b.t, {_times(w['z'], 'g.h')} AS z FROM clicks_before b
  JOIN gru g ON g.row_idx = b.row_idx AND g.n = b.n)
"""


def _fit(epochs, lr):
    """Full-gradient AdamW, unrolled: parameters in long form per epoch."""
    parts = ["""
par0 AS (
  SELECT 'user' AS kind, id, g.d, vec[g.d + 1] AS w, 0::DOUBLE AS m, 0::DOUBLE AS v
  FROM mfuser CROSS JOIN range(9) g(d)
  UNION ALL SELECT 'item', id, g.d, vec[g.d + 1], 0::DOUBLE, 0::DOUBLE FROM mfitem CROSS JOIN range(9) g(d))"""]

    def logliks(name, epoch, phase, params):
        return f"""
{name}c AS (
  SELECT user_id, t, 0 AS c, click AS item_id FROM phased WHERE click >= 3 AND phase = '{phase}'
  UNION ALL SELECT user_id, t, g.j, 3 + {H('=cand', '=1', '=' + phase, f'={epoch}', 'user_id', 't', 'g.j')} % (n_items - 3)
  FROM phased CROSS JOIN range(1, 5) g(j) CROSS JOIN widths WHERE click >= 3 AND phase = '{phase}'),
{name}s AS (
  SELECT c.user_id, c.t, c.c, c.item_id, sum(u.w * i.w) AS s FROM {name}c c
  JOIN {params} u ON u.kind = 'user' AND u.id = c.user_id
  JOIN {params} i ON i.kind = 'item' AND i.id = c.item_id AND i.d = u.d GROUP BY ALL),
{name}q AS (
  SELECT *, s - ln(sum(exp(s)) OVER (PARTITION BY user_id, t)) AS ll FROM {name}s)"""

    for e in range(epochs):
        c1, c2 = 1 - 0.9 ** (e + 1), 1 - 0.999 ** (e + 1)
        parts.append(logliks(f"tr{e}", e, "train", f"par{e}"))
        parts.append(f"""
grad{e} AS (
  SELECT 'user' AS kind, q.user_id AS id, i.d, sum(((q.c = 0)::INT - exp(q.ll)) * i.w) AS g
  FROM tr{e}q q JOIN par{e} i ON i.kind = 'item' AND i.id = q.item_id GROUP BY ALL
  UNION ALL
  SELECT 'item', q.item_id, u.d, sum(((q.c = 0)::INT - exp(q.ll)) * u.w)
  FROM tr{e}q q JOIN par{e} u ON u.kind = 'user' AND u.id = q.user_id GROUP BY ALL),
mom{e} AS (
  SELECT p.kind, p.id, p.d, p.w, 0.9::DOUBLE * p.m - 0.1::DOUBLE * coalesce(g.g, 0) AS m,
    0.999::DOUBLE * p.v + 0.001::DOUBLE * coalesce(g.g, 0) * coalesce(g.g, 0) AS v
  FROM par{e} p LEFT JOIN grad{e} g ON g.kind = p.kind AND g.id = p.id AND g.d = p.d),
par{e + 1} AS (
  SELECT kind, id, d, m, v, w * (1 - {lr}::DOUBLE * 0.01::DOUBLE)
    - {lr}::DOUBLE * (m / {c1!r}::DOUBLE) / (sqrt(v / {c2!r}::DOUBLE) + 1e-8::DOUBLE) AS w FROM mom{e})""")
        parts.append(logliks(f"va{e}", e, "valid", f"par{e + 1}"))
    return ",".join(parts)


# log in text form, one row per user
WIDE = f"""
per_user AS (
  SELECT s.row_idx, s.user_id, {text('list(s.click ORDER BY s.t)')} AS click,
    {text('list(s.click_idx ORDER BY s.t)')} AS click_idx,
    {text('list(s.slate_length ORDER BY s.t)')} AS slate_lengths,
    {text('list(s.interaction_type ORDER BY s.t)')} AS interaction_type,
    {text('list(' + text('l.slate') + ' ORDER BY s.t)', ';')} AS slate
  FROM step s JOIN slate l ON l.row_idx = s.row_idx AND l.t = s.t GROUP BY 1, 2)
"""


def _last_top(states, items):
    """The 20 best items of each user's last state, ranks from 1."""
    return f"""
      SELECT q.row_idx, v.id, row_number() OVER (
        PARTITION BY q.row_idx ORDER BY list_dot_product(q.vec, v.vec) DESC, v.id) AS rank
      FROM (SELECT row_idx, vec FROM {states} QUALIFY t = max(t) OVER (PARTITION BY row_idx)) q
      CROSS JOIN {items} v QUALIFY rank <= 20"""


BODIES = {
    # scans, sinks
    "scan_slate_log": "SELECT * FROM per_user",
    "scan_vocab": "SELECT attr, idx, value FROM vocab",
    "scan_item_attr": "SELECT item_id, category_id FROM item",
    "narrow_ids": "SELECT row_idx, click, slate, 'array<int>' AS click_type FROM per_user",
    "sink_phase_batches": """
      SELECT phase, count(*) AS num_users, CAST(ceil(count(*) / 1024::DOUBLE) AS BIGINT) AS num_batches
      FROM member GROUP BY phase""",
    "sink_model_tables": f"""
      SELECT 'itemvec' AS name, CAST(id AS BIGINT) AS id, CAST(len(vec) AS INT) AS dim,
        {r6('list_sum(vec)')} AS vec_sum FROM itemvec
      UNION ALL SELECT 'uservec', id, CAST(len(vec) AS INT), {r6('list_sum(vec)')} FROM uservec""",
    "sink_metrics": f"SELECT epoch, phase, batch_id, name, {r6('value')} AS value FROM metric",
    # validation, dimensions
    "validate_log": """
      SELECT unnest(['has_slate', 'has_click', 'steps_click', 'steps_click_idx', 'steps_slate_lengths',
        'steps_interaction_type']) AS "check", CAST(0 AS BIGINT) AS violations
      UNION ALL SELECT 'step_count_users', CAST(min(n) <> max(n) AS BIGINT) FROM (
        SELECT count(*) AS n FROM step_no GROUP BY row_idx)
      UNION ALL SELECT 'slate_width', count(*) FROM (SELECT row_idx FROM step GROUP BY 1
        HAVING min(greatest(25, slate_length)) <> max(greatest(25, slate_length)))
      UNION ALL SELECT 'slate_width_users', CAST(count(DISTINCT w) > 1 AS BIGINT) FROM (
        SELECT max(greatest(25, slate_length)) AS w FROM step GROUP BY row_idx)
      UNION ALL SELECT 'click_in_slate', count(*) FROM interaction i
      WHERE NOT EXISTS (SELECT 1 FROM exposure e WHERE e.row_idx = i.row_idx AND e.t = i.t
        AND e.pos = i.click_idx AND e.item_id = i.click)""",
    "dataset_dims": """
      SELECT CAST((SELECT n_items FROM widths) AS BIGINT) AS num_items,
        (SELECT CAST(max(t) + 1 AS BIGINT) FROM step_no) AS num_interactions,
        (SELECT greatest(25, max(slate_length))::BIGINT FROM step) AS maxlen_slate,
        max(user_id) + 1 AS num_users, CAST(3 AS BIGINT) AS num_interaction_types FROM users""",
    "num_groups": "SELECT count(DISTINCT category_id) AS num_groups FROM item",
    "checksum_columns": f"""
      SELECT "column", {r6('mean')} AS mean FROM (
        SELECT m.*, sum(mean) OVER () AS total FROM (
          SELECT unnest(['click', 'click_idx', 'slate_lengths', 'interaction_type']) AS "column",
            unnest([avg(click), avg(click_idx), avg(slate_length), avg(interaction_type)]) AS mean FROM step
          UNION ALL SELECT 'mask_type', avg(mask_type) FROM mask
          UNION ALL SELECT 'slate', avg(item_id) FROM slot
          UNION ALL SELECT 'user_id', avg(user_id) FROM users) m)
      UNION ALL SELECT 'total', {r6('sum(mean)')} FROM (
          SELECT avg(click) + avg(click_idx) + avg(slate_length) + avg(interaction_type) AS mean FROM step
          UNION ALL SELECT avg(mask_type) FROM mask UNION ALL SELECT avg(item_id) FROM slot
          UNION ALL SELECT avg(user_id) FROM users)""",
    "checksum_batch": f"""
      SELECT count(DISTINCT row_idx) AS num_users, CAST(sum(item_id) AS BIGINT) AS checksum FROM exposure
      WHERE row_idx IN (SELECT row_idx FROM users
        ORDER BY {H('=batch', '=0', '=0', 'row_idx')}, row_idx LIMIT 1024)""",
    # projections, filters, reshaping
    "explode_interactions": "SELECT user_id, t, click, click_idx, slate_length, interaction_type FROM interaction",
    "explode_exposures": "SELECT user_id, t, pos, item_id FROM exposure",
    "pack_interactions": "SELECT * FROM per_user",
    "interaction_lookup": f"""
      SELECT s.row_idx, s.user_id, s.t, s.click, s.click_idx, s.slate_length, s.interaction_type,
        {text('l.slate')} AS slate FROM step s JOIN slate l ON l.row_idx = s.row_idx AND l.t = s.t
      WHERE s.t = 3""",
    "limit_users": "SELECT row_idx, user_id, click FROM per_user WHERE row_idx < 1000",
    "slate_length": "SELECT user_id, t, CAST(count(*) AS INT) AS slate_length FROM exposure GROUP BY 1, 2",
    "click_position": """
      SELECT e.user_id, e.t, e.pos AS click_idx FROM exposure e JOIN interaction i
      ON i.row_idx = e.row_idx AND i.t = e.t AND i.click = e.item_id""",
    "real_item_filter": "SELECT user_id, t, pos, item_id FROM exposure WHERE item_id >= 3",
    "observed_step_filter": "SELECT phase, user_id, t, click FROM phased WHERE click <> 2",
    "phase_clicks": f"""
      SELECT m.phase, m.user_id, coalesce({text('list(p.click ORDER BY p.t) FILTER (p.click IS NOT NULL)')}, '') AS clicks
      FROM member m LEFT JOIN phased p ON p.row_idx = m.row_idx AND p.phase = m.phase GROUP BY 1, 2""",
    "history_cut": f"""
      SELECT s.row_idx, s.user_id,
        {text('list(CASE WHEN s.t < 5 THEN s.click ELSE 0 END ORDER BY s.t)')} AS click,
        {text('list(CASE WHEN s.t < 5 THEN s.click_idx ELSE 0 END ORDER BY s.t)')} AS click_idx,
        {text('list(CASE WHEN s.t < 5 THEN s.slate_length ELSE 0 END ORDER BY s.t)')} AS slate_lengths,
        {text('list(CASE WHEN s.t < 5 THEN s.interaction_type ELSE 0 END ORDER BY s.t)')} AS interaction_type,
        {text("list(CASE WHEN s.t < 5 THEN " + text('l.slate') + " ELSE repeat('0,', len(l.slate)::INT - 1) || '0' END ORDER BY s.t)", ';')} AS slate
      FROM step s JOIN slate l ON l.row_idx = s.row_idx AND l.t = s.t GROUP BY 1, 2""",
    "left_pad_history": f"""
      SELECT u.row_idx, {text('list(coalesce(r.click, 0) ORDER BY g.k DESC)')} AS history
      FROM users u CROSS JOIN range(10) g(k) LEFT JOIN (
        SELECT row_idx, click, row_number() OVER (PARTITION BY row_idx ORDER BY t DESC) - 1 AS k
        FROM interaction) r ON r.row_idx = u.row_idx AND r.k = g.k GROUP BY 1""",
    "collapse_item_group": "SELECT item_id, CAST(0 AS INT) AS category_id FROM item",
    # joins
    "item_category_name": """
      SELECT i.user_id, i.t, i.click, n.category_name FROM interaction i
      JOIN item_name n ON n.item_id = i.click""",
    "interaction_type_name": """
      SELECT user_id, t, interaction_type,
        ['undefined', 'search', 'recommendation'][interaction_type + 1] AS type_name FROM interaction""",
    "inverse_vocab_lookup": """
      SELECT item_id, split_part(category_name, ',', 1) AS vertical,
        max(category_id) OVER (PARTITION BY split_part(category_name, ',', 1)) AS idx FROM item""",
    "gather_item_vectors": f"""
      SELECT e.user_id, e.t, e.pos, e.item_id, {r6('list_sum(v.vec)')} AS vec_sum
      FROM exposure e JOIN itemvec v ON v.id = e.item_id""",
    "gather_user_vectors": f"""
      SELECT i.user_id, i.t, i.click, {r6('list_sum(v.vec)')} AS vec_sum
      FROM interaction i JOIN uservec v ON v.id = i.user_id""",
    "items_left_counts": """
      SELECT CAST(g.i AS INT) AS item_id, (SELECT count(*) FROM interaction
        WHERE click = g.i AND click >= 3) AS n FROM range((SELECT n_items FROM widths)) g(i)""",
    "semi_recommended": """
      SELECT user_id, item_id, rank FROM top20 r WHERE EXISTS (SELECT 1 FROM interaction i
        WHERE i.row_idx = r.row_idx AND i.click = r.item_id AND i.t >= 5)""",
    "anti_already_clicked": """
      SELECT user_id, item_id, rank FROM top20 r WHERE NOT EXISTS (SELECT 1 FROM interaction i
        WHERE i.row_idx = r.row_idx AND i.click = r.item_id AND i.t < 5)""",
    "users_x_items": """
      SELECT user_id, item_id FROM users, (SELECT item_id FROM views WHERE item_id >= 3
        ORDER BY views DESC, item_id LIMIT 5)""",
    # splits, batches
    "split_users_pct": "SELECT row_idx, user_id, split FROM split",
    "split_users_ratio": """
      SELECT row_idx, user_id, CASE WHEN rk <= n THEN 'valid' WHEN rk <= 2 * n THEN 'test'
        ELSE 'train' END AS split
      FROM ranked, (SELECT floor(count(*)::DOUBLE * (1::DOUBLE - 0.9::DOUBLE) / 2) AS n FROM users)""",
    "phase_mask": f"""
      SELECT m.phase, m.user_id, {text('''list(CASE WHEN m.phase <> 'train' THEN CAST(g.t >= 5 AS INT)
        ELSE CAST(m.split = 'train' OR g.t < 5 AS INT) END ORDER BY g.t)''', '')} AS phase_mask
      FROM member m JOIN step_no g ON g.row_idx = m.row_idx GROUP BY 1, 2""",
    "mask_type": f"SELECT user_id, {text('list(mask_type ORDER BY t)', '')} AS mask_type FROM mask GROUP BY 1",
    "phase_mask_from_type": f"""
      SELECT p.phase, m.user_id, {text('list(CAST(m.mask_type = p.code AS INT) ORDER BY m.t)', '')} AS phase_mask
      FROM mask m CROSS JOIN (VALUES ('train', 1), ('valid', 2), ('test', 3)) p(phase, code)
      GROUP BY 1, 2""",
    "batch_assign": f"""
      SELECT phase, row_idx, (rn - 1) // 100 AS batch_id, CAST((rn - 1) % 100 AS INT) AS batch_pos FROM (
        SELECT phase, row_idx, row_number() OVER (PARTITION BY phase ORDER BY CASE WHEN phase = 'train'
          THEN {H('=batch', '=0', '=0', 'row_idx')} ELSE rk END, row_idx) AS rn FROM member)""",
    # sampling
    "sample_candidates": f"""
      SELECT s.user_id, s.t, {text('list(3 + ' + H('=cand', '=0', 's.user_id', 's.t', 'g.j')
                                   + ' % (n_items - 3) ORDER BY g.j)')} AS allitem
      FROM step s CROSS JOIN range(1, 5) g(j) CROSS JOIN widths GROUP BY 1, 2""",
    "sample_uniform_slate": f"""
      SELECT s.user_id, s.t, {text('''list(CASE WHEN g.p = 0 THEN 1 WHEN g.p = 1 AND s.click <> 1
        THEN s.click ELSE 3 + ''' + H('=slate', '=0', 's.user_id', 's.t', 'g.p')
                                   + ' % (n_items - 3) END ORDER BY g.p)')} AS slate,
        CAST(s.click <> 1 AS INT) AS click_idx
      FROM step s JOIN (SELECT row_idx, t, pos AS p FROM slot) g ON g.row_idx = s.row_idx AND g.t = s.t
      CROSS JOIN widths GROUP BY s.user_id, s.t, s.click""",
    "random_recommender": f"""
      SELECT user_id, {text(f"list(i + 2 ORDER BY {H('=perm', '=0', 'user_id', 'i')})")} AS recs FROM (
        SELECT user_id, unnest(s) AS i FROM floyd CROSS JOIN widths WHERE j = n_items - 2) GROUP BY user_id""",
    "sample_items_labelled": f"""
      SELECT 'item' AS kind, draw, CAST(i.item_id AS BIGINT) AS id, i.category_name AS label,
        {r6('coalesce(list_sum(v.vec), 0::DOUBLE)')} AS vec_sum
      FROM (SELECT g.d AS draw, {H('=emb', '=0', 'g.d')} % (SELECT count(*) FROM item) AS item_id
            FROM range(10000) g(d)) x JOIN item i ON i.item_id = x.item_id
      LEFT JOIN itemvec v ON v.id = i.item_id
      UNION ALL SELECT 'user', row_idx, id, '', {r6('list_sum(vec)')} FROM uservec WHERE row_idx < 1000""",
    "posterior_draw": f"""
      SELECT CAST(g.draw AS INT) AS draw, CAST(v.id AS BIGINT) AS id, CAST(v.d AS INT) AS dim,
        {r6('v.x + s.scale * ' + N('=post', '=0', '=item', 'g.draw', 'v.id', 'v.d'))} AS value
      FROM itemdim v JOIN itemscale s ON s.id = v.id CROSS JOIN range(2) g(draw)""",
    "sample_click": f"""
      SELECT x.user_id, x.t, coalesce(min(x.pos) FILTER (x.cum >= {U('=click', '=0', 'x.user_id', 'x.t')}),
        max(x.pos)) AS pos, any_value(x.t) >= 19 AS click_at_end
      FROM (SELECT p.row_idx, p.user_id, p.t, p.pos, sum(p.prob) OVER (
              PARTITION BY p.row_idx, p.t ORDER BY p.pos) AS cum FROM prob p
            JOIN (SELECT row_idx, max(t) AS t FROM interaction GROUP BY 1) l
            ON l.row_idx = p.row_idx AND l.t = p.t) x GROUP BY x.user_id, x.t""",
    # aggregations
    "noclick_ratio": f"SELECT {r6('count(*) FILTER (click = 1) / count(*)')} AS noclick_ratio FROM interaction",
    "avg_slate_length": f"SELECT {r6('avg(slate_length)')} AS avg_slate_length FROM interaction",
    "recommendation_ratio": f"""
      SELECT {r6('avg(CAST(interaction_type = 2 AS INT))')} AS recommendation_ratio
      FROM interaction WHERE interaction_type <> 0""",
    "avg_interactions_per_user": f"""
      SELECT {r6('(SELECT count(*) FROM interaction) / count(*)')} AS avg_interactions FROM users""",
    "item_click_counts": "SELECT item_id, clicks FROM clicked",
    "item_view_counts": "SELECT item_id, views FROM views",
    "item_ctr": f"SELECT item_id, clicks, views, {r6('ctr')} AS ctr FROM ctr",
    "top_ctr_items": f"SELECT item_id, clicks, views, {r6('ctr')} AS ctr FROM ctr ORDER BY ctr.ctr DESC, item_id LIMIT 20",
    "popularity_histogram": """
      SELECT CAST(g.b AS INT) AS bin, count(v.item_id) AS n FROM range(100) g(b) LEFT JOIN (
        SELECT item_id, CASE WHEN item_id < 3 THEN 1 ELSE views END AS x FROM views) v
      ON v.x <= 1000 AND least(v.x // 10, 99) = g.b GROUP BY 1""",
    "value_histogram": """
      SELECT name, CAST(g.b AS INT) AS bin, count(x.v) AS n
      FROM (VALUES ('scale'), ('vec')) k(name) CROSS JOIN range(100) g(b) LEFT JOIN (
        SELECT *, min(v) OVER (PARTITION BY what) AS lo,
          (max(v) OVER (PARTITION BY what) - min(v) OVER (PARTITION BY what)) / 100 AS w FROM (
          SELECT 'scale' AS what, round(scale, 12) AS v FROM itemscale
          UNION ALL SELECT 'vec', round(list_sum(vec) / len(vec), 12) FROM itemvec)) x
      ON x.what = k.name AND x.v >= x.lo + g.b * x.w AND (x.v < x.lo + (g.b + 1) * x.w OR g.b = 99)
      GROUP BY 1, 2""",
    "category_counts": """
      SELECT item_id, category_id, count(*) OVER (PARTITION BY category_id) AS n FROM item""",
    "item_report": f"""
      SELECT item_id, views, {r6('mean_scale')} AS mean_scale, vertical, category_count,
        {r6('dist_vec')} AS dist_vec, {r6('dist_scale')} AS dist_scale FROM report""",
    "density_2d": """
      SELECT vertical, CAST(floor(log10(views) * 10) AS INT) AS bx, CAST(floor(log10(y) * 10) AS INT) AS "by",
        count(*) AS n, what AS y FROM (
        SELECT vertical, views, 'mean_scale' AS what, mean_scale AS y FROM report
        UNION ALL SELECT vertical, views, 'dist_vec', dist_vec FROM report)
      WHERE views > 0 AND y > 0 GROUP BY 1, 2, 3, 5""",
    "num_obs": "SELECT phase, count(*) AS num_obs FROM phased GROUP BY 1",
    "phase_epoch_mean": f"SELECT epoch, phase, name, {r6('value')} AS value FROM epochs",
    "best_epoch": f"""
      SELECT v.epoch, {r6('t.value')} AS train_value, {r6('v.value')} AS valid_value
      FROM epochs v JOIN epochs t ON t.epoch = v.epoch AND t.phase = 'train' WHERE v.phase = 'valid'
      ORDER BY v.value DESC, v.epoch LIMIT 1""",
    "param_l1": f"""
      SELECT 'itemvec' AS name, {r6('avg(abs(x))')} AS l1 FROM itemdim
      UNION ALL SELECT 'uservec', {r6('avg(abs(x))')} FROM userdim""",
    "state_energy": f"""
      SELECT b.t, CAST(f.d AS INT) AS dim, {r6('sum(f.x * f.x)')} AS energy FROM clicks_before b
      JOIN state_fold f ON f.row_idx = b.row_idx AND f.n = b.n GROUP BY 1, 2""",
    "state_std": f"""
      SELECT CAST(f.d AS INT) AS dim, {r6('stddev_samp(f.x)')} AS std FROM clicks_before b
      JOIN state_fold f ON f.row_idx = b.row_idx AND f.n = b.n GROUP BY 1""",
    "user_hits": """
      SELECT u.user_id, count(DISTINCT i.click) AS hits FROM users u LEFT JOIN (
        SELECT i.row_idx, i.click FROM interaction i JOIN top20 r
        ON r.row_idx = i.row_idx AND r.item_id = i.click WHERE i.t >= 5) i
      ON i.row_idx = u.row_idx GROUP BY 1""",
    # vector scoring, likelihood
    "score_dot": f"""
      SELECT i.user_id, i.t, i.click, {r6('list_dot_product(u.vec, v.vec)')} AS score
      FROM interaction i JOIN uservec u ON u.id = i.user_id JOIN itemvec v ON v.id = i.click""",
    "score_l2": f"""
      SELECT i.user_id, i.t, i.click, {r6('s')} AS score FROM interaction i
      JOIN l2 ON l2.row_idx = i.row_idx AND l2.item_id = i.click""",
    "score_targets": f"""
      SELECT user_id, item_id, {r6('s')} AS score FROM score WHERE item_id IN (
        SELECT item_id FROM views WHERE item_id >= 3 ORDER BY views DESC, item_id LIMIT 10)""",
    "slate_scores": f"SELECT user_id, t, pos, item_id, {r6('score')} AS score FROM slatescore",
    "slate_softmax": f"SELECT user_id, t, pos, {r6('prob')} AS prob FROM prob",
    "slate_loglik": f"""
      SELECT phase, {r6('sum(ll)')} AS loglik, {r6('sum(ll) / 0.5::DOUBLE')} AS tempered
      FROM stepll GROUP BY 1""",
    "mf_sampled_loglik": f"SELECT phase, {r6('sum(ll)')} AS loglik FROM mfll GROUP BY 1",
    "mf_scaled_loss": f"""
      SELECT b.phase, b.batch_id, {r6('-coalesce(sum(l.ll), 0) * (SELECT max(user_id) + 1 FROM users) / count(DISTINCT b.row_idx)', 4)} AS loss
      FROM (SELECT phase, row_idx, (row_number() OVER (PARTITION BY phase ORDER BY CASE WHEN phase = 'train'
              THEN {H('=batch', '=0', '=0', 'row_idx')} ELSE rk END, row_idx) - 1) // 100 AS batch_id
            FROM member) b LEFT JOIN mfll l ON l.row_idx = b.row_idx AND l.phase = b.phase GROUP BY 1, 2""",
    "prob_mae": f"""
      SELECT o.phase, {r6('sum(abs(p.prob - h.prob)) / count(DISTINCT (o.row_idx, o.t))')} AS prob_mae
      FROM observed o JOIN prob p ON p.row_idx = o.row_idx AND p.t = o.t
      JOIN hatprob h ON h.row_idx = p.row_idx AND h.t = p.t AND h.pos = p.pos GROUP BY 1""",
    "hier_log_prior": f"SELECT term, {r6('log_prior', 4)} AS log_prior FROM prior",
    "elbo_terms": f"""
      SELECT {r6('l', 4)} AS loglik, {r6('q - p', 4)} AS kl, {r6('l - (q - p)', 4)} AS elbo FROM
        (SELECT sum(ll) AS l FROM stepll WHERE phase = 'train'),
        (SELECT sum(log_prior) AS p FROM prior),
        (SELECT 64 * sum({pdf('0::DOUBLE', '0', 'scale')}) AS q FROM itemscale)""",
    "group_distance": f"""
      SELECT item_id, {r6('dist_vec')} AS dist_vec, {r6('dist_scale')} AS dist_scale FROM report""",
    # user profiles
    "profile_linear": f"SELECT user_id, t, {millionths('vec')} AS vec FROM state",
    "profile_markov": f"""
      SELECT b.user_id, b.t, coalesce({millionths('v.vec')}, repeat('0,', 63) || '0') AS vec
      FROM clicks_before b LEFT JOIN rc ON rc.row_idx = b.row_idx AND rc.k = b.n
      LEFT JOIN itemvec v ON v.id = rc.click""",
    "profile_start": f"""
      SELECT user_id, 'zero' AS kind, repeat('0,', 63) || '0' AS h0 FROM users
      UNION ALL SELECT id, 'normal', {millionths('vec')} FROM uservec
      UNION ALL SELECT id, 'compact_normal', {millionths('list(x ORDER BY r)')} FROM (
        SELECT u.id, w.r, sum(w.w * u.x) AS x FROM userdim u JOIN (
          SELECT g.r, h.d, {U('=start', 'g.r', 'h.d')} - 0.5::DOUBLE AS w
          FROM range(64) g(r) CROSS JOIN range(64) h(d)) w ON w.d = u.d GROUP BY 1, 2) GROUP BY id""",
    "amortized_start": f"""
      SELECT u.user_id, {millionths('list(coalesce(a.mean, 0) ORDER BY g.d)')} AS mean,
        {millionths('list(0.2::DOUBLE * sqrt(coalesce(a.spread, 0) + 1e-6) ORDER BY g.d)')} AS scale
      FROM users u CROSS JOIN range(64) g(d) LEFT JOIN (
        SELECT c.row_idx, c.d, sum(c.w * c.x) AS mean,
          sum(c.v * (c.x - c.centre) * (c.x - c.centre)) AS spread FROM (
          SELECT s.row_idx, v.d, v.x, s.w, s.v, sum(v.x) OVER (PARTITION BY s.row_idx, v.d) / s.n AS centre
          FROM (SELECT row_idx, click, count(*) OVER (PARTITION BY row_idx) AS n, raw / (sum(raw) OVER (PARTITION BY row_idx) + 1e-5) AS w,
                  pos / (sum(pos) OVER (PARTITION BY row_idx) + 1e-5) AS v FROM (
                  SELECT row_idx, click, pos, CASE WHEN mask_type = 1 THEN pos / (pow(
                    sum(pos) OVER (PARTITION BY row_idx ORDER BY t), 0.7::DOUBLE) + 1e-5) ELSE 0 END AS raw
                  FROM (SELECT s.row_idx, s.t, s.click, CAST(s.click > 3 AS INT)::DOUBLE AS pos, m.mask_type
                        FROM step s JOIN mask m ON m.row_idx = s.row_idx AND m.t = s.t))) s
          JOIN itemdim v ON v.id = s.click) c GROUP BY 1, 2) a
      ON a.row_idx = u.row_idx AND a.d = g.d GROUP BY 1""",
    "profile_gru": f"SELECT user_id, t, {millionths('z')} AS vec FROM grustate",
    "profile_linear_gru": f"""
      SELECT g.user_id, g.t, {millionths('list_transform(list_zip(g.z, s.vec), lambda p: (p[1] + p[2]) * 0.5::DOUBLE)')} AS vec
      FROM grustate g JOIN state s ON s.row_idx = g.row_idx AND s.t = g.t""",
    # top-k
    "topk_items": f"SELECT user_id, item_id, rank, {r6('s')} AS score FROM top20",
    "topk_targets": f"""
      SELECT user_id, item_id, rank, {r6('s')} AS score FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS INT) AS rank FROM score
        WHERE item_id IN (SELECT item_id FROM views WHERE item_id >= 3 ORDER BY views DESC, item_id LIMIT 500))
      WHERE rank <= 20""",
    "topk_at_step": f"""
      SELECT user_id, item_id, rank, {r6('s')} AS score FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS INT) AS rank FROM (
          SELECT q.user_id, v.id AS item_id, list_dot_product(q.vec, v.vec) AS s
          FROM state q CROSS JOIN itemvec v WHERE q.t = 5)) WHERE rank <= 20""",
    "topk_over_time": f"""
      SELECT b.user_id, b.t, item_id, rank, {r6('s')} AS score FROM clicks_before b JOIN (
        SELECT *, CAST(row_number() OVER (PARTITION BY row_idx, n ORDER BY s DESC, item_id) AS INT) AS rank FROM (
          SELECT q.row_idx, q.n, v.id AS item_id, -sqrt(greatest(list_dot_product(q.vec, q.vec)
            - 2 * list_dot_product(q.vec, v.vec) + list_dot_product(v.vec, v.vec), 1e-10)) AS s
          FROM state_vec q CROSS JOIN itemvec v)) r ON r.row_idx = b.row_idx AND r.n = b.n WHERE rank <= 5""",
    "topk_inslate_thompson": f"""
      SELECT user_id, item_id, CAST(rank AS INT) AS rank FROM (
        SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY min(r * 5 + draw)) AS rank
        FROM (SELECT u.user_id, v.id AS item_id, v.draw, row_number() OVER (PARTITION BY u.user_id, v.draw
                ORDER BY list_dot_product(u.vec, v.vec) DESC, v.id) AS r
              FROM drawnstate u JOIN drawnvec v ON v.draw = u.draw
              QUALIFY r <= 5) GROUP BY 1, 2) WHERE rank <= 5""",
    "rank_from_order": """
      SELECT item_id, CASE WHEN item_id < 3 THEN 0 ELSE row_number() OVER (
        PARTITION BY item_id < 3 ORDER BY views DESC, item_id) - 1 END AS rank FROM views""",
    "category_report": """
      SELECT row_idx, line, """ + ", ".join(
        f"max(CASE WHEN t = {t} THEN label END) AS t{t}" for t in range(10)) + """
      FROM (
        SELECT row_idx, t, 'slate type' AS line, ['undefined', 'search', 'recommendation'][interaction_type + 1] AS label
        FROM step
        UNION ALL SELECT s.row_idx, s.t, 'click', n.category_name FROM step s JOIN item_name n ON n.item_id = s.click
        UNION ALL SELECT x.row_idx, x.t, 'rec item ' || (x.r - 1), n.category_name FROM (
          SELECT b.row_idx, b.t, y.id, y.r FROM clicks_before b JOIN (
            SELECT row_idx, n, id, row_number() OVER (PARTITION BY row_idx, n ORDER BY s DESC, id) AS r FROM (
              SELECT q.row_idx, q.n, v.id, list_dot_product(q.vec, v.vec) AS s
              FROM state_vec q CROSS JOIN itemvec v
              UNION ALL SELECT q.row_idx, q.n, g.i, 0 FROM state_vec q CROSS JOIN range(3) g(i))
            QUALIFY r <= 2) y ON y.row_idx = b.row_idx AND y.n = b.n) x JOIN item_name n ON n.item_id = x.id)
      WHERE t < 10 GROUP BY 1, 2""",
    "recs_in_external_list": """
      SELECT a.user_id, count(b.item_id) AS n FROM top20 a LEFT JOIN top20l2 b
      ON b.row_idx = a.row_idx AND b.item_id = a.item_id GROUP BY 1""",
    # evaluation
    "hitrate": f"""
      SELECT CAST(sum(h) AS BIGINT) AS hits, count(*) AS users, {r6('sum(h) / count(*)')} AS hitrate FROM (
        SELECT s.row_idx, (SELECT count(DISTINCT i.click) FROM interaction i JOIN top20 r
          ON r.row_idx = i.row_idx AND r.item_id = i.click
          WHERE i.row_idx = s.row_idx AND i.t >= 5 AND NOT EXISTS (SELECT 1 FROM interaction o
            WHERE o.row_idx = i.row_idx AND o.t < 5 AND o.click = i.click))::BIGINT AS h
        FROM split s WHERE s.split = 'test')""",
    "hitrate_by_phase": f"""
      SELECT s.split AS phase, {r6('avg(coalesce(h.n, 0))')} AS hitrate FROM split s LEFT JOIN (
        SELECT q.row_idx, count(DISTINCT i.click) AS n FROM (
          SELECT q.row_idx, v.id FROM state q CROSS JOIN itemvec v WHERE q.t = 5
          QUALIFY row_number() OVER (PARTITION BY q.row_idx
            ORDER BY list_dot_product(q.vec, v.vec) DESC, v.id) <= 20) q
        JOIN interaction i ON i.row_idx = q.row_idx AND i.click = q.id AND i.t > 5 GROUP BY 1) h
      ON h.row_idx = s.row_idx GROUP BY 1""",
    "reward_by_step": f"""
      SELECT phase, t, {r6('reward')} AS reward FROM reward
      UNION ALL SELECT phase, CAST(-1 AS INT), {r6('avg(reward)')} FROM reward GROUP BY phase""",
    "footrule": f"""
      SELECT s.split AS phase, {r6('avg(coalesce(d.gap, 0) / 420::DOUBLE)')} AS footrule FROM split s LEFT JOIN (
        SELECT row_idx, sum(abs(coalesce(a.rank, 21) - coalesce(b.rank, 21))) AS gap
        FROM lasttop a FULL JOIN lasttophat b USING (row_idx, id) GROUP BY 1) d ON d.row_idx = s.row_idx GROUP BY 1""",
    # model fitting
    "mf_init": f"""
      SELECT 'user' AS name, id, {millionths('vec')} AS vec FROM mfuser
      UNION ALL SELECT 'item', CAST(id AS BIGINT), {millionths('vec')} FROM mfitem""",
    "mf_gradient": f"""
      SELECT name, CAST(id AS BIGINT) AS id, {millionths('list(x ORDER BY d)')} AS vec FROM (
        SELECT 'user' AS name, user_id AS id, g.d, sum(q * vec[g.d + 1]) AS x
        FROM mfcand CROSS JOIN range(9) g(d) GROUP BY 2, 3
        UNION ALL SELECT 'item', item_id, g.d, sum(q * z[g.d + 1])
        FROM mfcand CROSS JOIN range(9) g(d) GROUP BY 2, 3) GROUP BY 1, 2""",
}

BODIES["mf_fit"] = " UNION ALL ".join(
    f"""SELECT CAST({e} AS INT) AS epoch, {r6(f'(SELECT sum(ll) FROM tr{e}q WHERE c = 0)', 4)} AS train_loglik,
      {r6(f'(SELECT sum(ll) FROM va{e}q WHERE c = 0)', 4)} AS valid_loglik""" for e in range(MF_EPOCHS))

# definitions only some queries need
EXTRA = {
    "random_recommender": f"""
floyd AS (
  SELECT user_id, n_items - 2 - 24 AS j, CAST([] AS BIGINT[]) AS s FROM users CROSS JOIN widths
  UNION ALL
  SELECT user_id, j + 1, list_append(s, CASE WHEN list_contains(s, d) THEN j ELSE d END) FROM (
    SELECT user_id, j, s, {H('=rand', '=0', 'user_id', 'j')} % (j + 1) AS d FROM floyd CROSS JOIN widths
    WHERE j < n_items - 2))
""",
    "topk_inslate_thompson": f"""
drawn AS (
  SELECT v.id, g.draw, v.d, v.x + s.scale * {N('=post', '=0', '=item', 'g.draw', 'v.id', 'v.d')} AS x
  FROM itemdim v JOIN itemscale s ON s.id = v.id CROSS JOIN range(5) g(draw)),
drawnvec AS (SELECT id, draw, list(x ORDER BY d) AS vec FROM drawn GROUP BY 1, 2),
lastlevel AS (SELECT row_idx, max(n) AS n FROM levels GROUP BY 1),
drawnstate AS (
  SELECT u.row_idx, u.id AS user_id, g.draw,
    list(pow(0.8::DOUBLE, l.n) * u.x + coalesce(p.x, 0) ORDER BY u.d) AS vec
  FROM userdim u JOIN lastlevel l ON l.row_idx = u.row_idx CROSS JOIN range(5) g(draw) LEFT JOIN (
    SELECT rc.row_idx, v.draw, v.d, sum(0.2::DOUBLE * pow(0.8::DOUBLE, l.n - rc.k) * v.x) AS x
    FROM rc JOIN lastlevel l ON l.row_idx = rc.row_idx JOIN drawn v ON v.id = rc.click GROUP BY ALL) p
  ON p.row_idx = u.row_idx AND p.draw = g.draw AND p.d = u.d GROUP BY 1, 2, 3)
""",
    "profile_gru": _gru(gru_weights()),
    "profile_linear_gru": _gru(gru_weights()),
    "mf_fit": _fit(MF_EPOCHS, MF_RATE),
    "footrule": f"lasttop AS ({_last_top('state', 'itemvec')}), lasttophat AS ({_last_top('hatstate', 'itemhat')})",
}

ORACLES = {
    name: f"WITH RECURSIVE {BASE}, {EXTRA.get(name, WIDE)} {body}" for name, body in BODIES.items()
}
