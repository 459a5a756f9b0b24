"""The same queries in plain SQL, written directly from the definitions."""

from __future__ import annotations

from catalog.inputs import MULTI, SINGLE

_RUNS = ", ".join(
    f"('{p}_seed{s}', '{p}', {s}, {q})"
    for p, q in (("multi", 85), ("single", 82))
    for s in (42, 123, 456, 789, 2024)
)

_ORDER_TRUTH = """
truth AS (
  SELECT o_orderkey AS row_idx, 'priority' AS task, 5 AS k,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS y_true FROM orders
  UNION ALL
  SELECT o_orderkey, 'status', 3,
         CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END FROM orders)"""

_EVENT_TRUTH = """
truth AS (
  SELECT event_id AS row_idx, 'event' AS task, 5 AS k,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                         WHEN 'signup' THEN 3 ELSE 4 END AS y_true FROM events)"""

_DOC_TRUTH = """
truth AS (
  SELECT doc_id AS row_idx, 'lang' AS task, 4 AS k,
         CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS y_true
  FROM documents)"""

_DOC_TRUTH_JOINT = """
truth AS (
  SELECT doc_id AS row_idx, 'lang' AS task, 4 AS k,
         CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS y_true
  FROM documents
  UNION ALL
  SELECT doc_id, 'half', 2, CAST(substr(source, 4) AS INTEGER) % 2 FROM documents)"""

_PREDICTIONS = f"""
all_runs AS (SELECT * FROM (VALUES {_RUNS}) AS v(run, prefix, seed, quality)),
mixed AS (
  SELECT r.run, r.prefix, r.seed, r.quality, t.*,
         CAST('0x' || substr(md5('|' || r.run || '|' || t.task || '|' || CAST(t.row_idx AS VARCHAR)),
                             1, 15) AS BIGINT) AS h
  FROM truth t CROSS JOIN all_runs r),
predictions AS (
  SELECT run, prefix, seed, 'test' AS split, row_idx, task, y_true,
    CASE WHEN h % 256 = 0 THEN NULL
         WHEN (h >> 40) % 100 < quality THEN y_true
         ELSE CAST((y_true + 1 + (h >> 24) % 65536 % (k - 1)) % k AS INTEGER) END AS y_pred,
    (h >> 8) % 65536 % 10000 / CAST(10000 AS DOUBLE) AS confidence
  FROM mixed)"""

_CELLS = """
cells AS (
  SELECT run, task, y_true, y_pred, count(*) AS n FROM predictions
  WHERE y_true IS NOT NULL GROUP BY run, task, y_true, y_pred)"""

# Per-class figures straight from the predictions, class by class.
_PER_CLASS = """
seen AS (
  SELECT DISTINCT run, task, y_true AS class FROM predictions
  UNION SELECT DISTINCT run, task, y_pred FROM predictions WHERE y_pred IS NOT NULL),
counted AS (
  SELECT s.run, s.task, s.class,
         count(*) FILTER (WHERE p.y_true = s.class AND p.y_pred = s.class) AS tp,
         count(*) FILTER (WHERE p.y_true = s.class) AS support,
         count(*) FILTER (WHERE p.y_pred = s.class) AS predicted
  FROM seen s JOIN predictions p ON p.run = s.run AND p.task = s.task
  GROUP BY s.run, s.task, s.class),
per_class AS (
  SELECT *,
    CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision_,
    CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall_,
    CAST(2 * tp AS DOUBLE) / (support + predicted) AS f1
  FROM counted)"""

_METRICS = """
metrics AS (
  SELECT run, task, CAST(sum(support) AS BIGINT) AS n,
         CAST(sum(support) - sum(tp) AS BIGINT) AS errors,
         CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
         avg(f1) AS macro_f1,
         sum(f1 * support) / sum(support) AS weighted_f1
  FROM per_class GROUP BY run, task)"""

_ORDER_LABELS = """
long AS (
  SELECT o_orderkey AS row_idx, 'status' AS task, o_orderstatus AS label FROM orders
  UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders)"""

_DOC_LABELS = """
long AS (
  SELECT doc_id AS row_idx, 'lang' AS task, lang AS label FROM documents
  UNION ALL SELECT doc_id, 'source', source FROM documents
  UNION ALL SELECT doc_id, 'quality', CAST(quality AS VARCHAR) FROM labels
  UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels)"""

_ENCODER = """
encoder AS (
  SELECT task, CAST(row_number() OVER (PARTITION BY task ORDER BY label) - 1 AS INTEGER) AS class_id,
         label AS class_name
  FROM (SELECT DISTINCT task, label FROM long WHERE label IS NOT NULL))"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


_ORDER_METRICS = _with(_ORDER_TRUTH, _PREDICTIONS, _PER_CLASS, _METRICS)
_ORDER_CELLS = _with(_ORDER_TRUTH, _PREDICTIONS, _CELLS)


def _split(table: str, key: str, strata: str, seed: int) -> str:
    """Quotas by largest remainder, rows by hash rank; 80 / 10 / 10."""
    return f"""
sizes AS (SELECT {strata} AS stratum, count(*) AS n FROM {table} GROUP BY {strata}),
totals AS (SELECT CAST(sum(n) AS BIGINT) AS n,
                  CAST(ceil(round(sum(n) * 0.2, 6)) AS BIGINT) AS held FROM sizes),
shares AS (SELECT s.stratum, s.n, s.n * (t.n - t.held) // t.n AS base,
                  s.n * (t.n - t.held) % t.n AS rem, t.n - t.held AS draws
           FROM sizes s CROSS JOIN totals t),
train_q AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, stratum)
                     <= draws - sum(base) OVER () THEN 1 ELSE 0 END AS train FROM shares),
held AS (SELECT *, n - train AS m, sum(n - train) OVER () AS total FROM train_q),
held2 AS (SELECT *, total - CAST(ceil(round(total * 0.5, 6)) AS BIGINT) AS draws2 FROM held),
shares2 AS (SELECT *, m * draws2 // total AS base2, m * draws2 % total AS rem2 FROM held2),
quotas AS (SELECT stratum, train,
             train + base2 + CASE WHEN row_number() OVER (ORDER BY rem2 DESC, stratum)
                     <= draws2 - sum(base2) OVER () THEN 1 ELSE 0 END AS val FROM shares2),
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY {strata} ORDER BY
             CAST('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT),
             {key}) AS place FROM {table} d),
parted AS (SELECT r.*, CASE WHEN place <= q.train THEN 'train' WHEN place <= q.val THEN 'val'
                            ELSE 'test' END AS split
           FROM ranked r JOIN quotas q ON r.{strata} = q.stratum)"""


_SPLIT_DOCS = _split("documents", "doc_id", "lang", 7)


def _association(corrected: bool) -> str:
    tasks = ("status", "priority", "segment", "year")
    value = """sqrt(greatest(chi - 1, 0) / nullif(least(r, c) - 1, 0))"""
    if corrected:
        value = """sqrt(greatest(greatest(chi - 1, 0) - (r - 1) * (c - 1) / (n - 1.0), 0)
          / (least(r - (r - 1) * (r - 1) / (n - 1.0), c - (c - 1) * (c - 1) / (n - 1.0)) - 1))"""
    digits = 6 if corrected else 9
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS task_a, '{b}' AS task_b, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM base"
        for a in tasks
        for b in tasks
        if a != b
    )
    same = " UNION ALL ".join(
        f"SELECT '{a}', '{a}', 1.0::DOUBLE, count({a}) FROM base" for a in tasks
    )
    return f"""WITH base AS (
  SELECT o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment,
         year(o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey),
pairs AS ({pairs}),
cells AS (SELECT task_a, task_b, a, b, count(*) AS o FROM pairs GROUP BY ALL),
ra AS (SELECT task_a, task_b, a, sum(o) AS r FROM cells GROUP BY ALL),
cb AS (SELECT task_a, task_b, b, sum(o) AS c FROM cells GROUP BY ALL),
stats AS (
  SELECT cells.task_a, cells.task_b,
         sum(CAST(o AS DOUBLE) * o / (CAST(ra.r AS DOUBLE) * cb.c)) AS chi,
         CAST(sum(o) AS BIGINT) AS n, count(DISTINCT cells.a)::DOUBLE AS r,
         count(DISTINCT cells.b)::DOUBLE AS c
  FROM cells JOIN ra USING (task_a, task_b, a) JOIN cb USING (task_a, task_b, b)
  GROUP BY ALL),
v AS (SELECT task_a, task_b, round({value}, {digits}) + 0.0 AS v, n FROM stats
      UNION ALL {same})
"""


# Replicates: a draw is a position in the profile order, the same for all runs of a scope.
_REPLICATES = 1000


def _resample(truth: str, prefixes: str, joint: bool) -> str:
    """Macro F1 per (task, b, run) on keyed draws."""
    wanted = f"SELECT * FROM predictions WHERE prefix IN ({prefixes})"
    order = "list(coalesce(y_pred, -1) ORDER BY ord)"
    runs = """(SELECT run, row_number() OVER (ORDER BY prefix, seed_no) AS ord FROM (
        SELECT run, prefix, CASE seed WHEN 42 THEN 1 WHEN 123 THEN 2 WHEN 456 THEN 3
               WHEN 789 THEN 4 ELSE 5 END AS seed_no FROM all_runs))"""
    if joint:
        profiles = f"""
profiles AS (
  SELECT '*' AS scope, row_idx,
         list_concat(max(code) FILTER (WHERE task = 'lang'), max(code) FILTER (WHERE task = 'half')) AS code
  FROM (SELECT task, row_idx, list_concat([min(y_true)], {order}) AS code
        FROM chosen GROUP BY task, row_idx) GROUP BY row_idx)"""
        key = "concat_ws('|', '0', CAST(b AS VARCHAR), CAST(k AS VARCHAR))"
        meet = "d.row_idx = p.row_idx"
    else:
        profiles = f"""
profiles AS (
  SELECT task AS scope, row_idx, list_concat([min(y_true)], {order}) AS code
  FROM chosen GROUP BY task, row_idx)"""
        key = "concat_ws('|', '0', scope, CAST(b AS VARCHAR), CAST(k AS VARCHAR))"
        meet = "d.row_idx = p.row_idx AND d.scope = p.task"
    return _with(
        truth,
        _PREDICTIONS,
        f" chosen AS (SELECT p.*, o.ord FROM ({wanted}) p JOIN {runs} o USING (run))",
        profiles,
        f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY
                    substr(md5(array_to_string(code, ',')), 1, 3), code, row_idx) - 1 AS at,
                  count(*) OVER (PARTITION BY scope) AS total FROM profiles),
draws AS (SELECT scope, b, CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT) % total AS at
          FROM (SELECT DISTINCT scope, total FROM placed) s,
               range({_REPLICATES}) AS bs(b), LATERAL (SELECT unnest(range(total)) AS k)),
drawn AS (SELECT d.scope, d.b, p.row_idx, count(*) AS times
          FROM draws d JOIN placed p ON d.scope = p.scope AND d.at = p.at GROUP BY ALL),
cells AS (SELECT p.task, d.b, p.run, p.prefix, p.y_true, p.y_pred, sum(d.times) AS n
          FROM drawn d JOIN chosen p ON {meet} GROUP BY ALL),
sides AS (SELECT task, b, run, prefix, y_true AS class, n AS support, 0 AS predicted,
                 CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM cells
          UNION ALL
          SELECT task, b, run, prefix, y_pred, 0, n, 0 FROM cells WHERE y_pred IS NOT NULL),
f1s AS (SELECT task, b, run, prefix, class,
               2.0::DOUBLE * sum(tp) / (sum(support) + sum(predicted)) AS f1
        FROM sides GROUP BY ALL),
scores AS (SELECT task, b, run, prefix, avg(f1) AS macro_f1 FROM f1s GROUP BY ALL)""",
    )


_DELTAS = """
deltas AS (SELECT task, b, round(avg(macro_f1) FILTER (WHERE prefix = 'multi')
                         - avg(macro_f1) FILTER (WHERE prefix = 'single'), 12) + 0.0 AS delta
           FROM scores GROUP BY task, b)"""

_MEAN_DELTAS = """
all_deltas AS (SELECT * FROM deltas
               UNION ALL SELECT 'Mean macro-F1', b, round(avg(delta), 12) + 0.0 FROM deltas GROUP BY b)"""


def _paired(source: str) -> str:
    return f"""
facts AS (SELECT task, avg(delta) AS delta,
    quantile_cont(delta, 0.025) AS low, quantile_cont(delta, 0.975) AS high,
    quantile_cont(delta, 0.05) AS tost_low, quantile_cont(delta, 0.95) AS tost_high,
    avg(CASE WHEN delta <= 0 THEN 1.0 ELSE 0.0 END) AS below,
    avg(CASE WHEN delta >= 0 THEN 1.0 ELSE 0.0 END) AS above,
    greatest(avg(CASE WHEN delta >= 0.02 THEN 1.0 ELSE 0.0 END),
             avg(CASE WHEN delta <= -0.02 THEN 1.0 ELSE 0.0 END)) AS tost_p,
    count(*) AS replicates FROM {source} GROUP BY task),
paired AS (SELECT task, round(delta, 9) + 0.0 AS delta, round(low, 9) + 0.0 AS low,
    round(high, 9) + 0.0 AS high,
    round(CASE WHEN delta > 0 THEN below ELSE above END, 9) + 0.0 AS p_one_sided,
    CASE WHEN CASE WHEN delta > 0 THEN below ELSE above END < 0.01 THEN '**'
         WHEN CASE WHEN delta > 0 THEN below ELSE above END < 0.05 THEN '*' ELSE '' END AS stars,
    round(least(1.0, 2 * least(below, above)), 9) + 0.0 AS p_two_sided,
    round(tost_low, 9) + 0.0 AS tost_low, round(tost_high, 9) + 0.0 AS tost_high,
    round(tost_p, 9) + 0.0 AS tost_p, tost_p < 0.05 AS equivalent, replicates FROM facts)"""


_BOTH = "'multi', 'single'"
_PAIRED_SQL = _resample(_DOC_TRUTH_JOINT, _BOTH, joint=False)
_PAIRED_MEAN_SQL = (
    _resample(_DOC_TRUTH_JOINT, _BOTH, joint=True).rstrip()
    + "," + _DELTAS + "," + _MEAN_DELTAS + "," + _paired("all_deltas") + "\nSELECT * FROM paired"
)

_SCORED = """
base AS (
  SELECT vec_id AS row_idx, embedding, label,
         unnest([{'task': 'ten', 'y': label}, {'task': 'two', 'y': label % 2},
                 {'task': 'three', 'y': label % 3}]) AS t FROM embeddings),
rows_ AS (SELECT row_idx, t.task AS task, t.y AS y_true, embedding FROM base),
parts AS (SELECT row_idx, task, y_true, unnest(embedding)::DOUBLE AS x,
                 generate_subscripts(embedding, 1) AS pos FROM rows_),
centres AS (SELECT task, y_true AS class_id, pos, avg(x) AS w FROM parts GROUP BY ALL),
bias AS (SELECT task, class_id, -sum(w * w) / 2 AS bias FROM centres GROUP BY ALL),
dots AS (SELECT p.row_idx, p.task, p.y_true, c.class_id, sum(p.x * c.w) AS dot
         FROM parts p JOIN centres c ON p.task = c.task AND p.pos = c.pos GROUP BY ALL),
logits AS (SELECT row_idx, task, y_true, class_id, dot + bias AS z
           FROM dots JOIN bias USING (task, class_id)),
peaks AS (SELECT row_idx, task, max(z) AS top FROM logits GROUP BY ALL),
norms AS (SELECT l.row_idx, l.task, any_value(p.top) + ln(sum(exp(z - p.top))) AS lse
          FROM logits l JOIN peaks p USING (row_idx, task) GROUP BY ALL),
logp AS (SELECT l.*, z - lse AS lp FROM logits l JOIN norms USING (row_idx, task))"""

_WEIGHTS = """
counts AS (SELECT task, y_true AS class_id, count(*) AS n FROM rows_ GROUP BY ALL),
weights AS (SELECT task, class_id, least(greatest(
    sum(n) OVER (PARTITION BY task) / CAST(count(*) OVER (PARTITION BY task) * n AS DOUBLE), 0.1), 10.0)
    AS weight FROM counts)"""

_WEIGHTED_CE = """
ce AS (SELECT row_idx, task,
         0.9 * sum(CASE WHEN class_id = y_true THEN -lp * weight ELSE 0 END)
         + 0.1 / count(*) * sum(-lp * weight) AS ce
       FROM logp JOIN weights USING (task, class_id) GROUP BY row_idx, task)"""

_PLAIN_FOCAL = """
losses AS (SELECT task, avg(pow(1 - exp(lp), 2.0) * -lp) AS loss, count(*) AS n
           FROM logp WHERE class_id = y_true GROUP BY task)"""

_KL = """
halved AS (SELECT row_idx, task, class_id, z * 0.5 AS z FROM logits),
peaks2 AS (SELECT row_idx, task, max(z) AS top FROM halved GROUP BY ALL),
norms2 AS (SELECT l.row_idx, l.task, any_value(p.top) + ln(sum(exp(z - p.top))) AS lse
           FROM halved l JOIN peaks2 p USING (row_idx, task) GROUP BY ALL),
logq AS (SELECT l.*, z - lse AS lq FROM halved l JOIN norms2 USING (row_idx, task)),
row_kl AS (SELECT row_idx, task,
             (sum(exp(lq) * (lq - lp)) + sum(exp(lp) * (lp - lq))) / 2 AS kl
           FROM logp JOIN logq USING (row_idx, task, class_id) GROUP BY ALL),
kl AS (SELECT task, avg(kl) AS kl, count(*) AS n FROM row_kl GROUP BY task)"""

_HISTORY = """
history AS (SELECT event_type AS run, day(ts) AS epoch, round(avg(value) / 100.0, 9) AS value
            FROM events GROUP BY ALL)"""

_STOPPING = """
marked AS (SELECT *, row_number() OVER w AS step,
    value > greatest(coalesce(max(value) OVER (PARTITION BY run ORDER BY epoch
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS improved
  FROM history WINDOW w AS (PARTITION BY run ORDER BY epoch)),
waiting AS (SELECT *, step - coalesce(max(CASE WHEN improved THEN step END) OVER
    (PARTITION BY run ORDER BY epoch), 0) AS waited,
    max(value) OVER (PARTITION BY run ORDER BY epoch) AS best_so_far FROM marked),
stops AS (SELECT run, min(epoch) AS stop_epoch FROM waiting WHERE waited >= 5 GROUP BY run)"""

_ERRORS = """
wrong AS (SELECT * FROM predictions WHERE y_true IS NOT NULL AND y_pred IS DISTINCT FROM y_true)"""

_AGG = """
with_prefix AS (SELECT DISTINCT m.*, r.prefix FROM metrics m JOIN all_runs r USING (run)),
values_ AS (SELECT prefix, task, macro_f1 FROM with_prefix
            UNION ALL SELECT prefix, 'MEAN_MACRO_F1', avg(macro_f1) FROM with_prefix
                      GROUP BY prefix, run),
agg AS (SELECT prefix, task, avg(macro_f1) AS mean, stddev_pop(macro_f1) AS std,
               min(macro_f1) AS lo, max(macro_f1) AS hi, count(*) AS n
        FROM values_ GROUP BY prefix, task),
pairs AS (SELECT task, max(mean) FILTER (WHERE prefix = 'multi') AS first_mean,
    max(std) FILTER (WHERE prefix = 'multi') AS first_std,
    max(mean) FILTER (WHERE prefix = 'single') AS second_mean,
    max(std) FILTER (WHERE prefix = 'single') AS second_std FROM agg GROUP BY task)"""


def r9(expression: str, name: str) -> str:
    return f"round({expression}, 9) + 0.0 AS {name}"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


_EVENT = _with(_EVENT_TRUTH, _PREDICTIONS, _CELLS, _PER_CLASS, _METRICS)

ORACLE: dict[str, str] = {
    "label_clean": """
WITH raw AS (
  SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN text END AS text,
    CASE doc_id % 4 WHEN 0 THEN chr(9) || lang || chr(9) WHEN 1 THEN ' ' || lang || ' '
      WHEN 2 THEN '  ' || lang || '  '
      ELSE chr(13) || chr(10) || ' ' || lang || chr(13) || chr(10) || ' ' END AS lang,
    CASE doc_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN ' FALSE' WHEN 2 THEN 'True' || chr(9)
                    WHEN 3 THEN 'maybe' END AS flag FROM documents),
clean AS (
  SELECT doc_id, text, regexp_replace(lang, '^\\s+|\\s+$', '', 'g') AS lang,
    CASE upper(regexp_replace(flag, '^\\s+|\\s+$', '', 'g'))
      WHEN 'TRUE' THEN 'List' WHEN 'FALSE' THEN 'Single' END AS flag FROM raw)
SELECT doc_id, lang, flag, length(text) AS chars FROM clean
WHERE text IS NOT NULL AND lang IS NOT NULL AND flag IS NOT NULL""",
    "labels_long": _with(_ORDER_LABELS) + "SELECT * FROM long",
    "encoder_fit": """
WITH long AS (
  SELECT 'status' AS task, o_orderstatus AS label FROM orders
  UNION ALL SELECT 'priority', o_orderpriority FROM orders
  UNION ALL SELECT 'segment', c_mktsegment FROM customer),""" + _ENCODER + "\nSELECT * FROM encoder",
    "encode_decode": _with(_ORDER_LABELS, _ENCODER) + """
SELECT row_idx, task, class_id, class_name FROM long JOIN encoder USING (task)
WHERE label = class_name""",
    "encode_wide": _with(_ORDER_LABELS, _ENCODER) + """
SELECT o_orderkey, s.class_id AS status_encoded, p.class_id AS priority_encoded FROM orders
JOIN encoder s ON s.task = 'status' AND s.class_name = o_orderstatus
JOIN encoder p ON p.task = 'priority' AND p.class_name = o_orderpriority""",
    "num_classes": _with(_DOC_LABELS)
    + "SELECT task, count(DISTINCT label) AS num_classes FROM long GROUP BY task",
    "stratified_split": "WITH "
    + _split("orders", "o_orderkey", "o_orderpriority", 42)
    + "\nSELECT o_orderkey, split FROM parted",
    "stratified_split_skewed": "WITH " + _SPLIT_DOCS + "\nSELECT doc_id, split FROM parted",
    "split_info": "WITH " + _SPLIT_DOCS + """
SELECT 7 AS seed, count(*) AS total, count(*) FILTER (WHERE split = 'train') AS train,
  count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test,
  round(100.0::DOUBLE * count(*) FILTER (WHERE split = 'train') / count(*), 1) AS train_pct,
  round(100.0::DOUBLE * count(*) FILTER (WHERE split = 'val') / count(*), 1) AS val_pct,
  round(100.0::DOUBLE * count(*) FILTER (WHERE split = 'test') / count(*), 1) AS test_pct,
  'lang' AS stratify_on, 'lang,source' AS columns FROM parted""",
    "class_counts": _with(_DOC_LABELS) + """
SELECT task, label, count(*) AS n FROM long WHERE label IS NOT NULL GROUP BY task, label""",
    "imbalance": "WITH " + _SPLIT_DOCS + """,
long AS (SELECT 'lang' AS task, lang AS label FROM parted WHERE split = 'train'
         UNION ALL SELECT 'source', source FROM parted WHERE split = 'train'),
counts AS (SELECT task, label, count(*) AS n FROM long GROUP BY ALL),
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n, label) AS place,
                   max(n) OVER (PARTITION BY task) AS max_count FROM counts)
SELECT task, label AS min_class, n AS min_count, max_count,
  round(CAST(max_count AS DOUBLE) / n, 9) + 0.0 AS ratio,
  CASE WHEN max_count > 20 * n THEN 'SEVERE' WHEN max_count > 5 * n THEN 'MODERATE' ELSE '' END AS flag
FROM ranked2 WHERE place = 1""",
    "class_weights": _with(_DOC_LABELS) + """
, counts AS (SELECT task, label, count(*) AS n FROM long WHERE label IS NOT NULL GROUP BY ALL)
SELECT task, label, n, round(least(greatest(
  sum(n) OVER (PARTITION BY task) / CAST(count(*) OVER (PARTITION BY task) * n AS DOUBLE), 0.1), 10.0), 9)
  + 0.0 AS weight FROM counts""",
    "confusion_sparse": _ORDER_CELLS + "SELECT * FROM cells",
    "confusion_dense": _ORDER_CELLS.rstrip() + "," + _ORDER_LABELS + "," + _ENCODER + """
SELECT r.run, t.task, t.class_id AS y_true, p.class_id AS y_pred, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT run FROM predictions) r CROSS JOIN encoder t
JOIN encoder p ON p.task = t.task
LEFT JOIN cells c ON c.run = r.run AND c.task = t.task AND c.y_true = t.class_id
                  AND c.y_pred = p.class_id""",
    "confusion_wide": _with(_EVENT_TRUTH, _PREDICTIONS) + """
SELECT run, task, y_true,"""
    + ", ".join(f"count(*) FILTER (WHERE y_pred = {c}) AS pred_{c}" for c in range(5))
    + " FROM predictions GROUP BY run, task, y_true",
    "rejected_rows": _with(_ORDER_TRUTH, _PREDICTIONS) + """
SELECT run, task, count(*) AS rejected FROM predictions WHERE row_idx % 7 = 0 GROUP BY run, task""",
    "per_class": _with(_ORDER_TRUTH, _PREDICTIONS, _PER_CLASS)
    + f"""SELECT run, task, class, tp, support, predicted, {r9('precision_', 'precision')},
{r9('recall_', 'recall')}, {r9('f1', 'f1')} FROM per_class""",
    "accuracy": _with(_ORDER_TRUTH, _PREDICTIONS) + """
SELECT run, task, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS accuracy
FROM predictions GROUP BY run, task""",
    "macro_f1": _EVENT + f"SELECT run, task, {r9('macro_f1', 'macro_f1')} FROM metrics",
    "macro_f1_all_classes": _with(
        _ORDER_TRUTH,
        _PREDICTIONS.replace("predictions AS", "everything AS"),
        """
predictions AS (SELECT * FROM everything WHERE task = 'status' AND y_true <> 2
                AND (y_pred IS NULL OR y_pred <> 2))""",
        _PER_CLASS,
    )
    + """SELECT run, task, round(sum(f1) / (SELECT count(DISTINCT o_orderstatus) FROM orders), 9) + 0.0
  AS macro_f1 FROM per_class GROUP BY run, task""",
    "weighted_f1": _with(_DOC_TRUTH, _PREDICTIONS, _PER_CLASS, _METRICS)
    + f"SELECT run, task, {r9('weighted_f1', 'weighted_f1')} FROM metrics",
    "report": _with(_ORDER_TRUTH, _PREDICTIONS, _PER_CLASS, _METRICS, _ORDER_LABELS, _ENCODER) + """
, lines AS (
SELECT run, p.task, class_name AS label, precision_ AS precision, recall_ AS recall, f1,
       CAST(support AS DOUBLE) AS support
FROM per_class p JOIN encoder e ON e.task = p.task AND e.class_id = p.class
UNION ALL SELECT run, task, 'accuracy', accuracy, accuracy, accuracy, accuracy FROM metrics
UNION ALL SELECT run, task, 'macro avg', avg(precision_), avg(recall_), avg(f1),
                 CAST(sum(support) AS DOUBLE) FROM per_class GROUP BY run, task
UNION ALL SELECT run, task, 'weighted avg', sum(precision_ * support) / sum(support),
                 sum(recall_ * support) / sum(support), sum(f1 * support) / sum(support),
                 CAST(sum(support) AS DOUBLE) FROM per_class GROUP BY run, task)
SELECT run, task, label, round(precision, 9) + 0.0 AS precision, round(recall, 9) + 0.0 AS recall,
       round(f1, 9) + 0.0 AS f1, round(support, 9) + 0.0 AS support FROM lines""",
    "mean_macro_f1": _ORDER_METRICS
    + f"SELECT run, {r9('avg(macro_f1)', 'mean_macro_f1')} FROM metrics GROUP BY run",
    "evaluate": _ORDER_METRICS
    + f"""SELECT run, task, n, errors, {r9('accuracy', 'accuracy')}, {r9('macro_f1', 'macro_f1')},
{r9('weighted_f1', 'weighted_f1')} FROM metrics
UNION ALL SELECT run, 'MEAN', CAST(sum(n) AS BIGINT), CAST(sum(errors) AS BIGINT),
{r9('avg(accuracy)', 'accuracy')}, {r9('avg(macro_f1)', 'macro_f1')},
{r9('avg(weighted_f1)', 'weighted_f1')} FROM metrics GROUP BY run""",
    "per_class_lists": _EVENT
    + f"""SELECT m.run, m.task, n, errors, {r9('accuracy', 'accuracy')},
{r9('macro_f1', 'macro_f1')}, {r9('weighted_f1', 'weighted_f1')}, l.position, {r9('l.f1', 'f1')}
FROM metrics m JOIN (SELECT run, task, f1,
  CAST(row_number() OVER (PARTITION BY run, task ORDER BY class) - 1 AS INTEGER) AS position
  FROM per_class) l ON l.run = m.run AND l.task = m.task""",
    "bootstrap_law": _with(_ORDER_TRUTH, _PREDICTIONS) + """
SELECT task, run, CAST(1000 AS BIGINT) AS replicates, count(*) AS n, count(*) AS least_drawn, count(*) AS most_drawn,
  round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy, true AS inside, true AS spread_fits
FROM predictions WHERE prefix = 'multi' AND y_true IS NOT NULL GROUP BY task, run""",
    "errors_first_k": _with(_DOC_TRUTH, _PREDICTIONS, _ERRORS) + """
, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, task ORDER BY row_idx) AS INTEGER)
             AS place FROM wrong)
SELECT run, task, row_idx, y_true, y_pred, place, text
FROM ranked JOIN documents ON doc_id = row_idx WHERE place <= 20""",
    "errors_by_confidence": _with(_DOC_TRUTH, _PREDICTIONS, _ERRORS) + """
SELECT run, task, row_idx,
  list_extract(['de', 'en', 'es', 'fr'], y_true + 1) AS true_label,
  list_extract(['de', 'en', 'es', 'fr'], y_pred + 1) AS pred_label,
  round(confidence, 9) + 0.0 AS confidence, length(text) AS chars
FROM wrong JOIN documents ON doc_id = row_idx""",
    "errors_top_k": _with(_ORDER_TRUTH, _PREDICTIONS, _ERRORS) + """
SELECT run, task, row_idx, y_true, y_pred, round(confidence, 9) + 0.0 AS confidence
FROM wrong ORDER BY confidence DESC, run, task, row_idx LIMIT 100""",
    "run_names": _with(_ORDER_TRUTH, _PREDICTIONS)
    + "SELECT run, prefix, seed, count(*) AS n FROM predictions GROUP BY ALL",
    "seed_aggregate": _ORDER_METRICS.rstrip() + "," + _AGG
    + f"""\nSELECT prefix, task, {r9('mean', 'mean')}, {r9('std', 'std')}, {r9('lo', 'min')},
{r9('hi', 'max')}, n FROM agg""",
    "comparison": _ORDER_METRICS.rstrip() + "," + _AGG
    + f"""\nSELECT task, {r9('first_mean', 'first_mean')}, {r9('first_std', 'first_std')},
{r9('second_mean', 'second_mean')}, {r9('second_std', 'second_std')},
{r9('first_mean - second_mean', 'delta_mean')} FROM pairs""",
    "comparison_text": _ORDER_METRICS.rstrip() + "," + _AGG + """
SELECT task,
  format('{:.4f}', round(first_mean, 9)) || ' ± ' || format('{:.4f}', round(first_std, 9)) AS first,
  format('{:.4f}', round(second_mean, 9)) || ' ± ' || format('{:.4f}', round(second_std, 9)) AS second
FROM pairs""",
    "leaderboard": _ORDER_METRICS.rstrip() + """,
means AS (SELECT run, avg(macro_f1) AS m, count(*) AS tasks FROM metrics GROUP BY run)
SELECT rank() OVER (ORDER BY m DESC) AS place, run, round(m, 9) + 0.0 AS mean_macro_f1, tasks,
       round(m - max(m) OVER (), 9) + 0.0 AS delta FROM means""",
    "missing_baseline": _with(_ORDER_TRUTH, _PREDICTIONS) + """
SELECT DISTINCT task FROM (SELECT 'status' AS task FROM orders UNION SELECT 'priority' FROM orders)
WHERE task NOT IN (SELECT task FROM predictions
  WHERE prefix = 'single' AND split = 'test' AND (prefix <> 'single' OR task = 'status'))""",
    "best_epoch": _with(_HISTORY) + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, epoch) AS place
             FROM history WHERE value > 0)
SELECT run, epoch AS best_epoch, round(value, 9) + 0.0 AS best FROM ranked WHERE place = 1""",
    "early_stopping": _with(_HISTORY, _STOPPING) + """
SELECT w.run, epoch, round(value, 9) + 0.0 AS value, improved,
       round(best_so_far, 9) + 0.0 AS best_so_far, waited,
       coalesce(epoch = stop_epoch, false) AS stop
FROM waiting w LEFT JOIN stops s ON s.run = w.run""",
    "stopping_summary": _with(_HISTORY, _STOPPING) + """
SELECT w.run, any_value(stop_epoch) AS stop_epoch,
       max(CASE WHEN improved THEN epoch END) AS best_epoch, round(max(value), 9) + 0.0 AS best
FROM waiting w LEFT JOIN stops s ON s.run = w.run
WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY w.run""",
    "epoch_loss": """
SELECT event_type AS run, day(ts) AS epoch, round(avg(value), 9) + 0.0 AS train_loss,
       count(value) AS batches FROM events GROUP BY ALL""",
    "cost_ratio": """
WITH costs AS (SELECT r_name AS setup, count(*) AS units, sum(s_acctbal) AS cost
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name), ref AS (SELECT * FROM costs WHERE setup = 'ASIA')
SELECT c.setup, c.units, round(c.cost, 4) + 0.0 AS cost,
       round(CAST(c.units AS DOUBLE) / ref.units, 4) + 0.0 AS units_ratio,
       round(c.cost / ref.cost, 4) + 0.0 AS cost_ratio
FROM costs c LEFT JOIN ref ON true""",
    "cramers_v": _association(False) + "SELECT * FROM v",
    "cramers_v_corrected": _association(True) + "SELECT * FROM v",
    "association_matrix": _association(False) + "SELECT task_a AS task, "
    + ", ".join(
        f"max(v) FILTER (WHERE task_b = '{t}') AS {t}"
        for t in ("status", "priority", "segment", "year")
    )
    + " FROM v GROUP BY task_a",
    "bootstrap_draws": """
WITH sizes AS (SELECT lang AS scope, count(*) AS total FROM documents GROUP BY lang),
draws AS (SELECT scope, CAST(b AS INTEGER) AS b,
            CAST('0x' || substr(md5(concat_ws('|', '3', scope, CAST(b AS VARCHAR), CAST(k AS VARCHAR))), 1, 15)
                 AS BIGINT) % total AS pos
          FROM sizes, range(20) AS bs(b), LATERAL (SELECT unnest(range(total)) AS k))
SELECT scope, b, pos AS "at", count(*) AS times FROM draws GROUP BY scope, b, pos""",
    "bootstrap_ci": _resample(_DOC_TRUTH, "'multi'", joint=False).rstrip() + """,
means AS (SELECT task, b, avg(macro_f1) AS score FROM scores GROUP BY task, b)
SELECT task, round(avg(score), 9) + 0.0 AS mean, round(quantile_cont(score, 0.025), 9) + 0.0 AS low,
       round(quantile_cont(score, 0.975), 9) + 0.0 AS high, count(*) AS replicates
FROM means GROUP BY task""",
    "interval_law": _with(_DOC_TRUTH, _PREDICTIONS, _PER_CLASS, _METRICS) + """,
of_runs AS (SELECT task, prefix, avg(macro_f1) AS score FROM metrics JOIN (SELECT DISTINCT run, prefix FROM all_runs) USING (run) GROUP BY ALL),
estimates AS (
  SELECT task, max(score) FILTER (prefix = 'multi') AS interval_, max(score) FILTER (prefix = 'multi') - max(score) FILTER (prefix = 'single') AS paired
  FROM of_runs GROUP BY task)
SELECT task, kind, CAST(1000 AS BIGINT) AS replicates, round(estimate, 9) AS estimate, true AS inside, true AS centred, true AS width_fits
FROM (SELECT task, 'interval' AS kind, interval_ AS estimate FROM estimates UNION ALL SELECT task, 'paired', paired FROM estimates)""",
    "paired_bootstrap": _PAIRED_SQL.rstrip() + "," + _DELTAS + "," + _paired("deltas")
    + "\nSELECT * FROM paired",
    "paired_mean": _PAIRED_MEAN_SQL,
    "significance_text": _PAIRED_SQL.rstrip() + "," + _DELTAS + "," + _paired("deltas") + """
SELECT task, round(delta, 4) AS delta,
  printf('[%+.3f, %+.3f]', low, high) AS ci95, round(p_two_sided, 3) AS paired_p,
  printf('[%+.3f, %+.3f]', tost_low, tost_high) AS ci90, round(tost_p, 3) AS tost_p, equivalent
FROM paired""",
    "score_heads": _with(_SCORED)
    + f"SELECT row_idx, task, class_id, {r6('z', 'logit')} FROM logits",
    "predict_blocks": "WITH rows_ AS (SELECT vec_id AS row_idx, 'many' AS task, vec_id % 97 AS y_true, embedding FROM embeddings),\nparts AS"
    + _SCORED.split("parts AS", 1)[1] + f"""
SELECT row_idx, any_value(task) AS task, (min(class_id) FILTER (lp = best))::INTEGER AS y_pred, {r9('exp(max(lp))', 'confidence')},
  {r9('max(lse)', 'log_sum')}, {r9('-max(lp) FILTER (class_id = y_true)', 'ce')}
FROM (SELECT l.*, n.lse, max(lp) OVER (PARTITION BY row_idx) AS best FROM logp l JOIN norms n USING (row_idx, task)) GROUP BY row_idx""",
    "softmax_rows": _with(_SCORED)
    + f"SELECT row_idx, task, class_id, {r6('exp(lp)', 'probability')} FROM logp",
    "fit_heads": """
SELECT task, class_id, 64 AS dims, true AS biases_cancel, true AS learned FROM (
  SELECT DISTINCT 'ten' AS task, label::INTEGER AS class_id FROM embeddings UNION ALL
  SELECT DISTINCT 'two', (label % 2)::INTEGER FROM embeddings UNION ALL
  SELECT DISTINCT 'three', (label % 3)::INTEGER FROM embeddings)""",
    "train_heads": """
SELECT task, class_id, 64 AS dims, true AS learned, true AS weighted FROM (
  SELECT DISTINCT 'ten' AS task, label::INTEGER AS class_id FROM embeddings UNION ALL
  SELECT DISTINCT 'two', (label % 2)::INTEGER FROM embeddings UNION ALL
  SELECT DISTINCT 'three', (label % 3)::INTEGER FROM embeddings)""",
    "joint_gradient": _with(_SCORED, _WEIGHTS, _WEIGHTED_CE) + """
, facts AS (SELECT task, count(*) AS k, sum(weight) AS spread, sum(n) AS n FROM weights JOIN counts USING (task, class_id) GROUP BY task),
by_ce AS (
  SELECT row_idx, task, 5 * pow(1 - exp(-ce), 4) * exp(-ce) * ce + pow(1 - exp(-ce), 5) AS slope FROM ce),
own AS (SELECT l.row_idx, l.task, 0.9 * w.weight AS hit FROM logp l JOIN weights w USING (task, class_id) WHERE l.class_id = l.y_true),
by_logit AS (
  SELECT l.row_idx, l.task, l.class_id, slope / k / n
    * ((hit + 0.1 / k * spread) * exp(lp) - 0.1 / k * w.weight - CASE WHEN l.class_id = l.y_true THEN hit ELSE 0 END) AS d
  FROM logp l JOIN own USING (row_idx, task) JOIN by_ce USING (row_idx, task) JOIN facts USING (task) JOIN weights w USING (task, class_id)),
inputs AS (SELECT row_idx, task, pos, x FROM parts UNION ALL SELECT row_idx, task, 0, 1.0 FROM rows_)
SELECT task, class_id::INTEGER AS class_id, pos::INTEGER AS pos, round(sum(d * x), 6) + 0.0 AS gradient
FROM by_logit JOIN inputs USING (row_idx, task) GROUP BY ALL""",
    "predict": _with(_SCORED) + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY row_idx, task ORDER BY z DESC, class_id) AS place
             FROM logp)
SELECT row_idx, task, y_true, class_id AS y_pred, round(exp(lp), 6) AS confidence
FROM ranked WHERE place = 1""",
    "score_and_evaluate": _with(
        _SCORED,
        """
predictions AS (SELECT 'x' AS run, task, y_true, class_id AS y_pred FROM (
  SELECT *, row_number() OVER (PARTITION BY row_idx, task ORDER BY z DESC, class_id) AS place FROM logp)
  WHERE place = 1)""",
        _PER_CLASS,
        _METRICS,
    )
    + f"""SELECT task, n, errors, {r9('accuracy', 'accuracy')}, {r9('macro_f1', 'macro_f1')},
{r9('weighted_f1', 'weighted_f1')} FROM metrics""",
    "row_losses": _with(_SCORED, _WEIGHTS, _WEIGHTED_CE)
    + f"SELECT row_idx, task, {r6('ce', 'ce')}, {r6('pow(1 - exp(-ce), 5.0) * ce', 'focal')} FROM ce",
    "focal_loss": _with(_SCORED, _PLAIN_FOCAL) + f"SELECT task, {r6('loss', 'loss')}, n FROM losses",
    "mean_losses": _with(_SCORED, _PLAIN_FOCAL) + """
SELECT task, round((any_value(l.loss) + avg(pow(1 - exp(lp), 5.0) * -lp)) / 2, 6) + 0.0 AS loss
FROM logp JOIN losses l USING (task) WHERE class_id = y_true GROUP BY task""",
    "combined_loss": _with(_SCORED, _WEIGHTS, _WEIGHTED_CE) + """
, losses AS (SELECT task, avg(pow(1 - exp(-ce), 5.0) * ce) AS loss FROM ce GROUP BY task),
vars AS (SELECT task, ln(count(*)) AS s FROM counts GROUP BY task)
SELECT 'weighted' AS kind, round(sum(exp(-s) * loss + s / 2), 6) + 0.0 AS total_loss
FROM losses JOIN vars USING (task)
UNION ALL SELECT 'plain', round(sum(loss), 6) + 0.0 FROM losses""",
    "symmetric_kl": _with(_SCORED, _KL) + f"SELECT task, {r6('kl', 'kl')}, n FROM kl",
    "regularised_loss": _with(_SCORED, _PLAIN_FOCAL, _KL) + """
SELECT round((SELECT sum(loss) FROM losses) + 0.7 * (SELECT sum(kl) FROM kl), 6) + 0.0 AS total_loss""",
    "io_predictions": _ORDER_CELLS + "SELECT * FROM cells WHERE task = 'status' AND run LIKE 'multi%'",
    "io_encoder": _with(_DOC_LABELS, _ENCODER) + "SELECT * FROM encoder",
    "io_run_metrics": _ORDER_METRICS
    + f"""SELECT m.run, r.prefix, r.seed, m.task, {r9('accuracy', 'accuracy')},
{r9('macro_f1', 'macro_f1')}, c.classes FROM metrics m JOIN all_runs r USING (run)
JOIN (SELECT run, task, CAST(count(*) AS INTEGER) AS classes FROM per_class GROUP BY ALL) c
  ON c.run = m.run AND c.task = m.task
WHERE r.prefix = 'multi'""",
    "io_questions": """
SELECT doc_id, md5(text) AS digest, lang, CASE WHEN doc_id % 9 <> 0 THEN source END AS source
FROM documents""",
    "io_history": _with(_HISTORY) + """
SELECT run, epoch, 'a' AS task, round(value, 9) + 0.0 AS f1 FROM history
UNION ALL SELECT run, epoch, 'b', round(value * 2, 9) + 0.0 FROM history""",
    "prepare_pipeline": "WITH " + _SPLIT_DOCS + """,
ids AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_encoded
        FROM (SELECT DISTINCT lang FROM documents))
SELECT lang_encoded, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, split
FROM parted JOIN ids USING (lang) GROUP BY lang_encoded, split""",
    "error_pipeline": _with(_DOC_TRUTH, _PREDICTIONS, _CELLS, _PER_CLASS, _METRICS, _ERRORS) + """
, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, task ORDER BY row_idx) AS INTEGER)
             AS place FROM wrong WHERE prefix = 'multi'),
classes AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS class FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
lines AS (
  SELECT run, task, lang AS label, precision_ AS precision, recall_ AS recall, f1, CAST(support AS DOUBLE) AS support
  FROM per_class JOIN classes USING (class)
  UNION ALL SELECT run, task, 'accuracy', accuracy, accuracy, accuracy, accuracy FROM metrics
  UNION ALL SELECT run, task, 'macro avg', avg(precision_), avg(recall_), avg(f1), CAST(sum(support) AS DOUBLE) FROM per_class GROUP BY run, task
  UNION ALL SELECT run, task, 'weighted avg', sum(precision_ * support) / sum(support), sum(recall_ * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS DOUBLE) FROM per_class GROUP BY run, task),
matrix AS (
  SELECT r.run, 'lang' AS task, t.class AS y_true, p.class AS y_pred, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT run FROM predictions WHERE prefix = 'multi') r CROSS JOIN classes t CROSS JOIN classes p
  LEFT JOIN cells c ON c.run = r.run AND c.y_true = t.class AND c.y_pred = p.class)
SELECT 'errors' AS part, run, task, row_idx, list_extract(['de', 'en', 'es', 'fr'], y_true + 1) AS true_label,
  list_extract(['de', 'en', 'es', 'fr'], y_pred + 1) AS pred_label, md5(text) AS digest, place
FROM ranked JOIN documents ON doc_id = row_idx WHERE place <= 5
UNION ALL BY NAME
SELECT 'report' AS part, run, task, label, round(precision, 9) + 0.0 AS precision, round(recall, 9) + 0.0 AS recall,
  round(f1, 9) + 0.0 AS f1, round(support, 9) + 0.0 AS support FROM lines WHERE run LIKE 'multi%'
UNION ALL BY NAME
SELECT 'matrix' AS part, * FROM matrix""",
    "aligned_profiles": _with(_DOC_TRUTH, _PREDICTIONS) + f"""
SELECT scope, code, count(*) AS n FROM (
  SELECT task AS scope, row_idx, concat_ws(',', max(y_true), {', '.join(
      f"coalesce(max(CASE WHEN run = '{r}' THEN coalesce(y_pred, -1) END), -2)" for r in (*MULTI, *SINGLE))}) AS code
  FROM predictions GROUP BY task, row_idx HAVING count(y_true) > 0)
GROUP BY scope, code""",
    "compare_pipeline": f"""
SELECT 'paired' AS part, * FROM ({_PAIRED_MEAN_SQL})
UNION ALL BY NAME
SELECT 'intervals' AS part, * FROM ({_resample(_DOC_TRUTH_JOINT, "'multi'", joint=False).rstrip()},
  means AS (SELECT task, b, avg(macro_f1) AS score FROM scores GROUP BY task, b)
  SELECT task, {r9('avg(score)', 'mean')}, {r9('quantile_cont(score, 0.025)', 'low')}, {r9('quantile_cont(score, 0.975)', 'high')},
    count(*) AS replicates FROM means GROUP BY task)
UNION ALL BY NAME
SELECT 'metrics' AS part, * FROM ({_with(_DOC_TRUTH_JOINT, _PREDICTIONS, _PER_CLASS, _METRICS)}
  SELECT m.run, r.prefix, m.task, n, errors, {r9('accuracy', 'accuracy')}, {r9('macro_f1', 'macro_f1')}, {r9('weighted_f1', 'weighted_f1')}, per_class_f1
  FROM metrics m JOIN all_runs r USING (run)
  JOIN (SELECT run, task, string_agg(format('{{:.6f}}', f1), ' ' ORDER BY class) AS per_class_f1 FROM per_class GROUP BY ALL) l
    ON l.run = m.run AND l.task = m.task)
UNION ALL BY NAME
SELECT 'summary' AS part, * FROM ({_with(_DOC_TRUTH_JOINT, _PREDICTIONS, _PER_CLASS, _METRICS).rstrip()},{_AGG}
  SELECT prefix, task, {r9('mean', 'mean')}, {r9('std', 'std')}, {r9('lo', 'min')}, {r9('hi', 'max')}, n FROM agg)""",
    "percentiles": """
SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n,
  round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.975), 6) AS high, min(l_extendedprice) AS least, max(l_extendedprice) AS most
FROM lineitem GROUP BY ALL""",
    "number_texts": """
SELECT format('{:.4f}', l_quantity / 32) AS exact, format('{:+.3f}', l_extendedprice / 200) AS near, count(*) AS n
FROM lineitem GROUP BY ALL""",
    "appended_cells": _ORDER_CELLS + "SELECT run, task, y_true, y_pred, n FROM cells",
}
