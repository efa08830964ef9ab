"""The same results in plain SQL, for the check against another engine.

Sums are of decimals that hold every digit of the given tables, in as few places as that
takes, since the other engine's doubles are exact for those only.
"""

from __future__ import annotations

from salescast.operators.trees import tree_sql
from salescast.plans.fixed import fixed_layers

_LAYERS = fixed_layers()

_ITEMS = """items AS (
  SELECT p_partkey, p_name,
         CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS p_brand,
         p_type, p_size, p_retailprice,
         CAST(floor(p_retailprice / 10) AS BIGINT) AS price_band,
         CAST(floor(p_size / 10.0) AS BIGINT) AS size_band
  FROM part)"""

_EVENTS = """all_events AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id,
         TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS p_partkey,
         event_type, value,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS buy,
         CASE WHEN event_type = 'purchase' THEN value END AS amount
  FROM events)"""

_ALL = f"""{_EVENTS},
all_contacts AS (
  SELECT * FROM all_events WHERE event_type IN ('view', 'click', 'purchase')),
contacts AS (SELECT * FROM all_contacts WHERE ts < TIMESTAMP '2024-01-25'),
later AS (SELECT * FROM all_contacts WHERE ts >= TIMESTAMP '2024-01-25')"""


def _stats(source: str, keys: str) -> str:
    return f"""sums AS (
  SELECT {keys}, count(*) AS n_rows, count(buy) AS n, CAST(sum(buy) AS DOUBLE) AS s
  FROM {source} GROUP BY {keys}),
prior AS (SELECT sum(s) / sum(n) AS g FROM sums),
stats AS (
  SELECT {keys}, n_rows, n, s, (s + 20 * g) / (n + 20) AS likelihood FROM sums, prior)"""


def _history(side: str, key: str) -> str:
    over = f"OVER (PARTITION BY {key} ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH {_ALL},
daily AS (
  SELECT {key}, day, count(*) AS contacts, sum(buy) AS buys,
         sum(CAST(coalesce(amount, 0) AS DECIMAL(18,2))) AS qty
  FROM contacts GROUP BY {key}, day),
past AS (
  SELECT {key}, day,
         CAST(coalesce(sum(contacts) {over}, 0) AS BIGINT) AS {side}_contacts_before,
         CAST(coalesce(sum(buys) {over}, 0) AS BIGINT) AS {side}_buys_before,
         CAST(coalesce(sum(qty) {over}, 0) AS DOUBLE) AS {side}_qty_before,
         CAST(date_diff('day', lag(day) OVER (PARTITION BY {key} ORDER BY day), day)
              AS INTEGER) AS {side}_days_since
  FROM daily)
SELECT event_id, {key}, {side}_contacts_before, {side}_buys_before, {side}_qty_before,
       {side}_days_since
FROM contacts JOIN past USING ({key}, day)"""


def _bayes(target: str, cls: str, source: str, attrs: list[str], answer: str, known: str) -> str:
    """Scores every class for every row without a target."""
    steps, terms, joins = [], [], []
    for i, a in enumerate(attrs):
        steps.append(f"""c{i} AS (
  SELECT cls, {a} AS v, count(*) AS n FROM known WHERE {a} IS NOT NULL GROUP BY cls, {a}),
t{i} AS (SELECT cls, sum(n) AS n FROM c{i} GROUP BY cls),
v{i} AS (SELECT count(DISTINCT v) AS n FROM c{i})""")
        terms.append(
            f"CASE WHEN r.{a} IS NULL THEN 0 ELSE ln((coalesce(c{i}.n, 0) + 1.0) / "
            f"(coalesce(t{i}.n, 0) + CAST((SELECT n FROM v{i}) AS DOUBLE))) END"
        )
        joins.append(
            f"LEFT JOIN c{i} ON c{i}.cls = k.cls AND c{i}.v = r.{a} "
            f"LEFT JOIN t{i} ON t{i}.cls = k.cls"
        )
    return f"""WITH {_ITEMS},
parts AS ({source}),
known AS (SELECT *, {cls} AS cls FROM parts WHERE {target} IS NOT NULL),
classes AS (
  SELECT cls, CAST(sum({known}) AS DOUBLE) / count(*) AS mean,
         ln(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM known)) AS lp
  FROM known GROUP BY cls),
{", ".join(steps)},
scores AS (
  SELECT r.p_partkey, k.cls, k.mean, round(k.lp + {" + ".join(terms)}, 9) AS score
  FROM parts r CROSS JOIN classes k {" ".join(joins)}
  WHERE r.{target} IS NULL),
best AS (
  SELECT p_partkey, cls, mean FROM scores
  QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, cls) = 1)
SELECT p.p_partkey, coalesce(p.{target}, b.{answer}) AS {target},
       p.{target} IS NULL AS {target}_was_null
FROM parts p LEFT JOIN best b ON b.p_partkey = p.p_partkey"""


def _recent(side: str, key: str) -> str:
    def within(days: int) -> str:
        cells = [
            ("contacts", "count(d.day)", "BIGINT"),
            ("buys", "sum(buy)", "BIGINT"),
            ("qty", "sum(CAST(coalesce(amount, 0) AS DECIMAL(18,2)))", "DOUBLE"),
        ]
        inside = f"FILTER (WHERE d.day >= a.day - {days})"
        return ", ".join(f"CAST(coalesce({agg} {inside}, 0) AS {kind}) AS {side}_{m}_{days}d" for m, agg, kind in cells)

    return f"""WITH {_ALL},
asked AS (SELECT DISTINCT {key}, day FROM all_contacts),
past AS (
  SELECT a.{key}, a.day, {within(7)}, {within(28)}
  FROM asked a LEFT JOIN contacts d
    ON d.{key} IS NOT DISTINCT FROM a.{key} AND d.day < a.day AND d.day >= a.day - 28
  GROUP BY a.{key}, a.day)
SELECT event_id, c.{key}, p.* EXCLUDE ({key}, day)
FROM all_contacts c JOIN past p ON p.{key} IS NOT DISTINCT FROM c.{key} AND p.day = c.day"""


def _gaussian(target: str, asked: str, digits: int) -> str:
    """Scores every class for every row in question."""
    sums, spread, added, terms = [], [], [], []
    for a, places in (("p_size", 2), ("p_retailprice", 2)):
        x, xx = f"CAST({a} AS DECIMAL(18,{places}))", f"CAST({a} AS DECIMAL(12,{places})) * CAST({a} AS DECIMAL(12,{places}))"
        sums.append(f"count({a}) AS n_{a}, CAST(sum({x}) AS DOUBLE) AS s_{a}, CAST(sum({xx}) AS DOUBLE) AS q_{a}")
        spread.append(f"sum(q_{a}) / sum(n_{a}) - (sum(s_{a}) / sum(n_{a})) * (sum(s_{a}) / sum(n_{a}))")
        added.append(f"s_{a} / n_{a} AS m_{a}, q_{a} / n_{a} - (s_{a} / n_{a}) * (s_{a} / n_{a}) + 1e-9 * top AS v_{a}")
        terms.append(f"CASE WHEN r.{a} IS NULL THEN 0 ELSE -0.5 * (ln(2 * pi() * v_{a}) + (r.{a} - m_{a}) * (r.{a} - m_{a}) / v_{a}) END")
    return f"""{_ITEMS},
sums AS (
  SELECT {target} AS cls, count(*) AS n, {", ".join(sums)} FROM items WHERE {target} IS NOT NULL GROUP BY {target}),
whole AS (SELECT sum(n) AS n_all, greatest({", ".join(spread)}) AS top FROM sums),
classes AS (
  SELECT cls, ln(CAST(n AS DOUBLE)) - ln(CAST(n_all AS DOUBLE)) AS lp, {", ".join(added)} FROM sums, whole),
scores AS (
  SELECT r.p_partkey, cls, round(lp + {" + ".join(terms)}, {digits}) AS score
  FROM items r CROSS JOIN classes WHERE {asked}),
best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, cls) = 1)"""


def _rolling(cutoffs: list[str], horizon: int, threshold: float) -> str:
    parts = []
    for c in cutoffs:
        day = f"DATE '{c}'"
        parts.append(f"""SELECT '{c}' AS cutoff, (SELECT count(*) FROM all_contacts WHERE day < {day}) AS n_train,
  count(*) AS n_rows, sum(CASE WHEN (p >= {threshold}) = (buy = 1) THEN 1.0 ELSE 0.0 END) / count(*) AS accuracy,
  CAST(greatest(sum(buy), count(*) - sum(buy)) AS DOUBLE) / count(*) AS majority_share,
  round(avg((buy - p) * (buy - p)), 9) AS brier
FROM (
  SELECT t.buy, (coalesce(k.s, 0) + 20 * g) / (coalesce(k.n, 0) + 20) AS p
  FROM all_contacts t
  CROSS JOIN (SELECT avg(buy) AS g FROM all_contacts WHERE day < {day}) AS prior
  LEFT JOIN (SELECT user_id, sum(buy) AS s, count(*) AS n FROM all_contacts WHERE day < {day} GROUP BY user_id) AS k
    ON k.user_id IS NOT DISTINCT FROM t.user_id
  WHERE t.day >= {day} AND t.day < {day} + {horizon})""")
    return f"WITH {_ALL}\n" + "\nUNION ALL\n".join(parts)


def _permuted(features: list[str], total: str) -> str:
    p = f"1.0 / (1.0 + exp(-2.0 * {total}))"
    cases = []
    for f in ["", *features]:
        taken = ", ".join(f"{'o' if f == c else 'r'}.{c} AS {c}" for c in features)
        cases.append(f"SELECT '{f}' AS feature, r.buy, {taken} FROM placed r JOIN placed o ON o.second = r.first")
    return f"""wide AS (
  SELECT event_id, buy, CAST(coalesce(contacts, 0) AS DOUBLE) AS user_contacts_before,
         CAST(coalesce(buys, 0) AS DOUBLE) AS user_buys_before,
         CAST(coalesce(date_diff('day', last, day), -1) AS DOUBLE) AS user_days_since,
         CAST(coalesce(p_size, -1) AS DOUBLE) AS p_size, coalesce(p_retailprice, -1.0) AS p_retailprice
  FROM later l LEFT JOIN totals t ON t.user_id = l.user_id LEFT JOIN part p ON p.p_partkey = l.p_partkey),
placed AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:rows:' || event_id)) AS first,
         row_number() OVER (ORDER BY md5('42:others:' || event_id)) AS second
  FROM wide),
cases AS ({" UNION ALL ".join(cases)}),
losses AS (
  SELECT feature, count(*) AS n_rows, avg((buy - {p}) * (buy - {p})) AS loss FROM cases GROUP BY feature)
SELECT l.feature, l.n_rows, round(b.loss, 9) AS base_loss, round(l.loss, 9) AS loss, round(l.loss - b.loss, 9) AS importance
FROM losses l JOIN losses b ON b.feature = '' WHERE l.feature <> ''"""


_TOTALS = """totals AS (
  SELECT user_id, count(*) AS contacts, sum(buy) AS buys, max(day) AS last FROM contacts GROUP BY user_id)"""

ORACLE: dict[str, str] = {
    "scan_items": "SELECT p_name, p_partkey, p_brand, p_type, p_size, p_retailprice FROM part",
    "scan_contacts": f"""WITH {_EVENTS}
SELECT event_id, CAST(day AS VARCHAR) AS day, user_id, p_partkey, event_type, value, buy, amount
FROM all_events""",
    "scan_score_rows": f"""WITH {_ALL}
SELECT event_id, CAST(day AS VARCHAR) AS day, user_id, p_partkey FROM later""",
    "attach_items": f"""WITH {_ALL}, {_ITEMS}
SELECT event_id, user_id, buy, c.p_partkey, p_brand, p_type, p_size, p_retailprice
FROM contacts c LEFT JOIN items i ON i.p_partkey = c.p_partkey""",
    "null_profile": f"""WITH {_ITEMS},
counted AS (
  SELECT count(*) AS n_rows, count(p_name) AS a, count(p_partkey) AS b, count(p_brand) AS c,
         count(p_type) AS d, count(p_size) AS e, count(p_retailprice) AS f FROM items),
long AS (
  SELECT 'p_name' AS "column", n_rows, n_rows - a AS n_null FROM counted
  UNION ALL SELECT 'p_partkey', n_rows, n_rows - b FROM counted
  UNION ALL SELECT 'p_brand', n_rows, n_rows - c FROM counted
  UNION ALL SELECT 'p_type', n_rows, n_rows - d FROM counted
  UNION ALL SELECT 'p_size', n_rows, n_rows - e FROM counted
  UNION ALL SELECT 'p_retailprice', n_rows, n_rows - f FROM counted)
SELECT "column", n_rows, n_null, CAST(n_null AS DOUBLE) / n_rows AS null_share FROM long""",
    "likelihood_user": f"""WITH {_ALL}, {_stats("contacts", "user_id")}
SELECT user_id, n_rows, n, s, likelihood FROM stats""",
    "likelihood_oof_user": f"""WITH {_ALL},
cells AS (
  SELECT user_id, event_id % 5 AS fold, count(buy) AS n, CAST(sum(buy) AS DOUBLE) AS s
  FROM contacts GROUP BY user_id, event_id % 5),
whole AS (SELECT user_id, sum(n) AS n, sum(s) AS s FROM cells GROUP BY user_id),
folds AS (SELECT fold, sum(n) AS n, sum(s) AS s FROM cells GROUP BY fold),
priors AS (
  SELECT fold, ((SELECT sum(s) FROM folds) - s) / ((SELECT sum(n) FROM folds) - n) AS g
  FROM folds)
SELECT e.event_id, e.user_id, e.buy,
       (w.s - c.s + 20 * p.g) / (w.n - c.n + 20) AS likelihood
FROM contacts e
JOIN cells c ON c.user_id = e.user_id AND c.fold = e.event_id % 5
JOIN whole w ON w.user_id = e.user_id
JOIN priors p ON p.fold = c.fold""",
    "likelihood_score_rows": f"""WITH {_ALL}, {_stats("contacts", "user_id, p_partkey")}
SELECT l.event_id, l.user_id, l.p_partkey, coalesce(t.likelihood, prior.g) AS likelihood
FROM later l CROSS JOIN prior
LEFT JOIN stats t ON t.user_id = l.user_id AND t.p_partkey = l.p_partkey""",
    "likelihood_crossed": f"""WITH {_ALL}, {_ITEMS},
wide AS (
  SELECT buy, coalesce(p_brand, '\\N') || '|' || coalesce(p_type, '\\N') AS brand_type
  FROM contacts c LEFT JOIN items i ON i.p_partkey = c.p_partkey),
{_stats("wide", "brand_type")}
SELECT brand_type, n_rows, n, s, likelihood FROM stats""",
    "nb_fill_brand": _bayes(
        "p_brand", "p_brand", "SELECT * FROM items", ["p_type", "price_band", "size_band"],
        "cls", "0",
    ),
    "nb_fill_size": _bayes(
        "p_size",
        "CAST(floor(p_size / 10) AS BIGINT)",
        "SELECT * REPLACE (CASE WHEN p_partkey % 10 <> 3 THEN CAST(p_size AS DOUBLE) END "
        "AS p_size) FROM items",
        ["p_brand", "p_type", "price_band"],
        "mean",
        "p_size",
    ),
    "calendar": f"""WITH {_ALL}
SELECT event_id, CAST(day AS VARCHAR) AS day, CAST(dayofweek(day) + 1 AS INTEGER) AS day_of_week,
       CAST(month(day) AS INTEGER) AS month,
       CAST(date_diff('day', DATE '2024-01-01', day) AS INTEGER) AS day_number
FROM all_contacts""",
    "user_history": _history("user", "user_id"),
    "item_history": _history("item", "p_partkey"),
    "score_row_history": f"""WITH {_ALL},
totals AS (
  SELECT user_id, count(*) AS contacts, sum(buy) AS buys, max(day) AS last,
         sum(CAST(coalesce(amount, 0) AS DECIMAL(18,2))) AS qty
  FROM contacts GROUP BY user_id)
SELECT l.event_id, l.user_id, CAST(coalesce(contacts, 0) AS BIGINT) AS user_contacts_before,
       CAST(coalesce(buys, 0) AS BIGINT) AS user_buys_before,
       CAST(coalesce(qty, 0) AS DOUBLE) AS user_qty_before,
       CAST(date_diff('day', last, day) AS INTEGER) AS user_days_since
FROM later l LEFT JOIN totals t ON t.user_id = l.user_id""",
    "price_vs_peers": f"""WITH {_ITEMS},
means AS (
  SELECT p_type, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean
  FROM items GROUP BY p_type)
SELECT p_partkey, i.p_type, p_retailprice, mean AS peer_price,
       p_retailprice / mean AS price_ratio,
       percent_rank() OVER (PARTITION BY i.p_type ORDER BY p_retailprice) AS price_rank
FROM items i JOIN means m ON m.p_type = i.p_type""",
    "price_ladder": f"""WITH {_ITEMS},
means AS (
  SELECT p_type, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, count(*) AS n
  FROM items GROUP BY p_type),
cases AS (
  SELECT p_partkey, p_type, f AS price_factor, p_retailprice * f AS price
  FROM items CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (1.0), (1.25)) AS steps(f)),
below AS (
  SELECT c.p_partkey, c.price_factor, count(i.p_partkey) AS n
  FROM cases c LEFT JOIN items i
    ON i.p_type = c.p_type AND i.p_retailprice < c.price AND i.p_partkey <> c.p_partkey
  GROUP BY c.p_partkey, c.price_factor)
SELECT c.p_partkey, c.price_factor, price, mean AS peer_price, price / mean AS price_ratio,
       CASE WHEN m.n > 1 THEN CAST(b.n AS DOUBLE) / (m.n - 1) ELSE 0.0 END AS price_rank
FROM cases c JOIN means m ON m.p_type = c.p_type
JOIN below b ON b.p_partkey = c.p_partkey AND b.price_factor = c.price_factor""",
    "price_change": """WITH daily AS (
  SELECT l_partkey, CAST(l_shipdate AS DATE) AS day,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
         / nullif(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 0) AS price
  FROM lineitem GROUP BY l_partkey, CAST(l_shipdate AS DATE)),
steps AS (
  SELECT *, lag(price) OVER (PARTITION BY l_partkey ORDER BY day) AS previous_price FROM daily)
SELECT l_partkey, CAST(day AS VARCHAR) AS day, price, previous_price,
       price - previous_price AS price_difference,
       price / nullif(previous_price, 0) AS price_ratio
FROM steps""",
    "last_offer": f"""WITH {_ALL},
offers AS (
  SELECT p_partkey, day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS offer
  FROM contacts GROUP BY p_partkey, day),
known AS (SELECT * FROM offers WHERE offer IS NOT NULL),
days AS (SELECT DISTINCT p_partkey, day FROM all_contacts),
past AS (
  SELECT d.p_partkey, d.day, max(k.day) AS last
  FROM days d JOIN known k ON k.p_partkey IS NOT DISTINCT FROM d.p_partkey AND k.day < d.day
  GROUP BY d.p_partkey, d.day)
SELECT event_id, c.p_partkey, k.offer AS last_offer,
       CAST(date_diff('day', p.last, c.day) AS INTEGER) AS last_days, value - k.offer AS offer_change
FROM all_contacts c
LEFT JOIN past p ON p.p_partkey IS NOT DISTINCT FROM c.p_partkey AND p.day = c.day
LEFT JOIN known k ON k.p_partkey IS NOT DISTINCT FROM p.p_partkey AND k.day = p.last""",
    "likelihood_ordered": f"""WITH {_ALL},
daily AS (SELECT user_id, day, sum(buy) AS s, count(buy) AS n FROM contacts GROUP BY user_id, day),
days AS (SELECT day, sum(s) AS s, sum(n) AS n FROM daily GROUP BY day),
priors AS (
  SELECT day, CAST(sum(s) OVER before AS DOUBLE) / sum(n) OVER before AS g FROM days
  WINDOW before AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
own AS (
  SELECT user_id, day, CAST(coalesce(sum(s) OVER before, 0) AS DOUBLE) AS s, coalesce(sum(n) OVER before, 0) AS n
  FROM daily
  WINDOW before AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, c.user_id, (s + 20 * g) / (n + 20) AS likelihood
FROM contacts c JOIN own o ON o.user_id = c.user_id AND o.day = c.day JOIN priors p ON p.day = c.day""",
    "likelihood_amount": f"""WITH {_ALL}, {_ITEMS},
sums AS (
  SELECT p_type, count(*) AS n_rows, count(buy) AS n_buy, CAST(sum(buy) AS DOUBLE) AS s_buy,
         count(amount) AS n_amount, CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS s_amount,
         sum(CAST(amount AS DECIMAL(18,2))) AS amounts
  FROM contacts c LEFT JOIN items i ON i.p_partkey = c.p_partkey GROUP BY p_type),
priors AS (
  SELECT sum(s_buy) / sum(n_buy) AS buy, CAST(sum(amounts) AS DOUBLE) / sum(n_amount) AS amount FROM sums)
SELECT p_type, n_rows, n_buy, s_buy, (s_buy + 20 * buy) / (n_buy + 20) AS likelihood_buy,
       n_amount, s_amount, (s_amount + 20 * amount) / (n_amount + 20) AS likelihood_amount
FROM sums, priors""",
    "score_fixed_layers": f"""WITH {_ALL},
totals AS (
  SELECT user_id, count(*) AS contacts, sum(buy) AS buys, max(day) AS last FROM contacts GROUP BY user_id),
wide AS (
  SELECT event_id, CAST(coalesce(contacts, 0) AS DOUBLE) AS user_contacts_before,
         CAST(coalesce(buys, 0) AS DOUBLE) AS user_buys_before,
         CAST(coalesce(date_diff('day', last, day), -1) AS DOUBLE) AS user_days_since,
         CAST(coalesce(p_size, -1) AS DOUBLE) AS p_size, coalesce(p_retailprice, -1.0) AS p_retailprice
  FROM later l LEFT JOIN totals t ON t.user_id = l.user_id LEFT JOIN part p ON p.p_partkey = l.p_partkey),
scored AS (
  SELECT event_id, round(1.0 / (1.0 + exp(-2.0 * {tree_sql(_LAYERS["buy"], _LAYERS["features"])})), 9) AS p_buy,
         {tree_sql(_LAYERS["amount"], _LAYERS["features"])} AS amount
  FROM wide)
SELECT event_id, p_buy, amount, CASE WHEN p_buy >= 0.25 THEN amount ELSE 0.0 END AS qty_gated,
       p_buy * amount AS qty_expected
FROM scored""",
    "user_recent": _recent("user", "user_id"),
    "item_recent": _recent("item", "p_partkey"),
    "gaussian_fill_brand": f"""WITH {_gaussian("p_brand", "r.p_brand IS NULL", 9)}
SELECT i.p_partkey, coalesce(i.p_brand, b.cls) AS p_brand, i.p_brand IS NULL AS p_brand_was_null
FROM items i LEFT JOIN best b ON b.p_partkey = i.p_partkey""",
    "gaussian_type": f"""WITH {_gaussian("p_type", "true", 9)}
SELECT p_partkey, cls AS p_type, round(score, 6) AS score FROM best""",
    "rolling_accuracy": _rolling(["2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"], 7, 0.35),
    "permutation_importance": f"""WITH {_ALL}, {_TOTALS},
{_permuted(_LAYERS["features"], tree_sql(_LAYERS["buy"], _LAYERS["features"]))}""",
    "split_counts": f"""WITH {_ALL}
SELECT 'train' AS part, count(*) AS n_rows, CAST(sum(buy) AS BIGINT) AS n_buys FROM contacts
UNION ALL
SELECT 'test', count(*), CAST(sum(buy) AS BIGINT) FROM later
UNION ALL
SELECT 'untimed', count(*), CAST(coalesce(sum(buy), 0) AS BIGINT) FROM all_contacts
WHERE ts IS NULL""",
    "two_layer_combine": """WITH given AS (
  SELECT l_orderkey, l_linenumber, l_discount * 10 AS p_buy, l_quantity AS amount FROM lineitem)
SELECT l_orderkey, l_linenumber, p_buy, amount,
       CASE WHEN p_buy >= 0.5 THEN amount ELSE 0.0 END AS qty_gated,
       p_buy * amount AS qty_expected
FROM given""",
    "accuracy": f"""WITH {_ALL},
ruled AS (SELECT buy, CASE WHEN value > 50 THEN 1 ELSE 0 END AS guess FROM later),
sizes AS (SELECT buy, count(*) AS n FROM ruled GROUP BY buy)
SELECT count(*) AS n_rows,
       CAST(sum(CASE WHEN buy = guess THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy,
       CAST((SELECT max(n) FROM sizes) AS DOUBLE) / count(*) AS majority_share
FROM ruled""",
    "forecast": f"""WITH {_ALL}, {_ITEMS},
scored AS (
  SELECT p_type, (l.p_partkey % 10) / 10.0 * value AS qty, p_retailprice AS price
  FROM later l LEFT JOIN items i ON i.p_partkey = l.p_partkey)
SELECT p_type, count(*) AS n_rows, count(*) - count(price) AS n_unpriced,
       CAST(sum(CAST(qty AS DECIMAL(18,6))) AS DOUBLE) AS expected_qty,
       CAST(sum(CAST(qty * price AS DECIMAL(18,6))) AS DOUBLE) AS expected_revenue
FROM scored GROUP BY p_type""",
    "forecast_unpriced": f"""WITH {_ALL},
scored AS (
  SELECT l.p_partkey, value / 8 AS qty, p_retailprice / 1000 AS price
  FROM later l LEFT JOIN part p ON p.p_partkey = l.p_partkey AND p.p_partkey % 3 <> 0)
SELECT p_partkey, count(*) AS n_rows, count(*) - count(price) AS n_unpriced,
       CAST(sum(CAST(qty AS DECIMAL(18,6))) AS DOUBLE) AS expected_qty,
       CAST(sum(CAST(qty * price AS DECIMAL(18,10))) AS DOUBLE) AS expected_revenue
FROM scored GROUP BY p_partkey""",
    "price_vs_peers_small": """WITH prices AS (
  SELECT p_partkey, p_type, p_retailprice / 1000 AS price FROM part),
counted AS (SELECT p_type, price, count(*) AS n FROM prices GROUP BY p_type, price),
means AS (
  SELECT p_type, CAST(sum(CAST(price * n AS DECIMAL(18,6))) AS DOUBLE) / sum(n) AS mean
  FROM counted GROUP BY p_type)
SELECT p_partkey, p.p_type, price, mean AS peer_price, price / mean AS price_ratio,
       percent_rank() OVER (PARTITION BY p.p_type ORDER BY price) AS price_rank
FROM prices p JOIN means m ON m.p_type = p.p_type""",
    "price_change_small": """WITH daily AS (
  SELECT l_partkey, CAST(l_shipdate AS DATE) AS day,
         CAST(sum(CAST(l_extendedprice / 1000 AS DECIMAL(18,6))) AS DOUBLE)
         / nullif(CAST(sum(CAST(l_quantity / 1000 AS DECIMAL(18,6))) AS DOUBLE), 0) AS price
  FROM lineitem GROUP BY l_partkey, CAST(l_shipdate AS DATE)),
steps AS (
  SELECT *, lag(price) OVER (PARTITION BY l_partkey ORDER BY day) AS previous_price FROM daily)
SELECT l_partkey, CAST(day AS VARCHAR) AS day, price, previous_price,
       price - previous_price AS price_difference,
       price / nullif(previous_price, 0) AS price_ratio
FROM steps""",
}
