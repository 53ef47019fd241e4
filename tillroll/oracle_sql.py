"""SQL versions of every registered job (DuckDB dialect), written from the jobs' definitions.

They share no code with the Spark operators and take other routes: one fact row
per delivered order, from which customers, months and the summary are folded;
missing rows by ``EXISTS``; predecessors by counting and self-joins; quintiles by
arithmetic on row numbers; the first two purchases from ordered arrays; the first
item by ``arg_min``.  Conventions shared with the Spark side:

* ratios of exact numbers are rounded once, half away from zero, on whole
  numbers (``share``); averages of doubles are rounded on ``decimal(28,8)``;
* descending orders put NULLs first and ascending ones last;
* ties in rankings and top-k lists are broken by the natural key;
* months are published as midnight timestamps.
"""

from __future__ import annotations

from tillroll.sources.testbind import with_views


def rounded(x: str, n: int) -> str:
    """Rounded value of a double or decimal expression."""
    return f"round(({x})::DECIMAL(28,8), {n})::DOUBLE"


def share(num: str, den: str, n: int, factor: int = 1) -> str:
    """factor * num / den rounded to n decimals on whole numbers of hundredths; NULL for no den."""
    a, b = (f"((({x})::DECIMAL(32,2) * 100)::HUGEINT)" for x in (num, den))
    size = f"((2 * abs({a}) * {factor * 10 ** n} + abs({b})) // (2 * abs({b})))::DOUBLE / {10 ** n}"
    return f"CASE WHEN ({den}) <> 0 THEN CASE WHEN ({a} < 0) <> ({b} < 0) THEN -1 ELSE 1 END * {size} END"


def days(later: str, earlier: str) -> str:
    return f"(epoch_us({later}) - epoch_us({earlier}))::DOUBLE / 86400000000.0"


# One row per delivered order: its customer, dates, item totals and mean review score.
FACTS = """
item_totals AS (
    SELECT order_id, count(*) AS lines, sum(price) AS goods, sum(freight_value) AS shipping
    FROM raw_order_items GROUP BY ALL),
scores AS (SELECT order_id, avg(review_score::DOUBLE) AS score FROM raw_order_reviews GROUP BY ALL),
facts AS (
    SELECT o.order_id, o.customer_id, o.order_purchase_timestamp AS bought,
           o.order_delivered_customer_date AS arrived, o.order_estimated_delivery_date AS promised,
           t.lines, t.goods, t.shipping, s.score, t.order_id IS NOT NULL AS has_items, s.order_id IS NOT NULL AS reviewed
    FROM (FROM raw_orders WHERE order_status = 'delivered') o
    LEFT JOIN item_totals t USING (order_id) LEFT JOIN scores s USING (order_id))"""

# Delivered orders of known customers.
OWNED = FACTS + """,
owned AS (SELECT c.customer_unique_id AS who, f.* FROM facts f JOIN raw_customers c USING (customer_id))"""

# Delivered orders with both dates, in fractional days.
TRIPS = FACTS + f""",
trips AS (
    SELECT *, {days('arrived', 'bought')} AS took, {days('arrived', 'promised')} AS late_by
    FROM facts WHERE arrived IS NOT NULL AND promised IS NOT NULL)"""

LABELS = """
labels AS (
    SELECT p.product_id, coalesce(t.product_category_name_english, p.product_category_name) AS label
    FROM raw_products p LEFT JOIN raw_product_category_translation t USING (product_category_name))"""

_Q: dict[str, str] = {}

# ---------------------------------------------------------------- data quality
_COUNTED = ["customers", "orders", "products", "order_items", "order_payments", "order_reviews"]
_Q["dq_row_counts"] = (
    f"SELECT unnest({_COUNTED}) AS table_name, unnest([" + ", ".join(f"(SELECT count(*) FROM raw_{t})" for t in _COUNTED)
    + "]) AS row_count")


def repeated(table: str, keys: str) -> str:
    return (f"SELECT DISTINCT {keys}, count(*) OVER (PARTITION BY {keys}) AS cnt FROM {table} QUALIFY cnt > 1")


_Q["dq_duplicate_order_ids"] = repeated("raw_orders", "order_id")
_Q["dq_duplicate_customer_ids"] = repeated("raw_customers", "customer_id")
_Q["dq_duplicate_reviews"] = """
WITH per_id AS (SELECT review_id, count(*) AS n FROM raw_order_reviews GROUP BY review_id)
SELECT coalesce(sum(n), 0)::BIGINT AS total_reviews, count(review_id) AS distinct_review_ids,
       (coalesce(sum(n), 0) - count(review_id))::BIGINT AS duplicate_review_ids FROM per_id"""
_Q["dq_order_nulls"] = """
WITH nulls AS (
    SELECT unnest([('status', order_status IS NULL), ('purchase', order_purchase_timestamp IS NULL),
                   ('approved', order_approved_at IS NULL), ('delivered', order_delivered_customer_date IS NULL)]) AS x FROM raw_orders),
counted AS (SELECT x[1] AS field, count(*) AS n FROM nulls WHERE x[2] GROUP BY 1)
SELECT """ + ", ".join(f"coalesce((SELECT n FROM counted WHERE field = '{f}'), 0) AS null_{f}"
                       for f in ("status", "purchase", "approved", "delivered"))
_Q["dq_products_without_category"] = (
    "SELECT count(*) AS products_without_category FROM raw_products WHERE product_category_name IS NULL")
_Q["dq_status_distribution"] = f"""
WITH per_status AS (SELECT order_status, count(*) AS cnt FROM raw_orders GROUP BY ALL),
whole AS (SELECT count(*) AS n FROM raw_orders)
SELECT order_status, cnt, {share('cnt', 'n', 2, 100)} AS pct FROM per_status, whole"""
for _name, _other in [("items", "raw_order_items"), ("payments", "raw_order_payments")]:
    _Q[f"dq_orders_without_{_name}"] = f"""
SELECT count(*) AS orders_without_{_name} FROM raw_orders o
WHERE NOT EXISTS (FROM {_other} x WHERE x.order_id = o.order_id)"""
_Q["dq_delivered_before_purchase"] = """
SELECT count(*) AS delivered_before_purchase FROM raw_orders
WHERE order_delivered_customer_date < order_purchase_timestamp"""
_Q["dq_item_money"] = """
SELECT (SELECT count(*) FROM raw_order_items WHERE price <= 0) AS non_positive_price,
       (SELECT count(*) FROM raw_order_items WHERE freight_value < 0) AS negative_freight"""
_Q["dq_payment_money"] = """
SELECT count(*) AS non_positive_payment FROM raw_order_payments WHERE payment_value <= 0"""
_Q["dq_reviews_without_order"] = """
SELECT count(*) AS reviews_without_order FROM raw_order_reviews r
WHERE NOT EXISTS (FROM raw_orders o WHERE o.order_id = r.order_id)"""
_Q["dq_purchase_range"] = """
WITH dated AS (SELECT order_purchase_timestamp AS t FROM raw_orders WHERE order_purchase_timestamp IS NOT NULL)
SELECT (FROM dated ORDER BY t LIMIT 1) AS first_order, (FROM dated ORDER BY t DESC LIMIT 1) AS last_order"""

# ------------------------------------------------------------ key constraints
for _name, _keys in [("products", "product_id"), ("order_items", "order_id, order_item_id"),
                     ("order_payments", "order_id, payment_sequential"), ("order_reviews", "review_sk"),
                     ("product_category_translation", "product_category_name")]:
    _Q["check_pk_" + _name.replace("product_category", "category")] = repeated(f"raw_{_name}", _keys)

_NOT_NULL = {"customers": ["customer_id", "customer_unique_id"], "orders": ["order_id"], "products": ["product_id"],
             "order_items": ["order_id", "order_item_id"], "order_payments": ["order_id", "payment_sequential"],
             "order_reviews": ["review_sk"],
             "product_category_translation": ["product_category_name", "product_category_name_english"]}
_Q["check_not_null"] = " UNION ALL ".join(
    f"(SELECT '{t}' AS table_name, unnest({cols}) AS column_name, "
    f"unnest([{', '.join(f'count(*) FILTER ({c} IS NULL)' for c in cols)}]) AS null_count FROM raw_{t})"
    for t, cols in _NOT_NULL.items())

for _child, _parent, _key in [("orders", "customers", "customer_id"), ("order_items", "orders", "order_id"),
                              ("order_items", "products", "product_id"), ("order_payments", "orders", "order_id")]:
    _Q[f"check_fk_{_child}_{_parent}"] = f"""
WITH missing AS (SELECT {_key} FROM raw_{_child} EXCEPT SELECT {_key} FROM raw_{_parent})
SELECT {_key}, count(*) AS orphan_rows FROM raw_{_child} JOIN missing USING ({_key}) GROUP BY ALL"""

# -------------------------------------------------------------- monthly sales
MONTHS = FACTS + """,
months AS (
    SELECT date_trunc('month', bought)::TIMESTAMP AS month, count(*) AS sold, count(DISTINCT customer_id) AS buyers,
           sum(goods) AS goods, sum(lines) AS lines, sum(shipping) AS shipping
    FROM facts WHERE has_items GROUP BY ALL)"""
_Q["monthly_metrics"] = f"""
WITH {MONTHS},
placed AS (
    SELECT *, (SELECT count(*) FROM months e WHERE e.month < m.month OR (m.month IS NULL AND e.month IS NOT NULL)) AS place
    FROM months m)
SELECT now.month AS order_month, now.sold AS orders_count, now.buyers AS customers_count,
       {rounded('now.goods', 2)} AS revenue, {share('now.goods', 'now.sold', 2)} AS avg_order_value,
       {share('now.lines', 'now.sold', 2)} AS avg_items_per_order,
       {share('now.shipping', 'now.sold', 2)} AS avg_freight_per_order,
       {share('now.goods - old.goods', 'old.goods', 2, 100)} AS revenue_mom_pct,
       {share('now.sold - old.sold', 'old.sold', 2, 100)} AS orders_mom_pct
FROM placed now LEFT JOIN placed old ON old.place + 1 = now.place"""
_Q["chart_monthly_revenue"] = f"""
WITH {MONTHS} SELECT month AS order_month, sold AS orders_count, {rounded('goods', 2)} AS revenue FROM months"""

# ------------------------------------------------------------------ categories
SOLD_LINES = LABELS + """,
sold_lines AS (
    SELECT coalesce(l.label, 'unknown') AS category, i.order_id, o.customer_id, i.price, i.freight_value
    FROM raw_order_items i LEFT JOIN labels l USING (product_id)
    JOIN (FROM raw_orders WHERE order_status = 'delivered') o ON o.order_id = i.order_id),
sums AS (
    SELECT category, sum(price) AS goods, count(price) AS priced, sum(freight_value) AS shipping, count(freight_value) AS shipped,
           count(DISTINCT order_id) AS sold, count(DISTINCT customer_id) AS buyers
    FROM sold_lines GROUP BY ALL)"""
_Q["category_revenue"] = f"""
WITH {SOLD_LINES}, whole AS (SELECT sum(goods) AS total FROM sums)
SELECT category, {rounded('goods', 2)} AS revenue, sold AS orders_count, buyers AS customers_count,
       {share('goods', 'sold', 2)} AS avg_order_value, {share('goods', 'priced', 2)} AS avg_item_price,
       {share('shipping', 'shipped', 2)} AS avg_freight, {share('goods', 'total', 2, 100)} AS revenue_share_pct,
       1 + (SELECT count(DISTINCT coalesce(b.goods, 1e20::DECIMAL(38,2))) FROM sums b
            WHERE coalesce(b.goods, 1e20::DECIMAL(38,2)) > coalesce(sums.goods, 1e20::DECIMAL(38,2))) AS revenue_rank
FROM sums, whole"""
_Q["chart_top_categories"] = f"""
WITH {SOLD_LINES}, top AS (SELECT category, {rounded('goods', 2)} AS revenue FROM sums)
FROM top ORDER BY revenue DESC NULLS FIRST, category LIMIT 10"""

# ------------------------------------------------------------ repeat customers
PER_CUSTOMER = OWNED + """,
per_customer AS (SELECT who, count(*) AS bought_times FROM owned GROUP BY ALL)"""
_Q["repeat_customer_metrics"] = f"""
WITH {PER_CUSTOMER}, whole AS (
    SELECT count(*) AS n, coalesce(sum((bought_times > 1)::INT), 0)::BIGINT AS again, sum(bought_times) AS times,
           max(bought_times) AS most FROM per_customer)
SELECT n AS total_customers, again AS repeat_customers, {share('again', 'n', 2, 100)} AS repeat_rate_pct,
       {share('times', 'n', 3)} AS avg_orders_per_customer, most AS max_orders_single_customer FROM whole"""
_Q["orders_per_customer_distribution"] = f"""
WITH {PER_CUSTOMER}, whole AS (SELECT count(*) AS n FROM per_customer),
bars AS (SELECT bought_times, count(*) AS customers FROM per_customer GROUP BY ALL)
SELECT bought_times AS orders_count, customers, {share('customers', 'n', 2, 100)} AS pct FROM bars, whole"""
GAPS = OWNED + f""",
firsts AS (SELECT who, array_agg(bought ORDER BY bought NULLS LAST, order_id NULLS LAST) AS dates FROM owned GROUP BY ALL),
gaps AS (SELECT {days('dates[2]', 'dates[1]')} AS gap FROM firsts WHERE len(dates) > 1)"""
_Q["days_between_first_two_orders"] = f"""
WITH {GAPS}
SELECT {rounded('avg(gap)', 1)} AS avg_days_between, {rounded('min(gap)', 1)} AS min_days,
       {rounded('max(gap)', 1)} AS max_days, quantile_cont(gap, 0.5) AS median_days FROM gaps"""
_Q["top_customers_by_revenue"] = f"""
WITH {OWNED}, spent AS (
    SELECT who, count(*) AS times, {rounded('sum(goods)', 2)} AS total FROM owned WHERE has_items GROUP BY who)
SELECT who AS customer_unique_id, times AS orders_count, total AS total_revenue
FROM spent ORDER BY total DESC NULLS FIRST, who LIMIT 10"""

# -------------------------------------------------------- delivery and reviews
_Q["delivery_performance"] = f"""
WITH {TRIPS}, whole AS (
    SELECT count(*) AS n, coalesce(sum((late_by > 0)::INT), 0)::BIGINT AS late, avg(took) AS mean_took,
           quantile_cont(took, 0.5) AS middle, avg(late_by) AS mean_late FROM trips)
SELECT n AS delivered_orders, {rounded('mean_took', 1)} AS avg_delivery_days, {rounded('middle', 1)} AS median_delivery_days,
       late AS late_orders, {share('late', 'n', 2, 100)} AS late_rate_pct, {rounded('mean_late', 1)} AS avg_delay_days
FROM whole"""


def by_group(group: str) -> str:
    return f"""
WITH {TRIPS}, grouped AS (
    SELECT {group} AS delivery_group, count(*) AS orders, {rounded('avg(score)', 3)} AS avg_review_score
    FROM trips WHERE reviewed GROUP BY 1)"""


_Q["review_score_by_delivery_group"] = by_group(
    "CASE WHEN late_by < 0 THEN 'early' WHEN late_by = 0 THEN 'on_time' WHEN late_by > 0 THEN 'late' END") + f""", whole AS (SELECT sum(orders) AS n FROM grouped)
SELECT delivery_group, orders, avg_review_score, {share('orders', 'n', 2, 100)} AS pct_of_orders FROM grouped, whole"""
_Q["chart_delivery_reviews"] = by_group("if(late_by > 0, 'Late', 'On time / Early')") + " FROM grouped"
_Q["score_distribution_by_delivery"] = f"""
WITH {TRIPS}
SELECT round(score::DECIMAL(28,8), 0)::INTEGER AS review_score,
       count(*) - sum((late_by > 0)::INT)::BIGINT AS on_time_or_early, sum((late_by > 0)::INT)::BIGINT AS late
FROM trips WHERE reviewed GROUP BY 1"""
_Q["category_delay_top10"] = f"""
WITH {TRIPS}, {LABELS},
first_items AS (
    SELECT order_id, arg_min({{'p': product_id}}, (order_item_id IS NULL, order_item_id, product_id IS NULL, product_id)).p AS product_id
    FROM raw_order_items GROUP BY order_id),
grouped AS (
    SELECT coalesce(l.label, 'unknown') AS category, count(*) AS orders, {rounded('avg(late_by)', 2)} AS avg_delay_days,
           sum((late_by > 0)::INT) AS late
    FROM trips JOIN first_items f USING (order_id) LEFT JOIN labels l ON l.product_id = f.product_id GROUP BY 1)
SELECT category, orders, avg_delay_days, {share('late', 'orders', 2, 100)} AS late_rate_pct
FROM grouped WHERE orders >= 100 ORDER BY avg_delay_days DESC NULLS FIRST, category LIMIT 10"""


# ------------------------------------------------------------------------- RFM
def bucket(place: str, n: str, k: int) -> str:
    """NTILE(k) of the row at 0-based ``place`` of ``n``: the first n % k buckets have one row more."""
    big = f"({n} % {k}) * ({n} // {k} + 1)"
    return (f"(CASE WHEN {place} < {big} THEN {place} // ({n} // {k} + 1) "
            f"ELSE {n} % {k} + ({place} - {big}) // greatest({n} // {k}, 1) END + 1)::BIGINT")


BASE = OWNED + """,
latest AS (SELECT max(bought) AS day FROM facts),
base AS (
    SELECT who AS customer_unique_id, date_part('day', any_value(day) - max(bought))::INTEGER AS recency_days,
           count(*) AS frequency, round(sum(goods), 2)::DOUBLE AS monetary
    FROM owned, latest WHERE has_items GROUP BY who)"""
SCORED = BASE + f""",
numbered AS (
    SELECT *, count(*) OVER () AS n,
           row_number() OVER (ORDER BY recency_days DESC NULLS FIRST, customer_unique_id) - 1 AS r,
           row_number() OVER (ORDER BY frequency, customer_unique_id) - 1 AS f,
           row_number() OVER (ORDER BY monetary NULLS LAST, customer_unique_id) - 1 AS m FROM base),
scored AS (
    SELECT customer_unique_id, recency_days, frequency, monetary, {bucket('r', 'n', 5)} AS r_score,
           {bucket('f', 'n', 5)} AS f_score, {bucket('m', 'n', 5)} AS m_score FROM numbered),
rules(place, segment, r_from, r_to, m_from, m_to) AS (VALUES
    (1, 'Champions', 4, 5, 4, 5), (2, 'Loyal Customers', 3, 5, 3, 5), (3, 'Potential Loyalists', 4, 5, 1, 2),
    (4, 'At Risk', 1, 2, 3, 5), (5, 'Hibernating', 1, 5, 1, 5)),
segmented AS (
    SELECT s.*, (SELECT arg_min(segment, place) FROM rules
                 WHERE s.r_score BETWEEN r_from AND r_to AND s.m_score BETWEEN m_from AND m_to) AS segment FROM scored s)"""
_Q["rfm_base"] = f"WITH {BASE} FROM base"
_Q["rfm_scores"] = f"WITH {SCORED} FROM scored"
_Q["rfm_customer_segments"] = f"WITH {SCORED} FROM segmented"
_Q["rfm_segment_summary"] = f"""
WITH {SCORED}, sums AS (
    SELECT segment, count(*) AS customers, sum(monetary::DECIMAL(18,2)) AS spent, count(monetary) AS spenders,
           sum(frequency) AS times, sum(recency_days) AS idle, count(recency_days) AS dated FROM segmented GROUP BY segment),
whole AS (SELECT sum(customers) AS n FROM sums)
SELECT segment, customers, {share('customers', 'n', 2, 100)} AS pct_customers,
       {share('spent', 'spenders', 2)} AS avg_revenue_per_customer, {share('times', 'customers', 2)} AS avg_orders,
       {share('idle', 'dated', 0)} AS avg_recency_days, {rounded('spent', 2)} AS total_revenue FROM sums, whole"""

# --------------------------------------------------------------------- summary
_Q["business_summary"] = f"""
WITH {OWNED}, per_customer AS (
    SELECT who, count(*) AS times, sum(has_items::INT) AS sold, sum(goods) AS goods,
           sum((has_items AND arrived > promised)::INT) AS late,
           sum((has_items AND arrived IS NOT NULL AND promised IS NOT NULL)::INT) AS dated,
           sum(score) FILTER (has_items) AS stars, count(score) FILTER (has_items) AS rated FROM owned GROUP BY who),
whole AS (
    SELECT count(*) AS n, coalesce(sum((times > 1)::INT), 0) AS again, coalesce(sum(sold), 0)::BIGINT AS sold, sum(goods) AS goods,
           coalesce(sum((sold > 0)::INT), 0)::BIGINT AS buyers, sum(late) AS late, sum(dated) AS dated,
           sum(stars) AS stars, sum(rated) AS rated FROM per_customer)
SELECT {rounded('goods', 2)} AS total_revenue, sold AS delivered_orders, buyers AS unique_customers,
       {share('goods', 'sold', 2)} AS avg_order_value, {share('again', 'n', 2, 100)} AS repeat_purchase_rate_pct,
       {share('late', 'dated', 2, 100)} AS late_delivery_rate_pct,
       {rounded('stars / nullif(rated, 0)', 3)} AS avg_review_score FROM whole"""

# ------------------------------------------------------- distributed operators
_Q["review_surrogate_keys"] = """
SELECT row_number() OVER (ORDER BY review_creation_date NULLS LAST, review_id NULLS LAST, order_id NULLS LAST,
                                   review_score NULLS LAST) AS review_sk,
       review_id, order_id, review_score, review_creation_date FROM raw_order_reviews"""
_Q["global_row_number"] = """
SELECT row_number() OVER (ORDER BY price NULLS LAST, order_id NULLS LAST, order_item_id NULLS LAST, product_id NULLS LAST) AS row_number,
       order_id, order_item_id, product_id, price::DOUBLE AS price FROM raw_order_items"""
_Q["ntile_global"] = f"""
WITH per_order AS (SELECT order_id, count(*) AS items FROM raw_order_items WHERE order_id IS NOT NULL GROUP BY order_id),
numbered AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY items, order_id) - 1 AS i FROM per_order)
SELECT order_id, items, {bucket('i', 'n', 4)} AS quartile FROM numbered"""
_Q["exact_median_global"] = f"""
WITH {TRIPS}, {GAPS.replace(FACTS, '', 1).lstrip(',')}
SELECT (SELECT quantile_cont(took, 0.5) FROM trips) AS median_delivery_days,
       (SELECT quantile_cont(gap, 0.5) FROM gaps) AS median_days_between"""


# ------------------------------------------------------------------- load path
# Landed tables hold ids as text; review keys follow the order of the rows in the files.
_LANDED = {
    "customers": "customer_id::VARCHAR AS customer_id, customer_unique_id::VARCHAR AS customer_unique_id, customer_city, customer_state",
    "orders": "order_id::VARCHAR AS order_id, customer_id::VARCHAR AS customer_id, order_status, order_purchase_timestamp, "
              "order_approved_at, order_delivered_customer_date, order_estimated_delivery_date",
    "products": "product_id::VARCHAR AS product_id, product_category_name",
    "order_items": "order_id::VARCHAR AS order_id, order_item_id, product_id::VARCHAR AS product_id, "
                   "seller_id::VARCHAR AS seller_id, shipping_limit_date, price::DOUBLE AS price, freight_value::DOUBLE AS freight_value",
    "order_payments": "order_id::VARCHAR AS order_id, payment_sequential, payment_type, payment_installments, "
                      "payment_value::DOUBLE AS payment_value",
    "order_reviews": "row_number() OVER (ORDER BY review_creation_date NULLS LAST, review_id NULLS LAST, order_id NULLS LAST, "
                     "review_score NULLS LAST) AS review_sk, review_id::VARCHAR AS review_id, "
                     "order_id::VARCHAR AS order_id, review_score, review_creation_date",
    "product_category_translation": "product_category_name, product_category_name_english",
}
for _t, _cols in _LANDED.items():
    _Q[f"land_{_t}"] = f"SELECT {_cols} FROM raw_{_t}"
_Q["publish_business_summary"] = _Q["business_summary"]
_Q["layer_versions"] = " UNION ALL ".join(
    f"SELECT '{version}' AS layer_version, '{t}' AS table_name, count(*) AS row_count FROM raw_{t}{less.get(t, '')}"
    for version, less in (("first", {}), ("second", {"order_items": " WHERE order_item_id > 1", "products": " WHERE false"})) for t in _LANDED)


def oracle_queries() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _Q.items()}


def oracle_bodies() -> dict[str, str]:
    """The job SQL over tables named ``raw_<canonical name>`` (no binding CTEs)."""
    return dict(_Q)
