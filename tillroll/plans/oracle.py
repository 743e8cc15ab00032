"""DuckDB twins of the catalog's queries (the driver's correctness oracle).

Conventions shared with the Spark side so that values hash equal:
* money: ``CAST(price AS DECIMAL(18,2)) * (1 - CAST(discount AS DECIMAL(18,2)))``
  summed exactly and cast to DOUBLE once;
* double constants are written as ``CAST('<repr>' AS DOUBLE)`` (a bare
  ``0.3`` is a DECIMAL in DuckDB);
* integer outputs are cast to the Spark type (INTEGER for Spark ``int``);
* rounding of doubles goes through the decimal text form, like Spark's
  ``round`` (``ROUND(CAST(CAST(x AS VARCHAR) AS DECIMAL(38,10)), n)``).
"""

from __future__ import annotations

import math

# Fixed values, stated here again rather than imported: a wrong constant in an
# operator then shows as a mismatch.
SAFETY_Z_SIMPLE = 1.65
Z_95 = 1.6448536269514715
LEAD_TIME_DAYS = 7
PAIR_MIN_SUPPORT = 0.03
ORDER_COST, HOLDING_RATE, DAYS_PER_YEAR = 50.0, 0.2, 365.0
SES_ALPHA = 0.3
YEAR_DAYS, WEEK_DAYS, YEARLY_ORDER, WEEKLY_ORDER = 365.25, 7.0, 10, 3
MAPE_EPS = 2.220446049250313e-16
SEED, TEST_PERCENT = 42, 20
SEGMENT_RULES = (
    ("Champions", ("444", "443", "434", "344")),
    ("Loyal Customers", ("442", "441", "432", "431")),
    ("Potential Loyalists", ("333", "334", "343", "433")),
    ("New Customers", ("411", "412", "421", "422")),
    ("Promising", ("311", "312", "321", "322")),
    ("Need Attention", ("211", "212", "221", "222")),
)
DEFAULT_SEGMENT = "At Risk"


def D(x: float) -> str:
    """A double literal."""
    return f"CAST('{x!r}' AS DOUBLE)"


def R2(x: str, n: int = 2) -> str:
    """Spark's HALF_UP ``round`` of a double."""
    return f"CAST(ROUND(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def R6(x: str) -> str:
    return f"ROUND({x}, 6)"


MONEY = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"

_FX = {
    "order_key": ("lineitem", "l_orderkey"),
    "line_number": ("lineitem", "l_linenumber"),
    "sku": ("lineitem", "l_partkey"),
    "quantity": ("lineitem", "l_quantity"),
    "extended_price": ("lineitem", "l_extendedprice"),
    "unit_price": ("lineitem", "l_extendedprice / l_quantity"),
    "discount": ("lineitem", "l_discount"),
    "revenue_dec": ("lineitem", MONEY),
    "total_price": ("lineitem", f"CAST({MONEY} AS DOUBLE)"),
    "date": ("orders", "CAST(o_orderdate AS DATE)"),
    "customer_id": ("orders", "o_custkey"),
    "is_holiday": ("orders", "((month(o_orderdate) = 11 AND day(o_orderdate) >= 20) OR "
                             "(month(o_orderdate) = 12 AND day(o_orderdate) <= 26))"),
    "loyalty_tier": ("customer", "c_mktsegment"),
    "acctbal": ("customer", "c_acctbal"),
    "city": ("nation", "n_name"),
    "category": ("part", "p_type"),
    "product": ("part", "p_name"),
    "brand": ("part", "p_brand"),
}

FULL_FACT = ("order_key", "line_number", "date", "customer_id", "category", "product", "sku", "brand",
             "quantity", "unit_price", "discount", "total_price", "is_holiday", "city", "loyalty_tier")


def fact(*cols: str) -> str:
    """Subquery with the fact columns ``cols`` (joins only what they need)."""
    need = {_FX[c][0] for c in cols} | {"lineitem"}
    if "nation" in need:
        need.add("customer")
    if "customer" in need:
        need.add("orders")
    src = "lineitem"
    if "orders" in need:
        src += " LEFT JOIN orders ON l_orderkey = o_orderkey"
    if "customer" in need:
        src += " LEFT JOIN customer ON o_custkey = c_custkey"
    if "nation" in need:
        src += " LEFT JOIN nation ON c_nationkey = n_nationkey"
    if "part" in need:
        src += " LEFT JOIN part ON l_partkey = p_partkey"
    sel = ", ".join(f"{_FX[c][1]} AS {c}" for c in cols)
    return f"(SELECT {sel} FROM {src})"


SQL: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    SQL[name] = sql.strip()


# ------------------------------------------------------------------ shared CTEs

ORDERS = f"""o AS (
  SELECT order_key, customer_id, date, SUM(revenue_dec) AS revenue_dec, SUM(quantity) AS units, COUNT(*) AS lines
  FROM {fact('order_key', 'customer_id', 'date', 'revenue_dec', 'quantity')}
  GROUP BY order_key, customer_id, date)"""

RFM_BASE = ORDERS + """,
snap AS (SELECT MAX(date) AS s FROM o),
base AS (
  SELECT customer_id,
         CAST(date_diff('day', MAX(date), (SELECT s FROM snap)) AS INTEGER) AS recency,
         COUNT(*) AS frequency,
         SUM(revenue_dec) AS monetary_dec,
         CAST(SUM(revenue_dec) AS DOUBLE) AS monetary,
         COALESCE(CAST(SUM(revenue_dec) AS DOUBLE) / COUNT(*), 0.0) AS avg_order_value
  FROM o WHERE customer_id IS NOT NULL GROUP BY customer_id)"""


def _segment_case(col: str) -> str:
    whens = " ".join(
        f"WHEN {col} IN ({', '.join(repr(c) for c in codes)}) THEN '{name}'" for name, codes in SEGMENT_RULES)
    return f"CASE {whens} ELSE '{DEFAULT_SEGMENT}' END"


RFM_SCORES = RFM_BASE + f""",
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY frequency, customer_id) AS f_rank FROM base),
cuts AS (
  SELECT quantile_cont(CAST(recency AS DOUBLE), [0.25, 0.5, 0.75]) AS rq,
         quantile_cont(monetary, [0.25, 0.5, 0.75]) AS mq,
         COUNT(*) AS n
  FROM base),
scored AS (
  SELECT customer_id, recency, frequency, monetary, avg_order_value, monetary_dec,
         CASE WHEN recency <= rq[1] THEN '4' WHEN recency <= rq[2] THEN '3'
              WHEN recency <= rq[3] THEN '2' ELSE '1' END AS r_score,
         CASE WHEN f_rank <= 1 + 0.25 * (n - 1) THEN '1' WHEN f_rank <= 1 + 0.5 * (n - 1) THEN '2'
              WHEN f_rank <= 1 + 0.75 * (n - 1) THEN '3' ELSE '4' END AS f_score,
         CASE WHEN monetary <= mq[1] THEN '1' WHEN monetary <= mq[2] THEN '2'
              WHEN monetary <= mq[3] THEN '3' ELSE '4' END AS m_score
  FROM ranked, cuts),
coded AS (SELECT *, r_score || f_score || m_score AS rfm_score FROM scored),
seg AS (SELECT *, {_segment_case('rfm_score')} AS segment FROM coded)"""

SEG_COLS = "customer_id, recency, frequency, monetary, avg_order_value, r_score, f_score, m_score, rfm_score"

DPS = f"""dps AS (
  SELECT date, product, category, SUM(quantity) AS units, CAST(SUM(revenue_dec) AS DOUBLE) AS revenue
  FROM {fact('date', 'product', 'category', 'quantity', 'revenue_dec')}
  WHERE date IS NOT NULL AND product IS NOT NULL AND category IS NOT NULL
  GROUP BY date, product, category)"""

DAILY_REV = f"""daily AS (
  SELECT date, CAST(SUM(revenue_dec) AS DOUBLE) AS revenue
  FROM {fact('date', 'revenue_dec')} WHERE date IS NOT NULL GROUP BY date)"""

DAILY_METRICS = ORDERS + """,
dm AS (
  SELECT date, CAST(SUM(revenue_dec) AS DOUBLE) AS revenue, SUM(units) AS units,
         COUNT(DISTINCT customer_id) AS unique_customers, COUNT(*) AS transactions
  FROM o WHERE date IS NOT NULL GROUP BY date)"""


def _roll(n: int) -> str:
    w = f"(ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    x = "CAST(revenue AS DECIMAL(19,4))"
    s1 = f"CAST(SUM({x}) OVER {w} AS DOUBLE)"
    s2 = f"CAST(SUM({x} * {x}) OVER {w} AS DOUBLE)"
    full = f"COUNT(revenue) OVER {w} >= {n}"
    var = f"GREATEST({D(0.0)}, ({s2} - {s1} * {s1} / {D(float(n))}) / {D(float(n - 1))})"
    return (f"CASE WHEN {full} THEN {s1} / {D(float(n))} END AS revenue_rolling_mean_{n}, "
            f"CASE WHEN {full} THEN CAST(ROUND(CAST(CAST(SQRT({var}) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) END AS revenue_rolling_std_{n}")


DAILY_FEATURES = DAILY_METRICS + f""",
df0 AS (
  SELECT date, revenue, units, unique_customers, transactions,
         CAST(isodow(date) - 1 AS INTEGER) AS dayofweek,
         CAST(month(date) AS INTEGER) AS month,
         CAST(quarter(date) AS INTEGER) AS quarter,
         CAST(dayofyear(date) AS INTEGER) AS dayofyear,
         CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
         {', '.join(f'LAG(revenue, {k}) OVER (ORDER BY date) AS revenue_lag_{k}' for k in (1, 2, 3, 7, 14))},
         {_roll(7)}, {_roll(14)}
  FROM dm),
dfeat AS (SELECT * FROM df0 WHERE revenue_lag_14 IS NOT NULL AND revenue_rolling_std_14 IS NOT NULL
          AND revenue_lag_1 IS NOT NULL AND revenue_rolling_std_7 IS NOT NULL)"""

CAL = ("CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, "
       "CAST(quarter(date) AS INTEGER) AS quarter, CAST(dayofyear(date) AS INTEGER) AS day_of_year, "
       "CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend")

# ------------------------------------------------------------------ sources & sinks

q("sales_fact", f"SELECT * FROM {fact(*FULL_FACT)}")
q("dim_products", f"SELECT DISTINCT product, category FROM {fact('product', 'category')}")
q("dim_customers", f"""WITH {RFM_SCORES}
SELECT s.customer_id, recency, frequency, monetary, avg_order_value, segment, c_mktsegment AS loyalty_tier
FROM seg s LEFT JOIN customer ON s.customer_id = c_custkey""")

PRODUCT_PERFORMANCE = f"""SELECT category, product, CAST(SUM(revenue_dec) AS DOUBLE) AS total_revenue,
  SUM(quantity) AS total_units, COUNT(DISTINCT order_key) AS transaction_count
FROM {fact('category', 'product', 'revenue_dec', 'quantity', 'order_key')}
WHERE category IS NOT NULL AND product IS NOT NULL GROUP BY category, product"""
q("product_performance", PRODUCT_PERFORMANCE)
q("export_csv_roundtrip", f"SELECT * FROM {fact(*FULL_FACT)}")

_ORDER_ALL = ", ".join(f"{c} NULLS FIRST" for c in FULL_FACT)
q("export_sample", f"SELECT * FROM {fact(*FULL_FACT)} ORDER BY {_ORDER_ALL} LIMIT 10000")
q("preview", f"SELECT * FROM {fact(*FULL_FACT)} ORDER BY {_ORDER_ALL} LIMIT 5")

# ------------------------------------------------------------------ projections

q("line_totals", f"""SELECT order_key, line_number, sku, date, quantity, unit_price, discount, is_holiday,
  CAST(CAST(extended_price AS DECIMAL(18,2)) AS DOUBLE) AS line_total,
  CAST(revenue_dec AS DOUBLE) AS net_total,
  CAST(revenue_dec * CASE WHEN is_holiday THEN 1.5 ELSE 1.0 END AS DOUBLE) AS holiday_adjusted_total
FROM {fact('order_key', 'line_number', 'sku', 'date', 'quantity', 'unit_price', 'discount', 'is_holiday',
           'extended_price', 'revenue_dec')}""")

q("holiday_sales", f"""SELECT is_holiday, COUNT(*) AS lines, COUNT(DISTINCT order_key) AS transactions,
  SUM(quantity) AS units, CAST(SUM(revenue_dec) AS DOUBLE) AS revenue
FROM {fact('is_holiday', 'order_key', 'quantity', 'revenue_dec')} GROUP BY is_holiday""")

q("season_mix", f"""WITH sc AS (
  SELECT CASE WHEN month(date) IN (11, 12) THEN 'HOLIDAY' ELSE 'REGULAR' END AS season, category,
         SUM(revenue_dec) AS rev, COUNT(*) AS lines
  FROM {fact('date', 'category', 'revenue_dec')} WHERE category IS NOT NULL GROUP BY 1, 2)
SELECT season, category, lines, CAST(rev AS DOUBLE) AS revenue,
       CAST(rev AS DOUBLE) / CAST(SUM(rev) OVER (PARTITION BY season) AS DOUBLE) AS share
FROM sc""")

q("lag_features_named", f"""WITH {DPS}
SELECT date, product, category, units,
  LAG(units, 1) OVER (PARTITION BY product, category ORDER BY date) AS lag1,
  LAG(units, 7) OVER (PARTITION BY product, category ORDER BY date) AS lag7
FROM dps WHERE product IN (SELECT p_name FROM part WHERE p_name IS NOT NULL GROUP BY p_name ORDER BY p_name LIMIT 2)""")

q("lag_features_top5", f"""WITH {DPS},
firsts AS (SELECT product, MIN(date) AS first_date FROM {fact('date', 'product')} WHERE product IS NOT NULL
           GROUP BY product ORDER BY first_date, product LIMIT 5)
SELECT date, product, category, units,
  LAG(units, 1) OVER (PARTITION BY product, category ORDER BY date) AS lag1,
  LAG(units, 7) OVER (PARTITION BY product, category ORDER BY date) AS lag7
FROM dps WHERE product IN (SELECT product FROM firsts)""")

q("model_frame", f"""WITH {DPS},
f AS (
  SELECT date, product, category, units,
    CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
    CAST(quarter(date) AS INTEGER) AS quarter, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
    LAG(units, 1) OVER w AS lag1, LAG(units, 7) OVER w AS lag7,
    AVG(units) OVER (PARTITION BY product, category ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
      AS rolling_mean_7
  FROM dps WINDOW w AS (PARTITION BY product, category ORDER BY date)),
m AS (SELECT * FROM f WHERE lag1 IS NOT NULL AND lag7 IS NOT NULL),
codes AS (SELECT product, CAST(DENSE_RANK() OVER (ORDER BY product) - 1 AS INTEGER) AS product_code
          FROM (SELECT DISTINCT product FROM m))
SELECT m.*, product_code FROM m JOIN codes USING (product)""")

q("daily_features", f"WITH {DAILY_FEATURES} SELECT * FROM dfeat")

# ------------------------------------------------------------------ joins

FIRST_ATTRS = f"""fa AS (
  SELECT customer_id, date AS first_date, product AS first_product, category AS first_category,
         loyalty_tier, city
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id
                                     ORDER BY date, order_key, line_number, sku) AS rn
        FROM {fact('customer_id', 'date', 'order_key', 'line_number', 'sku', 'product', 'category', 'loyalty_tier', 'city')}
        WHERE customer_id IS NOT NULL)
  WHERE rn = 1)"""

q("customer_first_attributes", f"WITH {FIRST_ATTRS} SELECT * FROM fa")
q("rfm_with_attributes", f"""WITH {RFM_BASE}, {FIRST_ATTRS}
SELECT b.customer_id, recency, frequency, monetary, avg_order_value,
       first_date, first_product, first_category, loyalty_tier, city
FROM base b LEFT JOIN fa USING (customer_id)""")


def _pairs(item: str, min_support: float) -> str:
    return f"""WITH items AS (SELECT DISTINCT order_key AS basket, {item} AS item FROM {fact('order_key', item)}
               WHERE {item} IS NOT NULL),
nb AS (SELECT COUNT(DISTINCT basket) AS baskets FROM items),
pc AS (SELECT a.item AS item_a, b.item AS item_b, COUNT(*) AS pair_count
       FROM items a JOIN items b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2)
SELECT item_a, item_b, pair_count, pair_count / baskets AS support
FROM pc, nb WHERE pair_count / baskets >= {D(min_support)}"""


q("basket_pairs", _pairs("category", PAIR_MIN_SUPPORT))
q("basket_pairs_brand", _pairs("brand", 0.01))
q("basket_pairs_product", _pairs("product", 0.003))
q("basket_pairs_top", _pairs("category", PAIR_MIN_SUPPORT) + " ORDER BY support DESC, item_a, item_b LIMIT 10")
q("basket_pairs_sample", f"""WITH sample AS (SELECT DISTINCT order_key FROM {fact('order_key')} ORDER BY order_key LIMIT 2000),
f AS (SELECT * FROM {fact('order_key', 'category')} WHERE order_key IN (SELECT order_key FROM sample)),
items AS (SELECT DISTINCT order_key AS basket, category AS item FROM f WHERE category IS NOT NULL),
nb AS (SELECT COUNT(DISTINCT basket) AS baskets FROM items),
pc AS (SELECT a.item AS item_a, b.item AS item_b, COUNT(*) AS pair_count
       FROM items a JOIN items b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2)
SELECT item_a, item_b, pair_count, pair_count / baskets AS support
FROM pc, nb WHERE pair_count / baskets >= {D(PAIR_MIN_SUPPORT)}""")

q("basket_pairs_multiset", f"""WITH per AS (SELECT order_key AS basket, category AS item, COUNT(*) AS n
             FROM {fact('order_key', 'category')} WHERE category IS NOT NULL GROUP BY 1, 2),
nb AS (SELECT COUNT(DISTINCT basket) AS baskets FROM per),
w AS (SELECT a.item AS item_a, b.item AS item_b, a.n * b.n AS w
      FROM per a JOIN per b ON a.basket = b.basket AND a.item < b.item
      UNION ALL
      SELECT item, item, CAST(n * (n - 1) / 2 AS BIGINT) FROM per WHERE n >= 2),
pc AS (SELECT item_a, item_b, CAST(SUM(w) AS BIGINT) AS pair_count FROM w GROUP BY 1, 2)
SELECT item_a, item_b, pair_count, pair_count / baskets AS support FROM pc, nb""")

# ------------------------------------------------------------------ aggregations


def _rev_by(key: str) -> str:
    return (f"SELECT {key}, CAST(SUM(revenue_dec) AS DOUBLE) AS revenue FROM {fact(key, 'revenue_dec')} "
            f"WHERE {key} IS NOT NULL GROUP BY {key}")


q("daily_revenue", _rev_by("date"))
q("category_revenue", _rev_by("category"))
q("tier_revenue", _rev_by("loyalty_tier"))
q("daily_product_sales", f"WITH {DPS} SELECT * FROM dps")
q("rfm_base", f"WITH {RFM_BASE} SELECT customer_id, recency, frequency, monetary, avg_order_value FROM base")
q("segment_profiles", f"""WITH {RFM_SCORES}
SELECT segment,
  {R2('SUM(recency) / COUNT(*)')} AS recency,
  {R2('SUM(frequency) / COUNT(*)')} AS frequency,
  {R2('CAST(SUM(monetary_dec) AS DOUBLE) / COUNT(*)')} AS monetary,
  {R2('AVG(avg_order_value)')} AS avg_order_value,
  COUNT(*) AS customers
FROM seg GROUP BY segment""")

_CATS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
q("seasonal_demand", f"""SELECT CAST(month(date) AS INTEGER) AS month,
  {', '.join(f"SUM(quantity) FILTER (WHERE category = '{c}') AS units_{c.lower()}" for c in _CATS)}
FROM {fact('date', 'category', 'quantity')} GROUP BY 1""")

_VOL = f"""vol AS (
  SELECT product, mean, std, std / mean AS cv, std * {D(SAFETY_Z_SIMPLE)} AS safety_stock
  FROM (SELECT product, AVG(quantity) AS mean, CAST(ROUND(CAST(CAST(STDDEV_SAMP(quantity) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS std
        FROM {fact('product', 'quantity')} WHERE product IS NOT NULL GROUP BY product))"""
q("product_volatility", f"WITH {_VOL} SELECT * FROM vol")
q("top_volatile", f"WITH {_VOL} SELECT * FROM vol ORDER BY cv DESC NULLS LAST, product LIMIT 10")
q("safety_stock_simple", f"WITH {_VOL} SELECT product, mean, safety_stock FROM vol ORDER BY product LIMIT 10")

q("daily_metrics", f"WITH {DAILY_METRICS} SELECT * FROM dm")
q("weekday_pattern", f"""WITH {ORDERS}
SELECT CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, strftime(date, '%a') AS day_name,
  CAST(SUM(revenue_dec) AS DOUBLE) / COUNT(*) AS avg_transaction_value, COUNT(*) AS transactions
FROM o WHERE date IS NOT NULL GROUP BY 1, 2""")
q("top_products", _rev_by("product") + " ORDER BY revenue DESC, product LIMIT 10")
q("segment_distribution", f"""WITH {RFM_SCORES}
SELECT segment, customers, CAST(customers AS DOUBLE) * {D(100.0)} / CAST(SUM(customers) OVER () AS DOUBLE) AS share_pct
FROM (SELECT segment, COUNT(*) AS customers FROM seg GROUP BY segment)""")
q("segment_revenue", f"""WITH {RFM_SCORES}
SELECT segment, CAST(SUM(monetary_dec) AS DOUBLE) AS revenue FROM seg GROUP BY segment""")

_YEARS = list(range(1995, 2002))
q("monthly_year_revenue", f"""SELECT CAST(month(date) AS INTEGER) AS month,
  {', '.join(f'CAST(SUM(revenue_dec) FILTER (WHERE year(date) = {y}) AS DOUBLE) AS y_{y}' for y in _YEARS)}
FROM {fact('date', 'revenue_dec')} GROUP BY 1""")

PRODUCT_DEMAND = f"""pd AS (
  SELECT product, AVG(quantity) AS avg_demand, CAST(ROUND(CAST(CAST(STDDEV_SAMP(quantity) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS std_demand,
         SUM(quantity) AS total_demand, COUNT(DISTINCT order_key) AS frequency
  FROM {fact('product', 'quantity', 'order_key')} WHERE product IS NOT NULL GROUP BY product)"""
q("product_demand", f"WITH {PRODUCT_DEMAND} SELECT * FROM pd")

_SS = f"std_demand * {D(Z_95)} * {D(math.sqrt(LEAD_TIME_DAYS))}"
REORDER = f"""{PRODUCT_DEMAND},
rp AS (SELECT *, {_SS} AS safety_stock, avg_demand * {D(float(LEAD_TIME_DAYS))} + {_SS} AS reorder_point FROM pd)"""
q("reorder_points", f"WITH {REORDER} SELECT * FROM rp")
q("top_demand", f"WITH {REORDER} SELECT * FROM rp ORDER BY total_demand DESC, product LIMIT 10")

q("kpi_summary", f"""WITH {ORDERS},
a AS (SELECT COUNT(*) AS transactions, CAST(SUM(lines) AS BIGINT) AS lines, CAST(SUM(revenue_dec) AS DOUBLE) AS total_revenue,
             CAST(SUM(revenue_dec) AS DOUBLE) / COUNT(*) AS avg_order_value, SUM(units) AS total_units,
             COUNT(DISTINCT customer_id) AS unique_customers, MIN(date) AS first_date, MAX(date) AS last_date FROM o),
p AS (SELECT COUNT(DISTINCT product) AS unique_products, COUNT(DISTINCT category) AS unique_categories
      FROM {fact('product', 'category')})
SELECT * FROM a, p""")

_STATS = ("customer_id", "quantity", "unit_price", "discount", "total_price")
q("column_statistics", f"WITH f AS (SELECT * FROM {fact(*_STATS)})\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, COUNT({c}) AS count, CAST(ROUND(CAST(CAST(AVG(CAST({c} AS DOUBLE)) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS mean,
  CAST(ROUND(CAST(CAST(STDDEV_SAMP(CAST({c} AS DOUBLE)) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS std, MIN(CAST({c} AS DOUBLE)) AS min,
  CAST(ROUND(CAST(CAST(quantile_cont(CAST({c} AS DOUBLE), 0.25) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS p25, CAST(ROUND(CAST(CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS p50,
  CAST(ROUND(CAST(CAST(quantile_cont(CAST({c} AS DOUBLE), 0.75) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS p75, MAX(CAST({c} AS DOUBLE)) AS max FROM f""" for c in _STATS))

_TYPES = {"order_key": "bigint", "line_number": "int", "date": "date", "customer_id": "bigint",
          "category": "string", "product": "string", "sku": "bigint", "brand": "string", "quantity": "double",
          "unit_price": "double", "discount": "double", "total_price": "double", "is_holiday": "boolean",
          "city": "string", "loyalty_tier": "string"}
q("null_counts", f"WITH f AS (SELECT * FROM {fact(*FULL_FACT)})\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{_TYPES[c]}' AS data_type, COUNT({c}) AS non_null, "
    f"COUNT(*) - COUNT({c}) AS nulls FROM f" for c in FULL_FACT))

q("baskets", f"""WITH per AS (SELECT order_key, product AS item, COUNT(*) AS multiplicity
             FROM {fact('order_key', 'product')} WHERE product IS NOT NULL GROUP BY 1, 2)
SELECT order_key, item, multiplicity,
       CAST(SUM(multiplicity) OVER (PARTITION BY order_key) AS BIGINT) AS basket_size,
       COUNT(*) OVER (PARTITION BY order_key) AS distinct_items
FROM per""")

q("customer_value_summary", f"""WITH {RFM_SCORES}
SELECT COUNT(*) AS customers, CAST(SUM(monetary_dec) AS DOUBLE) / COUNT(*) AS avg_customer_value,
       CAST(SUM(monetary_dec) AS DOUBLE) AS total_customer_value FROM seg""")

# ------------------------------------------------------------------ windows

q("lag_features", f"""WITH {DPS}
SELECT date, product, category, units,
  LAG(units, 1) OVER w AS lag1, LAG(units, 7) OVER w AS lag7
FROM dps WINDOW w AS (PARTITION BY product, category ORDER BY date)""")
q("rolling_mean_product", f"""WITH {DPS}
SELECT date, product, category, units,
  AVG(units) OVER (PARTITION BY product, category ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
    AS rolling_mean_7
FROM dps""")
q("rfm_scores", f"WITH {RFM_SCORES} SELECT {SEG_COLS} FROM coded")
q("rfm_segments", f"WITH {RFM_SCORES} SELECT {SEG_COLS}, segment FROM seg")
q("top_segment", f"""WITH {RFM_SCORES}
SELECT segment, COUNT(*) AS customers FROM seg GROUP BY segment ORDER BY customers DESC, segment LIMIT 1""")

q("revenue_sequences", f"""WITH {DAILY_FEATURES},
s AS (
  SELECT date, revenue AS target,
    list(revenue) OVER w AS win,
    CAST(SUM(CAST(revenue AS DECIMAL(18,4))) OVER w AS DOUBLE) AS window_sum
  FROM dfeat WINDOW w AS (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT date, target, win[1] AS window_first, win[30] AS window_last, window_sum,
       CAST(len(win) AS INTEGER) AS window_size
FROM s WHERE len(win) = 30""")

q("chrono_split", f"""WITH {DAILY_FEATURES},
s AS (SELECT date, revenue, ROW_NUMBER() OVER (ORDER BY date) AS row_index, COUNT(*) OVER () AS n FROM dfeat)
SELECT date, revenue, CAST(row_index AS INTEGER) AS row_index,
  CASE WHEN row_index <= floor(n * {D(0.8)}) THEN 'train' ELSE 'validation' END AS split FROM s""")

q("last_90_days", f"WITH {DAILY_REV} SELECT * FROM daily ORDER BY date DESC LIMIT 90")

# ------------------------------------------------------------------ calendar / scalar

q("future_calendar", f"""WITH {DAILY_REV}
SELECT date, false AS is_future FROM daily
UNION ALL
SELECT CAST((SELECT MAX(date) FROM daily) + CAST(i AS INTEGER) AS DATE), true FROM range(1, 91) t(i)""")

q("calendar_features", f"""SELECT date, {CAL}, CAST(year(date) AS INTEGER) AS year, strftime(date, '%a') AS day_name
FROM (SELECT DISTINCT date FROM {fact('date')} WHERE date IS NOT NULL)""")

q("calendar_fill", f"""WITH {DAILY_REV},
days AS (SELECT CAST(d AS DATE) AS date FROM range((SELECT MIN(date) FROM daily),
         (SELECT MAX(date) FROM daily) + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d))
SELECT days.date, COALESCE(revenue, 0.0) AS revenue, revenue IS NOT NULL AS has_sales
FROM days LEFT JOIN daily USING (date)""")

q("transaction_labels", f"""SELECT order_key, printf('TXN_%06d', order_key) AS transaction_label
FROM (SELECT DISTINCT order_key FROM {fact('order_key')})""")

q("product_encoding", f"""WITH {DPS}
SELECT product, CAST(DENSE_RANK() OVER (ORDER BY product) - 1 AS INTEGER) AS product_code
FROM (SELECT DISTINCT product FROM dps)""")

# ------------------------------------------------------------------ customers

q("rfm_scaled", f"""WITH {RFM_BASE},
st AS (SELECT AVG(recency) AS mu_r, AVG(frequency) AS mu_f,
              CAST(SUM(monetary_dec) AS DOUBLE) / COUNT(*) AS mu_m, AVG(avg_order_value) AS mu_a,
              STDDEV_SAMP(recency) AS sd_r, STDDEV_SAMP(frequency) AS sd_f,
              STDDEV_SAMP(monetary) AS sd_m, STDDEV_SAMP(avg_order_value) AS sd_a FROM base)
SELECT customer_id,
  CAST(ROUND(CAST(CAST((recency - mu_r) / sd_r AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS recency_z,
  CAST(ROUND(CAST(CAST((frequency - mu_f) / sd_f AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS frequency_z,
  CAST(ROUND(CAST(CAST((monetary - mu_m) / sd_m AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS monetary_z,
  CAST(ROUND(CAST(CAST((avg_order_value - mu_a) / sd_a AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS avg_order_value_z
FROM base, st""")

q("customer_clv", f"""WITH {ORDERS},
per AS (SELECT customer_id, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) AS frequency,
               SUM(revenue_dec) AS m FROM o WHERE customer_id IS NOT NULL GROUP BY customer_id),
c AS (SELECT *, CAST(m AS DOUBLE) / frequency AS avg_order_value,
             CAST(frequency * 365 AS DOUBLE) / CAST(GREATEST(date_diff('day', first_date, last_date) + 1, 365) AS DOUBLE)
               AS orders_per_year FROM per)
SELECT customer_id, first_date, last_date, frequency, avg_order_value, orders_per_year,
       CAST(ROUND(CAST(CAST(avg_order_value * orders_per_year * {D(3.0)} AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS clv FROM c""")

QUARTERS = f"""{ORDERS},
cq AS (SELECT DISTINCT customer_id, CAST(year(date) * 4 + quarter(date) AS INTEGER) AS q FROM o
       WHERE customer_id IS NOT NULL AND date IS NOT NULL),
each AS (SELECT customer_id, CAST(COUNT(*) - 1 AS INTEGER) AS x, CAST(MAX(q) - MIN(q) AS INTEGER) AS t,
                CAST((SELECT MAX(q) FROM cq) - MIN(q) AS INTEGER) AS n FROM cq GROUP BY customer_id)"""
q("purchase_histogram", f"WITH {QUARTERS} SELECT x, t, n, COUNT(*) AS customers FROM each GROUP BY x, t, n")

# ------------------------------------------------------------------ baskets

q("association_rules", f"""WITH items AS (SELECT DISTINCT order_key AS basket, category AS item
               FROM {fact('order_key', 'category')} WHERE category IS NOT NULL),
nb AS (SELECT COUNT(DISTINCT basket) AS baskets FROM items),
sup AS (SELECT item, COUNT(*) AS item_baskets FROM items GROUP BY item),
pc AS (SELECT a.item AS item_a, b.item AS item_b, COUNT(*) AS pair_count
       FROM items a JOIN items b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2),
fp AS (SELECT item_a, item_b, pair_count FROM pc, nb WHERE pair_count / baskets >= {D(PAIR_MIN_SUPPORT)}),
both_ AS (SELECT item_a AS antecedent, item_b AS consequent, pair_count FROM fp
          UNION ALL SELECT item_b, item_a, pair_count FROM fp)
SELECT antecedent, consequent, pair_count, pair_count / baskets AS support,
       pair_count / sa.item_baskets AS confidence,
       (pair_count * baskets) / (sa.item_baskets * sc.item_baskets) AS lift
FROM both_ JOIN sup sa ON sa.item = antecedent JOIN sup sc ON sc.item = consequent, nb""")

# frequent itemsets of every size (FP-growth's output): each basket's item
# subsets enumerated in sorted order, counted, kept at >= ceil(support * baskets)
q("frequent_itemsets", f"""WITH RECURSIVE items AS (
  SELECT DISTINCT order_key AS b, category AS item FROM {fact('order_key', 'category')} WHERE category IS NOT NULL),
n AS (SELECT COUNT(DISTINCT b) AS baskets FROM items),
sets(b, last, itemset, size) AS (
  SELECT b, item, item, 1 FROM items
  UNION ALL
  SELECT s.b, i.item, s.itemset || '|' || i.item, s.size + 1 FROM sets s JOIN items i ON i.b = s.b AND i.item > s.last)
SELECT itemset, CAST(size AS INTEGER) AS size, COUNT(*) AS baskets FROM sets GROUP BY itemset, size
HAVING COUNT(*) >= CEIL({D(PAIR_MIN_SUPPORT)} * (SELECT baskets FROM n))""")

# ------------------------------------------------------------------ inventory

q("reorder_points_daily", f"""WITH f AS (SELECT * FROM {fact('product', 'date', 'quantity')}),
span AS (SELECT CAST(date_diff('day', MIN(date), MAX(date)) + 1 AS INTEGER) AS days FROM f),
pdd AS (SELECT product, date, SUM(quantity) AS units FROM f WHERE product IS NOT NULL GROUP BY 1, 2),
s AS (SELECT product, SUM(units) AS total_demand, SUM(units * units) AS s2, COUNT(*) AS selling_days
      FROM pdd GROUP BY product),
o AS (SELECT product, days, selling_days, total_demand,
             total_demand / CAST(days AS DOUBLE) AS avg_daily_demand,
             CASE WHEN days > 1 THEN CAST(ROUND(CAST(CAST(SQRT(GREATEST(
               (s2 - total_demand * total_demand / CAST(days AS DOUBLE)) / (CAST(days AS DOUBLE) - {D(1.0)}),
               {D(0.0)})) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) END AS std_daily_demand
      FROM s, span)
SELECT *, std_daily_demand * {D(Z_95)} * {D(math.sqrt(LEAD_TIME_DAYS))} AS safety_stock,
       avg_daily_demand * {D(float(LEAD_TIME_DAYS))}
         + std_daily_demand * {D(Z_95)} * {D(math.sqrt(LEAD_TIME_DAYS))} AS reorder_point
FROM o""")

q("economic_order_quantity", f"""WITH f AS (SELECT * FROM {fact('product', 'date', 'quantity', 'extended_price')}),
span AS (SELECT date_diff('day', MIN(date), MAX(date)) + 1 AS days FROM f),
s AS (SELECT product, SUM(quantity) AS total_units, SUM(CAST(extended_price AS DECIMAL(18,2))) AS v
      FROM f WHERE product IS NOT NULL GROUP BY product),
c AS (SELECT product, total_units, total_units * {D(DAYS_PER_YEAR)} / CAST(days AS DOUBLE) AS annual_demand,
             CAST(v AS DOUBLE) / total_units AS unit_cost FROM s, span)
SELECT product, total_units, annual_demand, unit_cost,
       CAST(ROUND(CAST(CAST(SQRT({D(2.0)} * annual_demand * {D(ORDER_COST)} / ({D(HOLDING_RATE)} * unit_cost)) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS eoq
FROM c""")

# ------------------------------------------------------------------ forecasting (SQL-expressible)

q("trend_line", f"""WITH {DAILY_REV},
t AS (SELECT revenue, CAST(date_diff('day', (SELECT MIN(date) FROM daily), date) AS INTEGER) AS t FROM daily)
SELECT CAST(ROUND(CAST(CAST(regr_slope(revenue, t) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS slope, CAST(ROUND(CAST(CAST(regr_intercept(revenue, t) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS intercept,
       CAST(ROUND(CAST(CAST(regr_r2(revenue, t) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS r2, COUNT(*) AS n FROM t""")


def _fourier() -> str:
    cols = []
    for name, period, order in (("yearly", YEAR_DAYS, YEARLY_ORDER), ("weekly", WEEK_DAYS, WEEKLY_ORDER)):
        for k in range(1, order + 1):
            arg = f"{D(2.0 * math.pi * k)} * CAST(t AS DOUBLE) / {D(period)}"
            cols.append(f"CAST(ROUND(CAST(CAST(sin({arg}) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS {name}_sin_{k}")
            cols.append(f"CAST(ROUND(CAST(CAST(cos({arg}) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS {name}_cos_{k}")
    return ", ".join(cols)


q("seasonal_regressors", f"""WITH {DAILY_REV},
cal AS (SELECT date, false AS is_future FROM daily
        UNION ALL
        SELECT CAST((SELECT MAX(date) FROM daily) + CAST(i AS INTEGER) AS DATE), true FROM range(1, 91) r(i)),
ct AS (SELECT date, is_future, CAST(date_diff('day', (SELECT MIN(date) FROM cal), date) AS INTEGER) AS t FROM cal)
SELECT date, is_future, t, {_fourier()} FROM ct""")

q("minmax_revenue", f"""WITH {DAILY_FEATURES},
b AS (SELECT MIN(revenue) AS mn, MAX(revenue) AS mx FROM dfeat),
s AS (SELECT date, revenue, (revenue - mn) / (mx - mn) AS scaled, mn, mx FROM dfeat, b)
SELECT date, revenue, scaled, scaled * (mx - mn) + mn AS restored FROM s""")

q("forecast_metrics", f"""WITH {DAILY_REV},
s AS (SELECT revenue AS y, LAG(revenue, 7) OVER (ORDER BY date) AS p FROM daily),
e AS (SELECT y, p, y - p AS e FROM s WHERE p IS NOT NULL AND y IS NOT NULL)
SELECT COUNT(*) AS n, CAST(ROUND(CAST(CAST(AVG(abs(e)) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS mae,
       CAST(ROUND(CAST(CAST(SQRT(SUM(e * e) / COUNT(*)) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS rmse,
       CAST(ROUND(CAST(CAST({D(1.0)} - SUM(e * e) / (SUM(y * y) - SUM(y) * SUM(y) / COUNT(*)) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS r2,
       CAST(ROUND(CAST(CAST({D(100.0)} * AVG(abs(e) / GREATEST(abs(y), {D(MAPE_EPS)})) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS mape
FROM e""")

q("ses_level", f"""WITH {DPS},
pd AS (SELECT product, date, SUM(units) AS units FROM dps GROUP BY product, date)
SELECT product, CAST(COUNT(*) AS INTEGER) AS n_days,
       CAST(ROUND(CAST(CAST(list_reduce(list(units ORDER BY date),
             lambda acc, x: {D(SES_ALPHA)} * x + {D(1.0 - SES_ALPHA)} * acc) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS level
FROM pd GROUP BY product""")

q("ar1_by_product", f"""WITH {DPS},
pd AS (SELECT product, date, SUM(units) AS units FROM dps GROUP BY product, date),
l AS (SELECT product, units, LAG(units, 1) OVER (PARTITION BY product ORDER BY date) AS prev FROM pd)
SELECT product, CAST(ROUND(CAST(CAST(regr_slope(units, prev) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS phi, CAST(ROUND(CAST(CAST(regr_intercept(units, prev) AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE) AS c,
       COUNT(*) AS n
FROM l WHERE prev IS NOT NULL GROUP BY product""")


def R6(x: str) -> str:
    return f"CAST(ROUND(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,12)), 6) AS DOUBLE)"


def _levinson(most: int = 6) -> str:
    """One CTE an order: its last coefficient, the others, the error left."""
    steps, before = [], "s0"
    for p in range(1, most + 1):
        r = lambda k: f"r{k}" if k else "CAST(1 AS DOUBLE)"
        dot = " + ".join(f"a{p - 1}_{j} * {r(p - j)}" for j in range(1, p)) or "CAST(0 AS DOUBLE)"
        rest = "".join(f", a{p - 1}_{j} - k * a{p - 1}_{p - j} AS a{p}_{j}" for j in range(1, p))
        steps.append(f"s{p} AS (SELECT *, k AS a{p}_{p}{rest}, GREATEST(error_{p - 1} * (1 - k * k), {D(1e-12)}) AS error_{p} FROM"
                     f" (SELECT * {'EXCLUDE (k)' if p > 1 else ''}, ({r(p)} - ({dot})) / error_{p - 1} AS k FROM {before}))")
        before = f"s{p}"
    return ",\n".join(steps)


_LAGS = range(1, 7)
_PHI = [f"CASE {' '.join(f'WHEN ar_order = {p} THEN a{p}_{j}' for p in range(j, 7))} ELSE 0 END" for j in _LAGS]
q("ar_order_by_product", f"""WITH {DPS},
pd AS (SELECT product, date, CAST(SUM(units) AS DOUBLE) AS x FROM dps GROUP BY product, date),
l AS (SELECT product, x, {', '.join(f'LAG(x, {k}) OVER (PARTITION BY product ORDER BY date) AS b{k}' for k in _LAGS)} FROM pd),
a AS (SELECT product, COUNT(*) AS n, AVG(x) AS mean, SUM(x * x) AS q0,
             {', '.join(f'SUM(x * b{k}) AS q{k}, SUM(x + b{k}) AS e{k}' for k in _LAGS)} FROM l GROUP BY product),
s0 AS (SELECT product, n, mean, CAST(1 AS DOUBLE) AS error_0,
       {', '.join(f'CASE WHEN q0 - n * mean * mean > {D(1e-9)} * q0 AND n > {k} THEN (q{k} - mean * e{k} + (n - {k}) * mean * mean) / (q0 - n * mean * mean) ELSE 0 END AS r{k}' for k in _LAGS)} FROM a),
{_levinson()},
o AS (SELECT *, list_position([{', '.join(f'n * ln(error_{p}) + {2 * p}' for p in range(7))}],
                list_min([{', '.join(f'n * ln(error_{p}) + {2 * p}' for p in range(7))}])) - 1 AS ar_order FROM s6)
SELECT product, n, {R6('mean')} AS mean, CAST(ar_order AS INTEGER) AS ar_order, {', '.join(f'{R6(c)} AS phi_{j}' for j, c in enumerate(_PHI, 1))},
       {R6(f"CASE {' '.join(f'WHEN ar_order = {p} THEN error_{p}' for p in range(7))} END")} AS error, CAST(0 AS DOUBLE) AS off FROM o""")

# weights of level, trend and season that the smoothing tries
_TRIALS = [(a, b, g) for a in (0.1, 0.3, 0.5, 0.7, 0.9) for b in (0.0, 0.02, 0.1) for g in (0.0, 0.05, 0.1)]
q("seasonal_smoothing", f"""WITH RECURSIVE u AS (
  SELECT product, year(date) * 12 + month(date) - 1 AS m, CAST(SUM(quantity) AS DOUBLE) AS x
  FROM {fact('date', 'product', 'quantity')} WHERE date IS NOT NULL AND product IS NOT NULL GROUP BY 1, 2),
months AS (SELECT unnest(range((SELECT MIN(m) FROM u), (SELECT MAX(m) FROM u) + 1)) AS m),
xs AS (SELECT product, list(COALESCE(x, 0) ORDER BY m) AS x
       FROM (SELECT DISTINCT product FROM u) CROSS JOIN months LEFT JOIN u USING (product, m) GROUP BY product),
st AS (SELECT product, x, list_sum(x[1:12]) / 12 AS y1, list_sum(x[13:24]) / 12 AS y2 FROM xs WHERE len(x) >= 24),
tr AS (SELECT * FROM (VALUES {', '.join(f'({i}, {D(a)}, {D(b)}, {D(g)})' for i, (a, b, g) in enumerate(_TRIALS))}) v(trial, alpha, beta, gamma)),
f AS (SELECT product, trial, alpha, beta, gamma, 12 AS t, y1 + 5.5::DOUBLE * ((y2 - y1) / 12) AS level, (y2 - y1) / 12 AS trend,
             list_transform(x[1:12], lambda v, i: v - (y1 + (i - 6.5::DOUBLE) * ((y2 - y1) / 12))) AS season, CAST(0 AS DOUBLE) AS sse FROM st, tr
      UNION ALL
      SELECT product, trial, alpha, beta, gamma, t + 1, level + trend + alpha * e, trend + beta * e,
             list_append(season[2:12], season[1] + gamma * e), sse + e * e
      FROM (SELECT f.*, st.x[t + 1] - (level + trend + season[1]) AS e FROM f JOIN st USING (product) WHERE t < len(st.x))),
b AS (SELECT f.*, len(x) AS months, ROW_NUMBER() OVER (PARTITION BY product ORDER BY sse, trial) AS place
      FROM f JOIN st USING (product) WHERE t = len(x))
SELECT product, CAST(months AS INTEGER) AS months, alpha, beta, gamma, {R6('sqrt(sse / (months - 12))')} AS rmse, {R6('level')} AS level, {R6('trend')} AS trend,
       {R6('level + trend + season[1]')} AS next_month, {R6('level * 12 + trend * 78 + list_sum(season)')} AS next_year
FROM b WHERE place = 1""")


def _millionths() -> str:
    """The forecast's regressors in whole millionths, then revenue in hundredths."""
    cols = ["1000000", "t * 1000000 // days"]
    cols += [f"GREATEST(t - 80 * days * {j} // 2600, 0) * 1000000 // days" for j in range(1, 26)]
    for period, order in ((YEAR_DAYS, YEARLY_ORDER), (WEEK_DAYS, WEEKLY_ORDER)):
        for k in range(1, order + 1):
            for f in ("sin", "cos"):
                arg = f"{D(2.0 * math.pi * k)} * CAST(t AS DOUBLE) / {D(period)}"
                cols.append(f"ROUND(CAST(CAST({f}({arg}) AS VARCHAR) AS DECIMAL(38,12)), 6) * 1000000")
    cols.append("floor(revenue * 100 + 0.5)")
    return ", ".join(f"CAST({c} AS HUGEINT)" for c in cols)


q("forecast_gram", f"""WITH {DAILY_REV},
dt AS (SELECT revenue, CAST(date_diff('day', (SELECT MIN(date) FROM daily), date) AS BIGINT) AS t,
              CAST(date_diff('day', (SELECT MIN(date) FROM daily), (SELECT MAX(date) FROM daily)) AS BIGINT) AS days FROM daily),
x AS (SELECT t, [{_millionths()}] AS x FROM dt),
c AS (SELECT t, unnest(x) AS z, CAST(generate_subscripts(x, 1) AS INTEGER) AS i FROM x)
SELECT a.i AS i, b.i AS j, CAST(SUM(a.z * b.z) AS VARCHAR) AS value
FROM c a JOIN c b ON a.t = b.t AND a.i <= b.i GROUP BY a.i, b.i""")

# ------------------------------------------------------------------ report text

_KPI = f"""{ORDERS},
a AS (SELECT COUNT(*) AS transactions, CAST(SUM(revenue_dec) AS DOUBLE) AS total_revenue,
             CAST(SUM(revenue_dec) AS DOUBLE) / COUNT(*) AS avg_order_value,
             COUNT(DISTINCT customer_id) AS unique_customers, MIN(date) AS first_date, MAX(date) AS last_date FROM o),
p AS (SELECT COUNT(DISTINCT product) AS unique_products, COUNT(DISTINCT category) AS unique_categories
      FROM {fact('product', 'category')})"""
_LINES = [
    ("Total Transactions", "format('{:,}', transactions)"),
    ("Total Revenue", "'$' || format('{:,.2f}', " + R2("total_revenue") + ")"),
    ("Average Order Value", "'$' || format('{:,.2f}', " + R2("avg_order_value") + ")"),
    ("Unique Customers", "format('{:,}', unique_customers)"),
    ("Products", "CAST(unique_products AS VARCHAR)"),
    ("Categories", "CAST(unique_categories AS VARCHAR)"),
    ("Date Range", "CAST(first_date AS VARCHAR) || ' to ' || CAST(last_date AS VARCHAR)"),
]
q("kpi_report_lines", f"WITH {_KPI}\n" + "\nUNION ALL\n".join(
    f"SELECT {i + 1} AS line_no, '{label}: ' || {expr} AS text FROM a, p" for i, (label, expr) in enumerate(_LINES)))

# ------------------------------------------------------------------ seeded hash split

q("random_split", f"""WITH {DPS}
SELECT date, product, category,
  CASE WHEN CAST('0x' || substr(md5(concat_ws('|', '{SEED}', date, product, category)), 1, 8) AS BIGINT) % 100
            < {100 - TEST_PERCENT} THEN 'train' ELSE 'test' END AS split
FROM dps""")

# ------------------------------------------------------------------ models: what SQL can check

DEMAND_TEST = f"""{DPS},
f AS (SELECT *, LAG(units, 7) OVER (PARTITION BY product, category ORDER BY date) AS lag7 FROM dps),
test AS (SELECT * FROM f WHERE lag7 IS NOT NULL
  AND CAST('0x' || substr(md5(concat_ws('|', '42', date, product, category)), 1, 8) AS BIGINT) % 100 >= 80)"""
_CHECKS = {}
for _i in range(3):
    _CHECKS[f"demand_{_i}_rows"] = f"WITH {DEMAND_TEST} SELECT COUNT(*) FROM test"
    _CHECKS[f"demand_{_i}_actual"] = f"WITH {DEMAND_TEST} SELECT SUM(units) FROM test"
    _CHECKS[f"demand_{_i}_missing"] = "SELECT 0"
    _CHECKS[f"demand_{_i}_metrics_rows"] = "SELECT 1"
    _CHECKS[f"demand_{_i}_metrics_off"] = "SELECT 0"
_CHECKS |= {f"linear_fit_skew_{_i}": "SELECT 0" for _i in range(9)}  # the constant and eight features
_CHECKS["linear_fit_rows"] = f"WITH {DEMAND_TEST} SELECT (SELECT COUNT(*) FROM f WHERE lag7 IS NOT NULL) - (SELECT COUNT(*) FROM test)"
_SEQ = f"""{DAILY_FEATURES},
s AS (SELECT date, revenue, ROW_NUMBER() OVER (ORDER BY date) - 30 AS i, COUNT(*) OVER () - 30 AS n FROM dfeat)"""
_VAL = f"""{DAILY_FEATURES},
v AS (SELECT date, revenue, ROW_NUMBER() OVER (ORDER BY date) AS i, COUNT(*) OVER () AS n FROM dfeat)"""
_CHECKS |= {
    "forecast_rows": f"WITH {DAILY_REV} SELECT COUNT(*) + 90 FROM daily",
    "forecast_future": "SELECT 90",
    "forecast_actual": f"WITH {DAILY_REV} SELECT CAST(SUM(revenue) AS DECIMAL(38, 2)) FROM daily",
    "forecast_outside": "SELECT 0",
    "forecast_last_day": f"WITH {DAILY_REV} SELECT date_diff('day', DATE '1970-01-01', MAX(date)) + 90 FROM daily",
    "components_rows": f"WITH {DAILY_REV} SELECT COUNT(*) + 90 FROM daily",
    "components_off": "SELECT 0",
    "forecast_widths_rows": "SELECT 90",
    "forecast_widths_narrower": "SELECT 0",
    "forecast_optimal_rows": "SELECT 53",  # the line's two, 25 changes, 26 of the seasons
    "forecast_optimal_broken": "SELECT 0",
    "actual_vs_forecast_rows": f"WITH {DAILY_REV} SELECT LEAST(COUNT(*), 90) + 90 FROM daily",
    "clusters_rows": f"WITH {RFM_BASE} SELECT COUNT(*) FROM base",
    "clusters_frequency": f"WITH {RFM_BASE} SELECT SUM(frequency) FROM base",
    "clusters_segments": "SELECT 4",
    "clusters_fit_rows": f"WITH {RFM_BASE} SELECT COUNT(*) FROM base",
    "clusters_fit_far": "SELECT 0",
    "clusters_means_rows": "SELECT 4",
    "clusters_means_off": "SELECT 0",
    "pca_rows": f"WITH {RFM_BASE} SELECT COUNT(*) FROM base",
    "pca_correlated": "SELECT 0",
    "pca_off_centre": "SELECT 0",
    "pca_disordered": "SELECT 0",
    "lifetime_rows": f"WITH {QUARTERS} SELECT COUNT(*) FROM each",
    "lifetime_purchases": f"WITH {QUARTERS} SELECT SUM(x) FROM each",
    "lifetime_steep": "SELECT 0",
    "lifetime_outside": "SELECT 0",
    "forecast_results_rows": f"WITH {DEMAND_TEST} SELECT LEAST(COUNT(*), 100) FROM test",
    "forecast_results_actual": f"""WITH {DEMAND_TEST},
        t AS (SELECT units FROM test ORDER BY date, product, category LIMIT 100) SELECT SUM(units) FROM t""",
}
_TUNED_CHECKS = {
    "tuned_rows": "SELECT 20",
    "tuned_best": "SELECT 1",
    "tuned_iterations": "SELECT 0",
    "tuned_validation_rows": f"WITH {_VAL} SELECT COUNT(*) FROM v WHERE i > floor(n * 0.8)",
    "tuned_validation_actual": f"WITH {_VAL} SELECT CAST(SUM(revenue) AS DECIMAL(38, 2)) FROM v WHERE i > floor(n * 0.8)",
    "tuned_validation_missing": "SELECT 0",
    "tuned_validation_worse_than_mean": "SELECT 0",
    "tuned_metrics_rows": "SELECT 1",
    "tuned_metrics_off": "SELECT 0",
    "tuned_beaten_rows": "SELECT 0",
    "ar30_rows": f"WITH {_SEQ} SELECT COUNT(*) FROM s WHERE i > 0 AND i > floor(n * 0.8)",
    "ar30_actual": f"WITH {_SEQ} SELECT CAST(SUM(revenue) AS DECIMAL(38, 2)) FROM s WHERE i > 0 AND i > floor(n * 0.8)",
    "ar30_worse_than_mean": "SELECT 0",
    "best_model_rows": "SELECT 2",
}
for _name, _checks in (("model_checks", _CHECKS), ("tuned_model_checks", _TUNED_CHECKS)):
    q(_name, "\nUNION ALL\n".join(
        f"SELECT '{name}' AS \"check\", CAST(({sql}) AS DOUBLE) AS value" for name, sql in _checks.items()))

# ------------------------------------------------------------------ one K-means step, in whole numbers

_FEATS = ("recency", "frequency", "monetary", "avg_order_value")


def _grid(j: int) -> str:
    s, ss = f"CAST(s{j} AS DOUBLE)", f"CAST(q{j} AS DOUBLE)"
    spread = f"GREATEST({ss} - {s} * {s} / n, {D(0.0)}) / (n - 1)"
    return f"CASE WHEN {spread} > 0 THEN CAST(floor((CAST(x{j} AS DOUBLE) - {s} / n) / sqrt({spread}) * {D(4096.0)}) AS BIGINT) ELSE 0 END AS z{j}"


_DIST = " + ".join(f"(p.z{j} - c.z{j}) * (p.z{j} - c.z{j})" for j in range(4))
q("kmeans_first_step", f"""WITH {RFM_BASE},
whole AS (SELECT customer_id, CAST(recency AS BIGINT) AS x0, CAST(frequency AS BIGINT) AS x1,
                 CAST(CAST(monetary_dec AS DECIMAL(28,4)) * 10000 AS BIGINT) AS x2 FROM base),
x AS (SELECT *, x2 // x1 AS x3 FROM whole),
st AS (SELECT COUNT(*) AS n, {', '.join(f"SUM(CAST(x{j} AS HUGEINT)) AS s{j}, SUM(CAST(x{j} AS HUGEINT) * x{j}) AS q{j}" for j in range(4))} FROM x),
p AS (SELECT customer_id, {', '.join(_grid(j) for j in range(4))} FROM x, st),
c AS (SELECT z0, z1, z2, z3, ROW_NUMBER() OVER (ORDER BY md5(concat_ws('|', '42', customer_id)), customer_id) - 1 AS cluster
      FROM p QUALIFY cluster < 4),
near AS (SELECT p.*, c.cluster, {_DIST} AS distance FROM p, c
         QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY {_DIST}, c.cluster) = 1)
SELECT CAST(cluster AS INTEGER) AS cluster, COUNT(*) AS customers,
  {', '.join(f"CAST((SUM(z{j}) - ((SUM(z{j}) % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*) AS BIGINT) AS {f}" for j, f in enumerate(_FEATS))},
  CAST(SUM(distance) AS BIGINT) AS distance
FROM near GROUP BY cluster""")

# ------------------------------------------------------------------ export manifest

_MANIFEST_VIEWS = {
    "fact_transactions": f"SELECT COUNT(*) FROM {fact(*FULL_FACT)}",
    "dim_products": f"SELECT COUNT(*) FROM (SELECT DISTINCT product, category FROM {fact('product', 'category')})",
    "dim_customers": f"WITH {RFM_BASE} SELECT COUNT(*) FROM base",
    "daily_sales": f"WITH {DAILY_REV} SELECT COUNT(*) FROM daily",
    "segment_profiles": f"WITH {RFM_SCORES} SELECT COUNT(DISTINCT segment) FROM seg",
    "forecast_results": f"WITH {DEMAND_TEST} SELECT LEAST(COUNT(*), 100) FROM test",
    "customer_clusters": f"WITH {RFM_BASE} SELECT COUNT(*) FROM base",
    "cluster_profiles": "SELECT 4",
    "Transactions": f"SELECT LEAST(COUNT(*), 10000) FROM {fact(*FULL_FACT)}",
    "Customer_RFM": f"WITH {RFM_BASE} SELECT COUNT(*) FROM base",
    "Daily_Metrics": f"WITH {DAILY_FEATURES} SELECT COUNT(*) FROM dfeat",
    "Product_Performance": f"SELECT COUNT(*) FROM ({PRODUCT_PERFORMANCE})",
    "Revenue_Forecast": "SELECT 90",
    "Inventory_Optimization": f"WITH {PRODUCT_DEMAND} SELECT COUNT(*) FROM pd",
}
q("export_manifest", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS view_name, CAST(({sql}) AS BIGINT) AS rows" for name, sql in _MANIFEST_VIEWS.items()))

# ------------------------------------------------------------------ streaming (closed windows only)

q("stream_daily_value", """WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type, CAST(value AS DECIMAL(18,2)) AS value
           FROM events),
wm AS (SELECT MAX(ts) - INTERVAL 1 DAY AS watermark FROM e)
SELECT CAST(date_trunc('day', ts) AS DATE) AS window_date, event_type, COUNT(*) AS events,
       CAST(SUM(value) AS DOUBLE) AS total_value
FROM e, wm
GROUP BY 1, 2, watermark
HAVING date_trunc('day', MIN(ts)) + INTERVAL 1 DAY <= watermark""")
