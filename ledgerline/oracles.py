"""Each registered query as SQL over the given tables, for comparison in DuckDB."""

from __future__ import annotations

ORDERS = """
orders_v AS (
  SELECT event_id AS id,
    CASE WHEN event_type = 'signup' THEN 'SHIPPED' WHEN event_type = 'error' THEN 'FAILED'
         ELSE 'CREATED' END AS status,
    CASE WHEN k % 10 = 9 THEN NULL WHEN k % 10 < 3 THEN 'SHOES' WHEN k % 10 < 6 THEN 'WATCH'
         ELSE 'GUITAR' END AS product,
    CAST(event_id % 13 AS INT) - 1 AS quantity,
    CAST(floor(value) AS BIGINT) * 5 AS price,
    CASE WHEN user_id % 25 = 0 THEN NULL ELSE user_id END AS customer_id,
    ts, event_id AS seq
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events) e),
created_v AS (SELECT * FROM orders_v WHERE status = 'CREATED')"""

INVENTORY = """
inventory_v AS (
  SELECT product,
    CASE WHEN c.step = 2 AND product = 'WATCH' THEN NULL
         ELSE CAST(demand * c.tenths // 10 AS INT) END AS stock,
    CAST(c.at_ts AS TIMESTAMP) AS ts, CAST(c.step AS BIGINT) AS seq
  FROM (SELECT product, CAST(sum(quantity) AS BIGINT) AS demand FROM created_v
        WHERE product IS NOT NULL GROUP BY product) d
  CROSS JOIN (VALUES (1, 3, '2024-01-02 00:00:00'), (2, 4, '2024-01-10 00:00:00'),
                     (3, 6, '2024-01-15 00:00:00')) AS c(step, tenths, at_ts)),
inventory_now AS (
  SELECT product, stock, ts, seq
  FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ts DESC, seq DESC) AS n
        FROM inventory_v) r
  WHERE n = 1 AND stock IS NOT NULL)"""

VALIDATIONS = """
validations_v AS (
  SELECT o.id AS order_id, t.type,
    CASE WHEN (o.id + t.i) % 7 < 2 THEN 'FAIL' ELSE 'PASS' END AS result,
    o.ts + j.d AS ts, o.id * 4 + t.i AS seq
  FROM created_v o
  CROSS JOIN (VALUES (0, 'FRAUD_CHECK'), (1, 'ORDER_DETAILS_CHECK'), (2, 'INVENTORY_CHECK'),
                     (3, 'FRAUD_CHECK')) AS t(i, type)
  JOIN (VALUES (0, INTERVAL 0 MILLISECONDS), (1, INTERVAL 2 MILLISECONDS),
               (2, INTERVAL 4 MILLISECONDS), (3, INTERVAL 5 MILLISECONDS),
               (4, INTERVAL 11 MILLISECONDS), (5, INTERVAL 400000 MILLISECONDS)) AS j(n, d)
    ON j.n = (o.id + 3 * t.i) % 6
  WHERE t.i < 3 OR o.id % 4 = 0)"""

# Customer sessions: a new one after more than an hour.
SPENDING = """
spend_gaps AS (
  SELECT *, lag(ts) OVER (PARTITION BY customer_id ORDER BY ts, seq) AS before
  FROM created_v WHERE customer_id IS NOT NULL),
spend_sessions AS (
  SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 1 HOUR THEN 1 ELSE 0 END)
      OVER (PARTITION BY customer_id ORDER BY ts, seq) AS session
  FROM spend_gaps),
running_v AS (
  SELECT id, customer_id, price, quantity, ts, seq,
    CAST(sum(price * quantity) OVER (PARTITION BY customer_id, session ORDER BY ts, seq
         ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
  FROM spend_sessions)"""

STOCKED = """
asof_v AS (
  SELECT id, product, quantity, ts, seq, stock
  FROM (SELECT o.id, o.product, o.quantity, o.ts, o.seq, i.stock
        FROM created_v o ASOF JOIN inventory_v i ON o.product = i.product AND o.ts >= i.ts) a
  WHERE stock IS NOT NULL)"""

RESERVED = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY product ORDER BY ts, seq) AS n FROM asof_v),
reserved_v AS (
  SELECT id, product, ts, seq, n,
    CAST(CASE WHEN stock - quantity >= 0 THEN quantity ELSE 0 END AS BIGINT) AS reserved,
    stock - quantity >= 0 AS granted
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT q.id, q.product, q.ts, q.seq, q.n,
    r.reserved + CASE WHEN q.stock - r.reserved - q.quantity >= 0 THEN q.quantity ELSE 0 END,
    q.stock - r.reserved - q.quantity >= 0
  FROM reserved_v r JOIN numbered q ON q.product = r.product AND q.n = r.n + 1)"""

DETAILS_CHECK = """
  SELECT id AS order_id, 'ORDER_DETAILS_CHECK' AS type,
    CASE WHEN customer_id IS NOT NULL AND product IS NOT NULL AND quantity > 0 AND price > 0
         THEN 'PASS' ELSE 'FAIL' END AS result,
    ts, seq * 3 + 1 AS seq
  FROM created_v"""
FRAUD_CHECK = """
  SELECT id AS order_id, 'FRAUD_CHECK' AS type,
    CASE WHEN total < 2000 THEN 'PASS' ELSE 'FAIL' END AS result, ts, seq * 3 AS seq
  FROM running_v"""
INVENTORY_CHECK = """
  SELECT id AS order_id, 'INVENTORY_CHECK' AS type,
    CASE WHEN granted THEN 'PASS' ELSE 'FAIL' END AS result, ts, seq * 3 + 2 AS seq
  FROM reserved_v"""
CHECKED = f"checked_v AS ({DETAILS_CHECK} UNION ALL {FRAUD_CHECK} UNION ALL {INVENTORY_CHECK})"

ORDER_JSON = (
    "CAST(json_object('id', id, 'status', status, 'product', product, 'quantity', quantity, "
    "'price', price, 'customerId', customer_id) AS VARCHAR)"
)
VALIDATION_JSON = (
    "CAST(json_object('orderId', order_id, 'type', type, 'result', result) AS VARCHAR)"
)

# JSON order values as they may arrive: whole, without numbers, cut off, misspelt.
WIRE = f"""
wire_v AS (
  SELECT id, ts, seq,
    CASE WHEN id % 17 = 0 THEN '{{"id":"' || id || '","status":'
         WHEN id % 11 = 0 THEN '{{"id":"' || id || '","status":"' || status || '"}}'
         WHEN id % 19 = 0 THEN '{{"id":"' || id || '","status":"LOST","quantity":1}}'
         ELSE {ORDER_JSON} END AS value
  FROM orders_v)"""


def outcomes(verdicts: str) -> str:
    """CTEs from a verdict log to validated and failed updates and the order state."""
    return f"""
count_gaps AS (
  SELECT *, lag(ts) OVER (PARTITION BY order_id ORDER BY ts, seq) AS before FROM {verdicts}),
count_sessions AS (
  SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 5 MILLISECONDS
                     THEN 1 ELSE 0 END)
      OVER (PARTITION BY order_id ORDER BY ts, seq) AS session
  FROM count_gaps),
counts_v AS (
  SELECT order_id, type, result, session, ts, seq,
    CAST(sum(CASE WHEN result = 'PASS' THEN 1 ELSE 0 END)
      OVER (PARTITION BY order_id, session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)
      AS BIGINT) AS passes
  FROM count_sessions),
validated_v AS (
  SELECT o.id, 'VALIDATED' AS status, o.product, o.quantity, o.price, o.customer_id,
    greatest(c.ts, o.ts) AS ts, c.seq
  FROM counts_v c JOIN created_v o ON c.order_id = o.id
    AND o.ts BETWEEN c.ts - INTERVAL 5 MINUTES AND c.ts + INTERVAL 5 MINUTES
  WHERE c.passes >= 3),
failed_raw_v AS (
  SELECT o.id, 'FAILED' AS status, o.product, o.quantity, o.price, o.customer_id,
    greatest(v.ts, o.ts) AS ts, v.seq
  FROM {verdicts} v JOIN created_v o ON v.order_id = o.id
    AND o.ts BETWEEN v.ts - INTERVAL 5 MINUTES AND v.ts + INTERVAL 5 MINUTES
  WHERE v.result = 'FAIL'),
failed_v AS (
  SELECT * EXCLUDE (n)
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS n FROM failed_raw_v) f
  WHERE n = 1),
log_v AS (
  SELECT id, status, product, quantity, price, customer_id, ts, seq, 0 AS step FROM orders_v
  UNION ALL SELECT *, 1 AS step FROM validated_v
  UNION ALL SELECT *, 2 AS step FROM failed_v),
state_v AS (
  SELECT * EXCLUDE (n)
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, step > 0 DESC, seq DESC,
                              step DESC) AS n
        FROM log_v) s
  WHERE n = 1)"""


OUTCOMES = outcomes("validations_v")
LIFECYCLE = outcomes("checked_v")
SESSIONS = """
  (SELECT *, row_number() OVER (PARTITION BY {0}, session ORDER BY ts DESC, seq DESC) AS newest
   FROM {1})"""


# Of the streams: micro-batches by event time, and how long a session takes late orders.
SLICES = 5
GRACE = "INTERVAL 23 HOURS"


def late_spending() -> str:
    """Spend verdicts over micro-batches into which every fifth event comes one late.

    A block of CTEs per micro-batch: the remembered sessions and the arrived orders as
    intervals of their customer, numbered by session. Sessions that ended more than GRACE
    before the newest order of earlier micro-batches are closed: their orders are LATE, and
    what is remembered of them stays as it was.
    """
    ctes = [
        f"""
arrived_v AS (
  SELECT o.*, CAST(price * quantity AS BIGINT) AS amount,
    least({SLICES - 1}, (epoch_us(ts) - first) * {SLICES} // (last - first + 1)
      + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) AS slice
  FROM created_v o, (SELECT min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events) s
  WHERE customer_id IS NOT NULL),
fronts_v AS (
  SELECT n, (SELECT max(ts) FROM arrived_v WHERE slice < n) AS before,
    (SELECT max(ts) FROM arrived_v WHERE slice <= n) AS newest
  FROM (SELECT unnest(range({SLICES})) AS n) f)"""
    ]
    for n in range(SLICES):
        known = "" if n == 0 else f"""
    UNION ALL SELECT customer_id, began, last_ts, total, false, NULL, NULL, NULL FROM kept_{n - 1}"""
        ctes.append(
            f"""
both_{n} AS (
  SELECT customer_id, ts AS began, ts AS ended, amount, true AS new, id, ts, seq FROM arrived_v WHERE slice = {n}{known}),
opened_{n} AS (
  SELECT *, CASE WHEN began - max(ended) OVER (PARTITION BY customer_id ORDER BY began, ended, new
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS opens
  FROM both_{n}),
session_{n} AS (
  SELECT *, sum(opens) OVER (PARTITION BY customer_id ORDER BY began, ended, new
    ROWS UNBOUNDED PRECEDING) AS session FROM opened_{n}),
told_{n} AS (
  SELECT s.*, sum(amount) OVER (PARTITION BY customer_id, session ORDER BY ts NULLS FIRST, seq
      ROWS UNBOUNDED PRECEDING) AS total,
    coalesce(max(ended) OVER (PARTITION BY customer_id, session) < f.before - {GRACE}, false) AS closed
  FROM session_{n} s JOIN fronts_v f ON f.n = {n}),
kept_{n} AS (
  SELECT * FROM (
    SELECT customer_id, min(began) AS began, max(ended) AS last_ts, sum(amount) AS total
    FROM told_{n} WHERE NOT closed GROUP BY customer_id, session
    UNION ALL SELECT customer_id, began, ended, amount FROM told_{n} WHERE closed AND NOT new) k
  WHERE last_ts >= (SELECT newest FROM fronts_v WHERE n = {n}) - {GRACE} - INTERVAL 1 HOUR)"""
        )
    return ",".join(ctes)


LATE_VERDICTS = " UNION ALL ".join(
    f"""SELECT id AS order_id, CASE WHEN closed THEN 'LATE' WHEN total < 2000 THEN 'PASS' ELSE 'FAIL' END AS result, ts
        FROM told_{n} WHERE new"""
    for n in range(SLICES)
)


PROFILES = """
profile_orders AS (
  SELECT *, CAST(price * quantity AS DOUBLE) AS spent,
    row_number() OVER (PARTITION BY customer_id ORDER BY ts, seq) AS n
  FROM created_v WHERE customer_id IS NOT NULL),
profile_v AS (
  SELECT id, customer_id, ts, n, product, false AS changed,
    CAST(0.5 AS DOUBLE) * coalesce(spent, 0) AS average
  FROM profile_orders WHERE n = 1
  UNION ALL
  SELECT q.id, q.customer_id, q.ts, q.n, coalesce(q.product, p.product),
    coalesce(q.product <> p.product, false),
    CAST(0.5 AS DOUBLE) * p.average + CAST(0.5 AS DOUBLE) * coalesce(q.spent, 0)
  FROM profile_v p JOIN profile_orders q ON q.customer_id = p.customer_id AND q.n = p.n + 1)"""


def _sql(*parts: str) -> str:
    """The last part as the query, the others as its CTEs."""
    *ctes, query = parts
    return f"WITH RECURSIVE {','.join(ctes)} {query}"


def oracle_sql() -> dict[str, str]:
    checks = (ORDERS, INVENTORY, SPENDING, STOCKED, RESERVED)
    logged = (ORDERS, VALIDATIONS, OUTCOMES)
    order_columns = "id, status, product, quantity, price, customer_id, ts"
    wire_valid = (
        "json_valid(value) AND coalesce(json_extract_string(value, '$.status'), 'CREATED') "
        "IN ('CREATED', 'VALIDATED', 'FAILED', 'SHIPPED')"
    )
    fraud_sessions = f"""
      SELECT customer_id, min(ts) AS first_ts, max(ts) AS last_ts,
        CAST(sum(price * quantity) AS BIGINT) AS total,
        max(CASE WHEN newest = 1 THEN id END) AS last_order_id,
        max(CASE WHEN newest = 1 THEN quantity END) AS last_quantity
      FROM {SESSIONS.format("customer_id", "spend_sessions")} s GROUP BY customer_id, session"""
    pass_sessions = """
      SELECT order_id, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(seq, (ts, seq)) AS last_seq,
        CAST(sum(CASE WHEN result = 'PASS' THEN 1 ELSE 0 END) AS BIGINT) AS passes
      FROM count_sessions GROUP BY order_id, session"""
    running = "SELECT id, customer_id, total, ts FROM running_v"
    pass_running = "SELECT order_id, passes, ts, seq FROM counts_v"
    asof = "SELECT id, product, quantity, stock, ts FROM asof_v"
    queries = {
        # Sources, filters, projections
        "scan_orders": _sql(ORDERS, f"SELECT {order_columns} FROM orders_v"),
        "scan_validations": _sql(
            ORDERS, VALIDATIONS, "SELECT order_id, type, result, ts FROM validations_v"
        ),
        "filter_created": _sql(ORDERS, f"SELECT {order_columns} FROM created_v"),
        "rekey_by_product": _sql(ORDERS, f"SELECT product AS key, {order_columns} FROM created_v"),
        "route_orders": _sql(
            ORDERS,
            """SELECT id, CASE WHEN status = 'CREATED' AND customer_id IS NOT NULL
                     AND product IS NOT NULL AND quantity > 0 AND price > 0 THEN 0
                   WHEN status = 'CREATED' THEN 1 ELSE 2 END AS branch
               FROM orders_v WHERE status <> 'SHIPPED'""",
        ),
        "ingest_orders": _sql(
            ORDERS,
            """SELECT id, 'CREATED' AS status, product, quantity, price,
                 CAST(customer_id AS VARCHAR) AS customer_id,
                 CASE WHEN customer_id IS NULL THEN 36 ELSE 0 END AS generated_length
               FROM orders_v""",
        ),
        "encode_orders": _sql(
            ORDERS, f"SELECT CAST(id AS VARCHAR) AS key, {ORDER_JSON} AS value FROM orders_v"
        ),
        "encode_validations": _sql(
            ORDERS,
            VALIDATIONS,
            f"""SELECT CAST(order_id AS VARCHAR) AS key, {VALIDATION_JSON} AS value
                FROM validations_v""",
        ),
        "decode_orders": _sql(
            ORDERS,
            WIRE,
            f"""SELECT json_extract_string(value, '$.id') AS id,
                  json_extract_string(value, '$.status') AS status,
                  json_extract_string(value, '$.product') AS product,
                  CAST(coalesce(json_extract_string(value, '$.quantity'), '0') AS INT)
                    AS quantity,
                  CAST(coalesce(json_extract_string(value, '$.price'), '0') AS BIGINT) AS price,
                  json_extract_string(value, '$.customerId') AS customer_id, ts
                FROM wire_v WHERE CASE WHEN json_valid(value) THEN {wire_valid} ELSE false END""",
        ),
        "decode_rejects": _sql(
            ORDERS,
            WIRE,
            f"""SELECT value AS reject, ts FROM wire_v
                WHERE CASE WHEN json_valid(value) THEN NOT ({wire_valid}) ELSE true END""",
        ),
        "history_union": _sql(
            ORDERS,
            INVENTORY,
            VALIDATIONS,
            f"""SELECT key, from_topic || ': ' || coalesce(value, 'null') AS value, from_topic,
                  'from' AS header_key, from_topic AS header_value, ts
                FROM (SELECT CAST(id AS VARCHAR) AS key, {ORDER_JSON} AS value,
                        'orders' AS from_topic, ts FROM orders_v
                      UNION ALL
                      SELECT CAST(order_id AS VARCHAR), {VALIDATION_JSON}, 'order-validations', ts
                      FROM validations_v
                      UNION ALL
                      SELECT product, CAST(stock AS VARCHAR), 'warehouse-inventory', ts
                      FROM inventory_v) h""",
        ),
        # Tables
        "inventory_latest": _sql(
            ORDERS, INVENTORY, "SELECT product, stock, ts, seq FROM inventory_now"
        ),
        "order_log": _sql(*logged, f"SELECT {order_columns}, step FROM log_v"),
        "order_state": _sql(*logged, f"SELECT {order_columns} FROM state_v"),
        "lookup_order": _sql(
            *logged,
            f"""SELECT {order_columns} FROM state_v
                WHERE id IN (SELECT order_id FROM validations_v WHERE result = 'FAIL')""",
        ),
        "lookup_validated": _sql(
            *logged, f"SELECT {order_columns} FROM state_v WHERE status = 'VALIDATED'"
        ),
        # Checks
        "details_check": _sql(ORDERS, f"SELECT * FROM ({DETAILS_CHECK}) c"),
        "fraud_sessions": _sql(ORDERS, SPENDING, fraud_sessions),
        "fraud_running_total": _sql(ORDERS, SPENDING, running),
        "fraud_check": _sql(ORDERS, SPENDING, FRAUD_CHECK),
        "orders_with_stock": _sql(
            ORDERS,
            INVENTORY,
            """SELECT o.id, o.product, o.quantity, i.stock
               FROM created_v o JOIN inventory_now i ON o.product = i.product""",
        ),
        "orders_asof_stock": _sql(ORDERS, INVENTORY, STOCKED, asof),
        "inventory_check": _sql(ORDERS, INVENTORY, STOCKED, RESERVED, INVENTORY_CHECK),
        "all_validations": _sql(*checks, CHECKED, "SELECT * FROM checked_v"),
        # User functions
        "customer_profiles": _sql(
            ORDERS, PROFILES, "SELECT id, customer_id, changed, average, ts FROM profile_v"
        ),
        "product_changes": _sql(
            ORDERS,
            """bought AS (
                 SELECT *, lag(product) OVER (PARTITION BY customer_id ORDER BY ts, seq) AS before
                 FROM created_v WHERE customer_id IS NOT NULL AND product IS NOT NULL)""",
            """SELECT customer_id, arg_min(product, (ts, seq)) AS first_product,
                 arg_max(product, (ts, seq)) AS last_product,
                 count(*) FILTER (product <> before) AS changes
               FROM bought GROUP BY customer_id""",
        ),
        "basket_sessions": _sql(
            ORDERS,
            SPENDING,
            """SELECT customer_id, min(ts) AS first_ts, max(ts) AS last_ts,
                 CAST(bit_or(CASE product WHEN 'SHOES' THEN 1 WHEN 'WATCH' THEN 2
                             WHEN 'GUITAR' THEN 4 ELSE 0 END) AS BIGINT) AS products,
                 CAST(max(price * quantity) AS BIGINT) AS dearest
               FROM spend_sessions GROUP BY customer_id, session""",
        ),
        # Outcomes
        "pass_count_sessions": _sql(*logged, pass_sessions),
        "pass_count_running": _sql(*logged, pass_running),
        "validated_orders": _sql(*logged, f"SELECT {order_columns} FROM validated_v"),
        "validated_distinct_types": _sql(
            *logged,
            """typed AS (
                 SELECT order_id, ts, seq, session,
                   sum(CASE WHEN result = 'PASS' AND type = 'FRAUD_CHECK' THEN 1 ELSE 0 END)
                     OVER w AS fraud,
                   sum(CASE WHEN result = 'PASS' AND type = 'ORDER_DETAILS_CHECK'
                       THEN 1 ELSE 0 END) OVER w AS details,
                   sum(CASE WHEN result = 'PASS' AND type = 'INVENTORY_CHECK'
                       THEN 1 ELSE 0 END) OVER w AS stock
                 FROM count_sessions
                 WINDOW w AS (PARTITION BY order_id, session ORDER BY ts, seq
                              ROWS UNBOUNDED PRECEDING))""",
            """SELECT o.id, 'VALIDATED' AS status, greatest(t.ts, o.ts) AS ts
               FROM typed t JOIN created_v o ON t.order_id = o.id
                 AND o.ts BETWEEN t.ts - INTERVAL 5 MINUTES AND t.ts + INTERVAL 5 MINUTES
               WHERE fraud > 0 AND details > 0 AND stock > 0""",
        ),
        "validated_sessions": _sql(
            *logged,
            """SELECT o.id, 'VALIDATED' AS status, greatest(s.last_ts, o.ts) AS ts
               FROM (SELECT order_id, max(ts) AS last_ts FROM count_sessions
                     GROUP BY order_id, session
                     HAVING sum(CASE WHEN result = 'PASS' THEN 1 ELSE 0 END) >= 3) s
               JOIN created_v o ON s.order_id = o.id AND o.ts BETWEEN
                 s.last_ts - INTERVAL 5 MINUTES AND s.last_ts + INTERVAL 5 MINUTES""",
        ),
        "failed_orders_raw": _sql(*logged, f"SELECT {order_columns}, seq FROM failed_raw_v"),
        "failed_orders": _sql(*logged, f"SELECT {order_columns}, seq FROM failed_v"),
        "order_lifecycle": _sql(
            *checks, CHECKED, LIFECYCLE, f"SELECT {order_columns} FROM state_v"
        ),
    }
    # The same operators with every key cut into small blocks, as a hot key would be.
    for name in (
        "basket_sessions",
        "fraud_sessions",
        "fraud_running_total",
        "orders_asof_stock",
        "inventory_check",
        "pass_count_sessions",
        "pass_count_running",
        "order_lifecycle",
    ):
        queries[f"{name}_split"] = queries[name]
    # The streaming jobs run over the whole input to its end.
    for name in (
        "customer_profiles",
        "details_check",
        "fraud_check",
        "inventory_check",
        "history_union",
        "pass_count_running",
        "validated_orders",
        "failed_orders",
        "order_state",
        "all_validations",
        "order_lifecycle",
    ):
        queries[f"stream_{name}"] = queries[name]
    queries["stream_order_changes"] = queries["order_state"]
    queries["stream_lookup_order"] = queries["lookup_order"]
    queries["stream_fraud_late"] = _sql(ORDERS, late_spending(), LATE_VERDICTS)
    return queries
