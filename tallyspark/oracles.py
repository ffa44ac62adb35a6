"""The same queries as DuckDB SQL over the given tables."""

from __future__ import annotations

_ORDERS = """
    SELECT o_orderkey + 1 AS id, o_custkey AS seller_id,
           CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
           CASE WHEN o_orderstatus = 'F' THEN 'SETTLED' ELSE 'CONFIRMED' END AS status,
           CAST(o_orderdate AS DATE) AS order_date, o_orderdate AS created_at
    FROM orders
"""

_FACTS = "amount, amount * 3 // 100 AS fee, amount - amount * 3 // 100 AS net_amount"
_AT = "TIMESTAMP '2026-03-25 00:00:00' AS settled_at"
_BEFORE = "TIMESTAMP '2026-03-24 00:00:00' AS settled_at"

_WITH = f"WITH o AS ({_ORDERS})"

_BOUNDS = """
    b AS (SELECT min(id) AS lo, max(id) AS hi, (max(id) - min(id)) // 4 + 1 AS width
          FROM o WHERE status = 'CONFIRMED')
"""

_STEPS = """
WITH workers AS (
    SELECT list_value('reader-offset', 'reader-zero-offset', 'writer-jpa', 'writer-jdbc-batch',
                      'insert-identity', 'insert-jdbc-rewrite', 'sequential', 'partitioning'
           )[user_id % 8 + 1] AS case_name,
           'workerStep:partition' || (user_id // 8 % 4) AS step_name,
           count(*) AS read_count,
           count(*) FILTER (WHERE value >= 1) AS write_count,
           count(*) FILTER (WHERE value < 1) AS skip_count,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS duration_ms
    FROM events GROUP BY ALL
), steps AS (
    SELECT * FROM workers
    UNION ALL
    SELECT case_name, 'masterStep', CAST(sum(read_count) AS BIGINT),
           CAST(sum(write_count) AS BIGINT), CAST(sum(skip_count) AS BIGINT),
           CAST(sum(duration_ms) AS BIGINT)
    FROM workers GROUP BY case_name
), totals AS (
    SELECT case_name, CAST(sum(read_count) AS BIGINT) AS total_read,
           CAST(sum(write_count) AS BIGINT) AS total_write,
           CAST(sum(skip_count) AS BIGINT) AS total_skip,
           CAST(sum(duration_ms) AS BIGINT) AS duration_ms
    FROM steps WHERE step_name NOT LIKE '%:%' GROUP BY case_name
), rates AS (
    SELECT *, CASE WHEN total_read > 0
                   THEN total_read * 1000.0::DOUBLE / nullif(duration_ms, 0)
                   ELSE 0.0::DOUBLE END AS rate
    FROM totals
)
"""

_FEED = """
feed AS (
    SELECT event_id // 2 * 4 + 1 AS id, nullif(user_id, 0) AS seller_id,
           CAST(round(value * 100) AS BIGINT) AS amount,
           CASE WHEN event_type <> 'error' THEN 'CONFIRMED' END AS status,
           CAST(ts AS DATE) AS order_date,
           CAST(date_trunc('day', ts) AS TIMESTAMP) AS created_at, event_id AS version
    FROM events
)
"""

_TIMINGS = """
WITH t AS (
    SELECT event_type AS step, event_id + 1 AS chunk_no, value AS elapsed_ms FROM events
)
"""

_PAGE = f"{_WITH} SELECT * FROM o WHERE status = 'CONFIRMED' ORDER BY id LIMIT 1000 OFFSET 5000"

_UPSERTED = f"""{_WITH}, {_FEED},
        n AS (
            SELECT id, seller_id, amount, 'SETTLED' AS status, order_date, created_at
            FROM feed WHERE seller_id IS NOT NULL AND status IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1)
        SELECT coalesce(n.id, o.id) AS id, coalesce(n.seller_id, o.seller_id) AS seller_id,
               coalesce(n.amount, o.amount) AS amount, coalesce(n.status, o.status) AS status,
               coalesce(n.order_date, o.order_date) AS order_date,
               coalesce(o.created_at, n.created_at) AS created_at
        FROM o FULL JOIN n ON o.id = n.id
"""

_INSERTED = f"""{_WITH},
        earlier AS (
            SELECT id, id AS order_id, seller_id, {_FACTS}, {_BEFORE}
            FROM o WHERE status = 'SETTLED'),
        added AS (
            SELECT (SELECT max(id) FROM earlier) + row_number() OVER (ORDER BY id) AS id,
                   id AS order_id, seller_id, {_FACTS}, {_AT}
            FROM o WHERE status = 'CONFIRMED')
        SELECT * FROM earlier UNION ALL SELECT * FROM added
"""

_REPORT = """
        SELECT case_name, format('{:,}', total_read) AS total_read,
               format('{:,}', total_write) AS total_write,
               format('{:,}', total_skip) AS total_skip,
               format('{:,}', CAST(floor(round(duration_ms / 1000.0::DOUBLE, 1)) AS BIGINT)) || '.'
               || CAST(round(round(duration_ms / 1000.0::DOUBLE, 1) * 10) AS BIGINT) % 10 || 's'
                   AS total_duration,
               format('{:,}', CAST(round(rate, 0) AS BIGINT)) || ' records/s' AS throughput
"""

ORACLES: dict[str, str] = {
    "orders_scan": f"{_WITH} SELECT * FROM o",
    "confirmed_scan": f"{_WITH} SELECT * FROM o WHERE status = 'CONFIRMED'",
    "offset_page": _PAGE,
    "indexed_offset_page": _PAGE,
    "keyset_page": f"{_WITH} SELECT * FROM o WHERE id > 5000 ORDER BY id LIMIT 1000",
    "bounded_keyset_page": f"""{_WITH}
        SELECT * FROM o WHERE id > 5000 AND id <= 5500 ORDER BY id LIMIT 1000""",
    "full_read": f"{_WITH} SELECT * FROM o WHERE id > 0",
    "id_range_scan": f"{_WITH} SELECT * FROM o WHERE id BETWEEN 1 AND 5000",
    "settlement_projection": f"{_WITH} SELECT id AS order_id, seller_id, {_FACTS} FROM o",
    "settle_status": f"""{_WITH}
        SELECT id, seller_id, amount, 'SETTLED' AS status, order_date, created_at
        FROM o WHERE id > 0""",
    "settle_full": f"""{_WITH}
        SELECT id AS order_id, seller_id, {_FACTS}, {_AT}, 'SETTLED' AS order_status
        FROM o WHERE id > 0""",
    "settle_bounded": f"""{_WITH}
        SELECT id AS order_id, seller_id, {_FACTS}, {_AT}, 'CONFIRMED' AS order_status
        FROM o WHERE id BETWEEN 1 AND 5000""",
    "settle_ranged": f"""
        WITH o AS (SELECT * REPLACE ('CONFIRMED' AS status) FROM ({_ORDERS})), {_BOUNDS}
        SELECT id AS order_id, seller_id, {_FACTS}, {_AT}, 'SETTLED' AS order_status,
               (id - lo) // width AS partition_no
        FROM o, b WHERE id BETWEEN lo AND hi""",
    "settle_by_ledger": f"""{_WITH}
        SELECT row_number() OVER (ORDER BY id) AS id, id AS order_id, seller_id, {_FACTS}, {_AT}
        FROM o""",
    "unsettled_orders": f"""{_WITH}
        SELECT * FROM o
        WHERE id NOT IN (SELECT o_orderkey + 1 FROM orders WHERE o_orderstatus = 'F')""",
    "insert_settlements": _INSERTED,
    "audited_settlements": _INSERTED,
    "append_audits": f"""{_WITH}, {_FEED},
        f AS (SELECT count(*) AS n FROM o WHERE status = 'SETTLED'),
        c AS (SELECT count(*) AS n FROM o WHERE status = 'CONFIRMED'),
        again AS (SELECT count(*) AS n FROM (SELECT id FROM feed GROUP BY id HAVING count(*) > 1))
        SELECT 0::BIGINT AS batch, n AS row_count, 0::BIGINT AS null_count,
               0::BIGINT AS repeated_keys, 0::BIGINT AS settled_before, true AS published FROM f
        UNION ALL
        SELECT 1, count(*), CAST(count_if(seller_id IS NULL) + 3 * count_if(amount IS NULL) AS BIGINT),
               any_value(again.n), 0, false FROM feed, again
        UNION ALL SELECT 2, n, 0, 0, 0, true FROM c
        UNION ALL SELECT 3, n, 0, 0, n, false FROM f""",
    "settle_in_place": f"""{_WITH},
        s AS (SELECT id FROM o WHERE status = 'SETTLED' AND id <= 5000)
        SELECT * REPLACE (CASE WHEN id IN (FROM s) THEN 'SETTLED' ELSE 'CONFIRMED' END AS status)
        FROM o""",
    "settle_orders": f"""{_WITH},
        s AS (SELECT id FROM o WHERE status = 'SETTLED')
        SELECT r.* REPLACE (CASE WHEN s.id IS NOT NULL THEN 'SETTLED' ELSE r.status END AS status)
        FROM (SELECT * REPLACE ('CONFIRMED' AS status) FROM o) r LEFT JOIN s ON r.id = s.id""",
    "upsert_orders": _UPSERTED,
    "upsert_in_place": _UPSERTED,
    "reset_orders": f"{_WITH} SELECT * REPLACE ('CONFIRMED' AS status) FROM o",
    "confirmed_bounds": f"""{_WITH}
        SELECT min(id) AS min_id, max(id) AS max_id FROM o WHERE status = 'CONFIRMED'""",
    "order_count": "SELECT count(*) AS order_count FROM orders",
    "range_partitions": f"""{_WITH}, {_BOUNDS}
        SELECT i AS partition_no, 'partition' || i AS label, lo + i * width AS min_id,
               least(lo + (i + 1) * width - 1, hi) AS max_id
        FROM b, range(4) r(i) WHERE lo IS NOT NULL""",
    "partition_stats": f"""{_WITH}, {_BOUNDS}
        SELECT (id - lo) // width AS partition_no, count(*) AS row_count,
               min(id) AS first_id, max(id) AS last_id,
               CAST(sum(amount) AS BIGINT) AS sum_amount,
               CAST(sum(amount * 3 // 100) AS BIGINT) AS sum_fee,
               'partition' || ((id - lo) // width) AS label
        FROM o, b WHERE id BETWEEN lo AND hi GROUP BY (id - lo) // width""",
    "chunk_numbers": f"""{_WITH},
        n AS (SELECT id, row_number() OVER (ORDER BY id) AS row_no
              FROM o WHERE status = 'CONFIRMED')
        SELECT id, row_no, (row_no - 1) // 1000 + 1 AS chunk_no FROM n""",
    "duplicate_settlements": """
        SELECT l_orderkey + 1 AS order_id, count(*) AS settlement_count
        FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""",
    "null_violations": f"""WITH {_FEED}
        SELECT 'id' AS column_name, count(*) - count(id) AS null_count FROM feed
        UNION ALL SELECT 'seller_id', count(*) - count(seller_id) FROM feed
        UNION ALL SELECT 'amount', count(*) - count(amount) FROM feed
        UNION ALL SELECT 'status', count(*) - count(status) FROM feed
        UNION ALL SELECT 'order_date', count(*) - count(order_date) FROM feed
        UNION ALL SELECT 'created_at', count(*) - count(created_at) FROM feed""",
    "settlement_null_violations": f"""WITH {_FEED}, s AS (
            SELECT version AS id, id AS order_id, seller_id, {_FACTS}, {_AT} FROM feed)
        SELECT 'id' AS column_name, count(*) - count(id) AS null_count FROM s
        UNION ALL SELECT 'order_id', count(*) - count(order_id) FROM s
        UNION ALL SELECT 'seller_id', count(*) - count(seller_id) FROM s
        UNION ALL SELECT 'amount', count(*) - count(amount) FROM s
        UNION ALL SELECT 'fee', count(*) - count(fee) FROM s
        UNION ALL SELECT 'net_amount', count(*) - count(net_amount) FROM s
        UNION ALL SELECT 'settled_at', count(*) - count(settled_at) FROM s""",
    "rejected_orders": f"""WITH {_FEED}
        SELECT * FROM feed
        WHERE id IS NULL OR seller_id IS NULL OR amount IS NULL OR status IS NULL
           OR order_date IS NULL OR created_at IS NULL""",
    "status_length_violations": """
        WITH tagged AS (
            SELECT o_orderkey + 1 AS id,
                   CASE WHEN o_orderstatus = 'F' THEN 'SETTLED' ELSE 'CONFIRMED' END
                   || ' ' || o_orderpriority AS status
            FROM orders)
        SELECT id, status, length(status) AS status_length FROM tagged WHERE length(status) > 20""",
    "generate_orders": """
        SELECT count(*) AS row_count, CAST(1 AS BIGINT) AS min_id, count(*) AS max_id,
               count(*) AS sellers_in_range, count(*) AS amounts_in_range,
               count(*) AS confirmed, count(*) AS on_order_date
        FROM orders""",
    "top_up_orders": f"""{_WITH},
        have AS (SELECT count(*) AS n, min(id) AS lo, max(id) AS hi FROM o),
        want AS (SELECT count(*) AS n FROM lineitem)
        SELECT false AS is_generated, n AS row_count, lo AS min_id, hi AS max_id FROM have
        UNION ALL
        SELECT true, want.n - have.n, hi + 1, hi + want.n - have.n FROM have, want
        WHERE want.n > have.n""",
    "step_totals": f"""{_STEPS}
        SELECT * FROM totals""",
    "throughput": f"""{_STEPS}
        SELECT case_name, round(rate, 2) AS rows_per_second FROM rates""",
    "run_report": f"{_STEPS} {_REPORT} FROM rates",
    "run_status_report": f"""{_STEPS}, failed AS (
            SELECT DISTINCT list_value('reader-offset', 'reader-zero-offset', 'writer-jpa',
                'writer-jdbc-batch', 'insert-identity', 'insert-jdbc-rewrite', 'sequential',
                'partitioning')[user_id % 8 + 1] AS case_name
            FROM events GROUP BY user_id % 8, user_id // 8 % 4
            HAVING count(*) FILTER (WHERE event_type = 'error') % 2 = 1)
        {_REPORT}, CASE WHEN case_name IN (FROM failed) THEN 'FAILED' ELSE 'COMPLETED' END AS status
        FROM rates""",
    "case_speedup": f"""{_STEPS},
        pairs(axis, base_case, opt_case) AS (VALUES
            ('reader', 'reader-offset', 'reader-zero-offset'),
            ('writer', 'writer-jpa', 'writer-jdbc-batch'),
            ('insert', 'insert-identity', 'insert-jdbc-rewrite'),
            ('parallel', 'sequential', 'partitioning'))
        SELECT axis, round(b.rate, 2) AS base_rows_per_second,
               round(p.rate, 2) AS opt_rows_per_second,
               round(p.rate / nullif(b.rate, 0), 2) AS speedup
        FROM pairs JOIN rates b ON b.case_name = base_case JOIN rates p ON p.case_name = opt_case""",
    "chunk_timing_by_step": f"""{_TIMINGS}
        SELECT step, count(*) AS chunk_count, round(sum(elapsed_ms), 2) AS total_ms,
               max(elapsed_ms) AS max_ms
        FROM t GROUP BY step""",
    "chunk_first_latest": f"""{_TIMINGS}
        SELECT count(*) AS chunk_count, arg_min(elapsed_ms, chunk_no) AS first_ms,
               arg_max(elapsed_ms, chunk_no) AS latest_ms
        FROM t""",
    "chunk_timing_samples": f"""{_TIMINGS}
        SELECT chunk_no, step, elapsed_ms,
               (SELECT arg_min(elapsed_ms, chunk_no) FROM t) AS first_ms,
               elapsed_ms AS latest_ms
        FROM t WHERE chunk_no % 100 = 0""",
    "incremental_settle": f"""{_WITH}
        SELECT id AS order_id, seller_id, {_FACTS}, {_AT} FROM o WHERE id > 0""",
    "keyed_settle": f"""{_WITH}
        SELECT id AS order_id, seller_id, {_FACTS}, {_AT} FROM o
        WHERE id IN (SELECT l_orderkey + 1 FROM lineitem)""",
    "stream_run_report": f"""{_WITH},
        fed AS (SELECT id, 4 - id % 4 AS times FROM o JOIN lineitem ON l_orderkey + 1 = id)
        SELECT 'incremental' AS case_name, CAST(sum(times) AS BIGINT) AS total_read,
               count(DISTINCT id) AS total_write,
               CAST(sum(times) - count(DISTINCT id) AS BIGINT) AS total_skip,
               4::BIGINT AS chunk_count
        FROM fed""",
    "footer_bounds": f"""{_WITH}
        SELECT status, min(id) AS min_id, max(id) AS max_id, count(*) AS row_count
        FROM o GROUP BY status""",
}
