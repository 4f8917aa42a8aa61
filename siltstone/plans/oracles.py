"""DuckDB SQL for the registered queries, written independently of the DataFrame plans."""

from __future__ import annotations

from ..config import USD_RATES
from .queries import ROUTES, SAMPLE, S

_NAMES = ", ".join(f"'{c}'" for c in USD_RATES)
_RATES = ", ".join(f"('{c}', {r}::DOUBLE)" for c, r in USD_RATES.items())
_COLUMNS = "ts, from_bank, from_account, to_bank, to_account, amount_received, receiving_currency, amount_paid, payment_currency, payment_format, is_laundering"
_WITH = f"""
WITH named AS (SELECT [{_NAMES}] AS names),
alltx AS (
    SELECT
        l_shipdate AS ts, o_custkey % 25 AS from_bank, o_custkey::VARCHAR AS from_account,
        l_suppkey % 12 % 25 AS to_bank, (l_suppkey % 12)::VARCHAR AS to_account,
        l_extendedprice * (1 - l_discount) / 100 AS amount_received, names[l_suppkey % 15 + 1] AS receiving_currency,
        l_extendedprice / 100 AS amount_paid,
        CASE WHEN l_returnflag IN ('A', 'R') THEN 'US Dollar' ELSE names[l_partkey % 15 + 1] END AS payment_currency,
        CASE o_orderpriority[1] WHEN '1' THEN 'Wire' WHEN '2' THEN 'ACH' WHEN '3' THEN 'Cheque' WHEN '4' THEN 'Credit Card' WHEN '5' THEN 'Cash' END AS payment_format,
        (l_linestatus = 'O')::INTEGER AS is_laundering, o_orderkey % 5 + 1 AS client_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey, named
),
tx AS (SELECT {_COLUMNS} FROM alltx),
acc AS (SELECT n_name AS bank_name, c_custkey % 25 AS bank_id FROM customer JOIN nation ON n_nationkey = c_custkey % 25),
usd AS (SELECT * FROM tx WHERE payment_currency = 'US Dollar'),
p1 AS (SELECT * FROM usd WHERE ts >= TIMESTAMP '{S.period1.start}' AND ts < TIMESTAMP '{S.period1.end}'),
p2 AS (SELECT * FROM usd WHERE ts >= TIMESTAMP '{S.period2.start}' AND ts < TIMESTAMP '{S.period2.end}'),
best AS (
    SELECT * FROM usd QUALIFY row_number() OVER (PARTITION BY from_bank ORDER BY amount_paid DESC, ts DESC, from_account DESC, to_bank DESC, to_account DESC,
        amount_received DESC, receiving_currency DESC, payment_currency DESC, payment_format DESC, is_laundering DESC) = 1
),
q2 AS (SELECT from_bank, from_account, bank_name, amount_paid FROM best JOIN acc ON from_bank = bank_id),
average AS (SELECT payment_format, avg(amount_paid) AS average FROM p1 GROUP BY payment_format),
q3 AS (SELECT from_bank, from_account, payment_format, amount_paid FROM p2 JOIN average USING (payment_format) WHERE amount_paid < average * {S.average_fraction}::DOUBLE),
q1 AS (SELECT from_bank, from_account, to_bank, to_account, amount_paid FROM usd WHERE amount_paid < 50),
rates(payment_currency, rate) AS (VALUES {_RATES}),
converted AS (SELECT tx.*, amount_paid * rate AS amount FROM tx LEFT JOIN rates USING (payment_currency)),
q5 AS (
    SELECT * FROM converted WHERE ts >= TIMESTAMP '{S.period1.start}' AND ts < TIMESTAMP '{S.period1.end}' AND payment_format IN ('Wire', 'ACH') AND amount < 1
),
ranged AS (
    SELECT p1.* FROM p1 SEMI JOIN (
        SELECT from_bank, from_account FROM p1 GROUP BY ALL HAVING count(DISTINCT (to_bank, to_account)) > 5 AND count(DISTINCT (to_bank, to_account)) < 10
    ) k USING (from_bank, from_account)
),
hops AS (
    SELECT l.from_bank AS a_bank, l.from_account AS a_account, l.to_bank AS b_bank, l.to_account AS b_account, r.to_bank AS c_bank, r.to_account AS c_account
    FROM ranged l JOIN ranged r ON l.to_bank = r.from_bank AND l.to_account = r.from_account
    WHERE l.from_bank <> r.to_bank OR l.from_account <> r.to_account
),
pairs AS (SELECT a_bank, a_account, c_bank, c_account, count(*) AS paths FROM hops GROUP BY ALL HAVING count(*) > 5),
q4 AS (SELECT a_bank AS bank, a_account AS account FROM pairs UNION SELECT c_bank, c_account FROM pairs),
wide AS (SELECT p1.* FROM p1 SEMI JOIN (SELECT from_bank, from_account FROM p1 GROUP BY ALL HAVING count(DISTINCT (to_bank, to_account)) >= 5) k USING (from_bank, from_account)),
deep AS (SELECT p1.* FROM p1 SEMI JOIN (SELECT to_bank, to_account FROM p1 GROUP BY ALL HAVING count(DISTINCT (from_bank, from_account)) >= 5) k USING (to_bank, to_account)),
drawn AS (
    SELECT l.from_bank AS a_bank, l.from_account AS a_account, r.to_bank AS c_bank, r.to_account AS c_account, count(DISTINCT (r.from_bank, r.from_account)) AS intermediaries
    FROM wide l JOIN deep r ON l.to_bank = r.from_bank AND l.to_account = r.from_account
    WHERE l.from_bank <> r.to_bank OR l.from_account <> r.to_account
    GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT (r.from_bank, r.from_account)) >= 5
),
cp1 AS (SELECT * FROM alltx WHERE payment_currency = 'US Dollar' AND ts >= TIMESTAMP '{S.period1.start}' AND ts < TIMESTAMP '{S.period1.end}'),
cranged AS (
    SELECT cp1.* FROM cp1 SEMI JOIN (
        SELECT client_id, from_bank, from_account FROM cp1 GROUP BY ALL HAVING count(DISTINCT (to_bank, to_account)) > 2 AND count(DISTINCT (to_bank, to_account)) < 10
    ) k USING (client_id, from_bank, from_account)
),
cpairs AS (
    SELECT l.client_id, l.from_bank AS a_bank, l.from_account AS a_account, r.to_bank AS c_bank, r.to_account AS c_account
    FROM cranged l JOIN cranged r ON l.client_id = r.client_id AND l.to_bank = r.from_bank AND l.to_account = r.from_account
    WHERE l.from_bank <> r.to_bank OR l.from_account <> r.to_account
    GROUP BY ALL HAVING count(*) > 2
)
"""

_Q5_COUNT = "SELECT count(*) AS n FROM q5"
_BODIES = {
    "q1_low_usd": "SELECT * FROM q1",
    "q2_max_per_bank": "SELECT * FROM q2",
    "q3_below_avg_fraction": "SELECT * FROM q3",
    "q4_scatter_gather": "SELECT * FROM q4",
    "q4_pairs": "SELECT * FROM pairs",
    "q4_distinct_intermediaries": "SELECT * FROM drawn",
    "q5_small_converted": "SELECT * FROM q5",
    "q5_count": _Q5_COUNT,
    "usd_only": "SELECT * FROM usd",
    "period1_usd": "SELECT * FROM p1",
    "period2_usd": "SELECT * FROM p2",
    "wire_or_ach": "SELECT * FROM tx WHERE payment_format IN ('Wire', 'ACH')",
    "converted_amounts": "SELECT * FROM converted",
    "avg_per_format": "SELECT payment_format, round(average, 6) AS average FROM average",
    "max_txn_rows": "SELECT * FROM best",
    "fan_out_degree": "SELECT from_bank, from_account, count(DISTINCT (to_bank, to_account)) AS destinations FROM p1 GROUP BY ALL HAVING count(DISTINCT (to_bank, to_account)) >= 5",
    "fan_in_degree": "SELECT to_bank, to_account, count(DISTINCT (from_bank, from_account)) AS sources FROM p1 GROUP BY ALL HAVING count(DISTINCT (from_bank, from_account)) >= 5",
    "ranged_senders": "SELECT * FROM ranged",
    "two_hop_paths": "SELECT *, count(*) AS paths FROM hops GROUP BY ALL",
    "bank_accounts_union": "SELECT from_bank AS bank, from_account AS account FROM tx UNION SELECT to_bank, to_account FROM tx",
    "multi_bank_accounts": """SELECT account, count(bank) AS banks FROM (
        SELECT c_nationkey AS bank, c_custkey AS account FROM customer UNION SELECT s_nationkey, s_suppkey FROM supplier) u GROUP BY account HAVING count(bank) > 1""",
    "timestamp_range": "SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM tx",
    "dataset_sizes": """SELECT 'transactions' AS name, count(*) AS n FROM tx UNION ALL SELECT 'usd', count(*) FROM usd UNION ALL SELECT 'period1_usd', count(*) FROM p1
        UNION ALL SELECT 'accounts', count(*) FROM acc UNION ALL SELECT 'ranged', count(*) FROM ranged""",
    "client_counts": "SELECT client_id, count(*) AS transactions FROM alltx GROUP BY client_id",
    "q1_by_client": "SELECT client_id, from_bank, from_account, to_bank, to_account, amount_paid FROM alltx WHERE payment_currency = 'US Dollar' AND amount_paid < 50",
    "q4_by_client": "SELECT client_id, a_bank AS bank, a_account AS account FROM cpairs UNION SELECT client_id, c_bank, c_account FROM cpairs",
    "report_union": """SELECT 'q1' AS query, from_bank, from_account, amount_paid, 0::BIGINT AS n FROM q1
        UNION ALL SELECT 'q2', from_bank, from_account, amount_paid, 0 FROM q2 UNION ALL SELECT 'q3', from_bank, from_account, amount_paid, 0 FROM q3
        UNION ALL SELECT 'q4', bank, account, 0, 0 FROM q4 UNION ALL SELECT 'q5', 0, '', 0, count(*) FROM q5""",
    "batch_json_roundtrip": "SELECT * FROM alltx",
    "route_partitions": f"SELECT from_bank % {ROUTES} AS route, count(*) AS n, count(DISTINCT from_bank) AS banks FROM tx GROUP BY 1",
    "sample_n": f"""SELECT * FROM tx ORDER BY md5(concat_ws(':', '0', ts::VARCHAR, from_account, to_account, payment_currency, payment_format,
        floor(amount_received * 10000)::BIGINT::VARCHAR, floor(amount_paid * 10000)::BIGINT::VARCHAR)) LIMIT {SAMPLE}""",
    "head_rows": "SELECT ts, from_bank, from_account, to_bank, to_account, amount_paid FROM tx ORDER BY ALL LIMIT 5",
    "converted_by_day": """SELECT ts, from_account, to_account, payment_currency, amount_paid,
        (CASE WHEN ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1999-01-01' THEN amount_paid * (rate * (1 + day(ts) / 1000.0::DOUBLE)) END) AS amount
        FROM tx LEFT JOIN rates USING (payment_currency)""",
    "queue_by_key": "SELECT client_id, 2 * count(*) AS rows FROM alltx GROUP BY client_id",
    "stream_client_counts": "SELECT client_id, count(*) AS transactions FROM alltx GROUP BY client_id",
    "stream_q1": "SELECT * FROM q1",
    "stream_q2": "SELECT * FROM q2",
    "stream_q3": "SELECT * FROM q3",
    "stream_q5_count": _Q5_COUNT,
}
ORACLES = {name: f"{_WITH}{body}" for name, body in _BODIES.items()}
