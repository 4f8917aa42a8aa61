"""Column names, types and CSV headers of transactions and accounts, and the schema of a batch message."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _D, _I = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType()

# Fixed values: (column, type, CSV header).
TRANSACTION_COLUMNS = [
    ("ts", _S, "Timestamp"),
    ("from_bank", _L, "From Bank"),
    ("from_account", _S, "Account"),
    ("to_bank", _L, "To Bank"),
    ("to_account", _S, "Account.1"),
    ("amount_received", _D, "Amount Received"),
    ("receiving_currency", _S, "Receiving Currency"),
    ("amount_paid", _D, "Amount Paid"),
    ("payment_currency", _S, "Payment Currency"),
    ("payment_format", _S, "Payment Format"),
    ("is_laundering", _I, "Is Laundering"),
]
ACCOUNT_COLUMNS = [
    ("bank_name", _S, "Bank Name"),
    ("bank_id", _L, "Bank ID"),
    ("account_number", _S, "Account Number"),
    ("entity_id", _S, "Entity ID"),
    ("entity_name", _S, "Entity Name"),
]
#: Headers of result columns that differ from those above.
RESULT_HEADERS = {"bank": "Bank", "account": "Account", "amount": "Amount"}


def struct(columns) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t, _ in columns])


TRANSACTIONS, ACCOUNTS = struct(TRANSACTION_COLUMNS), struct(ACCOUNT_COLUMNS)
HEADERS = {n: h for n, _, h in TRANSACTION_COLUMNS + ACCOUNT_COLUMNS} | RESULT_HEADERS


def batch(transactions: T.StructType = TRANSACTIONS, accounts: T.StructType = ACCOUNTS) -> T.StructType:
    return T.StructType(
        [T.StructField("type", _S), T.StructField("client_id", _S), T.StructField("transactions", T.ArrayType(transactions)), T.StructField("accounts", T.ArrayType(accounts))]
    )
