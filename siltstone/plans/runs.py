"""Whole runs over folders of clients: making inputs, the five queries, comparing outputs.

    python -m siltstone.plans.runs generate|analyse|compare

Folders and numbers come from the environment (see `config.Run`). All clients go through one plan, told apart by
`client_id`, so more clients mean more rows rather than more jobs.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..config import Run, Settings
from ..functions.compare import all_match, compare_outputs
from ..operators import graph, payments
from ..sources import files, sinks

# The names of a client's input files.
TRANSACTIONS_FILE, ACCOUNTS_FILE = "LI-Small_Trans.csv", "LI-Small_accounts.csv"
BY = ("client_id",)


def generate(spark: SparkSession, run: Run) -> None:
    """`input_dir`/client_N: a sample of the transactions of `data_dir` of each client's own, and all accounts."""
    tx, _ = files.quarantine(files.read_csv(spark, f"{run.data_dir}/{TRANSACTIONS_FILE}"))
    accounts, _ = files.quarantine(files.read_csv(spark, f"{run.data_dir}/{ACCOUNTS_FILE}", schema.ACCOUNT_COLUMNS))
    sinks.clear_clients(spark, run.input_dir)
    for n in range(1, run.n_clients + 1):
        folder = f"{run.input_dir}/client_{n}"
        sinks.write_csv(files.sample(tx, run.n_samples, seed=n), folder, TRANSACTIONS_FILE.removesuffix(".csv"))
        sinks.write_csv(accounts, folder, ACCOUNTS_FILE.removesuffix(".csv"))


def results(tx: DataFrame, accounts: DataFrame, settings: Settings, by: tuple[str, ...] = BY) -> dict[str, DataFrame]:
    """The five queries' rows. `tx` has `line`, so that of equal maxima the first in the file wins."""
    plain = tx.drop("line")
    return {
        "query_1": payments.low_payments(plain, settings, by),
        "query_2": payments.largest_with_names(tx, accounts, settings, by, first="line"),
        "query_3": payments.far_below_average(plain, settings, by),
        "query_4": graph.scatter_gather(plain, settings, by),
        "query_5": payments.small_converted(plain, settings),
    }


def analyse(spark: SparkSession, run: Run, settings: Settings | None = None) -> dict[int, int]:
    """`output_dir`/client_N/query_1.csv to query_5.csv, in place of earlier ones; the number of rows of query 5 by client."""
    settings = settings or Settings()
    clients = sorted(int(n.removeprefix("client_")) for n in sinks.Files(spark, run.input_dir).names(run.input_dir) if n.startswith("client_"))
    read = lambda name, columns: files.quarantine(files.read_csv(spark, f"{run.input_dir}/client_*/{name}", columns, clients=True))[0]
    # Read once from CSV; the queries scan the columns that they need.
    tx = sinks.stored(files.with_line_numbers(read(TRANSACTIONS_FILE, schema.TRANSACTION_COLUMNS)))
    accounts = sinks.stored(read(ACCOUNTS_FILE, schema.ACCOUNT_COLUMNS))
    sinks.clear_clients(spark, run.output_dir)
    found = results(tx, accounts, settings)
    sinks.write_clients(found, run.output_dir, clients)
    counted = {r.client_id: r["count"] for r in found["query_5"].groupBy("client_id").count().collect()}
    for stored in (tx, accounts):
        path = stored.inputFiles()[0].rpartition("/")[0]
        sinks.Files(spark, path).delete(path)
    return {n: counted.get(n, 0) for n in clients}


def main(what: str) -> int:
    run, spark = Run.from_env(), SparkSession.builder.appName("siltstone").getOrCreate()
    if what == "generate":
        generate(spark, run)
    elif what == "analyse":
        for n, rows in analyse(spark, run).items():
            print(f"client_{n}: {rows} small payments")
    elif what == "compare":
        compared = compare_outputs(spark, run.expected_dir, run.output_dir)
        print(*[f"{name}: {verdict}" for name, verdict in compared.items()], sep="\n")
        return int(not all_match(compared))
    else:
        raise SystemExit(__doc__)
    return 0


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:2] or [""]))
