"""The payment operators on hand-written rows."""

import socket
import time

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from siltstone.config import USD_RATES, Period, Run, Settings
from siltstone.functions.compare import all_match, compare_outputs, same_rows
from siltstone.operators import graph, payments
from siltstone.plans import oracles, queries, runs
from siltstone.schema import ACCOUNT_COLUMNS, ACCOUNTS, TRANSACTION_COLUMNS, TRANSACTIONS
from siltstone.sources import files, sinks
from siltstone.streaming import control
from siltstone.streaming import payments as streams

S = Settings()
SMALL = "/root/testdata/sf0.001"


def tx(spark, rows):
    """Rows of (ts, from bank, from account, to bank, to account, amount[, currency[, format]])."""
    full = [(r[0], r[1], r[2], r[3], r[4], r[5], "US Dollar", r[5], (r[6] if len(r) > 6 else "US Dollar"), (r[7] if len(r) > 7 else "Wire"), 0) for r in rows]
    return spark.createDataFrame(full, TRANSACTIONS)


def test_period_edges(spark):
    stamps = ["2022/09/01 00:00", "2022/09/05 23:59", "2022/09/06 00:00", "2022/09/06", "2022/09/14 23:59", "2022/09/15 00:00"]
    df = tx(spark, [(t, 1, "a", 2, "b", 1.0) for t in stamps])
    assert [r.ts for r in payments.first_period(df, S).collect()] == [stamps[0], stamps[1], stamps[3]]
    assert [r.ts for r in payments.second_period(df, S).collect()] == stamps[2:5]
    half_open = Settings(period1=Period("1996-01-01", "1998-01-01", False))
    dated = df.limit(2).withColumn("ts", F.expr("element_at(array(timestamp_ntz '1996-01-01', timestamp_ntz '1998-01-01'), cast(from_bank as int))"))
    assert payments.first_period(dated, half_open).count() == 2


def test_low_payments_are_strict(spark):
    df = tx(spark, [("t", 1, "a", 2, "b", x) for x in (49.99, 50.0, None, 49.99)] + [("t", 1, "a", 2, "b", 1.0, "Euro")])
    assert [r.amount_paid for r in payments.low_payments(df, S).collect()] == [49.99, 49.99]


def test_largest_per_bank_ties_fan_out_and_gaps(spark):
    df = tx(spark, [("t", 1, "x", 9, "b", 5.0), ("t", 1, "y", 9, "b", 5.0), ("t", 2, "z", 9, "b", None), ("t", 3, "w", 9, "b", 1.0)])
    accounts = spark.createDataFrame([("One", 1, "1", "e", "n"), ("One", 1, "2", "e", "n"), ("Uno", 1, "3", "e", "n")], ACCOUNTS)
    lined = df.withColumn("line", F.when(F.col("from_account") == "x", 0).otherwise(1))
    assert {(r.from_account, r.bank_name) for r in payments.largest_with_names(lined, accounts, S, first="line").collect()} == {("x", "One"), ("x", "Uno")}
    assert payments.largest_with_names(df, accounts, S).count() == 3
    assert {(r.from_bank, r.from_account) for r in payments.largest_per_bank(df, S).collect()} == {(1, "y"), (3, "w")}


def test_far_below_average(spark):
    p1, p2 = "2022/09/02 10:00", "2022/09/07 10:00"
    df = tx(spark, [(p1, 1, "a", 2, "b", 100.0), (p2, 1, "a", 2, "b", 1.0), (p2, 1, "c", 2, "b", 0.99), (p2, 1, "c", 2, "b", 0.99), (p2, 1, "d", 2, "b", 0.1, "US Dollar", "Cash")])
    assert [(r.from_account, r.amount_paid) for r in payments.far_below_average(df, S).collect()] == [("c", 0.99)] * 2


def wide(bank, account, to, repeat=1, pad=6, day="2022/09/02 10:00"):
    """A sender with `pad` distinct destinations, of which `to` gets `repeat` payments."""
    others = [(day, bank, account, 900, f"{account}{i}", 1.0) for i in range(pad - 1)]
    return others + [(day, bank, account, *to, 1.0)] * repeat


@pytest.mark.parametrize("n, kept", [(5, False), (6, True), (9, True), (10, False)])
def test_degree_bounds(spark, n, kept):
    assert bool(graph.ranged(tx(spark, wide(1, "a", (2, "b"), 3, n)), S).count()) == kept


def test_scatter_gather_counts_pairs_of_payments(spark):
    rows = wide(1, "A", (2, "B"), 3) + wide(2, "B", (3, "C"), 2) + wide(1, "D", (2, "E"), 1) + wide(2, "E", (3, "F"), 5)
    rows += wide(1, "G", (1, "G"), 3) + wide(1, "H", (2, "narrow"), 9) + [("2022/09/02 10:00", 2, "narrow", 3, "C", 1.0)] * 9
    df = tx(spark, rows)
    pairs = {(r.a_account, r.c_account): r.paths for r in graph.path_pairs(df, S).collect()}
    assert pairs == {("A", "C"): 6}
    assert same_rows(graph.path_pairs(df, S).withColumn("paths", F.col("paths").cast("long")), graph.path_pairs_unweighted(df, S))
    assert {(r.bank, r.account) for r in graph.scatter_gather(df, S).collect()} == {(1, "A"), (3, "C")}


def test_same_account_number_in_two_banks_and_clients(spark):
    pairs = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (1, "y"), (None, "y")], "bank long, account string")
    assert [tuple(r) for r in graph.in_several_banks(pairs).collect()] == [("x", 2)]
    two = tx(spark, [("t", 1, "a", 2, "b", 5.0)]).withColumn("client_id", F.lit(1)).unionByName(tx(spark, [("t", 1, "a", 2, "b", 7.0)]).withColumn("client_id", F.lit(2)))
    assert {(r.client_id, r.amount_paid) for r in payments.largest_per_bank(two, S, ("client_id",)).collect()} == {(1, 5.0), (2, 7.0)}
    assert {tuple(r) for r in payments.counts_per_client(two).collect()} == {(1, 1), (2, 1)}


def test_conversion(spark):
    df = tx(spark, [("2022/09/02 10:00", 1, "a", 2, "b", 0.5, c) for c in [*USD_RATES, "Gold"]])
    amounts = {r.payment_currency: r.amount for r in payments.converted(df, S).collect()}
    assert amounts["Gold"] is None and all(amounts[c] == 0.5 * r for c, r in USD_RATES.items())
    assert {r.payment_currency for r in payments.small_converted(df, S).collect()} == {c for c, r in USD_RATES.items() if 0.5 * r < 1}


HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"


def test_csv(spark, tmp_path):
    rows = ["2022/09/01 00:20,010,A,001,B,3.5,Euro,3.5,Euro,Wire,0", '2022/09/01 00:21,10,"A, b",1,B,x,Euro,NaN,Euro,Wire,1', "short,1", "", "2022/09/01 00:22,10,A,1,B,1,Euro,1,Euro,Wire,1,long"]
    (tmp_path / "t.csv").write_text(HEADER + "\n".join(rows) + "\n")
    good, bad = files.quarantine(files.read_csv(spark, str(tmp_path / "t.csv")))
    assert (good.count(), bad.count()) == (2, 2) and sorted(r[0] for r in bad.select(files.CORRUPT).collect()) == sorted([rows[2], rows[4]])
    assert [(r.from_bank, r.from_account, r.to_account, r.amount_received, r.amount_paid) for r in good.collect()] == [(10, "A", "B", 3.5, 3.5), (10, "A, b", "B", None, None)]
    assert good.columns == [c for c, _, _ in TRANSACTION_COLUMNS] and good.select("from_bank").distinct().count() == 1
    zeros = files.quarantine(files.read_csv(spark, str(tmp_path / "t.csv"), bad_number=0))[0]
    assert [r.amount_received for r in zeros.collect()] == [3.5, 0.0]
    streamed = files.read_csv(spark, str(tmp_path), TRANSACTION_COLUMNS, streaming=True)
    assert streams.finished_rows(streamed).count() == 4


def test_csv_accounts_batch_and_stream(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"client_{n}").mkdir()
        (tmp_path / f"client_{n}/a.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\n" + "".join(f'"Bank, {i}",0{i},ACC{i},E{i},Name {i}\n' for i in range(n)))
    loaded = files.quarantine(files.read_csv(spark, f"{tmp_path}/client_*/a.csv", ACCOUNT_COLUMNS, clients=True))[0]
    assert sorted(map(tuple, loaded.collect())) == [(1, "Bank, 0", 0, "ACC0", "E0", "Name 0"), (2, "Bank, 0", 0, "ACC0", "E0", "Name 0"), (2, "Bank, 1", 1, "ACC1", "E1", "Name 1")]
    streamed = files.read_csv(spark, f"{tmp_path}/client_2", ACCOUNT_COLUMNS, streaming=True)
    assert [r.bank_id for r in streams.finished_rows(streamed).orderBy("bank_id").collect()] == [0, 1]


def test_first_row_of_the_file_wins_ties(spark, tmp_path):
    rows = [f"2022/09/01 00:20,{i % 7},ACC{(i * 37) % 500:03d},1,B,5,Euro,5,US Dollar,Wire,0" for i in range(500)]
    (tmp_path / "t.csv").write_text(HEADER + "\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    # Many parts, read by several tasks.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        loaded = files.with_line_numbers(files.quarantine(files.read_csv(spark, str(tmp_path / "t.csv")))[0])
        assert loaded.rdd.getNumPartitions() > 10
        assert [r.from_account for r in loaded.orderBy("line").collect()] == [f"ACC{(i * 37) % 500:03d}" for i in range(500)]
        assert {(r.from_bank, r.from_account) for r in payments.largest_per_bank(loaded, S, first="line").collect()} == {(i, f"ACC{i * 37:03d}") for i in range(7)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sinks_and_comparison(spark, tmp_path):
    df = tx(spark, [("t", 1, "a", 2, "b", 5.0), ("t", 1, "a", 2, "b", 5.0), ("t", 1, "c", 2, "b", 6.0)])
    low = payments.low_payments(df, S)
    sinks.write_csv(low, str(tmp_path / "x/client_1"), "query_1")
    assert (tmp_path / "x/client_1/query_1.csv").read_text().splitlines()[0] == "From Bank,Account,To Bank,Account.1,Amount Paid"
    sinks.write_csv(low.orderBy(F.desc("from_account")), str(tmp_path / "y/client_1"), "query_1")
    sinks.write_csv(low.distinct(), str(tmp_path / "z/client_1"), "query_1")
    (tmp_path / "v/client_1").mkdir(parents=True)
    compare = lambda other: compare_outputs(spark, str(tmp_path / "x"), str(tmp_path / other))
    assert [compare(o) for o in "yzv"] == [{"client_1/query_1.csv": s} for s in ("OK", "DIFFERENT", "MISSING")]
    assert compare("w") == {"client_1": "MISSING"} and all_match(compare("y")) and not all_match(compare("w"))
    sinks.write_clients({"query_1": low.withColumn("client_id", F.lit(7))}, str(tmp_path / "c"), [7, 8])
    assert (tmp_path / "c/client_7/query_1.csv").read_text().count("\n") == 4
    assert (tmp_path / "c/client_8/query_1.csv").read_text() == "From Bank,Account,To Bank,Account.1,Amount Paid\n"
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["client_7", "client_8"]


def test_numbers_are_compared_as_numbers(spark, tmp_path):
    texts = {"a": "x,n\n007,5.10\nb,1e1\n", "b": "x,n\nb,10\n007,5.1\n", "c": "x,n\nb,10\n7,5.1\n", "d": "x,n\nb,10\n007,5.2\n", "e": "x,m\nb,10\n007,5.1\n"}
    for name, text in texts.items():
        (tmp_path / name / "client_1").mkdir(parents=True)
        (tmp_path / name / "client_1/q.csv").write_text(text)
    verdict = lambda other: compare_outputs(spark, str(tmp_path / "a"), str(tmp_path / other))["client_1/q.csv"]
    # Text stays text: 007 beside b is no number.
    assert [verdict(o) for o in "abcde"] == ["OK", "OK", "DIFFERENT", "DIFFERENT", "DIFFERENT"]


def test_two_clients_end_to_end(spark, tmp_path):
    """Inputs made, analysed and compared; both clients' results are those of the operators on their own files."""
    data = tmp_path / "data"
    data.mkdir()
    p1, p2 = "2022/09/02 10:00", "2022/09/07 10:00"
    lines = [f"{p1 if i % 3 else p2},{i % 4},ACC{i % 11},{i % 5},ACC{i % 13},1,Euro,{(i * 7919) % 900 / 10},{'US Dollar' if i % 4 else 'Yen'},{'Wire' if i % 2 else 'Cash'},0" for i in range(400)]
    (data / runs.TRANSACTIONS_FILE).write_text(HEADER + "\n".join([*lines, "short"]) + "\n")
    (data / runs.ACCOUNTS_FILE).write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\n" + "".join(f"Bank {i},{i},ACC{i},E,N\n" for i in range(4)))
    run = Run(str(data), str(tmp_path / "input"), str(tmp_path / "out"), str(tmp_path / "out"), 250, 2)
    (tmp_path / "input/client_9").mkdir(parents=True)
    (tmp_path / "out/client_9").mkdir(parents=True)
    runs.generate(spark, run)
    made = [(tmp_path / f"input/client_{n}" / runs.TRANSACTIONS_FILE).read_text().splitlines() for n in (1, 2)]
    assert sorted(p.name for p in (tmp_path / "input").iterdir()) == ["client_1", "client_2"] and [len(m) for m in made] == [251, 251] and set(made[0]) != set(made[1])
    counted = runs.analyse(spark, run)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["client_1", "client_2"]
    for n in (1, 2):
        own = files.with_line_numbers(files.quarantine(files.read_csv(spark, f"{run.input_dir}/client_{n}/{runs.TRANSACTIONS_FILE}"))[0])
        accounts = files.quarantine(files.read_csv(spark, f"{run.input_dir}/client_{n}/{runs.ACCOUNTS_FILE}", ACCOUNT_COLUMNS))[0]
        for name, df in runs.results(own, accounts, S, ()).items():
            sinks.write_csv(df, str(tmp_path / f"alone/client_{n}"), name)
            assert name not in ("query_1", "query_2", "query_5") or df.count()
        assert counted[n] == runs.results(own, accounts, S, ())["query_5"].count()
    compared = compare_outputs(spark, str(tmp_path / "alone"), run.output_dir)
    assert len(compared) == 10 and all_match(compared), compared


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    put = lambda lo, hi: spark.range(lo, hi).withColumn("client_id", F.col("id") % 2).write.mode("append").parquet(str(source))
    put(0, 10)
    stream = lambda: spark.readStream.schema("id long, client_id long").parquet(str(source))
    assert streams.finished_rows(stream(), out + "/a").count() == 10
    put(10, 15)
    assert sorted(r.id for r in streams.finished_rows(stream(), out + "/a").collect()) == list(range(15))
    totals = lambda: {r.client_id: r.transactions for r in streams.finished_aggregate(stream().groupBy("client_id").agg(F.count("*").alias("transactions")), out + "/b").collect()}
    assert totals() == {0: 8, 1: 7}
    put(15, 17)
    assert totals() == {0: 9, 1: 8} and totals() == {0: 9, 1: 8}


def test_running_counts_and_watcher(spark):
    df = spark.range(25).select((F.col("id") % 2).alias("client_id")).coalesce(1)
    with control.Watcher(spark) as seen:
        after = streams.running_counts(streams.in_batches(df, 10))
        totals = {(r.batch, r.client_id): r.transactions for r in after.collect()}
        for _ in range(100):
            if seen.ended:
                break
            time.sleep(0.1)
    assert totals == {(0, 0): 5, (0, 1): 5, (1, 0): 10, (1, 1): 10, (2, 0): 13, (2, 1): 12}
    assert list(seen.rows.values()) == [25] and list(seen.ended.values()) == [None] and set(seen.started) == set(seen.ended)


def test_failed_queries_are_tried_again(spark, tmp_path):
    tries = []

    def flaky(batch, number):
        tries.append(number)
        if len(tries) < 3:
            raise RuntimeError("no connection")
        batch.write.mode("append").parquet(str(tmp_path / "rows"))

    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    start = lambda: stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(flaky).start()
    control.run(start, attempts=3, wait=0)
    assert tries == [0, 0, 0] and spark.read.parquet(str(tmp_path / "rows")).count() == 5
    tries.clear()
    spark.range(5).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException):
        control.run(start, attempts=2, wait=0)
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "other")).format("noop").start()
    assert control.stop(query) and not control.stop(query) and not query.isActive


def test_queue_with_routing_keys(spark, tmp_path):
    messages, queue = spark.createDataFrame([("m1",), ("m2",)], "value string"), str(tmp_path / "queue")
    sinks.publish(messages, queue, ["a", "b"])
    sinks.publish(messages.limit(1), queue, ["b"])
    got = lambda keys: sorted(tuple(r) for r in streams.finished_rows(sinks.consume(spark, queue, keys)).collect())
    assert got(["a"]) == [("m1", "a"), ("m2", "a")] and len(got(["b"])) == 3 and len(got(None)) == 5
    with pytest.raises(ValueError):
        sinks.publish(messages, queue, [])


def test_socket_source(spark):
    with socket.socket() as server:
        server.bind(("localhost", 0))
        server.listen()
        lines = streams.socket_lines(spark, "localhost", server.getsockname()[1])
        assert lines.isStreaming and lines.columns == ["value"]


def test_rates_by_day(spark):
    df = tx(spark, [("2022/09/02 10:00", 1, "a", 2, "b", 2.0, "Euro"), ("2022/09/03", 1, "a", 2, "b", 2.0, "Euro"), ("bad", 1, "a", 2, "b", 2.0, "Euro")])
    rates = spark.createDataFrame([("Euro", "2022-09-02", 1.5), ("Euro", "2022-09-04", 9.0)], "payment_currency string, day string, rate double").withColumn("day", F.col("day").cast("date"))
    assert sorted((r.ts, r.amount) for r in payments.converted_by_day(df, rates, S).collect()) == [("2022/09/02 10:00", 3.0), ("2022/09/03", None), ("bad", None)]


def test_batches(spark):
    df = tx(spark, [("t", i, "a", 2, "b", None if i % 3 else 0.1 * i) for i in range(25)]).withColumn("client_id", F.lit("1"))
    messages = files.to_batches(df, size=10)
    assert files.from_batches(messages, TRANSACTIONS).select(df.columns).exceptAll(df).count() == 0 and messages.count() >= 3
    control = spark.createDataFrame([('{"type":"eof","client_id":"1"}',), ("junk",)], "value string")
    assert files.from_batches(control, TRANSACTIONS).count() == 0


def test_sample_and_settings(spark):
    df = tx(spark, [("t", i, "a", 2, "b", 1.0) for i in range(30)])
    assert files.sample(df, 10, 1).count() == 10 and same_rows(files.sample(df, 10, 1), files.sample(df, 10, 1)) and files.sample(df, 99).count() == 30
    many = spark.range(5000)
    assert files.sample(many, 10, 1).distinct().count() == 10 and {r.id for r in files.sample(many, 10, 1).collect()} != {r.id for r in files.sample(many, 10, 2).collect()}
    same = spark.range(5000).select(F.lit(1).alias("x"))
    assert files.sample(same, 10).count() == 10
    assert Run.from_env({"N_SAMPLES": "7", "INPUT_DIR": "i", "GATEWAY_PORT": "81", "INSTANCE_ID": "", "OTHER": "x"}) == Run(input_dir="i", n_samples=7, gateway_port=81)
    assert [r.amount_paid for r in files.head(df, 2, ["from_bank"]).collect()] == [1.0, 1.0]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_agree_with_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want))
