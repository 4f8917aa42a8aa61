"""Accounts as nodes, payments as edges: degrees, two-hop paths, the scatter-gather pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from .payments import RECEIVER, SENDER, By, first_period, in_currency


def fan_out(tx: DataFrame, by: By = ()) -> DataFrame:
    """Distinct destinations of each sender; a destination with a null part doesn't count."""
    return tx.groupBy(*by, *SENDER).agg(F.count_distinct(*RECEIVER).alias("destinations"))


def fan_in(tx: DataFrame, by: By = ()) -> DataFrame:
    return tx.groupBy(*by, *RECEIVER).agg(F.count_distinct(*SENDER).alias("sources"))


def ranged(tx: DataFrame, s: Settings, by: By = ()) -> DataFrame:
    """Payments of the first period by senders whose number of destinations is in range."""
    p1 = first_period(in_currency(tx, s), s)
    low, high = s.destinations
    kept = fan_out(p1, by).where((F.col("destinations") > low) & (F.col("destinations") < high))
    return p1.join(kept, [*by, *SENDER], "left_semi")


def edges(tx: DataFrame, s: Settings, by: By = ()) -> DataFrame:
    """Distinct (sender, receiver) of the first period with `w`, the number of payments."""
    return first_period(in_currency(tx, s), s).groupBy(*by, *SENDER, *RECEIVER).agg(F.count("*").alias("w"))


def _of_degree(e: DataFrame, ends: tuple[str, ...], others: tuple[str, ...], wanted, by: By) -> DataFrame:
    """The edges whose `ends` have a `degree` as wanted: how many different `others`, none of a null part, they meet."""
    # `w` is always positive; asking for it keeps this the same exchange as that of the edges, which is reused.
    met = F.count_if(F.col(others[0]).isNotNull() & F.col(others[1]).isNotNull() & (F.col("w") > 0)).alias("degree")
    return e.join(e.groupBy(*by, *ends).agg(met).where(wanted), [*by, *ends], "left_semi")


def _hops(left: DataFrame, right: DataFrame, by: By) -> DataFrame:
    """a -> b -> c over edges with weights: the join multiplies edges, not payments."""
    one = left.select(*by, *SENDER, *RECEIVER, "w").toDF(*by, "a_bank", "a_account", "b_bank", "b_account", "w1")
    two = right.select(*by, *SENDER, *RECEIVER, "w").toDF(*by, "b_bank", "b_account", "c_bank", "c_account", "w2")
    return one.join(two, [*by, "b_bank", "b_account"]).where((F.col("a_bank") != F.col("c_bank")) | (F.col("a_account") != F.col("c_account")))


def two_hop_paths(tx: DataFrame, s: Settings, by: By = ()) -> DataFrame:
    """a, b, c and the number of pairs of payments along them. Both hops come from the kept senders (those of `ranged`).

    Payments become edges first, so they are read and shuffled once; degrees and both hops start from that exchange.
    """
    low, high = s.destinations
    kept = _of_degree(edges(tx, s, by), SENDER, RECEIVER, (F.col("degree") > low) & (F.col("degree") < high), by)
    return _hops(kept, kept, by).select(*by, "a_bank", "a_account", "b_bank", "b_account", "c_bank", "c_account", (F.col("w1") * F.col("w2")).alias("paths"))


def path_pairs(tx: DataFrame, s: Settings, by: By = ()) -> DataFrame:
    """(a, c) joined by more than `path_pairs` pairs of payments."""
    ends = [*by, "a_bank", "a_account", "c_bank", "c_account"]
    return two_hop_paths(tx, s, by).groupBy(*ends).agg(F.sum("paths").alias("paths")).where(F.col("paths") > s.path_pairs)


def path_pairs_unweighted(tx: DataFrame, s: Settings, by: By = ()) -> DataFrame:
    """The same as `path_pairs`, by joining single payments; for comparison."""
    kept = ranged(tx, s, by).select(*by, *SENDER, *RECEIVER)
    one, two = kept.toDF(*by, "a_bank", "a_account", "b_bank", "b_account"), kept.toDF(*by, "b_bank", "b_account", "c_bank", "c_account")
    both = one.join(two, [*by, "b_bank", "b_account"]).where((F.col("a_bank") != F.col("c_bank")) | (F.col("a_account") != F.col("c_account")))
    return both.groupBy(*by, "a_bank", "a_account", "c_bank", "c_account").agg(F.count("*").alias("paths")).where(F.col("paths") > s.path_pairs)


def scatter_gather(tx: DataFrame, s: Settings, by: By = ()) -> DataFrame:
    """Every account at either end of a path pair."""
    pairs = path_pairs(tx, s, by)
    ends = F.explode(F.array(*[F.struct(F.col(f"{e}_bank").alias("bank"), F.col(f"{e}_account").alias("account")) for e in "ac"]))
    return pairs.select(*by, ends.alias("e")).select(*by, "e.bank", "e.account").distinct()


def drawn_scatter_gather(tx: DataFrame, s: Settings, by: By = ()) -> DataFrame:
    """The drawn variant: wide senders to wide receivers over at least `drawn_least` distinct intermediaries."""
    all_edges = edges(tx, s, by)
    out = _of_degree(all_edges, SENDER, RECEIVER, F.col("degree") >= s.drawn_least, by)
    into = _of_degree(all_edges, RECEIVER, SENDER, F.col("degree") >= s.drawn_least, by)
    # Edges are distinct, so each intermediary of a pair is one row of it: counts, summed map-side.
    hops = _hops(out, into, by).groupBy(*by, "a_bank", "a_account", "c_bank", "c_account").agg(F.count("*").alias("intermediaries"))
    return hops.where(F.col("intermediaries") >= s.drawn_least)


def bank_accounts(tx: DataFrame) -> DataFrame:
    """All distinct (bank, account), as sender or receiver."""
    ends = F.explode(F.array(F.struct(F.col("from_bank").alias("bank"), F.col("from_account").alias("account")), F.struct(F.col("to_bank").alias("bank"), F.col("to_account").alias("account"))))
    return tx.select(ends.alias("e")).select("e.bank", "e.account").distinct()


def in_several_banks(pairs: DataFrame) -> DataFrame:
    """Accounts found in more than one bank, from (bank, account) rows."""
    return pairs.distinct().groupBy("account").agg(F.count("bank").alias("banks")).where(F.col("banks") > 1)
