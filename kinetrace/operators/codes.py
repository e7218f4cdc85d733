"""Discrete codes: histograms, usage, perplexity, codebook updates, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(codes: DataFrame, by: list[str], code: str, size: int) -> DataFrame:
    """(by, code, n) with a row for each of the ``size`` codes; null and outlying codes do not count."""
    counts = codes.where((F.col(code) >= 0) & (F.col(code) < size)).groupBy(*by, F.col(code).cast("int").alias("code")).agg(F.count("*").alias("n"))
    grid = codes.select(*by).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("code")) if by else codes.sparkSession.range(size).select(F.col("id").cast("int").alias("code"))
    return grid.join(counts, [*by, "code"], "left").select(*by, "code", F.coalesce("n", F.lit(0)).alias("n"))


def perplexity(n: Column, total: Column, eps: float = 0.0) -> Column:
    """exp of the entropy of a histogram column, as an aggregate; 0 of an empty one.

    ``eps`` is added to each share inside the logarithm.
    """
    p = n / total
    return F.exp(-F.sum(F.when(n > 0, p * F.ln(p + eps)).otherwise(0.0)))


def usage(hist: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, usage, dead_code_ratio, perplexity) of a histogram (by, code, n)."""
    total = hist.groupBy(*by).agg(F.sum("n").alias("total")) if by else hist.agg(F.sum("n").alias("total"))
    joined = hist.join(total, by) if by else hist.crossJoin(F.broadcast(total))  # one row
    share = F.count_if(F.col("n") > 0) / float(size)
    measures = [share.alias("usage"), (1 - share).alias("dead_code_ratio"), F.when(F.max("total") > 0, perplexity(F.col("n"), F.greatest(F.col("total"), F.lit(1)))).otherwise(0.0).alias("perplexity")]
    return joined.groupBy(*by).agg(*measures) if by else joined.agg(*measures)


def usage_rollup(codes: DataFrame, stream: str, code: str, size: int) -> DataFrame:
    """Usage per stream and overall (stream null), from one histogram."""
    hist = codes.where((F.col(code) >= 0) & (F.col(code) < size)).groupBy(stream, code).agg(F.count("*").alias("n"))
    both = hist.unionByName(hist.groupBy(code).agg(F.sum("n").alias("n")).withColumn(stream, F.lit(None).cast(hist.schema[stream].dataType)))
    both = both.withColumn("_all", F.col(stream).isNull())
    total = both.groupBy("_all", stream).agg(F.sum("n").alias("total"))
    joined = both.alias("h").join(total.alias("t"), F.expr(f"h._all = t._all and h.{stream} <=> t.{stream}"))
    return joined.groupBy(F.col("h._all"), F.col(f"h.{stream}")).agg(
        (F.count("*") / float(size)).alias("usage"), F.sum("h.n").alias("n_codes"), perplexity(F.col("h.n"), F.col("t.total")).alias("perplexity")
    ).drop("_all")


def fresh(book: DataFrame) -> DataFrame:
    """State (code, dim, total, size, c) of a codebook (code, dim, c) that has seen no batch:
    its sums are the codebook, its counts one.  So it starts, and so it is rebuilt when only
    the codebook was kept."""
    return book.select("code", "dim", F.col("c").cast("double").alias("total"), F.lit(1.0).alias("size"), F.col("c").cast("double").alias("c"))


def as_book(state: DataFrame) -> tuple[DataFrame, str, str, int]:
    """What ``matching.codebook`` takes, of a state: a row per code with its vector."""
    width = state.agg(F.max("dim")).head()[0] + 1
    rows = state.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("r"))  # as many as there are dimensions
    return rows.select("code", F.transform("r", lambda e: e["c"]).alias("vec")), "code", "vec", width


def spares(state: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """(code, dim, spare): for the codes in order the first vectors of a batch by key, taken in turn.

    Both sides are no more than the codes of a codebook, which is bounded.
    """
    codes = state.select("code").distinct().withColumn("_k", F.row_number().over(Window.orderBy("code")) - 1)
    most = codes.count()
    first = values.select(key).distinct().orderBy(key).limit(most).withColumn("_p", F.row_number().over(Window.orderBy(key)) - 1)
    n = first.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    turn = codes.crossJoin(F.broadcast(n)).withColumn("_p", F.pmod("_k", "_n").cast("int"))  # one row
    return turn.join(first, "_p").join(values, key).select("code", "dim", F.col("x").alias("spare"))


def updated(state: DataFrame, assigned: DataFrame, values: DataFrame, key: str, momentum: float) -> DataFrame:
    """The state (code, dim, total, size, c) after a batch: running sums and counts of each
    code's members decay by ``momentum``; a code whose count falls below one is dead, and
    takes a vector of the batch instead (its own, where the batch has none).

    ``assigned`` has (key, code), ``values`` (key, dim, x); vectors without a code do not count.
    """
    members = assigned.where("code is not null").select(key, "code")
    good = values.join(members, key)
    sums = good.groupBy("code", "dim").agg(F.sum("x").alias("_s"), F.count("*").alias("_n"))
    joined = state.join(sums, ["code", "dim"], "left").join(spares(state, good.select(key, "dim", "x"), key), ["code", "dim"], "left")
    size = momentum * F.col("size") + (1 - momentum) * F.coalesce("_n", F.lit(0))
    total = momentum * F.col("total") + (1 - momentum) * F.coalesce("_s", F.lit(0.0))
    return joined.select("code", "dim", total.alias("total"), size.alias("size"), F.when(size >= 1, total / size).otherwise(F.coalesce("spare", "c")).alias("c"))


def token_rate(n_codes: Column, seconds: Column, size: int) -> tuple[Column, Column]:
    """Codes and bits per second, as aggregates."""
    rate = F.try_divide(F.sum(n_codes), F.sum(seconds))
    return rate, rate * F.log2(F.lit(float(size)))
