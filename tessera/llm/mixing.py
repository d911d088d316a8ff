"""Mixing sources to target weights by Poisson replication.

A source with n documents and target weight w gets the mean repetition rate epochs * N * w / n. Each
document inverts the Poisson distribution of its source's rate at a uniform number hashed from the
seed and its doc_id, is exploded by that count, and the copies are dealt out in a random order. The rates
of up to MAX_SOURCES sources are broadcast, so the texts are shuffled once, at the end; those of more
sources meet them by a shuffle over (source, salt), which splits the largest source over SALTS tasks.

Edge cases: a null source is a source of its own; rows of equal doc_id (nulls too) get equal counts;
an empty table gives an empty one; columns named like ours are kept under their own names in the
output of `mix_documents`. Rates above 700 are refused, as exp(-rate) would be 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 17
#: A source's weight is its size to this power, unless weights are given.
ALPHA = 0.7
EPOCHS = 1.0
#: Sources up to which the rates (9 kB each at most) are broadcast; salts of a source beyond.
MAX_SOURCES, SALTS = 4096, 64


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the md5 of the parts: 52 bits and a half."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until what is left is far below 2**-53."""
    last = (rate + 12 * F.sqrt(rate) + 40).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(a, k):
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + p)).alias("cdf"))

    return F.reduce(F.sequence(F.lit(1), last), zero, step, lambda a: a["cdf"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS) -> DataFrame:
    """source, rate, cdf: one row for each source of docs.

    weights: target weight by source, which sum to 1 after division by their total (sources not
    listed get 0); by default n**alpha.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "source string, w double")
        weighed = sizes.join(given, "source", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w")).first()  # one row
    rate = F.lit(float(epochs)) * F.lit(total["all_n"]) * F.col("w") / F.lit(total["all_w"] or 1.0) / F.col("n")
    rated = weighed.select("source", rate.alias("rate"))
    safe = F.when(F.col("rate") <= 700, F.col("rate")).otherwise(F.raise_error(F.lit("a repetition rate is above 700")).cast("double"))
    return rated.withColumn("rate", safe).withColumn("cdf", poisson_cdf(F.col("rate")))


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """All columns of docs, then mix_copy (1 up to the document's count), mix_rate and mix_key.

    Rows are dealt out by a hash of (seed, doc_id, copy) and sorted by it inside partitions, which is
    a random order of all of them.
    """
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), F.col("doc_id").alias("id"), F.col("source").alias("own"))
    rates = source_rates(docs, weights, alpha, epochs).withColumnRenamed("source", "rated")
    if docs.select("source").distinct().limit(MAX_SOURCES + 1).count() <= MAX_SOURCES:
        counted = packed.join(F.broadcast(rates), F.col("own").eqNullSafe(F.col("rated")), "left")
    else:
        packed = packed.withColumn("salt", F.pmod(F.xxhash64(F.col("doc")), F.lit(SALTS)))
        salted = rates.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        counted = packed.join(salted.hint("shuffle_hash"), F.col("own").eqNullSafe(F.col("rated")) & (F.col("salt") == F.col("part")), "left")
    u = uniform(str(seed), F.col("id"))
    copies = F.size(F.filter("cdf", lambda c: c < u))
    exploded = counted.where(copies > 0).select("doc", "id", "rate", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    dealt = exploded.withColumn("key", key).repartition("key").sortWithinPartitions("key")
    mine = {"mix_copy": F.col("copy"), "mix_rate": F.col("rate"), "mix_key": F.col("key")}
    return dealt.select(*(F.col("doc")[c].alias(c) for c in names), *(v.alias(k) for k, v in mine.items() if k not in names))
