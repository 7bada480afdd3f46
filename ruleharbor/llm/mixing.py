"""Mixing of sources to target weights by Poisson replication.

A source's mean repetition rate is ``target share * target size / size of the source``. A
document draws its number of copies by inverting the Poisson distribution of that mean at a
number in [0, 1) that is a hash of the seed and its id: the same rows and seed give the same
copies on any cluster. Copies are exploded and dealt out by a hash of seed, id and copy number,
so each output partition is a random part of the whole, sorted at random.

Sizes are sums over all documents (characters, and one more per document), pre-aggregated in the
map tasks. Only the table of sources joins the documents; it is broadcast after its rows were counted.

Defined cases: a null source is a source of its own, a null text has no characters, rows with equal
ids get equal counts, rows without id draw as one. A source without target weight counts as weight 0.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleharbor.llm.common import cut, small

SEED = "mix-1"
POWER = 0.5  # target weights grow as the square root of the sizes unless weights are given


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, .. up to where nothing of 2**-52 is left, summed in log space."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("logf"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("steps"))

    def add(state, k):
        logf = state["logf"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(F.lit(0.0))
        total = state["total"] + F.exp(k * F.log(rate) - rate - logf)
        return F.struct(logf.alias("logf"), total.alias("total"), F.concat(state["steps"], F.array(total)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, add)["steps"]).otherwise(F.array(F.lit(1.0)))


def rates(documents: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """Per source: its size, target weight, mean repetition rate and the steps of its Poisson distribution."""
    sizes = documents.groupBy("source").agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(POWER)))
    else:
        given = documents.sparkSession.createDataFrame(
            [(s, float(w)) for s, w in weights.items()], "given string, weight double")
        weighed = sizes.join(given, sizes["source"].eqNullSafe(F.col("given")), "left").drop("given").fillna(
            0.0, ["weight"])
    weighed = cut(weighed)
    all_size, all_weight = weighed.agg(F.sum("size"), F.sum("weight")).first()
    rate = F.col("weight") / F.lit(all_weight or 1.0) * F.lit(float(all_size or 0)) / F.col("size") * F.lit(float(epochs))
    return weighed.withColumn("rate", rate).withColumn("steps", poisson_steps(F.col("rate"))).select(
        F.col("source").alias("__source"), "size", "weight", "rate", F.col("steps").alias("__steps"))


def replicate(documents: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0,
              seed: str = SEED) -> DataFrame:
    """Each document as often as its draw says, with ``__copy`` (from 0) and ``__order``, in hashed order."""
    per_source = small(cut(rates(documents, weights, epochs).select("__source", "__steps")))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = documents.join(per_source, documents["source"].eqNullSafe(F.col("__source")))
    count = F.size(F.filter("__steps", lambda s: s <= unit(F.lit(seed), ident)))
    copies = drawn.withColumn("__count", count).where("__count > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident, F.col("__copy").cast("string")))
    keyed = copies.withColumn("__order", order)
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "__order").sortWithinPartitions("__order").select(
        *documents.columns, "__copy", "__order")


def mix(documents: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0,
        seed: str = SEED) -> DataFrame:
    """The mixed collection with the columns of ``documents``."""
    return replicate(documents, weights, epochs, seed).select(*documents.columns)
