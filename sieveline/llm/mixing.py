"""Mixing of sources to target weights, by systematic sampling along a distributed prefix sum.

Within a source the documents are ordered by size, each adds its expected copies to a running sum, and is used once for
every whole number the sum passes, counted from one random offset. Ordered by size, every stretch of the offset takes
short and long documents alike, so that the tokens come out close to the target. Sums are whole numbers of 2**-24
copies: they are exact, and the same however the rows are partitioned.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, range_parts, ship, small, spread

UNIT = 1 << 24


#: The setting that names the file of a public tokenizer, as it is found on every executor; used where no path is given.
TOKENIZER = "spark.sieveline.tokenizer"


def default_tokenizer(spark: SparkSession) -> str:
    """The path in the setting TOKENIZER, else that of an installed public tokenizer."""
    named = spark.conf.get(TOKENIZER, None)
    if named:
        return named
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of every document; a null text has 0 tokens. Texts are counted whole; repeated rows once."""
    ship(documents.sparkSession)
    path = tokenizer or default_tokenizer(documents.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(path)
        for b in batches:
            sizes = []
            for a in range(0, len(b), 256):
                sizes += [len(e.ids) for e in t.encode_batch([x or "" for x in b["text"].iloc[a : a + 256]], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": sizes})

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return spread(slim).mapInPandas(count, "doc_id long, source string, n_tokens long").distinct()


def plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, available_tokens, wanted_tokens, units: the expected copies of a source's documents in 2**-24.

    A source wants its share of the tokens of all documents, also of those whose source is not listed, and has at most
    max_repeats copies of each. A null or negative share or cap counts as 0; a source listed twice counts with its
    greater share.
    """
    listed = targets.select(F.col("source").cast("string").alias("source"), F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0)).alias("max_repeats"))
    listed = listed.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*")
    held = counts.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    total = held.agg(F.coalesce(F.sum("available_tokens"), F.lit(0)).alias("all_tokens"))
    out = listed.join(held, "source", "left").fillna({"available_tokens": 0}).crossJoin(F.broadcast(total))  # total is one row
    out = out.withColumn("wanted_tokens", F.col("target_share") * F.col("all_tokens"))
    copies = F.least(F.col("max_repeats").cast("double"), F.col("wanted_tokens") / F.nullif("available_tokens", F.lit(0)))
    return out.withColumn("units", F.coalesce(F.floor(copies * UNIT), F.lit(0)).cast("long")).drop("all_tokens")


def systematic(df: DataFrame, group: str, order: list[str], units: str, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """df with ``copies``: how often each row is used. ``order`` must tell all rows of a group apart, up to equal ones.

    The running sum of ``units`` is carried from partition to partition of a global range sort; a group may fill many.
    """
    spark = df.sparkSession
    ship(spark)
    df = cut(df)
    n = partitions or range_parts(df)
    rows = cut(df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)).withColumn("_pid", F.spark_partition_id())
    sums = rows.groupBy("_pid", group).agg(F.sum(units).alias("sum"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    # A group's first row of a partition begins at what the partitions before it hold; all later ones follow from it.
    heads = sums.groupBy("_pid").agg(F.min(F.struct(group, "base")).alias("x")).select("_pid", f"x.{group}", "x.base").collect()  # one row a partition
    begins = {r["_pid"]: (r[group], r["base"]) for r in heads}
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", copies int"

    def use(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, total = None, 0
        first = True
        for b in batches:
            if b.empty:
                continue
            if first:
                name, total = begins[int(b["_pid"].iloc[0])]
                first = False
            copies = np.zeros(len(b), np.int64)
            who, unit = b[group].to_numpy(), b[units].to_numpy(np.int64)
            edges = [0, *(np.flatnonzero(who[1:] != who[:-1]) + 1), len(b)]
            for x, y in zip(edges, edges[1:]):
                if who[x] != name:
                    name, total = who[x], 0
                reached = total + _offset(name, seed) + np.cumsum(unit[x:y])
                copies[x:y] = reached // UNIT - (reached - unit[x:y]) // UNIT
                total += int(unit[x:y].sum())
            out = b[names].copy()
            out["copies"] = copies
            yield out

    return rows.mapInPandas(use, schema)


def _offset(name: str, seed: int) -> int:
    """A group's random offset, in units: the same wherever it is asked for."""
    return zlib.crc32(f"{seed}:{name}".encode()) % UNIT


def chosen(counts: DataFrame, planned: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, n_tokens, copies of the documents of listed sources that are used at least once."""
    rows = counts.join(small(planned.select("source", "units")), "source").where("units > 0")
    used = systematic(rows.select("doc_id", "source", "n_tokens", "units"), "source", ["n_tokens", "doc_id"], "units", seed)
    return used.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, n_tokens, copies of the documents that are used; the rest, and sources that are not listed, are not.

    Null and empty texts have 0 tokens and are chosen like others. Documents of equal size are told apart by doc_id.
    Repeated rows count once, other columns are not read, empty tables give an empty result.
    """
    counts = cut(token_counts(documents, tokenizer))
    return chosen(counts, cut(plan(counts, targets)), seed)


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, seed: int = 17) -> DataFrame:
    """source, target_share, max_repeats, available_tokens, wanted_tokens, used_tokens, actual_share, shortfall_tokens.

    actual_share is of the tokens of all documents, as target_share is; shortfall_tokens is what a source falls short
    of its target because even max_repeats copies of all its documents do not reach it.
    """
    counts = cut(token_counts(documents, tokenizer))
    planned = cut(plan(counts, targets))
    used = chosen(counts, planned, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    total = counts.agg(F.sum("n_tokens").alias("all_tokens"))
    out = planned.drop("units").join(used, "source", "left").fillna({"used_tokens": 0}).crossJoin(F.broadcast(total))  # total is one row
    short = F.greatest(F.lit(0.0), F.col("wanted_tokens") - F.col("available_tokens") * F.col("max_repeats"))
    return out.withColumn("actual_share", F.col("used_tokens") / F.nullif("all_tokens", F.lit(0))).withColumn("shortfall_tokens", short).drop("all_tokens")
