"""The borders to models: what is asked of one is asked once, on the executors, and kept."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Turns a text into a vector; a model's client.
Embed = Callable[[str], list[float]]
#: Turns a document's text into the JSON text of a record; a model's client.
Structure = Callable[[str], str | dict]


def _kept(df: DataFrame, path: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def embedded(texts: DataFrame, column: str, embed: Embed, path: str) -> DataFrame:
    """texts with ``vector``: each distinct text is embedded once and kept at ``path``, from where later calls take it.

    A null text has no vector; a text that ``embed`` fails on has none either, and is asked again by the next call.
    One writer at a time.
    """
    ship(texts.sparkSession)
    fresh = texts.select(F.col(column).alias("_text")).where("_text is not null").distinct()
    known = _kept(texts, path)
    fresh = fresh if known is None else fresh.join(known, "_text", "left_anti")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["_text"]:
                try:
                    rows.append((t, [float(x) for x in embed(t)]))
                except Exception:  # one text must not end the job
                    continue
            yield pd.DataFrame(rows, columns=["_text", "vector"])

    fresh.mapInPandas(make, "_text string, vector array<double>").write.mode("append").parquet(path)
    return texts.drop("vector").join(texts.sparkSession.read.parquet(path), F.col(column) == F.col("_text"), "left").drop("_text")


def structured(texts: DataFrame, structure: Structure) -> DataFrame:
    """texts (with a column text) and ``output``, what ``structure`` made of each, and ``error`` where it failed or there is no text.

    An error that is there already stays. Equal texts are asked for as often as they occur: a document is a document.
    """
    ship(texts.sparkSession)
    columns = [c for c in texts.columns if c not in ("output", "error")]
    rows = texts if "error" in texts.columns else texts.withColumn("error", F.lit(None).cast("string"))
    rows = rows.select(*columns, "error")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", output string"

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            said, wrong = [], []
            for text, error in zip(b["text"], b["error"]):
                made = None
                if not error:
                    try:
                        if not text:
                            raise ValueError("no text")
                        made = structure(text)
                        made = made if isinstance(made, str) else json.dumps(made)
                    except Exception as fault:  # one document must not end the job
                        error = f"{type(fault).__name__}: {fault}"
                said.append(made)
                wrong.append(error or None)
            b["error"], b["output"] = wrong, said
            yield b

    return rows.mapInPandas(make, schema)
