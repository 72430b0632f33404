"""Label encoding with a kept vector store.

Every distinct label is encoded once, ever: labels that the store does not
hold yet go, in batches, to an encoder that each task builds once (one model a
worker), and their vectors are appended to the store.  Later runs and other
tables read them from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmatch.session import ship_by_value

SCHEMA = "label string, vector array<double>"
BATCH = 256  # labels that the encoder is given at a time


def _run(make_encoder: Callable[[], Callable[[list[str]], list]], batch: int):
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for frame in frames:
            for at in range(0, len(frame), batch):
                labels = list(frame["label"].iloc[at:at + batch])
                encoder = encoder or make_encoder()  # a task without labels loads no model
                vectors = [[float(x) for x in v] for v in encoder(labels)]
                if len(vectors) != len(labels):
                    raise ValueError(f"{len(vectors)} vectors for {len(labels)} labels")
                yield pd.DataFrame({"label": labels, "vector": vectors})
    return encode


def encode_labels(labels: DataFrame, make_encoder: Callable[[], Callable[[list[str]], list]], store: str,
                  label: str = "label", partitions: int = 8, batch: int = BATCH) -> DataFrame:
    """``(label, vector)`` of every distinct label in ``labels``, NULL left
    out, from the Parquet table at ``store``, which is extended by what it
    lacks.

    ``make_encoder()`` runs on the executors and returns a function of a list
    of labels that gives their vectors in order; ``partitions`` bounds how many
    models are loaded at a time.  The encoder is called in this step, not when
    the result is read.  An encoder that fails ends the run, and the store is
    as it was; a label that two runs at once encode counts once."""
    ship_by_value(__name__, getattr(make_encoder, "__module__", "") or "")
    spark = labels.sparkSession
    wanted = labels.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    try:
        known = spark.read.schema(SCHEMA).parquet(store)
    except AnalysisException:  # no store yet
        known = None
    new = wanted if known is None else wanted.join(known.select("label"), "label", "left_anti")
    new.repartition(partitions, "label").mapInPandas(_run(make_encoder, batch), SCHEMA).write.mode("append").parquet(store)
    held = spark.read.schema(SCHEMA).parquet(store).join(wanted, "label", "left_semi")
    return held.groupBy("label").agg(F.min("vector").alias("vector"))
