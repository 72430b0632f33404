"""Helpers shared by the operators of this package."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmatch.session import checkpoint_dir
from flowmatch.sources.tables import table


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The whole ``documents`` table, only the named columns."""
    ship_code(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select(*columns) if columns else docs


def ship_code(spark: SparkSession) -> None:
    """Have Spark hand this package's source to the Python workers, once a
    session, so that tasks can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_flowmatch_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="flowmatch-code-"), f"{top.name}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(to)
    sc._flowmatch_shipped = True


def kept(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of ``spark.checkpoint.dir``.

    Later reads survive the loss of executors, and random or
    partition-dependent values (row numbers, approximate quantiles) are fixed.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def constant(values: list, schema: str) -> Column:
    """A constant of any length as one expression: folded when the plan is made."""
    return F.from_json(F.lit(json.dumps(values)), schema)


def surrogate_key(spark: SparkSession) -> str:
    """The secret key of surrogates: the session's ``spark.flowmatch.surrogate.key``.
    Sessions that set none, such as tests, share a public one."""
    return spark.conf.get("spark.flowmatch.surrogate.key", None) or "no secret"


def slots(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for (the unit of layout choices)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unsigned(value: int) -> int:
    return value & 0xFFFFFFFFFFFFFFFF


def signed(value: int) -> int:
    """A 64-bit pattern as the signed long that Spark stores."""
    value &= 0xFFFFFFFFFFFFFFFF
    return value - (1 << 64) if value >= 1 << 63 else value
