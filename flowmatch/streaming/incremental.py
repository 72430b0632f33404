"""Incremental scoring of newly arriving model texts.

``start_files`` streams whole text files, one model a file, whose paths name
the model.  A model that is delivered again -- under another path, in the same
batch or a later one -- is scored once: the sink is keyed by the model, and a
batch leaves out what earlier batches have scored (W10).

``start_lines`` streams model lines from Parquet rows that carry the model
keys.  Every model is written whole into one file -- ``write_models``
co-locates a model's lines with ``repartition`` on its keys.

A file is never split across micro-batches, so no state crosses batches: each
batch is parsed, labelled and scored against the (static) expected models with
the same operators as the batch path.  Each batch's result is written to
``<sink>/batch_id=<n>`` with overwrite, so a replayed batch (after a lost
executor or driver restart) replaces its own output -- exactly-once results
from an at-least-once ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmatch.operators import labels as L
from flowmatch.operators import parse as P
from flowmatch.operators import reshape as R
from flowmatch.operators import score as S
from flowmatch.session import counted_broadcast, dealt


# Tasks that list the files of a batch, and the bytes that opening a file counts as.
_SMALL_FILES = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64", "spark.sql.files.openCostInBytes": "65536"}


def score_batch(batch: DataFrame, key_cols: list[str], assign: DataFrame,
                expected_counts: DataFrame, method: str = "dice") -> tuple[DataFrame, list[DataFrame]]:
    """Parse one batch of (keys..., line_no, value) lines or of (keys..., text)
    models and score its models.

    ``assign`` (keys..., pattern, m1) names each model's expected model;
    ``expected_counts`` holds the label counts of the expected models.
    Returns the scores and the intermediates it persisted (counts and flags
    feed several branches); the caller unpersists them after writing."""
    model = F.struct(*[F.col(k) for k in key_cols])
    if "text" in batch.columns:
        lns = P.lines(batch.select(model.alias("model_id"), "text"))
    else:
        # dealt once by model: a model's lines, elements and flows stay together
        lns = dealt(batch.select(model.alias("model_id"), "line_no", F.col("value").alias("line")), "model_id")
    models = lns.select("model_id").distinct()
    p = P.parse_lines(lns, models, number=False)
    counts = S.label_counts(L.model_labels(p["elements"], L.parsed_flows(p["flows"]))).persist()
    flags = p["flags"].persist()
    pairs = (models.select(*[F.col("model_id")[k].alias(k) for k in key_cols], F.col("model_id").alias("m2"))
             .join(assign, key_cols))
    # a model of the batch may itself be an expected model: keep one copy of its counts
    exp_ids = expected_counts.select("model_id").distinct()
    allc = counts.join(exp_ids, "model_id", "left_anti").unionByName(expected_counts)
    sc = S.score_pairs(pairs, allc, method=method, pairs_unique=True, model_flags=flags,
                       truth=counted_broadcast(expected_counts))
    return sc.drop("m1", "m2"), [counts, flags]


def write_models(lines: DataFrame, path: str, key_cols: list[str], partition_by: list[str],
                 files: int | None = None) -> None:
    """Append model lines (keys..., line_no, value) so that each model lands in
    one file; by default as many writers as the session has shuffle partitions."""
    dealt = lines.repartition(files, *key_cols) if files else lines.repartition(*key_cols)
    dealt.write.mode("append").partitionBy(*partition_by).parquet(path)


def _write_batch(out: DataFrame, held: list[DataFrame], sink: str, batch_id: int) -> None:
    out.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    for d in held:
        d.unpersist()


def _whole_files(spark: SparkSession, in_dir: str, glob: str) -> DataFrame:
    """A stream of ``(path, text)``, one row for each file.

    The text source copies the session's whole Hadoop configuration for each
    file, under a lock that all tasks of an executor share; the binary source
    does not, but leaves compressed files as they are."""
    path = F.col("_metadata.file_path").alias("path")
    files = {"recursiveFileLookup": True, "pathGlobFilter": glob}
    if glob.endswith(".txt"):
        rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        return rows.options(**files).load(in_dir).select(path, F.col("content").cast("string").alias("text"))
    return spark.readStream.text(in_dir, wholetext=True, **files).select(path, F.col("value").alias("text"))


def _started(src: DataFrame, each, checkpoint: str, available_now: bool):
    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_lines(spark: SparkSession, in_dir: str, schema: str, key_cols: list[str], assign: DataFrame,
                expected_counts: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """Start a stream of model lines in Parquet; returns the StreamingQuery.

    ``assign`` and ``expected_counts`` are static: pass them materialised
    (``session.cut_lineage``) so micro-batches do not recompute them."""
    src = spark.readStream.schema(schema).option("basePath", in_dir).parquet(in_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        b = batch.persist()  # the batch feeds several branches of the plan
        out, held = score_batch(b, key_cols, assign, expected_counts)
        _write_batch(out, held + [b], sink, batch_id)

    return _started(src, each, checkpoint, available_now)


def start_files(spark: SparkSession, in_dir: str, key_pattern: str, keys: dict[str, str], assign: DataFrame,
                expected_counts: DataFrame, sink: str, checkpoint: str, glob: str = "*.txt", available_now: bool = True):
    """Start a stream of whole text files below ``in_dir``, nested folders
    included; returns the StreamingQuery.

    ``key_pattern`` is a regular expression whose groups are, in order, the
    model keys in a file's path, ``keys`` their names and types.  Files whose
    path does not match are left out.  Of several files of one model the one
    that came in the earlier batch counts, in one batch the one whose path
    sorts first.  ``assign`` and ``expected_counts`` as in ``start_lines``.

    The files are small: the stream lists and reads many of them in a task."""

    def each(batch: DataFrame, batch_id: int) -> None:
        models = batch.where(F.regexp_like("path", F.lit(key_pattern)))
        models = models.select(*[F.regexp_extract("path", key_pattern, i + 1).cast(t).alias(k) for i, (k, t) in enumerate(keys.items())], "path", "text")
        models = models.groupBy(*keys).agg(F.min_by("text", "path").alias("text"))
        try:  # the batch's own folder is there if it is replayed
            done = spark.read.parquet(sink).where(F.col("batch_id") != batch_id)
        except AnalysisException:  # nothing scored yet
            done = None
        if done is not None:
            models = R.skip_done(models, done, list(keys))
        models = models.persist()
        out, held = score_batch(models, list(keys), assign, expected_counts)
        _write_batch(out, held + [models], sink, batch_id)

    before = {name: spark.conf.get(name) for name in _SMALL_FILES}
    try:
        for name, value in _SMALL_FILES.items():
            spark.conf.set(name, value)
        # a file source lists and reads by the settings of its own session whenever a batch begins, not by those of
        # the stream's start: a copy of the session keeps them
        own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
        src = _whole_files(own, in_dir, glob)
        return _started(src, each, checkpoint, available_now)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
