"""Batch text generation with a caller-supplied client.

Each distinct prompt is generated once: prompts are de-duplicated, spread
over ``partitions`` tasks by hash, generated by ``mapInPandas`` (the client
is built once per task, calls are paced and retried there), and joined back.
Failures are data: ``reply`` is NULL and ``error`` holds the message.

The call rate is one call each ``min_interval`` seconds over all tasks: time
is dealt in turns of that length, and task p of n may call at the start of
every n-th turn only.  This needs no server and no shared state, only clocks
that agree to a fraction of the interval; a task that ends or is not running
leaves its turns unused, so the rate is never above the limit.

``generate_to_table`` makes the replies a durable step: every reply is written
to the reply table from inside the task as it comes, prompts already answered
there are not asked again, neither by a later run nor by another attempt of a
lost task, and later actions read the table instead of calling the client.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmatch.session import ship_by_value

# The pacing and retry policy of the slowest provider client.
MIN_INTERVAL_S = 3.0
RETRY_WAIT_S = 70.0
RETRIES = 2

CHUNK = 8  # replies that a task hands over at a time

SCHEMA = "prompt string, reply string, error string, attempts int"


def _wait_for_turn(interval: float, tasks: int, task: int) -> None:
    """Sleep until the next turn of this task starts."""
    if interval <= 0:
        return
    period, offset = interval * tasks, interval * task
    turn = (math.floor((time.time() - offset) / period) + 1) * period + offset
    while (left := turn - time.time()) > 0:
        time.sleep(left)


class ReplyLog:
    """Replies of one task, each a Parquet file of its own once it is there.

    Files are named after the task, so that another attempt finds what was
    answered; they get their name when they are whole.  A task that ends well
    joins its files into one.  ``folder`` is a path or URI of a file system
    that pyarrow opens on the executors."""

    def __init__(self, folder: str, task: int):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        self.fs.create_dir(self.folder)
        self.name = f"task-{task:05d}-"
        self.answered = {r["prompt"] for f in self._files() for r in self._read(f).to_pylist() if r["error"] is None}

    def _files(self) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.folder))
        return [f.path for f in found if f.base_name.startswith(self.name)]

    def _read(self, path: str):
        import pyarrow.parquet as pq

        return pq.read_table(path, filesystem=self.fs)

    def _write(self, table) -> str:
        import pyarrow.parquet as pq

        name = f"{self.name}{uuid.uuid4().hex}.parquet"
        pq.write_table(table, f"{self.folder}/_{name}", filesystem=self.fs)  # readers skip names with _
        self.fs.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")
        return f"{self.folder}/{name}"

    def add(self, prompt: str, reply: str | None, error: str | None, attempts: int) -> None:
        import pyarrow as pa

        now = pd.Timestamp.now("UTC").floor("us")
        self._write(pa.table({"prompt": pa.array([prompt], pa.string()), "reply": pa.array([reply], pa.string()),
                              "error": pa.array([error], pa.string()), "attempts": pa.array([attempts], pa.int32()),
                              "asked_at": pa.array([now], pa.timestamp("us", "UTC"))}))
        if error is None:
            self.answered.add(prompt)

    def join_files(self) -> None:
        import pyarrow as pa

        files = self._files()
        if len(files) > 1:
            self._write(pa.concat_tables([self._read(f) for f in files]))
            for f in files:
                self.fs.delete_file(f)


def _ask(client: Callable, prompt: str, system_prompt: str, retries: int, retry_wait: float, wait: Callable[[], None]):
    """(reply, error, attempts) of one prompt; a failure is recorded, not raised."""
    for attempt in range(1, retries + 2):
        wait()
        try:
            reply = client(prompt, system_prompt)
            return reply, None if reply is not None else "no reply", attempt
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if attempt <= retries:
                time.sleep(retry_wait)
    return None, error, attempt


def _run(make_client: Callable[[], Callable[[str, str], str]], system_prompt: str, min_interval: float, retries: int,
         retry_wait: float, tasks: int, log: str | None = None):
    def gen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        client = make_client()
        replies = ReplyLog(log, task) if log else None
        columns = ["prompt", "reply", "error", "attempts"]
        for pdf in batches:
            asked = []
            for prompt in pdf["prompt"]:
                if replies and prompt in replies.answered:
                    continue
                row = (prompt, *_ask(client, prompt, system_prompt, retries, retry_wait, lambda: _wait_for_turn(min_interval, tasks, task)))
                if replies:
                    replies.add(*row)
                asked.append(row)
                if len(asked) == CHUNK:
                    yield pd.DataFrame(asked, columns=columns)
                    asked = []
            if asked:
                yield pd.DataFrame(asked, columns=columns)
        if replies:
            replies.join_files()
    return gen


def _ship(make_client: Callable) -> None:
    """Send the task function (and a client defined in this package) by value."""
    ship_by_value(__name__, getattr(make_client, "__module__", "") or "")


def generate_to_table(df: DataFrame, prompt_col: str, make_client: Callable[[], Callable[[str, str], str]],
                      path: str, system_prompt: str = "", partitions: int = 8, min_interval: float = MIN_INTERVAL_S,
                      retries: int = RETRIES, retry_wait: float = RETRY_WAIT_S) -> DataFrame:
    """T1-T4 and W10 as a durable step: ask every prompt that the reply table
    at ``path`` does not answer yet, and return ``df`` with ``reply``, ``error``
    and ``attempts`` read from the table.

    Each reply is in the table before the next prompt is asked, so a run that
    breaks off has lost none: a task's next attempt and the next run ask only
    what is not answered.  Of a prompt's rows the newest without an error
    counts, else the newest; a prompt whose calls failed is asked again by the
    next run.  ``path`` must open by pyarrow on the executors and by Spark."""
    _ship(make_client)
    spark = df.sparkSession
    schema = SCHEMA + ", asked_at timestamp"
    prompts = df.select(F.col(prompt_col).alias("prompt")).where(F.col("prompt").isNotNull()).distinct()
    try:
        known = spark.read.schema(schema).parquet(path, recursiveFileLookup=True)
    except AnalysisException:  # no table yet
        known = None
    if known is not None:
        prompts = prompts.join(known.where("error is null").select("prompt").distinct(), "prompt", "left_anti")
    run = f"{path.rstrip('/')}/run-{uuid.uuid4().hex}"
    prompts.repartition(partitions, "prompt").mapInPandas(
        _run(make_client, system_prompt, min_interval, retries, retry_wait, partitions, run), SCHEMA).write.format("noop").mode("overwrite").save()
    replies = spark.read.schema(schema).parquet(path, recursiveFileLookup=True)
    best = F.max_by(F.struct("reply", "error", "attempts"), F.struct(F.col("error").isNull(), "asked_at"))
    replies = replies.groupBy(F.col("prompt").alias(prompt_col)).agg(best.alias("_r")).select(prompt_col, "_r.*")
    return df.join(replies, prompt_col, "left")


def generate_by_provider(df: DataFrame, prompt_col: str, provider_col: str, clients: dict[str, Callable],
                         **settings) -> DataFrame:
    """Each row's prompt goes to the client of its provider.  ``clients``
    maps provider names to ``make_client``; a row with another provider gets
    no call and the error ``unknown provider``."""
    parts = []
    for name, make_client in clients.items():
        mine = df.where(F.lower(provider_col) == name.lower())
        parts.append(batch_generate(mine, prompt_col, make_client, **settings))
    names = [n.lower() for n in clients]
    rest = df.where(~F.coalesce(F.lower(provider_col).isin(names), F.lit(False)))
    parts.append(rest.withColumns({"reply": F.lit(None).cast("string"), "error": F.lit("unknown provider"),
                                   "attempts": F.lit(0)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_generate(df: DataFrame, prompt_col: str, make_client: Callable[[], Callable[[str, str], str]],
                   system_prompt: str = "", partitions: int = 8, min_interval: float = MIN_INTERVAL_S,
                   retries: int = RETRIES, retry_wait: float = RETRY_WAIT_S) -> DataFrame:
    """Add ``reply``, ``error``, ``attempts`` for ``prompt_col``.

    ``make_client()`` runs on the executors and returns ``f(prompt, system)``.
    Rows with a NULL prompt get no call and NULL results.  The task function
    (and a client defined in this package) is shipped by value, so executors
    need no copy of the package; a caller's own client module must be on the
    executors' path as usual (``--py-files``)."""
    _ship(make_client)
    prompts = (df.select(F.col(prompt_col).alias("prompt")).where(F.col("prompt").isNotNull())
               .distinct().repartition(partitions, "prompt"))
    out = prompts.mapInPandas(_run(make_client, system_prompt, min_interval, retries, retry_wait, partitions), SCHEMA)
    return df.join(out.withColumnRenamed("prompt", prompt_col), prompt_col, "left")
