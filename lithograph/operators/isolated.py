"""Work on rows of which some fail: failures go to a dead-letter table with reason and attempt, and are taken up again.

A run of `attempt` calls the work on every row that is due, catches what one row raises, and writes one
table with the outcome of each. The outcomes of an attempt are whole or not there (Spark's commit of a
write), so a driver that dies repeats an attempt from its start and no row is worked on twice by two
attempts: due rows are those given at first, later the failed ones of the last attempt. Work must bear
being repeated, as Spark repeats tasks of lost executors.

Defined cases: rows whose key is null or repeated are rows of their own; a row that fails ``most`` times is
given up and stays in `dead`; an attempt without due rows is none; rows of any other type of failure than an
exception (a worker that is killed) fail the attempt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a reason that are kept, and attempts of a row.
REASON, MOST = 500, 3


def _attempts(spark: SparkSession, path: str) -> list[int]:
    """The attempts whose outcomes are whole."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(make(path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(make(path))]
    return sorted(n for n in (int(x.removeprefix("attempt=")) for x in names if x.startswith("attempt=")) if fs.exists(make(f"{path}/attempt={n}/_SUCCESS")))


def _outcomes(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.parquet(f"{path}/attempt={n}")


def attempt(rows: DataFrame, work: Callable[[dict], str | None], path: str, most: int = MOST) -> bool:
    """Works on the rows that are due; false if there is none. ``work`` gets a row as a dict and gives its result as text.

    rows are asked for at the first attempt of a path only; they keep their columns beside ``result``, ``reason``
    (null if it went well) and ``tries``.
    """
    spark = rows.sparkSession
    done = _attempts(spark, path)
    n = done[-1] + 1 if done else 1
    due = _outcomes(spark, path, done[-1]).where((F.col("reason").isNotNull()) & (F.col("tries") < most)) if done else rows.withColumn("tries", F.lit(0))
    names = rows.columns
    due = due.select(*names, "tries")
    if done and due.isEmpty():
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, reasons = [], []
            for row in batch.select(names).to_pylist():
                try:
                    result, reason = work(row), None
                except Exception as e:  # one row's failure is its own: it is kept with its reason
                    result, reason = None, f"{type(e).__name__}: {e}"[:REASON]
                results.append(result)
                reasons.append(reason)
            tries = pa.array([t + 1 for t in batch.column("tries").to_pylist()], pa.int32())
            columns = [*(batch.column(c) for c in names), tries, pa.array(results, pa.string()), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "tries", "result", "reason"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "tries int", "result string", "reason string"])
    due.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{path}/attempt={n}")
    return True


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The rows that went well, each with its result and the try that did."""
    out = None
    for n in _attempts(spark, path):
        part = _outcomes(spark, path, n).where("reason is null").drop("reason")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"{path} has no attempt")
    return out


def dead(spark: SparkSession, path: str) -> DataFrame:
    """The rows that failed at the last attempt and those given up before, with the last reason."""
    numbers = _attempts(spark, path)
    if not numbers:
        raise ValueError(f"{path} has no attempt")
    # a row fails at every attempt until it goes well or is given up, so what failed last is all there is
    return _outcomes(spark, path, numbers[-1]).where("reason is not null").drop("result")
