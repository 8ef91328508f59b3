"""Session helpers: reliable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Largest number of rows that may travel through the driver or be broadcast.
# Tables above it take the shuffled path; the result is the same.
SMALL_ROWS = 100_000


def local_session(cores: int | str = "*", memory: str = "12g", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("phasewise")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "localhost")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for local runs without it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="phasewise-ckpt-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a ``cut`` table that nothing reads any more."""
    files = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if files.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def columns_used(df: DataFrame, *exprs: Column) -> list[str]:
    """Names of the columns of ``df`` that ``exprs`` read."""
    refs = df.select(*exprs)._jdf.queryExecution().analyzed().references().iterator()
    names = set()
    while refs.hasNext():
        names.add(refs.next().name())
    return [c for c in df.columns if c in names]


def local_frame(spark: SparkSession, pdf: pd.DataFrame, schema) -> DataFrame:
    """DataFrame over a small pandas frame (statistics, never row data).

    Goes through an Arrow table of the explicit schema, so numpy cells work whatever the session's
    Arrow setting is, and NaN stays NaN (only None becomes NULL).
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    target = to_arrow_schema(kind)
    columns = []
    for field in target:
        cells = [c.tolist() if isinstance(c, np.ndarray) else c for c in pdf[field.name].tolist()]
        columns.append(pa.array(cells, type=field.type, from_pandas=False))
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=target), kind)


def settle(df: DataFrame, limit: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate a table of statistics once.

    Returns ``(table, small)``: up to ``limit`` rows become a local table that may be
    broadcast; anything larger is checkpointed and must be joined by shuffle.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows <= limit:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return cut(df), False


def join_small(left: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a table that is normally tiny: broadcast when its size is proven, else shuffle."""
    table, fits = settle(small)
    return left.join(F.broadcast(table) if fits else table, list(on), how)


def per_row_numpy(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema, limit: int = SMALL_ROWS
) -> tuple[DataFrame, bool, pd.DataFrame | None]:
    """Apply a vectorised row function to a table of per-group statistics.

    Few groups: one small fetch. Many groups: the same function runs in tasks.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows <= limit:
        out = fn(rows.to_pandas())
        return local_frame(df.sparkSession, out, schema), True, out
    return cut(df.mapInPandas(lambda it: (fn(p) for p in it), schema)), False, None
