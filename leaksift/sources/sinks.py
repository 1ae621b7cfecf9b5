"""Sinks. A result replaces the earlier one only when its job has succeeded."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F


def _replace(rows: DataFrame, path: str, save: Callable[[DataFrameWriter, str], None]) -> None:
    """Save beside ``path``, then swap the folders by rename.

    A job that fails leaves the earlier result as it was. Spark's own overwrite
    deletes it before the job begins. Both folders lie on one file system, so a
    rename moves no data.
    """
    jvm = rows.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    new, old = (jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}.{kind}.{uuid.uuid4().hex}") for kind in ("new", "old"))
    files = target.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration())
    try:
        save(rows.write.mode("error"), new.toString())
    except BaseException:
        files.delete(new, True)
        raise
    earlier = files.exists(target)
    if earlier and not files.rename(target, old):
        raise OSError(f"cannot move {path} aside; the new result is in {new.toString()}")
    if not files.rename(new, target):
        if earlier:
            files.rename(old, target)
        raise OSError(f"cannot move the new result to {path}; it is in {new.toString()}")
    if earlier:
        files.delete(old, True)


def write_by_source(rows: DataFrame, path: str, source: str = "source", fmt: str = "parquet") -> None:
    """Annotated rows, one folder per source; a large source may fill several files."""
    _replace(rows, path, lambda w, p: w.partitionBy(source).format(fmt).option("header", True).save(p))


def write_splits(rows: DataFrame, path: str, helpers: Sequence[str] = (), split: str = "split",
                 fmt: str = "csv") -> None:
    """Split tables without their helper columns, one folder per split."""
    _replace(rows.drop(*helpers), path, lambda w, p: w.partitionBy(split).format(fmt).option("header", True).save(p))


def write_result(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A result that replaces the earlier one when the job has succeeded."""
    _replace(rows, path, lambda w, p: w.format(fmt).save(p))


def write_summary(summary: DataFrame, path: str) -> None:
    """A long summary table (metric, value and keys) as JSON lines."""
    _replace(summary, path, lambda w, p: w.json(p))


def nested_summary(summary: DataFrame, by: Sequence[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """One row per group with its metrics as a map."""
    entries = F.map_from_entries(F.collect_list(F.struct(metric, value)))
    return summary.groupBy(*by).agg(entries.alias("metrics"))


def append_fingerprints(rows: DataFrame, path: str) -> None:
    """Add newly fingerprinted items to the cache."""
    rows.write.mode("append").parquet(path)
