"""Scans with explicit schemas: nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksift.functions.digest import sha256_digest
from leaksift.functions.keys import basename, slash_path
from leaksift.operators.skew import estimated_bytes, first_per_key

# Column names of annotation files; the reference corpus is part of three of them.
def annotation_schema(reference: str) -> str:
    return ("source string, partition string, cv_dataset string, cv_split string, filename string, path string, "
            f"phash string, dhash string, min_phash_dist_to_{reference} int, min_dhash_dist_to_{reference} int, "
            f"nearest_{reference}_file string")


RUN_SCHEMA = (
    "args map<string,string>, meta map<string,string>, runs array<struct<seed: int, "
    "history: array<struct<epoch: int, loss: double, bal_acc: double>>, "
    "last: map<string, struct<acc: double, bal_acc: double, balanced_accuracy: double, f1_macro: double, "
    "mean_auc_ovr: double, combined_ovr: double, null_acc: double, n_test: bigint, "
    "per_class: map<string, struct<recall: double, n: bigint>>, "
    "per_source: map<string, struct<n: bigint, bal_acc: double, acc: double>>>>>>"
)
# Fixed value: a cell anywhere in a log line, `[corr sev=N fold=N method] bal=x ent=x pass=x`; names hold no white space.
CELL_LINE = r"\[(\S+) sev=(\d+) fold=(\d+) (\S+)\] bal=([\d.]+) ent=([\d.]+) pass=([\d.]+)"


def scanned_file() -> Column:
    """Name of the file a row came from; Spark hands it over percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def spread_input(df: DataFrame, *key: str, most_bytes: int | None = None) -> DataFrame:
    """Spread an input with fewer scan partitions than cores; larger inputs stay as they are.

    Only a small input has so few partitions, so the extra shuffle is bounded by
    one scan split per core. For long work on every row ``most_bytes`` bounds what
    a partition reads, by Spark's estimate: a scan's splits grow with the input
    up to a limit that suits reading alone, and never part a row group. That
    shuffles the input once.
    """
    cores, have = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    parts = max(cores, -(-estimated_bytes(df) // most_bytes) if most_bytes else 0)
    return df if have >= parts else df.repartition(parts, *key)


def class_columns(columns: Sequence[str], classes: Sequence[str]) -> list[str]:
    """Class columns of a manifest, found by name."""
    return [c for c in classes if c in columns]


def manifest_schema(classes: Sequence[str]) -> T.StructType:
    fields = [T.StructField("image_path", T.StringType()), T.StructField("Dataset", T.StringType())]
    return T.StructType(fields + [T.StructField(c, T.IntegerType()) for c in classes])


def read_manifest(spark: SparkSession, paths: dict[str, str], classes: Sequence[str],
                  listing: DataFrame | None = None) -> DataFrame:
    """Split manifests (split → CSV path) as one table; rows whose file is not listed are left out."""
    parts = None
    for split, path in paths.items():
        part = (spark.read.schema(manifest_schema(classes)).option("header", True).csv(path)
                .withColumn("image_path", slash_path(F.col("image_path"))).withColumn("split", F.lit(split)))
        parts = part if parts is None else parts.unionByName(part)
    if listing is None:
        return parts
    return parts.join(listing.select(F.col("path").alias("image_path")), "image_path", "left_semi")


def list_classes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files under class folders: ``class`` (folder), ``filename``, ``path``; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(root).select("path", "length"))
    listed = files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class"), basename(F.col("path")).alias("filename"),
        "path", "length")
    return first_per_key(listed, ["filename"], ["path"])


def file_digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path`` and SHA-256 of every file below a root."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).load(root)
            .select("path", sha256_digest(F.col("content")).alias("digest"), "length"))


def missing_fingerprints(items: DataFrame, cache: DataFrame, key: str, digest: str) -> DataFrame:
    """Items whose (key, content digest) is not cached yet; equal counts would not prove that."""
    return items.join(cache.select(key, digest), [key, digest], "left_anti")


def read_annotations(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Annotation CSVs as one table with the file each row came from; no existing file is an error."""
    existing = [p for p in paths if _exists(spark, p)]
    if not existing:
        raise FileNotFoundError(f"no annotation file among {list(paths)}")
    return (spark.read.schema(schema).option("header", True).csv(existing)
            .withColumn("file", scanned_file()))


def unique_annotations(rows: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One row per key (the first by file) and the number of surplus rows."""
    surplus = rows.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("_n")).agg(F.sum("_n").alias("duplicate_rows"))
    return first_per_key(rows, key, ["file"]), surplus


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records as rows: file, seed and the nested ``history`` and ``last``."""
    records = spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(path)
    return (records.select(scanned_file().alias("file"), "args", F.inline("runs")))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Long rows (file, seed, split, metric, value) of the final evaluations; old key names are read too."""
    flat = runs.select("file", "seed", F.explode("last").alias("split", "m"))
    values = {
        "acc": F.col("m.acc"), "balanced_accuracy": F.coalesce("m.balanced_accuracy", "m.bal_acc"),
        "f1_macro": F.col("m.f1_macro"), "mean_auc_ovr": F.col("m.mean_auc_ovr"),
        "combined_ovr": F.col("m.combined_ovr"), "null_acc": F.col("m.null_acc"),
        "n_test": F.col("m.n_test").cast("double"),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])
    return flat.select("file", "seed", "split", F.inline(entries)).where(F.col("value").isNotNull())


def run_classes(runs: DataFrame) -> DataFrame:
    """Per-class rows: file, seed, split, class, recall, n."""
    flat = runs.select("file", "seed", F.explode("last").alias("split", "m"))
    return flat.select("file", "seed", "split", F.explode("m.per_class").alias("class", "v")).select(
        "file", "seed", "split", "class", "v.recall", "v.n")


def run_sources(runs: DataFrame) -> DataFrame:
    """Per-source rows: file, seed, split, source, n, bal_acc, acc."""
    flat = runs.select("file", "seed", F.explode("last").alias("split", "m"))
    return flat.select("file", "seed", "split", F.explode("m.per_source").alias("source", "v")).select(
        "file", "seed", "split", "source", "v.n", "v.bal_acc", "v.acc")


def run_history(runs: DataFrame) -> DataFrame:
    """Epoch rows: file, seed, epoch, loss, bal_acc."""
    return runs.select("file", "seed", F.inline("history"))


def read_predictions(spark: SparkSession, path: str, classes: Sequence[str], ending: str = ".csv") -> DataFrame:
    """One sheet per team: ``team`` (file name), ``item_id`` and ``scores`` in class order."""
    schema = T.StructType([T.StructField("image_path", T.StringType())]
                          + [T.StructField(c, T.DoubleType()) for c in classes])
    sheets = spark.read.schema(schema).option("header", True).csv(path)
    name = scanned_file()
    return sheets.select(
        name.substr(F.lit(1), F.length(name) - len(ending)).alias("team"),
        slash_path(F.col("image_path")).alias("item_id"), F.array(*[F.col(f"`{c}`") for c in classes]).alias("scores"))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Corruption cells out of log lines; other lines are dropped."""
    line = spark.read.text(path).where(F.col("value").rlike(CELL_LINE))
    part = lambda i: F.regexp_extract("value", CELL_LINE, i)
    return line.select(
        part(1).alias("corruption"), part(2).cast("int").alias("severity"), part(3).cast("int").alias("fold"),
        part(4).alias("method"), part(5).cast("double").alias("balanced"), part(6).cast("double").alias("entropy"),
        part(7).cast("double").alias("pass_rate"))


def read_split_list(spark: SparkSession, paths: dict[str, str], labels: Sequence[str]) -> DataFrame:
    """Fold lists (fold → CSV path) with the index of each known label; other labels are dropped."""
    parts = None
    for fold, path in paths.items():
        part = (spark.read.schema("filename string, label string").option("header", True).csv(path)
                .withColumn("fold", F.lit(fold)))
        parts = part if parts is None else parts.unionByName(part)
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    return parts.withColumn("class_index", (at - 1).cast("int")).where(F.col("class_index") >= 0)


def read_id_metadata(spark: SparkSession, path: str, key: str = "image", group: str = "lesion_id",
                     default: str = "OTHER") -> DataFrame:
    """Image metadata with the source read off its group id."""
    from leaksift.functions.keys import source_from_id

    rows = spark.read.schema(f"{key} string, {group} string").option("header", True).csv(path)
    return rows.withColumn("source", source_from_id(F.col(group), default))
