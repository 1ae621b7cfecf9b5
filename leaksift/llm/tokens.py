"""Token counts through a cache of digests.

Texts are counted once per content and tokenizer. A document's content is
normalised only as far as no count can change (null becomes empty, text is
taken as UTF-8) and named by its SHA-256; a tokenizer is named by the SHA-256
of its file, its library's version and how it is called. Counts are stored
under the tokenizer's name, one row per content. A run joins the digests of its
documents to the stored counts, encodes each distinct content that is missing
once, appends the new counts, and joins all counts back.

Texts leave their task only if they are missing, and then once per task and
content at most: copies are combined before the shuffle. What is written is
content-addressed: a row is right whoever wrote it, so a retried or concurrent
run does no harm (each run appends a folder of its own; rows stored twice count
once), and a run that dies leaves nothing false.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksift.operators.skew import BROADCAST_ROWS, salted_lookup
from leaksift.session import materialise

LIMIT = 1024
BYTES_AT_ONCE = 1 << 20
STORED = "digest binary, n_tokens bigint"
_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


def tokenizer_version(path: str, blob: bytes) -> str:
    """Name of a tokenizer: its file, its library's version, and the options it is called with."""
    if path.endswith(".json"):
        import tokenizers as library
    elif path.endswith(".model"):
        import sentencepiece as library
    else:
        raise ValueError("a tokenizer is a .json or a .model file")
    call = f"{library.__name__} {library.__version__}: no added tokens, special strings by default, whole texts"
    return hashlib.sha256(call.encode() + b"\0" + blob).hexdigest()


def counter(version: str, path: str, blob: bytes) -> Callable[[list[str]], list[int]]:
    """Counts of tokens of texts, without added tokens; a tokenizer is loaded once per process."""
    if version not in _LOADED:
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_str(blob.decode())
            loaded.no_truncation()
            loaded.no_padding()
            _LOADED[version] = lambda texts: [len(e) for e in loaded.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_proto=blob)
            _LOADED[version] = lambda texts: [len(e) for e in pieces.encode(texts, num_threads=1)]
    return _LOADED[version]


def _encoded(texts: DataFrame, version: str, path: str, blob: bytes) -> DataFrame:
    """``digest`` and ``n_tokens`` of rows of ``digest`` and ``content``; about a megabyte of text is encoded at a time."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(version, path, blob)
        for batch in batches:
            contents, counts, waiting, held = batch.column(1).to_pylist(), [], [], 0
            for content in contents:
                waiting.append(content)
                held += len(content)
                if held >= BYTES_AT_ONCE:
                    counts += tokens(waiting)
                    waiting, held = [], 0
            counts += tokens(waiting) if waiting else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "content").mapInArrow(count, STORED)


def stored_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts in a folder, one row per digest; none if there is no such folder."""
    try:
        rows = spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(folder)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in (missing.getCondition() or ""):
            raise
        rows = spark.createDataFrame([], STORED)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", key: str = "doc_id",
                 limit: int = LIMIT) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every document.

    ``tokenizer`` is the path of a ``.json`` (tokenizers) or ``.model``
    (sentencepiece) file, read by the driver and sent along. ``cache`` is a
    folder that driver and executors share. No special tokens are added;
    special strings in a text are handled as the library does by default;
    nothing is cut or padded. A null text counts as empty, with 0 bytes. Rows
    come back one for one, repeated and null keys included; an empty table
    gives an empty one; other columns are ignored.
    """
    with open(tokenizer, "rb") as file:
        blob = file.read()
    version = tokenizer_version(tokenizer, blob)
    folder = f"{cache.rstrip('/')}/{version}"
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    marked = docs.select(F.col(key).alias("key"), digest, F.octet_length(content).cast("bigint").alias("n_bytes"))
    wanted = materialise(marked.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")))
    stored = stored_counts(docs.sparkSession, folder).join(wanted.select("digest"), "digest", "left_semi")
    stored = materialise(stored)
    missing = materialise(wanted.select("digest").join(stored, "digest", "left_anti"))
    left = missing.count()
    known = stored
    if left:
        texts, once = docs.select(digest, content.alias("content")), F.first("content").alias("content")
        if left <= BROADCAST_ROWS // 4:  # 32 bytes each: what is stored already stays where it is
            texts = texts.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(once)
        else:
            texts = texts.groupBy("digest").agg(once).join(missing, "digest", "left_semi")
        new = materialise(_encoded(texts, version, tokenizer, blob))
        new.write.parquet(f"{folder}/{uuid.uuid4().hex}")
        known = stored.unionByName(new)
    counted = salted_lookup(marked, known, ["digest"], ["key"], "inner")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in local tests the checkpoint folder in use."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        materialise(spark.range(1))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")
