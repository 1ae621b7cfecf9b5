"""Tables, derived inputs and SQL fragments shared by the queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksift.functions.digest import draw_index, split_by_digest
from leaksift.functions.keys import argmax_index
from leaksift.operators.fingerprints import text_fingerprints
from leaksift.session import materialise
from leaksift.sources.scans import spread_input

WORDS = ["fp2", "fp3"]
RADIUS = 6
TEXT_BYTES = 16 << 20  # of texts, as stored, that a task fingerprints
TEAMS = 6
CLASSES = 10


class Registry:
    """Collects a module's queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(fn):
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn
        return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r9(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, 9)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to nine digits, so sums in another order compare equal."""
    return df.select(*[r9(c).alias(c) if c in columns else F.col(c) for c in df.columns])


_KEPT: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def content_mark(spark: SparkSession, path: str) -> str:
    """A mark of a table's files: names, sizes and times of change, from the file listing alone."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    mark = hashlib.sha256()
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    mark.update("\n".join(sorted(found)).encode())
    return mark.hexdigest()


def kept(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame], of: str | None = None) -> DataFrame:
    """A table derived from table ``of`` (``name`` if not given), written once per application and read by every later query.

    Fingerprints are far smaller than what they are made from, and an audit asks
    many questions of them. A table whose files have changed is derived anew.
    """
    key, mark = (spark.sparkContext.applicationId, sf, name), content_mark(spark, f"{sf}/{of or name}.parquet")
    if key not in _KEPT or _KEPT[key][0] != mark:
        _KEPT[key] = mark, materialise(build())
    return _KEPT[key][1]


# --- documents with fingerprints and a split ---------------------------------

def document_prints(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, lang, split and two fingerprints, computed once from whole texts and kept.

    Both sides of every pair query read it.
    """
    def build() -> DataFrame:
        docs = spread_input(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id", most_bytes=TEXT_BYTES)
        prints = text_fingerprints(docs, ["doc_id", "source", "lang"], digest="md5")
        return prints.withColumn("split", split_by_digest(F.col("doc_id"), "split", 7))

    return kept(spark, sf, "documents", build)


def document_digests(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, lang, source, digest and size of every text; one scan of the texts serves all queries of it."""
    return kept(spark, sf, "digests", lambda: table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.md5("text").alias("digest"), F.octet_length("text").alias("size")), of="documents")


def document_count(spark: SparkSession, sf: str) -> int:
    """Row count from the parquet footers: an upper bound on distinct fingerprints."""
    return table(spark, sf, "documents").count()


def train_and_held(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    return prints.where(F.col("split") == "training"), prints.where(F.col("split") == "validation")


def _bits_sql(size: int, name: str, source: str, key: str) -> str:
    shingle = " || ' ' || ".join(f"w[i+{j}]" for j in range(1, size + 1))
    sums = ", ".join([f"sum((lo>>{i})&1) b{i}" for i in range(32)] + [f"sum((hi>>{i})&1) b{i + 32}" for i in range(32)])
    word = " + ".join(f"(case when 2*b{i}>n then {-(1 << 63) if i == 63 else 1 << i} else 0 end)::HUGEINT" for i in range(64))
    return f"""
{name}_pos AS (SELECT {key}, w, unnest(range(greatest(len(w)-{size - 1},1))) i FROM {source}),
{name}_md AS (SELECT {key}, md5(CASE WHEN len(w)>={size} THEN {shingle} ELSE array_to_string(w,' ') END) m FROM {name}_pos),
{name}_h AS (SELECT {key}, ('0x'||m[1:8])::BIGINT hi, ('0x'||m[9:16])::BIGINT lo FROM {name}_md),
{name}_c AS (SELECT {key}, count(*) n, {sums} FROM {name}_h GROUP BY {key}),
{name}_v AS (SELECT {key}, ({word})::BIGINT AS {name} FROM {name}_c)"""


def words_sql(column: str) -> str:
    return f"trim(regexp_replace(lower({column}),'[^\\p{{L}}\\p{{N}}]+',' ','g'))"


def prints_cte(source: str, key: str, prefix: str = "") -> str:
    """CTEs ending in ``<prefix>fps``: key, fp2, fp3 of every row of ``source`` with words."""
    return f"""
{prefix}tok AS (SELECT {key}, string_split({words_sql('text')},' ') w FROM {source} WHERE {words_sql('text')} <> ''),
{_bits_sql(2, prefix + 'fp2', prefix + 'tok', key)},
{_bits_sql(3, prefix + 'fp3', prefix + 'tok', key)},
{prefix}fps AS (SELECT a.{key}, a.{prefix}fp2 AS fp2, b.{prefix}fp3 AS fp3 FROM {prefix}fp2_v a JOIN {prefix}fp3_v b USING ({key}))"""


def index_sql(size: str | int, *parts: str) -> str:
    text = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x'||substr(md5({text}),1,15))::BIGINT % ({size})::BIGINT)"


def split_sql(key: str) -> str:
    draw = index_sql(10, "'split'", key)
    return f"CASE WHEN {draw} < 7 THEN 'training' ELSE 'validation' END"


DOCS = f"""WITH {prints_cte('documents', 'doc_id')},
docs AS (SELECT d.doc_id, d.source, d.lang, f.fp2, f.fp3, {split_sql('d.doc_id')} AS split
         FROM documents d LEFT JOIN fps f USING (doc_id)),
tr AS (SELECT * FROM docs WHERE split='training'), va AS (SELECT * FROM docs WHERE split='validation')"""


def ham(a: str, b: str) -> str:
    return f"bit_count(xor({a},{b}))::INTEGER"


Z = 1.959963984540054


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    k, n = f"({k})::DOUBLE", f"({n})::DOUBLE"
    centre = f"(({k}/{n}) + {Z * Z}/(2*{n}))/(1+{Z * Z}/{n})"
    half = f"({Z}/(1+{Z * Z}/{n}))*sqrt(({k}/{n})*(1-{k}/{n})/{n} + {Z * Z}/(4*{n}*{n}))"
    return f"round(greatest({centre}-{half},0.0),9)", f"round(least({centre}+{half},1.0),9)"


# --- predictions of derived teams over the labelled embeddings -----------------

def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """team, vec_id, source, part, y, pred and ten scores in [0, 1), fixed by digests of the row key.

    Teams of higher number lean more towards the true label.
    """
    items = spread_input(table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("y")), "vec_id")
    rows = items.select(
        "vec_id", "y",
        F.concat(F.lit("s"), draw_index(4, F.lit("source"), F.col("vec_id")).cast("string")).alias("source"),
        draw_index(10, F.lit("part"), F.col("vec_id")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(TEAMS - 1))).alias("_t"))
    team = F.concat(F.lit("team"), F.col("_t").cast("string"))
    score = [((draw_index(1000, F.lit("score"), F.col("_t"), F.col("vec_id"), F.lit(c))
               + F.when(F.col("y") == c, F.col("_t") * 150).otherwise(0)) / 2000.0) for c in range(CLASSES)]
    scored = rows.select(team.alias("team"), "vec_id", "source", "part", "y", F.array(*score).alias("scores"))
    return scored.withColumn("pred", argmax_index(F.col("scores")))


_SCORE = index_sql(1000, "'score'", "t", "vec_id", "c")
PREDICTIONS = f"""WITH items AS (SELECT vec_id, label AS y, 's'||{index_sql(4, "'source'", "vec_id")}::VARCHAR AS source,
       {index_sql(10, "'part'", "vec_id")}::INTEGER AS part FROM embeddings),
long AS (SELECT 'team'||t::VARCHAR AS team, vec_id, y, source, part, c,
       ({_SCORE} + CASE WHEN y=c THEN t*150 ELSE 0 END)/2000.0::DOUBLE AS score
       FROM items, (SELECT unnest(range({TEAMS}))::INTEGER AS t), (SELECT unnest(range({CLASSES}))::INTEGER AS c)),
pred AS (SELECT team, vec_id, y, source, part, c AS pred FROM long
         QUALIFY row_number() OVER (PARTITION BY team, vec_id ORDER BY score DESC, c)=1)"""


def label_metrics_sql(name: str, keys: str, rows: str = "pred", weight: str = "1") -> str:
    """CTEs ending in ``name``: label metrics per key over rows with y, pred and a weight."""
    on = f"USING ({keys}, label)"
    return f"""
{name}_t AS (SELECT {keys}, y AS label, sum({weight})::DOUBLE sup, sum(CASE WHEN y=pred THEN {weight} ELSE 0 END)::DOUBLE hit FROM {rows} GROUP BY {keys}, y),
{name}_p AS (SELECT {keys}, pred AS label, sum({weight})::DOUBLE prd FROM {rows} GROUP BY {keys}, pred),
{name}_u AS (SELECT {keys}, label, coalesce(sup,0) sup, coalesce(hit,0) hit, coalesce(prd,0) prd FROM {name}_t FULL JOIN {name}_p {on}),
{name} AS (SELECT {keys}, sum(sup)::BIGINT n, sum(hit)/sum(sup) accuracy, avg(CASE WHEN sup>0 THEN hit/sup END) balanced_accuracy,
  avg(2*hit/(sup+prd)) macro_f1, sum(2*hit/(sup+prd)*sup)/sum(sup) weighted_f1, max(sup)/sum(sup) null_accuracy,
  count(*) FILTER (WHERE sup>0) n_present FROM {name}_u GROUP BY {keys})"""


def auc_sql(name: str, keys: str, rows: str = "long", weight: str = "1") -> str:
    """CTEs ending in ``name``: one-vs-rest AUC per key and class, by its pair definition."""
    return f"""
{name}_d AS (SELECT {keys}, c AS label, score, sum(CASE WHEN y=c THEN {weight} ELSE 0 END)::DOUBLE p, sum(CASE WHEN y=c THEN 0 ELSE {weight} END)::DOUBLE q
  FROM {rows} GROUP BY {keys}, c, score),
{name}_r AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY {keys}, label ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) below FROM {name}_d),
{name} AS (SELECT {keys}, label, sum(p)::BIGINT n_pos, sum(q)::BIGINT n_neg,
  CASE WHEN sum(p)>0 AND sum(q)>0 THEN sum(p*(below+q/2))/(sum(p)*sum(q)) END auc FROM {name}_r GROUP BY {keys}, label)"""
