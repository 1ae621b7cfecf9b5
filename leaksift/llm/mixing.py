"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Every source is a line of words: its documents in a seeded permutation, once
per pass. The line is cut into blocks, and the mix takes the first words of it
up to the source's quota, so a source's words come out exactly. Which blocks go
to which output shard is drawn by a tree: at each node the blocks of all
sources are split between two children by a multivariate hypergeometric draw,
from the counts alone. A leaf takes its count of blocks from each source, as a
range of the permuted line that no other leaf has, and orders its rows by a
seeded hash.

Only built-in column functions are used. Per source there is one row and per
(source, digest bucket) another; documents are never gathered by source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksift.operators.skew import running_total
from leaksift.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SPREAD = 12
PIECES = "array<struct<shard:int,pass:int,begin:bigint,end:bigint>>"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, passes: int) -> DataFrame:
    """Words that each source gives: ``source``, ``source_size``, ``weight``, ``target``, ``quota``.

    ``sizes`` has one row per source. Sources in code-point order, null last,
    get ``weights`` in turn and share ``share`` of all words. A target stops at
    ``passes`` times its source's size; the excess goes to the others by weight.
    Ordered by size per weight the stopped sources come first, so one pass over
    the sources finds the level at which the rest settle.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (sizes.withColumn("_at", F.row_number().over(place) - 1)
              .withColumn("weight", F.element_at(cycle, (F.col("_at") % len(weights) + 1).cast("int")))
              .withColumn("_cap", (F.col("source_size") * passes).cast("double")))
    every = Window.partitionBy(F.lit(0))
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), "_at").rowsBetween(Window.unboundedPreceding, -1)
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))
    left = (F.sum("source_size").over(every) * F.lit(float(share))) - F.coalesce(F.sum("_cap").over(by_level), F.lit(0.0))
    levelled = ranked.withColumn("_level", left / open_weight)
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct("_at_level", "_level"))).over(every)
    numbered = levelled.withColumn("_at_level", F.row_number().over(Window.orderBy(F.col("_cap") / F.col("weight"), "_at")))
    target = F.least("_cap", F.coalesce(level["_level"] * F.col("weight"), F.col("_cap")))
    return (numbered.withColumn("target", target)
            .withColumn("quota", F.least(F.round("target").cast("bigint"), F.col("_cap").cast("bigint")))
            .select("source", "source_size", "weight", "target", "quota"))


def _left_count(total: Column, marked: Column, taken: Column, draw: Column) -> Column:
    """Hypergeometric draw: how many of ``marked`` among ``total`` blocks are in the ``taken`` ones.

    Inverse of the distribution function over all counts within ``SPREAD``
    standard deviations of the mode; weights follow from the ratio of
    neighbouring probabilities, so no factorials are needed.
    """
    n, k, m = total.cast("double"), marked.cast("double"), taken.cast("double")
    spread = F.ceil(F.sqrt(F.greatest(m * k / n * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0))) * SPREAD) + 3
    mode = F.floor((k + 1) * (m + 1) / (n + 2))
    low = F.greatest(F.lit(0.0), m + k - n, (mode - spread).cast("double")).cast("bigint")
    high = F.least(m, k, (mode + spread).cast("double")).cast("bigint")

    def step(log: Column, x: Column) -> Column:
        x = x.cast("double")
        return log + F.log((k - x) * (m - x)) - F.log((x + 1) * (n - k - m + x + 1))

    support = F.filter(F.sequence(low, high), lambda x: x < high)

    def grow(acc: Column, x: Column) -> Column:
        nxt = step(acc["log"], x)
        top = F.greatest(acc["top"], nxt)
        return F.struct(nxt.alias("log"), top.alias("top"),
                        (acc["sum"] * F.exp(acc["top"] - top) + F.exp(nxt - top)).alias("sum"))

    whole = F.aggregate(support, F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("top"), F.lit(1.0).alias("sum")), grow)
    # Totals ride in the accumulator: named inside the step they would be computed again at every count.
    start = F.struct(F.lit(0.0).alias("log"), whole.alias("whole"), F.lit(-1.0).alias("sum"), F.lit(0).alias("at"))

    def pick(acc: Column, x: Column) -> Column:
        first = acc["sum"] < 0
        so_far = F.when(first, F.exp(-acc["whole"]["top"])).otherwise(acc["sum"])
        nxt = step(acc["log"], x)
        return F.struct(nxt.alias("log"), acc["whole"].alias("whole"), (so_far + F.exp(nxt - acc["whole"]["top"])).alias("sum"),
                        (acc["at"] + F.when(so_far < acc["whole"]["sum"] * draw, 1).otherwise(0)).alias("at"))

    at = F.aggregate(support, start, pick)["at"]
    return F.when((total <= 0) | (marked <= 0) | (taken <= 0), F.lit(0).cast("bigint")) \
        .when(low >= high, low).otherwise(F.least(high, low + at))


def shard_quotas(targets: DataFrame, shards: int, block_words: int, seed: int) -> DataFrame:
    """Blocks of every source for every leaf of the tree: ``source``, ``edges``.

    ``edges`` holds, for shards 1..n in order, the word on the source's line at
    which the shard ends. ``shards`` is a power of two.
    """
    spark = targets.sparkSession
    depth = shards.bit_length() - 1
    if shards != 1 << depth:
        raise ValueError("shards must be a power of two")
    listed = targets.select("source", "quota", F.ceil(F.col("quota") / block_words).cast("bigint").alias("blocks"))
    node = listed.agg(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col("source"), F.lit("")).alias("name"),
                                                           F.col("source").isNull().alias("none"), "blocks"))).alias("counts"))
    node = node.select(F.lit(0).alias("node"), "counts")
    for level in range(depth):
        def split(acc: Column, item: Column) -> Column:
            draw = (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), item["name"], item["none"]), F.lit(1 << 30))
                    + 0.5) / float(1 << 30)
            left = _left_count(acc["total"], item["blocks"], acc["room"], draw)
            return F.struct((acc["total"] - item["blocks"]).alias("total"), (acc["room"] - left).alias("room"),
                            F.concat(acc["left"], F.array(left)).alias("left"))

        total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x["blocks"])
        start = F.struct(F.col("total"), F.floor(F.col("total") / 2).cast("bigint").alias("room"),
                         F.array().cast(T.ArrayType(T.LongType())).alias("left"))
        drawn = node.withColumn("total", total).withColumn("left", F.aggregate("counts", start, split)["left"])
        # Written once per level: the draw is used by both children.
        drawn = materialise(drawn)

        def part(right: bool) -> Column:
            def one(c: Column, x: Column) -> Column:
                return F.struct(c["name"].alias("name"), c["none"].alias("none"),
                                (c["blocks"] - x if right else x).alias("blocks"))
            return F.zip_with("counts", "left", one)

        sides = F.array(*[F.struct((F.col("node") * 2 + int(r)).alias("node"), part(r).alias("counts")) for r in (False, True)])
        node = drawn.select(F.inline(sides))
    leaf = node.select("node", F.inline("counts")).select(
        F.when(~F.col("none"), F.col("name")).alias("source"), "node", "blocks")
    before = Window.partitionBy("source").orderBy("node")
    ends = leaf.withColumn("_end", F.sum("blocks").over(before) * block_words)
    return ends.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "_end"))),
                                                  lambda x: x["_end"]).alias("edges"))


def row_digest(key: Column, text: Column, seed: int = 11) -> Column:
    """The place of a document in its source's permutation, fixed by its key and text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, passes: int = 2,
             shards: int = 8, block_words: int = 4096, seed: int = 11, key: str = "doc_id", text: str = "text",
             source: str = "source", keep: Sequence[str] = (),
             named: str | None = None) -> DataFrame:
    """One row per document with the pieces of it that the mix takes.

    Columns: ``key``, ``keep``, ``size``, ``source_size``, ``target``,
    ``pieces`` (shard, pass, first and last word, end exclusive) and ``taken``.
    A source's taken words equal its rounded target. A null source is a source
    of its own; a null or empty text has size 0 and gives nothing; rows that
    are equal in key and text are interchangeable; an empty table gives an
    empty one. Other columns of ``docs`` are ignored unless named in ``keep``.
    ``named`` is a name for the rows' digests, if they are wanted.
    """
    slim = materialise(docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(F.col(text)).alias("size"),
                                   row_digest(F.col(key), F.col(text), seed).alias("_digest"), *[F.col(c).alias(f"_keep_{c}") for c in keep]))
    sizes = slim.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, passes))
    lines = targets.join(shard_quotas(targets, shards, block_words, seed).withColumnRenamed("source", "_s"),
                         F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    tagged = slim.withColumn("_line", F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("none")))
    placed = running_total(tagged, "size", "_digest", F.substring("_digest", 1, 4), ["_line"], "_before")
    lines = lines.withColumn("_line", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none"))).drop("source")
    joined = placed.join(lines, "_line")

    def on_pass(number: int) -> Column:
        first = F.col("_before") + F.col("source_size") * number
        last = F.least(first + F.col("size"), F.col("quota"))

        def piece(edge: Column, i: Column) -> Column:
            lower = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(F.col("edges"), i - 1))
            return F.struct(i.cast("int").alias("shard"), F.lit(number).alias("pass"),
                            (F.greatest(first, lower) - first).alias("begin"),
                            (F.least(last, edge) - first).alias("end"))

        return F.filter(F.transform("edges", piece), lambda p: p["end"] > p["begin"])

    pieces = F.concat(*[on_pass(p) for p in range(passes)]).cast(PIECES)
    planned = joined.withColumn("pieces", pieces)
    taken = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda a, p: a + p["end"] - p["begin"])
    return planned.select(F.col("_key").alias(key), *[F.col(f"_keep_{c}").alias(c) for c in keep],
                          *([F.col("_digest").alias(named)] if named else []), "size", "source_size", "target", "pieces", taken.alias("taken"))


def mixed_rows(plan: DataFrame, seed: int = 11, key: str = "doc_id") -> DataFrame:
    """The mix itself: one row per piece, by shard and in each shard in a seeded order (``place``)."""
    rest = [c for c in plan.columns if c not in ("pieces", "size", "source_size", "target", "taken")]
    rows = plan.select(*rest, F.inline("pieces"))
    place = F.md5(F.concat_ws(":", F.lit(f"{seed}:place"), "shard", F.coalesce(F.col(key).cast("string"), F.lit("")), "pass", "begin"))
    return rows.withColumn("place", place).repartition("shard").sortWithinPartitions("shard", "place")
