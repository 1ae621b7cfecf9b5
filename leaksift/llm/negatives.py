"""Hard negatives by an inverted multi-index.

Vectors are cut in two halves, each half has a codebook of its own, and the two
nearest code words of a vector name its cell. No vector of a cell scores higher
with an anchor than the sum of two half-scores: anchor half times code word,
plus the anchor half's length times the largest distance of any vector to that
code word. A multi-sequence heap visits an anchor's cells in falling order of
these sums, so the sum of the next cell bounds everything not yet seen. An
anchor is searched twice: for its positives until the last of them lies above
the bound; then for negatives in a window of scores per positive, until every
window holds its rows above the bound, or lies above it. Cells whose least
score lies above all open windows are passed over. What stops a search is always
a bound, so results are exact.

Code words are fitted on a bounded sample; every vector is indexed, and
radii and cell counts come from all vectors. An anchor goes only to cells it
visits, more of them in each round; large cells are cut in parts and anchors of
one cell in batches, each pair of which is one task's matrix product.

Equal vectors of one label are one point. A point keeps its least keys, as many
as any anchor can use; all anchors of a point are searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaksift.llm.common import fresh
from leaksift.operators.skew import salted_lookup, sized
from leaksift.session import materialise

FITTED_ON = 20_000
CELL_ROWS = 1024
MOST_WORDS = 1024
PART_ROWS = 8192
ANCHORS_PER_TASK = 4096
FIRST_ROWS = 8192
GROWTH = 8
FARTHEST = 1.7976931348623157e308
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
OPEN = "qid string, v array<double>, label bigint, windows array<struct<p: bigint, lo: bigint, hi: bigint>>"


@dataclass
class MultiIndex:
    """Code words and radii of both halves, and the number of points in every cell."""

    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray

    def bounds(self, v: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per half, the highest and the lowest half-score of an anchor with vectors of every code word."""
        high, low = [], []
        for half, words, radii in zip(_halves(v[None, :]), self.words, self.radii):
            with np.errstate(all="ignore"):
                middle, reach = words @ half[0], np.linalg.norm(half) * radii
                slack = 1e-9 * (np.abs(words) @ np.abs(half[0]) + reach) + 1e-6  # for rounding
                # What leaves the range of a double bounds nothing.
                high.append(np.nan_to_num(middle + reach + slack, nan=np.inf, posinf=np.inf, neginf=np.inf))
                low.append(np.nan_to_num(middle - reach - slack, nan=-np.inf, posinf=-np.inf, neginf=-np.inf))
        return high, low


def _halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (vectors.shape[1] + 1) // 2
    return vectors[:, :cut], vectors[:, cut:]


def _padded(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of one length, filled with zeros."""
    out = np.zeros((len(vectors), width))
    if all(len(v) == width for v in vectors):
        return np.stack(vectors.to_numpy()) if len(vectors) else out
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _nearest_word(half: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = (words * words).sum(1)[None, :] - 2 * half @ words.T
    at = gap.argmin(1)
    return at, np.linalg.norm(half - words[at], axis=1)


def code_words(half: np.ndarray, count: int, steps: int = 12, seed: int = 11) -> np.ndarray:
    """Code words by Lloyd's steps from distinct vectors of the sample."""
    start = np.unique(half, axis=0)
    words = start[np.random.default_rng(seed).permutation(len(start))[:count]].copy()
    for _ in range(steps):
        at, _ = _nearest_word(half, words)
        sums = np.zeros_like(words)
        np.add.at(sums, at, half)
        n = np.bincount(at, minlength=len(words))
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; beyond the range of a long its limit stands."""
    width = max(1, a.shape[1])
    reach = width * (np.abs(a).max() if a.size else 0) * (np.abs(b).max() if b.size else 0)
    if reach < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.clip(exact, LOWEST, HIGHEST).astype(np.int64)


def cells_in_order(high: list[np.ndarray]) -> Iterator[tuple[float, int, int]]:
    """All cells by falling sum of their half-bounds, from a heap over two sorted sequences."""
    first, second = (np.argsort(-h, kind="stable") for h in high)
    left, right = high[0][first], high[1][second]
    heap, queued = [(-(left[0] + right[0]), 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(first[i]), int(second[j])
        queued.discard((i, j))
        for a, b in ((i + 1, j), (i, j + 1)):
            # A cell is queued once its smaller neighbours in both sequences have left the heap.
            if a < len(left) and b < len(right) and (a, b) not in queued:
                queued.add((a, b))
                heapq.heappush(heap, (-(left[a] + right[b]), a, b))


def points_of(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector and label (``qid``), with its ``keep`` least keys."""
    slim = rows.groupBy("qid", "id").agg(F.count(F.lit(1)).alias("copies"))
    least = F.row_number().over(Window.partitionBy("qid").orderBy("id"))
    ids = slim.withColumn("_n", least).where(F.col("_n") <= keep).groupBy("qid").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = rows.groupBy("qid").agg(F.first("v").alias("v"), F.first("label").alias("label"))
    return vectors.join(ids, "qid")


def build_index(points: DataFrame, width: int) -> tuple[MultiIndex, DataFrame]:
    """The index, and all points with their ``cell``."""
    total = points.count()
    count = int(min(MOST_WORDS, max(1, np.ceil(np.sqrt(total / CELL_ROWS)))))
    sample = points.select("v", F.xxhash64("qid").alias("_h"), "qid").orderBy("_h", "qid").limit(FITTED_ON).toPandas()
    halves = _halves(_padded(sample["v"], width))
    words = tuple(code_words(h, count) for h in halves)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            (c1, r1), (c2, r2) = (_nearest_word(h, w) for h, w in zip(_halves(_padded(batch["v"], width)), words))
            yield batch.assign(c1=c1.astype(np.int32), c2=c2.astype(np.int32), r1=r1, r2=r2)

    schema = "qid string, v array<double>, label bigint, ids array<bigint>, c1 int, c2 int, r1 double, r2 double"
    placed = materialise(points.select("qid", "v", "label", "ids").mapInPandas(assigned, schema))
    radii = []
    for c, r, w in (("c1", "r1", words[0]), ("c2", "r2", words[1])):
        far = np.zeros(len(w))
        for row in placed.groupBy(c).agg(F.max(r).alias("far")).collect():  # at most MOST_WORDS rows
            far[row[c]] = row["far"]
        radii.append(far)
    counts = np.zeros((len(words[0]), len(words[1])), np.int64)
    found = placed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most MOST_WORDS squared rows
    counts[found["c1"], found["c2"]] = found["n"]
    cell = (F.col("c1") * len(words[1]) + F.col("c2")).alias("cell")
    return MultiIndex(words, (radii[0], radii[1]), counts), placed.select("qid", "v", "label", "ids", cell)


def _next_cells(index: MultiIndex, width: int, budget: int):
    """The function that visits further cells of every open anchor, about ``budget`` points of them."""
    second = len(index.words[1])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done, frontier, cells = [], [], []
            for v, before, floor, ceiling in zip(_padded(batch["v"], width), batch["done"], batch["floor"], batch["ceiling"]):
                high, low = index.bounds(v)
                popped, rows, mine, ahead = 0, 0, [], -np.inf
                for bound, i, j in cells_in_order(high):
                    if bound < floor:
                        break
                    if popped >= before and rows >= budget:
                        ahead = bound
                        break
                    popped += 1
                    if popped > before and index.counts[i, j] and low[0][i] + low[1][j] <= ceiling:
                        rows += index.counts[i, j]
                        mine.append(i * second + j)
                done.append(popped)
                frontier.append(ahead)
                cells.append(mine)
            yield batch.drop(columns=["done", "floor", "ceiling"]).assign(done=done, frontier=frontier, cells=cells)

    return step


def _best_of_cell(width: int, keep: int, same: bool):
    """The function that scores a batch of anchors against a part of a cell."""
    def score(anchors: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, int, int, int, bool]] = []
        if len(anchors) and len(points):
            points = points.iloc[np.argsort([ids[0] for ids in points["ids"]], kind="stable")]
            ids, labels, names = points["ids"].to_numpy(), points["label"].to_numpy(), points["qid"].to_numpy()
            scores = products(_padded(anchors["v"], width), _padded(points["v"], width))
            for row, qid, label, windows in zip(scores, anchors["qid"], anchors["label"], anchors["windows"]):
                fits = (labels == label) if same else (labels != label)
                lo, hi = min(w["lo"] for w in windows), max(w["hi"] for w in windows)
                at = np.flatnonzero(fits & (row >= lo) & (row <= hi))
                at = at[np.argsort(~row[at], kind="stable")]
                falling = ~row[at]  # rises as scores fall, and never overflows
                for w in windows:
                    near = at[np.searchsorted(falling, ~w["hi"]):np.searchsorted(falling, ~w["lo"], side="right")][:keep]
                    best = sorted((-int(row[p]), int(i), bool(names[p] == qid)) for p in near for i in ids[p])[:keep]
                    out += [(qid, int(w["p"]), -s, i, own) for s, i, own in best]
        return pd.DataFrame(out, columns=["qid", "p", "score", "id", "own"]).astype({"p": "int64", "score": "int64", "id": "int64", "own": "bool"})

    return score


def _search(asked: DataFrame, index: MultiIndex, placed: DataFrame, width: int, keep: int, same: bool) -> DataFrame:
    """``qid``, ``p``, ``score``, ``id``, ``own``, ``rank``: the first ``keep`` rows in every window of every anchor.

    ``own`` marks rows of the anchor's point.
    """
    spark: SparkSession = asked.sparkSession
    sizes = index.counts.ravel()
    large = np.flatnonzero(sizes > PART_ROWS)
    parts = spark.createDataFrame([(int(c), int(-(-sizes[c] // PART_ROWS))) for c in large], "cell int, parts int")
    parts = F.broadcast(parts)  # at most one row per PART_ROWS points and per cell
    cut = placed.join(parts, "cell", "left").withColumn("part", F.pmod(F.xxhash64("qid"), F.coalesce("parts", F.lit(1))).cast("int"))
    cut = cut.select("cell", "part", "qid", "v", "label", "ids")
    rank = F.row_number().over(Window.partitionBy("qid", "p").orderBy(F.desc("score"), "id"))
    floor = F.array_min(F.transform("windows", lambda w: w.lo)).cast("double")
    ceiling = F.array_max(F.transform("windows", lambda w: w.hi)).cast("double")
    still = asked.where(F.size("windows") > 0).withColumns({"done": F.lit(0).cast("bigint"), "floor": floor, "ceiling": ceiling})
    found, budget = None, FIRST_ROWS
    while True:
        plan = materialise(still.mapInPandas(_next_cells(index, width, budget), f"{OPEN}, done bigint, frontier double, cells array<int>"))
        visits = plan.select("qid", "v", "label", "windows", F.explode("cells").alias("cell"))
        busy, batches = sized(visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ANCHORS_PER_TASK)
                              .select("cell", F.ceil(F.col("n") / ANCHORS_PER_TASK).cast("int").alias("batches")))
        left = visits.join(parts, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        right = cut.join(visits.select("cell").distinct(), "cell", "left_semi")
        if busy:
            left = left.join(batches, "cell", "left").withColumn("batch", F.pmod(F.xxhash64("qid"), F.coalesce("batches", F.lit(1))).cast("int"))
            right = right.join(batches, "cell", "left").withColumn("batch", F.explode(F.sequence(F.lit(0), F.coalesce("batches", F.lit(1)) - 1)))
        else:
            left, right = left.withColumn("batch", F.lit(0)), right.withColumn("batch", F.lit(0))
        left = left.select("qid", "v", "label", "windows", "cell", "part", "batch")
        right = right.select("qid", "v", "label", "ids", "cell", "part", "batch")
        on = ["cell", "part", "batch"]
        hits = (left.groupBy(*on).cogroup(right.groupBy(*on))
                .applyInPandas(_best_of_cell(width, keep, same), "qid string, p bigint, score bigint, id bigint, own boolean"))
        hits = hits if found is None else found.drop("rank").unionByName(hits)
        found = materialise(hits.withColumn("rank", rank).where(F.col("rank") <= keep))
        last = found.where(F.col("rank") == keep).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("p", "score"))).alias("_last"))
        need = lambda w: F.greatest(w.lo, F.coalesce(F.try_element_at("_last", w.p), F.lit(LOWEST)))
        # A window still open asks from now on for what can enter its first rows.
        windows = F.transform(F.filter("windows", lambda w: F.col("frontier") >= need(w).cast("double")),
                              lambda w: F.struct(w.p.alias("p"), need(w).alias("lo"), w.hi.alias("hi")))
        still = (plan.drop("cells").join(last, "qid", "left").withColumn("windows", windows).where(F.size("windows") > 0)
                 .withColumns({"floor": floor, "ceiling": ceiling})
                 .select("qid", "v", "label", "windows", "done", "floor", "ceiling"))
        still = materialise(still)
        if not still.head(1):
            return found
        budget *= GROWTH


def hard_negatives(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50,
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Components become ``floor(scale * x)``; a score is the integer inner
    product, higher first, ties by smaller key. Anchors are rows whose key is
    divisible by ``every``; their positives are the first ``positives`` other
    rows of their label; negatives of a positive are the first ``negatives``
    rows of other labels with scores from ``low`` to ``high`` hundredths of the
    positive's. A positive with no such row has no row in the result.

    Rows with a null key, label or vector, or a null or non-finite component,
    take no part. A row that occurs again counts once. Rows that share a key
    and differ in label or vector are different rows: each is searched, and may be found for the
    other. A shorter vector counts as filled with zeros. A score beyond the
    range of a long stands at its limit. An empty table gives an empty one; other
    columns are ignored.
    """
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = lambda x: F.greatest(F.least(x * scale, F.lit(FARTHEST)), F.lit(-FARTHEST))
    # The floor as a double (a long would not hold it), with one zero.
    whole = F.transform("v", lambda x: F.rint(scaled(x)) - F.when(F.rint(scaled(x)) > scaled(x), 1.0).otherwise(0.0) + 0.0)
    rows = (table.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
            .select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                    F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
            .where(good).withColumn("v", whole))
    name = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: x.cast("string"))), 256)
    rows = rows.select("id", "label", "v", name.alias("qid"))
    points = materialise(points_of(rows, positives + 1))
    width = points.agg(F.max(F.size("v"))).first()[0]
    kinds = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if width is None:
        return table.sparkSession.createDataFrame([], kinds)
    width = max(2, width)
    index, placed = build_index(points, width)
    anchors = materialise(rows.where(F.col("id") % every == 0).select("id", "qid").distinct())
    asked = points.join(anchors.select("qid").distinct(), "qid", "left_semi")
    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi")))
    near = _search(asked.select("qid", "v", "label", everything.alias("windows")), index, placed, width, positives + 1, True)
    near = near.select("qid", "score", "id", "own", "rank")
    p = F.col("score")
    window = F.struct(p.alias("p"), F.expr(f"cast(ceil(cast(score as decimal(38,0)) * {low} / 100) as bigint)").alias("lo"),
                      F.expr(f"cast(floor(cast(score as decimal(38,0)) * {high} / 100) as bigint)").alias("hi"))
    windows = near.select("qid", window.alias("w")).where(F.col("w.lo") <= F.col("w.hi")).groupBy("qid").agg(F.collect_set("w").alias("windows"))
    far = _search(points.select("qid", "v", "label").join(windows, "qid"), index, placed, width, negatives, False)
    ranked = far.groupBy("qid", "p").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("negatives"))
    lists = (near.join(ranked.withColumnRenamed("p", "score"), ["qid", "score"], "left").groupBy("qid")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "id", "own", "score", "negatives"))).alias("found")))
    # Many anchors may share a point; each leaves itself out of the point's list.
    own = salted_lookup(anchors, lists, ["qid"], ["id"], "inner").select(
        F.col("id").alias("anchor_id"), F.slice(F.filter("found", lambda f: (f.id != F.col("id")) | ~f.own), 1, positives).alias("found"))
    each = own.select("anchor_id", F.explode("found").alias("f")).select("anchor_id", "f.id", "f.score", F.explode("f.negatives").alias("n"))
    return each.select("anchor_id", F.col("id").alias("positive_id"), F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
                       F.col("score").alias("positive_score"), F.col("n.score").alias("negative_score"))


def with_shifted_labels(table: DataFrame, key: str = "vec_id", label: str = "label", every: int = 7, classes: int = 10) -> DataFrame:
    """The table with the label of every ``every``-th key moved on by one."""
    moved = fresh(table, "_moved")
    shifted = F.when(F.col(key) % every == 0, (F.col(label) + 1) % classes).otherwise(F.col(label))
    return table.withColumn(moved, shifted).drop(label).withColumnRenamed(moved, label)
