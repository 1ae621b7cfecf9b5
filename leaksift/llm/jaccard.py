"""N-gram Jaccard join: a MinHash LSH forest and exact verification.

Every distinct set of word shingles gets a signature of ``TREES`` labels, each a
path of ``LONGEST`` minimum hashes; the sorted labels of one tree are a prefix
trie. Sets below one node at the longest prefix are compared first, by whole
signatures. From what a set met there its recall at every shorter prefix is
estimated: a partner of similarity s shares a prefix of length d with chance
s**d in a tree, so it stands for 1 / (TREES * s**LONGEST) partners and is found
in some tree with chance 1 - (1 - s**d)**TREES. A set stays at the longest
prefix whose estimate reaches the target; a set that met nobody, or falls short,
has its prefixes shortened, down to the length at which even partners of
exactly the threshold reach the target. Two sets of one trie are then compared
when the prefix they share is as long as one of them asks for.

What may reach the threshold is linked, and linked sets form families. The sets
of a family are then compared exactly, tile by tile. Neither step lists pairs: a
task returns a spanning forest of the links it found and sums per set. Nodes and
families over a tile's size are split into more tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksift.llm.common import connected, fresh, least_labels, mixed, run_hashes, sorted_runs, word_hashes, words_of
from leaksift.session import materialise

TREES = 20
LONGEST = 8
SHINGLE = 5
TILE = 1024
CHUNK = 2048
SLACK = 4.0  # standard deviations of the signature's estimate below the threshold


def prefix_length(threshold: float, recall: float, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix whose expected recall at the threshold reaches the target."""
    for size in range(longest, 0, -1):
        if 1 - (1 - threshold ** size) ** trees >= recall:
            return size
    return 1


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words, sorted."""
    return np.unique(run_hashes(word_hashes(words_of(text)), size))


_ODD = mixed(np.arange(1, TREES * LONGEST + 1, dtype=np.uint64)) | np.uint64(1)


def signature(items: np.ndarray) -> np.ndarray:
    """Minimum hashes of a set, one per trie level."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(items), CHUNK):
        least = np.minimum(least, (items[lo:lo + CHUNK, None] * _ODD[None, :]).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key``, text digest, set digest (two numbers), set size and signature (two bytes per trie level, tree by tree)."""
    shape = "set_a bigint, set_b bigint, n bigint, sig binary"

    @F.pandas_udf(shape)
    def sign(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            items = shingle_set(t, size)
            if len(items) == 0:
                rows.append((0, 0, 0, None))
                continue
            rows.append((np.add.reduce(items).view(np.int64), np.bitwise_xor.reduce(mixed(items)).view(np.int64), len(items),
                         signature(items).astype(np.uint16).tobytes()))
        return pd.DataFrame(rows, columns=["set_a", "set_b", "n", "sig"])

    sign = sign.asNondeterministic()  # its fields are used apart; it must run once
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text"), sign(F.col(text)).alias("_s")
                       ).select("key", "text", "_s.*")


def branch(depth: int) -> Column:
    """The first ``depth`` levels of the label of ``tree``."""
    return F.substring(F.col("sig"), F.col("tree") * (2 * LONGEST) + 1, F.lit(2 * depth))


def below_nodes(sets: DataFrame, depth: int, tile: int) -> DataFrame:
    """Sets that share a trie node at ``depth`` with another, sorted below each node; tiled where a node has many."""
    rows = sets.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trie = rows.select("id", "tree", F.xxhash64("tree", branch(depth)).alias("node"))
    by = ["node", "t", "u"]
    return (tiled(trie, ["node"], ["id"], tile).join(sets, "id").withColumn("label", branch(LONGEST))
            .repartition(*by).sortWithinPartitions(*by, "label"))


def tiled(rows: DataFrame, by: list[str], spread: list[str], tile: int) -> DataFrame:
    """Rows of groups with two members and more, with ``t`` and ``u``: the two tiles that meet, and ``side``.

    A group of at most ``tile`` rows is one tile that meets itself; a larger
    one is cut by a hash and its tiles meet in pairs, each in a task of its own.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    cut = rows.join(sizes.withColumn("_tiles", F.ceil(F.col("_n") / tile).cast("int")), by)
    own = F.pmod(F.xxhash64(*spread), F.col("_tiles")).cast("int")
    pairs = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    return (cut.withColumn("_own", own).withColumn("_other", pairs)
            .withColumn("t", F.least("_own", "_other")).withColumn("u", F.greatest("_own", "_other"))
            .withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
            .drop("_n", "_tiles", "_own", "_other"))


def near_in_tries(batches: Iterator[pd.DataFrame], least: float, first: bool, floor: int) -> Iterator[pd.DataFrame]:
    """Spanning links of sets whose signatures agree often enough, and per set the sums its recall is estimated from.

    ``first`` compares sets that share the whole label; else those sharing less
    of it, but as much as one of the two asks for (``depth``). ``b`` is the set
    that ``a`` hangs on; ``weight`` estimates the partners of ``a``, ``got``
    how many of them are met at each prefix length from ``floor`` on.
    """
    lengths = np.arange(floor, LONGEST + 1)
    for rows, starts in sorted_runs(batches, ["node", "t", "u"]):
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), -1)
        label = np.frombuffer(b"".join(rows["label"]), np.uint16).reshape(len(rows), LONGEST)
        n = len(rows)
        shared = np.zeros(n, np.int64)  # levels shared with the row before
        shared[1:] = np.cumprod(label[1:] == label[:-1], axis=1).sum(1)
        ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        side, cross, depth = rows["side"].to_numpy(), (rows["t"] != rows["u"]).to_numpy(), rows["depth"].to_numpy()
        need = int(np.ceil(least * sig.shape[1]))
        left, right = [], []
        sums = np.zeros((n, 1 + len(lengths)))
        at, common, step = np.arange(n), np.full(n, LONGEST), 1
        while True:
            going = at + step < ends[at]
            at = at[going]
            if not len(at):
                break
            common = np.minimum(common[going], shared[at + step])
            asked = common == LONGEST if first else (common < LONGEST) & (common >= np.minimum(depth[at], depth[at + step]))
            pick = at[asked & (~cross[at] | (side[at] != side[at + step]))]
            for lo in range(0, len(pick), 1 << 15):
                p = pick[lo:lo + (1 << 15)]
                agree = (sig[p] == sig[p + step]).sum(1)
                near = agree >= need
                hit, agree = p[near], agree[near]
                left.append(hit)
                right.append(hit + step)
                if first and len(hit):
                    # The tree they met in says nothing about how alike they are.
                    alike = np.clip((agree - LONGEST) / (sig.shape[1] - LONGEST), 1e-3, 1.0)[:, None]
                    weight = 1 / (TREES * alike ** LONGEST)
                    part = np.hstack([weight, weight * (1 - (1 - alike ** lengths) ** TREES)])
                    np.add.at(sums, hit, part)
                    np.add.at(sums, hit + step, part)
            step += 1
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                top = least_labels(n, a, b)
                out = np.union1d(a, b)
                ids = rows["id"].to_numpy()
                yield pd.DataFrame({"a": ids[out], "b": ids[top[out]], "weight": sums[out, 0], "got": list(sums[out, 1:])})


def own_depth(recall: float, floor: int) -> Column:
    """The longest prefix at which a set's estimated recall reaches the target, an aggregate over :func:`near_in_tries`."""
    met = [F.sum(F.element_at("got", d - floor + 1)) / F.sum("weight") for d in range(floor, LONGEST + 1)]
    return F.coalesce(*[F.when(met[d - floor] >= recall, F.lit(d)) for d in range(LONGEST, floor, -1)], F.lit(floor))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, min(4096, (1 << 23) // max(len(sets), 1)))
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [lo, lo + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], code[a:b] - lo] = 1
        total += block @ block.T
    return total


def verify(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Exact links inside families: per set the documents it links to, and its least linked partner in the tile."""
    for rows, starts in sorted_runs(batches, ["root", "t", "u"]):
        sets = [np.frombuffer(s, np.uint64) for s in rows["items"]]
        ids, copies, side = rows["id"].to_numpy(), rows["copies"].to_numpy(), rows["side"].to_numpy()
        cross = (rows["t"] != rows["u"]).to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        for lo, hi in zip(starts, np.append(starts[1:], len(rows))):
            if hi - lo < 2:
                continue
            group, sizes = sets[lo:hi], np.array([len(s) for s in sets[lo:hi]], np.float64)
            common = overlaps(group).astype(np.float64)
            # Whole numbers on both sides: no rounding decides about a pair.
            good = common * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
            np.fill_diagonal(good, False)
            if cross[lo]:
                good &= side[lo:hi, None] != side[None, lo:hi]
            a, b = np.nonzero(good)
            if len(a):
                label = least_labels(hi - lo, a, b)
                keep = np.flatnonzero(good.any(1))
                out.append((ids[lo:hi][keep], ids[lo:hi][label[keep]], good[keep] @ copies[lo:hi]))
        if out:
            yield pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out]),
                                "links": np.concatenate([o[2] for o in out]).astype(np.int64)})


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, size: int = SHINGLE,
                    recall: float = 0.999, tile: int = TILE) -> DataFrame:
    """One row per document: ``key``, ``class_id`` and ``n_links``.

    Two documents are linked when the Jaccard similarity of their sets of
    ``size``-word shingles is at least ``threshold``; ``n_links`` counts a
    document's partners, equal copies included, and ``class_id`` is the least
    key of its connected documents. Words are lower-case runs of letters and
    digits; a shorter text is one shingle. A null text, or one without a word,
    has no shingle and no links; a null key is a document whose class is its
    partners' least key (null if all are null); rows equal in key and text are
    documents of their own; an empty table gives an empty one.
    """
    return (document_classes(docs, key, text, threshold, size, recall, tile)
            .select(F.col("key").alias(key), "class_id", "n_links"))


def document_classes(docs: DataFrame, key: str, text: str, threshold: float, size: int, recall: float, tile: int) -> DataFrame:
    """Per row: ``key``, ``text`` (digest), ``root`` (number of its class, null without words), ``class_id``, ``n_links``."""
    found, reps, classes = _linked(docs, key, text, threshold, size, recall, tile)
    named = reps.join(classes, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    per_set = named.join(least, "root").select("set_a", "set_b", "n", "root", "class_id",
                                               (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = found.join(per_set, ["set_a", "set_b", "n"], "left")
    return joined.select("key", "text", "root", F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
                         F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def _linked(docs, key, text, threshold, size, recall, tile):
    """Signed documents, distinct sets (with an id, copies and least key), and the class of every linked set."""
    floor = prefix_length(threshold, recall)
    found = materialise(signed(docs, key, text, size))
    # Equal sets are one from here on; its id comes from the set's digest, so reruns agree.
    reps = materialise(found.where(F.col("n") > 0).groupBy("set_a", "set_b", "n")
                       .agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"), F.min(F.struct("text", "sig")).alias("_first"))
                       .select(F.xxhash64("set_a", "set_b", "n").alias("id"), "set_a", "set_b", "n", "copies", "least",
                               F.col("_first.text").alias("text"), "_first.sig"))
    level = max(0.0, threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / (TREES * LONGEST))))
    shape = "a bigint, b bigint, weight double, got array<double>"
    sets = reps.select("id", "sig")
    whole = sets.withColumn("depth", F.lit(LONGEST))
    met = materialise(below_nodes(whole, LONGEST, tile).mapInPandas(lambda b: near_in_tries(b, level, True, floor), shape))
    asked = met.groupBy(F.col("a").alias("id")).agg(own_depth(recall, floor).alias("_depth"))
    # Only sets still short of the target ask for shorter prefixes; all sets can be met there.
    shorter = sets.join(asked, "id", "left").select("id", "sig", F.coalesce("_depth", F.lit(floor)).alias("depth"))
    more = below_nodes(materialise(shorter), floor, tile).mapInPandas(lambda b: near_in_tries(b, level, False, floor), shape)
    families = connected(met.select("a", "b").unionByName(more.select("a", "b"))).withColumnRenamed("node", "id")
    members = materialise(families.join(reps.select("id", "text", "copies"), "id"))

    @F.pandas_udf("binary")
    def items(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, size).tobytes() for t in texts])

    # Only texts of families are read again; of equal texts one is kept.
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    texts = (docs.select(digest.alias("text"), F.col(text).alias("_body")).join(members, "text")
             .groupBy("id", "root", "copies").agg(F.first("_body").alias("_body")))
    sets = materialise(texts.select("id", "root", "copies", items("_body").alias("items")))
    by = ["root", "t", "u"]
    tiles = tiled(sets.select("id", "root"), ["root"], ["id"], tile).join(sets.select("id", "copies", "items"), "id")
    checked = materialise(tiles.repartition(*by).sortWithinPartitions(*by)
                          .mapInPandas(lambda b: verify(b, threshold), "a bigint, b bigint, links bigint"))
    links = checked.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = connected(checked.select("a", "b")).withColumnRenamed("node", "id")
    classes = links.join(roots, "id", "left")
    return found, reps, classes


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, size: int = SHINGLE,
                            recall: float = 0.999, tile: int = TILE) -> DataFrame:
    """``docs`` with one document of each class: that with the least key (null last), then the least text digest.

    Rows equal in key and text count as copies. Documents without links are
    kept as they are, null and empty texts too.
    """
    k, t, keep = (fresh(docs, c) for c in ("_class_key", "_class_text", "_class_keep"))
    rows = materialise(document_classes(docs, key, text, threshold, size, recall, tile).where(F.col("n_links") > 0)
                       .select("key", "text", "root").distinct())
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text")).alias("_f"))
    marked = rows.join(first, "root").select(F.col("key").alias(k), F.col("text").alias(t),
                                             (F.col("key").eqNullSafe(F.col("_f.key")) & (F.col("text") == F.col("_f.text"))).alias(keep))
    digest = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    joined = docs.join(marked, docs[key].eqNullSafe(marked[k]) & (digest == marked[t]), "left")
    single = joined.where(F.col(keep).isNull()).select(*docs.columns)
    return single.unionByName(joined.where(F.col(keep)).dropDuplicates([k, t]).select(*docs.columns))
