"""Near-duplicate pairs, nearest neighbours and leaks over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaksift.functions.bits import word_hex
from leaksift.functions.digest import split_by_digest
from leaksift.functions.intervals import collision_probability
from leaksift.operators.balls import median_distance, nearest
from leaksift.operators.checks import concat_all
from leaksift.operators.fingerprints import distinct_fingerprints, text_fingerprints
from leaksift.operators.lookups import exact_matches, exact_membership, passage_hits
from leaksift.operators.pairs import flagged_fingerprints, near_pairs, nearest_within
from leaksift.operators.rates import histogram, leak_rate, threshold_counts, touched_rows
from leaksift.operators.skew import salted_lookup
from leaksift.plans.audit import leakage_audit
from leaksift.queries.base import (DOCS, RADIUS, TEXT_BYTES, WORDS, Registry, document_count, document_prints, ham, kept,
                                   prints_cte, rounded, split_sql, table, train_and_held, wilson_sql, words_sql)
from leaksift.session import materialise
from leaksift.sources.scans import spread_input

registry = Registry()
LADDER = (0, 2, 6, 10)
_LOW, _HIGH = wilson_sql("k", "n")


@registry.add(f"""{DOCS},
d AS (SELECT {ham('a.fp2', 'b.fp2')} d FROM docs a JOIN docs b ON a.doc_id<b.doc_id WHERE bit_count(xor(a.fp2,b.fp2))<=10)
SELECT t::INTEGER AS threshold, count(d.d) AS item_pairs FROM (SELECT unnest([0,2,6,10]) t) LEFT JOIN d ON d.d<=t GROUP BY t""")
def near_dup_pairs(spark, sf):
    """Item pairs within each radius, counted from fingerprint pairs and copy counts."""
    groups = distinct_fingerprints(document_prints(spark, sf), ["fp2"])
    pairs = near_pairs(groups, words=["fp2"], radius=max(LADDER), rows=document_count(spark, sf))
    across = pairs.select("distance", (F.col("n_a") * F.col("n_b")).alias("v"))
    inside = groups.select(F.lit(0).alias("distance"), F.expr("n * (n - 1) div 2").alias("v"))
    return across.unionByName(inside).agg(
        *[F.coalesce(F.sum(F.when(F.col("distance") <= t, F.col("v"))), F.lit(0)).alias(f"t{t}") for t in LADDER]
    ).select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("item_pairs")) for t in LADDER])))


@registry.add(f"""{DOCS},
g AS (SELECT fp2, fp3, count(*) n FROM docs WHERE fp2 IS NOT NULL GROUP BY fp2, fp3)
SELECT a.fp2 fp2_a, a.fp3 fp3_a, a.n n_a, b.fp2 fp2_b, b.fp3 fp3_b, b.n n_b, {ham('a.fp2', 'b.fp2')} dist_fp2,
 {ham('a.fp3', 'b.fp3')} dist_fp3, ({ham('a.fp2', 'b.fp2')}+{ham('a.fp3', 'b.fp3')})::INTEGER distance
FROM g a, g b WHERE (a.fp2<b.fp2 OR (a.fp2=b.fp2 AND a.fp3<b.fp3)) AND {ham('a.fp2', 'b.fp2')}+{ham('a.fp3', 'b.fp3')}<=10""")
def near_dup_list(spark, sf):
    """Pairs of distinct two-word fingerprints at total distance at most 10."""
    groups = distinct_fingerprints(document_prints(spark, sf), WORDS)
    return near_pairs(groups, words=WORDS, radius=10, rows=document_count(spark, sf))


def _mode(spark, sf, mode):
    prints = document_prints(spark, sf)
    train, held = train_and_held(prints)
    flagged = flagged_fingerprints(held, train, mode, words=WORDS, radius=RADIUS,
                                   rows=document_count(spark, sf), ref_key="doc_id")
    counts = held.groupBy("lang", *WORDS).agg(F.count(F.lit(1)).alias("_n"))
    marked = counts.join(flagged.withColumn("_hit", F.lit(True)), WORDS, "left")
    rates = leak_rate(marked.withColumn("_hit", F.coalesce("_hit", F.lit(False))), "_hit", ["lang"], "_n")
    return rounded(rates, "rate", "ci_low", "ci_high")


def _mode_sql(condition):
    return f"""{DOCS},
f AS (SELECT v.lang, ({condition}) AS hit FROM va v),
c AS (SELECT lang, count(*) n, count(*) FILTER (WHERE hit) k FROM f GROUP BY lang)
SELECT lang, n, k, round(k/n,9) AS rate, {_LOW} AS ci_low, {_HIGH} AS ci_high FROM c"""


def _near_sql(condition):
    return f"EXISTS (SELECT 1 FROM tr t WHERE {condition})"


_A, _B = ham("v.fp2", "t.fp2"), ham("v.fp3", "t.fp3")


@registry.add(_mode_sql(f"{_near_sql(f'{_A}<=6')} AND {_near_sql(f'{_B}<=6')}"))
def pairs_independent(spark, sf):
    """Held-out rows whose two words each have some training row within 6."""
    return _mode(spark, sf, "independent")


@registry.add(_mode_sql(_near_sql(f"{_A}<=6 AND {_B}<=6")))
def pairs_same_row(spark, sf):
    """Held-out rows with one training row within 6 in both words."""
    return _mode(spark, sf, "same_row")


@registry.add(_mode_sql(_near_sql(f"{_A}+{_B}<=6")))
def pairs_additive(spark, sf):
    """Held-out rows with one training row at total distance at most 6."""
    return _mode(spark, sf, "additive")


@registry.add(f"""{DOCS},
p AS (SELECT a.source, a.doc_id a, b.doc_id b FROM docs a JOIN docs b ON a.source=b.source AND a.doc_id<b.doc_id
      WHERE {ham('a.fp2', 'b.fp2')}+{ham('a.fp3', 'b.fp3')}<=6),
t AS (SELECT source, count(DISTINCT id) rows_in_pairs FROM (SELECT source, a id FROM p UNION ALL SELECT source, b FROM p) GROUP BY source)
SELECT s.source, count(p.a) AS item_pairs, coalesce(max(t.rows_in_pairs),0) AS rows_in_pairs
FROM (SELECT DISTINCT source FROM docs) s LEFT JOIN p USING (source) LEFT JOIN t USING (source) GROUP BY s.source""")
def intra_source_pairs(spark, sf):
    """Unordered pairs inside each source at total distance at most 6, and the rows they touch."""
    groups = materialise(distinct_fingerprints(document_prints(spark, sf), WORDS, by=["source"]))
    pairs = materialise(near_pairs(groups, words=WORDS, radius=RADIUS, rows=document_count(spark, sf), on=["source"]))
    across = pairs.groupBy(F.col("source_a").alias("source")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("_across"))
    ends = (pairs.select("source_a", *[f"{w}_a" for w in WORDS]).toDF("source", *WORDS)
            .unionByName(pairs.select("source_b", *[f"{w}_b" for w in WORDS]).toDF("source", *WORDS)).distinct()
            .withColumn("_hit", F.lit(True)))
    touched = (F.col("_hit").isNotNull()) | (F.col("n") > 1)
    inside = groups.join(ends, ["source", *WORDS], "left").groupBy("source").agg(
        F.sum(F.expr("n * (n - 1) div 2")).alias("_inside"),
        F.sum(F.when(touched, F.col("n")).otherwise(0)).alias("rows_in_pairs"))
    return inside.join(across, "source", "left").select(
        "source", (F.col("_inside") + F.coalesce("_across", F.lit(0))).alias("item_pairs"), "rows_in_pairs")


@registry.add(f"""{DOCS}
SELECT a.source AS source_a, b.source AS source_b, count(*) AS item_pairs,
 count(*) FILTER (WHERE a.fp2=b.fp2 AND a.fp3=b.fp3) AS exact_pairs
FROM docs a JOIN docs b ON a.source<b.source WHERE {ham('a.fp2', 'b.fp2')}+{ham('a.fp3', 'b.fp3')}<=6 GROUP BY 1,2""")
def cross_source_matrix(spark, sf):
    """Near pairs between every two sources, counted from per-source copies of each fingerprint."""
    prints = document_prints(spark, sf)
    copies = materialise(distinct_fingerprints(prints, WORDS, by=["source"]))
    pairs = near_pairs(copies.groupBy(*WORDS).agg(F.count(F.lit(1)).alias("n")), words=WORDS, radius=RADIUS,
                       rows=document_count(spark, sf))
    a = copies.select(F.col("source").alias("_sa"), F.col("n").alias("_ca"), *[F.col(w).alias(f"{w}_a") for w in WORDS])
    b = copies.select(F.col("source").alias("_sb"), F.col("n").alias("_cb"), *[F.col(w).alias(f"{w}_b") for w in WORDS])
    near = (pairs.join(a, [f"{w}_a" for w in WORDS]).join(b, [f"{w}_b" for w in WORDS])
            .select("_sa", "_sb", (F.col("_ca") * F.col("_cb")).alias("_v"), F.lit(0).cast("bigint").alias("_e")))
    same = (copies.select(*WORDS, F.col("source").alias("_sa"), F.col("n").alias("_ca"))
            .join(copies.select(*WORDS, F.col("source").alias("_sb"), F.col("n").alias("_cb")), WORDS)
            .where(F.col("_sa") < F.col("_sb"))
            .select("_sa", "_sb", (F.col("_ca") * F.col("_cb")).alias("_v"), (F.col("_ca") * F.col("_cb")).alias("_e")))
    return (near.unionByName(same).where(F.col("_sa") != F.col("_sb"))
            .groupBy(F.least("_sa", "_sb").alias("source_a"), F.greatest("_sa", "_sb").alias("source_b"))
            .agg(F.sum("_v").alias("item_pairs"), F.sum("_e").alias("exact_pairs")))


def _class_distances(spark, sf, by, radius):
    """Held-out fingerprints per class with their rows and smallest training distance (null beyond the radius)."""
    train, held = train_and_held(document_prints(spark, sf))
    near = nearest_within(held, train, words=["fp2"], radius=radius, rows=document_count(spark, sf),
                          ref_key="doc_id").select("fp2", "distance")
    return held.groupBy(by, "fp2").agg(F.count(F.lit(1)).alias("_n")).join(near, "fp2", "left")


def _ladder(counts, by, thresholds):
    return rounded(threshold_counts(counts, "distance", thresholds, [by], "_n"), "rate", "ci_low", "ci_high")


def leak_ladder(spark, sf, by="lang", thresholds=LADDER):
    """Held-out rows with a training neighbour within each radius, per class, with Wilson intervals."""
    return _ladder(_class_distances(spark, sf, by, max(thresholds)), by, thresholds)


_LADDER_SQL = f"""{DOCS},
d AS (SELECT v.doc_id, v.lang, min({ham('v.fp2', 't.fp2')}) d FROM va v LEFT JOIN tr t ON bit_count(xor(v.fp2,t.fp2))<=10 GROUP BY 1,2),
c AS (SELECT lang, t::INTEGER threshold, count(*) n, count(*) FILTER (WHERE d<=t) k FROM d, (SELECT unnest([0,2,6,10]) t) GROUP BY 1,2)
SELECT lang, n, threshold, k, round(k/n,9) rate, {_LOW} AS ci_low, {_HIGH} AS ci_high FROM c"""


def _nearest_sql(name: str, word: str, same: str = "TRUE") -> str:
    """A CTE: the distance of every held-out row to its nearest training row, however far."""
    return f"{name} AS (SELECT v.doc_id, v.source, v.lang, min({ham(f'v.{word}', f't.{word}')}) d FROM va v JOIN tr t ON {same} GROUP BY 1,2,3)"


@registry.add(_LADDER_SQL.replace("\nSELECT lang, n,", f",\n{_nearest_sql('nd', 'fp2')},\nmd AS (SELECT lang, median(d)::DOUBLE AS median_distance FROM nd GROUP BY 1)\nSELECT lang, n,")
              .replace("AS ci_high FROM c", "AS ci_high, median_distance FROM c JOIN md USING (lang)"))
def train_val_leak_by_class(spark, sf):
    """Leak rates per radius and class, with the median distance to the nearest training row, however far."""
    train, held = train_and_held(document_prints(spark, sf))
    medians = median_distance(held, train, words=["fp2"], rows=document_count(spark, sf), ref_key="doc_id", by=["lang"])
    return _ladder(_class_distances(spark, sf, "lang", max(LADDER)), "lang", LADDER).join(medians, "lang")


@registry.add(f"""{DOCS},
x AS (SELECT v.doc_id, v.source, (SELECT min({_A}) FROM tr t WHERE t.source=v.source AND {_A}<=6) da, (SELECT min({_B}) FROM tr t WHERE t.source=v.source AND {_B}<=6) db,
  (SELECT count(*)>0 FROM tr t WHERE t.source=v.source AND {_A}<=6 AND {_B}<=6) joint,
  EXISTS (SELECT 1 FROM tr t WHERE t.source=v.source AND 'doc_'||(t.doc_id%300)='doc_'||(v.doc_id%300)) named FROM va v),
n AS (SELECT source, count(*) n_train FROM tr GROUP BY 1), {_nearest_sql('n2', 'fp2', 't.source=v.source')}, {_nearest_sql('n3', 'fp3', 't.source=v.source')},
m2 AS (SELECT source, median(d)::DOUBLE AS median_fp2 FROM n2 GROUP BY 1), m3 AS (SELECT source, median(d)::DOUBLE AS median_fp3 FROM n3 GROUP BY 1)
SELECT x.source, max(n_train) n_train, count(*) n_held, count(da) k_near, count(*) FILTER (WHERE joint) k_joint,
 round(count(*) FILTER (WHERE joint)/count(*),9) joint_rate, count(*) FILTER (WHERE da=0) k_zero, round(count(*) FILTER (WHERE da=0)/count(*),9) zero_rate,
 count(*) FILTER (WHERE da IS NOT NULL AND db IS NOT NULL) k_independent, count(*) FILTER (WHERE named) n_named,
 max(median_fp2) AS median_fp2, max(median_fp3) AS median_fp3 FROM x JOIN n USING (source) JOIN m2 USING (source) JOIN m3 USING (source) GROUP BY 1""")
def internal_leak_by_source(spark, sf):
    """Leaks between the splits of one and the same source: within the radius in one word, both, or both in one row; equal;
    names that occur on both sides; and medians of the distance to the nearest training row, however far."""
    prints = document_prints(spark, sf)
    train, held = train_and_held(prints)
    rows = document_count(spark, sf)
    near = {w: nearest_within(held, train, words=[w], radius=RADIUS, rows=rows, ref_key="doc_id", on=["source"])
            .select("source", w, F.col("distance").alias(f"_d_{w}")) for w in WORDS}
    joint = flagged_fingerprints(held, train, "same_row", words=WORDS, radius=RADIUS, rows=rows,
                                 ref_key="doc_id", on=["source"])
    counts = materialise(held.groupBy("source", *WORDS).agg(F.count(F.lit(1)).alias("_n"))
                         .join(near["fp2"], ["source", "fp2"], "left").join(near["fp3"], ["source", "fp3"], "left")
                         .join(joint.withColumn("_joint", F.lit(True)), ["source", *WORDS], "left"))
    sizes = train.groupBy("source").agg(F.count(F.lit(1)).alias("n_train"))
    some = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    a, b = F.col("_d_fp2"), F.col("_d_fp3")
    out = counts.groupBy("source").agg(
        F.sum("_n").alias("n_held"), some(a.isNotNull()).alias("k_near"), some(F.col("_joint")).alias("k_joint"),
        some(a == 0).alias("k_zero"), some(a.isNotNull() & b.isNotNull()).alias("k_independent"))
    name = F.concat(F.lit("doc_"), (F.col("doc_id") % 300).cast("string")).alias("_name")
    named = (held.select("source", name).join(train.select("source", name).distinct(), ["source", "_name"], "left_semi")
             .groupBy("source").agg(F.count(F.lit(1)).alias("n_named")))
    out = out.join(named, "source", "left").withColumn("n_named", F.coalesce("n_named", F.lit(0).cast("bigint")))
    for w in WORDS:
        out = out.join(median_distance(held, train, words=[w], rows=rows, ref_key="doc_id", by=["source"], on=["source"], out=f"median_{w}"), "source")
    out = sizes.join(out, "source").withColumn("joint_rate", F.col("k_joint") / F.col("n_held")).withColumn("zero_rate", F.col("k_zero") / F.col("n_held"))
    return rounded(out, "joint_rate", "zero_rate")


@registry.add(f"""{DOCS},
m AS (SELECT v.doc_id, min({_A}) d FROM va v, tr t GROUP BY 1)
SELECT v.doc_id, v.source, v.lang, m.d AS distance,
 (SELECT min(t.doc_id) FROM tr t WHERE {_A}=m.d) AS nearest FROM va v LEFT JOIN m USING (doc_id)""")
def annotated_documents(spark, sf):
    """Every held-out row with its smallest training distance, however large, and first nearest row."""
    train, held = train_and_held(document_prints(spark, sf))
    near = nearest(held, train, words=["fp2"], rows=document_count(spark, sf), ref_key="doc_id")
    return salted_lookup(held, near, ["fp2"], ["doc_id"], rows=document_count(spark, sf)).select("doc_id", "source", "lang", "distance", "nearest")


@registry.add(f"""{DOCS},
m AS (SELECT v.doc_id, v.lang, min({_A}) d FROM va v, tr t GROUP BY 1,2)
SELECT lang, CASE WHEN d<3 THEN '0,3' WHEN d<6 THEN '3,6' WHEN d<10 THEN '6,10' WHEN d<20 THEN '10,20' WHEN d<=64 THEN '20,64' ELSE 'outside' END AS bin, count(*) n FROM m GROUP BY 1,2""")
def nearest_histogram(spark, sf):
    """Distances to the nearest training row in half-open bins up to all 64 bits; only unhashed rows are outside."""
    train, held = train_and_held(document_prints(spark, sf))
    near = nearest(held, train, words=["fp2"], rows=document_count(spark, sf), ref_key="doc_id")
    counts = held.groupBy("lang", "fp2").agg(F.count(F.lit(1)).alias("_n")).join(near.select("fp2", "distance"), "fp2", "left")
    return histogram(counts, "distance", (0, 3, 6, 10, 20, 64), ["lang"], "_n")


@registry.add(f"""{DOCS},
m AS (SELECT fp2, fp3, min(doc_id) first_match, count(*) n_matches, arg_min(source, doc_id) src FROM tr GROUP BY 1,2)
SELECT v.doc_id, v.source, first_match, n_matches, v.source=m.src AS same_group FROM va v JOIN m USING (fp2, fp3)""")
def exact_match_list(spark, sf):
    """Held-out rows equal to a training row: first match, multiplicity, same source or not."""
    train, held = train_and_held(document_prints(spark, sf))
    return exact_matches(held, train, on=WORDS, item="doc_id", ref_key="doc_id", group="source",
                          rows=document_count(spark, sf)).select(
        "doc_id", "source", "first_match", "n_matches", "same_group")


@registry.add(f"""{DOCS},
m AS (SELECT fp2, fp3, arg_min(source, doc_id) src FROM tr GROUP BY 1,2)
SELECT v.lang, count(*) n_pairs, count(*) FILTER (WHERE v.source=src) n_same, count(*) FILTER (WHERE v.source<>src) n_different
FROM va v JOIN m USING (fp2, fp3) GROUP BY 1""")
def exact_match_groups(spark, sf):
    """Exact matches whose first training match is of the same or of another source."""
    train, held = train_and_held(document_prints(spark, sf))
    found = exact_matches(held, train, on=WORDS, item="doc_id", ref_key="doc_id", group="source",
                          rows=document_count(spark, sf))
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("same_group").alias("n_same"),
                                     F.count_if(~F.col("same_group")).alias("n_different"))


@registry.add(f"""{DOCS},
h AS (SELECT DISTINCT fp2, fp3 FROM tr)
SELECT v.source, count(*) n, count(h.fp2) k, round(count(h.fp2)/count(*),9) rate,
 {wilson_sql('count(h.fp2)', 'count(*)')[0]} AS ci_low, {wilson_sql('count(h.fp2)', 'count(*)')[1]} AS ci_high
FROM va v LEFT JOIN h ON v.fp2=h.fp2 AND v.fp3=h.fp3 GROUP BY 1""")
def exact_membership_by_source(spark, sf):
    """Share of held-out rows whose exact fingerprint occurs in training, per source."""
    train, held = train_and_held(document_prints(spark, sf))
    flagged = exact_membership(held, train, WORDS, ["doc_id"], rows=document_count(spark, sf))
    return rounded(leak_rate(flagged, "is_member", ["source"]), "rate", "ci_low", "ci_high")


@registry.add(f"""WITH tok AS (SELECT doc_id, source, string_split({words_sql('text')},' ') w FROM documents),
btok AS (SELECT item_id, string_split({words_sql('text')},' ') w FROM benchmark),
s AS (SELECT DISTINCT doc_id, source, array_to_string(w[i+1:i+8],' ') g FROM (SELECT doc_id, source, w, unnest(range(len(w)-7)) i FROM tok)),
b AS (SELECT DISTINCT array_to_string(w[i+1:i+8],' ') g FROM (SELECT item_id, w, unnest(range(len(w)-7)) i FROM btok)),
hit AS (SELECT DISTINCT doc_id FROM s WHERE g IN (SELECT g FROM b)),
c AS (SELECT d.source, count(*) n, count(hit.doc_id) k FROM documents d LEFT JOIN hit USING (doc_id) GROUP BY 1)
SELECT source, n, k, round(k/n,9) rate, {_LOW} AS ci_low, {_HIGH} AS ci_high FROM c""")
def benchmark_contamination_by_source(spark, sf):
    """Share of documents holding a run of eight words of the benchmark, per source."""
    docs = spread_input(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    hits = passage_hits(docs, table(spark, sf, "benchmark"), "doc_id", size=8)
    marked = docs.select("doc_id", "source").join(hits.withColumn("_hit", F.lit(True)), "doc_id", "left")
    rates = leak_rate(marked.withColumn("_hit", F.coalesce("_hit", F.lit(False))), "_hit", ["source"])
    return rounded(rates, "rate", "ci_low", "ci_high")


_P6 = repr(collision_probability(6, 128))


@registry.add(f"""{DOCS},
conv AS (SELECT conv_id*100000+turn AS key, text FROM conversations),
{prints_cte('conv', 'key', 'c_')},
src AS (SELECT source, count(*) n FROM docs GROUP BY 1), m AS (SELECT count(*) m FROM c_fps),
p AS (SELECT d.source, count(*) pairs, count(*) FILTER (WHERE d.fp2=c.fp2 AND d.fp3=c.fp3) exact
      FROM docs d, c_fps c WHERE {ham('d.fp2', 'c.fp2')}+{ham('d.fp3', 'c.fp3')}<=6 GROUP BY 1)
SELECT source, n*m AS volume, coalesce(pairs,0) AS item_pairs, coalesce(exact,0) AS exact_pairs,
 n*m*{_P6}::DOUBLE*1e20 AS expected_e20 FROM src CROSS JOIN m LEFT JOIN p USING (source)""")
def cross_corpus_control(spark, sf):
    """Negative control: conversation turns against every document source, with the hits chance would give."""
    docs = document_prints(spark, sf)
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("key"), "text")
    turns = materialise(text_fingerprints(spread_input(turns, "key"), ["key"], digest="md5"))
    rows = max(document_count(spark, sf), table(spark, sf, "conversations").count())
    copies = distinct_fingerprints(docs, WORDS, by=["source"])
    pairs = near_pairs(copies, distinct_fingerprints(turns, WORDS), words=WORDS, radius=RADIUS, rows=rows)
    volume = F.col("n_a") * F.col("n_b")
    hits = pairs.groupBy(F.col("source_a").alias("source")).agg(
        F.sum(volume).alias("_p"), F.sum(F.when(F.col("distance") == 0, volume).otherwise(0)).alias("_e"))
    size = turns.dropna(subset=WORDS).agg(F.count(F.lit(1)).alias("_m"))
    counted = (docs.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).join(size, F.lit(True))
               .withColumn("volume", F.col("_n") * F.col("_m")).join(hits, "source", "left"))
    return counted.select("source", "volume", F.coalesce("_p", F.lit(0)).alias("item_pairs"),
                          F.coalesce("_e", F.lit(0)).alias("exact_pairs"),
                          (F.col("volume") * F.lit(collision_probability(6, 128)) * 1e20).alias("expected_e20"))


@registry.add(f"""{DOCS},
p AS (SELECT a.doc_id a, b.doc_id b FROM docs a JOIN docs b ON a.doc_id<b.doc_id WHERE {ham('a.fp2', 'b.fp2')}+{ham('a.fp3', 'b.fp3')}<=6)
SELECT (SELECT count(*) FROM (SELECT a FROM p UNION SELECT b FROM p)) AS rows_in_pairs, (SELECT count(fp2) FROM docs) AS n_rows""")
def rows_in_any_pair(spark, sf):
    """Distinct rows touched by near pairs, copies included."""
    groups = materialise(distinct_fingerprints(document_prints(spark, sf), WORDS))
    pairs = near_pairs(groups, words=WORDS, radius=RADIUS, rows=document_count(spark, sf))
    return touched_rows(pairs, groups, WORDS)


_UNHASHED = "SELECT source, 'unhashed' AS report, 0::INTEGER AS threshold, count(*) n, count(*)-count(fp2) AS k FROM docs GROUP BY 1"


@registry.add(f"""{DOCS},
m AS (SELECT v.doc_id, v.source, min({_A}) d FROM va v LEFT JOIN tr t ON bit_count(xor(v.fp2,t.fp2))<=6 GROUP BY 1,2),
f AS (SELECT v.source, {_near_sql(f'{_A}<=6 AND {_B}<=6')} AS s, {_near_sql(f'{_A}+{_B}<=6')} AS a FROM va v)
SELECT source, 'by_source' AS report, t::INTEGER AS threshold, count(*) n, count(*) FILTER (WHERE d<=t) k FROM m, (SELECT unnest([0,2,6]) t) GROUP BY 1,3
UNION ALL SELECT source, 'same_row', 6, count(*), count(*) FILTER (WHERE s) FROM f GROUP BY 1
UNION ALL SELECT source, 'additive', 6, count(*), count(*) FILTER (WHERE a) FROM f GROUP BY 1 UNION ALL {_UNHASHED}""")
def full_audit(spark, sf):
    """The per-source tables of a whole audit in one long form."""
    out = leakage_audit(document_prints(spark, sf), key="doc_id", words=WORDS, source="source", label="lang", split="split",
                        rows=document_count(spark, sf), modes=("same_row", "additive"))
    parts = [out["by_source"].select("source", F.lit("by_source").alias("report"), "threshold", "n", "k")]
    parts += [out[m].select("source", F.lit(m).alias("report"), F.lit(6).alias("threshold"), "n", "k") for m in ("same_row", "additive")]
    sizes = document_prints(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    parts.append(sizes.join(out["unhashed"], "source").select(
        "source", F.lit("unhashed").alias("report"), F.lit(0).alias("threshold"), "n", F.col("n_unhashed").alias("k")))
    return concat_all(parts)


_LINES = f"""WITH lines AS (SELECT doc_id*1000000+i AS key, lang, {split_sql('doc_id')} AS split, l AS text
 FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)),1)-1 i FROM documents)),
{prints_cte('lines', 'key')}, x AS (SELECT key, lang, split, fp2 FROM lines JOIN fps USING (key)),
d AS (SELECT DISTINCT fp2 FROM x WHERE split='training'), h AS (SELECT lang, fp2, count(*) n FROM x WHERE split='validation' GROUP BY 1,2),
m AS (SELECT h.lang, h.fp2, h.n, min({ham('h.fp2', 'd.fp2')}) dist FROM h LEFT JOIN d ON bit_count(xor(h.fp2,d.fp2))<=6 GROUP BY 1,2,3),
c AS (SELECT lang, t::INTEGER threshold, sum(n)::BIGINT n, coalesce(sum(n) FILTER (WHERE dist<=t),0)::BIGINT k FROM m, (SELECT unnest([0,2,6]) t) GROUP BY 1,2)"""


@registry.add(f"{_LINES} SELECT lang, n, threshold, k, round(k/n,9) rate, {_LOW} AS ci_low, {_HIGH} AS ci_high FROM c")
def line_leak_by_class(spark, sf):
    """Held-out lines with a near copy among the lines of training documents."""
    def build():
        docs = spread_input(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id", most_bytes=TEXT_BYTES)
        lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line", "text"))
        prints = text_fingerprints(lines, ["doc_id", "line", "lang"], families={"fp2": 2}, digest="md5")
        return prints.where(F.col("fp2").isNotNull()).withColumn("split", split_by_digest(F.col("doc_id"), "split", 7))

    lines = kept(spark, sf, "lines", build, of="documents")
    train, held = train_and_held(lines)
    near = nearest_within(held, train, words=["fp2"], radius=RADIUS, rows=lines.count(), ref_key="doc_id")
    counts = held.groupBy("lang", "fp2").agg(F.count(F.lit(1)).alias("_n")).join(near.select("fp2", "distance"), "fp2", "left")
    return rounded(threshold_counts(counts, "distance", (0, 2, 6), ["lang"], "_n"), "rate", "ci_low", "ci_high")


@registry.add(f"""{DOCS}
SELECT doc_id, lower(format('{{:016x}}', CASE WHEN fp2<0 THEN fp2::HUGEINT+18446744073709551616 ELSE fp2 END)) AS fp2_hex,
 bit_count(fp2)::INTEGER AS ones FROM docs""")
def document_fingerprints(spark, sf):
    """The two-word fingerprint of every document as hex digits, with its popcount."""
    return document_prints(spark, sf).select("doc_id", word_hex(F.col("fp2")).alias("fp2_hex"),
                                             F.bit_count("fp2").alias("ones"))


QUERIES, SQL = registry.queries, registry.sql
