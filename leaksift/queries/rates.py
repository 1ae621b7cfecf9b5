"""Counts, coverage and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaksift.functions.digest import split_by_digest
from leaksift.functions.keys import basename, joint_max_distance
from leaksift.operators.fingerprints import distinct_fingerprints
from leaksift.operators.lookups import attach, class_prior, group_overlap, majority_vote, name_overlap
from leaksift.operators.pairs import near_pairs
from leaksift.operators.rates import (agreement, band_summary, bounded_examples, corruption_summary,
                                      cross_source_groups, curve, density, disagreement, duplicate_groups,
                                      fraction_buckets, group_coverage, group_profile, histogram,
                                      location_summary, source_split_counts, unmappable)
from leaksift.queries.base import (DOCS, PREDICTIONS, WORDS, Registry, document_count, document_digests, document_prints, ham,
                                   predictions, rounded, split_sql, table)

registry = Registry()


@registry.add(f"""WITH d AS (SELECT lang, {split_sql('doc_id')} AS split FROM documents)
SELECT CASE WHEN grouping(lang)=1 THEN '(all)' ELSE lang END AS lang,
 CASE WHEN grouping(split)=1 THEN '(all)' ELSE split END AS split, count(*) n FROM d GROUP BY ROLLUP(lang, split)""")
def class_split_counts(spark, sf):
    """Rows per class and split with all totals."""
    docs = table(spark, sf, "documents").select("lang", split_by_digest(F.col("doc_id"), "split", 7).alias("split"))
    return source_split_counts(docs, ["lang", "split"])


@registry.add("""WITH g AS (SELECT lang, md5(text) h, count(*) n FROM documents GROUP BY 1,2)
SELECT lang, sum(n)::BIGINT n_rows, count(*) FILTER (WHERE n>1) n_groups,
 coalesce(sum(n) FILTER (WHERE n>1),0)::BIGINT rows_in_groups,
 (coalesce(sum(n) FILTER (WHERE n>1),0) - count(*) FILTER (WHERE n>1))::BIGINT extra_rows,
 round(100.0::DOUBLE*(coalesce(sum(n) FILTER (WHERE n>1),0) - count(*) FILTER (WHERE n>1))/sum(n),9) extra_percent FROM g GROUP BY lang""")
def exact_text_groups(spark, sf):
    """Groups of identical texts per class."""
    docs = document_digests(spark, sf).select("lang", "digest")
    return rounded(duplicate_groups(docs, ["digest"], ["lang"]), "extra_percent")


@registry.add("""SELECT md5(text) AS digest, count(DISTINCT source) n_sources, count(*) n_rows, min(source) first_source
FROM documents GROUP BY 1 HAVING count(DISTINCT source)>=2""")
def cross_source_text_groups(spark, sf):
    """Identical texts seen in two or more sources."""
    docs = document_digests(spark, sf).select("source", "digest")
    return cross_source_groups(docs, ["digest"], "source")


@registry.add("""WITH g AS (SELECT md5(text) h, doc_id FROM documents),
k AS (SELECT h FROM g GROUP BY h HAVING count(*)>1),
r AS (SELECT h, doc_id, row_number() OVER (PARTITION BY h ORDER BY doc_id) r FROM g WHERE h IN (SELECT h FROM k))
SELECT h AS digest, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS examples FROM r WHERE r<=3 GROUP BY h""")
def duplicate_examples(spark, sf):
    """First three members of every group of identical texts."""
    docs = document_digests(spark, sf).select("doc_id", "digest")
    many = docs.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("digest")
    found = bounded_examples(docs.join(many, "digest", "left_semi"), ["digest"], "doc_id", 3)
    return found.select("digest", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


_EVENTS = f"WITH e AS (SELECT user_id, event_type, value, {split_sql('event_id')} AS split FROM events)"


def _split_events(spark, sf):
    return table(spark, sf, "events").select(
        "user_id", "event_type", "value", split_by_digest(F.col("event_id"), "split", 7).alias("split"))


@registry.add(f"""{_EVENTS}, a AS (SELECT user_id, count(*) FILTER (WHERE split='training') a, count(*) FILTER (WHERE split='validation') b FROM e GROUP BY 1)
SELECT count(*) FILTER (WHERE a>0 AND b>0) n_shared, count(*) FILTER (WHERE a>0 AND b=0) n_train_only,
 count(*) FILTER (WHERE a=0 AND b>0) n_test_only, coalesce(sum(b) FILTER (WHERE a>0 AND b>0),0)::BIGINT test_rows_shared, sum(b)::BIGINT test_rows FROM a""")
def user_overlap(spark, sf):
    """Users with events in both splits, and held-out events of shared users."""
    events = _split_events(spark, sf)
    return group_overlap(events.where(F.col("split") == "training"), events.where(F.col("split") == "validation"), "user_id")


_COVERAGE = """SELECT user_id, count(*) total, count(*) FILTER (WHERE event_type='error') hit,
 round(count(*) FILTER (WHERE event_type='error')/count(*),9) fraction FROM events GROUP BY 1"""


def _coverage(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type")
    return group_coverage(events, events.where(F.col("event_type") == "error"), "user_id")


@registry.add(_COVERAGE)
def user_coverage(spark, sf):
    """Share of error events per user; users without one are kept."""
    return rounded(_coverage(spark, sf), "fraction")


@registry.add(f"""WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type='error')/count(*) f FROM events GROUP BY 1)
SELECT count(*) n_groups, round(avg(f),9) mean_fraction, round(stddev_pop(f),9) sd_population, count(*) FILTER (WHERE f>=0.99) n_full,
 count(*) FILTER (WHERE f>0.9) n_above_90, count(*) FILTER (WHERE f>0.5) n_above_50, count(*) FILTER (WHERE f=0) n_zero FROM c""")
def coverage_buckets(spark, sf):
    """How many users are fully, mostly, half or not covered by errors."""
    return rounded(fraction_buckets(_coverage(spark, sf)), "mean_fraction", "sd_population")


_LOCATION = ", ".join(f"round(quantile_cont({{v}},{q}),9) p{int(q * 100)}" for q in (0.10, 0.25, 0.50, 0.75, 0.95))


def _location_sql(value, cuts):
    shares = ", ".join(f"round(avg(({value}>={c})::INTEGER),9) AS share_ge_{str(c).replace('.', '_')}" for c in cuts)
    return (f"count({value}) n, round(avg({value}),9) mean, round(stddev_samp({value}),9) sd_sample, "
            f"round(stddev_pop({value}),9) sd_population, {_LOCATION.format(v=value)}, min({value}) AS min, max({value}) AS max"
            + (", " + shares if cuts else ""))


_LOCATION_COLUMNS = ("mean", "sd_sample", "sd_population", "p10", "p25", "p50", "p75", "p95")


@registry.add(f"SELECT event_type, {_location_sql('value', (10, 50.5))} FROM events GROUP BY 1")
def value_summary(spark, sf):
    """Location summary of event values per type, with shares above two cuts."""
    out = location_summary(table(spark, sf, "events"), "value", ["event_type"], (10, 50.5))
    return rounded(out, *_LOCATION_COLUMNS, "share_ge_10", "share_ge_50_5")


@registry.add(f"""WITH l AS (SELECT l_discount, CASE WHEN l_quantity BETWEEN 0 AND 10 THEN '0-10' WHEN l_quantity BETWEEN 11 AND 30 THEN '11-30'
 WHEN l_quantity BETWEEN 31 AND 40 THEN '31-40' ELSE 'other' END AS band FROM lineitem)
SELECT band, {_location_sql('l_discount', ())} FROM l GROUP BY 1""")
def quantity_bands(spark, sf):
    """Discounts per quantity band; quantities outside every band stay visible."""
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_discount")
    return rounded(band_summary(lines, "l_quantity", "l_discount", [(0, 10), (11, 30), (31, 40)]), *_LOCATION_COLUMNS)


@registry.add("""SELECT l_returnflag, CASE WHEN l_quantity>=1 AND l_quantity<3 THEN '1,3' WHEN l_quantity>=3 AND l_quantity<6 THEN '3,6'
 WHEN l_quantity>=6 AND l_quantity<10 THEN '6,10' WHEN l_quantity>=10 AND l_quantity<=40 THEN '10,40' ELSE 'outside' END AS bin, count(*) n
FROM lineitem GROUP BY 1,2""")
def quantity_histogram(spark, sf):
    """Half-open bins with a closed last one and a visible rest."""
    return histogram(table(spark, sf, "lineitem"), "l_quantity", (1, 3, 6, 10, 40), ["l_returnflag"])


@registry.add(f"""{DOCS},
g AS (SELECT lang, fp2, fp3 FROM docs WHERE fp2 IS NOT NULL GROUP BY ALL),
p AS (SELECT a.lang, greatest({ham('a.fp2', 'b.fp2')}, {ham('a.fp3', 'b.fp3')}) AS joint FROM g a JOIN g b ON a.lang=b.lang
 AND (a.fp2<b.fp2 OR (a.fp2=b.fp2 AND a.fp3<b.fp3)) WHERE {ham('a.fp2', 'b.fp2')}+{ham('a.fp3', 'b.fp3')}<=12),
c AS (SELECT lang, joint, count(*) n FROM p GROUP BY 1,2)
SELECT lang, joint, n, round(n/sum(n) OVER (PARTITION BY lang),9) density FROM c""")
def joint_distance_density(spark, sf):
    """Unit-bin density of the larger of two word distances over near pairs of one class."""
    groups = distinct_fingerprints(document_prints(spark, sf), WORDS, by=["lang"]).drop("n")
    pairs = near_pairs(groups, words=WORDS, radius=12, rows=document_count(spark, sf), on=["lang"])
    joint = pairs.select(F.col("lang_a").alias("lang"), joint_max_distance(F.col("dist_fp2"), F.col("dist_fp3")).alias("joint"))
    return rounded(density(joint, "joint", ["lang"]), "density")


@registry.add("""WITH c AS (SELECT q AS quality, coalesce(n,0) n FROM (SELECT unnest([0,1,2])::INTEGER q) LEFT JOIN (SELECT quality q, count(*) n FROM labels GROUP BY 1) USING (q))
SELECT quality, n, round(n/(SELECT count(quality) FROM labels),9) prior FROM c""")
def quality_prior(spark, sf):
    """Share of every known quality class among labelled documents, an empty one included."""
    classes = spark.range(3).select(F.col("id").cast("int").alias("quality"))
    return rounded(class_prior(table(spark, sf, "labels"), classes, "quality"), "prior")


@registry.add("""WITH c AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1,2)
SELECT user_id, event_type AS vote FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type)=1""")
def user_majority(spark, sf):
    """Most frequent event type per user, first by name on ties."""
    return majority_vote(table(spark, sf, "events"), ["user_id"], "event_type")


@registry.add(f"""{PREDICTIONS},
c AS (SELECT source, y, count(*) n, count(*) FILTER (WHERE y=pred) k FROM pred GROUP BY 1,2),
t AS (SELECT source, sum(n) n, sum(k)/sum(n) acc FROM c GROUP BY 1),
d AS (SELECT source, y AS dominant_label FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, y)=1),
o AS (SELECT c.source, sum(k)/sum(n) acc FROM c JOIN d USING (source) WHERE y<>dominant_label GROUP BY 1)
SELECT source, dominant_label, t.n::BIGINT n, round(t.acc,9) accuracy, round(o.acc,9) accuracy_other,
 CASE WHEN t.acc>=0.8 THEN 'high' WHEN t.acc<=0.2 THEN 'low' ELSE 'mid' END AS level FROM t JOIN d USING (source) LEFT JOIN o USING (source)""")
def group_accuracy_profile(spark, sf):
    """Accuracy per group over all teams, its dominant label, and accuracy outside that label."""
    rows = predictions(spark, sf).withColumn("correct", F.col("y") == F.col("pred"))
    return rounded(group_profile(rows, "source", "y", "correct"), "accuracy", "accuracy_other")


@registry.add(f"""{PREDICTIONS}
SELECT y, pred, count(*) n FROM pred WHERE y<>pred GROUP BY 1,2 ORDER BY n DESC, y, pred LIMIT 15""")
def label_disagreement(spark, sf):
    """The fifteen most frequent differing label pairs over all teams."""
    return disagreement(predictions(spark, sf), "y", "pred")


@registry.add(f"""{PREDICTIONS},
c AS (SELECT team, source, y, count(*) n, count(*) FILTER (WHERE y=pred) k FROM pred GROUP BY 1,2,3),
t AS (SELECT team, source, sum(n) n, sum(k)/sum(n) acc FROM c GROUP BY 1,2),
d AS (SELECT team, source, y AS dominant_label FROM c QUALIFY row_number() OVER (PARTITION BY team, source ORDER BY n DESC, y)=1),
o AS (SELECT c.team, c.source, sum(k)/sum(n) acc FROM c JOIN d USING (team, source) WHERE y<>dominant_label GROUP BY 1,2)
SELECT team, source, dominant_label, t.n::BIGINT n, round(t.acc,9) accuracy, round(o.acc,9) accuracy_other,
 CASE WHEN t.acc>=0.8 THEN 'high' WHEN t.acc<=0.2 THEN 'low' ELSE 'mid' END AS level
FROM t JOIN d USING (team, source) LEFT JOIN o USING (team, source)""")
def group_accuracy_by_team(spark, sf):
    """``group_accuracy_profile`` for every team."""
    rows = predictions(spark, sf).withColumn("correct", F.col("y") == F.col("pred"))
    return rounded(group_profile(rows, "source", "y", "correct", by=["team"]), "accuracy", "accuracy_other")


@registry.add(f"""{PREDICTIONS}
SELECT team, y, pred, count(*) n FROM pred WHERE y<>pred GROUP BY 1,2,3
QUALIFY row_number() OVER (PARTITION BY team ORDER BY n DESC, y, pred)<=15""")
def label_disagreement_by_team(spark, sf):
    """The fifteen most frequent differing label pairs of every team."""
    return disagreement(predictions(spark, sf), "y", "pred", by=["team"])


@registry.add("""WITH j AS (SELECT l.quality, d.lang, CASE WHEN quality=1 THEN 'en' ELSE NULL END AS mapped FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) FILTER (WHERE mapped=lang) n_agree, count(*) FILTER (WHERE mapped<>lang) n_disagree, count(*) FILTER (WHERE mapped IS NULL) n_unmappable,
 round(count(*) FILTER (WHERE mapped=lang)/(count(*) FILTER (WHERE mapped=lang)+count(*) FILTER (WHERE mapped<>lang)),9) agree_fraction FROM j""")
def label_agreement(spark, sf):
    """Agreeing, differing and unmappable rows of a mapped label against the class."""
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    mapped = rows.withColumn("mapped", F.when(F.col("quality") == 1, "en"))
    return rounded(agreement(mapped, "mapped", "lang"), "agree_fraction")


@registry.add("""WITH j AS (SELECT d.lang, CASE WHEN quality=1 THEN 'en' ELSE NULL END AS mapped FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang, count(*) FILTER (WHERE mapped IS NULL) n_unmappable, count(*) n, round(count(*) FILTER (WHERE mapped IS NULL)/count(*),9) share FROM j
GROUP BY 1 HAVING count(*) FILTER (WHERE mapped IS NULL)>0""")
def unmappable_labels(spark, sf):
    """Rows per class whose label maps to nothing."""
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(unmappable(rows.withColumn("mapped", F.when(F.col("quality") == 1, "en")), "lang", "mapped", "lang"), "share")


@registry.add("""SELECT l_linenumber, count(*) n, round(avg(l_extendedprice),6) mean, round(stddev_pop(l_extendedprice),6) sd_population,
 round(stddev_samp(l_extendedprice),6) sd_sample, count(DISTINCT l_partkey) n_unique FROM lineitem GROUP BY 1""")
def scale_curve(spark, sf):
    """Mean and deviations along one axis, with unique rows per point."""
    out = curve(table(spark, sf, "lineitem"), ["l_linenumber"], "l_extendedprice",
                [F.count_distinct("l_partkey").alias("n_unique")])
    return out.select("l_linenumber", "n", "n_unique", *[F.round(c, 6).alias(c) for c in ("mean", "sd_population", "sd_sample")])


@registry.add("""SELECT l_returnflag AS corruption, l_linenumber AS severity, count(*) n, round(avg(l_tax),9) mean_entropy,
 round(avg(l_discount),9) mean_pass, round(stddev_pop(l_discount),9) sd_pass, round(avg(l_quantity/50),9) mean_balanced FROM lineitem GROUP BY 1,2""")
def corruption_cells(spark, sf):
    """Summary per (corruption, severity) cell."""
    cells = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("corruption"), F.col("l_linenumber").alias("severity"), F.col("l_tax").alias("entropy"),
        F.col("l_discount").alias("pass_rate"), (F.col("l_quantity") / 50).alias("balanced"))
    return rounded(corruption_summary(cells), "mean_entropy", "mean_pass", "sd_pass", "mean_balanced")


@registry.add("""SELECT d.lang, count(*) n, count(l.doc_id) n_found, count(*)-count(l.doc_id) n_missing
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def label_lookup(spark, sf):
    """Labels attached to documents, with the misses counted."""
    found = attach(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"], ["doc_id"])
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_found").alias("n_found"),
                                     F.count_if(~F.col("is_found")).alias("n_missing"))


@registry.add(f"""WITH p AS (SELECT regexp_replace(url,'^.*/','') AS name, {split_sql('page_id')} AS split FROM pages)
SELECT name FROM p WHERE split='training' INTERSECT SELECT name FROM p WHERE split='validation'""")
def page_name_overlap(spark, sf):
    """File names of pages that occur in both splits."""
    pages = table(spark, sf, "pages").select(basename(F.col("url")).alias("name"),
                                             split_by_digest(F.col("page_id"), "split", 7).alias("split"))
    return name_overlap(pages.where(F.col("split") == "training"), pages.where(F.col("split") == "validation"), ["name"])


QUERIES, SQL = registry.queries, registry.sql
