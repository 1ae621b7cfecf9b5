"""Cleaned splits, matched controls and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaksift.functions.digest import draw_index
from leaksift.operators.checks import cell_counts
from leaksift.operators.lookups import keep_keys, remove_keys, salted_lookup
from leaksift.operators.pairs import nearest_within
from leaksift.operators.splits import (add_unseen, capped_addon, composition_matched, displace_and_add,
                                       duplicate_cell, group_holdout, holdout_rows, held_in_sample, internal_leaks,
                                       leave_one_out_sizes, proportional_targets, random_subset, ratio_split,
                                       remove_internal_leaks, review_sample, shortfall, shuffle_labels,
                                       stratified_subset, swap_cell, threshold_splits, two_fold)
from leaksift.plans.cleaning import cleaned_arms
from leaksift.queries.base import (DOCS, RADIUS, WORDS, Registry, document_count, document_prints, ham, index_sql,
                                   table, train_and_held)

registry = Registry()


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source")


def _labelled(spark, sf):
    return keep_keys(_docs(spark, sf), table(spark, sf, "labels"), ["doc_id"])


def _rank_sql(seed, by="", key="doc_id"):
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY md5('{seed}:'||{key}), {key})"


def _annotated(spark, sf):
    train, held = train_and_held(document_prints(spark, sf))
    near = nearest_within(held, train, words=["fp2"], radius=RADIUS, rows=document_count(spark, sf),
                          ref_key="doc_id").select("fp2", "distance")
    return salted_lookup(held, near, ["fp2"], ["doc_id"], rows=document_count(spark, sf)).unionByName(
        train.withColumn("distance", F.lit(None).cast("int")))


_ANNOTATED = f"""{DOCS},
near AS (SELECT v.doc_id, min({ham('v.fp2', 't.fp2')}) distance FROM va v JOIN tr t ON bit_count(xor(v.fp2,t.fp2))<=6 GROUP BY 1),
items AS (SELECT d.*, n.distance FROM docs d LEFT JOIN near n USING (doc_id)),
kept AS (SELECT t::INTEGER AS threshold, i.* FROM items i, (SELECT unnest([6,2,0]) t)
         WHERE NOT coalesce(distance<=t AND source<>'src0', false))"""


@registry.add(f"{_ANNOTATED} SELECT threshold, split, lang, count(*) n FROM kept GROUP BY 1,2,3")
def dedup_split_counts(spark, sf):
    """Rows left per threshold, split and class when near copies are dropped outside one source."""
    kept = threshold_splits(_annotated(spark, sf), "distance", (6, 2, 0), F.col("source") != "src0")
    return cell_counts(kept, ["threshold", "split", "lang"])


@registry.add(f"""{_ANNOTATED},
nm AS (SELECT *, 'doc_'||(doc_id%300)::VARCHAR AS name FROM docs),
leak AS (SELECT doc_id FROM nm v WHERE split='validation' AND (EXISTS (SELECT 1 FROM nm t WHERE t.split='training' AND t.source=v.source AND t.name=v.name)
  OR EXISTS (SELECT 1 FROM nm t WHERE t.split='training' AND t.source=v.source AND t.fp2=v.fp2 AND t.fp3=v.fp3)))
SELECT split, source, count(*) n FROM kept WHERE threshold=6 AND doc_id NOT IN (SELECT doc_id FROM leak) GROUP BY 1,2""")
def dedup_plus_internal(spark, sf):
    """The threshold-6 split without rows that share a name or exact fingerprint with training."""
    items = _annotated(spark, sf).withColumn("name", F.concat(F.lit("doc_"), (F.col("doc_id") % 300).cast("string")))
    kept = threshold_splits(items, "distance", (6,), F.col("source") != "src0")
    leaks = internal_leaks(items, key="doc_id", name="name", words=WORDS, source="source",
                           rows=document_count(spark, sf))
    return cell_counts(remove_internal_leaks(kept, leaks, "doc_id"), ["split", "source"])


_ORDER = "row_number() OVER (PARTITION BY {by} ORDER BY md5('arms:{seed}:'||doc_id), doc_id)"


@registry.add(f"""{_ANNOTATED}, nm AS (SELECT *, 'doc_'||(doc_id%300)::VARCHAR AS name FROM docs),
leak AS (SELECT doc_id FROM nm v WHERE split='validation' AND (EXISTS (SELECT 1 FROM nm t WHERE t.split='training' AND t.source=v.source AND t.name=v.name)
  OR EXISTS (SELECT 1 FROM nm t WHERE t.split='training' AND t.source=v.source AND t.fp2=v.fp2 AND t.fp3=v.fp3))),
cl AS (SELECT doc_id, split, lang FROM kept WHERE threshold=6), s1 AS (SELECT split, count(*) t FROM cl GROUP BY 1), s2 AS (SELECT split, lang, count(*) t FROM cl GROUP BY 1,2),
rn AS (SELECT doc_id, split, lang, {_ORDER.format(by='split', seed='random')} r FROM docs), mt AS (SELECT doc_id, split, lang, {_ORDER.format(by='split, lang', seed='matched')} r FROM docs),
u AS (SELECT 'cleaned' AS arm, split, lang, doc_id FROM cl UNION ALL SELECT 'strict', split, lang, doc_id FROM cl WHERE doc_id NOT IN (SELECT doc_id FROM leak)
 UNION ALL SELECT 'random', split, lang, doc_id FROM rn JOIN s1 USING (split) WHERE r<=t UNION ALL SELECT 'matched', split, lang, doc_id FROM mt JOIN s2 USING (split, lang) WHERE r<=t)
SELECT arm, split, lang, count(*) n, sum(doc_id)::BIGINT id_sum FROM u GROUP BY 1,2,3""")
def cleaning_arms(spark, sf):
    """Cleaned, strict, random and composition-matched arms of one cleaning study."""
    items = _annotated(spark, sf).withColumn("name", F.concat(F.lit("doc_"), (F.col("doc_id") % 300).cast("string")))
    arms = cleaned_arms(items, key="doc_id", label="lang", source="source", split="split", distance="distance", name="name",
                        words=WORDS, threshold=RADIUS, restrict=F.col("source") != "src0", seed="arms",
                        rows=document_count(spark, sf))
    return arms.groupBy("arm", "split", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


@registry.add("""SELECT source, count(*) n FROM documents WHERE NOT (lang='en' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic=1)) GROUP BY 1""")
def restricted_removal(spark, sf):
    """Flagged keys removed from one class only."""
    flagged = table(spark, sf, "labels").where(F.col("toxic") == 1)
    return cell_counts(remove_keys(_docs(spark, sf), flagged, ["doc_id"], F.col("lang") == "en"), ["source"])


@registry.add(f"SELECT doc_id, lang FROM documents QUALIFY {_rank_sql('plain')}<=100")
def random_documents(spark, sf):
    """A fixed number of rows without replacement."""
    return random_subset(_docs(spark, sf), 100, "doc_id", "plain").select("doc_id", "lang")


@registry.add(f"""WITH t AS (SELECT lang, count(*) target FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1),
r AS (SELECT doc_id, lang, {_rank_sql('strata', 'lang')} r FROM documents)
SELECT doc_id, lang FROM r JOIN t USING (lang) WHERE r<=target""")
def stratified_documents(spark, sf):
    """As many documents per class as another table has."""
    targets = _labelled(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("target"))
    return stratified_subset(_docs(spark, sf), targets, "doc_id", ["lang"], "strata").select("doc_id", "lang")


_MATCHED = f"""WITH t AS (SELECT lang, count(*)//4+10 AS target FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1),
r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY (source<>'src7')::INTEGER, md5('matched:'||doc_id), doc_id) r FROM documents),
m AS (SELECT doc_id, lang, source FROM r JOIN t USING (lang) WHERE r<=target)"""


def _targets(spark, sf):
    return _labelled(spark, sf).groupBy("lang").agg(F.expr("count(1) div 4 + 10").alias("target"))


@registry.add(f"{_MATCHED} SELECT doc_id, lang, source FROM m")
def matched_documents(spark, sf):
    """Class targets filled from one source first and from the others after it."""
    return composition_matched(_docs(spark, sf), _targets(spark, sf), key="doc_id", label="lang", source="source",
                               preferred="src7", seed="matched").select("doc_id", "lang", "source")


@registry.add("""WITH t AS (SELECT lang, count(*)//4+10 AS target FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1),
g AS (SELECT lang, count(*) FILTER (WHERE source='src7') got FROM documents GROUP BY 1)
SELECT lang, target, got FROM t JOIN g USING (lang) WHERE got<target""")
def matched_shortfall(spark, sf):
    """Classes one source alone cannot fill."""
    return shortfall(_docs(spark, sf).where(F.col("source") == "src7"), _targets(spark, sf), "lang")


@registry.add(f"""WITH u AS (SELECT doc_id, lang, {_rank_sql('addon', 'lang')} r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, lang FROM u WHERE r<=20""")
def capped_addon_documents(spark, sf):
    """Labelled documents plus up to twenty unseen ones per class."""
    return capped_addon(_labelled(spark, sf), _docs(spark, sf), 20, "doc_id", "lang", "addon").select("doc_id", "lang")


@registry.add("""WITH c AS (SELECT lang, count(*) n FROM documents GROUP BY 1), t AS (SELECT lang, n, round_even(n*150/(SELECT sum(n) FROM c),0)::BIGINT target FROM c)
SELECT lang, target + CASE WHEN row_number() OVER (ORDER BY n DESC, lang)=1 THEN (150-(SELECT sum(target) FROM t))::BIGINT ELSE 0 END AS target FROM t""")
def proportional_allocation(spark, sf):
    """Class sizes in proportion, summing to 150 exactly."""
    return proportional_targets(_docs(spark, sf), "lang", 150)


_EMB = f"SELECT vec_id, label, {index_sql(4, chr(39) + 'source' + chr(39), 'vec_id')} AS g FROM embeddings"


@registry.add(f"""WITH e AS ({_EMB}),
a AS (SELECT vec_id, g, {_rank_sql('mix:to', 'g', 'vec_id')} p FROM e WHERE g<2),
b AS (SELECT label, g, {_rank_sql('mix:from', 'g', 'vec_id')} p FROM e WHERE g<2),
m AS (SELECT a.vec_id, b.label FROM a JOIN b USING (g, p))
SELECT e.vec_id, e.label, coalesce(m.label, e.label) AS shuffled FROM e LEFT JOIN m USING (vec_id)""")
def label_shuffle(spark, sf):
    """Labels permuted inside two groups, class counts kept."""
    items = table(spark, sf, "embeddings").select("vec_id", "label", draw_index(4, F.lit("source"), F.col("vec_id")).alias("g"))
    return shuffle_labels(items, "vec_id", "label", F.col("g") < 2, ["g"], "mix").select("vec_id", "label", "shuffled")


@registry.add(f"""WITH r AS (SELECT doc_id, {_rank_sql('ratio')} p, count(*) OVER () n FROM documents)
SELECT doc_id, CASE WHEN p<=floor(n*0.7+1e-9) THEN 'train' WHEN p<=floor(n*0.85+1e-9) THEN 'val' ELSE 'test' END AS part FROM r""")
def ratio_split_documents(spark, sf):
    """70/15/15 by seeded order."""
    return ratio_split(_docs(spark, sf).select("doc_id"), "doc_id", [("train", 0.7), ("val", 0.15), ("test", 0.15)], "ratio")


@registry.add("SELECT source, (SELECT count(*) FROM documents)-count(*) AS n_train, count(*) n_test FROM documents GROUP BY 1")
def leave_one_source_out(spark, sf):
    """Training and test size of every fold that holds one source out."""
    return leave_one_out_sizes(_docs(spark, sf), "source")


@registry.add("""SELECT source, lang, count(*) n FROM (SELECT source, lang FROM documents WHERE NOT (source='src1' AND lang='en')
 UNION ALL SELECT source, lang FROM documents WHERE source='src2' AND lang='fr') GROUP BY 1,2""")
def swapped_cell(spark, sf):
    """One (source, class) cell replaced by the rows of another."""
    docs = _docs(spark, sf)
    incoming = docs.where((F.col("source") == "src2") & (F.col("lang") == "fr"))
    return cell_counts(swap_cell(docs, (F.col("source") == "src1") & (F.col("lang") == "en"), incoming), ["source", "lang"])


_DROP = f"""WITH c AS (SELECT doc_id, {_rank_sql('{seed}')} r FROM documents WHERE source='src3' AND lang='en'), d AS (SELECT doc_id FROM c WHERE r<=3)"""


@registry.add(f"""{_DROP.format(seed='displace')}
SELECT doc_id, count(*) n FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d)
 UNION ALL SELECT doc_id FROM documents WHERE source='src5' AND lang='de') GROUP BY 1""")
def displaced_cell(spark, sf):
    """Three rows of a cell dropped, another cell appended."""
    docs = _docs(spark, sf)
    incoming = docs.where((F.col("source") == "src5") & (F.col("lang") == "de"))
    out = displace_and_add(docs, (F.col("source") == "src3") & (F.col("lang") == "en"), 3, incoming, "doc_id", "displace")
    return cell_counts(out, ["doc_id"])


@registry.add(f"""{_DROP.format(seed='twice')},
e AS (SELECT doc_id FROM documents WHERE source='src5' AND lang='en' QUALIFY {_rank_sql('twice:copy')}<=3)
SELECT doc_id, count(*) n FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT doc_id FROM e) GROUP BY 1""")
def duplicated_cell(spark, sf):
    """Three rows of a cell dropped and three of another repeated, size unchanged."""
    docs = _docs(spark, sf)
    out = duplicate_cell(docs, (F.col("source") == "src3") & (F.col("lang") == "en"),
                         (F.col("source") == "src5") & (F.col("lang") == "en"), "doc_id", "twice", 3)
    return cell_counts(out, ["doc_id"])


@registry.add(f"""WITH u AS (SELECT doc_id, lang, {_rank_sql('unseen')} r FROM documents WHERE lang='en' AND doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, lang FROM u WHERE r<=30""")
def unseen_addition(spark, sf):
    """Labelled documents plus thirty unseen rows of one class."""
    docs = _docs(spark, sf)
    return add_unseen(_labelled(spark, sf), docs.where(F.col("lang") == "en"), 30, "doc_id", "unseen").select("doc_id", "lang")


_HOLDOUT = """WITH c AS (SELECT user_id, event_type, count(*) nc FROM events GROUP BY 1,2),
s AS (SELECT user_id, sum(nc)::BIGINT n FROM c GROUP BY 1 HAVING sum(nc)>=4),
o AS (SELECT user_id, n, event_type, nc FROM s JOIN c USING (user_id) WHERE nc>=2),
g1 AS (SELECT user_id, n FROM o WHERE event_type='error' ORDER BY nc DESC, user_id LIMIT 1),
g2 AS (SELECT user_id, n FROM o WHERE event_type='purchase' AND user_id NOT IN (SELECT user_id FROM g1) ORDER BY nc DESC, user_id LIMIT 1),
ch AS (SELECT user_id, n, 0 AS step FROM g1 UNION ALL SELECT user_id, n, 1 FROM g2),
f AS (SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id) r FROM s WHERE user_id NOT IN (SELECT user_id FROM ch)),
h AS (SELECT user_id, n, step FROM ch UNION ALL SELECT user_id, n, 2 FROM f WHERE r<=5-(SELECT count(*) FROM ch))"""


@registry.add(f"{_HOLDOUT} SELECT user_id, n, step FROM h")
def user_holdout(spark, sf):
    """Five users to hold out: one per priority type, then the largest."""
    return group_holdout(table(spark, sf, "events"), group="user_id", label="event_type",
                         priority=("error", "purchase"), k=5, min_rows=4)


@registry.add(f"{_HOLDOUT} SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM h) THEN 'held_out' ELSE 'reduced' END AS part FROM events")
def user_holdout_rows(spark, sf):
    """Every event on its side of the held-out users."""
    return holdout_rows(table(spark, sf, "events"), user_holdout(spark, sf), "user_id", ["event_id"]).select("event_id", "part")


_PART = index_sql(10, "'part'", "vec_id")


@registry.add(f"""WITH e AS (SELECT label, {_PART} AS part FROM embeddings)
SELECT CASE WHEN part=0 THEN 'train' ELSE 'test' END AS role, label, count(*) n FROM e WHERE part IN (0,1) GROUP BY 1,2""")
def two_fold_counts(spark, sf):
    """Class counts of a train fold and a test fold."""
    items = table(spark, sf, "embeddings").select("label", draw_index(10, F.lit("part"), F.col("vec_id")).alias("part"))
    return cell_counts(two_fold(items, "part", 0, 1), ["role", "label"])


@registry.add(f"""SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
QUALIFY {_rank_sql('in')}<=(SELECT count(*) FROM labels WHERE toxic=1)""")
def held_in_documents(spark, sf):
    """As many labelled documents as there are flagged ones."""
    n = table(spark, sf, "labels").where(F.col("toxic") == 1).count()
    return held_in_sample(_labelled(spark, sf), n, "doc_id", "in").select("doc_id")


@registry.add(f"SELECT doc_id FROM labels WHERE quality=1 QUALIFY {_rank_sql('review')}<=200")
def review_documents(spark, sf):
    """Up to two hundred rows for review."""
    return review_sample(table(spark, sf, "labels").where(F.col("quality") == 1), "doc_id", "review").select("doc_id")


QUERIES, SQL = registry.queries, registry.sql
