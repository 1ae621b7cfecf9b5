"""Cascade, merging, reconciliation and contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaksift.functions.digest import split_by_digest
from leaksift.functions.keys import squash_name
from leaksift.operators.checks import (cell_counts, claims, concat_all, common_keys, contract, equal_claims, left_only_keys,
                                       long_form, metadata_agreement, preflight, provenance, scorecard,
                                       seed_status, strict_merge, tolerant_merge)
from leaksift.operators.lookups import majority_vote, manifest_check, priority_cascade, reconcile
from leaksift.operators.rates import duplicate_groups, rule_coverage
from leaksift.queries.base import (DOCS, Registry, document_count, document_digests, document_prints, rounded, split_sql, table,
                                   train_and_held)
from leaksift.session import materialise

registry = Registry()


def _cascade(spark, sf):
    prints = document_prints(spark, sf).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    items = (prints.withColumn("name", F.concat(F.lit("doc_"), (F.col("doc_id") % 300).cast("string")))
             .withColumn("size", F.expr("n_chars div 500")))
    train, held = train_and_held(items)
    votes = lambda *key: majority_vote(train.dropna(subset=list(key)), key, "lang", "vote")
    rules = {name: (votes(*key), key) for name, key in (
        ("filename", ("name",)), ("exact_pair", ("fp2", "fp3")), ("same_neighbour", ("fp3",)), ("same_group", ("source", "size")))}
    return priority_cascade(held, rules, ["doc_id"], "prior", rows=document_count(spark, sf))


def _votes_sql(name, key):
    return f"""{name} AS (SELECT {key}, vote FROM (SELECT {key}, lang AS vote, count(*) n FROM t GROUP BY {key}, lang)
 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, vote)=1)"""


_CASCADE = f"""{DOCS}, x AS (SELECT docs.*, 'doc_'||(doc_id%300) AS name, n_chars//500 AS size FROM docs JOIN documents d USING (doc_id, lang, source)),
t AS (SELECT * FROM x WHERE split='training'), {_votes_sql('v1', 'name')}, {_votes_sql('v2', 'fp2, fp3')}, {_votes_sql('v3', 'fp3')}, {_votes_sql('v4', 'source, size')},
c AS (SELECT x.doc_id, x.lang, coalesce(v1.vote,v2.vote,v3.vote,v4.vote) AS vote, CASE WHEN v1.vote IS NOT NULL THEN 'filename' WHEN v2.vote IS NOT NULL THEN 'exact_pair'
 WHEN v3.vote IS NOT NULL THEN 'same_neighbour' WHEN v4.vote IS NOT NULL THEN 'same_group' ELSE 'prior' END AS rule
 FROM x LEFT JOIN v1 ON x.name=v1.name LEFT JOIN v2 ON x.fp2=v2.fp2 AND x.fp3=v2.fp3 LEFT JOIN v3 ON x.fp3=v3.fp3
 LEFT JOIN v4 ON x.source=v4.source AND x.size=v4.size WHERE x.split='validation')"""


@registry.add(f"{_CASCADE} SELECT doc_id, vote, rule FROM c")
def trivial_cascade(spark, sf):
    """Label of every held-out row by the first of four training look-ups that knows it."""
    return _cascade(spark, sf).select("doc_id", "vote", "rule")


@registry.add(f"{_CASCADE} SELECT rule, count(*) n FROM c GROUP BY 1")
def cascade_coverage(spark, sf):
    """Rows per cascade rule."""
    return rule_coverage(_cascade(spark, sf), "rule")


@registry.add("""WITH a1 AS (SELECT doc_id AS path, md5(d.text) h FROM documents d), b1 AS (SELECT item_id AS path, md5(CASE WHEN item_id%3=0 THEN d.text ELSE b.text END) h FROM benchmark b LEFT JOIN documents d ON d.doc_id=item_id
 UNION ALL SELECT -1-item_id, md5(text) FROM benchmark)
SELECT path, CASE WHEN a.h IS NULL THEN 'missing' WHEN b.h IS NULL THEN 'unlisted' WHEN a.h=b.h THEN 'ok' ELSE 'mismatch' END AS status FROM a1 a FULL JOIN b1 b USING (path)""")
def manifest_reconcile(spark, sf):
    """Document digests against a manifest: some entries right, some wrong, some naming no document."""
    listing = document_digests(spark, sf).select(F.col("doc_id").alias("path"), "digest")
    items = materialise(table(spark, sf, "benchmark").select("item_id", F.md5("text").alias("own")))
    right = F.when(F.col("item_id") % 3 == 0, F.col("digest")).otherwise(F.col("own"))
    named = items.join(listing, F.col("path") == F.col("item_id"), "left").select(F.col("item_id").alias("path"), right.alias("digest"))
    absent = items.select((-1 - F.col("item_id")).alias("path"), F.col("own").alias("digest"))
    return manifest_check(listing, named.unionByName(absent), "path", "digest")


@registry.add("""WITH o AS (SELECT 'orders' AS claim, count(*)::DOUBLE v FROM orders UNION ALL SELECT 'mean_price', avg(o_totalprice) FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem),
e AS (SELECT 'orders' AS claim, count(DISTINCT o_orderkey)::DOUBLE v, 0.0::DOUBLE tol FROM orders UNION ALL SELECT 'mean_price', median(o_totalprice), 10.0 FROM orders UNION ALL SELECT 'absent', 1.0, 0.5)
SELECT claim, round(e.v,6) expected, e.tol AS tolerance, round(o.v,6) observed, coalesce(abs(o.v-e.v)<=e.tol, false) AS ok FROM e LEFT JOIN o USING (claim)""")
def table_claims(spark, sf):
    """Claims against observed values within a tolerance; a claim without a value fails."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    claim = lambda name, df, value: df.agg(F.lit(name).alias("claim"), value.cast("double").alias("value"))
    observed = (claim("orders", orders, F.count(F.lit(1))).unionByName(claim("mean_price", orders, F.avg("o_totalprice")))
                .unionByName(claim("lines", lines, F.count(F.lit(1)))))
    expected = (claim("orders", orders, F.count_distinct("o_orderkey")).withColumn("tolerance", F.lit(0.0))
                .unionByName(claim("mean_price", orders, F.median("o_totalprice")).withColumn("tolerance", F.lit(10.0)))
                .unionByName(orders.agg(F.lit("absent").alias("claim"), F.lit(1.0).alias("value")).withColumn("tolerance", F.lit(0.5))))
    out = claims(observed, expected)
    return out.select("claim", F.round("expected", 6).alias("expected"), "tolerance", F.round("observed", 6).alias("observed"), "ok")


@registry.add("""WITH o AS (SELECT 'lines' AS claim, count(*) v FROM lineitem UNION ALL SELECT 'orders', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM orders
 UNION ALL SELECT 'nations', count(DISTINCT c_nationkey) FROM customer),
e AS (SELECT 'lines' AS claim, max(l_linenumber)*count(DISTINCT l_orderkey) v FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customers', count(*) FROM customer
 UNION ALL SELECT 'nations', count(*) FROM nation UNION ALL SELECT 'regions', count(*) FROM region)
SELECT claim, e.v::BIGINT AS expected, o.v::BIGINT AS observed, e.v IS NOT DISTINCT FROM o.v AS ok FROM e LEFT JOIN o USING (claim)""")
def equal_table_claims(spark, sf):
    """Claims of exact equality: counts seen in one table against the size another gives; some hold, one is never observed."""
    lines, orders, customers = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    claim = lambda name, df, value: df.agg(F.lit(name).alias("claim"), value.cast("bigint").alias("value"))
    rows = F.count(F.lit(1))
    observed = concat_all([claim("lines", lines, rows), claim("orders", lines, F.count_distinct("l_orderkey")),
                           claim("customers", orders, F.count_distinct("o_custkey")), claim("nations", customers, F.count_distinct("c_nationkey"))])
    expected = concat_all([claim("lines", lines, F.max("l_linenumber") * F.count_distinct("l_orderkey")), claim("orders", orders, rows),
                           claim("customers", customers, rows), claim("nations", table(spark, sf, "nation"), rows),
                           claim("regions", table(spark, sf, "region"), rows)])
    return equal_claims(observed, expected)


@registry.add("""WITH a AS (SELECT source, lang, count(*) n FROM documents JOIN labels USING (doc_id) GROUP BY 1,2), e AS (SELECT source, lang, count(*) n FROM documents GROUP BY 1,2)
SELECT source, lang, coalesce(a.n,0) actual, e.n AS expected, coalesce(a.n,0)=e.n AS ok FROM e LEFT JOIN a USING (source, lang)""")
def cell_contract(spark, sf):
    """Labelled rows per (source, class) cell against all rows of the cell."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    labelled = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi")
    return contract(cell_counts(labelled, ["source", "lang"]), cell_counts(docs, ["source", "lang"]), ["source", "lang"])


@registry.add(f"""WITH s AS (SELECT {split_sql('doc_id')} AS split FROM documents), n AS (SELECT count(*) n FROM s),
a AS (SELECT split, count(*) n FROM s GROUP BY 1 UNION ALL SELECT '(all)', n FROM n),
e AS (SELECT 'training' AS split, n*7//10 AS n FROM n UNION ALL SELECT 'validation', n-n*7//10 FROM n UNION ALL SELECT '(all)', count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'test', n//20 FROM n)
SELECT split, coalesce(a.n,0)::BIGINT AS actual, coalesce(e.n,0)::BIGINT AS expected, coalesce(a.n,0)=coalesce(e.n,0) AS ok FROM a FULL JOIN e USING (split)""")
def row_contract(spark, sf):
    """Rows per split against the sizes it was planned with: seven tenths, three tenths, and a test split that was never cut."""
    docs = table(spark, sf, "documents").select("doc_id", split_by_digest(F.col("doc_id"), "split", 7).alias("split"))
    actual = cell_counts(docs, ["split"]).unionByName(docs.agg(F.lit("(all)").alias("split"), F.count(F.lit(1)).alias("n")))
    sized = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d"))
    train = F.expr("n * 7 div 10")
    planned = {"training": train, "validation": F.col("n") - train, "(all)": F.col("d"), "test": F.expr("n div 20")}
    expected = sized.select(F.inline(F.array(*[F.struct(F.lit(k).alias("split"), v.alias("n")) for k, v in planned.items()])))
    return contract(actual, expected, ["split"])


def _shards(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), (F.col("l_orderkey") % 10).alias("seed")).agg(
        F.count(F.lit(1)).alias("value"))
    return runs, runs.select("arm").distinct().join(spark.range(10).withColumnRenamed("id", "seed"), F.lit(True))


@registry.add("SELECT l_returnflag arm, l_orderkey%10 seed, CASE WHEN l_orderkey%10<5 THEN count(*) ELSE sum(l_linenumber) END::BIGINT AS value FROM lineitem GROUP BY 1,2")
def shard_merge(spark, sf):
    """Shards of two different runs merged; every arm needs each of ten seeds exactly once."""
    runs, expected = _shards(spark, sf)
    other = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), (F.col("l_orderkey") % 10).alias("seed")).agg(
        F.sum("l_linenumber").cast("bigint").alias("value"))
    return strict_merge([runs.where(F.col("seed") < 5), other.where(F.col("seed") >= 5)], expected, ["arm", "seed"])


@registry.add("""WITH r AS (SELECT l_returnflag arm, l_orderkey%10 seed FROM lineitem GROUP BY 1,2),
s AS (SELECT * FROM r WHERE seed<>3 UNION ALL SELECT * FROM r WHERE arm='A' AND seed=5 UNION ALL SELECT 'A', 12),
c AS (SELECT arm, seed, count(*) n FROM s GROUP BY 1,2), e AS (SELECT * FROM (SELECT DISTINCT arm FROM r), (SELECT unnest(range(10)) seed))
SELECT arm, seed, coalesce(c.n,0) n, CASE WHEN e.arm IS NULL THEN 'extra' WHEN c.n IS NULL THEN 'missing' WHEN c.n>1 THEN 'duplicate' ELSE 'ok' END AS status
FROM (SELECT arm, seed, 1 AS has FROM e) e0 JOIN e USING (arm, seed) FULL JOIN c USING (arm, seed)""")
def shard_status(spark, sf):
    """Missing, repeated and unexpected runs of incomplete shards."""
    runs, expected = _shards(spark, sf)
    keys = runs.select("arm", "seed")
    extra = keys.where((F.col("arm") == "A") & (F.col("seed") == 0)).withColumn("seed", F.lit(12).cast("bigint"))
    shards = keys.where(F.col("seed") != 3).unionByName(keys.where((F.col("arm") == "A") & (F.col("seed") == 5))).unionByName(extra)
    return seed_status(shards, expected, ["arm", "seed"])


@registry.add("""SELECT l_returnflag arm, l_orderkey%10 seed, count(*) + CASE WHEN (l_returnflag='A' AND l_orderkey%10<>4) OR l_returnflag='N' THEN 0 ELSE 1000 END AS value
FROM lineitem GROUP BY 1,2 HAVING NOT (l_returnflag='R' AND l_orderkey%10=7)""")
def tolerant_shards(spark, sf):
    """Incomplete shards filled from an earlier result that has other values and lacks a run itself."""
    runs, expected = _shards(spark, sf)
    earlier = runs.where(~((F.col("arm") == "R") & (F.col("seed") == 7))).withColumn("value", F.col("value") + 1000)
    return tolerant_merge([runs.where((F.col("arm") == "A") & (F.col("seed") != 4)), runs.where(F.col("arm") == "N")], earlier, expected, ["arm", "seed"])[0]


@registry.add("SELECT user_id, count(DISTINCT event_type) n_values, count(DISTINCT event_type)=1 AS ok FROM events GROUP BY 1")
def metadata_check(spark, sf):
    """Keys whose value is one and the same over all parts."""
    return metadata_agreement(table(spark, sf, "events"), "user_id", "event_type")


@registry.add("""SELECT 'texts' AS section, 'n_rows' AS metric, count(*)::DOUBLE AS value FROM documents UNION ALL
SELECT 'texts', 'extra_rows', (count(*)-count(DISTINCT md5(text)))::DOUBLE FROM documents UNION ALL SELECT 'labels', 'quality_mean', round(avg(quality),9) FROM labels UNION ALL SELECT 'labels', 'toxic_mean', round(avg(toxic),9) FROM labels""")
def audit_scorecard(spark, sf):
    """One long table out of several metric tables."""
    docs = duplicate_groups(document_digests(spark, sf).select("digest"), ["digest"])
    labels = table(spark, sf, "labels").agg(F.avg("quality").alias("quality_mean"), F.avg("toxic").alias("toxic_mean"))
    return rounded(scorecard({"texts": long_form(docs, ["n_rows", "extra_rows"]), "labels": long_form(labels, ["quality_mean", "toxic_mean"])}), "value")


@registry.add("""WITH r AS (SELECT lang AS kind, count(*) m FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1 UNION ALL SELECT 'xx', 1)
SELECT kind, coalesce(n,0) n, m AS minimum, coalesce(n,0)>=m AS ok FROM r LEFT JOIN (SELECT lang AS kind, count(*) n FROM documents GROUP BY 1) USING (kind)""")
def input_preflight(spark, sf):
    """Required kinds of input against a minimum; an absent kind counts as zero."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("kind"))
    labelled = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("minimum"))
    absent = docs.agg(F.lit("xx").alias("kind"), F.lit(1).cast("bigint").alias("minimum"))
    return preflight(docs, labelled.unionByName(absent))


@registry.add("SELECT md5(text) AS digest, doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))")
def untraced_results(spark, sf):
    """Digests of documents that no labelled document has."""
    docs = document_digests(spark, sf).select("digest", "doc_id")
    return provenance(docs, docs.join(table(spark, sf, "labels"), "doc_id", "left_semi"), "digest")


@registry.add("""WITH a AS (SELECT DISTINCT regexp_replace(lower(p_brand),'[^a-z0-9]+','','g') AS name FROM part WHERE p_size<25),
b AS (SELECT DISTINCT 'brand'||(s_suppkey%40) AS name FROM supplier)
SELECT name, CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN 'both' WHEN a.name IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side FROM a FULL JOIN b USING (name)""")
def entity_sides(spark, sf):
    """Names of two releases reconciled after squashing."""
    a = table(spark, sf, "part").where(F.col("p_size") < 25).select(squash_name(F.col("p_brand")).alias("name"))
    b = table(spark, sf, "supplier").select(squash_name(F.concat(F.lit("Brand #"), (F.col("s_suppkey") % 40).cast("string"))).alias("name"))
    return reconcile(a, b, ["name"])


_SPLIT_CUSTOMERS = f"WITH e AS (SELECT o_custkey, {split_sql('o_orderkey')} AS split FROM orders)"


def _split_customers(spark, sf):
    return train_and_held(table(spark, sf, "orders").select(
        "o_custkey", split_by_digest(F.col("o_orderkey"), "split", 7).alias("split")))


@registry.add(f"{_SPLIT_CUSTOMERS} SELECT o_custkey FROM e WHERE split='training' INTERSECT SELECT o_custkey FROM e WHERE split='validation'")
def shared_customers(spark, sf):
    """Customers with orders in both splits."""
    return common_keys(*_split_customers(spark, sf), ["o_custkey"])


@registry.add(f"{_SPLIT_CUSTOMERS} SELECT o_custkey FROM e WHERE split='training' EXCEPT SELECT o_custkey FROM e WHERE split='validation'")
def training_only_customers(spark, sf):
    """Customers whose every order is in training."""
    return left_only_keys(*_split_customers(spark, sf), ["o_custkey"])


QUERIES, SQL = registry.queries, registry.sql
