"""Vector fingerprints, perturbed copies, correlation and cosine checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaksift.functions.bits import word_hex
from leaksift.functions.digest import draw_index, sha256_digest
from leaksift.functions.keys import band_label
from leaksift.functions.vectors import centred_unit_vector, gradient_hash, plane_hash, unit_vector, vector_norm
from leaksift.operators.balls import ball_pairs, nearest
from leaksift.operators.fingerprints import distinct_fingerprints, perturbation_robustness, perturbed, vector_fingerprints
from leaksift.operators.pairs import flagged_fingerprints, pair_scores, random_non_matches
from leaksift.operators.rates import location_summary, threshold_counts
from leaksift.operators.skew import quota_sample, salted_lookup
from leaksift.queries.base import DOCS, Registry, ham, index_sql, kept, rounded, table
from leaksift.session import materialise
from leaksift.sources.scans import spread_input

registry = Registry()
SIZE = 64


def _vectors(spark, sf):
    return spread_input(table(spark, sf, "embeddings"), "vec_id")


def _dhash_sql(v):
    terms = [f"(CASE WHEN {v}[{(i + 1) % SIZE + 1}]>{v}[{i + 1}] THEN {-(1 << 63) if i == 63 else 1 << i} ELSE 0 END)::HUGEINT" for i in range(SIZE)]
    return "(" + " + ".join(terms) + ")::BIGINT"


def _bit_list_sql(bits):
    """A list of booleans as one signed word."""
    terms = [f"(CASE WHEN {bits}[{i + 1}] THEN {-(1 << 63) if i == 63 else 1 << i} ELSE 0 END)::HUGEINT" for i in range(SIZE)]
    return "(" + " + ".join(terms) + ")::BIGINT"


_COS = "list_transform(range(64), lambda k: round(list_sum(list_transform(range(64), lambda j: {v}[j+1]::DOUBLE*cos(pi()*k*(2*j+1)/128))),9))"


def _phash_cte(name, source, keys, v):
    return f"""{name}_c AS (SELECT {keys}, {_COS.format(v=v)} c FROM {source}),
{name}_b AS (SELECT {keys}, list_transform(c, lambda x: x > list_median(c)) b FROM {name}_c),
{name} AS (SELECT {keys}, {_bit_list_sql('b')} AS phash FROM {name}_b)"""


@registry.add(f"""WITH {_phash_cte('p', 'embeddings', 'vec_id', 'embedding')}
SELECT vec_id, {_dhash_sql('embedding')} AS dhash, phash FROM embeddings JOIN p USING (vec_id)""")
def vector_hashes(spark, sf):
    """Gradient and frequency hash of every vector."""
    return vector_fingerprints(_vectors(spark, sf), ["vec_id"])


_HEX = "lower(format('{:016x}', CASE WHEN d<0 THEN d::HUGEINT+18446744073709551616 ELSE d END))"


@registry.add(f"WITH h AS (SELECT vec_id, label, {_dhash_sql('embedding')} d FROM embeddings) SELECT vec_id, label, {_HEX} AS dhash_hex FROM h")
def vector_hash_hex(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", word_hex(gradient_hash(F.col("embedding"))).alias("dhash_hex"))


_SIGN = "CASE WHEN ('0x'||md5('planes:'||p||':'||i)[1:1])::INTEGER%2=1 THEN 1.0 ELSE -1.0 END::DOUBLE"
_PLANES = f"""sg AS (SELECT p, list({_SIGN} ORDER BY i) s FROM (SELECT unnest(range(256))::INTEGER p), (SELECT unnest(range(64))::INTEGER i) GROUP BY p),
pj AS (SELECT vec_id, p, round(list_sum(list_transform(range(1,65), lambda j: embedding[j]::DOUBLE*s[j])),9)>0 AS b FROM embeddings, sg),
wd AS (SELECT vec_id, p//64 AS w, sum(CASE WHEN b THEN (CASE WHEN p%64=63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT<<(p%64)) END) ELSE 0 END)::BIGINT AS x FROM pj GROUP BY 1,2),
wide AS (SELECT vec_id, max(x) FILTER (WHERE w=0) w0, max(x) FILTER (WHERE w=1) w1, max(x) FILTER (WHERE w=2) w2, max(x) FILTER (WHERE w=3) w3 FROM wd GROUP BY 1)"""


def _wide(df, key):
    words = plane_hash(F.col("_v"), SIZE)
    return df.withColumn("_w", words).select(*key, *[F.col("_w")[i].alias(f"w{i}") for i in range(4)])


@registry.add(f"""WITH {_PLANES} SELECT vec_id, w0, w1, w2, w3,
 round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))),9) quality FROM wide JOIN embeddings USING (vec_id)""")
def wide_hashes(spark, sf):
    """256-bit projection hash of every vector as four words, with the norm as quality."""
    items = _vectors(spark, sf).select("vec_id", F.col("embedding").alias("_v"), vector_norm(F.col("embedding")).alias("quality"))
    return rounded(_wide(items, ["vec_id", "quality"]), "quality")


def _copy_planes(steps):
    """CTEs ending in ``copy``: wide hashes of vectors rounded to a ``steps``-th."""
    copied = f"(SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE*{steps})/{steps}) v FROM embeddings)"
    cte = (_PLANES.replace("embedding[j]::DOUBLE", "v[j]").replace("FROM embeddings, sg", f"FROM {copied}, sg").replace("pj AS", "pj2 AS")
           .replace("FROM pj ", "FROM pj2 ").replace("wd AS", "wd2 AS").replace("FROM wd ", "FROM wd2 ").replace("wide AS", "copy AS"))
    return cte[cte.index("pj2 AS"):]


_GAP = "+".join(f"bit_count(xor(c.w{i},o.w{i}))::INTEGER" for i in range(4))


WIDE = [f"w{i}" for i in range(4)]
WIDE_RADIUS = 50


def _wide_sides(spark, sf, steps):
    """Wide hashes of the vectors and of copies rounded to a ``steps``-th."""
    base = _vectors(spark, sf).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("_v"))
    copies = base.withColumn("_v", F.transform("_v", lambda x: F.round(x * steps) / steps))
    return materialise(_wide(base, ["vec_id"])), materialise(_wide(copies, ["vec_id"]))


@registry.add(f"""WITH {_PLANES}, {_copy_planes(90)}, d AS (SELECT c.vec_id, o.vec_id AS near, ({_GAP})::INTEGER AS distance FROM copy c, wide o)
SELECT vec_id, min(distance) AS distance, arg_min(near, distance::BIGINT*1000000000+near) AS nearest FROM d GROUP BY 1""")
def wide_nearest(spark, sf):
    """Nearest original of lightly quantised copies over 256-bit hashes, however far."""
    originals, changed = _wide_sides(spark, sf, 90)
    near = nearest(changed, originals, words=WIDE, rows=originals.count(), ref_key="vec_id")
    return salted_lookup(changed, near, WIDE, ["vec_id"]).select("vec_id", "distance", "nearest")


_ROUGH = f"WITH {_PLANES}, {_copy_planes(6)}, pr AS (SELECT c.vec_id, o.vec_id AS original, ({_GAP})::INTEGER AS distance FROM copy c, wide o WHERE {_GAP}<={WIDE_RADIUS})"


def _rough_pairs(spark, sf):
    """Distinct hashes of rough copies and of originals within 50 of 256 bits, with their counts."""
    originals, changed = _wide_sides(spark, sf, 6)
    left, right = (materialise(distinct_fingerprints(side, WIDE)) for side in (changed, originals))
    return changed, originals, ball_pairs(left, right, words=WIDE, radius=WIDE_RADIUS, rows=originals.count())


@registry.add(f"{_ROUGH} SELECT vec_id, original, distance FROM pr")
def wide_pairs(spark, sf):
    """Rough copies and originals within 50 of 256 bits, by balls with a threshold per part."""
    changed, originals, pairs = _rough_pairs(spark, sf)
    a = changed.select("vec_id", *[F.col(w).alias(f"{w}_a") for w in WIDE])
    b = originals.select(F.col("vec_id").alias("original"), *[F.col(w).alias(f"{w}_b") for w in WIDE])
    return (pairs.join(a, [f"{w}_a" for w in WIDE]).join(b, [f"{w}_b" for w in WIDE]).select("vec_id", "original", "distance"))


@registry.add(f"""{_ROUGH}, m AS (SELECT vec_id, min(distance) d FROM pr GROUP BY 1)
SELECT label, t::INTEGER AS threshold, count(*) n, count(*) FILTER (WHERE d<=t) k, round(count(*) FILTER (WHERE d<=t)/count(*),9) rate
FROM embeddings LEFT JOIN m USING (vec_id), (SELECT unnest([20,30,40,50]) t) GROUP BY 1,2""")
def wide_leak_by_label(spark, sf):
    """Rough copies with an original within 20 to 50 of 256 bits, per label."""
    changed, _, pairs = _rough_pairs(spark, sf)
    least = pairs.groupBy(*[F.col(f"{w}_a").alias(w) for w in WIDE]).agg(F.min("distance").alias("distance"))
    marked = salted_lookup(changed, least, WIDE, ["vec_id"]).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    counted = threshold_counts(marked, "distance", (20, 30, 40, WIDE_RADIUS), ["label"], intervals=False)
    return rounded(counted.select("label", "threshold", "n", "k", "rate"), "rate")


_COPY = "list_transform(embedding, lambda x: round(x::DOUBLE*40)/40)"
_COPIES = f"""WITH o AS (SELECT vec_id, label, {_dhash_sql('embedding')} AS dhash FROM embeddings),
c AS (SELECT vec_id, label, {_COPY} v FROM embeddings), q AS (SELECT vec_id, label, {_dhash_sql('v')} AS dhash FROM c)"""


def _copies(spark, sf):
    """Originals and quantised copies of every vector with their gradient hash."""
    def build():
        base = _vectors(spark, sf).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("_v"))
        return base.select("vec_id", "label", gradient_hash(F.col("_v")).alias("original"),
                           gradient_hash(F.transform("_v", lambda x: F.round(x * 40) / 40)).alias("copy"))

    both = kept(spark, sf, "copies", build, of="embeddings")
    return (both.select("vec_id", "label", F.col("original").alias("dhash")),
            both.select("vec_id", "label", F.col("copy").alias("dhash")))


@registry.add(f"""{_COPIES}, d AS (SELECT q.vec_id, q.label, min({ham('q.dhash', 'o.dhash')}) d FROM q, o GROUP BY 1,2)
SELECT q.vec_id, q.label, d.d AS distance, (SELECT min(o.vec_id) FROM o WHERE bit_count(xor(q.dhash,o.dhash))=d.d) AS nearest FROM q LEFT JOIN d USING (vec_id)""")
def nearest_original(spark, sf):
    """Nearest original of every quantised copy, however far."""
    original, copy = _copies(spark, sf)
    near = nearest(copy, original, words=["dhash"], rows=table(spark, sf, "embeddings").count(), ref_key="vec_id")
    return salted_lookup(copy, near, ["dhash"], ["vec_id"]).select("vec_id", "label", "distance", "nearest")


@registry.add(f"""{_COPIES}, d AS (SELECT q.label, q.vec_id, min({ham('q.dhash', 'o.dhash')}) d FROM q, o GROUP BY 1,2)
SELECT label, count(*) n_rows, count(d) n, min(d) AS min, max(d) AS max, round(avg(d),9) mean, median(d)::DOUBLE p50 FROM d GROUP BY 1""")
def nn_hamming_by_label(spark, sf):
    """Distance of the quantised copies to their nearest original, however far, per label."""
    original, copy = _copies(spark, sf)
    near = nearest(copy, original, words=["dhash"], rows=table(spark, sf, "embeddings").count(), ref_key="vec_id")
    joined = salted_lookup(copy, near, ["dhash"], ["vec_id"])
    sizes = joined.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    out = sizes.join(location_summary(joined, "distance", ["label"]), "label")
    return rounded(out.select("label", "n_rows", "n", "min", "max", "mean", "p50"), "mean")


_MODE = f"""{_COPIES}, {_phash_cte('po', 'embeddings', 'vec_id', 'embedding')}, {_phash_cte('pq', 'c', 'vec_id', 'v')},
oo AS (SELECT o.vec_id, dhash, phash FROM o JOIN po USING (vec_id)), qq AS (SELECT q.vec_id, dhash, phash FROM q JOIN pq USING (vec_id))"""


@registry.add(f"""{_MODE} SELECT 'additive' AS mode, count(*) k FROM qq WHERE EXISTS (SELECT 1 FROM oo WHERE bit_count(xor(qq.dhash,oo.dhash))+bit_count(xor(qq.phash,oo.phash))<=6)
UNION ALL SELECT 'same_row', count(*) FROM qq WHERE EXISTS (SELECT 1 FROM oo WHERE bit_count(xor(qq.dhash,oo.dhash))<=6 AND bit_count(xor(qq.phash,oo.phash))<=6)
UNION ALL SELECT 'independent', count(*) FROM qq WHERE EXISTS (SELECT 1 FROM oo WHERE bit_count(xor(qq.dhash,oo.dhash))<=6) AND EXISTS (SELECT 1 FROM oo WHERE bit_count(xor(qq.phash,oo.phash))<=6)""")
def vector_flag_modes(spark, sf):
    """Quantised copies flagged under each reading of the joint threshold."""
    base = _vectors(spark, sf).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    copies = base.withColumn("embedding", F.transform("embedding", lambda x: F.round(x * 40) / 40))
    original = materialise(vector_fingerprints(base, ["vec_id"]))
    changed = materialise(vector_fingerprints(copies, ["vec_id"]))
    words, rows, out = ["dhash", "phash"], original.count(), None
    for mode in ("additive", "same_row", "independent"):
        hit = flagged_fingerprints(changed, original, mode, words=words, radius=6, rows=rows, ref_key="vec_id")
        part = changed.join(hit, words, "left_semi").agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("k"))
        out = part if out is None else out.unionByName(part)
    return out.select("mode", "k")


def _picked(at):
    """The entries of ``e`` that a rule names by position ``i``."""
    return f"list_transform(range({SIZE}), lambda i: e[({at})::INTEGER+1])"


def _changed_sql():
    """Every vector under every change."""
    kinds = {f"crop{p}": _picked(f"{(SIZE - SIZE * p // 100) // 2}+least({SIZE * p // 100 - 1}, i*{SIZE * p // 100}//{SIZE})") for p in (90, 75, 60)}
    kinds |= {f"shift{n}": _picked(f"(i+{n})%{SIZE}") for n in (1, 2, 4)}
    kinds |= {f"quant{n}": f"list_transform(e, lambda x: round(x*{n})/{n})" for n in (90, 40, 10)}
    kinds |= {name: _picked(f"least({SIZE - 1}, ((i*{n}//{SIZE})*{SIZE})//{n})") for name, n in (("half", SIZE // 2), ("double", SIZE * 2))}
    return " UNION ALL ".join(f"SELECT vec_id, '{name}' AS transform, {v} AS v FROM o" for name, v in kinds.items())


@registry.add(f"""WITH o AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), c AS ({_changed_sql()}),
{_phash_cte('po', 'o', 'vec_id', 'e')}, {_phash_cte('pc', 'c', 'vec_id, transform', 'v')},
h AS (SELECT transform, {ham('po.phash', 'pc.phash')} p, {ham('a', 'b')} d FROM (SELECT vec_id, {_dhash_sql('e')} a FROM o) JOIN po USING (vec_id)
 JOIN (SELECT vec_id, transform, {_dhash_sql('v')} b FROM c) USING (vec_id) JOIN pc USING (vec_id, transform))
SELECT transform, count(*) n, round(avg(p),9) phash_mean, median(p)::DOUBLE phash_median, max(p) phash_max, round(avg(d),9) dhash_mean, median(d)::DOUBLE dhash_median,
 max(d) dhash_max, round(avg((p<=6 AND d<=6)::INTEGER),9) share_le6, round(avg((p<=2 AND d<=2)::INTEGER),9) share_le2 FROM h GROUP BY 1""")
def perturbation_table(spark, sf):
    """Hash distance under eleven perturbations of every vector."""
    out = perturbation_robustness(_vectors(spark, sf), "vec_id", "embedding", SIZE)
    return rounded(out, "phash_mean", "dhash_mean", "share_le6", "share_le2")


@registry.add(f"""WITH s AS (SELECT vec_id, embedding e FROM embeddings QUALIFY row_number() OVER (ORDER BY md5('fifty:'||vec_id), vec_id)<=50),
c AS (SELECT vec_id, e, list_transform(e, lambda x: round(x::DOUBLE*10)/10) v FROM s), h AS (SELECT {_dhash_sql('e')} a, {_dhash_sql('v')} b FROM c)
SELECT 'quant10' AS transform, count(*) n, round(avg({ham('a', 'b')}),9) mean, max({ham('a', 'b')}) AS max FROM h""")
def perturbation_sample(spark, sf):
    """One perturbation over a seeded sample of fifty vectors."""
    sample = quota_sample(table(spark, sf, "embeddings"), 50, ["vec_id"], seed="fifty")
    changed = perturbed(sample, "vec_id", "embedding", SIZE).where(F.col("transform") == "quant10")
    distance = F.bit_count(gradient_hash(F.col("original")).bitwiseXOR(gradient_hash(F.col("changed"))))
    return rounded(changed.groupBy("transform").agg(F.count(F.lit(1)).alias("n"), F.avg(distance).alias("mean"),
                                                    F.max(distance).alias("max")), "mean")


_PARTNER = index_sql("n", "'partner'", "vec_id")
_PAIRS = f"""num AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id)-1 AS at, count(*) OVER () n FROM embeddings),
pr AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding ea, b.embedding eb, a.label FROM num a JOIN num b ON b.vec_id={_PARTNER.replace('vec_id', 'a.vec_id').replace('(n)', '(a.n)')})"""


def _pairs(spark, sf):
    """Every vector with a seeded partner; vec_id runs from 0."""
    items = table(spark, sf, "embeddings").select("vec_id", "label")
    size = items.agg(F.count(F.lit(1)).alias("_n"))
    return items.join(size, F.lit(True)).select(
        F.col("vec_id").alias("a"), draw_index(F.col("_n"), F.lit("partner"), F.col("vec_id")).alias("b"), "label")


_COSINE = "list_sum(list_transform(range(1,65), lambda i: ea[i]::DOUBLE*eb[i]::DOUBLE))/sqrt(list_sum(list_transform(ea, lambda x: x::DOUBLE*x::DOUBLE))*list_sum(list_transform(eb, lambda x: x::DOUBLE*x::DOUBLE)))"


@registry.add(f"WITH {_PAIRS} SELECT a, b, label, round({_COSINE},9) AS score, 64::INTEGER AS vector_length FROM pr")
def cosine_pairs(spark, sf):
    """Cosine of every vector and its partner; unit vectors are made once per item."""
    units = _vectors(spark, sf).select("vec_id", unit_vector(F.col("embedding")).alias("unit"))
    out = pair_scores(_pairs(spark, sf), units, left="a", right="b", key="vec_id")
    return rounded(out.select("a", "b", "label", "score", "vector_length"), "score")


_NCC = """cen AS (SELECT a, b, label, list_transform(ea, lambda x: x::DOUBLE-list_avg(list_transform(ea, lambda y: y::DOUBLE))) ea,
 list_transform(eb, lambda x: x::DOUBLE-list_avg(list_transform(eb, lambda y: y::DOUBLE))) eb FROM pr)"""


@registry.add(f"""WITH {_PAIRS}, {_NCC}, s AS (SELECT label, {_COSINE} AS v FROM cen)
SELECT CASE WHEN label BETWEEN 0 AND 2 THEN '0-2' WHEN label BETWEEN 3 AND 6 THEN '3-6' ELSE 'other' END AS band, count(*) n, round(avg(v),9) mean,
 round(median(v),9) p50, round(quantile_cont(v,0.95),9) p95, round(avg((v>=0.1)::INTEGER),9) share_ge_0_1 FROM s GROUP BY 1""")
def ncc_band_summary(spark, sf):
    """Correlation of every vector and its partner per band, verified through the vectors themselves."""
    units = _vectors(spark, sf).select("vec_id", centred_unit_vector(F.col("embedding")).alias("unit"))
    scored = pair_scores(_pairs(spark, sf), units, left="a", right="b", key="vec_id")
    banded = scored.withColumn("band", band_label(F.col("label"), [(0, 2), (3, 6)]))
    out = location_summary(banded, "score", ["band"], (0.1,))
    return rounded(out.select("band", "n", "mean", "p50", "p95", "share_ge_0_1"), "mean", "p50", "p95", "share_ge_0_1")


@registry.add(f"""WITH m AS (SELECT vec_id, (vec_id+1)%(SELECT count(*) FROM embeddings) AS matched FROM embeddings),
ni AS (SELECT vec_id, matched, row_number() OVER (ORDER BY md5('neg:'||vec_id), vec_id) p, count(*) OVER () n FROM m),
nr AS (SELECT vec_id AS ref, row_number() OVER (ORDER BY md5('neg:'||vec_id), vec_id) p, count(*) OVER () n FROM embeddings),
d AS (SELECT draw, {index_sql('n', "'neg:item'", 'draw')}+1 AS i, {index_sql('n', "'neg:ref'", 'draw')} AS r, n FROM (SELECT unnest(range(200)) draw), (SELECT count(*) n FROM m)),
x AS (SELECT draw, vec_id, matched, r, d.n, a.ref f, b.ref s FROM d JOIN ni ON ni.p=d.i JOIN nr a ON a.p=r+1 JOIN nr b ON b.p=(r+1)%d.n+1)
SELECT draw, vec_id, CASE WHEN f<>matched THEN f ELSE s END AS ref FROM x""")
def random_negatives(spark, sf):
    """Two hundred seeded pairs, none of them a match."""
    items = table(spark, sf, "embeddings").select("vec_id")
    size = items.agg(F.count(F.lit(1)).alias("_n"))
    matches = items.join(size, F.lit(True)).select("vec_id", ((F.col("vec_id") + 1) % F.col("_n")).alias("matched"))
    return random_non_matches(matches, items.withColumnRenamed("vec_id", "ref"), 200, item="vec_id", matched="matched",
                              ref_key="ref", seed="neg")


@registry.add("SELECT page_id, sha256(html) AS digest, md5(html) AS md5, strlen(html)::INTEGER AS size FROM pages")
def content_digests(spark, sf):
    return table(spark, sf, "pages").select("page_id", sha256_digest(F.col("html")).alias("digest"), F.md5("html").alias("md5"),
                                            F.octet_length("html").alias("size"))


@registry.add(f"""{DOCS}, m AS (SELECT fp2, fp3, min(doc_id) f FROM tr GROUP BY 1,2), p AS (SELECT v.doc_id a, f b FROM va v JOIN m USING (fp2,fp3))
SELECT a, b, x.text=y.text AS identical FROM p JOIN documents x ON x.doc_id=a JOIN documents y ON y.doc_id=b""")
def identical_matches(spark, sf):
    """Whether an exact fingerprint match is also byte-identical."""
    from leaksift.operators.lookups import exact_matches
    from leaksift.queries.base import WORDS, document_count, document_digests, document_prints, train_and_held

    train, held = train_and_held(document_prints(spark, sf))
    found = exact_matches(held, train, on=WORDS, item="doc_id", ref_key="doc_id", group="source",
                          rows=document_count(spark, sf)).select(
        F.col("doc_id").alias("a"), F.col("first_match").alias("b"))
    # Digests and sizes are joined, not texts; copies of one text share their match, so it is looked up split.
    docs = document_digests(spark, sf)
    left = docs.select(F.col("doc_id").alias("a"), F.col("digest").alias("_dx"), F.col("size").alias("_sx"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("digest").alias("_dy"), F.col("size").alias("_sy"))
    same = (F.col("_dx") == F.col("_dy")) & (F.col("_sx") == F.col("_sy"))
    return salted_lookup(found.join(left, "a"), right, ["b"], ["a"], "inner").select("a", "b", same.alias("identical"))


QUERIES, SQL = registry.queries, registry.sql
