"""Path, key, label, name and bit projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaksift.functions.bits import hamming, hamming_or_max, hex_word, popcount, word_hex
from leaksift.functions.keys import (basename, expand_root, group_key, hex_group_key, label_argmax, label_first,
                                     map_label, one_hot, partition_label, relative_key, resolve_path, scrub,
                                     scrub_all, slash_path, source_from_id, source_from_path, squash_name, stem,
                                     strip_suffixes, verified_group_key)
from leaksift.operators.checks import metric_status, without_drift
from leaksift.operators.lookups import filter_group
from leaksift.queries.base import Registry, split_sql, table
from leaksift.functions.digest import split_by_digest

registry = Registry()


@registry.add(r"""SELECT page_id, url AS clean, regexp_replace(url,'^.*/','') AS name, regexp_replace(regexp_replace(url,'^.*/',''),'(.)\.[^.]*$','\1') AS stem,
 CASE WHEN position('fr/' IN url)>0 THEN substr(url, position('fr/' IN url)) WHEN position('en/' IN url)>0 THEN substr(url, position('en/' IN url))
 ELSE regexp_replace(url,'^[./]+','') END AS rel FROM pages""")
def page_paths(spark, sf):
    """Slashes, file name, stem and relative key of page addresses written with backslashes."""
    path = F.translate("url", "/", "\\")
    return table(spark, sf, "pages").select(
        "page_id", slash_path(path).alias("clean"), basename(path).alias("name"), stem(path).alias("stem"),
        relative_key(path, ("fr/", "en/")).alias("rel"))


_RAW = """CASE doc_id%5 WHEN 0 THEN '/abs/'||lang||'/'||doc_id WHEN 1 THEN 'split_1/x/'||lang||'/'||doc_id WHEN 2 THEN 'kc/labelled_images/'||lang||'/'||doc_id
 WHEN 3 THEN 'labelled_images/'||doc_id ELSE 'training/'||lang||'/'||doc_id END"""


def _raw_path():
    part = lambda head: F.concat(F.lit(head), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"))
    kind = F.col("doc_id") % 5
    return (F.when(kind == 0, part("/abs/")).when(kind == 1, part("split_1/x/")).when(kind == 2, part("kc/labelled_images/"))
            .when(kind == 3, F.concat(F.lit("labelled_images/"), F.col("doc_id").cast("string"))).otherwise(part("training/")))


@registry.add("""SELECT doc_id, CASE doc_id%5 WHEN 0 THEN '/abs/'||lang||'/'||doc_id WHEN 1 THEN '/ref/'||lang||'/'||doc_id WHEN 2 THEN '/ref/'||lang||'/'||doc_id
 WHEN 3 THEN '/ref/'||doc_id ELSE '/data/training/'||lang||'/'||doc_id END AS path FROM documents""")
def resolved_paths(spark, sf):
    """Historical prefixes resolved to concrete roots."""
    return table(spark, sf, "documents").select("doc_id", resolve_path(
        _raw_path(), "/data", "/ref", "split_1/", ("kc/labelled_images/", "labelled_images/")).alias("path"))


@registry.add(f"""WITH p AS (SELECT doc_id, {_RAW} AS path FROM documents)
SELECT doc_id, CASE WHEN starts_with(path,'training/') THEN '/root/set/'||substr(path,10) ELSE path END AS path FROM p""")
def expanded_roots(spark, sf):
    """A placeholder prefix replaced by a root."""
    return table(spark, sf, "documents").select("doc_id", expand_root(_raw_path(), "training", "/root/set").alias("path"))


@registry.add("""SELECT page_id, CASE WHEN lower('/'||url) LIKE '%/fr/%' THEN 'FRENCH' WHEN lower('/'||url) LIKE '%/en/%' THEN 'ENGLISH' ELSE 'UNK' END AS source FROM pages""")
def page_sources(spark, sf):
    """Source by the folder in a path."""
    return table(spark, sf, "pages").select("page_id", source_from_path(F.col("url"), {"fr": "FRENCH", "en": "ENGLISH"}).alias("source"))


@registry.add("""WITH i AS (SELECT c_custkey, CASE c_custkey%3 WHEN 0 THEN c_mktsegment||c_custkey||'_x' WHEN 1 THEN '' ELSE lower(c_mktsegment)||'_x' END AS id FROM customer)
SELECT c_custkey, CASE WHEN id='' THEN 'MSK' WHEN regexp_matches(id,'^([A-Z]+)\\d*_') THEN regexp_extract(id,'^([A-Z]+)\\d*_',1) ELSE 'OTHER' END AS source FROM i""".replace("\\\\", "\\"))
def id_sources(spark, sf):
    """Source by the capitals an id starts with."""
    kind, key = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    item = (F.when(kind == 0, F.concat("c_mktsegment", key, F.lit("_x"))).when(kind == 1, "")
            .otherwise(F.concat(F.lower("c_mktsegment"), F.lit("_x"))))
    return table(spark, sf, "customer").select("c_custkey", source_from_id(item, "MSK").alias("source"))


@registry.add("""WITH f AS (SELECT doc_id, source, CASE doc_id%3 WHEN 0 THEN md5(source)[1:16]||'_'||doc_id||'.jpg' WHEN 1 THEN 'polyp-'||doc_id||'.jpg' ELSE 'plain' END AS name FROM documents)
SELECT doc_id, split_part(name,'_',1) AS group_key, regexp_extract(name,'^([0-9a-f]+)_',1) AS hex_key,
 CASE WHEN source IN ('src1') AND doc_id%3=0 THEN md5(source)[1:16] ELSE '' END AS verified FROM f""")
def document_group_keys(spark, sf):
    """Group keys read off file names: plain, hex only, and verified for one source."""
    kind, doc = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    name = (F.when(kind == 0, F.concat(F.substring(F.md5("source"), 1, 16), F.lit("_"), doc, F.lit(".jpg")))
            .when(kind == 1, F.concat(F.lit("polyp-"), doc, F.lit(".jpg"))).otherwise("plain"))
    return table(spark, sf, "documents").select(
        "doc_id", group_key(name).alias("group_key"), hex_group_key(name).alias("hex_key"),
        verified_group_key(name, F.col("source"), "src1", ("Polyp", "Foreign Body")).alias("verified"))


@registry.add("""SELECT doc_id, CASE WHEN toxic=1 THEN 'toxic' WHEN quality=1 THEN 'good' END AS first_label,
 CASE WHEN toxic=1 THEN 'toxic' WHEN quality=1 THEN 'good' ELSE 'none' END AS top_label,
 CASE WHEN toxic=1 THEN 1.0 ELSE 0.0 END::DOUBLE AS toxic, CASE WHEN toxic<>1 AND quality=1 THEN 1.0 ELSE 0.0 END::DOUBLE AS good FROM labels""")
def label_forms(spark, sf):
    """One-hot flags to a label by first flag and by argmax, and back."""
    flags = {"toxic": F.col("_t"), "good": F.col("_q")}
    rows = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("_t"), F.col("quality").alias("_q"))
    first = label_first(flags)
    return rows.select("doc_id", first.alias("first_label"), label_argmax(flags, "none").alias("top_label"),
                       *one_hot(first, ("toxic", "good")))


@registry.add("""SELECT vec_id, CASE label WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN NULL ELSE 'UNKNOWN' END AS name,
 CASE WHEN vec_id%10<7 THEN 'training' ELSE 'validation' END||'_'||label AS part FROM embeddings""")
def mapped_labels(spark, sf):
    """Fixed class map with a null target and a marker for unknown classes."""
    label = F.col("label").cast("string")
    split = F.when(F.col("vec_id") % 10 < 7, "training").otherwise("validation")
    return table(spark, sf, "embeddings").select(
        "vec_id", map_label(label, {"0": "zero", "1": "one", "2": None}, "UNKNOWN").alias("name"),
        partition_label(split, label).alias("part"))


@registry.add("""SELECT p_partkey, regexp_replace(lower(p_brand||' '||p_name),'[^a-z0-9]+','','g') AS squashed,
 CASE WHEN p_name LIKE '% ring' THEN regexp_replace(p_name,' ring$','') WHEN p_name LIKE '% widget' THEN regexp_replace(p_name,' widget$','') ELSE p_name END AS stripped FROM part""")
def part_names(spark, sf):
    """Names squashed for comparison, and with listed endings cut."""
    return table(spark, sf, "part").select(
        "p_partkey", squash_name(F.concat_ws(" ", "p_brand", "p_name")).alias("squashed"),
        strip_suffixes(F.col("p_name"), (" ring", " widget")).alias("stripped"))


@registry.add("""WITH h AS (SELECT doc_id, md5(text)[1:16] a, CASE WHEN doc_id%4=0 THEN NULL ELSE md5(source)[1:16] END AS b FROM documents),
w AS (SELECT doc_id, a, ((('0x'||a[1:8])::HUGEINT*4294967296+('0x'||a[9:16])::HUGEINT)) x, ((('0x'||b[1:8])::HUGEINT*4294967296+('0x'||b[9:16])::HUGEINT)) y FROM h)
SELECT doc_id, a AS hex_a, bit_count(x)::INTEGER AS ones, bit_count(xor(x,y))::INTEGER AS distance, coalesce(bit_count(xor(x,y))::INTEGER,64) AS distance_or_max FROM w""")
def digest_distances(spark, sf):
    """Hex digests as words: round trip, popcount and both readings of a missing one."""
    a = hex_word(F.substring(F.md5("text"), 1, 16))
    b = F.when(F.col("doc_id") % 4 != 0, hex_word(F.substring(F.md5("source"), 1, 16)))
    return table(spark, sf, "documents").select("doc_id", word_hex(a).alias("hex_a"), popcount(a).alias("ones"),
                                                hamming(a, b).alias("distance"), hamming_or_max(a, b).alias("distance_or_max"))


@registry.add(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text,'https?://\S+','<URL>','g'),'[0-9]+','<N>','g') AS text FROM conversations""")
def scrubbed_turns(spark, sf):
    """Ordered replacements over text."""
    return table(spark, sf, "conversations").select("conv_id", "turn", scrub(F.col("text"), ((r"https?://\S+", "<URL>"), ("[0-9]+", "<N>"))).alias("text"))


@registry.add(r"""SELECT event_id, regexp_replace(props::JSON->>'k','[0-9]+','N','g') AS k1, event_id AS n2,
 string_split(regexp_replace(event_type,'[0-9]+','N','g'),'e') AS parts, regexp_replace('a\'||event_id::VARCHAR,'[0-9]+','N','g') AS path FROM events""")
def scrubbed_values(spark, sf):
    """Replacements over every string of a nested value; numbers and names with digits stay."""
    kind = "k1 string, n2 bigint, parts array<string>, inner struct<path: string>"
    nested = F.struct(F.get_json_object("props", "$.k").alias("k1"), F.col("event_id").alias("n2"), F.split("event_type", "e").alias("parts"),
                      F.struct(F.concat(F.lit("a\\"), F.col("event_id").cast("string")).alias("path")).alias("inner"))
    rows = table(spark, sf, "events").select("event_id", scrub_all(nested, (("[0-9]+", "N"),), kind).alias("_v"))
    return rows.select("event_id", "_v.k1", "_v.n2", "_v.parts", "_v.inner.path")


@registry.add("""SELECT event_type, count(*) n FROM events WHERE event_type NOT IN ('error','signup') GROUP BY 1""")
def group_filter(spark, sf):
    """Rows outside a membership table; a member that matches nobody would be an error."""
    members = table(spark, sf, "events").select("event_type").distinct().where(F.col("event_type").isin("error", "signup"))
    kept = filter_group(table(spark, sf, "events").select("event_type"), members, "event_type")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@registry.add("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey%7=0 THEN NULL ELSE s_acctbal END a, CASE WHEN s_suppkey%5=0 THEN NULL WHEN s_suppkey%3=0 THEN s_acctbal+1 ELSE s_acctbal END b FROM supplier)
SELECT s_suppkey, CASE WHEN a IS NULL THEN 'excluded_no_official_score' WHEN b IS NULL THEN 'excluded_no_reproduction' WHEN abs(a-b)>1e-6 THEN 'excluded_known_drift' ELSE 'ok' END AS status FROM s""")
def score_status(spark, sf):
    """Which re-scored rows count and which are excluded; drift is known for suppliers divisible by three and would fail elsewhere."""
    key = F.col("s_suppkey")
    a = F.when(key % 7 != 0, F.col("s_acctbal"))
    b = F.when(key % 5 == 0, None).when(key % 3 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))
    rows = table(spark, sf, "supplier").select("s_suppkey", (key % 3).cast("string").alias("name"), a.alias("_a"), b.alias("_b"))
    status = metric_status(F.col("_a"), F.col("_b"), name=F.col("name"), allowed=["0"])
    return without_drift(rows.withColumn("status", status)).select("s_suppkey", "status")


@registry.add(f"""SELECT d.source, count(*) n FROM documents d JOIN labels l USING (doc_id) WHERE l.quality+l.toxic>0 AND d.source IN ('src1','src2','src3')
 AND {split_sql('d.doc_id')}='training' GROUP BY 1""")
def labelled_training_rows(spark, sf):
    """Source, split and non-empty-label filters together."""
    docs = table(spark, sf, "documents").where(F.col("source").isin("src1", "src2", "src3"))
    rows = docs.where(split_by_digest(F.col("doc_id"), "split", 7) == "training").join(table(spark, sf, "labels"), "doc_id")
    return rows.where(F.col("quality") + F.col("toxic") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


QUERIES, SQL = registry.queries, registry.sql
