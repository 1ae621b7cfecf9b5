"""Column functions against plain Python."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leaksift.functions import bits, intervals, keys, vectors
from leaksift.operators.fingerprints import majority_word, normalised_words, shingle_words, text_fingerprints


def one(spark, column, **values):
    """Value of a column expression over one row of literals."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("out")).first().out


def resolve(path):
    return keys.resolve_path(F.lit(path), "/cv", "/ref", "split_1/", ("caps/labelled_images/", "labelled_images/"))


@pytest.mark.parametrize("path,want", [
    ("training\\Normal\\A\\frame.jpg", "/cv/training/Normal/A/frame.jpg"),
    ("split_1/ulcer/img001.jpg", "/ref/ulcer/img001.jpg"),
    ("caps/labelled_images/Ulcer/x.jpg", "/ref/Ulcer/x.jpg"),
    ("labelled_images/Ulcer/x.jpg", "/ref/Ulcer/x.jpg"),
    ("/abs/x.jpg", "/abs/x.jpg"),
])
def test_resolve_path(spark, path, want):
    assert one(spark, resolve(path)) == want


def test_malformed_path_is_an_error(spark):
    with pytest.raises(Exception, match="malformed"):
        one(spark, resolve("split_1/"))


def test_paths_and_keys(spark):
    f = lambda c: one(spark, c)
    assert f(keys.basename(F.lit("a\\b/c.jpg"))) == "c.jpg"
    assert f(keys.stem(F.lit("a/b.tar.gz"))) == "b.tar" and f(keys.stem(F.lit(".hidden"))) == ".hidden"
    assert f(keys.relative_key(F.lit("x/y/training/a.jpg"))) == "training/a.jpg"
    assert f(keys.relative_key(F.lit("./../a.jpg"))) == "a.jpg"
    assert f(keys.expand_root(F.lit("<ROOT>/Dataset/a"), "<ROOT>", "/r/Dataset")) == "/r/Dataset/a"
    assert f(keys.expand_root(F.lit("<ROOT>/a"), "<ROOT>", "/r")) == "/r/a"
    assert f(keys.hex_group_key(F.lit("0a1f_12.jpg"))) == "0a1f" and f(keys.hex_group_key(F.lit("Zx_1"))) == ""
    group = lambda n, s: f(keys.verified_group_key(F.lit(n), F.lit(s), "K", ("Foreign Body", "Polyp")))
    assert group("ABCDEF0123456789_1.jpg", "K") == "abcdef0123456789"
    assert group("ABCDEF0123456789_1.jpg", "L") == "" and group("foreignbody-1.jpg", "K") == ""
    assert f(keys.source_from_id(F.lit("BCN12_x"), "MSK")) == "BCN"
    assert f(keys.source_from_id(F.lit(""), "MSK")) == "MSK" and f(keys.source_from_id(F.lit("bcn_1"), "MSK")) == "OTHER"


def test_labels(spark):
    flags = lambda *v: dict(zip("abc", [F.lit(x) for x in v]))
    assert one(spark, keys.label_first(flags(0, 1, 1))) == "b" and one(spark, keys.label_first(flags(0, 0, 0))) is None
    assert one(spark, keys.label_argmax(flags(2, 2, 1))) == "a"
    assert one(spark, keys.label_argmax(flags(0, 0, 0))) is None and one(spark, keys.label_argmax(flags(0, 0, 0), "z")) == "z"


def test_bins_are_half_open_and_the_last_is_closed(spark):
    edges = (0, 3, 6, 10)
    label = lambda v: one(spark, keys.bin_label(F.lit(v), edges))
    assert [label(v) for v in (0, 2, 3, 6, 10)] == ["0,3", "0,3", "3,6", "6,10", "6,10"] and label(11) is None
    band = lambda v: one(spark, keys.band_label(F.lit(v), [(0, 0), (1, 2), (3, 4)]))
    assert [band(v) for v in (0, 2, 4, 5)] == ["0-0", "1-2", "3-4", "other"]


@pytest.mark.parametrize("value", [0, 1, 0xFFFFFFFFFFFFFFFF, 0x8000000000000000, 0x123456789ABCDEF0])
def test_hex_words(spark, value):
    text = f"{value:016x}"
    word = bits.hex_word(F.lit(text))
    assert one(spark, word) == bits.signed(value) and one(spark, bits.word_hex(word)) == text
    assert one(spark, bits.popcount(word)) == bin(value).count("1")


def test_missing_and_malformed_words(spark):
    assert one(spark, bits.hex_word(F.lit("xyz"))) is None
    missing = F.lit(None).cast("bigint")
    assert one(spark, bits.hamming(missing, F.lit(0).cast("bigint"))) is None
    assert one(spark, bits.hamming_or_max(missing, F.lit(0).cast("bigint"))) == 64


@pytest.mark.parametrize("z", [-40.0, -8.0, -1.96, 0.0, 0.5, 1.96, 5.0, 7.5, 20.0])
def test_normal_tail(spark, z):
    want = 0.5 * math.erfc(z / math.sqrt(2))
    assert one(spark, intervals.normal_tail(F.lit(z))) == pytest.approx(want, rel=1e-9, abs=1e-300)


@pytest.mark.parametrize("k,n,low,high", [(1381, 11581, 0.1134706, 0.1252760), (3, 25331, 4.0278e-05, 3.48177e-04), (0, 0, 0.0, 0.0)])
def test_wilson_published_values(spark, k, n, low, high):
    a, b = intervals.wilson(F.lit(k), F.lit(n))
    assert one(spark, a) == pytest.approx(low, rel=1e-4) and one(spark, b) == pytest.approx(high, rel=1e-4)


def test_two_proportion_published_value(spark):
    z = intervals.two_proportion_z(F.lit(1381), F.lit(11581), F.lit(3), F.lit(25331))
    assert one(spark, z) == pytest.approx(55.9043546, rel=1e-8)
    assert one(spark, intervals.two_proportion_z(F.lit(0), F.lit(5), F.lit(0), F.lit(5))) == math.inf
    assert one(spark, intervals.two_sided_p(F.lit(1.96))) == pytest.approx(2 * (1 - NormalDist().cdf(1.96)), rel=1e-9)


def test_collision_probability_published_value():
    assert intervals.collision_probability(6, 128) == pytest.approx(1.67484e-29, rel=1e-5)
    assert intervals.collision_probability(6, 128) * 626_704_218 == pytest.approx(1.0496e-20, rel=1e-4)


def test_vector_scores(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(20, 64)), rng.normal(size=(20, 64))
    a[0] = 5.0
    df = spark.createDataFrame(pd.DataFrame({"i": range(20), "a": list(a.tolist()), "b": list(b.tolist())}))
    got = df.select("i", vectors.ncc(F.col("a"), F.col("b")).alias("n"), vectors.cosine(F.col("a"), F.col("b")).alias("c"),
                    vectors.gradient_hash(F.col("a")).alias("d"), vectors.frequency_hash(F.col("a")).alias("p")).orderBy("i").toPandas()
    assert got.n[0] == 0.0
    np.testing.assert_allclose(got.n[1:], [np.corrcoef(x, y)[0, 1] for x, y in zip(a[1:], b[1:])], atol=1e-12)
    np.testing.assert_allclose(got.c, [x @ y / np.linalg.norm(x) / np.linalg.norm(y) for x, y in zip(a, b)], atol=1e-12)
    for i in range(20):
        want = sum(1 << j for j in range(64) if a[i][(j + 1) % 64] > a[i][j])
        assert got.d[i] == bits.signed(want)
        k, j = np.arange(64)[:, None], np.arange(64)[None, :]
        c = np.round((np.cos(np.pi * k * (2 * j + 1) / 128) * a[i]).sum(axis=1), 9)
        assert got.p[i] == bits.signed(sum(1 << int(q) for q in range(64) if c[q] > np.median(c)))


def test_text_fingerprints_edges(spark):
    rows = [(1, "One two three four"), (2, "one, TWO; three? four!"), (3, "one"), (4, " .. "), (5, None), (6, "ONE")]
    got = {r.id: (r.fp2, r.fp3) for r in text_fingerprints(spark.createDataFrame(rows, "id int, text string"), ["id"]).collect()}
    assert got[1] == got[2] and got[3] == got[6] and got[3][0] == got[3][1]
    assert got[4] == (None, None) and got[5] == (None, None)


def test_entropy_and_scrub(spark):
    got = one(spark, keys.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))))
    assert got == pytest.approx(math.log(2) - 1e-8 * math.log(1e-8), abs=1e-12)
    nested = F.struct(F.lit("/home/a/x").alias("p"), F.array(F.lit("/home/a/y")).alias("q"))
    out = one(spark, keys.scrub_all(nested, (("/home/a", "<ROOT>"),), "p string, q array<string>"))
    assert out.p == "<ROOT>/x" and out.q == ["<ROOT>/y"]


def test_scrub_changes_string_values_only(spark):
    kind = "k1 int, `a.2` string, m map<string,string>, s struct<t9: array<string>, d: double>, gone struct<x: string>"
    value = F.struct(F.lit(12).alias("k1"), F.lit('say "7" \\ 8').alias("a.2"), F.create_map(F.lit("key5"), F.lit("v5")).alias("m"),
                     F.struct(F.array(F.lit("1a"), F.lit(None).cast("string")).alias("t9"), F.lit(2.5).alias("d")).alias("s"),
                     F.lit(None).cast("struct<x: string>").alias("gone"))
    out = one(spark, keys.scrub_all(value, (("[0-9]+", "N"),), kind))
    assert out.k1 == 12 and out["a.2"] == 'say "N" \\ N' and out.m == {"key5": "vN"} and out.gone is None
    assert out.s.t9 == ["Na", None] and out.s.d == 2.5


def test_majority_words_of_a_whole_batch():
    import numpy as np

    from leaksift.operators.fingerprints import majority_words

    rng = np.random.default_rng(6)
    sizes = np.concatenate([rng.integers(0, 40, 300), [0, 1, 255, 256, 70_000, 0]])
    offsets = np.concatenate([[3], 3 + np.cumsum(sizes)])  # a sliced batch does not start at 0
    values = rng.integers(-2**63, 2**63 - 1, offsets[-1])
    got = majority_words(values, offsets)
    for a, b, word in zip(offsets, offsets[1:], got):
        bits = np.unpackbits(values[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) * 2 > b - a
        assert word == np.packbits(bits, bitorder="little").view(np.int64)[0]
    assert majority_words(values[:0], np.zeros(1, np.int64)).tolist() == []


def test_hashes_as_bytes_give_the_words_of_hashes_as_numbers(spark):
    texts = [None, "", "  ", "one", "one two", "a b c d e f g", "x " * 700, "Été über 12 naïve — words"] + [f"w{i} w{i % 7} v{i}" for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    assert text_fingerprints(rows.where("id = 3"), ["id"], digest="md5")._jdf.queryExecution().analyzed().toString().count("conv(") == 0
    for size in (1, 2, 3):
        words = normalised_words(F.col("text"))
        want = {r.id: r.w for r in rows.select("id", majority_word(shingle_words(words, size, "md5")).alias("w")).collect()}
        got = {r.id: r.w for r in text_fingerprints(rows, ["id"], families={"w": size}, digest="md5").collect()}
        assert got == want and got[0] is None and got[1] is None and got[3] is not None
