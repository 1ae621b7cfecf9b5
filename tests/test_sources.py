"""Scans and sinks over small files written by the test."""

import json

import pytest
from pyspark.sql import functions as F

from leaksift.sources import scans, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_manifest_and_listing(spark, tmp_path):
    train = write(tmp_path / "t.csv", "image_path,Dataset,Normal,Ulcer\ntraining\\a.jpg,K,1,0\ntraining\\b.jpg,K,0,1\n")
    val = write(tmp_path / "v.csv", "image_path,Dataset,Normal,Ulcer\nvalidation/c.jpg,L,1,0\n")
    rows = scans.read_manifest(spark, {"training": train, "validation": val}, ("Normal", "Ulcer"))
    assert {(r.image_path, r.split, r.Ulcer) for r in rows.collect()} == {
        ("training/a.jpg", "training", 0), ("training/b.jpg", "training", 1), ("validation/c.jpg", "validation", 0)}
    listing = spark.createDataFrame([("training/a.jpg",)], "path string")
    assert scans.read_manifest(spark, {"training": train}, ("Normal", "Ulcer"), listing).count() == 1
    assert scans.class_columns(["x", "Ulcer"], ("Normal", "Ulcer")) == ["Ulcer"]


def test_class_folders_first_path_wins(spark, tmp_path):
    for folder in ("b", "a"):
        write(tmp_path / folder / "same.txt", folder)
    write(tmp_path / "b" / "other.txt", "x")
    got = {r.filename: r["class"] for r in scans.list_classes(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"same.txt": "a", "other.txt": "b"}
    digests = {r.path.rsplit("/", 2)[-2:][0] + "/" + r.path.rsplit("/", 1)[-1]: r.digest for r in scans.file_digests(spark, str(tmp_path)).collect()}
    assert len(set(digests.values())) == 3


def test_fingerprint_cache_is_keyed_by_content(spark, tmp_path):
    path = str(tmp_path / "cache")
    cached = spark.createDataFrame([(1, "d1"), (2, "d2")], "id int, digest string")
    sinks.append_fingerprints(cached, path)
    now = spark.createDataFrame([(1, "d1"), (2, "changed")], "id int, digest string")
    todo = scans.missing_fingerprints(now, spark.read.parquet(path), "id", "digest")
    assert [tuple(r) for r in todo.collect()] == [(2, "changed")]


def test_annotations(spark, tmp_path):
    head = "source,partition,cv_dataset,cv_split,filename,path,phash,dhash,min_phash_dist_to_ref,min_dhash_dist_to_ref,nearest_ref_file\n"
    schema = scans.annotation_schema("ref")
    one = write(tmp_path / "a.csv", head + "s,p,K,training,x.jpg,training/x.jpg,00,00,1,2,n.jpg\n")
    two = write(tmp_path / "b.csv", head + "s,p,L,training,x.jpg,training/x.jpg,00,00,3,4,m.jpg\n")
    rows = scans.read_annotations(spark, [one, two, str(tmp_path / "absent.csv")], schema)
    unique, surplus = scans.unique_annotations(rows, ["path"])
    assert unique.first().cv_dataset == "K" and surplus.first().duplicate_rows == 1
    with pytest.raises(FileNotFoundError):
        scans.read_annotations(spark, [str(tmp_path / "absent.csv")], schema)


def test_run_records_of_both_schema_versions(spark, tmp_path):
    def record(name, value):
        last = {"orig_val": {"acc": 0.5, name: value, "n_test": 10, "per_class": {"Ulcer": {"recall": None, "n": 0}},
                             "per_source": {"K": {"n": 4, "bal_acc": 0.25, "acc": 0.5}}}}
        return {"args": {"lr": "1"}, "meta": {}, "runs": [{"seed": 3, "history": [{"epoch": 1, "loss": 2.0, "bal_acc": 0.1}], "last": last}]}

    write(tmp_path / "runs" / "a.json", json.dumps(record("bal_acc", 0.75), indent=1))
    write(tmp_path / "runs" / "b.json", json.dumps(record("balanced_accuracy", 0.25), indent=1))
    runs = scans.read_runs(spark, str(tmp_path / "runs"))
    values = {r.file: r.value for r in scans.run_metrics(runs).where("metric = 'balanced_accuracy'").collect()}
    assert values == {"a.json": 0.75, "b.json": 0.25}
    assert scans.run_classes(runs).first().recall is None and scans.run_sources(runs).first().bal_acc == 0.25
    assert scans.run_history(runs).count() == 2


def test_predictions_logs_and_lists(spark, tmp_path):
    write(tmp_path / "p" / "team+one 1.csv", "image_path,A,B\nv\\x.jpg,0.25,0.75\n")
    row = scans.read_predictions(spark, str(tmp_path / "p"), ("A", "B")).first()
    assert (row.team, row.item_id, row.scores) == ("team+one 1", "v/x.jpg", [0.25, 0.75])
    log = write(tmp_path / "log.txt", "start\n[fog sev=2 fold=1 tent] bal=0.5 ent=1.25 pass=0.75\n[broken line]\n"
                "12:30 worker 3: [motion-blur sev=10 fold=0 no-adapt+] bal=1.0 ent=.5 pass=0. done\n")
    cells = scans.read_cells(spark, log).collect()
    assert [tuple(c) for c in cells] == [("fog", 2, 1, "tent", 0.5, 1.25, 0.75), ("motion-blur", 10, 0, "no-adapt+", 1.0, 0.5, 0.0)]
    fold = write(tmp_path / "f.csv", "filename,label\na,Ulcer\nb,Unknown\n")
    assert [(r.filename, r.class_index) for r in scans.read_split_list(spark, {"0": fold}, ("Normal", "Ulcer")).collect()] == [("a", 1)]
    meta = write(tmp_path / "m.csv", "image,lesion_id\ni1,BCN00_1\ni2,\n")
    assert [r.source for r in scans.read_id_metadata(spark, meta, default="MSK").orderBy("image").collect()] == ["BCN", "MSK"]


def test_a_failed_overwrite_leaves_the_earlier_result(spark, tmp_path):
    good = spark.createDataFrame([("a", "training", 1), ("b", "validation", 2)], "source string, split string, v int")
    bad = good.withColumn("v", F.when(F.col("v") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    writers = {"r": sinks.write_result, "s": sinks.write_by_source, "j": sinks.write_summary, "c": lambda d, p: sinks.write_splits(d, p, fmt="parquet")}
    for name, save in writers.items():
        path = str(tmp_path / name)
        save(good, path)
        with pytest.raises(Exception, match="broken"):
            save(bad, path)
        read = spark.read.json(path) if name == "j" else spark.read.parquet(path)
        assert sorted(r.v for r in read.collect()) == [1, 2]
        save(good.where("v = 1"), path)
        read = spark.read.json(path) if name == "j" else spark.read.parquet(path)
        assert [r.v for r in read.collect()] == [1]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == sorted(writers)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "training", 1, 0), ("b", "validation", 2, 0)], "source string, split string, v int, helper int")
    sinks.write_by_source(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2 and (tmp_path / "s" / "source=a").is_dir()
    sinks.write_splits(rows, str(tmp_path / "c"), ["helper"])
    assert "helper" not in spark.read.option("header", True).csv(str(tmp_path / "c")).columns
    for n in (2, 1):
        sinks.write_result(rows.limit(n), str(tmp_path / "r"))
        assert spark.read.parquet(str(tmp_path / "r")).count() == n
    summary = rows.select("source", F.lit("n").alias("metric"), F.col("v").cast("double").alias("value"))
    sinks.write_summary(summary, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.nested_summary(summary, ["source"]).where("source = 'b'").first().metrics == {"n": 2.0}


def test_long_work_is_spread_by_bytes(spark, tmp_path):
    """A scan split grows with its input; what a task has to do must not."""
    path = str(tmp_path / "one_group.parquet")
    spark.range(40_000).selectExpr("id", "sha2(cast(id as string), 512) AS text").coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    few, many = scans.spread_input(table, "id"), scans.spread_input(table, "id", most_bytes=1 << 16)
    assert many.rdd.getNumPartitions() > 16 > few.rdd.getNumPartitions()
    sizes = many.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 40_000 and max(sizes) < 4_000
