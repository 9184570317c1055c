"""CSV files of several layouts (S1) and scoring what is available."""

import os

import pytest
from pyspark.sql import functions as F

from allelix.plans import models as M
from allelix.sources import readers
from allelix.sources.stages import StageStore
from allelix.streaming.scoring import publish_arm, score, score_available


def _file(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def test_files_are_read_by_their_own_headers(spark, scratch):
    d = f"{scratch}/csv"
    _file(d, "a.csv", "gene,region,allele_freq\ng1,r1,0.5\n")
    _file(d, "b c.csv", "allele_freq,gene,region\n0.2,g2,NA\n")
    _file(d, "c.csv", "\ufeffregion,gene\nr3,g3\n")
    _file(d, "only_header.csv", "position,gene\n")
    _file(d, "empty.csv", "")
    assert len(readers.header_census(spark, d)) == 4
    df = readers.read_variants_csv(spark, d)
    rows = {tuple(r) for r in df.select("gene", "region", "allele_freq", "position").collect()}
    assert rows == {("g1", "r1", 0.5, None), ("g2", None, 0.2, None), ("g3", "r3", None, None)}
    assert dict(df.dtypes)["allele_freq"] == "double" and dict(df.dtypes)["gene"] == "string"


def test_malformed_lines_are_listed_with_their_file(spark, scratch):
    d = f"{scratch}/csv"
    _file(d, "a.csv", "gene,region\ng1,r1\ng2\ng3,r3,x\n")
    _file(d, "b.csv", "region,gene\nr4,g4\n")
    got = {(os.path.basename(r.file), r.line) for r in readers.malformed_lines(spark, d).collect()}
    assert got == {("a.csv", "g2"), ("a.csv", "g3,r3,x")}
    assert readers.malformed_lines(spark, d).count() == 2
    rows = {tuple(r) for r in readers.read_variants_csv(spark, d).select("gene", "region").collect()}
    assert rows == {("g1", "r1"), ("g2", None), ("g3", "r3"), ("g4", "r4")}


def test_repeated_column_names_and_empty_folders(spark, scratch):
    _file(f"{scratch}/twice", "a.csv", "gene,gene\n1,2\n")
    with pytest.raises(ValueError, match="repeated"):
        readers.read_variants_csv(spark, f"{scratch}/twice")
    _file(f"{scratch}/none", "a.csv", "")
    assert readers.read_variants_csv(spark, f"{scratch}/none").columns == []
    assert readers.malformed_lines(spark, f"{scratch}/none").count() == 0


def _arm(spark, sign):
    rows = [(f"v{i}", "p" if i % 2 else "q", float(i % 10), int((i % 10 > 4) == (sign > 0))) for i in range(200)]
    df = spark.createDataFrame(rows, "variant_id string, population_name string, allele_freq double, y int")
    spec = M.ArmSpec(population_aware=True, model="LogisticRegression", label_col="y", numeric=("allele_freq",),
                     categorical=("population_name",), sequence=())
    return df.withColumn("allele_length", F.lit(1)), M.fit_arm(df.withColumn("allele_length", F.lit(1)), spec, [0, 1])


def test_scoring_goes_on_after_a_lost_batch_and_takes_the_newest_arm(spark, scratch):
    df, first = _arm(spark, 1)
    _, second = _arm(spark, -1)
    store = StageStore(spark, f"{scratch}/arms")
    where = (f"{scratch}/in/*", df.schema, f"{scratch}/out", f"{scratch}/ckpt")
    df.limit(0).write.parquet(f"{scratch}/in/none")
    publish_arm(store, "scorer", first)
    old = df.where("substring(variant_id, 2) < 100")
    old.repartition(4).write.parquet(f"{scratch}/in/one")
    assert score_available(store, "scorer", *where, files_per_batch=2).count() == old.count()
    # the last batch's commit is lost after its rows were written: it is done again, no row comes twice
    commits = sorted((n for n in os.listdir(f"{scratch}/ckpt/commits") if n.isdigit()), key=int)
    os.remove(f"{scratch}/ckpt/commits/{commits[-1]}")
    crc = f"{scratch}/ckpt/commits/.{commits[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    new = df.where("substring(variant_id, 2) >= 100")
    new.repartition(3).write.parquet(f"{scratch}/in/two")
    out = score_available(store, "scorer", *where, files_per_batch=2)
    assert out.count() == df.count() and out.select("variant_id").distinct().count() == df.count()
    want = {r.variant_id: r.prob_pathogenic for r in score(first, df).select("variant_id", "prob_pathogenic").collect()}
    assert all(abs(r.prob_pathogenic - want[r.variant_id]) < 1e-12 for r in out.collect())
    # rows that come after another arm was published are scored by it
    path = publish_arm(store, "scorer", second)
    df.limit(5).withColumn("variant_id", F.concat(F.lit("late"), "variant_id")).write.parquet(f"{scratch}/in/three")
    late = score_available(store, "scorer", *where).where("variant_id like 'late%'")
    assert late.count() == 5 and {r.arm_path for r in late.collect()} == {path}


def test_scoring_without_an_arm_is_an_error(spark, scratch):
    df, _ = _arm(spark, 1)
    df.limit(3).write.parquet(f"{scratch}/in")
    with pytest.raises(Exception, match="no arm"):
        score_available(StageStore(spark, f"{scratch}/arms"), "scorer", f"{scratch}/in", df.schema,
                        f"{scratch}/out", f"{scratch}/ckpt")
