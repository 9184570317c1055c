"""Edge rows G1-G4, G11 and feature operators."""

from pyspark.sql import functions as F

from allelix.functions.labels import label_class
from allelix.operators import features as feat
from allelix.operators import labels as lab
from allelix.sources.readers import coerce_numeric, read_variants_csv


def test_g1_label_text(spark):
    rows = [(None,), ("",), ("PATHOGENIC",), ("non-pathogenic",), ("Benign; pathogenic",),
            ("conflicting data",), ("Conflicting interpretations of pathogenicity",),
            ("association",), ("Likely benign",), ("Uncertain significance",)]
    df = spark.createDataFrame(rows, "txt STRING").select("txt", label_class("txt").alias("c"))
    got = {r.txt: r.c for r in df.collect()}
    assert got[None] is None and got[""] is None and got["association"] is None
    assert got["PATHOGENIC"] == "pathogenic"
    assert got["non-pathogenic"] == "pathogenic"          # first match wins (quirk Q1)
    assert got["Benign; pathogenic"] == "pathogenic"
    assert got["conflicting data"] == "uncertain"
    assert got["Conflicting interpretations of pathogenicity"] == "pathogenic"
    assert got["Likely benign"] == "benign"
    assert got["Uncertain significance"] == "uncertain"


def test_prepare_target_modes(spark):
    df = spark.createDataFrame([("Benign",), ("Pathogenic",), ("uncertain",), ("x",)],
                               "clinical_significance STRING")
    three = {r.mapped_target: r.target_encoded for r in lab.prepare_target(df).collect()}
    assert three == {"benign": 0, "pathogenic": 1, "uncertain": 2}
    two = sorted((r.mapped_target, r.target_encoded) for r in lab.prepare_target(df, binary=True).collect())
    assert two == [("non_pathogenic", 0), ("non_pathogenic", 0), ("pathogenic", 1)]
    counts = {r.mapped_target: r.n for r in lab.class_counts(lab.prepare_target(df, binary=True),
                                                             binary=True).collect()}
    assert counts == {"non_pathogenic": 2, "pathogenic": 1}


def test_g2_numeric_coercion(spark):
    df = spark.createDataFrame([("abc",), ("",), ("1e-3",), ("0.1",), (None,)], "allele_freq STRING")
    got = [r.allele_freq for r in coerce_numeric(df).collect()]
    assert got[0] is None and got[1] is None and got[4] is None
    assert abs(got[2] - 0.001) < 1e-15 and got[3] == 0.1


def test_csv_source_with_and_without_optional_columns(spark, scratch):
    path = f"{scratch}/v.csv"
    with open(path, "w") as f:
        f.write("variant_id,gene,allele_freq,position,clinical_significance\n")
        f.write("v1,G6PD,0.0003,154535341,Pathogenic\nv2,BRCA1,abc,12,Benign\n")
    df = read_variants_csv(spark, path)
    assert df.columns == ["variant_id", "gene", "allele_freq", "position", "clinical_significance"]
    rows = {r.variant_id: r for r in df.collect()}
    assert rows["v1"].allele_freq == 0.0003 and rows["v2"].allele_freq is None
    assert rows["v1"].position == 154535341.0
    # optional columns absent -> operators leave the frame unchanged
    assert feat.sequence_features(df).columns == df.columns
    assert feat.interaction_terms(df).columns == df.columns


def test_g3_sequence_features(spark):
    df = spark.createDataFrame([(None,), ("",), ("ACGT",), ("acgt",), ("A/G",), ("GGGG",)], "allele STRING")
    rows = feat.sequence_features(df).collect()
    by = {r.allele: r for r in rows}
    assert by[""].allele_length == 0 and by[""].allele_GC_content == 0.0   # NULL became ''
    assert sum(1 for r in rows if r.allele == "") == 2
    assert (by["ACGT"].allele_A_count, by["ACGT"].allele_GC_content) == (1, 0.5)
    assert by["acgt"].allele_A_count == 0 and by["acgt"].allele_length == 4   # case-sensitive
    assert by["A/G"].allele_length == 3 and abs(by["A/G"].allele_GC_content - 1 / 3) < 1e-12
    assert by["GGGG"].allele_GC_content == 1.0


def test_sequence_falls_back_to_allele_string(spark):
    df = spark.createDataFrame([("GC/A",)], "allele_string STRING")
    r = feat.sequence_features(df).first()
    assert r.allele_length == 4 and r.allele_G_count == 1 and r.allele_C_count == 1


def test_g4_group_means(spark):
    rows = [("a", None), ("a", None), ("b", 0.0), ("b", 0.0), (None, 2.0), ("c", 1.0), ("c", 3.0)]
    df = spark.createDataFrame(rows, "population_name STRING, allele_freq DOUBLE")
    out = feat.GroupMeans().fit(df).transform(df)
    got = {(r.population_name, r.allele_freq): (r.pop_allele_freq_mean, r.allele_freq_rel)
           for r in out.collect()}
    overall = (0 + 0 + 2 + 1 + 3) / 5
    assert got[("a", None)] == (overall, None)            # all-NULL group -> global mean
    assert got[("b", 0.0)] == (0.0, None)                 # mean 0 -> ratio NULL
    assert got[(None, 2.0)] == (2.0, 1.0)                 # NULL group is its own group
    assert got[("c", 1.0)] == (2.0, 0.5)


def test_interactions_nan_text(spark):
    df = spark.createDataFrame([(None, "missense", "G6PD")], "population_name STRING, consequence_type STRING, gene STRING")
    r = feat.interaction_terms(df).first()
    assert r.pop_consequence == "nan_missense" and r.pop_gene == "nan_G6PD"


def test_pathway_features_default_map(spark):
    df = spark.createDataFrame([("G6PD", "frameshift_variant"), ("BRCA1", "missense_variant"),
                                ("BRCA2", None), ("OTHER", "missense_variant")],
                               "gene STRING, consequence_type STRING")
    out = feat.pathway_features(df, importance={"DNA repair": 2.0})
    cols = [c for c in out.columns if c.startswith("pathway_")]
    assert cols == sorted(cols) and len(cols) == 5
    by = {r.gene: r for r in out.collect()}
    assert by["G6PD"]["pathway_Metabolic pathways"] == 3.0
    assert by["BRCA1"]["pathway_DNA repair"] == 4.0 and by["BRCA1"]["pathway_Cell cycle"] == 2.0
    assert by["BRCA2"]["pathway_DNA repair"] == 1.0       # NULL consequence -> 0.5 severity
    assert all(by["OTHER"][c] == 0.0 for c in cols)


def test_column_roles_and_arm_projection():
    cols = ["allele_freq", "allele_freq_rel", "gene", "population_name", "pop_gene", "allele"]
    num, cat, seq = feat.column_roles(cols, True)
    assert num == ["allele_freq", "allele_freq_rel"] and cat == ["gene", "population_name", "pop_gene"]
    num2, cat2, _ = feat.column_roles(cols, False)
    assert num2 == ["allele_freq"] and cat2 == ["gene"] and seq == ["allele"]


def test_arm_projection_keeps_rel(spark):
    df = spark.createDataFrame([(1.0, "x", "y", 0.5)], "a DOUBLE, population_name STRING, pop_gene STRING, allele_freq_rel DOUBLE")
    assert feat.arm_projection(df).columns == ["a", "allele_freq_rel"]


def test_group_size_flags(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("b", 0), ("c", 0), ("c", 1)], "g STRING, y INT")
    got = {r.g: (r.n, r.single_member, r.single_class) for r in feat.group_size_flags(df, "g", "y").collect()}
    assert got == {"a": (1, True, True), "b": (2, False, True), "c": (2, False, False)}
