"""Readers of catalogue inputs, and the catalogue made from them end to end."""

import pytest
from pyspark.sql import functions as F

from kmerlake.operators import catalogue as C
from kmerlake.sources import catalogue_files as K


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture
def at(tmp_path):
    (tmp_path / "coords.tsv").write_text('more\tvariant\tposition\treference_nucleotide\talternative_nucleotide\nx\trpoB_p.Ser2Leu\t5\tC\tT\ny\tkatG_c.1A>C\t9\tA\tC\nz\tother_c.1A>C\t3\tA\tC\n"q ""w"""\trpoB_c.5C>T\t5\tC\tT\n')
    (tmp_path / "master.tsv").write_text("drug\tvariant\tFINAL CONFIDENCE GRADING\nRIF\trpoB_p.Ser2Leu\t3) Uncertain\nRIF\trpoB_p.Ser2Leu\t1) Assoc w R\n INH \tkatG_c.1A>C\t 4) Not \nINH\t\t1) x\nINH\tkatG_c.1A>C\t\nRIF\trpoB_c.5C>T\t2) Assoc w R - Interim\n")
    (tmp_path / "list.csv").write_text('source,Gene,Mutation,drug\ntbdb,rpoB,"p.Ser2Leu",rifampicin\nwho,katG,c.1A>C,isoniazid\n')
    (tmp_path / "g.gff").write_text("##gff\nc\ts\tgene\t3\t14\t.\t+\t.\tID=1;Name=rpoB;gene_id=Rv1\nc\ts\tCDS\t1\t9\t.\t+\t0\tName=no\nc\ts\tgene\t20\t30\t.\t-\t.\tgene_id=Rv2=x\n")
    return lambda name: str(tmp_path / name)


def test_readers(spark, at):
    assert rows(K.variant_coordinates(spark, at("coords.tsv")).drop("ordinal")) == [("katG_c.1A>C", 9, "A", "C"), ("other_c.1A>C", 3, "A", "C"), ("rpoB_c.5C>T", 5, "C", "T"), ("rpoB_p.Ser2Leu", 5, "C", "T")]
    assert rows(K.variant_grades(spark, at("master.tsv"))) == [("katG_c.1A>C", "INH", "4) Not"), ("rpoB_c.5C>T", "RIF", "2) Assoc w R - Interim"), ("rpoB_p.Ser2Leu", "RIF", "1) Assoc w R")]
    assert rows(K.listed_mutations(spark, at("list.csv"), "tbdb").drop("ordinal")) == [("rpoB", "p.Ser2Leu", "rifampicin", "")]
    assert rows(K.gene_places(spark, at("g.gff")).drop("ordinal")) == [("", "Rv2", 20, 30, "-"), ("rpoB", "Rv1", 3, 14, "+")]
    with pytest.raises(ValueError, match="lacks the columns position"):
        K.variant_coordinates(spark, at("master.tsv"))


def test_from_files_to_two_frames(spark, at):
    variants = K.variant_coordinates(spark, at("coords.tsv")).withColumn("p", C.variant_parts(F.col("variant"))).select("ordinal", "variant", "pos", "ref", "alt", "p.gene", "p.mutation")
    drugs = spark.createDataFrame([("rpoB", "RIF"), ("katG", "INH")], "gene string, drug string")
    told = C.with_drug(variants, K.variant_grades(spark, at("master.tsv")), drugs).withColumnRenamed("label", "drug")
    best = C.strongest_of_each(told)
    assert rows(best.select("pos", "variant", "drug", "grade")) == [(5, "rpoB_p.Ser2Leu", "RIF", "1) Assoc w R"), (9, "katG_c.1A>C", "INH", "4) Not")]
    framed = C.catalogue_frames(best, {"one": "GGGGCGGGAG", "two": "GGGGTGGGGG"})
    assert rows(framed.select("frame", "drug_rank", "pos", "ref", "alt", "changed")) == [("one", 0, 5, "C", "T", False), ("one", 1, 9, "A", "C", False), ("two", 1, 9, "G", "C", True)]
    placed = C.gene_of(K.listed_mutations(spark, at("list.csv"), "tbdb"), K.gene_places(spark, at("g.gff")))
    assert rows(placed.select("gene", "start", "end", "strand")) == [("rpoB", 3, 14, "+")]
