"""Operators on hand-made cases."""

import random
import warnings
import re

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter, functions as F

from kmerlake.functions import names, seq as S
from kmerlake.operators import annotate as A, catalogue as C, contain, features, forest as M, insights as I, lineage as L, reports, scan
from kmerlake.sources import files, sinks
from kmerlake.streaming import totals


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


# ---- sequences


def test_kmers_skip_foreign_characters(spark):
    reads = spark.createDataFrame([("a", "ACGTNACG"), ("b", "AC"), ("c", None), ("d", "")], "id string, seq string")
    assert rows(S.explode_kmers(reads, 3)) == [("a", 0, "ACG"), ("a", 1, "CGT"), ("a", 5, "ACG")]


def test_encode_decode_and_reverse(spark):
    s = "T" * 31
    r = spark.createDataFrame([(s,)], "s string").select(S.encode(F.col("s")), S.decode(S.encode(F.col("s")), 31), S.revcomp(F.lit("acgtRn")), S.canonical(F.lit("TTT"))).first()
    assert tuple(r) == (4**31 - 1, s, "NNACGT", "AAA")


def test_kmer_forms_equal_plain(spark):
    import pyarrow as pa

    from kmerlake.functions import kmers

    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("ACGTNa"), n, p=[0.24] * 4 + [0.02] * 2)) for n in (0, 3, 40, 500)] + [None, "éACGTACéGTACGTT", "ACGT" * 60]
    turn = str.maketrans("ACGT", "TGCA")
    for k in (1, 3, 8, 31):
        want = [(i, p, s[p : p + k]) for i, s in enumerate(seqs) for p in range(len(s or "") - k + 1) if not s[p : p + k].strip("ACGT")]
        code = lambda x: int(x.translate(str.maketrans("ACGT", "0123")), 4)
        for limit in (7, 64, 1 << 20):  # long sequences are read in slices
            got = [x for w in kmers.windows(pa.array(seqs), k, limit) for x in zip(w.row.tolist(), w.pos.tolist(), w.text().to_pylist(), w.forward.tolist(), w.reverse.tolist())]
            assert got == [(i, p, x, code(x), code(x[::-1].translate(turn))) for i, p, x in want]
    frame = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string").repartition(3)
    hits = kmers.panel_hits(frame, 3, np.array(sorted({6, 27})), keep=["id"])
    want = [(i, strand, p, x) for i, s in enumerate(seqs) for strand, t in ((0, s or ""), (1, re.sub("[^ACGT]", "N", s or "")[::-1].translate(turn))) for p in range(len(t) - 2) if not (x := t[p : p + 3]).strip("ACGT") and code(x) in (6, 27)]
    assert rows(hits.select("id", "strand", "pos", S.decode(F.col("kmer"), 3))) == sorted(want)
    assert kmers.kmer_rows(frame.where("id < 0"), 3).count() == 0


def test_a_genome_takes_linear_time(spark):
    import time

    genome = "".join(np.random.default_rng(1).choice(list("ACGT"), 5_000_000))
    made = spark.createDataFrame([(i, 100_000 * (i + 1), "A", "C", ["L"], 15, genome[100_000 * (i + 1) - 16 : 100_000 * (i + 1) + 15]) for i in range(40)], "marker_id int, pos int, ref string, alt string, levels array<string>, left int, alt_kmer string")
    began = time.time()
    hits = scan.assembly_hits(spark.createDataFrame([("g", 0, genome)], "genome string, contig int, seq string"), made, 31).collect()
    assert sorted(h.genome_pos for h in hits) == [100_000 * (i + 1) for i in range(40)] and time.time() - began < 30


def test_large_panels_are_joined(spark, monkeypatch):
    made = scan.diagnostic_kmers(panel(spark, [(150, 1, ALT), (100, 1, "T" if REF[99] != "T" else "G")]), REF, 11)
    reads = spark.createDataFrame([("s", REF[100:220]), ("t", REF[140:149] + ALT + REF[150:170])], "sample string, seq string")
    contigs = spark.createDataFrame([("g", 0, REF[:149] + ALT + REF[150:]), ("h", 0, REF[:149] + ALT + REF[150:])], "genome string, contig int, seq string")
    both = lambda: (rows(scan.allele_counts(reads, scan.read_index(made, 11), 11)), rows(scan.assembly_hits(contigs, made, 11).drop("levels")))
    near = both()
    monkeypatch.setattr(scan, "panel_codes", lambda df: None)
    assert both() == near and all(near)


def test_chunks_keep_every_window_once(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("ACGT") for _ in range(1000))
    frame = spark.createDataFrame([("g", text)], "id string, seq string")
    whole = rows(S.explode_kmers(frame, 11))
    cut = S.explode_kmers(S.in_chunks(frame, 11, 100), 11).select("id", (F.col("pos") + F.col("offset")).alias("pos"), "kmer")
    assert rows(cut) == whole


def test_parameters_are_checked():
    for bad in (0, 32):
        with pytest.raises(ValueError):
            S.check_k(bad)
    with pytest.raises(ValueError):
        S.check_k(5, 3)


# ---- markers


_RNG = random.Random(9)
REF = "".join(_RNG.choice("ACGT") for _ in range(300))
ALT = REF[149].translate(str.maketrans("ACGT", "GTAC"))


def panel(spark, variants):
    out = [(i, p, REF[p - 1 : p - 1 + n], alt, ["L1"]) for i, (p, n, alt) in enumerate(variants)]
    return spark.createDataFrame(out, "marker_id int, pos int, ref string, alt string, levels array<string>")


def test_windows_at_the_ends(spark):
    made = {r.marker_id: r for r in scan.diagnostic_kmers(panel(spark, [(3, 1, "T"), (150, 1, ALT), (299, 1, "T"), (150, 2, "TGC")]), REF, 11).collect()}
    assert made[0].left == 2 and made[0].ref_kmer == REF[:11]
    assert made[1].ref_kmer == REF[144:155] and made[1].alt_kmer == REF[144:149] + ALT + REF[150:155]
    assert 2 not in made
    assert len(made[3].ref_kmer) == len(made[3].alt_kmer) == 11 and made[3].left == 4


def test_reads_credit_both_markers_of_a_kmer_and_assemblies_the_last(spark):
    twice = panel(spark, [(150, 1, ALT), (150, 1, ALT)])
    made = scan.diagnostic_kmers(twice, REF, 11)
    alt = REF[:149] + ALT + REF[150:]
    reads = spark.createDataFrame([("s", alt[130:170])], "sample string, seq string")
    counts = rows(scan.allele_counts(reads, scan.read_index(made, 11), 11))
    assert [(r[1], r[3]) for r in counts] == [(0, 1), (1, 1)]
    hits = scan.assembly_hits(spark.createDataFrame([("g", 0, alt)], "genome string, contig int, seq string"), made, 11).collect()
    assert [(h.marker_id, h.kmer_pos, h.genome_pos) for h in hits] == [(1, 145, 150)]


def test_reverse_contig_is_found_once(spark):
    made = scan.diagnostic_kmers(panel(spark, [(150, 1, ALT)]), REF, 11)
    alt = REF[:149] + ALT + REF[150:]
    rc = alt[::-1].translate(str.maketrans("ACGT", "TGCA"))
    frame = spark.createDataFrame([("g", 0, rc), ("g", 1, alt), ("h", 0, REF)], "genome string, contig int, seq string")
    hits = scan.assembly_hits(frame, made, 11).collect()
    assert [(h.genome, h.contig, h.strand) for h in hits] == [("g", 0, 1)]


def test_percent_is_tested_in_single_precision(spark):
    counts = spark.createDataFrame([(f"{a}/{n}", 0, n - a, a) for n in range(10, 60) for a in range(n + 1)], "sample string, marker_id int, ref_count long, alt_count long")
    kept = {r.sample for r in scan.called_variants(counts, 10, 95).collect()}
    want = {f"{a}/{n}" for n in range(10, 60) for a in range(n + 1) if np.float32(np.float32(a) / np.float32(n)) * np.float32(100) >= np.float32(95)}
    assert kept == want


# ---- lineages


def nested(tally):
    if not tally:
        return None
    order = lambda p: (-tally[p], p)
    ok = [p for p in tally if all(";".join(p.split(";")[:i]) in tally for i in range(1, p.count(";") + 1))]
    most = min(tally, key=order)
    if not ok:
        return most
    deep = min(ok, key=lambda p: (-p.count(";"), *order(p)))
    one = deep == most or deep.startswith(most + ";") or most.startswith(deep + ";")
    return most if not one and tally[most] > tally[deep] else deep


def test_nested_call_equals_plain(spark):
    rng = random.Random(4)
    paths = ["L1", "L12", "L1;L1.1", "L1;L1.1;L1.1.1", "L2", "L2;L2.1", "L2;L2.2", "L3;L3.1"]
    tallies = {f"s{i}": {p: rng.randint(1, 5) for p in rng.sample(paths, rng.randint(1, 6))} for i in range(300)}
    frame = spark.createDataFrame([(s, p, n) for s, t in tallies.items() for p, n in t.items()], "sample string, path string, n long")
    assert dict(rows(L.major_nested(frame, "sample"))) == {s: nested(t) for s, t in tallies.items()}
    flat = {s: min(t, key=lambda p: (-t[p], p)) for s, t in tallies.items()}
    assert dict(rows(L.major_flat(frame, "sample"))) == flat


def test_branches_and_mixtures(spark):
    frame = spark.createDataFrame([("s", "L2", 3), ("s", "L2;L2.1", 2), ("s", "L2;L2.2", 4), ("s", "L4", 1), ("t", "L1", 9)], "sample string, path string, n long")
    got = L.branches(frame, "sample")
    assert rows(got) == [("s", "L2;L2.1", 5, 2), ("s", "L2;L2.2", 7, 4), ("s", "L4", 1, 1), ("t", "L1", 9, 9)]
    assert rows(L.mixed(got, "sample")) == [("s", 2, 6, True), ("t", 1, 9, False)]


# ---- containment


def test_containment_counts_shared_weight(spark):
    reads = spark.createDataFrame([("ACGTACGTAC",), ("ACGTA",), ("GGGGG",)], "seq string")
    refs = spark.createDataFrame([(1, "TTTTT"), (2, "ACGTAC"), (3, "ACGTAC")], "ref_id int, seq string")
    counts = contain.kmer_counts(reads, 5)
    scores = {r.ref_id: (r.shared, r.total) for r in contain.containment(counts, refs, 5).collect()}
    assert scores[1] == (0, 8) and scores[2] == scores[3] and scores[2][0] > 0
    assert contain.best_reference(contain.containment(counts, refs, 5)).first().ref_id == 2
    assert contain.without_noise(counts, 2, gate=1).count() < counts.count() == contain.without_noise(counts, 2).count()


# ---- genes


def test_amino_changes(spark):
    ref = "AAATGGCCTTAAGGG"  # from 2: ATG GCC TTA AGG
    cases = [(5, 1, "A", 2, 14, "+"), (7, 1, "A", 2, 14, "+"), (4, 2, "TT", 2, 14, "+"), (5, 1, "AA", 2, 14, "+"), (0, 1, "C", 2, 14, "+"), (5, 1, "A", 2, 14, "."), (13, 1, "A", 2, 14, "-")]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, pos0 int, n int, alt string, start int, stop int, strand string")
    got = {r.i: r.aa for r in A.with_amino_change(frame, ref, *[F.col(c) for c in ("pos0", "n", "alt", "start", "stop", "strand")]).collect()}
    assert got[0].change == "Ala2Thr(GCC>ACC)" and got[1].change == "Ala2Ala(GCC>GCA) syn"
    assert got[2].change == "Met1Ile(ATG>ATT);Ala2Ser(GCC>TCC)" and got[3].change == "frameshift_pos2"
    assert got[4] is None and got[5] is None and got[6].aa_pos == 1 and got[6].change.startswith("Pro1Ser(CCT>")


def test_overlap_join_equals_plain(spark):
    rng = random.Random(6)
    hits = [(i, s, s + rng.randint(1, 4000)) for i, s in enumerate(rng.randint(0, 20_000) for _ in range(80))]
    genes = [(i, s, s + rng.randint(1, 6000)) for i, s in enumerate(rng.randint(0, 20_000) for _ in range(60))]
    a = spark.createDataFrame(hits, "hit int, h_start int, h_end int")
    b = spark.createDataFrame(genes, "id int, start int, stop int")
    want = sorted((h[0], g[0]) for h in hits for g in genes if h[1] < g[2] and h[2] > g[1])
    assert rows(A.overlapping(a, b).select("hit", "id")) == want


def test_masks(spark):
    ranges = spark.createDataFrame([("g", 1, 3), ("g", 3, 5), ("g", 9, 99), ("h", 0, 1)], "genome string, start int, stop int")
    merged = A.merged_ranges(ranges, ["genome"])
    assert rows(merged) == [("g", 1, 5), ("g", 9, 99), ("h", 0, 1)]
    by = merged.groupBy("genome").agg(F.collect_list(F.struct("start", "stop")).alias("r"))
    assert rows(by.select("genome", A.mask(F.lit("ACGTACGTACGT"), F.col("r")))) == [("g", "ANNNNCGTANNN"), ("h", "NCGTACGTACGT")]


# ---- results


def test_resistance_profile(spark):
    calls = [("s", "AMI;x;m;1) Assoc w R;g;A1B", 20), ("s", "AMK;x;m;3) Uncertain;g;C1D", 90), ("s", "RIF;x;m;4) Not assoc;g;E1F", 5), ("s", "L1;L2;L3;L4", 5), ("t", "INH;x;m;uncertain", 5), ("t", "INH;x;m9;Unknown;g;", 5)]
    got = {(r.sample, r.drug): r for r in I.profile(spark.createDataFrame(calls, "sample string, dr_path string, coverage long"), "sample").collect()}
    assert set(got) == {("s", "AMK"), ("s", "RIF"), ("t", "INH")}
    assert got["s", "AMK"].mutations == "A1B,C1D" and got["s", "AMK"].verdict == "resistant"
    assert got["t", "INH"].verdict == "ungraded" and got["t", "INH"].mutations == "m9"


def test_cells(spark):
    r = spark.sql("select 1").select(*[I.number(F.lit(x)) for x in ("12abc", "1,5", "-3.x", "abc", "", ".5")], I.unknown(F.lit(" N/A ")), I.unknown(F.lit("L1"))).first()
    assert tuple(r) == (12.0, 1.5, -3.0, None, None, 0.5, True, False)


def test_filters_search_and_thinning(spark):
    frame = spark.createDataFrame([(i, f"Gene{i % 3}", f"{i * 10},5") for i in range(12)], "i int, gene string, score string")
    assert rows(I.filter_rows(frame, "gene1", {"score": ">= 40", "gene": "GENE"}).select("i")) == [(4,), (7,), (10,)]
    assert [r.score for r in I.scored_search(frame.select("i", "gene"), ["i", "gene"], "gene1 1", ["i"], 5).collect()] == [28, 22, 18, 18, 8]
    assert I.every_nth(frame, "gene", ["i"], 2).count() == 6
    assert rows(I.top_with_other(frame.groupBy("gene").count(), "gene", "count", 1)) == [("Gene0", 4), ("Other", 8)]


# ---- catalogue and names


def test_catalogue(spark):
    grades = spark.createDataFrame([("v", "MXF", "2) x"), ("v", "LEV", "1) x"), ("v", "RIF", "2) x"), ("v", "KAN", "3) x"), ("w", "INH", "4) x")], "variant string, drug string, grade string")
    assert rows(C.collapse(grades)) == [("v", "RIF_FQ", "1) x")]
    parts = spark.createDataFrame([("rpoB_p.Ser450Leu",), ("pncA_LoF_p.Trp68*",), ("inhA_c.-15C>T",), ("bare",)], "n string").select(C.variant_parts(F.col("n")).alias("p")).collect()
    assert [(r.p.gene, r.p.mutation) for r in parts] == [("rpoB", "S450L"), ("pncA_LoF", "W68*"), ("inhA", "c.-15C>T"), ("bare", "bare")]


def test_mutations_are_placed_on_the_genome(spark):
    ref = "AAATGGCCTTAAGGG"  # gene 3..14: ATG GCC TTA AGG, its reverse: CCT TAA GGC CAT
    cases = [("p.Ala2Thr", 3, 14, "+"), ("p.Met1Trp", 3, 14, "+"), ("p.Gly1Thr", 3, 14, "+"), ("p.Ala2del", 3, 14, "+"), ("p.Pro1Ser", 3, 14, "-"), ("p.Leu3*", 3, 14, "+")]
    frame = spark.createDataFrame(cases, "mutation string, start int, end int, strand string")
    got = rows(C.protein_snps(frame, ref).select("mutation", "pos", "ref", "alt"))
    assert got == [("p.Ala2Thr", 6, "G", "A"), ("p.Leu3*", 10, "T", "A"), ("p.Met1Trp", 3, "A", "T"), ("p.Met1Trp", 4, "T", "G"), ("p.Pro1Ser", 14, "G", "A")]
    bases = [("c.4G>A", 3, 14, "+"), ("c.-1A>C", 3, 14, "+"), ("c.1C>T", 3, 14, "-"), ("n.1G>A", 3, 14, "-"), ("c.4C>A", 3, 14, "+")]
    got = rows(C.base_snps(spark.createDataFrame(bases, "mutation string, start int, end int, strand string"), ref).select("mutation", "pos", "ref", "alt"))
    assert got == [("c.-1A>C", 2, "A", "C"), ("c.1C>T", 14, "G", "A"), ("c.4G>A", 6, "G", "A"), ("n.1G>A", 14, "G", "A")]


def test_result_helpers(spark):
    frame = spark.createDataFrame([("A", "0.95", "aacga"), ("unknown", "0.2", ""), ("a ", "1,0", None)], "call string, conf string, kmer string")
    assert I.quick_filter(frame, "call", "category", "a").count() == 2 and I.quick_filter(frame, "call", "unknown").count() == 1
    assert I.quick_filter(frame, "conf", "high").count() == 2 and I.quick_filter(frame, "conf", "low").count() == 1
    assert [r["Mut NT"] for r in I.with_bases(frame, None, None, "kmer").collect()] == ["C", "", ""]
    cell = spark.sql("select 'L1:3, L2;L2.1:12 x a:b:4' as c").select(I.lineage_cells(F.col("c")).alias("p")).first().p
    assert [(x.path, x.n) for x in cell] == [("L1", 3), ("L2;L2.1", 12), ("a:b", 4)]


def test_slices_and_annotations(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">c1 first\nACGTACGT\n>c2\nGGGGCCCC\n")
    records = files.fasta(spark, str(tmp_path / "s.fa"))
    assert tuple(files.slice_of(records, "C2", 6, 3).first()) == ("c2", 3, 6, "GGCC")
    assert tuple(files.slice_of(records, "none", -4, 99).first()) == ("c1 first", 1, 8, "ACGTACGT")
    genomes = spark.createDataFrame([("d/a.fa",), ("d/b.fasta",)], "path string")
    notes = spark.createDataFrame([("g/a.gff",)], "path string")
    assert rows(files.with_annotation(genomes, notes)) == [("d/a.fa", "g/a.gff"), ("d/b.fasta", None)]
    assert files.with_annotation(genomes, notes, "all.gff").where("gff = 'all.gff'").count() == 1


def test_read_pairs(spark):
    paths = ["a/S1_R1_001.fastq.gz", "a/S1_R1_002.fastq.gz", "a/S1_R2_001.fastq.gz", "b/S1_R1_001.fastq.gz", "a/x_1.fq", "a/x_2.fq", "a/lone.fastq"]
    got = {(r.dir, r.sample): (r.paired, [p[2:] for p in r.files]) for r in names.read_pairs(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got["a", "S1"] == (True, ["S1_R1_001.fastq.gz", "S1_R1_002.fastq.gz", "S1_R2_001.fastq.gz"])
    assert got["b", "S1"] == (False, ["S1_R1_001.fastq.gz"]) and got["a", "x"][0] and got["a", "lone"] == (False, ["lone.fastq"])


# ---- files


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\n\nacgt\n>empty\n>two\nGG\r\nTT\n")
    assert [(r.id, r.header, r.seq) for r in files.fasta(spark, str(tmp_path / "a.fa")).orderBy("ordinal").collect()] == [("one", "one first", "ACGTacgt"), ("two", "two", "GGTT")]
    with pytest.raises(ValueError):
        files.reference(spark, str(tmp_path / "a.fa"))
    (tmp_path / "dup.fa").write_text(">x\nA\n>x\nC\n")
    with pytest.raises(ValueError):
        files.unique_ids(files.fasta(spark, str(tmp_path / "dup.fa")))
    (tmp_path / "r.fastq").write_text("@r1 d\nACGT\n+\n@III\n@r2\nGGGG\n+r2\n+III\n@r3\nTT\n+\n++\n@r4\nCC\n+\n@@\n")
    assert [(r.name, r.seq) for r in files.fastq(spark, str(tmp_path / "r.fastq")).orderBy("name").collect()] == [("r1", "ACGT"), ("r2", "GGGG"), ("r3", "TT"), ("r4", "CC")]


def test_markers_and_gff(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("#c\n10\tA\tC\tL1\tL1.1\t\tgene\t\tmut\nx\tA\tC\tL1\n11\tA\t\tL1\n12\tAT\tC\tL2\n\n13\tA\tG\n")
    lines = files.marker_lines(spark, str(tmp_path / "m.tsv"))
    got = files.parse_markers(lines).orderBy("pos").collect()
    assert [(r.pos, r.levels, r.notes) for r in got] == [(10, ["L1", "L1.1"], ["gene", "mut"]), (12, ["L2"], [])]
    assert [r.pos for r in files.parse_read_markers(lines).collect()] == [10]
    (tmp_path / "g.gff").write_text("##gff\nc\ts\tCDS\t10\t30\t.\t+\t0\tID=i%20d;gene=ge\nc\ts\tCDS\t50\t40\t.\t-\t0\tName=nm,x;locus_tag=lt\nc\ts\tgene\t1\t2\t.\t+\t.\tID=q\nc\ts\tCDS\t1\t3\t.\t+\t0\tnote=1\n")
    features_ = files.gff(spark, str(tmp_path / "g.gff"))
    assert rows(files.coding_genes(features_)) == [(0, 3, "+", "Unknown"), (9, 30, "+", "ge"), (39, 50, "-", "nm")]
    (tmp_path / "l.tsv").write_text("sample\tfile\na\tx.fq\ty.fq\nb\tz.fq\n")
    assert files.sample_list(spark, str(tmp_path / "l.tsv")) == [("a", ["x.fq", "y.fq"]), ("b", ["z.fq"])]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a b", "f", "A" * 170), ("a/b", "f", "C" * 170), ("q", "g", "C")], "sample string, file string, seq string")
    assert rows(sinks.safe_names(frame)) == [("a b", "a_b"), ("a/b", "a_b_2"), ("q", "q")]
    assert sinks.maskable(frame, 170).count() == 2
    text = sinks.fasta_text(frame, "sample").where("value like '>a b%'").first().value.split("\n")
    assert [len(x) for x in text[1:]] == [80, 80, 10]
    sinks.write_tsv(frame, str(tmp_path / "t"))
    assert files.result_table(spark, str(tmp_path / "t")).count() == 3


def test_mutation_files(spark, tmp_path):
    calls = spark.createDataFrame([("a/1", 20, "A", "C", 1, 99, 99.0, ["L1"], ["x", "y"]), ("a/1", 7, "G", "T", 0, 10, 100.0, ["L1", "L1.1"], None)], "sample string, pos int, ref string, alt string, ref_count long, alt_count long, alt_percent double, levels array<string>, notes array<string>")
    reports.write_mutations(reports.mutation_table(calls), str(tmp_path / "m"), spark.createDataFrame([("a/1",), ("b",)], "sample string"))
    head = "\t".join(reports.MUTATIONS) + "\textra_annotations...\n"
    assert {p.name: p.read_text() for p in (tmp_path / "m").iterdir()} == {"a_1_mutations.tsv": head + "7\tG\tT\t0\t10\t100.00\tL1;L1.1\n20\tA\tC\t1\t99\t99.00\tL1\tx\ty\n", "b_mutations.tsv": head}


def test_quoted_cells_and_levels_in_a_cell(spark, tmp_path):
    (tmp_path / "m.tsv").write_text('10\tA\tC\tL2;L2.2\t"L3\tx"\t\t"say ""hi"""\n11\t"A"\tG\tL1\r\n')
    quoted = files.parse_markers(files.marker_lines(spark, str(tmp_path / "m.tsv"), quoted=True)).orderBy("pos").collect()
    assert [(r.pos, r.ref, r.levels, r.notes) for r in quoted] == [(10, "A", ["L2", "L2.2", "L3\tx"], ['say "hi"']), (11, "A", ["L1"], [])]
    (tmp_path / "r.tsv").write_text("10\tA\tC\tL2;L2.2\tL3\n")
    lines = files.marker_lines(spark, str(tmp_path / "r.tsv"))
    assert files.parse_markers(lines).first().levels == ["L2", "L2.2", "L3"] and files.parse_read_markers(lines).first().levels == ["L2;L2.2", "L3"]


def test_lists_of_samples(spark, tmp_path):
    for name in ("a.fa", "b.fa", "b.gff"):
        (tmp_path / name).write_text("x")
    at = lambda n: str(tmp_path / n)
    (tmp_path / "l.tsv").write_text(f"sample\tfasta\tgff\na\t{at('a.fa')}\nb\t{at('b.fa')}\t{at('b.gff')}\n")
    assert rows(files.assembly_list(spark, at("l.tsv"), "all.gff")) == [("a", at("a.fa"), "all.gff"), ("b", at("b.fa"), at("b.gff"))]
    assert files.pooled_list(spark, at("l.tsv")) == [at("a.fa"), at("b.fa"), at("b.gff")]
    (tmp_path / "m.tsv").write_text(f"a\t{at('none.fa')}\n")
    for read in (files.assembly_list, files.pooled_list):
        with pytest.raises(FileNotFoundError, match="none.fa"):
            read(spark, at("m.tsv"))


def test_files_without_detection_and_forced_pairs(spark):
    paths = spark.createDataFrame([(0, "a/S1_R1.fastq.gz"), (1, "a/S1_R2.fastq.gz"), (2, "b/x.fq"), (3, "b/y.fq")], "ordinal int, path string")
    with pytest.raises(ValueError, match="S1"):
        names.single_files(paths)
    assert rows(names.single_files(paths.where("ordinal > 1"))) == [("x", ["b/x.fq"]), ("y", ["b/y.fq"])]
    assert rows(names.forced_samples(paths)) == [("S1", ["a/S1_R1.fastq.gz", "a/S1_R2.fastq.gz"], True), ("x", ["b/x.fq", "b/y.fq"], False)]
    with pytest.raises(ValueError, match="odd"):
        names.forced_samples(paths.limit(3))


def test_shown_features(spark):
    frame = spark.createDataFrame([("CDS",), ("mRNA",), ("exon",), ("ORF",), (None,)], "type string")
    assert rows(files.shown_features(frame)) == [("CDS", 0), ("ORF", 3), ("mRNA", 2)]


def test_a_model_of_another_version_warns(spark, tmp_path, monkeypatch):
    model = spark.createDataFrame([(0, 0, -1, 0.0, -1, -1, 0)], "tree int, node int, feature int, threshold double, left int, right int, cls int")
    codes = spark.createDataFrame([("x", 0)], "label string, code int")
    M.save(model, codes, str(tmp_path / "m"), 9)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert M.load(spark, str(tmp_path / "m"))[2] == 9
    monkeypatch.setattr(M, "VERSION", "other")
    with pytest.warns(UserWarning, match="was written by"):
        M.load(spark, str(tmp_path / "m"))


def test_labels_and_sequences_that_are_odd(spark):
    codes = spark.createDataFrame([("x", 0), ("y", 1)], "label string, code int")
    frame = spark.createDataFrame([(1, "y"), (2, None), (3, "x")], "seq int, lineage string")
    assert rows(M.encoded(frame, codes, "lineage")) == [(1, "y", 1), (2, None, None), (3, "x", 0)]
    with pytest.raises(Exception, match="unseen label: z"):
        M.encoded(frame.withColumn("lineage", F.lit("z")), codes, "lineage").collect()
    assert spark.range(1).select(S.normalise(F.lit("ac gu\nRyn.~-*j"))).first()[0] == "ACGTRYN---NN"


def test_no_two_samples_share_a_file_name(spark):
    names = ["a b", "a/b", "a_b_2", "a_b_3", "a.b", ".._x_", "x", "", "__", "é", None, "a_b_02", "a?b", "sample_2"]
    got = {r.sample: r.file_name for r in sinks.safe_names(spark.createDataFrame([(n,) for n in names], "sample string")).collect()}
    assert set(got) == set(names) and len(set(got.values())) == len(names)
    assert got["a_b_2"] == "a_b_2" and {got["a b"], got["a/b"], got["a?b"]} == {"a_b", "a_b_4", "a_b_5"} and got["a.b"] == "a.b"
    assert {got[".._x_"], got["x"]} == {"x", "x_2"} and {got[""], got["__"], got["é"], got[None]} == {"sample", "sample_3", "sample_4", "sample_5"}


def test_files_of_samples_come_all_or_none(spark, tmp_path):
    lines = spark.createDataFrame([("a b", 2, "two"), ("a b", 1, "one"), ("a/b", 1, "x"), ("c", 1, None)], "sample string, i int, value string")
    sinks.write_per_sample(lines, str(tmp_path / "o"), ["i"], head="#h")
    files_ = {p.name: p.read_text() for p in (tmp_path / "o").iterdir()}
    assert files_ == {"a_b_mutations.tsv": "#h\none\ntwo\n", "a_b_2_mutations.tsv": "#h\nx\n", "c_mutations.tsv": "#h\n"}
    bad = lines.withColumn("value", F.when(F.col("sample") == "c", F.raise_error("broken").cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        sinks.write_per_sample(bad, str(tmp_path / "p"), ["i"])
    assert not (tmp_path / "p").exists() or not list((tmp_path / "p").iterdir())
    with pytest.raises(Exception, match="already holds"):
        sinks.write_per_sample(lines, str(tmp_path / "o"), ["i"], overwrite=False)
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == sorted(files_)


# ---- forest


def motif_table(spark, n=20):
    rng = random.Random(1)
    motifs = ["".join(rng.choice("ACGT") for _ in range(28)) for _ in range(3)]
    seqs = []
    for c, m in enumerate(motifs):
        for i in range(n):
            s = list((m * 18)[:500])
            for p in rng.sample(range(500), 15):
                s[p] = rng.choice("ACGT")
            seqs.append((c * n + i, c, "".join(s)))
    return spark.createDataFrame(seqs, "seq long, code int, bases string")


def test_forest_separates_motifs(spark):
    table = motif_table(spark)
    cells = features.bucket_counts(table.select(F.col("seq").alias("key"), F.col("bases").alias("seq")), 9, "key").withColumnRenamed("key", "seq").cache()
    labels = table.select("seq", "code")
    model = M.train(cells, labels, trees=10, depth=6, leaf=2).cache()
    assert rows(model) == rows(M.train(cells, labels, trees=10, depth=6, leaf=2))
    ballots = M.votes(cells, model)
    assert ballots.count() == 600
    assert M.accuracy(ballots, labels).first().accuracy >= 80
    assert M.accuracy(M.out_of_bag(ballots, labels, 10), labels).first().accuracy >= 80
    ranked = M.importance(model).collect()
    assert ranked[0]["rank"] == 1 and sum(r.importance_pct for r in ranked) == pytest.approx(100)


def gini_single(y):
    one, total = np.float32(1), np.float32(sum(y))
    squares = np.float32(0)
    for c in y:
        squares += (np.float32(c) * (one / total)) ** 2
    return one - squares


def grown_plainly(cells, codes, drawn, depth, leaf, classes, most, seed=42):
    """One tree by trying every split of the candidates, level by level as nodes are numbered; nodes as (feature, threshold, left, right) or a class."""

    def tally(rows):
        return [sum(drawn[r] for r in rows if codes[r] == c) for c in range(classes)]

    held, nodes, edge, tried = [[r for r in codes if drawn[r]]], {}, [0], []
    for level in range(depth + 1):
        following = []
        for i in edge:
            rows_, y = held[i], tally(held[i])
            nodes[i] = max(range(classes), key=lambda c: (y[c], c))
            if level == depth or max(y) == sum(y) or sum(y) <= 2 * leaf:
                continue
            there = np.array(sorted({b for r in rows_ for b in cells[r]}), dtype=np.int64)
            order = M.draw_order(np.full(len(there), i, np.int64), there, seed)
            chosen = sorted(there[np.argsort(order, kind="stable")[:most]].tolist())
            tried.append((len(there), len(chosen)))
            best = None
            for f in chosen:
                points = sorted({cells[r].get(f, 0) for r in rows_})
                for lo, hi in zip(points, points[1:]):
                    low = [r for r in rows_ if cells[r].get(f, 0) <= lo]
                    p, q = tally(low), [x - z for x, z in zip(y, tally(low))]
                    gain = gini_single(y) - (np.float32(sum(p)) * gini_single(p) + np.float32(sum(q)) * gini_single(q)) / np.float32(sum(y)) if sum(p) and sum(q) else -1
                    if min(sum(p), sum(q)) >= leaf and gain > (best[0] if best else 0):
                        best = gain, f, (lo + hi) / 2, low
            if best:
                left, right = len(held), len(held) + 1
                held += [best[3], [r for r in rows_ if r not in set(best[3])]]
                nodes[i] = (best[1], best[2], left, right)
                following += [left, right]
        edge = following
    return nodes, tried


@pytest.fixture(scope="module")
def small_forest(spark):
    rng = np.random.default_rng(5)
    codes = {i: int(rng.integers(0, 3)) for i in range(70)}
    cells = {i: {int(b): int(rng.integers(1, 4)) + codes[i] * int(b % 3 == 0) for b in rng.choice(25, 8, replace=False)} for i in codes}
    cells[69] = {}  # too short for a k-mer
    frame = spark.createDataFrame([(i, b, n) for i, own in cells.items() for b, n in own.items()], "seq long, bucket int, cnt long").repartition(5)
    return codes, cells, frame, spark.createDataFrame(list(codes.items()), "seq long, code int")


@pytest.mark.parametrize("most", [7, 1024])
def test_trees_equal_plain(spark, small_forest, most):
    codes, cells, frame, labels = small_forest
    for seed in (42, 7):  # each forest is one tree, so that nodes are numbered alike
        nodes = {r.node: r for r in M.train(frame, labels, trees=1, depth=5, leaf=2, seed=seed, most=most).collect()}
        drawn = {r.seq: r.drawn[0] for r in M.bootstrap(labels, "seq", 1, seed).collect()}
        want, tried = grown_plainly(cells, codes, drawn, 5, 2, 3, most, seed)
        assert {i: r.cls if r.feature < 0 else (r.feature, r.threshold, r.left, r.right) for i, r in nodes.items()} == want
        assert most == 1024 or any(there > most == used for there, used in tried)


def test_walks_and_out_of_bag(spark, small_forest):
    codes, cells, frame, labels = small_forest
    model = M.train(frame, labels, trees=3, depth=4, leaf=3)
    nodes = {(r.tree, r.node): r for r in model.collect()}

    def call(tree, i, row):
        r = nodes[tree, i]
        return r.cls if r.feature < 0 else call(tree, r.left if row.get(r.feature, 0) <= r.threshold else r.right, row)

    walked = {(r.seq, r.tree): r.code for r in M.votes(frame, model).collect()}
    assert walked == {(i, tree): call(tree, 0, cells[i]) for i in codes if cells[i] for tree in range(3)}
    drawn = {r.seq: r.drawn for r in M.bootstrap(labels, "seq", 3).collect()}
    oob = {(r.seq, r.tree) for r in M.out_of_bag(M.votes(frame, model), labels, 3).collect()}
    assert oob == {(i, t) for t in range(3) for i in codes if cells[i] and not drawn[i][t]}
    with pytest.raises(ValueError):
        M.train(frame, labels.withColumn("code", F.lit(1)), trees=1)
    with pytest.raises(ValueError):
        M.cross_validation(frame, labels.limit(3), 4)


def test_bootstrap_draws_n_of_n(spark):
    frame = spark.range(20_000).withColumnRenamed("id", "seq")
    bags = {r.seq: r.drawn for r in M.bootstrap(frame, "seq", 4, bin_rows=300).collect()}
    drawn = np.array([bags[i] for i in range(20_000)])
    assert drawn.sum(axis=0).tolist() == [20_000] * 4
    for n, share in enumerate((0.3679, 0.3679, 0.1839)):
        assert np.allclose((drawn == n).mean(axis=0), share, atol=0.015)
    assert abs(np.corrcoef(drawn.T)[0, 1]) < 0.05
    again = {r.seq: r.drawn for r in M.bootstrap(frame.repartition(7, F.rand(1)), "seq", 4, bin_rows=300).collect()}
    assert again == bags
    assert {r.seq: r.drawn[:2] for r in M.bootstrap(frame, "seq", 2, bin_rows=300).collect()} == {i: d[:2] for i, d in bags.items()}
    assert M.bootstrap(frame.limit(1), "seq", 3).first().drawn == [1, 1, 1] and M.bootstrap(frame.limit(0), "seq", 3).collect() == []


def test_splits_check_their_parameters(spark):
    frame = spark.range(5).withColumn("l", F.lit("x"))
    with pytest.raises(ValueError):
        M.stratified_folds(frame, "l", "id", 1)
    with pytest.raises(ValueError):
        M.holdout_split(frame, "id", 1.0)


# ---- streams


def test_a_stream_that_was_killed_ends_with_the_batch_totals(spark, tmp_path, monkeypatch):
    reads = spark.createDataFrame([("s", "ACGTACGTACGT"), ("t", "GGGGGGACGT"), ("u", "ACGTTTTT")] * 3, "sample string, seq string")
    reads.repartition(5).write.parquet(str(tmp_path / "in"))
    start = lambda: totals.kmer_totals(spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 5)
    table, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    write = DataFrameWriter.parquet

    def failing(self, path, *a, **k):
        write(self, path, *a, **k)  # what it wrote stays, as if it died before the trigger was noted
        if path.endswith("trigger=1"):
            raise RuntimeError("killed")

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(Exception, match="killed"):
        totals.run_available(start(), table, checkpoint)
    monkeypatch.undo()
    assert rows(totals.latest(spark, table, ["kmer"])) != rows(contain.kmer_counts(reads, 5))
    totals.run_available(start(), table, checkpoint)
    assert rows(totals.latest(spark, table, ["kmer"])) == rows(contain.kmer_counts(reads, 5))
    totals.compact(spark, table, str(tmp_path / "n"), ["kmer"])
    assert rows(totals.latest(spark, str(tmp_path / "n"), ["kmer"])) == rows(contain.kmer_counts(reads, 5))


def test_model_round_trip_and_cross_validation(spark, tmp_path):
    table = motif_table(spark, 12)
    cells = features.bucket_counts(table.select(F.col("seq").alias("key"), F.col("bases").alias("seq")), 9, "key").withColumnRenamed("key", "seq").cache()
    labels = table.select("seq", "code")
    model = M.train(cells, labels, trees=3, depth=5, leaf=2)
    codes = labels.select(F.col("code").cast("string").alias("label"), "code").distinct()
    M.save(model, codes, str(tmp_path / "m"), 9)
    again, back, k = M.load(spark, str(tmp_path / "m"))
    assert k == 9 and rows(again) == rows(model) and rows(back) == rows(codes)
    M.save(model.limit(0), codes, str(tmp_path / "e"), 9)
    with pytest.raises(ValueError):
        M.load(spark, str(tmp_path / "e"))
    cv = M.cross_validation(cells, labels, 2, trees=3, depth=5, leaf=2).first()
    assert cv["mean"] >= 80 and cv.deviation >= 0


def test_table_functions_equal_the_native_form(spark):
    from kmerlake.functions import udtf

    udtf.register(spark)
    spark.createDataFrame([("a", "ACGTNACGG"), ("b", "AC"), ("c", None)], "id string, seq string").createOrReplaceTempView("udtf_reads")
    native = S.explode_kmers(spark.table("udtf_reads"), 3)
    assert rows(spark.sql("select id, pos, kmer from udtf_reads, lateral kmers(seq, 3)")) == rows(native)
    assert rows(spark.sql("select id, pos, kmer from udtf_reads, lateral canonical_kmers(seq, 3)")) == rows(native.select("id", "pos", S.canonical(F.col("kmer"))))


def test_driver_side_names():
    assert names.forced_pairs(["a", "b", "c", "d"]) == [("a", "b"), ("c", "d")]
    with pytest.raises(ValueError):
        names.forced_pairs(["a"])
    assert names.unique_names(["x", "x", "x_2", "x"]) == ["x", "x_2", "x_2_2", "x_3"]


def test_catalogue_joins_and_counts(spark):
    variants = spark.createDataFrame([("a", "rpoB"), ("b", "rpoB"), ("c", "katG"), ("d", "other")], "variant string, gene string")
    grades = spark.createDataFrame([("a", "INH", "1) Assoc w R"), ("a", "RIF", "2) Assoc w R - Interim"), ("b", "RIF", "5) Not assoc w R"), ("b", "INH", "3) Uncertain significance")], "variant string, drug string, grade string")
    drugs = spark.createDataFrame([("rpoB", "RIF"), ("katG", "INH")], "gene string, drug string")
    got = sorted(tuple(r) for r in C.with_drug(variants, grades, drugs).collect())
    assert got == [("a", "rpoB", "RIF_INH", "1) Assoc w R"), ("b", "rpoB", "RIF", "3) Uncertain significance"), ("c", "katG", "INH", "Unknown")]
    genes = spark.createDataFrame([(1, "x", "R1", 1, 9, "+"), (2, "R1", "R2", 20, 30, "-"), (3, "x", "R3", 40, 50, "+"), (4, "", "R2", 60, 70, "+")], "ordinal int, name string, gene_id string, start int, end int, strand string")
    asked = spark.createDataFrame([("x",), ("R1",), ("R2",), ("R3",), ("none",)], "gene string")
    assert sorted((r.gene, r.start) for r in C.gene_of(asked, genes).collect()) == [("R1", 20), ("R2", 20), ("R3", 40), ("x", 40)]
    markers = spark.createDataFrame([("RIF", "snp", "1"), ("RIF", "snp", "2"), ("INH", "snp", "1")], "drug string, type string, grade string")
    assert sorted(tuple(r) for r in C.catalogue_counts(markers).collect()) == [("drug", "INH", 1), ("drug", "RIF", 2), ("grade", "1", 2), ("grade", "2", 1), ("type", "snp", 3)]
    one, other = (spark.createDataFrame([(s,)], "seq string") for s in ("ACGTACGTAC", "ACCTACGTTCGG"))
    assert [C.reference_differences(one, other, n).first().n for n in (3, 100)] == [2, 2]


def test_columns_by_token_and_search_by_position(spark):
    names = ["Sample ID", "SNP-reference (pos)", "alt", "Alt_Fraction"]
    assert I.header("  SNP-reference (pos)") == "snp_reference_pos_"
    assert [I.column_of(names, t) for t in (["sample id"], ["alt"], ["sam"], ["nope", "fraction"])] == ["Sample ID", "alt", None, "Alt_Fraction"]
    assert I.column_of(names, ["fraction"], exact_only=True) is None
    frame = spark.createDataFrame([(7, 70, "g7"), (17, 7, "x"), (77, 71, "7")], "g int, r int, gene string")
    assert [r.g for r in I.scored_search(frame, ["g", "r", "gene"], " 7 ", ["g", "r"], positions=("g", "r")).collect()] == [7, 17]
    assert [r.g for r in I.scored_search(frame, ["g", "gene"], "g7", ["g"], positions=("g", "r")).collect()] == [7]


def test_literature_grades(spark):
    said = {"Assoc w R": "1) Assoc w R", "Assoc w R - Interim": "2) Assoc w R - Interim", "Uncertain significance": "3) Uncertain significance", "Not assoc w R - Interim": "4) Not assoc w R - Interim", "Not assoc w R": "5) Not assoc w R", "assoc w r": "TBProfiler_literature", None: "TBProfiler_literature"}
    frame = spark.createDataFrame([(k, v) for k, v in said.items()], "said string, want string")
    assert all(r.want == r.got for r in frame.select("want", C.literature_grade(F.col("said")).alias("got")).collect())
    graded = spark.createDataFrame([("v", "RIF", "1) x"), ("v", "XYZ", "1) x"), ("w", "XYZ", "1) x")], "variant string, drug string, grade string")
    assert rows(C.collapse(graded).select("variant", "label")) == [("v", "RIF")]


def test_reports(spark):
    records = spark.createDataFrame([("/d/a.fa", 0, "c1", "ACGT", "s1"), ("/d/a.fa", 1, "c2", "ACGT", "s1")], "file string, ordinal int, id string, seq string, sample string")
    names_of = {m: sorted({r.genome for r in reports.named_contigs(records, m).collect()}) for m in ("listed", "records", "files")}
    assert names_of == {"listed": ["s1"], "records": ["c1", "c2"], "files": ["[a.fa] c1", "[a.fa] c2"]}
    with pytest.raises(ValueError):
        reports.named_contigs(records, "odd")
    made = scan.diagnostic_kmers(panel(spark, [(150, 1, ALT)]), REF, 11)
    contigs = spark.createDataFrame([("g", 0, REF[:149] + ALT + REF[150:]), ("none", 0, "ACGT" * 10)], "genome string, contig int, seq string")
    got = {r.genome: r for r in reports.hit_detail(contigs, made, None, REF, 11).collect()}
    assert list(got["g"].asDict()) == list(reports.DETAIL) and got["g"]["SNPgenome"] == 150 and got["g"]["AA_Pos"] is None
    assert [v for k, v in got["none"].asDict().items() if k != "genome"] == [None] * 12
    summary = spark.createDataFrame([("b", "L1", 0.5, 0.25, "L2:1"), ("a", "L2", 1.0, 1.0, "")], "seq string, winner string, confidence double, margin double, others string")
    assert [tuple(r) for r in reports.prediction_table(summary).collect()] == [("a", "L2", "1.0000", "1.0000", ""), ("b", "L1", "0.5000", "0.2500", "L2:1")]
    assert tuple(reports.match_table(spark.createDataFrame([(3, 0.25)], "ref_id int, score double"), ["x.fq", "y.fq"]).first()) == ("x.fq,y.fq", "3", "0.2500")
    calls = spark.createDataFrame([("s", 5, "A", "G", 1, 9, 90.0, ["L1", "L1.1"], ["n1", "n2"]), ("s", 7, "C", "T", 0, 20, 100.0, ["L2"], [])], "sample string, pos int, ref string, alt string, ref_count long, alt_count long, alt_percent double, levels array<string>, notes array<string>")
    lines = [r.value for r in reports.mutation_lines(reports.mutation_table(calls)).orderBy("value").collect()]
    assert lines == ["5\tA\tG\t1\t9\t90.00\tL1;L1.1\tn1\tn2", "7\tC\tT\t0\t20\t100.00\tL2"]
    ranked = spark.createDataFrame([(1, 7, 3, 75.0), (2, 9, 1, 25.0)], "rank int, bucket int, split_count long, importance_pct double")
    kmers_ = spark.createDataFrame([(7, "ACG,CGT")], "bucket int, kmers string")
    assert [tuple(r) for r in reports.importance_table(ranked, kmers_).collect()] == [(1, 7, 3, "75.0000", "ACG,CGT"), (2, 9, 1, "25.0000", "")]
    places = spark.createDataFrame([("b", 4, "ACG", 7), ("a", 9, "CGT", 7), ("a", 2, "CGT", 9)], "seq string, position int, kmer string, bucket int")
    assert [(r["rank"], r.seq, r.position) for r in reports.coordinate_table(places, ranked, "seq").collect()] == [(1, "a", 9), (1, "b", 4), (2, "a", 2)]
