from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seqspark.functions import codes, names, scalar, translation
from seqspark.operators import bait, cascade, clips, edits, kmers, overlap, pileup, pool, reads, stats
from seqspark.plans import registry
from seqspark.plans.read_queries import saver
from seqspark.sources import records, text_formats, traces
from seqspark.streaming import bait_stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_kmers_break_at_other_letters(spark):
    r = spark.createDataFrame([(1, "ACGNACGT"), (2, "AC"), (3, "")], "read_id long, seq string")
    assert rows(kmers.kmers(r, 3, "read_id")) == [(1, "ACG"), (1, "ACG"), (1, "CGT")]
    assert rows(kmers.positioned(r, 3, "read_id")) == [(1, 0, "ACG"), (1, 4, "ACG"), (1, 5, "CGT")]


def test_counts_keep_strands_apart(spark):
    r = spark.createDataFrame([("AAC", 1), ("AAC", 2), ("GTT", 1), ("ATAT", 1)], "kmer string, seqtype int")
    got = {x.kmer: (x.fcount, x.rcount, x.seqtype) for x in kmers.count(r, 3).collect()}
    assert got == {"AAC": (2, 1, 15), "GTT": (1, 2, 15), "ATAT": (1, 1, 1)}  # a palindrome counts on both strands


def test_average_frequency(spark):
    data = [(f"k{n}", n, n) for n in range(1, 41)]
    s = spark.createDataFrame(data, "kmer string, fcount long, rcount long")
    counts = [2 * n for n in range(3, 39)]  # 5% off either end
    run, want = 0, 0
    for c in counts:
        run += c
        if run > sum(counts) // 2:
            want = c
            break
    assert kmers.average_frequency(s).first()[0] == want


def test_dust_and_forks(spark):
    assert {"ACACAC", "AAAAAA", "ACGACG", "ACGTAC"} <= set(kmers.dust_ends(6)) and "ACGTTT" not in kmers.dust_ends(6)
    s = spark.createDataFrame([("AACG", 3, 3), ("AACT", 3, 3), ("GGGG", 1, 1)], "kmer string, fcount long, rcount long")
    assert rows(kmers.forks_strict(s, 2)) == [("AACG",), ("AACT",)]
    t = spark.createDataFrame([("AACG", 9, 9), ("AACT", 1, 1)], "kmer string, fcount long, rcount long")
    assert rows(kmers.forks_relaxed(t)) == [("AACT", 1, 1)]


def test_bait(spark):
    r = spark.createDataFrame([(1, "AAACCCGGG"), (2, "TTTTTTTTT"), (3, "CC")], "read_id long, seq string")
    b = spark.createDataFrame([("CCCGGGTTT",)], "seq string")
    got = {x.read_id: (x.hits, x.taken) for x in bait.take(r, b, 4, -2, "read_id").collect()}
    assert got[1] == (6, True) and got[2] == (0, False) and got[3] == (0, True)  # a short read needs none
    stream = {x.read_id: x.hits for x in bait_stream.screen(r, b, 4, 1).collect()}
    assert stream == {1: 6}


def test_stream_equals_batch(spark, tmp_path):
    r = spark.createDataFrame([(k, "AAACCCGGG"[k % 5 :]) for k in range(20)], "read_id long, seq string")
    b = spark.createDataFrame([("CCCGGGTTT",)], "seq string")
    r.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for more in (0, 1):  # a second run goes on after the first
        q = bait_stream.start(stream, b, 4, 1, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        q.processAllAvailable()
        q.stop()
        got = spark.read.parquet(f"{tmp_path}/out")
        assert rows(got.select("read_id", "hits")) == rows(bait_stream.screen(r, b, 4, 1)) and got.select("batch").distinct().count() > 1
        if not more:
            extra = spark.createDataFrame([(100, "CCCGG")], "read_id long, seq string")
            extra.write.mode("append").parquet(f"{tmp_path}/in")
            r = r.union(extra)


def test_coverage(spark):
    p = spark.createDataFrame([(1, 0, 4), (1, 2, 4), (1, 10, 1)], "contig long, start long, len long")
    assert rows(stats.coverage(p)) == [(1, 0, 2, 1), (1, 2, 4, 2), (1, 4, 6, 1), (1, 10, 11, 1)]
    s = stats.coverage_stats(stats.coverage(p)).first()
    assert (s.min_cov, s.max_cov, s.sum_cov, s.positions) == (1, 2, 9, 7)
    assert s.stddev_cov == pytest.approx((13 / 7 - (9 / 7) ** 2) ** 0.5)


def test_masks_and_islands(spark):
    m = spark.createDataFrame([(1, k, int(k in (2, 3, 4, 9))) for k in range(12)], "c long, p long, m int")
    opened = stats.dilate(stats.erode(m, "c", "p", 1), "c", "p", 1).where("m = 1")
    assert rows(stats.islands(opened, "c", "p")) == [(1, 2, 4, 3)]


def test_n50(spark):
    n = spark.createDataFrame([(x,) for x in (80, 70, 50, 40, 30, 20)], "len long")
    r = stats.n_stats(n, 0.5, 0.9).first()
    assert (r.contigs, r.total, r.longest, r.n50, r.n90) == (6, 290, 80, 70, 30)


def test_scalars(spark):
    d = spark.createDataFrame([("ACGTN", "ATGGCNTAA", "r/1", "r/2x", "a%3Bb+c", "x<y")], "a string, b string, c string, d string, e string, f string")
    got = d.select(scalar.reverse_complement(F.col("a")), scalar.translate_dna(F.col("b")), scalar.template_of(F.col("c")), scalar.template_of(F.col("d")), scalar.segment_of(F.col("d")), codes.gff3_decode(F.col("e")), codes.html_escape(F.col("f"))).first()
    assert tuple(got) == ("NACGT", "MX*", "r", "r_x", 255, "a;b+c", "x&lt;y")


def test_pairs(spark):
    r = spark.createDataFrame([("t", 1), ("t", 2), ("u", 3), ("v", 4), ("v", 5), ("v", 6)], "template string, id long")
    got = {x.id: x.partner for x in reads.resolve_pairs(r, "template", "template", "id").collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: None, 5: None, 6: None}
    p = spark.createDataFrame([("t", 0, 50, False, 250, 50, True), ("u", 0, 50, True, 250, 50, False)], "template string, pos1 int, len1 int, rev1 boolean, pos2 int, len2 int, rev2 boolean")
    assert rows(reads.sam_flags(p, 200, 400)) == [("t", 99, 147, 300, True), ("u", 81, 161, 300, False)]


def test_overlaps(spark):
    h = spark.createDataFrame([(2, 1, 5), (2, 1, 6), (2, 1, 300)], "rid1 long, rid2 long, eoffset long")
    assert rows(overlap.by_diagonal(h)) == [(2, 1, 0, 2, 5, 6), (2, 1, 1, 1, 300, 300)]
    e = spark.createDataFrame([(2, 1, 5, 9)], "rid1 long, rid2 long, eoffset long, weight long")
    assert rows(overlap.symmetric(e)) == [(1, 2, -5, 9), (2, 1, 5, 9)]
    bans = spark.createDataFrame([(1, 2)], "lo long, hi long")
    assert overlap.not_banned(e, bans).count() == 0


def test_unitigs_and_components(spark):
    nodes = spark.createDataFrame([(x,) for x in ("AAC", "ACG", "CGT", "CGA", "GAT")], "kmer string")
    assert rows(overlap.unitigs(nodes, saver(spark))) == [("AAC", 2, "ACG"), ("CGA", 2, "GAT"), ("CGT", 1, "CGT")]
    ids, e = spark.range(8).toDF("id"), spark.createDataFrame([(1, 2), (2, 3), (6, 5)], "a long, b long")
    assert rows(overlap.components(e, ids, saver(spark))) == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7)]


def test_pileup(spark):
    p = spark.createDataFrame([(1, 1, b, q, r) for b, q, r in (("A", 30, False), ("A", 25, False), ("A", 20, True), ("C", 90, True), ("C", 90, False))], "contig int, pos int, base string, qual int, rev boolean")
    g = pileup.groups(p)
    assert rows(g.select("base", "n", "fwd", "bwd", "quality")) == [("A", 3, 2, 1, 52), ("C", 2, 1, 1, 90)]
    assert rows(pileup.majority(g)) == [(1, 1, "A", 3, 52)]
    assert rows(pileup.short_read_consensus(g)) == [(1, 1, "M", 2)]


def test_formats_round_trip(spark, tmp_path):
    r = spark.createDataFrame([("a", "ACGTN" * 30, [20] * 150), ("b", "AC", [1, 40])], "name string, seq string, qual array<int>").coalesce(1)
    text_formats.write_fasta(r, f"{tmp_path}/f")
    assert rows(text_formats.read_fasta(spark, f"{tmp_path}/f").select("name", "seq")) == rows(r.select("name", "seq"))
    text_formats.write_fastq(r, f"{tmp_path}/q")
    assert rows(text_formats.read_fastq(spark, f"{tmp_path}/q").select("name", "seq", F.to_json("qual"))) == rows(r.select("name", "seq", F.to_json("qual")))
    g = spark.createDataFrame([("c", "s", "gene", 1, 9, ".", "+", ".", {"ID": "g;1", "Note": "a%b"})], "seqid string, source string, type string, start int, stop int, score string, strand string, phase string, attributes map<string,string>")
    text_formats.write_gff3(g, f"{tmp_path}/g")
    assert text_formats.read_gff3(spark, f"{tmp_path}/g").first() == g.first()


def test_malformed_files(spark, tmp_path):
    for name, text in (("noname", ">\nACGT\n"), ("wrongbase", ">x\nAC7GT\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="name|illegal"):
            text_formats.read_fasta(spark, str(tmp_path / name)).collect()
    (tmp_path / "q").write_text(">x\n1 2 three\n")
    with pytest.raises(Exception, match="bad quality"):
        text_formats.read_fasta_qual(spark, str(tmp_path / "q")).collect()
    (tmp_path / "ok").write_text(">x\nACG\n")
    (tmp_path / "short").write_text(">x\n1 2\n")
    with pytest.raises(Exception, match="lengths differ"):
        text_formats.with_qualities(text_formats.read_fasta(spark, str(tmp_path / "ok")), text_formats.read_fasta_qual(spark, str(tmp_path / "short"))).collect()
    (tmp_path / "kv").write_text("# c\nkey  a value # x\n\nalone\n")
    assert rows(text_formats.read_key_values(spark, str(tmp_path / "kv"))) == [("alone", ""), ("key", "a value")]


def test_each_query_has_sql():
    # alignments and the walk of a normalisation are tested against brute force
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"alignment_bans", "alignment_edges", "normalised_reads", "overlap_alignments"} and len(registry.queries()) > 45


def test_treatment(spark):
    from seqspark.operators import treat

    d = spark.createDataFrame([("AACC*Nn",)], "s string")
    got = d.select(treat.collapse_runs(F.col("s")), treat.blind(F.col("s")), treat.hard_trim(F.col("s"), F.lit(1), F.lit(4)), treat.hard_trim(F.col("s"), F.lit(4), F.lit(1))).first()
    assert tuple(got) == ("AC*Nn", "cccc*Nn", "ACC", "")
    t = treat.tiles(spark.createDataFrame([("a", "ACGTACG"), ("b", "")], "name string, seq string"), 4, 3)
    assert rows(t) == [("a", 0, "ACGT"), ("a", 3, "TACG"), ("a", 6, "G")]
    r = spark.createDataFrame([(1, [2, 2, 30, 30, 30, 2]), (2, [1, 1]), (3, None)], "read_id long, qual array<int>")
    assert rows(treat.quality_clips(r, 20, 3)) == [(1, 1, 6), (2, 0, 0), (3, 0, 0)]


def test_names_and_codes(spark):
    d = spark.createDataFrame([("abc.p1x",), ("abc.",), ("xTFa",), ("TR",)], "n string")
    n = F.col("n")
    got = d.select(*names.dotted(n, "sanger"), *names.dotted(n, "fr"), *names.tigr(n)).collect()
    assert [tuple(r) for r in got] == [("abc_1x", 1, "abc_1x", 0, "abc.p1x", 0), ("abc", 0, "abc.", 0, "abc.", 0), ("xTFa", 0, "xTFa", 0, "x_a", 1), ("TR", 0, "TR", 0, "TR", 255)]
    one = spark.createDataFrame([("a;b=c,%\t\x7f+é", "a%20b%zz%4")], "a string, b string")
    coded = one.select(codes.gff3_encode(F.col("a")).alias("x"), codes.gff3_decode(F.col("b")).alias("y")).first()
    assert coded.x == "a%3Bb%3Dc%2C%25%09%7F+é" and coded.y == "a b%zz%4"
    assert one.select(codes.gff3_decode(codes.gff3_encode(F.col("a")))).first()[0] == "a;b=c,%\t\x7f+é"
    attrs = one.select(codes.gff3_attributes(F.lit("ID=x%3By;Note=a+b; ;ID=z")).alias("m")).first().m
    assert attrs == {"ID": "z", "Note": "a+b"}


def test_translation(spark):
    one = spark.range(1)
    p = one.select(translation.translate(F.lit("ATG*TGATAG")), translation.translate(F.lit("ATGTGATAG"), 4), translation.translate(F.lit("CTATCACAT"), reverse=True, to_stop=True), translation.amino_acid(F.lit("ATH")), translation.amino_acid(F.lit("NNN")), translation.codon_index(F.lit("GGG"))).first()
    assert tuple(p) == ("M**", "MW*", "M*", "I", "X", 63)
    q = one.select(translation.identity(F.lit("MAB*Q"), F.lit("MAC")), translation.identity(F.lit(""), F.lit("")), translation.contained(F.lit("R"), F.lit("a")), translation.bases_of(F.lit("Y")), translation.is_start(F.lit("ttg"), 11)).first()
    assert q[0] == pytest.approx(200 / 3) and tuple(q)[1:] == (1.0, True, ["C", "T"], True)
    with pytest.raises(ValueError):
        translation.amino_acids(7)


def test_edits_and_clips(spark):
    d = spark.createDataFrame([("AAACCGT*NN", list(range(1, 11)), [(0, 2, "HAF3"), (5, 9, "SRMr")])], "seq string, qual array<int>, tags array<struct<from:int,to:int,id:string>>")
    s, q, t = F.col("seq"), F.col("qual"), F.col("tags")
    got = d.select(edits.rle_seq(s), edits.rle_lengths(s), edits.rle_qual(s, q), edits.unrle(edits.rle_seq(s), edits.rle_lengths(s)), edits.weakest_in_run(s, q, F.lit(1)), edits.has_tag(t, "SRMr", F.lit(4)), edits.count_tags(t, "HAF3"), edits.delete_tags(t, "HAF3")).first()
    assert tuple(got)[:7] == ("ACGT*NN", [3, 2, 1, 1, 1, 1, 1], [2, 4, 6, 7, 8, 9, 10], "AAACCGT*NN", 0, False, 1) and len(got[7]) == 1
    long = "ACXX" + "AX" * 20_000 + "ACGTACGTACGT"
    c = spark.createDataFrame([(long,), ("ACGT",), ("",)], "s string").select(clips.mask_left(F.col("s"), 1, 2).alias("l"), clips.mask_right(F.col("s"), 1, 2).alias("r")).collect()
    assert [tuple(x) for x in c] == [(40_004, len(long)), (0, 4), (0, 0)]
    poly = spark.createDataFrame([("CGAAAACAAAATTG",)], "s string").select(*clips.poly_front(F.col("s"), "a", 8, 1, 3), *clips.poly_end(F.col("s"), "t", 2, 0, 2), clips.end_base(F.col("s"), 4)).first()
    assert tuple(poly) == (2, 10, 11, 12, "t")


def test_cascade(spark):
    kind = "edge_id long, rid1 long, rid2 long, eoffset long, ratio long, weight long, len1 long, len2 long, rept boolean, weakgood boolean, taken boolean"
    e = spark.createDataFrame([(1, 1, 2, 10, 100, 50, 100, 100, False, False, False), (2, 1, 3, 20, 96, 40, 100, 100, True, False, False), (3, 1, 4, -5, 90, 30, 100, 100, False, True, False), (4, 2, 5, 0, 100, 20, 100, 100, False, False, False), (5, 3, 1, 0, 80, 5, 100, 50, False, False, False)], kind)
    taken = lambda d: sorted(r.edge_id for r in d.where("taken").collect())
    # reads 2 to 5 have no edges of their own that extend both sides, so only with those are they well connected
    assert taken(cascade.take_non_repeat(e, 1, 85)) == []
    more = [(10 * r + k, r, 9, off, 100, 1, 100, 100, False, False, False) for r in (2, 3, 4) for k, off in enumerate((10, -10))]
    full = e.union(spark.createDataFrame(more, kind))
    assert taken(cascade.take_non_repeat(full, 1, 85)) == [1, 3]
    assert taken(cascade.take_non_repeat(full, 1, 85, spark.createDataFrame([(1,), (2,)], "read_id long"))) == [1]
    assert taken(cascade.take_identical(e, 1)) == [4]
    steps = cascade.cascade(e, lambda x: cascade.take_identical(x, 1), lambda x: cascade.take_for_untaken_reads(x, 1))
    assert taken(steps) == [1, 4, 5]
    assert rows(cascade.best_ratios(e)) == [(1, 85, 95), (2, 0, 0), (3, 0, 0)]
    assert cascade.repeat_reads(e).count() == 2 and cascade.without_reads(e, cascade.repeat_reads(e)).count() == 1


def test_consensus_by_largest_group(spark):
    g = spark.createDataFrame([(1, 1, "*", 6, 3, 3, 50), (1, 1, "A", 4, 2, 2, 40), (1, 2, "C", 3, 1, 2, 30), (1, 2, "T", 3, 1, 2, 20), (1, 3, "G", 20, 9, 11, 80), (1, 3, "A", 1, 1, 0, 9)], "contig int, pos int, base string, n long, fwd long, bwd long, quality long")
    assert rows(pileup.largest_group_consensus(g, True)) == [(1, 1, "A", 10), (1, 2, "Y", 25), (1, 3, "G", 80)]
    assert rows(pileup.largest_group_consensus(g, False))[0] == (1, 1, "*", 10)
    assert rows(pileup.text_consensus(g)) == [(1, 1, "*", 50, "A*"), (1, 2, "C", 30, "CT"), (1, 3, "G", 80, "G")]


def test_records(spark, tmp_path):
    assert records.parse_location("complement(join(<1..5,10..>20))") == [(-1, 1, 5), (-1, 10, 20)]
    assert records.parse_location("join(3,complement(7^8),(2.4)..(9.12))") == [(1, 3, 3), (-1, 7, 8), (1, 2, 12)]
    with pytest.raises(ValueError):
        records.parse_location("somewhere")
    (tmp_path / "a.phd").write_text("BEGIN_SEQUENCE r1\nBEGIN_COMMENT\nEND_COMMENT\nBEGIN_DNA\na 10 5\nc 20 17\nEND_DNA\nEND_SEQUENCE\nBEGIN_SEQUENCE r2\nBEGIN_DNA\ng 1 2\nEND_DNA\n")
    assert rows(records.read_phd(spark, f"{tmp_path}/a.phd")) == [("r1", "AC", [10, 20], [5, 17]), ("r2", "G", [1], [2])]
    (tmp_path / "a.exp").write_text("ID   x.1\nQL   2\nQR   7\nTN   x\nSQ\n     ACGT-CGTA\n//\nTG   SVEC = 1..2\n")
    r = records.read_exp(spark, f"{tmp_path}/a.exp").first()
    assert (r["name"], r.seq, r.ql, r.qr, r.sl, r.sr, r.template, len(r.tags)) == ("x.1", "ACGTNCGTA", 2, 6, 0, 9, "x", 1)
    (tmp_path / "a.gb").write_text('LOCUS       U1  12 bp\nFEATURES             Location/Qualifiers\n     gene            1..6\n                     /gene="g1"\n                     /locus_tag="t1"\n     CDS             join(1..3,\n                     4..6)\n                     /locus_tag="t1"\n                     /product="a long\n                     name"\nORIGIN\n        1 acgtac gtacgt\n//\n')
    seqs, feats = records.read_genbank(spark, f"{tmp_path}/a.gb")
    assert rows(seqs) == [("U1", "acgtacgtacgt")]
    cds = feats.where("type = 'CDS'").withColumn("at", records.locations(F.col("location"))).first()
    assert cds.location == "join(1..3,4..6)" and cds.qualifiers == {"locus_tag": "t1", "product": "a long name", "gene": "g1"} and [tuple(x) for x in cds["at"]] == [(1, 1, 3), (1, 4, 6)]
    reads_ = spark.createDataFrame([("r1", 2, "ACGTAC", [1, 2, 3, 4, 5, 60], 1, 5), ("r2", 0, "GG", [9, 9], 0, 2)], "name string, rg int, seq string, qual array<int>, ql int, qr int")
    records.maf_read(reads_).write.text(f"{tmp_path}/maf")
    assert rows(records.read_maf_reads(spark, f"{tmp_path}/maf")) == rows(reads_)
    assert [r.seq for r in records.masked(reads_).collect()] == ["XCGTAX", "GG"] and records.clipped(reads_).first().qual == [2, 3, 4, 5]
    got = spark.range(1).select(records.cigar(F.lit("AC*GT*A"), F.lit("ACGG*TA"), F.lit(2), F.lit(0))).first()[0]
    assert got == "2S2M1D1M1I1D1M"
    head = records.sam_header(spark.createDataFrame([("c1", 7)], "name string, len int"), spark.createDataFrame([(1, "s", "solexa")], "id int, sample string, technology string"), "x").orderBy("nth").collect()
    assert [h.value for h in head] == ["@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:c1\tLN:7", "@RG\tID:1\tSM:s\tPL:SOLEXA", "@PG\tID:x\tPN:x"]
    (tmp_path / "t.xml").write_text("<trace_volume><trace><trace_name>r1</trace_name><template_id>tt</template_id><clip_quality_left>3</clip_quality_left></trace></trace_volume>")
    t = records.read_traceinfo(spark, f"{tmp_path}/t.xml").first()
    assert (t["name"], t.template, t.ql, t.qr) == ("r1", "tt", 3, None)


def test_tools(spark, tmp_path):
    from seqspark import tools

    assert tools.file_type("a/b.fq.gz") == ("fastq", "a/b.fq.gz") and tools.file_type("EXP::x.fasta") == ("exp", "x.fasta")
    (tmp_path / "r.fasta").write_text(">a\nAAACCCGGG\n>b\nTTTTTTTTT\n")
    (tmp_path / "bait.fasta").write_text(">x\nAACCCGG\n")
    (tmp_path / "names").write_text("b\n")
    tools.main(["bait", f"{tmp_path}/bait.fasta", f"{tmp_path}/r.fasta", f"fasta::{tmp_path}/hit", "--miss", f"fastq::{tmp_path}/miss", "-k", "5"], spark)
    assert [r["name"] for r in text_formats.read_fasta(spark, f"{tmp_path}/hit").collect()] == ["a"]
    assert text_formats.read_fastq(spark, f"{tmp_path}/miss").first().qual == [30] * 9
    tools.main(["mer", "create", f"{tmp_path}/r.fasta", f"{tmp_path}/k", "-k", "5"], spark)
    tools.main(["mer", "dump", f"{tmp_path}/k", f"{tmp_path}/dump", "--table", "--forward", "2"], spark)
    assert [r.value for r in spark.read.text(f"{tmp_path}/dump").collect()] == ["TTTTT\t5\t0"]
    tools.main(["diff", f"{tmp_path}/r.fasta", f"{tmp_path}/bait.fasta", f"{tmp_path}/diff", "-k", "5"], spark)
    assert (tmp_path / "diff" / "a_not_b").exists()
    tools.main(["convert", f"{tmp_path}/r.fasta", f"maf::{tmp_path}/out", "-n", f"{tmp_path}/names", "--invert"], spark)
    assert [r["name"] for r in records.read_maf_reads(spark, f"{tmp_path}/out").collect()] == ["a"]


def test_pool(spark):
    r = spark.createDataFrame([("b", "ACGTACGT", 1), ("a", "TTTT", 2), ("c", "GG", 3)], "name string, seq string, read_id int")
    order = spark.createDataFrame([("c", 0), ("b", 1), ("b", 9)], "name string, nth int")
    assert [x["name"] for x in pool.by_name_order(r, order).collect()] == ["c", "b", "a"]
    ad = spark.createDataFrame([(7, "GTACG"), (8, "TACGT")], "adaptor_id int, seq string")
    assert rows(pool.adaptor_clips(r, ad, 3, 2)) == [(1, 0, 8)]
    steps = spark.createDataFrame([(1, 0, 10), (1, 12, 20), (1, 40, 55), (2, 3, 4)], "read_id int, start int, stop int")
    assert rows(pool.chimera_cuts(steps, 4)) == [(1, 0, 20, 2), (2, 3, 4, 1)]
    m = spark.createDataFrame([(1, 1, "x", 5), (1, 2, "y", 9), (2, 1, "x", 1)], "template int, segment int, contig string, pos int")
    assert rows(pool.mates(m)) == [(1, 1, "x", 5, "y", 9), (1, 2, "y", 9, "x", 5), (2, 1, "x", 1, None, None)]


def test_traces(spark, tmp_path):
    import numpy as np

    rnd = np.random.default_rng(1)
    samples = rnd.integers(0, 65536, (4, 50)).tolist()
    data = traces.write_scf(samples, "ACGN", [3, 9, 20, 40], [[9, 1, 2, 3], [0, 8, 0, 0], [1, 1, 7, 1], [0, 0, 0, 0]])
    got = traces.read_scf(data)
    assert got["samples"] == samples and got["seq"] == "ACGN" and got["peaks"] == [3, 9, 20, 40]
    (tmp_path / "x.scf").write_bytes(data)
    r = traces.read_traces(spark, f"{tmp_path}/x.scf").first()
    assert r.qual == [9, 8, 7, 0] and r.samples == samples
    with pytest.raises(ValueError):
        traces.read_scf(bytes(200))


def test_runs_of_one_base_and_coverage_warnings(spark):
    reads_ = ["A" * 20, "A" * 10 + "nN" + "a" * 10, "A" * 19 + "C" * 5, "A" * 12 + "C" * 2, "A" * 12 + "CNNNNNNC", "A" * 12 + "C" * 3, "A" * 6 + "N" + "A" * 6, "A" * 6 + "C" + "A" * 6, "", "NNN"]
    d = spark.createDataFrame([(k, s) for k, s in enumerate(reads_)], "i int, s string")
    got = {r.i for r in d.where(reads.poly_junk(F.col("s"), "A", 20, 12, 20)).collect()}
    # 3 of 15 are 20 percent, 5 of 24 are 20.8, rounded down to 20, which is not less
    assert got == {0, 1, 3, 4, 6}
    c = spark.createDataFrame([(x,) for x in (7.0, 8.9, 9.0, 79.9, 80.0, 150.0, 300.0, None)], "cov double")
    assert [r.warning for r in pool.high_coverage(c, 8.0).collect()] == [0, 0, 1, 1, 2, 3, 4, 0]
    assert [kmers.dust_bases(k, p) for k, p in ((8, 67), (10, 50), (4, 100), (9, 0))] == [6, 6, 4, 1]
