"""Readers and writers of record formats: PHD, EXP, GenBank, MAF and CAF reads, TRACEINFO, SAM, k-mer tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions import codes, scalar

LOCATION = "array<struct<direction:int,start:int,stop:int>>"


def read_phd(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual, peaks) of base-call records; fails on one without its DNA part."""
    record = spark.read.text(path, lineSep="BEGIN_SEQUENCE").where(F.trim("value") != "")
    dna = F.regexp_extract("value", r"(?s)BEGIN_DNA\s*\n(.*?)END_DNA", 1)
    rows = F.transform(F.filter(F.split(dna, "\n"), lambda x: F.trim(x) != ""), lambda x: F.split(F.trim(x), r"\s+"))
    name = F.regexp_extract("value", r"^\s*(\S+)", 1)
    whole = F.col("value").contains("BEGIN_DNA") & F.col("value").contains("END_DNA")
    bad = F.when(~whole, F.raise_error(F.concat(F.lit("no DNA in "), name)))
    return record.select(F.coalesce(bad.cast("string"), name).alias("name"), rows.alias("r")).select(
        "name", F.array_join(F.transform("r", lambda x: F.upper(F.substr(x[0], F.lit(1), F.lit(1)))), "").alias("seq"), F.transform("r", lambda x: x[1].cast("int")).alias("qual"), F.transform("r", lambda x: x[2].cast("int")).alias("peaks")
    )


def read_exp(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per experiment file: name, seq, qual, clips and tags from its two-letter lines.

    Clips count bases that are cut from the left and the first that is cut on the right; absent ones are 0 and the length.
    """
    one = spark.read.text(paths, wholetext=True)
    line = lambda key: F.regexp_extract("value", rf"(?m)^{key}\s+(.*)$", 1)
    number = lambda key: F.when(line(key) != "", line(key).try_cast("int"))
    body = F.regexp_replace(F.regexp_extract("value", r"(?ms)^SQ\s*$(.*?)^//", 1), r"[\s\d]", "")
    qualities = F.filter(F.split(F.trim(F.regexp_replace(F.regexp_extract("value", r"(?ms)^AV((?:[ \t]+[^\n]*\n(?:AV)?)+)", 1), "AV", " ")), r"\s+"), lambda x: x != "")
    rows = one.select(
        F.coalesce(F.nullif(line("ID"), F.lit("")), line("EN")).alias("name"), F.translate(body, "-", "N").alias("seq"), F.transform(qualities, lambda x: x.try_cast("int")).alias("qual"),
        number("QL").alias("ql"), number("QR").alias("qr"), number("SL").alias("sl"), number("SR").alias("sr"), F.nullif(line("TN"), F.lit("")).alias("template"), F.nullif(line("SV"), F.lit("")).alias("vector"),
        F.regexp_extract_all("value", F.lit(r"(?m)^TG\s+(.*)$"), F.lit(1)).alias("tags"),
    )
    n = F.length("seq")
    return rows.select("name", "seq", "qual", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("ql", "sl")), *(F.coalesce(F.col(c) - 1, n).alias(c) for c in ("qr", "sr")), "template", "vector", "tags")


def parse_location(text: str) -> list[tuple[int, int, int]]:
    """(direction, start, stop) of the parts of a GenBank location, 1-based, in the order written.

    complement() turns its parts, join() and order() list them. < and > are left out, a^b is the pair a, b. Of a
    choice (a.b) the smaller number begins a part and the larger one ends it.
    """
    out: list[tuple[int, int, int]] = []

    def parts(s: str) -> Iterator[str]:
        depth = begin = 0
        for i, c in enumerate(s):
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                yield s[begin:i]
                begin = i + 1
        yield s[begin:]

    def walk(s: str, direction: int) -> None:
        for p in parts(s):
            m = re.fullmatch(r"(complement|join|order)\((.*)\)", p)
            if m:
                walk(m[2], -direction if m[1] == "complement" else direction)
                continue
            p = p.split(":")[-1].translate(str.maketrans("", "", "<>"))
            ends = re.fullmatch(r"(\d+|\(\d+\.\d+\))(?:(?:\.\.|\^)(\d+|\(\d+\.\d+\)))?", p)
            if not ends:
                raise ValueError(f"no GenBank location: {p!r}")
            first = [int(x) for x in re.findall(r"\d+", ends[1])]
            last = [int(x) for x in re.findall(r"\d+", ends[2])] if ends[2] else first
            out.append((direction, min(first), max(last)))

    walk(re.sub(r"\s", "", text), 1)
    return out


def locations(text: Column) -> Column:
    """parse_location() of a column, as an array of (direction, start, stop)."""

    @F.pandas_udf(LOCATION)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [{"direction": d, "start": a, "stop": b} for d, a, b in parse_location(x)])

    return run(text)


def read_genbank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sequences, features) of a flat file: (accession, seq), and (accession, nth, type, location, qualifiers).

    A CDS without a gene takes the gene of its locus_tag from the gene feature.
    """
    record = spark.read.text(path, lineSep="\n//").where(F.col("value").contains("LOCUS"))
    accession = F.regexp_extract("value", r"(?m)^LOCUS\s+(\S+)", 1)
    body = F.regexp_replace(F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), r"[\s\d/]", "")
    table = F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*\n(.*?)(?=\n\S|$)", 1)
    feats = F.split(F.regexp_replace(table, r"(?m)^ {5}(?=\S)", "\x01"), "\x01")
    rows = record.select(accession.alias("accession"), F.posexplode(F.filter(feats, lambda x: F.trim(x) != "")).alias("nth", "f"))
    head = F.regexp_extract("f", r"(?s)^(\S+)\s+(.*?)(?=\n\s*/|$)", 2)
    quals = F.filter(F.split(F.regexp_replace("f", r"\n\s+/", "\x01/"), "\x01"), lambda x: x.startswith("/"))
    entry = F.transform(quals, lambda x: F.struct(F.regexp_extract(x, r"^/([^=\s]+)", 1).alias("k"), F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r'(?s)^/[^=]+="?(.*?)"?\s*$', 1), r"\n\s+", " "), '""', '"').alias("v")))
    last = F.filter(entry, lambda x, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda y: y.k == x.k))
    features = rows.select("accession", "nth", F.regexp_extract("f", r"^(\S+)", 1).alias("type"), F.regexp_replace(head, r"\s", "").alias("location"), F.map_from_entries(last).alias("qualifiers"))
    genes = features.where("type = 'gene'").select("accession", F.try_element_at("qualifiers", F.lit("locus_tag")).alias("tag"), F.try_element_at("qualifiers", F.lit("gene")).alias("g")).where("tag is not null and g is not null").dropDuplicates(["accession", "tag"])
    tag = F.try_element_at("qualifiers", F.lit("locus_tag"))
    with_genes = features.withColumn("tag", tag).join(genes, ["accession", "tag"], "left")
    own = F.try_element_at("qualifiers", F.lit("gene")).isNull() & (F.col("type") == "CDS") & F.col("g").isNotNull()
    merged = F.when(own, F.map_concat("qualifiers", F.create_map(F.lit("gene"), F.col("g")))).otherwise(F.col("qualifiers"))
    return record.select(accession.alias("accession"), body.alias("seq")), with_genes.select("accession", "nth", "type", "location", merged.alias("qualifiers"))


def read_traceinfo(spark: SparkSession, path: str) -> DataFrame:
    """(name, template, ql, qr, sl, sr, insert_size, insert_stdev) of an XML file of traces; 1-based clips as written."""
    x = spark.read.format("xml").option("rowTag", "trace").option("inferSchema", "false").load(path)
    lower = {c.lower(): c for c in x.columns}
    get = lambda c, kind="int": (F.col(lower[c]).try_cast(kind) if c in lower else F.lit(None).cast(kind))
    return x.select(
        get("trace_name", "string").alias("name"), get("template_id", "string").alias("template"), get("clip_quality_left").alias("ql"), get("clip_quality_right").alias("qr"), get("clip_vector_left").alias("sl"), get("clip_vector_right").alias("sr"), get("insert_size").alias("insert_size"), get("insert_stdev").alias("insert_stdev")
    )


def merge_traceinfo(reads: DataFrame, traces: DataFrame) -> DataFrame:
    """reads(name, template, ...) with the templates and insert sizes that traces tells."""
    t = traces.select("name", F.col("template").alias("_t"), "insert_size", "insert_stdev")
    return reads.join(t, "name", "left").withColumn("template", F.coalesce("_t", "template")).drop("_t")


# lines of reads


def quality_text(qual: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(qual, lambda q: F.char(q + offset)), "")


def maf_read(reads: DataFrame) -> DataFrame:
    """(value): a read as lines of two-letter keys: RD name, RS bases, RQ qualities, RG group, clips QL and QR, ER."""
    lines = F.concat_ws("\n", F.concat(F.lit("RD\t"), F.col("name")), F.concat(F.lit("RG\t"), F.col("rg").cast("string")), F.concat(F.lit("RS\t"), F.col("seq")), F.concat(F.lit("RQ\t"), quality_text(F.col("qual"))), F.concat(F.lit("QL\t"), (F.col("ql") + 1).cast("string")), F.concat(F.lit("QR\t"), F.col("qr").cast("string")), F.lit("ER"))
    return reads.select(lines.alias("value"))


def read_maf_reads(spark: SparkSession, path: str) -> DataFrame:
    """(name, rg, seq, qual, ql, qr) of the reads of a file of two-letter keys."""
    record = spark.read.text(path, lineSep="\nER").where(F.col("value").contains("RD\t"))
    line = lambda key: F.regexp_extract("value", rf"(?m)^{key}\t(.*)$", 1)
    quals = F.transform(F.filter(F.split(line("RQ"), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    n = F.length(line("RS"))
    return record.select(line("RD").alias("name"), line("RG").cast("int").alias("rg"), line("RS").alias("seq"), quals.alias("qual"), F.coalesce(line("QL").try_cast("int") - 1, F.lit(0)).alias("ql"), F.coalesce(line("QR").try_cast("int"), n).alias("qr"))


def caf_read(reads: DataFrame) -> DataFrame:
    """(value): a read as a CAF sequence with its clips, DNA and base qualities."""
    head = F.concat(F.lit("Sequence : "), F.col("name"), F.lit("\nIs_read\nPadded\nClipping QUAL "), (F.col("ql") + 1).cast("string"), F.lit(" "), F.col("qr").cast("string"))
    dna = F.concat(F.lit("\n\nDNA : "), F.col("name"), F.lit("\n"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n"))
    quals = F.concat(F.lit("\n\nBaseQuality : "), F.col("name"), F.lit("\n"), F.array_join(F.col("qual").cast("array<string>"), " "))
    return reads.select(F.concat(head, dna, quals, F.lit("\n")).alias("value"))


def fasta_qual(reads: DataFrame) -> DataFrame:
    """(value): FASTA records of whole-number qualities."""
    return reads.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.array_join(F.col("qual").cast("array<string>"), " ")).alias("value"))


def clipped(reads: DataFrame) -> DataFrame:
    """reads with seq and qual cut to [ql, qr)."""
    n = F.greatest(F.col("qr") - F.col("ql"), F.lit(0))
    return reads.withColumns({"seq": F.substr("seq", F.col("ql") + 1, n), "qual": F.slice("qual", F.col("ql") + 1, n)})


def masked(reads: DataFrame) -> DataFrame:
    """reads whose bases outside [ql, qr) are X."""
    n = F.length("seq")
    right = F.greatest("qr", "ql")
    return reads.withColumn("seq", F.concat(F.call_function("repeat", F.lit("X"), F.least("ql", n)), F.substr("seq", F.col("ql") + 1, right - F.col("ql")), F.call_function("repeat", F.lit("X"), F.greatest(n - right, F.lit(0)))))


# SAM


def cigar(read: Column, reference: Column, left: Column, right: Column) -> Column:
    """CIGAR of two padded rows of equal length; left and right are bases cut off softly.

    A gap in both is no column. M stands for equal and different bases alike.
    """
    pairs = F.zip_with(F.regexp_extract_all(read, F.lit("(?s)."), F.lit(0)), F.regexp_extract_all(reference, F.lit("(?s)."), F.lit(0)), lambda a, b: F.when((a == "*") & (b == "*"), "").when(a == "*", "D").when(b == "*", "I").otherwise("M"))
    runs = F.regexp_extract_all(F.array_join(pairs, ""), F.lit("M+|I+|D+"), F.lit(0))
    middle = F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substr(r, F.lit(1), F.lit(1)))), "")
    soft = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    return F.concat(soft(left), middle, soft(right))


def sam_line(flag: str = "flag") -> Column:
    """A SAM line of columns name, flag, contig, pos, mapq, cigar, mate_contig, mate_pos, tlen, seq, qual; null mates are * and 0."""
    same = F.when(F.col("mate_contig").isNull(), "*").when(F.col("mate_contig") == F.col("contig"), "=").otherwise(F.col("mate_contig"))
    text = lambda c: F.col(c).cast("string")
    return F.concat_ws("\t", "name", text(flag), "contig", text("pos"), text("mapq"), "cigar", same, F.coalesce(text("mate_pos"), F.lit("0")), F.coalesce(text("tlen"), F.lit("0")), F.replace("seq", F.lit("*"), F.lit("")), "qual")


def sam_header(contigs: DataFrame, groups: DataFrame, program: str) -> DataFrame:
    """(nth, value): header lines for contigs(name, len) and groups(id, sample, technology), in order of nth."""
    head = contigs.sparkSession.createDataFrame([(0, "@HD\tVN:1.6\tSO:unsorted")], "nth int, value string")
    sq = contigs.select(F.lit(1).alias("nth"), F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("len").cast("string")).alias("value"))
    rg = groups.select(F.lit(2).alias("nth"), F.concat(F.lit("@RG\tID:"), F.col("id").cast("string"), F.lit("\tSM:"), F.col("sample"), F.lit("\tPL:"), F.upper("technology")).alias("value"))
    pg = contigs.sparkSession.createDataFrame([(3, f"@PG\tID:{program}\tPN:{program}")], "nth int, value string")
    return head.union(sq).union(rg).union(pg)


def tag_gff3(tags: DataFrame) -> DataFrame:
    """(value): tags(name, from, to, id, strand, comment) as GFF3 lines, positions 0-based there and 1-based here."""
    note = F.concat(F.lit("Note="), codes.gff3_encode(F.col("comment")))
    return tags.select(F.concat_ws("\t", codes.gff3_encode(F.col("name")), F.lit("seqspark"), "id", (F.col("from") + 1).cast("string"), (F.col("to") + 1).cast("string"), F.lit("."), F.coalesce("strand", F.lit(".")), F.lit("."), note).alias("value"))


# k-mer tables


def save_kmers(stats: DataFrame, path: str) -> None:
    stats.write.option("compression", "gzip").parquet(path)


def load_kmers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def kmer_header(stats: DataFrame) -> DataFrame:
    """One row: length of the k-mers, how many there are, and how many counts they have."""
    return stats.agg(F.max(F.length("kmer")).alias("k"), F.count("*").alias("kmers"), F.sum(F.col("fcount") + F.col("rcount")).alias("total"))


def complement_record(reads: DataFrame) -> DataFrame:
    """reads as their reverse complement, with qualities and clips turned."""
    n = F.length("seq")
    return reads.withColumns({"seq": scalar.reverse_complement(F.col("seq")), "qual": F.reverse("qual"), "ql": n - F.col("qr"), "qr": n - F.col("ql")})
