"""Queries of names, codes, translation and edits of single reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions import codes, names, scalar, translation
from seqspark.operators import clips, edits
from seqspark.plans.adapter import READS_SQL, reads
from seqspark.plans.registry import query

SUFFIXES = (".p1", ".f", ".q2x", "TFa", "TR", ".1", ".2b", ".g")
NAMES_SQL = "n AS (SELECT doc_id AS read_id, source || '_' || doc_id || CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SUFFIXES)) + " END AS name FROM documents)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("read_id") % 8 + 1).cast("int"))
    return reads(spark, sf_dir).select("read_id", F.concat("source", F.lit("_"), F.col("read_id").cast("string"), tail).alias("name"))


def _dotted_sql(scheme: str) -> str:
    first, last = (", ".join(f"'{c}'" for c in x) for x in names.SEGMENT_LETTERS[scheme])
    part = lambda k: f"regexp_extract(name, '^(.*)\\.(.?)(.*)$', {k}, 's')"
    key = part(2) if scheme == "sra" else f"upper({part(2)})"
    made = f"{part(1)} || CASE WHEN {part(3)} = '' THEN '' ELSE '_' || {part(3)} END"
    also = f" OR {part(2)} = ''" if scheme in ("fr", "sra") else ""
    return f"""CASE WHEN NOT contains(name, '.') OR {made} = ''{also} THEN name ELSE {made} END AS {scheme}_template,
 CASE WHEN NOT contains(name, '.') THEN 0 WHEN {key} IN ({first}) THEN 1 WHEN {key} IN ({last}) THEN 255 ELSE 0 END AS {scheme}_segment"""


@query(
    f"WITH {NAMES_SQL} SELECT read_id, "
    + ", ".join(map(_dotted_sql, names.SEGMENT_LETTERS))
    + """, CASE WHEN contains(name, 'TF') THEN coalesce(nullif(split_part(name, 'TF', 1) || CASE WHEN substr(name, instr(name, 'TF') + 2) = '' THEN '' ELSE '_' || substr(name, instr(name, 'TF') + 2) END, ''), name)
 WHEN contains(name, 'TR') THEN coalesce(nullif(split_part(name, 'TR', 1) || CASE WHEN substr(name, instr(name, 'TR') + 2) = '' THEN '' ELSE '_' || substr(name, instr(name, 'TR') + 2) END, ''), name) ELSE name END AS tigr_template,
 CASE WHEN contains(name, 'TF') THEN 1 WHEN contains(name, 'TR') THEN 255 ELSE 0 END AS tigr_segment FROM n"""
)
def template_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for scheme in names.SEGMENT_LETTERS:
        template, segment = names.dotted(F.col("name"), scheme)
        out += [template.alias(f"{scheme}_template"), segment.alias(f"{scheme}_segment")]
    template, segment = names.tigr(F.col("name"))
    return _names(spark, sf_dir).select("read_id", *out, template.alias("tigr_template"), segment.alias("tigr_segment"))


@query("SELECT doc_id AS read_id, CASE WHEN doc_id % 2 = 0 THEN 'SRR' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.' || doc_id % 7 ELSE source || doc_id END AS name, doc_id % 2 = 0 AS is_sra FROM documents")
def sra_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("read_id")
    made = F.when(i % 2 == 0, F.concat(F.lit("SRR"), F.lpad(i.cast("string"), 6, "0"), F.lit("."), (i % 7).cast("string"))).otherwise(F.concat("source", i.cast("string")))
    return reads(spark, sf_dir).select("read_id", made.alias("name"), names.is_sra(made).alias("is_sra"))


SPELLINGS = ("---> <---", "<--- --->", "same direction", "Lefties", "1> 2>", "2> 1>", "?", "sideways", "= >")
EXPECTED = ("FR", "RF", "SU", "SF", "SF", "SB", "UNKNOWN", None, "SF")


@query("SELECT p_partkey AS id, CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN " + (f"'{x}'" if x else "NULL") for k, x in enumerate(EXPECTED)) + " END AS placement FROM part")
def placement_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), names.placement(spelt).alias("placement"))


_ENCODE = "text"
for _c in codes.GFF3_ESCAPED:
    _ENCODE = f"replace({_ENCODE}, chr({ord(_c)}), '%{ord(_c):02X}')" if ord(_c) else _ENCODE


@query(f"SELECT doc_id AS read_id, md5({_ENCODE}) AS coded_md5, md5(text) AS back_md5 FROM documents")
def gff3_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.gff3_encode(F.col("text"))
    return reads(spark, sf_dir).select("read_id", F.md5(coded.cast("binary")).alias("coded_md5"), F.md5(codes.gff3_decode(coded).cast("binary")).alias("back_md5"))


@query(
    """WITH v AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS DOUBLE) * pow(10, o_orderkey % 8) AS n FROM orders) SELECT id, CASE WHEN n < 1024 THEN CAST(CAST(floor(n) AS BIGINT) AS VARCHAR) || ' B'
 WHEN n < 1048576 THEN CAST(CAST(round_even(n / 1024, 0) AS BIGINT) AS VARCHAR) || ' KiB' WHEN n < 1073741824 THEN CAST(CAST(round_even(n / 1048576, 0) AS BIGINT) AS VARCHAR) || ' MiB'
 WHEN n < 1099511627776 THEN printf('%.1f GiB', round_even(n / 1073741824, 1)) ELSE printf('%.1f TiB', round_even(n / 1099511627776, 1)) END AS size FROM v"""
)
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor("o_totalprice").cast("double") * F.pow(F.lit(10), F.col("o_orderkey") % 8)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), codes.human_bytes(n).alias("size"))


@query(
    f"""SELECT o_orderkey AS id, coalesce(nullif(ltrim(list_aggregate(list_transform([36, 30, 24, 18, 12, 6, 0], lambda s: substr('{codes.DIGITS}', CAST(((o_orderkey * 7919) >> CAST(s AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', ''), '0'), ''), '0') AS short FROM orders"""
)
def short_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), codes.short_number(F.col("o_orderkey") * 7919, 32).alias("short"))


CODES = (2, 4, 6, 11, 13, 22)


def _protein_sql(table: int) -> str:
    told = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in zip(scalar.codons(), translation.amino_acids(table))) + "}"
    return f"md5(array_to_string(list_transform(regexp_extract_all(seq, '...'), lambda x: coalesce({told}[x], 'X')), '')) AS code_{table}"


@query(f"WITH {READS_SQL}, s AS (SELECT read_id, regexp_replace(seq, '[^ACGT]', '', 'g') AS seq FROM reads) SELECT read_id, " + ", ".join(map(_protein_sql, CODES)) + " FROM s")
def genetic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.regexp_replace("seq", "[^ACGT]", "")
    return reads(spark, sf_dir).select("read_id", translation.coded(seq).alias("letters")).select("read_id", *(F.md5(translation.told(F.col("letters"), t).cast("binary")).alias(f"code_{t}") for t in CODES))


_STOPS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in scalar.codons().items()) + "}"


@query(
    f"""WITH {READS_SQL}, s AS (SELECT read_id, reverse(translate(regexp_replace(seq, '[^ACGT]', '', 'g'), 'ACGT', 'TGCA')) AS seq FROM reads),
p AS (SELECT read_id, substr(seq, 2, 3) AS first, array_to_string(list_transform(regexp_extract_all(substr(seq, 2), '...'), lambda x: {_STOPS}[x]), '') AS prot FROM s)
SELECT read_id, CASE WHEN contains(prot, '*') THEN split_part(prot, '*', 1) || '*' ELSE prot END AS protein, first IN ('TTG', 'CTG', 'ATG') AS starts FROM p"""
)
def reading_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reverse strand from its second base to the first stop."""
    seq = F.regexp_replace("seq", "[^ACGT]", "")
    rows = reads(spark, sf_dir).select("read_id", seq.alias("seq"))
    first = F.substr(scalar.reverse_complement(F.col("seq")), F.lit(2), F.lit(3))
    return rows.select("read_id", translation.translate(F.col("seq"), 1, 2, reverse=True, to_stop=True).alias("protein"), translation.is_start(first).alias("starts"))


# reads as names and events, which are short, with qualities by a rule
SHORT_SQL = "s AS (SELECT o_orderkey AS read_id, translate(o_orderstatus || o_orderpriority || md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef -', 'ACGTAACCGGTTNACG**') AS seq FROM orders), q AS (SELECT read_id, seq, list_transform(range(length(seq)), lambda i: CAST((read_id * 7 + i * 13) % 41 AS INTEGER)) AS qual FROM s)"


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("o_orderstatus", "o_orderpriority", F.md5(F.col("o_orderkey").cast("string").cast("binary")))
    s = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("read_id"), F.translate(text, "0123456789abcdef -", "ACGTAACCGGTTNACG**").alias("seq"))
    return s.withColumn("qual", F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: ((F.col("read_id") * 7 + i * 13) % 41).cast("int")))


_RUNS = "regexp_extract_all(seq, 'A+|C+|G+|T+|a+|c+|g+|t+|.', 0, 's')"


@query(
    f"""WITH {SHORT_SQL}, b AS (SELECT read_id, seq, qual, {_RUNS} AS runs FROM q), n AS (SELECT read_id, seq, qual, runs, list_transform(runs, lambda r: length(r)) AS n FROM b),
e AS (SELECT *, list_transform(range(len(n)), lambda i: list_sum(n[1:i + 1])) AS ends FROM n)
SELECT read_id, array_to_string(list_transform(runs, lambda r: left(r, 1)), '') AS rle_seq, array_to_string(list_transform(range(len(n)), lambda i: list_sum(qual[ends[i + 1] - n[i + 1] + 1:ends[i + 1]]) // n[i + 1]), ',') AS rle_qual, seq AS back FROM e"""
)
def rle_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, qual = F.col("seq"), F.col("qual")
    back = edits.unrle(edits.rle_seq(seq), edits.rle_lengths(seq))
    return _short(spark, sf_dir).select("read_id", edits.rle_seq(seq).alias("rle_seq"), F.array_join(edits.rle_qual(seq, qual).cast("array<string>"), ",").alias("rle_qual"), back.alias("back"))


@query(
    f"""WITH {SHORT_SQL} SELECT read_id, array_to_string(list_transform(range(length(seq)), lambda i: CASE WHEN qual[i + 1] < 20 THEN lower(substr(seq, i + 1, 1)) ELSE substr(seq, i + 1, 1) END), '') AS by_quality,
 lower(substr(seq, 1, 5)) || upper(substr(seq, 6, 20)) || lower(substr(seq, 26)) AS by_clips, replace(seq, '*', 'N') AS no_gaps, translate(seq, 'Nn', '**') AS no_ns, replace(seq, '*', '') AS removed FROM q"""
)
def read_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    return _short(spark, sf_dir).select(
        "read_id", edits.case_by_quality(seq, F.col("qual"), 20).alias("by_quality"), edits.case_by_clips(seq, F.lit(5), F.lit(25)).alias("by_clips"), edits.gaps_to_ns(seq).alias("no_gaps"), edits.ns_to_gaps(seq).alias("no_ns"), edits.without_gaps(seq).alias("removed")
    )


@query(
    f"""WITH {SHORT_SQL}, p AS (SELECT *, CAST(read_id % length(seq) AS INTEGER) AS pos FROM q) SELECT read_id, length(replace(substr(seq, 1, pos), '*', '')) AS unpadded, CAST(length(regexp_replace(substr(seq, 1, pos + 1), '\\*+$', '')) - 1 AS INTEGER) AS lower_base,
 CAST(length(seq) - 1 - pos AS INTEGER) AS complement FROM p"""
)
def padded_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(spark, sf_dir).withColumn("pos", (F.col("read_id") % F.length("seq")).cast("int"))
    seq, pos = F.col("seq"), F.col("pos")
    return rows.select("read_id", edits.unpadded_position(seq, pos).cast("long").alias("unpadded"), edits.lower_base_position(seq, pos).alias("lower_base"), edits.complement_position(F.length("seq"), pos).alias("complement"))


@query(
    f"""WITH {SHORT_SQL}, p AS (SELECT *, CAST(read_id % length(seq) AS INTEGER) AS pos FROM q) SELECT read_id, substr(seq, 1, pos) || 'T' || substr(seq, pos + 1) AS inserted, array_to_string(list_concat(list_concat(qual[1:pos], [30]), qual[pos + 1:]), ',') AS inserted_qual,
 substr(seq, 1, pos) || substr(seq, pos + 2) AS deleted, array_to_string(list_concat(qual[1:pos], qual[pos + 2:]), ',') AS deleted_qual, substr(seq, 1, pos) || 'G' || substr(seq, pos + 2) AS changed FROM p"""
)
def base_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(spark, sf_dir).withColumn("pos", (F.col("read_id") % F.length("seq")).cast("int"))
    seq, qual, pos = F.col("seq"), F.col("qual"), F.col("pos")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select(
        "read_id", edits.insert_base(seq, "T", pos).alias("inserted"), text(edits.insert_quality(qual, 30, pos)).alias("inserted_qual"), edits.delete_base(seq, pos).alias("deleted"), text(edits.delete_quality(qual, pos)).alias("deleted_qual"), edits.change_base(seq, "G", pos).alias("changed")
    )


@query(
    f"""WITH {SHORT_SQL}, p AS (SELECT *, CAST(read_id % length(seq) AS INTEGER) AS pos FROM q), b AS (SELECT *, substr(seq, pos + 1, 1) AS base FROM p),
r AS (SELECT read_id, qual, pos - (length(reverse(substr(seq, 1, pos))) - length(ltrim(reverse(substr(seq, 1, pos)), base))) AS low, pos + length(substr(seq, pos + 2)) - length(ltrim(substr(seq, pos + 2), base)) AS high FROM b)
SELECT read_id, CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high, CAST(low + list_position(qual[low + 1:high + 1], list_min(qual[low + 1:high + 1])) - 1 AS INTEGER) AS weakest FROM r"""
)
def base_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(spark, sf_dir).withColumn("pos", (F.col("read_id") % F.length("seq")).cast("int"))
    low, high = edits.run_bounds(F.col("seq"), F.col("pos"))
    return rows.select("read_id", low.alias("low"), high.alias("high"), edits.weakest_in_run(F.col("seq"), F.col("qual"), F.col("pos")).alias("weakest"))


@query(
    f"""WITH {SHORT_SQL}, g AS (SELECT read_id, list_filter(list_transform(range(5, 26), lambda i: CASE WHEN lower(substr(seq, i + 1, 1)) IN ('n', '*') THEN NULL ELSE qual[i + 1] END), lambda x: x IS NOT NULL) AS good FROM q)
SELECT read_id, CAST(CASE WHEN len(good) = 0 THEN 0 ELSE list_sum(good) // len(good) END AS INTEGER) AS quality FROM g"""
)
def average_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(spark, sf_dir).select("read_id", edits.average_quality(F.col("seq"), F.col("qual"), F.lit(5), F.lit(25)).alias("quality"))


MASKED_SQL = f"{READS_SQL}, x AS (SELECT read_id, translate(seq, ' .', 'X*') AS seq FROM reads)"


def _mask_sql(seq: str, gap: int, front: int) -> str:
    b = "[^XxNn*][Nn*]*"
    return f"length(regexp_extract({seq}, '^[Nn*]*(?:{b}){{0,{front}}}[Xx][XxNn*]*(?:(?:{b}){{0,{gap}}}[Xx][XxNn*]*)*', 0, 's'))"


@query(f"WITH {MASKED_SQL} SELECT read_id, CAST({_mask_sql('seq', 4, 10)} AS INTEGER) AS l, CAST(length(seq) - {_mask_sql('reverse(seq)', 4, 10)} AS INTEGER) AS r FROM x")
def mask_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.translate("seq", " .", "X*")
    return reads(spark, sf_dir).select("read_id", clips.mask_left(seq, 4, 10).alias("l"), clips.mask_right(seq, 4, 10).alias("r"))


@query(
    f"""WITH {SHORT_SQL}, c AS (SELECT read_id, qual, length(seq) AS n, CAST(read_id % 12 AS INTEGER) AS l, CAST(length(seq) - read_id % 9 AS INTEGER) AS r FROM q),
d AS (SELECT *, array_to_string(list_transform(qual[l + 1:r], lambda v: CASE WHEN v < 25 THEN 'b' ELSE 'g' END), '') AS marks FROM c)
SELECT read_id, CAST(CASE WHEN l < 4 THEN 6 ELSE l END AS INTEGER) AS least_left, CAST(CASE WHEN n - r < 3 THEN n - 3 ELSE r END AS INTEGER) AS least_right, len(list_filter(qual, lambda v: v >= 30)) >= 10 AS enough,
 CAST(CASE WHEN instr(marks, 'bbb') > 0 THEN l + instr(marks, 'bbb') - 1 ELSE r END AS INTEGER) AS bad_right FROM d"""
)
def quality_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right, n = (F.col("read_id") % 12).cast("int"), (F.length("seq") - F.col("read_id") % 9).cast("int"), F.length("seq")
    qual = F.col("qual")
    return _short(spark, sf_dir).select(
        "read_id", clips.least_left(left, 4, 6).alias("least_left"), clips.least_right(right, n, 3).alias("least_right"), clips.enough_quality(qual, 30, 10).alias("enough"), clips.bad_stretch(qual, left, right, 25, 3).alias("bad_right")
    )


def _poly_sql(seq: str, base: str, least: int, errors: int, grace: int) -> str:
    low, up = base.lower(), base.upper()
    run = f"regexp_replace(regexp_extract(substr({seq}, CAST(i + 1 AS BIGINT)), '^(?:[{low}{up}Nn]*[^{low}{up}Nn]){{0,{errors}}}[{low}{up}Nn]*', 0, 's'), '[^{low}{up}]+$', '')"
    each = f"list_transform(range(0, {grace + 1}), lambda i: {{'s': i, 'e': i + length({run}) - 1, 'ok': length(regexp_replace({run}, '[^{low}{up}]', '', 'g')) >= {least} AND lower(substr({seq}, CAST(i + 1 AS BIGINT), 1)) = '{low}'}})"
    return f"list_filter({each}, lambda x: x.ok)[1]"


@query(
    f"""WITH {READS_SQL}, f AS (SELECT read_id, length(seq) AS n, {_poly_sql('seq', 'a', 4, 2, 6)} AS a, {_poly_sql('reverse(seq)', 't', 4, 2, 6)} AS b FROM reads)
SELECT read_id, CAST(coalesce(a.s, -1) AS INTEGER) AS a_start, CAST(coalesce(a.e, -1) AS INTEGER) AS a_end, CAST(CASE WHEN b.s IS NULL THEN -1 ELSE n - 1 - b.e END AS INTEGER) AS t_start, CAST(CASE WHEN b.s IS NULL THEN -1 ELSE n - 1 - b.s END AS INTEGER) AS t_end FROM f"""
)
def poly_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poly-A at the front and poly-T at the back."""
    a, t = clips.poly_front(F.col("seq"), "a", 4, 2, 6), clips.poly_end(F.col("seq"), "t", 4, 2, 6)
    return reads(spark, sf_dir).select("read_id", a[0].alias("a_start"), a[1].alias("a_end"), t[0].alias("t_start"), t[1].alias("t_end"))
