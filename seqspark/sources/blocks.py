"""Records of several lines from files that Spark splits anywhere.

Spark's text source gives every line once, with its file and where its split begins. A task groups the lines
of a split into units; what stands before a split's first recognisable beginning and after its last
complete unit are fragments, a few lines for each split, that are put together with those of its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNIT, HEAD, TAIL = 0, 1, 2
_NAMES = ["path", "block", "nth", "kind", "known", "contig", "lines"]
_SCHEMA = "path string, block long, nth long, kind int, known boolean, contig string, lines array<string>"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string())]


def _grouped(spark: SparkSession, paths: str | list[str], begin: Callable[[list[str], bool, bool], int | None], unit_end: Callable[[list[str], int, bool], int | None], state: Callable[[str], tuple[bool, str | None]] | None) -> DataFrame:
    """Units and fragments of each split.

    begin(lines, is_first, is_last): the index of the first unit's first line, None if more lines are needed or there is none.
    unit_end(lines, at, is_last): the index after the unit that begins at `at`, or None if it may go on beyond these lines.
    state(line): whether a unit's first line sets what the following units belong to, and to what.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, lines, begun, nth, known, contig = None, [], False, 0, False, None

        def take(is_last: bool) -> None:
            nonlocal lines, begun, nth, known, contig
            if not begun:
                at = begin(lines, now[1] == 0, is_last)
                if at is None:
                    if is_last:
                        out.append((*now, 0, HEAD, False, None, lines))
                        lines = []
                    return
                out.append((*now, 0, HEAD, False, None, lines[:at]))
                lines, begun = lines[at:], True
            at = 0
            while at < len(lines):
                end = unit_end(lines, at, is_last)
                if end is None:
                    break
                emit(UNIT, lines[at:end])
                at = end
            lines = lines[at:]
            if is_last:
                emit(TAIL, lines)
                lines = []

        def emit(kind: int, unit: list[str]) -> None:
            nonlocal nth, known, contig
            sets, value = state(unit[0]) if state and unit else (False, None)
            if sets:
                known, contig = True, value
            nth += 1
            out.append((*now, nth, kind, known, contig, unit))

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], _NAMES)
            out.clear()
            return done

        for batch in batches:
            for path, block, value in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "value"))):
                if (path, block) != now:
                    if now is not None:
                        take(True)
                    now, lines, begun, nth, known, contig = (path, block), [], False, 0, False, None
                lines.append(value.removesuffix("\r"))
            if now is not None:
                take(False)
            if out:
                yield flush()
        if now is not None:
            take(True)
        if out:
            yield flush()

    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    return text.mapInArrow(run, _SCHEMA)


def _stitched(found: DataFrame) -> DataFrame:
    """(path, block, nth, known, contig, lines): all units; a tail goes on with the heads of splits up to the next tail."""
    order = W.partitionBy("path").orderBy("block", "kind")
    parts = found.where(F.col("kind") != UNIT).withColumn("g", F.sum((F.col("kind") == TAIL).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct("block", "kind", "lines")))
    first = lambda c: F.min_by(c, F.struct("block", F.col("kind") != TAIL))
    whole = parts.groupBy("path", "g").agg(first("block").alias("block"), first("nth").alias("nth"), first("known").alias("known"), first("contig").alias("contig"), F.flatten(F.transform(rows, lambda x: x.lines)).alias("lines"))
    units = found.where(F.col("kind") == UNIT).select("path", "block", "nth", "known", "contig", "lines")
    return units.union(whole.where(F.exists("lines", lambda x: F.trim(x) != "")).select("path", "block", "nth", "known", "contig", "lines"))


def fastq_units(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, nth, lines): records of four lines, each once however the files are split.

    A record begins at a line with @ whose second next has +: a quality line with @ is followed by a name and bases.
    """

    def begin(lines: list[str], is_first: bool, is_last: bool) -> int | None:
        if is_first:
            return 0
        return next((k for k in range(len(lines) - 2) if lines[k].startswith("@") and lines[k + 2].startswith("+")), None)

    def unit_end(lines: list[str], at: int, is_last: bool) -> int | None:
        return at + 4 if at + 4 <= len(lines) else None

    whole = _stitched(_grouped(spark, paths, begin, unit_end, None))
    # a split of one or two lines may hold the end of one record and the beginning of the next
    fours = F.transform(F.sequence(F.lit(0), F.expr("(size(lines) - 1) div 4").cast("int")), lambda k: F.slice("lines", k * 4 + 1, 4))
    rows = whole.select("path", "block", "nth", F.explode(fours).alias("lines"))
    return rows.where(F.exists("lines", lambda x: F.trim(x) != ""))


def read_fastq(spark: SparkSession, path: str | list[str], offset: int = 33) -> DataFrame:
    """(name, comment, seq, qual) of FASTQ files of four lines a record, plain or gzipped; plain ones are split anywhere.

    A comment that begins with 1: or 2: rolls into the name. A record that is none, or is cut off, is an error.
    """
    rows = fastq_units(spark, path)
    line = lambda k: F.coalesce(F.get("lines", F.lit(k)), F.lit(""))
    bad = (F.size("lines") < 4) | ~line(0).startswith("@") | ~line(2).startswith("+") | (F.length(line(1)) != F.length(line(3)))
    head = F.split(F.substr(line(0), F.lit(2)), r"\s+", 2)
    comment = F.coalesce(F.get(head, F.lit(1)), F.lit(""))
    name = F.concat(head[0], F.when(comment.rlike("^[12]:"), F.concat(F.lit("/"), F.substr(comment, F.lit(1), F.lit(1)))).otherwise(""))
    seq = F.when(bad, F.raise_error(F.concat(F.lit("not a FASTQ record of four lines: "), line(0))).cast("string")).otherwise(line(1))
    quals = F.transform(F.filter(F.split(line(3), ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)
    return rows.select(name.alias("name"), comment.alias("comment"), seq.alias("seq"), quals.alias("qual"))


# files of two-letter keys: read groups, reads, and contigs with the reads that were placed on them

#: Lines that begin a unit.
STARTS = ("RD", "CO", "EC", "@ReadGroup", "@Version", "@Program")


def _key(line: str) -> str:
    return line.split(None, 1)[0] if line.strip() else ""


def keyed_units(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, nth, contig, lines): units of files of two-letter keys, with the contig they stand in.

    A split that begins inside a contig takes its name from the last split before it that begins or ends one.
    """

    def begin(lines: list[str], is_first: bool, is_last: bool) -> int | None:
        return 0 if is_first else next((k for k, x in enumerate(lines) if _key(x) in STARTS), None)

    def unit_end(lines: list[str], at: int, is_last: bool) -> int | None:
        return next((k for k in range(at + 1, len(lines)) if _key(lines[k]) in STARTS), None)

    def state(line: str) -> tuple[bool, str | None]:
        key = _key(line)
        return key in ("CO", "EC"), line.split(None, 1)[1].strip() if key == "CO" and len(line.split(None, 1)) > 1 else None

    found = _grouped(spark, paths, begin, unit_end, state)
    units = _stitched(found)
    last = found.where("kind <> 1").groupBy("path", "block").agg(F.max_by("known", "nth").alias("k"), F.max_by("contig", "nth").alias("c"))
    told = F.last(F.when(F.col("k"), F.struct("c")), ignorenulls=True).over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    before = last.select("path", "block", told.alias("told"))
    return units.join(before, ["path", "block"], "left").select("path", "block", "nth", F.when(F.col("known"), F.col("contig")).otherwise(F.col("told.c")).alias("contig"), "lines")


def _field(key: str) -> Column:
    """The value after a key, null without such a line."""
    hit = F.get(F.filter("lines", lambda x: x.rlike(rf"^{key}(\s|$)")), F.lit(0))
    return F.trim(F.regexp_replace(hit, rf"^{key}\s*", ""))


def _quals(key: str) -> Column:
    return F.transform(F.filter(F.split(_field(key), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def _tags(key: str) -> Column:
    """Tags (id, from, to, strand, source, comment) of lines of a key; places from 0, to exclusive."""
    rows = F.transform(F.filter("lines", lambda x: x.rlike(rf"^{key}\s")), lambda x: F.split(F.regexp_replace(x, rf"^{key}\s+", ""), "\t"))
    part = lambda p, k: F.coalesce(F.get(p, F.lit(k)), F.lit(""))
    return F.transform(
        rows, lambda p: F.struct(part(p, 0).alias("id"), (F.least(part(p, 1).try_cast("int"), part(p, 2).try_cast("int")) - 1).alias("from"), F.greatest(part(p, 1).try_cast("int"), part(p, 2).try_cast("int")).alias("to"), part(p, 3).alias("strand"), part(p, 4).alias("source"), part(p, 5).alias("comment"))
    )


def keyed_groups(units: DataFrame) -> DataFrame:
    """(id, values): read groups with the values of their @RG lines."""
    rows = units.where(F.col("lines")[0].startswith("@ReadGroup"))
    pairs = F.transform(F.filter("lines", lambda x: x.rlike(r"^@RG\s")), lambda x: F.split(F.regexp_replace(x, r"^@RG\s+", ""), r"\s+", 2))
    values = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.lower(p[0]).alias("k"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("v"))))
    return rows.select(values.alias("values")).select(F.try_element_at("values", F.lit("id")).try_cast("int").alias("id"), "values")


def keyed_contigs(units: DataFrame) -> DataFrame:
    """(contig, reads, length, seq, qual, tags) of contigs."""
    return units.where(F.col("lines")[0].rlike(r"^CO\s")).select(_field("CO").alias("contig"), _field("NR").try_cast("int").alias("reads"), _field("LC").try_cast("int").alias("length"), _field("CS").alias("seq"), _quals("CQ").alias("qual"), _tags("CT").alias("tags"))


def keyed_reads(units: DataFrame) -> DataFrame:
    """(name, rg, contig, seq, qual, clips, template, segment, tags, place) of reads, free ones with a null contig and place.

    clips are sl, sr, ql, qr, cl, cr, places from 0 with the right one exclusive; null lines mean no clip. place is
    (from, to, read_from, read_to) in the contig and the read, from 1 as written; a reversed one has from above to.
    """
    left = lambda k: F.coalesce(_field(k).try_cast("int") - 1, F.lit(0))
    right = lambda k: F.coalesce(_field(k).try_cast("int"), F.length(_field("RS")))
    clips = F.struct(left("SL").alias("sl"), right("SR").alias("sr"), left("QL").alias("ql"), right("QR").alias("qr"), left("CL").alias("cl"), right("CR").alias("cr"))
    at = F.split(_field("AT"), r"\s+")
    place = F.when(_field("AT").isNotNull(), F.struct(*(F.get(at, F.lit(k)).try_cast("int").alias(n) for k, n in enumerate(("from", "to", "read_from", "read_to")))))
    return units.where(F.col("lines")[0].rlike(r"^RD\s")).select(
        _field("RD").alias("name"), _field("RG").try_cast("int").alias("rg"), "contig", _field("RS").alias("seq"), _quals("RQ").alias("qual"), clips.alias("clips"), _field("TN").alias("template"), _field("TS").try_cast("int").alias("segment"), _tags("RT").alias("tags"), place.alias("place")
    )


def _tag_lines(key: str) -> Column:
    return F.transform("tags", lambda t: F.concat_ws("\t", F.lit(key), t["id"], (t["from"] + 1).cast("string"), t["to"].cast("string"), t["strand"], t["source"], t["comment"]))


def _phred(qual: str) -> Column:
    return F.array_join(F.transform(qual, lambda q: F.char(q + 33)), "")


def write_keyed(path: str, groups: DataFrame, contigs: DataFrame, reads: DataFrame) -> None:
    """Writes groups, contigs with their placed reads, and free reads, as the readers give them. A contig stands in one file."""
    line = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f"{key}\t"), value.cast("string")))
    told = F.transform(F.map_entries("values"), lambda e: F.concat(F.lit("@RG\t"), e.key, F.lit("\t"), e.value))
    head = groups.select(F.lit(None).cast("string").alias("contig"), F.lit(0).alias("part"), F.col("id").cast("string").alias("sub"), F.concat_ws("\n", F.lit("@ReadGroup"), told, F.lit("@EndReadGroup")).alias("value"))
    top = contigs.select("contig", F.lit(1), F.lit(""), F.concat_ws("\n", line("CO", F.col("contig")), line("NR", F.col("reads")), line("LC", F.col("length")), _tag_lines("CT"), line("CS", F.col("seq")), line("CQ", _phred("qual")), F.lit("\\\\")))
    end = contigs.select("contig", F.lit(3), F.lit(""), F.lit("//\nEC"))
    c = F.col("clips")
    place = F.when(F.col("place").isNotNull(), F.concat_ws(" ", F.lit("AT"), *(F.col("place")[k].cast("string") for k in ("from", "to", "read_from", "read_to"))))
    body = F.concat_ws(
        "\n", line("RD", F.col("name")), line("RG", F.col("rg")), line("RS", F.col("seq")), line("RQ", _phred("qual")), line("TN", F.col("template")), line("TS", F.col("segment")),
        *(line(k, c[k.lower()] + (1 if k[1] == "L" else 0)) for k in ("SL", "SR", "QL", "QR", "CL", "CR")), _tag_lines("RT"), F.lit("ER"), place,
    )
    rows = head.union(top).union(end).union(reads.select("contig", F.when(F.col("contig").isNull(), 1).otherwise(2), "name", body))
    rows.repartitionByRange("contig").sortWithinPartitions(F.asc_nulls_first("contig"), "part", "sub").select("value").write.text(path)
