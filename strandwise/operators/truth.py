"""True errors of reads out of their alignments with a genome.

Defined cases: unmapped and hard-clipped records, and reads with several records, give none; soft-clipped bases are
passed over; `=` and `X` count as matches that are looked at base by base; null cigars give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.sequence import complement, part_of, reverse_complement
from strandwise.session import written


def cigar_steps(cigar: Column) -> Column:
    """Array of (op, n, read_at, ref_at): what each step takes and where it starts in the read and in the reference."""
    counts = F.regexp_extract_all(cigar, F.lit(r"([0-9]+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(r"([0-9]+)([MIDNSHP=X])"), F.lit(2))
    pairs = F.arrays_zip(counts.alias("c"), ops.alias("o"))
    kind = "array<struct<op:string,n:int,read_at:int,ref_at:int>>"
    start = F.struct(F.lit(0).alias("read_at"), F.lit(0).alias("ref_at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n, op = x["c"].cast("int"), x["o"]
        one = F.array(F.struct(op.alias("op"), n.alias("n"), acc["read_at"].alias("read_at"), acc["ref_at"].alias("ref_at")))
        return F.struct(
            (acc["read_at"] + F.when(op.isin("M", "I", "S", "=", "X"), n).otherwise(0)).alias("read_at"),
            (acc["ref_at"] + F.when(op.isin("M", "D", "N", "=", "X"), n).otherwise(0)).alias("ref_at"),
            F.concat(acc["out"], one).alias("out"),
        )

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def usable(alignments: DataFrame) -> DataFrame:
    """Mapped records without a hard clip of the reads that have one record, with steps and span on the reference."""
    single = alignments.groupBy("read_id").agg(F.count("*").alias("records")).where("records = 1").select("read_id")
    rows = alignments.join(single, "read_id", "left_semi").where((F.col("flag").bitwiseAND(4) == 0) & ~F.col("cigar").contains("H"))
    rows = rows.withColumn("steps", cigar_steps(F.col("cigar")))
    return rows.withColumn("span", F.expr("aggregate(steps, 0, (a, s) -> a + if(s.op in ('M', 'D', 'N', '=', 'X'), s.n, 0))"))


def with_reference(rows: DataFrame, genome: DataFrame, least: int = 4096, deep: int = 50_000) -> DataFrame:
    """rows with ref, the stretch of genome under each; the genome is dealt in overlapping tiles, never as whole contigs.

    Tiles under more than `deep` rows are dealt as several copies, each for a share of the rows, so that a small genome
    under many reads is not the work of as few tasks as it has tiles.
    """
    cell = F.floor(F.col("begin_pos") / least)
    cells = written(rows.groupBy("contig", cell.alias("cell")).agg(F.count("*").alias("n"), F.max("span").alias("span")), "tile-depths")
    tile = least * max(1, -(-cells.agg(F.coalesce(F.max("span"), F.lit(0)).alias("s")).first().s // least))
    depth = cells.groupBy("contig", F.floor(F.col("cell") * least / tile).alias("tile")).agg(F.sum("n").alias("n"))
    copies = depth.where(F.col("n") > deep).select("contig", "tile", F.ceil(F.col("n") / deep).alias("copies"))
    n = F.coalesce("copies", F.lit(1).cast("long"))
    starts = genome.where(F.length("seq") > 0).select("contig", F.col("seq").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("seq") - 1) / tile))).alias("tile"))
    tiles = starts.select("contig", "tile", part_of(F.col("g"), F.col("tile") * tile, 2 * tile).alias("part"))
    tiles = tiles.join(copies, ["contig", "tile"], "left").select("contig", "tile", "part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("copy"))
    met = rows.withColumn("tile", F.floor(F.col("begin_pos") / tile)).join(copies, ["contig", "tile"], "left")
    met = met.withColumn("copy", F.pmod(F.xxhash64("read_id", "begin_pos"), n)).drop("copies").join(tiles, ["contig", "tile", "copy"])
    return met.withColumn("ref", part_of(F.col("part"), F.col("begin_pos") - F.col("tile") * tile, F.col("span"))).drop("part", "tile", "copy")


def true_corrections(alignments: DataFrame, genome: DataFrame) -> DataFrame:
    """read_id, orig_pos (in the read as sequenced, from 0), type and ref_pos of each true error."""
    rows = with_reference(usable(alignments), genome)
    steps = rows.select("read_id", "flag", "begin_pos", "seq", "ref", F.length("seq").alias("size"), F.inline("steps"))
    # Only places that differ are written out, so that work grows with a read's length and rows with its errors.
    letters = [F.split(part_of(F.col(c), F.col(at), F.col("n")), "") for c, at in (("seq", "read_at"), ("ref", "ref_at"))]
    differs = F.filter(F.transform(F.zip_with(*letters, lambda a, b: ~a.eqNullSafe(b)), lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    which = F.when(F.col("op") == "D", F.array(F.lit(0))).when(F.col("op") == "I", F.sequence(F.lit(0), F.col("n") - 1)).otherwise(differs)
    each = steps.where(F.col("op").isin("M", "=", "X", "I", "D") & (F.col("n") > 0)).withColumn("i", F.explode(which))
    each = each.withColumn("other", part_of(F.col("ref"), F.col("ref_at") + F.col("i"), 1))
    back = F.col("flag").bitwiseAND(16) != 0
    strand = F.when(back, complement(F.col("other"))).otherwise(F.col("other"))
    kind = F.when(F.col("op") == "I", "INSERTION").when((F.col("op") == "D") & (F.col("n") > 1), "MULTIDEL").when(F.col("op") == "D", F.concat(F.lit("DEL_OF_"), strand)).otherwise(F.concat(F.lit("SUB_FROM_"), strand))
    at = F.when(F.col("op") == "D", F.when(back, F.col("size") - 1 - F.col("read_at")).otherwise(F.col("read_at") - 1)).otherwise(
        F.when(back, F.col("size") - 1 - F.col("read_at") - F.col("i")).otherwise(F.col("read_at") + F.col("i"))
    )
    return each.select("read_id", at.cast("long").alias("orig_pos"), kind.alias("type"), (F.col("begin_pos") + F.col("ref_at") + F.when(F.col("op") == "I", 0).otherwise(F.col("i"))).cast("long").alias("ref_pos"))


def grouped(alignments: DataFrame) -> DataFrame:
    """read_id and records, an array of all its records (flag, contig, begin_pos, cigar, seq and, if there, line), in the file's order if they have `line`."""
    columns = [c for c in ("line", "flag", "contig", "begin_pos", "cigar", "seq", "qual", "md") if c in alignments.columns]
    return alignments.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("records"))


def counters(alignments: DataFrame) -> DataFrame:
    """One row: reads, those whose first record (by line) is mapped, and those with one record."""
    each = alignments.groupBy("read_id").agg(F.min_by("flag", "line").alias("flag"), F.count("*").alias("records"))
    return each.agg(
        F.count("*").alias("reads"),
        F.count(F.when(F.col("flag").bitwiseAND(4) == 0, 1)).alias("mapped"),
        F.count(F.when(F.col("records") == 1, 1)).alias("single"),
    )


def sequenced(alignments: DataFrame) -> DataFrame:
    """read_id with a leading @, and the read as the sequencer gave it: its first record without a hard clip, turned back if it lies on the other strand.

    A read that only has hard-clipped records has no row. Quality is reversed along; records are ordered by line.
    """
    whole = alignments.where(~F.coalesce("cigar", F.lit("")).contains("H"))
    columns = [c for c in ("flag", "seq", "qual", "begin_pos") if c in alignments.columns]
    first = whole.groupBy("read_id").agg(F.min_by(F.struct(*columns), "line").alias("r"))
    back = F.col("r.flag").bitwiseAND(16) != 0
    out = [F.concat(F.lit("@"), F.col("read_id").cast("string")).alias("read_id"), F.when(back, reverse_complement(F.col("r.seq"))).otherwise(F.col("r.seq")).alias("seq")]
    if "qual" in columns:
        out.append(F.when(back, F.reverse("r.qual")).otherwise(F.col("r.qual")).alias("qual"))
    return first.select(*out, F.col("r.begin_pos").alias("begin_pos"))


def ends(alignments: DataFrame) -> DataFrame:
    """read_id, begin_pos and end_pos, the last reference place under each usable read."""
    return usable(alignments).select("read_id", "begin_pos", (F.col("begin_pos") + F.col("span") - 1).cast("long").alias("end_pos"))


def clipped_places(alignments: DataFrame) -> DataFrame:
    """read_id and orig_pos of the soft-clipped bases of usable reads, in the read as sequenced."""
    steps = usable(alignments).select("read_id", "flag", F.length("seq").alias("size"), F.inline("steps")).where("op = 'S'")
    each = steps.select("read_id", "flag", "size", F.explode(F.sequence("read_at", F.col("read_at") + F.col("n") - 1)).alias("at"))
    back = F.col("flag").bitwiseAND(16) != 0
    return each.select("read_id", F.when(back, F.col("size") - 1 - F.col("at")).otherwise(F.col("at")).cast("long").alias("orig_pos"))


def true_reads(alignments: DataFrame, genome: DataFrame) -> DataFrame:
    """read_id, seq (as sequenced) and true_seq: the bases without the errors of the usable reads, missing stretches as an underscore."""
    from strandwise.operators.correction import apply

    rows = usable(alignments)
    back = F.col("flag").bitwiseAND(16) != 0
    reads = rows.select("read_id", F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    found = true_corrections(alignments, genome).select("read_id", "orig_pos", "type")
    return apply(reads, found).select("read_id", "seq", F.col("corrected").alias("true_seq"))
