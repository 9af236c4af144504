"""Scalar functions of DNA strings as Column expressions: all stay in the JVM.

Defined cases: null gives null; the empty string has a null GC content and no k-mers; a string shorter than k has no k-mers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error types in the order of their numbers, and k-mer classes in theirs.
ERROR_TYPES = ("CORRECT", "INSERTION", "SUB_FROM_A", "SUB_FROM_C", "SUB_FROM_G", "SUB_FROM_T", "DEL_OF_A", "DEL_OF_C", "DEL_OF_G", "DEL_OF_T", "MULTIDEL", "NODEL")
KMER_TYPES = ("REPEAT", "TRUSTED", "UNTRUSTED")


def complement(s: Column) -> Column:
    return F.translate(s, "ACGT", "TGCA")


def reverse_complement(s: Column, strict: bool = False) -> Column:
    """The other strand; characters outside ACGTN pass through, or raise an error if strict."""
    out = F.reverse(complement(s))
    return F.when(s.rlike("^[ACGTN]*$"), out).otherwise(F.raise_error(F.concat(F.lit("not a DNA string: "), s)).cast("string")) if strict else out


def base_complement(base: Column) -> Column:
    """The base across; anything but A, C, G and T gives N."""
    return F.when(base.isin("A", "C", "G", "T"), complement(base)).when(base.isNotNull(), F.lit("N"))


def gc_count(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, "GC", ""))


def gc_content(s: Column) -> Column:
    return F.when(F.length(s) > 0, gc_count(s) / F.length(s))


def gc_bin(s: Column, compat: bool = False) -> Column:
    """The number of G and C; compat divides two floating-point fractions, which may fall one short."""
    n, k = gc_count(s).cast("double"), F.length(s).cast("double")
    return F.floor((n / k) / (F.lit(1.0) / k)).cast("int") if compat else gc_count(s).cast("int")


def minimum_k(genome_size: int) -> int:
    """The least odd k of at least floor(log4(200 * genome_size))."""
    k = math.floor(math.log(200 * genome_size) / math.log(4))
    return k + 1 if k % 2 == 0 else k


def part_of(s: Column, pos: Column, n: Column | int) -> Column:
    """n characters of an ASCII string from pos (from 0): bytes are cut in place, where characters would be counted from the start."""
    return F.substring(s.cast("binary"), (pos + 1).cast("int"), n if isinstance(n, Column) else F.lit(n)).cast("string")


def kmers(s: Column, k: int) -> Column:
    """Array of (pos, kmer), pos from 0; for short strings, as each k-mer is looked for from the start."""
    here = F.sequence(F.lit(0), F.length(s) - k)
    each = F.transform(here, lambda p: F.struct(p.alias("pos"), F.substring(s, p + 1, F.lit(k)).alias("kmer")))
    return F.when(F.length(s) >= k, each).otherwise(F.array().cast("array<struct<pos:int,kmer:string>>"))


def read_name(s: Column) -> Column:
    """A read's id up to the first slash, then the first space."""
    return F.substring_index(F.substring_index(s, "/", 1), " ", 1)


def infer_error_type(old: Column, new: Column) -> Column:
    """What turned `new` into the one base `old`."""
    n = F.length(new)
    letter = lambda c: F.when(c.isin("A", "C", "G"), c).otherwise(F.lit("T"))
    return F.when(n == 0, "INSERTION").when(n == 1, F.concat(F.lit("SUB_FROM_"), letter(new))).when(n == 2, F.concat(F.lit("DEL_OF_"), letter(F.substring(new, 2, 1)))).otherwise("MULTIDEL")


def undo_error(s: Column, kind: Column, pos: Column) -> Column:
    """s as it was before an error of this kind at pos (from 0); MULTIDEL cannot be undone and gives null."""
    base, last = F.substring(s, pos + 1, F.lit(1)), F.substring(kind, -1, 1)
    instead = F.when(kind.startswith("SUB_FROM_"), last).when(kind == "INSERTION", "").when(kind.startswith("DEL_OF_"), F.concat(base, last)).when(kind.isin("CORRECT", "NODEL"), base)
    return F.concat(F.substring(s, F.lit(1), pos), instead, F.substring(s, pos + 2, F.length(s)))


def possible_errors(s: Column, pos: Column) -> Column:
    """Kinds of error that a base at pos (from 0) may stem from; deletions and insertions not at the end."""
    base = F.substring(s, pos + 1, F.lit(1))
    subs = F.filter(F.array(*map(F.lit, ERROR_TYPES[2:6])), lambda t: F.substring(t, -1, 1) != base)
    more = F.array(*map(F.lit, (ERROR_TYPES[1], *ERROR_TYPES[6:10])))
    return F.when(pos < F.length(s) - 1, F.concat(subs, more)).otherwise(subs)


def most_likely(scores: Column, default: str) -> Column:
    """The kind with the highest of an array of (score, number); the smaller number wins ties, null and empty give default."""
    best = F.array_max(F.transform(scores, lambda x: F.struct(x["score"].alias("score"), (-x["number"]).alias("rank"))))
    return F.coalesce(F.element_at(F.array(*map(F.lit, ERROR_TYPES)), 1 - best["rank"]), F.lit(default))


def error_number(kind: Column) -> Column:
    """0 to 11; an unknown name raises an error."""
    at = F.array_position(F.array(*map(F.lit, ERROR_TYPES)), kind)
    return F.when(at > 0, (at - 1).cast("int")).when(kind.isNotNull(), F.raise_error(F.concat(F.lit("no such error type: "), kind)).cast("int"))


def error_type(number: Column) -> Column:
    """The name of an error type's number; numbers outside 0 to 11 raise an error."""
    names = F.array(*map(F.lit, ERROR_TYPES))
    return F.when(number.between(0, 11), F.get(names, number)).when(number.isNotNull(), F.raise_error(F.concat(F.lit("no such error number: "), number.cast("string"))))


def kmer_type_number(kind: Column) -> Column:
    """0 to 2; an unknown name raises an error."""
    at = F.array_position(F.array(*map(F.lit, KMER_TYPES)), kind)
    return F.when(at > 0, (at - 1).cast("int")).when(kind.isNotNull(), F.raise_error(F.concat(F.lit("no such k-mer type: "), kind)).cast("int"))


def kmer_type(number: Column) -> Column:
    """The name of a k-mer class's number; numbers outside 0 to 2 raise an error."""
    return F.when(number.between(0, 2), F.get(F.array(*map(F.lit, KMER_TYPES)), number)).when(number.isNotNull(), F.raise_error(F.concat(F.lit("no such k-mer number: "), number.cast("string"))))


def kmer_after_error(s: Column, kind: Column, pos: Column) -> Column:
    """undo_error for types that change a k-mer; CORRECT, NODEL and MULTIDEL raise an error."""
    return F.when(kind.isin("CORRECT", "NODEL", "MULTIDEL"), F.raise_error(F.concat(F.lit("changes no k-mer: "), kind)).cast("string")).otherwise(undo_error(s, kind, pos))


def correction(pos: Column, orig_pos: Column, old: Column, new: Column, prob: Column | None = None, kind: Column | None = None) -> Column:
    """A correction as a struct: type inferred from the bases unless given, probability 1 unless given. Equal bases raise an error."""
    kind = infer_error_type(old, new) if kind is None else kind
    kind = F.when((old == new) & (kind != "MULTIDEL"), F.raise_error(F.lit("a correction must change something")).cast("string")).otherwise(kind)
    return F.struct(kind.alias("type"), pos.alias("pos"), orig_pos.alias("orig_pos"), old.alias("old"), new.alias("new"), (F.lit(1.0) if prob is None else prob).alias("prob"))


def motif_index(motif: Column) -> Column:
    """A motif's place in the list of all motifs over A, C, G, T and N, shorter ones first; other letters count as A."""
    digits = F.translate(F.regexp_replace(motif, "[^ACGTN]", "A"), "ACGTN", "01234")
    value = F.aggregate(F.filter(F.split(digits, ""), lambda d: d != ""), F.lit(0).cast("long"), lambda acc, d: acc * 5 + d.cast("long"))
    return value + ((F.pow(F.lit(5.0), F.length(motif)) - 1) / 4).cast("long") - 1


def motif_at(index: Column, longest: int = 12) -> Column:
    """The motif at a place in that list."""
    size = F.lit(longest)
    for n in range(longest - 1, 0, -1):
        size = F.when(index < (5 ** (n + 1) - 1) // 4 - 1, n).otherwise(size)
    value = index + 1 - ((F.pow(F.lit(5.0), size) - 1) / 4).cast("long")
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 5), size, F.lit("0")), "01234", "ACGTN")


def middle_quality(a: Column, b: Column) -> Column:
    """The quality character halfway between two, rounded down."""
    return F.char(F.floor((F.ascii(a) + F.ascii(b)) / 2).cast("int"))


def correction_text(kind: Column, pos: Column, old: Column, new: Column, prob: Column) -> Column:
    """type, position, old and new bases and probability; no base prints as a dot."""
    dot = lambda c: F.when(c == "", ".").otherwise(c)
    return F.concat_ws(" ", kind, pos.cast("string"), dot(old), dot(new), prob.cast("string"))


def md_text(found: Column) -> Column:
    """Substitutions of an MD tag as "base position," one after another."""
    return F.array_join(F.transform(found, lambda x: F.concat(x["base"], F.lit(" "), x["position"].cast("string"), F.lit(","))), "")


def md_substitutions(md: Column) -> Column:
    """Array of (base, position) of the substitutions in an MD tag; deleted letters take no position."""
    tokens = F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Z]+|[A-Z])"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<base:string,position:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        number, gap = t.rlike("^[0-9]"), t.startswith("^")
        here = F.array(F.struct(t.alias("base"), acc["at"].alias("position")))
        at = F.when(number, acc["at"] + F.expr("0") + F.when(number, t).otherwise("0").cast("int")).when(gap, acc["at"]).otherwise(acc["at"] + 1)
        return F.struct(at.alias("at"), F.when(number | gap, acc["out"]).otherwise(F.concat(acc["out"], here)).alias("out"))

    return F.aggregate(tokens, start, step)["out"]
