"""Column functions on sequences, qualities, flags and CIGAR strings.

All stay inside the JVM; CIGAR offsets are prefix sums inside the row, so
expanding alignments needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REF_OPS, READ_OPS, EMIT_OPS = "MDN=X", "MIS=X", "M=X"


def reverse_complement(seq: Column) -> Column:
    """Other letters stay as they are."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def kmer_code(digits: Column) -> Column:
    """Base-3 value of a three-letter k-mer, first digit highest; k up to 39."""
    return F.conv(digits, 3, 10).cast("bigint")


def words_2bit(seq: Column) -> Column:
    """array<decimal(20,0)>: 32 bases a word, base i at bits 2i, anything but C, G, T is 0."""
    digits = F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "A"), "ACGT", "0123")
    count = F.ceil(F.length(seq) / 32).cast("int")
    word = lambda i: F.conv(F.reverse(F.substring(digits, i * 32 + 1, F.lit(32))), 4, 10).cast("decimal(20,0)")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), word)).otherwise(F.array().cast("array<decimal(20,0)>"))


def bases_2bit(words: Column, length: Column) -> Column:
    """The first ``length`` bases of words of two bits a base."""
    text = F.array_join(F.transform(words, lambda w: F.reverse(F.lpad(F.conv(w.cast("string"), 10, 4), 32, "0"))), "")
    return F.translate(F.substring(text, F.lit(1), length), "0123", "ACGT")


def phred(symbol: Column) -> Column:
    return F.ascii(symbol) - 33


def qualities(qual: Column) -> Column:
    """array<int> of a quality string; empty for an empty string."""
    return F.when(F.length(qual) > 0, F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)).otherwise(F.array().cast("array<int>"))


def flag_set(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def cigar_ops(cigar: Column) -> Column:
    """array<struct<op, len>> in order, zero-length operations included."""
    pattern = F.lit("(\\d+)([MIDNSHP=X])")
    lens = F.regexp_extract_all(cigar, pattern, F.lit(1))
    codes = F.regexp_extract_all(cigar, pattern, F.lit(2))
    return F.zip_with(codes, lens, lambda op, n: F.struct(op.alias("op"), n.cast("int").alias("len")))


def placed_ops(ops: Column, ref_ops: str = REF_OPS, read_ops: str = READ_OPS, emit: str = EMIT_OPS) -> Column:
    """array<struct<op, len, ref, read, ordinal>>: operations with the bases of each kind before them, in one pass."""
    zero = F.lit(0).cast("bigint")
    kind = "array<struct<op:string,len:bigint,ref:bigint,read:bigint,ordinal:bigint>>"
    start = F.struct(zero.alias("ref"), zero.alias("read"), zero.alias("ordinal"), F.array().cast(kind).alias("out"))

    def add(a, o):
        n = o["len"].cast("bigint")
        on = lambda kinds: F.when(F.instr(F.lit(kinds), o["op"]) > 0, n).otherwise(zero)
        one = F.struct(o["op"].alias("op"), n.alias("len"), a["ref"].alias("ref"), a["read"].alias("read"), a["ordinal"].alias("ordinal"))
        return F.struct((a["ref"] + on(ref_ops)).alias("ref"), (a["read"] + on(read_ops)).alias("read"), (a["ordinal"] + on(emit)).alias("ordinal"), F.concat(a["out"], F.array(one)).alias("out"))

    return F.aggregate(ops, start, add, lambda a: a["out"])


def _operations(sam: DataFrame, keep: list[str], emit: str, ref_ops: str, read_ops: str, qual: bool) -> DataFrame:
    """(keep..., __pos, __seq[, __qual], __o): a row an operation that emits bases of the read."""
    shown = F.filter(placed_ops(cigar_ops(F.col("cigar")), ref_ops, read_ops, emit), lambda o: (F.instr(F.lit(emit), o["op"]) > 0) & (F.least(o["len"], F.length("seq") - o["read"]) > 0))
    return sam.select(*keep, (F.col("pos") - 1).alias("__pos"), F.col("seq").alias("__seq"), *([F.col("qual").alias("__qual")] if qual else []), F.explode(shown).alias("__o"))


def aligned_pieces(sam: DataFrame, keep: list[str], run: int, emit: str = EMIT_OPS, ref_ops: str = REF_OPS, read_ops: str = READ_OPS) -> DataFrame:
    """(keep..., run, off, letters): the bases of ``aligned_bases``, a row for each operation and ``run`` reference
    positions that it meets; ``letters`` begin ``off`` positions into the run."""
    o, x = F.col("__o"), F.col("__at")
    letters = F.substring("__seq", (o["read"] + 1).cast("int"), o["len"].cast("int"))
    rows = _operations(sam, keep, emit, ref_ops, read_ops, False).select(*keep, (F.col("__pos") + o["ref"]).alias("__at"), letters.alias("__letters"))
    end = x + F.length("__letters")

    def piece(r):
        start = F.greatest(x, r * run)
        return F.struct(r.alias("run"), (start - r * run).cast("int").alias("off"), F.substring(F.col("__letters"), (start - x + 1).cast("int"), (F.least(end, (r + 1) * run) - start).cast("int")).alias("letters"))

    # no piece carries its operation's letters
    return rows.select(*keep, F.explode(F.transform(F.sequence(F.floor(x / run), F.floor((end - 1) / run)), piece)).alias("__p")).select(*keep, "__p.*")


def aligned_bases(sam: DataFrame, keep: list[str], emit: str = EMIT_OPS, ref_ops: str = REF_OPS, read_ops: str = READ_OPS, qual: str | None = None) -> DataFrame:
    """(keep..., aligned_idx, ref_pos, base[, q]): 0-based reference position of every emitted base.

    Truncated at the read's end; ``aligned_idx`` counts emitted bases of the
    read from 0. Needs columns cigar, pos (1-based) and seq. ``qual`` adds the
    quality letter (null past its end) at the base's "ordinal" or its "read" offset.

    A row is cut into one piece an operation, and pieces into bases, so that no
    base's row carries the read.
    """
    each = _operations(sam, keep, emit, ref_ops, read_ops, bool(qual))
    part = lambda c, at: F.split(F.substring(c, (F.col(f"__o.{at}") + 1).cast("int"), F.col("__o.len").cast("int")), "")
    letters = part("__seq", "read")
    if qual:
        letters = F.arrays_zip(letters.alias("base"), F.when(F.length("__qual") > F.col(f"__o.{qual}"), part("__qual", qual)).otherwise(F.array().cast("array<string>")).alias("q"))
    piece = each.select(*keep, F.col("__o.ordinal").alias("__ordinal"), (F.col("__pos") + F.col("__o.ref")).alias("__ref"), letters.alias("__letters"))
    rows = piece.select(*keep, "__ordinal", "__ref", F.posexplode("__letters").alias("__j", "__b"))
    names = ["__b.base", "__b.q"] if qual else [F.col("__b").alias("base")]
    rows = rows.select(*keep, (F.col("__ordinal") + F.col("__j")).alias("aligned_idx"), (F.col("__ref") + F.col("__j")).alias("ref_pos"), *names)
    # a piece of quality may be longer than the rest of the read
    return rows.where("base is not null") if qual else rows
