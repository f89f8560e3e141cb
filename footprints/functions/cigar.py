"""Alignment blocks from a position and a cigar ``array<struct<op int, len int>>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Cigar operation letters in code order.
OPERATIONS = "MIDNSHP=X"
ON_REFERENCE = [0, 2, 3, 7, 8]
ALIGNED = [0, 7, 8]
IN_READ = [0, 1, 4, 7, 8]
SOFT_CLIP = 4
SKIP = 3
INDELS = [1, 2]


def parse(text: Column) -> Column:
    lengths = F.regexp_extract_all(text, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    letters = F.regexp_extract_all(text, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(
        lengths,
        letters,
        lambda n, op: F.struct((F.instr(F.lit(OPERATIONS), op) - 1).alias("op"), n.cast("int").alias("len")),
    )


def unparse(cigar: Column) -> Column:
    return F.array_join(
        F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), F.substr(F.lit(OPERATIONS), c["op"] + 1, F.lit(1)))), ""
    )


def _total(cigar: Column, operations: list[int]) -> Column:
    return F.aggregate(
        cigar, F.lit(0), lambda acc, c: acc + F.when(c["op"].isin(operations), c["len"]).otherwise(F.lit(0))
    )


def reference_end(pos: Column, cigar: Column) -> Column:
    return pos + _total(cigar, ON_REFERENCE)


def aligned_length(cigar: Column) -> Column:
    return _total(cigar, ALIGNED)


def query_length(cigar: Column) -> Column:
    return _total(cigar, IN_READ)


def aligned_blocks(pos: Column, cigar: Column) -> Column:
    """Half-open reference blocks ``array<struct<start bigint, end bigint>>`` of the aligned bases."""
    empty = F.struct(
        pos.cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("blocks")
    )

    def step(acc: Column, c: Column) -> Column:
        span = F.when(c["op"].isin(ON_REFERENCE), c["len"]).otherwise(F.lit(0)).cast("bigint")
        block = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + span).alias("end")))
        return F.struct(
            (acc["at"] + span).alias("at"),
            F.when(c["op"].isin(ALIGNED), F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"),
        )

    return F.aggregate(cigar, empty, step, lambda acc: acc["blocks"])


def keep_read_bases(cigar: Column, first: Column, last: Column) -> Column:
    """The cigar of read bases ``first .. last - 1`` (0-based); blocks outside are dropped, edge blocks shortened."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<op:int,len:int>>").alias("kept"))

    def step(acc: Column, c: Column) -> Column:
        in_read = c["op"].isin(IN_READ)
        end = acc["at"] + F.when(in_read, c["len"]).otherwise(F.lit(0))
        overlap = F.least(end, last) - F.greatest(acc["at"], first)
        inside = (acc["at"] > first) & (acc["at"] < last)
        kept = (
            F.when(in_read & (overlap > 0), F.concat(acc["kept"], F.array(F.struct(c["op"].alias("op"), overlap.cast("int").alias("len")))))
            .when(~in_read & inside, F.concat(acc["kept"], F.array(F.struct(c["op"].alias("op"), c["len"].alias("len")))))
            .otherwise(acc["kept"])
        )
        return F.struct(end.cast("int").alias("at"), kept.alias("kept"))

    return F.aggregate(cigar, start, step, lambda acc: acc["kept"])
