"""Document fingerprints that can be subtracted: invertible Bloom lookup tables of paragraph digests, in Spark's own functions.

A paragraph (a \\n-split line with a word) has a 64-bit digest, which goes into three cells, one in each third of a table; a cell
keeps the number, the exclusive or of the digests and that of their check hashes. The tables of two versions are subtracted cell
by cell, which leaves what only one of them has. A cell that holds one digest gives it away, and taking it out of its other cells
frees more; when all cells are empty, the differing digests are known. If that stops short, the tables are made anew with
more cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footprints.llm.storage import row_key, written

# Cells in each third of a table. The fingerprint is the smallest table.
FIRST_WIDTH = 5
WIDTHS = [FIRST_WIDTH, 17, 67, 257]
ROUNDS = 12
_SLICE = 0x1FFFFF


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; null has none."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line)))


def _entry(key: Column, sign: Column, width: Column) -> Column:
    """A digest with its check hash and its three cells, which are slices of its bits."""
    cells = [(F.pmod(F.shiftrightunsigned(key, 21 * j).bitwiseAND(F.lit(_SLICE)), width) + width * j).cast("int").alias(f"i{j}") for j in range(3)]
    return F.struct(key.alias("k"), sign.cast("int").alias("s"), F.xxhash64(key).alias("h"), *cells)


def _holds(entry: Column, cell: Column) -> Column:
    return (entry["i0"] == cell) | (entry["i1"] == cell) | (entry["i2"] == cell)


def _put(cell: Column, entry: Column, times: int) -> Column:
    return F.struct((cell["c"] + entry["s"] * times).alias("c"), cell["k"].bitwiseXOR(entry["k"]).alias("k"), cell["h"].bitwiseXOR(entry["h"]).alias("h"))


def table(keys: Column, width: Column) -> Column:
    """Cells (c, k, h) of an array of digests."""
    empty = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("h"))
    entries = F.transform(keys, lambda k: _entry(k, F.lit(1), width))
    return _let(
        entries,
        lambda all_of: F.transform(
            F.sequence(F.lit(0), (width * 3 - 1).cast("int")),
            lambda i: F.aggregate(F.filter(all_of, lambda e: _holds(e, i)), empty, lambda cell, e: _put(cell, e, 1)),
        ),
    )


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))
    )


def peeled(cells: Column, width: Column) -> Column:
    """The digests (k, s) that are left in a subtracted table, s being 1 for the first version's; null if not all come out."""
    none = F.array().cast("array<struct<k:bigint,s:int,h:bigint,i0:int,i1:int,i2:int>>")

    def step(state, _):
        single = F.filter(state["cells"], lambda c: (F.abs(c["c"]) == 1) & (c["h"] == F.xxhash64(c["k"])))
        pure = F.array_distinct(F.transform(single, lambda c: _entry(c["k"], c["c"], width)))
        return _let(
            pure,
            lambda out: F.when(F.size(out) == 0, state).otherwise(
                F.struct(
                    F.transform(
                        state["cells"], lambda cell, i: F.aggregate(F.filter(out, lambda e: _holds(e, i)), cell, lambda x, e: _put(x, e, -1))
                    ).alias("cells"),
                    F.concat(state["found"], out).alias("found"),
                )
            ),
        )

    start = F.struct(cells.alias("cells"), none.alias("found"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    empty = lambda s: F.forall(s["cells"], lambda c: (c["c"] == 0) & (c["k"] == 0) & (c["h"] == 0))
    return _let(done, lambda s: F.when(empty(s), F.transform(s["found"], lambda e: F.struct(e["k"], e["s"]))))


def difference(a: Column, b: Column, first_a: Column, first_b: Column) -> Column:
    """The digests that only one of two versions has, by subtracting tables: the fingerprints first, then ever larger ones.

    ``a`` and ``b`` are the versions' digests, from which larger tables are made when the smaller do not come out. Digests that
    would stay together in every table are compared as sets at the very end.
    """
    width = lambda n: F.lit(n).cast("bigint")
    tries = [peeled(subtracted(first_a, first_b), width(FIRST_WIDTH))]
    both = (F.size(a) + F.size(b)).cast("bigint")
    for w in [*(width(n) for n in WIDTHS[1:]), both * 2 + 3, both * 3 + 5]:
        tries.append(peeled(subtracted(table(a, w), table(b, w)), w))
    only = lambda x, y, s: F.transform(F.array_except(x, y), lambda k: F.struct(k.alias("k"), F.lit(s).alias("s")))
    return F.coalesce(*tries, F.concat(only(a, b, 1), only(b, a, -1)))


def fingerprint(cells: Column, paragraphs: Column) -> Column:
    """The number of paragraphs and the cells of the smallest table, in hexadecimal digits."""
    shown = lambda c: F.concat(F.lpad(F.hex(c["c"]), 4, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"]), 16, "0"))
    return F.concat(paragraphs.cast("string"), F.lit(":"), F.array_join(F.transform(cells, shown), ""))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Paragraphs in both over paragraphs in either, from the sizes and the difference; 1 if there are none."""
    d = F.size(differing)
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))


def _followers(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n, next_id, next_row): each document's next by descending id, the last one's being the first.

    Only ids and lengths are sorted, in ranges; a range's last document follows on to the next range's first.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("row").desc()]
    ids = docs.select("doc_id", "row", F.coalesce(F.length("text"), F.lit(0)).alias("n")).distinct()
    ids = written(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ids")
    within = Window.partitionBy("part").orderBy(*order)
    this = F.struct("doc_id", "row")
    ranked = ids.withColumn("next", F.lead(this).over(within)).withColumn("place", F.row_number().over(within))
    # One row a range.
    firsts = ranked.where("place = 1").select("part", this.alias("first"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(every)).alias("after"))
    joined = ranked.join(after, "part").withColumn("next", F.coalesce("next", "after"))
    return joined.select("doc_id", "row", "n", F.col("next.doc_id").alias("next_id"), F.col("next.row").alias("next_row"))


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the differing digests) per row.

    The edited text is the text with its last floor(n_chars / 2) characters replaced by as many of the next document's first, or
    all it has; next is by descending doc_id (null at the end, equal ids by a hash of the text), and after the last comes the
    first. A null text is empty; texts without paragraphs are alike. Repeated rows are one document and get equal answers.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("row", row_key()).select("doc_id", "row", F.coalesce("text", F.lit("")).alias("text"))
    links = _followers(keyed)
    other = links.select(F.col("doc_id").alias("to_id"), F.col("row").alias("to_row"), (F.floor(F.col("n") / 2)).cast("int").alias("half"), "next_id", "next_row")
    heads = keyed.join(other, (F.col("row") == F.col("next_row")) & F.col("doc_id").eqNullSafe(F.col("next_id")))
    heads = heads.select("to_id", "to_row", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"), digests(F.col("text")).alias("next_keys"))
    heads = heads.groupBy("to_id", "to_row").agg(F.first(F.struct("head", "next_keys")).alias("next"))
    both = keyed.join(heads, (F.col("row") == F.col("to_row")) & F.col("doc_id").eqNullSafe(F.col("to_id")))
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("next.head"))
    made = both.select("doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"), F.col("next.next_keys").alias("next_keys"))
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("keys"), digests(F.col("edited")).alias("edited_keys"), "next_keys")
    width = F.lit(FIRST_WIDTH).cast("bigint")
    cells = made.select("*", *[table(F.col(k), width).alias(f"{k}_cells") for k in ("keys", "edited_keys", "next_keys")])
    compared_with = lambda k: difference(F.col("keys"), F.col(k), F.col("keys_cells"), F.col(f"{k}_cells"))
    found = cells.select("*", compared_with("edited_keys").alias("edited_difference"), compared_with("next_keys").alias("next_difference"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("keys_cells"), F.size("keys")).alias("fingerprint"),
        fingerprint(F.col("edited_keys_cells"), F.size("edited_keys")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys"), F.col("edited_difference")).alias("near_edited"),
        likeness(F.col("keys"), F.col("next_keys"), F.col("next_difference")).alias("near_next"),
        F.col("edited_difference").alias("differing"),
    )
