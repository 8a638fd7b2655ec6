"""Document fingerprints: invertible Bloom lookup sketches, with built-in functions only.

A text is cut into paragraphs: at least 96 characters, on to the next end of a sentence or line, at
most 224; the cutting runs from the left, so an unchanged beginning keeps its paragraphs. A sketch
of the distinct 64-bit paragraph digests has 24 cells in three rows; every digest enters one
cell of each row, and a cell holds a count, the XOR of digests and the XOR of their checks.
Subtracting the cells of two versions leaves what differs, and peeling cells that hold one digest
recovers it. A sketch that doesn't peel is made again larger: the digests are dealt by their own
bits over blocks of 24 cells, about ten to a block, and a block that fails is split in four, twice
at most. What little is left then is compared digest by digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import fits_broadcast, let
from marketloom.session import materialize

#: Paragraphs: at least 96 characters up to the end of a sentence; the first HEAD characters are cut
#: finer, at the blank after 12, so that short texts have several digests too.
PARAGRAPH = r"(?s).{96}[^.!?\n]{0,128}[.!?\n]*|.+"
HEAD, PIECE = 96, r"(?s).{12}\S*\s*|.+"
ROW, ROWS = 8, 3
CELLS = ROW * ROWS
LOAD = 10  # digests a block is planned for
SHIFT = 9  # the bits below choose the cells
ROUNDS = 10
NONE = "array<struct<n:int,k:bigint,c:bigint>>"


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs; none for null or empty text."""
    full = F.coalesce(text, F.lit(""))
    cut = F.concat(F.regexp_extract_all(F.substring(full, 1, HEAD), F.lit(PIECE), F.lit(0)),
                   F.regexp_extract_all(F.substring(full, HEAD + 1, (1 << 31) - 1), F.lit(PARAGRAPH), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(cut, lambda p: F.length(p) > 0), lambda p: F.xxhash64(p)))


def _check(h: Column) -> Column:
    return F.xxhash64(h, F.lit(77))


def _mask(h: Column) -> Column:
    """One bit for each of the digest's cells."""
    def bit(r: int) -> Column:
        place = (F.shiftrightunsigned(h, 3 * r).bitwiseAND(F.lit(ROW - 1)) + ROW * r).cast("int")
        return F.call_function("shiftleft", F.lit(1), place)

    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def _prepared(d: Column) -> Column:
    return F.transform(d, lambda h: F.struct(h.alias("h"), _mask(h).alias("m"), _check(h).alias("c")))


def cells(d: Column) -> Column:
    """The sketch of an array of distinct digests: CELLS structs (n, k, c)."""
    def cell(p: Column, i: Column) -> Column:
        return let(F.filter(p, lambda x: F.getbit(x.m, i) == 1), lambda q: F.struct(
            F.size(q).alias("n"),
            F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x.h)).alias("k"),
            F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x.c)).alias("c")))

    return let(_prepared(d), lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: cell(p, i)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x.n - y.n).alias("n"), x.k.bitwiseXOR(y.k).alias("k"), x.c.bitwiseXOR(y.c).alias("c")))


def peel(difference: Column) -> Column:
    """struct(cells, found): the digests recovered, with sign 1 (only in the first version) or -1."""
    def round_(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(
            F.filter(state.cells, lambda x: (F.abs(x.n) == 1) & (x.c == _check(x.k))),
            lambda x: F.struct(x.k.alias("h"), x.n.alias("s"), _mask(x.k).alias("m"), x.c.alias("c"))))
        return let(pure, lambda p: F.when(F.size(p) == 0, state).otherwise(F.struct(
            F.transform(state.cells, lambda x, i: F.aggregate(
                F.filter(p, lambda q: F.getbit(q.m, i) == 1), x,
                lambda y, q: F.struct((y.n - q.s).alias("n"), y.k.bitwiseXOR(q.h).alias("k"),
                                      y.c.bitwiseXOR(q.c).alias("c")))).alias("cells"),
            F.concat(state.found, F.transform(p, lambda q: F.struct(q.h, q.s))).alias("found"))))

    start = F.struct(difference.alias("cells"),
                     F.array().cast("array<struct<h:bigint,s:int>>").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)


def peeled(state: Column) -> Column:
    return F.forall(state.cells, lambda x: (x.n == 0) & (x.k == 0) & (x.c == 0))


def _dealt(a: Column, b: Column, blocks: Column, shift: int,
           use: Callable[[Column, Column], Column]) -> Column:
    """Sum of ``use`` over the blocks of two digest arrays, dealt by bits from ``shift`` on."""
    def block(h: Column) -> Column:
        return F.shiftrightunsigned(h, shift) % blocks

    def tagged(d: Column, s: int) -> Column:
        return F.transform(d, lambda h: F.struct(block(h).alias("b"), h.alias("h"), F.lit(s).alias("s")))

    def part(rows: Column, tags: Column, marks: Column, i: Column) -> Column:
        first = F.array_position(tags, F.element_at(marks, i))
        after = F.when(i < F.size(marks), F.array_position(
            tags, F.element_at(marks, F.least(i + 1, F.size(marks))))).otherwise(F.size(tags) + 1)
        return let(F.slice(rows, first.cast("int"), (after - first).cast("int")), lambda q: use(
            F.transform(F.filter(q, lambda x: x.s == 1), lambda x: x.h),
            F.transform(F.filter(q, lambda x: x.s == -1), lambda x: x.h)))

    def total(rows: Column) -> Column:
        return let(F.transform(rows, lambda r: r.b), lambda tags: let(
            F.array_distinct(tags), lambda marks: F.aggregate(
                F.when(F.size(marks) == 0, F.array().cast("array<int>")).otherwise(
                    F.sequence(F.lit(1), F.greatest(F.size(marks), F.lit(1)))),
                F.lit(0).cast("long"), lambda n, i: n + part(rows, tags, marks, i))))

    return let(F.sort_array(F.concat(tagged(a, 1), tagged(b, -1))), total)


def differing(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """How many paragraph digests are in one version only, by peeling, larger where that fails."""
    def retry(x: Column, y: Column, depth: int) -> Column:
        if depth == 2:
            return (F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))).cast("long")
        return let(peel(subtract(cells(x), cells(y))), lambda s: F.when(
            peeled(s), F.size(s.found).cast("long")).otherwise(
            _dealt(x, y, F.lit(4).cast("long"), SHIFT + 24 + 2 * depth, lambda p, q: retry(p, q, depth + 1))))

    blocks = F.pow(F.lit(2.0), F.ceil(F.log2((F.size(a) + F.size(b)) / LOAD))).cast("long")
    larger = _dealt(a, b, F.greatest(blocks, F.lit(2).cast("long")), SHIFT, lambda x, y: retry(x, y, 0))
    # a sketch of CELLS cells can't hold more differing digests than cells
    hopeless = F.abs(F.size(a) - F.size(b)) > CELLS
    return F.when(hopeless, larger).otherwise(let(peel(subtract(cells_a, cells_b)), lambda s: F.when(
        peeled(s), F.size(s.found).cast("long")).otherwise(larger)))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Shared over all distinct paragraphs, from the sizes and the digests recovered; 1 for two
    texts without any."""
    n = (F.size(a) + F.size(b)).cast("double")
    return let(differing(a, b, cells_a, cells_b), lambda d: F.when(n == 0, 1.0).otherwise((n - d) / (n + d)))


def fingerprint(text: Column, sketch: Column) -> Column:
    """Length and hash of the whole text, then the cells in hexadecimal."""
    body = F.array_join(F.transform(sketch, lambda x: F.when(x.n == 0, F.lit("0")).otherwise(
        F.concat_ws(".", F.hex(x.n), F.hex(x.k), F.hex(x.c)))), "|")
    return F.concat_ws(":", F.length(text).cast("string"), F.hex(F.xxhash64(text)), body)


def with_next(docs: DataFrame, per_block: int = 512, coarse: int = 256) -> DataFrame:
    """(doc_id, text, next_text): each row's follower by (doc_id, text), the first after the last.

    Ids are dealt into blocks of about ``per_block`` rows, from ``coarse`` quantiles and evenly
    inside them; one shuffle moves the texts, and only the last row of a block takes its follower
    from the table of block heads. Null ids come first, null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    total, marks, low, high = rows.agg(
        F.count(F.lit(1)), F.percentile_approx("doc_id", [i / coarse for i in range(coarse)], 10_000),
        F.min("doc_id"), F.max("doc_id")).first()
    if not total or marks is None:
        marks, low, high = [0], 0, 0
    marks = sorted({low, *marks})
    each = max(1, total // len(marks) // per_block)
    widths = [max(1, -(-(b - a) // each)) for a, b in zip(marks, [*marks[1:], high + 1])]
    ids = F.coalesce("doc_id", F.lit(low))
    place = F.size(F.filter(F.lit(marks), lambda m: m <= ids))
    rows = (rows.withColumn("c", place).withColumn("s", F.floor(
        (ids - F.element_at(F.lit(marks), F.col("c"))) / F.element_at(F.lit(widths), F.col("c"))).cast("long")))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    heads = (rows.groupBy("c", "s").agg(F.min(F.struct(
        F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("h"))).alias("first")))
    heads = materialize(heads.select("c", "s", "first.*"), "heads")
    firsts = {r.c: r.first for r in heads.groupBy("c").agg(F.min(F.struct("s", "known", "doc_id", "h")).alias("first"))
              .collect()}  # at most ``coarse``
    order_c = sorted(firsts)
    after = {c: firsts[order_c[(i + 1) % len(order_c)]] for i, c in enumerate(order_c)}
    spark = docs.sparkSession
    turn = spark.createDataFrame([(c, r.known, r.doc_id, r.h) for c, r in after.items()],
                                 "c int, t_known boolean, t_id long, t_h long")
    w = Window.partitionBy("c").orderBy("s")
    follow = heads.withColumns({"n_id": F.lead("doc_id").over(w), "n_h": F.lead("h").over(w),
                                "inner": F.lead("known").over(w).isNotNull()}).join(F.broadcast(turn), "c")
    follow = follow.select("c", "s", F.when(F.col("inner"), F.col("n_id")).otherwise(F.col("t_id")).alias("n_id"),
                           F.when(F.col("inner"), F.col("n_h")).otherwise(F.col("t_h")).alias("n_h"))
    small = fits_broadcast(heads)
    want = heads.select(F.col("doc_id").alias("h_id"), "h").distinct()
    texts = rows.withColumn("hash", F.xxhash64("text"))
    texts = texts.join(F.broadcast(want) if small else want,
                       texts["doc_id"].eqNullSafe(F.col("h_id")) & (F.col("hash") == F.col("h")), "left_semi")
    texts = texts.select(F.col("doc_id").alias("x_id"), F.col("hash").alias("x_h"),
                         F.col("text").alias("head_text")).dropDuplicates(["x_id", "x_h"])
    tails = (follow.join(texts, F.col("n_id").eqNullSafe(F.col("x_id")) & (F.col("n_h") == F.col("x_h")))
             .select("c", "s", "head_text"))
    inside = rows.withColumn("lead_text", F.lead("text").over(Window.partitionBy("c", "s").orderBy(*order)))
    return (inside.join(materialize(tails, "tails").hint("shuffle_hash"), ["c", "s"], "left")
            .select("doc_id", "text", F.coalesce("lead_text", "head_text").alias("next_text")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    A row for each input row; null text is empty. Rows with one doc_id follow each other by the
    hash of their text. A single row follows itself. Other columns are ignored."""
    half = F.floor(F.length("text") / 2).cast("int")
    made = with_next(docs).withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half),
        F.substring(F.col("next_text"), F.lit(1), half)))
    for name in ("text", "edited", "next_text"):
        made = made.withColumn(f"d_{name}", digests(F.col(name)))
    for name in ("text", "edited", "next_text"):
        made = made.withColumn(f"c_{name}", cells(F.col(f"d_{name}")))

    def like(other: str) -> Column:
        return likeness(F.col("d_text"), F.col(f"d_{other}"), F.col("c_text"), F.col(f"c_{other}"))

    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text"), F.col("c_text")).alias("fingerprint"),
        fingerprint(F.col("edited"), F.col("c_edited")).alias("edited_fingerprint"),
        like("edited").alias("near_edited"), like("next_text").alias("near_next"))
