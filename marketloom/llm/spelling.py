"""Spelling variants: words one edit apart, by dense prefix-suffix tiling.

1. Every whole text is cut into letter runs; a run whose checksum is a multiple of 97 loses one
   letter (a planted slip). Counts are summed inside each task before the shuffle.
2. Two words are one insertion, deletion or replacement apart exactly if common prefix plus common
   suffix reach the longer length minus one. With L the longer length, the prefix then lies in
   one of ``PARTS`` ranges of 0..L-1, and each range fixes a beginning and an end that both
   words have. Words meet only under such a (L, range, beginning, end), never in all pairs.
3. A group's words are the rows of a padded code-point matrix (one left-, one right-aligned).
   Groups above ``BLOCK`` words are cut into blocks, and block pairs become tasks of their own. Prefix and
   suffix lengths of a tile come from two dense comparisons. A pair counts only in the range its
   prefix lies in, so it counts once.
4. Counts and best forms are summed per word; roots follow forms by pointer doubling. A form
   is at least twice as frequent, so chains are as short as the logarithm of the counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import join_narrow
from marketloom.operators.skew import spread_join
from marketloom.session import materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SLIP = 97
PARTS = 3
BLOCK = 2048
_DISTINCT = 200_000     # words a task counts before it hands them on
_CELLS = 1 << 22        # cells compared at once
_LONG = 1 << 20


def slip(run: bytes, seed: int) -> bytes:
    """The lower-cased run (UTF-8), without one code point if its checksum is a multiple of 97."""
    h = zlib.crc32(run, seed)
    if h % SLIP:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def runs(text: str):
    """All letter runs; those of a very long text one after the other."""
    return RUN.findall(text) if len(text) < _LONG else (m[0] for m in RUN.finditer(text))


def count_words(docs: DataFrame, least: int = 5) -> DataFrame:
    """(word, n): the words of at least ``least`` code points of all texts, partly summed."""
    def run(batches):
        total: Counter[bytes] = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())],
                ["word", "n"])
            total.clear()
            return out

        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                seed = zlib.crc32(f"{b.column(0)[i].as_py() or ''}:".encode())
                for found, n in Counter(runs(text)).items():
                    word = slip(found.encode().lower(), seed)
                    if len(word) >= least and (word.isascii() or len(word.decode()) >= least):
                        total[word] += n
                if len(total) > _DISTINCT:
                    yield rows()
        yield rows()

    return docs.where("text is not null").select(F.col("doc_id").cast("string"), "text").mapInArrow(
        run, "word string, n long")


def keyed(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, n, long, part, key): a row for each longer length and range under which a word can
    meet its near words. ``long`` is the length of the pair's longer word."""
    places = ", ".join(f"named_struct('long', length(word) + {more}, 'part', {t})"
                       for more in (0, 1) for t in range(parts))
    at, to = f"cast(part * long div {parts} as int)", f"cast((part + 1) * long div {parts} as int)"
    return (words.selectExpr("word", "n", f"inline(array({places}))")
            .selectExpr("word", "n", "long", "part", f"xxhash64(long, part, left(word, {at}), "
                        f"right(word, long - {to})) as key"))


def tiled(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` with (own, lo, hi): blocks of groups above ``block`` words, each word once for every
    block pair its block is part of."""
    large = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") > block)
                        .select("key", F.ceil(F.col("of") / block).cast("int").alias("blocks")), "large")
    if large.isEmpty():
        return rows.withColumns({"own": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})
    return (join_narrow(rows, large, ["key"], "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
            .drop("blocks", "other"))


class Matrix:
    """Words of length ``long`` or one less as left- and right-aligned code points."""

    def __init__(self, words: list[str], long: int) -> None:
        coded = [w.encode("latin-1") for w in words]
        self.long = long
        self.full = np.array([len(w) == long for w in coded])
        self.left = self._of([w.ljust(long, b"\0") for w in coded])
        self.right = self._of([w.rjust(long, b"\0") for w in coded])

    def _of(self, rows: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), self.long)

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For tiles ``i`` x ``j`` (or equal shapes): one edit apart, and the common prefix length.
        Equal words must not meet."""
        prefix = (self.left[i] == self.left[j]).argmin(axis=-1)
        suffix = (self.right[i] == self.right[j])[..., ::-1].argmin(axis=-1)
        return (prefix + suffix >= self.long - 1) & (self.full[i] | self.full[j]), prefix

    def tile(self, a: np.ndarray, b: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, row, prefix) of the near pairs of ``a`` x ``b``, or of ``a`` with itself."""
        other = a if b is None else b
        step = max(1, _CELLS // (len(other) * self.long + 1))
        for lo in range(0, len(a), step):
            part = a[lo:lo + step]
            of = other[lo:] if b is None else other
            hit, prefix = self.near(part[:, None], of[None, :])
            if b is None:
                hit &= part[:, None] < of[None, :]
            x, y = np.nonzero(hit)
            yield part[x], of[y], prefix[x, y]

    def diagonals(self, ends: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for many small groups at once: ``ends`` is where each row's group ends."""
        d = 1
        while len(rows := rows[ends[rows] > rows + d]):
            step = max(1, _CELLS // self.long)
            for lo in range(0, len(rows), step):
                i = rows[lo:lo + step]
                hit, prefix = self.near(i, i + d)
                yield i[hit], i[hit] + d, prefix[hit]
            d += 1


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, each of one (long, part), from batches sorted by group."""
    names = ["long", "part", "key", "lo", "hi"]
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        ids = np.stack([rest[c].to_numpy() for c in names])
        new = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
        if len(new):
            yield from _same_kind(rest.slice(0, int(new[-1])))
            rest = rest.slice(int(new[-1]))
    if rest is not None and rest.num_rows:
        yield from _same_kind(rest)


def _same_kind(t: pa.Table) -> Iterator[pa.Table]:
    kind = np.stack([t["long"].to_numpy(), t["part"].to_numpy()])
    cuts = [0, *(np.flatnonzero((kind[:, 1:] != kind[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield t.slice(lo, hi - lo)


def _near_pairs(t: pa.Table, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    long, part = t["long"][0].as_py(), t["part"][0].as_py()
    m = Matrix(t["word"].to_pylist(), long)
    own, lo, hi = (t[c].to_numpy() for c in ("own", "lo", "hi"))
    ids = np.stack([t["key"].to_numpy(), lo, hi])
    starts = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1])
    ends = np.append(starts[1:], t.num_rows)
    small = (ends - starts <= 32) & (lo[starts] == hi[starts])
    end = np.repeat(ends, ends - starts)

    def found():
        yield from m.diagonals(end, np.flatnonzero(np.repeat(small, ends - starts)))
        for k in np.flatnonzero(~small).tolist():
            rows = np.arange(starts[k], ends[k])
            if lo[starts[k]] == hi[starts[k]]:
                yield from m.tile(rows)
            else:
                yield from m.tile(rows[own[rows] == lo[rows]], rows[own[rows] != lo[rows]])

    first, last = part * long // parts, (part + 1) * long // parts
    for i, j, prefix in found():
        mine = (prefix >= first) & (prefix < last)
        yield i[mine], j[mine]


def near_counts(tiles: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, n_near, best): near words of each word in each tile, and the best of them as
    (minus its n, word)."""
    def run(batches):
        for t in _groups(batches):
            pairs = list(_near_pairs(t, parts))
            i = np.concatenate([np.concatenate([x, y]) for x, y in pairs] or [np.zeros(0, np.int64)])
            if not len(i):
                continue
            j = np.concatenate([np.concatenate([y, x]) for x, y in pairs])
            n = t["n"].to_numpy()
            place = np.argsort(np.array(t["word"].to_pylist(), object), kind="stable").argsort()
            order = np.lexsort((place[j], -n[j], i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            words = t["word"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(i[first])), pa.array(np.diff(np.append(first, len(i)))),
                 pa.array(-n[j[first]]), words.take(pa.array(j[first]))],
                ["word", "near", "minus", "other"])

    return tiles.mapInArrow(run, "word string, near long, minus long, other string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form, form not null): the end of each word's chain."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = materialize(spread_join(now, step, ["root"]).select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if ahead.where("moved").isEmpty():
            return ahead.select("word", "root")
        now = ahead.select("word", "root")


def variants(docs: DataFrame, least: int = 5, often: int = 3, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word of at least ``least`` code points
    and ``often`` occurrences.

    ``docs`` needs doc_id and text; other columns are ignored. A null text has no words, a null
    doc_id counts as empty text in the checksum, and repeated rows count as often as they stand. Ties of
    the best form go to the smallest word in code-point order. An empty table gives no rows."""
    words = materialize(count_words(docs, least).groupBy("word").agg(F.sum("n").alias("n"))
                        .where(F.col("n") >= often), "words")
    tiles = (tiled(keyed(words, parts), block).repartition("key", "lo", "hi")
             .sortWithinPartitions("long", "part", "key", "lo", "hi"))
    near = (near_counts(tiles, parts).groupBy("word")
            .agg(F.sum("near").alias("n_near"), F.min(F.struct("minus", "other")).alias("best")))
    known = materialize(
        words.join(near, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                F.when(-F.col("best.minus") >= 2 * F.col("n"), F.col("best")).alias("best"))
        .select("word", F.col("best.other").alias("form"), "n", "n_near", (-F.col("best.minus")).alias("form_n")),
        "variants")
    ends = roots(known.where("form is not null"))
    return (known.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
