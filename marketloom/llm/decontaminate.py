"""Benchmark decontamination by latent semantic retrieval.

1. Every whole document is encoded once as ids of benchmark words (0: any other word), stored as
   two or four bytes a word. Document frequencies are counted over all of it.
2. The latent space is the right singular space of TF-IDF passages: all benchmark items and all
   passages of all documents, cut every 32 words. One pass over them sums the products of the words that
   meet in a passage; randomised power iteration then reads these sums, in blocks of words, and the
   driver gets one (vocabulary x rank) matrix a round.
3. Every window of 32 words, one every 16, is a passage. An item of n words whose order share asks for m
   of them in order can only stand around a window that has, of any n - m + j of its words, at
   least j. So postings of the rarest n - m + 4 words choose the (passage, item) pairs, exactly; all others
   would fail step 4. Those pairs are compared by cosine in the latent space.
   Word-for-word copies are candidates at any cosine: the first words of each item are looked up at
   every place.
4. Each candidate is decided by the longest common subsequence of the item and the words around
   the window, over the whole item and over its answer (a column ``answer``, or the last third of
   the item), so reworded copies that keep most words in order are found. Items under five words
   count only as exact word sequences.

A benchmark above ``PART_CHARS`` characters is searched in parts one after the other, each with a
latent space of its own, so what a task holds does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import join_narrow, slices
from marketloom.session import materialize

PART_CHARS = 1_000_000  # benchmark characters searched at once
CHUNK_WORDS = 125_000   # document words a task searches at once
LEAD = 4
PAIRS = 1 << 22         # pairs of words summed at once by a task
BLOCK_PAIRS = 1 << 19   # pairs of words whose sums travel together
FIT_TASKS = 64          # most tasks of the pass that sums pairs: each hands on every pair it met
PUNCTUATION = bytes.maketrans(b".,;:!?\"'()[]{}<>|*#$%&_=/\\-", b" " * 27)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(PUNCTUATION).split()


def places(item: np.ndarray) -> dict[int, int]:
    """The places of each word of an item, one bit of an integer per word."""
    at: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    return at


def lcs(item: np.ndarray, words: np.ndarray, at: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence; ``at`` are the item's ``places``."""
    at = places(item) if at is None else at
    full = (1 << len(item)) - 1
    v = full
    for w in words.tolist():
        m = at.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


@dataclass
class Items:
    """Benchmark items as word ids; id 0 is no benchmark word."""

    item_ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: dict[bytes, int]
    least: int = 5  # shorter items count only word for word
    window: int = 32
    idf: np.ndarray = field(default=None)
    basis: np.ndarray = field(default=None)  # vocabulary x rank
    latent: np.ndarray = field(default=None)  # items x rank, unit rows

    @property
    def kind(self) -> type:
        return np.uint16 if len(self.vocabulary) < 65_535 else np.uint32


def parts_of(benchmark: DataFrame, part_chars: int = PART_CHARS) -> list[DataFrame]:
    """The benchmark in parts of about ``part_chars`` characters, by hash."""
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-size // part_chars)
    if n < 2:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def read_items(benchmark: DataFrame, least: int = 5) -> Items:
    """Items with a word; null texts have none. Those under ``least`` words count only word for word.
    The rows are one part of the benchmark, which a task holds."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select("item_id", "text", answer.alias("answer")).where(
        "text is not null and item_id is not null").distinct().collect()
    vocabulary: dict[bytes, int] = {}
    ids, words, answers = [], [], []
    for item, text, reply in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")):
        coded = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in tokens(text)], np.int64)
        if not len(coded):
            continue
        tail = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in tokens(reply)], np.int64)
        ids.append(item), words.append(coded)
        answers.append(tail if len(tail) else coded[-max(2, len(coded) // 3):])
    return Items(ids, words, answers, vocabulary, least)


def encode(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, words binary) of every row with a doc_id; null text gives no words."""
    def run(batches: Iterator[pa.RecordBatch]):
        known, kind = items.vocabulary.get, items.kind
        for part in slices(batches, 512):
            coded = [np.array([known(w, 0) for w in tokens(t)], kind).tobytes()
                     for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(coded, pa.binary())],
                                             ["doc_id", "words"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, words binary")


def _arrays(batches, kind):
    for b in slices(batches, 1024):
        for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield i, np.frombuffer(w, kind)


def document_frequency(coded: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Documents holding each benchmark word, and all documents."""
    def run(batches):
        n, docs = np.zeros(len(items.vocabulary) + 1, np.int64), 0
        for _, w in _arrays(batches, items.kind):
            n[np.unique(w)] += 1
            docs += 1
        n[0] = docs
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["word", "n"])

    rows = coded.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(items.vocabulary) + 1, np.int64)
    n[rows["word"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return n, int(n[0])


def meetings(words: np.ndarray, doc: np.ndarray, idf: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of a pair of words, product of their shares), for all pairs of words in a passage, each once.

    ``doc`` numbers the document of each word, ascending; a passage is a run of ``width`` words of one
    document, and shares are its TF-IDF values at length one. The pair of words a <= b has place b * (b + 1) / 2 + a.
    At most (``width`` + 1) / 2 times the words."""
    size = len(idf)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    known = np.flatnonzero(words)
    passage = np.cumsum(place % width == 0)[known]
    key, times = np.unique(passage * size + words[known], return_counts=True)
    passage, word = np.divmod(key, size)
    share = times * idf[word]
    start = np.flatnonzero(np.diff(passage, prepend=-1))
    n = np.diff(np.append(start, len(passage)))
    share /= np.repeat(np.sqrt(np.add.reduceat(share * share, start)) if len(start) else start, n)
    at = np.arange(len(word))
    each = np.repeat(start + n, n) - at  # the words from each on, itself included
    right = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - at, each)
    return (word * (word + 1) // 2)[right] + np.repeat(word, each), share[right] * np.repeat(share, each)


def sums(batches: Iterator[pa.RecordBatch], kind: type, idf: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """(a, b, v) with a <= b: the sums of ``meetings`` over the passages of a task's documents.

    Holds a sum for every pair of words if these are few; else the pairs met, at most ``PAIRS``, then hands them on."""
    size = len(idf)
    low = np.arange(size + 1) * np.arange(1, size + 2) // 2  # the place of each word's first pair
    dense = int(low[-1]) <= 2 * PAIRS
    total = np.zeros(low[-1] if dense else 0)

    def out(keys, values):
        for i in range(0, len(keys), 100_000):
            key = keys[i:i + 100_000]
            b = np.searchsorted(low, key, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(key - low[b]), pa.array(b), pa.array(values[i:i + 100_000])],
                                             ["a", "b", "v"])

    def merged(parts):
        keys, values = (np.concatenate(x) for x in zip(*parts))
        parts.clear()  # their room is needed for the order
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[new], np.add.reduceat(values, new) if len(new) else values

    parts, held = [], 0
    for words, doc in _chunks(batches, kind, max(1, PAIRS // width // 32 // width) * width):
        pair = meetings(words, doc, idf, width)
        if dense:
            np.add.at(total, *pair)
            continue
        parts.append(merged([pair]))
        held += len(parts[-1][0])
        if held > PAIRS:
            parts = [merged(parts)]
            held = len(parts[0][0])
            if held > PAIRS // 2:
                yield from out(*parts.pop())
                held = 0
    for i in range(0, len(total), 1 << 18):  # not all at once, as keys and values would take twice the room of the sums
        keys = i + np.flatnonzero(total[i:i + (1 << 18)])
        yield from out(keys, total[keys])
    if parts:
        yield from out(*merged(parts))


def products(coded: DataFrame, items: Items) -> DataFrame:
    """(a, b, v): the ``sums`` over all passages of the documents and the items, both ways round."""
    kind, idf, width = items.kind, items.idf, items.window

    def run(batches):
        return sums(batches, kind, idf, width)

    # from Arrow: of a list of rows, executors would read the items by a second set of Python workers
    own = coded.sparkSession.createDataFrame(pa.table(
        {"doc_id": [0] * len(items.words), "words": [w.astype(kind).tobytes() for w in items.words]}))
    met = [x.select("doc_id", "words").mapInArrow(run, "a long, b long, v double")
           for x in (own.coalesce(1), coded.coalesce(FIT_TASKS))]
    once = met[0].unionByName(met[1]).groupBy("a", "b").agg(F.sum("v").alias("v"))
    pair, turned = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = F.when(F.col("a") == F.col("b"), F.array(pair)).otherwise(F.array(pair, turned))
    return once.select(F.explode(both).alias("pair"), "v").select("pair.a", "pair.b", "v")


def _chunks(batches, kind, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, number of their document) of about ``most`` words; a longer document is cut every ``most``."""
    def joined(rows):
        return np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), [len(x) for x in rows])

    rows, held = [], 0
    for _, w in _arrays(batches, kind):
        while len(w) > most:
            yield joined([w[:most]])
            w = w[most:]
        if len(w):
            rows.append(w)
            held += len(w)
        if held >= most:
            yield joined(rows)
            rows, held = [], 0
    if rows:
        yield joined(rows)


def fit(items: Items, coded: DataFrame, rank: int = 128, passes: int = 3, seed: int = 3) -> Items:
    """Set idf, basis and latent vectors, from all passages of all documents and items."""
    n, docs = document_frequency(coded, items)
    idf = np.log((1.0 + docs) / (1.0 + n)) + 1.0
    idf[0] = idf[1:].max()
    items.idf = idf
    size = len(idf)
    rank = min(rank, size - 1, max(1, len(items.words)))
    block = max(1, BLOCK_PAIRS // size)  # words whose sums travel together

    def pack(met: pa.Table) -> pa.Table:
        a, b, v = (met.column(c).to_numpy() for c in ("a", "b", "v"))
        return pa.table({"at": [int(a[0]) // block * block], "pairs": [(a % block * size + b).tobytes()],
                         "v": [v.tobytes()]})

    blocks = materialize(products(coded, items).groupBy(F.floor(F.col("a") / block)).applyInArrow(
        pack, "at long, pairs binary, v binary"), "passages")
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0]
    for _ in range(passes):
        def multiply(batches, q=q):
            for b in slices(batches, 1):
                for at, pairs, v in zip(*(c.to_pylist() for c in b.columns)):
                    some = np.zeros((min(block, size - at), size))
                    some.reshape(-1)[np.frombuffer(pairs, np.int64)] = np.frombuffer(v, np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([(some @ q).tobytes()], pa.binary())], ["at", "part"])

        total = np.zeros((size, rank))
        for at, part in blocks.mapInArrow(multiply, "at long, part binary").collect():
            total[at:at + block] = np.frombuffer(part, np.float64).reshape(-1, rank)
        q = np.linalg.qr(total + 1e-12 * q)[0]
    q[0] = 0
    items.basis = (q * idf[:, None]).astype(np.float32)
    latent = np.stack([items.basis[w].sum(axis=0) for w in items.words])
    items.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return items


class Copies:
    """Places of word-for-word copies: the first words of every item are hashed and looked up."""

    def __init__(self, items: Items) -> None:
        self.whole: dict[bytes, list[int]] = {}
        lengths: dict[tuple[int, int], set[int]] = {}
        for k, w in enumerate(items.words):
            w = w.astype(np.int64)
            self.whole.setdefault(w.tobytes(), []).append(k)
            g = min(len(w), items.least)
            lengths.setdefault((g, int(self.grams(w[:g], g)[0])), set()).add(len(w))
        self.heads = {g: np.array(sorted(h for n, h in lengths if n == g), np.uint64)
                      for g in sorted({n for n, _ in lengths})}
        self.lengths = lengths

    @staticmethod
    def grams(w: np.ndarray, g: int) -> np.ndarray:
        """A hash of the ``g`` words from each place on."""
        x, n = w.astype(np.uint64), len(w) - g + 1
        h = x[:n].copy()
        for i in range(1, g):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[i:i + n]
        return h

    def find(self, w: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, item) of each copy."""
        w = w.astype(np.int64)
        run = np.concatenate([[0], np.cumsum(w > 0)])
        for g, heads in self.heads.items():
            if len(w) < g:
                continue
            full = np.flatnonzero(run[g:] - run[:-g] == g)
            if not len(full):
                continue
            h = self.grams(w, g)[full]
            at = np.minimum(np.searchsorted(heads, h), len(heads) - 1)
            for i in np.flatnonzero(heads[at] == h).tolist():
                place = int(full[i])
                for n in self.lengths[g, int(h[i])]:
                    for k in self.whole.get(w[place:place + n].tobytes(), ()):
                        yield place, k


class Postings:
    """Rare words of the items, to find the places where an item may stand.

    Of an item's n words a passage needs ``needed`` in order. The rarest ones, counted with
    repeats, are taken until there are n - needed + ``LEAD``; then ``least`` of them are needed."""

    def __init__(self, items: Items, needed: np.ndarray) -> None:
        heads: dict[int, list[tuple[int, int]]] = {}
        self.least = np.ones(len(items.words), np.int64)
        self.reach = np.array([items.window + 2 * len(w) for w in items.words])  # words around a window
        for k, w in enumerate(items.words):
            if len(w) < items.least:
                continue
            found, times = np.unique(w, return_counts=True)
            rare = np.argsort(-items.idf[found], kind="stable")
            upto = min(len(rare) - 1, int(np.searchsorted(np.cumsum(times[rare]), len(w) - needed[k] + LEAD)))
            taken = rare[:upto + 1]
            self.least[k] = max(1, needed[k] - (len(w) - times[taken].sum()))
            for i in taken.tolist():
                heads.setdefault(int(found[i]), []).append((k, int(times[i])))
        self.count = np.zeros(len(items.vocabulary) + 1, np.int64)
        for w, rows in heads.items():
            self.count[w] = len(rows)
        self.first = np.cumsum(self.count) - self.count
        flat = np.array([r for w in sorted(heads) for r in heads[w]], np.int64).reshape(-1, 2)
        self.item, self.times = flat[:, 0], flat[:, 1]

    def stretches(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, b): the passage around a window may hold the item if it begins in
        [b * reach, (b + 1) * reach); it then ends before (b + 2) * reach."""
        place = np.flatnonzero(self.count[words])
        word = words[place].astype(np.int64)
        n = self.count[word]
        at = np.repeat(self.first[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, times = self.item[at], self.times[at]
        block = np.repeat(place, n) // self.reach[item]
        key = np.stack([np.tile(item, 2), np.concatenate([block, block - 1]), np.tile(np.repeat(word, n), 2),
                        np.tile(times, 2)])
        key = key[:, np.lexsort(key[2::-1])]
        new = np.flatnonzero((np.diff(key[:3], prepend=-2) != 0).any(axis=0))
        if not len(new):
            return new, new
        counted = np.minimum(np.diff(np.append(new, key.shape[1])), key[3, new])
        item, block = key[0, new], key[1, new]
        start = np.flatnonzero((np.diff(np.stack([item, block]), prepend=-2) != 0).any(axis=0))
        fine = np.add.reduceat(counted, start) >= self.least[item[start]]
        return item[start][fine], block[start][fine]


class Chunk:
    """The words of several documents in one array, far enough apart that no passage meets two."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], window: int, gap: int) -> None:
        self.docs = [doc for doc, _ in rows]
        sizes = np.array([len(w) for _, w in rows])
        self.start = gap + np.cumsum(sizes + gap) - sizes - gap
        self.words = np.zeros(int((sizes + gap).sum()) + gap, np.int64)
        for at, (_, w) in zip(self.start.tolist(), rows):
            self.words[at:at + len(w)] = w
        step = window // 2
        n = np.maximum(1, -(-(sizes - step) // step))
        first = np.repeat(np.cumsum(n) - n, n)
        self.windows = np.repeat(self.start, n) + (np.arange(n.sum()) - first) * step

    def doc_at(self, place: int) -> int:
        return int(np.searchsorted(self.start, place, "right")) - 1


def search(coded: DataFrame, items: Items, cosine: float = 0.3, order: float = 0.6,
           answer: float = 0.4) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, first_word): the best window of each hit."""
    sizes = np.array([len(x) for x in items.words])
    needed = np.ceil(order * sizes - 1e-9).astype(np.int64)
    where = [places(x) for x in items.words]
    width, gap = items.window, int(sizes.max()) + 2 * items.window

    def hits(chunk: Chunk, postings: Postings, copies: Copies) -> dict[tuple[int, int], tuple]:
        best: dict[tuple[int, int], tuple] = {}
        latent: dict[int, np.ndarray] = {}

        def near(start: int, k: int) -> float:
            if start not in latent:
                x = items.basis[chunk.words[start:start + width]].sum(axis=0)
                latent[start] = x / max(np.linalg.norm(x), 1e-9)
            return float(latent[start] @ items.latent[k])

        def judge(start: int, k: int, cos: float) -> None:
            item, reply = items.words[k], items.answers[k]
            around = chunk.words[start - len(item):start + width + len(item)]
            a = lcs(item, around, where[k]) / len(item)
            if a < order:
                return
            r = lcs(reply, around) / len(reply)
            doc = chunk.doc_at(start)
            found = a, r, cos, int(chunk.start[doc]) - start
            if r >= answer and found > best.get((doc, k), (0, 0, -2)):
                best[doc, k] = found

        for k, b in zip(*(x.tolist() for x in postings.stretches(chunk.words))):
            n, reach = int(sizes[k]), int(postings.reach[k])
            here = set(chunk.words[max(0, b * reach):(b + 2) * reach].tolist())
            if sum(bits.bit_count() for w, bits in where[k].items() if w in here) < needed[k]:
                continue
            lo, hi = np.searchsorted(chunk.windows, [b * reach + n, (b + 1) * reach + n])
            for start in chunk.windows[lo:hi].tolist():
                if (cos := near(start, k)) >= cosine:
                    judge(start, k, cos)
        for place, k in copies.find(chunk.words):
            judge(place, k, near(place, k))
        return best

    def run(batches):
        postings, copies = Postings(items, needed), Copies(items)

        def out(rows):
            chunk = Chunk(rows, width, gap)
            found = [(chunk.docs[doc], items.item_ids[k], cos, a, r, -first)
                     for (doc, k), (a, r, cos, first) in hits(chunk, postings, copies).items()]
            return pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in found], t) for i, t in enumerate(
                    [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()])],
                ["doc_id", "item_id", "cosine", "lcs", "answer", "first_word"])

        rows, held = [], 0
        for doc, w in _arrays(batches, items.kind):
            if len(w):
                rows.append((doc, w))
                held += len(w) + gap
            if held > CHUNK_WORDS:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)

    return coded.mapInArrow(run, "doc_id long, item_id long, cosine double, lcs double, answer double, "
                                 "first_word long").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, first_word), a row for each document and item found.

    Null and empty texts hold nothing; rows without doc_id are not reported; rows repeating a
    doc_id are reported once per different finding; an empty benchmark finds nothing.
    """
    found = []
    for part in parts_of(benchmark):
        items = read_items(part)
        if items.words:
            coded = materialize(encode(docs, items), "coded")
            found.append(search(coded, fit(items, coded), **limits))
    if not found:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long")
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The documents in which no benchmark item was found; columns stay as they are."""
    found = materialize(contaminated(docs, benchmark, **limits).select("doc_id").distinct(), "leaks")
    return join_narrow(docs, found, ["doc_id"], "left_anti").select(docs.columns)
