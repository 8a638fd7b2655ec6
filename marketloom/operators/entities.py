"""Entity mentions, the sentences around them, and per-entity sentiment."""

from __future__ import annotations

import ctypes
import mmap
import uuid
from collections.abc import Iterator, Sequence
from functools import partial, reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.chunking import fixed_chunks
from marketloom.functions.expressions import strip, ticker_text
from marketloom.functions.lexicon import LexiconScorer, Scorer, mentions_finance, sentences, words
from marketloom.operators.linking import link_vectors
from marketloom.operators.phrases import PhraseAutomaton
from marketloom.operators.skew import join_dimension, spread_join
from marketloom.session import materialize

# fixed values: labels of mentions that are kept
ENTITY_LABELS = ["ORG", "MONEY", "PERSON", "GPE", "PRODUCT"]
# learned vectors: neighbours on each side, words a step and a product, chance words a step and how many count for a
# pair, rate; words and texts of a pack, words and different ones of a copy; bytes of vectors averaged at once, of
# those every task holds
WINDOW, STEP_WORDS, TILE, NOISE, NEGATIVES, RATE = 5, 512, 32, 64, 5, 0.1
PACK_WORDS, PACK_ROWS, COPY_WORDS, COPY_DIFFERENT = 1 << 19, 4_096, 6 << 20, 3 << 19
MEAN_BYTES, HEAD_BYTES = 8 << 20, 32 << 20


def document_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, sentence): one row per stripped, non-blank sentence in document order."""
    return (docs.select("doc_id", F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
            .withColumn("sentence", strip(F.col("sentence"))).where(F.col("sentence") != ""))


def finance_sentences(docs: DataFrame, text: str = "text",
                      keywords: Sequence[str] | None = None) -> DataFrame:
    """Sentences containing a finance keyword."""
    rows = document_sentences(docs, text)
    return rows.where(mentions_finance(F.col("sentence"), *([keywords] if keywords else [])))


def gazetteer_mentions(docs: DataFrame, gazetteer: DataFrame, text: str = "text",
                       part_chars: int = 32 << 20) -> DataFrame:
    """Mentions of the phrases in ``gazetteer`` (entity, label), matched on lower-case words.

    Returns (doc_id, pos, word, entity, label, sentence), every label and spelling of a phrase in
    a row of its own; overlapping and nested phrases are all found. One pass over the sentences runs
    all phrases as an automaton, and only matches get their sentence. A gazetteer above
    ``part_chars`` characters is dealt by first words to several passes. A trained recogniser can
    replace this operator: the others only need its output columns.
    """
    found = _found(docs, gazetteer, text, part_chars)
    return (reduce(DataFrame.unionByName, found).withColumn("sentence", strip(F.col("sentence")))
            .select("doc_id", "pos", "word", "entity", "label", "sentence"))


def mentioned_documents(docs: DataFrame, gazetteer: DataFrame, text: str = "text",
                        part_chars: int = 32 << 20) -> DataFrame:
    """The mentions of ``gazetteer_mentions`` with each sentence held once: (doc_id, alone, sentences, found), a row
    for each document (and pass); ``found`` has (entity, label, at), ``at`` the (pos, word) of its mentions
    in order. ``alone`` tells that no other row has this doc_id. The operators below take it in place of mentions."""
    many = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("_many"))
    own = join_dimension(docs.select("doc_id", F.col(text).alias("_t")), many, ["doc_id"], "left")
    return reduce(DataFrame.unionByName, _found(own.select(
        "doc_id", "_t", (F.col("doc_id").isNotNull() & F.col("_many").isNull()).alias("alone")), gazetteer, "_t", part_chars))


def _found(docs: DataFrame, gazetteer: DataFrame, text: str, part_chars: int) -> list[DataFrame]:
    phrases = (gazetteer.select("entity", "label", words(F.col("entity")).alias("_w"))
               .where(F.size("_w") > 0).distinct())
    size = phrases.agg(F.coalesce(F.sum(F.length("entity") + 32), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_chars))
    first = F.pmod(F.xxhash64(F.col("_w")[0]), F.lit(parts))
    nested = ["alone"] if "alone" in docs.columns else []
    tokens = (docs.select("doc_id", sentences(F.col(text)).alias("_s"), *nested).where("_s is not null")
              .select("doc_id", "_s", F.transform("_s", words).alias("_w"), *nested))
    if nested:
        tokens = tokens.withColumn("_s", F.transform("_s", strip))
    return [_matches(tokens, phrases.where(first == i) if parts > 1 else phrases) for i in range(parts)]


def _matches(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    rows = phrases.collect()  # bounded by part_chars
    named: dict[tuple[str, ...], list[int]] = {}
    for i, r in enumerate(rows):
        named.setdefault(tuple(r["_w"]), []).append(i)
    known = tokens.sparkSession.sparkContext.broadcast((
        PhraseAutomaton(list(named)), list(named.values()), [r["entity"] for r in rows], [r["label"] for r in rows]))
    kind, nested = dict(tokens.dtypes)["doc_id"], "alone" in tokens.columns

    def grouped(docs: int, doc, row, pos, word, entity: pa.Array, label: pa.Array) -> pa.Array:
        order = np.lexsort((word, pos, row, doc))
        doc, row, pos, word = doc[order], row[order], pos[order], word[order]
        new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        places = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(word, pa.int32())], ["pos", "word"])
        at = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)), pa.int32()), places)
        which = pa.array(row[new], pa.int64())
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[new], np.arange(docs + 1)), pa.int32()), pa.StructArray.from_arrays(
            [entity.take(which), label.take(which), at], ["entity", "label", "at"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names, entity, label = known.value
        entity, label = pa.array(entity, pa.string()), pa.array(label, pa.string())
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts, lists = part.column(1).flatten(), part.column(2).flatten()
                in_doc = part.column(1).value_lengths().to_numpy()
                doc = np.repeat(np.arange(part.num_rows), in_doc)
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(in_doc) - in_doc, in_doc)
                in_sentence = lists.value_lengths().to_numpy()
                sentence = np.repeat(np.arange(len(lists)), in_sentence)
                at, phrase = automaton.find(automaton.numbers(lists.flatten()), sentence)
                row = np.array([i for k in phrase.tolist() for i in names[k]], np.int64)
                at = np.repeat(at, [len(names[k]) for k in phrase.tolist()])
                s = sentence[at]
                word = at - (np.cumsum(in_sentence) - in_sentence)[s]
                if nested:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(3), part.column(1), grouped(part.num_rows, doc[s], row, pos[s], word, entity, label)],
                        ["doc_id", "alone", "sentences", "found"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc[s])), pa.array(pos[s], pa.int32()), pa.array(word, pa.int32()),
                     entity.take(pa.array(row)), label.take(pa.array(row)), texts.take(pa.array(s))],
                    ["doc_id", "pos", "word", "entity", "label", "sentence"])

    if nested:
        return tokens.mapInArrow(run, f"doc_id {kind}, alone boolean, sentences array<string>, found array<struct<"
                                      "entity string, label string, at array<struct<pos int, word int>>>>")
    return tokens.mapInArrow(run, f"doc_id {kind}, pos int, word int, entity string, label string, sentence string")


def mention_rows(found: DataFrame) -> DataFrame:
    """``mentioned_documents`` as the rows of ``gazetteer_mentions``."""
    return (found.select("doc_id", "sentences", F.explode("found").alias("_f"))
            .select("doc_id", "sentences", "_f.entity", "_f.label", F.explode("_f.at").alias("_a"))
            .select("doc_id", "_a.pos", "_a.word", "entity", "label",
                    F.element_at("sentences", F.col("_a.pos") + 1).alias("sentence")))


def _by_entity(found: Column) -> Column:
    """(entity, at) of each entity; the places of one with several labels are merged."""
    names = F.array_distinct(F.transform(found, lambda f: f["entity"]))
    merged = F.transform(names, lambda n: F.struct(n.alias("entity"), F.array_sort(F.flatten(F.transform(
        F.filter(found, lambda f: f["entity"] == n), lambda f: f["at"]))).alias("at")))
    plain = F.transform(found, lambda f: F.struct(f["entity"].alias("entity"), f["at"].alias("at")))
    return F.when(F.size(names) == F.size(found), plain).otherwise(merged)


def financial_mentions(mentions: DataFrame, labels: Sequence[str] = tuple(ENTITY_LABELS)) -> DataFrame:
    """Mentions with a label of interest."""
    if "found" in mentions.columns:
        return mentions.withColumn("found", F.filter("found", lambda f: f["label"].isin(list(labels))))
    return mentions.where(F.col("label").isin(list(labels)))


def org_entities(mentions: DataFrame) -> DataFrame:
    """Distinct organisation names per document."""
    return mentions.where(F.col("label") == "ORG").select("doc_id", "entity").distinct()


def entity_sentences(mentions: DataFrame) -> DataFrame:
    """Per document and entity, the sentences of its mentions in order (repeats kept).

    Of ``mentioned_documents`` only documents that share a doc_id are shuffled."""
    if "found" in mentions.columns:
        kept = materialize(mentions, "mentions")
        alone = kept.where("alone").select("doc_id", "sentences", F.explode(_by_entity(F.col("found"))).alias("_m"))
        made = alone.select("doc_id", "_m.entity", F.col("sentences").alias("_all"), F.col("_m.at").alias("_at")).select(
            "doc_id", "entity", F.transform("_at", lambda a: F.element_at(F.col("_all"), a["pos"] + 1)).alias("sentences"))
        return made.unionByName(entity_sentences(mention_rows(kept.where("not alone"))))
    at = F.struct("pos", "word", "sentence")
    ordered = F.array_sort(F.collect_list(at))
    return mentions.groupBy("doc_id", "entity").agg(
        F.transform(ordered, lambda m: m["sentence"]).alias("sentences"))


def scored_mentions(mentions: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Mentions with ``sentiment``; every distinct sentence is scored once.

    A sentence copied into very many documents is one hot key of the join back, which spreads it.
    """
    scored = (mentions.select("sentence").distinct()
              .withColumn("sentiment", (scorer or LexiconScorer())(F.col("sentence"))))
    return spread_join(mentions, scored, ["sentence"])


def entity_sentiment(mentions: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Sentiment of each entity of a document: that of the last sentence mentioning it.

    Of ``mentioned_documents`` each such sentence is scored in place, once for all its entities."""
    if "found" in mentions.columns:
        kept = materialize(mentions, "mentions")
        lasts = F.transform(_by_entity(F.col("found")), lambda m: F.struct(
            F.array_max(m["at"])["pos"].alias("pos"), m["entity"].alias("entity")))
        ends = kept.where("alone").select("doc_id", "sentences", lasts.alias("_l")).select(
            "doc_id", "sentences", "_l", F.explode(F.array_distinct(F.col("_l.pos"))).alias("_p")).select(
            "doc_id", F.element_at("sentences", F.col("_p") + 1).alias("_t"), F.transform(
                F.filter("_l", lambda x: x["pos"] == F.col("_p")), lambda x: x["entity"]).alias("_e"))
        made = ends.withColumn("_s", (scorer or LexiconScorer())(F.col("_t"))).select("doc_id", F.explode("_e").alias("entity"), "_s")
        return made.select("doc_id", "entity", "_s.label", "_s.score").unionByName(
            entity_sentiment(mention_rows(kept.where("not alone")), scorer))
    last = F.max_by("sentiment", F.struct("pos", "word"))
    return (scored_mentions(mentions, scorer).groupBy("doc_id", "entity").agg(last.alias("_s"))
            .select("doc_id", "entity", "_s.label", "_s.score"))


# ---------------------------------------------------------------- embeddings

GRID = float(1 << 20)   # components are multiples of 1 / GRID: sums of products are exact


def letter_grams(text: Column, n: int = 3) -> Column:
    """The runs of ``n`` characters of the lower-case text, which names share with longer texts."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(low, i, F.lit(n)))


def buckets(pieces: Column, dim: int) -> Column:
    """The bucket of each piece: 28 bits of its md5, modulo ``dim``."""
    return F.transform(pieces, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") % dim)


def embed_text(rows: DataFrame, text: str = "text", dim: int = 256, out: str = "embedding", pieces=words) -> DataFrame:
    """Unit-length hashed bag of ``pieces`` (words, or ``letter_grams`` for names): the bundled embedder, which a
    trained model such as ``word_vectors`` can replace. Null texts and texts without pieces give zeros."""
    @F.pandas_udf("array<double>")
    def unit(found: pd.Series) -> pd.Series:
        made = []
        for b in found:
            n = np.bincount(b, minlength=dim).astype(float) if b is not None and len(b) else np.zeros(dim)
            made.append(np.rint(GRID * n / max(1.0, np.sqrt((n * n).sum()))) / GRID)
        return pd.Series(made)

    return rows.withColumn(out, unit(buckets(pieces(F.col(text)), dim)))


class SkipGrams:
    """Word vectors by skip-grams with negative sampling: each word is to be told from chance words by its
    neighbours, at most ``WINDOW`` known words away. Steps are taken on ``STEP_WORDS`` words at once, with chance words in
    common and a rate for each word that falls with its squared gradients (Adagrad)."""

    def __init__(self, inner: np.ndarray, outer: np.ndarray, noise: np.ndarray, seed) -> None:
        self.inner, self.outer, self.chance = inner.copy(), outer.copy(), np.cumsum(noise / noise.sum())
        self.grown = np.ones(len(inner), np.float32), np.ones(len(inner), np.float32)
        self.random = np.random.default_rng(seed)
        self.met = np.zeros(len(inner), bool)
        self.far = np.abs(np.arange(TILE + 2 * WINDOW) - WINDOW - np.arange(TILE)[:, None]).astype(np.int32)
        self.far[self.far == 0] = WINDOW + 1

    def learn(self, ids: np.ndarray, doc: np.ndarray, other: np.ndarray | None = None) -> None:
        """One step on words and the ascending numbers of their documents. ``TILE`` words at a time meet the words
        around them in one product, in which only pairs within reach count. ``other``: the chance words, if drawn."""
        n = -(-len(ids) // TILE) * TILE
        word, text = np.zeros(n, np.int64), np.full(n + 2 * WINDOW, -2, np.int32)
        word[:len(ids)], text[WINDOW:WINDOW + len(ids)], text[WINDOW + len(ids):WINDOW + n] = ids, doc, -1
        x, y = self.inner[word], self.outer[word].reshape(-1, TILE, self.outer.shape[1])
        around = np.arange(0, n, TILE)[:, None] + np.arange(TILE + 2 * WINDOW)
        near = np.zeros((len(text), x.shape[1]), np.float32)
        near[WINDOW:WINDOW + n] = x
        near, ids = near[around], word
        mine, there = text[WINDOW:WINDOW + n].reshape(-1, TILE, 1), text[around][:, None, :]
        reach = self.random.integers(1, WINDOW + 1, mine.shape, np.int32) * (mine >= 0)
        pair = ((self.far <= reach) & (mine == there)).astype(np.float32)
        g = pair / (1 + np.exp(np.matmul(y, near.transpose(0, 2, 1))))
        dx = self._joined(np.matmul(g.transpose(0, 2, 1), y))
        dy = np.matmul(g, near).reshape(x.shape)
        times = self._joined(pair.sum(axis=1)[:, :, None])
        if other is None:
            other = np.minimum(np.searchsorted(self.chance, self.random.random(NOISE)), len(self.chance) - 1)
        z = self.outer[other]
        g = np.float32(NEGATIVES / NOISE) * times / (1 + np.exp(-(x @ z.T)))
        dx -= g @ z
        self._move(self.inner, self.grown[0], ids, dx)
        self._move(self.outer, self.grown[1], np.concatenate([ids, other]), np.concatenate([dy, -(g.T @ x)]))
        self.met[ids[:len(doc)]] = True

    @staticmethod
    def _joined(parts: np.ndarray) -> np.ndarray:
        """The sum of the rows that tiles hold for the same word."""
        tiles, _, dim = parts.shape
        total = np.zeros((tiles + 1, TILE, dim), np.float32)
        total[:-1] += parts[:, :TILE]
        total[1:, :2 * WINDOW] += parts[:, TILE:]
        return total.reshape(-1, dim)[WINDOW:WINDOW + tiles * TILE]

    @staticmethod
    def _move(vectors: np.ndarray, grown: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        word, d = ids[first], np.add.reduceat(d[order], first)
        grown[word] += (d * d).mean(axis=1)
        vectors[word] += RATE * d / np.sqrt(grown[word])[:, None]


class Copy(SkipGrams):
    """A ``SkipGrams`` that holds only the words one task meets or draws, by their ranks. Words start
    where their rank says, the same in every copy."""

    def __init__(self, dim: int, room: int, seed: int, turn: int, copy: int) -> None:
        """``room``: how many words there can be. Memory is touched only as far as there are."""
        super().__init__(np.zeros((0, dim), np.float32), np.zeros((0, dim), np.float32), np.ones(0), [seed, turn, copy])
        self.seed, self.ranks, self.rows = seed, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.inner, self.outer, *grown = (_untouched(room, x) for x in (dim, dim, 1, 1))
        self.grown, self.met = tuple(x[:, 0] for x in grown), np.zeros(room, bool)

    def places(self, ranks: np.ndarray, both: np.ndarray | None = None) -> np.ndarray:
        """The rows of ascending different ranks. Those that are new get one, with the vectors ``both`` if given."""
        at = np.searchsorted(self.ranks, ranks)
        new = np.append(self.ranks, -1)[at] != ranks
        if new.any():
            held, dim = len(self.ranks), self.inner.shape[1]
            total = held + int(new.sum())
            self.inner[held:total] = start_vectors(ranks[new], dim, self.seed) if both is None else both[new, :dim]
            self.outer[held:total] = 0 if both is None else both[new, dim:]
            self.met[held:total] = False
            for x in self.grown:
                x[held:total] = 1
            self.rows = np.insert(self.rows, at[new], np.arange(held, total))
            self.ranks = np.insert(self.ranks, at[new], ranks[new])
            at = np.searchsorted(self.ranks, ranks)
        return self.rows[at]

    def learn_pack(self, pack: "Pack", noise: np.ndarray) -> None:
        """All steps on a pack; ``noise`` has the ranks of the chance words of each."""
        drawn, other = np.unique(noise, return_inverse=True)
        place, other = self.places(pack.ranks), self.places(drawn)[other].reshape(noise.shape)
        doc = np.repeat(np.arange(len(pack.ends)), np.diff(pack.ends, prepend=0))
        for i, lo in enumerate(range(0, len(doc), STEP_WORDS)):
            self.learn(place[pack.at[lo:lo + STEP_WORDS]], doc[lo:lo + STEP_WORDS], other[i])

    def blocks(self, width: int, last: bool) -> Iterator[pa.RecordBatch]:
        """The vectors of the words met, ``width`` ranks to a row; after the last round only the inner ones count."""
        met = self.met[self.rows]
        ranks, rows = self.ranks[met], self.rows[met]
        ends = np.append(np.flatnonzero(np.diff(ranks // width)) + 1, len(ranks)) if len(ranks) else ranks
        starts = np.append(0, ends[:-1])
        for lo in range(0, len(ends), 256):
            some = slice(starts[lo], ends[min(lo + 256, len(ends)) - 1])
            edges = np.append(starts[lo], ends[lo:lo + 256]) - starts[lo]
            v = self.inner[rows[some]]
            v = v if last else np.hstack([v, self.outer[rows[some]]])
            yield pa.RecordBatch.from_arrays([pa.array(ranks[starts[lo:lo + 256]] // width), _cut(ranks[some], edges),
                                              _cut(v, edges)], ["block", "at", "v"])


def _untouched(rows: int, dim: int) -> np.ndarray:
    """A matrix whose memory is taken a small page at a time as rows are written, and given back with it. (NumPy asks for
    huge pages, which are slower to get here and hold more.)"""
    held = mmap.mmap(-1, max(1, 4 * rows * dim), mmap.MAP_PRIVATE | mmap.MAP_ANONYMOUS)
    if hasattr(mmap, "MADV_NOHUGEPAGE"):
        held.madvise(mmap.MADV_NOHUGEPAGE)
    return np.frombuffer(held, np.float32, rows * dim).reshape(rows, dim)


def start_vectors(ranks: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Even chance numbers from -1 / (2 dim) to 1 / (2 dim), set by rank, column and seed (splitmix64)."""
    z = (ranks.astype(np.uint64)[:, None] * np.uint64(dim) + np.arange(1, dim + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z += np.random.SeedSequence(seed).generate_state(1, np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2 ** 53 - 0.5).astype(np.float32) / np.float32(dim)


def _cut(x: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The rows of ``x`` between ``edges`` as bytes."""
    width = x[:1].nbytes if len(x) else 0
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)),
                                                               pa.py_buffer(np.ascontiguousarray(x))])


def _give_back() -> None:
    """Return freed memory to the system, before a worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _shut(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes each, packed."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return np.array([x.itemsize, len(x)]).tobytes() + (pa.compress(x.tobytes(), "zstd", asbytes=True) if len(x) else b"")


def _opened(x: bytes) -> np.ndarray:
    width, n = np.frombuffer(x, np.int64, 2).tolist()
    return np.frombuffer(pa.decompress(x[16:], n * width, "zstd", asbytes=True) if n else b"", f"u{width}").astype(np.int64)


class Pack:
    """A row of ``_coded``: the ranks of the different known words, the place of every one in these, the ends of the texts."""

    def __init__(self, ranks: bytes, at: bytes, ends: bytes) -> None:
        self.ranks, self.at, self.ends = np.cumsum(_opened(ranks)), _opened(at), _opened(ends)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts given as words and key, up to ``PACK_WORDS`` words together: each different word with its times, the place
    of every one in these, the ends of the texts, and their keys."""
    first = TaskContext.get().partitionId() << 33
    texts: list[tuple[pa.Array, pa.Array]] = []
    made = words_held = rows_held = 0

    def pack() -> Iterator[pa.RecordBatch]:
        nonlocal made, words_held, rows_held
        if words_held:
            coded = pa.chunked_array([x.flatten() for x, _ in texts]).combine_chunks().dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            size = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x, _ in texts])
            ends, n = np.cumsum(size.astype(np.int64)), len(coded.dictionary)
            edges, times = pa.array([0, n], pa.int32()), pa.array(np.bincount(at, minlength=n))
            yield pa.RecordBatch.from_arrays([
                pa.array([first + made]), pa.array([words_held]), pa.array([n]),
                pa.ListArray.from_arrays(edges, coded.dictionary.cast(pa.string())), pa.ListArray.from_arrays(edges, times),
                pa.array([_shut(at)]), pa.array([_shut(ends)]), pa.array([b"".join(k for _, x in texts for k in x.to_pylist())])],
                ["pack", "n", "different", "words", "times", "at", "ends", "keys"])
            made += 1
        texts.clear()
        words_held = rows_held = 0

    for b in batches:
        total = np.cumsum(pc.list_value_length(b.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            before = int(total[lo - 1]) if lo else 0
            hi = int(np.searchsorted(total, before + PACK_WORDS - words_held, "right"))
            hi = min(max(hi, lo + (not rows_held)), lo + PACK_ROWS - rows_held)
            if hi > lo:
                texts.append((b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)))
                words_held, rows_held, lo = words_held + int(total[hi - 1]) - before, rows_held + hi - lo, hi
            if lo < b.num_rows:
                yield from pack()
    yield from pack()
    _give_back()


_PACKS = ("pack long, n long, different long, words array<string>, times array<long>, at binary, ends binary, keys binary")


def _key(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("string")))


def _packed(rows: DataFrame, text: str) -> DataFrame:
    own = rows.where(F.col(text).isNotNull()).select(words(F.col(text)).alias("w"), _key(text).alias("k"))
    return materialize(own.mapInArrow(_packs, _PACKS), "words")


def _ranked(packed: DataFrame, least: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(w, rank) of the words met ``least`` times, the most frequent first, and (times, words met so often) in this order."""
    counts = (packed.select(F.explode(F.arrays_zip("words", "times")).alias("w")).groupBy(F.col("w.words").alias("w"))
              .agg(F.sum("w.times").alias("n")).where(F.col("n") >= least))
    listed = materialize(counts.orderBy(F.desc("n"), "w").withColumn("rank", F.monotonically_increasing_id()), "vocabulary")
    listed = listed.withColumn("part", F.shiftright("rank", 33))
    parts = sorted(listed.groupBy("part").count().collect())
    first = np.cumsum([0] + [n for _, n in parts]).tolist()
    table = F.broadcast(packed.sparkSession.createDataFrame(
        [(r["part"], before) for r, before in zip(parts, first)], "part long, before long"))
    often = sorted(((r["n"], r["count"]) for r in listed.groupBy("n").count().collect()), reverse=True)
    return listed.join(table, "part").select("w", (F.col("rank").bitwiseAND((1 << 33) - 1) + F.col("before")).alias("rank")), often


def _coded(packed: DataFrame, ranked: DataFrame) -> DataFrame:
    """The packs with ranks for words; unknown words are left out."""
    own = (packed.select(F.col("pack").alias("of"), F.posexplode("words").alias("at", "w")).join(ranked, "w")
           .select("of", "at", "rank"))

    def code(pack: pa.Table, known: pa.Table) -> pa.Table:
        row = pack.to_pylist()[0]
        rank = np.full(row["different"], -1, np.int64)
        rank[known["at"].to_numpy()] = known["rank"].to_numpy()
        rank = rank[_opened(row["at"])]
        ends = np.append(0, np.cumsum(rank >= 0))[_opened(row["ends"])]
        ranks, at = np.unique(rank[rank >= 0], return_inverse=True)
        _give_back()
        return pa.table({"pack": [row["pack"]], "n": [len(at)], "ranks": [_shut(np.diff(ranks, prepend=0))], "at": [_shut(at)],
                         "ends": [_shut(ends)], "keys": [row["keys"]]})

    return materialize(packed.select("pack", "different", "at", "ends", "keys").groupBy("pack").cogroup(own.groupBy("of"))
                       .applyInArrow(code, "pack long, n long, ranks binary, at binary, ends binary, keys binary"), "coded")


class Noise:
    """Chance words for each step on a pack: ranks, by times to the power of 0.75. Words met equally often follow each
    other, so what is held is one row for each number of times."""

    def __init__(self, often: list[tuple[int, int]], seed: int) -> None:
        times, self.words = np.array(often, np.int64).reshape(-1, 2).T
        self.each, self.first, self.seed = times ** 0.75, np.cumsum(self.words) - self.words, seed
        self.ends = np.cumsum(self.each * self.words)

    def draw(self, words: int, turn: int, pack: int) -> np.ndarray:
        steps = -(-words // STEP_WORDS)
        if not steps:
            return np.zeros((0, NOISE), np.int64)
        x = np.random.default_rng([self.seed, turn, pack]).random((steps, NOISE)) * self.ends[-1]
        at = np.minimum(np.searchsorted(self.ends, x, "right"), len(self.ends) - 1)
        before = self.ends[at] - self.each[at] * self.words[at]
        return self.first[at] + np.clip(((x - before) / self.each[at]).astype(np.int64), 0, self.words[at] - 1)


def _spread(spark, n: int) -> list[int]:
    """``n`` numbers that ``repartition(n, ...)`` deals to one task each."""
    ids = spark.range(n * (n.bit_length() + 10))
    found = ids.groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id")).collect()
    taken = [r[1] for r in found]
    return taken + [-i for i in range(1, n - len(taken) + 1)]


def _learned(coded: DataFrame, copies: DataFrame, n_copies: int, room: int, noise: Noise, dim: int, seed: int, rounds: int) -> DataFrame:
    """(rank, v): the vectors of all words, averaged over the copies that met them. A copy learns from some packs, one after
    the other, and holds only the words it meets or draws."""
    packs = coded.drop("keys").join(copies, "pack")
    stream = packs.select("copy", "pack", "n", "ranks", "at", "ends").withColumns(
        {"rank": F.lit(None).cast("long"), "v": F.lit(None).cast("binary")})
    learned = None
    for turn in range(rounds):
        last = turn == rounds - 1
        width = dim if last else 2 * dim
        block = max(32, min(1_024, MEAN_BYTES // (4 * width * n_copies)))

        def train(batches):
            model, copy = None, None
            for b in batches:
                for (now, sent), rows in groupby(b.to_pylist(), lambda x: (x["copy"], x["v"] is not None)):
                    if now != copy:
                        if model:
                            yield from model.blocks(block, last)
                        model, copy = Copy(dim, room, seed, turn, now), now
                    if sent:
                        rows = sorted(rows, key=itemgetter("rank"))
                        model.places(np.array([x["rank"] for x in rows]),
                                     np.frombuffer(b"".join(x["v"] for x in rows), np.float32).reshape(-1, 2 * dim))
                    else:
                        for x in rows:
                            model.learn_pack(Pack(x["ranks"], x["at"], x["ends"]), noise.draw(x["n"], turn, x["pack"]))
            if model:
                yield from model.blocks(block, last)
            model = None
            _give_back()

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            total, n = np.zeros((block, width)), np.zeros(block)
            for at, v in zip(pdf["at"], pdf["v"]):
                at = np.frombuffer(at, np.int64) % block
                total[at] += np.frombuffer(v, np.float32).reshape(-1, width)
                n[at] += 1
            at = np.flatnonzero(n)
            v = (total[at] / n[at, None]).astype(np.float32)
            return pd.DataFrame({"rank": at + pdf["block"].iloc[0] * block, "v": [x.tobytes() for x in v]})

        def asked(batches):
            for row in (x for b in batches for x in b.to_pylist()):
                drawn = noise.draw(row["n"], turn, row["pack"])
                ranks = np.union1d(np.cumsum(_opened(row["ranks"])), drawn)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranks), row["copy"])), pa.array(ranks)], ["copy", "rank"])

        whole = stream
        if turn:  # what a copy needs of the round before comes first
            needed = packs.select("copy", "pack", "n", "ranks").mapInArrow(asked, "copy long, rank long").distinct().join(learned, "rank")
            whole = stream.unionByName(needed.withColumn("pack", F.lit(-1).cast("long")), allowMissingColumns=True)
        met = (whole.repartition(n_copies, "copy").sortWithinPartitions("copy", "pack")
               .mapInArrow(train, "block long, at binary, v binary"))
        learned = materialize(met.groupBy("block").applyInPandas(mean, "rank long, v binary"), "vectors")
    return learned


def _pooled(coded: DataFrame, learned: DataFrame, head: np.ndarray, whole: bool) -> DataFrame:
    """(k, v): the unit vectors of the texts that have a known word. Vectors of the first ranks are ``head``; of the
    others, unless it is ``whole``, each pack gets those it needs."""
    dim = head.shape[1]

    def pool(row: dict, table: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        ends, key = _opened(row["ends"]), np.frombuffer(row["keys"], "V16")
        made = np.array([table[x].sum(axis=0, dtype=float) for x in np.split(at, ends[:-1])])
        fine = np.diff(ends, prepend=0) > 0
        made = made[fine] / np.maximum(np.linalg.norm(made[fine], axis=1, keepdims=True), 1e-300)
        edges = np.arange(len(made) + 1)
        return pa.RecordBatch.from_arrays([_cut(key[fine], edges), pa.ListArray.from_arrays(
            pa.array(edges * dim, pa.int32()), pa.array(made.ravel()))], ["k", "v"])

    def held(batches):
        for row in (x for b in batches for x in b.to_pylist()):
            ranks = np.cumsum(_opened(row["ranks"]))
            yield pool(row, head[ranks], _opened(row["at"]))

    def sent(pack: pa.Table, rare: pa.Table) -> pa.Table:
        row = pack.to_pylist()[0]
        ranks = np.cumsum(_opened(row["ranks"]))
        table = np.zeros((len(ranks), dim), np.float32)
        n = np.searchsorted(ranks, len(head))
        table[:n] = head[ranks[:n]]
        table[np.searchsorted(ranks, rare["rank"].to_numpy())] = np.frombuffer(b"".join(rare["v"].to_pylist()), np.float32).reshape(-1, dim)
        made = pool(row, table, _opened(row["at"]))
        _give_back()
        return pa.Table.from_batches([made])

    def rare(batches):
        for row in (x for b in batches for x in b.to_pylist()):
            ranks = np.cumsum(_opened(row["ranks"]))
            ranks = ranks[np.searchsorted(ranks, len(head)):]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranks), row["pack"])), pa.array(ranks)], ["pack", "rank"])

    schema = "k binary, v array<double>"
    if whole:
        return coded.select("ranks", "at", "ends", "keys").mapInArrow(held, schema)
    asked = coded.select("pack", "ranks").mapInArrow(rare, "pack long, rank long").join(learned.where(F.col("rank") >= len(head)), "rank")
    return coded.groupBy("pack").cogroup(asked.select("pack", "rank", "v").groupBy("pack")).applyInArrow(sent, schema)


def word_vectors(docs: DataFrame, text: str = "text", dim: int = 64, least: int = 5, seed: int = 42, rounds: int = 1):
    """A trained embedder: vectors of the words that ``docs`` hold ``least`` times, learned from all of them by
    ``SkipGrams`` in copies (at most as many as the session shuffles, if these are small enough) that are averaged by word after
    each round, mean-pooled and of unit length. It takes the place of ``embed_text``; texts without a known word give zeros.

    No task and not the driver holds all words: a copy holds those of its texts, averages are made a block of
    words at a time, and each pack of texts is sent its rare words' vectors. Rows get theirs by the digest of the text, so
    ``docs`` have to be the same whenever they are read."""
    spark = docs.sparkSession
    packed = _packed(docs, text)
    sizes = sorted(packed.select("pack", "n", "different").collect())
    total, different = sum(r["n"] for r in sizes), sum(r["different"] for r in sizes)
    ranked, often = _ranked(packed, least)
    coded = _coded(packed, ranked)
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    n_copies = max(1, min(len(sizes), max(parts, -(-total // COPY_WORDS), -(-different // COPY_DIFFERENT))))
    key, before, dealt, room = _spread(spark, n_copies), 0, [], [0] * n_copies
    for r in sizes:
        at = (2 * before + r["n"]) * n_copies // (2 * total)
        dealt.append((r["pack"], key[at]))
        room[at] += r["different"] + -(-r["n"] // STEP_WORDS) * NOISE
        before += r["n"]
    copies = F.broadcast(spark.createDataFrame(dealt, "pack long, copy long"))
    n = sum(x for _, x in often)
    learned = _learned(coded, copies, n_copies, min(n, max(room)), Noise(often, seed), dim, seed, rounds)
    head = np.zeros((min(n, HEAD_BYTES // (4 * dim)), dim), np.float32)
    first = learned.where(F.col("rank") < len(head)).toArrow()
    head[first["rank"].to_numpy()] = np.frombuffer(b"".join(first["v"].to_pylist()), np.float32).reshape(-1, dim)

    own_text, zeros = text, F.array(*[F.lit(0.0)] * dim)

    def embed(rows: DataFrame, text: str = "text", dim: int = dim, out: str = "embedding") -> DataFrame:
        made = coded if rows is docs and text == own_text else _coded(_packed(rows, text), ranked)
        found = materialize(_pooled(made, learned, head, len(head) == n).dropDuplicates(["k"]), "embeddings")
        key = f"_k_{uuid.uuid4().hex[:8]}"
        joined = rows.withColumn(key, _key(text)).join(found.toDF(key, f"{key}v"), key, "left")  # AQE splits a hot text
        return joined.withColumn(out, F.coalesce(F.col(f"{key}v"), zeros)).select(*rows.columns, *[out] * (out not in rows.columns))

    return embed


def mean_embedding(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean of the vectors of each ``by`` (partial sums before the shuffle)."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return (rows.groupBy(by).agg(Summarizer.mean(array_to_vector(doubles)).alias("_m"))
            .select(by, vector_to_array("_m").alias(vector)))


def embed_documents(docs: DataFrame, text: str = "text", dim: int = 256, embed=embed_text) -> DataFrame:
    """Long texts are cut into chunks, embedded, and averaged per document."""
    chunks = docs.select("doc_id", F.explode(fixed_chunks(F.col(text))).alias("text"))
    return mean_embedding(embed(chunks, "text", dim), "doc_id")


# ---------------------------------------------------------------- tickers

def link_tickers(mentions: DataFrame, tickers: DataFrame, dim: int = 256, embed=None, **kw) -> DataFrame:
    """(entity, ticker, similarity): every distinct organisation of ``mentions`` linked to the ticker whose
    text (symbol, sector and sub-industry without separators) has the nearest vector.

    ``tickers`` has the columns of the ticker CSV; rows without a symbol are no targets, other
    missing fields count as empty."""
    embed = embed or partial(embed_text, pieces=letter_grams)
    names = mentions.where(F.col("label") == "ORG").select(F.col("entity").alias("q_id")).distinct()
    empty = F.lit("")
    texts = tickers.where(F.col("Symbol").isNotNull()).select(F.col("Symbol").alias("c_id"), ticker_text(
        F.col("Symbol"), F.coalesce("GICS Sector", empty), F.coalesce("GICS Sub-Industry", empty)).alias("text"))
    found = link_vectors(embed(names.withColumn("text", F.col("q_id")), "text", dim, "q_value"),
                         embed(texts.dropDuplicates(["c_id"]), "text", dim, "c_value"), **kw)
    return found.select(F.col("q_id").alias("entity"), F.col("c_id").alias("ticker"), F.col("score").alias("similarity"))


def entity_records(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, entity, n, ticker, similarity): the entities of each document with the number of their
    mentions and, for organisations, the linked ticker."""
    made = mentions.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    return join_dimension(made, links, ["entity"], "left")
