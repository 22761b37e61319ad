"""Benchmark passages in documents: latent semantic retrieval, then alignment and an answer check."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import NOT_WORD, Words, chunks, fold, freed, table

#: Items are searched for in blocks of about so many words, so what goes to the workers is bounded however many there are.
#: Nothing but the number of passes depends on it.
BLOCK_WORDS = 500_000
#: Latent dimensions, oversampling and power iterations of the randomised SVD.
RANK, OVERSAMPLE, POWER = 128, 32, 2
#: How much all passages of the corpus weigh in the decomposed matrix, in terms of all passages of the benchmark.
CORPUS = 4
#: Columns of the matrix: words of the benchmark beyond this number share columns, and its words are bounded.
COLUMNS, MOST_WORDS = 1 << 16, 4_000_000
#: Passages: so many words, starting every half of it.
PASSAGE = 32
#: Numbers of the matrix that are multiplied at once.
AT_ONCE = 1 << 13
#: What a candidate passage needs: so much of its squared weight in words of the items, and this latent cosine.
MASS, COSINE = 0.1, 0.4
#: The least aligned share of an item: by itself, or with this share of its answer found.
COVERED, COVERED_WITH_ANSWER, ANSWER = 0.65, 0.5, 0.8


@dataclass
class Item:
    item: int
    words: np.ndarray  # hashes
    answer: int  # index of the answer's first word


def words_of(texts: pa.Array):
    """(first row, Words) of runs of texts, in small letters, words being what punctuation leaves."""
    for a, _, data, offsets in chunks(texts):
        yield a, Words(fold(data), offsets, NOT_WORD)


def answer_start(n: int) -> int:
    """Items have no answer column; the last quarter of an item, three words at least, stands for its answer."""
    return n - min(n, max(3, n // 4))


def read_items(rows: list) -> list[Item]:
    """Items with at least one word; rows are (item_id, text)."""
    out = []
    for a, w in words_of(pa.array([r[1] for r in rows], pa.string())):
        for k in range(len(w.first) - 1):
            h = w.h[w.first[k] : w.first[k + 1]]
            if len(h):
                out.append(Item(rows[a + k][0], h, answer_start(len(h))))
    return out


def find(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each h in sorted_, -1 where it isn't there."""
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return np.where(sorted_[at] == h, at, -1)


def vocabulary_of(items: DataFrame) -> np.ndarray:
    """The sorted hashes of all words of the items."""

    def run(batches):
        for b in batches:
            own = [np.unique(w.h) for _, w in words_of(b.column(1))]
            yield pa.record_batch([pa.array(np.unique(np.concatenate(own)).view(np.int64) if own else np.zeros(0, np.int64))], names=["h"])

    got = items.mapInArrow(freed(run), "h long").distinct().limit(MOST_WORDS + 1).toArrow().column("h").to_numpy()
    if len(got) > MOST_WORDS:
        raise ValueError(f"the benchmark has more than {MOST_WORDS} different words; search for it in parts")
    return np.sort(got.view(np.uint64))


def document_frequencies(docs: DataFrame, shared) -> tuple[np.ndarray, int]:
    """In how many rows of docs (column text) each word of the broadcast vocabulary occurs, and the number of rows."""

    def run(batches):
        vocabulary = shared.value
        df, rows = np.zeros(len(vocabulary), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, w in words_of(b.column(0)):
                v = find(vocabulary, w.h)
                df += np.bincount(np.unique(w.doc[v >= 0] * len(vocabulary) + v[v >= 0]) % len(vocabulary), minlength=len(vocabulary))
        used = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.r_[-1, used]), pa.array(np.r_[rows, df[used]])], names=["v", "n"])

    got = docs.select("text").mapInArrow(freed(run), "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).toArrow()
    out, total = np.zeros(len(shared.value), np.int64), 0
    v, n = got.column("v").to_numpy(), got.column("n").to_numpy()
    out[v[v >= 0]] = n[v >= 0]
    total = int(n[v < 0].sum())
    return out, total


@dataclass
class Space:
    """What places a text in the matrix: the vocabulary, each word's column and weight, and any other word's weight."""

    vocabulary: np.ndarray
    idf: np.ndarray
    other: float

    @property
    def columns(self) -> int:
        return min(len(self.vocabulary), COLUMNS)

    def rows(self, texts: list[np.ndarray]):
        """(row, column, value) of the texts' unit TF-IDF vectors over the vocabulary's columns."""
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        return self.cells(row, np.concatenate(texts) if texts else np.zeros(0, np.uint64), len(texts))

    def cells(self, row: np.ndarray, h: np.ndarray, n_rows: int):
        """The same for words h, of which each is in the text whose number is in row."""
        word = find(self.vocabulary, h)
        row, word = row[word >= 0], word[word >= 0]
        cell, n = np.unique(row * len(self.vocabulary) + word, return_counts=True)
        row, word = cell // len(self.vocabulary), cell % len(self.vocabulary)
        value = n * self.idf[word]
        norm = np.sqrt(np.bincount(row, value**2, n_rows))
        return row, word % COLUMNS, value / np.maximum(norm[row], 1e-12)


def passages_of(h: np.ndarray) -> list[np.ndarray]:
    """A text's words as passages, each half overlapping the one before; the last ends with the text."""
    at = [*range(0, max(1, len(h) - PASSAGE + 1), PASSAGE // 2)]
    if len(h) > PASSAGE and at[-1] + PASSAGE < len(h):
        at.append(len(h) - PASSAGE)
    return [h[a : a + PASSAGE] for a in at]


def benchmark_passages(benchmark: DataFrame) -> DataFrame:
    """All passages of the benchmark as word hashes: (words binary)."""

    def run(batches):
        for b in batches:
            own = [x for _, w in words_of(b.column(0)) for k in range(len(w.first) - 1) if w.first[k] < w.first[k + 1] for x in passages_of(w.h[w.first[k] : w.first[k + 1]])]
            yield pa.record_batch([pa.array([x.tobytes() for x in own], pa.binary())], names=["words"])

    return benchmark.select("text").mapInArrow(freed(run), "words binary")


def tiles(w: Words) -> np.ndarray:
    """For each word the number of its passage, where texts are cut into passages that follow one another."""
    n = -(-np.diff(w.first) // PASSAGE)
    return (np.cumsum(n) - n)[w.doc] + (np.arange(len(w)) - w.first[w.doc]) // PASSAGE


def add_terms(total: np.ndarray, q: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> None:
    """Adds X'(Xq) to total; X is given by its rows (in order), columns and values."""
    value = value.astype(np.float32)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    y = np.zeros((len(starts), q.shape[1]), np.float32)
    nth = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(row)]))
    for k in range(0, len(starts), AT_ONCE // PASSAGE):
        a, b = starts[k], starts[k + AT_ONCE // PASSAGE] if k + AT_ONCE // PASSAGE < len(starts) else len(row)
        y[k : k + AT_ONCE // PASSAGE] = np.add.reduceat(q[col[a:b]] * value[a:b, None], starts[k : k + AT_ONCE // PASSAGE] - a, axis=0)
    order = np.argsort(col, kind="stable")
    for k in range(0, len(order), AT_ONCE):
        part = order[k : k + AT_ONCE]
        c = col[part]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        total[c[first]] += np.add.reduceat(y[nth[part]] * value[part, None], first, axis=0)


def _sum(terms: DataFrame, shape: tuple[int, int]) -> tuple[np.ndarray, int]:
    """The sum of terms (column, term, n), and of n; added up on the executors, the driver gets each column once."""

    def add(group):
        column, at = np.unique(group.column("column").to_numpy(), return_inverse=True)
        total = np.zeros((len(column), shape[1]))
        np.add.at(total, at, np.frombuffer(b"".join(group.column("term").to_pylist()), np.float32).reshape(-1, shape[1]))
        n = np.bincount(at, group.column("n").to_numpy(), len(column)).astype(np.int64)
        return pa.table({"column": column, "term": pa.array([x.tobytes() for x in total.astype(np.float32)], pa.binary()), "n": n})

    got = terms.groupBy((F.col("column") % 64).alias("part")).applyInArrow(add, TERMS).toArrow()
    out = np.zeros(shape)
    for c, t in zip(got.column("column").to_pylist(), got.column("term").to_pylist(), strict=True):
        if c >= 0:
            out[c] = np.frombuffer(t, np.float32)
    return out, sum(got.column("n").to_pylist())


#: Columns of X'(Xq) from one task; the row of column -1 has the number of X's rows in n.
TERMS = "column long, term binary, n long"


def _terms(total: np.ndarray, rows: int) -> pa.RecordBatch:
    used = np.flatnonzero(total.any(axis=1))
    term = [np.zeros(total.shape[1], np.float32).tobytes(), *(x.tobytes() for x in total[used])]
    return pa.record_batch([pa.array(np.r_[-1, used]), pa.array(term, pa.binary()), pa.array(np.r_[rows, np.zeros(len(used), np.int64)])], names=["column", "term", "n"])


def corpus_factor(docs: DataFrame, own, q: np.ndarray) -> tuple[np.ndarray, int]:
    """(f, n): f f' stands for C'C, where C's n rows are all passages of all of docs that have any of the items' words,
    cut so that each word is in one.

    One pass: each task makes C_p'(C_p q) of the documents it has; with the sum S, C'C is S (q'S)^-1 S' (Nystrom's
    approximation for random orthonormal q), exactly so if q spans all columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        q, n = shared.value, 0
        total = np.zeros(q.shape, np.float32)
        for b in batches:
            for _, w in words_of(b.column(0)):
                if len(w):
                    row = tiles(w)
                    row, col, value = own.value.cells(row, w.h, int(row[-1]) + 1)
                    n += len(np.unique(row))
                    add_terms(total, q, row, col, value)
        yield _terms(total, n)

    total, n = _sum(docs.select("text").mapInArrow(freed(run), TERMS), q.shape)
    core = q.T.astype(float) @ total
    weight, u = np.linalg.eigh((core + core.T) / 2)
    some = weight > 1e-6 * max(weight.max(initial=0), 1e-12)
    return total @ (u[:, some] / np.sqrt(weight[some])), n


def latent_basis(docs: DataFrame, benchmark: DataFrame, space: Space, rank: int) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF matrix X of all passages of the benchmark and all passages of
    docs, which weigh CORPUS times as much together as those of the benchmark, each divided by its singular value, as
    texts are folded into a latent space: else the few directions that tell languages apart would decide every cosine.
    A direction of less weight than one passage is divided by that of one, so that what few texts share isn't blown up.

    Randomised subspace iteration (Halko, Martinsson and Tropp, 2011), distributed over the rows of X: docs are read
    once, for a factor of their part of X'X; every pass over the benchmark broadcasts the current basis Q, each task
    makes the term X_p'(X_p Q) of X'XQ for the columns it meets, the terms are added up column by column on the
    executors, and the driver orthonormalises the sum (COLUMNS x rank numbers at most).
    """
    spark = docs.sparkSession
    rng = np.random.default_rng(7)
    width = min(rank + OVERSAMPLE, space.columns)
    q = np.linalg.qr(rng.standard_normal((space.columns, width)))[0].astype(np.float32)
    own = spark.sparkContext.broadcast(space)
    factor, n_docs = corpus_factor(docs, own, q)
    texts = benchmark_passages(benchmark)
    for _ in range(POWER + 1):
        shared = spark.sparkContext.broadcast(q)

        def run(batches, shared=shared):
            q, n = shared.value, 0
            total = np.zeros(q.shape, np.float32)
            for b in batches:
                rows = [np.frombuffer(x, np.uint64) for x in b.column(0).to_pylist()]
                n += len(rows)
                if rows:
                    add_terms(total, q, *own.value.rows(rows))
            yield _terms(total, n)

        total, n = _sum(texts.mapInArrow(freed(run), TERMS), q.shape)
        total += factor @ (factor.T @ q) * (CORPUS * n / max(1, n_docs))
        q, triangle = np.linalg.qr(total)
        # directions without any weight say nothing
        q = (q * (np.abs(np.diag(triangle)) > 1e-7)).astype(np.float32)
    # the leading directions of what the last pass spans; its weights are squares of the singular values
    left, weight, _ = np.linalg.svd(triangle)
    own = weight[:rank] > 1e-6 * max(weight[:1].max(initial=0), 1e-12)
    return (q @ left[:, :rank][:, own] / np.sqrt(np.maximum(weight[:rank][own], 1.0))).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyro, 2004)."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        m = at.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Searcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[Item], space: Space, basis: np.ndarray):
        self.items, self.space = items, space
        self.idf = np.r_[space.idf, space.other].astype(np.float32)  # the last: any word outside the vocabulary
        self.basis = np.r_[basis, np.zeros((1, basis.shape[1]), np.float32)]
        row, col, value = space.rows([i.words for i in items])
        latent = np.zeros((len(items), basis.shape[1]), np.float32)
        np.add.at(latent, row, value.astype(np.float32)[:, None] * basis[col])
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def passages(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of each passage: every half length, with a last one that ends with the text."""
        n = np.diff(w.first)
        half = PASSAGE // 2
        count = np.where(n > PASSAGE, -(-(n - PASSAGE) // half) + 1, (n > 0).astype(np.int64))
        doc = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        a = w.first[doc] + nth * half
        return a, np.minimum(a + PASSAGE, w.first[doc + 1])

    def candidates(self, w: Words):
        """(word place, end, item index, cosine) of passages near items in latent space."""
        v = find(self.space.vocabulary, w.h)
        a, b = self.passages(w)
        weight = self.idf[v].astype(float) ** 2
        both = np.stack([np.where(v >= 0, weight, 0), weight])
        sums = np.concatenate([np.zeros((2, 1)), np.cumsum(both, axis=1)], axis=1)
        inside, norm = sums[:, b] - sums[:, a]
        full = np.flatnonzero((inside > 0) & (inside >= MASS * norm))
        column = np.where(v < 0, len(self.basis) - 1, v % COLUMNS)
        for i in range(0, len(full), 512):
            part = full[i : i + 512]
            size = b[part] - a[part]
            starts = np.r_[0, np.cumsum(size)[:-1]]
            at = np.repeat(a[part] - starts, size) + np.arange(size.sum())
            vec = np.add.reduceat(self.basis[column[at]] * self.idf[v[at]][:, None], starts, axis=0)
            vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
            for k in range(0, len(self.items), 4096):
                cos = vec @ self.latent[k : k + 4096].T
                for p, n in zip(*np.nonzero(cos >= COSINE), strict=True):
                    yield int(a[part[p]]), int(b[part[p]]), k + int(n), round(float(cos[p, n]), 4)

    def search(self, w: Words):
        """(text index, item, cosine, covered, answer covered, first word, end) of each item found in each text, once."""
        best: dict[tuple[int, int], tuple] = {}
        for a, b, k, cos in self.candidates(w):
            item = self.items[k]
            doc = int(w.doc[a])
            lo, hi = int(w.first[doc]), int(w.first[doc + 1])
            n = len(item.words)
            # the item may begin before the passage or end after it
            first, end = max(lo, a - n), min(hi, b + n)
            h = w.h[first:end]
            # no common subsequence is longer than the number of the item's words that occur there at all
            if np.isin(item.words, h).sum() < min(COVERED, COVERED_WITH_ANSWER) * n:
                continue
            got = (0.0, 0.0, 0, 0)
            # of the words around, those that are the item's, as far as one item's length (and a quarter) reaches
            reach = n + n // 4 + 2
            for s in range(0, max(1, len(h) - reach + n // 4 + 1), max(1, n // 4)):
                seg = h[s : s + reach]
                share = common_subsequence(item.words, seg) / n
                if share > got[0]:
                    answer = item.words[item.answer :]
                    got = (share, common_subsequence(answer, seg) / len(answer), first + s - lo, first + s + len(seg) - lo)
            if got[0] >= COVERED or got[0] >= COVERED_WITH_ANSWER and got[1] >= ANSWER:
                key = (doc, item.item)
                if key not in best or got[0] > best[key][3]:
                    best[key] = (doc, item.item, cos, *got)
        return best.values()


FOUND = "id long, item_id long, cosine double, covered double, answer_covered double, first_word long, end_word long"


def _blocks(items: DataFrame):
    """Lists of items in the order of their ids, of about BLOCK_WORDS words; items that share an id stay together."""
    block: list[Item] = []
    size = 0
    for rows in _batches(items.orderBy("item_id", "text").toLocalIterator(prefetchPartitions=True), 1000):
        for item in read_items(rows):
            if size >= BLOCK_WORDS and item.item != block[-1].item:
                yield block
                block, size = [], 0
            block.append(item)
            size += len(item.words)
    if block:
        yield block


def _batches(rows, n: int):
    batch = []
    for r in rows:
        batch.append((r.item_id, r.text))
        if len(batch) == n:
            yield batch
            batch = []
    if batch:
        yield batch


def _searchers(docs: DataFrame, benchmark: DataFrame, rank: int):
    """A broadcast Searcher for each block of items; docs: (id, text), benchmark: (item_id, text). All blocks have the
    same weights, from one pass over docs, and the same basis, from another."""
    spark = docs.sparkSession
    vocabulary = vocabulary_of(benchmark)
    if not len(vocabulary):
        return
    df, n = document_frequencies(docs, spark.sparkContext.broadcast(vocabulary))
    space = Space(vocabulary, np.log((n + 1) / (df + 1)) + 1e-3, float(np.log(n + 1)) + 1e-3)
    basis = latent_basis(docs, benchmark, space, rank)
    for items in _blocks(benchmark):
        yield spark.sparkContext.broadcast(Searcher(items, space, basis))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK) -> DataFrame:
    """(id, item_id, cosine, covered, answer_covered, first_word, end_word): a row for each benchmark item found in
    each row of docs.

    TF-IDF weights come from all of docs; one latent basis of rank dimensions from all passages of the benchmark and of
    docs; every passage of every document is a query against every item. A candidate counts if
    the longest common subsequence of its words and the item's covers COVERED of the item, or COVERED_WITH_ANSWER of it
    and ANSWER of its answer.

    Null and empty texts, items without a word, and empty tables give no row. Items that share an id count as one, the
    text that covers more of itself; a null item id stays null. Repeated rows of docs each give their rows. Other
    columns aren't read.
    """
    rows = _docs(docs, id_col, text_col)
    out = docs.sparkSession.createDataFrame([], FOUND)
    for shared in _searchers(rows, _items(benchmark, item_col, item_text_col), rank):

        def run(batches, shared=shared):
            for b in batches:
                found = []
                for a, w in words_of(b.column(1)):
                    found += [(a + f[0], *f[1:]) for f in shared.value.search(w)]
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                cols = [pa.array([f[i] for f in found], t) for i, t in enumerate(kinds, 1)]
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.record_batch([b.column(0).take(at), *cols], names=["id", "item_id", "cosine", "covered", "answer_covered", "first_word", "end_word"])

        out = out.union(rows.mapInArrow(freed(run), FOUND))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK) -> DataFrame:
    """docs without the rows in which an item of benchmark (item_id, text) is found; rows don't move.

    All columns stay as they are, whatever their names. Rows with a null or empty text stay, repeated rows stay or go
    together, and an empty docs or benchmark takes nothing away.
    """
    out = docs
    for shared in _searchers(_docs(docs, id_col, text_col), _items(benchmark, "item_id", "text"), rank):
        place = docs.columns.index(text_col)

        def run(batches, shared=shared, place=place):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for a, w in words_of(b.column(place)):
                    for f in shared.value.search(w):
                        keep[a + f[0]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(freed(run), docs.schema)
    return out


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "cosine", "covered", "answer_covered", "first_word", "end_word")
