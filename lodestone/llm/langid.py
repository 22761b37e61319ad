"""Language identification by prediction by partial matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestone.llm.common import as_row, chunks, column_of, fold, freed, stage, table

ORDER = 3
#: A context is kept if it occurs so often in one language, and so often in each PER bytes of it on average; rarer ones
#: give way to the next shorter one. So no language has more than PER / LEAST_COUNT contexts of an order.
LEAST_COUNT, PER = 3, 1 << 20
#: Numbers that a task holds before it adds up equal ones, and different ones before it passes them on.
AT_ONCE = 1 << 20
#: Bound of the table that goes to the workers: a model that would need more is refused, never thinned out.
TABLE_BYTES = 256 << 20
SCALE = 512.0
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def _context(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each byte the order bytes before it in its text as one number; a text is taken to follow spaces."""
    out = np.zeros(len(data), np.int64)
    for back in range(order, 0, -1):
        before = np.full(len(data), 32, np.int64)
        before[back:] = data[:-back]
        for k in range(back):
            at = starts + k
            before[at[at < len(data)]] = 32
        out = out * 256 + before
    return out


class Model:
    """Frozen context trees of every language, as one table of code lengths.

    bits[state * width + symbol] has the code length of a byte in 1/SCALE bits under each language; state is the
    longest kept context that the bytes before it end with. A language codes a byte it has seen in a context with
    probability count / (total + distinct); else it pays the escape, distinct / (total + distinct), and goes on in
    the next shorter context, down to all 256 bytes alike; a context it has never been in costs it nothing.
    A byte's length is rounded down to 1/SCALE bits and taken as 64 bits at most; sums of these are exact.
    """

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, table_bytes: int = TABLE_BYTES, least: int = LEAST_COUNT):
        self.order, self.langs = order if samples else 0, sorted(samples)
        data, starts = {}, {}
        for lang in self.langs:
            texts = [t for t in samples[lang] if t]
            data[lang] = fold(np.frombuffer(b"".join(texts), np.uint8))
            starts[lang] = np.cumsum([0, *map(len, texts)])[:-1].astype(np.int64) if texts else np.zeros(0, np.int64)
        grams = {(lang, k): np.unique(_context(data[lang], starts[lang], k) * 256 + data[lang], return_counts=True) for lang in self.langs for k in range(order + 1)}
        self._fill(grams, self._contexts(grams, least), table_bytes)

    @classmethod
    def of(cls, grams: dict, contexts: list[np.ndarray], table_bytes: int = TABLE_BYTES) -> Model:
        """From counts: grams[language, k] has sorted k + 1 bytes as numbers and how often each occurs, for all contexts of
        k bytes that are in contexts[k] (sorted; with each its shorter ones)."""
        out = cls.__new__(cls)
        out.langs = sorted({lang for lang, _ in grams})
        out.order = len(contexts) - 1 if grams else 0
        out._fill(grams, contexts, table_bytes)
        return out

    def _fill(self, grams: dict, contexts: list[np.ndarray], table_bytes: int) -> None:
        seen = np.unique(np.concatenate([grams[lang, 0][0] for lang in self.langs] or [np.zeros(0, np.int64)]))
        self.symbol = np.zeros(256, np.int64)  # 0: a byte never seen
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        if (size := 2 * sum(map(len, contexts)) * self.width * len(self.langs)) > table_bytes:
            raise ValueError(f"the table of {len(self.langs)} languages has {size} bytes, {table_bytes} are allowed: ask for a smaller order or a larger least count")
        cost = np.full((1 + sum(map(len, contexts)), self.width, len(self.langs)), 8.0)
        self.index: list[np.ndarray] = []
        base = 0
        for k, own in enumerate(contexts):
            rows = slice(base, base + len(own))
            if k:
                short = np.searchsorted(contexts[k - 1], own % 256 ** (k - 1))
                cost[rows] = cost[self.offset[k - 1] + short]
            self.offset = [*getattr(self, "offset", []), base]
            for j, lang in enumerate(self.langs):
                gram, n = grams[lang, k]
                at = np.searchsorted(own, gram >> 8)
                ok = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == gram >> 8) if len(own) else np.zeros(len(gram), bool)
                at, n, sym = at[ok], n[ok].astype(float), self.symbol[gram[ok] & 255]
                total = np.bincount(at, n, len(own))
                distinct = np.bincount(at, minlength=len(own))
                used = distinct > 0
                escape = np.zeros(len(own))
                escape[used] = np.log2((total[used] + distinct[used]) / distinct[used])
                cost[rows, :, j] += escape[:, None]
                cost[base + at, sym, j] = np.log2((total + distinct)[at] / n)
            base += len(own)
        self.contexts = contexts
        self.bits = np.minimum(cost * SCALE, 32767).astype(np.int16).reshape(len(cost) * self.width, len(self.langs))
        self._states()

    @staticmethod
    def _contexts(grams: dict, least: int) -> list[np.ndarray]:
        """Sorted contexts of each order: those that one language has least times, and whose shorter ones are there."""
        out, top = [np.zeros(1, np.int64)], max(k for _, k in grams) if grams else 0
        for k in range(1, top + 1):
            kept = [np.zeros(0, np.int64)]
            for (_, o), (g, n) in grams.items():
                if o == k:
                    found, inverse = np.unique(g >> 8, return_inverse=True)
                    kept.append(found[np.bincount(inverse, n, len(found)) >= least])
            own = np.unique(np.concatenate(kept))
            out.append(own[np.isin(own % 256 ** (k - 1), out[-1])])
        return out

    def _states(self) -> None:
        """next_[context of order symbols] = the row of its longest kept suffix."""
        w = self.width
        rows = np.zeros(1, np.int64)  # by the symbols of the last k bytes
        for k in range(1, self.order + 1):
            rows = np.tile(rows, w)  # a symbol further back, not looked at yet
            own = self.contexts[k]
            code = np.zeros(len(own), np.int64)
            for back in range(k - 1, -1, -1):
                code = code * w + self.symbol[(own >> (8 * back)) & 255]
            rows[code] = self.offset[k] + np.arange(len(own))
        self.next_ = rows.astype(np.int32)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths in bits: a row for each text, a column for each language."""
        data = fold(data)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(data) or not self.langs:
            return out
        sym = self.symbol[data]
        full = np.flatnonzero(np.diff(offsets))
        starts = offsets[full]
        space = self.symbol[32]
        code = np.zeros(len(data), np.int64)
        for back in range(self.order, 0, -1):
            before = np.full(len(data), space, np.int64)
            before[back:] = sym[:-back] if back < len(data) else space
            for k in range(back):
                at = starts + k
                before[at[at < len(data)]] = space
            code = code * self.width + before
        # a short text's own limits: what lies before its start was set to spaces above
        cost = self.bits[self.next_[code].astype(np.int64) * self.width + sym]
        out[full] = np.add.reduceat(cost, starts, axis=0, dtype=np.int64) / SCALE
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        strings = texts.to_pylist()
        for a, b, data, offsets in chunks(texts):
            bits = self.lengths(data, offsets)
            for i in range(a, b):
                t = strings[i]
                if not self.langs or not t or not LETTER.search(t):
                    names.append(UNDETERMINED)
                    continue
                row = bits[i - a]
                best = int(row.argmin())
                names.append(self.langs[best])
                scores[i] = 1.0 / np.exp2(np.maximum(row[best] - row, -1000.0)).sum()
        return names, scores


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(number, count), each number once and in order, of several such."""
    gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.zeros(len(gram), np.int64)
    np.add.at(n, at, np.concatenate([n for _, n in parts]))
    return gram, n


def _count(batches):
    """For rows (lang, text): (lang, gram, n), how often a byte comes after the ORDER bytes before it; a number may come
    several times."""

    def out(lang: str):
        gram, n = held.pop(lang)[0]
        return pa.record_batch([pa.repeat(pa.scalar(lang), len(gram)), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for b in batches:
        for lang in b.column(0).unique():
            own = held.setdefault(lang.as_py(), [])
            for _, _, data, offsets in chunks(b.column(1).filter(pc.equal(b.column(0), lang))):
                data = fold(data)
                own.append(np.unique((_context(data, offsets[:-1], ORDER) * 256 + data).astype(np.uint32), return_counts=True))
                if sum(len(g) for g, _ in own) > AT_ONCE:
                    own[:] = [_added(own)]
            own[:] = [_added(own)] if own else []
        while sum(len(own[0][0]) for own in held.values() if own) > AT_ONCE:
            yield out(max((lang for lang in held if held[lang]), key=lambda lang: len(held[lang][0][0])))
    for lang in [lang for lang in held if held[lang]]:
        yield out(lang)


def train(docs: DataFrame, where, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", table_bytes: int = TABLE_BYTES) -> Model:
    """A model of the languages of docs, from all rows that satisfy where; lang_col is read for nothing else.

    Every byte of every such text is counted, on the executors; the driver gets the counts of the contexts that are kept
    (see LEAST_COUNT), however many texts there are. Repeated rows count each time. Rows without an id, a text or a
    language teach nothing.
    """
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    parts = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(freed(_count), "lang string, gram long, n long")
    longest = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the last bytes of the longest contexts are the shorter ones
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("gram") % 256 ** (k + 1)).alias("gram")) for k in range(ORDER + 1)]))
    grams = stage(longest.select("lang", orders.alias("e"), "n").groupBy("lang", "e.k", "e.gram").agg(F.sum("n").alias("n")), "langid-grams")
    grams = grams.withColumn("context", F.shiftright("gram", 8))
    total = grams.where("k = 0").groupBy("lang").agg(F.sum("n").alias("bytes"))
    least = F.greatest(F.lit(LEAST_COUNT), F.ceil(F.col("bytes") / (PER / LEAST_COUNT)))
    seen = grams.groupBy("lang", "k", "context").agg(F.sum("n").alias("n")).join(total, "lang")
    kept = stage(seen.where((F.col("k") == 0) | (F.col("n") >= least)).select("k", "context").distinct(), "langid-contexts")
    langs, width = grams.where("k = 0").agg(F.count_distinct("lang"), F.count_distinct("gram")).first()
    if (size := 2 * kept.count() * (width + 1) * langs) > table_bytes:  # before anything of that size is fetched
        raise ValueError(f"the table of {langs} languages has {size} bytes, {table_bytes} are allowed: ask for a larger least count")
    got = grams.join(kept, ["k", "context"], "left_semi").select("lang", "k", "gram", "n").orderBy("lang", "k", "gram").toArrow()
    k, gram, n = (got.column(c).to_numpy() for c in ("k", "gram", "n"))
    names = got.column("lang").combine_chunks().dictionary_encode()
    lang, names = names.indices.to_numpy(), names.dictionary.to_pylist()
    by = {}
    for i, name in enumerate(names):
        for o in range(ORDER + 1):
            own = (lang == i) & (k == o)
            by[name, o] = gram[own], n[own]
    contexts = [np.unique(gram[k == o] >> 8) if o else np.zeros(1, np.int64) for o in range(ORDER + 1)]
    return Model.of(by, contexts, table_bytes)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score) for every row of docs; row has all its columns, whatever their names.

    The language with the shortest code for the whole text wins; score is its share of the probability. A text that
    is null, or without a letter, is 'und' with score 0, and so is everything under a model of no language. Ties go
    to the first name. Repeated rows stay; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score = shared.value.predict(column_of(b, text_col))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    rows = docs.select(as_row(docs.columns))
    return rows.mapInArrow(freed(run), StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo n; of the empty text for a null id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = train(docs, ~held)
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("row.doc_id", "row.held_out", "lang_pred", "score")
