"""Toxicity: a learned lexicon, fuzzy matching by Levenshtein automata, and context windows."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm.common import as_row, column_of, freed, smallest, spread, stage, table
from lodestone.llm.langid import remainder

#: The bounded training sample: of each label the documents with the smallest hashes, of those up to so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 100_000
#: And of these, in that order, as many as fit into so many bytes, so that the driver holds a bounded sample.
SAMPLE_BYTES = 64 << 20
#: A term or stem needs so many toxic documents of the sample, and a rate in them so many times that in the others.
LEAST_DOCS, TERM_TIMES, STEM_TIMES = 3, 30.0, 6.0
#: The least weight of a term that fuzzy matching looks for.
FUZZY_WEIGHT = 0.75
#: How much surer than by chance, in natural logarithms, a term must be.
SURE = 3.0
#: Stems, beginnings of words: so many letters, and so many different words that begin so.
STEM, LONGEST_STEM, CONTINUATIONS = 4, 10, 3
#: The ratio of rates that counts as a whole hit.
WHOLE = 400.0
#: Fuzzy terms have this length at least for one edit.
FUZZY = 5
#: Characters of the words that a worker keeps with what they match, and automaton steps kept; neither changes a result.
CACHE_CHARS, CACHE_STEPS = 12 << 20, 400_000
#: Words to either side of a hit that decide what it is.
WINDOW = 12
OPEN, CLOSE, BOTH = "«“„‘‹([", "»”’›)]", "\"'"
TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + OPEN + CLOSE + "…–—¡¿"


class Trie:
    """The lexicon's trie; node 0 is the root. term[n]: a term ends at n; stem[n]: every word from n on is a match."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.term, self.stem = [0.0], [0.0]
        for words, weight in ((terms, self.term), (stems, self.stem)):
            for w, value in words.items():
                n = 0
                for c in w:
                    if c not in self.next[n]:
                        self.next[n][c] = len(self.next)
                        self.next.append({})
                        self.term.append(0.0)
                        self.stem.append(0.0)
                    n = self.next[n][c]
                weight[n] = max(weight[n], value)


class Matcher:
    """The Levenshtein automaton of one edit intersected with the trie, made deterministic as words need it.

    A state is the set of (node, edits so far) that a prefix leads to, with all deletions taken; a step on a character
    follows the node's child (match), any child (substitution) or none (insertion). Stems take no edits: they are
    short, and a stem with an edit would match by chance.
    """

    def __init__(self, trie: Trie, benign: frozenset[str] = frozenset()):
        self.trie, self.benign = trie, benign
        self.start = self._close({(0, 0)})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.known: dict[str, tuple[float, int] | None] = {}
        self.chars = 0

    def clear(self) -> None:
        self.known.clear()
        self.steps.clear()
        self.chars = 0

    def keep(self, word: str, got: tuple[float, int] | None) -> None:
        if len(word) <= 64:
            self.chars += len(word) + 8
            if self.chars > CACHE_CHARS:
                self.known.clear()
                self.chars = len(word) + 8
            self.known[word] = got

    def _close(self, state: set) -> frozenset:
        return frozenset(state | {(c, 1) for n, e in state if not e for c in self.trie.next[n].values()})

    def _step(self, state: frozenset, c: str) -> frozenset:
        got = self.steps.get((state, c))
        if got is None:
            out = set()
            for n, e in state:
                if (child := self.trie.next[n].get(c)) is not None:
                    out.add((child, e))
                if not e:
                    out.add((n, 1))
                    out.update((x, 1) for x in self.trie.next[n].values())
            got = self._close(out)
            if len(self.steps) >= CACHE_STEPS:
                self.steps.clear()
            self.steps[state, c] = got
        return got

    def _match(self, word: str) -> tuple[float, int] | None:
        state, trie = self.start, self.trie
        exact, stem = 0, 0.0
        for c in word:
            exact = trie.next[exact].get(c, -1) if exact >= 0 else -1
            if exact >= 0:
                stem = max(stem, trie.stem[exact])
            state = self._step(state, c)
            if not state:
                break
        best = (stem, 0) if stem else None
        for n, e in state:
            if trie.term[n] and (not e or trie.term[n] >= FUZZY_WEIGHT and len(word) >= FUZZY and word not in self.benign) and (best is None or (e, -trie.term[n]) < (best[1], -best[0])):
                best = trie.term[n], e
        return best

    def __call__(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the nearest term, or None."""
        try:
            return self.known[word]
        except KeyError:
            got = self._match(word)
            self.keep(word, got)
            return got


def clean_word(token: str) -> str:
    return token.strip(TRIM).casefold()


def quoted(tokens: list[str], at: int) -> bool:
    """Whether a quotation opens in the window before the token (or with it) and closes in the window after it."""
    opened = closed = False
    for t in tokens[max(0, at - WINDOW) : at + 1]:
        if t[0] in OPEN + BOTH:
            opened = True
        if t[-1] in CLOSE + BOTH and t is not tokens[at]:
            opened = False
    for t in tokens[at : at + WINDOW + 1]:
        if t[0] in OPEN + BOTH and t is not tokens[at]:
            break
        if t.rstrip(".,;:!?")[-1:] in tuple(CLOSE + BOTH):
            closed = True
            break
    return opened and closed


#: Features of a text: exact hits, fuzzy hits, quoted hits, hits that come together in one window, hits a hundred words
#: (each saturated), and the logarithm of the length, by which long texts have chance hits.
FEATURES = 6
#: Weights before any label is seen; learning starts from them and is drawn to them.
PRIOR = np.array([2.0, 1.2, 0.3, 0.8, 0.5, 0.0])
PRIOR_BIAS = -2.5


@dataclass
class Model:
    matcher: Matcher
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = PRIOR_BIAS

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(FEATURES)
        tokens = text.split() if text else []
        hits, known, last = [], self.matcher.known, None
        for i, t in enumerate(tokens):
            got = known.get(t, 0)
            if got == 0:
                got = self.matcher(clean_word(t))
                self.matcher.keep(t, got)
            if got is not None:
                hits.append((i, got))
        seen: set[str] = set()
        for i, (weight, edits) in hits:
            if tokens[i] in seen:  # a word said again adds little
                weight /= 4
            seen.add(tokens[i])
            if quoted(tokens, i):
                out[2] += weight
                continue
            out[1 if edits else 0] += weight
            if last is not None and i - last <= WINDOW:
                out[3] += weight
            last = i
        out[4] = 100 * (out[0] + out[1]) / max(len(tokens), 100)
        out[5] = math.log(max(len(tokens), 100) / 100)
        return np.minimum(out, 4.0)

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.weights + self.bias)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def lexicon(toxic: list[str], clean: list[str]) -> tuple[dict[str, float], dict[str, float], frozenset[str]]:
    """(terms, stems, benign): words and beginnings of words that tell toxic texts from others, with weights in (0, 1],
    and the words of the others, which fuzzy matching leaves alone.

    A beginning counts if it is commoner in toxic documents than chance would have it, given how many beginnings are
    looked at; a language that builds words from a stem and many endings needs them. Its weight grows with the ratio
    of the rates, so a longer beginning that only toxic documents have weighs more than the stem itself.
    """
    words: dict[int, Counter] = {1: Counter(), 0: Counter()}
    begins: dict[int, Counter] = {1: Counter(), 0: Counter()}
    ends: dict[str, set[str]] = defaultdict(set)
    for label, texts in ((1, toxic), (0, clean)):
        for t in texts:
            own = {w for w in map(clean_word, t.split()) if len(w) > 1}
            words[label].update(own)
            begins[label].update({w[:k] for w in own for k in range(STEM, min(len(w), LONGEST_STEM) + 1)})
            if label:
                for w in own:
                    for k in range(STEM, min(len(w), LONGEST_STEM) + 1):
                        ends[w[:k]].add(w)
    n_toxic, n_clean = max(1, len(toxic)), max(1, len(clean))

    def chosen(of: dict[int, Counter], times: float) -> dict[str, float]:
        seen = sorted(n + of[0][w] for w, n in of[1].items())
        out = {}
        for w, a in of[1].items():
            b = of[0][w]
            ratio = (a + 0.5) / (n_toxic + 1) / ((b + 0.5) / (n_clean + 1))
            if a < LEAST_DOCS or ratio < times:
                continue
            mean = (a + b) * n_toxic / (n_toxic + n_clean)
            as_common = len(seen) - bisect_left(seen, a + b)
            if a * math.log(a / mean) - a + mean > math.log(as_common) + SURE:
                out[w] = min(1.0, math.log(ratio) / math.log(WHOLE))
        return out

    stems = {p: x for p, x in chosen(begins, STEM_TIMES).items() if len(ends[p]) >= CONTINUATIONS}
    # a stem that is hardly more than one of its words stands for that word only
    stems = {p: x for p, x in stems.items() if max(words[1][w] for w in ends[p]) < 0.8 * begins[1][p]}
    return chosen(words, TERM_TIMES), stems, frozenset(words[0])


def fit(toxic: list[str], clean: list[str]) -> Model:
    """A model of a sample: the lexicon, then logistic regression on the features, drawn to PRIOR, by Newton steps."""
    if not toxic:
        return Model(Matcher(Trie({}, {})))
    terms, stems, benign = lexicon(toxic, clean)
    trie = Trie(terms, stems)
    probe = Matcher(trie)
    model = Model(Matcher(trie, frozenset(w for w in benign if probe(w) is not None and probe(w)[1])))
    x = np.array([[*model.features(t), 1.0] for t in [*toxic, *clean]])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    prior = np.r_[PRIOR, PRIOR_BIAS]
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + 2.0 * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 2.0 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    model.weights, model.bias = np.r_[np.maximum(w[:-2], 0.0), w[-2]], float(w[-1])
    model.matcher.clear()
    return model


def _fitting(picked: list) -> list:
    total = np.cumsum([r.n for r in picked])
    return [r for r, n in zip(picked, total, strict=True) if n <= SAMPLE_BYTES]


def train(docs: DataFrame, labels: DataFrame, where) -> Model:
    """Fits on a bounded sample of the rows of docs that satisfy where and have a label; a document with both labels
    counts as toxic. Only the sample's texts come to the driver."""
    toxic = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(where & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    rows = rows.withColumn("at", spread("doc_id", "text"))
    sized = rows.select("doc_id", "at", F.octet_length("text").alias("n"))
    small = stage(sized.join(toxic.hint("merge"), "doc_id").select("at", "toxic", "n").distinct(), "toxicity-labels")
    picks = [_fitting(smallest(small.where(F.col("toxic") == k), "at", SAMPLE_DOCS)) for k in (1, 0)]
    picked = docs.sparkSession.createDataFrame([(r.at, r.toxic) for p in picks for r in p], "at long, toxic int")
    got = rows.join(F.broadcast(picked), "at").dropDuplicates(["at"]).orderBy("at").select("toxic", "text").collect()
    return fit([r.text for r in got if r.toxic == 1], [r.text for r in got if r.toxic != 1])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score) for every row of docs: all its columns, whatever their names, and the probability of a toxic text.

    Null and empty texts get the score of a text without a hit. Repeated rows stay and get equal scores; an empty table
    gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            out = np.array([model.score(t.as_py()) for t in column_of(b, text_col)], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["row", "score"])

    rows = docs.select(as_row(docs.columns))
    return rows.mapInArrow(freed(run), StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder("doc_id", 5) == 0
    out = score(docs.select("doc_id", held.alias("held_out"), "text"), train(docs, labels, ~held))
    return out.select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
