"""Removal of word sequences that an earlier document already has, found level by level."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Words, chunks, freed, give_back, grams, mix, partitions, table

LOW48 = np.uint64(2**48 - 1)
#: A bucket holds the hashes of about so many bytes of text, so its size stays the same however large the corpus is.
BUCKET_BYTES = 12 << 20
#: The shortest windows looked at have more than so many words; each level at most doubles the length.
FIRST = 6
FOUND = "id long, th long, found binary"
ASKED = "bucket int, hi binary, lo binary, doc binary, pos binary, ids binary, ths binary"


def levels(window: int) -> list[int]:
    """Window lengths from the shortest looked at to the one asked for; each is at most twice the one before."""
    out = [window]
    while out[0] > 2 * FIRST:
        out.insert(0, out[0] // 2 + 1)
    return out if len(out) > 1 else [max(1, window // 2 + 1), window]


def _sampled(words: Words, short: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g, whole, least): the short windows' hashes; for each start of a long window, whether it lies in one text,
    and the least hash among its short windows. That short window stands for the long one: equal long windows have
    equal least hashes, so looking at these alone (about 2 in long - short + 2) misses none."""
    g = grams(words.h, short, 1) & LOW48
    n = max(0, len(words) - long + 1)
    if not n:
        return g, np.zeros(0, bool), np.zeros(0, np.uint64)
    least = g[:n].copy()
    for o in range(1, long - short + 1):
        np.minimum(least, g[o : o + n], out=least)
    return g, words.doc[:n] == words.doc[long - 1 : long - 1 + n], least


def _buffer(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _blobs(ids: np.ndarray, ths: np.ndarray, doc: np.ndarray, values: np.ndarray, names: list[str]):
    """One row (id, th, values) for each doc index in doc."""
    if not len(doc):
        return None
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    ends = np.r_[at[1:], len(doc)]
    blob = [_buffer(values[a:b]) for a, b in zip(at, ends, strict=True)]
    return pa.record_batch([pa.array(ids[doc[at]]), pa.array(ths[doc[at]]), pa.array(blob, pa.binary())], names=names)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the stretches of equal values."""
    if not len(values):
        return []
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return list(zip(at.tolist(), [*at[1:].tolist(), len(values)], strict=True))


def _ask(buckets: np.ndarray, hi, lo, doc, pos, ids, ths):
    """Rows of ASKED: one for each bucket that anything falls into, with its arrays, document by document."""
    rows: list[list] = [[] for _ in range(7)]
    bucket = buckets[(hi % np.uint64(len(buckets))).astype(np.int64)]
    order = np.lexsort([pos, doc, bucket])
    bucket = bucket[order]
    for a, b in _runs(bucket):
        i = order[a:b]
        own, at = np.unique(doc[i], return_inverse=True)
        for col, x in zip(rows, (int(bucket[a]), _buffer(hi[i]), _buffer(lo[i]), _buffer(at.astype("<u4")), _buffer(pos[i]), _buffer(ids[own]), _buffer(ths[own])), strict=True):
            col.append(x)
    return pa.record_batch([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["bucket", "hi", "lo", "doc", "pos", "ids", "ths"])


def _union(asked=None, found=None):
    """A row batch of both kinds, told apart by kind."""
    names = ["bucket", "hi", "lo", "doc", "pos", "ids", "ths", "id", "th", "found"]
    n = (asked or found).num_rows
    empty = {"bucket": pa.int32(), "id": pa.int64(), "th": pa.int64()}
    have = dict(zip((asked or found).schema.names, (asked or found).columns, strict=True))
    return pa.record_batch([have.get(x, pa.nulls(n, empty.get(x, pa.binary()))) for x in names], names=names)


BOTH = f"{ASKED}, {FOUND}"


def _gather(table_: pa.Table) -> tuple[np.ndarray, ...]:
    """The arrays of a bucket's rows, with (id, th) for each entry."""
    parts = [[] for _ in range(5)]
    ids, ths, base = [], [], 0
    for r in table_.select(["hi", "lo", "doc", "pos", "ids", "ths"]).to_pylist():
        own = np.frombuffer(r["ids"], "<i8")
        parts[0].append(np.frombuffer(r["hi"], "<u8"))
        parts[1].append(np.frombuffer(r["lo"], "<u4"))
        parts[2].append(np.frombuffer(r["doc"], "<u4").astype(np.int64) + base)
        parts[3].append(np.frombuffer(r["pos"], "<u4"))
        ids.append(own)
        ths.append(np.frombuffer(r["ths"], "<i8"))
        base += len(own)
    hi, lo, doc, pos = (np.concatenate(p) for p in parts[:4])
    ids, ths = np.concatenate(ids), np.concatenate(ths)
    # a document met in several rows gets one index
    order = np.lexsort([ths, ids])
    new = np.ones(len(order), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (ths[order][1:] != ths[order][:-1])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return hi, lo, at[doc], pos, ids[order][new], ths[order][new]


def ranks(ids: np.ndarray, ths: np.ndarray) -> np.ndarray:
    """Documents in the order of their ids: equal ids have one rank, and so have all null ids, the last one."""
    null = (ths & 1).astype(bool)
    out = np.full(len(ids), np.iinfo(np.int64).max)
    out[~null] = np.unique(ids[~null], return_inverse=True)[1]
    return out


def _groups(keys: list[np.ndarray], rank: np.ndarray):
    """(order, least, greatest): entries sorted by keys, and of each one's group of equal keys the outermost ranks."""
    order = np.lexsort([rank, *keys[::-1]])
    if not len(order):
        return order, rank, rank
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    rank = rank[order]
    return order, rank[first][group], rank[np.r_[first[1:], len(order)] - 1][group]


def _first_level(short: int, long: int, buckets: np.ndarray):
    """Asks which sampled short windows occur in two documents or more. What a batch shows repeated by itself is
    found at once; only the outermost ids of each such window still ask, so a passage of a third of all documents
    makes two rows a batch."""

    def run(batches):
        for b in batches:
            ids, ths = np.asarray(b.column(0)), np.asarray(b.column(1))
            hs, docs = [], []
            for a, _, data, offsets in chunks(b.column(2)):
                w = Words(data, offsets)
                g, whole, least = _sampled(w, short, long)
                pick = np.zeros(len(g), bool)
                for o in range(long - short + 1):
                    pick[o : o + len(whole)] |= whole & (least == g[o : o + len(whole)])
                h, d = g[pick], w.doc[: len(g)][pick] + a
                order = np.lexsort([d, h])
                h, d = h[order], d[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                hs.append(h[keep])
                docs.append(d[keep])
            if not hs or not sum(map(len, hs)):
                continue
            h, d = np.concatenate(hs), np.concatenate(docs)
            rank = ranks(ids, ths)
            order, low, high = _groups([h], rank[d])
            h, d = h[order], d[order]
            many = low != high
            edge = ~many | (rank[d] == low) | (rank[d] == high)
            if many.any():
                yield _union(found=_blobs(ids, ths, d[many], h[many], ["id", "th", "found"]))
            e = h[edge]
            zero = np.zeros(len(e), "<u4")
            yield _union(asked=_ask(buckets, e, zero, d[edge], zero, ids, ths))

    return freed(run)


PACKED = "dest int, ids binary, ths binary, sizes binary, vals binary"
PACKED_TYPES = pa.schema([("dest", pa.int32()), *((x, pa.binary()) for x in ("ids", "ths", "sizes", "vals"))])


def _address(dests: np.ndarray, ids, ths, doc, values) -> pa.Table:
    """One row for each destination that any of the documents falls to: the documents' keys, sizes and values."""
    home = dests[(mix(ids.view(np.uint64) + mix(ths.view(np.uint64))) % np.uint64(len(dests))).astype(np.int64)]
    order = np.lexsort([doc, home[doc]])
    doc, values = doc[order], values[order]
    rows: list[list] = [[] for _ in range(5)]
    for a, b in _runs(home[doc]):
        d, v = doc[a:b], values[a:b]
        at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        sizes = np.diff(np.r_[at, len(d)]).astype("<u4")
        for col, x in zip(rows, (int(home[d[0]]), _buffer(ids[d[at]]), _buffer(ths[d[at]]), _buffer(sizes), _buffer(v)), strict=True):
            col.append(x)
    give_back()
    return pa.Table.from_arrays([pa.array(r, t.type) for r, t in zip(rows, PACKED_TYPES, strict=True)], schema=PACKED_TYPES)


def _answer_repeated(dests: np.ndarray):
    """For a bucket: each document's windows that occur in two documents or more."""

    def run(table_: pa.Table) -> pa.Table:
        hi, _, doc, _, ids, ths = _gather(table_)
        order, low, high = _groups([hi], ranks(ids, ths)[doc])
        many = low != high
        return _address(dests, ids, ths, doc[order][many], hi[order][many])

    return run


def _answer_later(dests: np.ndarray):
    """For a bucket: each document's places of windows that a document with a smaller id has too."""

    def run(table_: pa.Table) -> pa.Table:
        hi, lo, doc, pos, ids, ths = _gather(table_)
        rank = ranks(ids, ths)[doc]
        order, low, _ = _groups([hi, lo], rank)
        later = rank[order] > low
        return _address(dests, ids, ths, doc[order][later], pos[order][later])

    return run


def _unpack(width: int):
    """For a destination: one row for each document, with all that the buckets answered it (values of width bytes)."""

    def run(table_: pa.Table) -> pa.Table:
        told: dict[tuple[int, int], list[bytes]] = {}
        for r in table_.select(["ids", "ths", "sizes", "vals"]).to_pylist():
            ends = np.cumsum(np.frombuffer(r["sizes"], "<u4").astype(np.int64)) * width
            a = 0
            for i, t, b in zip(np.frombuffer(r["ids"], "<i8").tolist(), np.frombuffer(r["ths"], "<i8").tolist(), ends.tolist(), strict=True):
                told.setdefault((i, t), []).append(r["vals"][a:b])
                a = b
        cols = [pa.array([k[0] for k in told], pa.int64()), pa.array([k[1] for k in told], pa.int64()), pa.array([b"".join(v) for v in told.values()], pa.binary())]
        return pa.Table.from_arrays(cols, names=["id", "th", "found"])

    return run


def _member(doc: np.ndarray, h: np.ndarray, own: list[list[bytes]]) -> np.ndarray:
    """Whether h[i] is among the values that document doc[i] was told of."""
    told = [np.frombuffer(x, "<u8") for x in (b"".join(o or []) for o in own)]
    n = np.array([len(x) for x in told])
    salt = lambda d: (d.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return np.isin(h ^ salt(doc), (np.concatenate(told) if len(told) else np.zeros(0, np.uint64)) ^ salt(np.repeat(np.arange(len(n)), n)))


def _next_level(short: int, long: int, sampled: bool, last: bool, buckets: np.ndarray):
    """Extends the windows found repeated at short to long, and asks about those. sampled: only each long window's
    least short window was asked about; else its first and its last. last: long is the length wanted, so the places
    asked for are those that a smaller id has, and a batch again settles what it can by itself."""

    def run(batches):
        for b in batches:
            ids, ths, own = np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(3).to_pylist()
            parts: list[list] = [[], [], [], []]
            for a, z, data, offsets in chunks(b.column(2)):
                w = Words(data, offsets)
                g, whole, least = _sampled(w, short, long)
                n = len(whole)
                if sampled:
                    take = whole & _member(w.doc[:n], least, own[a:z])
                else:
                    both = _member(w.doc[: len(g)], g, own[a:z])
                    take = whole & both[:n] & both[long - short : long - short + n]
                i = np.flatnonzero(take)
                seed = 3 if last else 1
                h = grams(w.h, long, seed)[i]
                parts[0].append(h if last else h & LOW48)
                parts[1].append((grams(w.second(), long, 5)[i] >> np.uint64(32)).astype("<u4") if last else np.zeros(len(i), "<u4"))
                parts[2].append(w.doc[i] + a)
                parts[3].append((i - w.first[w.doc[i]]).astype("<u4"))
            if not parts[0] or not sum(map(len, parts[0])):
                continue
            hi, lo, doc, pos = (np.concatenate(p) for p in parts)
            rank = ranks(ids, ths)
            order, low, high = _groups([hi, lo], rank[doc])
            hi, lo, doc, pos = hi[order], lo[order], doc[order], pos[order]
            own = rank[doc]
            known = own > low if last else low != high
            ask = ~known if last else ~known | (own == low) | (own == high)
            if known.any():
                yield _union(found=_blobs(ids, ths, doc[known], pos[known] if last else hi[known], ["id", "th", "found"]))
            if ask.any():
                yield _union(asked=_ask(buckets, hi[ask], lo[ask], doc[ask], pos[ask], ids, ths))

    return freed(run)


def _settle(both: DataFrame, answer, width: int) -> DataFrame:
    """(id, th, found): what was found in the batches, and what the buckets answer, as one list a document.

    Buckets answer in one row for each destination, not for each document, so rows don't multiply with partitions.
    """
    asked = both.where("bucket IS NOT NULL").select("bucket", "hi", "lo", "doc", "pos", "ids", "ths")
    found = both.where("id IS NOT NULL").select("id", "th", "found")
    told = asked.groupBy("bucket").applyInArrow(answer(numbers(1, partitions(both.sparkSession))), PACKED)
    told = told.groupBy("dest").applyInArrow(_unpack(width), FOUND)
    return found.union(told).groupBy("id", "th").agg(F.collect_list("found").alias("found"))


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of integers (Murmur3 with seed 42), by which it deals out groups."""
    u = np.uint32
    turn = lambda v, n: (v << u(n)) | (v >> u(32 - n))
    h = turn(u(42) ^ turn(x.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593), 13) * u(5) + u(0xE6546B64)
    h ^= u(4)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32)


def numbers(least: int, parts: int) -> np.ndarray:
    """Group numbers, least of them or more, that Spark deals to its parts partitions equally many each."""
    each = -(-least // parts)
    some = np.arange(parts * (4 * each + 40), dtype=np.int32)
    while True:
        part = _spark_hash(some).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        size = np.bincount(part, minlength=parts)
        if size.min() >= each:
            nth = np.arange(len(some)) - np.repeat(np.cumsum(size) - size, size)
            return np.sort(some[order][nth < each])
        some = np.arange(2 * len(some), dtype=np.int32)


def bucket_numbers(rows: DataFrame) -> np.ndarray:
    """Buckets for the hashes of rows' texts: so many that each has those of about BUCKET_BYTES of text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return numbers(max(1, -(-size // BUCKET_BYTES)), partitions(rows.sparkSession))


def repeated(rows: DataFrame, window: int) -> DataFrame:
    """(id, th, found): for each document of rows (id, th, text) with any, the word places (binary lists of unsigned
    32-bit numbers) where a window starts whose word sequence also starts in a document with a smaller id.

    Level by level: short windows first (of each long window only the one with the least hash), and only where they
    occur in two documents are they extended to about twice the length, until the wanted length is reached or
    nothing is left. Hashes travel in arrays, one row for each batch and bucket; the number of buckets follows the
    bytes of text, so a bucket's size doesn't grow with the corpus. Each level only narrows what the next one looks at;
    the last one compares 64 bits of one hash of the words' bytes and 32 of another that is made in another way.
    """
    buckets = bucket_numbers(rows)
    ladder = levels(window)
    out = _settle(rows.select("id", "th", "text").mapInArrow(_first_level(ladder[0], ladder[1], buckets), BOTH), _answer_repeated, 8)
    for i, long in enumerate(ladder[1:]):
        last = long == window
        there = rows.select("id", "th", "text").join(out, ["id", "th"]).select("id", "th", "text", "found")
        asked = there.mapInArrow(_next_level(ladder[i], long, i == 0, last, buckets), BOTH)
        out = _settle(asked, _answer_later, 4) if last else _settle(asked, _answer_repeated, 8)
    return out


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, n), -1)
    return np.cumsum(step[:n]) > 0


def row_key(id_col: str, text: Column) -> tuple[Column, Column]:
    """(id, th): the key of a row's own results. th has 63 bits of the text's SHA-256 and, lowest, whether the id is
    null; then id has 64 more bits of the digest. So two rows share a key only if id and text are equal (but for equal
    digests' bits), and such rows have the same results."""
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    part = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    null = F.col(f"`{id_col}`").isNull()
    id_ = F.when(null, part(17)).otherwise(F.col(f"`{id_col}`").cast("long"))
    th = F.shiftleft(F.shiftright(part(1), 1), 1).bitwiseOR(null.cast("long"))
    # never null, and the planner knows it: else its joins would filter nulls out on one side and shuffle texts twice
    return F.coalesce(id_, F.lit(0).cast("long")), F.coalesce(th, F.lit(0).cast("long"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    id_, th = row_key(id_col, text)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")] if carry else []
    return docs.select(id_.alias("id"), th.alias("th"), text.alias("text"), *row)


def _texts(batch: pa.RecordBatch):
    """(text, found) of a batch's rows, few texts in memory at a time."""
    for a in range(0, batch.num_rows, 256):
        part = batch.slice(a, 256)
        yield from zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)


def _finish(window: int, with_text: bool):
    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, found in _texts(b):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                n, keep = len(words), words
                if found:
                    starts = np.frombuffer(b"".join(found), "<u4").astype(np.int64)
                    keep = list(compress(words, ~covered(starts, n, window)))
                joined = b" ".join(keep)
                out[0].append(n)
                out[1].append(n - len(keep))
                out[2].append(hashlib.sha256(joined).hexdigest())
                out[3].append((text if n == len(keep) else joined.decode("utf-8", "replace")) if with_text else None)
            if with_text:
                yield pa.record_batch([*b.columns[4:], *(pa.array(x, t) for x, t in zip((out[0], out[1], out[3]), (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["row", "n_words", "n_removed", "kept_text"])
                continue
            cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            id_ = pc.if_else(pc.equal(pc.bit_wise_and(b.column(3), 1), 1), pa.scalar(None, pa.int64()), b.column(0))
            yield pa.record_batch([id_, b.column(3), *cols], names=["id", "th", "n_words", "n_removed", "kept_sha256"])

    return freed(run)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(id, th, n_words, n_removed, kept_sha256) for every row of docs.

    A word goes if a window of `window` consecutive words that covers it also starts, with the same words, in a
    document with a smaller id; words are runs of bytes other than space and 0x09-0x0D. The digest is of the kept
    words joined by one space.

    Null text: no words, the digest of nothing. A null id counts as larger than all others: its windows go where any
    other id has them. Rows that share an id never remove from each other, and repeated rows get the same result.
    Texts shorter than a window stay whole. An empty table gives no row. Other columns aren't read.
    """
    rows = _keyed(docs, id_col, text_col)
    # both uses of the text below join on (id, th) after the same exchange, which Spark runs once
    joined = rows.join(repeated(rows, window), ["id", "th"], "left").select("id", "text", "found", "th")
    return joined.mapInArrow(_finish(window, False), "id long, th long, n_words long, n_removed long, kept_sha256 string")


def substring_dedup_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """docs with what substring_dedup removes taken out of the text: (row, n_words, n_removed, kept_text), where row
    has the other columns, and kept_text is the text as it was where nothing goes, else the kept words joined by one
    space. The same rules hold."""
    rows = _keyed(docs, id_col, text_col, carry=True)
    marks = repeated(rows.select("id", "th", "text"), window)
    joined = rows.join(marks, ["id", "th"], "left").select("id", "text", "found", "th", "row")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_finish(window, True), f"row {kind}, n_words long, n_removed long, kept_text string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


#: The same in DuckDB SQL: every window of every document, and the words that one with an earlier start covers.
ORACLE = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM windows) WHERE first < doc_id
), gone AS (
    SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM later)
), kept AS (
    SELECT n.doc_id, string_agg(n.x, ' ' ORDER BY n.p) AS t
    FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words) n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.p = g.p
    GROUP BY n.doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""
