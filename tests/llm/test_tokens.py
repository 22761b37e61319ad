import random
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm.common import shared_dir
from lodestone.llm.encoder import Encoder, default_path
from lodestone.llm.packing import pack, plan
from lodestone.llm.tokencount import token_counts

ODD = [
    "", "  a  b ", " lead", " x\n y", "a\n\nb  c", "<|endoftext|> hi <|endoftext|>", "tab\t\tx \t y", "don't we'll  ' s", "²½ x٣",
    "　a 　 b", "é  ", "\n", "a " * 50 + "b", " " * 40, "x" * 100 + " y", "a​ b", "1 2  3\r\n 4", "a\x00b \x00", "日本語 テキスト 🙂 ok", "a᠎ b", "ſ ǆ ʰ ͅ",
]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(default_path())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    rng = random.Random(3)
    alphabet = [" ", "  ", "\n", "\t", ".", ",", "'s", "'", "a", "the", "Ü", "é", "1", "23", "!!", "thnt", "_", " ", "\r\n", "²"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    got = Encoder(default_path()).ids(texts)
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == library(t), repr(t)


def test_counts_and_cache(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(99, None, "y"), (None, "hi there", "z"), (3, ODD[3], "x"), (7, "a b " * 2000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    cache = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    want = sorted((str(d), len((t or "").encode()), len(library(t))) for d, t, _ in rows)
    take = lambda df: sorted((str(r.id), r.n_bytes, r.n_tokens) for r in token_counts(df, default_path(), cache).collect())
    assert take(docs) == want
    n = spark.read.parquet(cache).count()
    assert n == len({t or "" for _, t, _ in rows})
    more = docs.union(spark.createDataFrame([(500, "never seen before", "q")], docs.schema))
    assert take(more) == sorted([*want, ("500", 17, len(library("never seen before")))])
    assert spark.read.parquet(cache).count() == n + 1
    assert take(docs.limit(0)) == []


def check_plan(counts, capacity):
    runs, total = plan(dict(counts), capacity)
    used, seen = defaultdict(list), Counter()
    for r in runs:
        for i in range(r.n):
            used[r.seq + i // r.per].append((r.offset + i % r.per * r.length, r.length))
        seen[r.length] += r.n
    assert seen == Counter(counts) and len(used) == total
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return total


def test_plans():
    rng = random.Random(4)
    assert check_plan({}, 2048) == 0
    assert check_plan({1: 5000}, 2048) == 3
    assert check_plan({2048: 7, 1: 3}, 2048) == 8
    c = Counter(min(2048, int(rng.lognormvariate(6.5, 1)) + 1) for _ in range(50000))
    assert check_plan(c, 2048) <= 1.002 * sum(k * v for k, v in c.items()) / 2048 + 1
    for _ in range(30):
        cap = rng.choice([10, 64, 100])
        check_plan(Counter(rng.randint(1, cap) for _ in range(rng.randrange(1, 300))), cap)


def test_pack(spark, library):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "of", "zqx", "7"]) for _ in range(rng.randrange(400))), 1) for i in range(200)]
    rows += [(300, None, 1), (301, "", 1), (None, "a b c", 1), (5, rows[5][1], 1), (302, "one two " * 3000, 1), *[(400 + i, "same text", 1) for i in range(300)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack(docs, default_path(), capacity=256).collect()
    assert pack(docs.limit(0), default_path()).count() == 0
    want = []
    for d, t, _ in rows:
        ids = np.array([*library(t), 0], dtype="<u4")
        start = piece = 0
        while start < len(ids):
            n = (len(ids) % 256 or 256) if not piece else 256
            want.append((str(d), piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start, piece = start + n, piece + 1
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 256
