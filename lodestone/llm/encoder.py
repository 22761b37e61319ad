"""Exact library token ids, the bulk of them through a faster engine over the same vocabulary."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The pre-tokenisation pattern that byte-level BPE files with use_regex=True stand for, and the characters on whose
#: classes all regex engines agree; texts with any other go to the library.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞]*")
#: Longer runs of white space are the library's too: the engine's pattern goes over a run once for each of its places.
SPACES = 256
LONG_SPACE = re.compile(rf"\s{{{SPACES}}}")


def _visible() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the n-th other byte for U+0100 + n."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def _ranks(path: str) -> dict[bytes, int] | None:
    """A byte-level BPE file's tokens as bytes, by id, where merging by least id is merging by the file's order; None for
    any other file. That holds if the n-th merge made the n-th token after the 256 bytes, and nothing else is set."""
    with open(path, "rb") as f:
        spec = json.load(f)
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") is True and split.get("add_prefix_space") is False and spec.get("normalizer") is None
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or odd or model.get("type") != "BPE":
        return None
    vocab, made = model["vocab"], ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
    if any(vocab.get(t) != 256 + i for i, t in enumerate(made)) or len(vocab) != 256 + len(model["merges"]):
        return None
    byte = {c: b for b, c in enumerate(_visible())}
    return {bytes([byte[c] for c in token]): i for token, i in vocab.items()}


class Encoder:
    """ids(texts): for each text the library's ids as little-endian unsigned 32-bit bytes.

    For a byte-level BPE file without a normalizer a text is encoded by the engine that merges by least id, which gives
    the same ids several times faster and remembers nothing. A text that holds one of the added tokens' strings, a
    character on whose class regex engines disagree, or a very long run of white space goes to the library whole, as
    does everything for any other kind of file.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.engine, self.special, self._library = path, None, re.compile(r"(?!)"), None
        if not path.endswith(".json"):
            return
        with open(path, "rb") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens") or []]
        if added:
            self.special = re.compile("|".join(map(re.escape, added)))
        if (ranks := _ranks(path)) is not None:
            import tiktoken

            self.engine = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def library(self, texts: list[str]) -> list[bytes]:
        """What the library itself gives; it is loaded when a text first needs it."""
        if self._library is None:
            if self.path.endswith(".json"):
                from tokenizers import Tokenizer

                tok = Tokenizer.from_file(self.path)
                tok.no_truncation()
                tok.no_padding()
                many = getattr(tok, "encode_batch_fast", tok.encode_batch)
                self._library = lambda own: [np.array(e.ids, dtype="<u4").tobytes() for e in many(own, add_special_tokens=False)]
            else:
                import sentencepiece

                sp = sentencepiece.SentencePieceProcessor(model_file=self.path)
                self._library = lambda own: [np.array(x, dtype="<u4").tobytes() for x in sp.encode(own, num_threads=1)]
        return self._library(texts)

    def _easy(self, text: str) -> bool:
        return (text.isascii() or PLAIN.fullmatch(text) is not None) and not self.special.search(text) and (len(text) < SPACES or not LONG_SPACE.search(text))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if self.engine is None:
            return self.library([t or "" for t in texts])
        encode = self.engine.encode_ordinary
        out = [(array("I", encode(t)).tobytes() if self._easy(t) else None) if t else b"" for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.library([texts[i] for i in rest]) if rest else (), strict=True):
            out[i] = x
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(x) // 4 for x in self.ids(texts)]


#: Rows whose texts and ids are in memory at once.
ROWS = 256


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, ROWS):
        yield batch.slice(a, ROWS)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
