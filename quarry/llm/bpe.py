"""BPE encoding and decoding with batched numpy merge rounds.

Texts are cut at ASCII white space into chunks; no pre-token, special token or composition of the
tokenizer crosses it, so a chunk's ids don't depend on its surroundings. Distinct chunks that the bounded
cache does not hold are encoded together: the symbols of all their words lie in one flat array, and each
round looks up the rank of every adjacent pair by binary search over the sorted pair keys, takes the lowest
rank of each word, and merges all its occurrences from the left. Merging them in one round equals merging
one by one because no merge that uses a symbol has a lower rank than the one that makes it; ``BPE`` checks
this when it loads a vocabulary and otherwise merges only the leftmost.

Letters, digits, case and composition are those of the tokenizers library's own Unicode tables: pre-tokens of chunks
outside ASCII come from its normalizer and pre-tokenizer. A tokenizer file with other steps than ``STEPS`` is refused.

Rows: a null text counts as empty, an empty text has no ids and an empty decoded text. Repeated rows, ties and
null ids stay, row by row. An empty table gives an empty result. Texts of any length are encoded whole: memory is
bounded by ROWS texts and their ids at once. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import text_bytes

#: The tokenizer's pattern of pre-tokens, its steps before the merges, and what a file may set in no other way.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "ignore_merges": False}
SPECIAL = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
NO_RANK = np.iinfo(np.int32).max
#: Chunks that a worker's cache holds at most (about 190 bytes each), the longest chunk that it holds, and rows encoded together.
CACHE, CACHED, ROWS = 250_000, 64, 512
#: Bytes from which a word is merged by windows, not by its lowest rank alone.
LONG = 256


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def other_steps(spec: dict) -> list[str]:
    """Settings of a tokenizer file that differ from STEPS, MODEL and SPECIAL; none if its chunks can be encoded alone."""
    out = [k for k, v in STEPS.items() if spec.get(k) != v] + [k for k, v in MODEL.items() if spec["model"].get(k) != v]
    return out + [f"{k} of {a['content']}" for a in spec["added_tokens"] for k, v in SPECIAL.items() if a.get(k) != v or regex.search(r"\s", a["content"])]


def library_tokenizer(path: str):
    """The tokenizers library's own reading of a file, without truncation and padding, on the executor's one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's to share out
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def window_least(x: np.ndarray, reach: int) -> np.ndarray:
    """The least of each number and those up to ``reach`` places before and after it."""
    most, out, have = np.iinfo(x.dtype).max, np.r_[x, np.full(2 * reach, np.iinfo(x.dtype).max, x.dtype)], 1
    out = np.r_[np.full(reach, most, x.dtype), out[: len(x) + reach]]
    while have < 2 * reach + 1:  # out[i] is the least of ``have`` numbers from i on
        step = min(have, 2 * reach + 1 - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class BPE:
    """A tokenizer file of kind BPE with word ends, NFC, lower case and byte letters; any other is refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if other := other_steps(spec):
            raise ValueError(f"{path}: cannot encode with these settings: {', '.join(other)}")
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = np.int64(size)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        made = np.full(size, -1, np.int64)
        made[self.merged] = np.arange(len(pairs))
        self.monotone = bool(np.all(np.maximum(made[left], made[right]) < np.arange(len(pairs))))
        self.reach = max(len(t) for t in vocab)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or r"(?!)")
        self.split = regex.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^0-9a-z]+")  # of ASCII without white space
        tok = library_tokenizer(path)
        self.normal, self.cut = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        self.byte_of = {ord(c): k for k, c in enumerate(letters)}

    def words(self, text: str) -> list[bytes | int]:
        """Pre-tokens as UTF-8, and the ids of special tokens."""
        out: list[bytes | int] = []
        at = 0
        for m in self.special.finditer(text) if "<" in text else ():
            out += self._plain(text[at : m.start()])
            out.append(self.specials[m[0]])
            at = m.end()
        return out + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> list[bytes]:
        if text.isascii():
            return [w.encode() for w in self.split.findall(text.lower())]
        return [w.translate(self.byte_of).encode("latin-1") for w, _ in self.cut(self.normal(text))]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of each word's ids. No word is empty."""
        size = np.array([len(w) for w in words], np.int64)
        if not len(size):
            return np.empty(0, np.int64), size
        if self.monotone and size.max() >= LONG:
            return self._with_long(words, size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = self.final[raw[ends]]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        while len(sym):
            rank = self._rank(sym, word)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            count = np.diff(np.r_[start, len(sym)])
            least_at = np.repeat(least, count)
            open_ = least_at != NO_RANK
            if not open_.all():  # words without a further merge leave
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
                sym, word, rank, least_at = sym[open_], word[open_], rank[open_], least_at[open_]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least_at)
            new_run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])]
            if self.monotone:  # in a run such as a a a a, every second one from the left
                first = np.flatnonzero(new_run)
                place = np.arange(len(hit)) - np.repeat(first, np.diff(np.r_[first, len(hit)]))
                hit = hit[place % 2 == 0]
            else:
                hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _with_long(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode_words where some words are long: each of those by itself."""
        long = size >= LONG
        ids, count = self.encode_words([w for w, far in zip(words, long, strict=True) if not far])
        parts, ends = [], np.cumsum(count)
        rest = zip((ends - count).tolist(), ends.tolist(), strict=True)
        for w, far in zip(words, long.tolist(), strict=True):
            if far:
                parts.append(self.encode_long(w))
            else:
                a, b = next(rest)
                parts.append(ids[a:b])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def encode_long(self, word: bytes) -> np.ndarray:
        """Ids of one word by rounds that merge every pair whose rank is the least within ``reach`` symbols on both sides.

        A pair of rank r is merged before its neighbours unless a pair of lower rank takes one of its two symbols. That pair's other symbol may be made by merges yet to come, which all have lower
        ranks still (``monotone``), and all lie within the bytes of the token that they make: ``reach`` at most. Where no rank there is below r, none of
        them can happen. So the pairs merged together are merged by the rule of the lowest rank too, and rounds don't grow with the word.
        """
        raw = np.frombuffer(word, np.uint8)
        sym = self.inner[raw]
        sym[-1] = self.final[raw[-1]]
        while True:
            rank = self._rank(sym, np.zeros(len(sym), np.int8))
            least = rank == window_least(rank, self.reach)
            least &= rank != NO_RANK
            if not least.any():
                return sym
            # A run such as a a a a merges every second pair from the left, once all of it is least.
            start = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            n = np.diff(np.r_[start, len(rank)])
            whole = np.repeat(np.logical_and.reduceat(least, start), n)
            hit = np.flatnonzero(whole & ((np.arange(len(rank)) - np.repeat(start, n)) % 2 == 0))
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym = sym[keep]

    def _rank(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The rank of each symbol's pair with the next one of its word."""
        rank = np.full(len(sym), NO_RANK, np.int32)
        if len(sym) > 1:
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NO_RANK)
        return rank

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk as little-endian unsigned 32-bit integers."""
        parts = [self.words(c.decode()) for c in chunks]
        distinct: dict[bytes, int] = {}
        for words in parts:
            for w in words:
                if type(w) is bytes:
                    distinct.setdefault(w, len(distinct))
        ids, count = self.encode_words(list(distinct))
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(count) * 4
        starts = (ends - count * 4).tolist()
        ends = ends.tolist()

        def of(w: bytes | int) -> bytes:
            if type(w) is int:
                return w.to_bytes(4, "little")
            k = distinct[w]
            return raw[starts[k] : ends[k]]

        return [b"".join(map(of, words)) for words in parts]

    def decode(self, ids: np.ndarray) -> str:
        """As a tokenizer without a decoder: the tokens with a blank between."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def encode_texts(texts: list[bytes], cache: dict[bytes, bytes], encode_chunks: Callable[[list[bytes]], list[bytes]], most: int | None = None) -> Iterator[bytes]:
    """Ids of each text as bytes, by way of a cache of chunks up to CACHED bytes that never holds much more than ``most`` (CACHE)."""
    most = most or CACHE
    for at in range(0, len(texts), ROWS):
        split = [t.split() for t in texts[at : at + ROWS]]  # of bytes: at ASCII white space only
        found = [list(map(cache.get, chunks)) for chunks in split]
        holes = [[k for k, ids in enumerate(f) if ids is None] for f in found]
        new = list({chunks[k] for chunks, at_ in zip(split, holes, strict=True) for k in at_})
        if len(cache) + len(new) > most:  # what these rows don't use goes
            used = {c: ids for chunks, f in zip(split, found, strict=True) for c, ids in zip(chunks, f, strict=True) if ids is not None}
            cache.clear()
            cache.update(used)
        made = dict(zip(new, encode_chunks(new), strict=True))
        cache.update((c, ids) for c, ids in made.items() if len(c) <= CACHED)
        for chunks, f, at_ in zip(split, found, holes, strict=True):
            for k in at_:
                f[k] = made[chunks[k]]
            yield b"".join(f)


@lru_cache(2)
def load(path: str) -> tuple[BPE, dict[bytes, bytes]]:
    """Once for each Python worker: the vocabulary and its cache."""
    return BPE(path), {}


def encode_decode(df: DataFrame, vocabulary: str, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``texts`` also ids (binary, 4 bytes each) and decoded.

    ``vocabulary`` is the tokenizer file's path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = load(vocabulary)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for at in range(0, len(raw), ROWS):
                n, sha, out_sha, ids_out, text_out = [], [], [], [], []
                for ids in encode_texts(raw[at : at + ROWS], cache, bpe.encode_chunks):
                    decoded = bpe.decode(np.frombuffer(ids, "<u4"))
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    out_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if texts:
                        ids_out.append(ids)
                        text_out.append(decoded)
                cols = [batch.column(0).slice(at, ROWS), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(out_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if texts:
                    cols += [pa.array(ids_out, pa.binary()), pa.array(text_out, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * texts
    return text_bytes(df, "doc_id").mapInArrow(run, schema)
