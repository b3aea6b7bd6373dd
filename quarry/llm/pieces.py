"""Ids of whole texts by the tokenizers library, which is asked once for each distinct piece that its worker's cache does not hold.

A piece is what the library encodes alike alone and in its text. With the steps of ``bpe.STEPS`` no pre-token, special token or composition crosses ASCII white space. A word between white
space that holds ASCII and composed Latin letters (U+00C0 to U+027F) alone is its pre-tokens: runs of letters, single digits, runs of marks; ASCII case doesn't count there. Any other word is one piece as it
stands: other code points may compose (``J`` and a caron are two after composition, ``j`` and a caron one), an apostrophe may start a pre-token (``'s``), special tokens start with
``<``. A tokenizer file with other steps, or a special token without ``<``, gets whole texts.

Nothing of a text is left out or cut off: its ids are its pieces' in order. Memory is some 30 times PART or the longest word, 8 bytes an id, and the cache.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from quarry.llm.bpe import library_tokenizer, other_steps

WHITE, LETTER, DIGIT, MARK, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[:128] = MARK
KIND[list(b" \t\n\v\f\r")] = WHITE
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
KIND[0x80:0xC0] = KIND[0xC3:0xCA] = LETTER  # two-byte letters; later bytes of other code points follow a first byte that is OTHER
KIND[list(b"0123456789")] = DIGIT
KIND[list(b"'<")] = OTHER
#: No letters, and a letter whose lower case is two code points.
EXCEPT = [c.encode() for c in "\u00d7\u00f7\u0130"]
ODD = re.compile(rb"['<\xc2\xca-\xff]|" + b"|".join(EXCEPT)).search
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
SPACE = re.compile(rb"[ \t\n\v\f\r]")
#: Bytes split at once (about: up to the next white space), pieces in a worker's cache at about 190 bytes, the longest that it holds, and pieces in one call of the library.
PART, CACHE, CACHED, JOINED = 1 << 21, 500_000, 64, 1024


def split(part: bytes) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each piece starts, and the pieces. part: UTF-8 that ends with white space."""
    raw = np.frombuffer(part, np.uint8)
    kind = KIND[raw]
    for c in EXCEPT:
        at = part.find(c)
        while at >= 0:
            kind[at] = OTHER
            at = part.find(c, at + 2)
    white = kind == WHITE
    low = LOWER[raw]
    if len(other := np.flatnonzero(kind == OTHER)):
        edge = np.flatnonzero(np.diff(white, prepend=True))  # where words start and end, in turn
        word = np.searchsorted(edge, other, "right") - 1
        step = np.zeros(len(raw), np.int8)
        step[edge[word]], step[edge[word + 1]] = 1, -1
        whole = np.cumsum(step, dtype=np.int8).view(bool)
        kind[whole] = OTHER
        low = np.where(whole, raw, low)
    first = np.empty(len(raw), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == DIGIT
    black = ~white
    first &= black
    data = low[black]
    at = np.append(np.flatnonzero(first[black]), len(data))
    made = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    return np.flatnonzero(first), made.dictionary_encode()


class Encoder:
    """The library's ids of texts."""

    def __init__(self, path: str):
        self.tok = tok = library_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.apart = not other_steps(spec) and spec["model"].get("end_of_word_suffix") == "</w>" and all("<" in a["content"] for a in spec["added_tokens"])
        self.size = tok.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(tok.id_to_token(i) or "").endswith("</w>") for i in range(self.size)])
        self.cache: dict[bytes, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def ask(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The library's ids of each piece. Single pre-tokens go many to a call, and are told apart by their word ends."""
        out, words = {}, []
        for p in pieces:
            if ODD(p):
                out[p] = self.whole(p.decode()).tobytes()
            else:
                words.append(p)
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            ids = self.whole(b" ".join(part).decode())
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                raw, ends = ids.tobytes(), (4 * cut).tolist()
                out.update((p, raw[a:b]) for p, a, b in zip(part, [0, *ends[:-1]], ends, strict=True))
            else:
                out.update((p, self.whole(p.decode()).tobytes()) for p in part)
        return out

    def known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, by way of the cache."""
        found = list(map(self.cache.get, pieces))
        new = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if not new:
            return found
        if len(self.cache) + len(new) > CACHE:  # what this part doesn't use goes
            self.cache = {p: ids for p, ids in zip(pieces, found, strict=True) if ids is not None}
        asked = self.ask(new)
        self.cache.update((p, ids) for p, ids in asked.items() if len(p) <= CACHED)
        return [asked[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        if not self.apart:
            return [self.whole(t.decode()).tobytes() for t in texts]
        joined = b" ".join([*texts, b""])
        tops = np.cumsum([len(t) + 1 for t in texts])
        parts, bounds, at, before = [], [0], 0, 0
        while at < len(joined):
            end = SPACE.search(joined, min(at + PART, len(joined)) - 1).end()
            starts, made = split(joined[at:end])
            ids = pa.array(self.known(made.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(made.indices)
            if len(ids):
                _, upto, data = ids.buffers()
                upto = np.frombuffer(upto, np.int64, len(ids) + 1)
                parts.append(memoryview(data)[: upto[-1]])
            else:
                upto = np.zeros(1, np.int64)
            a, b = np.searchsorted(tops, (at, end), "right")  # texts that end in this part
            bounds += (before + upto[np.searchsorted(starts, tops[a:b] - at)]).tolist()
            before += int(upto[-1])
            at = end
        raw = b"".join(parts)
        return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
