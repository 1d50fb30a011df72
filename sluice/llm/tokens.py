"""Token ids of many texts at once with a byte-level BPE of the `tokenizers` library.

The tokenizer splits a text into pieces (contractions, letters, digits, other characters, white space) and encodes each
piece on its own. Here the pieces of a block of texts are found with vectorised code, and each different piece is encoded
once in a task. Texts that hold an added token's string go to the library whole.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sluice.llm import kernels as K

OTHER, LETTER, NUMBER, SPACE = range(4)
MOST_PIECES = 200_000
# Unicode's White_Space characters.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The endings after an apostrophe that the tokenizer's pattern takes as pieces.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    kinds = np.zeros(0x110000, np.uint8)
    first = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    kinds[[i for i, c in enumerate(first) if c == "L"]] = LETTER
    kinds[[i for i, c in enumerate(first) if c == "N"]] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds, K.mix(np.arange(1, 0x110001, dtype=np.uint64))


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceEncoder:
    """Ids of a single piece. Merges in the order of their ids, as most vocabularies have, run in tiktoken."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        vocabulary, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranked = [vocabulary[a + b] for a, b in merges]
        self.fast = None
        if ranked == sorted(set(ranked)):
            import tiktoken

            byte_of = _byte_characters()
            ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in self.added}
            if len([t for t in ranks if len(t) == 1]) == 256:
                self.fast = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def piece(self, text: str) -> list[int]:
        if self.fast is not None:
            return self.fast._encode_single_piece(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in the concatenated code points of texts; every text begins one."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _characters()[0][points]
    first = np.zeros(n + 1, bool)
    first[1:n] = kind[1:] != kind[:-1]
    first[offsets] = True
    first[n] = True
    runs = np.flatnonzero(first)
    begin, end = runs[:-1], runs[1:]
    starts = first[:n].copy()
    last_of_text = np.zeros(n + 1, bool)
    last_of_text[offsets] = True
    # White space before more text: its last character is a piece of its own, or goes with what follows if a blank.
    before = end[(kind[begin] == SPACE) & ~last_of_text[end]]
    starts[before - 1] = True
    starts[before[points[before - 1] == 0x20]] = False
    # An apostrophe that begins a piece takes one of the endings.
    quote = (points[begin] == 0x27) & (end - begin == 1) & starts[begin] & ~last_of_text[end]
    where = np.flatnonzero(quote)
    where = where[where + 1 < len(begin)]
    where = where[kind[begin[where + 1]] == LETTER]
    for p, a, b in zip(begin[where].tolist(), begin[where + 1].tolist(), end[where + 1].tolist()):
        following = "".join(map(chr, points[a : min(b, a + 2)].tolist()))
        for ending in ENDINGS:
            if following.startswith(ending):
                starts[a] = False
                if a + len(ending) < b:
                    starts[a + len(ending)] = True
                break
    return np.flatnonzero(starts)


class BatchEncoder:
    def __init__(self, path: str) -> None:
        self.encoder = PieceEncoder(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.begin, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 17, np.int32), 0

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        piece, ids, lengths = self.encoder.piece, [], []
        for t in texts:
            got = piece(t)
            ids += got
            lengths.append(len(got))
        n = len(self.known)
        while len(self.begin) < n + len(lengths) + 1:
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[n + 1 : n + len(lengths) + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.known.update(zip(hashes, range(n, n + len(lengths))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, which are given as UTF-8, one after another, and where each text's begin, and the end."""
        raw = data.tobytes()
        text = raw.decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        head = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=head[1:])
        at = head[offsets]
        starts = piece_starts(points, at)
        ends = np.append(starts[1:], len(points))
        h = K.span_hashes(points, starts, ends, _characters()[1])
        if len(self.known) > MOST_PIECES:
            self._forget()
        different, where, which = np.unique(h, return_index=True, return_inverse=True)
        keys = different.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            a, b = starts[where[new]].tolist(), ends[where[new]].tolist()
            self._learn([keys[i] for i in new], [text[x:y] for x, y in zip(a, b)])
        index = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which]
        size = self.begin[index + 1] - self.begin[index]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.flat[np.repeat(self.begin[index] - total[:-1], size) + np.arange(total[-1])]
        begin = total[np.searchsorted(starts, at, side="left")]
        odd = {i for t in self.encoder.added if t.encode() in raw for i in self._holders(raw, offsets, t.encode())}
        if odd:
            own = [np.array(self.encoder.whole(text[at[i] : at[i + 1]]), np.int32) if i in odd else ids[begin[i] : begin[i + 1]] for i in range(len(at) - 1)]
            begin = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            ids = np.concatenate(own) if own else ids
        return ids, begin

    @staticmethod
    def _holders(raw: bytes, offsets: np.ndarray, token: bytes) -> set[int]:
        out, i = set(), raw.find(token)
        while i >= 0:
            out.add(int(np.searchsorted(offsets, i, side="right")) - 1)
            i = raw.find(token, i + 1)
        return out


@lru_cache(4)
def batch_encoder(path: str) -> BatchEncoder:
    return BatchEncoder(path)


def encode_texts(path: str, texts: list[str | None]) -> list[list[int]]:
    """Ids of each text."""
    ids, begin = batch_encoder(path).encode(*K.utf8(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]
