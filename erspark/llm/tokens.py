"""Batch tokenization with a public byte-level BPE file.

Encoding is independent per pre-token, so equal pre-tokens are encoded once by the
``tokenizers`` library and looked up afterwards. Pre-token boundaries of texts below
U+0500 are found with numpy; other texts go to the library whole. Memory is bounded by
``MAX_WORDS`` remembered pre-tokens and one slice of text.

The memory of pre-tokens is keyed by a 64-bit hash: with a million kept words, two
different ones share a key with a chance under 1e-7.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from . import text as T

#: Remembered pre-tokens in a worker; the memory is emptied beyond this, which costs time only.
MAX_WORDS = 1_500_000
#: Code points from here on are left to the library, as are rare control characters.
FAST_BELOW = 0x500

LETTER, NUMBER, SPACE, OTHER, SLOW = 1, 2, 3, 0, 9


def _classes() -> np.ndarray:
    out = np.zeros(FAST_BELOW + 1, np.uint8)
    for i in range(FAST_BELOW):
        kind = unicodedata.category(chr(i))[0]
        out[i] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[9, 10, 11, 12, 13, 32, 0xA0]] = SPACE
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, FAST_BELOW]] = SLOW
    return out


CLASSES = _classes()


def pretokens(points: np.ndarray, kinds: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Start flags of pre-tokens. heads: first code point of each non-empty text.

    A run of letters, of numbers or of other marks takes one space before it along; of
    longer white space the last character stands apart; 's 't 'm 'd 're 've 'll that
    begin a run of marks are pre-tokens of their own.
    """
    n = len(points)
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    start = head[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    last = space.copy()
    last[:-1] &= ~space[1:] | head[1:n]
    at = np.flatnonzero(last)
    at = at[~head[at + 1]]  # white space that ends its text stays whole
    start[at] = True
    start[at[points[at] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        ended = np.concatenate([head, np.ones(3, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = ~ended[quote + 1] & np.isin(one, [ord(c) for c in "stmd"])
        long = ~ended[quote + 1] & ~ended[quote + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for found, size in ((quote[short], 2), (quote[long], 3)):
            start[found + 1] = False
            after = found + size
            start[after[after < n]] = True
    return start


class BatchEncoder:
    """ids of many texts, as the library gives them with ``add_special_tokens=False``.

    A control string inside a text is its own id there; such texts go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in self.tok.get_added_tokens_decoder().values()]
        self.vocabulary = self.tok.get_vocab_size()
        kind = type(self.tok.pre_tokenizer).__name__
        self.fast = kind == "ByteLevel" and self.tok.normalizer is None and not self.tok.pre_tokenizer.add_prefix_space
        self._reset()

    def _reset(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, per-text offsets into them)."""
        ids, counts = [np.empty(0, np.int32)], []
        for a, b in T.slices(offsets):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            for x, c in self._slice(part, off):
                ids.append(x)
                counts.append(c)
        out = np.zeros(len(offsets), np.int64)
        if counts:
            np.cumsum(np.concatenate(counts), out=out[1:])
        return np.concatenate(ids), out

    def _slice(self, data, offsets):
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = (data & 0xC0) != 0x80
        if not self.fast or int(lead.sum()) != len(points):
            yield from (self._plain(raw[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1))
            return
        to_point = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=to_point[1:])
        kinds = CLASSES[np.minimum(points, FAST_BELOW)]
        cut = to_point[offsets]
        slow = np.flatnonzero(kinds == SLOW)
        rows = np.unique(np.concatenate([np.searchsorted(cut, slow, "right") - 1, self._with_added(raw, offsets)]))
        begin = 0
        for i in [*rows.tolist(), len(offsets) - 1]:
            if i > begin:
                lo, hi = offsets[begin], offsets[i]
                yield self._quick(data[lo:hi], offsets[begin : i + 1] - lo, points[cut[begin] : cut[i]], kinds[cut[begin] : cut[i]], np.flatnonzero(lead[lo:hi]), cut[begin : i + 1] - cut[begin])
            if i < len(offsets) - 1:
                yield self._plain(raw[offsets[i] : offsets[i + 1]])
            begin = i + 1

    def _with_added(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Texts that hold a control string."""
        found = []
        for mark in self.added:
            at = raw.find(mark)
            while at >= 0:
                found.append(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(mark, int(offsets[found[-1] + 1]))
        return np.array(found, np.int64)

    def _plain(self, raw: bytes):
        ids = np.array(self.tok.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
        return ids, np.array([len(ids)], np.int64)

    def _quick(self, data, offsets, points, kinds, bytes_at, cut):
        n = len(offsets) - 1
        if not len(points):
            return np.empty(0, np.int32), np.zeros(n, np.int64)
        starts = np.flatnonzero(pretokens(points, kinds, cut[:-1][cut[:-1] < cut[1:]]))
        first = np.searchsorted(starts, cut)  # pre-tokens before each text
        starts = bytes_at[starts]
        ends = np.append(starts[1:], len(data))
        keys, where, back = np.unique(T.span_hash(T.prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        at, size = self._known(keys, data, starts[where], ends[where])
        size, at = size[back], at[back]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        ids = self.pool[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])]
        return ids, np.diff(upto[first])

    def _known(self, keys, data, starts, ends):
        if len(self.keys) > MAX_WORDS:
            self._reset()
        pos = np.searchsorted(self.keys, keys)
        have = pos < len(self.keys)
        have[have] = self.keys[pos[have]] == keys[have]
        if not have.all():
            new = np.flatnonzero(~have)
            raw = data.tobytes()
            at, size = self._learn([raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            self.keys, self.at, self.size = (np.insert(old, pos[new], x) for old, x in ((self.keys, keys[new]), (self.at, at), (self.size, size)))
            pos = np.searchsorted(self.keys, keys)
        return self.at[pos], self.size[pos]

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Adds the ids of the words to the pool; their places and numbers of ids there."""
        texts = [w.decode("utf-8") for w in words]
        size, at = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        parts, held, done = [self.pool], len(self.pool), np.zeros(len(texts), bool)
        plain = np.array([i for i, x in enumerate(texts) if x[0] == " " and x[1:].isalpha()], np.int64)
        for a in range(0, len(plain), 2000):  # " a" " b" joined are cut into the same pre-tokens again
            some = plain[a : a + 2000]
            e = self.tok.encode("".join(texts[i] for i in some.tolist()), add_special_tokens=False)
            counts = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))
            if len(counts) == len(some) and counts.all():
                parts.append(np.array(e.ids, np.int32))
                size[some], at[some], done[some] = counts, held + np.cumsum(counts) - counts, True
                held += len(parts[-1])
        rest = np.flatnonzero(~done).tolist()
        for i, e in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
            parts.append(np.array(e.ids, np.int32))
            size[i], at[i] = len(parts[-1]), held
            held += len(parts[-1])
        self.pool = np.concatenate(parts)
        return at, size


_encoders: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """The worker's encoder of a file; the library's own threads stay off."""
    T.keep("tokens", _encoders)
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
