"""Token ids of whole texts by the public word-level vocabulary, word by word from a cache.

The tokenizer lower-cases, drops white space, splits into words and encodes each word alone. So a text's ids are its
words' ids in turn, and each distinct word needs to be encoded once. Texts of Latin-1 characters are split here by
array operations; any other text goes through the tokenizer as a whole. Both ways give the tokenizer's own ids.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np

from tideline.llm.common import Words, mix, u64

#: Words kept per Python worker, half of the places of its table; beyond it the table starts anew.
CACHE_WORDS = 1_500_000
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3


def _class(code: int) -> int:
    kind = unicodedata.category(chr(code))[0]
    if code in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
        return BLANK
    return {"L": LETTER, "N": NUMBER}.get(kind, OTHER)


_CLASS = np.array([_class(c) for c in range(256)], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256)], np.uint8)
_ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's words in lower-cased Latin-1 texts.

    A word is a run of letters, one number sign, a run of other signs, or an apostrophe that no other sign precedes
    with one of the short endings; the rest of the letters is then a word of its own.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    text_end = np.zeros(n + 1, bool)
    text_end[offsets] = True
    quotes = np.flatnonzero(data == 39)
    if len(quotes):
        fresh = quotes[cut[quotes]]  # the first sign of its run
        for q in fresh.tolist():
            for ending in _ENDINGS:
                stop = q + 1 + len(ending)
                if stop <= n and data[q + 1 : stop].tobytes() == ending and not text_end[q + 1 : stop].any():
                    cut[q + 1] = False
                    cut[stop] = True
                    break
    places = np.flatnonzero(cut)
    start, end = places[:-1], places[1:]
    keep = kind[start] != BLANK
    return start[keep], end[keep]


_KEPT = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word, never 0, from its first and last eight bytes and its length, which are all of a word of up
    to sixteen; longer ones, which are rare, are hashed one by one."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    length = end - start
    first = eight[start] & _KEPT[np.minimum(length, 8)]
    last = np.where(length > 8, eight[np.maximum(end - 8, 0)], u64(0))
    out = mix(first * u64(0x9FB21C651E98DF25) + mix(last + length.astype(np.uint64) * u64(0xA24BAED4963EE407)))
    for i in np.flatnonzero(length > 16).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return np.maximum(out, u64(1))


class Encoder:
    """Ids of many texts at once. One per Python worker, see :func:`encoder`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self, room: int = CACHE_WORDS) -> None:
        """An empty hash table of words with room for so many, at most half full."""
        size = 1 << max(2 * room - 1, 1).bit_length()
        self.mask, self.room, self.held = size - 1, size // 2, 0
        self.known = np.zeros(size, np.uint64)  # hashes by place, 0: free
        self.at = np.zeros(size, np.int32)
        self.length = np.zeros(size, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the words stand in the table, -1 for unknown ones."""
        at = (hashes & u64(self.mask)).astype(np.int64)
        got = self.known[at]
        place = np.where(got == hashes, at, -1)
        todo = np.flatnonzero((got != hashes) & (got != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got = self.known[at[todo]]
            hit = got == hashes[todo]
            place[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (got != 0)]
        return place

    def _put(self, hashes: np.ndarray) -> np.ndarray:
        """Places for distinct new words."""
        at = (hashes & u64(self.mask)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            free = todo[self.known[at[todo]] == 0]
            self.known[at[free]] = hashes[free]  # of several that want one place the last has it
            todo = todo[self.known[at[todo]] != hashes[todo]]
            at[todo] = (at[todo] + 1) & self.mask
        self.held += len(hashes)
        return at

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: Words, fresh: np.ndarray, hashes: np.ndarray) -> None:
        data = words.data.tobytes()
        texts = [data[a:b].decode("latin-1") for a, b in zip(words.start[fresh].tolist(), words.end[fresh].tolist(), strict=True)]
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, made), np.int64, len(made))
        place = self._put(hashes)
        self.at[place] = np.cumsum(length) - length + len(self.ids)
        self.length[place] = length
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in made for i in ids), np.uint32, int(length.sum()))])

    def _look_up(self, words: Words) -> np.ndarray:
        """The words' places in the table; unknown ones are learned first."""
        hashes = word_hashes(words.data, words.start, words.end)
        place = self._places(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            distinct, first = np.unique(hashes[missing], return_index=True)
            if self.held + len(distinct) > self.room:
                distinct, first = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
                self._clear(max(CACHE_WORDS, len(distinct)))
            self._learn(words, missing[first], distinct)
            place[missing] = self._places(hashes[missing])
        return place

    def _split(self, texts: list[str | None]) -> tuple[Words, np.ndarray, dict[int, str]]:
        """The words of the Latin-1 texts, where each text's bytes begin, and the other texts by row."""
        plain, odd = [], {}
        for i, text in enumerate(texts):
            text = text or ""
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                odd[i], raw = text, b""
            if b"<|" in raw:
                odd[i], raw = text, b""
            plain.append(raw)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in plain], out=offsets[1:])
        data = _LOWER[np.frombuffer(b"".join(plain), np.uint8)]
        words = Words.__new__(Words)
        words.data, words.offsets = data, offsets
        words.start, words.end = word_bounds(data, offsets)
        return words, offsets, odd

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text, without the ids."""
        words, offsets, odd = self._split(texts)
        total = np.zeros(len(words.start) + 1, np.int64)
        np.cumsum(self.length[self._look_up(words)], out=total[1:])
        found = np.diff(total[np.searchsorted(words.start, offsets)])
        for i, made in zip(odd, self.whole(list(odd.values())), strict=True):
            found[i] = len(made)
        return found

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and where each text's begin (with the total at the end)."""
        words, offsets, odd = self._split(texts)
        slot = self._look_up(words)
        length = self.length[slot].astype(np.int64)
        total = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        place = np.arange(total[-1]) + np.repeat(self.at[slot] - total[:-1], length)
        ids = self.ids[place]
        bounds = total[np.searchsorted(words.start, offsets)]
        if not odd:
            return ids, bounds
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        for i, made in zip(odd, self.whole(list(odd.values())), strict=True):
            parts[i] = made
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in parts], out=bounds[1:])
        return np.concatenate(parts), bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, whose cache lasts over tasks."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
