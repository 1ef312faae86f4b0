"""Token ids of whole texts with a public tokenizer file, fast for repeated words.

The tokenizer drops white space and cuts what is between into runs of letters, single digits
and runs of other characters before it looks at its vocabulary, and it folds case. So the ids of a
text are those of these units in order. Units are found for a whole slice of texts at once and told apart
by 64-bit hashes; the tokenizer encodes each distinct one once, and its ids are kept for later slices. A chunk between
white space that holds anything but plain Latin text (other scripts, marks, control
characters, apostrophes, special tokens) is one unit, left to the tokenizer whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from forestlens.llm import textops

KEPT = 500_000                 # units that a worker process keeps (about 40 bytes each); beyond, those of the current slice stay
GROUP = 64                     # plain units to a text handed to the tokenizer
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[textops.SPACE] = _SPACE
_CLASS_OF = _CLASS.tobytes()   # for bytes.translate, which needs no wide index array
# Bytes that make a chunk odd: control characters, the apostrophe, leads of all but U+00C0..U+017F.
_ODD = np.zeros(256, bool)
_ODD[[*range(0x20), 0x27, 0x7F, *range(0xC0, 0x100)]] = True
_ODD[[0xC3, 0xC4, 0xC5]] = False
_ODD[textops.SPACE] = False
# Pairs that do: multiplication and division signs, dotted capital I, the opening of a special token.
_ODD_PAIRS = [b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0", b"<|"]
_PAIR_CODES = [a << 8 | b for a, b in _ODD_PAIRS]
_SUSPECT = _ODD.copy()
_SUSPECT[[a for a, _ in _ODD_PAIRS]] = True
_SUSPECT_OF = _SUSPECT.tobytes()
_encoders: dict[str, "Encoder"] = {}


def units(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of a slice, and whether each is an odd chunk."""
    n, data = len(raw), np.frombuffer(raw, np.uint8)
    kind = np.frombuffer(raw.translate(_CLASS_OF), np.uint8)
    # segments: runs of a class within a text, a digit each; those of white space are no units
    begins = np.empty(n, bool)
    begins[:1] = True
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edges = offsets[offsets < n]
    begins[edges] = True
    at = np.flatnonzero(begins)
    space = kind[at] == _SPACE
    suspects = np.flatnonzero(np.frombuffer(raw.translate(_SUSPECT_OF), bool))
    codes = data[suspects].astype(np.int32) << 8 | data[np.minimum(suspects + 1, n - 1)]
    odd_bytes = suspects[_ODD[data[suspects]] | np.isin(codes, _PAIR_CODES)]
    odd = np.zeros(len(at), bool)
    if len(odd_bytes):
        opens = ~space
        opens[1:] &= space[:-1]
        opens[np.searchsorted(at, edges)] = True
        chunk = np.cumsum(opens)
        odd_chunk = np.zeros(int(chunk[-1]) + 1, bool)
        odd_chunk[chunk[np.searchsorted(at, odd_bytes, "right") - 1]] = True
        odd = odd_chunk[chunk] & ~space
        stays = opens | ~odd            # an odd chunk is one unit
        at, space, odd = at[stays], space[stays], odd[stays]
    ends = np.append(at, n)[1:]
    return at[~space], ends[~space], odd[~space]


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        # ids that end a word, where the vocabulary tells them
        self.ends_word = None
        if suffix:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
            self.ends_word[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        """Known units: sorted hashes, and where in ``pool`` the ids of each are."""
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def encode_each(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def encode_plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_each`, many plain units to a call: joined by spaces, the ids cut where the tokenizer's words end."""
        groups = [texts[i:i + GROUP] for i in range(0, len(texts), GROUP)]
        joined = [b" ".join(g).decode() for g in groups]
        encode = self.tokenizer.encode_batch if self.ends_word is None else self.tokenizer.encode_batch_fast
        pool, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for group, e in zip(groups, encode(joined, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            if self.ends_word is None:
                word = np.array([-1 if w is None else w for w in e.word_ids])
                last = np.flatnonzero(np.append(word[1:] != word[:-1], True)) if len(word) and word.min() >= 0 else word[:0]
            else:
                last = np.flatnonzero(self.ends_word[ids])
            size = np.diff(last, prepend=-1)
            if len(last) != len(group) or last[-1] != len(ids) - 1:          # a unit that isn't one word of the tokenizer
                ids, size = self.encode_each(group)
            pool.append(ids)
            sizes.append(size)
        return np.concatenate(pool), np.concatenate(sizes)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes are, or belong, among the known ones, and whether they are there."""
        at = np.searchsorted(self.keys, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == h[inside]
        return at, known

    def learn(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Adds units of sorted hashes ``h`` with their ids."""
        at = np.searchsorted(self.keys, h)
        self.first = np.insert(self.first, at, len(self.pool) + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.keys = np.insert(self.keys, at, h)
        self.pool = np.concatenate([self.pool, ids])

    def forget(self, keep: np.ndarray) -> None:
        """Keeps the known units at the places ``keep`` only."""
        first, size = self.first[keep], self.size[keep]
        new_first = np.cumsum(size) - size
        self.pool = self.pool[np.repeat(first - new_first, size) + np.arange(size.sum())]
        self.keys, self.first, self.size = self.keys[keep], new_first, size

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a slice."""
        raw = data.tobytes()
        starts, ends, odd = units(raw, offsets)
        if not len(starts):
            return [np.zeros(0, "<u4")] * (len(offsets) - 1)
        h = textops.span_hashes(data, starts, ends, nocase=True)
        if odd.any():
            h[odd] = textops.span_hashes(data, starts[odd], ends[odd]) + np.uint64(1)
        which, own = pd.factorize(h, sort=True)
        at, known = self.find(own)
        if len(self.keys) + len(own) - known.sum() > KEPT:
            self.forget(at[known])
        if not known.all():
            example = np.empty(len(own), np.int64)
            example[which] = np.arange(len(which))
            new = np.flatnonzero(~known)
            place, is_odd = example[new], odd[example[new]]
            folded = raw.lower()
            for encode, text, part in ((self.encode_plain, folded, ~is_odd), (self.encode_each, raw, is_odd)):
                if part.any():
                    spans = place[part]
                    self.learn(own[new[part]], *encode([text[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist())]))
        at = np.searchsorted(self.keys, own)[which]
        n = self.size[at]
        places = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.first[at] - places[:-1], n) + np.arange(places[-1])]
        edges = places[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
