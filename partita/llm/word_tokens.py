"""Token ids of whole texts from a tokenizer file whose pre-tokens never cross white space."""

from __future__ import annotations

import re
from itertools import filterfalse

import numpy as np

_BLANKS = re.compile("[ \t\n\r\x0b\x0c]+")
_MARKS = ".,;:!?|\"()*$%&#"


def words_of(text: str) -> list[str]:
    """Parts between white space. str.split() also cuts at four control characters that are no white space to the tokenizer."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [w for w in _BLANKS.split(text) if w]
    return text.split()


class WordEncoder:
    """Encodes texts word by word; up to `room` words and stems are remembered, the others are encoded once a batch.

    Ids are little-endian unsigned 32-bit bytes, so a text's ids are the joined bytes of its words. A word of Latin
    letters and then marks is two pre-tokens, of which the letters are looked up by themselves: lower-cased
    precomposed letters pass the file's normaliser and its pattern unchanged, so the file's model can read many of
    them in one call, where the word-end suffix tells them apart. Other words go through the whole tokenizer.
    """

    def __init__(self, path: str, room: int = 200_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.room, self.kept, self.stems, self.tails = room, {}, {}, {"": b""}
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        probe = ["it", "élan", "words", "größe"]
        both = [self._whole(w) for w in probe]
        self.lean = bool(suffix) and self._letters(probe) == both and self._whole("Élan WORDS, größe") == both[1] + both[2] + self._whole(",") + both[3]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, words: list[str]) -> list[bytes] | None:
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *at], at, strict=False)] if len(at) == len(words) and at[-1] == len(raw) else None

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of these words into `kept`, and those of their stems into `stems`."""
        kept, stems, tails = self.kept, self.stems, self.tails
        lows = [w.lower() for w in words]
        cut = [x.rstrip(_MARKS) for x in lows]
        simple = [self.lean and x.isalpha() and (x.isascii() or max(x) < "\u0250") for x in cut]
        some = list(dict.fromkeys(x for x, ok in zip(cut, simple, strict=True) if ok and x not in stems))
        for at in range(0, len(some), 5000):
            part = some[at : at + 5000]
            stems.update(zip(part, self._letters(part) or [self._whole(x) for x in part], strict=True))
        for w, low, stem, ok in zip(words, lows, cut, simple, strict=True):
            if not ok:
                kept[w] = self._whole(w)
            elif len(stem) == len(low):
                kept[w] = stems[stem]
            else:
                tail = low[len(stem) :]
                if tail not in tails:
                    tails[tail] = self._whole(tail)
                kept[w] = stems[stem] + tails[tail]
        for x in some[max(0, len(some) - max(0, len(stems) - self.room)) :]:
            del stems[x]
        if len(tails) > 10_000:
            self.tails = {"": b""}

    def encode_many(self, texts: list[list[str]]) -> list[bytes]:
        """The joined ids of each list of words."""
        kept, new = self.kept, set()
        for words in texts:
            new.update(filterfalse(kept.__contains__, words))
        missing = list(new)
        self._learn(missing)
        out = [b"".join(map(kept.__getitem__, words)) for words in texts]
        for w in missing[max(0, len(missing) - max(0, len(kept) - self.room)) :]:
            del kept[w]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
