"""Encoding words with a public tokenizer whose tokens never hold white space.

Such a tokenizer gives a text the ids of its words, one after the other, so a
word needs to be encoded only once.  ``split_words`` cuts at ASCII white space
alone, which every such tokenizer drops; what else it treats as space stays
inside a word and is left to it.
"""

from __future__ import annotations

import numpy as np

#: Words whose ids an executor's Python worker remembers; twice as many at most.
REMEMBERED = 600_000

#: Punctuation that, after a letter or number, such a tokenizer encodes apart.
TAIL = b".,!?;:*%$&#|"


class WordEncoder:
    """Ids of single words, by the ``tokenizers`` library, from a tokenizer's file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        one = self._ids("Ab") + self._ids("c.")
        if any(self._ids(f"Ab{s}c.") != one for s in " \t\n\r\x0b\x0c"):
            raise ValueError("a table of words needs a tokenizer that drops white space")
        self.lower = self._ids("Ab") == self._ids("aB")
        self.tails = all(self._ids(w + p) == self._ids(w) + self._ids(p) for w in ("ab", "a1", "é") for p in (".", ",%", "***"))
        added = self.tokenizer.get_added_tokens_decoder()
        #: strings that the tokenizer looks for in the raw text; words that may hold one are left as they are
        self.marks = sorted({t.content[:2].encode() for t in added.values()})
        plain = [(i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.between = min(plain) if plain else None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def split_words(self, text: bytes) -> list[bytes]:
        """The text's words, lower-cased (A-Z) if the tokenizer does that itself."""
        if not self.lower:
            return text.split()
        if any(m in text for m in self.marks):
            return [w if any(m in w for m in self.marks) else w.lower() for w in text.split()]
        return text.lower().split()

    def cut(self, word: bytes) -> tuple[bytes, bytes]:
        """The word without the punctuation at its end, and that, where they can be encoded apart."""
        core = word.rstrip(TAIL)
        if not self.tails or not core or len(core) == len(word) or any(m in word for m in self.marks):
            return word, b""
        last = core[-1:].decode() if core[-1] < 128 else core[-4:].decode("utf-8", "ignore")[-1:]
        return (core, word[len(core) :]) if last.isalnum() else (word, b"")

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, as uint32. Many words are encoded as one text, a special token between them."""
        return [np.frombuffer(b, "<u4") for b in self.encode_bytes(words)]

    def encode_bytes(self, words: list[bytes]) -> list[bytes]:
        """The same as little-endian bytes."""
        out: list[bytes] = [b""] * len(words)
        if self.between:
            odd = [i for i, w in enumerate(words) if any(m in w for m in self.marks)]
        else:
            odd = list(range(len(words)))
        for i in odd:
            out[i] = np.array(self._ids(words[i].decode("utf-8", "replace")), "<u4").tobytes()
        if self.between and len(odd) < len(words):
            mark, string = self.between
            plain = words if not odd else [w for i, w in enumerate(words) if i not in set(odd)]
            separator = string.encode()
            found: list[bytes] = []
            for k in range(0, len(plain), 2000):
                text = separator.join(plain[k : k + 2000]).decode("utf-8", "replace")
                ids = np.array(self._ids(text), "<u4")
                cuts = (np.flatnonzero(ids == mark) * 4).tolist()
                raw = ids.tobytes()
                found += [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)])]
            if not odd:
                return found
            rest = iter(found)
            skip = set(odd)
            for i in range(len(words)):
                if i not in skip:
                    out[i] = next(rest)
        return out


class Remembering:
    """Little-endian uint32 bytes of words' ids; the last words asked for are kept, up to a bound."""

    def __init__(self, encoder: WordEncoder):
        self.encoder, self.now, self.before = encoder, {}, {}

    def ids(self, words: list[bytes]) -> bytes:
        now, before = self.now, self.before
        new = []
        for w in set(words).difference(now):
            if w in before:
                now[w] = before[w]
            else:
                new.append(w)
        cuts = [self.encoder.cut(w) for w in new]
        parts = [p for p in {p for c in cuts for p in c if p} if p not in now]
        for p in parts:
            if p in before:
                now[p] = before[p]
        parts = [p for p in parts if p not in now]
        now.update(zip(parts, self.encoder.encode_bytes(parts)))
        now.update((w, now[core] + now[tail]) for w, (core, tail) in zip(new, cuts) if tail)
        out = b"".join(map(now.__getitem__, words))
        if len(now) > REMEMBERED:
            self.before, self.now = now, {}
        return out


_ENCODERS: dict[str, Remembering] = {}


def remembering(path: str) -> Remembering:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Remembering(WordEncoder(path))
    return _ENCODERS[path]
