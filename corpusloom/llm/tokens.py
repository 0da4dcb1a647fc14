"""Token ids of whole texts, from a vocabulary file, with memory for the ids of words already seen."""

from __future__ import annotations

import os
import re

import numpy as np

#: White space that str.split() and the tokenizer may judge differently, or that isn't a plain blank.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_encoders: dict = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Signs that the tokenizer splits from the letters before them, one sign being one word of its own.
_SIGNS = frozenset(".,;:!?")


class WordEncoder:
    """Encodes texts whose tokenizer lower-cases, drops white space and never joins words across it (a BPE with word ends).

    Each blank-free run is encoded once and kept in one of two generations of at most `keep` runs each, so memory stays
    bounded whatever the number of different words. Runs of Latin letters go through the tokenizer many at a time, as one
    text, whose ids are cut after each token that ends a word; a sign after such a run is a word of its own. All other runs
    are encoded alone. Texts with unusual white space, with letters whose lower case depends on the place, or that hold a token
added to the vocabulary (such as <|endoftext|>, to which the tokenizer gives its own id wherever it stands) are encoded as a whole.
    Ids are 16-bit where the vocabulary allows.
    """

    def __init__(self, path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Lowercase()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.signs = {sign: self._alone([sign])[0] for sign in _SIGNS}
        self.keep, self.young, self.old = keep, {}, {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of runs of Latin letters."""
        out = []
        joined = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)]
        for i, e in enumerate(self.letters.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * self.dtype.itemsize
            part, raw = words[i * 200 : i * 200 + 200], ids.tobytes()
            starts = [0, *ends.tolist()]
            out += [raw[a:b] for a, b in zip(starts, starts[1:])] if len(ends) == len(part) else self._alone(part)
        return out

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of runs that are not in the young generation."""
        found, plain, signed, rest = {}, set(), [], []
        for w in missing:
            if (ids := self.old.get(w)) is not None:
                found[w] = ids
            elif w.isalpha() and max(w) < "\u0250":
                plain.add(w)
            elif w[-1] in _SIGNS and (base := w[:-1]).isalpha() and max(base) < "\u0250":
                signed.append((w, base))
                if base not in self.young and base not in missing:
                    plain.add(base)
            else:
                rest.append(w)
        plain = list(plain)
        found.update(zip(plain, self._together(plain)))
        for at in range(0, len(rest), 20_000):
            found.update(zip(rest[at : at + 20_000], self._alone(rest[at : at + 20_000])))
        for w, base in signed:
            found[w] = (found.get(base) or self.young[base]) + self.signs[w[-1]]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of self.dtype."""
        runs, every = [], []
        for t in texts:
            odd = not t.isascii() and (_ODD_SPACE.search(t) or "\u03a3" in t or "\u0130" in t) or not t.isprintable() and _ODD_SPACE.search(t)
            low = t.lower()
            odd = odd or any(x in low for x in self.added)
            runs.append(None if odd else len(words := low.split()))
            if not odd:
                every += words
        ids = list(map(self.young.get, every))
        holes = [i for i, v in enumerate(ids) if v is None]
        learnt = self._learn({every[i] for i in holes})
        for i in holes:
            ids[i] = learnt[every[i]]
        if len(self.young) + len(learnt) > self.keep:
            self.old, self.young = self.young, {}
        self.young.update(learnt)
        out, at = [], 0
        for t, n in zip(texts, runs):
            out.append(self._alone([t])[0] if n is None else b"".join(ids[at : at + n]))
            at += n or 0
        return out


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def text_runs(texts: list[str], most_chars: int = 1_000_000):
    """(first, last) of runs of texts with about most_chars characters."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most_chars:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
