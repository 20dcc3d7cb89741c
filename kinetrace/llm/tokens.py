"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once per worker.

Texts whose characters keep to ASCII and the Latin letters up to U+017E, under the word-level vocabulary's own normaliser and
splitter, are split here by the same rules, and the library encodes each distinct piece once. Every other text, and every text
under another vocabulary, goes to the library whole. Both ways give the same ids.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np

# The pre-tokeniser pattern for which the word-wise way is right, and the same over the characters of SAFE in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = re.compile(r"[a-zß-öø-ž]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
SAFE = re.compile("[\t\n\r\x20-\x7eÀ-įı-ž]*")
#: Distinct words that a worker remembers before it starts anew; bounds memory, not results.
REMEMBER = 500_000
JOIN = 512


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern", {}).get("Regex") == PATTERN and splits[0].get("behavior") == "Removed" and spec.get("post_processor") is None
        # Ids that end a word, by which the ids of many words encoded at once are told apart.
        suffix, vocab = spec["model"].get("end_of_word_suffix"), self.library.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.by_word &= bool(suffix)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.library.get_vocab_size()
        # The same model, which both share, for words that are already normalised and split.
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """Starts anew, but for the words that came up three times or more."""
        often = [w for w, n in zip(self.words, self.uses.tolist(), strict=False) if n > 2] if self.words else []
        self.words = _Words()
        self.uses = np.zeros(1 << 14, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        if len(often) < REMEMBER // 2:
            for w in often:
                self.words[w]  # noqa: B018
            self.learn()

    def learn(self) -> None:
        """Encodes the words that came up for the first time."""
        if not (new := self.words.new):
            return
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast([" ".join(new[i : i + JOIN]) for i in range(0, len(new), JOIN)], add_special_tokens=False)), np.uint32)
        counts = np.diff(np.flatnonzero(self.last[flat]), prepend=-1)
        if len(counts) != len(new) or counts.sum() != len(flat):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        first, last = len(self.words) - len(new), len(self.words)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while last > len(self.start):
            self.start, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.uses))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[first:last] = self.used + np.cumsum(counts) - counts
        self.count[first:last] = counts
        self.used += len(flat)
        self.words.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and n + 1 bounds."""
        easy = [self.by_word and SAFE.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        split = [WORDS.findall(t.lower()) if e else [] for t, e in zip(texts, easy, strict=True)]
        if len(self.words) > REMEMBER:
            self.forget()
        of = self.words.__getitem__
        index = np.fromiter(map(of, chain.from_iterable(split)), np.int64)
        self.learn()
        self.uses[: len(self.words)] += np.bincount(index, minlength=len(self.words))
        counts = self.count[index]
        ends = np.cumsum(counts)
        flat = self.flat[np.repeat(self.start[index] - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        bounds = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(n_words)]]).astype(np.int64)
        if all(easy):
            return flat, bounds
        hard = [i for i, e in enumerate(easy) if not e]
        whole = dict(zip(hard, (e.ids for e in self.library.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False)), strict=True))
        rows = [np.asarray(whole[i], np.uint32) if i in whole else flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)

    def encode_ended(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, with the id ``end`` after each text."""
        flat, bounds = self.encode(texts)
        n = len(texts)
        out = np.full(len(flat) + n, end, np.uint32)
        new = bounds + np.arange(n + 1)
        keep = np.ones(len(out), bool)
        keep[new[1:] - 1] = False
        out[keep] = flat
        return out, new


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
