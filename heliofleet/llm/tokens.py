"""Token ids of whole texts in a task, by a public tokenizer's file.

A tokenizer that drops white space and works word by word gives a word the same ids wherever it
stands, so each distinct word of a block is encoded once and kept for later blocks, as a whole or
as letters with a punctuation tail. The kept words are bounded; a full store starts afresh.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from heliofleet.llm.words import split_words

KEPT_WORDS = 200_000
_TAILED = re.compile(r"([^\W\d_]+)([!#$%&*+,\-./:;=?@^~()\[\]{}]*)")
_LOADED: dict = {}


class WordTokenizer:
    """Ids of words under a BPE tokenizer with word ends (``</w>``)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, stems: list[str], others: list[str]) -> None:
        if stems:
            ids = self._ids(" ".join(stems))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(stems):
                start = 0
                for stem, stop in zip(stems, cuts.tolist()):
                    self.known[stem] = ids[start:stop].tobytes()
                    start = stop
            else:
                others = others + stems
        if others:
            for word, got in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
                self.known[word] = np.array(got.ids, np.uint32).tobytes()

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each distinct word, as bytes of unsigned 32-bit numbers."""
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known, parts, stems, others = self.known, [], {}, {}
        for word in words:
            if word in known:
                parts.append((word, ""))
                continue
            match = _TAILED.fullmatch(word)
            stem, tail = match.groups() if match else (word, "")
            if match and stem.isalpha():
                if stem.isascii():
                    stem = stem.lower()
                if stem not in known:
                    stems[stem] = None
                if tail and tail not in known:
                    others[tail] = None
            else:
                stem, tail = word, ""
                others[word] = None
            parts.append((stem, tail))
        self._learn(list(stems), list(others))
        return [known[stem] + known[tail] if tail else known[stem] for stem, tail in parts]


def tokenizer_for(path: str) -> WordTokenizer:
    """One tokenizer per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def token_ids(texts: pa.Array, path: str):
    """(flat ids, starts) of the texts; a null text has none."""
    words = split_words(texts, lower=False)
    pieces = tokenizer_for(path).encode(words.vocab.to_pylist())
    sizes = np.fromiter((len(p) // 4 for p in pieces), np.int64, len(pieces))
    table = np.frombuffer(b"".join(pieces), np.uint32)
    base = np.concatenate([[0], np.cumsum(sizes)])
    counts = sizes[words.codes]
    ends = np.concatenate([[0], np.cumsum(counts)])
    flat = table[np.repeat(base[words.codes] - ends[:-1], counts) + np.arange(ends[-1])]
    return flat, ends[words.starts]
