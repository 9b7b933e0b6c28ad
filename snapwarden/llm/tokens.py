"""Batch token encoding with a word memory.

The tokenizer of ``word_bpe_49k.json`` turns each run of white space into a separator that it then drops, so the ids of a
text are the ids of its words one after another. A batch is therefore split into words in Arrow, each distinct word is
encoded once, and the ids or lengths are gathered by number. Other tokenizers encode whole texts.
"""

from __future__ import annotations

import gc
import json
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from snapwarden.llm.words import safe_pieces, split_words

#: Fixed value: the pre-tokenizer pattern under which a white-space character never belongs to a token.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words of these letters are one piece for the pre-tokenizer; their lower case is the same in all libraries.
_PLAIN = "^[a-zA-ZÀ-ÖØ-öø-ÿ]+$"
_ODD = frozenset("ªºµ")


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones as they are, the rest from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts, exactly as the library gives them without begin, end or added special tokens."""

    def __init__(self, path: str | None = None, memory: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.memory = path or default_path(), memory
        self.by_word = False
        if self.path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=self.path)
            self.size = piece.get_piece_size()
            self.whole = lambda texts: piece.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.size = self.library.get_vocab_size()
            self.whole = lambda texts: [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
            with open(self.path, encoding="utf-8") as f:
                head, model, rest = f.read().partition('"model"')
            said = json.loads(f'{head.rstrip().rstrip(",")}}}') | {"model": {"end_of_word_suffix": "</w>" if re.search(r'"end_of_word_suffix":\s*"</w>"', rest[:2000]) else None}}
            del head, model, rest  # the vocabulary as Python objects would be large
            steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
            self.by_word = steps[0].get("pattern") == {"Regex": _SPLIT} and bool(steps[0].get("invert")) and said["model"].get("end_of_word_suffix") == "</w>"
            alphabet = _byte_alphabet()
            self.hidden = {b: alphabet[b] for b in range(128, 256) if alphabet[b] != chr(b)}
            self.special = any("<" in t["content"] for t in said.get("added_tokens", []))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _one(self, core: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(core if core.isascii() else core.encode().decode("latin-1").translate(self.hidden))]

    def _learn(self, new: list[str]) -> None:
        """Keys are lower-case words of plain letters, which the model takes as they are, or any other words, which go through the library."""
        plain = [w.isalpha() and (w.isascii() or max(w) < "Ā") and w == w.lower() and not _ODD.intersection(w) for w in new]
        others = iter(self.whole([w for w, p in zip(new, plain, strict=True) if not p]) if not all(plain) else ())
        found = [self._one(w) if p else next(others) for w, p in zip(new, plain, strict=True)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        starts = len(self.store) + np.cumsum(lengths) - lengths
        self.store = np.concatenate([self.store, np.fromiter((x for ids in found for x in ids), np.uint32, int(lengths.sum()))])
        self.known.update(zip(new, range(len(self.lengths), len(self.lengths) + len(new)), strict=True))
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def _numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each word two numbers in the memory, of its letters and of the punctuation behind them; the texts' offsets in words."""
        if not (self.special and pc.any(pc.match_substring(texts, "<|")).as_py()):
            texts = pc.ascii_lower(texts)  # the normaliser does this too, but only outside special strings
        flat, offsets = split_words(texts)
        if not len(flat):
            return np.zeros(0, np.int64), offsets
        coded = flat.dictionary_encode()
        words = coded.dictionary
        cores = pc.ascii_rtrim(words, string.punctuation)
        plain = pc.match_substring_regex(cores, _PLAIN)
        cut = pc.utf8_length(cores).to_numpy(zero_copy_only=False)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        keys = pc.if_else(plain, pc.utf8_lower(cores), words).dictionary_encode()
        distinct = keys.dictionary.to_numpy(zero_copy_only=False).tolist()
        behind = np.flatnonzero((cut < size) & plain.to_numpy(zero_copy_only=False))
        ends = [w[c:] for w, c in zip(words.take(pa.array(behind)).to_numpy(zero_copy_only=False).tolist(), cut[behind].tolist(), strict=True)]
        wanted = ["", *set(ends), *distinct]
        new = [w for w in dict.fromkeys(wanted) if w not in self.known]
        if new and len(self.known) + len(new) > self.memory:
            self._forget()
            new = [*dict.fromkeys(wanted)]
        if new:
            collecting = gc.isenabled()
            gc.disable()  # hundreds of thousands of small lists are made here and none is garbage
            self._learn(new)
            if collecting:
                gc.enable()
        get = self.known.__getitem__
        pairs = np.full((len(words), 2), get(""), np.int64)
        pairs[:, 0] = np.fromiter(map(get, distinct), np.int64, len(distinct))[keys.indices.to_numpy()]
        pairs[behind, 1] = np.fromiter(map(get, ends), np.int64, len(ends))
        return pairs[coded.indices.to_numpy()].ravel(), 2 * offsets

    def counts(self, texts: pa.Array, piece: int = 4 << 20) -> np.ndarray:
        """Number of ids of each text; texts of over ``piece`` characters are cut between words first."""
        if not self.by_word:
            return np.array([len(x) for x in self.whole(texts.to_pylist())], np.int64)
        if len(texts) and pc.max(pc.binary_length(texts)).as_py() > piece:
            out = np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts.to_pylist()):
                out[i] = sum(int(self._count(pa.array([x]))[0]) for x in safe_pieces(text, piece))
            return out
        return self._count(texts)

    def _count(self, texts: pa.Array) -> np.ndarray:
        numbers, offsets = self._numbers(texts)
        total = np.concatenate([[0], np.cumsum(self.lengths[numbers])])
        return total[offsets[1:]] - total[offsets[:-1]]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and the texts' offsets into them."""
        if not self.by_word:
            found = self.whole(texts.to_pylist())
            ends = np.cumsum([0, *map(len, found)])
            return np.fromiter((x for ids in found for x in ids), np.uint32, int(ends[-1])), ends
        numbers, offsets = self._numbers(texts)
        lengths = self.lengths[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat((self.starts[numbers] - ends[:-1]).astype(np.int32), lengths)
        at += np.arange(ends[-1], dtype=np.int32)  # a batch and the memory have far fewer than 2**31 ids
        return self.store[at], ends[offsets]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each path in a Python worker; its memory serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
