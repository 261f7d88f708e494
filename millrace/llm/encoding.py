"""Fast exact encoding with the word-level BPE vocabulary, shared by the binary writer and the packer.

The vocabulary's pre-tokenizer never lets a token cross white space and its normalizer works on single characters (and
combining runs, which white space ends), so a text's ids are the ids of its white-space separated chunks in order. Nor
does a token hold both letters and marks, so a chunk of letters with marks behind it is encoded as both in turn, if its
normalized form, too, is letters alone: a dotted capital I, say, ends in a combining dot, which joins the marks.

Arrow splits texts and numbers their different chunks; only those are looked up, and NumPy puts their ids in the texts'
order. Words not met before are encoded by the tokenizers library many at a time, as one text, whose word numbers give each
word its ids (one by one where the numbers do not fit the words); a worker remembers them.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterable, Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import tokenizer_path

VOCABULARY = "word_bpe_49k.json"
#: Chunks in each of a worker's two memories: a full one becomes the older one, of which what is met again is kept.
MEMORY = 400_000
#: Bytes of texts that are looked up together, and words in one call.
_TOGETHER, _WORDS = 2 << 20, 1000
_MARKS = string.punctuation.encode()


def _letters(word: bytes) -> bool:
    """Whether a word is letters alone, before and after it is normalized."""
    return word.isalpha() or ((own := word.decode()).isalpha() and normalize("NFC", own).lower().isalpha())


class _Vocabulary:
    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk."""
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        out = list(map(self.known.get, chunks))
        missing = [i for i, own in enumerate(out) if own is None]
        self.learn(self._new({chunks[i] for i in missing}))
        for i in missing:
            out[i] = self.known[chunks[i]]
        return out

    def _new(self, chunks: set[bytes]) -> set[bytes]:
        """Those that no memory has; what the older one has moves to the newer."""
        again = {c: self.older[c] for c in chunks if c in self.older}
        self.known.update(again)
        return chunks.difference(self.known)

    def _one(self, chunk: bytes) -> bytes:
        return np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u2").tobytes()

    def _words(self, words: list[bytes]) -> None:
        """Learn words of letters alone: each is one word of the pre-tokenizer, unless its lower case is not."""
        done = self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False)
        number = np.array(done.word_ids, np.int64)
        first = np.flatnonzero(np.diff(number, prepend=-1))
        if len(first) != len(words):
            self.known.update((w, self._one(w)) for w in words)
            return
        ids = np.array(done.ids, "<u2").tobytes()
        edge = [*(2 * first).tolist(), len(ids)]
        self.known.update((w, ids[edge[i] : edge[i + 1]]) for i, w in enumerate(words))

    def _plain(self, chunks: list[bytes]) -> None:
        """Learn ASCII chunks of any kind: what a token stands for begins within its chunk."""
        done = self.tokenizer.encode(b" ".join(chunks).decode(), add_special_tokens=False)
        begins = np.cumsum([0, *[len(c) + 1 for c in chunks[:-1]]])
        edge = (2 * np.searchsorted([a for a, _ in done.offsets], begins)).tolist()
        ids = np.array(done.ids, "<u2").tobytes()
        self.known.update((c, ids[a:b]) for c, a, b in zip(chunks, edge, [*edge[1:], len(ids)]))

    def learn(self, chunks: set[bytes]) -> None:
        known, parts, words, others = self.known, [], set(), []
        for chunk in chunks:
            word = chunk.rstrip(_MARKS)
            if not _letters(word):
                if chunk.isascii() and b"<|" not in chunk:
                    others.append(chunk)
                else:
                    known[chunk] = self._one(chunk)
                continue
            word = word.lower()
            words.add(word)
            if word != chunk:
                parts.append((chunk, word, chunk[len(word) :]))
        for at in range(0, len(others), _WORDS):
            self._plain(others[at : at + _WORDS])
        new = list(self._new(words))
        for at in range(0, len(new), _WORDS):
            self._words(new[at : at + _WORDS])
        for chunk, word, marks in parts:
            if marks and marks not in known:
                known[marks] = self._one(marks)
            known[chunk] = known[word] + known[marks] if marks else known[word]


_vocabularies: dict[str, _Vocabulary] = {}


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = done = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, done + _TOGETHER)) + 1
        yield texts.slice(at, to - at)
        at, done = to, ends[min(to, len(ends)) - 1]


def encoded(texts: Iterable[str | None] | pa.Array, vocabulary: str = VOCABULARY, end: int | None = None) -> Iterator[np.ndarray]:
    """An array of 16-bit ids for each text (null: empty), ending with the id `end` if given."""
    own = _vocabularies.get(vocabulary)
    if own is None:
        own = _vocabularies[vocabulary] = _Vocabulary(vocabulary)
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.large_string())
    tail = np.array([] if end is None else [end], "<u2")
    for group in _groups(texts.fill_null("")):
        split = pc.ascii_split_whitespace(group)
        coded = split.flatten().dictionary_encode()
        chunk = coded.indices.to_numpy()
        ids = own.ids(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        begin = np.cumsum(size) - size
        # Id k of the group is the one of its chunk that is as far behind the chunk's first as k is.
        sizes = size[chunk]
        before = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(begin[chunk] - before[:-1], sizes)
        place += np.arange(before[-1])
        flat = np.frombuffer(b"".join(ids), "<u2")[place]
        edge = before[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])].tolist()
        for a, b in zip(edge, edge[1:]):
            yield np.concatenate([flat[a:b], tail])


def encode(texts: Iterable[str | None] | pa.Array, vocabulary: str = VOCABULARY, end: int | None = None) -> list[np.ndarray]:
    """`encoded` as a list."""
    return list(encoded(texts, vocabulary, end))
