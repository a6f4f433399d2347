"""Whole-text encoding by a public tokenizer, each distinct word of a batch of texts encoded once.

Both vocabularies split a text into words before any merge, so a word's ids do not depend on its neighbours. The texts of
a batch are cut at blanks and line ends, their words dictionary-encoded by Arrow, each distinct word is encoded by the
`tokenizers` library, and ids are gathered by numpy. Any text for which a cut at blanks could change a boundary (runs of
white space, blanks at the end, strings of special tokens) is encoded whole by the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words and ids that a worker remembers; beyond it the memory starts anew, results do not change.
MEMORY_BYTES = 24 << 20
#: Longer words (in bytes) are not remembered.
LONGEST = 64
#: Characters that are cut and gathered at a time.
GROUP_CHARS = 2_000_000
_LATIN_END = "ɐ"
_ENCODERS: dict[tuple, "Encoder"] = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.spaced = spaced  # blanks belong to the following word
        self.letters = _byte_letters()
        self.marks = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        # slots that follow the words of a batch: nothing, a full stop, a comma, a line end
        self.fixed = [b"", self._ids("."), self._ids(","), self._ids("\n") if spaced else b""]
        self.forget()

    def forget(self) -> None:
        """Start the memory anew: words, how many ids each has (-1: its text must be encoded whole), and these ids in a row."""
        self.words = pa.array([], pa.large_string())
        self.sizes, self.values = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A run of Latin letters, with its blank: one word of the model, unless normalising leaves other than letters."""
        given, plain = word, word.isascii()
        if self.normalizer is not None:
            word = word.lower() if plain else self.normalizer.normalize_str(word)
            if not plain and not word.isalpha():
                return self._ids(given)
        if plain:
            spelled = "Ġ" + word[1:] if word[0] == " " else word
        else:
            letters = self.letters
            spelled = "".join([letters[b] for b in word.encode()])
        return pack("<%dI" % len(found), *[t.id for t in found]) if (found := self.model.tokenize(spelled)) else b""

    def _fresh(self, word: str) -> bytes | None:
        """Ids of a stretch without blanks or line ends, but for a leading blank; None where its text must be encoded whole."""
        stem = word[1:] if word[0] == " " else word
        if stem.isalpha() and (stem.isascii() or max(stem) < _LATIN_END):
            return self._word(word)
        if any(mark in stem for mark in self.marks) or not self.spaced and "Σ" in stem:  # its lower case depends on what follows
            return None
        if self.spaced and (stem[0].isspace() or stem[-1].isspace()):
            return None
        return self._ids(word)

    def _slots(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot of each distinct word, and the sizes and ids of all slots."""
        slots = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(slots < 0)
        added = words.take(pa.array(new))
        found = [self._fresh(word) for word in added.to_pylist()]
        slots[new] = len(self.sizes) + np.arange(len(new))
        sizes = np.concatenate([self.sizes, np.array([-1 if x is None else len(x) // 4 for x in found], np.int64)])
        values = np.concatenate([self.values, np.frombuffer(b"".join(x for x in found if x), "<u4")])
        if (pc.max(pc.binary_length(added)).as_py() or 0) <= LONGEST:
            self.words, self.sizes, self.values = pa.concat_arrays([self.words, added]), sizes, values
            if self.words.nbytes + values.nbytes + sizes.nbytes > MEMORY_BYTES:
                self._keep(words, slots)
        return slots, sizes, values

    def _keep(self, words: pa.Array, slots: np.ndarray) -> None:
        """Start the memory anew with the words of one batch, if they take half of it at most."""
        each, begin = np.maximum(self.sizes, 0), np.cumsum(np.maximum(self.sizes, 0)) - np.maximum(self.sizes, 0)
        each, begin = each[slots], begin[slots]
        stops = np.cumsum(each)
        values = self.values[np.repeat(begin - stops + each, each) + np.arange(int(stops[-1]))]
        self.words, self.sizes, self.values = words, self.sizes[slots], values
        if words.nbytes + values.nbytes + 8 * len(slots) > MEMORY_BYTES // 2:
            self.forget()

    def _gathered(self, texts: list[str], first: bool = True) -> list[memoryview | None]:
        """Ids of each text; None where one must be encoded whole. Not `first`: a later stretch of a text, from a blank on."""
        column = pa.array(texts, pa.large_string())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
        size = int(bounds[-1])
        if not size:
            return [memoryview(b"")] * len(texts)
        data = np.frombuffer(column.buffers()[2], np.uint8)[:size]
        edge = np.zeros(size + 1, bool)
        edge[bounds] = True
        white = (data == 32) | (data == 10)
        after, before = edge[1:].copy(), edge[:-1].copy()
        after[:-1] |= white[1:]
        before[1:] |= white[:-1]
        starts, ends = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
        whole = np.zeros(len(texts), bool)
        text_of = lambda at: np.searchsorted(bounds, at, "right") - 1
        if self.spaced:
            whole[text_of(np.flatnonzero(white & after))] = True  # white space before white space or at the end
            if first:
                heads = bounds[:-1][bounds[:-1] < bounds[1:]]
                whole[text_of(heads[white[heads]])] = True
        if not len(starts):
            return [None if w else memoryview(b"") for w in whole.tolist()]
        text = text_of(starts)
        last, inner = data[ends - 1], data[np.maximum(ends - 2, 0)] & 223
        cut = (ends - starts > 1) & ((last == 46) | (last == 44)) & (inner > 64) & (inner < 91)  # a mark behind a letter
        lead = np.where(starts > bounds[text], data[np.maximum(starts - 1, 0)], 0)
        spans = np.stack([starts - (lead == 32) * self.spaced, ends - cut], 1).ravel()
        spread = pa.LargeStringArray.from_buffers(len(spans) - 1, pa.py_buffer(spans), column.buffers()[2])
        coded = spread.take(pa.array(np.arange(0, len(spans) - 1, 2))).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        slots, sizes, values = self._slots(coded.dictionary)
        base, own = len(sizes), slots[codes]
        whole[text[sizes[own] < 0]] = True
        sizes = np.concatenate([np.maximum(sizes, 0), [len(x) // 4 for x in self.fixed]])
        values = np.concatenate([values, np.frombuffer(b"".join(self.fixed), "<u4")])
        begin = np.cumsum(sizes) - sizes
        order = np.stack([np.where(lead == 10, base + 3, base), own, base + cut * (1 + (last == 44))], 1).ravel()
        each = sizes[order]
        stops = np.cumsum(each)
        ids = memoryview(values[np.repeat(begin[order] - stops + each, each) + np.arange(stops[-1])].tobytes())
        stops = np.concatenate([[0], stops[2::3]])
        cuts = (4 * stops[np.searchsorted(text, np.arange(len(texts) + 1))]).tolist()
        return [None if w else ids[a:b] for a, b, w in zip(cuts[:-1], cuts[1:], whole.tolist(), strict=True)]

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes | memoryview]:
        """Ids of each text in turn; null counts as empty."""
        group: list[str] = []
        size = 0

        def finish() -> Iterator[bytes | memoryview]:
            found = self._gathered(group) if group else []
            for text, ids in zip(group, found, strict=True):
                yield self._ids(text) if ids is None else ids

        for text in texts:
            text = text or ""
            if size + len(text) > GROUP_CHARS:
                yield from finish()
                group, size = [], 0
            if len(text) > GROUP_CHARS:
                yield self._long(text)
            else:
                group.append(text)
                size += len(text)
        yield from finish()

    def _long(self, text: str) -> bytes:
        """One very long text, stretch by stretch; each after the first begins with its blank."""
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + GROUP_CHARS)
            end = len(text) if end < 0 else end
            found = self._gathered([text[at:end]], at == 0)[0]
            if found is None:
                return self._ids(text)
            out.append(found)
            at = end
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Null counts as empty."""
        return bytes(next(iter(self.encode_many([text]))))


def encoder(path: str) -> Encoder:
    """One per worker and file. Byte-level vocabularies without a normaliser keep blanks with the word that follows."""
    key = (path, os.path.getmtime(path))
    if key not in _ENCODERS:
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _ENCODERS[key] = Encoder(path, spaced=spec.get("normalizer") is None)
    return _ENCODERS[key]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """Keys and texts (the first two columns) of many batches, GROUP_CHARS at a time: small batches would waste the memory."""
    keys, texts, chars = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys.append(key)
            texts.append(text.as_py())
            chars += len(texts[-1] or "") + 16
            if chars > GROUP_CHARS:
                yield keys, texts
                keys, texts, chars = [], [], 0
    if keys:
        yield keys, texts
