"""Encoding of whole texts with public vocabularies, piece by piece through a bounded cache.

Both vocabularies split a text before merging, and a split never crosses the piece borders used
here (ASCII white space for word vocabularies; a space after a non-space character for
byte-level ones). So the ids of a text are those of its pieces in order, and a piece that has
been seen is not encoded again. All pieces, however rare or long, are encoded by the tokenizers
library; the cache only spares repetitions.

A text that may hold one of the vocabulary's special tokens (`<|endoftext|>` and the like) is
one piece: the library finds these tokens before it splits a text, and gives them their own ids.
"""
from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_BYTES = 160 << 20
LOT = 128
_PIECES = re.compile(r"(?<=\S)(?= )")
#: A run of these behind letters is a unit of its own in both vocabularies; an apostrophe may belong to letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TWO_SPACES = re.compile(r"\s\s")


def word_pieces(text: str) -> list:
    """White space and the case of ASCII letters are gone; the word vocabulary ignores both."""
    return text.encode("utf-8").lower().split()


def spaced_pieces(text: str) -> list:
    """Pieces that start at a space which follows a non-space character; a lone line feed is a piece."""
    if _TWO_SPACES.search(text) is not None:
        return _PIECES.split(text)
    out: list = []
    for i, line in enumerate(text.split("\n")):
        if i:
            out.append("\n")
        head, *rest = line.split(" ")
        if head:
            out.append(head)
        out += [" " + x for x in rest]
    return out


def lots(texts: pa.Array, rows: int = 512, room: int = 1 << 22):
    """(first, number) of the texts to encode at once: so many rows at most, and so many bytes, but one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, "right"))
        end = min(at + rows, max(at + 1, most))
        yield at, end - at
        at = end


class Rows(dict):
    """Row number by piece; new pieces get the next number and are noted."""

    def __init__(self):
        super().__init__()
        self.todo: list = []

    def __missing__(self, piece) -> int:
        self.todo.append(piece)
        i = self[piece] = len(self)
        return i

    def noted(self) -> list:
        """The new pieces since the last call."""
        new, self.todo = self.todo, []
        return new


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype), 0

    def room(self, n: int) -> np.ndarray:
        """The data, with room for n entries in all."""
        if n > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(n - len(self.data), len(self.data)), self.data.dtype)])
        self.n = max(self.n, n)
        return self.data

    def extend(self, values: np.ndarray) -> int:
        at = self.n
        self.room(at + len(values))[at : at + len(values)] = values
        return at


class Encoder:
    """ids of texts as 16-bit numbers; both vocabularies have fewer than 65536 ids.

    A piece's ids are flat[first : first + size] of its row; row 0 is the end of a document.
    """

    def __init__(self, path: str, words: bool, end: int, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words, self.end, self.cache_bytes = words, end, cache_bytes
        # What every special token's string holds, so that a search for it finds all texts with one.
        self.special = os.path.commonprefix([t.content for t in self.library.get_added_tokens_decoder().values()])
        self.marks = np.zeros(65536, bool)
        for piece, i in self.library.get_vocab().items():
            self.marks[i] = piece.endswith("</w>") if words else piece.startswith("Ġ")
        self.reset()

    def cut(self, text: str) -> list:
        if self.special and self.special in text:
            return [text.encode("utf-8") if self.words else text]
        return word_pieces(text) if self.words else spaced_pieces(text)

    def reset(self) -> None:
        self.rows = Rows()
        self.rows[None] = 0
        self.first, self.size, self.flat = Grown(np.int64), Grown(np.int32), Grown(np.uint16)
        self.room = self.cache_bytes
        self._put(np.array([0]), np.array([1]), np.array([self.end]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with the end id; number of ids by text)."""
        cuts = [self.cut(t) if t else [] for t in texts]
        for c in cuts:
            c.append(None)
        counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(cuts)), np.int64, int(counts.sum()))
        self._learn_noted()
        ids, sizes = self._gather(rows)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        if self.room < 0:
            self.reset()
        return ids, np.diff(ends, prepend=0)

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size.data[rows].astype(np.int64)
        at = np.repeat(self.first.data[rows] - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.flat.data[at], sizes

    def _put(self, rows: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """ids of the rows, one row after another."""
        top = int(rows.max(initial=-1)) + 1
        at = self.flat.extend(ids)
        self.first.room(top)[rows] = at + np.cumsum(sizes) - sizes
        self.size.room(top)[rows] = sizes
        self.room -= 2 * len(ids)

    def _learn_noted(self) -> None:
        new = self.rows.todo
        if not new:
            return
        base = len(self.rows) - len(new)
        self.rows.todo = []
        text = [x.decode("utf-8") for x in new] if self.words else new
        self.room -= 200 * len(new) + sum(map(len, new))
        plain, rest, marked, tails = [], [], [], []
        for i, t in enumerate(text):
            body = t if self.words or t[:1] != " " else t[1:]
            if (self.words or body is not t) and len(t) < 64:
                if body.isalpha():
                    plain.append(i)
                    continue
                head = body.rstrip(_MARKS)
                if head.isalpha():
                    marked.append(i)  # a word and the marks behind it are split before merging
                    tails.append(len(head) - len(body))
                    continue
            rest.append(i)
        # Plain words go to the library many at a time, as one text, whose ids fall into words again
        # by the vocabulary's own mark of a word's end or beginning.
        lots = [plain[i : i + LOT] for i in range(0, len(plain), LOT)]
        glue = " " if self.words else ""
        for lot, e in zip(lots, self.library.encode_batch_fast([glue.join([text[i] for i in lot]) for lot in lots], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint16)
            at = np.flatnonzero(self.marks[ids])
            if len(at) != len(lot):  # a word that isn't one unit after normalisation
                rest += lot
                continue
            sizes = np.diff(at, prepend=-1) if self.words else np.diff(at, append=len(ids))
            self._put(base + np.array(lot), sizes, ids)
        if rest:
            found = [e.ids for e in self.library.encode_batch_fast([text[i] for i in rest], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._put(base + np.array(rest), sizes, np.fromiter(chain.from_iterable(found), np.uint16, int(sizes.sum())))
        if marked:
            look = self.rows.__getitem__
            parts = np.array([(look(new[i][:k]), look(new[i][k:])) for i, k in zip(marked, tails)])
            self._learn_noted()
            ids, sizes = self._gather(parts.ravel())
            self._put(base + np.array(marked), sizes.reshape(-1, 2).sum(1), ids)


_ENCODERS: dict = {}


def encoder(path: str, words: bool, end: int, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """One encoder for each worker process, vocabulary and size of its cache, on which no id depends."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = path, words, end, cache_bytes
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
