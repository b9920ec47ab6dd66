"""Token ids of texts, for the public tokenizer ``word_bpe_49k.json``.

Its pre-tokenizer drops white space, so it never joins what a space or line
feed separates: a text's ids are those of its pieces between them, one after
the other. Each distinct piece is encoded once and its ids are kept; texts are
put together with numpy. Plain Latin characters are cut, as the tokenizer does
after lower-casing, into words, digits and punctuation, and these parts are kept:
of a text of nothing else right away, of other texts a piece at a time; a piece
that is not plain goes to the library as it is. What is kept is bounded: past
``MOST`` entries it is dropped.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

MOST = 600_000
JOINED = 256
END = 1  # closes every document

# Characters that normalisation changes by lower-casing only, none of them
# white space. The tokenizer's pattern, with the letters and
# numbers that Latin-1 has.
PLAIN = re.compile("[!-~\u00a1-\u00ff]+")
LETTERS = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS} \n]+")
PLAIN_TEXT = re.compile("[ \n!-~\u00a1-\u00ff]*")


class _Numbers(dict):
    """Numbers strings in the order in which they are first looked up."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new


class _Rows:
    """Rows of ids of any length."""

    def __init__(self, dtype):
        self.lengths, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, dtype)

    def append(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of the given rows, one after the other."""
        n = self.lengths[rows]
        at = np.cumsum(n) - n
        return n, self.ids[np.repeat(self.starts[rows] - at, n) + np.arange(int(n.sum()))]


class WordTokenizer:
    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # strings of special tokens that occur in a text are then ordinary text
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.parts = _Numbers(), _Numbers()
        self.piece_ids, self.part_ids = _Rows(self.dtype), _Rows(self.dtype)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per part, ids of all parts). Plain parts are words to the
        library and go to it many at a time."""
        single = np.array([not PLAIN.fullmatch(p) or "<|" in p for p in parts], bool)
        words = np.flatnonzero(~single)
        lengths = np.zeros(len(parts), np.int64)
        joined = [" ".join([parts[i] for i in words[a:a + JOINED].tolist()]) for a in range(0, len(words), JOINED)]
        found = self.tokenizer.encode_batch(joined, add_special_tokens=False)
        for k, e in enumerate(found):
            own = words[k * JOINED:(k + 1) * JOINED]
            lengths[own] = np.bincount(np.array(e.word_ids, np.int64), minlength=len(own))
        ids = np.fromiter(chain.from_iterable([e.ids for e in found]), self.dtype)
        others = np.flatnonzero(single).tolist()
        if not others:
            return lengths, ids
        rows = np.split(ids, np.cumsum(lengths)[:-1])
        for i in others:
            rows[i] = np.array(self.tokenizer.encode(parts[i], add_special_tokens=False).ids, self.dtype)
            lengths[i] = len(rows[i])
        return lengths, np.concatenate(rows)

    def rest(self) -> None:
        """To call when a task ends: a large store of pieces is dropped, as
        the worker may do other work next."""
        if len(self.pieces) + len(self.parts) > MOST // 8:
            self._forget()

    def _learn(self) -> None:
        new = self.pieces.take_new()
        look, plain, cut = self.parts.__getitem__, PLAIN.fullmatch, PARTS.findall
        cuts = [[look(x) for x in cut(p.lower())] if plain(p) and "<|" not in p else [look(p)] if p else []
                for p in new]
        parts = self.parts.take_new()
        if parts:
            self.part_ids.append(*self._encode(parts))
        if new:
            counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
            lengths, ids = self.part_ids.take(np.fromiter(chain.from_iterable(cuts), np.int64))
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
            self.piece_ids.append(np.diff(ends), ids)

    def _rows(self, texts: list[str]) -> list[tuple[bool, np.ndarray]]:
        """Per text whether it is cut into parts right away, and the numbers
        of its parts or else of its pieces."""
        piece, part, plain, cut = self.pieces.__getitem__, self.parts.__getitem__, PLAIN_TEXT.fullmatch, PARTS.findall
        out = []
        for t in texts:
            whole = plain(t) is not None and "<|" not in t
            found = cut(t.lower()) if whole else t.replace("\n", " ").split(" ")
            out.append((whole, np.fromiter(map(part if whole else piece, found), np.int64, len(found))))
        return out

    def encode(self, texts: list[str], end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets); each text is
        followed by ``end`` unless that is None."""
        if len(self.pieces) + len(self.parts) > MOST:
            self._forget()
        rows = self._rows(texts)
        self._learn()
        sizes, order, found = [], [], []
        for whole, table in ((True, self.part_ids), (False, self.piece_ids)):
            own = [i for i, r in enumerate(rows) if r[0] is whole]
            if own:
                n, ids = table.take(np.concatenate([rows[i][1] for i in own]))
                ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum([len(rows[i][1]) for i in own])])]
                order += own
                sizes.append(np.diff(ends))
                found.append(ids)
        flat = np.concatenate(found) if found else np.zeros(0, self.dtype)
        size = np.zeros(len(texts), np.int64)
        size[order] = np.concatenate(sizes) if sizes else 0
        if len(found) > 1:  # back into the order of the texts
            begin = np.zeros(len(texts), np.int64)
            begin[order] = np.concatenate([[0], np.cumsum(size[order])[:-1]])
            at = np.cumsum(size) - size
            flat = flat[np.repeat(begin - at, size) + np.arange(int(size.sum()))]
        ends = np.concatenate([[0], np.cumsum(size)])
        if end is None:
            return flat, ends
        return np.insert(flat, ends[1:], end), ends + np.arange(len(ends))


_loaded: dict[tuple, WordTokenizer] = {}


def load(path: str, special_as_text: bool = False) -> WordTokenizer:
    """The tokenizer of this worker, loaded once."""
    key = path, special_as_text
    if key not in _loaded:
        _loaded[key] = WordTokenizer(*key)
    return _loaded[key]
