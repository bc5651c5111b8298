"""Byte-level BPE over Arrow batches through per-worker caches.

A space before anything but white space always starts a pre-token, so texts are cut there and the pieces (one
pre-token or a few) encoded apart with the same result. Equal pieces give equal ids: a worker encodes each distinct piece once,
over all tasks that it serves. Pieces with characters whose class may differ between regex libraries are encoded by the library itself, and texts that hold a
special string go to it whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: All that some library may take for white space; a space before one of these is no place to cut.
BLANK = " \t\n\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
#: Texts that can't be cut at each space; pieces that go to the library itself.
UNEVEN = f" [{BLANK}]"
ODD = re.compile("[ \x1c-\x1f\x85\xa0]|[^\x00-\u024f]")
_CUT = re.compile(f" (?=[^{BLANK}])")
# Fixed value: the byte-level pre-token pattern of these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a piece that is worth keeping.
LONGEST = 64


class Library:
    """The vocabulary of a .json file: whole texts by tokenizers, pieces by the same merges as ranks.

    Where ids aren't merge ranks (so that ranks can't stand for merges), pieces go to tokenizers too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", ())]
        self.ranked = self._ranked(spec)

    def text(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece with a space before it, and all their ids."""
        if not self.ranked:
            return self._each(pieces)
        odd = np.array([not p or ODD.search(p) is not None for p in pieces], bool)
        plain = [p for p, o in zip(pieces, odd) if not o]
        n, ids = np.zeros(len(pieces), np.int64), np.zeros(0, np.uint32)
        if plain:
            ids = np.array(self.ranked(" " + " ".join(plain)), np.uint32)
            starts = np.flatnonzero(self.spaced[ids])
            n[~odd] = np.diff(np.append(starts, len(ids)))
        if not odd.any():
            return n, ids
        n[odd], others = self._each([p for p, o in zip(pieces, odd) if o])
        from_, at = np.where(odd, len(ids), 0), np.zeros(len(pieces), np.int64)
        for kind in (odd, ~odd):
            at[kind] = np.cumsum(n[kind]) - n[kind]
        index = np.arange(n.sum()) + np.repeat(from_ + at - (np.cumsum(n) - n), n)
        return n, np.append(ids, others)[index]

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.text(" " + p) for p in pieces]
        return np.array([len(x) for x in each], np.int64), np.array([i for x in each for i in x], np.uint32)

    def head(self, piece: str) -> list[int]:
        """The ids of a text's first piece, which has no space before it."""
        return self.ranked(piece) if self.ranked and not ODD.search(piece) else self.text(piece)

    def _ranked(self, spec: dict):
        import tiktoken

        vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", ())
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or any(vocab.get("".join(p)) != 256 + k for k, p in enumerate(pairs)):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def hashes(pieces: list[str]) -> np.ndarray:
    """64-bit hashes of pieces, the same in every worker."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))


class Lengths:
    """A compact hash table of pieces' numbers of ids: sorted hashes and a number each (10 bytes an entry)."""

    def __init__(self, pieces: list[str], library: Library):
        n, h = library.pieces(pieces)[0], hashes(pieces)
        # Were two of the pieces to share a hash, neither would stay.
        once = np.isin(h, *[x[c > 1] for x, c in [np.unique(h, return_counts=True)]], invert=True)
        order = np.argsort(h[once])
        self.hash, self.n = h[once][order], n[once][order].astype(np.uint16)

    def find(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which pieces the table has, and their numbers of ids (anything for others)."""
        if not len(self.hash) or not pieces:
            return np.zeros(len(pieces), bool), np.zeros(len(pieces), np.int64)
        h = hashes(pieces)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return self.hash[at] == h, self.n[at].astype(np.int64)


class Encoder:
    """Encodes Arrow string arrays; the ids of pieces are kept up to a bound of entries and of bytes, long pieces never."""

    MOST, MOST_BYTES = 150_000, 8 << 20

    def __init__(self, library: Library):
        self.library = library
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.n, self.start, self.ids, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where self.n and self.start have the pieces, after learning the new ones."""
        new = [w for w in dict.fromkeys(pieces) if w not in self.at]
        size = sum(map(len, new))
        if new and (len(self.at) + len(new) > self.MOST or self.bytes + size > self.MOST_BYTES):
            self._reset()
            new = list(dict.fromkeys(pieces))
        if new:
            n, ids = self.library.pieces(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.n, self.ids, self.bytes = np.append(self.n, n), np.append(self.ids, ids), self.bytes + size
            self.start = np.cumsum(self.n) - self.n
        return np.fromiter((self.at[w] for w in pieces), np.int64, len(pieces))

    def _uneven(self, text: str) -> np.ndarray:
        """The ids of a text that can't be cut at each space."""
        if any(s in text for s in self.library.special):
            return np.array(self.library.text(text), np.uint32)
        head, *pieces = _CUT.split(text)
        n, ids = self.library.pieces(pieces)
        return np.append(np.array(self.library.head(head), np.uint32), ids)

    def _entries(self, texts: pa.Array, table: Lengths | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids and their start for each piece of the texts, the ids these point into, and each text's first piece. Pieces that the table has get a number only."""
        uneven = pc.match_substring_regex(texts, UNEVEN)
        for s in self.library.special:
            uneven = pc.or_(uneven, pc.match_substring(texts, s))
        cut = pc.split_pattern(pc.if_else(uneven, "", texts), " ")
        size = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size
        coded = pc.list_flatten(cut).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
        known, n = table.find(words) if table else (np.zeros(len(words), bool), np.zeros(len(words), np.int64))
        start = np.zeros(len(words), np.int64)
        rest = np.flatnonzero(~known)
        long = np.fromiter((len(words[k]) > LONGEST for k in rest), bool, len(rest))
        short, long = rest[~long], rest[long]
        places = self._places([words[k] for k in short])
        n[short], start[short] = self.n[places], self.start[places]
        n[long], more = self.library.pieces([words[k] for k in long])
        start[long] = len(self.ids) + np.cumsum(n[long]) - n[long]
        where = coded.indices.to_numpy()
        n, start = n[where], start[where]
        # A text's first piece has no space before it, and an uneven text is a single piece.
        heads = [np.array(self._uneven(t) if o else self.library.head(h), np.uint32) for t, o, h in zip(pc.if_else(uneven, texts, "").to_pylist(), uneven.to_pylist(), pc.list_element(cut, 0).to_pylist())] if len(texts) else []
        n[first] = sizes = np.array([len(h) for h in heads], np.int64)
        start[first] = len(self.ids) + len(more) + np.cumsum(sizes) - sizes
        return n, start, np.concatenate([self.ids, more, *heads]), first

    def lengths(self, texts: pa.Array, table: Lengths | None = None) -> np.ndarray:
        """The number of each text's ids: of pieces by the table, of those that it lacks by the cache."""
        n, _, _, first = self._entries(texts, table)
        return np.add.reduceat(n, first) if len(first) else n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each text's ids."""
        n, start, ids, first = self._entries(texts)
        if not len(first):
            return ids[:0], n
        total = np.cumsum(n)
        index = np.arange(total[-1], dtype=np.int64)
        index += np.repeat(start - (total - n), n)
        return ids[index], np.add.reduceat(n, first)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary: loaded once, its cache serves all tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Library(path))
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes of text at most (one longer text is a run of its own)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + most, side="right")))
        yield batch.slice(k, end - k)
        k = end


def strings(column: pa.Array) -> pa.Array:
    """Nulls as empty texts; a batch of nulls only has no string type of its own."""
    return pc.fill_null(column.cast(pa.string()) if not pa.types.is_large_string(column.type) else column, "")
