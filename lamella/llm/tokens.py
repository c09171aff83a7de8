"""Ids of whole texts by a byte-level BPE file of the tokenizers library.

The pre-tokeniser never joins characters across a blank or line feed that follows other text, nor a letter with the stop
after it, so texts are cut there and the library encodes each *different* piece once; the ids of a text are the ids of its
pieces in order.  Texts in which a cut would split a run of white space go through the library whole.
"""
from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}\x{200b}\x{feff}\x{180e}]"
#: A blank or line feed with white space on both sides, or the mark that the cutting uses.
WHOLE = rf"{_WS}[ \n]{_WS}|{_WS}[ \n]\z|\x00"
#: A blank, then something without white space at its ends. Odd marks count as white space, as do all that any library takes for it.
PLAIN = rf"^ [^{_WS[1:-1]}](?s:.*[^{_WS[1:-1]}])?$"
#: Different pieces a worker remembers, about (some 200 bytes each); beyond it those met in one batch only go. Bounds memory, not results.
CACHE = 250_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encoder(path: str, cache: int = CACHE) -> "Encoder":
    """The worker's encoder; kept on the library's module, as this package's functions travel by value with each task."""
    import tokenizers
    held = tokenizers.__dict__.setdefault("_lamella_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    held[path].cache = cache
    return held[path]


class Encoder:
    """``encode(texts)``: all ids as one uint32 array, and how many each text has."""

    def __init__(self, path: str, cache: int = CACHE):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for w, i in vocab.items():
            self.bytes[i] = len(w)  # one character of a vocabulary entry is one byte
        self.cache = cache
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int32)  # batches that held a piece
        self.n = 1

    def keep_common(self) -> None:
        """Forgets the pieces met in the fewest batches, all but at most half of ``cache``; counts of the others are halved."""
        uses = self.uses[:self.n]
        uses[0] = uses.max() + 1  # the empty piece
        most = max(1, self.cache // 2)
        least = np.sort(uses)[-most - 1] + 1 if self.n > most else 0
        kept = np.flatnonzero(uses >= max(2, least))
        known, start, size, pool, uses = list(self.known), self.start[kept], self.size[kept], self.pool, uses[kept] // 2
        self.forget()
        self.known = {known[k]: i for i, k in enumerate(kept.tolist())}
        self._room(len(kept))
        self.uses[:len(kept)] = uses
        self._keep(np.arange(len(kept)), size, pool[_runs(start, size)])
        self.n = len(kept)

    def _room(self, n: int) -> None:
        while n > len(self.start):
            self.start, self.size, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.uses))

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, new: pa.Array) -> np.ndarray:
        """Places in ``new`` of words that begin with one blank and hold no other white space at their ends."""
        return np.flatnonzero(np.asarray(pc.match_substring_regex(new, PLAIN)))

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Numbers of new pieces. Words that begin with a blank are encoded in long strings, which the pre-tokeniser cuts at
        those blanks; token lengths in bytes tell where a piece ends."""
        first, words = self.n, new.to_numpy(zero_copy_only=False).tolist()
        self._room(first + len(words))
        runs = self._runs(new)
        alone = np.ones(len(words), bool)
        alone[runs] = False
        want = np.asarray(pc.binary_length(new)).astype(np.int64)
        groups = [runs[at:at + 512] for at in range(0, len(runs), 512)]
        for own in groups:
            ids = np.asarray(self.whole(["".join([words[i] for i in own.tolist()])])[0], np.uint32)
            ends = np.cumsum(self.bytes[ids])
            edge = np.cumsum(want[own])
            at = np.searchsorted(ends, edge)
            if at[-1] >= len(ends) or (ends[at] != edge).any():
                alone[own] = True
                continue
            self._keep(first + own, np.diff(at, prepend=-1), ids)
        rest = np.flatnonzero(alone)
        for i in range(0, len(rest), 4096):
            own = rest[i:i + 4096]
            parts = self.whole([words[k] for k in own.tolist()])
            self._keep(first + own, np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate([np.asarray(x, np.uint32) for x in parts]))
        return np.arange(first, first + len(words))

    def _keep(self, number: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Puts the ids of pieces, one piece's behind the other's, into the pool."""
        end = self.used + len(ids)
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used:end] = ids
        self.start[number] = self.used + np.cumsum(size) - size
        self.size[number] = size
        self.used = end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.cache:
            self.keep_common()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, WHOLE)
        odd = np.flatnonzero(np.asarray(whole))
        marked = pc.replace_substring(pc.replace_substring(pc.if_else(whole, "", texts), " ", "\0 "), "\n", "\0\n")
        lists = pc.split_pattern(pc.replace_substring_regex(marked, r"(\p{L})([.,;:!?])", "\\1\0\\2"), "\0")
        per = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        miss = np.flatnonzero(number < 0)
        if len(miss):
            number[miss] = k = self._learn(coded.dictionary.take(pa.array(miss)))
            self.known.update(zip([pieces[i] for i in miss.tolist()], k.tolist()))
            self.n += len(miss)
        self.uses[number] += 1
        which = number[np.asarray(coded.indices)]
        size = self.size[which]
        ends = np.cumsum(size)
        ids = self.pool[_runs(self.start[which], size)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
        lens = np.diff(edges)
        if len(odd):
            parts = [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            for i, x in zip(odd.tolist(), self.whole([texts[i].as_py() for i in odd.tolist()])):
                parts[i] = np.asarray(x, np.uint32)
            ids, lens = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, lens


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` places from each ``start``, one run behind the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def chunks(batches, column: str, limit: int = 4 << 20):
    """Record batches joined until the texts of one hold about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    t = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    yield from t[:1]
