"""Encoding whole texts with a public byte-level BPE, by cached units.

The pre-tokenizer of the byte-level BPE cuts before a single blank that is
followed by a word, so the ids of a text are those of its blank-separated
units, each with its blank, one after the other.  A block of texts is split
and its units are numbered by Arrow; the tokenizers library encodes distinct
units only, and ids are put together as arrays.  Units met in more than one
block stay cached in the worker.  Texts where the cut is not that simple
(runs of blanks, special tokens, separators that only some libraries count as
white space) go to the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept_in_worker

_MARKS = ",.;:!?\n"              # cut from letters before them in any context
_WHOLE = ("  ", "\x1c", "\x1d", "\x1e", "\x1f", "<|endoftext|>")
BLOCK_CHARS = 4_000_000
UNITS_KEPT = 300_000            # cached units of a worker


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, block_chars: int = BLOCK_CHARS, units_kept: int = UNITS_KEPT):
        import os
        self.block_chars, self.units_kept = block_chars, units_kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        named = self.tok.get_vocab(with_added_tokens=False)
        self.blank = np.zeros(max(named.values()) + 2, bool)      # ids that begin with a blank
        self.blank[[i for t, i in named.items() if t.startswith("\u0120")]] = True
        self.cache: dict[str, bytes] = {}
        self.seen: set[int] = set()
        self.tails: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        made = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in made]

    def _after_blank(self, units: list[str]) -> list[bytes]:
        """Ids of units, each after a blank, from one text of them all: no
        unit has a blank, so an id that begins with one begins a unit."""
        out: list[bytes] = []
        for lo in range(0, len(units), 20_000):
            part = units[lo:lo + 20_000]
            made, = self.tok.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids = np.array(made.ids, "<u4")
            at = np.flatnonzero(self.blank[np.minimum(ids, len(self.blank) - 1)])
            if len(at) == len(part) and not at[0]:
                raw, at = ids.tobytes(), (4 * at).tolist() + [4 * len(ids)]
                out += [raw[a:b] for a, b in zip(at, at[1:])]
            else:
                out += self._ids([" " + u for u in part])
        return out

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units, each after a blank."""
        if len(self.cache) > self.units_kept:
            self.cache.clear()
        got = list(map(self.cache.get, units))
        new = [i for i, x in enumerate(got) if x is None]
        if len(self.seen) > 2 * self.units_kept:
            self.seen.clear()
        if len(self.tails) > self.units_kept:
            self.tails.clear()
        plain: dict[str, bytes | None] = {}        # units and stems of units to encode
        cut: list[tuple[int, str, str]] = []       # letters and the marks behind them
        for i in new:
            u = units[i]
            stem = u.rstrip(_MARKS)
            if len(stem) < len(u) and stem.isalpha():
                tail = u[len(stem):]
                if tail not in self.tails:
                    self.tails[tail], = self._ids([tail])
                cut.append((i, stem, tail))
                if stem not in self.cache:
                    plain[stem] = None
            else:
                plain[u] = None
        plain.update(zip(list(plain), self._after_blank(list(plain))))
        for i in new:
            got[i] = plain.get(units[i])
        for i, stem, tail in cut:
            got[i] = (plain.get(stem) or self.cache[stem]) + self.tails[tail]
        for u, ids in plain.items():
            h = hash(u)
            if h in self.seen:
                self.cache[u] = ids
            else:
                self.seen.add(h)
        return got

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            done = int(size[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, done + self.block_chars)))
            out += self._block(texts.slice(lo, hi - lo))
            lo = hi
        return out

    def _block(self, texts: pa.Array) -> list[bytes]:
        whole = np.zeros(len(texts), bool)
        for x in _WHOLE:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~whole)
        out: list[bytes] = [b""] * len(texts)
        odd = np.flatnonzero(whole).tolist()
        for i, ids in zip(odd, self._ids([texts[i].as_py() for i in odd])):
            out[i] = ids
        if not len(plain):
            return out
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        starts = split.offsets.to_numpy()[:-1].astype(np.int64)
        named = split.values.dictionary_encode()
        codes = named.indices.to_numpy().astype(np.int64)
        units = named.dictionary.to_pylist()
        # a text's first unit has no blank before it
        first = [units[c] for c in codes[starts].tolist()]
        heads = sorted(set(first))
        at_head = {u: len(units) + i for i, u in enumerate(heads)}
        codes[starts] = [at_head[u] for u in first]
        made = self._units(units) + self._ids(heads)
        count = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat = np.frombuffer(b"".join(made), "<u4")
        place = np.cumsum(count) - count
        n = count[codes]
        after = np.cumsum(n)
        total = int(after[-1])
        raw = flat[np.repeat(place[codes] - (after - n), n) + np.arange(total)].tobytes()
        ends = np.append(starts[1:], len(codes)) - 1
        begins = (4 * (after - n)[starts]).tolist()
        for i, a, b in zip(plain.tolist(), begins, (4 * after[ends]).tolist()):
            out[i] = raw[a:b]
        return out


def encoder(path: str, block_chars: int = BLOCK_CHARS, units_kept: int = UNITS_KEPT) -> Encoder:
    """The worker's encoder for a vocabulary; its cache serves later tasks."""
    return kept_in_worker(("encoder", path, block_chars), lambda: Encoder(path, block_chars, units_kept))
