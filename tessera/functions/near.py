"""Similar texts of a block, found without writing their grams: what tasks of ``dedup.near_pairs`` do.

A pair of similarity t shares at least t * n of the smaller set's n grams.  So of any n - t * n + k of these, the larger set holds at least k.  Each
text looks up its rarest grams, by their counts in the block, and only pairs with k hits are compared whole.  Texts of a block with equal
sets are looked up once.  Sets are numbered from the largest.  Grams have 32-bit codes (``gram_codes``); where codes may be
shared, which can only add hits, 64-bit hashes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from tessera.functions.text import gram_codes, gram_set

#: Text of a block; its index takes some eight times as much in a task.
BLOCK_BYTES = 48 << 20
#: k as a part of a set's size; text that visits a block at once; hits that are counted at once, and bytes of marked grams kept to compare.
HITS_PART, PROBE_BYTES, HITS, COUNTERS = 0.1, 1 << 20, 1 << 21, 1 << 26
#: Classes of sizes, whose sets can be looked up alone.
CLASSES = 16
_LOW = np.uint64(0xFFFFFFFF)


class Texts:
    """Texts by their set of grams: of each different set its size, its grams' codes, its text where these may be shared, and the rows (seq, id) that have it."""

    def __init__(self, size: int):
        self.size, self.number, self.n, self.codes, self.text, self.rows = size, {}, [], [], [], []

    def add(self, text: str | None, seq: int, id: int) -> None:
        codes, exact = gram_codes(text, self.size)
        if len(codes):
            whole = codes if exact else gram_set(text, self.size)
            number = self.number.setdefault((exact, blake2b(whole.tobytes(), digest_size=16).digest()), len(self.n))
            if number == len(self.n):
                self.n.append(len(codes))
                self.codes.append(codes)
                self.text.append(None if exact else text)
                self.rows.append([])
            self.rows[number].append((seq, id))


class Block(Texts):
    """Texts that others are held against: of each gram, in ``grams``, the sets that hold it lie in ``sets`` from its ``head`` to the next."""

    def close(self) -> None:
        order = np.argsort(-np.array(self.n, np.int64), kind="stable").tolist()
        self.n, self.codes, self.text, self.rows = ([x[i] for i in order] for x in (self.n, self.codes, self.text, self.rows))
        self.sizes, self.number, self.marks = np.array(self.n, np.int64), {}, {}
        keys = np.empty(int(self.sizes.sum()), np.uint64)
        at = 0
        for number, codes in enumerate(self.codes):
            keys[at : at + len(codes)] = codes.astype(np.uint64) << np.uint64(32) | np.uint64(number)
            at += len(codes)
        keys.sort()
        gram = keys.astype("<u8", copy=False).view("<u4")[1::2].copy()
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        self.grams, self.head = gram[first], first
        # where the sets of a gram end that are among the largest: a set only lies in those as large
        classes = max(1, min(CLASSES, len(keys) // (8 * len(first)))) if len(first) else 1
        self.edges = np.append(np.searchsorted(np.cumsum(self.sizes), len(keys) * np.arange(1, classes) / classes) + 1, len(self.n))
        self.ends = [np.searchsorted(keys, self.grams.astype(np.uint64) << np.uint64(32) | np.uint64(x)).astype(np.int32) for x in self.edges[:-1]] + [np.append(first[1:], len(gram)).astype(np.int32)]
        np.bitwise_and(keys, _LOW, out=keys)
        self.sets, self.hits = keys.view(np.int64), np.empty(HITS, np.int64)
        for number, codes in enumerate(self.codes):
            self.codes[number] = self.places(codes).astype(np.uint32)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Places in ``grams`` of those codes that the block has."""
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        return at[self.grams[at] == codes]

    def candidates(self, n: int, places: np.ndarray, need: int, own: bool) -> np.ndarray:
        """Numbers of the block's sets that a set of n grams, of which the block has ``places``, may lie in with ``need`` grams."""
        last = int(np.searchsorted(-self.sizes, -n, "right"))
        low = self.head[places]
        high = self.ends[int(np.searchsorted(self.edges, last))][places]
        df = high - low
        held = df > (1 if own else 0)  # a set of the block holds its own grams
        if last == 0 or np.count_nonzero(held) < need:
            return np.zeros(0, np.int64)
        low, high, df = low[held], high[held], df[held]
        least = max(1, min(int(n * HITS_PART), need))
        rare = n - need + least - (n - len(df))  # the others of the rarest have no hits
        if rare < len(df):
            kept = np.argpartition(df, rare - 1)[:rare]
            low, high, df = low[kept], high[kept], df[kept]
        total, begin, counts = np.cumsum(df), 0, 0
        low, high = low.tolist(), high.tolist()
        while begin < len(low):
            done = int(total[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + HITS, "right")))
            parts, found = [self.sets[x:y] for x, y in zip(low[begin:end], high[begin:end])], int(total[end - 1]) - done
            hits = np.concatenate(parts, out=self.hits[:found]) if found <= len(self.hits) else np.concatenate(parts)
            counts = counts + np.bincount(hits, minlength=len(self.sizes))
            begin = end
        return np.flatnonzero(counts[:last] >= least)

    def shared(self, number: int, places: np.ndarray, byte: np.ndarray, bit: np.ndarray) -> int:
        """How many of ``places`` a set of the block holds: by a bit for each gram of the block, which the largest sets keep, or looked up."""
        if (number + 1) * len(self.grams) > COUNTERS * 8:
            held = self.codes[number]
            return np.count_nonzero(held[np.minimum(np.searchsorted(held, places), len(held) - 1)] == places)
        if number not in self.marks:
            held = np.zeros(len(self.grams), bool)
            held[self.codes[number]] = True
            self.marks[number] = np.packbits(held, bitorder="little")
        return np.count_nonzero(self.marks[number].take(byte) & bit)

    def _rows(self, given: Texts, number: int, other: int) -> Iterator[tuple[int, int]]:
        """Pairs of the rows of two similar sets; equally large ones are met from both sides, and told by the smaller seq."""
        same = self.n[other] == given.n[number]
        for seq, id in given.rows[number]:
            for seq2, id2 in self.rows[other]:
                if id != id2 and (seq < seq2 if same else seq != seq2):
                    yield min(seq, seq2), max(seq, seq2)

    def pairs(self, given: Texts, threshold: float) -> Iterator[tuple[int, int]]:
        """(earlier, later) of similar rows of ``given`` and the block, where the row of ``given`` has the smaller set, or an equally large one and the smaller seq."""
        for number, n in enumerate(given.n if len(self.n) else []):
            if given is self:
                yield from self._rows(given, number, number)
            need = int(np.ceil(n * threshold - 1e-9))
            places, whole = given.codes[number].astype(np.intp) if given is self else self.places(given.codes[number]), None
            others = self.candidates(n, places, need, given is self).tolist()
            byte, bit, places = places >> 3, np.left_shift(1, places & 7).astype(np.uint8), places.astype(np.uint32)
            for other in others:
                if given is self and other == number or self.shared(other, places, byte, bit) / n < threshold:
                    continue
                if given.text[number] is not None and self.text[other] is not None:
                    whole = gram_set(given.text[number], self.size) if whole is None else whole
                    if len(np.intersect1d(whole, gram_set(self.text[other], self.size), assume_unique=True)) / n < threshold:
                        continue
                yield from self._rows(given, number, other)


def block_pairs(batches: Iterator[pa.RecordBatch], threshold: float, size: int) -> Iterator[pa.RecordBatch]:
    """Similar pairs from rows (cell, visits, seq, id, text), in the order of cell and visits: those that don't visit are the cell's block."""
    cell, block, guests, held = None, None, None, 0

    def shown(given: Texts) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        for earlier, later in block.pairs(given, threshold):
            out[0].append(earlier)
            out[1].append(later)
            if len(out[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["earlier", "later"])
                out = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["earlier", "later"])

    def closed() -> Iterator[pa.RecordBatch]:
        if guests is None:
            block.close()
            yield from shown(block)
        else:
            yield from shown(guests)

    for batch in batches:
        for own, visits, seq, id, text in zip(*[batch.column(i) for i in range(5)]):
            own, visits = own.as_py(), visits.as_py()
            if own != cell:
                if cell is not None:
                    yield from closed()
                cell, block, guests, held = own, Block(size), None, 0
            if visits and (guests is None or held >= PROBE_BYTES):
                yield from closed()
                guests, held = Texts(size), 0
            text = text.as_py()
            held += len(text or "")
            (guests if visits else block).add(text, seq.as_py(), id.as_py())
    if cell is not None:
        yield from closed()
