"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased and stripped of ASCII punctuation, so case and punctuation
don't hide a copy.  Every n-gram of a test item is a seed and is looked for in all
documents, however many hold it: what one document holds doesn't depend on how
often others do.  Where a document and an item share seeds, and enough of the
item's words occur in the document at all to reach ``least`` (so a common phrase
alone costs no alignment), the words around the seeds are aligned with the item
(Smith-Waterman over words, linear gaps); an alignment that reaches ``least`` of
the score of a perfect copy is a leak, so edited or paraphrased copies count too.

The test items are a stated query set: tasks put them in blocks of about BLOCK_BYTES
of text, index each block's n-grams and write the index to the shared folder; all
tasks over documents then take the blocks one after the other, and keep the last few.
So no document and no item passes the driver, documents are read once, and memory has
a fixed bound however large the benchmark is.

Defined results: null or empty texts and items match nothing; an item with fewer
words than the seed length is its own seed; repeated items are items of their own; an
item with a null id is looked for like any other, and its id is null in the result;
repeated documents are judged alike; extra columns stay out of the way.
"""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pieces, read_file, shared_folder, text_buffer, write_file
from tessera.llm.words import LOOSE, LOWER, find_words, hash_windows, hash_words, windows

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5
BLOCK_BYTES = 4 << 20
#: Blocks that a worker keeps in memory.
KEPT_BLOCKS = 8
#: Words of items that are looked up in texts at once, and a factor that tells texts apart.
MOST_WORDS, MIX = 1 << 18, np.uint64(0x9E3779B97F4A7C15)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(column)
    data = LOWER[data]
    start, end, ptr = find_words(data, offsets, LOOSE)
    return hash_words(data, start, end), ptr


@dataclass
class Items:
    """Word hashes of a block of items, and their n-grams: sorted hashes, each with its item and place."""

    ids: pa.Array
    words: np.ndarray
    ptr: np.ndarray
    grams: np.ndarray  # distinct, sorted
    gram_of: np.ndarray  # entries: index into grams, in order
    entry_ptr: np.ndarray  # grams + 1
    item: np.ndarray  # of an entry
    place: np.ndarray  # of an entry
    filter: np.ndarray

    @classmethod
    def build(cls, ids: pa.Array, texts: pa.Array) -> Items:
        words, ptr = _words(texts)
        first, item = windows(ptr, SEED_WORDS)
        width = np.full(len(first), SEED_WORDS)
        few = np.flatnonzero((np.diff(ptr) < SEED_WORDS) & (np.diff(ptr) > 0))
        first, item, width = np.append(first, ptr[few]), np.append(item, few), np.append(width, np.diff(ptr)[few])
        grams, of = np.unique(hash_windows(words, first, width), return_inverse=True)
        order = np.argsort(of, kind="stable")
        filter = np.zeros(1 << 20, bool)
        filter[(grams >> np.uint64(44)).astype(np.int64)] = True
        return cls(ids, words, ptr, grams, of[order], np.searchsorted(of[order], np.arange(len(grams) + 1)), item[order], (first - ptr[item])[order], filter)

    def find(self, words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, gram) of every n-gram of a buffer that some item has."""
        found = []
        for width in range(1, SEED_WORDS + 1):
            first, text = windows(ptr, width)
            if width < SEED_WORDS and not (np.diff(self.ptr) == width).any():
                continue
            h = hash_windows(words, first, width)
            near = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.grams, h[near]), max(len(self.grams) - 1, 0))
            good = self.grams[at] == h[near] if len(self.grams) else np.zeros(0, bool)
            near, at = near[good], at[good]
            found.append((text[near], (first - ptr[text])[near], at))
        return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]

    def shared(self, item: np.ndarray, text: np.ndarray, words: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """For pairs of an item and a text, how many of the item's words occur in the text, or somewhat more."""
        own = np.unique(text)
        length = ptr[own + 1] - ptr[own]
        of = np.repeat(own, length)
        at = np.arange(len(of)) + np.repeat(ptr[own] - (np.cumsum(length) - length), length)
        have = np.unique(words[at] ^ (of.astype(np.uint64) * MIX))  # equal keys of unequal words only add to the count
        size, out = np.diff(self.ptr)[item], np.zeros(len(item), np.int64)
        parts = np.cumsum(size) // MOST_WORDS
        for part in np.unique(parts):
            a, b = np.searchsorted(parts, (part, part + 1))
            pair = np.repeat(np.arange(a, b), size[a:b])
            at = np.arange(len(pair)) + np.repeat(self.ptr[item[a:b]] - (np.cumsum(size[a:b]) - size[a:b]), size[a:b])
            key = self.words[at] ^ (text[pair].astype(np.uint64) * MIX)
            out[a:b] = np.bincount(pair[have[np.minimum(np.searchsorted(have, key), len(have) - 1)] == key] - a, minlength=b - a)
        return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment's score, and the end of its words in ``text``."""
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    step = np.arange(len(text) + 1) * -GAP
    for word in item:
        now = np.zeros_like(row)
        now[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP))
        row = np.maximum.accumulate(now + step) - step
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def leaks(items: Items, column: pa.Array, least: float) -> list[tuple[int, int, float, int, int, int]]:
    """(row, item, score, seeds, first word, end) of each pair of a text and an item that align well."""
    words, ptr = _words(column)
    text, word, gram = items.find(words, ptr)
    entries = items.entry_ptr[gram + 1] - items.entry_ptr[gram]
    before = np.cumsum(entries) - entries
    entry = np.arange(int(entries.sum())) + np.repeat(items.entry_ptr[gram] - before, entries)
    text, word = np.repeat(text, entries), np.repeat(word, entries)
    item, begin = items.item[entry], word - items.place[entry]
    order = np.lexsort((word, begin, item, text))
    text, word, begin, item = text[order], word[order], begin[order], item[order]
    size = np.diff(items.ptr)
    if len(text):  # each match scores MATCH at most, so a pair needs ``least`` of the item's words
        first = np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])))
        good = (items.shared(item[first], text[first], words, ptr) / size[item[first]] >= least)[np.cumsum(first) - 1]
        text, word, begin, item = text[good], word[good], begin[good], item[good]
    # a run: seeds of one pair whose implied beginnings lie within half the item's length of the one before
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[item[1:]] // 2 + 2)
    at = np.append(np.flatnonzero(new), len(text))
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        t, i = int(text[a]), int(item[a])
        n = int(size[i])
        spare = int(MATCH * n * max(1 - least, 0) / -GAP) + 1  # gaps that an alignment can afford; one seed may be all that it has
        low, high = max(0, int(begin[a]) - spare), min(int(ptr[t + 1] - ptr[t]), int(begin[b - 1]) + n + spare)
        own, there = items.words[items.ptr[i] : items.ptr[i + 1]], words[ptr[t] + low : ptr[t] + high]
        got, end = align(own, there)
        share = got / (MATCH * n)
        if share >= least and (known := best.get((t, i), (0.0, 0, 0, 0)))[0] < share:
            back = align(own[::-1], there[:end][::-1])[1]
            best[t, i] = (share, known[1] + b - a, low + end - back, low + end)
    return [(t, i, *x) for (t, i), x in best.items()]


def write_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> list[str]:
    """Files with the indexed blocks of the test items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(key).alias("id"), F.col(text).alias("t")).filter("t IS NOT NULL")
    blocks = (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES + 1
    folder = f"{shared_folder(spark)}/items-{uuid.uuid4().hex}"

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("t", "ascending")]).combine_chunks()
        content = pickle.dumps(Items.build(table.column("id").combine_chunks(), table.column("t").combine_chunks()))
        return pa.table({"file": [write_file(folder, content)], "block": table.column("block")[:1]})

    # texts of one length may repeat an id, so both decide the block
    named = items.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(blocks)))
    return [r["file"] for r in named.groupBy("block").applyInArrow(build, "file string, block long").orderBy("block").collect()]  # a name for each 4 MB of items


_KEPT: OrderedDict[str, Items] = OrderedDict()


def _block(file: str) -> Items:
    if file in _KEPT:
        _KEPT.move_to_end(file)
    else:
        _KEPT[file] = pickle.loads(read_file(file))
        if len(_KEPT) > KEPT_BLOCKS:
            _KEPT.popitem(last=False)
    return _KEPT[file]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, score (share of a perfect copy's), seeds, first_word, end_word: the place in the document's words."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kinds = own.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    files = write_blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for file in files:
                items = _block(file)
                if rows := leaks(items, batch.column(1), least):
                    row, item, score, seeds, first, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), items.ids.take(pa.array(item)), pa.array(score), pa.array(seeds, pa.int32()), pa.array(first, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "score", "seeds", "first_word", "end_word"])

    return own.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, seeds int, first_word long, end_word long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no leak, with their own columns."""
    files = write_blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            for file in files:
                bad = {r[0] for r in leaks(_block(file), batch.column(batch.schema.get_field_index(text)), least)}
                if bad:
                    batch = batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark)
