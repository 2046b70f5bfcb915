"""Phrases whose words stay together, mined from shards (SON) and counted exactly.

Each task cuts its texts into shards and mines each completely: words first (a
phrase can't be more frequent than its words), then pairs of frequent words, then
runs of 3 and 4 words whose pairs are all candidates, at a support lowered to the
shard's share of its language, rounded up.  A phrase that no shard reports isn't frequent.  What the
shards report is summed by hash; as a shard that doesn't report a phrase holds it
less often than its local support, the sum bounds the true count from above, and
phrases below the support by that bound go as well.  Those left are a bitmap of
fixed size, by which a last pass over the texts counts candidates, now as
strings, globally and exactly; false bits cost rows, never results.

The support is an absolute count.  Once a shard is less than 1 / support of its
language, its local support is 1: then only infrequent words and pairs and the bound over
all shards sift phrases before the last pass, and the mining's shuffles hold
a hash (some 3 bytes when compressed) for each different phrase of a shard.

Defined results: null and empty texts hold no words; a null language is ``und``;
repeated rows count each time; an empty table gives an empty one; other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise, often_and_seldom, scan, text_buffer
from tessera.llm.words import LOWER, find_words, gather, hash_windows, hash_words, mix, table, windows

LONGEST, SUPPORT, INSIDE_PERCENT, SCALE, BEST = 4, 30, 80, 2_000_000, 2_000
#: Characters that end a piece, and those that end a word.
BREAK = table(b".,;:!?\n\v\f\r")
APART = BREAK | table(b" \t")
#: Text of a shard; one piece without an end is never cut, so it makes a longer shard.
SHARD_BYTES = 8 << 20
#: Bits of the fixed bitmaps of frequent words and of candidates (2 and 16 MB), and of a bucket's number.
WORD_BITS, PHRASE_BITS, MOST_BUCKET_BITS = 24, 27, 16
#: Ranges of bytes that are gathered at once.
RANGES = 1 << 17
#: Words for each bucket of hashes.
BUCKET_WORDS = 2 << 20
#: Languages with at least a SHARE-th of all words have a lowered support; there are at most so many.  Those below aren't sifted locally.
SHARE = 10_000
_U = np.uint64


def _seed(lang: str) -> np.uint64:
    return _U(xxhash.xxh64_intdigest(lang.encode()))


def _ranges(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """As ``gather``, in blocks, as its indices take eight times the bytes."""
    parts = [gather(values, first[at : at + RANGES], length[at : at + RANGES]) for at in range(0, len(first), RANGES)]
    return np.concatenate(parts) if parts else values[:0]


class Shard:
    """Lower-cased words of some pieces of one language."""

    def __init__(self, lang: str, data: np.ndarray, edges: np.ndarray):
        self.lang, self.data = lang, data
        self.start, self.end, self.ptr = find_words(data, edges, APART)
        self.seed = _seed(lang)

    def hashes(self) -> np.ndarray:
        return hash_words(self.data, self.start, self.end)

    def windows(self, width: int) -> np.ndarray:
        return windows(self.ptr, width)[0]

    def strings(self, first: np.ndarray, width: int) -> pa.Array:
        """Runs of ``width`` words from ``first``, joined by one space each."""
        size = self.end - self.start + 1
        joined = _ranges(np.append(self.data, np.uint8(32)), self.start, size)
        stop = np.cumsum(size) - 1
        joined[stop] = 32
        begin, length = (stop - size + 1)[first], stop[first + width - 1] - (stop - size + 1)[first]
        offsets = np.append(0, np.cumsum(length))
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_ranges(joined, begin, length)))

    def word_ids(self) -> np.ndarray:
        """A number for each word; equal words have equal numbers."""
        return np.asarray(self.strings(np.arange(len(self.start)), 1).dictionary_encode().indices).astype(np.int64)


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    """Shards of (lang, text) rows: whole pieces of one language, of about ``most`` bytes."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[Shard]:
        rows = pa.Table.from_batches(held)
        for lang in pc.unique(rows.column(0)).to_pylist():
            data, offsets = text_buffer(rows.filter(pc.equal(rows.column(0), lang)).column(1))
            edges = np.unique(np.concatenate((offsets, np.flatnonzero(BREAK[data]))))
            at = 0
            while at < len(data):
                last = int(edges[min(np.searchsorted(edges, at + most), len(edges) - 1)])
                inside = edges[(edges >= at) & (edges <= last)]
                yield Shard(lang, LOWER[data[at:last]], inside - at)
                at = last

    held, size = [], 0
    for batch in batches:
        first, sizes = 0, np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))
        for i, n in enumerate(sizes.tolist()):
            size += n
            if size >= most:
                yield from cut([*held, batch.slice(first, i + 1 - first)])
                held, size, first = [], 0, i + 1
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield from cut(held)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def count_words(texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, phrase, n): how often each word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_bytes):
            found = shard.strings(np.arange(len(shard.start)), 1).value_counts()
            yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(found), pa.string()), found.field(0).cast(pa.string()), found.field(1)], names=["lang", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _bitmap(slices: DataFrame, bits: int, slice_bits: int) -> np.ndarray:
    """Packed bits from (slice, packed) rows: 2 ** bits of them, however many rows there are."""
    out = np.zeros((1 << bits - slice_bits, max(1 << slice_bits >> 3, 1)), np.uint8)
    for row in slices.toLocalIterator():
        out[row["slice"]] |= np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["packed"])), np.uint8)
    return out.ravel()


def _pack(places: np.ndarray, slice_bits: int) -> bytes:
    bit = np.zeros(1 << slice_bits, np.uint8)
    bit[places] = 1
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bit, bitorder="little").tobytes())


def _has(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    place = hashes >> _U(64 - bits)
    return (bitmap[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8) & 1).astype(bool)


def word_bitmap(frequent: DataFrame) -> np.ndarray:
    """A bit for the hash of each (lang, phrase) of ``frequent``."""
    slice_bits = WORD_BITS - 6

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            seeds = {lang: _seed(lang) for lang in pc.unique(batch.column(0)).to_pylist()}
            place = mix(hash_words(data, offsets[:-1], offsets[1:]) ^ np.array([seeds[x] for x in batch.column(0).to_pylist()], np.uint64)) >> _U(64 - WORD_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((place >> _U(slice_bits)).astype(np.int64)), pa.array((place & _U((1 << slice_bits) - 1)).astype(np.int64))], names=["slice", "place"])

    def pack(t: pa.Table) -> pa.Table:
        return pa.table({"slice": t.column("slice").slice(0, 1), "packed": pa.array([_pack(np.asarray(t.column("place")), slice_bits)], pa.binary())})

    # different places of a slice: at most 2 ** slice_bits
    slices = frequent.select("lang", "phrase").mapInArrow(places, "slice long, place long").distinct().groupBy("slice").applyInArrow(pack, "slice long, packed binary")
    return _bitmap(slices, WORD_BITS, slice_bits)


def candidate_bitmap(texts: DataFrame, words: np.ndarray, totals: dict[str, int], total: int, support: int = SUPPORT, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """The bits of all phrases that may occur ``support`` times: pairs first, then longer runs of such pairs."""
    pairs = _mined(texts, words, None, range(2, 3), totals, total, support, shard_bytes)
    return pairs if longest < 3 else pairs | _mined(texts, words, pairs, range(3, longest + 1), totals, total, support, shard_bytes)


def _mined(texts: DataFrame, words: np.ndarray, pairs: np.ndarray | None, widths: range, totals: dict[str, int], total: int, support: int, shard_bytes: int) -> np.ndarray:
    """The bits of runs of some widths, all of whose words and pairs have bits, from complete mining of every shard at its share of the support."""
    bucket_bits = min(max((max(total, 1) // BUCKET_WORDS).bit_length(), 3), MOST_BUCKET_BITS)
    known = texts.sparkSession.sparkContext.broadcast((words, pairs, totals))  # bitmaps of fixed size, at most SHARE totals

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, pair_bitmap, of = known.value
        for shard in shards(batches, shard_bytes):
            low = max(-(-support * len(shard.start) // of[shard.lang]), 1) if shard.lang in of else 1
            hashed = shard.hashes()
            # words, or pairs of a word and the next, that aren't frequent, before each word
            rare, span = np.cumsum(np.append(False, ~_has(bitmap, mix(hashed ^ shard.seed), WORD_BITS))), 0
            if pair_bitmap is not None:
                pair = mix(hash_windows(hashed, np.arange(max(len(hashed) - 1, 0)), 2) ^ shard.seed)
                rare, span = np.cumsum(np.append(False, ~_has(pair_bitmap, pair, PHRASE_BITS))), 1
            found = []
            for width in widths:
                first = shard.windows(width)
                first = first[rare[first + width - span] == rare[first]] if len(first) else first
                found.append(mix(hash_windows(hashed, first, width) ^ shard.seed))
            phrase, n = np.unique(np.concatenate(found), return_counts=True)
            phrase, n = phrase[n >= low], np.minimum(n[n >= low], 255)
            edge = np.searchsorted(phrase >> _U(64 - bucket_bits), np.arange((1 << bucket_bits) + 1).astype(np.uint64))
            key = (phrase >> _U(32 - bucket_bits)).astype(np.uint32)
            rows = []
            for bucket in range(1 << bucket_bits):
                part = slice(edge[bucket], edge[bucket + 1])
                if edge[bucket] < edge[bucket + 1] or low > 1:
                    step = np.diff(key[part], prepend=np.uint32(0)).astype("<u4")
                    rows.append((bucket, step.view(np.uint8).reshape(-1, 4).T.tobytes() + n[part].astype(np.uint8).tobytes()))
            pack = zstandard.ZstdCompressor(level=1).compress
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([shard.lang] * len(rows), pa.string()), pa.array([low - 1] * len(rows), pa.int64()), pa.array([pack(r[1]) for r in rows], pa.binary())], names=["slice", "lang", "less", "blob"])

    def settle(t: pa.Table) -> pa.Table:
        """Sum what shards report of one bucket: each count less what a shard may hide, plus what all shards may hide."""
        slice_bits, marked = PHRASE_BITS - bucket_bits, []
        for lang in pc.unique(t.column("lang")).to_pylist():
            own = t.filter(pc.equal(t.column("lang"), lang))
            keys, values, hidden = [], [], 0
            for less, blob in zip(own.column("less").to_pylist(), own.column("blob")):
                raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint8)
                m = len(raw) // 5
                keys.append(np.cumsum(np.ascontiguousarray(raw[: 4 * m].reshape(4, m).T).view("<u4").ravel(), dtype=np.uint32))
                values.append(raw[4 * m :].astype(np.int64) - less)
                hidden += less
            key, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            bound = np.add.reduceat(value, head) + hidden if len(head) else value
            marked.append(key[head][bound >= support] >> np.uint32(32 - slice_bits))
        return pa.table({"slice": t.column("slice").slice(0, 1), "packed": pa.array([_pack(np.concatenate(marked), slice_bits)], pa.binary())})

    slices = texts.mapInArrow(mine, "slice long, lang string, less long, blob binary").groupBy("slice").applyInArrow(settle, "slice long, packed binary")
    return _bitmap(slices, PHRASE_BITS, PHRASE_BITS - bucket_bits)


def count_candidates(texts: DataFrame, bitmap: np.ndarray, support: int = SUPPORT, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, words, phrase, n) of the phrases that occur ``support`` times: strings that have their bit, counted over all texts."""
    known = texts.sparkSession.sparkContext.broadcast(bitmap)  # 2 ** PHRASE_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_bytes):
            hashed, ids = shard.hashes(), shard.word_ids()
            for width in range(2, longest + 1):
                first = shard.windows(width)
                first = first[_has(known.value, mix(hash_windows(hashed, first, width) ^ shard.seed), PHRASE_BITS)]
                if not len(first):
                    continue
                number = ids[first]
                for step in range(1, width):  # a number for each different run: of its beginning, and its last word
                    _, number = np.unique(number * (len(ids) + 1) + ids[first + step], return_inverse=True)
                _, one, n = np.unique(number, return_index=True, return_counts=True)
                phrase = shard.strings(first[one], width).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(n), pa.string()), pa.array([width] * len(n), pa.int32()), phrase, pa.array(n, pa.int64())], names=["lang", "words", "phrase", "n"])

    counted = texts.mapInArrow(run, "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= support)


def frequent_runs(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of every run of 1 to ``longest`` words that occurs ``support`` times, and (lang, n) of all words."""
    texts = _texts(docs, text, lang)
    words = materialise(count_words(texts, shard_bytes), "words")
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    large = {r["lang"]: r["n"] for r in totals.filter(F.col("n") * SHARE >= total).collect()}
    words = words.filter(F.col("n") >= support)
    bitmap = candidate_bitmap(texts, word_bitmap(words), large, total, support, longest, shard_bytes)
    phrases = materialise(count_candidates(texts, bitmap, support, longest, shard_bytes), "phrases")
    return words.select("lang", F.lit(1).alias("words"), "phrase", "n").unionByName(phrases), totals


def scored(runs: DataFrame, total: int) -> DataFrame:
    """lang, phrase, a, l, r and score of each run of two or more words, by its lowest-scoring cut."""
    phrases = runs.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    word = F.split("phrase", " ")
    part = lambda begin, n: F.array_join(F.slice(word, begin, n), " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")
    sides = phrases.select("*", cut).select("lang", "phrase", "a", "cut", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), part(F.lit(1), F.col("cut")).alias("part")),
        F.struct(F.lit(False).alias("left"), part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("part")),
    )).alias("side")).select("lang", "phrase", "a", "cut", "side.*")
    counts = runs.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), F.col("n").alias("k"))
    # a part takes part in at most f / support phrases of each length; all occurrences of runs of one length are at most ``total``
    often, seldom = (x.drop("k") for x in often_and_seldom(counts, total))
    met = sides.join(F.broadcast(often), ["lang", "part"], "left")
    met = met.filter("f IS NOT NULL").unionByName(met.filter("f IS NULL").drop("f").join(seldom, ["lang", "part"]))
    cuts = met.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("product", F.lit(SCALE).cast("decimal(10,0)") * wide("a")).withColumn("both", wide("l") + wide("r")).withColumn("score", F.expr("product div both"))
    return cuts.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("best")).select("lang", "phrase", "a", "best.*")


def contained(runs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase) of the runs whose words lie in a longer run that occurs INSIDE_PERCENT as often."""
    word = F.split("phrase", " ")

    def inside(n: int):
        """The runs of n words in a longer run."""
        at = F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(word, i, n), " "))
        return F.when(F.col("words") > n, at).otherwise(F.array().cast("array<string>"))

    inner = [inside(n) for n in range(2, longest)]
    longer = runs.filter("words > 2").select("lang", F.explode(F.concat(*inner) if inner else F.array().cast("array<string>")).alias("phrase"), F.col("n").alias("longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return runs.filter("words > 1").join(most, ["lang", "phrase"]).filter(100 * wide("longer") >= INSIDE_PERCENT * wide("n")).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, best: int = BEST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The first ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    runs, totals = frequent_runs(docs, text, lang, support, longest, shard_bytes)
    total = totals.agg(F.sum("n")).first()[0] or 0
    kept = scored(runs, total).join(contained(runs, longest), ["lang", "phrase"], "left_anti")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank).filter(F.col("rank") <= best)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(scan(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, piece AS body FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
words AS (
  SELECT piece, lang, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (SELECT piece, lang, regexp_extract_all(body, '[^\x20\x09]+') AS w FROM pieces)),
grams AS (
  SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY piece ORDER BY place)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, 1 AS words, w1 AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM grams WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM grams WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM runs WHERE words > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, 2000000::HUGEINT * c.a // (x.f + y.f) AS score
  FROM cuts c
  JOIN runs x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN runs y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_runs AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM (
    SELECT lang, f, string_split(phrase, ' ') AS w, words, m, unnest(range(1, words - m + 2)) AS i
    FROM runs, (VALUES (2), (3)) AS sizes(m) WHERE words > m)
  GROUP BY ALL),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN inner_runs i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a::BIGINT AS a, k.l::BIGINT AS l, k.r::BIGINT AS r, t.n::BIGINT AS n, k.score::BIGINT AS score
FROM ranked k JOIN totals t ON t.lang = k.lang WHERE k.rank <= 2000
"""
