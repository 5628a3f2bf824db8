"""Finding benchmark passages in documents by spaced seeds (operator 5).

A mask names the words of a window that are hashed; the others may differ. The
hashes of every benchmark item under each mask are a table of seeds, and the
hashes of every document's windows are joined with it. A seed carries the words
around it, as far as a passage that holds it can reach, so that around each hit
document and item are laid side by side and compared word by word.

A document is contaminated by an item if ``WORDS`` words in a row, or all words
of a shorter item, stand in it with at least ``SIMILARITY`` of them the same at
the same place. The masks are chosen so that some mask hits in every window of
13 words with up to 2 others, so verification loses no such passage.

Most windows of documents have no seed. A bitmap of the seeds' hashes, of
bounded size, tells most of them before the join. Equal windows with equal
surroundings count once for each document, so that a text which says one thing
again and again isn't compared more than once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import Scratch, batch_of, small_batches, table, text_or_empty
from tracelab.llm.words import grouped, mixed, window_hashes, word_hashes

MASKS = ("11110111", "11001001111", "11111101")
WORDS, SIMILARITY, LEAST_WORDS = 13, 0.8, 5
LEAST_SAME = math.ceil(SIMILARITY * WORDS)
LEAST_BITS, MOST_BITS = 16, 28  #: size of the bitmap: 64 to 128 bits a seed, 32 MB at most
BROADCAST_SEEDS, BROADCAST_KEYS = 200_000, 2_000_000  #: rows (of 250, and of 16 bytes) that are broadcast at most
TOGETHER = 1 << 16  #: windows whose surroundings are held at once
SEED = "seed long, kind int, owner long, place long, around binary"


def _kinds(lengths: list[int]) -> list[tuple[int, tuple[int, ...], int, int]]:
    """Kind, offsets of the hashed words, and words around that a seed carries: from where, and how many.

    Kinds from 0 are masks, kind -n is an item of n words, all of them hashed.
    """
    masks = [tuple(k for k, x in enumerate(m) if x == "1") for m in MASKS]
    wide = [(k, o, o[-1] + 1 - WORDS, 2 * WORDS - 1 - o[-1]) for k, o in enumerate(masks)]
    return wide + [(-n, tuple(range(n)), 0, n) for n in lengths]


def _seeds(texts: list[str | None], kinds: list, items: bool, bitmap: np.ndarray | None) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, kind, text, place in the text, words around) of the windows of texts, those equal in a text once.

    The seeds of ``items`` are of the kinds for their lengths; those of documents of all kinds.
    """
    words, begin = word_hashes(texts)
    size = np.diff(begin)
    for kind, offsets, before, length in kinds:
        h, at = window_hashes(words, begin, offsets)
        if bitmap is not None and len(h):
            bits = len(bitmap).bit_length() + 5
            for leading in (True, False):
                bit = h >> np.uint64(64 - bits) if leading else h & np.uint64((1 << bits) - 1)
                maybe = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                h, at = h[maybe], at[maybe]
        text = np.searchsorted(begin, at, "right") - 1
        if items:
            own = size[text] == -kind if kind < 0 else size[text] >= WORDS
            h, at, text = h[own], at[own], text[own]
        for k in range(0, len(h), TOGETHER):
            part = slice(k, k + TOGETHER)
            place = at[part][:, None] + np.arange(before, before + length)
            inside = (place >= begin[text[part]][:, None]) & (place < begin[text[part] + 1][:, None])
            around = np.where(inside, words[np.minimum(np.maximum(place, 0), len(words) - 1)], np.uint64(0))
            key = h[part] ^ mixed(text[part].astype(np.uint64))
            for column in around.T:
                key = mixed(key + column * np.uint64(0x9E3779B97F4A7C15))
            first = np.unique(key, return_index=True)[1]  # the first place of those equal in hash, text and surroundings
            yield h[part][first], kind, text[part][first], (at[part] - begin[text[part]])[first], around[first]


def _emitted(texts: list, owners: list, kinds: list, items: bool, bitmap: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for part in grouped(texts):
        own = owners[part]
        for h, kind, text, place, around in _seeds(texts[part], kinds, items, bitmap):
            raw = np.ascontiguousarray(around)
            yield batch_of(SEED, [h.view(np.int64), np.full(len(h), kind, np.int32), [own[i] for i in text], place, [r.tobytes() for r in raw]])


def _bitmap(seeds: DataFrame, n: int) -> np.ndarray:
    """Bits for the leading and the last bits of each seed's hash; the size follows their number, up to ``MOST_BITS``."""
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * n).bit_length()))
    both = F.array(F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND(F.lit((1 << bits) - 1)))
    each = seeds.select(F.explode(both).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("flags"))
    got = each.toPandas()  # at most a row for each word of the bitmap
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["flags"].to_numpy(np.int64).view(np.uint64)
    return out


def compared(kind: np.ndarray, ours: list[bytes], theirs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of surroundings: most words the same in a passage that holds the seed, and where it begins from the seed.

    0 where no passage has enough of them.
    """
    same, at = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
    for k, _, before, length in _kinds(sorted({-int(x) for x in kind if x < 0})):
        rows = np.flatnonzero(kind == k)
        if not len(rows):
            continue
        a, b = (np.frombuffer(b"".join(x[i] for i in rows), np.uint64).reshape(len(rows), length) for x in (ours, theirs))
        there, equal = (a != 0) & (b != 0), (a == b) & (a != 0)
        width = WORDS if k >= 0 else length
        least = LEAST_SAME if k >= 0 else length
        best = np.zeros(len(rows), np.int64)
        for start in range(length - width + 1):
            n = np.where(there[:, start : start + width].all(axis=1), equal[:, start : start + width].sum(axis=1), 0)
            better = (n >= least) & (n > best)
            best[better], at[rows[better]] = n[better], start + before
        same[rows] = best
    return same, at


def _found(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, least_words: int) -> DataFrame:
    """The leaks as in ``leaks``, with the document's ``text_key``."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), text_or_empty(item_text).alias("text"))
    lengths = list(range(least_words, WORDS))  # short items of every length

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _emitted(batch.column("text").to_pylist(), batch.column("item_id").to_pylist(), _kinds(lengths), True)

    seeds = tables.keep(items.mapInArrow(of_items, SEED).select("seed", "kind", "around", F.col("owner").alias("item_id")).distinct(), "seeds")
    n = seeds.count()
    present = sorted(-r["kind"] for r in seeds.filter("kind < 0").select("kind").distinct().collect())  # at most a row for each length
    bitmap, kinds = spark.sparkContext.broadcast(_bitmap(seeds, n)), _kinds(present)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))
            for got in _emitted(texts, list(range(len(texts))), kinds, False, bitmap.value):
                at = got.column("owner").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array([keys[i] for i in at], pa.int64()), *(got.column(c) for c in ("seed", "kind", "place", "around"))], names=["doc_id", "text_key", "seed", "kind", "place", "around"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("text_key"), F.col(text).alias("text"))
    windows = plain.mapInArrow(of_docs, "doc_id long, text_key long, seed long, kind int, place long, around binary").distinct() if n else spark.createDataFrame([], "doc_id long, text_key long, seed long, kind int, place long, around binary")
    other = seeds.withColumnRenamed("around", "theirs")
    pairs = windows.join(F.broadcast(other) if n <= BROADCAST_SEEDS else other, ["seed", "kind"])
    schema = "doc_id long, text_key long, item_id long, start long, n_words long, n_same long"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            same, at = compared(kind, batch.column("around").to_pylist(), batch.column("theirs").to_pylist())
            good = pa.array(np.flatnonzero(same))
            if len(good):
                own = batch.take(good)
                k = good.to_numpy()
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_key"), own.column("item_id"), pa.array(own.column("place").to_numpy() + at[k]), pa.array(np.where(kind[k] < 0, -kind[k], WORDS).astype(np.int64)), pa.array(same[k])], names=["doc_id", "text_key", "item_id", "start", "n_words", "n_same"])

    checked = pairs.select("doc_id", "text_key", "item_id", "place", "kind", "around", "theirs").mapInArrow(verify, schema)
    best = F.max(F.struct("n_same", (-F.col("start")).alias("early"), "n_words")).alias("b")
    return checked.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", (-F.col("b.early")).alias("start"), "b.n_words", "b.n_same")


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each item of which a document holds a passage: doc_id, item_id, start, n_words, n_same.

    The passage is the one with most words the same (``n_same`` of ``n_words``),
    the first of equals; ``start`` counts the document's words from 0. Null and
    empty texts have no words. Items with fewer than ``least_words`` words are
    passed over, as they stand in clean texts by chance; those with fewer than
    ``WORDS`` have to stand there whole and unchanged. Equal items each get a
    row, as do documents with one id and several texts; rows equal in id and
    text are one document, and null is an id as any other. Long texts are read
    whole, a passage that one repeats is compared once. Empty tables give no
    rows; other columns are left out.
    """
    return _found(docs, benchmark, doc_id, text, item_id, item_text, least_words).drop("text_key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark; all columns pass through, whatever their names.

    Rows are told by id and text, so nulls, repeated ids and repeated rows are
    as in ``leaks``. An empty benchmark leaves all rows, an empty table has none.
    """
    tables = Scratch(docs.sparkSession, "decontaminated")
    bad = tables.keep(_found(docs, benchmark, doc_id, text, item_id, item_text, least_words).select("doc_id", "text_key").distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text_or_empty(text)).alias("key"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left_anti").select("row.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
