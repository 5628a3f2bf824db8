"""Dropping lines that documents repeat, by a sharded minimal perfect hash (operator 10).

Spark counts the documents of each distinct line hash. The repeated ones are
dealt to shards of about ``SHARD_KEYS``; a task builds a minimal perfect hash
for each shard and writes it as a file with three arrays in its order:
fingerprints, counts and first documents. The hashes of the documents' lines
then go to the tasks of their shards and probe these arrays by number; lines
are never joined. A task holds one shard at a time and opens it once, whatever
the size of the index. What a document loses comes back to it as line numbers.

A line is known by two 64-bit hashes of its key: the first places it, the
second is its fingerprint, so a line that isn't in the index is told apart with
an error of 2 to the power -64.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import Scratch, appended, batch_of, new_file, read_range, shared_dir, small_batches, stored, table, text_or_empty

MIN_CHARS = 10
SHARD_KEYS = 1 << 17
SPREAD = 64  #: parts that the hashes of a shard are dealt to tasks in
TRIMMED = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_DOC = (1 << 63) - 1  #: stands for a null doc_id, which is one document and the last


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers distinct 64-bit keys 0 to n-1: levels of bits for keys that fall on a place of their own."""

    LEVELS, ROOM = 40, 2

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.begin = np.cumsum(sizes) - sizes
        self.rank = np.append(0, np.cumsum(bits))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys.astype(np.uint64)
        while len(left) and len(sizes) < cls.LEVELS:
            size = cls.ROOM * len(left) + 1
            place = _mix(left, len(sizes)) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place.astype(np.int64)]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool), np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for a key that wasn't built in, any number, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        keys = keys.astype(np.uint64)
        for level, size in enumerate(self.sizes):
            place = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64) + self.begin[level]
            hit = self.bits[place]
            out[left[hit]] = self.rank[place[hit]]
            left = left[~hit]
            if not len(left):
                break
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.rank[-1] + at[hit]
        return out


class Shard:
    """Perfect hash of a part of the repeated lines, and its arrays in the order of that hash.

    Keys that share their first hash with another can't be told apart by the
    perfect hash; all but one of them are kept beside it.
    """

    ARRAYS = ("fingerprint", "count", "first", "spare_h1", "spare_fingerprint", "spare_count", "spare_first")

    def __init__(self, mph: PerfectHash, **arrays: np.ndarray):
        self.mph, self.arrays = mph, arrays

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, first: np.ndarray) -> Shard:
        by = np.lexsort((h2, h1))
        h1, h2, count, first = (x[by] for x in (h1.astype(np.uint64), h2.astype(np.uint64), count.astype(np.int64), first.astype(np.int64)))
        spare = np.append(False, h1[1:] == h1[:-1])[: len(h1)]
        mph = PerfectHash.build(h1[~spare])
        order = np.argsort(mph.index(h1[~spare]))
        own = {n: x[~spare][order] for n, x in (("fingerprint", h2), ("count", count), ("first", first))}
        return cls(mph, **own, **{f"spare_{n}": x[spare] for n, x in (("h1", h1), ("fingerprint", h2), ("count", count), ("first", first))})

    def save(self, path: str) -> None:
        data, m = io.BytesIO(), self.mph
        np.savez(data, sizes=m.sizes, bits=np.packbits(m.bits), n_bits=len(m.bits), rest=m.rest, **self.arrays)
        with new_file(path) as out:
            out.write(data.getvalue())

    @classmethod
    def load(cls, path: str) -> Shard:
        x = np.load(io.BytesIO(read_range(path)))
        mph = PerfectHash(x["sizes"], np.unpackbits(x["bits"], count=int(x["n_bits"])).astype(bool), x["rest"])
        return cls(mph, **{n: x[n] for n in cls.ARRAYS})

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line: in how many rows it is (0: not repeated), and its first document."""
        count, first, a = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64), self.arrays
        h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
        at = self.mph.index(h1)
        if len(a["fingerprint"]):
            hit = (at >= 0) & (a["fingerprint"][at] == h2)
            count[hit], first[hit] = a["count"][at[hit]], a["first"][at[hit]]
        for k in range(len(a["spare_h1"])):
            hit = (h1 == a["spare_h1"][k]) & (h2 == a["spare_fingerprint"][k])
            count[hit], first[hit] = a["spare_count"][k], a["spare_first"][k]
        return count, first


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> tuple[Column, Column]:
    """Two hashes for each line of ``text``, in order; null for lines whose key is short."""
    keys = F.transform(F.split(text, "\n", -1), lambda x: F.translate(F.btrim(x, F.lit(TRIMMED)), UPPER, LOWER))
    long = F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, k))
    first = F.transform(long, lambda k: F.when(k.isNotNull(), F.xxhash64(k)))
    second = F.transform(long, lambda k: F.when(k.isNotNull(), F.xxhash64(F.lit("line"), k)))
    return first, second


def shard_of(h1: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), h1), F.lit(shards)).cast("int")


def build_index(docs: DataFrame, path: str, tables: Scratch) -> int:
    """Writes the shards for the repeated lines of ``docs`` (doc, h1, h2); returns their number."""
    lines = docs.select("doc", F.explode(F.array_distinct(F.arrays_zip("h1", "h2"))).alias("line")).filter("line.h1 is not null")
    found = lines.groupBy(F.col("line.h1").alias("h1"), F.col("line.h2").alias("h2")).agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    repeated = tables.keep(found.filter("first < last").select("h1", "h2", "n", "first"), "repeated")
    shards = math.ceil(repeated.count() / SHARD_KEYS)
    if not shards:
        return 0
    dealt = repeated.withColumn("shard", shard_of(F.col("h1"), shards)).repartition(shards, "shard")

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        Shard.build(*(rows[c].to_numpy() for c in ("h1", "h2", "n", "first"))).save(f"{path}/shard-{key[0]:06d}.npz")
        return pd.DataFrame({"shard": [key[0]], "n": [len(rows)]})

    stored(dealt.groupBy("shard").applyInPandas(write, "shard int, n long"), "line-shards", f"{path}/shards")
    tables.drop("repeated")
    return shards


def probed(lines: DataFrame, path: str, shards: int) -> DataFrame:
    """The rows of ``lines`` (text_key, doc, n, h1, h2) that go: text_key, doc, n.

    Hashes go to the tasks of their shard, which open it once each; those of a
    shard are dealt out by the text, so that a very common line isn't one
    task's work.
    """
    parts = F.pmod(F.col("text_key"), F.lit(SPREAD)).cast("int")
    dealt = lines.withColumn("shard", shard_of(F.col("h1"), shards)).repartition("shard", parts).sortWithinPartitions("shard")
    schema = "text_key long, doc long, n int"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = -1, None
        for batch in batches:
            key, doc, n, h1, h2, part = (batch.column(c).to_numpy() for c in ("text_key", "doc", "n", "h1", "h2", "shard"))
            for k in np.unique(part):
                if k != held:
                    held, shard = k, Shard.load(f"{path}/shard-{k:06d}.npz")
                own = part == k
                count, first = shard.probe(h1[own], h2[own])
                gone = (count > 0) & (first != doc[own])
                if gone.any():
                    yield batch_of(schema, [key[own][gone], doc[own][gone], n[own][gone]])

    return dealt.mapInArrow(probe, schema)


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that an earlier document has; adds n_lines and n_dropped.

    A line's key is the line trimmed of ASCII white space, A-Z lower-cased. Keys
    of ``min_chars`` code points or more that are in two documents or more stay
    only in that with the smallest id, repeats inside it included; rows with
    equal ids are one document, null ids come last. Null or empty text is one
    empty line. All other columns pass through, whatever their names; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables, whole = Scratch(spark, "line-dedup"), text_or_empty(text)
    h1, h2 = line_hashes(whole, min_chars)
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_DOC))
    hashed = docs.select(doc.alias("doc"), F.xxhash64(whole).alias("text_key"), h1.alias("h1"), h2.alias("h2"))
    path = shared_dir(spark, "line-index")
    shards = build_index(hashed, path, tables)
    each = hashed.select("doc", "text_key", F.posexplode(F.arrays_zip("h1", "h2")).alias("n", "line")).filter("line.h1 is not null")
    drops = probed(each.select("text_key", "doc", "n", "line.h1", "line.h2"), path, shards) if shards else spark.createDataFrame([], "text_key long, doc long, n int")
    gone = tables.keep(drops.groupBy("text_key", "doc").agg(F.collect_set("n").alias("__gone")), "dropped-lines")

    def cut(texts: pa.Array, dropped: pa.Array) -> list[list]:
        out, sizes, n_dropped = [], [], []
        for t, drop in zip(texts.to_pylist(), dropped.to_pylist(), strict=True):
            t = t or ""
            sizes.append(t.count("\n") + 1)
            n_dropped.append(len(drop or ()))
            if drop:
                drop = set(drop)
                t = "\n".join(line for i, line in enumerate(t.split("\n")) if i not in drop)
            out.append(t)
        return [out, sizes, n_dropped]

    others = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    rows = docs.select(F.struct(F.lit(0), *others).alias("row"), F.col(text).alias("text"), F.xxhash64(whole).alias("text_key"), doc.alias("doc"))
    marked = rows.join(gone, ["text_key", "doc"], "left").select("row", "text", "__gone")
    made = appended(marked, "kept string, n_lines long, n_dropped long", cut, ["text", "__gone"], ("text", "__gone"))
    row = F.col("row")
    kept = [F.col("kept").alias(c) if c == text else row.getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return made.select(*kept, "n_lines", "n_dropped")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(generate_series(1, len(parts))) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.i, k.line, r.first IS NOT NULL AND r.first <> k.doc_id AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
