"""Resampling documents towards a target by hashed n-gram importance (operator 11).

Tasks read texts in blocks of about ``BLOCK_BYTES`` and number the distinct
words of each block; documents become arrays of these numbers. Spark gives every
distinct word of all blocks an integer id, which turns the distinct n-grams of
each block into tuples of ids. Every distinct tuple is spelled out and its bytes
are hashed to a bucket once; counts and gains are joined back by tuple, block by
block, so a word or n-gram meets no join more than once for each block,
however common it is. The draw is a global order over ranges, not one sort.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import Scratch, joined_by, small_batches, table, text_or_empty

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 10, 20, 2024
BLOCK_BYTES = 32 << 20  #: bytes of text in a block; a longer text is a block of its own
CHUNK = 50_000  #: words or n-grams of a block in one stored row
COPIES = 4096  #: equal rows that are written out by one row
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("ids", pa.list_(pa.int32())), ("first", pa.int64()), ("size", pa.int32()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("m", pa.list_(pa.int64()))])
_BLOCKS_DDL = "block long, doc_id long, key long, ids array<int>, first long, size int, words array<string>, n array<long>, m array<long>"


def grams(ids: np.ndarray, row: np.ndarray, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the distinct runs of ``ids`` inside a row in order, and for each place which of them starts there, and the place's row."""
    words, at = np.unique(ids, return_inverse=True)
    keys, now, rows = words[:, None], at, row
    for size in range(1, most + 1):
        if size > 1:
            whole = row[: max(len(row) - size + 1, 0)] == row[size - 1 :]
            pairs, now = np.unique(now[: len(whole)][whole] * len(words) + at[size - 1 :][whole], return_inverse=True)
            keys = np.column_stack([keys[pairs // max(len(words), 1)], words[pairs % max(len(words), 1)]])
            rows = row[: len(whole)][whole]
            # places of the next length are counted among all places again
            full = np.zeros(len(row), np.int64)
            full[np.flatnonzero(whole)] = now
            starts, now = now, full
        else:
            starts = now
        if size >= least:
            yield keys, starts, rows


def _blocks(texts: DataFrame, least: int, most: int) -> DataFrame:
    """Rows for each document (block, doc_id, key, ids), and for each block its words and its distinct n-grams with counts."""

    def rows(block: int, held: list, vocabulary: dict) -> Iterator[pa.RecordBatch]:
        def batch(count, **columns):
            columns["block"] = [block] * count
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in _BLOCKS], schema=_BLOCKS)

        for k in range(0, len(held), 256):
            part = [x for x in held[k : k + 256] if x[2] == 0]
            if part:
                yield batch(len(part), doc_id=[x[0] for x in part], key=[x[1] for x in part], ids=[x[3] for x in part])
        words = [w.decode() for w in vocabulary]
        for k in range(0, len(words), CHUNK):
            yield batch(1, first=[k], words=[words[k : k + CHUNK]])
        ids, row = np.concatenate([x[3] for x in held]), np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
        target, number = np.array([x[2] for x in held]), 0
        for keys, starts, places in grams(ids, row, least, most):
            m = np.bincount(starts, target[places], len(keys)).astype(np.int64)
            n = np.bincount(starts, minlength=len(keys)) - m
            for k in range(0, len(keys), CHUNK):
                cut = slice(k, k + CHUNK)
                yield batch(1, first=[number + k], size=[keys.shape[1]], ids=[keys[cut].ravel()], n=[n[cut]], m=[m[cut]])
            number += len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, vocabulary, size = TaskContext.get().partitionId() << 32, [], {}, 0
        for b in batches:
            for doc_id, key, target, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "target", "text")), strict=True):
                if held and size + len(text) > BLOCK_BYTES:
                    yield from rows(block, held, vocabulary)
                    block, held, vocabulary, size = block + 1, [], {}, 0
                put = vocabulary.setdefault
                held.append((doc_id, key, target, np.array([put(w, len(vocabulary)) for w in WORD.findall(text.lower())], np.int32)))
                size += len(text)
        if held:
            yield from rows(block, held, vocabulary)

    return texts.mapInArrow(run, _BLOCKS_DDL)


def _translated(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """block, no, gram, n, m: the distinct n-grams of each block as tuples of the dictionary's ids."""
    schema = "block long, no long, gram array<long>, n long, m long"

    def run(key: tuple, chunks: pa.Table, known: pa.Table) -> pa.Table:
        local, found = known.column("local").to_numpy(), known.column("id").to_numpy()
        of = np.zeros(len(local), np.int64)
        of[local] = found
        parts = []
        for c in chunks.to_pylist():
            flat, size = of[np.array(c["ids"], np.int64)], c["size"]
            count = len(flat) // size
            gram = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size), pa.int32()), pa.array(flat))
            parts.append(pa.table({"block": np.full(count, key[0].as_py()), "no": np.arange(count) + c["first"], "gram": gram, "n": pa.array(c["n"], pa.int64()), "m": pa.array(c["m"], pa.int64())}))
        return pa.concat_tables(parts) if parts else pa.table({"block": pa.array([], pa.int64()), "no": pa.array([], pa.int64()), "gram": pa.array([], pa.list_(pa.int64())), "n": pa.array([], pa.int64()), "m": pa.array([], pa.int64())})

    chunks = blocks.filter("size is not null").select("block", "first", "size", "ids", "n", "m")
    return chunks.groupBy("block").cogroup(ids.groupBy("in_block")).applyInArrow(run, schema)


def _spelled(tuples: DataFrame, dictionary: DataFrame, most: int, tables: Scratch) -> DataFrame:
    """Adds ``text``, the words of each distinct tuple joined by a space."""
    if most == 1:  # every id is one tuple
        return tuples.withColumn("id", F.get("gram", F.lit(0))).join(dictionary, "id").select("gram", "n", "m", F.col("word").alias("text"))
    places = tables.keep(tuples.select("gram", F.posexplode("gram").alias("at", "id")), "places")
    uses = dictionary.join(places.groupBy("id").agg(F.count("*").alias("uses")), "id")
    words = joined_by(places, uses, "id", "uses", places.count())
    spelled = words.groupBy("gram").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    return tuples.join(spelled, "gram")


def _weighted(blocks: DataFrame, gains: DataFrame, least: int, most: int) -> DataFrame:
    """doc_id, key, n_words, n_features, weight for each document, from the gains of its block's n-grams."""
    schema = "doc_id long, key long, n_words long, n_features long, weight long"

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        gain = np.zeros(len(known), np.int64)
        gain[known.column("no").to_numpy()] = known.column("gain").to_numpy()
        each = docs.column("ids").combine_chunks()
        sizes, ids = np.diff(each.offsets.to_numpy()), each.flatten().to_numpy()
        total, features, number = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), 0
        for keys, starts, places in grams(ids, np.repeat(np.arange(len(docs)), sizes), least, most):
            np.add.at(total, places, gain[starts + number])
            features += np.bincount(places, minlength=len(docs))
            number += len(keys)
        return pa.table({"doc_id": docs.column("doc_id"), "key": docs.column("key"), "n_words": sizes.astype(np.int64), "n_features": features, "weight": total // np.maximum(features, 1)})

    docs = blocks.filter("key is not null").select("block", "doc_id", "key", "ids")
    return docs.groupBy("block").cogroup(gains.groupBy("block")).applyInArrow(run, schema)


def _ranked(scored: DataFrame, share: int, least_words: int, tables: Scratch) -> DataFrame:
    """Adds ``rank`` to (doc_id, key, copies, ...): 1 for the best, null beyond the share."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key")]
    placed = tables.keep(scored.filter(F.col("n_words") >= least_words).repartitionByRange(*best).withColumn("part", F.spark_partition_id()), "placed")
    parts = placed.groupBy("part").agg(F.sum("copies").alias("rows"))
    n = parts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    ahead = parts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    upto = F.sum("copies").over(Window.partitionBy("part").orderBy(*best).rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("upto", upto).join(F.broadcast(ahead), "part").withColumn("first", F.col("ahead") + F.col("upto") - F.col("copies") + 1)
    rest = scored.filter(F.col("n_words") < least_words).withColumn("first", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest).withColumn("last_rank", F.lit(share * n // 100))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number between 0 and 1 from a hash of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / 4294967296.0


def drawn(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The weight and draw of each distinct (doc_id, text) of ``docs``: doc_id, key, copies, n_words, n_features, weight, score, first, last_rank.

    ``key`` is xxhash64 of the text. Words are runs of letters and digits and
    of signs beyond ASCII, A-Z lower-cased; features are all runs of ``least``
    to ``most`` words. ``weight`` is the floored mean of the features' gains
    (0 without features), in thousandths of the logarithm of how much more
    frequent their bucket is in ``target``; ``score`` adds a Gumbel draw from a
    hash of the id. Rows with ``least_words`` words or more are ranked by score,
    then id (null last), then key; ``copies`` equal rows take the ranks from
    ``first`` on, and a row is drawn if its rank is ``last_rank`` at most. Null
    and empty texts have no words; an empty table has no rows, an empty target
    gives plain weights.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables = Scratch(spark, "importance")

    def side(df, number):
        return df.select((F.col("doc_id").cast("long") if number == 0 else F.lit(None).cast("long")).alias("doc_id"), F.xxhash64(text_or_empty()).alias("key"), F.lit(number).alias("target"), text_or_empty().cast("binary").alias("text"))

    blocks = tables.keep(_blocks(side(docs, 0).unionByName(side(target, 1)), least, most), "blocks")
    words = blocks.filter("words is not null").select("block", "first", F.posexplode("words").alias("at", "word")).select("block", (F.col("first") + F.col("at")).alias("local"), "word")
    dictionary = tables.keep(words.select("word").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    ids = words.join(dictionary, "word").select(F.col("block").alias("in_block"), "local", "id")
    translated = tables.keep(_translated(blocks, ids), "translated")
    tuples = translated.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    hashed = tables.keep(_spelled(tuples, dictionary, most, tables).select("gram", (F.crc32(F.col("text").cast("binary")) % buckets).cast("int").alias("bucket"), "n", "m"), "hashed")
    counts = hashed.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("m").alias("t"))
    all_s, all_t = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = ((F.col("t") + 1) * F.lit(all_s + buckets)).cast("double") / ((F.col("s") + 1) * F.lit(all_t + buckets)).cast("double")
    gains = counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    known = translated.select("block", "no", "gram").join(hashed.join(F.broadcast(gains), "bucket").select("gram", "gain"), "gram").select("block", "no", "gain")
    weighted = _weighted(blocks, known, least, most)
    noise = F.floor(-1000 * F.log(-F.log(uniform(F.col("doc_id"), seed))))
    equal = weighted.groupBy("doc_id", "key").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_words", "n_features", "weight")))
    scored = tables.keep(equal.withColumn("score", F.col("weight") + noise), "scored")
    tables.drop("blocks", "dictionary", "translated", "hashed", "places")
    return _ranked(scored, share, least_words, tables)


def ranks(draws: DataFrame) -> DataFrame:
    """A row for each row of the documents: doc_id, n_features, weight, score, rank (null: not drawn)."""
    runs = draws.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    each = runs.withColumn("nth", F.explode(F.sequence(F.col("run") * COPIES, F.least((F.col("run") + 1) * COPIES, F.col("copies")) - 1)))
    rank = F.col("first") + F.col("nth")
    return each.select("doc_id", "n_features", "weight", "score", F.when(rank <= F.col("last_rank"), rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn towards ``target``, with all their columns.

    Options and odd inputs as in ``drawn``. Equal ids with equal texts share a
    place in the order; where the draw ends among such rows, as many of them
    stay as there's room for.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("key"))
    taken = drawn(docs, target, **options).filter(F.col("first") <= F.col("last_rank")).select(F.col("doc_id").alias("id2"), F.col("key").alias("key2"), "copies", (F.col("last_rank") - F.col("first") + 1).alias("room"))
    taken = Scratch(docs.sparkSession, "resampled").keep(taken, "taken")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))
    whole = rows.join(taken.filter("copies <= room"), same, "left_semi").select("row.*")
    last = taken.filter("copies > room").select("room").first()  # one group of equal rows at most
    if last is None:
        return whole
    return whole.unionAll(rows.join(F.broadcast(taken.filter("copies > room")), same, "left_semi").limit(last[0]).select("row.*"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


#: CRC-32 of a word's UTF-8 bytes from the table of the reversed polynomial EDB88320.
CRC = """
crc_table AS (
  SELECT list(v ORDER BY i) AS tbl
  FROM (SELECT i, list_reduce(list_prepend(i, generate_series(1, 8)),
          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END) AS v
        FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))
)"""


def crc_sql(column: str) -> str:
    """SQL for the unsigned CRC-32 of a string column; needs ``crc_table`` beside it."""
    data = f"hex(encode({column}))"
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len({data}) // 2),
      lambda i: CAST('0x' || substr({data}, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
      lambda c, b: xor(c // 256, tbl[xor(c, b) % 256 + 1])), CAST(4294967295 AS BIGINT))"""


ORACLE = rf"""
WITH {CRC}, d AS (
  SELECT row_number() OVER () AS no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), f AS (
  SELECT no, word, count(*) AS n FROM (SELECT no, unnest(words) AS word FROM d) GROUP BY no, word
), c AS (
  SELECT word, sum(n) AS n, sum(m) AS m
  FROM (SELECT word, n, 0 AS m FROM f UNION ALL SELECT word, 0, 1 FROM b) GROUP BY word
), h AS (
  SELECT word, n, m, {crc_sql("word")} % 10000 AS bucket FROM c, crc_table
), g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (all_s + 10000) AS DOUBLE) / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT bucket, sum(n) AS s, sum(m) AS t, sum(sum(n)) OVER () AS all_s, sum(sum(m)) OVER () AS all_t FROM h GROUP BY bucket)
), w AS (
  SELECT no, CAST(sum(f.n) AS BIGINT) AS n_features, CAST(sum(f.n * gain) AS BIGINT) AS total FROM f JOIN h USING (word) JOIN g USING (bucket) GROUP BY no
), s AS (
  SELECT d.no, d.doc_id, len(d.words) AS n_words, coalesce(w.n_features, 0) AS n_features,
         coalesce(CAST(floor(CAST(total AS DOUBLE) / w.n_features) AS BIGINT), 0) AS weight,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN w USING (no)
), r AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM s
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (WHERE n_words >= 20) OVER () AS n
  FROM r
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM o
"""
