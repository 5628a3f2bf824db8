"""The trie of conversations by their first turns (operator 12).

Turns are numbered and fingerprinted in sorted ranges: numpy takes a running
polynomial sum over the turns of a range, and what a conversation had in
earlier ranges is added from a table with a row for each range at most, so no
conversation has to fit in a task. Conversations with equal fingerprints at a
depth are a candidate group. Every member's turn is compared with the turn of
the group's representative, its smallest conversation, and its parent's group
with that of the representative; members that differ are split off by their own
turn and parent, and the comparison is repeated until none differs. As parents
are compared as well as turns, groups then hold equal prefixes exactly.

A node is known by its representative and depth, so the ancestor of a node at
any distance is found by an equality join with one row on both sides. Sums over
subtrees take twice the distance in each round; nodes with one conversation are
chains without savings and one leaf, and only shared nodes take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import SPACE, Scratch, batch_of, joined_by, shared_dir, small_batches, stored, table
from tracelab.llm.importance import CRC, crc_sql

EVERY, HEADS = 20, 4  #: conversations that share a head, and the number of lengths that heads have
NO_CONV = (1 << 63) - 1  #: stands for a null conv_id, which is one conversation and the last
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 69069)
RUN = 4096  #: ids that are joined to one text before the digest


def power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """``base`` to each exponent modulo a prime under 2^31."""
    out, square, left = np.ones(len(exponents), np.int64), base, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def scanned(rows: DataFrame, by: list, value: str | None = None, depth: str | None = None) -> DataFrame:
    """``rows`` in ranges by ``conv`` and ``by``, with ``part``, ``local`` (rows of the conversation before it in the range) and f1, f2.

    f1 and f2 are running sums of ``value`` times powers of ``depth`` modulo two
    primes, this row included, also inside the range.
    """
    ranged = rows.repartitionByRange("conv", *by).sortWithinPartitions("conv", *by).withColumn("part", F.spark_partition_id())
    names = ranged.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, sums = None, 0, [0, 0]
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            sizes = np.diff(np.append(starts, len(conv)))
            goes_on = conv[0] == last
            local = np.arange(len(conv)) - np.repeat(starts, sizes)
            local[: sizes[0]] += n if goes_on else 0
            out = []
            for k, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
                if value is None:
                    out.append(np.zeros(len(conv), np.int64))
                    continue
                turn = (batch.column(value).to_numpy() >> (32 * k)) % prime
                total = np.cumsum(turn * power(base, batch.column(depth).to_numpy(), prime) % prime)
                before = np.append(0, total)[starts]
                before[0] -= sums[k] if goes_on else 0
                out.append((total - np.repeat(before, sizes)) % prime)
                sums[k] = int(out[k][-1])
            last, n = conv[-1], int(local[-1]) + 1
            new = batch_of("local long, f1 long, f2 long", [local, *out])
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.columns], names=[*names, "local", "f1", "f2"])

    return ranged.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*ranged.dtypes, ("local", "long"), ("f1", "long"), ("f2", "long")]))


def carried(rows: DataFrame) -> DataFrame:
    """The rows of ``scanned`` with ``local``, f1 and f2 for the whole conversation; a range has one row at most to carry on."""
    ends = rows.groupBy("conv", "part").agg((F.max("local") + 1).alias("n"), *(F.max_by(f, "local").alias(f) for f in ("f1", "f2")))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("conv", "part", *(F.sum(c).over(before).alias(f"c_{c}") for c in ("n", "f1", "f2"))).filter("c_n is not null")
    joined = rows.join(F.broadcast(carry), ["conv", "part"], "left")
    local = F.col("local") + F.coalesce("c_n", F.lit(0))
    sums = [((F.col(f) + F.coalesce(f"c_{f}", F.lit(0))) % p).alias(f) for f, p in zip(("f1", "f2"), PRIMES, strict=True)]
    return joined.select(*(c for c in rows.columns if c not in ("part", "local", "f1", "f2")), local.alias("local"), *sums)


def rebuilt(conversations: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, d, role, text, hash, words, last) of rebuilt conversations, and all conversations (conv, length)."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")}
    conv = F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONV)).alias("conv")
    turns = conversations.select(conv, F.col("turn"), *(c.alias(n) for n, c in text.items()))
    placed = tables.keep(carried(tables.keep(scanned(turns, [F.asc_nulls_first("turn"), "role", "text"]), "ranges")).select("conv", F.col("local").alias("pos"), "role", "text"), "placed")
    tables.drop("ranges")
    own = F.col("conv") != NO_CONV
    sizes = placed.groupBy("conv").agg(F.count("*").alias("n"))
    named = sizes.select("conv", "n", F.when(own, F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).otherwise(0).cast("long").alias("h"), F.when(own, F.col("conv") - F.col("conv") % EVERY).alias("giver"))
    givers = sizes.select(F.col("conv").alias("giver"), F.col("n").alias("given"))
    known = tables.keep(named.join(givers, "giver", "left").withColumn("take", F.least("h", F.coalesce("given", F.lit(0)))).withColumn("length", F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "known")
    firsts = placed.filter(F.col("pos") < HEADS - 1).withColumnRenamed("conv", "giver")
    head = known.join(firsts, "giver").filter(F.col("pos") < F.col("h")).select("conv", (F.col("pos") + 1).alias("d"), "role", "text", "length")
    rest = joined_by(placed, known.select("conv", "n", "h", "take", "length"), "conv", "n", placed.count())
    tail = rest.filter(F.col("pos") >= F.col("h")).select("conv", (F.col("pos") - F.col("h") + F.col("take") + 1).alias("d"), "role", "text", "length")
    words = F.regexp_count("text", F.lit(f"[^{SPACE}]+")).cast("long")
    made = head.unionByName(tail).select("conv", "d", "role", "text", F.xxhash64("role", "text").alias("hash"), words.alias("words"), (F.col("d") == F.col("length")).alias("last"))
    out = tables.keep(made, "turns")
    tables.drop("placed")
    return out, known.select("conv", "length")


def fingerprints(turns: DataFrame, tables: Scratch, bits: int = 62) -> DataFrame:
    """conv, d, words, last, fp and parent_fp: the fingerprints of the first d and d-1 turns, of ``bits`` bits."""
    narrow = tables.keep(scanned(turns.select("conv", "d", "hash", "words", "last"), ["d"], "hash", "d"), "ranges")
    now = carried(narrow)
    fp = (F.shiftleft(F.col("f1"), 31) + F.col("f2")).bitwiseAND((1 << bits) - 1)
    lagged = tables.keep(now.select("conv", "d", "words", "last", fp.alias("fp")), "prints-alone")
    tables.drop("ranges")
    above = lagged.select("conv", (F.col("d") + 1).alias("d"), F.col("fp").alias("parent_fp"))
    return tables.keep(lagged.join(above, ["conv", "d"], "left").select("conv", "d", "words", "last", "fp", F.coalesce("parent_fp", F.lit(0)).alias("parent_fp"), *(F.lit(0).cast("long").alias(c) for c in ("level", "label", "parent_level", "parent_label"))), "prints")


def verified(prints: DataFrame, turns: DataFrame, tables: Scratch) -> DataFrame:
    """conv, d, words, last, rep, n: each turn's node, after groups with unequal prefixes have been split."""
    total, level = prints.count(), 0
    group, parent = F.struct("d", "fp", "level", "label"), F.struct("parent_fp", "parent_level", "parent_label")
    while True:
        rows = prints.select("*", group.alias("group"), parent.alias("above"))
        groups = rows.groupBy("group").agg(F.count("*").alias("n"), F.min("conv").alias("rep"))
        counted = groups.withColumn("members", F.col("n"))
        path = tables.keep(joined_by(rows, counted, "group", "n", total).withColumnRenamed("members", "n"), "path")
        members = tables.keep(path.filter("n > 1").select("conv", "d", "group", "above", "rep", "n").join(turns.select("conv", "d", "role", "text"), ["conv", "d"]), "members")
        reps = members.filter("conv = rep").select("group", "n", F.struct("above", "role", "text").alias("first"))
        turn = F.struct("above", "role", "text")
        differ = joined_by(members.drop("n"), reps, "group", "n", total).filter(turn != F.col("first")).select("conv", "d", "group", turn.alias("turn"))
        bad = tables.keep(differ, "differ")
        if bad.isEmpty():
            tables.drop("members", "differ")
            return path.select("conv", "d", "words", "last", "rep", "n")
        level += 1
        labels = bad.groupBy("group", "turn").agg(F.min("conv").alias("new"))
        moved = tables.keep(bad.join(labels, ["group", "turn"]).select("conv", "d", "new"), "moved")
        below = moved.select("conv", (F.col("d") + 1).alias("d"), F.col("new").alias("new_parent"))
        both = prints.join(moved, ["conv", "d"], "left").join(below, ["conv", "d"], "left")
        put = {"level": ("new", F.lit(level).cast("long")), "label": ("new", F.col("new")), "parent_level": ("new_parent", F.lit(level).cast("long")), "parent_label": ("new_parent", F.col("new_parent"))}
        prints = tables.keep(both.select("conv", "d", "words", "last", "fp", "parent_fp", *(F.when(F.col(new).isNotNull(), value).otherwise(F.col(c)).alias(c) for c, (new, value) in put.items())), "prints")


def digests(ends: DataFrame) -> DataFrame:
    """rep, d, ends_sha256 of (rep, d, conv): the ids in order are joined in runs, and a node's runs hashed as a stream."""
    order = ["rep", "d", "conv"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, d, conv = (batch.column(c).to_numpy() for c in order)
            same = np.append(False, (rep[1:] == rep[:-1]) & (d[1:] == d[:-1]))[: len(rep)]
            starts = np.flatnonzero(~same)
            cuts = np.unique(np.concatenate([starts, np.arange(0, len(rep), RUN)]))
            bounds = zip(cuts, np.append(cuts[1:], len(rep)), strict=True)
            joined = [",".join("null" if c == NO_CONV else str(c) for c in conv[a:b].tolist()) for a, b in bounds]
            yield batch_of("rep long, d long, first long, ids string", [rep[cuts], d[cuts], conv[cuts], joined])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, made = None, None
        for batch in batches:
            out = []
            for rep, d, _, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "d", "first", "ids")), strict=True):
                if (rep, d) != node:
                    if node:
                        out.append((*node, made.hexdigest()))
                    node, made = (rep, d), hashlib.sha256(ids.encode())
                else:
                    made.update(f",{ids}".encode())
            yield batch_of("rep long, d long, ends_sha256 string", list(zip(*out, strict=True)) if out else [[], [], []])
        if node:
            yield batch_of("rep long, d long, ends_sha256 string", [[node[0]], [node[1]], [made.hexdigest()]])

    runs = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "rep long, d long, first long, ids string")
    return runs.repartition("rep", "d").sortWithinPartitions("rep", "d", "first").mapInArrow(digest, "rep long, d long, ends_sha256 string")


def rolled_up(nodes: DataFrame, path: DataFrame, tables: Scratch) -> DataFrame:
    """rep, d, leaves, saved: sums over the subtrees of shared nodes (rep, d, leaves, saved of their own)."""
    deepest = nodes.agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]
    # The path of a representative leads to its nodes' ancestors, which are shared as well.
    ways = path.filter("n > 1").select(F.col("conv").alias("rep"), F.col("d").alias("at"), F.col("rep").alias("up"))
    step, sums = 1, nodes
    while step < deepest:
        lower = sums.withColumn("at", F.col("d") - step).join(ways, ["rep", "at"])
        given = lower.groupBy(F.col("up").alias("rep"), F.col("at").alias("d")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        both = sums.join(given, ["rep", "d"], "left")
        sums = tables.keep(both.select("rep", "d", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved"))), "sums")
        step *= 2
    return sums


def prefix_trie(conversations: DataFrame, bits: int = 62) -> DataFrame:
    """The nodes of the trie of rebuilt ``conversations``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role and text; null role or
    text is empty; repeated rows are turns of their own. A conversation begins
    with the first turns of the one at the start of its block of ``EVERY`` ids,
    crc32 of its id modulo ``HEADS`` of them, and goes on with its own after as
    many. A null conv_id is one conversation without such a head, after all
    others, null in ``conv_id`` and in the digest. An empty table has no nodes,
    any other the root at least. Other columns aren't read. ``bits`` is for
    tests: fewer make fingerprints collide.
    """
    spark = conversations.sparkSession
    small_batches(spark, 4096)
    tables = Scratch(spark, "prefix-trie")
    turns, convs = rebuilt(conversations, tables)
    path = verified(fingerprints(turns, tables, bits), turns, tables)
    tables.drop("turns", "prints", "prints-alone")
    root = convs.agg(F.min("conv").alias("rep"), F.count("*").alias("n")).first()
    if not root["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    above = path.select(F.col("conv").alias("rep"), (F.col("d") + 1).alias("d"), F.col("rep").alias("parent"))
    nodes = tables.keep(path.filter("conv = rep").select("rep", "d", "n", "words").join(above, ["rep", "d"], "left").select("rep", "d", "n", "words", F.coalesce("parent", F.lit(root["rep"])).alias("parent")), "nodes")
    children = nodes.groupBy(F.col("parent").alias("rep"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("singles"))
    family = tables.keep(nodes.join(children, ["rep", "d"], "left").fillna(0, ["n_children", "singles"]), "family")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    shared = family.filter("n > 1").select("rep", "d", (leaf + F.col("singles")).alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    sums = rolled_up(shared, path, tables)
    ends = path.filter("last").select("rep", "d", "conv").unionByName(convs.filter("length = 0").select(F.lit(root["rep"]).alias("rep"), F.lit(0).cast("long").alias("d"), "conv"))
    known = family.join(sums, ["rep", "d"], "left").select("rep", "d", "parent", "n", "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"), F.coalesce("saved", F.lit(0).cast("long")).alias("saved"))
    known = tables.keep(known, "rolled")
    first = known.filter("d = 1")
    top = first.agg(F.count("*").alias("n_children"), F.coalesce(F.sum("leaves"), F.lit(1)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")).select(F.lit(root["rep"]).alias("rep"), F.lit(0).cast("long").alias("d"), F.lit(None).cast("long").alias("parent"), F.lit(root["n"]).cast("long").alias("n"), "n_children", "leaves", "saved")
    every = known.unionByName(top).join(digests(ends), ["rep", "d"], "left")

    def shown(c):
        return F.when(F.col(c) != NO_CONV, F.col(c))

    nothing = hashlib.sha256(b"").hexdigest()
    out = every.select(shown("rep").alias("conv_id"), F.col("d").alias("depth"), shown("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    result = stored(out, "trie", shared_dir(spark, "trie"))
    tables.drop(*list(tables.paths))
    return result


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH {CRC}, o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations
), c AS (
  SELECT conv_id, n, {crc_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - conv_id % 20 AS giver
  FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id), crc_table
), k AS (
  SELECT c.*, least(c.h, coalesce(g.n, 0)) AS take FROM c LEFT JOIN c g ON g.conv_id = c.giver
), r AS (
  SELECT k.conv_id, o.pos + 1 AS d, role, text FROM k JOIN o ON o.conv_id = k.giver AND o.pos < k.h
  UNION ALL
  SELECT k.conv_id, o.pos - h + take + 1, role, text FROM k JOIN o ON o.conv_id = k.conv_id AND o.pos >= k.h
), p AS (
  SELECT conv_id, d, text, string_agg(md5(md5(role) || md5(text)), '' ) OVER (PARTITION BY conv_id ORDER BY d) AS path,
         d = max(d) OVER (PARTITION BY conv_id) AS last
  FROM r
  UNION ALL SELECT conv_id, 0, '', '', conv_id NOT IN (SELECT conv_id FROM r) FROM c
), n AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n,
         (count(*) - 1) * len(regexp_extract_all(min(text), '[^\\x20\\x09-\\x0D]+')) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM p GROUP BY path, d
), f AS (
  SELECT n.*, u.conv_id AS parent, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND starts_with(x.path, n.path)) AS n_children
  FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.path = substr(n.path, 1, 32 * (CAST(n.d AS INTEGER) - 1))
)
SELECT a.conv_id, a.d AS depth, a.parent AS parent_conv_id, a.n AS n_convs, a.n_children,
       count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM f a JOIN f b ON starts_with(b.path, a.path)
GROUP BY a.conv_id, a.d, a.parent, a.n, a.n_children, a.ends_sha256
"""
