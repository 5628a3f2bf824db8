"""Near-duplicate documents by consistent weighted sampling (operator 7).

A document is a weighted set of shingles of ``SHINGLE`` words; a shingle weighs
its number of occurrences times an inverse document frequency. Frequencies are
counted shingle by shingle over all documents. A shingle that at most one in
``COMMON`` documents has weighs the most, so only the others' frequencies are
needed later, and of these there are at most ``COMMON`` times as many as a
document has on average, however many documents there are. Improved consistent weighted
sampling draws ``BANDS`` x ``ROWS`` shingles from each document so that two
documents draw the same one with the chance of their weighted Jaccard
similarity; documents that agree on all rows of a band are candidates, and
candidates with a similarity of ``SIMILARITY`` or more are linked. Classes are
the connected components of links and exact copies.

Exact copies are put together first. In a bucket each document is then compared
with the first one. Pairs of a bucket that are still in different components
after that are compared in groups of bounded size, of which only the links that
join parts go on; so a bucket of a thousand copies of a text costs a thousand
comparisons, and no link is lost.

A similar pair always shares one of the first shingles of both, where these are
put in one order, rare ones first, and a fifth of the weight is taken
(``prefix``). Large buckets are cut into groups by these shingles, and inside
groups they tell which pairs to compare. That loses no pair, so it makes no
difference to the result by which groups a bucket's pairs are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import Scratch, batch_of, joined_by, small_batches, table, text_or_empty
from tracelab.llm.components import components
from tracelab.llm.words import grouped, mixed, window_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
COMMON = 1000  #: a shingle weighs less than the most if more than one in so many documents have it
SPAN = 0.5  #: by how much a rare shingle outweighs one of all documents; more would tear large groups of near copies
TOGETHER = 1 << 21  #: shingles counted together in a task
TABLE_BITS = 14  #: entries of the tables of random values for each sample
CHUNK = 512  #: documents of a bucket that are compared with each other in one group
ROUNDS = 3  #: further members that those of a large bucket are compared with first
BROADCAST_ROWS = 2_000_000  #: ids (8 bytes each) that are broadcast; more are joined by a shuffle
NO_DOC = (1 << 63) - 1
SEED = 20


def shingles(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of texts, and the text of each, whose shingles stand together; fewer words make one shingle of all."""
    words, begin = word_hashes(texts)
    h, at = window_hashes(words, begin, tuple(range(width)))
    text = np.searchsorted(begin, at, "right") - 1
    size = np.diff(begin)
    few = np.flatnonzero((size > 0) & (size < width))
    for n in range(1, width):
        of = few[size[few] == n]
        if len(of):
            more, places = window_hashes(words, begin, tuple(range(n)))
            own = np.isin(np.searchsorted(begin, places, "right") - 1, of)
            h, text = np.concatenate([h, more[own]]), np.concatenate([text, np.searchsorted(begin, places[own], "right") - 1])
    return mixed(h), text


def weighted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles text by text: hash, number of times, text."""
    h, text = shingles(texts)
    for own in np.split(h, np.flatnonzero(text[1:] != text[:-1]) + 1):
        own.sort()
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[: len(h)])
    return h[first], np.diff(np.append(first, len(h))).astype(np.float64), text[first]


class Weights:
    """Weight of every shingle: 1 where all documents have it, ``1 + SPAN`` where at most one in ``COMMON`` does.

    Between these it falls with the logarithm of the frequency. ``known`` are
    the shingles of more documents, ``df`` their numbers of documents.
    """

    def __init__(self, documents: int, known: np.ndarray, df: np.ndarray):
        def weight(df):  # a shingle that isn't known has one document, or fewer than the limit
            return 1 - SPAN * np.log(np.clip(df / max(1, documents), 1 / COMMON, 1)) / math.log(COMMON)

        order = np.argsort(known)
        self.known, self.weight, self.rest = known[order].astype(np.uint64), weight(df[order].astype(np.float64)), float(weight(1.0))

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(h), self.rest)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.weight[at], self.rest)


def frequencies(docs: DataFrame, text: str = "text") -> Weights:
    """Weights from the number of documents that have each shingle, counted shingle by shingle over all documents.

    The shingles that more than one in ``COMMON`` documents have come to the
    driver, 16 bytes each. As each takes up a place in so many documents, they
    are at most ``COMMON`` times the mean number of shingles of a document.
    """
    n_docs = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return batch_of("shingle long, n long", [h.view(np.int64), n])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in grouped(texts):
                held.append(weighted(texts[part])[0])
                size += len(held[-1])
                if size >= TOGETHER:
                    yield summed()
                    held, size = [], 0
        if size:
            yield summed()

    # Counts of a task are added up before they are dealt out; most shingles are rare, so there is no more to gain.
    dealt = docs.select(F.col(text).alias("text")).mapInArrow(count, "shingle long, n long").repartition("shingle")
    got = dealt.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") * COMMON > n_docs).filter("n > 1").toPandas()
    return Weights(n_docs, got["shingle"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64))


class Sampler:
    """Improved consistent weighted sampling with random values from seeded tables."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        rng, shape = np.random.default_rng(seed), (samples, 1 << TABLE_BITS)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)
        self.turn = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def draw(self, h: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row for each run of elements that begins at ``first``, with a 64-bit code for each sample."""
        log_w, wide = np.log(weight).astype(np.float32), mixed(h)
        size = np.diff(np.append(first, len(h)))
        out = np.empty((len(first), len(self.turn)), np.uint64)
        for k, turn in enumerate(self.turn):
            turned = wide * turn
            at = (turned >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
            r = self.r[k][at]
            t = np.floor(log_w / r + self.beta[k][at])
            rank = self.log_c[k][at] - r * (t - self.beta[k][at] + 1)
            best = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, first), size))
            # elements with one table entry can tie; the smallest code decides
            code = mixed(turned[best] + t[best].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[:, k] = np.minimum.reduceat(code, np.searchsorted(best, first))
        return out


def similarity(a: np.ndarray, b: np.ndarray, weights: Weights) -> float:
    """Weighted Jaccard similarity of two sorted arrays of shingle hashes, repeats included."""
    if not len(a) or not len(b):
        return 0.0
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    w, v = weights.of(x), weights.of(y)
    common = float((np.minimum(n[i], m[j]) * w[i]).sum())
    return common / (float((n * w).sum() + (m * v).sum()) - common)


def signatures(texts: DataFrame, weights: Weights) -> DataFrame:
    """doc, samples (a 64-bit value for each) for each (doc, text); texts without words are left out."""
    sent = texts.sparkSession.sparkContext.broadcast(weights)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            doc, all_texts = batch.column("doc").to_numpy(), batch.column("text").to_pylist()
            for part in grouped(all_texts):
                h, times, text = weighted(all_texts[part])
                if len(h):
                    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                    codes = sampler.draw(h, times * sent.value.of(h), first).view(np.int64)
                    samples = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, SAMPLES, dtype=np.int32), codes.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(doc[part][text[first]]), samples], names=["doc", "samples"])

    return texts.select("doc", "text").mapInArrow(sign, "doc long, samples array<long>")


def _named(h: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64-bit names of shingles with the number of their repeat."""
    return mixed(h.astype(np.uint64) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix(h: np.ndarray, weights: Weights, least: float) -> np.ndarray:
    """64-bit names of the first elements of a sorted array of shingle hashes, rare ones first.

    Elements are shingles with the number of their repeat. They go on until
    what follows weighs less than ``least`` of all, so two texts with a
    similarity of ``least`` or more have at least one in common.
    """
    run = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    nth = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    w, code = weights.of(h), mixed(h)
    order = np.lexsort((nth, code, -w))
    upto = np.cumsum(w[order])
    taken = order[: int(np.searchsorted(upto, (1 - least + 1e-9) * upto[-1], "right")) + 1] if len(h) else order
    return _named(code[taken], nth[taken])


def shingled(texts: DataFrame) -> DataFrame:
    """doc, shingles (sorted 64-bit hashes, repeats included) for each (doc, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of("doc long, shingles binary", [batch.column("doc"), [np.sort(shingles([t])[0]).tobytes() for t in batch.column("text").to_pylist()]])

    return texts.select("doc", "text").mapInArrow(cut, "doc long, shingles binary")


def prefixes(own: DataFrame, weights: Weights, least: float) -> DataFrame:
    """doc, tokens for each (doc, shingles)."""
    sent = own.sparkSession.sparkContext.broadcast(weights)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [prefix(np.frombuffer(s, np.uint64), sent.value, least).view(np.int64) for s in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(tokens, pa.list_(pa.int64()))], names=["doc", "tokens"])

    return own.mapInArrow(cut, "doc long, tokens array<long>")


def _shingles_of(ids: DataFrame, texts: DataFrame, tables: Scratch, name: str, rows: int) -> DataFrame:
    """doc, shingles of the given ids alone."""
    asked = tables.keep(ids, f"{name}-ids", rows)
    few = asked.count() <= BROADCAST_ROWS
    return tables.keep(shingled(texts.join(F.broadcast(asked) if few else asked, "doc", "left_semi")), name)


def _linked(pairs: DataFrame, texts: DataFrame, weights: Weights, least: float, tables: Scratch, name: str, rows: int) -> DataFrame:
    """The pairs (a, b) whose similarity is ``least`` or more."""
    sent = pairs.sparkSession.sparkContext.broadcast(weights)
    pairs = tables.keep(pairs, "pairs", rows)
    own = _shingles_of(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), texts, tables, "pair-shingles", rows)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            got = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), sent.value) >= least for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(got))

    one = pairs.join(own.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b")
    two = one.join(own.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a")
    out = tables.keep(two.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), name)
    tables.drop("pairs", "pair-shingles", "pair-shingles-ids")
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join parts which no earlier pair has joined."""
    root, out = list(range(n)), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = top(x), top(y)
        if u != v:
            root[u] = v
            out.append((x, y))
    return out


def similar_pairs(sets: list[np.ndarray], weights: Weights, least: float, columns: int = 2048) -> np.ndarray:
    """Whether each two of some sorted arrays of shingle hashes are similar, by sums over shared shingles.

    The sums of all pairs are one matrix product, taken over blocks of the
    shingles that at least two arrays have; those near the limit are summed
    again in double precision.
    """
    size = np.array([len(x) for x in sets])
    own, h = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    run = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])))
    nth = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    weight = weights.of(h)
    total = np.bincount(own, weight, len(sets))
    place, count = np.unique(_named(h, nth), return_inverse=True, return_counts=True)[1:]
    shared = np.flatnonzero(count > 1)
    column = np.full(len(count), -1)
    column[shared] = np.arange(len(shared))
    at = column[place]
    common = np.zeros((len(sets), len(sets)))
    for k in range(0, len(shared), columns):
        here = (at >= k) & (at < k + columns)
        m = np.zeros((len(sets), min(columns, len(shared) - k)), np.float32)
        m[own[here], at[here] - k] = np.sqrt(weight[here])
        common += m @ m.T
    ratio = common / np.maximum(total[:, None] + total[None, :] - common, 1e-12)
    out = ratio >= least
    for i, j in np.argwhere(np.triu(np.abs(ratio - least) < 1e-5, 1)):
        out[i, j] = out[j, i] = similarity(sets[i], sets[j], weights) >= least
    return out


def likely_pairs(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, weights: Weights, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (i < j) of different label that share an element of their prefixes, which all similar pairs do.

    ``side`` is the chunk of each set; where there are two, pairs go from one to
    the other. None if there are so many that all pairs are better compared.
    """
    tokens = [prefix(s, weights, least) for s in sets]
    token, own = np.concatenate(tokens), np.repeat(np.arange(len(sets)), [len(t) for t in tokens])
    order = np.lexsort((own, token))
    token, own = token[order], own[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
    size = np.diff(np.append(first, len(token)))
    if float((size.astype(float) ** 2).sum()) > 8 * len(token) + len(sets) ** 2:
        return None
    codes = [np.zeros(0, np.int64)]
    for step in range(1, int(size.max(initial=1))):  # pairs of a token at each distance
        at = np.flatnonzero(np.repeat(size, size) - (np.arange(len(token)) - np.repeat(first, size)) > step)
        codes.append(np.unique(own[at] * len(sets) + own[at + step]))
    code = np.unique(np.concatenate(codes))
    i, j = code // len(sets), code % len(sets)
    good = (label[i] != label[j]) & ((side[i] != side[j]) | bool((side == side[0]).all()))
    return i[good], j[good]


def sharing(buckets: list[list[int]], i: np.ndarray, j: np.ndarray, together: int = 1 << 15) -> np.ndarray:
    """Whether the members i and j of each pair have a bucket in common."""
    if len({tuple(b) for b in buckets}) == 1:
        return np.ones(len(i), bool)
    most = max(map(len, buckets))
    own = np.array([[*b, *[b[0]] * (most - len(b))] for b in buckets], np.int64)
    parts = [(own[i[k : k + together], :, None] == own[j[k : k + together], None, :]).any(axis=(1, 2)) for k in range(0, len(i), together)]
    return np.concatenate([np.zeros(0, bool), *parts])


def links_in(docs: np.ndarray, label: np.ndarray, side: np.ndarray, buckets: list[list[int]], sets: list[np.ndarray], weights: Weights, least: float) -> list[tuple[int, int]]:
    """Links between members of a group that share a bucket and are in different components, as many as join its parts."""
    pairs = likely_pairs(sets, label, side, weights, least) if len(sets) > 8 else None
    if pairs is None:
        i, j = np.triu_indices(len(sets), 1)
        apart = (label[i] != label[j]) & ((side[i] != side[j]) | bool((side == side[0]).all()))
        pairs = i[apart], j[apart]
    i, j = pairs
    met = sharing(buckets, i, j)
    i, j = i[met], j[met]
    if len(i) <= 2 * len(sets):
        good = np.array([similarity(sets[x], sets[y], weights) >= least for x, y in zip(i, j, strict=True)], bool)
    else:
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        good = similar_pairs([sets[k] for k in used], weights, least)[place[: len(i)], place[len(i) :]]
    return [(int(docs[x]), int(docs[y])) for x, y in _forest(len(docs), i[good], j[good])]


def _in_groups(members: DataFrame, size: int) -> DataFrame:
    """Members (bucket, doc, label, buckets) in groups (bucket, kind, i, j) that hold all pairs of different components.

    A bucket of at most ``size`` members is one group. Of a larger one only the
    largest component goes without pairs among itself: the others are cut into
    chunks, and each of these meets the chunks of the largest (kind 0) and of
    the others (kind 1). ``side`` tells the chunks of a group apart.
    """
    parts = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    tops = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top")).select("bucket", "n", F.col("n").alias("all"), F.col("top.label").alias("main"), F.ceil(F.col("top.n") / size).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("top.n")) / size).cast("int").alias("others"))
    known = joined_by(members, tops, "bucket", "n", members.count())
    turn = lambda of: F.pmod(F.xxhash64("doc"), F.greatest(F.col(of), F.lit(1))).cast("int")
    group = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    of_main = F.transform(upto("others"), lambda i: group(0, i, turn("mains")))
    of_others = F.concat(F.transform(upto("mains"), lambda j: group(0, turn("others"), j)), F.transform(upto("others"), lambda j: group(1, F.least(turn("others"), j), F.greatest(turn("others"), j))))
    whole = F.array(group(2, F.lit(0), F.lit(0)))
    few, main = F.col("all") <= size, F.col("label") == F.col("main")
    groups = F.when(few, whole).when(main, of_main).otherwise(of_others)
    side = F.when(few, F.lit(0)).when(main, F.lit(-1)).otherwise(turn("others"))
    return known.select("bucket", "doc", "label", "buckets", side.alias("side"), F.explode(groups).alias("g")).select("bucket", "g.kind", "g.i", "g.j", "side", "doc", "label", "buckets")


def _open_links(dealt: DataFrame, own: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Links (a, b) that join components, found inside the groups (bucket, kind, i, j) of ``dealt``."""
    sent = dealt.sparkSession.sparkContext.broadcast(weights)
    group = ["bucket", "kind", "i", "j"]
    rows = dealt.join(own, "doc").repartition(*group).sortWithinPartitions(*group, "doc")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in (*group, "doc", "label", "side", "buckets", "shingles")), strict=True))
        found: list[tuple[int, int]] = []
        for _, members in groupby(each, key=itemgetter(0, 1, 2, 3)):
            *_, doc, label, side, buckets, sets = zip(*members, strict=True)
            if len(set(label)) > 1:
                found += links_in(np.array(doc), np.array(label), np.array(side), list(buckets), [np.frombuffer(s, np.uint64) for s in sets], sent.value, least)
            if len(found) >= TOGETHER:
                yield batch_of("a long, b long", list(zip(*found, strict=True)))
                found = []
        if found:
            yield batch_of("a long, b long", list(zip(*found, strict=True)))

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _open(entries: DataFrame, labels: DataFrame, tables: Scratch, rows: int) -> DataFrame:
    """The entries (bucket, doc) of buckets that hold several components, with label and the bucket's number n."""
    labelled = entries.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", F.coalesce("label", "doc").alias("label"))
    buckets = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).filter("least <> most").select("bucket", "n")
    return tables.keep(labelled.join(tables.keep(buckets, "open-buckets", rows), "bucket"), "open-rows", rows)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """A row for each document: doc_id, text_hash, class_id, class_size.

    ``class_id`` is the smallest doc_id of the documents that are linked by
    copies and near copies. Null text is empty; texts without words are linked
    only to equal ones. Rows with equal ids are one document with several
    texts, each of which counts in class_size. A null id counts as the largest. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables, whole = Scratch(spark, "near-dup"), text_or_empty(text)
    text_hash = F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit("copy"), whole).alias("b"))
    named = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_DOC)).alias("doc"), whole.alias("text"), text_hash.alias("text_hash"))
    weights = frequencies(named)
    keys = tables.keep(named.select("doc", "text_hash"), "keys")
    n_docs = keys.count()
    rows = BANDS * n_docs
    copies = tables.keep(keys.groupBy("text_hash").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "copies", n_docs)

    # Every document is signed where it is read; of equal texts only the first goes on.
    texts = named.select("doc", "text")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("samples", i * ROWS + 1, ROWS)))
    spread = signatures(texts, weights).select("doc", F.posexplode(band).alias("i", "key")).select("doc", F.xxhash64("i", "key").alias("bucket"))
    entries = tables.keep(spread.join(copies.select(F.col("first").alias("doc")).distinct(), "doc", "left_semi").distinct(), "entries", rows)

    # Each document against the first of its bucket. Then, in buckets that hold
    # several components and many documents, against others of them.
    heads = entries.groupBy("bucket").agg(F.min("doc").alias("head"), F.count("*").alias("n")).filter("n > 1")
    known = tables.keep(heads, "heads", rows)
    star = joined_by(entries, known, "bucket", "n", rows).filter("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct()
    links = _linked(star, texts, weights, least, tables, "links", rows)
    shared = tables.keep(joined_by(entries, known.select("bucket", "n", F.col("n").alias("size")), "bucket", "n", rows).withColumnRenamed("size", "n"), "shared", rows)
    labels = components(links, tables)
    members = _open(shared, labels, tables, rows)
    # Further members are those that meet most others in all of their buckets, as what others were copied from does.
    degree = shared.groupBy("doc").agg(F.sum("n").alias("met"))
    large = tables.keep(members.filter(F.col("n") > CHUNK).join(degree, "doc").select("bucket", "doc", F.struct("met", "doc").alias("rank")), "large", rows)
    for turn in range(ROUNDS):
        pivots = tables.keep(large.groupBy("bucket").agg(F.max("rank").alias("pivot"), F.count("*").alias("n")), "pivots", rows)
        met = joined_by(large, pivots, "bucket", "n", rows)
        further = met.filter(F.col("doc") != F.col("pivot.doc")).select(F.least("doc", "pivot.doc").alias("a"), F.greatest("doc", "pivot.doc").alias("b")).distinct()
        if further.isEmpty():
            break
        links = links.unionByName(_linked(further, texts, weights, least, tables, f"links-{turn}", rows))
        large = tables.keep(met.filter(F.col("rank") < F.col("pivot")).select("bucket", "doc", "rank"), "large", rows)
    labels = components(links, tables)
    members = _open(members.select("bucket", "doc"), labels, tables, rows)

    # All pairs of a bucket that are still apart: in groups of the whole bucket, and where it is
    # large in groups of those that share a token of their prefixes, whatever their large buckets.
    own = _shingles_of(members.select("doc").distinct(), texts, tables, "open-shingles", rows)
    large = members.filter(F.col("n") > CHUNK)
    held = large.groupBy("doc").agg(F.first("label").alias("label"), F.sort_array(F.collect_set("bucket")).alias("buckets"))  # at most ``BANDS`` of each
    tokens = prefixes(own.join(held.select("doc"), "doc", "left_semi"), weights, least)
    tokened = tables.keep(held.join(tokens, "doc").select(F.explode("tokens").alias("bucket"), "doc", "label", "buckets"), "tokens")
    apart = tokened.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).filter("least <> most").select("bucket", "n")
    small = members.filter(F.col("n") <= CHUNK).select("bucket", "doc", "label", F.array("bucket").alias("buckets"))
    groups = small.unionByName(joined_by(tokened, apart, "bucket", "n", tokened.count()).select("bucket", "doc", "label", "buckets"))
    groups = tables.keep(groups, "groups")
    more = tables.keep(_open_links(_in_groups(groups, CHUNK), own, weights, least), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more), tables)
    tables.drop("entries", "heads", "shared", "large", "pivots", "open-buckets", "open-rows", "open-shingles", "open-shingles-ids", "tokens", "groups", "links", *(f"links-{k}" for k in range(ROUNDS)), "more-links")

    found = copies.join(labels.withColumnRenamed("node", "first"), "first", "left").select("text_hash", F.coalesce("label", "first").alias("class"), "n")
    classes = tables.keep(found, "classes", n_docs)
    sizes = classes.groupBy("class").agg(F.sum("n").alias("class_size"), F.count("*").alias("texts"))
    sized = joined_by(classes, sizes, "class", "texts", n_docs)
    known = joined_by(keys, sized, "text_hash", "n", n_docs)
    out_id = [F.nullif(F.col(c), F.lit(NO_DOC)).alias(o) for c, o in (("doc", "doc_id"), ("class", "class_id"))]
    return known.select(out_id[0], "text_hash", out_id[1], "class_size")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with the first document of each class; rows equal in id and text stay together. Columns may have any names."""
    whole = text_or_empty(text)
    gone = near_duplicates(docs, doc_id, text, least).filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("gone"), "text_hash").distinct()
    here = F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit("copy"), whole).alias("b"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), here.alias("here"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("gone")) & (F.col("here") == F.col("text_hash")), "left_anti").select("row.*")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
