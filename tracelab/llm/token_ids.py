"""Token ids as packed binary files (operator 1).

Each id takes the least number of bits that holds the vocabulary. A file holds
the ids of a range of documents in ascending order of ``doc_id``: a header,
blocks of ``BLOCK`` ids each packed into whole 64-bit words, the offset of each
block, and an index of the documents (id, first id in the file). A reader takes
the footer and then the blocks of the documents it wants, not the rest.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import batch_of, file_system, new_file, shared_dir, small_batches, stored, table, text_or_empty

MAGIC = b"TIDS0002"
HEADER = struct.Struct("<8sIIQQQQ")  # magic, bits, ids in a block, ids, documents, those without id, offset of the footer
BLOCK = 4096
FILE_IDS = 1 << 24  #: ids of a file; a longer document has one for itself
FILES = "path string, part int, seq int, n_docs long, n_ids long"
MEMO_ENTRIES = 500_000

# Letters of the Latin blocks; with ASCII they make up the texts for which the
# memo of pieces applies. Any other character sends the text through the tokenizer whole.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER = re.compile(rf"[^\x20-\x7e\n\r\t{_LETTER}]")
_WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, little end first, filled up to groups of 64 ids."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(rows), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8", copy=False).tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    rows = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        rows[:, j] = value & mask
    return rows.reshape(-1)[:count]


class PieceTable:
    """Open-addressed table from the hash of a piece of text to its bytes and ids, probed by array."""

    def __init__(self, entries: int):
        self.log2 = max(8, (2 * entries - 1).bit_length())
        self.keys, self.codes = np.zeros(1 << self.log2, np.uint64), np.zeros(1 << self.log2, np.int32)
        self.entries, self.n = entries, 0
        self.ids, self.id_at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)
        self.raw, self.raw_at = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The code of each hash, -1 where there is none."""
        code, slot, mask = np.full(len(h), -1, np.int64), (h >> np.uint64(64 - self.log2)).astype(np.int64), (1 << self.log2) - 1
        open_ = np.arange(len(h))
        while len(open_):
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            code[open_[hit]] = self.codes[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
            slot[open_] = (slot[open_] + 1) & mask
        return code

    def add(self, h: np.ndarray, raws: list[bytes], ids: list[list[int]], keep: np.ndarray) -> np.ndarray:
        """Codes of new pieces; those not in ``keep`` get codes that hold until ``forget``."""
        codes = self.n + np.arange(len(h))
        for name, at, parts in (("ids", "id_at", ids), ("raw", "raw_at", raws)):
            flat, starts = getattr(self, name), getattr(self, at)
            ends = starts[self.n] + np.cumsum([len(x) for x in parts])
            if ends[-1] > len(flat):
                setattr(self, name, flat := np.concatenate([flat, np.zeros(max(int(ends[-1]), len(flat)), flat.dtype)]))
            if self.n + len(h) >= len(starts):
                setattr(self, at, starts := np.concatenate([starts, np.zeros(len(h) + len(starts), np.int64)]))
            flat[int(starts[self.n]) : int(ends[-1])] = np.frombuffer(b"".join(parts), np.uint8) if name == "raw" else [i for x in parts for i in x]
            starts[self.n + 1 : self.n + 1 + len(h)] = ends
        todo = np.flatnonzero(keep)
        slot = (h >> np.uint64(64 - self.log2)).astype(np.int64)
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.codes[slot[put]] = h[put], codes[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.log2) - 1)
        self.n += len(h)
        return codes

    def forget(self, n: int) -> None:
        self.n = n


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for count[0] values, then those from first[1], and so on."""
    end = np.cumsum(count)
    return np.repeat(first - end + count, count) + np.arange(int(end[-1]) if len(end) else 0)


class Encoder:
    """Whole texts to ids with a ``tokenizers`` file.

    A byte-level BPE without normalizer encodes each word by itself, and words
    begin at their space. So texts of Latin letters are cut at spaces, and
    the ids of each distinct piece are kept, for at most ``entries`` pieces;
    later ones are encoded each time. Kept bytes are compared with the text,
    so equal hashes can't mix up pieces. Other texts go through the tokenizer
    as they are, as do all texts with another kind of tokenizer.
    """

    GROUP, LONG = 1 << 18, 64  # bytes taken at once; a longer piece isn't kept
    P = 0x9E3779B97F4A7C15

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        pre, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.by_piece = self.tokenizer.normalizer is None and isinstance(pre, ByteLevel) and not pre.add_prefix_space and pre.use_regex and isinstance(model, BPE) and not model.dropout
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level alphabet: printable bytes stand for themselves, the rest for the code points from 256
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: 256 + k for k, b in enumerate(others)}
        self.table, self.powers, self.inverse = PieceTable(entries), np.ones(1, np.uint64), np.ones(1, np.uint64)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, raw: bytes) -> list[int]:
        tokenize, ids = self.tokenizer.model.tokenize, []
        for word in _WORD.findall(raw.decode()):
            ids += [t.id for t in tokenize(word.encode().decode("latin-1").translate(self.alphabet))]
        return ids

    def _grow(self, n: int) -> None:
        if n >= len(self.powers):
            n = max(n, self.GROUP) + 1
            for name, p in (("powers", self.P), ("inverse", pow(self.P, -1, 1 << 64))):
                setattr(self, name, np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, p, np.uint64))]))

    def _group(self, raws: list[bytes]) -> list[np.ndarray] | None:
        """Ids of texts taken together; None if two pieces have one hash."""
        raw, t = b"".join(raws), self.table
        size = np.array([len(x) for x in raws])
        begin = np.cumsum(size) - size
        b, n = np.frombuffer(raw, np.uint8), len(raw)
        if not n:
            return [np.zeros(0, np.uint32) for _ in raws]
        self._grow(n)
        space = (b == 32) | (b == 10) | (b == 13) | (b == 9)
        after = np.append(space[1:], True)
        after[(begin + size)[size > 0] - 1] = True
        cut = (b == 32) & ~(np.append(True, space[:-1]) & after)
        cut[begin[size > 0]] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], n)
        total = np.concatenate([[np.uint64(0)], np.cumsum(b * self.powers[:n])])
        h = (total[e] - total[s]) * self.inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h[h == 0] = 1
        code, kept = t.find(h), t.n
        missing = np.flatnonzero(code < 0)
        if len(missing):
            new, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            pieces = [raw[s[i] : e[i]] for i in missing[one]]
            keep = np.array([len(x) <= self.LONG for x in pieces]) & (t.n + len(new) <= t.entries)
            order = np.argsort(~keep, kind="stable")  # kept ones first, so that the rest can go again
            codes = np.empty(len(new), np.int64)
            codes[order] = t.add(new[order], [pieces[i] for i in order], [self._piece(pieces[i]) for i in order], keep[order])
            code[missing] = codes[back]
            kept += int(keep.sum())
        at, length = t.raw_at[code], t.raw_at[code + 1] - t.raw_at[code]
        same = bool((length == e - s).all()) and bool((t.raw[_ragged(at, length)] == b).all())
        first = t.id_at[code]
        count = t.id_at[code + 1] - first
        ids, end = t.ids[_ragged(first, count)], np.append(0, np.cumsum(count))
        t.forget(kept)
        bound = end[np.searchsorted(s, np.append(begin, n))]
        return [ids[x:y] for x, y in zip(bound[:-1], bound[1:], strict=True)] if same else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_piece:
            return self._whole(texts)
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if _OTHER.search(t) or any(s in t for s in self.special)]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        group, size = [], 0
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i in rest:
            group.append(i)
            size += len(texts[i])
            if size >= self.GROUP or i == rest[-1]:
                got = self._group([texts[k].encode() for k in group]) or self._whole([texts[k] for k in group])
                for k, ids in zip(group, got, strict=True):
                    out[k] = ids
                group, size = [], 0
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class IdWriter:
    """Writes one file block by block; ``close`` gives its numbers of documents and ids."""

    def __init__(self, out: BinaryIO, bits: int):
        self.out, self.bits = out, bits
        self.doc_ids, self.starts, self.offsets = [], [], []
        self.nulls, self.n_ids, self.held, self.kept = 0, 0, [], 0
        self.at = out.write(HEADER.pack(MAGIC, bits, BLOCK, 0, 0, 0, 0))

    def _put(self, ids: np.ndarray) -> None:
        for k in range(0, len(ids), BLOCK):
            self.offsets.append(self.at)
            self.at += self.out.write(pack(ids[k : k + BLOCK], self.bits))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """The next document; those with a null id come before all others."""
        self.nulls += doc_id is None
        self.doc_ids.append(doc_id or 0)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.kept += len(ids)
        if self.kept >= 64 * BLOCK:
            ids = np.concatenate(self.held)
            full = self.kept // BLOCK * BLOCK
            self._put(ids[:full])
            self.held, self.kept = [ids[full:]], self.kept - full

    def close(self) -> tuple[int, int]:
        self._put(np.concatenate([np.zeros(0, np.uint32), *self.held]))
        for part in (np.array(self.offsets, "<u8"), np.array(self.doc_ids, "<i8"), np.array([*self.starts, self.n_ids], "<u8")):
            self.out.write(part.tobytes())
        self.out.write(HEADER.pack(MAGIC, self.bits, BLOCK, self.n_ids, len(self.doc_ids), self.nulls, self.at))
        return len(self.doc_ids), self.n_ids


class IdFile:
    """Random access to one file; reads the footer once, and then just the blocks that are asked for."""

    def __init__(self, path: str):
        system, at = file_system(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        magic, self.bits, self.block, self.n_ids, n_docs, nulls, footer = HEADER.unpack(self.file.read_at(HEADER.size, size - HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a file of token ids")
        tables, n_blocks = self.file.read_at(size - HEADER.size - footer, footer), -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(tables, "<u8", n_blocks)
        self.doc_ids = [None if k < nulls else d for k, d in enumerate(np.frombuffer(tables, "<i8", n_docs, 8 * n_blocks).tolist())]
        self.starts = np.frombuffer(tables, "<u8", n_docs + 1, 8 * (n_blocks + n_docs)).astype(np.int64)

    def __enter__(self) -> IdFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` of the file, from the blocks that hold them."""
        if end <= first:
            return np.zeros(0, np.uint32)
        b0, b1 = first // self.block, -(-end // self.block)
        size = -(-self.block // 64) * self.bits * 8
        last = -(-(min(self.n_ids, b1 * self.block) - (b1 - 1) * self.block) // 64) * self.bits * 8
        data = self.file.read_at(size * (b1 - b0 - 1) + last, int(self.offsets[b0]))
        ids = unpack(data, self.bits, min(self.n_ids, b1 * self.block) - b0 * self.block)
        return ids[first - b0 * self.block : end - b0 * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def each(self) -> Iterator[np.ndarray]:
        """The ids of one document after the other; whole blocks are read, some at a time."""
        got, lo, hi = np.zeros(0, np.uint32), 0, 0
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            if b > hi:
                lo, hi = a, min(self.n_ids, max(b, a + 256 * BLOCK))
                got = self.ids(lo, hi)
            yield got[a - lo : b - lo]


def write_token_ids(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of every text to files in ``out_dir``, in ascending order of ``doc_id``.

    Each text, null taken as empty, is followed by ``end_id``. Documents are
    dealt to tasks by range of ``doc_id``, those with equal ids by the hash of
    their text; a task begins a new file when one has ``file_ids`` ids. Null ids
    come first. Returns a row for each file: path, part, seq, n_docs, n_ids. An
    empty table gives no file. Other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bits = bits_for(encoder(tokenizer).vocabulary)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task = encoder(tokenizer), TaskContext.get()

        def encoded():
            for batch in batches:
                docs_, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for k in range(0, len(texts), 32):
                    for d, ids in zip(docs_[k : k + 32], code.encode(texts[k : k + 32]), strict=True):
                        yield d, np.append(ids, np.uint32(end_id))

        rows = encoded()
        following, seq = next(rows, None), 0
        while following is not None:
            # a task that runs again writes other files, and the index names those whose rows were kept
            path = f"{out_dir}/part-{task.partitionId():06d}-{seq:06d}-{task.taskAttemptId()}.ids"
            with new_file(path) as out:
                file = IdWriter(out, bits)
                while following is not None and (not file.n_ids or file.n_ids + len(following[1]) <= file_ids):
                    file.add(*following)
                    following = next(rows, None)
                n_docs, n_ids = file.close()
            yield batch_of(FILES, [[path], [task.partitionId()], [seq], [n_docs], [n_ids]])
            seq += 1

    return stored(ranged.mapInArrow(write, FILES), "token-index", f"{out_dir}/index")


def read_token_ids(files: DataFrame) -> DataFrame:
    """Reads the files again: per document doc_id, start, n_tokens and the crc32 of its ids.

    A file's first place is the sum of the ids of those before it; this runs
    over a row for each file. A task reads a file's footer, then its blocks.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    dealt = files.select("path", starts.cast("long").alias("before")).repartition(max(1, files.count()), "path")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with IdFile(path) as f:
                    crc = [zlib.crc32(ids.astype("<u4", copy=False).tobytes()) for ids in f.each()]
                    yield batch_of(schema, [f.doc_ids, start + f.starts[:-1], np.diff(f.starts), np.array(crc, np.int64)])

    return dealt.mapInArrow(read, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_ids(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes and reads back all of ``docs``; what the query and the pipeline's last stage return."""
    path = shared_dir(docs.sparkSession, "token-ids")
    return read_token_ids(write_token_ids(docs, path, tokenizer or default_tokenizer()))


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))
