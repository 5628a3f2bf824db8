"""Language identification by error-correcting output codes (operator 4).

Each language has a codeword; for each bit a logistic classifier over hashed
byte n-grams tells the languages with a 1 from those with a 0. A text's bit
margins are compared with every codeword by a loss weighted with how well each
bit's classifier does, and the nearest codeword gives the language. A text whose
two nearest codewords are almost as near as each other is flagged.

Training takes at most ``PER_LANGUAGE`` labelled rows of each language, chosen
by a hash of their id and text, whole texts; prediction takes every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import appended, small_batches, table

PER_LANGUAGE = 500
DIMENSIONS = 1 << 13
MAX_BITS = 31
STEPS, RATE, DECAY = 150, 0.5, 1e-4
AMBIGUOUS = 0.1  #: lead of the best over the second score below which a text is flagged
UNKNOWN = "und"
SCALE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_BYTES = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text))


def features(text: str) -> np.ndarray:
    """Roots of the counts of hashed 2- and 3-byte grams, ASCII signs and digits as spaces; length 1."""
    b = _BYTES[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    b = np.concatenate([[np.uint32(32)], b, [np.uint32(32)]]).astype(np.uint32)
    space = b == 32
    b = b[~(space & np.append(False, space[:-1]))]  # a run of spaces counts as one
    half = DIMENSIONS // 2
    two = (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(7)
    three = (b[:-2] * np.uint32(0x27D4EB2F) + b[1:-1] * np.uint32(0x165667B1) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(7)
    counts = np.sqrt(np.concatenate([np.bincount(two % half, minlength=half), np.bincount(three % half, minlength=half)]).astype(np.float32))
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def codewords(languages: int, max_bits: int = MAX_BITS, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 for each language; all splits for a few languages, else distant random ones."""
    if languages < 2:
        return np.zeros((languages, 0))
    if 2 ** (languages - 1) - 1 <= max_bits:
        splits = np.arange(1, 2 ** (languages - 1))
        return np.where((splits[None, :] >> np.arange(languages)[:, None]) & 1, 1.0, -1.0)
    bits, rng = max(max_bits, int(np.ceil(5 * np.log2(languages)))), np.random.default_rng(seed)

    def closest(code: np.ndarray) -> float:
        near = np.abs(code @ code.T)
        return float((near - np.diag(np.diag(near))).max())

    return min((np.where(rng.random((languages, bits)) < 0.5, 1.0, -1.0) for _ in range(50)), key=closest)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of features: number of the language, score in 0 to 1, and whether it is ambiguous."""
        if not self.languages:
            return np.full(len(x), -1), np.zeros(len(x)), np.ones(len(x), bool)
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = np.sort(p, axis=1)[:, ::-1]
        lead = top[:, 0] - top[:, 1] if p.shape[1] > 1 else np.ones(len(x))
        return best, top[:, 0].astype(float), lead < AMBIGUOUS


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """Trains all bits at once by full-batch gradient steps with momentum; the same for the same rows."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = np.searchsorted(languages, labels) if languages else np.zeros(0, np.int64)
    target = code[y].astype(np.float32)
    share = np.bincount(y, minlength=len(languages)).astype(np.float32)
    weight = (1 / share[y])[:, None] if len(y) else np.zeros((0, 1))
    w, b = np.zeros((DIMENSIONS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS if code.shape[1] else 0):
        g = -target * weight / (1 + np.exp(target * (x @ w + b))) / len(languages)
        speed_w = 0.9 * speed_w - RATE * 20 * (x.T @ g + DECAY * w)
        speed_b = 0.9 * speed_b - RATE * g.sum(axis=0)
        w, b = w + speed_w, b + speed_b
    right = ((x @ w + b) * target > 0).mean(axis=0) if len(y) and code.shape[1] else np.zeros(code.shape[1])
    trust = np.clip(2 * right - 1, 0.05, 1)
    return Model(languages, code, w, b, trust / max(trust.sum(), 1e-9) * min(code.shape[1], len(languages)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from labelled rows that aren't held out; without any, it knows no language.

    Takes at most ``per_language`` rows of each language, those with the
    smallest hash of id and text; rows equal in both count once.
    """
    known = docs.filter(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit("language"), F.col(doc_id), F.col(text)).alias("at"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # a row for each language
    limit = F.lit(0)
    for name, n in sorted(counts.items()):  # some more than asked for, which the order by hash then cuts
        limit = F.when(F.col("lang") == name, F.lit(min(SCALE, -(-SCALE * (per_language + 100) // n)))).otherwise(limit)
    drawn = known.filter(F.pmod(F.col("at"), F.lit(SCALE)) < limit)
    least = drawn.groupBy("lang", "at").agg(F.first("text").alias("text"))
    chosen = least.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("at"))).filter(F.col("n") <= per_language)

    def featurised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["text"].map(has_letter).astype(bool)]
            vectors = [features(t) for t in batch["text"]]
            at = [np.flatnonzero(v).astype(np.int32) for v in vectors]
            yield pd.DataFrame({"lang": batch["lang"].tolist(), "at": batch["at"].tolist(), "index": at, "value": [v[i] for v, i in zip(vectors, at, strict=True)]})

    rows = chosen.select("lang", "at", "text").mapInPandas(featurised, "lang string, at long, index array<int>, value array<float>").collect()
    rows.sort(key=lambda r: (r["lang"], r["at"]))
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for k, r in enumerate(rows):
        x[k, r["index"]] = r["value"]
    return fit(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous added; only the text decides.

    A text that is null or has no letters gets ``und`` with score 0 and is
    ambiguous, as does every text if the model knows no language. Texts are
    read whole, however long; repeated rows get equal results; ties between
    languages go to the first by name. Columns with the added names are
    replaced; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def predict(column: pa.Array) -> list:
        names, texts = np.array([*model.languages, UNKNOWN], object), column.to_pylist()
        found, score, flag = np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts), bool)
        usable = np.array([i for i, t in enumerate(texts) if t and has_letter(t)], np.int64)
        if len(usable) and model.languages:
            found[usable], score[usable], flag[usable] = model.decode(np.stack([features(texts[i]) for i in usable]))
        return [names[found].tolist(), score, flag]

    return appended(docs, "lang_pred string, score double, ambiguous boolean", predict, [text])


def accepted(docs: DataFrame, **names) -> DataFrame:
    """``docs`` without the rows whose language can't be told: no letters, or two codewords as near as each other.

    Null and empty texts go; repeated rows stay or go together. All columns
    pass through, whatever their names. An empty table has no rows, and where
    no row has a label all go, as no language is known.
    """
    model = train(docs, **names)
    marked = docs.select(F.col(names.get("text", "text")).alias("text"), F.struct(*docs.columns).alias("row"))
    found = identify(marked, model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select("row.*")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(named, train(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
