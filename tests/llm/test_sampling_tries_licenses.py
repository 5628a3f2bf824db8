"""Importance resampling, the trie of conversations and license scans against plain loops and odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import same_rows
from tracelab.llm import decontaminate, html_text, importance, licenses, line_dedup, mixing, near_dup, prefix_trie

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, row string, key long, rank string, __doc string"


def words_of(text):
    return WORDS.findall((text or "").translate(ASCII_LOWER))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "r", 7, "x", "d") for i, t in rows], DOCS)


def random_texts(n, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "The", "aé", "Éa", "of", "x1", "中文", "K", *(f"w{i}" for i in range(60))]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    return [" ".join(rng.choice(vocabulary, rng.integers(0, 80), p=p / p.sum())) for _ in range(n)]


ODD = [(None, None), (None, None), (1, ""), (1, "word " * 50), (1, "word " * 50), (2, "  \n--"), (3, "naïve " * 30_000), (3, "É é É"), (2**62 + 1, "The the " * 20), (None, "a b " * 30)]


# 11 importance

def plain_draw(rows, target, least, most, share, least_words):
    def features(text):
        w = words_of(text)
        return [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([x for _, x in rows], target))
    gains = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    out = []
    for i, text in rows:
        f = features(text)
        weight = sum(gains[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, text])
    able = sorted((x for x in out if len(words_of(x[5])) >= least_words), key=lambda x: (-x[3], x[0] is None, x[0]))
    for place, x in enumerate(able[: share * len(able) // 100]):
        x[4] = place + 1
    return out


@pytest.mark.parametrize("least, most, block", [(1, 1, 500), (1, 2, 700), (2, 3, 1 << 20)])
def test_draw_equals_plain_loops(spark, monkeypatch, least, most, block):
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    monkeypatch.setattr(importance, "CHUNK", 7)
    rows = list(enumerate(random_texts(120))) + ODD[:3]
    target = random_texts(9, 2) + [None]
    got = importance.ranks(importance.drawn(docs(spark, rows), docs(spark, [(0, t) for t in target]), least, most, share=30))
    have = sorted(map(tuple, got.collect()), key=repr)
    assert have == sorted((tuple(x[:5]) for x in plain_draw(rows, target, least, most, 30, 20)), key=repr)


def test_draw_of_odd_texts(spark):
    d = docs(spark, ODD)
    got = importance.ranks(importance.drawn(d, d.limit(0), share=50)).collect()
    want = plain_draw(ODD, [], 1, 1, 50, 20)
    assert sorted([tuple(x)[:4] for x in got], key=repr) == sorted([tuple(x[:4]) for x in want], key=repr)
    assert sorted(x["rank"] for x in got if x["rank"]) == [1, 2]
    assert importance.ranks(importance.drawn(d.limit(0), d)).count() == 0


def test_drawn_documents_keep_their_columns(spark, monkeypatch):
    monkeypatch.setattr(importance, "COPIES", 2)
    d = docs(spark, [*enumerate(random_texts(60)), *[(500, "same " * 30)] * 9])
    for share in (10, 95):
        ranks = importance.ranks(importance.drawn(d, d.limit(3), share=share)).filter("rank is not null")
        out = importance.resampled(d, d.limit(3), share=share)
        assert out.columns == d.columns and sorted(r[0] for r in out.collect()) == sorted(r[0] for r in ranks.collect())
        assert sorted(r["rank"] for r in ranks.collect()) == list(range(1, ranks.count() + 1))


# 12 trie

def plain_trie(rows):
    turns = {}
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3])):
        turns.setdefault(conv, []).append((role, text))
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        made[c] = (turns.get(c - int(math.fmod(c, 20)), [])[:h] if c is not None else []) + own[h:]
    rank = lambda c: (c is None, c)
    members = {}
    for c in sorted(made, key=rank):
        for d in range(len(made[c]) + 1):
            members.setdefault(tuple(made[c][:d]), []).append(c)
    out = []
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        childless = [p for p in below if not any(q[:-1] == p for q in members if q)]
        ends = ",".join("null" if c is None else str(c) for c in inside if len(made[c]) == len(path))
        out.append((inside[0], len(path), members[path[:-1]][0] if path else None, len(inside), sum(q[:-1] == path for q in members if q), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, d long")


def some_turns(seed, n=70):
    rng, rows = np.random.default_rng(seed), []
    for c in [*range(n), 2**61 + 40, 2**61 + 41, -7]:
        rows += [(c, t, ["user", "bot"][t % 2], f"say {rng.integers(0, 2)}  b") for t in range(rng.integers(1, 5))]
    rows += [(c, t, "user", "copy me") for c in (200, 201, 205, 207) for t in range(4)]
    rows += [(None, None, None, None), (None, 1, "user", "x y"), (3, None, "user", None), (3, None, "user", None), (4, 2, "bot", "tie"), (4, 2, "bot", "also")]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("bits", [62, 2])
def test_trie_equals_plain_loops(spark, bits):
    """With few bits nearly all groups are mixed and have to be split."""
    rows = some_turns(bits)
    got = prefix_trie.prefix_trie(conversations(spark, rows), bits)
    assert got.dtypes[1] == ("depth", "bigint")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_trie(rows), key=repr)


def test_conversations_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(c, t, "user", f"turn {t % 3}") for c in (0, 1, 2, 40) for t in range(90)] + [(5, 0, "user", "alone")]
        got = prefix_trie.prefix_trie(conversations(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(tuple, got), key=repr) == sorted(plain_trie(rows), key=repr)


def test_trie_of_little(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [(0, 0, "a", "b")]).limit(0)).count() == 0
    for rows in ([(21, 0, "a", "b")], [(None, 0, "", ""), *((c, 0, "", "") for c in range(25))]):
        assert sorted(map(tuple, prefix_trie.prefix_trie(conversations(spark, rows)).collect()), key=repr) == sorted(plain_trie(rows), key=repr)


def test_digest_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    ends = spark.range(0, 1000, 1, 16).select(F.lit(3).cast("long").alias("rep"), (F.col("id") % 2).alias("d"), (F.col("id") * 10**9).alias("conv"))
    got = {r["d"]: r["ends_sha256"] for r in prefix_trie.digests(ends).collect()}
    for d in (0, 1):
        assert got[d] == hashlib.sha256(",".join(str(i * 10**9) for i in range(1000) if i % 2 == d).encode()).hexdigest()


# 13 licenses

def license_rows():
    rng = np.random.default_rng(3)
    filler, rows = [f"word{i}" for i in range(50)], []
    for no, (_, text) in enumerate(licenses.TEMPLATES):
        words = licenses.template_words(text)
        for share in (1.0, 0.9, 0.75, 0.5):
            kept = [w if rng.random() < share else rng.choice(filler) for w in words]
            before, after = rng.integers(0, 600, 2)
            line = "\n * ".join([*rng.choice(filler, before), *kept, *rng.choice(filler, after)])
            rows.append((100 * no + int(share * 10), line.upper() if no % 2 else line))
    return rows


MORE = [(1, None), (1, ""), (2, "MIT License, mit license"), (3, "Cc-by cc by CC\nBY"), (None, "the Apache\tLicense; GNU general public license"), (4, "x" * 100_000 + " MIT License"), (5, "é" * 50_000), (5, "smit license mit licenses émit license"), (6, "word " * 40_000 + "mit license")]


@pytest.mark.parametrize("templates, threshold", [(licenses.TEMPLATES, 80), (licenses.TEMPLATES, 60), (licenses.TEMPLATES[:1], 100), ((), 80)])
def test_licenses_equal_sql(spark, templates, threshold):
    rows = license_rows() + MORE
    got = licenses.license_labels(docs(spark, rows), templates, threshold=threshold).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    if templates:
        same_rows(got, con.execute(licenses.oracle(templates, threshold=threshold)).df())
    else:
        assert (got["labels"] == got["base_labels"]).all()
    if threshold == 80 and templates:
        found = dict(zip(got["doc_id"], got["labels"], strict=True))
        for no, (label, _) in enumerate(templates):
            assert label in found[100 * no + 10].split(",")


def test_phrases_at_every_place(spark):
    rows = license_rows()[:3] + MORE
    for r, (_, text) in zip(licenses.license_labels(docs(spark, rows).coalesce(1)).select("n_words", "n_base", "first_word", "last_word").collect(), rows, strict=True):
        w = words_of(text)
        places = [i for p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert tuple(r) == (len(w), len(places), min(places, default=None), max(places, default=None))


def test_overlapping_phrases(spark):
    d = docs(spark, [(1, "a b a b a"), (2, "b a")])
    got = licenses.license_labels(d, phrases={"a b a": "x", "b a": "y"}).orderBy("doc_id").collect()
    assert [tuple(r)[2:6] for r in got] == [(4, 0, 3, "x,y"), (1, 0, 0, "y")]


def test_license_blocks_and_empty_table(spark):
    text = "word " * 300 + licenses.TEMPLATES[0][1]
    blocks = licenses.license_blocks(docs(spark, [(9, text)])).collect()
    assert {(b["doc_id"], b["template"], b["label"]) for b in blocks} == {(9, 0, "mit")}
    assert any(b["containment"] == 1 and b["first_word"] <= 300 for b in blocks)
    assert licenses.license_labels(docs(spark, [(9, text)]).limit(0)).count() == 0


def test_no_python_in_the_license_plan(spark):
    plan = licenses.scanned(docs(spark, MORE), licenses.TEMPLATES, licenses.PHRASES, 80)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Columns with names that operators use themselves

NAMES = ("row", "text_hash", "here", "gone", "id", "key", "text_key", "doc", "item_id", "__doc", "__key", "__id", "__hash", "__nth", "__copy", "__size", "__gone", "__path", "path", "host", "label", "kept", "class_id")


def test_columns_of_any_name_pass_through(spark):
    texts = ["one two three four five six seven\nand a line that comes again", "other words here and there\nand a line that comes again", None, "the answer to this question is hidden in a long text of words"]
    rows = [(i, t, "s", *(f"{n}-{i}" for n in NAMES)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))
    bench = spark.createDataFrame([(1, "the answer to this question is hidden in a long text of words", "x")], "item_id long, text string, doc_id string")

    def held(df, ids):
        assert df.columns[: len(d.columns)] == d.columns
        got = {r["doc_id"]: r for r in df.collect()}
        assert set(got) == set(ids) and all(r[n] == f"{n}-{i}" for i, r in got.items() for n in NAMES)
        return got

    held(near_dup.one_of_each(d), range(4))
    held(decontaminate.decontaminated(d, bench), [0, 1, 2])
    held(mixing.mixed_documents(d), [0, 1, 3])
    held(importance.resampled(d, bench, share=100, least_words=0), range(4))
    assert held(line_dedup.drop_repeated_lines(d), range(4))[1]["text"] == "other words here and there"
    pages = d.select(F.lit("http://a.b/c").alias("url"), F.concat(F.lit("<body><article><p>"), "text", F.lit("</p></article></body>")).alias("html"), *d.columns)
    got = {r["doc_id"]: r for r in html_text.main_text(pages).collect()}
    assert all(r[n] == f"{n}-{i}" for i, r in got.items() for n in NAMES) and got[3]["text"] == texts[3] and got[3]["html"].startswith("<body>")
