"""The pipeline's stages, one after another, each against brute force on what its predecessor kept."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_near import brute_kept, changed
from test_operators import WS, brute_dropped, brute_targets

from trajframe.llm import mixing, pieces
from trajframe.llm.common import stored


def corpus(spark):
    """Clean documents of two lines, near copies on one line with words changed, copies, repeated lines, and rows without a letter or text."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(80) + "\n" + text(40), "en" if i % 2 else "de", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, "12345 !!!", "en", "s1", 0), (102, None, "en", "s1", 0), (103, text(30) + "\n" + rows[3][1].split("\n")[0], "en", "s1", 0)]
    base = [text(rng.randrange(100, 200)).split() for _ in range(8)]
    rows += [(200 + i, " ".join(b), "en", "s2", 0) for i, b in enumerate(base)]
    rows += [(300 + i, " ".join(changed(rng, b, rng.randrange(1, 3))), "en", "s2", 0) for i, b in enumerate(base)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def brute_copies(rows):
    """{doc_id: copies} by the sources' targets, in order of size class and md5."""
    sizes, own = Counter(), {}
    for r in rows:
        n = len(WS.findall(r["text"] or ""))
        sizes[r["source"]] += n
        own.setdefault(r["source"], []).append((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"], n))
    out = {}
    for source, target in brute_targets(sizes).items():
        whole = math.floor(target / sizes[source]) if sizes[source] else 0
        part, at = target - whole * sizes[source], 0
        for h, doc, n in sorted(own[source], key=lambda d: (d[2] > part * mixing.LARGE, d[0])):
            out[doc] = min(whole + (at + n / 2 <= part), 3) if n else 0
            at += n
    return out


def test_stages(spark):
    docs = corpus(spark)
    columns = docs.columns
    given = {r["doc_id"]: r for r in docs.collect()}
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, None))
        held[name] = docs.collect()
        if name != "encode":
            assert docs.columns == columns
    # Language: what has no letter goes, clean documents stay.
    assert {r["doc_id"] for r in held["language"]} == set(given) - {101, 102}
    # Line dedup: by comparing all lines.
    ids = sorted(r["doc_id"] for r in held["language"])
    exact, near = brute_dropped([given[i]["text"] for i in ids], 20)
    left = {}
    for k, i in enumerate(ids):
        kept = [x for n, x in enumerate(given[i]["text"].split("\n")) if (k, n) not in exact | near]
        if kept:
            left[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in held["line_dedup"]} == left and 100 not in left and "\n" not in left[103]
    # Near duplicates: by comparing all pairs; the changed copies go.
    order = sorted(left)
    assert sorted(r["doc_id"] for r in held["near_duplicates"]) == [order[k] for k in sorted(brute_kept([left[i] for i in order]))]
    gone = set(left) - {r["doc_id"] for r in held["near_duplicates"]}
    assert len(gone) >= 6 and gone <= set(range(300, 308))
    # Mixture: each document as often as its source's target takes it, in order of training.
    want = {i: n for i, n in brute_copies(held["near_duplicates"]).items() if n}
    assert Counter(r["doc_id"] for r in held["mixture"]) == want
    # Encoding: the ids decode to the texts.
    model = pieces.pieces(pieces.MODEL)
    assert sorted((r["doc_id"], pieces.decode(r["ids"], model)) for r in held["encode"]) == sorted((r["doc_id"], r["text"]) for r in held["mixture"])
    assert set(docs.columns) == {"doc_id", "source", "ids"}


def test_mixture_is_in_training_order(spark):
    docs = corpus(spark).where("text IS NOT NULL")
    order = [r["doc_id"] for r in mixing.mixed_documents(docs).collect()]
    placed = mixing.training_order(mixing.mix(mixing.sized(docs))).withColumn("k", F.col("doc_id").cast("string")).orderBy("position", "k", "copy").collect()
    assert order == [r["doc_id"] for r in placed] and len(order) > 60


def test_mixture_keeps_rows_without_an_id(spark):
    """Every row is sized and placed: as many words come out of each source as mix() takes, with and without an id."""
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows = [(i, words(30), f"s{i % 3}") for i in range(60)] + [(None, words(10 + i), f"s{i % 4}") for i in range(24)] + [(None, "same words", "s3")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["source"]: r["n"] for r in mixing.mix(mixing.sized(docs)).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    out = [tuple(r) for r in corpus_pipeline.mixture(spark, docs, None).collect()]
    assert {s: sum(len(t.split()) for _, t, x in out if x == s) for s in taken} == pytest.approx(taken, abs=40)
    # The source s3 has only rows without an id, is capped, and gives each row three times, the two equal rows too.
    assert sorted(r for r in out if r[2] == "s3") == sorted([r for r in rows if r[2] == "s3"] * 3)
    assert {r for r in out if r[0] is None} <= set(rows) and len({r for r in out if r[0] is None and r[2] != "s3"}) > 0
    assert out == [tuple(r) for r in corpus_pipeline.mixture(spark, docs.repartition(3), None).collect()]
