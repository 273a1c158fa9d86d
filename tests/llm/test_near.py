"""The pipeline's near copies against brute force over all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from trajframe.llm import near, simhash


def shingled(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_kept(texts):
    """The smallest id of each group linked by similarities of 0.8 or more."""
    sets, root = [shingled(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return set(root)


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_keeps_one_of_each_group(spark, seed):
    """Near copies with up to eight changed words, a crowd of variants, and a passage that many unlike texts share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choices(words, k=rng.randrange(60, 300)) for _ in range(40)]
    passage = rng.choices(words, k=25)
    texts = [" ".join(b) for b in base]
    texts += [" ".join(changed(rng, b, rng.randrange(1, 9))) for b in base for _ in range(2)]
    texts += [" ".join(changed(rng, base[0], rng.randrange(0, 12))) for _ in range(40)]
    texts += [" ".join(passage + rng.choices(words, k=rng.randrange(0, 40))) for _ in range(40)]
    texts += ["", " ", "a b", "A  b", "a c", "one two three four five"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, texts[0], "s"), (None, texts[1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, None).where("doc_id IS NOT NULL").collect())
    assert got == sorted(brute_kept(texts)) and len(got) < len(texts) - 40
    assert simhash.keep_one_each(docs, shingle=5, similarity=0.8).where("doc_id IS NULL").count() == 2


def test_nothing_to_link(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.keep_one_each(docs, shingle=5, similarity=0.8).count() == 0


def test_few_turns_for_crowded_keys(spark, monkeypatch):
    """150 unlike texts (0.78) that share a passage, some of whose shingles are among their keys, and near copies of two: each turn costs tables, so turns must be few."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=40)
    texts = [" ".join(passage + rng.choices(words, k=5)) for _ in range(150)]
    texts += [" ".join([*texts[7].split()[:-1], "other"]), " ".join(["other", *texts[90].split()[1:]])]
    turns, stored = [], near.stored
    monkeypatch.setattr(near, "stored", lambda df: (turns.append(df) if {"rank", "root"} <= set(df.columns) else None, stored(df))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.keep_one_each(docs, shingle=5, similarity=0.8).collect()}
    assert got == brute_kept(texts) and len(got) < len(texts)
    assert 2 <= len(turns) <= 5
