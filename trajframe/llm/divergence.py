"""How sources differ in their use of terms: an audit on hash-consed segment trees over term ids.

The kept terms of a language are cut into blocks of some BLOCK terms of like frequency, and inside its block each has an id by falling
frequency. A group's (a language's source's) counts of a block are a segment tree over these ids; equal subtrees, at any place and of any group, are one
node (hash-consing), so that the many stretches without an occurrence, or with one each, share theirs. The distance of two groups is a sum over
terms that depends on the two counts alone; both trees are walked down together, level by level, and equal pairs of nodes are taken once, with how often
they occur (the memo). At the leaves each distinct pair of counts is priced once. Blocks are summed by Spark.

A task holds one block of the groups of two tiles of some TILE sources: its size doesn't grow with the number of documents, terms or sources. Counts are
summed in each task before they are shuffled. All arithmetic is on integers; products that may pass 64 bits are Python integers or decimals.

Defined results: null text, lang and source are empty strings, which are a language and a source; repeated rows are documents of their own; a language without a kept
term has pairs of value 0 and no terms; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.llm.common import read, stored
from trajframe.llm.runs import TABLE, letters, runs

LEAST_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP = 50
BLOCK = 1024
TILE = 64
#: ASCII letters and every byte of what is beyond ASCII, in UTF-8.
LETTERS = letters(lambda c: 97 <= c <= 122 or c >= 0x80)


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", table: int = TABLE) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents that have it."""
    kinds = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "docs": pa.int64()}

    def work(batches):
        n: defaultdict[tuple, Counter] = defaultdict(Counter)
        d: defaultdict[tuple, Counter] = defaultdict(Counter)

        def sent() -> pa.RecordBatch:
            rows = [(*g, w.decode(), c, d[g][w]) for g, own in n.items() for w, c in own.items()]
            n.clear()
            d.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds.values(), strict=True)], list(kinds))

        for batch in batches:
            held = sum(map(len, n.values()))
            for *group, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, seen, before = n[tuple(group)], set(), len(n[tuple(group)])
                for found in runs(body, "utf-8", LETTERS):
                    own.update(found)
                    seen.update(found)
                d[tuple(group)].update(seen)
                held += len(own) - before
                if held >= table:
                    yield sent()
                    held = 0
        yield sent()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = docs.select(empty(lang), empty(source), F.col(text)).mapInArrow(work, ", ".join(f"{c} {'long' if t == pa.int64() else t}" for c, t in kinds.items()))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, bottom = (wide(count) + F.lit(SMOOTH)) * F.lit(SCALE), wide(total) + wide(terms) * F.lit(SMOOTH)
    return F.call_function("div", top, bottom).cast("long") + 1


def consed(leaves: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(values of the leaf nodes, children of each level's nodes from the leaves up, root of each row) of segment trees over the rows, whose width is a
    power of two. Nodes of a level are numbered; equal ones, of any row and place, have one number."""
    values, ids = np.unique(leaves, return_inverse=True)
    ids, children = ids.reshape(leaves.shape), []
    size = len(values)
    while ids.shape[1] > 1:
        pairs, up = np.unique(ids[:, 0::2].astype(np.int64) * size + ids[:, 1::2], return_inverse=True)
        children.append(np.stack(np.divmod(pairs, size), axis=1))
        ids, size = up.reshape(len(ids), -1), len(pairs)
    return values, children, ids[:, 0]


def walked(children: list[np.ndarray], root: int, others: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(other, x, y, times): how often leaf x of the tree at ``root`` meets leaf y of each other tree at the same place. Equal pairs of nodes are followed once."""
    other, x, y, times = np.arange(len(others)), np.full(len(others), root), others, np.ones(len(others), np.int64)
    for level in reversed(range(len(children))):
        down, size = children[level], len(children[level - 1]) if level else leaves
        x, y = down[x].T.ravel(), down[y].T.ravel()
        pairs, same = np.unique((np.tile(other, 2) * size + x) * size + y, return_inverse=True)
        times = np.bincount(same, np.tile(times, 2)).astype(np.int64)
        rest, y = np.divmod(pairs, size)
        other, x = np.divmod(rest, size)
    return other, x, y, times


def block_distances(rows: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value) of a block's part of the distances of each two groups of different tiles, or of any two where there is one tile.

    Rows are (lang, block, tile_a, tile_b, tile, source, total, terms, slot, n); each group has one without a slot, whose n is the number of terms of the block."""
    heads = rows[rows["slot"].isna()].sort_values("source").reset_index(drop=True)
    number = pd.Series(heads.index, index=heads["source"])
    known = rows[rows["slot"].notna()]
    used = int(heads["n"].iloc[0])
    width = 1 << max(used - 1, 0).bit_length()
    leaves = np.zeros((len(heads), width), np.int64)
    leaves[number[known["source"]].to_numpy(), known["slot"].astype(np.int64)] = known["n"]
    values, children, roots = consed(leaves)
    bottoms = [int(t) + SMOOTH * int(v) for t, v in zip(heads["total"], heads["terms"], strict=True)]
    price = np.array([[1 + SCALE * (int(c) + SMOOTH) // b if b else 0 for c in values] for b in bottoms], np.int64)
    tiles, one = heads["tile"].to_numpy(), rows["tile_a"].iloc[0] == rows["tile_b"].iloc[0]
    out = []
    for a in range(len(heads)):
        b = np.arange(a + 1, len(heads))
        b = b if one else b[tiles[b] != tiles[a]]
        if not len(b):
            continue
        other, x, y, times = walked(children, roots[a], roots[b], len(values))
        cost = np.zeros(len(b), np.int64)
        np.add.at(cost, other, np.abs(price[a, x] - price[b[other], y]) * times)
        cost -= np.abs(price[a, 0] - price[b, 0]) * (width - used)  # leaves behind the last term, which count 0 (the least value) for all
        out.append(pd.DataFrame({"lang": heads["lang"].iloc[0], "a": heads["source"][a], "b": heads["source"].to_numpy()[b], "value": cost}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "value": []}).astype({"lang": str, "a": str, "b": str, "value": "int64"})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the distance of each group to each other of its language, part ``term`` the ``top`` terms that it uses
    more than its language does."""
    counts = stored(term_counts(docs))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    # Terms of like frequency, some ``block`` of them: their frequency's bits and a hash of the term.
    terms = stored(terms.select("lang", "term", "lang_n", F.floor(F.log2("lang_n")).cast("int").alias("bits")))
    bits = terms.groupBy("lang", "bits").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    in_block = Window.partitionBy("lang", "block").orderBy(F.desc("lang_n"), "term")
    placed = terms.join(bits, ["lang", "bits"]).withColumn("block", F.col("bits") * (1 << 32) + F.pmod(F.xxhash64("term"), F.col("blocks")))
    placed = placed.select("lang", "term", "lang_n", "block", (F.row_number().over(in_block) - 1).alias("slot"))
    kept = stored(counts.select("lang", "source", "term", "n").join(placed, ["lang", "term"]))
    groups = docs.select(empty("lang"), empty("source")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total"))))
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    groups = groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))

    order = lambda: Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    used = kept.join(groups, ["lang", "source"])
    more = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    used = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.alias("value")).where("value > 0")
    used = used.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= top)

    # Each group's counts go to the pairs of tiles that its own is part of; every group has a row in every block, and in one that has no term.
    places = placed.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("n"))
    places = places.unionByName(groups.select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("n")).distinct())
    there = groups.join(places, "lang").select("lang", "block", "source", F.lit(None).cast("int").alias("slot"), "n")
    rows = kept.select("lang", "block", "source", "slot", "n").unionByName(there).join(groups, ["lang", "source"])
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("lang", "block", F.least("tile", "with").alias("tile_a"), F.greatest("tile", "with").alias("tile_b"), "tile", "source", "total", "terms", "slot", "n")
    parts = rows.groupBy("lang", "block", "tile_a", "tile_b").applyInPandas(block_distances, "lang string, a string, b string, value long")
    sums = stored(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order()))
    return pairs.unionByName(used)


def op12_divergence(spark, sf_dir):
    return audit(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, COALESCE(text, '') AS text, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source FROM documents),
words AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
each AS (SELECT id, lang, source, term, COUNT(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, SUM(n)::HUGEINT AS n FROM each GROUP BY 1, 2 HAVING COUNT(*) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
  SELECT g.lang, g.source, k.term, COALESCE(c.n, 0)::HUGEINT AS n, k.n AS lang_n
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, SUM(n) AS n FROM each GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
priced AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (SUM(n) OVER g + 5 * COUNT(*) OVER g) AS p, 1 + (1000000000 * (lang_n + 5)) // (SUM(lang_n) OVER g + 5 * COUNT(*) OVER g) AS q
  FROM grid WINDOW g AS (PARTITION BY lang, source)),
distances AS (SELECT a.lang, a.source, b.source AS item, SUM(ABS(a.p - b.p)) AS value FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM priced WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT lang, source, part, item, value, ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50
"""
