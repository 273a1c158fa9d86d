"""SimHash near-dedup by the generalised pigeonhole principle.

A document's fingerprint has the majority bits of its shingle hashes. Two fingerprints link at MAX_BITS or fewer
differing bits. The 64 bits are split into partitions with a threshold each; if the thresholds sum to
MAX_BITS - partitions + 1, linked fingerprints lie within the threshold of at least one partition. Bits that go
together share a partition, and a dynamic program picks the thresholds (-1: the partition isn't probed) that cost least
by the number of candidates estimated from the corpus. Rows that meet in a partition are candidates and are verified.

A bucket with more than SMALL_BUCKET fingerprints isn't expanded into pairs. Each of its fingerprints instead emits all
65 values within one bit of itself; two fingerprints share such a value exactly if they differ in at most two bits, and
all that share a value link to the smallest of them. Both ways find every link.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows and exact copies
share a fingerprint and a component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import read, stored
from trajframe.llm.graph import connected_components

MAX_BITS = 2
SHINGLE = 3
SEED = 42
SMALL_BUCKET = 8
#: Cost of a verified candidate relative to a row that is dealt out.
PAIR_COST = 0.5
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: lower() changes A-Z only, split() takes ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for lo in range(0, n, _CHUNK):
        part = words[lo : lo + _CHUNK + shingle - 1]
        h = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(part[k:] for k in range(shingle)), strict=False)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row."""

    def work(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint of some hashes: a bit is one where over half of them have it."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[lo : lo + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: in how many fingerprints both bits are one; summed by Spark, 64 rows come back."""

    def work(batches):
        total = np.zeros((64, 64))
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            for lo in range(0, len(fp), _CHUNK):
                bits = np.unpackbits(fp[lo : lo + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), *(pa.array(total[:, j].astype(np.int64)) for j in range(64))], ["i", *(f"c{j}" for j in range(64))])

    columns = [f"c{j}" for j in range(64)]
    sums = fps.select("fp").mapInArrow(work, "i int, " + ", ".join(f"{c} long" for c in columns))
    rows = sums.groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).collect()
    out = np.zeros((64, 64))
    for r in rows:
        out[r["i"]] = [r[c] for c in columns]
    return out


def agreement(both: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Chance that two random fingerprints agree in bit i (first), and in bits i and j (second)."""
    one = np.diag(both)
    p11, p10 = both / n, (one[:, None] - both) / n
    p01, p00 = (one[None, :] - both) / n, 1 - (one[:, None] + one[None, :] - both) / n
    pair = p11**2 + p10**2 + p01**2 + p00**2
    p = one / n
    return p**2 + (1 - p) ** 2, pair


def grouped_bits(single: np.ndarray, pair: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size: each group is grown from a free bit by the bit that
    depends most on those already in it."""
    lift = pair / np.outer(single, single)
    free, groups = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [max(free, key=lambda b: (single[b], -b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (sum(lift[b, g] for g in group), -b))
            group.append(best)
            free.discard(best)
        groups.append(group)
    return groups


def estimated_cost(group: list[int], threshold: int, n: float, single: np.ndarray, pair: np.ndarray) -> float:
    """Rows dealt out and candidates met, if this partition is probed within ``threshold`` bits."""
    if threshold < 0:
        return 0.0
    chain = [single[group[0]]] + [min(1.0, pair[a, b] / single[a]) for a, b in zip(group, group[1:], strict=False)]
    # ways[d]: chance that exactly d bits of the partition differ
    ways = np.zeros(threshold + 1)
    ways[0] = 1.0
    for agree in chain:
        ways[1:] = ways[1:] * agree + ways[:-1] * (1 - agree)
        ways[0] *= agree
    rows = sum(_choose(len(group), d) for d in range(threshold + 1))
    return n * rows + PAIR_COST * n * n / 2 * ways.sum()


def _choose(n: int, k: int) -> int:
    return 1 if k == 0 else _choose(n - 1, k - 1) * n // k


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds -1, 0, 1, ... for the partitions that sum to ``total`` at the least cost (costs[i][t + 1])."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                new = (cost + c, [*chosen, t])
                if spent + t not in step or new < step[spent + t]:
                    step[spent + t] = new
        best = step
    return best[total]


def layout(both: np.ndarray, n: int, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition, the cheapest over two to five partitions; thresholds are at most 1."""
    single, pair = agreement(both, max(n, 1))
    found = []
    for parts in range(2, max_bits + 4):
        groups = grouped_bits(single, pair, parts)
        costs = [[estimated_cost(g, t, n, single, pair) for t in (-1, 0, 1)] for g in groups]
        cost, thresholds = allocate(costs, max_bits - parts + 1)
        found.append((cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(found, key=lambda f: f[0])[1]


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def probes(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, own, fp): each fingerprint's own key in every partition and the keys within its threshold."""

    def keys(part: int, bits: list[int], threshold: int) -> Column:
        mask = _long(sum(1 << b for b in bits))
        near = [F.struct(F.lit(part).alias("part"), F.col("fp").bitwiseAND(mask).alias("key"), F.lit(True).alias("own"))]
        if threshold:
            near += [
                F.struct(F.lit(part).alias("part"), F.col("fp").bitwiseXOR(_long(1 << b)).bitwiseAND(mask).alias("key"), F.lit(False).alias("own"))
                for b in bits
            ]
        return F.array(*near)

    return fps.select("fp", F.inline(F.concat(*(keys(i, *p) for i, p in enumerate(plan)))))


def near_edges(fps: DataFrame, max_bits: int = MAX_BITS, small: int = SMALL_BUCKET) -> DataFrame:
    """(a, b): links that join all fingerprints within ``max_bits`` of each other, from distinct (fp)."""
    if max_bits != 2:
        raise ValueError("values within one bit meet exactly at two or fewer differing bits: max_bits is 2")
    n = fps.count()
    rows = probes(fps, layout(bit_counts(fps), n, max_bits)) if n else fps.select("fp", F.lit(0).alias("part"), F.col("fp").alias("key"), F.lit(True).alias("own"))
    sizes = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("any")).where("size > 1 AND any")
    met = stored(rows.join(sizes, ["part", "key"]).select("part", "key", "own", "fp", "size"))
    few = met.where(F.col("size") <= small)
    pairs = few.alias("x").join(few.alias("y"), ["part", "key"]).where("x.fp < y.fp AND (x.own OR y.own)")
    pairs = pairs.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    crowd = met.where(F.col("size") > small).select("fp").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(_long(1 << b)) for b in range(64)))
    balls = crowd.select("fp", F.explode(near).alias("z"))
    centres = balls.groupBy("z").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65 share a value
    stars = centres.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def components(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for distinct fingerprints of (doc_id, fp)."""
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = connected_components(near_edges(classes.select("fp")))
    named = classes.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable over links."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    return prints.join(components(prints), "fp").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; rows repeated under it count once.
    Rows without an id can't be named in a group and stay.

    Without a ``similarity`` the groups are those of the fingerprints; with one, texts are linked whose shingles have that Jaccard similarity,
    all of them (see ``near``).
    """
    named = docs.where(F.col(id_col).isNotNull())
    if similarity is None:
        kept = near_duplicates(named, id_col, text_col, shingle).where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    else:
        from trajframe.llm.near import similar_sets

        kept = similar_sets(named, id_col, text_col, shingle, similarity).groupBy("root").agg(F.min("first").alias("__id")).select("__id").distinct()
    one = named.join(kept, F.col(id_col) == F.col("__id"), "left_semi").dropDuplicates([id_col])
    return one.unionByName(docs.where(F.col(id_col).isNull()))


def op5_simhash(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
