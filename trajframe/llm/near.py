"""Near copies by text, the second half of the SimHash operator: fingerprints propose, an exact set-similarity join completes.

Documents whose fingerprints lie within two bits, found by the generalised pigeonhole, are compared as texts and linked first. A
Jaccard similarity of 0.8 can leave ten or more of 64 bits different, where no partition is selective; so a prefix-filter join finds all
other links, and needs pairs only of sets that fingerprints haven't linked.

A document is the set of its SHINGLE-word shingles. Its shingles are put in one order that holds for all documents: those that
a sample of the documents has seldom first (else by hash), often ones last. Two sets of similarity t or more share
one of the first n - ceil(t n) + 1 shingles of each, whatever the order is, and the first they share is among the first n - ceil(2 t n / (1 + t)) + 1 of the smaller
one; so those are the keys under which sets meet, and the sample decides about cost only. What two sets share behind these prefixes is at most what is left of the larger
rest, so a pair that shares too few keys needs no look at the sets: a passage that unlike documents have in common goes no further. Pairs that are left are verified on
the whole sets, which only those documents' texts are read for.

Only links between documents that aren't linked yet matter. Where many sets meet under a key, all are compared with one of them first, then, in turns, with
those up to the 16th, the 128th and so on; sets that a link has joined by then are left out. A turn writes some ten small tables, so it is few turns that count.

Defined results: texts without a word have the same set, and so have exact copies; a text shorter than a shingle has one shingle.
Sets are named by a 64-bit digest.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajframe.llm.common import stored
from trajframe.llm.graph import connected_components
from trajframe.llm.simhash import majority_bits, near_edges

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
SMALL_BUCKET = 8
#: How many times as many of a crowded key's sets have been compared with the others after each turn.
TURN = 8
#: One document in SAMPLE is counted for the order; the OFTEN most frequent of the shingles that SEEN or more of those have come last.
SAMPLE, SEEN, OFTEN = 4, 2, 500_000
_MIX = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F], np.uint64)
_SHIFT = np.uint64(31)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; words as in the fingerprints."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    w = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(w) - shingle + 1
    h = w[:n].copy()
    for k in range(1, shingle):  # each word's hash is mixed into those before it, in order
        h *= _MIX[0]
        h ^= h >> _SHIFT
        h += w[k : k + n]
    h *= _MIX[1]
    h ^= h >> _SHIFT
    return np.unique(h)


def _arrays(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(v.view(np.int64) for v in values)])))


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, digest, hashes array<long>) for every row; the digest names the set."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t, shingle) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _digests(sets), _arrays(sets)], ["doc_id", "digest", "hashes"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, f"doc_id {dict(docs.dtypes)[id_col]}, digest long, hashes array<long>")


def often_seen(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> np.ndarray:
    """Hashes of shingles that many documents of the sample have, the rarest first: at most OFTEN, from a count upwards that a histogram of the counts gives."""
    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLE)) == 0)
    seen = shingle_sets(sample, id_col, text_col, shingle).select(F.explode("hashes").alias("h")).groupBy("h").count()
    seen = stored(seen.where(F.col("count") >= SEEN).withColumn("bits", F.floor(F.log2("count") * 8).cast("int")))
    total, least = 0, None
    for r in sorted(seen.groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["bits"]):
        if (total := total + r["n"]) > OFTEN:
            break
        least = r["bits"]
    if least is None:
        return np.zeros(0, np.uint64)
    top = seen.where(F.col("bits") >= least).select("h", "count").toArrow()
    h, n = (np.ascontiguousarray(top.column(c).to_numpy()) for c in ("h", "count"))
    return h[np.lexsort((h, n))].view(np.uint64)


def prefixes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: Fraction) -> DataFrame:
    """(doc_id, node, n, fp, keys): every row's set, named by its digest, with its size, fingerprint and first shingles."""
    often = often_seen(docs, id_col, text_col, shingle)
    by_hash = np.argsort(often)
    hashes = often[by_hash]

    def first(own: np.ndarray) -> np.ndarray:
        n = len(own)
        size = n + 1 + (-n * similarity.numerator // similarity.denominator)  # n - ceil(t n) + 1
        if not len(hashes):
            return own[:size]
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        place = np.where(hashes[at] == own, by_hash[at] + 1, 0)
        return own[np.argsort(place, kind="stable")[:size]]

    def work(batches):
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch.column(1).to_pylist()]
            fp = np.fromiter((majority_bits(s) for s in sets), np.uint64, len(sets))
            columns = [batch.column(0), _digests(sets), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp.view(np.int64)), _arrays([first(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "fp", "keys"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, f"doc_id {dict(docs.dtypes)[id_col]}, node long, n long, fp long, keys array<long>")


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """(x, y): sets to compare because of their fingerprints. A set stands for all with its fingerprint: each of them is compared with it,
    and it with those that stand for fingerprints within two bits."""
    heads = classes.groupBy("fp").agg(F.min("node").alias("head"))
    same = classes.join(heads, "fp").where("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y"))
    a, b = heads.toDF("a", "x"), heads.toDF("b", "y")
    return same.unionByName(near_edges(heads.select("fp")).join(a, "a").join(b, "b").select("x", "y"))


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, first, root): every distinct set, its smallest doc_id, and the name of the sets linked with it."""
    least = Fraction(str(similarity))
    a, b = F.lit(least.numerator), F.lit(least.denominator)
    prints = stored(prefixes(docs, id_col, text_col, shingle, least))
    classes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("copies")))
    copied = stored(classes.where("copies > 1").select(F.col("node").alias("__node"), F.col("first").alias("__first")))
    classes = classes.drop("copies")
    proposed = stored(fingerprint_pairs(classes))
    # Exact copies are one set: only the first one's keys are dealt out.
    one = prints.join(copied, (F.col("node") == F.col("__node")) & (F.col("doc_id") != F.col("__first")), "left_anti")
    inner = F.col("n") - F.ceil(2 * a * F.col("n") / (a + b)) + 1
    rows = one.select("node", inner.alias("inner"), F.posexplode("keys").alias("pos", "key")).select("key", "node", (F.col("pos") < F.col("inner")).alias("own"))
    wide = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"))
    met = stored(rows.join(wide, "key").groupBy("key", "node").agg(F.max("own").alias("own")))
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stored(met.join(sizes, "key").join(classes.select("node", "n"), "node"))

    def fits(x: str, y: str):
        return (F.col(x) * b >= F.col(y) * a) & (F.col(y) * b >= F.col(x) * a)

    def enough(shared, x: str, y: str):
        """Whether sets that share so many keys can be similar: the larger rest behind the prefixes may be common."""
        rest = lambda n: F.ceil(F.col(n) * a / b) - 1
        return (shared + F.greatest(rest(x), rest(y))) * (a + b) >= (F.col(x) + F.col(y)) * a

    def verified(pairs: DataFrame) -> DataFrame:
        """Links (a, b) among pairs (x, y). Pairs and the sets they name are written first: where they are few, Spark takes them to the texts, not the texts to them."""
        pairs = stored(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        wanted = stored(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(classes, "node").select("node", F.col("first").alias("__first")))
        texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(wanted, F.col("__id") == F.col("__first"))
        sets = shingle_sets(texts.select(F.struct("__id", "node").alias("__key"), "__text"), "__key", "__text", shingle).where("digest = doc_id.node").select("doc_id.node", "hashes")
        sets = stored(sets.dropDuplicates(["node"]))  # an id may be repeated, with the same text or with others
        sides = pairs.select("x", "y", F.explode(F.array("x", "y")).alias("node")).join(sets, "node")
        of = lambda side: F.first(F.when(F.col("node") == F.col(side), F.col("hashes")), ignorenulls=True)
        named = sides.groupBy("x", "y").agg(of("x").alias("xs"), of("y").alias("ys"))
        both = F.size(F.array_intersect("xs", "ys"))
        return stored(named.where(both * b >= (F.size("xs") + F.size("ys") - both) * a).select(F.col("x").alias("a"), F.col("y").alias("b")))

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots, "node", "left").select(*rows.columns, F.coalesce("component", "node").alias("root"))

    def inside(x: str, y: str):
        """Whether the key is among the smaller set's first ones."""
        return (F.col(f"{x}.own") & (F.col(f"{x}.n") <= F.col(f"{y}.n"))) | (F.col(f"{y}.own") & (F.col(f"{y}.n") <= F.col(f"{x}.n")))

    links = verified(proposed)
    roots = connected_components(links)
    few = rooted(met.where(F.col("size") <= SMALL_BUCKET).select("key", "node", "n", "own"), roots)
    crowd = met.where(F.col("size") > SMALL_BUCKET).select("key", "node", "n", "own")
    crowded = crowd.groupBy("node").agg(F.count(F.lit(1)).alias("keys"))
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, F.col("x.key") == F.col("y.key")).where((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & fits("x.n", "y.n"))
    pairs = pairs.groupBy(F.col("x.node").alias("x"), F.col("y.node").alias("y")).agg(F.count(F.lit(1)).alias("shared"), F.max(inside("x", "y")).alias("inside"), F.max("x.n").alias("nx"), F.max("y.n").alias("ny")).where("inside")
    for side in ("x", "y"):
        pairs = pairs.join(crowded.select(F.col("node").alias(side), F.col("keys").alias(f"c{side}")), side, "left")
    more = F.least(F.coalesce("cx", F.lit(0)), F.coalesce("cy", F.lit(0)))
    waiting = pairs.where(enough(F.col("shared") + more, "nx", "ny")).select("x", "y")

    # Crowded keys: in a turn, a key's sets up to the next power of TURN are compared with all behind them. The other keys' pairs go with the first turn.
    by_hash = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
    crowd = stored(crowd.withColumn("rank", F.row_number().over(by_hash)))
    keys = stored(met.groupBy("node").agg(F.collect_list("key").alias("keys")))  # a set's own first shingles
    start, end = 1, 2
    while True:
        named = rooted(crowd.where(F.col("rank") >= start), roots)
        open_ = named.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        named = stored(named.join(open_, "key"))
        if not named.isEmpty():
            x, y = named.alias("x"), named.where(F.col("rank") < end).alias("y")
            met_here = x.join(y, F.col("x.key") == F.col("y.key")).where((F.col("x.rank") > F.col("y.rank")) & (F.col("x.root") != F.col("y.root")) & fits("x.n", "y.n") & inside("x", "y"))
            tried = stored(met_here.select(F.col("x.node").alias("x"), F.col("y.node").alias("y"), F.col("x.n").alias("nx"), F.col("y.n").alias("ny")).distinct())
            both = tried.join(keys.toDF("x", "kx"), "x").join(keys.toDF("y", "ky"), "y")
            likely = stored(both.where(enough(F.least(F.size("kx"), F.size("ky")), "nx", "ny") & enough(F.size(F.array_intersect("kx", "ky")), "nx", "ny")).select("x", "y"))
            if waiting is not None:
                waiting = waiting.unionByName(likely)
            elif not likely.isEmpty():
                waiting = likely
        elif waiting is None:
            break
        if waiting is not None:
            links, waiting = links.unionByName(verified(waiting)), None
            roots = connected_components(links)
        start, end = end, TURN * end
    return rooted(classes.select("node", "first"), roots)
