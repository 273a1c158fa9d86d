"""Quality rules: how far a document's character classes and common words lie from its language.

References are counted over all documents: for every language, the histogram of character classes and of its
COMMON most frequent words. The most frequent ones have a bin each and the others share one with those of
similar rank (up to each of BANDS), so that the histogram has most of the words' mass and few bins that a short text leaves
empty by chance; all other words have the last bin. Every language has its own reference; they are on the driver, so ``lang`` must name
languages, of which there are thousands at most. A document
fails if the Jensen-Shannon distance (base 2, 0 to 1) of either histogram is above its bound and the document is long
enough for that histogram to mean something.

Defined results: a null text has no words and fails the base rules; a null language uses the pooled reference;
repeated rows give repeated results; without any words there are no references and only the base rules decide.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajframe.llm.common import read

COMMON = 5000
#: Words up to the first rank have a bin each; those from each rank to the next share one.
BANDS = (40, 200, 1000, COMMON)
BINS = BANDS[0] + len(BANDS)
POOLED = "\x00pooled"
MAX_CLASS_DISTANCE = 0.28
#: On sf0.1, clean texts of 100 words and more lie within 0.39 of their language, clean texts beyond 0.45 of another one, gibberish beyond 0.68.
MAX_WORD_DISTANCE = 0.42
#: Characters and words that a document needs for the two comparisons.
MIN_CHARS = 200
MIN_WORDS = 100
#: Parts of a language's vocabulary that are ranked apart.
PARTS = 64
#: Distinct words that a task counts before it hands its counts on.
FLUSH = 400_000

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "mark", "other", "wide")
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[list(b"!\"'(),-./:;?")] = 5
_CLASS[list(SYMBOLS)] = 4
_CLASS[0x80:0xC0] = 8  # later bytes of a character
_CLASS[0xC0:] = 7
_AS_CLASS = bytes(_CLASS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw.translate(_AS_CLASS), np.uint8), minlength=9)[:8]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that occurs at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    again = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(windows)] |= again
    return int(hit.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _count(batches):
    """(lang, kind, item, n): words and character classes by language."""
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}

    def flush():
        rows = [(lang, "w", w, n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, "c", name.encode(), int(n)) for lang, c in classes.items() for name, n in zip(CLASSES, c, strict=True) if n]
        words.clear()
        classes.clear()
        for i in range(0, len(rows), 100_000):
            part = list(zip(*rows[i : i + 100_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.string()), pa.array(part[2], pa.binary()), pa.array(part[3], pa.int64())], ["lang", "kind", "item", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            lang = POOLED if lang is None else lang
            words.setdefault(lang, Counter()).update(raw.lower().split())
            classes[lang] = classes.get(lang, 0) + class_counts(raw)
        if sum(map(len, words.values())) > FLUSH:
            yield from flush()
    yield from flush()


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, dict]:
    """{language or POOLED: {"classes": counts, "words": {word: count}, "total": words}}."""
    counts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, kind string, item binary, n long")
    counts = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).persist()
    totals = {r["lang"]: r["n"] for r in counts.where("kind = 'w'").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    everything = sum(totals.values())
    if not everything:
        counts.unpersist()
        return {}
    own = [lang for lang in totals if lang != POOLED]
    every = counts.groupBy("kind", "item").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "kind", "item", "n")
    mine = _most_frequent(counts.where((F.col("lang") != POOLED) & F.col("lang").isin(own)).select("lang", "kind", "item", "n"))
    pooled = _most_frequent(every)
    out = {lang: {"classes": np.zeros(len(CLASSES)), "words": {}, "total": totals[lang]} for lang in own}
    out[POOLED] = {"classes": np.zeros(len(CLASSES)), "words": {}, "total": everything}
    for r in mine.unionByName(pooled).collect():
        item = bytes(r["item"])
        if r["kind"] == "c":
            out[r["lang"]]["classes"][CLASSES.index(item.decode())] += r["n"]
        else:
            out[r["lang"]]["words"][item] = r["n"]
    counts.unpersist()
    return out


def _most_frequent(counts: DataFrame) -> DataFrame:
    """The COMMON most frequent items of each language and kind, first within PARTS parts of them, so that no task gets a language's whole vocabulary."""
    for part in (F.pmod(F.xxhash64("item"), F.lit(PARTS)), F.lit(0).cast("long")):
        rank = F.row_number().over(Window.partitionBy("lang", "kind", "part").orderBy(F.col("n").desc(), "item"))
        counts = counts.withColumn("part", part).withColumn("rank", rank).where(F.col("rank") <= COMMON).drop("part", "rank")
    return counts


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge(text: str | None, ref: dict | None) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    counts = class_counts(raw)
    n_symbols = int(np.bincount(np.frombuffer(raw, np.uint8), minlength=256)[_SYMBOL].sum())
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    by_class = by_word = 0.0
    if ref:
        by_class = js_distance(counts.astype(float), ref["classes"])
        common = ref["index"]
        mine = np.bincount([common.get(w, BINS - 1) for w in raw.lower().split()], minlength=BINS).astype(float)
        by_word = js_distance(mine, ref["vector"])
    far = (len(text) >= MIN_CHARS and by_class > MAX_CLASS_DISTANCE) or (n >= MIN_WORDS and by_word > MAX_WORD_DISTANCE)
    return n, len(text) - int(counts[3]), n_symbols, repeated_lines(text), repeats, failed, not failed and not far, round(by_class, 9), round(by_word, 9)


def word_bins(words: dict[bytes, int], total: int) -> dict:
    """Each common word's bin, and the reference's histogram over the bins."""
    index = {w: r if r < BANDS[0] else BANDS[0] + bisect_right(BANDS[1:], r) for r, w in enumerate(sorted(words, key=lambda w: (-words[w], w)))}
    vector = np.zeros(BINS)
    for w, n in words.items():
        vector[index[w]] += n
    vector[-1] += max(0, total - sum(words.values()))
    return {"index": index, "vector": vector}


def score_quality(docs: DataFrame, refs: dict[str, dict], id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row for each document with its counts, distances and verdict."""
    table = {}
    for lang, r in refs.items():
        table[lang] = {"classes": r["classes"]} | word_bins(r["words"], r["total"])
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, {SCORED}"
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    names = ["doc_id", *(x.split()[0] for x in SCORED.split(", "))]

    def work(batches):
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = [judge(t, table.get(lang) or table.get(POOLED)) for lang, t in zip(langs, texts, strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return docs.select(F.col(id_col), F.col(lang_col), F.col(text_col)).mapInArrow(work, schema)


def op4_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return score_quality(docs, references(docs))
