"""Language identification by a byte convolutional network, trained in numpy.

A text's bytes become symbols (letters without case, digits, the bytes of other scripts), cut into fixed-length
windows. Filters of several widths slide over a window, their largest values feed a softmax; a document's
score for a language is the mean over all its windows. The network learns from at most about PER_LANGUAGE labelled
documents of each language, a few windows of each, drawn by a hash of the id; predictions see the text only.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text if nothing could be
learned (no labelled rows). Repeated rows give repeated results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajframe.llm.common import read

UNKNOWN = "und"
WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
#: Bounds of the training sample: documents of a language, windows of a document.
PER_LANGUAGE = 400
WINDOWS_PER_DOC = 3
STEPS, BATCH, RATE = 500, 64, 0.01
#: Bytes that one numpy step works on.
CHUNK = 1 << 18

SYMBOLS = 64
_SYMBOL = np.zeros(256, np.uint8)
for _i in range(26):
    _SYMBOL[ord("a") + _i] = _SYMBOL[ord("A") + _i] = 1 + _i
_SYMBOL[ord("0") : ord("9") + 1] = 27
_SYMBOL[0x80:0xA0] = 32 + np.arange(32)  # later bytes, upper and lower case of Latin letters together
_SYMBOL[0xA0:0xC0] = 32 + np.arange(32)
_SYMBOL[0xC0:] = 28
_SYMBOL[0xC3] = 29
_SYMBOL[[0xC4, 0xC5]] = 30
_SYMBOL[0xD0:0xE0] = 31
_TO_SYMBOL = bytes(_SYMBOL)
_LETTER = re.compile(r"[^\W\d_]")


def windows_of(raw: bytes, width: int = WINDOW) -> np.ndarray:
    """All symbols of a text as rows of ``width``; neighbours share the symbols that a filter spans, the last is padded."""
    step = width - max(WIDTHS) + 1
    n = max(1, -(-(len(raw) - max(WIDTHS) + 1) // step))
    padded = np.zeros((n - 1) * step + width, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw.translate(_TO_SYMBOL), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, width)[::step]


class ByteNetwork:
    """Multi-width filters over one-hot symbols, max pooling, softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.taps = [[rng.normal(0, 0.3, (SYMBOLS, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def tables(self) -> list[list[np.ndarray]]:
        """Taps taken two at a time: the sum for each pair of symbols, so that a filter is one look-up a pair."""
        out = []
        for taps in self.taps:
            pairs = [(a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS) for a, b in zip(taps[::2], taps[1::2], strict=False)]
            out.append(pairs + ([taps[-1]] if len(taps) % 2 else []))
        return out

    def responses(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> list[np.ndarray]:
        pair = x[:, :-1].astype(np.intp) * SYMBOLS + x[:, 1:]
        out = []
        span = x.shape[1] - max(WIDTHS) + 1  # the same places for all widths
        for w, parts in zip(WIDTHS, tables, strict=True):
            total = None
            for k, part in enumerate(parts):
                at = pair[:, 2 * k : 2 * k + span] if len(part) > SYMBOLS else x[:, w - 1 : w - 1 + span]
                got = part[at]
                total = got if total is None else np.add(total, got, out=total)
            out.append(total)
        return out

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pooled = np.concatenate([_largest(r) for r in self.responses(x, tables)], axis=1)
        return _softmax(np.maximum(pooled, 0) @ self.dense + self.bias)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam on the cross-entropy; through the pooling, gradients reach the winning places only."""
        rng = np.random.default_rng(seed)
        weights = [t for taps in self.taps for t in taps] + [self.dense, self.bias]
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            bx, by = x[pick], y[pick]
            responses = self.responses(bx, self.tables())
            best = [r.argmax(axis=1) for r in responses]
            pooled = np.concatenate([np.take_along_axis(r, b[:, None, :], 1)[:, 0] for r, b in zip(responses, best, strict=True)], axis=1)
            active = np.maximum(pooled, 0)
            delta = _softmax(active @ self.dense + self.bias)
            delta[np.arange(BATCH), by] -= 1
            delta /= BATCH
            back = (delta @ self.dense.T) * (pooled > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    grad = np.zeros((SYMBOLS, FILTERS), np.float32)
                    symbol = np.take_along_axis(bx, best[k] + j, axis=1)
                    np.add.at(grad, (symbol, np.arange(FILTERS)[None, :]), g)
                    grads.append(grad)
            grads += [active.T @ delta, delta.sum(axis=0)]
            rate = RATE * (1 - (step - 1) / steps)
            for w, g, a, b in zip(weights, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _largest(r: np.ndarray) -> np.ndarray:
    """max over axis 1 by halving, so that numpy compares long runs."""
    while r.shape[1] > 1:
        half = r.shape[1] // 2
        left = np.maximum(r[:, :half], r[:, half : 2 * half])
        if r.shape[1] % 2:
            np.maximum(left[:, 0], r[:, -1], out=left[:, 0])
        r = left
    return r[:, 0]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_windows(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, list[str]]:
    """Symbols and languages of the sample. ``labelled`` has doc_id, lang, text; only pieces of the sampled rows are collected."""
    named = labelled.where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}  # a row for each language
    rows = named.where(F.length("text") > 0).select("doc_id", "lang", "text")
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), []
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sorted(counts.items())), F.lit(0.0))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000.0
    piece = lambda k: F.substr(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW))
    drawn = rows.where(draw < share).select("lang", F.explode(F.array(*(piece(k) for k in range(WINDOWS_PER_DOC)))).alias("piece"))
    got = sorted((r["lang"], r["piece"]) for r in drawn.collect())
    seen = {lang for lang, _ in got}
    missed = [k for k in counts if k not in seen]
    if missed:  # the draw can miss a rare language: the documents that come first in it stand in
        order = Window.partitionBy("lang").orderBy(draw, "doc_id")
        stand_in = rows.where(F.col("lang").isin(missed)).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_language)
        got = sorted([*got, *((r["lang"], r["piece"]) for r in stand_in.select("lang", F.explode(F.array(*(piece(k) for k in range(WINDOWS_PER_DOC)))).alias("piece")).collect())])
    x = np.zeros((len(got), WINDOW), np.uint8)
    for row, (_, text) in zip(x, got, strict=True):
        raw = text.encode()[:WINDOW]
        row[: len(raw)] = np.frombuffer(raw.translate(_TO_SYMBOL), np.uint8)
    return x, [lang for lang, _ in got]


def train(labelled: DataFrame) -> ByteNetwork | None:
    x, langs = training_windows(labelled)
    classes = sorted(set(langs))
    if not classes:
        return None
    net = ByteNetwork(classes)
    # Every language has the same weight: windows of the rarer ones are drawn more often.
    index = {c: i for i, c in enumerate(classes)}
    y = np.array([index[c] for c in langs])
    most = max(np.bincount(y))
    order = np.concatenate([np.resize(np.flatnonzero(y == c), most) for c in range(len(classes))])
    net.train(x[order], y[order])
    return net


def predict(docs: DataFrame, net: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; with ``carry`` also all its columns behind, as c0, c1, ..."""
    tables = net.tables() if net else None
    classes = net.classes if net else [UNKNOWN]

    def work(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            total = np.zeros((len(texts), len(classes)))
            held, owners, size = [], [], 0

            def flush():
                nonlocal size
                x = np.concatenate(held)
                owner = np.repeat([o for o, _ in owners], [n for _, n in owners])
                p = net.probabilities(x, tables)
                np.add.at(total, owner, p)
                held.clear()
                owners.clear()
                size = 0

            for i, text in enumerate(texts):
                if net is None or text is None or not _LETTER.search(text):
                    continue
                raw = text.encode()
                rows = windows_of(raw)
                for lo in range(0, len(rows), CHUNK // WINDOW):
                    part = rows[lo : lo + CHUNK // WINDOW]
                    held.append(part)
                    owners.append((i, len(part)))
                    size += part.size
                    if size >= CHUNK:
                        flush()
            if size:
                flush()
            n = total.sum(axis=1)
            best = total.argmax(axis=1)
            pred = [classes[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)]
            score = np.where(n > 0, total.max(axis=1) / np.maximum(n, 1e-9), 0.0)
            out = [batch.column(0), pa.array(pred, pa.string()), pa.array(np.minimum(score, 1.0)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", *extra])

    extra = [f"c{i}" for i in range(len(docs.columns))] if carry else []
    taken = docs.select(F.col(id_col), F.col(text_col), *(F.col(f"`{c}`") for c in docs.columns if carry))
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double"
    return taken.mapInArrow(work, ", ".join([schema, *(f"{e} {t}" for e, (_, t) in zip(extra, docs.dtypes, strict=False))]))


def keep_known(docs: DataFrame, net: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The documents whose language is predicted with a score of at least ``least``."""
    found = predict(docs, net, id_col, text_col, carry=True)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.drop("doc_id", "lang_pred", "score").toDF(*docs.columns)


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def op7_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    net = train(docs.where(~held_out()))
    return predict(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
