"""SentencePiece encoding and decoding by streaming Viterbi.

The best path is the one whose pieces' scores sum up highest; of equal ones, the one with the earlier start of the last piece. A
stream keeps the characters that a piece could still span and the uncommitted part of the surviving paths; as soon as
all of them go through one boundary, the ids up to it are committed. Characters without a piece become the pieces
of their UTF-8 bytes, so every text decodes to itself.

The given model file holds its pieces with merge ranks as scores. They are taken as the model has them; the ids are
those of the best-scoring path over these pieces, not of the pair merges.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; repeated rows give repeated results.
A blank in front of the text is added and taken off again; the meta symbol itself is encoded by its bytes. A column that has the
name of the result's is replaced.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import read

MODEL = os.environ.get("TRAJFRAME_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
META = "▁"
#: Stands for a meta symbol that the text itself holds while blanks are meta symbols; not a character of any piece.
_LITERAL = "\ue000"
#: What a character without a piece costs below the least score.
UNKNOWN_PENALTY = 10.0
#: Segments whose ids a task remembers, in each of two generations.
REMEMBERED = 150_000


class Pieces:
    """Pieces, scores and ids of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): (model.get_score(i), i) for i in plain if model.id_to_piece(i)}
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.score))
        self.unknown = min(s for s, _ in self.score.values()) - UNKNOWN_PENALTY
        # Nested dictionaries by character; None holds a piece's score and id.
        self.trie: dict = {}
        for p, known in self.score.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[None] = known
        # A cut before a meta symbol is safe if no piece has one behind another character, a cut at a line feed if no piece holds one.
        self.words = not any(re.search(f"[^{META}]{META}", p) for p in self.score)
        feed = "\n" if not any("\n" in p for p in self.score) else ""
        self.cut = re.compile(f"{META}+[^{META}{feed}]*|[^{META}{feed}]+" + ("|\n" if feed else ""))
        self.bytes_of = [b""] * len(ids)
        for p, (_, i) in self.score.items():
            self.bytes_of[i] = p.replace(META, " ").encode()
        for b, i in enumerate(self.byte_id):
            self.bytes_of[i] = bytes([b])
        if any(_LITERAL in p for p in self.score):
            raise ValueError("a piece holds the private character that stands for a literal meta symbol")

    def fallback(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in (META if char == _LITERAL else char).encode()]


    def best_path(self, segment: str) -> list[int]:
        """Ids of a segment that fits into the window, so that nothing can be committed before its end."""
        n, trie, unknown = len(segment), self.trie, self.unknown
        best, back, ids = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here, node, single = best[start], trie, False
            for end in range(start, n):
                node = node.get(segment[end])
                if node is None:
                    break
                known = node.get(None)
                if known:
                    if end == start:
                        single = True
                    if here + known[0] > best[end + 1]:
                        best[end + 1], back[end + 1], ids[end + 1] = here + known[0], start, known[1]
            if not single and here + unknown > best[start + 1]:
                best[start + 1], back[start + 1], ids[start + 1] = here + unknown, start, -1
        out: list[int] = []
        while n:
            out += [ids[n]] if ids[n] >= 0 else self.fallback(segment[n - 1])[::-1]
            n = back[n]
        return out[::-1]


class Memo:
    """The ids of recent segments, bounded: the younger of two generations takes the place of the older once it is full."""

    def __init__(self, size: int = REMEMBERED):
        self.size, self.young, self.old = size, {}, {}

    def get(self, segment: str) -> bytes | None:
        found = self.young.get(segment)
        if found is None:
            found = self.old.get(segment)
            if found is not None:
                self.put(segment, found)
        return found

    def put(self, segment: str, ids: bytes) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[segment] = ids


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class StreamingViterbi:
    """feed() characters as they come, finish() at the end; both return the ids that became certain.

    ``text`` holds the characters from the last committed boundary on, ``best`` and ``back`` the best score of a path
    to each boundary in it and where its last piece starts. A piece is at most ``longest`` characters, so only
    the last ``longest`` boundaries can be continued; when the paths to all of them share a boundary, what lies before is
    committed and forgotten. A boundary that no piece spans (before a blank, around a line feed) is shared by all paths whatever
    came before: the stream commits there without looking, and the ids of a segment between two of them can be remembered. The window is
    as long as the stretch in which paths stay apart; nothing is forced, since that could change ids.
    """

    def __init__(self, model: Pieces, memo: Memo | None = None):
        self.model, self.memo = model, memo
        self.held = ""  # the start of a segment whose end hasn't come
        self.text, self.best, self.back = "", [0.0], [-1]
        self.done = 0  # boundaries whose best path is final
        self.most = 0  # the longest window so far

    def feed(self, chunk: str) -> list[int]:
        return np.frombuffer(b"".join(self.parts(chunk)), "<i4").tolist()

    def finish(self) -> list[int]:
        return np.frombuffer(b"".join(self.last_parts()), "<i4").tolist()

    def parts(self, chunk: str) -> list[bytes]:
        """As feed(), the ids as pieces of little-endian int32."""
        model = self.model
        if not model.words:
            return [self._advance(chunk)]
        segments = model.cut.findall(self.held + chunk)
        self.held = segments.pop() if segments else ""
        out, young = [], self.memo.young if self.memo else {}
        if self.text and segments:
            out.append(self._segment(segments[0], True))
            del segments[0]
        for s in segments:
            ids = young.get(s)
            if ids is None:
                ids = self._segment(s, False)
                young = self.memo.young if self.memo else young
            out.append(ids)
        if len(self.held) > model.longest and not self.held.endswith(META):
            if self.text and segments:  # the held segment is a new one: the one before it has ended
                out.append(self._close())
            out.append(self._advance(self.held))
            self.held = ""
        return out

    def last_parts(self) -> list[bytes]:
        out = [self._segment(self.held, True)] if self.held else []
        self.held = ""
        return [*out, self._close()]

    def _segment(self, segment: str, first: bool) -> bytes:
        """Ids of a segment that has ended, or of the end of one that has begun to pass."""
        before = b""
        if self.text:
            if first and segment[0] != META and segment != "\n":
                return self._advance(segment) + self._close()
            before = self._close()
        if len(segment) > self.model.longest:
            return before + self._advance(segment) + self._close()
        ids = self.memo.get(segment) if self.memo else None
        if ids is None:
            ids = array("i", self.model.best_path(segment)).tobytes()
            if self.memo:
                self.memo.put(segment, ids)
        return before + ids

    def _advance(self, chunk: str) -> bytes:
        out = []
        for lo in range(0, len(chunk), self.model.longest):
            self.text += chunk[lo : lo + self.model.longest]
            self.most = max(self.most, len(self.text))
            self._extend(len(self.text) - self.model.longest)
            out += self._commit()
        return array("i", out).tobytes()

    def _close(self) -> bytes:
        self._extend(len(self.text))
        out = self._path(len(self.text))
        self.text, self.best, self.back, self.done = "", [0.0], [-1], 0
        return array("i", out).tobytes()

    def _extend(self, until: int) -> None:
        """Pieces that start at each boundary before ``until``: all that they can span has been read."""
        text, best, back, trie, unknown = self.text, self.best, self.back, self.model.trie, self.model.unknown
        grow = min(len(text), max(until, 0) + self.model.longest) + 1 - len(best)
        best += [float("-inf")] * grow
        back += [-1] * grow
        for start in range(self.done, until):
            here, node = best[start], trie
            for end in range(start, len(text)):
                node = node.get(text[end])
                if node is None:
                    break
                known = node.get(None)
                if known and here + known[0] > best[end + 1]:
                    best[end + 1], back[end + 1] = here + known[0], start
            if None not in trie.get(text[start], ()) and here + unknown > best[start + 1]:
                best[start + 1], back[start + 1] = here + unknown, start
        self.done = max(self.done, until)

    def _commit(self) -> list[int]:
        """Ids up to the boundary that all live paths go through; live are those that end in the window's last part."""
        live = {b for b in range(self.done, len(self.best)) if self.best[b] > float("-inf")}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(self.back[last])
        at = live.pop() if live else 0
        if at <= 0:
            return []
        out = self._path(at)
        base = self.best[at]
        self.text, self.done = self.text[at:], self.done - at
        self.best = [b - base for b in self.best[at:]]
        self.back = [-1] + [b - at for b in self.back[at + 1 :]]
        return out

    def _path(self, end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            start = self.back[end]
            known = self.model.score.get(self.text[start:end])
            out += [known[1]] if known else self.model.fallback(self.text[start])[::-1]
            end = start
        return out[::-1]


def encode(text: str, model: Pieces, memo: Memo | None = None) -> bytes:
    """Ids of a text as little-endian int32, all of them from one stream."""
    if not text:
        return b""
    if _LITERAL in text:
        return _around_private(text, model)
    stream = StreamingViterbi(model, memo)
    parts = stream.parts(META + text.replace(META, _LITERAL).replace(" ", META))
    return b"".join(parts + stream.last_parts())


def _around_private(text: str, model: Pieces) -> bytes:
    """A text with private characters: the parts between them are streamed, they themselves go by their bytes."""
    out: list[bytes] = []
    for k, part in enumerate(re.split(f"({_LITERAL})", text)):
        if part == _LITERAL:
            out.append(array("i", [model.byte_id[b] for b in part.encode()]).tobytes())
            continue
        stream = StreamingViterbi(model)
        out += stream.parts(("" if k else META) + part.replace(META, _LITERAL).replace(" ", META)) + stream.last_parts()
    return b"".join(out)


def decode(ids, model: Pieces) -> str:
    return b"".join([model.bytes_of[i] for i in ids])[1:].decode("utf-8", errors="replace")


def _carried(docs: DataFrame, out_type: str) -> str:
    return ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)) + f", out {out_type}"


def encode_texts(docs: DataFrame, text_col: str = "text", out_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """Adds the ids of every whole text as array<int>."""
    at = docs.columns.index(text_col)

    def work(batches):
        model, memo = pieces(model_path), Memo()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            parts = [b"" if t is None else encode(t, model, memo) for t in texts]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            mask = pa.array([t is None for t in texts]) if texts else None
            ids = pa.ListArray.from_arrays(pa.array(ends), values, mask=mask) if texts else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*(f"c{i}" for i in range(batch.num_columns)), "out"])

    done = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(work, _carried(docs, "array<int>"))
    return done.toDF(*docs.columns, "__out").withColumn(out_col, F.col("__out")).drop("__out")


def decode_ids(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """Adds the text of every array of ids."""
    at = docs.columns.index(ids_col)

    def work(batches):
        model = pieces(model_path)
        for batch in batches:
            texts = [None if not x.is_valid else decode(x.values.to_numpy().tolist(), model) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*(f"c{i}" for i in range(batch.num_columns)), "out"])

    done = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(work, _carried(docs, "string"))
    return done.toDF(*docs.columns, "__out").withColumn(out_col, F.col("__out")).drop("__out")


def op9_pieces(spark, sf_dir):
    docs = encode_texts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = decode_ids(docs)
    return back.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.length("decoded").cast("long").alias("n_chars"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
