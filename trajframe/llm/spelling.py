"""Spelling variants grouped by PartEnum signatures.

A word is a multiset of letters, taken as a binary vector over (letter, how many-th of its kind). One changed letter moves two bits of
it, one inserted or deleted letter moves one. The dimensions are dealt to PARTS[0] parts. Vectors of equally long words within two bits agree
outside of some two parts, so each choice of two parts to leave out gives a signature of the rest; vectors of words whose lengths differ by one
agree outside of some single one of PARTS[1] parts. As an edit also leaves the first or the second half of the letters as they are, each signature
comes twice, with either half's hash: anagrams, of which syllables make many, mostly don't meet. Words meet by equal signatures (an equi-join) and
are verified by their edit distance.

Where more than CROWD words share a signature, they aren't paired. Each of them instead gives a key for every way to mask or to drop one of
its letters (rolling hashes, so a word's keys take no more room than the word), and for itself. Words within one edit share a key, and no key has more words than
there are letters times places in a word, however many share a signature. Both ways find every link, and both are verified.

A word's form is its most frequent near word, if that is at least twice as frequent. Counts rise along forms, so they make trees; roots are
found by pointer doubling.

Defined results: a null or empty text has no words, a null id counts as an empty one; repeated rows count again; words of any length are taken whole; an empty
table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import read, stored
from trajframe.llm.runs import TABLE, letters, runs

LEAST_LETTERS = 5
LEAST_COUNT = 3
PARTS = (4, 3)
CROWD = 48
#: Of a form to its word, in counts.
RATIO = 2
#: One word in SLIPS, of a document, has lost a letter.
SLIPS = 97
#: A-Z, a-z and U+00C0 to U+00FF in Latin-1.
LETTERS = letters(lambda c: 97 <= c <= 122 or c >= 0xC0)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_MERSENNE, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681 % ((1 << 61) - 1)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT, table: int = TABLE) -> DataFrame:
    """(word, n) of all words of LEAST_LETTERS letters and ``least`` occurrences: lower-cased runs of letters, one in SLIPS of a document's distinct
    ones less a letter, as a checksum of the id and the run says. Each task sums in a table of some ``table`` words before anything is shuffled."""
    crc = zlib.crc32
    unicode = lambda w: w if w.isascii() else w.decode("latin-1").encode()

    def work(batches):
        sums: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            rows = [(w.decode("latin-1"), n) for w, n in sums.items() if n and len(w) >= LEAST_LETTERS]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lead = crc(f"{'' if doc_id is None else doc_id}:".encode())
                for found in runs(text, "latin-1", LETTERS):
                    words = [w for w in found if len(w) >= LEAST_LETTERS]
                    sums.update(words)
                    slipped = {w for w in set(words) if not crc(unicode(w), lead) % SLIPS}
                    for w in [w for w in words if w in slipped] if slipped else ():
                        at = crc(unicode(w), lead) % len(w)
                        sums[w] -= 1
                        sums[w[:at] + w[at + 1 :]] += 1
                    if len(sums) >= table:
                        yield sent()
        yield sent()

    found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def hashed(items: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in items), np.uint64, len(items))


def halves(words: list[str], lengths: np.ndarray) -> list[np.ndarray]:
    """Hashes of what stands before the middle and of what stands behind it, the middle being that of a word of the given length."""
    cut = [int(n) // 2 for n in lengths]
    return [mixed(hashed([w[:k] for w, k in zip(words, cut, strict=True)])), hashed([w[len(w) - int(n) + k :] for w, n, k in zip(words, lengths, cut, strict=True)])]


def letter_vectors(words: list[str], lengths: np.ndarray, parts: int) -> np.ndarray:
    """uint64 (words, parts): a hash of the set of each part's dimensions (letter, how many-th of its kind) that a word has."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((points, owner))
    points, owner = points[order], owner[order]
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    nth = np.arange(len(points)) - np.repeat(starts, np.diff(np.append(starts, len(points))))
    h = mixed(points * np.uint64(1 << 32) + nth.astype(np.uint64))
    out = np.zeros((len(words), parts), np.uint64)
    np.add.at(out, (owner, (h % np.uint64(parts)).astype(np.int64)), mixed(h))  # a set's hash is the sum of its members'
    return out


def signatures(words: list[str], parts: tuple[int, int] = PARTS) -> np.ndarray:
    """uint64, a row for each word: its signatures for words of its length (without two of parts[0] parts), then as the longer and as the shorter of two
    (without one of parts[1]), each with both halves."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    number = lambda x: mixed(np.asarray(x, np.uint64))
    out = []

    def put(vectors: np.ndarray, left_out: tuple[int, ...], low: np.ndarray, kind: int) -> None:
        rest = vectors.sum(axis=1, dtype=np.uint64) - sum((vectors[:, i] for i in left_out), np.zeros(len(words), np.uint64))
        place = number([kind * 4096 + sum(1 << i for i in left_out)]) + number(low)
        out.extend(mixed(rest + place + half) for half in halves_of[id(low)])

    shorter = n - 1
    halves_of = {id(n): halves(words, n), id(shorter): halves(words, shorter)}
    two, one = (letter_vectors(words, n, p) for p in parts)
    for pair in combinations(range(parts[0]), 2):
        put(two, pair, n, 1)
    for low in (shorter, n):
        for i in range(parts[1]):
            put(one, (i,), low, 2)
    return np.stack(out, axis=1)


def edit_keys(word: str) -> list[int]:
    """Keys of a word with each of its letters masked, with each of them dropped, and whole as what a longer word with one dropped would be."""
    n, points = len(word), [ord(c) + 1 for c in word]
    front = [0]
    for c in points:
        front.append((front[-1] * _BASE + c) % _MERSENNE)
    power, out, back = 1, [], 0  # back: the hash of what stands behind the letter, power: the base to its length
    for i in range(n - 1, -1, -1):
        masked = (front[i] * _BASE % _MERSENNE * power + back) % _MERSENNE
        dropped = (front[i] * power + back) % _MERSENNE
        out += [masked * 4 + 1, dropped * 4 + 2]
        back = (points[i] * power + back) % _MERSENNE
        power = power * _BASE % _MERSENNE
    return [*dict.fromkeys(out), front[n] * 4 + 2]


def _keyed(words: DataFrame, keys) -> DataFrame:
    """(word, n, key) with ``keys`` of a list of words as an Arrow array of lists of longs."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                yield pa.RecordBatch.from_arrays([*part.columns, keys(part.column(0).to_pylist())], ["word", "n", "keys"])

    return words.select("word", "n").mapInArrow(work, "word string, n long, keys array<long>").select("word", "n", F.explode("keys").alias("key"))


def _beside(rows: DataFrame) -> DataFrame:
    """The rows as a join's right side that is never broadcast: Spark doesn't see how many rows an explode or a compressed file makes, and takes such tables for small."""
    return rows.hint("merge")


def near_words(words: DataFrame, parts: tuple[int, int] = PARTS, crowd: int = CROWD) -> DataFrame:
    """(a, na, b, nb), a before b: all pairs of distinct words (word, n) that differ by one inserted, deleted or replaced letter."""

    def signed(items: list[str]) -> pa.Array:
        keys = signatures(items, parts).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(items) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))

    rows = _keyed(words, signed)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stored(rows.join(_beside(sizes), "key"))

    def verified(rows: DataFrame) -> DataFrame:
        x, y = rows.toDF("key", "a", "na"), rows.toDF("key", "b", "nb")
        close = F.abs(F.length("a") - F.length("b")) <= 1
        return x.join(_beside(y), "key").where((F.col("a") < F.col("b")) & close & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")

    few = verified(met.where(F.col("size") <= crowd).select("key", "word", "n"))
    many = met.where(F.col("size") > crowd).select("word", "n").distinct()
    other = verified(_keyed(many, lambda items: pa.array(map(edit_keys, items), pa.list_(pa.int64()))).select("key", "word", "n"))
    return few.unionByName(other).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), which has no cycles: each round every word looks where its present end leads, so paths double."""
    ends = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not ends.where("moved").isEmpty():
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = stored(ends.join(_beside(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return ends.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, parts: tuple[int, int] = PARTS, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for all words (word, n), each once."""
    words = stored(words.select("word", "n"))
    pairs = near_words(words, parts, crowd)
    both = pairs.select("a", F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("near"))).alias("best"))
    found = words.join(_beside(best), words["word"] == best["a"], "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    named = found.join(_beside(roots(found.where("form IS NOT NULL").select("word", "form"))), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir):
    return variants(word_counts(read(spark, sf_dir, "documents")))


#: The checksum is computed byte by byte from a table of its 256 steps; words meet by masked letters and by dropped ones.
OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each AS (SELECT doc_id, w, COUNT(*) AS c FROM runs GROUP BY 1, 2),
hexed AS (SELECT w, c, hex(encode(doc_id || ':' || w)) AS x FROM each),
summed AS (
  SELECT w, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda s, b: xor(s >> 8, t[1 + (xor(s, b) & 255)]))) AS h FROM hexed, steps),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM summed),
words AS (SELECT word, SUM(c)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING SUM(c) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masks AS (SELECT word, n, i, left(word, (i - 1)::INT) || '*' || substr(word, (i + 1)::INT) AS k FROM places),
drops AS (SELECT DISTINCT word, n, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS k FROM places),
near AS (
  SELECT a.word AS a, b.word AS b, b.n AS m FROM masks a JOIN masks b ON a.k = b.k AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM drops d JOIN words w ON w.word = d.k
  UNION SELECT w.word, d.word, d.n FROM drops d JOIN words w ON w.word = d.k),
best AS (SELECT a, COUNT(*) AS n_near, arg_min(b, (-m, b)) AS b, MAX(m) AS m FROM near GROUP BY a),
found AS (SELECT word, n, COALESCE(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN b END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best ON a = word),
up AS (SELECT word, word AS at FROM found UNION ALL SELECT up.word, form FROM up JOIN found ON found.word = up.at WHERE form IS NOT NULL)
SELECT f.word, f.form, up.at AS root, f.n, f.n_near, f.form_n FROM found f JOIN up ON up.word = f.word JOIN found e ON e.word = up.at AND e.form IS NULL
"""
