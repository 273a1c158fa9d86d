"""Line dedup: exact copies by hash, near copies within one edit by a segment-partition join.

A line is cut into threshold-plus-one (two) segments. Two lines within one edit agree in a segment, at the same place
from the start or, behind the edit, at the same place from the end; so a line is indexed under its length and each of its
segments, and a line one character longer probes with the matching substrings of its own. Lines that meet under a key are
verified with a banded bit-parallel edit distance.

Keys under which many lines meet aren't expanded into pairs. Their lines stay in, with the unmatched segment cut
into FANOUT smaller ones and all around it as the key, again and again; at one character (or one place between two)
all lines that meet are within one edit of each other, so that all but the first are near copies of the first. Two 64-bit hashes of
all that is around the place must agree, as two name a line. This is linear in the lines times the logarithm of their length.

A line is dropped if an equal line, or one within an edit of it, occurs earlier (by doc_id, then line number). Lines
without a word are left alone; a caller may have short lines compared for equality only.

Defined results: a null or empty text has no lines and stays as it is; rows repeated under one id count once and get the
same decisions; rows without an id are left as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import read, stored

MAX_EDITS = 1
SMALL_BUCKET = 6
FANOUT = 4
#: Halvings before a distance is counted character by character.
HALVINGS = 5
_SPACE = " \t\n\x0b\f\r"
_HAS_WORD = r"[^\x20\x09-\x0D]"


def banded_distance(x: Column, y: Column, k: int = MAX_EDITS) -> Column:
    """Edit distance of two arrays of characters, exact up to k and larger than k beyond.

    Hyyro's banded form of the bit-vector algorithm: a word of 2k + 1 bits holds the vertical differences of the band
    around the diagonal. While its lower edge runs down the rows the distance follows the diagonal, then the last row.
    """
    if k > 1:  # the band must start inside: the same k characters in front of both change nothing
        x, y = (F.concat(F.array_repeat(F.lit("\0"), k), v) for v in (x, y))
    swap = F.size(x) < F.size(y)
    p, t = F.when(swap, y).otherwise(x), F.when(swap, x).otherwise(y)
    full, top, side = (1 << (2 * k + 1)) - 1, 1 << (2 * k), 1 << max(2 * k - 1, 0)

    def step(acc: Column, i: Column) -> Column:
        c = F.get(t, i)
        hit = sum((F.when(F.get(p, F.when(i + b >= k, i + b - k)) == c, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(2 * k + 1)), F.lit(0))
        carried = F.struct(hit.alias("x"), acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["d"].alias("d"), acc["at"].alias("at"))
        d0 = lambda s: (((s["x"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(s["x"]).bitwiseOR(s["vn"])).bitwiseAND(F.lit(full))
        with_d0 = F.transform(F.array(carried), lambda s: F.struct(s.alias("s"), d0(s).alias("d0")))
        with_h = F.transform(
            with_d0,
            lambda r: F.struct(
                r["s"].alias("s"),
                r["d0"].alias("d0"),
                r["s"]["vn"].bitwiseOR(F.bitwise_not(r["d0"].bitwiseOR(r["s"]["vp"]))).bitwiseAND(F.lit(full)).alias("hp"),
                r["d0"].bitwiseAND(r["s"]["vp"]).alias("hn"),
            ),
        )

        def after(r: Column) -> Column:
            diagonal = i < F.size(p) - k
            down = r["s"]["d"] + F.when(r["d0"].bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
            along = r["s"]["d"] + F.when(r["hp"].bitwiseAND(r["s"]["at"]) != 0, 1).otherwise(0) - F.when(r["hn"].bitwiseAND(r["s"]["at"]) != 0, 1).otherwise(0)
            shifted = F.shiftright(r["d0"], 1)
            return F.struct(
                r["hn"].bitwiseOR(F.bitwise_not(shifted.bitwiseOR(r["hp"]))).bitwiseAND(F.lit(full)).alias("vp"),
                shifted.bitwiseAND(r["hp"]).alias("vn"),
                F.when(diagonal, down).otherwise(along).alias("d"),
                F.when(diagonal, r["s"]["at"]).otherwise(F.shiftright(r["s"]["at"], 1)).alias("at"),
            )

        return F.element_at(F.transform(with_h, after), 1)

    start = F.struct(F.lit((full >> k) << k).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("d"), F.lit(side).alias("at"))
    places = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    banded = F.aggregate(places, start, step, lambda acc: acc["d"])
    return F.when(F.size(p) - F.size(t) > k, F.lit(k + 1)).when(F.size(t) == 0, F.size(p)).otherwise(banded)


def within_one_edit(x: Column, y: Column) -> Column:
    """Equal halves from the start or the end are taken off first (one edit leaves one of them equal), until few characters are left."""
    pair = F.array(F.struct(x.alias("x"), y.alias("y")))

    def halve(s: Column) -> Column:
        h = F.least(F.length(s["x"]), F.length(s["y"])) / 2
        h = h.cast("int")
        head = F.substring(s["x"], F.lit(1), h) == F.substring(s["y"], F.lit(1), h)
        tail = F.right(s["x"], h) == F.right(s["y"], h)
        cut_head = F.struct(F.substr(s["x"], h + 1).alias("x"), F.substr(s["y"], h + 1).alias("y"))
        cut_tail = F.struct(F.left(s["x"], F.length(s["x"]) - h).alias("x"), F.left(s["y"], F.length(s["y"]) - h).alias("y"))
        return F.when(head, cut_head).when(tail, cut_tail)

    for _ in range(HALVINGS):
        pair = F.filter(F.transform(pair, halve), lambda s: s.isNotNull())
    near = F.exists(pair, lambda s: banded_distance(F.split(s["x"], ""), F.split(s["y"], "")) <= MAX_EDITS)
    return (F.abs(F.length(x) - F.length(y)) <= MAX_EDITS) & near


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line) for every line with a word."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return rows.where(F.ltrim(F.col("line"), F.lit(_SPACE)) != "")


def _key(kind: str | Column, n: Column, a: Column, b: Column, line: Column) -> Column:
    """A line's key for the segment from a to b of lines of length n: all in front of it and all behind it."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.xxhash64(kind, n, a, b, F.left(line, a), F.right(line, n - b))


def _segments(n: Column) -> list[tuple[bool, Column, Column, Column]]:
    """(own, m, a, b): both segments of a line of length n, and those of the lines shorter by one that it may be a copy of."""
    half = lambda m: (m / 2).cast("int")
    return [(own, m, a, b) for own, m in ((True, n), (False, n - 1)) for a, b in ((half(m), m), (F.lit(0), half(m)))]


def _first_keys(line: Column, n: Column, min_chars: int) -> Column:
    """The keys of all segments, as array<long>; lines that are compared for equality only have none."""
    return F.when(n >= min_chars, F.array(*(_key("", m, a, b, line) for _, m, a, b in _segments(n))))


def _probes(classes: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, line_no, key, kind, m, a, b, own): a row for each key of a distinct line."""
    cells = [F.struct(F.get("keys", F.lit(i)).alias("key"), F.lit("").alias("kind"), m.alias("m"), a.alias("a"), b.alias("b"), F.lit(own).alias("own")) for i, (own, m, a, b) in enumerate(_segments(F.col("n")))]
    return classes.where("keys IS NOT NULL").select("doc_id", "line_no", F.lit(0).cast("long").alias("check"), F.inline(F.array(*cells))).where(F.col("m") >= max(min_chars, 1))


def _finer(crowd: DataFrame) -> DataFrame:
    """Each crowded segment cut into FANOUT. Kind s: a character between a and b differs, in lines of one length. Kind
    i: lines longer by one have a character at one of the places a to b."""
    cut = lambda i, w: (F.col("a") + (i.cast("long") * w / FANOUT).cast("int")).cast("int")
    steps = F.sequence(F.lit(0), F.lit(FANOUT - 1))
    w = F.col("b") - F.col("a")
    same = F.transform(steps, lambda i: F.struct(F.lit("s").alias("kind"), cut(i, w).alias("a"), cut(i + 1, w).alias("b")))
    more = F.transform(steps, lambda i: F.struct(F.lit("i").alias("kind"), cut(i, w + 1).alias("a"), (cut(i + 1, w + 1) - 1).alias("b")))
    same = F.filter(same, lambda s: s["b"] > s["a"])
    more = F.filter(more, lambda s: s["b"] >= s["a"])
    none = F.array().cast("array<struct<kind:string,a:int,b:int>>")
    wanted = F.concat(F.when((F.col("kind") != "i") & F.col("own") & (F.col("owns") > 1), same).otherwise(none), F.when((F.col("kind") != "s") & (F.col("size") > F.col("owns")), more).otherwise(none))
    # Lines of one length, or of both, must be there for a link to be found.
    parts = crowd.select("doc_id", "line_no", "line", "m", "own", F.explode(wanted).alias("p"))
    key = lambda kind: _key(kind, F.col("m"), F.col("p.a"), F.col("p.b"), F.col("line"))
    return parts.select(
        "doc_id", "line_no", key(F.col("p.kind")).alias("key"), key(F.concat(F.lit("2"), "p.kind")).alias("check"), F.col("p.kind").alias("kind"), "m", F.col("p.a").alias("a"), F.col("p.b").alias("b"), "own"
    )


def _met(rows: DataFrame) -> DataFrame:
    """The rows that share their key with another line and could be linked to it, with the number that share it."""
    sizes = rows.groupBy("key", "check").agg(F.count(F.lit(1)).alias("size"), F.count_if("own").alias("owns"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    return rows.join(sizes.where("size > 1 AND owns > 0"), ["key", "check"])


def near_copies(docs: DataFrame, classes: DataFrame, min_chars: int = 0) -> DataFrame:
    """(doc_id, line_no, first struct<doc_id,line_no>) of distinct lines with an earlier line within one edit.

    ``classes`` has each distinct line's first place and its keys.
    """
    met = stored(_met(_probes(classes, min_chars)))
    wanted = met.groupBy("doc_id").agg(F.collect_set("line_no").alias("nos"))
    # Whole documents are dealt out, and only their wanted lines cut from them: one split, no row for the other lines.
    cut = F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform(F.col("nos"), lambda i: F.struct(i.alias("line_no"), F.get(lines, i).alias("line"))))
    texts = docs.join(wanted, "doc_id").select("doc_id", F.inline(F.get(cut, F.lit(0))))
    texts = stored(texts.dropDuplicates(["doc_id", "line_no"]))
    pairs, found = [], []
    while True:
        few = met.where(F.col("size") <= SMALL_BUCKET).select("key", "check", "doc_id", "line_no", "own", "kind")
        x, y = few.alias("x"), few.alias("y")
        later = F.struct("x.doc_id", "x.line_no") > F.struct("y.doc_id", "y.line_no")
        roles = (F.col("x.own") | F.col("y.own")) & ((F.col("x.kind") != "i") | (F.col("x.own") != F.col("y.own")))
        pairs.append(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.check") == F.col("y.check"))).where(later & roles).select("x.doc_id", "x.line_no", F.struct("y.doc_id", "y.line_no").alias("first")))
        leaf = ((F.col("kind") == "s") & (F.col("b") - F.col("a") == 1)) | ((F.col("kind") == "i") & (F.col("a") == F.col("b")))
        crowd = met.where(F.col("size") > SMALL_BUCKET)
        found.append(crowd.where(leaf & (F.struct("doc_id", "line_no") > F.col("first"))).select("doc_id", "line_no", "first"))
        crowd = crowd.where(~leaf)
        if crowd.isEmpty():
            break
        crowd = crowd.drop("key", "check", "first").join(texts, ["doc_id", "line_no"])
        met = stored(_met(_finer(crowd)))
    every = pairs[0]
    for p in pairs[1:]:
        every = every.unionByName(p)
    every = every.distinct()
    named = every.join(texts, ["doc_id", "line_no"]).join(
        texts.select(F.struct("doc_id", "line_no").alias("first"), F.col("line").alias("other")), "first"
    )
    # Comparing costs far more than its bytes suggest: the pairs are dealt out again, evenly.
    named = stored(named.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "line_no"))
    out = named.where(within_one_edit(F.col("line"), F.col("other"))).select("doc_id", "line_no", "first")
    for f in found:
        out = out.unionByName(f)
    return out.groupBy("doc_id", "line_no").agg(F.min("first").alias("first"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 0) -> DataFrame:
    """(doc_id, line_no, reason exact|near, first struct<doc_id,line_no>) for every line that an earlier one makes redundant.

    Lines of fewer than ``min_chars`` characters are compared for equality only.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n = F.length("line")
    # Two 64-bit hashes name a line.
    name = (F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))
    rows = stored(lines_of(docs).select("doc_id", "line_no", *name, n.alias("n"), _first_keys(F.col("line"), n, min_chars).alias("keys")))
    first = F.min(F.struct("doc_id", "line_no")).alias("f")
    classes = rows.groupBy("h1", "h2").agg(first, F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select("h1", "h2", "f.*", "n", "keys", "copies"))
    near = near_copies(docs, classes, min_chars)
    again = classes.where("copies > 1").select("h1", "h2", F.struct("doc_id", "line_no").alias("first"))
    exact = rows.select("doc_id", "line_no", "h1", "h2").join(again, ["h1", "h2"]).where(F.struct("doc_id", "line_no") > F.col("first"))
    return exact.select("doc_id", "line_no", F.lit("exact").alias("reason"), "first").unionByName(near.select("doc_id", "line_no", F.lit("near").alias("reason"), "first"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 0) -> DataFrame:
    """The documents without their dropped lines; those that lose all their lines with a word go."""
    gone = dropped_lines(docs, id_col, text_col, min_chars).groupBy("doc_id").agg(F.collect_set("line_no").alias("__gone"))
    out = docs.join(gone.withColumnRenamed("doc_id", "__id"), F.col(id_col) == F.col("__id"), "left")
    lines = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.array_join(F.transform(F.array_sort(stay), lambda i: F.get(lines, i)), "\n")
    out = out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(text))
    return out.where(F.col("__gone").isNull() | F.regexp_like(F.col(text_col), F.lit(_HAS_WORD))).select(*docs.columns)


def op1_lines(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    gone = dropped_lines(docs).groupBy("doc_id").agg(
        F.count_if(F.col("reason") == "exact").alias("n_exact"), F.count_if(F.col("reason") == "near").alias("n_near"), F.sum(F.col("line_no").cast("long")).alias("dropped_nos")
    )
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.ltrim(x, F.lit(_SPACE)) != "")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select("doc_id", F.size(lines).cast("long").alias("n_lines")).join(gone, "doc_id", "left").select("doc_id", "n_lines", zero("n_exact"), zero("n_near"), zero("dropped_nos"))


#: The same decisions in DuckDB: candidates by equal halves, then the common start and end must leave one edit.
OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS k, length(line) AS n FROM w),
c AS (SELECT doc_id, line_no, line, n FROM r WHERE k = 1),
keys AS (
  SELECT doc_id, line_no, line, n, n AS m, 1 AS s, left(line, CAST(floor(n / 2) AS BIGINT)) AS part FROM c
  UNION ALL SELECT doc_id, line_no, line, n, n, 2, right(line, CAST(n - floor(n / 2) AS BIGINT)) FROM c
  UNION ALL SELECT doc_id, line_no, line, n, n - 1, 1, left(line, CAST(floor((n - 1) / 2) AS BIGINT)) FROM c WHERE n > 1
  UNION ALL SELECT doc_id, line_no, line, n, n - 1, 2, right(line, CAST(n - 1 - floor((n - 1) / 2) AS BIGINT)) FROM c WHERE n > 1),
pairs AS (
  SELECT DISTINCT x.doc_id, x.line_no, x.line AS xl, y.line AS yl, greatest(x.n, y.n) AS longer, least(x.n, y.n) AS shorter
  FROM keys x JOIN keys y ON x.m = y.m AND x.s = y.s AND x.part = y.part
  WHERE (x.doc_id > y.doc_id OR (x.doc_id = y.doc_id AND x.line_no > y.line_no)) AND (x.n = x.m OR y.n = y.m)),
near AS (
  SELECT DISTINCT doc_id, line_no FROM pairs
  WHERE len(list_filter(range(1, shorter + 1), lambda i: left(xl, i) = left(yl, i))) + len(list_filter(range(1, shorter + 1), lambda i: right(xl, i) = right(yl, i))) >= longer - 1),
gone AS (
  SELECT doc_id, line_no, 1 AS e FROM r WHERE k > 1
  UNION ALL SELECT doc_id, line_no, 0 FROM near),
g AS (SELECT doc_id, CAST(sum(e) AS BIGINT) AS n_exact, CAST(sum(1 - e) AS BIGINT) AS n_near, CAST(sum(line_no) AS BIGINT) AS dropped_nos FROM gone GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, coalesce(dropped_nos, 0) AS dropped_nos
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""
