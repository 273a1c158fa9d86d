"""Spelling variants, source divergence and chat formatting against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from trajframe.llm import chat, divergence, spelling
from trajframe.llm.queries import QUERIES, SQL
from trajframe.llm.runs import letters, runs

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n int, key string, value long"
AWKWARD = [None, "", " ", "\n", "a", "é", "𝒜 𝒜 x", "word " * 3000, "x" * 70_000, "🙂" * 10, "A\x00B", "one two three", "one two three"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(None if i == 4 else i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", None, "k", 1) for i, t in enumerate(AWKWARD)]
    return spark.createDataFrame([*rows, rows[5], rows[8], rows[8]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op11_spelling", "op12_divergence", "op13_chat"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_runs_are_cut_between_words():
    table = letters(lambda c: 97 <= c <= 122)
    text = " ".join("ab" * (i % 7) for i in range(500)) + "-Z"
    assert sum(runs(text, "latin-1", table, 10), []) == re.findall(rb"[a-z]+", text.lower().encode())
    assert list(runs(None, "utf-8", table)) == [] and list(runs("", "utf-8", table)) == []


# Spelling variants


def brute_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def brute_variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("crowd", [2, spelling.CROWD])
@pytest.mark.parametrize("parts", [(3, 2), spelling.PARTS])
def test_variants(spark, crowd, parts):
    """Few letters, so that signatures are crowded; one letter repeated; letters beyond ASCII; a long word and its neighbours."""
    r = random.Random(crowd)
    n = {"".join(r.choices("abé", k=r.randint(5, 8))): r.choice([3, 4, 7, 9, 20, 50]) for _ in range(250)}
    long = "".join(r.choices("abcdefgh", k=3000))
    n |= {"a" * k: 2**k for k in range(5, 12)} | {long: 5, long[:1500] + long[1501:]: 3, long[:-1] + "z": 11, "b" + long: 30}
    words = spark.createDataFrame([*n.items()], "word string, n long")
    assert {tuple(x) for x in spelling.variants(words, parts=parts, crowd=crowd).collect()} == brute_variants(n)


def test_growing_tables_are_not_broadcast(spark, monkeypatch):
    """Under Spark's own threshold: it takes what an explode makes for as small as what went in, and the driver has to hold it."""
    plans, stored = [], spelling.stored
    keep = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(spelling, "stored", lambda df: stored(keep(df)))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10MB", "10485760b", "10485760")
    words = spark.createDataFrame([("aaaaa", 3), ("aaaab", 9), ("aaabb", 30), ("zzzzz", 4)], "word string, n long")
    found = keep(spelling.variants(words)).collect()
    assert {r["word"]: r["root"] for r in found} == {"aaaaa": "aaabb", "aaaab": "aaabb", "aaabb": "aaabb", "zzzzz": "zzzzz"}
    assert len(plans) >= 5 and any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)


def test_words_within_an_edit_share_a_key():
    r = random.Random(3)
    words = list({"".join(r.choices("ab", k=r.randint(1, 6))) for _ in range(120)})
    keys = {w: set(spelling.edit_keys(w)) for w in words}
    assert all(keys[a] & keys[b] for a in words for b in words if a != b and one_edit(a, b))
    assert not any(keys[a] & keys[b] for a in words for b in words if abs(len(a) - len(b)) > 1)


@pytest.mark.parametrize("table", [1, 200_000])
def test_word_counts(spark, awkward, table):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert {r["word"]: r["n"] for r in spelling.word_counts(awkward, table=table).collect()} == brute_counts(rows)
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choices("abcÀÉÿ", k=r.randint(3, 6))) for _ in range(400))) for i in range(30)]
    got = spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), table=table)
    assert {r["word"]: r["n"] for r in got.collect()} == brute_counts(rows)


def test_no_words(empty):
    assert spelling.variants(spelling.word_counts(empty)).count() == 0


# Source divergence


def brute_audit(rows, least, top):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        n[lang, source].update(found)
        n[lang].update(found)
        df[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in df[lang].items() if c >= least]
        p = {g: {t: 1 + 10**9 * (n[g][t] + 5) // (sum(n[g][k] for k in kept) + 5 * len(kept)) for t in kept} for g in [lang, *(g for g in groups if g[0] == lang)]}
        for g in (g for g in groups if g[0] == lang):
            pairs = [(sum(abs(p[g][t] - p[h][t]) for t in kept), h[1]) for h in groups if h[0] == lang and h != g]
            terms = [(p[g][t] - p[lang][t], t) for t in kept if n[g][t] and p[g][t] > p[lang][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, g[1], part, item, v, rank))
    return out


@pytest.mark.parametrize(("block", "tile"), [(4, 2), (3, 1), (1024, 64)])
def test_audit(spark, block, tile):
    r = random.Random(block)
    vocabulary = [f"{x}{y}" for x in "abcdefgé" for y in "xyzü"] + ["Ab", "AB", "ab"]
    rows = []
    for i in range(400):
        source = r.choice(["s0"] * 5 + [f"s{k}" for k in range(1, 8)])
        rows.append((i, None if i == 7 else " ".join(r.choices(vocabulary, weights=[2 ** -(k % 9) for k in range(len(vocabulary))], k=r.randint(0, 25))), r.choice(["en", "de"]), source))
    rows += [(1000, "only here", "fr", "s1"), (1001, None, "fr", "s2"), (1002, "", None, None), (1003, "!!", "en", "quiet")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = divergence.audit(docs, 12, 5, block, tile)
    assert sorted(tuple(x) for x in got.collect()) == sorted(brute_audit([x[1:] for x in rows], 12, 5))


def test_awkward_audit(awkward, empty):
    rows = [(r["text"], r["lang"], r["source"]) for r in awkward.collect()]
    assert sorted(tuple(x) for x in divergence.audit(awkward, 2).collect()) == sorted(brute_audit(rows, 2, divergence.TOP))
    assert divergence.audit(empty).count() == 0


def test_counts_in_small_tables(awkward):
    few = divergence.term_counts(awkward, table=1)
    assert sorted(tuple(r) for r in few.collect()) == sorted(tuple(r) for r in divergence.term_counts(awkward).collect())


# Chat formatting


def brute_fold(events):
    """{(conv, turn): [role, text]}: the log, event by event."""
    done = {}
    for conv, _, kind, turn, role, text in sorted(events, key=lambda e: (str(e[0]), e[1])):
        at = (conv, turn)
        if kind == "open":
            done[at] = [role or "", text or ""]
        elif at in done and kind == "delta":
            done[at][1] += text or ""
        elif at in done and kind == "edit":
            done[at][1] = text or ""
        elif kind == "regenerate":
            if at in done:
                done[at][1] = ""
            for other in [k for k in done if k[0] == conv and k[1] > turn]:
                del done[other]
    return done


LOG = "conv_id long, seq long, kind string, turn long, role string, text string, piece string"


@pytest.mark.parametrize("buckets", [1, 2, 1024])
def test_fold(spark, buckets):
    r = random.Random(buckets)
    events = []
    for conv in [None, *range(40)]:
        for seq in range(r.randint(1, 40)):
            kind = r.choices(["open", "delta", "edit", "regenerate", "other"], [4, 8, 1, 1, 0.5])[0]
            events.append((conv, seq, kind, r.randint(0, 6), r.choice(["user", "assistant", None]), r.choice([None, "", "a", "bé", "🙂</s>", "␛0"])))
    log = spark.createDataFrame([(*e, "clash") for e in [*events, *events[:50]]], LOG)  # some events twice
    got = {(x["conv_id"], x["turn"]): [x["role"], x["text"]] for x in chat.fold_log(log, buckets).collect()}
    assert got == brute_fold(events)


def test_template_is_reversible(spark):
    r = random.Random(1)
    bits = [*chat.CONTROLS, "␛", "0", "a", "z", "\n", "<", "|", ">", "]", "é", "🙂", "\\", "<|", "turn|>"]
    rows = [(1, i, "".join(r.choices(["user", "assistant", *bits], k=r.randint(0, 3))), "".join(r.choices(bits, k=r.randint(0, 30)))) for i in range(300)]
    rows += [(1, 300, "assistant", "x" * 70_000), (1, 301, None, None)]
    pieces = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [chat.parse(p["piece"]) for p in pieces] == [(x[2] or "", x[3] or "") for x in rows]
    for p, x in zip(pieces, rows, strict=True):
        assert not any(c in p["piece"][len(chat.TURN) : -len(chat.END) - 1] for c in chat.CONTROLS)
        assert (p["loss_start"] is not None) == (x[2] == "assistant")
        assert x[2] != "assistant" or chat.unescape(p["piece"][p["loss_start"] : p["loss_end"]]) == x[3]
    for wrong in ("", "<|turn|>user\nhi", "<|turn|>user\na<|turn|>b<|end|>\n"):
        with pytest.raises(ValueError, match="not a formatted message"):
            chat.parse(wrong)


def test_conversations(spark):
    """Ties, repeated rows, null ids, turns, roles and texts; each conversation as one text as well."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", chat.HOSTILE), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, "assistant", "n"), (2, None, None, None), (2, 3, "assistant", "")]
    turns = spark.createDataFrame([(*x, "p") for x in rows], "conv_id long, turn long, role string, text string, piece string")
    pieces = chat.formatted(chat.fold_log(chat.as_log(turns)))
    got = {x["conv_id"]: tuple(x)[1:] for x in chat.digests(pieces).collect()}
    whole = {x["conv_id"]: x for x in chat.joined(pieces).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == set(whole) == {1, 2, None}
    for conv in got:
        own = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv] == (len(own), digest("".join(f"{r}\n{x}\n" for _, r, x in own)), len(learned), digest(learned), len(whole[conv]["text"]))
        assert "".join(chat.unescape(whole[conv]["text"][s["start"] : s["end"]]) for s in whole[conv]["loss"]) == learned
    assert chat.digests(chat.formatted(chat.fold_log(chat.as_log(turns.limit(0))))).count() == 0
