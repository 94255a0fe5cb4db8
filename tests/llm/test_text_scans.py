"""Decontamination, ranked search and the source audit against brute force, with small limits so that every path is taken."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from readgauge.llm import decontaminate, divergence, lexical, words as wd

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, spans string, term string, n bigint"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def found(pattern, text):
    return [low(w) for w in re.findall(pattern, text or "")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdé中9") for _ in range(rng.randint(1, 4))) for _ in range(120)] + ["É", "Zed", "x1y"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(25)]
    items += [(3, some(12)), (100, None), (101, ""), (102, "…!?"), (None, some(14)), (103, items[5][1]), (9, items[9][1])]
    texts = [some(rng.choice([0, 1, 5, 40, 200])) for _ in range(90)]
    for i in range(60):
        item = items[i % 25][1] or ""
        sep = rng.choice([" ", ", ", "\n-", "--"])
        texts.append(some(rng.randint(0, 20)) + " " + sep.join(item.upper().split()) + "." + some(rng.randint(0, 9)))
    texts += [None, "", " \n", "É", some(30_000), texts[100], texts[100], texts[100]]
    docs = [(i * 7 % 1000, t, rng.choice(["en", "de", "de", None]), rng.choice(["a", "b", "ü", "", None]), len(t or ""), "c", "s", "t", 1)
            for i, t in enumerate(texts)]
    docs += [(None, texts[101], "xx", "only", 1, "c", "s", "t", 1), (5, texts[120], "en", "a", 1, None, None, None, None)]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark, rows):
    docs, items = rows
    marked = [(i, t, 0) for i, t in items]
    return (spark.createDataFrame(docs, DOCS).repartition(3).cache(),
            spark.createDataFrame(marked, "item_id bigint, text string, n int").cache())


@pytest.fixture(params=[False, True], ids=["plain", "small"])
def small(request, monkeypatch):
    """Small slabs and hashing stretches; tasks run in other processes, so these hold only where functions run here."""
    if request.param:
        monkeypatch.setattr(wd, "SLAB_BYTES", 50)
        monkeypatch.setattr(wd, "HASH_BYTES", 16)
    return request.param


@pytest.mark.parametrize("table,pattern", [(wd.LETTERS, LETTERS), (wd.LETTERS_DIGITS, WORD)])
def test_words_and_distinct_words(rows, small, table, pattern):
    texts = [r[1] for r in rows[0]] + ["a" * 300, "[é`{@Z", "\x7f\x80"]
    raw, offsets = wd.buffers(pa.array(texts))
    words, number, first = wd.distinct(raw, offsets, table)
    want = [(i, w.encode()) for i, t in enumerate(texts) for w in found(pattern, t)]
    assert [(int(d), words.word(i)) for i, d in enumerate(words.doc)] == want
    assert all(words.word(first[number[i]]) == words.word(i) for i in range(len(number)))
    assert len(first) == len({w for _, w in want})
    known = sorted({w for _, w in want})[::3]
    vocabulary = wd.Vocabulary(known, table)
    got = vocabulary.find(wd.tokenise(raw, offsets, table, vocabulary.seed))
    assert [known[x] if x >= 0 else None for x in got] == [w if w in set(known) else None for _, w in want]


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    real = wd._hashes
    monkeypatch.setattr(wd, "_hashes", lambda raw, s, e, seed: real(raw, s, e, seed) % np.uint64(2) if seed < 1 else real(raw, s, e, seed))
    raw, offsets = wd.buffers(pa.array(["ab cd ab ef", "cd xy"]))
    words, number, first = wd.distinct(raw, offsets, wd.LETTERS)
    assert len(first) == 4
    vocabulary = wd.Vocabulary([b"ab", b"ef", b"zz"], wd.LETTERS)
    assert vocabulary.find(words).tolist() in ([0, -1, 0, 1, -1, -1],)


# --- decontamination


def windows(items):
    out = collections.defaultdict(set)
    for i, t in items:
        w = found(WORD, t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            out[tuple(w[k:k + n])].add("" if i is None else str(i))
    return out


def contamination(docs, items):
    wins, out = windows(items), []
    for row in docs:
        w = found(WORD, row[1])
        hit, ids = set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                own = wins.get(tuple(w[k:k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    ids |= own
        out.append((row[0], len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [400_000, 60])
def test_contamination(tables, rows, block):
    got = decontaminate.scan(*tables, block=block).collect()
    want = contamination(*rows)
    assert sorted(((r["doc"]["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got), key=str) == want
    assert any(r["n_hit"] and r["n_hit"] < r["n_words"] for r in got)
    for r in got:
        raw = (r["doc"]["text"] or "").encode()
        assert sum(len(found(WORD, raw[s["start"]:s["end"]].decode())) for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] <= b["start"] and a["last"] + 1 < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_windows_with_one_hash_are_both_found(monkeypatch):
    monkeypatch.setattr(decontaminate, "window_hashes", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    grams = decontaminate.Grams([("1", 2, "a b"), ("2", 2, "b c"), ("3", 1, "z")])
    raw, offsets = wd.buffers(pa.array(["A b c", "a", "b", "c z", None]))
    n, spans, items = decontaminate._scan_rows(raw, offsets, [None] * 5, [None] * 5, grams)
    assert items == [["1", "2"], [], [], ["3"], []] and n.tolist() == [3, 1, 1, 2, 0]
    assert spans[0] == [{"first": 0, "last": 2, "start": 0, "end": 5}] and spans[3] == [{"first": 1, "last": 1, "start": 2, "end": 3}]


def test_clean_cuts_spans_and_drops_documents(tables, rows):
    docs, benchmark = tables
    items = [(i, t) for i, t in rows[1] if len(found(WORD, t)) >= 9]
    long_items = benchmark.where("size(split(trim(text), ' ')) >= 9")
    cleaned = decontaminate.clean(docs, long_items)
    assert cleaned.columns == docs.columns
    got = collections.Counter(r["doc_id"] for r in cleaned.collect())
    judged = contamination(rows[0], items)
    assert got == collections.Counter(d for d, n, hit, _ in judged if not hit or hit < n / 2)
    untouched = {d for d, n, hit, _ in judged if not hit} - {d for d, n, hit, _ in judged if hit}
    texts = {r[0]: r[1] for r in rows[0]}
    for r in cleaned.collect():
        if r["doc_id"] in untouched:
            assert r["text"] == texts[r["doc_id"]]
        elif r["doc_id"] is not None and r["text"] != texts.get(r["doc_id"]):
            assert r["n_chars"] == len(r["text"])


def test_decontamination_of_empty_tables(tables):
    docs, items = tables
    assert decontaminate.scan(docs.limit(0), items).count() == 0
    nothing = decontaminate.scan(docs, items.limit(0))
    assert nothing.where("n_hit > 0 OR size(items) > 0").count() == 0 and nothing.count() == docs.count()
    assert nothing.select(decontaminate.items_digest(nothing["items"]).alias("x")).first()["x"] == hashlib.sha256(b"").hexdigest()


# --- ranked search


def ranking(docs, items, k=10):
    tf = [(r[0], collections.Counter(found(WORD, r[1]))) for r in docs]
    tf = [(d, c) for d, c in tf if c]
    n_docs, length = len(tf), sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(t for _, c in tf for t in c)
    terms = collections.defaultdict(set)
    for i, t in items:
        terms[i] |= set(found(WORD, t))
    out = []
    for i, own in terms.items():
        scores = []
        for d, c in tf:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in own if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,k", [(1_000_000, 10), (40, 10), (1_000_000, 1), (1_000_000, 500)])
def test_ranked_search(tables, rows, block, k):
    got = lexical.search(*tables, k=k, block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == ranking(*rows, k=k)


def test_search_in_empty_tables(tables):
    docs, items = tables
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def block_of(rng, n_docs, n_terms, items):
    n, terms, tfs, owner = [], [], [], []
    for d in range(n_docs):
        own = sorted(rng.sample(range(n_terms), rng.randint(0, min(9, n_terms))))
        counts = [rng.randint(1, 5) for _ in own]
        n.append(sum(counts) + rng.randint(1, 30))
        terms += own
        tfs += counts
        owner += [d] * len(own)
    arrays = [np.array(x, np.int64) for x in (n, terms, tfs, owner)]
    return lexical.Block(*arrays, items), arrays


@pytest.mark.parametrize("n_terms", [5, 70, 200])
def test_masks_stop_early_and_miss_nothing(n_terms):
    rng = random.Random(n_terms)
    weights = np.array([rng.choice([1, 50, 4000]) for _ in range(n_terms)], np.int64)
    items = lexical.Items(pa.array([0]), [], weights, 500, 9000)
    block, (n, terms, tfs, owner) = block_of(rng, 2000, n_terms, items)
    saved = 0
    for k in (1, 10):
        own = np.array(sorted(rng.sample(range(n_terms), min(n_terms, 68 if n_terms > 68 else 5))))
        docs, scores, evaluated = lexical.evaluate(block, own, weights[own], k, 0)
        parts = lexical.part(tfs, lexical.norm(n, 500, 9000)[owner]) * weights[terms] * np.isin(terms, own)
        want = np.bincount(owner, parts, minlength=2000).astype(np.int64)
        best = np.sort(want)[::-1][k - 1]
        assert set(docs.tolist()) == set(np.flatnonzero(want >= max(best, 1)).tolist())
        assert (scores == want[docs]).all()
        saved += 2000 - evaluated
    assert saved > 0


# --- source audit


def audit(docs, least=30, top=50):
    texts = [((r[2] or ""), (r[3] or ""), collections.Counter(found(LETTERS, r[1]))) for r in docs]
    out = []
    for lang in {t[0] for t in texts}:
        own = [(s, c) for g, s, c in texts if g == lang]
        df = collections.Counter(t for _, c in own for t in c)
        kept = sorted(t for t in df if df[t] >= least)
        v = len(kept)
        total = collections.Counter()
        counts = collections.defaultdict(collections.Counter)
        for s, c in own:
            counts[s].update({t: c[t] for t in kept if t in c})
            total.update({t: c[t] for t in kept if t in c})
        p = lambda c, t: 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * v)
        for s in counts:
            pairs = [(-sum(abs(p(counts[s], t) - p(counts[o], t)) for t in kept), o.encode(), o) for o in counts if o != s]
            out += [(lang, s, "pair", x[2], -x[0], i + 1) for i, x in enumerate(sorted(pairs))]
            terms = [(p(total, t) - p(counts[s], t), t.encode(), t) for t in kept if counts[s][t] and p(counts[s], t) > p(total, t)]
            out += [(lang, s, "term", x[2], -x[0], i + 1) for i, x in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,top,memory,shards,fan", [(30, 50, 400_000, None, 256), (3, 5, 40, 3, 2), (1, 50, 1, 1, 2), (10_000, 50, 99, 7, 9)])
def test_audit(tables, rows, least, top, memory, shards, fan):
    got = divergence.audit(tables[0], least, top, memory, shards, fan).collect()
    assert sorted(tuple(r) for r in got) == audit(rows[0], least, top)


def test_audit_of_an_empty_table(tables):
    assert divergence.audit(tables[0].limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 20, 10_000])
def test_chunks_merge_in_order(block):
    rng = random.Random(2)
    want, chunks = collections.defaultdict(lambda: [0, 0]), []
    for run in range(7):
        rows = sorted({(bytes([rng.randrange(97, 110)]) * rng.randint(1, 3), rng.choice("xyz")) for _ in range(30)})
        for low in range(0, len(rows), 4):
            part = [(t, s, rng.randint(1, 5), 1) for t, s in rows[low:low + 4]]
            for t, s, c, n in part:
                want[t, s][0] += c
                want[t, s][1] += n
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*part), divergence.POSTING)]
            chunks.append((part[0][0], pa.Table.from_arrays(columns, schema=pa.schema(divergence.POSTING))))
    chunks.sort(key=lambda c: c[0])
    tables = list(divergence.merge_chunks(iter(chunks), block))
    got = [tuple(r.values()) for t in tables for r in t.to_pylist()]
    assert got == [(t, s, c, n) for (t, s), (c, n) in sorted(want.items())]
    terms = [set(t["term"].to_pylist()) for t in tables]
    assert sum(map(len, terms)) == len(set().union(*terms)) and (len(tables) > 1) == (block < 10_000)


def test_pair_corrections_in_tiles(monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    rng = np.random.default_rng(1)
    a = np.tile(np.arange(8), (5, 1))
    p, p0 = rng.integers(1, 100, (5, 8)), np.tile(rng.integers(1, 9, 8), (5, 1))
    got = collections.Counter()
    for x, y, value in divergence._corrections(a, p, p0):
        for i, j, v in zip(x.tolist(), y.tolist(), value.tolist()):
            got[i, j] += v
    want = {(i, j): int(sum(abs(p[t, i] - p[t, j]) - abs(p[t, i] - p0[t, j]) - abs(p[t, j] - p0[t, i]) + abs(p0[t, i] - p0[t, j])
                            for t in range(5))) for i in range(8) for j in range(i + 1, 8)}
    assert dict(got) == want
