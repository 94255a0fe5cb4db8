"""The operators against brute force on small fixtures with nulls, empty and repeated rows, ties and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readgauge.llm import (
    fingerprints, licenses, mixing, neighbours, packing, quality, shingles, suffixes, tokencounts, urlfilter,
)
from readgauge.llm.induced import SuffixSorter, pieces_text

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string"


def word(rng):
    return "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [" ".join(word(rng) for _ in range(rng.choice([1, 3, 30, 60, 400]))) for _ in range(40)]
    base = [word(rng) for _ in range(120)]
    for i in range(25):  # near copies
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = word(rng)
        texts.append(" ".join(copy))
    passage = " ".join(word(rng) for _ in range(60))
    texts += [texts[40] + "\n" + passage, passage + " " + texts[3], texts[5], texts[5], None, "", " \t\n", "x", "a" * 300, "ab" * 200]
    texts += ["Released under the MIT License.\nend", "the GNU General Public License, version 3. licensed under", "MIT license mit LICENSE"]
    return [(i * 3, t, "en", rng.choice(["a", "b", None]), len(t or ""), 0.5, "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def components(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_components(docs, rows, n, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.near_duplicates(docs, n, percent).collect()}
    assert got == components({r[0]: r[1] for r in rows}, n, percent)


@pytest.mark.parametrize("sets, shingles_held", [(1000, 400_000), (7, 400_000), (1000, 900)])
def test_links_within_a_component_are_counted(docs, rows, monkeypatch, sets, shingles_held):
    monkeypatch.setattr(shingles, "BLOCK_SETS", sets)
    monkeypatch.setattr(shingles, "BLOCK_SHINGLES", shingles_held)
    monkeypatch.setattr(shingles, "COLUMNS_AT_ONCE", 50)
    of = {}
    for i, text, *_ in rows:
        words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        of[i] = frozenset(tuple(words[j:j + 4]) for j in range(max(1, len(words) - 3))) if words else frozenset()
    different = set(of.values()) - {frozenset()}
    want = {i: sum(a != b and 100 * len(a & b) >= 60 * len(a | b) for b in different) if a else 0 for i, a in of.items()}
    got = {r["doc_id"]: r["n_links"] for r in shingles.near_duplicates(docs, 4, 60).collect()}
    assert got == want and max(want.values()) > 10


def test_prefixes_refuse_no_link_and_most_others():
    rng = np.random.default_rng(8)
    rank = rng.integers(0, 3, 1 << shingles.SKETCH_BITS).astype(np.uint8)
    links, refused = 0, 0
    for _ in range(400):
        a = rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)
        same = int(len(a) * rng.choice([0.3, 0.5, 0.9, 0.97, 1.0]))
        more = len(a) - same + (rng.random() < 0.3) * rng.integers(0, 5)
        b = np.concatenate([a[:same], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        near = [(shingles.prefix(x, rank, 1, 85) >> np.uint64(48)).astype("<u2").tolist() for x in (a, b)]
        kept = shingles.may_link(*near, len(a), len(b), 85)
        if 100 * shared >= 85 * (len(a) + len(b) - shared):
            links += 1
            assert kept
        elif 100 * shared < 60 * (len(a) + len(b) - shared):
            refused += not kept
    assert links > 50 and refused > 100  # one common shingle in the prefixes, as before, refuses few of these


def test_lists_are_not_moved_to_learn_their_roots(docs, monkeypatch):
    plans, write = {}, shingles.written

    def noting(df, name):
        out = write(df, name)
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(shingles, "written", noting)
    shingles.near_duplicates(docs, 4, 60).count()
    assert "Bucketed: true" in plans["open"] and "key#" in plans["open"]
    moved = [line for line in plans["open"].split("Initial Plan")[0].splitlines() if " Exchange hashpartitioning(key" in line]
    assert not moved


def test_one_per_group_keeps_columns_and_repeats_once(docs, rows):
    kept = shingles.one_per_group(docs.unionByName(docs.where("doc_id < 30")))
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    want = {i: c for i, (n, c) in components({r[0]: r[1] for r in rows}, 5, 80).items()}
    assert {i for i in ids if want[i] == i} == {i for i in want if want[i] == i} and max(ids.values()) == 1


def cut(texts):
    low = {}
    for i in sorted(texts):
        t = (texts[i] or "").encode()
        for j in range(len(t) - 49):
            low.setdefault(t[j:j + 50], i)
    out = {}
    for i, t in texts.items():
        t = (t or "").encode()
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if low[t[j:j + 50]] < i:
                gone[j:j + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_are_cut(docs, rows):
    got = {r[0]: tuple(r)[1:] for r in suffixes.remove_repeats(docs).collect()}
    want = cut({r[0]: r[1] for r in rows})
    assert got == want and sum(w[1] > 0 for w in want.values()) > 20
    texts = suffixes.without_repeats(docs)
    assert texts.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in texts.collect())


@pytest.mark.parametrize("letters,depth,limit", [(1, 8, 0), (2, 50, 200), (3, 200, 1 << 20), (40, 5, 0)])
def test_suffix_sorter(letters, depth, limit):
    rng = random.Random(letters)
    pieces = list({bytes(rng.randrange(97, 97 + letters) for _ in range(rng.randint(1, 60))) for _ in range(30)})
    text, _ = pieces_text(pieces)
    chunks = list(SuffixSorter(text, depth, queue_bytes=limit).descending())
    at, common = (np.concatenate([c[i] for c in chunks]).tolist() for i in (0, 1))
    assert sorted(at) == list(range(len(text) - 1))
    heads = [tuple(text[p:p + depth]) for p in at]
    assert heads == sorted(heads, reverse=True)
    for a, b, n in zip(heads, heads[1:], common[1:]):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs, 5).collect()}
    texts = [(r[0], r[1] or "") for r in rows]
    for (i, t), (_, following) in zip(texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    by_text = {(t, got[i]["fingerprint"]) for i, t in texts}
    assert len(by_text) == len({t for _, t in texts})


def test_fingerprint_sums_are_homomorphic(spark):
    df = spark.createDataFrame([("one\ntwo\nthree", "three\none", "two", "two\nthree\none")], "a string, b string, c string, d string")
    for c in "abcd":
        df = fingerprints.with_sums(df, c, f"f{c}")
    row = df.select(F.col("fa") == fingerprints.inserted(F.col("fb"), F.col("fc")), F.col("fa") == F.col("fd"),
                    F.col("fb") == fingerprints.deleted(F.col("fa"), F.col("fc"))).first()
    assert all(row)


def test_single_and_null_ids(spark):
    one = spark.createDataFrame([(7, "abcd")], "doc_id bigint, text string")
    assert fingerprints.edited_fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    two = spark.createDataFrame([(None, "wxyz"), (1, "abcd")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.edited_fingerprints(two).collect()}
    assert got == {1: hashlib.sha256(b"abwx").hexdigest(), None: hashlib.sha256(b"wxab").hexdigest()}


def test_mix(docs, rows):
    got = mixing.mix(docs).select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken").collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    target |= {s: weight[s] * level for s in free}
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_every_pass_has_its_position(spark):
    texts = [("rare", i, " ".join(["w"] * (1 + i % 5))) for i in range(20)] + [("wide", 100 + i, "w " * 9) for i in range(200)]
    docs = spark.createDataFrame(texts, "source string, doc_id bigint, text string")
    options = {"weights": (5, 1), "schedules": ((0.5, 1.5), (1.0, 1.0)), "repeats": 3, "demand": 1.2}
    got = [r for r in mixing.mix(docs, **options).select("doc.source", "doc.doc_id", "size", "target", "position", "positions").collect()
           if r["source"] == "rare"]
    stream = sorted(got, key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest())
    target = stream[0]["target"]
    assert target == 3 * sum(r["size"] for r in stream)
    at, want = 0, {}
    for r in stream * 3:
        share = (at + r["size"] / 2) / target
        want.setdefault(r["doc_id"], []).append((0.25 + 2 * share) ** 0.5 - 0.5)  # t with 0.5 t + 0.5 t² = share
        at += r["size"]
    for r in got:
        assert r["positions"] == pytest.approx(want[r["doc_id"]]) and r["position"] == r["positions"][0]
    assert max(r["positions"][-1] for r in got) > 0.95
    order = [r["doc_id"] for r in mixing.mixed_documents(docs, **options).collect() if r["source"] == "rare"]
    assert order == [r["doc_id"] for r in stream * 3]


def test_packing_is_a_round_trip(docs, rows):
    from tokenizers import Tokenizer
    import public_tokenizers
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    pieces = collections.defaultdict(list)
    packed = packing.pack(docs).collect()
    for r in packed:
        assert r["length"] == len(r["ids"]) == 1 << r["bucket"] <= 1024 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
    assert len({r["sequence_id"] for r in packed}) == len(packed)
    for i, t, *_ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert [x for _, part in sorted(pieces[i]) for x in part] == ids


def test_licenses(docs, rows):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    labels = {r[1]: got[r[0]] for r in rows if r[1]}
    mit = labels["Released under the MIT License.\nend"]
    assert (mit["n_words"], mit["n_base"], mit["first_word"], mit["base_labels"], mit["labels"]) == (6, 1, 3, "mit", "mit")
    assert mit["score"] == 1 and mit["blocks"] == [0]
    assert labels["the GNU General Public License, version 3. licensed under"]["labels"] == "gpl"
    twice = labels["MIT license mit LICENSE"]
    assert (twice["n_base"], twice["first_word"], twice["last_word"]) == (2, 0, 2)
    assert got[rows[69][0]]["n_words"] == 0 and got[rows[0][0]]["labels"] == ""


def test_template_join_equals_brute_force():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = [(f"t{i}", " ".join(rng.sample(vocabulary, rng.randint(3, 9)))) for i in range(8)]
    counts = {w.encode(): rng.randint(0, 9) for w in vocabulary}
    index = licenses.template_index(templates, counts, 0.7)
    for _ in range(300):
        block = {w.encode() for w in rng.sample(vocabulary, rng.randint(1, 20))}
        want = {}
        for label, text in templates:
            words = set(text.encode().split())
            if len(words & block) >= 0.7 * len(words) - 1e-9:
                want[label] = len(words & block) / len(words)
        assert licenses.block_matches(block, index) == want


def test_wrapped_notices_and_variants(spark):
    texts = {
        "mit": "Copyright 2020\n\nPermission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and",
        "bsd": "# Redistribution and use in source and binary forms, with or\n# without modification, are permitted provided",
        "mpl": "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. If",
        "apache": "Licensed under\nthe Apache\nLicense, Version 2.0 (the", "cc-by": "Licensed under\nCC BY 4.0.",
        "cc-by-nc": "x licensed under CC BY-NC 4.0.", "cc-by-sa": "licensed under CC\nBY-SA 4.0", "": "released under the X license",
        "cc-by,cc-by-nc": "Text licensed under CC BY 4.0, pictures licensed under CC BY-NC 4.0.",
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["labels"] for i in range(len(texts))] == list(texts)
    assert got[0]["blocks"] == [2] and got[0]["score"] == 1 and got[3]["blocks"] == [0] and got[8]["blocks"] == [0]


def test_stretches_equal_brute_force():
    rng = random.Random(6)
    found = 0
    for _ in range(400):
        vocabulary = [f"w{i}".encode() for i in range(9)]
        text = b" ".join(rng.choices(vocabulary[:6], k=rng.randint(2, 6))).decode()
        own, foreign = rng.choice([("", ""), ("w0", ""), ("", "w7 w8"), ("w1", "w8")])
        index = licenses.template_index([("x", text, own, foreign)], {}, 0.8)
        template = next(iter(index.values()))[0][0]
        words = rng.choices(vocabulary, k=rng.randint(0, 30))
        every, shares = set(text.encode().split()), []
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + len(text.split())) + 1):
                block = set(words[a:b])
                if set(own.encode().split()) <= block and not set(foreign.encode().split()) & block:
                    shares += [len(block & every)] * (len(block & every) >= 0.8 * len(every) - 1e-9)
        kept = licenses.stretches(words, template)
        assert max((n for n, _ in kept), default=0) == max(shares, default=0)
        found += bool(kept)
    assert found > 50


def test_token_counts_follow_edits(docs, rows):
    encode = packing.encoder()
    rng = random.Random(9)
    edits = []
    for i, t, *_ in rows:
        for seq in range(rng.randint(0, 3)):
            edits.append((i, seq, rng.randint(0, len(t or "") + 3), rng.randint(0, 9), rng.choice(["", " ", "x", "'s a b", " é  \n"])))
    frame = docs.sparkSession.createDataFrame(edits, "doc_id bigint, seq int, start bigint, length bigint, insert string")
    state = tokencounts.with_trees(tokencounts.attach_edits(docs, frame))
    got = {r["doc_id"]: r for r in tokencounts.apply_edits(state).collect()}
    for i, t, *_ in rows:
        text = t or ""
        assert got[i]["tokens_before"] == len(encode.encode_ordinary(text))
        for _, _, start, length, insert in sorted(e for e in edits if e[0] == i):
            text = text[:start] + insert + text[start + length:]
        assert got[i]["text"] == text and got[i]["tokens_after"] == len(encode.encode_ordinary(text))
        assert got[i]["tokens"][0] == got[i]["tokens_after"] and got[i]["chars"][0] == len(text)


def test_url_rules_and_graph(spark):
    pages = spark.createDataFrame([
        (1, "http://a.example.org/es/1", None), (2, "https://Example.ORG/en/17#x", ""), (3, "https://x.example.org/en/2?q", "<a href='/b'>"),
        (4, "http://spam.com/de/1", '<a href="http://friend.net/x">'), (5, "http://friend.net/q", '<a href="https://spam.com/">'),
        (6, None, None), (7, "no scheme", ""), (8, "http://alone.net", ""), (8, "http://alone.net", ""), (9, "http://good.net/", ""),
        (10, "http://site.org/", '<a href="//good.net/">'),
    ], "page_id bigint, url string, html string").withColumn("verdict", F.lit("x"))
    rows = urlfilter.judge(pages).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == 11
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/17", "example.org/en/1", "block")
    assert got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5][2:] == (None, "block")  # links to a blocked host
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("alone.net", "", None, "allow") and got[9][3] == "allow"
    assert {r["host"]: r["trust"] > r["distrust"] for r in rows}["good.net"]


@pytest.mark.parametrize("bits,wide", [(31, 62), (3, 5)])
def test_fingerprint_lanes_wrap_and_come_back(spark, monkeypatch, bits, wide):
    """Lanes that overflow many times lose only whole turns, and deleting brings the smaller multiset back."""
    monkeypatch.setattr(fingerprints, "LANE_BITS", bits)
    monkeypatch.setattr(fingerprints, "WIDE_BITS", wide)
    rng = random.Random(1)
    units = [f"line {rng.randrange(30)}" for _ in range(300)]
    texts = ["\n".join(u) for u in (units, units[:170], units[170:], units[::-1], units[1:])]
    df = spark.createDataFrame([tuple(texts)], "a string, b string, c string, d string, e string")
    for c in "abcde":
        df = fingerprints.with_sums(df, c, f"f{c}")
    row = df.select("fa", "fb", "fc", "fd", "fe", fingerprints.inserted(F.col("fb"), F.col("fc")).alias("more"),
                    fingerprints.deleted(F.col("fa"), F.col("fb")).alias("less"),
                    fingerprints.deleted(F.col("fa"), F.col("fa")).alias("none")).first()
    assert row["more"] == row["fa"] == row["fd"] != row["fe"] and row["less"] == row["fc"] and not any(row["none"])
    lanes = row["fa"][1:1 + 2 * fingerprints.LANES]
    parts = [x >> 32 * i & (1 << 32) - 1 for x in lanes for i in (0, 1)]
    assert len(parts) == 128 and max(parts) < 1 << bits and max(row["fa"][-4:]) < 1 << wide
    hashes = [r["h"] for r in spark.createDataFrame([(u,) for u in units], "u string").select(F.xxhash64("u", F.lit(17)).alias("h")).collect()]
    for k in range(fingerprints.LANES):
        for i in (0, 1):
            assert lanes[k] >> 32 * i & (1 << 32) - 1 == sum((h >> k + 32 * i) & 1 for h in hashes) % (1 << bits)


def test_likeness_of_very_many_equal_paragraphs(spark):
    df = spark.sql("SELECT repeat('x\n', 1100000) AS a, repeat('x\n', 1048577) AS b, repeat('y\n', 1100000) AS c")
    for c in "abc":
        df = fingerprints.with_sums(df, c, f"f{c}")
    row = df.select(fingerprints.likeness(F.col("fa"), F.col("fb")), fingerprints.likeness(F.col("fa"), F.col("fc"))).first()
    assert row[0] == pytest.approx(1) and row[1] < 0.5


def ranks_by_hand(edges, start, damping=0.85):
    hosts = sorted({h for e in edges for h in e[:2]} | set(start))
    at = {h: i for i, h in enumerate(hosts)}
    move = np.zeros((len(hosts), len(hosts)))
    for a, z, w in edges:
        move[at[a], at[z]] += w
    out = move.sum(axis=1, keepdims=True)
    move = np.divide(move, out, out=np.zeros_like(move), where=out > 0)
    base = np.zeros(len(hosts))
    for h, w in start.items():
        base[at[h]] = w / sum(start.values())
    rank = np.linalg.solve(np.eye(len(hosts)) - damping * move.T, (1 - damping) * base)
    return dict(zip(hosts, rank))


def test_rank_steps_are_one_join_each(spark, monkeypatch):
    plans, write = [], urlfilter.written

    def noting(df, name):
        if name == "host-rank":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(urlfilter, "written", noting)
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("z", 0.0, 2.0)], "host string, allowed double, blocked double")
    got = {r["host"]: r for r in urlfilter.ranks(edges, seeds).collect()}
    assert sorted(got) == ["a", "b", "c", "z"] and got["z"]["distrust"] == pytest.approx(0.15)
    assert plans and all(p.count("Join ") <= urlfilter.CUT_EVERY for p in plans)


def test_rank_steps_send_nothing_through_the_driver(spark, monkeypatch):
    plans, write = [], urlfilter.written

    def noting(df, name):
        out = write(df, name)
        if name == "host-rank":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(urlfilter, "written", noting)
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("z", 0.0, 2.0)], "host string, allowed double, blocked double")
    urlfilter.ranks(edges, seeds)
    steps = plans[1:]  # the first holds the seeds
    assert steps and all("SortMergeJoin" in p and "BroadcastExchange" not in p for p in steps)


def test_ranks_are_those_of_the_whole_graph(spark):
    rng = random.Random(5)
    hosts = [f"h{i}" for i in range(30)]
    edges = list({(rng.choice(hosts), rng.choice(hosts)): float(rng.randint(1, 4)) for _ in range(90)}.items())
    edges = [(a, z, w) for (a, z), w in edges] + [(f"c{i}", f"c{i + 1}", 1.0) for i in range(25)] + [("c25", "h1", 2.0)]
    allowed, blocked = {"h0": 2.0, "h7": 1.0}, {"h1": 1.0, "h3": 3.0}
    seeds = [(h, allowed.get(h, 0.0), blocked.get(h, 0.0)) for h in {*allowed, *blocked}]
    got = {r["host"]: r for r in urlfilter.ranks(
        spark.createDataFrame(edges, "src string, dst string, weight double").repartition(3),
        spark.createDataFrame(seeds, "host string, allowed double, blocked double")).collect()}
    trust, distrust = ranks_by_hand(edges, allowed), ranks_by_hand([(z, a, w) for a, z, w in edges], blocked)
    for h in trust:
        row = got.get(h)
        assert (row["trust"] if row else 0) == pytest.approx(trust[h], abs=1e-5)
        assert (row["distrust"] if row else 0) == pytest.approx(distrust[h], abs=1e-5)
        assert (distrust[h] > 1e-12) == bool(row and row["distrust"] > 0)


@pytest.mark.parametrize("rows, growth, joins", [(10**6, 4, 1), (0, 8, 2), (0, 0, 4)])
def test_several_steps_are_one_join(spark, monkeypatch, rows, growth, joins):
    monkeypatch.setattr(urlfilter, "JUMP_ROWS", rows)
    monkeypatch.setattr(urlfilter, "JUMP_GROWTH", growth)
    plans, files, write = [], [], urlfilter.written

    def noting(df, name):
        out = write(df, name)
        if name == "host-rank":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(urlfilter, "written", noting)
    hosts = [f"h{i}" for i in range(12)]  # ten ways to and from each of h0 and h1; h11 has none
    edges = [(h, x, 1.0 + i) for i, h in enumerate(hosts[2:11]) for x in hosts[:2]]
    edges += [(x, h, 2.0) for h in hosts[2:10] for x in hosts[:2]] + [("h10", "c0", 1.0)] + [(f"c{i}", f"c{i + 1}", 1.0) for i in range(11)]
    seeds = [("h2", 2.0, 0.0), ("h3", 1.0, 1.0), ("c9", 0.0, 3.0), ("h11", 1.0, 0.0)]
    got = {r["host"]: r for r in urlfilter.ranks(
        spark.createDataFrame(edges, "src string, dst string, weight double").repartition(3),
        spark.createDataFrame(seeds, "host string, allowed double, blocked double"), parts=2).collect()}
    trust = ranks_by_hand(edges + [("h11", "none", 0.0)], {"h2": 2.0, "h3": 1.0, "h11": 1.0})
    distrust = ranks_by_hand([(z, a, w) for a, z, w in edges], {"h3": 1.0, "c9": 3.0})
    for h in got:
        assert got[h]["trust"] == pytest.approx(trust.get(h, 0), abs=1e-5) and got[h]["distrust"] == pytest.approx(distrust.get(h, 0), abs=1e-5)
    assert {h for h in distrust if distrust[h] > 1e-12} <= set(got) and "h11" in got
    assert all(p.count("Join ") == joins for p in plans[1:]) and max(files) <= 2


def test_a_long_chain_to_a_blocked_host_is_blocked(spark):
    pages = [(0, "http://c0.net/", '<a href="http://bad.com/de/">')]
    pages += [(i, f"http://c{i}.net/", f'<a href="http://c{i - 1}.net/">') for i in range(1, 21)]
    pages += [(90, "http://bad.com/de/x", None), (91, "http://alone.net/", "<p>")]
    found = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert all(found[i]["verdict"] == "block" for i in [*range(21), 90]) and found[91]["verdict"] == "allow"
    ranks = [found[i]["distrust"] for i in range(21)]
    assert ranks == sorted(ranks, reverse=True) and ranks[-1] > 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:160] = v[20]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0, None] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(400), -np.round(s, 12))) if i != q][:20]
        assert len(found) == 20 and all(abs(s[i] - x) < 1e-12 for i, x in found)
        hits += len({i for i, _ in found} & set(order))
    assert hits >= 0.9 * 400
    assert [i for i, _ in got[20]][:3] == [100, 101, 102]


def recall(spark, x, k=20):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    found = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0, k).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, len(x), 20):
        products = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -products)) if i != q][:k]
        rows = sorted(found[q])
        assert [r for r, *_ in rows] == list(range(1, k + 1))
        assert all(s == pytest.approx(products[i]) for _, i, s in rows) and [s for *_, s in rows] == sorted((s for *_, s in rows), reverse=True)
        hit += len(set(order) & {i for _, i, _ in rows})
    return hit / (len(range(0, len(x), 20)) * k)


@pytest.mark.parametrize("kind", ["unit", "half", "one", "single"])
def test_recall_whatever_the_lengths(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind in ("half", "one"):
        x *= np.exp(rng.normal(size=(1500, 1)) * {"half": 0.5, "one": 1.0}[kind])
    if kind == "single":
        x[7] *= 10
    assert recall(spark, x) >= 0.9


def test_classes_of_lengths():
    norms = np.array([10.0, 8.0, 7.9, 1e-9, 10 / 1.25 ** 3])
    c = neighbours.class_of(norms, 10.0)
    assert c.tolist() == [0, 1, 1, neighbours.CLASSES - 1, 3]
    tops = 10 * neighbours.RATIO ** -c.astype(float)
    assert (norms <= tops * (1 + 1e-9)).all()
    x = neighbours.prepared(np.eye(5)[:, :4] * 3 + 1, 10.0, False)
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    assert neighbours.class_of(norms, None).tolist() == [0] * 5


def test_full_buckets_are_split_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    x = np.random.default_rng(5).normal(size=(300, 16))
    assert recall(spark, x, 5) >= 0.9


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(0, 6)], "vec_id bigint, embedding array<float>")
    got = neighbours.nearest(df, F.col("id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [5, 4, 3, 2, 1]
    assert neighbours.nearest(df.where("vec_id < 0"), F.col("id") == 0).count() == 0


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(2)
    prose = [" ".join(word(rng) + word(rng) + ("." if k % 9 == 8 else "") for k in range(80)) for _ in range(300)]
    junk = [" ".join([word(rng)] * 40 + [word(rng)] * 40) for _ in range(30)]
    junk += [" | ".join(word(rng) + word(rng) for _ in range(60)) for _ in range(30)]
    junk += [" ".join(word(rng) + "%%%" for _ in range(60)) for _ in range(30)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(prose + junk + [None, ""])], "doc_id bigint, text string, quality double")
    scored = {r["doc"]["doc_id"]: r["keep"] for r in quality.QualityModel.fit(df).score(df).collect()}
    assert sum(scored[i] for i in range(300)) == 300
    assert sum(scored[i] for i in range(300, 390)) <= 5 and not scored[390] and not scored[391]


def test_votes_give_accuracies():
    rng = random.Random(4)
    counts = collections.Counter()
    for _ in range(20000):
        bad = rng.random() < 0.2
        counts[tuple(int(bad) if rng.random() < 0.9 else int(not bad) for _ in quality.LABELLERS)] += 1
    _, table, prior = quality.estimate(sorted(counts.items()))
    assert prior == pytest.approx(0.2, abs=0.02)
    assert all(t[1][1] == pytest.approx(0.9, abs=0.03) and t[0][0] == pytest.approx(0.9, abs=0.03) for t in table)


def test_empty_tables(none):
    assert shingles.near_duplicates(none).count() == 0
    assert suffixes.remove_repeats(none).count() == 0
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert packing.pack(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert tokencounts.apply_edits(tokencounts.with_trees(none)).count() == 0
    assert quality.QualityModel.fit(none).score(none).count() == 0
    pages = none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert urlfilter.judge(pages).count() == 0


def test_pipeline_on_a_small_table(spark, docs, none, tmp_path):
    import corpus_pipeline
    for name, frame in (("full", docs.select("doc_id", "text", "lang", "source", "n_chars")), ("none", none.select(
            "doc_id", "text", "lang", "source", "n_chars"))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert (out.count() > 0) == (name == "full")
