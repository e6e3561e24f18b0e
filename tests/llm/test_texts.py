"""Operators 11 to 13: fingerprints, phrases and fill-in-middle, held against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import pytest

from clausewright.llm import phrases as P
from clausewright.llm.common import table
from clausewright.llm.fingerprints import BUCKETS, TRIPLETS, bucket_counts, fingerprint, fingerprint_digest, fingerprint_documents, following_texts, likeness, likeness_of
from clausewright.llm.infill import fill_in_middle, infill_digest, joined, point_count, restore, restored, rope, split, transformed, written_out
from clausewright.llm.queries import QUERIES
from clausewright.llm.sql import ORACLE_SQL

SCHEMA = "doc_id long, text string, lang string, part string, size long, fingerprint string, form string"


def rows(spark, pairs, lang=lambda i: None):
    """Documents with other columns whose names clash with an operator's own."""
    return spark.createDataFrame([(i, t, lang(i), "x", None, "y", "z") for i, t in pairs], SCHEMA)


def same_as_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    frame, found = QUERIES[name](spark, small), con.execute(ORACLE_SQL[name])
    assert frame.columns == [d[0] for d in found.description]
    assert sorted(map(tuple, frame.collect())) == sorted(found.fetchall())


# Fingerprints ---------------------------------------------------------------------------------------------------------


def plain_counts(text):
    data, counts = bytes(4) + text, [0] * BUCKETS
    for at in range(len(text)):
        for kind, places in enumerate(TRIPLETS):
            a, b, c = (data[at + p] for p in places)
            counts[((a | b << 8 | c << 16 | kind << 24) * 0x9E3779B1 & 0xFFFFFFFF) >> 24] += 1
    return counts


def plain_likeness(a, b):
    """By definition: penalties of all pairs of codes, over their mean when one side's codes are dealt at random."""
    if a == b:
        return 1.0
    codes = [[byte >> shift & 3 for byte in bytes.fromhex(x)[1:] for shift in (0, 2, 4, 6)] for x in (a, b)]
    cost = [0, 1, 2, 6]
    length = 3 * abs(int(a[:2], 16) - int(b[:2], 16))
    found = sum(cost[abs(x - y)] for x, y in zip(*codes)) + length
    chance = sum(cost[abs(x - y)] for x in codes[0] for y in codes[1]) / BUCKETS
    return max(0.0, 1 - found / chance) if chance else float(found == 0)


def test_fingerprint_counts_and_likeness():
    choose = random.Random(11)
    texts = ["", "a", "ab", "\x00", "é日本", *("".join(choose.choice("abc dé") for _ in range(choose.randint(0, 400))) for _ in range(40))]
    for text in texts:
        assert bucket_counts(text.encode()).tolist() == plain_counts(text.encode())
    marks = [fingerprint(t.encode()) for t in texts]
    pairs = [(choose.choice(marks), choose.choice(marks)) for _ in range(200)]
    got = likeness_of(*map(list, zip(*pairs)))
    assert got.tolist() == pytest.approx([plain_likeness(a, b) for a, b in pairs])
    assert ((got >= 0) & (got <= 1)).all()
    assert fingerprint(b"") == "00" * 65 and likeness_of([marks[1]], [marks[1]])[0] == 1


def test_fingerprints_of_long_texts_are_counted_in_blocks(monkeypatch):
    text = random.Random(3).randbytes(5000)
    whole = fingerprint(text)
    monkeypatch.setattr("clausewright.llm.fingerprints.BLOCK", 97)
    assert fingerprint(text) == whole


def plain_fingerprints(docs):
    ordered = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (i, text), (_, other) in zip(ordered, ordered[1:] + ordered[:1]):
        text, other = text or "", other or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + other[:k]
        marks = [fingerprint(x.encode()) for x in (text, edited, other)]
        near = [plain_likeness(marks[0], m) for m in marks[1:]]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], *(pytest.approx(x) for x in near))
    return out


def test_fingerprint_query(spark, small):
    docs = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    extra = [(-1, None), (-7, ""), (10**12, "é" * 7), (10**12 + 5, "日本" * 50_000), (10**13, "a")]
    got = fingerprint_digest(rows(spark, docs + extra)).collect()
    expected = plain_fingerprints(docs + extra)
    assert len(got) == len(expected)
    for r in got:
        assert tuple(r)[1:] == expected[r["doc_id"]]
    # Two thirds kept is nearer than another document, if that is another text.
    assert sum(r["near_edited"] > r["near_next"] or r["near_next"] > 0.6 for r in got) >= 0.97 * len(got)
    assert sum(r["near_edited"] for r in got) / len(got) > 0.6 > 0.4 > sum(r["near_next"] for r in got) / len(got)


@pytest.mark.parametrize("docs", [[], [(5, "alone")], [(5, None)], [(1, "x"), (1, "x"), (1, "y"), (None, "n"), (None, None), (2, "z")], [(7, "same")] * 40])
def test_following_texts_of_odd_tables(spark, docs):
    got = following_texts(rows(spark, docs)).collect()
    assert sorted((r["text"] for r in got), key=repr) == sorted((t or "" for _, t in docs), key=repr)
    # One circle: each text follows as often as it stands.
    assert Counter(r["next_text"] for r in got) == Counter(r["text"] for r in got)
    ids = [(r["doc_id"], r["next_text"]) for r in got]
    if docs and docs[0] == (1, "x") and len(docs) > 1:
        assert (2, "x") in ids or (2, "y") in ids
        assert sum(r["doc_id"] is None and r["next_text"] == "z" for r in got) == 1


def test_fingerprint_operator_and_column(spark):
    made = fingerprint_documents(rows(spark, [(1, "some words of a text"), (2, None), (2, None)]))
    assert [tuple(r) for r in made.orderBy("doc_id").collect()] == [(1, 20, fingerprint(b"some words of a text")), (2, 0, "00" * 65), (2, 0, "00" * 65)]
    pairs = spark.createDataFrame([(fingerprint(b"one text here"), fingerprint(b"one text there")), (None, "00" * 65)], "a string, b string")
    near = [r[0] for r in pairs.select(likeness(pairs["a"], pairs["b"])).collect()]
    assert near == [pytest.approx(plain_likeness(fingerprint(b"one text here"), fingerprint(b"one text there"))), None]


# Phrases --------------------------------------------------------------------------------------------------------------


def plain_collocations(docs, least, kept):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, found in counts.items():
        frequent = {p: a for p, a in found.items() if a >= least}
        rows = []
        for p, a in frequent.items():
            if len(p) < 2 or any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        out += [(lang, rank, phrase.decode(), -a, left, right, totals[lang], -score) for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:kept], 1)]
    return sorted(out)


def texts_of(choose, n):
    words = ["the", "The", "of", "a", "é", "日本", "x\x01y", "x", "xy", "z" * 100, "~", "\x1f"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", ";", "\r\n", "?!"]
    return ["".join(choose.choice(words[: choose.randint(1, 12)]) + choose.choice(ends) for _ in range(choose.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("deep", [False, True])
def test_collocations_of_random_texts(spark, monkeypatch, deep):
    choose = random.Random(12)
    docs = [(choose.choice(["en", "de", None, ""]), t) for t in texts_of(choose, 120)] + [("en", None), (None, ""), ("en", "the of " * 3000), ("en", "the of a " * 50)]
    if deep:  # each range is dealt again
        monkeypatch.setattr(P, "MOST_RANGES", 3)
    frame = rows(spark, enumerate(t for _, t in docs), lambda i: docs[i][0])
    got = P.collocations(frame, 3, 40, shard_bytes=500, range_leaves=40, sampled=4)
    assert sorted(map(tuple, got.collect())) == plain_collocations(docs, 3, 40)


def test_collocations_query(spark, small):
    same_as_sql(spark, small, "op12_phrase_collocations")


def test_collocations_of_nothing(spark):
    assert P.collocations(rows(spark, [])).collect() == []
    assert P.collocations(rows(spark, [(1, None), (2, " .. ")])).collect() == []


def test_scores_are_exact(spark):
    choose = random.Random(5)
    cases = [tuple(choose.randint(100, 10**choose.randint(3, 16)) for _ in range(4)) for _ in range(300)]
    cases = [(min(a, n), n, max(l, a), max(r, a)) for a, n, l, r in cases]
    got = spark.createDataFrame(cases, "a long, n long, l long, r long").selectExpr("a", "n", "l", "r", f"{P.SCORE} AS s").collect()
    assert all(r["s"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in got)


def test_tries_survive_packing():
    choose = random.Random(2)
    for text in texts_of(choose, 30):
        trie, totals = P.shard_trie([(b"en", text.encode())])
        own = P.unpacked(*trie.packed())
        spelled = lambda t: [[t.words[i - 1] if i else b"" for i in leaf] for leaf in t.leaves.tolist()]
        assert spelled(own) == spelled(trie) == sorted(spelled(trie)) and own.counts.tolist() == trie.counts.tolist()
        assert sum(totals.values()) == trie.counts.sum()


def test_tries_take_little_memory():
    """a shard's trie is made and packed in some 30 times its text (of short words), and frequent nodes leave a range some at a time."""
    choose = random.Random(5)
    text = " ".join("w%d" % int(choose.paretovariate(0.4)) for _ in range(150_000)).encode()[:800_000]
    P.shard_trie([(b"en", b"imports what it needs")])[0].packed()
    tracemalloc.start()
    try:
        trie, _ = P.shard_trie([(b"en", text)])
        packed = trie.packed()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 * len(text), peak / len(text)
    own = P.unpacked(*packed)
    nodes = list(P.frequent_nodes(own, 1))
    assert max(b.num_rows for b in nodes) <= P.NODE_ROWS < sum(b.num_rows for b in nodes)
    found = {(r["phrase"], tuple(r["lefts"])): r["a"] for b in nodes for r in b.to_pylist()}
    words = text.decode().lower().split(" ")
    plain = Counter(" ".join(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    assert {p: a for (p, _), a in found.items()} == plain
    assert all(list(lefts) == [plain[" ".join(p.split(" ")[:k])] for k in range(1, p.count(" ") + 1)] for p, lefts in found)


def test_tables_of_tries_have_small_rows(spark, monkeypatch):
    """a row of the table has some leaves of a shard's trie, not all."""
    monkeypatch.setattr(P, "ROW_LEAVES", 100)
    docs = spark.createDataFrame([("en", " ".join(f"a{i} b{i % 7}" for i in range(500)))], "lang string, text string")
    rows = P.shard_tries(docs, sampled=8).collect()
    assert [r["n_leaves"] for r in rows] == [100] * 10
    assert [r["langs"] for r in rows] == [{"en": 1000}] + [{}] * 9
    leaves = [leaf for r in rows for t in [P.unpacked(r["size"], bytes(r["trie"]))] for leaf in ([t.words[i - 1] if i else b"" for i in x] for x in t.leaves.tolist())]
    assert leaves == sorted(leaves) and [[bytes(w) for w in path] for r in rows for path in r["sample"]] == leaves[4::8]


def test_portions_never_cut_pieces():
    choose = random.Random(8)
    for text in [*texts_of(choose, 40), "long " * 100 + ". short, end"]:
        parts = list(P.portions(text.encode(), 20))
        assert b"".join(parts) == text.encode() and all(p.translate(P.PIECES).endswith(b"\n") for p in parts[:-1])


# Fill in the middle ---------------------------------------------------------------------------------------------------

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(doc_id, text, rate=50, spm=80):
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return text, "plain", len(units), None, None
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(part) for part in (units[:low], units[low:high], units[high:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", form, len(units), len(p), len(m)


def test_ropes_split_and_join(monkeypatch):
    monkeypatch.setattr("clausewright.llm.infill.LEAF", 8)
    choose = random.Random(13)
    for _ in range(500):
        text = "".join(choose.choice(["a", "é", "日", " ", "\n", "longer"]) for _ in range(choose.randint(0, 50)))
        tree, units = rope(text.encode()), UNITS.findall(text)
        assert written_out(tree) == text.encode() and (tree.units if tree else 0) == len(units)
        for whole, pieces in ((True, units), (False, list(text))):
            rank = choose.randint(-1, len(pieces) + 1)
            first, rest = split(tree, rank, whole)
            assert written_out(first) == "".join(pieces[: max(rank, 0)]).encode()
            assert written_out(joined(first, rest)) == text.encode()
            assert (first.points if first else 0) == point_count_of("".join(pieces[: max(rank, 0)]))


def point_count_of(text):
    import numpy as np

    return point_count(np.frombuffer(text.encode(), dtype=np.uint8))


def test_infill_of_random_texts():
    choose = random.Random(31)
    for _ in range(2000):
        text = "".join(choose.choice(["a", "é", "日本", " ", "\n\t", "<P", ">", "<S>", "\x1c", "\xa0", "word"]) for _ in range(choose.randint(0, 30)))
        doc_id = choose.choice([None, choose.randint(-(2**63), 2**63 - 1)])
        output, form, *rest = transformed(text.encode(), doc_id)
        assert (output.decode(), form, *rest) == plain_infill(doc_id, text)
        assert restored(output, form) == text.encode()


def test_infill_query(spark, small):
    same_as_sql(spark, small, "op13_fill_in_middle")


def test_infill_of_odd_tables(spark):
    long = "mot é " * 400_000
    docs = [(None, "x y"), (3, None), (4, ""), (5, long), (5, long), (6, "<P> held"), (7, " \n"), (8, "z")]
    made = fill_in_middle(rows(spark, docs), rate=100)
    got = restore(made).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t or "") for i, t in docs)
    assert all((r["output"], r["form"], r["n_units"], r["prefix_chars"], r["middle_chars"]) == plain_infill(r["doc_id"], r["text"], 100) for r in got)
    assert {r["form"] for r in got if r["doc_id"] in (3, 4, 6)} == {"plain"}
    assert infill_digest(rows(spark, [])).collect() == []
