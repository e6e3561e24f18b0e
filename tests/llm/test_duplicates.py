"""Operators 2, 7, 8 and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from clausewright.llm import passages, repeats, simhash
from clausewright.llm.common import table
from clausewright.llm.components import connected_components
from clausewright.llm.mixing import MIX_SQL
from clausewright.llm.packing import packed, unpacked
from clausewright.llm.suffixes import common_prefixes, suffix_array
from tests.llm.plain import plain_contamination, plain_rules, plain_secrets


def test_suffix_arrays():
    choose = random.Random(5)
    for _ in range(200):
        text = bytes(choose.choice(b"abc\xff") for _ in range(choose.randint(0, 60)))
        data = np.frombuffer(text, dtype=np.uint8)
        order = suffix_array(data, 100)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        for i, n in enumerate(common_prefixes(data, order, 10).tolist()):
            a, b = (text[order[i - 1] :], text[order[i] :]) if i else (b"", b"")
            assert n == next((k for k in range(min(len(a), len(b), 10)) if a[k] != b[k]), min(len(a), len(b), 10))


def plain_repeats(rows):
    seen, out = set(), {}
    for key, text in sorted(rows):
        data = text.encode()
        gone = [False] * len(data)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(data[i : i + 100])
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def passages_of(seed, n=40):
    choose = random.Random(seed)
    words = ["alpha", "beta", "gamma", "délta", "eps", "zeta\n", "eta ", "theta", "iota kappa"]
    para = lambda: " ".join(choose.choice(words) for _ in range(choose.randint(5, 60)))
    bank, rows = [para() for _ in range(8)], []
    for i in range(n):
        text = " ".join(choose.choice(bank) if choose.random() < 0.5 else para() for _ in range(choose.randint(0, 6)))
        rows.append((i * 3 - 20, rows[choose.randrange(len(rows))][1] if rows and choose.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize("hot", [256, 2])
def test_repeats(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_SEGMENTS", hot)
    rows = passages_of(1)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeats_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_repeats(rows)


def test_repeats_of_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 150)
    rows = [(i, t * 3) for i, t in passages_of(2, 12)]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.repeats_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: v[1] for k, v in plain_repeats(rows).items()}


def test_repeats_of_odd_rows(spark):
    text = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(4))
    rows = [(None, text, 1), (5, text, 2), (5, text, 3), (5, None, 4), (7, "", 5), (7, "x" + text, 6)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")).collect()
    assert len(got) == 6
    assert all(r["n_bytes"] == sum(s["end"] - s["start"] for s in r["spans"]) + len(r["kept"]) for r in got)
    assert sorted(len(r["kept"]) for r in got if r["doc_id"] == 5) == [0, 0, 0]
    assert next(r for r in got if r["doc_id"] is None)["spans"] == []
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fuzzy_passages(spark):
    choose = random.Random(2)
    words = ["".join(choose.choice("abcdefghij") for _ in range(choose.randint(2, 7))) for _ in range(3000)]
    some = lambda n: [choose.choice(words) for _ in range(n)]
    passage, rows, planted = some(60), [], {}
    for i in range(40):
        own = some(choose.randint(30, 200))
        if i % 4 == 1:
            part = list(passage)
            if i % 8 == 5:
                part[10], part[40] = "zzz", "yyy"
                del part[25]
            at = choose.randint(0, len(own))
            own[at:at] = part
            planted[i] = (at, at + len(part))
        rows.append((i, " ".join(own), "x"))
    rows += [(100, None, "x"), (101, "", "x")]
    got = {r["doc_id"]: r for r in passages.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string, holder string")).collect()}
    first = min(planted)
    for i, r in got.items():
        if i not in planted or i == first:
            assert r["passages"] == []
            continue
        start, end = planted[i]
        covered = set().union(*(range(p["start"], p["end"]) for p in r["passages"]))
        assert len(covered & set(range(start, end))) >= 0.9 * (end - start) and len(covered) <= 1.2 * (end - start)
        assert all(p["other_id"] in planted and p["other_id"] < i and p["similarity"] >= 0.8 for p in r["passages"])


def plain_chain_score(points):
    best = {}
    for x, y in sorted(points):
        best[x, y] = passages.SEED_WORDS + max([0.0, *(s - passages.GAP_COST * (x - a + y - b) for (a, b), s in best.items() if a < x and b < y)])
    return max(best.values())


def test_chains_are_the_best(monkeypatch):
    monkeypatch.setattr(passages, "MOST_GAP", 10**9)  # a chain that is cut at its gaps is several
    choose = random.Random(3)
    for _ in range(200):
        points = list({(choose.randrange(60), choose.randrange(60)) for _ in range(choose.randint(1, 15))})
        found = passages.chains(points)
        assert sorted(p for c in found for p in c) == sorted(points)
        top = found[0]
        score = len(top) * passages.SEED_WORDS - passages.GAP_COST * (top[-1][0] - top[0][0] + top[-1][1] - top[0][1])
        assert all(a[0] < b[0] and a[1] < b[1] for c in found for a, b in zip(c, c[1:]))
        assert score == pytest.approx(plain_chain_score(points))


def plain_components(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components_of_long_chains(spark):
    choose = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(choose.randrange(70, 120), choose.randrange(70, 120)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    expected = plain_components(120, links)
    assert all(got.get(i, i) == expected[i] for i in range(120))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_values(seed):
    choose = random.Random(seed)
    values = [choose.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for _ in range(4):
            x = v
            for _ in range(choose.randint(0, 5)):
                x ^= 1 << choose.randrange(64)
            values.append(x)
    return sorted(set(values))


def test_forest_and_shards_lose_no_link(spark, monkeypatch):
    values = near_values(3)
    links = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    expected = plain_components(len(values), links)
    assert plain_components(len(values), simhash.forest(values)) == expected
    frame = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "rep long, fp long")
    monkeypatch.setattr(simhash, "SHARD_ROWS", 3)
    got = {r["node"]: r["component"] for r in connected_components(simhash.links(frame)).collect()}
    assert [got.get(i, i) for i in range(len(values))] == expected


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark, small):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    texts += [(9001, None), (9002, "  "), (9003, "É a"), (9004, "é A"), (9004, "é A"), (9005, "w " * 600)]
    prints = {}
    for key, text in texts:
        prints.setdefault(plain_fingerprint(text), []).append(key)
    values = sorted(prints)
    links = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    group = plain_components(len(values), links)
    smallest = {g: min(min(prints[values[i]]) for i in range(len(values)) if group[i] == g) for g in set(group)}
    expected = sorted((k, f"{values[i]:016x}", smallest[group[i]]) for i in range(len(values)) for k in prints[values[i]])
    docs = spark.createDataFrame([(k, t, "c") for k, t in texts], "doc_id long, text string, component_id string")
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == expected
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(smallest.values()) and kept.columns == docs.columns


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (2, "a b c d")], "doc_id long, text string")).filter("component_id = 2").count() == 2


def plain_pipeline(rows, items):
    """rows (doc_id, text, source) that the first four stages keep, redacted. Without labels the rules alone decide."""
    kept = [r for r in rows if not plain_rules(r[1])[-1]]
    prints = [plain_fingerprint(r[1]) for r in kept]
    named = [i for i, r in enumerate(kept) if r[0] is not None]
    values = sorted({prints[i] for i in named})
    links = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    group = dict(zip(values, plain_components(len(values), links)))
    least = {}
    for i in named:
        key = (kept[i][0], hashlib.sha256((kept[i][1] or "").encode()).hexdigest())
        least[group[prints[i]]] = min(least.get(group[prints[i]], (key, i)), (key, i), key=lambda x: x[0])
    single = sorted(i for _, i in least.values()) + [i for i, r in enumerate(kept) if r[0] is None]
    clean = [kept[i] for i in single if not plain_contamination(kept[i][1], items)[1]]
    return [(key, plain_redaction(text), source) for key, text, source in clean]


def plain_redaction(text):
    out, at = [], 0
    for start, _, end in plain_secrets(text or ""):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def pipeline_folder(spark, folder, rows, items):
    """Tables with columns that clash with names inside the operators."""
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, source string, copy_no string, fp long, kept int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_against_a_plain_version(spark, small, tmp_path):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, small, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    words = lambda p, n=60: " ".join(f"{p}{i}" for i in range(n))
    rows += [(2_000_001, words("a"), None), (2_000_001, words("b"), None), (2_000_000, words("a"), "src0"), (2_000_002, None, "src0"), (None, words("c"), "src0"), (None, words("c"), "src1")]
    rows += [(2_000_003, words("d") + " token = abcdef012345", "s"), (2_000_004, words("e") + " " + items[0][1], "s"), (2_000_005, words("f"), "s"), (2_000_005, words("f"), "s")]
    pipeline_folder(spark, tmp_path, rows, items)
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == ["doc_id", "text", "source", "fp", "kept", "copy_no"]
    left = plain_pipeline(rows, items)
    con = duckdb.connect()
    frame = pd.DataFrame(left, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841  read by DuckDB
    con.execute("CREATE VIEW documents AS SELECT doc_id, text, source FROM frame")
    expected = Counter()
    for key, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({MIX_SQL}) AS m").fetchall():
        expected[key, size] += taken
    got = Counter()
    for r in result.collect():
        assert (r["doc_id"], r["text"], r["source"]) in left
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        got[r["doc_id"], size] += size
    assert +got == +expected and 2_000_001 in {k for k, _ in got}


def test_pipeline_of_nothing(spark, tmp_path):
    pipeline_folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, small):
    docs = table(spark, small, "documents").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def distinct_words(n, prefix):
    return [f"{prefix}{i}".encode() for i in range(n)]


def tiles_from(words):
    return {t: words[t * passages.TILE : (t + 1) * passages.TILE] for t in range(len(words) // passages.TILE + 1)}


def test_passages_of_a_chain_that_fails_as_a_whole():
    same, unlike, other = distinct_words(220, "s"), distinct_words(84, "u"), distinct_words(84, "o")
    mine, held = [], []
    for k in range(4):
        mine += same[55 * k : 55 * k + 55] + unlike[28 * k : 28 * k + 28]
        held += same[55 * k : 55 * k + 55] + other[28 * k : 28 * k + 28]
    points = [(83 * k + i, 83 * k + i) for k in range(4) for i in range(0, 50, 7)]
    assert [p[:4] for p in passages.aligned(mine, points, tiles_from(held))] == [(83 * k, 83 * k + 55) * 2 for k in range(4)]


def test_passages_that_cross_the_worst_gap():
    """Neither side of the first and worst gap has 25 words alone; the later gaps make the whole fail."""
    mine, held, points = [], [], []
    for k, (same, unlike) in enumerate([(15, 6), (15, 5), (5, 5), (5, 5), (5, 5), (5, 5), (5, 0)]):
        points.append((len(mine), len(mine)))
        if same > 5:
            points.append((len(mine) + same - 5, len(mine) + same - 5))
        both = distinct_words(same, f"s{k}x")
        mine += both + distinct_words(unlike, f"u{k}x")
        held += both + distinct_words(unlike, f"o{k}x")
    found = passages.aligned(mine, points, tiles_from(held))
    assert [p[:4] for p in found] == [(0, 36, 0, 36), (21, 46, 21, 46)] and found[0][4] == 1 - 6 / 36


def test_passages_grow_until_their_score_gives_up(spark):
    """One run of 30 equal words, then 4 of 5 words equal, on both sides: no seed for 600 words, or in what follows."""
    same = lambda p, n: [f"{p}{i}" for i in range(n)]
    held = same("a", 300) + same("m", 30) + same("b", 300)
    mine = [f"x{i}" if i % 5 == 0 else w for i, w in enumerate(held[:300])] + held[300:330] + [f"y{i}" if i % 5 == 4 else w for i, w in enumerate(held[330:])]
    rows = [(1, " ".join(same("p", 50) + held + same("q", 50))), (2, " ".join(same("r", 70) + mine + same("s", 70)))]
    found = {r["doc_id"]: r for r in passages.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["passages"] == []
    # The outermost words of the changed ends are unequal.
    assert [(p["start"], p["end"], p["other_start"], p["other_end"]) for p in found[2]["passages"]] == [(71, 699, 51, 679)]


def test_every_shared_seed_counts(spark):
    """Runs of at most eight equal words: a sample of one seed in any 20 words misses some."""
    choose = random.Random(8)
    rows, wanted = [], set()
    for i in range(0, 120, 2):
        same = [f"s{i}x{k}" for k in range(30)]
        fuzzy = [f"z{i}x{k}" if k in (7, 14, 21) else w for k, w in enumerate(same)]
        own = lambda p, n=choose.randint(40, 60): [f"{p}{i}x{k}" for k in range(n)]  # noqa: B023, E731
        rows += [(i, " ".join(own("a") + same + own("b"))), (i + 1, " ".join(own("c") + fuzzy + own("d")))]
        wanted.add(i + 1)
    found = passages.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).filter("size(passages) = 1").collect()
    assert {r["doc_id"] for r in found} == wanted
    assert all(p["end"] - p["start"] == 30 and p["similarity"] == 0.9 and p["other_id"] == r["doc_id"] - 1 for r in found for p in r["passages"])


@pytest.mark.parametrize("size", [4_000_000, 300])
def test_matches_are_those_of_all_seeds(spark, size, monkeypatch):
    monkeypatch.setattr(passages, "PARCEL_SEEDS", size)
    rows = [(k, t) for k, t in passages_of(4) if k]
    first, wide, expected = {}, {}, set()
    for key, text in sorted(rows):
        words = passages.plain_words(text.encode())
        for i in range(len(words) - 4):
            holders = [first.setdefault(tuple(words[i : i + 5]), (key, i))]
            if len(words) - i >= 25:
                holders.append(wide.setdefault(tuple(words[i : i + 25]), (key, i)))
            expected |= {(key, i, *h) for h in holders if h[0] != key}
    own = passages.bodies(spark.createDataFrame([(k, k, t) for k, t in rows], "doc_id long, doc long, text string"))
    parcels = passages.matches(own, 1 + 100_000 // size, 40).collect()
    found = [m for r in parcels for m in zip(*(c.tolist() for c in passages.unpacked_matches(r["n"], r["data"])))]
    assert sorted(m[:4] for m in found) == sorted(expected)


def test_edits():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        return row[-1]

    choose = random.Random(6)
    for _ in range(500):
        a, b = ([choose.choice([b"a", b"b", b"cc"]) for _ in range(choose.randint(0, 12))] for _ in range(2))
        assert passages.edits(a, b) == plain(a, b)


def test_passages_whose_parts_earlier_documents_hold(spark):
    """B and C share 64 words; three earlier documents hold 24 of them each, and so every seed."""
    own = lambda p: [f"{p}{k}" for k in range(40)]
    same = [f"s{k}" for k in range(64)]
    rows = [(k, " ".join(own(f"a{k}x") + same[20 * k : 20 * k + 24] + own(f"e{k}x"))) for k in range(3)]
    rows += [(k, " ".join(own(f"a{k}x") + same + own(f"e{k}x"))) for k in (3, 4)]
    found = {r["doc_id"]: r["passages"] for r in passages.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(p["start"], p["end"], p["other_id"], p["other_start"]) for p in found.pop(4)] == [(40, 104, 3, 40)]
    assert not any(found.values())


def test_texts_that_share_a_doc_id_stay_apart(spark):
    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (5, text("c")), (5, text("c")), (7, text("b")), (None, text("a"))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in kept} == {(1, text("a")), (5, text("b")), (5, text("c")), (None, text("a"))} and len(kept) == 4


def test_order_of_rows_does_not_matter_to_near_duplicates(spark):
    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(2, text("v")), (7, text("v")), (7, text("u"))]
    for order in ([0, 1, 2], [0, 2, 1], [2, 1, 0], [1, 2, 0]):
        docs = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").coalesce(1)
        assert sorted(map(tuple, simhash.drop_near_duplicates(docs).collect())) == [(2, text("v")), (7, text("u"))]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(2, 2), (7, 2), (7, 7)]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def test_passages_against_brute_force(spark):
    """Every reported passage is what it says; every run of 25 words that an earlier document has is covered."""
    choose = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    bank = [[choose.choice(words) for _ in range(choose.randint(10, 80))] for _ in range(8)]
    rows = []
    for i in range(60):
        own: list[str] = []
        for _ in range(choose.randint(0, 5)):
            part = list(choose.choice(bank)) if choose.random() < 0.6 else [choose.choice(words) for _ in range(choose.randint(1, 40))]
            for _ in range(choose.randint(0, len(part) // 12)):
                at = choose.randrange(len(part))
                part[at : at + choose.randint(0, 1)] = [choose.choice(words)] * choose.randint(0, 1)
            own += part
        rows.append((i * 2, " ".join(own)))
    rows += [(1001, rows[5][1]), (1002, None), (1003, ""), (None, rows[7][1]), (1004, "Thor " * 300), (1005, "Thor " * 200), (1006, "thor. " * 400)]
    got = {r["doc_id"]: r for r in passages.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {k: passages.plain_words((t or "").encode()) for k, t in rows}
    seen: set[tuple] = set()
    for key in sorted(texts, key=lambda k: (k is not None, k)):
        own, covered = texts[key], set()
        for p in got[key]["passages"]:
            mine, held = own[p["start"] : p["end"]], texts[p["other_id"]][p["other_start"] : p["other_end"]]
            size = max(len(mine), len(held))
            assert size >= 25 and p["similarity"] >= 0.8
            # The distance kept is that of an alignment, never less than the least.
            assert p["similarity"] <= 1 - plain_edits(mine, held) / size + 1e-9
            covered |= set(range(p["start"], p["end"]))
        windows = [tuple(own[i : i + 25]) for i in range(len(own) - 24)]
        for i, w in enumerate(windows):
            assert w not in seen or covered >= set(range(i, i + 25)), (key, i)
        seen |= set(windows)
    assert got[1001]["passages"][0]["other_id"] == 10 and len(got[1001]["passages"]) == 1


@pytest.mark.parametrize("share", [0.01, 0.05, 0.1])
def test_recall_of_edited_passages(spark, share):
    """Passages of 60 words with a share of their words changed, dropped or doubled, each held by one earlier document."""
    choose = random.Random(int(share * 100))
    word = lambda: "".join(choose.choice("abcdefghijklmnop") for _ in range(6))
    rows, planted = [], {}
    for i in range(60):
        part = [word() for _ in range(60)]
        edited: list[str] = []
        for w in part:
            how = choose.random() if choose.random() < share else 1
            edited += [word()] if how < 0.5 else [] if how < 0.75 else [w, word()] if how < 1 else [w]
        before = [word() for _ in range(40)]
        rows += [(2 * i, " ".join([word() for _ in range(30)] + part + [word() for _ in range(30)])), (2 * i + 1, " ".join(before + edited + [word() for _ in range(40)]))]
        planted[2 * i + 1] = set(range(40, 40 + len(edited)))
    got = {r["doc_id"]: r["passages"] for r in passages.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(len(w & set().union(*(range(p["start"], p["end"]) for p in got[k]))) for k, w in planted.items() if got[k])
    assert found >= 0.95 * sum(map(len, planted.values())) and not any(got[k] for k in got if k % 2 == 0)


@pytest.mark.parametrize("share", [0.05, 0.08, 0.1])
def test_recall_of_passages_that_several_hold_in_parts(spark, share):
    """Three early documents hold overlapping 24-word parts of a passage, a fourth all 60 words, a fifth an edited form."""
    choose = random.Random(int(share * 100))
    word = lambda: "".join(choose.choice("abcdefghijklmnop") for _ in range(6))
    fill = lambda n: [word() for _ in range(n)]
    rows, planted = [], {}
    for i in range(60):
        part = fill(60)
        edited: list[str] = []
        for w in part:
            how = choose.random() if choose.random() < share else 1
            edited += [word()] if how < 0.5 else [] if how < 0.75 else [w, word()] if how < 1 else [w]
        held = [part[0:24], part[18:42], part[36:60], part]
        rows += [(10 * i + k, " ".join(fill(30) + own + fill(30))) for k, own in enumerate(held)]
        rows.append((10 * i + 4, " ".join(fill(40) + edited + fill(40))))
        planted[10 * i + 4] = set(range(40, 40 + len(edited)))
    got = {r["doc_id"]: r["passages"] for r in passages.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [len(w & set().union(*(range(p["start"], p["end"]) for p in got[k]))) if got[k] else 0 for k, w in planted.items()]
    assert sum(found) >= 0.9 * sum(map(len, planted.values())) and sum(not f for f in found) <= 0.05 * len(found)
    assert not any(got[k] for k in got if k % 10 < 3)


def test_runs_meet_through_a_common_holder():
    pack = lambda *chains: passages.packed_chains(np.array([h for h, _ in chains]), np.array([len(p) for _, p in chains]), np.array([x for _, p in chains for x, _ in p]), np.array([y for _, p in chains for _, y in p]))
    mine = pack((7, [[10, 0], [15, 5], [21, 11]]), (9, [[40, 3]]))  # ten words from 0 on, five from 11; five of another
    other = pack((7, [[100, 2], [105, 7]]), (9, [[140, 4]]), (11, [[1, 3]]))
    assert passages.composed(mine, other) == [(x + 12, x + 100) for x in range(4)]
    assert passages.composed(other, mine) == [(x + 100, x + 12) for x in range(4)]
    assert passages.runs_of([[10, 0], [15, 5], [18, 8], [30, 20], [31, 22]]) == [(0, 13, 10), (20, 5, 10), (22, 5, 9)]


def test_passages_of_nothing(spark):
    assert passages.fuzzy_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, None, 1), (1, None, 2), (None, "a b", 3), (3, "x " * 40_000, 4), (4, "x " * 40_000, 5)], "doc_id long, text string, passages int")
    found = {(r["doc_id"], r["n_passages"], r["n_dup_words"]) for r in passages.passages_digest(odd).collect()}
    assert found == {(1, 0, 0), (None, 0, 0), (3, 0, 0), (4, 1, 40_000)}


def test_packed_columns_come_back():
    choose = random.Random(4)
    columns = [np.array([choose.choice([0, 1, -1, 2**62, -(2**62)]) for _ in range(50)]), np.arange(50) * 3, np.arange(50, dtype=np.uint64) << np.uint64(58)]
    back = unpacked(packed(columns, (8, 2, 8)), 50, (8, 2, 8))
    assert all((a.astype(np.int64) == b.view(np.int64)).all() for a, b in zip(columns, back))
    data = passages.packed_chains(np.array([5, -7]), np.array([1, 2]), np.array([1, 2, 3]), np.array([4, 5, 6]))
    assert list(passages.unpacked_chains(data)) == [(5, [[1, 4]]), (-7, [[2, 5], [3, 6]])]


def test_words_inside_spans():
    choose = random.Random(5)
    for _ in range(200):
        spans = [(choose.randrange(4), a := choose.randrange(30), a + choose.randrange(1, 12)) for _ in range(choose.randint(0, 8))]
        asked = [(choose.randrange(5), a := choose.randrange(40), a + choose.randrange(1, 10)) for _ in range(10)]
        covered = {(d, i) for d, a, b in spans for i in range(a, b)}
        got = passages.inside(*(np.array(c) for c in zip(*asked)), tuple(np.array(c, dtype=np.int64) for c in zip(*spans)) if spans else (np.zeros(0, np.int64),) * 3)
        assert got.tolist() == [all((d, i) in covered for i in range(a, b)) for d, a, b in asked]


def test_certain_words_are_in_passages():
    """Whatever certain() says without the words, alignment finds with them."""
    choose, told = random.Random(6), 0
    for _ in range(300):
        part = [b"w%d" % choose.randrange(200) for _ in range(choose.randint(20, 90))]
        edited: list[bytes] = []
        for w in part:
            how = choose.random()
            edited += [b"x%d" % choose.randrange(999)] if how < 0.04 else [] if how < 0.06 else [w, w] if how < 0.08 else [w]
        mine, held = [b"a%d" % i for i in range(choose.randint(0, 9))] + edited, [b"b%d" % i for i in range(choose.randint(0, 9))] + part
        seeds: dict[tuple, int] = {}
        for j in range(len(held) - 4):
            seeds.setdefault(tuple(held[j : j + 5]), j)
        points = [(i, seeds[k]) for i in range(len(mine) - 4) if (k := tuple(mine[i : i + 5])) in seeds]
        if not points:
            continue
        x, y = (np.array(c) for c in zip(*points))
        doc, holder, counts, x, y = passages.collected(np.full(len(x), 9), x, np.full(len(x), 1), y)
        covered, at = set(), 0
        for n in counts.tolist():
            found = passages.aligned(mine, list(zip(x[at : at + n].tolist(), y[at : at + n].tolist())), tiles_from([*held, *[b"end"] * 200]))
            covered |= {i for p in found or () for i in range(p[0], p[1])}
            at += n
        for _, start, end in zip(*passages.certain(doc, counts, x, y)):
            told += 1
            assert covered >= set(range(start, end))
    assert told > 200


def test_neighbours_never_rule_out_a_passage():
    choose, ruled_out, kept = random.Random(7), 0, 0
    for _ in range(1000):
        word = lambda: b"%d" % choose.randrange(30)
        mine = [word() for _ in range(choose.randint(5, 90))]
        held = [w if choose.random() < choose.choice([0.1, 0.75, 0.9]) else word() for w in mine]
        at = choose.randrange(len(mine) - 4)
        held[at : at + 5] = mine[at : at + 5]
        first = at
        while first and mine[first - 1] == held[first - 1]:
            first -= 1
        end = at + 5
        while end < len(mine) and mine[end] == held[end]:
            end += 1
        n = end - first
        if n >= passages.MIN_WORDS:
            continue
        views = [passages.neighbours(*passages.word_hashes([b" ".join(w)]), np.array([0]), np.array([first])) for w in (mine, held)]
        grows = bool(passages.may_grow(*views, np.array([n]))[0])
        points = [(first + i, first + i) for i in sorted({*range(0, n - 4, 5), n - 5})]
        found = passages.aligned(mine, points, tiles_from([*held, *[b"end"] * 200]))
        assert grows or found == []
        ruled_out, kept = ruled_out + (not grows), kept + bool(found)
    assert ruled_out > 50 and kept > 50
