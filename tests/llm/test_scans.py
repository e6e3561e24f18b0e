"""Operators 1, 3, 5, 9: row-wise scans, held against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import time

import duckdb
import pytest

from clausewright.llm.automaton import Parser, determinise
from clausewright.llm.common import shared_folder, table
from clausewright.llm.decontaminate import contamination_digest, drop_contaminated, find_contamination
from clausewright.llm.licenses import NOTICES, PHRASES, finder, find_licenses, license_digest
from clausewright.llm.queries import QUERIES
from clausewright.llm.secrets import BASE_KINDS, RULES, find_secrets, longest, redact_secrets, scanner, secret_digest, text_spans
from clausewright.llm.sql import ORACLE_SQL
from clausewright.llm.tokens import MARK, Trie, count_tokens, load_pieces
from tests.llm.plain import plain_contamination, plain_secrets, plain_words

SCHEMA = "doc_id long, text string, kind string, start long, spans string"


def rows(spark, texts):
    """Documents with other columns whose names clash with an operator's own."""
    return spark.createDataFrame([(i, t, "x", None, "y") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("pattern", ["a+b|ab*c", "(?:x|yz){2,3}w?", "[^a-c]d", "[0-9a-f]{3}[0-9a-f]*", r"k\x20*[:=]\x20*v+"])
def test_automaton_agrees_with_regular_expressions(pattern):
    dfa = determinise([Parser(pattern).parse()], floating=False)
    choose = random.Random(pattern)
    for _ in range(500):
        text = "".join(choose.choice("abcdxyzwkv01 :=") for _ in range(choose.randint(0, 12)))
        match = max((m for n in range(len(text) + 1) if (m := re.compile(pattern).fullmatch(text, 0, n))), key=lambda m: m.end(), default=None)
        assert longest(dfa, text.encode(), 0) == (match.end() if match else 0), text


def test_secrets_of_random_texts():
    parts = ["token", "TOKEN", "secret", "passwd", "api_key", "apikey", " = ", "=", ":", '"', "'", "abc", "abcdef", "é", "AKIA", "ABCDEFGH01234567", "0123456789abcdef01234567", " ", "ghp_", "0123456789" * 4, "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "AIza", "_", "\n"]
    choose = random.Random(4)
    for _ in range(3000):
        text = "".join(choose.choice(parts) for _ in range(choose.randint(0, 25)))
        assert text_spans(scanner(RULES), text.encode()) == plain_secrets(text), text


def test_secret_query(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text").collect()
    extra = [None, "", "é token = 'abcdefgh1' x", "token=token = abcdefgh", "a" * 300_000 + " AKIA" + "Z" * 16]
    got = {r["doc_id"]: r for r in secret_digest(rows(spark, [*extra, *(d["text"] for d in docs)])).collect()}
    for i, text in enumerate([*extra, *(d["text"] for d in docs)]):
        spans = plain_secrets(text or "")
        base = ",".join(f"{RULES[k].kind}:{s}:{e}" for s, k, e in spans if RULES[k].kind in BASE_KINDS)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert got[i]["spans"] == ",".join(f"{RULES[k].kind}:{s}:{e}" for s, k, e in spans)
        assert [got[i][f"n_{b}"] for b in BASE_KINDS] == [sum(RULES[k].kind == b for _, k, _ in spans) for b in BASE_KINDS]


def test_redaction_and_empty_table(spark):
    docs = rows(spark, ["x token = abcdef0123 y", None, "plain"])
    assert [r["text"] for r in redact_secrets(docs).orderBy("doc_id").collect()] == ["x [SECRET] y", None, "plain"]
    assert find_secrets(docs.filter("doc_id < 0")).count() == 0


def test_license_query(spark, small):
    docs = [d["text"] for d in table(spark, small, "documents").select("text").collect()]
    texts = [None, "", "CC BY cc-by", "Released under teh MIT Licence.", "Licensed under the Apache License, Version 2.0.", "gnu general  public\nlicense", "é" * 9, *docs]
    got = {r["doc_id"]: r for r in license_digest(rows(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = plain_words(text)
        places = [(w, label) for phrase, label in PHRASES for w in range(len(words)) if words[w : w + len(phrase.split())] == phrase.split()]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(words), len(places))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((min(p[0] for p in places), max(p[0] for p in places)) if places else (None, None))
        assert got[i]["base_labels"] == ",".join(sorted({p[1] for p in places}))
        assert set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(","))
        assert 0 <= got[i]["score"] <= 1
    assert got[3]["labels"] == "mit" and 0 < got[3]["score"] < 1 and got[3]["spans"] == "mit:0:30:3"
    assert got[4]["score"] == 1.0 and got[6]["score"] == 0.0


def least_edits(pattern, text):
    """The least edits of `pattern` against any part of `text` (the table of distances with a free start)."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        corner, row[0] = 0, 0
        for i, p in enumerate(pattern, 1):
            corner, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, corner + (p != c))
        best = min(best, row[-1])
    return best


def test_notices_against_the_edit_distance():
    choose = random.Random(8)
    for n in NOTICES:
        search = finder((n,))
        for _ in range(25):
            text = list(n.words)
            for _ in range(choose.randint(0, n.edits + 2)):
                at, how = choose.randrange(len(text)), choose.random()
                text[at : at + (how < 0.7)] = [] if how < 0.3 else ["z"]
            joined = " on the " + "".join(text) + " we "
            found, least = search.find(joined.encode()), least_edits(n.words, joined)
            assert [e for *_, e in found] == ([least] if least <= n.edits else []), joined


def test_many_notices_each_once():
    search = finder(NOTICES)
    for phrase, edits in (("mozila public licence version 2 0 mozilla public license version 2 0", [2, 0]), ("released undr the mit licence released under the mit license", [2, 0])):
        assert [e for *_, e in search.find(f" {phrase} ".encode())] == edits
    many = b" " + b"released under teh mit licence " * 1000
    assert len(search.find(many)) == 1000


def test_license_spans_are_code_points(spark):
    text = "Üé: Released under the M.I.T license, ok"
    spans = find_licenses(rows(spark, [text])).first()["notices"]
    assert text[spans[0]["start"] : spans[0]["end"]].startswith("Released under")


@pytest.mark.parametrize("block", [8_000_000, 40])
def test_contamination(spark, block):
    choose = random.Random(6)
    bank = [" ".join(choose.choice(["uno", "dos", "Tres", "é4", "cinco"]) for _ in range(n)) for n in (3, 10, 14, 25)]
    items = [(1, bank[0]), (2, bank[1]), (10, bank[2]), (3, None), (4, "..."), (5, bank[3] + " " + bank[0])]
    texts = [None, "", bank[1].upper() + "!", "x " + bank[2] + ", " + bank[2], " ".join(bank), "dos", *(" ".join(choose.choice(["uno", "dos", "tres", "é4", "cinco"]) for _ in range(60)) for _ in range(30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = rows(spark, texts)
    from clausewright.llm import decontaminate

    kept, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, block
    try:
        got = {r["doc_id"]: r for r in contamination_digest(docs, bench).collect()}
        found = {r["doc_id"]: r for r in find_contamination(docs, bench, block_bytes=block).collect()}
        left = {r["doc_id"] for r in drop_contaminated(docs, bench).collect()}
    finally:
        decontaminate.BLOCK_BYTES = kept
    for i, text in enumerate(texts):
        expected = plain_contamination(text, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"]) == expected, text
        assert sum(h["n_words"] for h in found[i]["hits"]) == expected[1]
        assert (i in left) == (expected[1] == 0) == (not got[i]["contaminated"])
        for h in found[i]["hits"]:
            assert plain_words(text[h["start"] : h["end"]]) == plain_words(text)[h["word"] : h["word"] + h["n_words"]]


def test_contamination_without_items(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination_digest(rows(spark, ["a b c"]), bench).first()["contaminated"] is False


def plain_tokens(word, trie):
    """The best segmentation without a trie."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * trie.fallback, best[end - 1][1] + n)]
        options += [(best[s][0] + trie.pieces[word[s:end]], best[s][1] + 1) for s in range(max(0, end - trie.longest), end) if word[s:end] in trie.pieces]
        best.append(max(options, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


def test_token_counts(spark, small):
    trie = Trie(load_pieces())
    texts = [None, "", "a", "über naïve 漢字 🙂 zzzzqqq", *(d["text"] for d in table(spark, small, "documents").limit(30).collect())]
    got = {r["doc_id"]: r for r in count_tokens(rows(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert (got[i]["n_words"], got[i]["n_chars"]) == (len(words), len(text or ""))
        assert got[i]["n_tokens"] == sum(plain_tokens(MARK + w, trie) for w in words)


def test_notices_before_a_better_one_are_found():
    from clausewright.llm import licenses

    joined = b" released under the mit licence released under the mit license released under the mit licence "
    found = licenses.finder(licenses.NOTICES).find(joined)
    assert [joined[a:b].strip() for a, b, _, _ in found] == [b"released under the mit licence", b"released under the mit license", b"released under the mit licence"]
    assert [e for _, _, _, e in found] == [1, 0, 1]


def test_secret_scans_are_linear():
    """A run that begins nothing is walked once: quadratic walks would take hours."""
    scan = scanner(RULES)
    began = time.perf_counter()
    assert scan.spans(b"eyJa" * 250_000) == [] and scan.spans(b"-----BEGIN " * 90_000) == []
    assert len(scan.spans(b"token = abcdef1 " * 60_000)) == 60_000
    assert time.perf_counter() - began < 20


def test_scans_of_odd_tables(spark):
    empty, bench = rows(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for scan in (secret_digest, license_digest, count_tokens, lambda d: contamination_digest(d, bench)):
        assert scan(empty).count() == 0
        twice = scan(rows(spark, ["a b c " * 50_000, None]).unionByName(rows(spark, ["a b c " * 50_000, None])))
        assert sorted(twice.groupBy("doc_id").count().collect()) == [(0, 2), (1, 2)]
    assert contamination_digest(rows(spark, ["a b c " * 50_000]), bench).first()["n_hit"] == 150_000


def test_benchmark_bound(spark, monkeypatch):
    from clausewright.llm import decontaminate

    monkeypatch.setattr(decontaminate, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="benchmark"):
        find_contamination(rows(spark, ["a"]), spark.createDataFrame([(1, "many words of a benchmark")], "item_id long, text string"))


def test_long_tokens_outside_the_trie():
    pieces = load_pieces()
    trie, choose = Trie(pieces), random.Random(3)
    word = MARK + "".join(choose.choice("abcdeé漢ing") for _ in range(5000))
    assert trie.count(word) == plain_tokens(word, trie) and len(trie.children) == 1
    for n in (5, 40, 999):
        assert trie.count(word[:n]) == trie.count_long(word[:n])


def test_no_folder_of_its_own_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    frame = QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    expected = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(names) == columns and sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect()) == expected
