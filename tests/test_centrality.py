"""Chunk summaries of central sentences, held against a plain version."""

from __future__ import annotations

import random
import re

from clausewright.operators import centrality
from clausewright.operators.centrality import central, central_chunks, central_parts
from clausewright.operators.summary import summarise


def plain_central(sentences, most=80):
    sets = [set(re.findall("[a-z0-9]+", s.lower())) for s in sentences]
    n = range(len(sets))
    weight = [[0 if i == j or not sets[i] and not sets[j] else 1000 * len(sets[i] & sets[j]) // (len(sets[i]) + len(sets[j])) for j in n] for i in n]
    rank = [1_000_000 for _ in n]
    for _ in range(20):
        rank = [150_000 + sum(850 * rank[j] * weight[i][j] // max(1000 * sum(weight[k][j] for k in n), 1) for j in n) for i in n]
    order = sorted((i for i in n if sets[i]), key=lambda i: (-rank[i], i))
    kept, total = [], 0
    for at, i in enumerate(order):
        if all(2 * len(sets[i] & sets[j]) < min(len(sets[i]), len(sets[j])) for j in order[:at]):
            total += len(sentences[i].split())
            if kept and total > most:
                break
            kept.append(i)
    return rank, " ".join(sentences[i] for i in sorted(kept))


def some_chunks():
    choose = random.Random(14)
    words = "supplier customer payment invoice term notice damages liability shall pay days the of a".split()
    sentence = lambda: " ".join(choose.choice(words).capitalize() if i == 0 else choose.choice(words) for i in range(choose.randint(1, 20))) + choose.choice(".!?")
    return [" ".join(sentence() for _ in range(choose.randint(0, 25))) for _ in range(60)]


def test_ranks_and_summaries_of_all_chunks(spark):
    chunks = [*some_chunks(), "", None, "...", "Same words. Same words. Same words.", "word " * 200]
    got = central_chunks(spark.createDataFrame(list(enumerate(chunks)), "chunk_no int, chunk string")).collect()
    assert len(got) == len(chunks)
    for r in got:
        assert (r["ranks"], r["summary"]) == plain_central(r["sentences"])
    own = {r["chunk_no"]: r["summary"] for r in got}
    assert own[len(chunks) - 2] == "Same words." and own[len(chunks) - 1] == ("word " * 200).strip() and own[len(chunks) - 5] == ""
    assert all(len(r["summary"].split()) <= 80 for r in got if r["chunk_no"] < 60)


def test_chunks_are_ranked_together(monkeypatch):
    """chunks of all sizes in few arrays, not one after another, with the results of each alone; the same where double
    precision would not do."""
    chunks = [re.split(r"(?<=[.!?]) ", text) if text else [] for text in some_chunks() * 4] + [["..."], [], ["", "Words.", "Words here."], ["A b."] * 70]
    wanted = [plain_central(own) for own in chunks]
    calls, plain = [], centrality.ranks
    monkeypatch.setattr(centrality, "ranks", lambda *a: calls.append(len(a[1])) or plain(*a))
    assert [(list(rank), said) for rank, said in centrality.centrals(chunks)] == wanted
    assert sum(calls) == sum(map(bool, chunks)) and len(calls) < 30
    monkeypatch.setattr(centrality, "EXACT", 0)
    assert [(list(rank), said) for rank, said in centrality.centrals(chunks)] == wanted


def test_what_is_said_often_is_central():
    told = ["The supplier shall pay damages for late delivery.", "Birds sing.", "Damages for late delivery are due to the customer.", "Delivery is late after thirty days and the supplier pays."]
    rank, said = central(told, most=9)
    assert min(rank) == rank[1] and "Birds" not in said


def test_summaries_of_whole_texts(spark):
    text = " ".join(some_chunks())
    docs = spark.createDataFrame([(1, text), (2, "One clause. Another clause of the text."), (3, " ")], "doc_id long, text string")
    found = {r["doc_id"]: r["overall_summary"] for r in summarise(docs, summarise_chunks=central_parts, limit=300).collect()}
    assert set(found) == {1, 2} and found[2] == "One clause. Another clause of the text." or "clause" in found[2]
    assert 80 < len(found[1].split()) < len(text.split()) / 3
