"""Trained sentence boundaries, held against a plain version of the whole procedure."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from clausewright.operators.sentences import boundaries, counted, marked, train

TOKEN = re.compile(r"[^ \t\n\f\r]+[ \t\n\f\r]*")


def plain_token(token):
    core = re.sub(r"^[\"'(\[{]+|[\"')\]}]+$", "", re.sub(r"[ \t\n\f\r]+$", "", token))
    word = re.sub(r"[.,;:!?]+$", "", core).lower()
    word = "##" if re.fullmatch(r"[0-9][0-9.,/-]*", word) else word
    begins = core[:1]
    return {"word": word, "stop": bool(re.search(r"[^.!?]\.$", core)), "ends": core[-1:] in tuple(".!?"), "loud": core[-1:] in tuple("!?"), "upper": begins.isupper(), "lower": begins.islower()}


def ratio(k, n1, n2, n):
    like = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)
    rest = (n2 - k) / (n - n1) if n > n1 else 0
    return 2 * (like(k, n1, k / n1) + like(n2 - k, n - n1, rest) - like(k, n1, n2 / n) - like(n2 - k, n - n1, n2 / n))


def letters(word):
    return any(c.isalpha() for c in word)


def plain_model(texts):
    docs = [[plain_token(t) for t in TOKEN.findall(text or "")] for text in texts]
    n, stops, lowers, uppers, pairs = (Counter() for _ in range(5))
    for doc in docs:
        for i, t in enumerate(doc):
            if not t["word"]:
                continue
            n[t["word"]] += 1
            stops[t["word"]] += t["stop"]
            lowers[t["word"]] += t["lower"]
            uppers[t["word"]] += t["upper"] and i > 0 and not doc[i - 1]["ends"]
            if t["stop"] and i + 1 < len(doc) and doc[i + 1]["word"]:
                pairs[t["word"], doc[i + 1]["word"]] += 1
    total, p = sum(n.values()), sum(stops.values()) / max(sum(n.values()), 1)
    short = {}
    for w, k in stops.items():
        if k and letters(w):
            size = len(w.replace(".", ""))
            found = 2 * (k * math.log(0.99 / p) + (n[w] - k) * math.log(0.01 / (1 - p)) if n[w] > k else k * math.log(0.99 / p))
            score = found * math.exp(-size) * (w.count(".") + 1) * size ** -(n[w] - k)
            if score >= 0.3:
                short[w] = score
    together = {(a, b) for (a, b), k in pairs.items() if a in short and letters(b) and ratio(k, stops[a], n[b], total) >= 7.88 and k * total > stops[a] * n[b]}
    after = Counter()
    for (a, b), k in pairs.items():
        if a not in short and letters(a) and not (len(a) == 1 and a.isalpha()):
            after[b] += k
    breaks = sum(after.values())
    starts = {b for b, k in after.items() if letters(b) and ratio(k, breaks, n[b], total) >= 30 and k * total > breaks * n[b]}
    return docs, short, together, starts, {w for w in n if lowers[w] and not uppers[w]}


def plain_sentences(texts):
    docs, short, together, starts, small = plain_model(texts)
    out = []
    for text, doc in zip(texts, docs):
        sentences, held = [], ""
        for i, (raw, t) in enumerate(zip(TOKEN.findall(text or ""), doc)):
            held += raw
            later = doc[i + 1] if i + 1 < len(doc) else None
            if later is None or t["loud"]:
                last = True
            elif not t["stop"]:
                last = t["ends"] and later["upper"]
            elif t["word"] == "##":
                last = not later["lower"]
            elif letters(t["word"]) and (t["word"] in short or len(t["word"]) == 1):
                last = (t["word"], later["word"]) not in together and later["upper"] and (later["word"] in starts or later["word"] in small)
            else:
                last = True
            if last:
                sentences.append(re.sub(r"[ \t\n\f\r]+$", "", held))
                held = ""
        out.append(sentences)
    return out


def some_texts():
    choose = random.Random(19)
    words = "the court held that party may not assign this agreement without consent of Acme Smith Jones Monday".split()
    short = ["Dr.", "No.", "Inc.", "e.g.", "art.", "J.", "U.S."]

    def sentence():
        found = [choose.choice(words) if choose.random() < 0.8 else choose.choice(short) for _ in range(choose.randint(3, 12))]
        found = [w if i and found[i - 1] != "No." else str(choose.randint(1, 99)) if i else choose.choice(["The", "This", "However,", "(That"]) for i, w in enumerate(found)]
        return " ".join([*found, choose.choice(words)]) + choose.choice([".", ".", ".", ".", "!", "?", "...", '."', " 12."])

    return ["  " * (i % 2) + choose.choice([" ", "\n", "  "]).join(sentence() for _ in range(choose.randint(0, 12))) for i in range(150)]


def test_learned_boundaries(spark):
    texts = [*some_texts(), None, "", "one", " \n ", "a. b"]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    model = train(docs)
    _, short, together, starts, _ = plain_model(texts)
    assert {r["word"]: r["score"] for r in model.abbreviations.collect()} == pytest.approx(short)
    assert {tuple(r) for r in model.collocations.collect()} == together and {r["word"] for r in model.starters.collect()} == starts
    assert {"dr", "no", "inc", "e.g"} <= set(short) and ("no", "##") not in together and "the" in starts
    got = {r["doc_id"]: (r["sentences"], r["word"]) for r in boundaries(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == [(s, "kept") for s in plain_sentences(texts)]


def test_rows_alike_and_ids_that_repeat(spark):
    model = train(spark.createDataFrame([(t,) for t in some_texts()], "text string"))
    rows = [(1, "See Dr. Smith. The end"), (1, "See Dr. Smith. The end"), (1, "Other words. More"), (None, "A. The one. Two"), (None, None)]
    got = boundaries(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted((r["doc_id"] or 0, r["sentences"]) for r in got) == sorted([(1, ["See Dr. Smith.", "The end"])] * 2 + [(1, ["Other words.", "More"]), (0, ["A.", "The one.", "Two"]), (0, [])])


def test_an_empty_corpus_has_an_empty_model(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = train(docs)
    assert model.abbreviations.count() == model.starters.count() == boundaries(docs, model).count() == 0
    own = boundaries(spark.createDataFrame([(1, "Dr. Smith came. He left! ok")], "doc_id long, text string"), model)
    assert own.first()["sentences"] == ["Dr.", "Smith came.", "He left!", "ok"]


def test_tokens_are_counted_before_they_are_looked_at(spark):
    """equal tokens are one row, whatever is asked of them later; only those with a period keep the next one."""
    docs = spark.createDataFrame([("One two dr. Who! (two) dr. Who",)] * 50 + [(None,), ("",)], "text string").repartition(4)
    found = {(r["token"], r["within"], r["next"]): r["n"] for r in counted(docs).collect()}
    assert found == {("One", False, None): 50, ("two", True, None): 50, ("dr.", True, "Who!"): 50, ("Who!", False, None): 50, ("(two)", False, None): 50, ("dr.", True, "Who"): 50, ("Who", False, None): 50}


def test_only_marks_are_looked_at_and_texts_move_whole(spark):
    """F8: of a text's tokens only those that can end a sentence are asked about, behind the join."""
    docs = spark.createDataFrame([(1, "One two three. Four five six seven? Eight")], "doc_id long, text string")
    assert [[m["at"] for m in r["_marks"]] for r in marked(docs).collect()] == [[2, 6]]
    plan = boundaries(docs, train(docs))._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "Join LeftOuter" in x and "doc_id" in x)
    side = plan.split(join)[1].splitlines()[1]
    assert "_tokens" not in side and "_marks" not in side
