"""Column functions and folds: inputs with the results written out, and what holds for any text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import segment


def values(spark, texts, column):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["v"] for r in frame.select("i", column(F.col("text")).alias("v")).orderBy("i").collect()]


def array_values(spark, rows, column):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, parts array<string>")
    return [r["v"] for r in frame.select("i", column(F.col("parts")).alias("v")).orderBy("i").collect()]


def by_document(frame):
    out: dict[int, list] = {}
    for r in frame.orderBy("doc_id", "para_idx").collect():
        out.setdefault(r["doc_id"], []).append(r["text"])
    return out


def check(spark, table, column):
    """table: input to expected result."""
    assert dict(zip(table, values(spark, list(table), column))) == table


def random_texts(seed, parts, n=150, most=25):
    choose = random.Random(seed)
    return ["".join(choose.choice(parts) for _ in range(choose.randint(0, most))) for _ in range(n)]


def solid(text):
    """The text without white space."""
    return "".join(text.split())


def test_clean_extracted(spark):
    table = {"pay   now": "pay now", "one\n \n\n\ntwo": "one\n\ntwo", "  left \n right\t": "left\nright", "a\x00b\x01c": "abc", "": "", "\n\n": ""}
    check(spark, table, T.clean_extracted)
    texts = random_texts(1, ["a", "bc", " ", "  ", "\n", "\t", "\n\n", "é"])
    for before, after in zip(texts, values(spark, texts, T.clean_extracted)):
        assert solid(after) == solid(before)
        assert "  " not in after and "\n\n\n" not in after and all(x == x.strip() for x in after.split("\n"))


def test_clean_ocr(spark):
    table = {
        "l|ne up": "lIne up",
        "c0de red": "cOde red",
        "room 101": "room 101",
        "ab§cd ef¢gh ij©kl": "abScd efcgh ij(c)kl",
        "x\nabc\n..": "abc",
        "Page 12\nreal text": "real text",
        "real text\n- 505 -": "real text",
        "wait..... done": "wait... done",
        "abc-----def": "abcdef",
        "one\ttwo": "one two",
        "bell\x07 rings": "bell rings",
        "": "",
    }
    check(spark, table, T.clean_ocr)


def test_clean_paragraph(spark):
    table = {"Fee , due": "Fee, due", "end.Next": "end. Next", "( a )": "(a)", "two\nlines": "two lines", "far   apart": "far apart", "1.5": "1. 5", "so ; then : this": "so; then: this", "": ""}
    check(spark, table, T.clean_paragraph)
    texts = random_texts(3, ["a", "B2", " ", "\n", ".", ",", "(", ")", ";"])
    for before, after in zip(texts, values(spark, texts, T.clean_paragraph)):
        assert solid(after) == solid(before) and "  " not in after and "\n" not in after and after == after.strip()


def test_heading_predicates(spark):
    texts = ["1. Scope", "PAYMENT TERMS", "(a) item", "IV. Parts", "the parties agree", "We met the payment date", "x " * 13, "", "Section 4", "Governing law and more", "AB cd"]
    assert values(spark, texts, T.is_heading) == [True, True, True, True, True, True, False, False, True, True, False]
    starts = ["1.2 Fees", "(b) x", "X. y", "section 9", "ALL CAPS WORDS here", "A B C", "and so on", "12."]
    assert values(spark, starts, T.is_clause_start) == [True, True, True, True, True, False, False, False]


def test_normalisers(spark):
    assert values(spark, ["Ｎo  Réfund‑s ", None], T.normalise_risk) == ["no refunds", None]
    assert values(spark, ["  A​ b\n c "], T.normalise_clause) == ["A b c"]
    assert values(spark, ["A, b! C_d"], T.lexical) == ["a b c_d"]
    assert values(spark, ["One two. Three! four? Five"], T.sentences) == [["One two.", "Three! four?", "Five"]]
    assert values(spark, ["x" * 205, "y"], T.snippet) == ["x" * 200 + "...", "y"]
    assert values(spark, ["abc def"], lambda c: T.truncate(c, 4)) == ["abc…"]
    assert values(spark, ["termination", "force_of_habit"], T.type_label) == ["Termination", "Force Of Habit"]
    assert values(spark, ["a.PDF", "b.exe", "c"], T.allowed_extension) == [True, False, False]
    assert values(spark, ["../n/x.pdf", "y.docx"], lambda c: T.stored_name(F.lit("id"), c)) == ["id_x.pdf", "id_y.docx"]


def test_confidence_bands(spark):
    rows = spark.createDataFrame([(0.8,), (0.75,), (0.6,), (0.5,), (0.49,)], "c double").select(T.confidence_band(F.col("c")).alias("b")).collect()
    assert [r["b"] for r in rows] == ["high", "high", "medium", "medium", "low"]


LINES = ["alpha beta", "1. Scope of work", "Section 2 fees", "- bullet", "", "", "continued here", "word", "\tindent  x"]


def test_structural_split(spark):
    texts = [
        "alpha beta\ncontinued here",
        "intro line\n1. Scope of work\nmore of it\n\nword",
        "Section 2 fees\n- bullet\n* other\ntail",
        "one\n\n\n\n\ttwo  words",
        "  \n ",
        "",
    ]
    expected = [["alpha beta continued here"], ["intro line", "1. Scope of work more of it", "word"], ["Section 2 fees", "- bullet", "* other tail"], ["one", "two words"], [], []]
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id int, text string")
    got = by_document(segment.split_structural(docs))
    assert [got.get(i, []) for i in range(len(texts))] == expected and 9 not in got
    choose = random.Random(4)
    some = ["\n".join(choose.choice(LINES) for _ in range(choose.randint(0, 12))) for _ in range(60)]
    got = by_document(segment.split_structural(spark.createDataFrame(list(enumerate(some)), "doc_id int, text string")))
    for i, text in enumerate(some):
        parts = got.get(i, [])
        assert " ".join(parts).split() == text.split()
        # A numbered line, a keyword line or a bullet stands at the start of a paragraph only.
        assert sum(text.count(x) for x in ("1. Scope", "Section 2", "- bullet")) == sum(p.startswith(("1. Scope", "Section 2", "- bullet")) for p in parts)


LONG = "this paragraph is long enough to stand alone"


def test_orphans(spark):
    table = [
        (["short", LONG], ["short " + LONG]),
        ([LONG, "short"], [LONG + " short"]),
        (["1. Head", LONG], ["1. Head", LONG]),
        (["one", "two", LONG, LONG], ["one two " + LONG, LONG]),
        (["only"], ["only"]),
        ([LONG, "Section 3", "tail"], [LONG, "Section 3 tail"]),
        # Two orphans that are long enough together join nothing else.
        (["twenty characters ok", "and twenty more of it", LONG], ["twenty characters ok and twenty more of it", LONG]),
        ([], []),
    ]
    assert array_values(spark, [t[0] for t in table], segment.merge_orphans) == [t[1] for t in table]
    choose = random.Random(5)
    rows = [[choose.choice(["short", "1. Head", LONG, "Section 3", "a bit longer but no head"]) for _ in range(choose.randint(1, 8))] for _ in range(80)]
    for before, after in zip(rows, array_values(spark, rows, segment.merge_orphans)):
        assert " ".join(after) == " ".join(before)
        assert all(len(p) >= 40 or p.startswith(("1. Head", "Section 3")) for p in after) or len(after) == 1


def test_clause_chunks(spark):
    first, second = "the first long part, over thirty", "the second long part, over thirty"
    table = {
        f"{first}\n\ntiny\n\n\n{second}": [first, second],
        f"{first}\n{second}\nshort": [first, second],
        first: [first],
        f"{first}\n\ntiny": [first],
        "tiny": [],
        "": [],
        "y" * 500: ["y" * 500],
        "z" * 2000: ["z" * 900, "z" * 900, "z" * 200],
    }
    check(spark, table, segment.clause_chunks)
    texts = ["word " * 1000, "some longer words in between " * 70]
    for text, chunks in zip(texts, values(spark, texts, segment.clause_chunks)):
        assert " ".join(chunks) == text.strip() and all(30 < len(c) <= 900 for c in chunks)
        assert all(len(c) > 450 for c in chunks[:-1])


def sentence(name, n):
    """n words, the first with a capital, the last with a full stop."""
    return " ".join([name.upper(), *(f"{name}{i}" for i in range(2, n)), f"{name}{n}."])


def test_overlap_chunks(spark):
    a, b, c, long = sentence("a", 60), sentence("b", 60), sentence("c", 60), sentence("d", 250)
    last = lambda s, n=50: " ".join(s.split()[-n:])
    pieces = [" ".join(long.split()[i : i + 100]) for i in (0, 100, 200)]
    table = {
        sentence("a", 30) + " " + sentence("b", 30): [sentence("a", 30) + " " + sentence("b", 30)],
        f"{a} {b} {c}": [a, f"{last(a)} {b}", f"{last(b)} {c}"],
        f"{a} {long}": [*pieces, a],
        long: pieces,
        "": [],
    }
    check(spark, table, lambda x: segment.overlap_chunks(x, 100))


@pytest.mark.parametrize(
    "kind, table",
    [
        ("extract", {"some words here\nand more\n\ntiny\n\nanother  part": ["some words here and more", "another part"], "": []}),
        ("ocr", {"some words here\nand more\n \ntiny\n\nanother part of it all": ["some words here and more", "another part of it all"], "under twenty": []}),
        ("legacy", {"a\nb\n\n c \n\n": ["a\nb", "c"], " \n ": []}),
        ("legacy_few", {"a\nb\n\nc": ["a", "b", "c"], "a\n\nb\n\nc\n\nd\n\ne\nf": ["a", "b", "c", "d", "e\nf"]}),
        ("blank", {"a\nb\n\n\n\nc": ["a\nb", "c"], "": []}),
    ],
)
def test_simple_splitters(spark, kind, table):
    check(spark, table, lambda c: segment.simple_split(c, kind))


def test_restructure(spark):
    table = [
        (["The fee is due.", "and more is due"], ["The fee is due. and more is due"]),
        (["open end", "Next words here."], ["open end Next words here."]),
        (["The fee is due.", "Next words here."], ["The fee is due.", "Next words here."]),
        (["open end", "(a) one thing"], ["open end", "(a) one thing"]),
        (["open end", "2. Two parts"], ["open end", "2. Two parts"]),
        (["hyphen-", "ated word."], ["hyphen-ated word."]),
        (["Due.", "", "ALL CAPS WORDS HERE"], ["Due.", "ALL CAPS WORDS HERE"]),
        (["spaced , out", "to( the )end"], ["spaced, out to(the) end"]),
    ]
    frame = spark.createDataFrame([(i, j, t) for i, (r, _) in enumerate(table) for j, t in enumerate(r)], "doc_id int, para_idx int, text string")
    got = by_document(segment.restructure(frame))
    assert [got[i] for i in range(len(table))] == [t[1] for t in table]
    choose = random.Random(9)
    bank = ["The fee is due.", "and more is due", "(a) one thing", "open end", "Provided that", "hyphen-", "Next one;", "2. Two parts"]
    rows = [[choose.choice(bank) for _ in range(choose.randint(1, 8))] for _ in range(60)]
    frame = spark.createDataFrame([(i, j, t) for i, r in enumerate(rows) for j, t in enumerate(r)], "doc_id int, para_idx int, text string")
    got = by_document(segment.restructure(frame))
    for i, r in enumerate(rows):
        assert solid("".join(got[i])) == solid("".join(r))
        # Numbered and lettered clauses are never merged into what precedes them.
        assert sum(x in ("(a) one thing", "2. Two parts") for x in r) == sum(x.startswith(("(a) one", "2. Two")) for x in got[i])


def test_quick_classes_hold_the_same_characters(spark):
    """the quicker forms of the classes, against their parts, over all code points but surrogates."""
    from clausewright.functions import text as T

    assert T.SPACE.startswith("[[^!-~]&&[") and T.CONTROLS.startswith("[[^ -~]&&[")
    whole = "".join(chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000)
    row = spark.createDataFrame([(whole,)], "t string")
    for quick, parts in ((T.SPACE, "[" + T.SPACE[len("[[^!-~]&&[") : -1]), (T.CONTROLS, "[" + T.CONTROLS[len("[[^ -~]&&[") : -1])):
        assert row.select(F.regexp_replace("t", quick, "") == F.regexp_replace("t", parts, "")).first()[0]


def test_words_of_cleaned_texts(spark):
    """words of cleaned texts by one split, as words() finds them; blanks that are single spaces already stay."""
    texts = random_texts(7, ["a", "Bc.", " ", "  ", "\t", "\n", "\n\n\n", "\r\n", "é", "\x0b", " ", "…"])
    plain = lambda t: T.strip(T.sub(T.sub(T.sub(F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"\n{3,}", "\n\n"), r"[ \t]+", " "), r"[^\x20-\x7E\n]", " "))
    cleaned = values(spark, texts, T.clean_summary)
    assert cleaned == values(spark, texts, plain)
    assert values(spark, cleaned, T.clean_words) == values(spark, cleaned, T.words) == [t.split() for t in cleaned]


def test_quick_forms_of_paragraph_steps(spark):
    """words, cleaning and clause starts in their quicker forms, against the plain ones."""
    texts = random_texts(11, ["a", "Bc", "DEF GH", "12", ".", ",", ")", "(", " ", "  ", "\t", "\n", "\x1c", " ", "é", "ALL THE WORDS", "ÄÖ"], n=400, most=12) + [chr(c) for c in range(1, 0x3100)]
    plain_words = lambda t: F.filter(F.split(t, f"{T.SPACE}+"), lambda w: w != "")

    def plain_clean(text):
        t = T.sub(F.replace(text, F.lit("\n"), F.lit(" ")), rf"{T.SPACE}+([.,;:)])", "$1")
        t = T.sub(T.sub(t, r"([.,;:)])([A-Za-z0-9])", "$1 $2"), rf"([(]){T.SPACE}+", "$1")
        return T.strip(T.sub(T.sub(t, rf"{T.SPACE}+([)])", "$1"), " +", " "))

    assert values(spark, texts, T.words) == values(spark, texts, plain_words)
    assert values(spark, texts, T.clean_paragraph) == values(spark, texts, plain_clean)
    capitals = [len(w) >= 3 and (f := " ".join(w[:3])).upper() == f != f.lower() and len(f) > 10 for w in values(spark, texts, plain_words)]
    assert any(capitals) and all(got for got, own in zip(values(spark, texts, T.is_clause_start), capitals) if own)
    # Nothing is left that has no compiled form.
    frame = spark.createDataFrame([("a", "b")], "t string, p string").select(T.merges_with(F.col("t"), F.col("p")))
    assert "lambda" not in frame._jdf.queryExecution().optimizedPlan().toString()
