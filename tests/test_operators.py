"""Rules, risk, matching, chat, state, sources and streams."""

from __future__ import annotations

import datetime as dt
import io
import json
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright import rules
from clausewright.corpus import PHRASES, corpus
from clausewright.operators import classify, drafts, learn, match, quality, risk, sessions, summary
from clausewright.sources import files, sinks
from clausewright.streaming import state
from clausewright.tables import table


def paragraphs(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, para_idx int, text string")


def test_rule_literals_are_required():
    """Wherever a rule matches, its literal stands: in the corpus' phrases, and in each rule's plainest match."""
    matched = 0
    for patterns in rules.CLAUSE_PATTERNS.values():
        for p in patterns:
            for found in re.finditer(p, " ".join(PHRASES), re.I):
                matched += 1
                assert rules.required_literal(p) in found[0].lower(), p
    assert matched > 60


def test_detection_against_a_plain_loop(spark):
    choose = random.Random(1)
    words = ["term", "Payment", "fees", "shall pay", "trade secret", "jurisdiction", "between", "and", "within", "30 days", "license", "as is", "ſecret", "x", "\n", "laws of"]
    texts = [" ".join(choose.choice(words) for _ in range(choose.randint(0, 14))) for _ in range(150)] + [*PHRASES, None, ""]
    got = classify.detect_clauses(paragraphs(spark, texts)).orderBy("para_idx").collect()
    for text, r in zip(texts, got):
        scores = {c: sum(len(re.findall(p, text or "", re.I)) for p in ps) for c, ps in rules.CLAUSE_PATTERNS.items()}
        total = sum(scores.values())
        assert r["label"] == (max(scores, key=lambda c: scores[c]) if total else "other"), text
        assert r["confidence"] == pytest.approx(max(scores.values()) / total if total else 0.0, abs=1e-4)


def test_hybrid_methods(spark):
    ruled = spark.createDataFrame([(1, 0, "parties", 0.9), (1, 1, "parties", 0.4), (1, 2, "parties", 0.6)], "doc_id int, para_idx int, label string, confidence double")
    learned = spark.createDataFrame([(1, 0, "other", 0.99), (1, 1, "termination", 0.5), (1, 2, "termination", 0.5)], "doc_id int, para_idx int, ml_label string, ml_confidence double")
    got = classify.hybrid(ruled, learned).orderBy("para_idx").collect()
    assert [(r["label"], r["method"]) for r in got] == [("parties", "rule_based"), ("termination", "ml_fallback"), ("parties", "rule_based_low_confidence")]
    assert classify.cascade(ruled, lambda unsure: unsure.join(learned, ["doc_id", "para_idx"])).orderBy("para_idx").collect() == got


def test_page_numbers_and_groups(spark):
    found = classify.structured(paragraphs(spark, ["The fee is due.", " ", "Binding arbitration applies."]), spark.createDataFrame([(1, 0, 3)], "doc_id int, para_idx int, page_number int"))
    assert [(r["para_idx"], r["page_number"]) for r in found.orderBy("para_idx").collect()] == [(0, 3), (2, None)]
    assert {r["clause_type"]: len(r["clauses"]) for r in classify.grouped(found).collect()} == {"payment_fees": 1, "dispute_resolution": 1}


def test_fallback_to_rules(spark):
    of = lambda rows: spark.createDataFrame(rows, "doc_id int, label string, confidence double")
    got = classify.with_fallback(of([(1, "other", 0.0), (2, "parties", 0.5), (2, "other", 0.0)]), of([(1, "termination", 1.0), (2, "termination", 1.0)])).collect()
    assert sorted((r["doc_id"], r["classifier"]) for r in got) == [(1, "rules"), (2, "model"), (2, "model")]


def test_risk_rules(spark):
    texts = ["This right is perpetual and irrevocable.", "This  RIGHT is perpetual and irrevocable.", "Clean text.", "A penalty of 5 applies.", "No refunds."]
    table_ = risk.rule_table(spark)
    found = risk.risk_matches(paragraphs(spark, texts), table_)
    rows = [(r["para_idx"], r["severity"], r["matched_phrase"], r["hits"]) for r in found.orderBy("para_idx").collect()]
    assert rows == [(0, "HIGH", "irrevocable", 2), (3, "MEDIUM", "penalty of", 1), (4, "HIGH", "no refund", 2)]
    report = risk.risk_report(paragraphs(spark, texts), found).first()
    assert (report["total_paragraphs"], report["risky_paragraph_count"], report["risk_score"], report["risk_level"]) == (5, 3, 2.67, "Low Risk")
    assert risk.risk_report(paragraphs(spark, ["Clean text."]), risk.risk_matches(paragraphs(spark, ["Clean text."]), table_)).first()["risk_score"] == 0
    fewer = risk.disable_category(table_, "Penalty Clauses")
    assert risk.risk_matches(paragraphs(spark, texts), fewer).count() == 2
    more = risk.add_rule(fewer, "Custom", "LOW", ["right"], whole_word=True)
    assert risk.risk_matches(paragraphs(spark, ["Rights matter", "my right"]), more).select("para_idx", "severity").collect() == [(1, "LOW")]
    parsed = json.loads(risk.report_json(risk.risk_report(paragraphs(spark, texts), found), found).first()["report"])
    assert [x["severity"] for x in parsed["risks_detected"]] == ["HIGH", "HIGH", "MEDIUM"]


def test_comparison_statuses(spark):
    a = paragraphs(spark, ["The fee is due within 30 days.", "The fee is  due within 30 days.", "Old clause about parking cars here.", "Either party may terminate this agreement on notice."])
    b = paragraphs(spark, ["The fee is due within 30 days.", "Either party may terminate this agreement on written notice.", "Something entirely new stands at this place."])
    changes = match.compare(a, b)
    got = sorted((r["status"], r["idx_a"], r["idx_b"]) for r in changes.filter("status <> 'added'").collect())
    assert got == [("identical", 0, 0), ("modified", 2, 1), ("removed", 1, None)]
    assert [r["clause_b"] for r in changes.filter("status = 'added'").collect()] == ["Something entirely new stands at this place."]
    assert match.change_summary(changes).first()["change_summary"] == "1 clause(s) added. 1 clause(s) removed. 1 clause(s) modified. 1 clause(s) unchanged or similar."
    assert match.compare(a, b.filter("false")).select("status").distinct().collect() == [("removed",)]


def test_blocked_search_is_exact(spark, small):
    vectors = table(spark, small, "embeddings").limit(60)
    asked = vectors.filter("vec_id % 20 = 0")
    one, many = (sorted(map(tuple, match.top_k_blocked(asked, vectors, 4, block_rows=n).collect())) for n in (4096, 7))
    assert one == many and len(one) == 4 * asked.count()


def test_sections_limit_then_dedupe(spark):
    rows = [(1, i, "The buyer shall pay the agreed price today.") for i in range(9)] + [(1, 9, "The seller shall deliver all goods in time."), (1, 10, "Shall pay.")]
    found = summary.sections(spark.createDataFrame(rows, "doc_id int, sentence_no int, sentence string")).collect()
    assert sorted((r["section"], r["position"]) for r in found) == [("obligations", 1), ("payment", 1)]


def test_summaries(spark):
    text = "The buyer shall pay the price within ten days of delivery. Either party may terminate on notice given in writing. Short one."
    docs = spark.createDataFrame([(1, text), (2, " "), (3, None)], "doc_id int, text string")
    rows = summary.summarise(docs).collect()
    assert len(rows) == 1 and rows[0]["overall_summary"] == text and len(rows[0]["key_points"]) == 2 and len(rows[0]["termination"]) == 1
    assert "Obligations" in summary.summary_text(summary.summarise(docs)).first()["report"]


def test_chat_rules(spark):
    messages = ["Please explain Bachan Singh and his fee", "hello", "What about fees?", "zzz", "good morning"]
    frame = spark.createDataFrame(list(enumerate(messages)), "message_id int, message string")
    got = [r["k"] for r in frame.select("message_id", classify.answer_key(F.col("message"), responder=True).alias("k")).orderBy("message_id").collect()]
    assert got == ["bachan_singh", "greeting", "payment", None, "greeting"]
    assert classify.answered(frame).filter("message_id = 3").first()["response"] == rules.FALLBACK_ANSWER
    remote = lambda m: m.select("message_id", F.when(F.col("message_id") == 3, "remote").alias("remote_response"))
    assert classify.answered(frame, remote).filter("message_id = 3").first()["response"] == "remote"
    asked = ["map the clauses and give a summary", "summarise this", "any risks", "compare them", "draft one", "so", " "]
    intents, sure = classify.intent(F.col("m"))
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, m string").select("i", intents.alias("intent"), sure.alias("sure")).orderBy("i").collect()
    assert [r["intent"] for r in rows] == ["CLAUSE_MAP", "SUMMARY", "RISK", "COMPARE", "DRAFT", "GENERAL", "GENERAL"]
    assert [r["sure"] for r in rows[-2:]] == [0.5, 1.0]


def test_context_and_routes(spark):
    rows = [("s", 1, "any risks", None, None), ("s", 2, "hello", None, "text"), ("s", 3, "any risks", None, None), ("s", 4, "summarise", "registered", "pasted"), ("t", 1, "compare", None, "x")]
    got = sessions.routed(sessions.session_context(spark.createDataFrame(rows, "session_id string, ts int, message string, contract_text string, text string"))).orderBy("session_id", "ts").collect()
    assert [r["route"] for r in got] == ["knowledge_base", "knowledge_base", "risk_report", "summarise", "ask_for_two_contracts"] and got[3]["context"] == "registered"


def events(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(u, i, start + dt.timedelta(seconds=s)) for i, (u, s) in enumerate(rows)], "user_id long, event_id long, ts timestamp")


def test_sessions_keep_the_exact_gap(spark):
    got = sessions.sessions(events(spark, [(1, 0), (1, 1800), (1, 3601), (2, 5)])).collect()
    assert sorted(r["n_events"] for r in got) == [1, 1, 2]


def plain_limits(rows, most, seconds):
    kept, out = {}, {}
    for i, (u, s) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        count, start = kept.get(u, (0, None))
        if start is None or s - start > seconds:
            count, start = 0, s
        out[i] = count < most
        kept[u] = (count + out[i], start)
    return out


def test_rate_limits_in_batch_and_stream(spark, tmp_path):
    choose = random.Random(2)
    rows = [(choose.randint(1, 4), choose.randint(0, 600)) for _ in range(300)]
    expected = plain_limits(rows, 3, 60)
    frame = events(spark, rows)
    assert {r["event_id"]: r["allowed"] for r in sessions.rate_decisions(frame, most=3, seconds=60).collect()} == expected
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    run = state.stream_rate_decisions(stream, 3, 60).writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r["event_id"]: r["allowed"] for r in spark.table("limits").collect()} == expected


def test_streams_agree_with_batch(spark, small, tmp_path):
    frame = table(spark, small, "events").select("event_id", "ts", "user_id", "event_type", "value")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, stream_of, batch in (("tumbling", state.stream_tumbling, sessions.tumbling), ("sliding", state.stream_sliding, sessions.sliding), ("sessions", state.stream_sessions, sessions.sessions)):
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        run = stream_of(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination()
        got, expected = set(map(tuple, spark.table(name).collect())), set(map(tuple, batch(frame).collect()))
        assert got <= expected and len(got) >= 0.9 * len(expected)


def test_histories_stream(spark, small, tmp_path):
    messages = table(spark, small, "conversations").select("conv_id", "turn", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")).alias("ts"))
    messages.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
    run = state.stream_histories(stream, 3).writeStream.format("memory").queryName("histories").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    last = sessions.recent_messages(messages, 3).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    assert sorted(map(tuple, spark.table("histories").collect())) == sorted(map(tuple, last.collect()))


def test_idle_histories_are_forgotten(spark, tmp_path):
    at = lambda conv, turn, seconds: (conv, turn, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds))
    batches = [[at(1, 1, 0), at(1, 2, 10)], [at(2, 1, 3000)], [at(2, 2, 3001)], [at(1, 3, 3100)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "conv_id long, turn long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema("conv_id long, turn long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = state.stream_histories(stream, 3, late="1 second").writeStream.format("memory").queryName("forgotten").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = sorted(map(tuple, spark.table("forgotten").collect()))
    assert (1, [1, 2]) in rows and (1, [3]) in rows and (2, [1, 2]) in rows


def test_task_states(spark):
    frame = spark.createDataFrame([("SUCCESS", 0), ("odd", 2), ("STARTED", 3)], "s string, n int")
    got = frame.select(sessions.shown_state(F.col("s")).alias("s"), sessions.retry_delay(F.col("n")).alias("d")).collect()
    assert [(r["s"], r["d"]) for r in got] == [("completed", 5), ("pending", 20), ("processing", None)]


def test_dataset_issues(spark):
    law = json.dumps({"prompt": "Under Act A: who pays?", "completion": {"law": "Act B", "sections": ["1"], "analysis": "one two three four five six"}})
    clean = json.dumps({"prompt": "Under Act A: who delivers?", "completion": {"law": "act a", "sections": ["1"], "analysis": "one two three four five six"}})
    lines = ["{broken", "", '{"prompt": " ", "completion": "one two three four five six seven eight"}', '{"prompt": "p", "completion": ""}', '{"prompt": "P  q", "completion": null}', '{"prompt": "p Q", "completion": "a b c d e f g h"}', law, clean, '{"prompt": "a cheque bounced", "completion": "a b c d e f g h"}']
    frame = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, raw string")
    got = sorted((r["line_no"], r["code"]) for r in quality.dataset_issues(frame).collect())
    assert got == [(1, "malformed_json"), (3, "missing_prompt"), (4, "missing_completion"), (5, "duplicate_prompt"), (5, "short_completion"), (7, "law_mismatch"), (9, "scenario_law_suspicious")]
    with pytest.raises(ValueError, match="line 1: malformed_json"):
        quality.require_clean(quality.dataset_issues(frame))
    quality.require_clean(quality.dataset_issues(frame.filter("line_no = 8")))


def docx(parts, rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cells = "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    body = "".join(map(para, parts)) + (f"<w:tbl>{cells}</w:tbl>" if rows else "")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return held.getvalue()


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["First paragraph of this.", " ", "Second paragraph here."], [["x", "", "y"]]))
    (tmp_path / "b.PDF").write_bytes(b"one page of plain text that is long enough to be digital, and goes on for some more words so that the mean is high")
    (tmp_path / "c.pdf").write_bytes(b"scan")
    found = files.scan_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.extract_documents(found, lambda c: iter([(1, c.decode())]), lambda c: iter([(1, "recognised text of the page")])).collect()}
    assert got["a.docx"]["raw_text"] == "First paragraph of this.\n\nSecond paragraph here.\n\nx | y" and got["a.docx"]["num_pages"] == 0 and got["a.docx"]["source_type"] == "docx"
    assert got["a.docx"]["paragraphs"] == ["First paragraph of this.", "Second paragraph here."]
    assert got["b.PDF"]["source_type"] == "digital" and got["c.pdf"]["source_type"] == "scanned" and got["c.pdf"]["raw_text"] == "recognised text of the page"
    (tmp_path / "d.exe").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported file"):
        files.extract_documents(files.scan_files(spark, str(tmp_path))).collect()


def test_training_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('text,label\n" pay now ",payment_terms\n,other\nx,unknown\n')
    assert files.read_training_csv(spark, str(tmp_path / "t.csv")).collect() == [("pay now", "payment_terms")]
    (tmp_path / "u.csv").write_text("words,label\na,other\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.read_training_csv(spark, str(tmp_path / "u.csv"))
    (tmp_path / "t.jsonl").write_text('{"prompt": "a", "completion": "b"}\n\n{bad\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "t.jsonl"))
    assert (good.count(), bad.count()) == (1, 1)
    assert [r["line_no"] for r in files.read_numbered_lines(spark, str(tmp_path / "t.jsonl")).collect()] == [1, 2, 3]


def test_sinks(spark, tmp_path):
    uploads = spark.createDataFrame([("c1", "../x/a.pdf", b"abc"), ("c2", "b.docx", b"")], "contract_id string, name string, content binary")
    records = sinks.store_uploads(uploads, str(tmp_path / "u")).orderBy("contract_id").collect()
    assert [(r["file_path"], r["file_size_bytes"]) for r in records] == [("c1_a.pdf", 3), ("c2_b.docx", 0)]
    assert sinks.delete_uploads(spark, str(tmp_path / "u"), ["c1", "none"], str(tmp_path / "v")).count() == 1
    sinks.write_lines(sessions.event_log(records and uploads.select("contract_id", "name"), ["contract_id", "name"]), str(tmp_path / "log"))
    assert sorted(json.loads(r["value"])["contract_id"] for r in spark.read.text(str(tmp_path / "log")).collect()) == ["c1", "c2"]


def test_learning(spark, small):
    rows = classify.detect_clauses(corpus(spark, small)).filter("label IN ('termination', 'payment_fees', 'confidentiality')").select("doc_id", "para_idx", "text", "label")
    split = learn.stratified_split(rows.withColumn("key", F.concat_ws("-", "doc_id", "para_idx")), "key", "label")
    for r in split.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("t")).collect():
        assert r["t"] == -(-r["n"] * 8 // 10)
    predict = learn.train(split.filter("split = 'train'").select("text", "label"))
    got = learn.metrics(learn.confusion(predict(split.filter("split = 'test'").select("text", "label")), "label", "ml_label")).first()
    assert got["accuracy"] > 0.95
    assert learn.no_model(rows).select("ml_label").distinct().collect() == [("other",)]
    import numpy as np

    flat = learn.predict_with(rows.limit(20), lambda texts: np.zeros((len(texts), 12)))
    assert flat.select("ml_label").distinct().collect() == [("other",)]
    with pytest.raises(Exception, match="unknown label"):
        learn.encode_labels(spark.createDataFrame([("zzz",)], "label string")).collect()


def test_drafts(spark):
    row = drafts.drafts(spark.createDataFrame([("A", " ", "now")], "party_a string, party_b string, date string"), "nda").first()
    assert row["draft"] == "NON-DISCLOSURE AGREEMENT between A and [Party B], effective now. Each party keeps the other's confidential information secret for [Duration]."
    assert sessions.search_landmarks(sessions.landmark_cards(spark), "smoke BALL").count() == 1
    assert sessions.search_landmarks(sessions.landmark_cards(spark), "field: torts").count() == 1
    saved = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert drafts.without(saved, "a").collect() == [("b", 2)]


def test_plain_language(spark):
    text = "The buyer shall pay the price within ten days of delivery. Either party may terminate on notice given in writing. A third sentence ends the text of this."
    rows = summary.explained(summary.summarise(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    first = rows.first()
    assert first["prompt"] == summary.PLAIN_PROMPT + text and first["explanation"] == "In short: " + ". ".join(text.split(". ")[:2]) + "."
    asked = summary.explained(summary.summarise(spark.createDataFrame([(1, text)], "doc_id int, text string")), lambda prompt: F.concat(F.lit("n="), F.length(prompt).cast("string")))
    assert asked.first()["explanation"] == f"n={len(summary.PLAIN_PROMPT + text)}"
    message = summary.summary_message(rows).first()["message"]
    assert message.startswith(text + "\n\n**Key points**\n- The buyer") and message.endswith("in writing.") and "**In plain language**" in message
    assert summary.summary_message(spark.createDataFrame([(1, " ", [], "")], "doc_id int, summary string, key_points array<string>, explanation string")).first()["message"] == ""


def test_wrapped_lines(spark):
    texts = {"one two three four": "one two\nthree\nfour", "extraordinarily a b": "extraordinarily\na b", "": ""}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", summary.wrapped(F.col("t"), 8).alias("w")).collect()
    assert dict(map(tuple, got)) == texts


def test_risk_service(spark):
    texts = ["The Supplier accepts unlimited liability.", "A penalty of 5 applies.", "A penalty of 9 applies."]
    found = risk.risk_matches(paragraphs(spark, texts), risk.rule_table(spark))
    row = risk.service_report(risk.risk_report(paragraphs(spark, texts), found), found).first()
    assert row["explanation"] == rules.CATEGORY_NOTES[0][1] + "\n\n" + rules.OTHER_NOTE.replace("{category}", "penalty clauses")
    assert (row["risky_count"], row["total_paragraphs"]) == (1, 3)
    clean = risk.risk_matches(paragraphs(spark, ["Clean."]), risk.rule_table(spark))
    assert risk.service_report(risk.risk_report(paragraphs(spark, ["Clean."]), clean), clean).first()["explanation"] == rules.NO_RISK_NOTE
    told = risk.risk_matches(paragraphs(spark, texts), risk.rule_table(spark), explain=lambda rows: F.upper(rows["matched_phrase"]))
    assert {r["explanation"] for r in told.collect()} == {"UNLIMITED LIABILITY", "PENALTY OF"}


def test_comparison_answers(spark):
    of = lambda rows: spark.createDataFrame(rows, "doc_id int, text string")
    a = of([(1, "1. The fee is due within 30 days.\n2. Old clause about parking cars here."), (2, "1. Same.")])
    b = of([(1, "1. The fee is due within 30 days.\n2. Something entirely new stands at this place."), (2, "1. Same.")])
    changes = match.compare_texts(a, b)
    rows = {r["doc_id"]: r for r in match.response(changes, a.unionByName(of([(3, "x")]))).collect()}
    assert rows[1]["added_clauses"] == ["2. Something entirely new stands at this place."]
    assert [(x["clause_a"], x["clause_b"], x["status"]) for x in rows[1]["removed_clauses"]] == [("2. Old clause about parking cars here.", None, "removed")]
    assert [x["status"] for x in rows[1]["similar_clauses"]] == ["identical"] and rows[1]["modified_clauses"] == []
    assert [rows[3][c] for c in ("added_clauses", *match.RESPONSE)] == [[], [], [], []]
    assert "[added] - -> 2. Something" in match.report(changes.filter("doc_id = 1"), "text").first()["report"]
    assert json.loads(match.report(changes.filter("doc_id = 2"), "dict").first()["report"])["similar_clauses"][0]["clause_a"] == "1. Same."
    assert match.report(changes, "report").count() == 2
    with pytest.raises(ValueError, match="output format"):
        match.report(changes, "pdf")


def test_blocks_give_the_same_pairs(spark, small, monkeypatch):
    vectors = table(spark, small, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").cast("int").alias("idx"), F.col("embedding").alias("vector"))
    a, b = vectors.filter("idx % 2 = 0"), vectors.filter("idx % 2 = 1")
    whole = [sorted(map(tuple, f.collect())) for f in (match.similarities(a, b), match.best(a, b), match.top_k(a, b, 3))]
    monkeypatch.setattr(match, "BLOCK_ROWS", 3)
    assert [sorted(map(tuple, f.collect())) for f in (match.block_similarities(match_rows(a, 3), match_rows(b, 3)), match.best(a, b), match.top_k(a, b, 3))] == whole
    wide = match.matrix(match.similarities(a, b), 4)
    assert wide.columns == ["doc_id", "idx_a", "0", "1", "2", "3"]


def match_rows(clauses, rows):
    return clauses.repartition(rows)


def test_all_pairs_are_dealt_out_and_take_few_bytes(spark, tmp_path):
    """a contract's pairs are the work of several tasks, whole and right, and a file of them holds under six bytes a
    pair (eight for each value, before they were put in order)."""
    made = np.random.default_rng(12).normal(size=(2400, 8))
    made = (0.3 * made / np.linalg.norm(made, axis=1, keepdims=True)).astype(np.float32)
    held = spark.createDataFrame([(7, i * 20 + i % 2, v.tolist()) for i, v in enumerate(made)], "doc_id int, idx int, vector array<float>")
    pairs = match.similarities(held.filter("idx % 2 = 0"), held.filter("idx % 2 = 1"))
    pairs.write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 6 * 1200 * 1200
    own = spark.read.parquet(str(tmp_path / "pairs")).toPandas()
    wanted = np.round(made[::2].astype(np.float64) @ made[1::2].astype(np.float64).T, 6)
    got = np.full(wanted.shape, np.nan)
    got[own["idx_a"] // 40, own["idx_b"] // 40] = own["similarity"]
    assert len(own) == wanted.size and (np.abs(got - wanted) < 1.5e-6).all() and set(own["doc_id"]) == {7}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = match.similarities(held.filter("idx % 2 = 0"), held.filter("idx % 2 = 1")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == wanted.size


def test_embedding_with_a_model(spark):
    clauses = spark.createDataFrame([(1, 0, "abc"), (1, 1, "")], "doc_id int, idx int, clause string")
    got = match.embed_with(clauses, lambda texts: [[len(t) * 3.0, len(t) * 4.0] for t in texts]).orderBy("idx").collect()
    assert [round(x, 4) for x in got[0]["vector"]] == [0.6, 0.8] and list(got[1]["vector"]) == [0.0, 0.0]


def test_comparable_requests(spark):
    known = spark.createDataFrame([("a",), ("b",)], "contract_id string")
    asked = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "z")], "id_a string, id_b string")
    assert [r["problem"] for r in match.comparable(asked, known).orderBy("id_b").collect()] == ["same_contract", None, "unknown_contract"]


def test_contract_texts(spark):
    contracts = spark.createDataFrame([("a", "text")], "contract_id string, text string")
    got = sessions.contract_text(spark.createDataFrame([("a",), ("z",)], "contract_id string"), contracts).orderBy("contract_id").collect()
    assert [r["text"] for r in got] == ["text", None]


def test_prompts_and_numbered_lines(spark, tmp_path):
    rows = quality.prompt_text(spark.createDataFrame([("q", "a")], "prompt string, completion string"))
    assert rows.first()["training_text"] == "### Instruction:\nq\n\n### Response:\na"
    text = "\n".join(f"line {i}" for i in range(2000))
    (tmp_path / "lines.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = files.read_numbered_lines(spark, str(tmp_path / "lines.txt")).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["line_no"], r["raw"]) for r in got] == [(i + 1, f"line {i}") for i in range(2000)]


def test_pages_one_by_one(spark):
    layer = spark.createDataFrame([("a", 1, "a text layer that is long enough to stand"), ("a", 2, "short"), ("a", 3, " "), ("a", 4, "")], "path string, page_no int, text string")
    read = spark.createDataFrame([("a", 1, "other"), ("a", 2, "read by the recogniser"), ("a", 3, "")], "path string, page_no int, text string")
    got = files.chosen_pages(layer, read).orderBy("page_no").collect()
    assert [(r["page_no"], r["text"]) for r in got] == [(1, "a text layer that is long enough to stand"), (2, "read by the recogniser")]


def test_image_steps(spark):
    images = spark.createDataFrame([("a", 1, b"x"), ("a", 2, b"y")], "path string, page_no int, content binary")
    angles = spark.createDataFrame([("a", 1, i, float(a)) for i, a in enumerate((1, 2, 9))] + [("a", 2, 0, 0.2)], "path string, page_no int, line_no int, angle double")

    def broken(image):
        raise ValueError

    steps = {"grayscale": lambda c: c + b"g", "denoise": broken, "threshold": lambda c: c + b"t", "deskew": lambda c, a: c + str(a).encode()}
    content = lambda f: [bytes(r["content"]) for r in f.orderBy("page_no").collect()]
    assert content(files.cleaned_images(images, steps, angles=angles)) == [b"xgt2.0", b"ygt"]
    assert content(files.cleaned_images(images, steps, off=("grayscale", "deskew"), angles=angles)) == [b"xt", b"yt"]
    assert [r["angle"] for r in files.median_angle(angles).orderBy("page_no").collect()] == [2.0, 0.0]


def test_model_files(spark, small, tmp_path):
    rows = classify.detect_clauses(corpus(spark, small)).filter("label IN ('termination', 'confidentiality')").select("text", "label")
    predict = learn.train(rows)
    sinks.save_model(predict.model, learn.metrics(learn.confusion(predict(rows), "label", "ml_label")), str(tmp_path))
    from pyspark.ml import PipelineModel

    assert len(PipelineModel.load(str(tmp_path / "model")).stages) == 7 and spark.read.json(str(tmp_path / "metrics")).first()["accuracy"] > 0.9


def test_registry_ties(spark):
    uploads = spark.createDataFrame([("c", "a.pdf", 1), ("c", "b.pdf", 1)], "contract_id string, name string, uploaded_at int")
    for frame in (uploads, uploads.orderBy(F.desc("name"))):
        assert sessions.registry(frame).first()["name"] == "b.pdf"


def test_pages_as_a_table_function(spark):
    def decoder(content):
        if content == b"bad":
            raise ValueError
        return ((i, p) for i, p in enumerate(content.decode().split("|"), 1))

    spark.udtf.register("pages_of_file", files.page_table(decoder))
    spark.createDataFrame([("a", b"x|y"), ("b", b"bad")], "path string, content binary").createOrReplaceTempView("held_files")
    rows = spark.sql("SELECT path, page_no, text FROM held_files, LATERAL pages_of_file(content)").collect()
    assert sorted(map(tuple, rows)) == [("a", 1, "x"), ("a", 2, "y")]


def test_words_become_vectors_within_blocks(spark):
    """words stand for clauses until their block is met, and give what their vectors give; contracts leave together."""
    rows = [(d, i, f"Clause {i * d} of the term {i}, né {d}.") for d in range(40) for i in range(5)]
    named = spark.createDataFrame(rows + [(1, 5, "...")], "doc_id int, idx int, clause string")
    by_words, by_vectors = (sorted(map(tuple, match.similarities(x, x).collect())) for x in (match.worded(named), match.embed(named)))
    assert by_words == by_vectors and len(by_words) == 39 * 25 + 36
    assert {s for d, i, j, s in by_words if i == j} == {1.0, 0.0}


def test_revision_is_one_pass(spark, small):
    """kept and added paragraphs come from one read of the paragraphs, which are those of the shared SQL."""
    from clausewright.corpus import CORPUS_SQL, revised

    plan = revised(corpus(spark, small))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "Union" not in plan
    for name in ("orders", "customer"):
        table(spark, small, name).createOrReplaceTempView(name)
    assert sorted(map(tuple, corpus(spark, small).collect())) == sorted(map(tuple, spark.sql(CORPUS_SQL).collect()))


def test_summaries_split_a_text_once(spark):
    """a contract's sentences are found once for its sections and chunks, and no section pattern runs as an expression."""
    docs = spark.createDataFrame([(1, "The fee is due within ten days.  Both parties shall keep\tall papers of this work.\n\n\nEither party may terminate at once.")], "doc_id int, text string")
    rows = summary.summarise(docs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.!?])") == 2 and "RLIKE" not in plan
    first = rows.first()
    assert first["obligations"] == ["Both parties shall keep all papers of this work."] and first["payment_terms"] == ["The fee is due within ten days."] and first["termination"] == ["Either party may terminate at once."] and first["risks"] == []
    assert all(set(w) <= set("abcdefghijklmnopqrstuvwxyz ") for own in summary.SECTION_WORDS.values() for w in own)


def test_rules_begin_where_words_do(spark):
    """every rule's match begins with its first word, which the one pass finds; unanchored rules are always asked."""
    assert rules.first_word(r"\brefers? to\b") == "refer" and rules.first_word(r"\bfee[s]?\b") == "fee" and rules.first_word(r"\bIP rights?\b") == "ip"
    assert rules.first_word(r"fee") == "" and rules.first_word(r"\bfee\b|\bcost\b") == "" and rules.first_word(r"\b(?:a|b)") == ""
    assert rules.shortest_starts(["as", "assign", "term"]) == {"as": "as", "assign": "as", "term": "term"}
    texts = ["Kfees as is", "the FEE, a-fee; xfee fee", "ſecret Keep confidential", "_fee 1fee éfee -fee", "assigns as used herein", "İP rights ip right", None, ""]
    patterns = {"a": (r"\bfee[s]?\b", r"\bas is\b", r"\bkeep confidential\b"), "b": (r"\bsecret\b", r"\bIP rights?\b", r"fee"), "c": (r"\bas used (in|herein)\b",)}
    got = classify.clause_scores(paragraphs(spark, texts), patterns).orderBy("para_idx").collect()
    assert [tuple(r[f"score_{c}"] for c in patterns) for r in got] == [tuple(sum(len(re.findall(p, t or "", re.I)) for p in ps) for ps in patterns.values()) for t in texts]
    plan = classify.clause_scores(paragraphs(spark, texts))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?<![a-z])" in plan and "_rule_" not in plan
