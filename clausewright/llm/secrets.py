"""Operator 1, secret scans: all rules in one minimised automaton, one pass over the bytes of every text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.automaton import Dfa, Parser, determinise, reverse
from clausewright.llm.common import steps, text_bytes, texts


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """body: the expression (at least one byte). prefix: what precedes the secret itself, if the length counts only
    what follows it. least: shorter finds are consumed, then dropped."""

    kind: str
    body: str
    least: int = 0
    prefix: str = ""

    def closed(self):
        """The body's tree with an open-ended run at its end cut to its least length: a text holds a match of the one
        if it holds one of the other, and the combined automaton has no states for runs that cross each other."""
        tree = Parser(self.body).parse()
        if tree[0] == "cat" and tree[1] and tree[1][-1][0] == "rep" and tree[1][-1][3] is None:
            _, item, least, _ = tree[1][-1]
            return ("cat", [*tree[1][:-1], ("rep", item, least, least)])
        return tree


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
_ASSIGN = rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?"""

#: The first three are the contract's; the others are this operator's additions.
RULES = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", 6, _ASSIGN),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24}[0-9a-f]*", 24),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")


class Scanner:
    """Finds the leftmost, longest, non-overlapping matches of each rule, in time linear in the text.

    One pass of the combined automaton tells which rules match at all; nearly all texts need nothing more. For each of
    those rules its mirrored automaton, run once from the end, marks the places where a match begins, and the anchored
    one gives each chosen place its longest end. No place that begins no match is ever walked from.
    """

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = determinise([r.closed() for r in rules], floating=True)
        bodies = [Parser(r.body).parse() for r in rules]
        self.ahead = [determinise([b], floating=False) for b in bodies]
        self.back = [determinise([reverse(b)], floating=True) for b in bodies]
        self.prefix = [determinise([Parser(r.prefix).parse()], floating=False) if r.prefix else None for r in rules]

    def matching(self, data: bytes) -> list[int]:
        """Numbers of the rules that match somewhere."""
        table, accepts, accepting = self.all.next, self.all.accepts, self.all.accepting
        state, found = 0, 0
        for byte in data:
            state = table[state + byte]
            if state >= accepting:
                found |= accepts[state >> 8]
        return [k for k in range(len(self.rules)) if found >> k & 1]

    def starts(self, data: bytes, k: int) -> list[int]:
        """Where matches of a rule begin, in order."""
        table, accepting = self.back[k].next, self.back[k].accepting
        state, found, at = 0, [], len(data)
        for byte in reversed(data):
            at -= 1
            state = table[state + byte]
            if state >= accepting:
                found.append(at)
        return found[::-1]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, in order."""
        out = []
        for k in self.matching(data):
            rule, done = self.rules[k], 0
            for start in self.starts(data, k):
                if start < done:
                    continue
                done = end = longest(self.ahead[k], data, start)
                body = start if self.prefix[k] is None else longest(self.prefix[k], data, start)
                if end - body >= rule.least:
                    out.append((start, k, end))
        return sorted(out)


def longest(dfa: Dfa, data: bytes, start: int) -> int:
    """End of the longest match from `start`, or `start`."""
    table, accepting, dead = dfa.next, dfa.accepting, dfa.dead
    state, end = 0, start
    for i in range(start, len(data)):
        state = table[state + data[i]]
        if state == dead:
            break
        if state >= accepting:
            end = i + 1
    return end


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def text_spans(scan: Scanner, data: bytes) -> list[tuple[int, int, int]]:
    """Like Scanner.spans, in code points."""
    spans = scan.spans(data)
    if not spans or data.isascii():
        return spans
    points = sorted({p for s, _, e in spans for p in (s, e)})
    at, count, place = 0, 0, {}
    for p in points:
        count += len(data[at:p].decode("utf-8", "replace"))
        at = p
        place[p] = count
    return [(place[s], k, place[e]) for s, k, e in spans]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: doc_id, spans array of (kind, start, end) in code points, ends exclusive, ordered by
    start and then by the rules' order. A null text is empty; an empty table gives none; repeated rows give repeated
    results; other columns of docs are not read. Texts of any length are scanned whole, one step at a time in memory and
    in linear time."""

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        kind = [r.kind for r in rules]
        out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in steps(batches):
            rows = [[{"kind": kind[k], "start": s, "end": e} for s, k, e in text_spans(scan, x)] for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, out)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(scan_batches, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each run of overlapping finds in `text` replaced by `mark`, and n_chars (if there) counted anew.
    A null text stays null; all other columns stay as they are."""

    def redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in steps(batches):
            column = batch.schema.get_field_index("text")
            done = []
            for data in batch.column(column).cast(pa.large_binary()).to_pylist():
                parts, at = [], 0
                for start, _, end in scan.spans(data) if data else ():
                    if start >= at:
                        parts += [data[at:start], mark.encode()]
                    at = max(at, end)
                done.append(b"".join([*parts, data[at:]]) if parts else data)
            arrays = list(batch.columns)
            arrays[column] = pa.array(done, pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field(column).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    out = docs.mapInArrow(redact_batches, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined_spans(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of find_secrets: counts of the base kinds, the digest of their spans, and all spans."""
    found = find_secrets(docs)

    def of(*kinds: str) -> F.Column:
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    base = of(*BASE_KINDS)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
