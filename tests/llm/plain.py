"""Plain versions of the operators that several tests hold results against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from clausewright.llm.secrets import RULES


def plain_secrets(text):
    assign = r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    for k, rule in list(enumerate(RULES))[1:]:
        body = "[0-9a-f]+" if rule.kind == "hex" else rule.body
        found += [(m.start(), k, m.end()) for m in re.finditer(body, text) if len(m[0]) >= rule.least]
    return sorted(found)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_contamination(text, items, size=10):
    words = plain_words(text)
    hit, found = set(), set()
    for item, body in items:
        own = plain_words(body)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            window = own[i : i + size]
            for w in range(len(words) - len(window) + 1):
                if words[w : w + len(window)] == window:
                    hit.update(range(w, w + len(window)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed
