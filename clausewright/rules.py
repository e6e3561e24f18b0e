"""Rule sets as data. The tables below are fixed values: detection results depend on every entry and on their order."""

from __future__ import annotations

import re

# Clause classes in tie-break order, each with its expressions (matched ignoring case).
CLAUSE_PATTERNS: dict[str, tuple[str, ...]] = {
    "definitions": (r"\bdefinition[s]?\b", r"\bmeaning\b", r"\bmeans\b", r"\bshall mean\b", r"\binterpreted as\b", r"\brefers? to\b", r"\bhereinafter\b", r"\bas used (in|herein)\b", r"\bfor purposes of\b", r"\binclude[s]? but (?:is|are) not limited to\b"),
    "parties": (r"\bparties\b", r"\bparty\b", r"\bclient\b", r"\bvendor\b", r"\bcontractor\b", r"\bsupplier\b", r"\bcustomer\b", r"\bpurchaser\b", r"\bseller\b", r"\blessor\b", r"\blessee\b", r"\blicensor\b", r"\blicensee\b", r"\bbetween.*and\b", r"\bhereinafter referred to as\b"),
    "term_duration": (r"\bterm\b", r"\bduration\b", r"\beffective date\b", r"\bcommencement\b", r"\bexpiration\b", r"\brenewal\b", r"\bextension\b", r"\bperiod of\b", r"\bshall remain in effect\b", r"\bcontinue for\b", r"\bvalid for\b", r"\byear[s]?\b", r"\bmonth[s]?\b"),
    "termination": (r"\btermination\b", r"\bterminate\b", r"\bcancellation\b", r"\bcancel\b", r"\bend this agreement\b", r"\bcessation\b", r"\bdiscontinue\b", r"\bwithout cause\b", r"\bfor cause\b", r"\bnotice of termination\b", r"\bupon termination\b", r"\beffect of termination\b", r"\bmay terminate\b"),
    "payment_fees": (r"\bpayment\b", r"\bfee[s]?\b", r"\bcompensation\b", r"\bremuneration\b", r"\bcost[s]?\b", r"\bprice\b", r"\bamount\b", r"\binvoice\b", r"\bbilling\b", r"\bshall pay\b", r"\bpayable\b", r"\bdue and payable\b", r"\bwithin.*days\b", r"\blate payment\b", r"\binterest\b"),
    "intellectual_property": (r"\bintellectual property\b", r"\bIP rights?\b", r"\bcopyright\b", r"\btrademark\b", r"\bpatent\b", r"\bproprietary\b", r"\bownership\b", r"\blicense\b", r"\btrade secret\b", r"\bknow-how\b", r"\bwork product\b", r"\bderivative work\b"),
    "confidentiality": (r"\bconfidential\b", r"\bconfidentiality\b", r"\bnon-disclosure\b", r"\bproprietary information\b", r"\btrade secret\b", r"\bsecret\b", r"\bdisclose\b", r"\bdisclosure\b", r"\bnon-public\b", r"\bshall not disclose\b", r"\bkeep confidential\b", r"\bprotect.*information\b"),
    "liability_indemnity": (r"\bliability\b", r"\bliable\b", r"\bindemnif(?:y|ication)\b", r"\bindemnity\b", r"\bhold harmless\b", r"\bdamages\b", r"\bloss(?:es)?\b", r"\bclaim[s]?\b", r"\blimitation of liability\b", r"\bexclusion of liability\b", r"\bshall not be liable\b", r"\bresponsible for\b"),
    "warranties": (r"\bwarrant(?:y|ies)\b", r"\brepresentation[s]?\b", r"\bguarantee\b", r"\brepresents and warrants\b", r"\bdisclaimer\b", r"\bas is\b", r"\bwarranty of merchantability\b", r"\bfitness for (?:a )?particular purpose\b", r"\bno warranty\b", r"\bexpress or implied\b"),
    "dispute_resolution": (r"\bdispute[s]?\b", r"\barbitration\b", r"\bmediation\b", r"\blitigation\b", r"\bresolution\b", r"\bcontroversy\b", r"\bdisagreement\b", r"\bconflict\b", r"\barbitrat(?:e|or)\b", r"\bbinding arbitration\b", r"\bvenue\b", r"\bjurisdiction\b"),
    "governing_law": (r"\bgoverning law\b", r"\bapplicable law\b", r"\bchoice of law\b", r"\bshall be governed\b", r"\bconstrued in accordance\b", r"\bjurisdiction\b", r"\blaws? of\b", r"\bstate of\b", r"\bfederal law\b"),
    "miscellaneous": (r"\bmiscellaneous\b", r"\bgeneral provisions?\b", r"\bentire agreement\b", r"\bseverability\b", r"\bwaiver\b", r"\bamendment\b", r"\bmodification\b", r"\bassignment\b", r"\bforce majeure\b", r"\bnotices?\b", r"\bcounterparts?\b", r"\bheadings?\b"),
}

# Risk rules in order (category, severity, phrases in order), matched as substrings of normalised text.
RISK_RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("Unlimited Liability", "HIGH", ("unlimited liability", "no liability cap", "no cap on liability", "liable for all damages", "liable for any and all", "full liability", "not limited in any way", "without limitation of liability")),
    ("Missing Termination Clause", "MEDIUM", ("no termination", "cannot be terminated", "irrevocable", "perpetual and irrevocable", "no right to terminate", "without the right to cancel", "non-cancellable", "noncancellable")),
    ("One-sided Indemnity", "HIGH", ("indemnify and hold harmless", "indemnify the client", "indemnify the company", "defend against all claims", "defend, indemnify", "hold harmless against all", "indemnify against all losses", "indemnify against any claim", "shall indemnify")),
    ("Payment Risk", "MEDIUM", ("payment due immediately", "immediate payment", "non-refundable", "nonrefundable", "no refund", "no refunds", "advance payment", "upfront payment", "payment in advance", "waives any right to a refund", "all fees are final")),
    ("Jurisdiction Risk", "MEDIUM", ("governed by the laws of", "exclusive jurisdiction", "courts of", "arbitration in", "venue shall be", "subject to the laws of", "dispute resolution in", "laws of a foreign", "international arbitration")),
    ("Confidentiality Risk", "MEDIUM", ("perpetual confidentiality", "indefinite nda", "confidential information shall include all", "disclose to any third party", "broad confidentiality", "no exceptions to confidentiality", "all information is confidential", "without any restrictions on disclosure")),
    ("Intellectual Property Ownership Risk", "HIGH", ("intellectual property shall vest", "all ip owned by", "assigns all rights", "work made for hire", "waives all moral rights", "irrevocably assigns", "ownership of all inventions", "assigns intellectual property", "all developments belong to")),
    ("Penalty Clauses", "MEDIUM", ("liquidated damages", "penalty clause", "pay a penalty", "financial penalty", "punitive damages", "penalty of", "automatic fine", "late payment penalty", "damages for breach")),
)

SEVERITY_WEIGHTS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
#: Raw weight that scores 10.
MOST_RAW_RISK = 30

#: One explanation per risk category; {phrase} stands for the first matched phrase. Own wording.
RISK_TEMPLATES: dict[str, str] = {
    "Unlimited Liability": "'{phrase}' leaves liability without a cap; ask for a limit tied to the contract value.",
    "Missing Termination Clause": "'{phrase}' leaves no clear way to end the contract; ask for exit conditions.",
    "One-sided Indemnity": "'{phrase}' lets one side bear all legal costs; ask for a mutual indemnity.",
    "Payment Risk": "'{phrase}' points to harsh payment terms; check refunds, dates and disputes.",
    "Jurisdiction Risk": "'{phrase}' may place disputes under unfamiliar law; ask for a neutral forum.",
    "Confidentiality Risk": "'{phrase}' may make secrecy too broad or one-sided; check scope and duration.",
    "Intellectual Property Ownership Risk": "'{phrase}' may transfer ownership of created work; state who owns what.",
    "Penalty Clauses": "'{phrase}' sets damages in advance; check that they are in proportion.",
}
GENERIC_TEMPLATE = "The phrase '{phrase}' may carry legal risk and should be reviewed."

# Notes of the risk service by what a category's name holds, the first that does; the keys are fixed values.
CATEGORY_NOTES: tuple[tuple[str, str], ...] = (
    ("liability", "Liability: without a cap one side may owe far more than the contract is worth. Ask for a limit."),
    ("termination", "Termination: check the notice period, and who may leave without a cause."),
    ("confidentiality", "Confidentiality: check what counts as confidential, and for how long."),
    ("indemnification", "Indemnification: a promise to bear all claims should be mutual and limited."),
    ("dispute_resolution", "Disputes: a distant forum or forced arbitration makes claims costly."),
    ("non_compete", "Non-compete: check its time, its area and its trade."),
    ("intellectual_property", "Intellectual property: state who owns earlier work and what is made later."),
    ("force_majeure", "Force majeure: a wide definition may excuse too much."),
    ("payment_terms", "Payment: look for rising prices, late fees and short terms."),
    ("governing_law", "Governing law: foreign law and courts raise the cost of any dispute."),
    ("warranties", "Warranties: check that they are mutual and not all disclaimed."),
)
OTHER_NOTE, NO_RISK_NOTE = "A risk of the kind '{category}' was found. Review it with care.", "No notable legal risk was found in the text."

# Summary sections (unanchored, on lower-cased sentences).
SECTION_PATTERNS: dict[str, str] = {
    "obligations": r"oblig|duty|duties|shall|must provide|must deliver",
    "payment": r"payment|fee|invoice|billing|remunerat|compensation|price|cost",
    "termination": r"terminat|cancell|cancel|end of agreement|expir",
    "risk": r"liabilit|indemnif|risk|penalty|penalt|damag",
}

# Chat intents, first match wins.
INTENT_PATTERNS: tuple[tuple[str, str], ...] = (
    ("CLAUSE_MAP", r"(list|map|identify|show|find|detect)\s+(all\s+)?(the\s+)?(clause|section|provision|article|part)(s|(\s+type))?|what\s+(type|kind)s?\s+of\s+(clause|section|provision)|classify\s+(the\s+)?(contract|document|clauses?)|break\s*down\s+(the\s+)?(clause|section|contract|clauses?)|clause\s+map|map\s+(the\s+)?clauses?"),
    ("SUMMARY", r"summari[sz]e|summary|overview|brief|what\s+does\s+this\s+(contract|agreement)\s+(say|cover)|give\s+me\s+a\s+summary|key\s+points|main\s+points|extract\s+summary|tldr|tl;dr|explain\s+this\s+(contract|document|agreement)\b|break\s+down\s+(this\s+)?(contract|agreement|document|for\s+me)\b"),
    ("RISK", r"\brisk[s]?\b|danger|red\s*flag|flag|vulnerabilit|concern|problematic|liability|indemnit|penalty|risky|warning|issue[s]?|what\s+(are|could\s+be)\s+the\s+(risks?|issues?|problems?)|anything\s+dangerous|safe\s+to\s+sign|should\s+i\s+(sign|worry)"),
    ("COMPARE", r"\bcompar[ei]|differ|diff\b|contrast|versus|vs\.?\b|changes?\s+between|what('s|\s+is)\s+(different|changed|new)|side\s+by\s+side|match"),
    ("DRAFT", r"\bdraft\b|generate\s+(a\s+)?(contract|clause|agreement|nda|terms)|write\s+(a\s+)?(contract|clause|section)|create\s+(a\s+)?(contract|agreement)|template|boilerplate"),
)

# The older, substring form of intents, first match wins.
KEYWORD_INTENTS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("RISK", ("risk", "danger", "flag", "problematic", "liability", "dangerous", "issue")),
    ("SUMMARY", ("summarize", "summary", "summarise", "key points", "overview", "tldr", "brief")),
    ("CLAUSE_MAP", ("clause", "classify", "identify clause", "clause type")),
)

# Question patterns of the offline knowledge base, landmark cases first, first match wins. The answers are
# our own short texts, found by their key.
KNOWLEDGE_PATTERNS: tuple[tuple[str, str], ...] = (
    ("bachan_singh", r"Bachan\s+Singh|1980\s+SCC\s*\(\s*2\s*\)\s*684|rarest\s+of\s+rare"),
    ("arnesh_kumar", r"Arnesh\s+Kumar|\(2014\)\s*8\s*SCC\s*273"),
    ("puttaswamy", r"Puttaswamy|privacy.*fundamental|10\s*SCC\s*1.*2017"),
    ("vishaka", r"Vishaka|POSH|sexual\s+harassment.*workplace"),
    ("carlill", r"Carlill|Carbolic\s+Smoke\s+Ball"),
    ("salomon", r"Salomon|Salomon\s+v\.|veil\s+of\s+incorporation"),
    ("donoghue", r"Donoghue|Stevenson|neighbour\s+principle"),
    ("article_14", r"\bArticle\s*14\b|equality\s+before\s+the\s+law|equal\s+protection"),
    ("article_21", r"\bArticle\s*21\b|life\s+and\s+personal\s+liberty"),
    ("tpa_53a", r"53A|part\s+performance|Transfer\s+of\s+Property"),
    ("greeting", r"\b(hi|hello|hey|greetings)\b"),
    ("identity", r"\bwho\s+are\s+you\b|\bwhat\s+are\s+you\b|your\s+name"),
    ("capabilities", r"\bwhat\s+can\s+you\s+(do|help)\b|your\s+features|capabilities"),
    ("warranty", r"\bwarrant(y|ies)?\b"),
    ("nda", r"\b(nda|non.?disclosure|confidentiality)\b"),
    ("liability", r"\b(liabilit(y|ies)|liable|indemnif)\b"),
    ("termination", r"\btermination?\b|cancel+ation?\b|end\s+the\s+(deal|agreement|contract)\b"),
    ("force_majeure", r"\bforce\s+majeure\b|\bact\s+of\s+god\b"),
    ("governing_law", r"\b(governing\s+law|jurisdiction|arbitration|dispute)\b"),
    ("non_compete", r"\b(non.?compete|non.?solicitation)\b"),
    ("intellectual_property", r"\b(ip|intellectual\s+property|copyright|patent|ownership)\b"),
    ("payment", r"\b(payment|invoice|fees?|salary|compensation)\b"),
    ("thanks", r"\b(thank(s|\s*you)?|thx|ty)\b"),
    ("wellbeing", r"\bhow\s+are\s+you\b"),
)

# The responder's further patterns, tried after the knowledge base.
RESPONDER_PATTERNS: tuple[tuple[str, str], ...] = (
    ("greeting", r"\b(hi|hello|hey|greetings|good\s*(morning|evening|afternoon))\b"),
    ("identity", r"\b(who|what)\s+are\s+you\b|\byour\s+name\b|tell me about yourself"),
    ("warranty", r"\bwarrant(y|ies|s)?\b"),
    ("nda", r"\b(nda|non.?disclosure|confidentiality\s+agreement)\b"),
    ("liability", r"\b(liabilit(y|ies)|liable)\b"),
    ("termination", r"\b(terminat(e|ion|ing)|end\s+the\s+(contract|agreement)|cancell?ation)\b"),
    ("indemnity", r"\bindemni(f(y|ication)|t(y|ies))?\b"),
    ("force_majeure", r"\bforce\s+majeure\b|\bact\s+of\s+god\b"),
    ("governing_law", r"\b(governing\s+law|jurisdiction|arbitration|dispute\s+resolution)\b"),
    ("non_compete", r"\b(non.?compete|non.?solicitation|restraint\s+of\s+trade)\b"),
    ("capabilities", r"\bwhat\s+can\s+you\s+do\b|\byour\s+capabilities\b|\bhelp\s*me\b"),
    ("intellectual_property", r"\b(intellectual\s+property|ip\s+rights|copyright|patent|trademark)\b"),
    ("payment", r"\b(payment|invoice|compensation|fee|rate|salary)\b"),
)
#: Own short answers by key.
ANSWERS: dict[str, str] = {
    "bachan_singh": "Death sentences are constitutional but kept for the rarest of rare cases.",
    "arnesh_kumar": "Arrest is not automatic; police must record why it is necessary.",
    "puttaswamy": "Privacy is a fundamental right; intrusions must be proportionate.",
    "vishaka": "Binding duties of employers against harassment at work, before the statute.",
    "carlill": "A public promise can be an offer that performance accepts.",
    "salomon": "A company is a person apart from its members; lifting the veil is exceptional.",
    "donoghue": "Care is owed to those whom one can foresee to harm.",
    "article_14": "Equality before the law and equal protection of the laws.",
    "article_21": "Life and personal liberty, except by fair procedure under law.",
    "tpa_53a": "Part performance protects a transferee in possession under a written contract.",
    "greeting": "Hello. Provide a contract to summarise it, find risks or list its clauses.",
    "identity": "An offline assistant for contract documents.",
    "capabilities": "Summaries, risk findings, clause maps and comparisons of contracts.",
    "warranty": "A warranty promises that stated facts are true, expressly or by law.",
    "nda": "An NDA limits sharing of confidential information: check scope, term and remedies.",
    "liability": "Liability clauses say who pays: check caps, exclusions and mutuality.",
    "termination": "Termination clauses say how a contract ends: for cause, for convenience, on notice.",
    "indemnity": "An indemnity makes one side cover the other's losses: check cap and scope.",
    "force_majeure": "Force majeure excuses performance in extraordinary events.",
    "governing_law": "These clauses choose the law, the forum, and courts or arbitration.",
    "non_compete": "Non-compete clauses limit later work: check duration, place and scope.",
    "intellectual_property": "IP clauses say who owns created work: hire, licence or assignment.",
    "payment": "Payment terms say when and how money moves: check dates and late fees.",
    "thanks": "You are welcome. Ask a lawyer before you rely on an answer.",
    "wellbeing": "Ready. Provide a contract to begin.",
}
FALLBACK_ANSWER = "No stored answer. Provide a contract, or ask for a summary, risks or clauses; ask a lawyer about new issues."

# Display names of clause types, model names first.
TYPE_LABELS: dict[str, str] = {
    "termination": "Termination", "payment_terms": "Payment Terms", "liability": "Liability / Limitation", "confidentiality": "Confidentiality / NDA", "governing_law": "Governing Law",
    "indemnification": "Indemnification", "intellectual_property": "Intellectual Property", "dispute_resolution": "Dispute Resolution", "force_majeure": "Force Majeure", "non_compete": "Non-Compete",
    "warranties": "Warranties", "other": "General / Other", "definitions": "Definitions", "parties": "Parties", "term_duration": "Term / Duration", "payment_fees": "Payment / Fees",
    "liability_indemnity": "Liability / Indemnity", "miscellaneous": "Miscellaneous",
}
# Labels of the trained classifier, in order of their ids.
MODEL_LABELS = ("termination", "payment_terms", "liability", "confidentiality", "governing_law", "indemnification", "intellectual_property", "dispute_resolution", "force_majeure", "non_compete", "warranties", "other")

# Headings, clause starts, continuations.
HEADING_NUMBERING = (r"^\d+\.", r"^\d+\.\d+", r"^Section\s+\d+", r"^Article\s+[IVX\d]+", r"^Clause\s+\d+", r"^Schedule\s+[A-Z\d]", r"^Appendix\s+[A-Z\d]", r"^Exhibit\s+[A-Z\d]", r"^\([a-z0-9]+\)", r"^[IVX]+\.")
HEADING_KEYWORDS = ("DEFINITIONS", "PARTIES", "RECITALS", "WHEREAS", "TERMINATION", "PAYMENT", "CONFIDENTIALITY", "INDEMNITY", "LIABILITY", "WARRANTIES", "GOVERNING LAW", "DISPUTE RESOLUTION", "MISCELLANEOUS", "GENERAL PROVISIONS", "INTELLECTUAL PROPERTY", "SCOPE OF WORK")
CONTINUATION_WORDS = ("and", "or", "but", "however", "provided", "unless", "except", "including", "excluding")
BOUNDARY_NUMBERED = r"^(?:\(?\d+[.\d]*\)?\s|[A-Z]{1,3}[IVX]*\.\s)"
BOUNDARY_KEYWORD = r"(?i)^(?:Section|Article|Clause|Schedule|Exhibit)\s+\w+"
BOUNDARY_BULLET = r"^[•\-*–—○◦▪]\s+"
BOUNDARY_CAPS = r"^[A-Z][A-Z\s.,:;\-]{2,}$"

# Tuning-set checks.
PROMPT_LAW = r"\bunder\s+([^:]+?)(?:\s*:\s*|$)"
LAW_HINTS: tuple[tuple[str, str], ...] = (
    (r"\b(unauthorized access|hacking|bank account|data breach|leaks? confidential)\b", "Information Technology Act, 2000"),
    (r"\bcheque\b|\bdishonou?red\b|\binsufficient funds\b", "Negotiable Instruments Act, 1881"),
    (r"\bdefective goods?\b|\bwarranty claims?\b|\bconsumer\b", "Consumer Protection Act, 2019"),
    (r"\bfails? to perform\b|\bvalid contract\b|\bbreach of contract\b", "Indian Contract Act, 1872"),
)

#: Reference cards of landmark cases: id, region, tag, title, citation; summaries are the ANSWERS.
LANDMARKS: tuple[tuple[str, str, str, str, str], ...] = (
    ("bachan_singh", "Indian Supreme Court", "Criminal / Constitutional", "Bachan Singh v. State of Punjab", "1980 SCC (2) 684"),
    ("arnesh_kumar", "Indian Supreme Court", "Criminal procedure", "Arnesh Kumar v. State of Bihar", "(2014) 8 SCC 273"),
    ("article_14", "Constitution of India", "Constitutional text", "Article 14 - Equality before the law", "Constitution of India, 1950, Art. 14"),
    ("article_21", "Constitution of India", "Constitutional text", "Article 21 - Life and personal liberty", "Constitution of India, 1950, Art. 21"),
    ("carlill", "Common law (England)", "Contract", "Carlill v. Carbolic Smoke Ball Co.", "[1893] 1 QB 256"),
    ("tpa_53a", "Indian statute", "Property", "Transfer of Property Act - Section 53A", "Transfer of Property Act, 1882"),
    ("puttaswamy", "Indian Supreme Court", "Privacy", "K.S. Puttaswamy v. Union of India", "(2017) 10 SCC 1"),
    ("salomon", "Common law (UK)", "Company law", "Salomon v. Salomon & Co. Ltd.", "[1897] AC 22"),
    ("vishaka", "Indian Supreme Court", "Labour", "Vishaka v. State of Rajasthan", "(1997) 6 SCC 241"),
    ("donoghue", "Common law (UK)", "Torts", "Donoghue v. Stevenson", "[1932] AC 562"),
)


def required_literal(pattern: str) -> str:
    """A lower-case literal that every match of a rule holds: a cheap test before the expression. "" if none is plain."""
    plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??|\[[^\]]*\]\??|.\?|\.\*|\\b|\\.", "\0", pattern)
    if "|" in re.sub(r"\((?:[^()]|\([^()]*\))*\)", "", pattern):
        return ""
    return max(plain.split("\0"), key=len).lower()


def first_word(pattern: str) -> str:
    """The plain letters, in lower case, with which every match of a rule begins at the start of a word. "" if there are
    none for sure."""
    found = re.match(r"\\b([A-Za-z]+)([?*{]?)", pattern)
    if not found or "|" in re.sub(r"\((?:[^()]|\([^()]*\))*\)", "", pattern):
        return ""
    return (found[1][:-1] if found[2] else found[1]).lower()


def shortest_starts(words: list[str]) -> dict[str, str]:
    """Each word to the shortest of all that it begins with, so that no two results begin alike."""
    return {w: min((x for x in words if w.startswith(x)), key=len) for w in words}
