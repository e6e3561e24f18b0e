"""A contract corpus derived from orders and customers, in SQL that Spark and DuckDB read alike.

A contract is a customer; each order gives one paragraph, chosen from the phrase bank by its key. The bank is our own
wording; it holds every clause class and risk category, escalations, headings, duplicates, blanks and broken lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.tables import table

#: Paragraphs; {name} is the customer, {amount} the order's price in whole units.
PHRASES: tuple[str, ...] = (
    "DEFINITIONS",
    "In this agreement the term Services means the work that refers to order {amount} and as used herein includes support.",
    "This agreement is made between {name} and the Supplier, each a party and together the parties.",
    "The agreement starts on the effective date and shall remain in effect for a period of two years unless renewal is agreed.",
    "4. TERMINATION",
    "Either party may terminate this agreement for cause upon notice of termination given thirty days ahead.",
    "{name} shall pay the invoice amount of {amount} within 30 days, and late payment carries interest.",
    "All fees are final, and the advance payment is non-refundable with no refunds after delivery.",
    "The Supplier keeps ownership of copyright, patent and know-how, and grants a license to the work product.",
    "The Contractor irrevocably assigns and assigns all rights in every derivative work made for hire.",
    "Each party shall keep confidential all proprietary information and shall not disclose any trade secret.",
    "All information is confidential and perpetual confidentiality applies to {name}.",
    "The Supplier accepts unlimited liability and is liable for any and all losses of {name}.",
    "The Contractor shall indemnify and hold harmless {name} against every claim.",
    "The Supplier represents and warrants that the goods are fit; there is no warranty of merchantability, express or implied.",
    "Goods are sold as is",
    "and without any guarantee by {name}.",
    "Any dispute goes to binding arbitration in London before one arbitrator.",
    "This agreement is governed by the laws of England, with exclusive jurisdiction of the courts of London.",
    "Governing Law and Venue",
    "Entire agreement: an amendment or waiver needs written notice; headings are for reference.",
    "A party in breach shall pay a penalty of {amount} as liquidated damages for breach.",
    "This right is perpetual and irrevocable.",
    "The weather in the valley was mild and the harvest began early.",
    "   ",
    "(a) the goods arrive late,",
    "or are damaged in transit by {name};",
    "The fee is due.",
    "Neither side bears cost of {amount} unless both agree in writing to share it .",
    "Each party may assign its duties with consent of the other.",
)


def _expression() -> str:
    def text(phrase: str) -> str:
        quoted = "'" + phrase.replace("'", "''") + "'"
        return "concat(" + quoted.replace("{name}", "', c_name, '").replace("{amount}", "', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '") + ", '')"

    cases = " ".join(f"WHEN {i} THEN {text(p)}" for i, p in enumerate(PHRASES))
    return f"CASE (o_orderkey * 7 + o_custkey) % {len(PHRASES)} {cases} END"


#: The corpus as a subquery of `orders` and `customer`.
CORPUS_SQL = f"""
SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS para_idx, {_expression()} AS text
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def _text() -> Column:
    """The same text by a look-up of the phrase, as a case of thirty branches is one method too large to be compiled."""
    phrase = F.get(F.array(*map(F.lit, PHRASES)), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % len(PHRASES)).cast("int"))
    with_amount = F.replace(phrase, F.lit("{amount}"), F.floor("o_totalprice").cast("bigint").cast("string"))
    return F.when(phrase.contains("{amount}"), with_amount).otherwise(phrase)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, para_idx, text), as CORPUS_SQL gives them."""
    orders, customer = (table(spark, sf_dir, name) for name in ("orders", "customer"))
    met = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "o_orderkey", "c_name", _text().alias("_t"))
    # The name comes last, so that nothing within it is taken for a place.
    named = met.select("o_custkey", "o_orderkey", F.when(F.col("_t").contains("{name}"), F.replace("_t", F.lit("{name}"), F.col("c_name"))).otherwise(F.col("_t")).alias("text"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return named.select(F.col("o_custkey").alias("doc_id"), (F.row_number().over(order) - 1).cast("int").alias("para_idx"), "text")


def revised(paragraphs: DataFrame) -> DataFrame:
    """The second version of every contract: terms changed, some paragraphs gone, some new. Same rows in REVISED_SQL."""
    changed = F.replace(F.replace(F.col("text"), F.lit("30 days"), F.lit("60 days")), F.lit("London"), F.lit("Paris"))
    kept = F.when((F.col("para_idx") + F.col("doc_id")) % 5 != 3, F.struct("para_idx", changed.alias("text")))
    added = F.when(F.col("para_idx") == 1, F.struct(F.lit(1000).alias("para_idx"), F.lit("The Supplier keeps audit records of every delivery for six years.").alias("text")))
    # Both from one pass: a union would make the paragraphs twice.
    return paragraphs.select("doc_id", F.explode(F.array(kept, added)).alias("x")).filter("x IS NOT NULL").select("doc_id", "x.*")


REVISED_SQL = f"""
SELECT doc_id, para_idx, replace(replace(text, '30 days', '60 days'), 'London', 'Paris') AS text FROM ({CORPUS_SQL}) AS c WHERE (para_idx + doc_id) % 5 <> 3
UNION ALL
SELECT doc_id, 1000 AS para_idx, 'The Supplier keeps audit records of every delivery for six years.' AS text FROM ({CORPUS_SQL}) AS c WHERE para_idx = 1
"""


def joined(paragraphs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """One text per contract, its paragraphs in order."""
    return paragraphs.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("para_idx", "text"))).getField("text"), separator).alias("text"))
