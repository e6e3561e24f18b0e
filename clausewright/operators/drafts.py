"""Draft templates: text with named fields, filled from rows, open fields marked by their label in brackets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Six kinds of drafts, in our own wording; {field} names a column.
TEMPLATES: dict[str, str] = {
    "nda": "NON-DISCLOSURE AGREEMENT between {party_a} and {party_b}, effective {date}. Each party keeps the other's confidential information secret for {duration}.",
    "service": "SERVICE AGREEMENT between {party_a} and {party_b}, effective {date}. {party_a} provides {services} for {amount}.",
    "employment": "EMPLOYMENT AGREEMENT between {party_a} and {party_b}, effective {date}. Position: {position}. Salary: {amount}.",
    "lease": "LEASE between {party_a} and {party_b}, effective {date}. Premises: {premises}. Rent: {amount} for {duration}.",
    "sale": "SALE AGREEMENT between {party_a} and {party_b}, effective {date}. Goods: {goods}. Price: {amount}.",
    "notice": "NOTICE from {party_a} to {party_b}, {date}. Subject: {subject}.",
}
LABELS = {"party_a": "Party A", "party_b": "Party B"}


def draft(kind: str) -> Column:
    """The template with each field's value, or its label in brackets where the value is null or blank."""
    parts = re.split(r"\{(\w+)\}", TEMPLATES[kind])
    label = lambda name: LABELS.get(name, name.replace("_", " ").title())
    value = lambda name: F.coalesce(F.nullif(F.trim(F.col(name).cast("string")), F.lit("")), F.lit(f"[{label(name)}]"))
    return F.concat(*(value(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def fields(kind: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", TEMPLATES[kind])))


def drafts(rows: DataFrame, kind: str) -> DataFrame:
    """rows with `draft`; fields that rows lack are left open."""
    for name in fields(kind):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows.withColumn("draft", draft(kind))


def without(items: DataFrame, item_id) -> DataFrame:
    """Saved items without one."""
    return items.filter(F.col("id") != item_id)
