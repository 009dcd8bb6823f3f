"""Disclosure categories of a statement by rules, for both engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ontology as o
from ..functions import text as t


def _tests(text: Column, action: Column, purpose: Column, recipient: Column, temporality: Column, kind: Column) -> dict[str, Column]:
    test = {
        "Processing Purpose": action.isin("use", "process", "collect") & (purpose != ""), "Data Categories": action.isin("use", "process", "collect") & (kind != ""),
        "Data Recipients": action.isin("share", "sell", "transfer") | (recipient != ""), "Storage Period": action.isin("retain", "delete") | (temporality != "unspecified"),
        "Right to Access": action == "access_right", "Right to Erase": action == "deletion_right", "Right to Portability": action == "portability_right", "Right to Object": action == "optout_right",
    }
    for k, p in t.RULES.items():
        test[k] = p(text) | (action == "optout_right") if k == "Withdraw Consent" else p(text)
    return test


def rule_labels(text: Column, action: Column, purpose: Column, recipient: Column, temporality: Column, kind: Column) -> Column:
    """Disclosure categories of a statement by rules, in their order."""
    test = _tests(text, action, purpose, recipient, temporality, kind)
    return F.array_compact(F.array(*[F.when(test[c], c) for c in o.CATEGORIES]))


def rule_bits(text: Column, action: Column, purpose: Column, recipient: Column, temporality: Column, kind: Column) -> Column:
    """The same categories as a whole number, a bit for each in their order."""
    test = _tests(text, action, purpose, recipient, temporality, kind)
    return reduce(Column.bitwiseOR, [F.when(test[c], 1 << k).otherwise(0) for k, c in enumerate(o.CATEGORIES)])


def labels_sql(source: str) -> str:
    test = {
        "Processing Purpose": "action IN ('use','process','collect') AND purpose <> ''", "Data Categories": "action IN ('use','process','collect') AND data_type <> ''",
        "Data Recipients": "action IN ('share','sell','transfer') OR recipient <> ''", "Storage Period": "action IN ('retain','delete') OR temporality <> 'unspecified'",
        "Right to Access": "action = 'access_right'", "Right to Erase": "action = 'deletion_right'", "Right to Portability": "action = 'portability_right'", "Right to Object": "action = 'optout_right'",
    }
    test |= {k: p.sql("source_text") for k, p in t.RULES.items()}
    parts = ", ".join(f"CASE WHEN {test[c]} THEN '{c}' END" for c in o.CATEGORIES)
    return f"SELECT *, list_filter([{parts}], lambda x: x IS NOT NULL) AS categories FROM {source}"
