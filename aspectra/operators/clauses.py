"""Clause gate, clause split and aspect prompt (row-local, no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.functions.text import contains_any, sequential_split, strip_ws

# ---- fixed values -------------------------------------------------------
# Delimiters the splitter applies, in this order.
SPLITTERS = (" nhưng ", " tuy nhiên ", " mặc dù ", " song ", ",", ";", ".")
# Delimiters that decide whether a sentence is split at all ('.' is not one).
GATE = (" nhưng ", " tuy nhiên ", " mặc dù ", " song ", ";", ",")
# Prompt given to the second classifier: aspect first, then the clause.
PROMPT = "Về khía cạnh %s, %s"
# -------------------------------------------------------------------------


def clause_gate(text: Column, gate: Sequence[str] = GATE) -> Column:
    """True when the lower-cased text contains any gate delimiter."""
    return contains_any(F.lower(text), gate)


def split_clauses(text: Column, splitters: Sequence[str] = SPLITTERS) -> Column:
    """Sequential split by each delimiter, parts stripped, blank parts dropped."""
    parts = F.transform(sequential_split(text, splitters), strip_ws)
    return F.filter(parts, lambda p: p != "")


def clause_array(text: Column, gate: Sequence[str] = GATE, splitters: Sequence[str] = SPLITTERS) -> Column:
    """Clauses of a sentence as the inference path sees them: the lower-cased
    sentence is split only when the gate passes, else it stays one clause."""
    low = F.lower(text)
    return F.when(contains_any(low, gate), split_clauses(low, splitters)).otherwise(F.array(low))


def explode_clauses(
    df: DataFrame,
    text: str,
    keys: Sequence[str],
    gate: Sequence[str] = GATE,
    splitters: Sequence[str] = SPLITTERS,
) -> DataFrame:
    """keys + (clause_no, clause), one row per clause."""
    return df.select(
        *keys, F.posexplode(clause_array(F.col(text), gate, splitters)).alias("clause_no", "clause")
    )


def aspect_prompt(aspect: Column, clause: Column, template: str = PROMPT) -> Column:
    return F.format_string(template, aspect, clause)
