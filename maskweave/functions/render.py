"""Activity records in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskweave.functions.text import show_hidden

# Reason and basis codes with their sentences.
REASONS = (
    ("masked_output", "The result would include masked columns."),
    ("unresolved_column", "A column could not be matched to the catalog."),
    ("stale_catalog", "The catalog is out of date with the database."),
    ("write", "It changes data."),
    ("ddl", "It changes the schema."),
    ("writes_off", "Writes are off on this profile."),
    ("reads_ask", "This profile asks before reads."),
    ("volatile_call", "It calls a function that may change data."),
    ("multi_statement", "It holds more than one statement."),
    ("unparseable", "The statement could not be read."),
    ("plan_timeout", "Planning the statement took too long."),
    ("permission_denied", "The database role lacks permission."),
)
BASES = (
    ("catalog", "set in the catalog"),
    ("rules", "detection rules"),
    ("inherited", "computed from its inputs"),
    ("parameter", "follows a parameter"),
    ("unknown", "not in the catalog"),
    ("unexamined", "not examined"),
)

# Verbs of record titles, and where a person decided.
TITLE_VERBS = (
    ("SELECT", "Read"),
    ("INSERT", "Insert into"),
    ("UPDATE", "Update"),
    ("DELETE", "Delete from"),
    ("MERGE", "Merge into"),
)
PLACES = (("dialog", "in the terminal"), ("ui", "in the dashboard"))
DECIDED_CODES = ("approval_required", "approval_refused")


def phrase(code: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """Text of a code; a code without one shows itself."""
    out = code
    for key, text in table:
        out = F.when(code == key, text).otherwise(out)
    return out


def reason_text(code: Column) -> Column:
    return phrase(code, REASONS)


def basis_text(basis: Column) -> Column:
    return phrase(basis, BASES)


def _filled(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def outcome_text(decision: Column, approver: Column, error_code: Column) -> Column:
    """What happened to a statement: ran, asked, a decision and who took it, expired, or failed."""
    place = F.lit("by ")
    by = F.concat(place, approver)
    for key, text in PLACES:
        by = F.when(approver == key, text).otherwise(by)
    failed = _filled(error_code) & ~error_code.isin(*DECIDED_CODES)
    return (
        F.when(failed, F.concat(F.lit("failed · "), error_code))
        .when(decision == "expired", "expired")
        .when(_filled(decision) & _filled(approver), F.concat(decision, F.lit(" "), by))
        .when(_filled(decision), decision)
        .when(error_code == "approval_required", "asked")
        .otherwise("ran")
    )


def record_title(statement: Column, statement_type: Column, relations: Column) -> Column:
    """Verb and the first two relations, with the number of further ones; a statement that touches no
    relation shows its own text."""
    names = F.transform(F.slice(relations, 1, 2), lambda r: F.concat(r["schema"], F.lit("."), r["relation"]))
    more = F.when(F.size(relations) > 2, F.concat(F.lit(" +"), (F.size(relations) - 2).cast("string"))).otherwise("")
    title = F.concat(phrase(statement_type, TITLE_VERBS), F.lit(" "), F.array_join(names, ", "), more)
    return F.when(F.coalesce(F.size(relations), F.lit(0)) < 1, show_hidden(statement)).otherwise(title)
