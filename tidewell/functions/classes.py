"""Classification of rows by small ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.strings import collapsed

#: Bed states, and the words that name them, in order of precedence.
BED_STATES = ("occupied", "empty", "maintenance", "reserved", "isolation")
BED_WORDS = (("DESOCUPADO|VAZIO", "empty"), ("LIMPEZA", "maintenance"), ("RESERVA", "reserved"), ("ISOLAMENTO", "isolation"))
#: Parts of names of sectors with a high turnover.
HIGH_TURNOVER = ("CRPA", "SALA", "OBSERVACAO", "OBSERVAÇÃO", "PS", "EMERGENCIA", "EMERGÊNCIA", "PRONTO")
#: Other spellings of a profession.
PROFESSIONS = {"phisiotherapy": "fisioterapia", "physiotherapy": "fisioterapia"}
#: Councils in signatures, in order of precedence, and what they stand for.
COUNCILS = (("crm", "medical"), ("coren", "nursing"), ("crefito", "phisiotherapy"), ("crn", "nutrition"), ("crefono", "speech_therapy"), ("cro", "dentistry"))
#: Kinds of errors and the reason under which they are counted.
FAILURES = {
    "ExtractionTimeoutError": "timeout",
    "SubprocessTimeoutError": "timeout",
    "EvolutionPdfTimeoutError": "timeout",
    "NavigationTimeoutError": "timeout",
    "InvalidJsonError": "invalid_payload",
    "SnapshotContainerMissingError": "invalid_payload",
    "EvolutionPdfError": "invalid_payload",
    "ValidationError": "validation_error",
    "ExtractionError": "source_unavailable",
}
#: Months of 365 / 12 days make 12 years at so many twelfths of a day.
_TWELVE_YEARS = 12 * 365 * 12


def chosen(rules, otherwise: str) -> Column:
    """The value of the first rule (condition, value) that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def bed_status(record: Column, name: Column) -> Column:
    """A record number makes a bed occupied; otherwise the name's words tell, and empty is what is left."""
    label = F.upper(F.trim(name))
    return chosen([(F.trim(F.coalesce(record, F.lit(""))) != "", "occupied"), *((label.rlike(words), state) for words, state in BED_WORDS)], "empty")


def age_band(age: Column, status: Column) -> Column:
    """under_12, age_12_or_over, unknown; not_applicable for beds without a patient. ``Nm`` and ``NmDd`` count months and days."""
    text = F.trim(F.coalesce(age, F.lit("")))
    pattern = r"(?i)^([0-9]+)\s*m\s*(?:([0-9]+)\s*d)?$"
    number = lambda group: F.coalesce(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("long"), F.lit(0))
    whole = text.rlike("^[0-9]+$")
    years = F.when(whole, text).try_cast("long") >= 12
    months = number(1) * 365 + number(2) * 12 >= _TWELVE_YEARS
    band = lambda old: F.when(old, "age_12_or_over").otherwise("under_12")
    return F.when(status != "occupied", "not_applicable").when(whole, band(years)).when(text.rlike(pattern), band(months)).otherwise("unknown")


def is_high_turnover(sector: Column) -> Column:
    """A part of the name, not a word of it: PS also lies inside words."""
    return F.coalesce(F.upper(sector).rlike("|".join(HIGH_TURNOVER)), F.lit(False))


def profession(raw: Column) -> Column:
    label = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PROFESSIONS.items() for x in kv])[label], label)


def author_category(signature: Column, content: Column) -> Column:
    """By the council in the signature, else by what the text says; crefono comes before cro, which it does not contain."""
    line = F.lower(F.coalesce(signature, F.lit("")))
    rules = [(F.contains(line, F.lit(k)), v) for k, v in COUNCILS]
    return chosen([*rules, (F.contains(F.lower(content), F.lit("odontolog")), "dentistry")], "other")


def residual_quality(highest_percent: Column) -> Column:
    return F.when(highest_percent > 5, "alert").when(highest_percent > 3, "warn").otherwise("ok")


def failure_reason(error: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FAILURES.items() for x in kv])
    return F.coalesce(known[error], F.lit("unexpected_exception"))


def same_label(a: Column, b: Column) -> Column:
    return collapsed(a) == collapsed(b)
