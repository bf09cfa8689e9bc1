"""Period labels: ``2024``, ``2024-Q1``, ``2024-05``, ``2024-05-01``.

A label names *what the number describes*; the edition calendar at the bottom
names *which vintage published it*.  The two are never mixed in one column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted claim-period shapes.
PERIOD_PATTERN = r"(?i)^\d{4}(-Q[1-4]|[QM-]?\d{0,2})?$"
AMBIGUOUS_PERIOD_PATTERN = r"^\d{4}-\d$"  # "2024-1" would prefix-match October to December
QUARTER_SPELLING = r"^(\d{4})[\s-]?[Qq]([1-4])$"
MONTH_SPELLING = r"^(\d{4})(0[1-9]|1[0-2])$"


def normalize_period(label: Column) -> Column:
    """Spell ``2024Q1`` / ``2024 q1`` as ``2024-Q1`` and ``202405`` as ``2024-05``."""
    s = F.trim(label)
    s = F.regexp_replace(s, QUARTER_SPELLING, "$1-Q$2")
    return F.regexp_replace(s, MONTH_SPELLING, "$1-$2")


def is_valid_period(label: Column) -> Column:
    return label.rlike(PERIOD_PATTERN) & ~label.rlike(AMBIGUOUS_PERIOD_PATTERN)


def period_year(label: Column) -> Column:
    """Leading four-digit year, NULL when the label does not start with one."""
    return F.regexp_extract(label, r"^(\d{4})", 1).try_cast("int")


def period_frequency(label: Column) -> Column:
    """``A``/``Q``/``M`` for labels on a calendar grid, NULL otherwise (daily dates)."""
    return (
        F.when(label.rlike(r"^\d{4}$"), F.lit("A"))
        .when(label.rlike(r"^\d{4}-?[Qq][1-4]$"), F.lit("Q"))
        .when(label.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.lit("M"))
    )


def period_index(label: Column) -> Column:
    """Position on the label's own calendar grid, so gaps stay gaps.

    Annual ``y``, quarterly ``4y + (q-1)``, monthly ``12y + (m-1)``; both quarter
    spellings map to the same number.
    """
    year = F.substring(label, 1, 4).try_cast("long")
    freq = period_frequency(label)
    return (
        F.when(freq == "A", year)
        .when(freq == "Q", year * 4 + F.substring(label, -1, 1).try_cast("long") - 1)
        .when(freq == "M", year * 12 + F.substring(label, 6, 2).try_cast("long") - 1)
    )


def periods_per_year(freq: Column) -> Column:
    return F.when(freq == "Q", F.lit(4)).when(freq == "M", F.lit(12)).otherwise(F.lit(1))


def as_of_date(text: Column) -> Column:
    """``YYYY`` -> 31 December, ``YYYY-MM`` -> first of month, ``YYYY-MM-DD`` as is.

    Impossible dates give NULL; they are never rolled over to another day.
    """
    s = F.trim(text)
    return (
        F.when(s.rlike(r"^\d{4}$"), F.try_to_date(F.concat(s, F.lit("-12-31")), "yyyy-MM-dd"))
        .when(s.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(s, F.lit("-01")), "yyyy-MM-dd"))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
    )


# --- twice-yearly edition calendar (April / October) -------------------------


def edition_at(day: Column) -> Column:
    """Edition expected to be out on ``day``: November on the October one, May on April's."""
    y, m = F.year(day), F.month(day)
    return (
        F.when(m >= 11, F.concat(y.cast("string"), F.lit("-10")))
        .when(m >= 5, F.concat(y.cast("string"), F.lit("-04")))
        .when(m.isNotNull(), F.concat((y - 1).cast("string"), F.lit("-10")))
    )


def previous_edition(edition: Column) -> Column:
    y = F.substring(edition, 1, 4).try_cast("int")
    return F.when(edition.endswith("-10"), F.concat(y.cast("string"), F.lit("-04"))).when(
        edition.endswith("-04"), F.concat((y - 1).cast("string"), F.lit("-10"))
    )


def next_edition_label(edition: Column) -> Column:
    """Human label of the edition after ``edition``; an expectation, not an announcement."""
    y = F.substring(edition, 1, 4).try_cast("int")
    return F.when(edition.endswith("-10"), F.concat(F.lit("April "), (y + 1).cast("string"))).when(
        edition.endswith("-04"), F.concat(F.lit("October "), y.cast("string"))
    )


def edition_label_parts(label: Column) -> Column:
    """``World Economic Outlook (April 2026)`` -> struct(year, month); NULL when unreadable."""
    # Month names in edition labels.
    months = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
    name = F.lower(F.regexp_extract(label, r"\(([A-Za-z]+)\s+\d{4}\)\s*$", 1))
    year = F.regexp_extract(label, r"\([A-Za-z]+\s+(\d{4})\)\s*$", 1).try_cast("int")
    month = F.array_position(F.array(*[F.lit(m) for m in months]), name).cast("int")
    return F.when((month > 0) & year.isNotNull(), F.struct(year.alias("year"), month.alias("month")))


def months_behind(period: Column, today: Column) -> Column:
    """Whole months from a period label to ``today``; a label without a month counts as December."""
    y = period_year(period)
    m = F.coalesce(F.regexp_extract(period, r"^\d{4}-?(\d{2})", 1).try_cast("int"), F.lit(12))
    return (F.year(today) - y) * 12 + (F.month(today) - m)


def staleness_budget_months(freq_letter: Column) -> Column:
    # Tolerated lag in months by frequency letter.
    return F.when(freq_letter == "D", F.lit(2)).when(freq_letter == "M", F.lit(4)).otherwise(F.lit(18))


# --- projection boundary -----------------------------------------------------

PROJECTION_HORIZON_YEARS = 5  # a payload normally runs to edition year + 5


def projection_boundary(horizon_year: Column, today: Column, edition_year: Column) -> Column:
    """First year that counts as a projection: struct(boundary_year, clamped)."""
    naive = horizon_year - PROJECTION_HORIZON_YEARS
    calendar_year = F.substring(edition_at(today), 1, 4).cast("int")
    implausible = F.abs(naive - calendar_year) > 1
    clamped_to = F.least(F.coalesce(edition_year, calendar_year), calendar_year)
    return F.struct(
        F.when(implausible, clamped_to).otherwise(naive).cast("int").alias("boundary_year"),
        implausible.alias("clamped"),
    )


def boundary_from_tag(tag: Column) -> Column:
    """Boundary year carried by a vintage tag ``WEO:2018-10`` / ``FM:2026``.

    Sibling datasets that only share the prefix (``WEOAGG:``) do not match.
    """
    return F.regexp_extract(tag, r"^(?:WEO|FM):(\d{4})", 1).try_cast("int")


def tag_kind(tag: Column) -> Column:
    return F.when(tag.startswith("FM:"), F.lit("IMF Fiscal Monitor")).when(
        tag.startswith("WEO:"), F.lit("IMF WEO")
    )


def projection_note(kind: Column, year: Column, boundary_year: Column) -> Column:
    return F.when(year >= boundary_year, F.concat(kind, F.lit(" estimate/projection")))


def is_projection_note(note: Column) -> Column:
    n = F.coalesce(note, F.lit(""))
    return n.rlike("(?i)WEO|Fiscal Monitor") & n.rlike("(?i)estimate|projection")


def stale_vintage(tag: Column, today: Column) -> Column:
    """struct(resolved, expected, stale) for a dated vintage tag; NULL for undated tags."""
    resolved = F.regexp_extract(tag, r"(?:WEO|FM):(\d{4}-\d{2})", 1)
    expected = edition_at(today)
    return F.when(
        resolved != "",
        F.struct(resolved.alias("resolved"), expected.alias("expected"), (resolved < expected).alias("stale")),
    )
