"""What a document says of itself: edition, date, publisher, disclaimer; by labels alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import understanding as U

# How questions ask for each, and how passages label it.
DOCUMENT = r"prospectus|প্রসপেক্টাস|document|নথি"
ASKED = {"edition": r"\bedition\b|সংস্করণ", "date": r"\bdate\b|তারিখ", "publisher": r"\bpublish(?:ed|er|ing)?\b|প্রকাশক|প্রকাশ", "disclaimer": r"\bdisclaimer\b|ডিসক্লেইমার"}
EDITION = r"(?i)\bEdition\s*[:\-]?\s*(\d{1,3}(?:st|nd|rd|th)\s+Edition)\s*,?\s*((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})"
PUBLISHED = r"(?i)^Published\s+by\s+(.+?)(?=\bEdition\b|\bAddress\s+of\s+Correspondence\b|\bDisclaimer\b|$)"
DISCLAIMER = r"(?i)\bDisclaimer\s*[:\-]?\s+(.+?)(?=\bPublished\s+by\b|\bEdition\b|$)"
STREET = r"\b\d+[A-Za-z]?(?:/[A-Za-z0-9]+)?\s*,"


def metadata_fields(question: Column) -> Column:
    """The document's own data that a question asks for: of edition, publication_date, published_by, publication_disclaimer.
    Date and publisher count only with a word for the document (or, the date, beside the edition)."""
    q = F.coalesce(question, F.lit(""))
    about = U.matches(q, DOCUMENT)
    has = {k: U.matches(q, p) for k, p in ASKED.items()}
    tests = {"edition": has["edition"], "publication_date": has["date"] & (has["edition"] | about), "published_by": has["publisher"] & about, "publication_disclaimer": has["disclaimer"]}
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))


def document_metadata(text: Column) -> Column:
    """map of what a passage labels; a publisher has two words at least and ends before a street number, a disclaimer has
    six words at least and ends as a sentence."""

    def of(t: Column) -> Column:
        edition, date = F.regexp_extract(t, EDITION, 1), F.regexp_extract(t, EDITION, 2)
        by = F.regexp_extract(t, PUBLISHED, 1)
        by = F.regexp_replace(F.element_at(F.split(by, STREET), 1), r"^[ ,.;:-]+|[ ,.;:-]+$", "")
        note = F.trim(F.regexp_extract(t, DISCLAIMER, 1))
        found = [("edition", edition, edition != ""), ("publication_date", date, date != ""), ("published_by", by, F.size(F.split(by, " ")) >= 2), ("publication_disclaimer", note, (F.size(F.split(note, " ")) >= 6) & note.rlike("[.!?]$"))]
        entries = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v, ok in found]))
        return F.map_from_entries(entries)

    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return T.let(plain, of)
