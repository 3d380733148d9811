"""Upload checks, file names, extracted-text clean-up and page splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import text as T

# Upload limits and types.
MAX_FILE_BYTES = 10 * 1024 * 1024
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
EXTENSIONS = (".pdf", ".docx")


def reject_reason(file_name: Column, mime_type: Column, file_size: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """First failed upload check, or null for an accepted file."""
    extension = F.lower(F.regexp_extract(file_name, r"(\.[^.]*)$", 1))
    return (
        F.when(file_size > max_bytes, "too_large")
        .when(~mime_type.isin(list(MIME_TYPES.values())), "mime_type")
        .when(~extension.isin(*EXTENSIONS), "extension")
    )


def split_uploads(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined rows of a manifest(file_name, mime_type, file_size, ...)."""
    checked = files.withColumn(
        "reject_reason", reject_reason(F.col("file_name"), F.col("mime_type"), F.col("file_size"), max_bytes)
    )
    return checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"), checked.filter(
        F.col("reject_reason").isNotNull()
    )


def sanitize_file_name(name: Column) -> Column:
    """Unsafe characters to ``_``, runs of ``_`` to one, at most 255 characters."""
    safe = F.regexp_replace(name, "[^a-zA-Z0-9._-]", "_")
    return F.substring(F.regexp_replace(safe, "_+", "_"), 1, 255)


def title_from_file_name(name: Column) -> Column:
    return T.strip(F.replace(F.regexp_replace(name, r"(?i)\.(?:pdf|docx)$", ""), F.lit("_"), F.lit(" ")))


def normalise_extracted(text: Column) -> Column:
    """Clean text as it leaves a file parser."""
    flat = F.replace(T.unix_newlines(text), F.lit("\t"), F.lit(" "))
    blanks = F.regexp_replace(flat, "[ ]{2,}", " ")
    return T.strip(F.regexp_replace(blanks, "\n{3,}", "\n\n"))


def mime_type(file_type: Column) -> Column:
    return F.when(file_type == "pdf", MIME_TYPES["pdf"]).otherwise(MIME_TYPES["docx"])


def raw_documents(notes: DataFrame) -> DataFrame:
    """Note rows as analysis input."""
    return notes.select(
        F.col("id").alias("doc_id"),
        F.col("content").alias("raw_text"),
        "file_name",
        mime_type(F.col("file_type")).alias("mime_type"),
        "file_size",
    )


def page_texts(text: Column, pages: Column | None = None) -> Column:
    """array<struct<page_no, raw_text>>: given pages, else form-feed parts, else one page."""
    parts = F.transform(
        F.split(text, "\f"),
        lambda p, i: F.struct((i + 1).alias("page_no"), p.alias("raw_text")),
    )
    if pages is None:
        return parts
    given = F.transform(
        pages,
        lambda p, i: F.struct(
            F.when(F.coalesce(p["page_no"], F.lit(0)) != 0, p["page_no"]).otherwise(i + 1).alias("page_no"),
            p["raw_text"].alias("raw_text"),
        ),
    )
    return F.when(F.size(F.coalesce(pages, F.array())) > 0, given).otherwise(parts)
