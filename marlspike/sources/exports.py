"""Exports as lines of text: each file form is a list of headers with column expressions, written as part files of one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions import text as X

BOM = "﻿"
# Headers of the exports.
ENGAGEMENT = (
    "Contact Name", "Email", "Company", "Campaign", "Sequence Step", "Sent At", "Delivered At", "Unique Opened", "Open Count", "First Opened At", "Last Opened At", "Unique Clicked", "Click Count", "First Clicked At", "Last Clicked At", "Replied", "Reply Count", "First Replied At", "Last Replied At", "Bounce Status", "Unsubscribe Status", "Last Activity At",
)
COMPANIES = ("Company Name", "Normalized Company Name", "Website", "Domain", "Resolution Status", "Resolution Source", "Resolution Evidence", "Booth Number", "Hall Number", "Category", "Source URL")
LEADS = ("ID", "Company Name", "Normalized Name", "Domain", "Website URL", "Contact Name", "Contact Title", "Email", "Phone", "City", "State", "Country", "Industry", "Company Size", "LinkedIn URL", "Source Type", "Source Name", "Dedupe Status", "Duplicate Reason", "Completeness Score", "Extracted At")
CONTACTS = ("First Name", "Last Name", "Full Name", "Email", "Job Title", "Company", "Industry", "City", "Status")
# Form of the batch export (38 columns).
BATCH = (
    "Company Name", "Normalized Company Name", "Contact Name", "First Name", "Last Name", "Job Title", "Email", "Phone", "Website", "Domain", "LinkedIn URL", "Country", "State", "City", "Address", "Industry", "Subindustry", "Category", "Product Category", "Employee Range", "Revenue Range", "Event Name", "Event Type", "Hall", "Booth", "Stall",
    "Source Type", "Source Name", "Source URL", "Listing URL", "Detail URL", "Source Page", "Source Row", "Duplicate Status", "Duplicate Reason", "Data Completeness", "Email Format Status", "Extracted At",
)


def iso(ts: Column) -> Column:
    """An instant in ISO form with milliseconds, empty for none."""
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")), F.lit(""))


def percent(share: Column) -> Column:
    return F.concat(F.round(share * 100).cast("int"), F.lit("%"))


def line(headers: tuple[str, ...], values: dict[str, Column], quote_all: bool = False) -> Column:
    """One line of an export; headers without a value are empty cells."""
    unknown = set(values) - set(headers)
    if unknown:
        raise ValueError(f"not in this export: {sorted(unknown)}")
    cells = [F.coalesce(values[h].cast("string"), F.lit("")) if h in values else F.lit("") for h in headers]
    if quote_all:
        cells = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in cells]
    else:
        cells = [X.csv_field(c) for c in cells]
    return F.concat_ws(",", *cells)


def stall_of(address: Column, hall: Column | None = None, booth: Column | None = None) -> tuple[Column, Column]:
    """Hall and booth, from the address where neither is given."""
    none = F.lit(None).cast("string")
    h, b = (F.nullif(c if c is not None else none, F.lit("")) for c in (hall, booth))
    missing = h.isNull() & b.isNull()
    found = lambda p: F.nullif(F.regexp_extract(address, p, 1), F.lit(""))
    return F.when(missing, found(r"(?i)hall\s*[:#]?\s*([a-zA-Z0-9\-_]+)")).otherwise(h), F.when(missing, found(r"(?i)(?:booth|stall|stand)\s*[:#]?\s*([a-zA-Z0-9\-_]+)")).otherwise(b)


def batch_values(contact: Column, address: Column) -> dict[str, Column]:
    """The derived cells of the batch export: first and last name, hall and booth."""
    words = F.split(F.trim(contact), r"\s+")
    hall, booth = stall_of(address)
    return {"Contact Name": contact, "First Name": words[0], "Last Name": F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), " "), "Address": address, "Hall": hall, "Booth": booth}


def write(lines: DataFrame, headers: tuple[str, ...], path: str, bom: bool = True, line_end: str = "\r\n") -> None:
    """Writes the column line as text files; the header is a file of its own that sorts first."""
    spark = lines.sparkSession
    head = spark.range(1).select(F.lit((BOM if bom else "") + ",".join(headers)).alias("line"))
    head.coalesce(1).write.mode("error").option("lineSep", line_end).text(f"{path}/0-header")
    lines.select("line").write.mode("error").option("lineSep", line_end).text(f"{path}/1-rows")
