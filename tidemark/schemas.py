"""Schemas of the tables: columns are known by name, and missing ones are added as nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, IntegerType, StringType, StructField, StructType


def _of(kinds: dict[str, object]) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in kinds.items()])  # type: ignore[arg-type]


_TEXT = StringType()
#: What a parser reads from a payload, before defaults.
ENTRY = _of({c: _TEXT for c in ("title", "link")} | {"published": DateType(), "summary": _TEXT, "deadline": DateType()} | {c: _TEXT for c in ("organisation", "type", "detail_url", "source", "country", "pdf", "budget", "sector")} | {"relevant": BooleanType(), "opportunity": BooleanType()})
#: One notice, tracked.
NOTICE = _of(
    {c: _TEXT for c in ("id", "title", "organisation", "country", "type", "sector", "budget", "source", "link", "pdf", "ref")}
    | {"published": DateType(), "deadline": DateType(), "days_left": IntegerType(), "status": _TEXT, "relevance": _TEXT, "summary": _TEXT, "followed": _TEXT}
    | {f"sent_{k}": _TEXT for k in ("new", "j7", "j3", "j1", "expired")}
)
SOURCE = _of({c: _TEXT for c in ("source_id", "code", "name", "method", "url", "default_country", "default_sector", "default_type")} | {"active": BooleanType()})
PLAN = _of({c: _TEXT for c in ("reference", "authority", "object", "type", "mode", "amount")} | {"launch": DateType(), "start": DateType()} | {c: _TEXT for c in ("funder", "year")})
LOG = _of({"at": _TEXT, "source": _TEXT, "action": _TEXT, "status": _TEXT, "message": _TEXT})

# The labels of the notice table's columns, for exports.
LABELS = {
    "id": "ID", "title": "Titre", "organisation": "Organisation", "country": "Pays", "type": "Type", "sector": "Secteur", "budget": "Budget",
    "source": "Source", "link": "Lien", "pdf": "PDF", "published": "Date_Publication", "deadline": "Deadline", "days_left": "Jours_Restants",
    "status": "Statut_Delai", "relevance": "Pertinence", "summary": "Resume", "followed": "Suivi",
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order: missing ones as nulls, others dropped."""
    held = {c.lower() for c in df.columns}
    return df.select(*((F.col(f.name) if f.name.lower() in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def missing(df: DataFrame, schema: StructType) -> list[str]:
    """Columns that the schema asks for and the table lacks."""
    held = {c.lower() for c in df.columns}
    return [f.name for f in schema if f.name.lower() not in held]
