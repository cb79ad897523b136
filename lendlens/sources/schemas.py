"""The four source relations: the columns read and the types accepted for each.

An instant may be stored with or without a zone, a disbursal also as a date; instants
are compared in their stored type so that bounds reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG = (T.LongType, T.IntegerType)
TEXT = (T.StringType,)
INSTANT = (T.TimestampNTZType, T.TimestampType)
INSTANT_OR_DATE = (*INSTANT, T.DateType)
NUMBER = (T.DecimalType, T.LongType, T.IntegerType, T.DoubleType)

SCHEMAS = {
    "loan_application": {
        "id": LONG,
        "user_id_ref": LONG,
        "loan_product_id": TEXT,
        "app_name": TEXT,
        "date_created": INSTANT,
        "disbursal_date": INSTANT_OR_DATE,
        "loan_amount": NUMBER,
        "loan_tenure": LONG,
    },
    "loan_application_metadata": {
        "loan_application_id_ref": LONG,
        "tag_name": TEXT,
        "date_created": INSTANT,
    },
    "app_user_history": {
        "user_id_ref": LONG,
        "attribution_id": TEXT,
        "date_created": INSTANT,
    },
    "install_event": {
        "attribution_id": TEXT,
        "campaign_type": TEXT,
        "date_created": INSTANT,
    },
}


class SchemaError(ValueError):
    """A source lacks a column or has it in a type the reports cannot read."""


#: Decimal places up to which amounts are carried exactly.
MOST_PLACES = 6
GRAINS = {"day": "DD", "month": "MM", "year": "YYYY"}
_MARK = "lendlens_layout"


@dataclass(frozen=True)
class Layout:
    """A date column that follows a time column, such as what a table is partitioned by.

    ``column`` is the day, or the first day of the month or year, of ``of`` in ``zone``;
    where it is NULL it says nothing. Bounds on ``of`` then also bound ``column``.
    """

    column: str
    of: str
    grain: str = "day"
    zone: str = "UTC"


def checked(df: DataFrame, relation: str, layouts: Sequence[Layout] = ()) -> DataFrame:
    """``df`` cut to the relation's columns and the declared layout columns."""
    found = {field.name: field.dataType for field in df.schema}
    wanted = SCHEMAS[relation]
    for name, accepted in wanted.items():
        if name not in found:
            raise SchemaError(f"{relation}: no column {name}")
        if not isinstance(found[name], accepted):
            raise SchemaError(f"{relation}.{name}: {found[name].simpleString()} not accepted")
        if isinstance(found[name], T.DecimalType) and found[name].scale > MOST_PLACES:
            raise SchemaError(f"{relation}.{name}: more than {MOST_PLACES} decimal places")
    marked = []
    for layout in layouts:
        named = f"{relation}.{layout.column}"
        if not isinstance(found.get(layout.column), T.DateType):
            raise SchemaError(f"{named}: a layout column must be a date")
        if layout.of not in wanted or not isinstance(wanted[layout.of], tuple):
            raise SchemaError(f"{named}: no column {layout.of} to follow")
        if layout.grain not in GRAINS:
            raise SchemaError(f"{named}: no grain {layout.grain}")
        mark = {_MARK: {"of": layout.of, "grain": layout.grain, "utc": layout.zone == "UTC"}}
        marked.append(F.col(layout.column).alias(layout.column, metadata=mark))
    return df.select(*wanted, *marked)


def layout_bound(df: DataFrame, of: str, day: Column) -> Column | None:
    """What rows with ``of`` on or after a day meet in the columns laid out by it."""
    bound = None
    for field in df.schema:
        mark = field.metadata.get(_MARK)
        if mark is None or mark["of"] != of:
            continue
        # A day of another zone may begin up to a day earlier.
        first = day if mark["utc"] else F.date_sub(day, 1)
        if mark["grain"] != "day":
            first = F.trunc(first, GRAINS[mark["grain"]])
        held = (F.col(field.name) >= first) | F.col(field.name).isNull()
        bound = held if bound is None else bound & held
    return bound
