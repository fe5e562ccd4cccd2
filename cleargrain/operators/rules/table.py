"""What a rule sees of a table: typed views of columns and attached facts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from cleargrain.functions import vocabulary as V
from cleargrain.functions.coerce import DEFAULT_DATE_FORMATS, date_view, number_view, strip

RETAIL_COLUMNS = {"InvoiceNo", "StockCode", "UnitPrice", "Quantity"}

# Retail column names and the names used by the later stages.
RETAIL_TO_SALES = {
    "UnitPrice": "price",
    "Quantity": "quantity",
    "InvoiceDate": "date",
    "InvoiceNo": "order_id",
    "StockCode": "product_id",
    "CustomerID": "customer_id",
    "Country": "country",
}


@dataclass(frozen=True)
class RuleOptions:
    """Thresholds and reference data of the rules.

    ``date_formats`` None: the format of a text date column is inferred for each scope.
    """

    as_of: dt.datetime | None = None
    date_formats: Sequence[str] | None = None
    price_max: float = 100000
    quantity_max: float = 1000000
    discount_max: float = 100
    discount_min: float = 0
    max_age_days: int = 3650
    allowed: Mapping[str, Sequence[str]] = field(default_factory=lambda: V.ALLOWED_VALUES)
    catalogue: DataFrame | Mapping[str, str] = field(default_factory=lambda: V.DEFAULT_CATALOGUE)

    @property
    def now(self) -> Column:
        return F.lit(self.as_of) if self.as_of else F.current_timestamp()


@dataclass(frozen=True)
class Hit:
    """One rule bound to a table.

    ``severity`` overwrites that of earlier rules; a soft rule adds its tag and
    weight but does not mark the row as anomalous. Rules ``on_cell`` look for
    missing cells; a ``late`` rule needs the count of those.
    """

    tag: str
    cond: Column
    weight: float
    severity: str | None = None
    soft: bool = False
    on_cell: bool = False
    late: bool = False


def dataset_kind(columns: Sequence[str]) -> str:
    """``retail``, ``sales`` or ``generic`` by the columns present."""
    names = set(columns)
    if RETAIL_COLUMNS <= names:
        return "retail"
    return "sales" if names & {"price", "quantity"} else "generic"


def retail_as_sales(df: DataFrame) -> DataFrame:
    """Rename retail columns to the names that the ensemble and repair use."""
    return df.withColumnsRenamed({a: b for a, b in RETAIL_TO_SALES.items() if a in df.columns and b not in df.columns})


class RuleTable:
    """Columns of one table as the rules read them.

    Numeric and date views are requested by name and collected in ``helpers``,
    so each is computed once below the projection that holds the conditions.
    """

    def __init__(self, df: DataFrame, meta: Sequence[str], options: RuleOptions, times: Mapping[str, Column] | None = None):
        self.options = options
        self.times = dict(times or {})
        self.types = {n: t for n, t in df.dtypes if n not in meta}
        self.columns = list(self.types)
        self.kind = dataset_kind(self.columns)
        self.helpers: dict[str, Column] = {}

    def has(self, *names: str) -> bool:
        return all(n in self.types for n in names)

    def first(self, *names: str) -> str | None:
        return next((n for n in names if n in self.types), None)

    def raw(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def text_columns(self) -> list[str]:
        return [n for n in self.columns if self.types[n] == "string"]

    def _helper(self, key: str, expr: Column) -> Column:
        self.helpers.setdefault(key, expr)
        return F.col(f"`{key}`")

    def number(self, name: str, drop: str = "") -> Column:
        suffix = "".join(f"_{ord(ch)}" for ch in drop)
        return self._helper(f"__num_{name}{suffix}", number_view(self.raw(name), self.types[name], drop))

    def time(self, name: str) -> Column:
        if name in self.times:
            return self._helper(f"__day_{name}", self.times[name])
        return self._helper(f"__day_{name}", date_view(self.raw(name), self.types[name], self.options.date_formats or DEFAULT_DATE_FORMATS))

    def stripped(self, name: str) -> Column:
        return self._helper(f"__txt_{name}", strip(self.raw(name).cast("string")))

    def missing(self, name: str) -> Column:
        return self.raw(name).isNull() | (self.stripped(name) == "")

    def unreadable(self, name: str, drop: str = "") -> Column:
        return self.number(name, drop).isNull() & self.raw(name).isNotNull() & (self.stripped(name) != "")

    def critical(self) -> list[str]:
        found = [self.first("price", "UnitPrice"), self.first("quantity", "Quantity"), self.first("order_id", "InvoiceNo")]
        return [n for n in found if n] or ["price", "quantity"]
