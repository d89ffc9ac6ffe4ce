"""Row types of the store: raw bars, features, and the registry that guards them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def _struct(spec: str) -> StructType:
    kinds = {"long": LongType(), "double": DoubleType(), "string": StringType()}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


OHLCV_1D = _struct(
    "ts_open:long ts_close:long open:double high:double low:double close:double volume:double "
    "quote_vol:double n_trades:long taker_buy_vol:double exchange:string symbol:string"
)
FEATURE_ROW = _struct("ts:long feature_id:string version:string asset:string value:double")
BOOK_TOP = _struct("ts:long exchange:string symbol:string bid_price_0:double ask_price_0:double bid_size_0:double ask_size_0:double")
DERIVATIVE_TICKER = _struct("ts:long exchange:string symbol:string funding_rate:double")

#: The immutable registry: an added column means a new key and a new path, never a change here.
SCHEMAS: dict[str, StructType] = {"ohlcv_1d": OHLCV_1D}

#: The twelve columns that make a bar record, in storage order.
BAR_COLUMNS: list[str] = OHLCV_1D.names


class SchemaMismatch(ValueError):
    """A table does not have exactly the registered names and types."""


def validate(df: DataFrame, data_type: str) -> DataFrame:
    """Return ``df`` if its names, order and types equal the registered schema, else raise."""
    if data_type not in SCHEMAS:
        raise SchemaMismatch(f"no schema is registered for {data_type!r}")
    want, have = [(f.name, f.dataType) for f in SCHEMAS[data_type]], [(f.name, f.dataType) for f in df.schema]
    if want != have:
        raise SchemaMismatch(f"{data_type}: expected {want}, found {have}")
    return df
