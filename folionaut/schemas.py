"""Explicit schemas of what is read and written."""

from pyspark.sql import types as T

HOLDING = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("yf", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("isin", T.StringType()), T.StructField("group", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("ccy", T.StringType()), T.StructField("quote_ccy", T.StringType()), T.StructField("quote_ccy_google", T.StringType()), T.StructField("shares", T.LongType()),
    T.StructField("cost_px", T.DoubleType()), T.StructField("cost_ccy", T.StringType()), T.StructField("cost_amount", T.DoubleType()),
])
SPEC = T.StructType([
    T.StructField("portfolio", T.StringType()), T.StructField("label", T.StringType()), T.StructField("google_portfolio_id", T.StringType()), T.StructField("base_currency", T.StringType()),
    T.StructField("inception", T.DateType()), T.StructField("sync_date", T.DateType()), T.StructField("methodology", T.StringType()),
    T.StructField("holdings", T.ArrayType(HOLDING)),
])
