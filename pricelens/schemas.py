"""Explicit schemas: nothing in the package infers one from data."""

from pyspark.sql import types as T

# Raw product. `price` and `details` arrive as text or as JSON values; both are read as text.
RAW = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("description", T.ArrayType(T.StringType())),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("details", T.StringType()),
])
# The same as it is read from a line: `description` and `features` are a list of texts or one text.
RAW_LINE = T.StructType([
    T.StructField(f.name, T.VariantType() if f.name in ("description", "features") else f.dataType) for f in RAW.fields
])

ITEM = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("full", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("summary", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("completion", T.StringType()),
    T.StructField("ord", T.LongType()),
])

DATAPOINT = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("completion", T.StringType()),
    T.StructField("ord", T.LongType()),
])

CHECKPOINT_LINE = "struct<key:string,summary:string>"
BATCH_RESPONSE = (
    "struct<custom_id:string,response:struct<body:struct<choices:array<struct<message:struct<content:string>>>>>>"
)
CHAT_LINE = "struct<messages:array<struct<role:string,content:string>>>"
GUESS = "summary string, guess double"
OPPORTUNITY = (
    "deal struct<product_description:string,price:double,url:string>, estimate double, discount double"
)
