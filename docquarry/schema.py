"""Fixed schemas of the data model: nothing is inferred and nothing is lost on reload."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])

TABLE = T.StructType(
    [
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)

REGION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("bbox", BBOX),
        T.StructField("layout_source", T.StringType()),
        T.StructField("table_markdown", T.StringType()),
        T.StructField("table", TABLE),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("region_id", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("regions", T.ArrayType(REGION)),
        T.StructField("chunks", T.ArrayType(CHUNK)),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
