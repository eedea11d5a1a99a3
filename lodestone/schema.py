"""Schemas of the stored chunk table and of retrieval hits."""

from pyspark.sql import types as T

_S = T.StringType()

#: The chunk table. Page is 1-based, 0 where there is none.
CHUNKS = T.StructType(
    [T.StructField(n, _S) for n in ("id", "text", "raw_text", "source", "filename", "h1", "h2", "category", "tags")]
    + [T.StructField("char_count", T.IntegerType()), T.StructField("tokenized_text", _S), T.StructField("vector", T.ArrayType(T.FloatType(), False))]
    + [T.StructField("chunk_type", _S), T.StructField("page", T.IntegerType()), T.StructField("timestamp", _S), T.StructField("figure_path", _S)]
)

#: Defaults of columns that older tables lack.
DEFAULTS = {"tokenized_text": "", "chunk_type": "text", "page": 0, "timestamp": "", "figure_path": "", "category": "", "tags": "", "h1": "", "h2": ""}

HITS = "query_id long, track string, seq long, id string, source string, raw_text string, score double"
GOLDEN = "query_id long, query string, expected_id string, expected_source string, expected_content string"
TREND = "title string, url string, source string, hot_score double, platform string, tags array<string>"
