"""Record shapes of the graph model."""

from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())

NODE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_location", T.StringType()),
        T.StructField("tags", _TEXTS),
        T.StructField("comment", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("log_messages", _TEXTS),
        T.StructField("throw_messages", _TEXTS),
    ]
)
EDGE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("relation", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_location", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
RAW_CALL = T.StructType(
    [
        T.StructField("caller_nid", T.StringType()),
        T.StructField("callee", T.StringType()),
        T.StructField("is_member_call", T.BooleanType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_location", T.StringType()),
    ]
)

# Confidence levels and file types of the model.
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
CONTAINMENT = ("contains", "method")
IMPORTS = ("imports", "imports_from")
