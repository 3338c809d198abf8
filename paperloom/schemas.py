"""Canonical schemas of the document store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

STEP_FLAGS = [
    "file_landed",
    "ocr_completed",
    "gpt_extraction_completed",
    "gpt_evaluation_completed",
    "gpt_summary_completed",
    "processing_completed",
]
SKIP_FLAGS = ["ocr_skipped", "gpt_evaluation_skipped", "gpt_summary_skipped"]
TIMED_STEPS = STEP_FLAGS[:5]
OPTION_FLAGS = ["include_ocr", "include_images", "enable_summary", "enable_evaluation"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _B, _D, _L, _I = T.StringType(), T.BooleanType(), T.DoubleType(), T.LongType(), T.IntegerType()

PROPERTIES = _struct(
    blob_name=_S, blob_size=_L, request_timestamp=T.TimestampNTZType(), num_pages=_I,
    dataset=_S, total_time_seconds=_D, ocr_provider_used=_S,
)
STATE = _struct(
    **{f: _B for f in STEP_FLAGS + SKIP_FLAGS},
    **{f"{f}_time_seconds": _D for f in TIMED_STEPS},
    finished=_B, error=_B,
)
EXTRACTED = _struct(
    ocr_output=_S, gpt_extraction_output=T.VariantType(),
    gpt_extraction_output_with_evaluation=T.VariantType(), gpt_summary_output=_S, classification=_S,
)
MODEL_INPUT = _struct(
    model_deployment=_S, model_prompt=_S, example_schema=T.VariantType(), max_pages_per_chunk=_I,
)
OPTIONS = _struct(**{f: _B for f in OPTION_FLAGS})

DOCUMENTS = _struct(
    id=_S, dataset=_S, properties=PROPERTIES, state=STATE, extracted_data=EXTRACTED,
    model_input=MODEL_INPUT, processing_options=OPTIONS, errors=T.ArrayType(_S),
    human_corrected=_B, last_correction_timestamp=T.TimestampNTZType(),
)

DATASET_CONFIG = _struct(
    dataset=_S, model_prompt=_S, example_schema=_S, max_pages_per_chunk=_I, processing_options=OPTIONS,
)

EVENT_DATA = _struct(
    api=_S, requestId=_S, eTag=_S, contentType=_S, contentLength=_L, blobType=_S, url=_S,
    sequencer=_S, validationCode=_S,
)
EVENT = _struct(
    topic=_S, subject=_S, eventType=_S, eventTime=_S, id=_S, data=EVENT_DATA,
    dataVersion=_S, metadataVersion=_S,
)


def has_field(df: DataFrame, path: str) -> bool:
    """True when the dotted path exists in the frame's schema."""
    node: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(node, T.StructType) or part not in node.fieldNames():
            return False
        node = node[part].dataType
    return True


def optional(df: DataFrame, path: str, kind: str = "string"):
    """Column at the path, or a typed null: records in the store need not have every key."""
    return F.col(path) if has_field(df, path) else F.lit(None).cast(kind)
