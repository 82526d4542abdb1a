"""Record schema, closed sets of values and the invariants of records."""

from __future__ import annotations

from pyspark.sql import types as T

STATES = ("ready", "failed", "unsupported", "skipped")
FAMILIES = ("text", "image", "audio", "video")
STAGES = ("discovering", "encoding", "completed", "cancelled")
#: The error codes of files and of runs.
ERROR_CODES = (
    "invalid_request", "unsupported_schema_version", "unknown_profile", "invalid_vector_file", "io_error",
    "resource_budget_too_small", "source_changed", "unsupported_format", "unselected_family", "invalid_text",
    "insufficient_content", "runtime_unavailable", "model_integrity", "decode_failed", "worker_failed",
    "worker_timeout", "output_closed", "cancelled",
)
DIMENSIONS = 4096
NORM_TOLERANCE = 1e-5

ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("message", T.StringType()), T.StructField("details", T.StringType())])
VECTOR = T.ArrayType(T.FloatType(), False)
RECORD = T.StructType(
    [
        T.StructField("path_bytes", T.BinaryType(), False),
        T.StructField("path", T.StringType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("state", T.StringType(), False),
        T.StructField("family", T.StringType()),
        T.StructField("profile_id", T.StringType()),
        T.StructField("vector", VECTOR),
        T.StructField("vector_sha256", T.StringType()),
        T.StructField("reused", T.BooleanType(), False),
        T.StructField("error", ERROR),
        T.StructField("extraction", T.StringType()),
    ]
)


class LodestoneError(Exception):
    """A failure of a whole run; failures of files are rows."""

    def __init__(self, code: str, stage: str, message: str, details: object = None):
        if code not in ERROR_CODES:
            raise ValueError(f"no error code {code}")
        super().__init__(message)
        self.code, self.stage, self.message, self.details = code, stage, message, details

    def as_dict(self) -> dict:
        out = {"code": self.code, "stage": self.stage, "message": self.message}
        return out if self.details is None else out | {"details": self.details}

    @property
    def exit_code(self) -> int:
        """2 for what the caller can mend, 130 for a cancelled run, 1 for the rest."""
        if self.code == "cancelled":
            return 130
        return 2 if self.code in ("invalid_request", "unsupported_schema_version", "unknown_profile", "invalid_vector_file", "resource_budget_too_small") else 1
