"""Stable issue codes and the error that carries them."""
from __future__ import annotations

#: Codes that results are compared by.
SOURCE_PATH_NOT_FOUND = "SOURCE_PATH_NOT_FOUND"
TARGET_PATH_NOT_FOUND = "TARGET_PATH_NOT_FOUND"
INVALID_INPUT = "INVALID_INPUT"
INVALID_EXPRESSION = "INVALID_EXPRESSION"
UNSUPPORTED_MAPPING_VERSION = "UNSUPPORTED_MAPPING_VERSION"
DUPLICATE_TARGET_ASSIGNMENT = "DUPLICATE_TARGET_ASSIGNMENT"
OVERLAPPING_TARGET_ASSIGNMENT = "OVERLAPPING_TARGET_ASSIGNMENT"
TYPE_MISMATCH = "TYPE_MISMATCH"
LOSSY_CAST = "LOSSY_CAST"
NUMERIC_PRECISION_RISK = "NUMERIC_PRECISION_RISK"
REQUIRED_TARGET_UNMAPPED = "REQUIRED_TARGET_UNMAPPED"
EVALUATION_LIMIT_EXCEEDED = "EVALUATION_LIMIT_EXCEEDED"
DIVIDE_BY_ZERO = "DIVIDE_BY_ZERO"
INVALID_DATE = "INVALID_DATE"
REMOTE_REF_DISABLED = "REMOTE_REF_DISABLED"
CYCLIC_REF = "CYCLIC_REF"
UNSUPPORTED_SCHEMA_FEATURE = "UNSUPPORTED_SCHEMA_FEATURE"
SOURCE_SCHEMA_VALIDATION = "SOURCE_SCHEMA_VALIDATION"
TARGET_SCHEMA_VALIDATION = "TARGET_SCHEMA_VALIDATION"
INVARIANT_FAILED = "INVARIANT_FAILED"
GOLDEN_OUTPUT_MISMATCH = "GOLDEN_OUTPUT_MISMATCH"
STALE_SUGGESTION_REPORT = "STALE_SUGGESTION_REPORT"
INVALID_REVIEW_DECISION = "INVALID_REVIEW_DECISION"
REVIEW_TARGET_NOT_FOUND = "REVIEW_TARGET_NOT_FOUND"
REVIEW_CANDIDATE_NOT_FOUND = "REVIEW_CANDIDATE_NOT_FOUND"
SUGGESTION_TARGET_MISSING = "SUGGESTION_TARGET_MISSING"
SUGGESTION_TARGET_DUPLICATE = "SUGGESTION_TARGET_DUPLICATE"
PROVIDER_RESPONSE_INVALID = "PROVIDER_RESPONSE_INVALID"
MODEL_CONTEXT_TOO_LARGE = "MODEL_CONTEXT_TOO_LARGE"
BENCHMARK_GATE_FAILED = "BENCHMARK_GATE_FAILED"


class MappingError(ValueError):
    """Issues found on the driver: (code, message, path) each."""

    def __init__(self, *issues: tuple[str, str, str]):
        self.issues = issues
        super().__init__("; ".join(f"{c} at {p or chr(47)}: {m}" for c, m, p in issues))

    @property
    def codes(self) -> list[str]:
        return [c for c, _, _ in self.issues]


def fail(code: str, message: str, path: str = "") -> MappingError:
    return MappingError((code, message, path))
