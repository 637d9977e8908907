"""Errors of the page pipeline as exceptions and as columns: a kind, a text and the page and bubble they belong to.

A failed page or region keeps its row, with the error; nothing that belongs to other rows is lost with it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of the kinds of errors by family; names in braces are their fields.
TEXTS = {
    "detection": {
        "InferenceFailed": "ONNX inference failed: {reason}",
        "PreprocessingFailed": "Image preprocessing failed: {reason}",
        "NoBubbles": "No bubbles detected with confidence >= {threshold} (page {page_index})",
        "InvalidImageSize": "Invalid image dimensions: {width}x{height}",
    },
    "translation": {
        "AllKeysFailed": "All {key_count} API keys exhausted after {attempts} attempts",
        "ApiRequestFailed": "API request failed: {reason}",
        "ValidationFailed": "Translation validation failed: {reason}",
        "InvalidResponse": "Invalid response format: {reason}",
        "RateLimited": "Rate limit exceeded for API key (retry after {seconds}s)",
        "UnhealthyApiKey": "API key {key_index} is unhealthy (consecutive failures: {failures})",
    },
    "rendering": {
        "FontNotFound": "Font not found: {family} (searched paths: {paths})",
        "TextOverflow": "Text doesn't fit in bubble (text: {text_width}x{text_height}, bubble: {bubble_width}x{bubble_height})",
        "ImageError": "Image processing failed: {reason}",
        "FontLoadError": "Font loading failed: {reason}",
        "InvalidBubbleDimensions": "Invalid bubble dimensions: {reason}",
    },
    "cache": {
        "LoadFailed": "Failed to load cache from {path}: {reason}",
        "SaveFailed": "Failed to save cache to {path}: {reason}",
        "DeserializationFailed": "Cache deserialization failed: {reason}",
        "CompressionFailed": "Compression failed: {reason}",
        "DirectoryCreationFailed": "Cache directory creation failed: {reason}",
    },
    "pipeline": {
        "DetectionFailed": "Detection failed on page {page_index}: {reason}",
        "TranslationFailed": "Translation failed for bubble {bubble_index} on page {page_index}: {reason}",
        "RenderingFailed": "Rendering failed for bubble {bubble_index} on page {page_index}: {reason}",
        "CacheFailed": "Cache operation failed: {reason}",
        "ImageLoadFailed": "Image loading failed for page {page_index}: {reason}",
        "BatchFailed": "Batch processing failed: {reason}",
        "TaskJoinFailed": "Task join failed: {reason}",
    },
    "config": {
        "NoApiKeys": "No API keys configured (set GEMINI_API_KEYS environment variable)",
        "InvalidDetectionConfig": "Invalid detection config: {reason}",
        "InvalidTranslationConfig": "Invalid translation config: {reason}",
        "InvalidRenderingConfig": "Invalid rendering config: {reason}",
        "InvalidCachePath": "Invalid cache path: {reason}",
        "InvalidConfidenceThreshold": "Confidence threshold must be in [0.0, 1.0], got {value}",
        "InvalidIoUThreshold": "IoU threshold must be in [0.0, 1.0], got {value}",
        "InvalidBatchSize": "Batch size must be > 0, got {value}",
        "EnvVarError": "Environment variable parsing failed: {reason}",
    },
}
_FAMILY = {kind: family for family, kinds in TEXTS.items() for kind in kinds}
#: What a family's errors become when they meet the page (and bubble) that they belong to.
_AT_PAGE, _AT_BUBBLE = {"detection": "DetectionFailed"}, {"translation": "TranslationFailed", "rendering": "RenderingFailed"}


@dataclass
class PageError(Exception):
    """An error of a kind of `TEXTS`, with the fields that its text names."""

    kind: str
    fields: dict = field(default_factory=dict)

    @property
    def family(self) -> str:
        return _FAMILY[self.kind]

    def __str__(self) -> str:
        return TEXTS[self.family][self.kind].format(**self.fields)

    def at(self, page_index: int, bubble_index: int | None = None) -> PageError:
        """The pipeline's error that this one causes: on a page for detection, on a page's bubble for the others."""
        kinds = _AT_PAGE if bubble_index is None else _AT_BUBBLE
        if self.family not in kinds:
            raise ValueError(f"{self.family} errors have {'a' if bubble_index is None else 'no'} bubble")
        where = {"page_index": page_index} | ({} if bubble_index is None else {"bubble_index": bubble_index})
        out = PageError(kinds[self.family], where | {"reason": str(self)})
        out.__cause__ = self
        return out


def error_text(kind: str, **fields: Column) -> Column:
    """Text of an error as a column, null if one of its fields is."""
    text = TEXTS[_FAMILY[kind]][kind]
    parts = []
    for literal, name in _pieces(text):
        parts.append(F.lit(literal))
        if name:
            parts.append(fields[name].cast("string"))
    return F.concat(*parts)


def _pieces(text: str):
    from string import Formatter

    return [(literal, name) for literal, name, _, _ in Formatter().parse(text)]


def isolated(rows: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """rows with `error_kind` and `error`: of the first check (in the order given) whose condition a row fails; both null for good rows.

    checks: kind to (condition that must hold, error text). A condition that is null fails.
    """
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (holds, said) in reversed(checks.items()):
        bad = ~F.coalesce(holds, F.lit(False))
        kind, text = F.when(bad, F.lit(name)).otherwise(kind), F.when(bad, said).otherwise(text)
    return rows.withColumns({"error_kind": kind, "error": text})
