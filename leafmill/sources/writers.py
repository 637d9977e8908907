"""Responses, caches and metrics as text that other programs read."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import from_data_url, hex_key, safe_filename


def cache_json(entries: DataFrame, capacity: int = 10_000) -> DataFrame:
    """One line of JSON: the cache as a map of hexadecimal keys. More than `capacity` entries, the cache's bound, are an error."""
    pair = F.struct(hex_key("key").alias("key"), F.struct("original_text", "translated_text").alias("value"))
    some = entries.limit(capacity + 1).agg(F.array_sort(F.collect_list(pair)).alias("__all"))
    checked = F.when(F.size("__all") <= capacity, F.col("__all")).otherwise(F.raise_error(F.lit(f"the cache holds more than {capacity} entries")).cast(some.schema["__all"].dataType))
    return some.select(F.to_json(F.map_from_entries(checked)).alias("value"))


def page_result(index: str, filename: str, error: str, data_url: Column, ms: Column) -> Column:
    """JSON of one page's result; absent parts are left out."""
    return F.to_json(F.struct(F.col(index).alias("index"), F.col(filename).alias("filename"), F.col(error).isNull().alias("success"), ms.alias("processing_time_ms"), F.col(error).alias("error"), data_url.alias("data_url")))


#: Fields of a response's entries, and their JSON schemas.
NUMBERED = {"bubble_number": {"type": "integer"}, "original_text": {"type": "string"}, "translated_text": {"type": "string"}}
STRUCTURED = {"id": {"type": "integer", "description": "The region ID from the input"}, "text": {"type": "string", "description": "The translated text"}}


def list_schema(entry: dict[str, dict], strict: bool = False) -> dict:
    """JSON schema of an object with `translations`, a list of entries, all fields required; strict ones forbid further fields."""
    closed = {"additionalProperties": False} if strict else {}
    item = {"type": "object", "properties": entry, "required": list(entry)} | closed
    return {"type": "object", "properties": {"translations": {"type": "array", "items": item}}, "required": ["translations"]} | closed


def generation_config(thinking: bool) -> dict:
    """Answers as JSON by the schema of numbered texts; without thinking, a budget of 0."""
    return {"response_mime_type": "application/json", "response_schema": list_schema(NUMBERED)} | ({} if thinking else {"thinkingConfig": {"thinking_budget": 0}})


def request_body(prompt: Column, images: Column) -> Column:
    """JSON body of a vision request: a prompt, then the images as inline data."""
    return _body(F.concat(F.array(F.to_json(F.struct(prompt.alias("text")))), _inline(images)), None)


def numbered_request(prompt: Column, images: Column, thinking: bool = False) -> Column:
    """JSON body of a numbered translation request: the images, then the prompt, and the schema of the answer."""
    return _body(F.concat(_inline(images), F.array(F.to_json(F.struct(prompt.alias("text"))))), generation_config(thinking))


#: Prompts; %s is the target language.
NUMBERED_PROMPT = (
    "Each image shows a text bubble with a VISIBLE NUMBER on the LEFT side. For each image, identify the bubble by its visible number and extract the text. Translate the text to %s. "
    "Return a JSON array where each object has: - 'bubble_number': the visible number shown on the left of the image (integer) "
    "- 'original_text': the extracted text (ignore the number, extract only the bubble content) - 'translated_text': the translation "
    "If no text is found in a bubble, use empty strings for text fields but still include the bubble_number."
)
SYSTEM_PROMPT = "You are a Japanese to %s translator. Translate each text naturally while fixing any OCR errors. Do not add extra words or explanations. Return translations in the exact JSON format specified."
USER_PROMPT = "Translate each Japanese text to %s. Input:\n%s"


def structured_request(model: str, language: Column, items: Column) -> Column:
    """JSON body of a text request whose answer is a strict list of (id, text); `items` is an array of such structs."""
    said = {"type": "json_schema", "json_schema": {"name": "translation_response", "strict": True, "schema": list_schema(STRUCTURED, True)}}
    user = F.format_string(USER_PROMPT, language, F.to_json(items))
    messages = F.to_json(F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", F.format_string(SYSTEM_PROMPT, language)), ("user", user))]))
    rest = {"stream": False, "max_completion_tokens": 65536, "temperature": 1.0, "top_p": 1.0, "reasoning_effort": "medium", "response_format": said}
    return F.concat(F.lit('{"model":' + json.dumps(model) + ',"messages":'), messages, F.lit("," + json.dumps(rest, separators=(",", ":"))[1:]))


def _inline(images: Column) -> Column:
    return F.transform(images, lambda x: F.to_json(F.struct(F.struct(F.lit("image/png").alias("mime_type"), F.regexp_replace(F.base64(x), r"\s", "").alias("data")).alias("inline_data"))))


def _body(parts: Column, config: dict | None) -> Column:
    end = "]}]" + (f',"generationConfig":{json.dumps(config, separators=(",", ":"))}' if config else "") + "}"
    return F.concat(F.lit('{"contents":[{"parts":['), F.array_join(parts, ","), F.lit(end))


def response_texts(body: Column) -> Column:
    """Array of (bubble_number, original_text, translated_text) of a vision response: JSON inside JSON."""
    inner = F.get_json_object(body, "$.candidates[0].content.parts[0].text")
    return F.from_json(inner, "translations array<struct<bubble_number:bigint,original_text:string,translated_text:string>>")["translations"]


def response_image(body: Column) -> Column:
    return F.unbase64(F.get_json_object(body, "$.candidates[0].content.parts[0].inline_data.data"))


def token_usage(body: Column, field: str) -> Column:
    return F.coalesce(F.get_json_object(body, f"$.usageMetadata.{field}").try_cast("bigint"), F.lit(0).cast("long"))


def structured_texts(body: Column) -> Column:
    """Array of (id, text) of a text model's structured output."""
    return F.from_json(body, "translations array<struct<id:bigint,text:string>>")["translations"]


def write_images(pages: DataFrame, folder: str, filename: str = "filename", url: str = "data_url") -> DataFrame:
    """Decodes data URLs into files of a folder that all workers share, and gives (filename, n_bytes, error) of each page.

    Names are made safe first, and put under their row's number if two pages have one name. A page without a data URL has no file. Retries write the same
    bytes to the same name, through a file of their own that is then moved.
    """
    stem, suffix = F.regexp_replace(filename, r"\.[^.]*$", ""), F.regexp_extract(filename, r"(\.[A-Za-z0-9]+)$", 1)
    twice = F.row_number().over(Window.partitionBy(filename).orderBy("index"))
    name = F.concat(safe_filename(stem), F.when(twice > 1, F.concat(F.lit("_"), twice.cast("string"))).otherwise(F.lit("")), suffix)
    rows = pages.select(name.alias("filename"), from_data_url(url).alias("content"))
    return rows.mapInArrow(_files(folder), "filename string, n_bytes long, error string")


def _files(folder: str):
    def run(batches):
        import os
        import uuid

        import pyarrow as pa

        for batch in batches:
            sizes, errors = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                error = None
                if content is not None:
                    part = os.path.join(folder, f".{uuid.uuid4().hex}")
                    try:
                        with open(part, "wb") as f:
                            f.write(content)
                        os.replace(part, os.path.join(folder, name))
                    except OSError as e:
                        error = str(e)
                sizes.append(len(content) if content is not None and error is None else None)
                errors.append(error)
            yield pa.record_batch({"filename": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "error": pa.array(errors, pa.string())})

    return run
