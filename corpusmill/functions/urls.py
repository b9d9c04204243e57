"""Addresses: objects, parameters to withhold, and the flow that an input starts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: query parameters that carry credentials.
CREDENTIALS = "^(x-amz-|x-goog-)|^(signature|expires|key-pair-id|policy|sig|se|sp|sv|sr|st|skoid|sktid|skt|ske|sks|skv|token|access_token)$"
# File endings and folders that are pointed at, not read.
POINTED_FILE = "^https?://\\S+?(\\.pmtiles|\\.fgb|\\.m3u8|\\.zarr/?|\\.dcm|\\.safetensors|\\.gguf|\\.splat|\\.ply|\\.jpe?g|\\.m4v|\\.tiff?|\\.nc|\\.h5|\\.hdf5|\\.las|\\.laz|\\.parquet|\\.mp4|\\.mov|\\.bin|\\.zip)(\\?\\S*)?$"
POINTED_FOLDER = "^https?://[a-z0-9.-]+\\.s3(\\.[a-z0-9-]+)?\\.amazonaws\\.com/\\S*/$"


def object_of(url: Column) -> Column:
    """Origin (lower case) and path: what an address names, whatever its query."""
    return F.concat(F.lower(F.regexp_extract(url, "^([a-zA-Z]+://[^/?#]+)", 1)), F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1))


def strip_parameters(url: Column, more: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """The address without credential parameters (and ``more`` names), and whether any was there."""
    pattern = f"(?i){CREDENTIALS}" + "".join(f"|^{name}$" for name in more)
    parts = F.split(F.regexp_extract(url, "\\?([^#]*)", 1), "&")
    kept = F.filter(parts, lambda x: ~F.element_at(F.split(x, "="), 1).rlike(pattern))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    gone = F.size(kept) < F.size(parts)
    clean = F.concat(F.regexp_extract(url, "^([^?#]*)", 1), query, F.regexp_extract(url, "(#.*)$", 1))
    return F.when(gone, clean).otherwise(url), gone


def route(text: Column) -> Column:
    """``point``, ``resolve``, ``make`` (a readable address) or ``text``; the first pattern that holds decides."""
    point = text.rlike(f"(?i){POINTED_FILE}") | text.rlike(f"(?i){POINTED_FOLDER}")
    return F.when(point, F.lit("point")).when(text.rlike("^[a-z2-7]{26}$"), F.lit("resolve")).when(text.rlike("^https?://\\S+$"), F.lit("make")).otherwise(F.lit("text"))
