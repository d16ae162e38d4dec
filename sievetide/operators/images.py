"""Signature images against content: by shape, name, size and recurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that mail programs and companies give to pictures in signatures, and the thresholds.
SIGNATURE_NAME = r"(?i)^(image\d{1,4}|outlook-[\w.-]*|~?wrd\d+|logo[\w.-]*|[\w.-]*logo|banner[\w.-]*|signature[\w.-]*|linkedin|facebook|twitter|instagram|youtube|spacer|pixel|icon[\w.-]*)(\.\w+)?$"
NAMED_SIDE, NAMED_BYTES = 400, 60_000
ICON_SIDE, TINY_BYTES = 64, 5_000
BANNER_RATIO, BANNER_HEIGHT = 5, 160
CONTENT_PIXELS, CONTENT_BYTES = 490_000, 100_000


def classify(name: Column, width: Column, height: Column, size: Column, inline: Column) -> Column:
    """signature, content or ambiguous; the first rule that holds."""
    longest = F.greatest(width, height)
    named = F.element_at(F.split(name, r"[\\/]"), -1).rlike(SIGNATURE_NAME)
    large = (width * height >= CONTENT_PIXELS) | (size >= CONTENT_BYTES)
    signature = (width <= 2) | (height <= 2) | (longest <= ICON_SIDE) | (size < TINY_BYTES) | ((width >= BANNER_RATIO * height) & (height <= BANNER_HEIGHT)) | (named & (longest <= NAMED_SIDE) & (size <= NAMED_BYTES))
    return F.when(signature, "signature").when(~inline & ~named & large, "content").otherwise("ambiguous")


def mark_recurring(images: DataFrame, least: int = 4) -> DataFrame:
    """images (image_hash, mail, width, height, bytes) with recurring: in at least so many mails and not document-sized."""
    mails = images.groupBy("image_hash").agg(F.count_distinct("mail").alias("n_mails"))
    large = (F.col("width") * F.col("height") >= CONTENT_PIXELS) | (F.col("bytes") >= CONTENT_BYTES)
    return images.join(mails, "image_hash", "left").withColumn("recurring", (F.col("n_mails") >= least) & ~large)


def embedded(content_id: Column, related: Column, html: Column) -> Column:
    cid = F.regexp_replace(F.coalesce(content_id, F.lit("")), "[<>]", "")
    return F.coalesce(related, F.lit(False)) | ((cid != "") & F.lower(F.coalesce(html, F.lit(""))).contains(F.concat(F.lit("cid:"), F.lower(cid))))


def header_facts(content: Column) -> Column:
    """(format, width, height) of PNG, GIF and WebP headers by byte positions; JPEG needs sources.parsers.jpeg_facts."""
    n = lambda start, length: F.conv(F.hex(F.substring(content, start, length)), 16, 10).cast("int")
    little = lambda start: F.conv(F.concat(F.hex(F.substring(content, start + 1, 1)), F.hex(F.substring(content, start, 1))), 16, 10).cast("int")
    head = F.hex(F.substring(content, 1, 12))
    facts = lambda kind, w, h: F.struct(F.lit(kind).alias("format"), w.alias("width"), h.alias("height"))
    return F.when(head.startswith("89504E470D0A1A0A"), facts("png", n(17, 4), n(21, 4))).when(head.startswith("474946383"), facts("gif", little(7), little(9))).when(
        head.startswith("52494646") & head.endswith("57454250"), F.when(F.hex(F.substring(content, 13, 4)) == "56503858", facts("webp", little(25) + 1, little(28) + 1)).otherwise(facts("webp", little(27).bitwiseAND(0x3FFF), little(29).bitwiseAND(0x3FFF)))
    )
