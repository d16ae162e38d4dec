"""Identity functions: SHA-256 over labelled parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(x: Column) -> Column:
    return F.sha2(x.cast("string").cast("binary"), 256)


def parts_hash(label: str, *parts: Column, sep: str = ":") -> Column:
    """SHA-256 of label and parts joined by sep; null parts count as empty."""
    return sha(F.concat_ws(sep, F.lit(label), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def letters_digits(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def fallback_hash(sender: Column, subject: Column, body: Column) -> Column:
    """Identity of a mail without a usable message id: sender, subject without its reply marks, and 100 characters of the body."""
    bare = F.regexp_replace(F.lower(F.coalesce(subject, F.lit(""))), r"^(re|fw|fwd|wg|aw)\s*:\s*", "")
    return sha(F.concat_ws("_", letters_digits(sender), letters_digits(bare), F.substring(letters_digits(body), 21, 100)))


def base_hash(message_id: Column, fallback: Column) -> Column:
    return F.when(F.length(message_id) > 5, sha(message_id)).otherwise(fallback)


def email_hash(scope: Column, base: Column) -> Column:
    return sha(F.concat_ws("::", scope, base))


def file_item_id(source: Column, path: Column) -> Column:
    return parts_hash("file", source, path)


def child_item_id(parent: Column, key: Column) -> Column:
    return parts_hash("child", parent, key)


def attachment_item_id(parent: Column, name: Column) -> Column:
    return parts_hash("attachment", parent, name)


def duplicate_item_id(source: Column, hash_: Column, n: Column) -> Column:
    return parts_hash("duplicate", source, hash_, n)


def source_row_id(request: Column, path: Column, wave: Column) -> Column:
    """24 hex digits of request and path; later waves have rows of their own."""
    first = F.concat_ws(":", request.cast("string"), path)
    later = F.concat_ws(":", request.cast("string"), F.concat(F.lit("w"), wave.cast("string")), path)
    return F.substring(sha(F.when(wave > 1, later).otherwise(first)), 1, 24)


def scan_id(path: Column) -> Column:
    return F.substring(sha(path), 1, 12)


def judgement_key(content_hash: Column) -> Column:
    return F.concat(F.lit("mail:"), F.substring(content_hash, 1, 24))


def message_key(author: Column, date: Column, time: Column, text: Column) -> Column:
    joined = F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in (author, date, time, text)])
    return F.concat(F.lit("chat:"), sha(F.regexp_replace(F.lower(joined), r"\s+", " ")))


def state_signature(*values: Column) -> Column:
    return sha(F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]))


def case_key(path: Column) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, 2), "/")
