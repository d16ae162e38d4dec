"""Text functions: cutting signatures and notices, HTML to text, threads, names, labels."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Where the substance of a mail or document ends.
NOTICES = (r"(?im)^this (?:e-?mail|email|message)(?: and any attachments?)?\b.*\b(?:confidential|privileged)\b", r"(?im)^confidentiality (?:notice|disclaimer)\b")
SIGN_OFFS = (r"(?m)^--\s*$", r"(?im)^sent from my\b", r"(?im)^(?:kind|best|warm) regards[,!]?\s*$", r"(?im)^(?:many )?thanks[,!]?\s*$", r"(?im)^(?:yours|sincerely)[,!]?\s*$")


def unix_lines(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n?", "\n")


def cut_at(x: Column, markers: tuple[str, ...]) -> Column:
    """x up to the earliest match of a marker: one search for all of them."""
    grouped = "|".join(re.sub(r"^\(\?(\w+)\)(.*)$", r"(?\1:\2)", m) for m in markers)
    return F.regexp_replace(x, rf"(?:{grouped})[\s\S]*", "")


def strip_signature(x: Column) -> Column:
    return F.trim(F.regexp_replace(cut_at(unix_lines(x), SIGN_OFFS + NOTICES), r"^\s+|\s+$", ""))


def strip_notice(x: Column) -> Column:
    return cut_at(unix_lines(x), NOTICES)


def strip_page_marks(x: Column) -> Column:
    return F.regexp_replace(x, r"(?im)^[ \t]*--\s*\d+\s+of\s+\d+\s*--[ \t]*$", "")


def html_text(x: Column) -> Column:
    """Scripts and styles out, tags to spaces, a few entities, single spaces."""
    out = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n\f]+", " "))


def exchange_name(x: Column) -> Column:
    parts = F.split(x, "-")
    internal = x.contains("/O=EXCHANGELABS") | x.contains("/CN=")
    return F.when(x.isNull() | (F.trim(x) == ""), "No Recipient").when(internal & (F.size(parts) > 1), F.lower(F.element_at(parts, -1))).when(internal, "Exchange Internal User").otherwise(x)


def clean_mail_body(text: Column, html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<style[^>]*>.*?</style>", ""), r"<[^>]*>?", "")
    out = F.coalesce(F.nullif(text, F.lit("")), bare, F.lit(""))
    for pattern in (r"[vow]\\:\* \{[^}]+\}", r"\.shape\s*\{[^}]+\}", "MicrosoftInternetExplorer4", r"(?s)<!--\[if [^\]]+\]>.*?<!\[endif\]-->"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(\r?\n|\r){2,}", "\n"), r"[ \t]{2,}", " "))


def thread_blocks(x: Column) -> Column:
    """The mails of a thread, newest first: trimmed blocks that are not empty."""
    blocks = F.split(x, r"(?i)\r?\n(?=From:\s|On .*wrote:|_{10,}|-----Original Message-----|\s*>)")
    return F.filter(F.transform(blocks, lambda b: F.trim(b)), lambda b: b != "")


def thread_parts(x: Column) -> Column:
    """first, second and rest of a thread."""
    b = thread_blocks(x)
    return F.struct(F.coalesce(F.get(b, F.lit(0)), x).alias("first"), F.coalesce(F.get(b, F.lit(1)), F.lit("")).alias("second"), F.array_join(F.slice(b, 3, F.size(b)), "\n\n").alias("rest"))


def header_value(block: Column, header: str) -> Column:
    return F.trim(F.regexp_extract(block, rf"(?im)^{header}:[ \t]*(.*)$", 1))


def strip_quoted_headers(x: Column) -> Column:
    out = F.regexp_replace(x, r"(?im)^(from|to|cc|bcc|subject|date|sent):.*$", "")
    return F.trim(F.regexp_replace(out, r"(?im)^(-----Original Message-----|_{8,}).*$", ""))


def label(x: Column, fallback: Column) -> Column:
    """An audit label: single spaces, 300 characters, or the first 16 of the fallback."""
    clean = F.substring(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")), 1, 300)
    return F.when(clean == "", F.substring(fallback.cast("string"), 1, 16)).otherwise(clean)


def discard_rule(x: Column) -> Column:
    """The rule that a logged discard text stands for; the first that matches."""
    # Texts of old logs.
    options = (("(?i)duplicate", "dup"), ("(?i)password-protected|encrypted", "password"), ("(?i)excluded keyword", "keyword"), ("(?i)subject header pattern|authored by subject", "chat_legacy"), ("(?i)not mentioned|missing subject name", "subject_absent"), ("(?i)0-byte|empty output", "empty_output"), ("(?i)signature image", "signature_image"), ("(?i)unreadable image", "unreadable_image"), ("(?i)unsupported format", "unsupported_type"))
    return F.coalesce(*[F.when(x.rlike(p), rule) for p, rule in options], F.lit("files_filter"))


def masked(x: Column) -> Column:
    return F.regexp_replace(x, r"[^/\\]", "•")


def bytes_label(n: Column, units: tuple[str, ...] = ("KB", "MB", "GB")) -> Column:
    """Bytes as B, or with one decimal in the largest of units (powers of 1024) that they fill; beyond the last, in the last."""
    in_unit = lambda i: F.concat(F.format_string("%.1f", n / 1024.0 ** (i + 1)), F.lit(f" {units[i]}"))
    out = F.when(n < 1024.0, F.concat(n.cast("string"), F.lit(" B")))
    for i in range(len(units) - 1):
        out = out.when(n < 1024.0 ** (i + 2), in_unit(i))
    return out.otherwise(in_unit(len(units) - 1))


def clock(ms: Column) -> Column:
    """Hours, minutes and seconds in two digits; hours in as many as they have."""
    s = F.floor(ms / 1000)
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def column_letters(n: Column) -> Column:
    """A spreadsheet's column label: 1 is A, 27 is AA; up to three letters."""
    char = lambda v: F.char(v + 65)
    return F.when(n <= 26, char(n - 1)).when(n <= 702, F.concat(char(F.floor((n - 27) / 26)), char((n - 1) % 26))).otherwise(F.concat(char(F.floor((n - 703) / 676)), char(F.floor((n - 27) / 26) % 26), char((n - 1) % 26)))


def natural_key(name: Column) -> Column:
    """A key whose order is that of names with their numbers compared as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


# Characters without content, and Windows-1252 for bytes that Latin-1 leaves to controls.
CONTROLS = (*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0))
INVISIBLE = (0xAD, 0x34F, 0x61C, *range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, 0xFEFF)
_UNSEEN = dict.fromkeys((*CONTROLS, *INVISIBLE))
_ARTEFACT = re.compile("[âÃÂ][^\n\r\u2028\u2029]|\ufffd")


def _byte(c: str) -> bytes:
    return bytes([ord(c)]) if ord(c) < 0x100 else c.encode("cp1252")


def repaired(s: str | None) -> str | None:
    """s with UTF-8 that was read as Windows-1252 undone, if that is possible without loss and leaves fewer traces."""
    n = len(_ARTEFACT.findall(s)) if s else 0
    if not n:
        return s
    try:
        t = b"".join(map(_byte, s)).decode("utf-8")
    except UnicodeError:
        return s
    return t if len(_ARTEFACT.findall(t)) < n else s


def normalised(s: str | None) -> str | None:
    """s repaired, with compatibility forms unified, without controls and invisible characters, runs of white space as one space."""
    if s is None:
        return None
    return re.sub(r"\s{2,}", " ", unicodedata.normalize("NFKC", repaired(s)).translate(_UNSEEN)).strip()


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(normalised, na_action="ignore")


@F.pandas_udf(StringType())
def unmojibake(x: pd.Series) -> pd.Series:
    return x.map(repaired, na_action="ignore")


def sample(text: Column, words: list[str], limit: int = 6000, head: int = 3000, max_lines: int = 25, max_line: int = 300) -> Column:
    """A text over the limit as its head and the later lines that hold one of the words: as many as fit, cut to max_line characters each."""
    low = lambda line: F.lower(line)
    hit = lambda line: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low(line), w)) if words else F.lit(False)
    lines = F.slice(F.filter(F.split(F.substring(text, head + 1, 2**31 - 1), "\n"), hit), 1, max_lines)
    start = F.struct(F.lit(0).alias("used"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        cut = F.substring(line, 1, max_line)
        used = acc["used"] + F.length(cut) + 1
        # What doesn't fit ends the list: used stays over the budget from then on.
        return F.struct(used.alias("used"), F.when(used > limit - head, acc["out"]).otherwise(F.concat(acc["out"], F.array(cut))).alias("out"))

    found = F.aggregate(lines, start, step, lambda acc: acc["out"])
    front = F.substring(text, 1, head)
    return F.when(F.length(text) <= limit, text).otherwise(F.when(F.size(found) > 0, F.concat(front, F.lit("\n…\n"), F.array_join(found, "\n"))).otherwise(front))


def sheet_body(html: Column) -> Column:
    """HTML mail in a spreadsheet cell as readable text: hidden parts out, blocks to lines, entities to characters."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"""(?is)<([a-z][\w:-]*)\b[^>]*(?:\bhidden\b|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)[^>]*>.*?</\1\s*>""", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?\s*>|</(?:p|div|tr|li|h[1-6])\s*>", "\n"), r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&zwnj;", ""), ("&shy;", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")
