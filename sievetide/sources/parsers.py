"""Decoders for single files: mail, archives, chats, password marks, JPEG headers. Arrow batches in, rows out."""

from __future__ import annotations

import email
import email.policy
import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

MAIL = "path string, depth int, parent string, message_id string, sender string, recipients array<string>, subject string, date string, text string, html string, attachments array<struct<filename: string, content_type: string, size: long, content: binary>>"
#: Limits of archive expansion.
MAX_DEPTH, MAX_ENTRIES, MAX_BYTES = 3, 50_000, 50 * 2**30


def _mail_rows(path: str, raw: bytes) -> Iterator[tuple]:
    """A mail and all mails attached to it, however deep, outer ones first."""
    waiting = [(path, raw, 0, None)]
    while waiting:
        where, data, depth, parent = waiting.pop()
        row, nested = _mail(data)
        own = f"{where}#{depth}" if depth else where
        yield own, depth, parent, *row
        waiting.extend((f"{where}/{i}", x, depth + 1, own) for i, x in reversed(list(enumerate(nested))))


def _mail(raw: bytes) -> tuple[tuple, list[bytes]]:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    text, html, attachments, nested = "", "", [], []
    inside: set[int] = set()
    for part in m.walk():
        if id(part) in inside:
            continue
        kind, name = part.get_content_type(), part.get_filename()
        if kind == "message/rfc822":
            nested += [x.as_bytes() for x in part.get_payload()]
            inside.update(id(x) for x in part.walk())
        elif part.is_multipart():
            continue
        elif name or part.get_content_disposition() == "attachment":
            data = part.get_payload(decode=True) or b""
            if name and name.lower().endswith(".eml"):
                nested.append(data)
            else:
                attachments.append({"filename": name, "content_type": kind, "size": len(data), "content": data})
        elif kind in ("text/plain", "text/html"):
            try:
                body = part.get_content()
            except (LookupError, UnicodeError):  # a charset that isn't one
                body = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
            text, html = (text + body, html) if kind == "text/plain" else (text, html + body)
    to = [a.strip() for h in ("to", "cc", "bcc") for v in m.get_all(h, []) for a in str(v).split(",") if a.strip()]
    return (str(m.get("message-id", "")).strip(), str(m.get("from", "")), to, str(m.get("subject", "")), str(m.get("date", "")), text, html, attachments), nested


def parse_mail(contents: DataFrame) -> DataFrame:
    """contents (path, content) of .eml files as mails; attached mails are rows with depth and parent. Null contents give no row."""
    names = [f.split(" ")[0] for f in re.split(r", (?![^<]*>)", MAIL)]

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                if raw is not None:
                    yield pd.DataFrame(list(_mail_rows(path, bytes(raw))), columns=names)

    return contents.select("path", "content").mapInPandas(of, MAIL)


# The markup of chat exports.
MESSAGE_TAG = r"""(?i)<div\s+class="\s*message\s[^"]*"(?:\sid="([^"]*)")?[^>]*>"""
CONTENT_TAG = r"""(?i)<div[^>]*class="[^"]*\bmessage__content\b[^"]*"[^>]*>"""
CHAT_PARTS = {"author": "message__author", "date": "message__date", "time": "message__time", "recipient": "message__recepient"}


def markup_text(html: Column) -> Column:
    """Markup as text: scripts and styles out, breaks as lines, tags as spaces, entities as characters."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style).*?</\1>", " "), r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>?", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'")):
        out = F.regexp_replace(out, f"(?i){entity}", char)
    numbers = F.array_distinct(F.regexp_extract_all(out, F.lit(r"&#(\d{1,7});"), F.lit(1)))
    character = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    out = F.aggregate(numbers, out, lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), F.when(n.cast("long") < 0x110000, character(n)).otherwise(F.lit("\ufffd"))))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def parse_chat(html: Column) -> Column:
    """The messages of an HTML chat export, as an array of structs (seq, id, author, date, time, recipient, content) in order.

    A message begins at a div whose first class is message, with others after it; its id is the tag's, or its place in the
    chat. Parts are the elements of their class; the content runs to the message's embedded data or its end. HTML that is
    no export has none.
    """
    part = lambda block, name: markup_text(F.regexp_extract(block, rf"""(?is)<(span|p|div)[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</\1>""", 2))

    def content(block: Column) -> Column:
        rest = F.element_at(F.split(block, CONTENT_TAG, 2), -1)
        rest = F.regexp_replace(F.substring_index(rest, '<script type="application/json"', 1), r"(?i)\s*</div>\s*$", "")
        return F.when(block.rlike(CONTENT_TAG), markup_text(rest)).otherwise("")

    ids = F.regexp_extract_all(html, F.lit(MESSAGE_TAG), F.lit(1))
    blocks = F.split(html, MESSAGE_TAG)
    blocks = F.slice(blocks, 2, F.size(blocks))
    named = F.zip_with(ids, blocks, lambda i, b: F.struct(i.alias("i"), b.alias("b")))
    return F.transform(
        named,
        lambda m, k: F.struct(k.alias("seq"), F.coalesce(F.nullif(m["i"], F.lit("")), F.concat(F.lit("m"), k.cast("string"))).alias("id"), *[part(m["b"], c).alias(n) for n, c in CHAT_PARTS.items()], content(m["b"]).alias("content")),
    )


def _zip_state(raw: bytes | None) -> str:
    if raw is None:
        return "corrupt"
    try:
        entries = zipfile.ZipFile(io.BytesIO(raw)).infolist()
    except (zipfile.BadZipFile, ValueError):
        return "corrupt"
    if any(e.flag_bits & 1 for e in entries):
        return "encrypted"
    return "over_limit" if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_BYTES else "ok"


@F.pandas_udf(StringType())
def zip_state(content: pd.Series) -> pd.Series:
    """ok, encrypted, corrupt or over_limit, from the archive's directory alone."""
    return content.map(lambda x: _zip_state(None if x is None else bytes(x)))


MAX_COMPONENT = 240


def entry_name(entry: zipfile.ZipInfo) -> str:
    """An entry's name: UTF-8 where it is flagged or reads as such, else the DOS code page."""
    if not entry.flag_bits & 0x800:
        try:
            return entry.orig_filename.encode("cp437").decode("utf-8")
        except UnicodeError:
            pass
    return entry.filename


def safe_path(name: str) -> str | None:
    """An entry's name as a relative path with parts of at most MAX_COMPONENT bytes; null if it would leave its folder."""
    name = name.replace("\\", "/")
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if name.startswith("/") or not parts or any(p == ".." or "\0" in p or re.fullmatch(".:", p) for p in parts):
        return None
    return "/".join(map(_short, parts))


def _short(part: str) -> str:
    """A part that is too long is cut before its ending and told apart by a hash."""
    raw = part.encode("utf-8", "replace")
    if len(raw) <= MAX_COMPONENT:
        return part
    ending = re.search(r"(?<=.)\.[^.]{1,19}$", part)
    tail = "~" + hashlib.sha1(raw).hexdigest()[:6] + (ending[0] if ending else "")
    return raw[: MAX_COMPONENT - len(tail.encode())].decode("utf-8", "ignore") + tail


def _expand(path: str, raw: bytes, depth: int) -> Iterator[tuple]:
    if not path.lower().endswith(".zip") or depth >= MAX_DEPTH:
        yield path, depth, "kept", raw
        return
    state = _zip_state(raw)
    if state != "ok":
        yield path, depth, {"encrypted": "password", "corrupt": "zip_error"}.get(state, "kept"), raw
        return
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for e in z.infolist():
            name = safe_path(entry_name(e))
            if e.is_dir():
                continue
            if name is None:
                yield f"{path}/{entry_name(e)}", depth + 1, "unsafe_path", None
                continue
            try:
                data = z.read(e)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                yield f"{path}/{name}", depth + 1, "zip_error", None  # only this entry is lost
                continue
            yield from _expand(f"{path}/{name}", data, depth + 1)


def expand_archives(contents: DataFrame) -> DataFrame:
    """contents (path, content) with archives replaced by their files, up to MAX_DEPTH levels; state says why one is left as it is.

    An entry that can't be read (zip_error) or whose name leaves its folder (unsafe_path) is a row without content; the
    others of its archive are unpacked.
    """

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                if raw is not None:
                    for row in _expand(path, bytes(raw), 0):  # file by file: an archive is never held expanded
                        yield pd.DataFrame([row], columns=["path", "depth", "state", "content"])

    return contents.select("path", "content").mapInPandas(of, "path string, depth int, state string, content binary")


def _zip_locked(raw: bytes) -> bool:
    """Whether any entry in an archive's directory is encrypted; without a directory, the first entry decides."""
    try:
        return any(e.flag_bits & 1 for e in zipfile.ZipFile(io.BytesIO(raw)).infolist())
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        return len(raw) > 7 and bool(raw[6] & 1)


def _ole_streams(raw: bytes) -> list[tuple[str, bytes]]:
    """Names of a compound file's entries with the first bytes of each stream that lies in whole sectors."""
    size = 1 << struct.unpack_from("<H", raw, 30)[0]
    start = struct.unpack_from("<I", raw, 48)[0]
    small = struct.unpack_from("<I", raw, 56)[0]
    table = []
    for at in struct.unpack_from("<109I", raw, 76):
        if at < 0xFFFFFFFA:
            table += struct.unpack_from(f"<{size // 4}I", raw, (at + 1) * size)
    out, seen = [], set()
    while start < 0xFFFFFFFA and start not in seen:
        seen.add(start)
        for at in range((start + 1) * size, (start + 2) * size, 128):
            length, kind = struct.unpack_from("<HB", raw, at + 64)
            if kind in (2, 5) and length > 2:
                name = raw[at : at + length - 2].decode("utf-16-le", "replace")
                first, n = struct.unpack_from("<II", raw, at + 116)
                out.append((name, raw[(first + 1) * size :][: min(n, size)] if n >= small else b""))
        start = table[start] if start < len(table) else 0xFFFFFFFE
    return out


def _ole_locked(raw: bytes) -> bool:
    """Whether an Office compound file is encrypted: an encrypted package, Word's flag, or a workbook's password record."""
    for name, data in _ole_streams(raw):
        if name in ("EncryptedPackage", "EncryptionInfo"):
            return True
        if name == "WordDocument" and len(data) > 11 and struct.unpack_from("<H", data, 10)[0] & 0x100:
            return True
        if name in ("Workbook", "Book"):
            at = 0
            while at + 4 <= len(data):
                record, length = struct.unpack_from("<HH", data, at)
                if record == 0x2F:
                    return True
                if record == 0x0A:
                    break
                at += 4 + length
    return False


def _locked(raw: bytes | None) -> bool:
    if not raw or len(raw) < 8:
        return False
    try:
        if raw.startswith(b"PK\x03\x04") or raw.startswith(b"PK\x05\x06"):
            return _zip_locked(raw)
        if raw.startswith(bytes.fromhex("D0CF11E0A1B11AE1")):
            return _ole_locked(raw)
        if raw.startswith(b"Rar!\x1a\x07\x01\x00"):
            return _rar5_locked(raw)
        if raw.startswith(b"Rar!\x1a\x07\x00"):
            return _rar4_locked(raw)
        if raw.startswith(b"7z\xbc\xaf\x27\x1c"):
            offset, length = struct.unpack_from("<QQ", raw, 12)
            return b"\x06\xf1\x07\x01" in raw[32 + offset : 32 + offset + length]
    except (struct.error, IndexError):
        pass
    return False


def _rar4_locked(raw: bytes) -> bool:
    """The main header's mark for encrypted headers, or any file header's for an encrypted file."""
    at = 7
    while at + 7 <= len(raw):
        kind, flags, size = struct.unpack_from("<BHH", raw, at + 2)
        if kind == 0x73 and flags & 0x80 or kind == 0x74 and flags & 0x04:
            return True
        more = struct.unpack_from("<I", raw, at + 7)[0] if flags & 0x8000 or kind == 0x74 else 0
        if size < 7 or kind == 0x7B:
            return False
        at += size + more
    return False


def _number(raw: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and where it ends."""
    value = shift = 0
    while True:
        value |= (raw[at] & 0x7F) << shift
        at, more, shift = at + 1, raw[at] & 0x80, shift + 7
        if not more or shift > 63:
            return value, at


def _rar5_locked(raw: bytes) -> bool:
    """An encryption header, or a file header with an encryption record."""
    at = 8
    while at + 7 <= len(raw):
        size, start = _number(raw, at + 4)
        kind, p = _number(raw, start)
        if kind == 4:
            return True
        flags, p = _number(raw, p)
        extra, p = _number(raw, p) if flags & 1 else (0, p)
        data, p = _number(raw, p) if flags & 2 else (0, p)
        q, end = start + size - extra, start + size
        while kind in (2, 3) and q < end:
            length, q2 = _number(raw, q)
            if _number(raw, q2)[0] == 1:
                return True
            q = q2 + length
        if kind == 5 or not size:
            return False
        at = end + data
    return False


@F.pandas_udf(BooleanType())
def protected(content: pd.Series) -> pd.Series:
    """Whether a file needs a password: encrypted zip entries, Office files, RAR 4 and 5, and 7z archives, by their headers."""
    return content.map(lambda x: _locked(None if x is None else bytes(x)))


def _jpeg(raw: bytes | None) -> tuple[int, int] | None:
    if not raw or raw[:2] != b"\xff\xd8":
        return None
    i = 2
    while i + 9 < len(raw):
        if raw[i] != 0xFF:
            return None
        mark = raw[i + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", raw[i + 5 : i + 9])
            return w, h
        i += 2 + struct.unpack(">H", raw[i + 2 : i + 4])[0]
    return None


@F.pandas_udf(StructType().add("width", IntegerType()).add("height", IntegerType()))
def jpeg_facts(content: pd.Series) -> pd.DataFrame:
    """Width and height of a JPEG; nulls for anything else."""
    return pd.DataFrame([_jpeg(None if x is None else bytes(x)) or (None, None) for x in content], columns=["width", "height"]).astype("Int32")


def flatten_attachments(mails: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """One row for each attachment, with the rule that drops it, if one does."""
    a = mails.select(F.col("path").alias("parent"), F.explode("attachments").alias("a")).select("parent", "a.*")
    ext = F.lower(F.regexp_extract("filename", r"(\.[A-Za-z0-9]+)$", 1))
    rule = F.when(protected(F.col("content")), "password").when(ext == ".zip", F.when(zip_state("content") == "corrupt", "zip_error")).when(~ext.isin(*supported), "unsupported_type")
    return a.withColumn("ext", ext).withColumn("rule", rule)


def _xml(z: zipfile.ZipFile, name: str) -> str:
    return z.read(name).decode("utf-8", "replace") if name in z.namelist() else ""


def _unescape(s: str) -> str:
    import html

    return html.unescape(re.sub(r"<[^>]*>", "", s))


@F.pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """The paragraphs of a DOCX, a line each; empty for what can't be read."""

    def one(raw: bytes | None) -> str:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(raw or b""))) as z:
                body = _xml(z, "word/document.xml")
        except (zipfile.BadZipFile, ValueError, RuntimeError):
            return ""
        return "\n".join(_unescape("".join(re.findall(r"<w:t[ >][^<]*</w:t>|<w:t>[^<]*</w:t>", p))) for p in re.findall(r"(?s)<w:p[ >].*?</w:p>", body))

    return content.map(one)


def workbook_cells(contents: DataFrame) -> DataFrame:
    """contents (path, content) of .xlsx files as cells: shared, inline and formula strings, and numbers as they are written. Unreadable files give no row."""

    def cells(path: str, raw: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            shared = [_unescape("".join(re.findall(r"(?s)<t[^>]*>(.*?)</t>", si))) for si in re.findall(r"(?s)<si>(.*?)</si>", _xml(z, "xl/sharedStrings.xml"))]
            for sheet in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
                for attrs, body in re.findall(r"(?s)<c ([^>]*?)(?:/>|>(.*?)</c>)", _xml(z, sheet)):
                    ref, kind = re.search(r'r="([A-Z]+)(\d+)"', attrs), re.search(r't="(\w+)"', attrs)
                    v, inline = re.search(r"(?s)<v>(.*?)</v>", body), re.findall(r"(?s)<t[^>]*>(.*?)</t>", body)
                    value = shared[int(v[1])] if v and kind and kind[1] == "s" else _unescape(v[1]) if v else _unescape("".join(inline))
                    if ref and value:
                        col = 0
                        for c in ref[1]:
                            col = col * 26 + ord(c) - 64
                        yield path, sheet.rsplit("/", 1)[1], int(ref[2]), col, value

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = list(cells(path, bytes(raw))) if raw is not None else []
                except (zipfile.BadZipFile, ValueError, IndexError, RuntimeError):
                    rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value"])

    return contents.select("path", "content").mapInPandas(of, "path string, sheet string, row int, col int, value string")
