"""Which words stand for the subject, and whether a text has them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Subject

SHORTEST_PART = 3


def _clean(value: str) -> str:
    return " ".join((value or "").split()).lower()


def identifiers(subject: Subject) -> list[str]:
    """What singles the subject out: name, aliases, addresses."""
    return list(dict.fromkeys(x for x in map(_clean, (subject.name, *subject.aliases, subject.email, subject.personal_email)) if x))


def tokens(subject: Subject) -> list[str]:
    """Identifiers, first and last name, and the addresses' local parts, of three letters at least."""
    name = _clean(subject.name)
    words = name.split(" ")
    out = [name, *[w for w in (words[0], words[-1]) if len(w) >= SHORTEST_PART], *map(_clean, subject.aliases)]
    for address in map(_clean, (subject.email, subject.personal_email)):
        local = address.split("@")[0]
        out += [address, local if len(local) >= SHORTEST_PART else ""]
    return list(dict.fromkeys(x for x in out if x))


def criterion_words(subject: Subject) -> list[list[str]]:
    return [x.split(" ") for x in identifiers(subject)]


def any_of(words: list[str] | tuple[str, ...]) -> str:
    return "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w) for w in words)


def mentions(text: Column, words: list[str]) -> Column:
    """Whether text has one of the words between characters that are no ASCII letters or digits; without words, true."""
    words = [w for w in words if w]
    return text.rlike(f"(?i)(^|[^a-z0-9])(?:{any_of(words)})($|[^a-z0-9])") if words else F.lit(True)


def has_keyword(text: Column, keywords: tuple[str, ...]) -> Column:
    return text.rlike(f"(?i)(?<![A-Za-z0-9])(?:{any_of(keywords)})(?![A-Za-z0-9])")


def cell_matches(value: Column, words: list[str]) -> Column:
    """Spreadsheet cells match by containing an identifier anywhere."""
    return F.lower(value).rlike(any_of(words)) if words else F.lit(False)


def has_all_words(text: Column, criteria: list[list[str]]) -> Column:
    """Whether all words of one criterion stand anywhere in the text."""
    low, out = F.lower(text), F.lit(False)
    for words in criteria:
        all_ = F.lit(True)
        for w in words:
            all_ = all_ & low.contains(w)
        out = out | all_
    return out


def sent_to(recipients: Column, address: str) -> Column:
    address = _clean(address)
    return F.exists(recipients, lambda r: F.lower(F.trim(r)) == address) if address else F.lit(False)


def sent_to_in_text(text: Column, address: str) -> Column:
    return text.rlike(rf"(?i)\b(?:to|cc|bcc)\s*:[^\n]{{0,240}}{any_of([_clean(address)])}") if address else F.lit(False)


def clearly_involved(text: Column, subject: Subject, is_excerpt: Column | None = None) -> Column:
    """An address anywhere, or a line that starts with the name or an alias and goes on as an author's or speaker's does.

    Such a line may begin with "Message edited:"; after the name come a bracket, a time, a date or a colon. A chat excerpt
    (is_excerpt) is judged by what it is about and never counts.
    """
    out = F.lit(False)
    for a in map(_clean, (subject.email, subject.personal_email)):
        out = out | (F.lower(text).contains(a) if a else F.lit(False))
    names = [n for n in dict.fromkeys(map(_clean, (subject.name, *subject.aliases))) if n]
    if names:
        out = out | text.rlike(rf"(?im)^\s*(?:message edited:\s*)?(?:{any_of(names)})(?:\s*<|\s+\d{{1,2}}:\d{{2}}|\s+\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\s*:)")
    return out if is_excerpt is None else out & ~F.coalesce(is_excerpt, F.lit(False))


def direct_party(head: Column, address: str) -> Column:
    return head.rlike(rf"(?im)^(?:from|to):[^\n]*{any_of([_clean(address)])}")


def strong_signal(sender: Column, to: Column, title: Column, body: Column, subject: Subject) -> Column:
    """An own address in From or To, the name in a header, twice in the body, or once in a forwarded one."""
    out = F.lit(False)
    for a in map(_clean, (subject.email, subject.personal_email)):
        if a:
            own = rf"(?i)\b{any_of([a])}\b"
            out = out | sender.rlike(own) | to.rlike(own)
    for name in map(_clean, (subject.name, *subject.aliases)):
        if name:
            word = r"(?i)\b" + any_of([name]).replace(" ", r"\s+") + r"\b"
            n = F.regexp_count(body, F.lit(word))
            out = out | F.concat_ws(" ", sender, to, title).rlike(word) | (n >= 2) | ((n >= 1) & body.rlike(r"(?i)forwarded message|original message|from:|to:"))
    return out
