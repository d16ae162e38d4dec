"""Settings of a review: who it is about, which words are privileged, and the thresholds of the rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# Words, closed sets and thresholds that results depend on.
PRIVILEGED_KEYWORDS = ("Confidential", "Confidentiality", "Privileged", "CRO", "CROs")
ITEM_STATES = ("pending", "kept", "discarded", "review")
ITEM_KINDS = ("email", "file", "chat_message")
ITEM_ORIGINS = ("pst", "attachment", "files_folder")
SENSITIVITIES = ("none", "payroll_compensation", "legal_privileged", "hr_investigation_or_discipline", "third_party_personal_data", "other_confidential")
FUNNEL_RULES = {
    "duplicates": ("dup",),
    "type": ("unsupported_type", "password", "zip_error", "empty_output", "unreadable_image"),
    "keyword": ("keyword",),
    "other": ("draft", "self_forward", "signature_image", "files_filter"),
    "subject": ("subject_absent",),
}
AI_RULES = ("ai_email", "ai_file", "mail_screen")
OUTCOMES = ("type", "keyword", "other", "subject", "ai_discarded", "review", "kept", "waiting")
SUPPORTED = (".pdf", ".doc", ".docx", ".xlsx", ".xls", ".csv", ".html", ".htm", ".eml", ".msg", ".txt", ".png", ".jpg", ".jpeg", ".gif", ".webp")
VIDEO = (".mp4", ".m4v", ".mov", ".avi", ".wmv", ".mkv", ".webm", ".mpg", ".mpeg", ".3gp", ".flv", ".ts", ".mts", ".m2ts")
AUDIO = (".mp3", ".wav", ".m4a", ".aac", ".wma", ".ogg", ".opus", ".flac", ".amr", ".aiff")


@dataclass(frozen=True)
class Subject:
    """The person a review is about."""

    name: str = ""
    email: str = ""
    personal_email: str = ""
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class ReviewConfig:
    subject: Subject = Subject()
    keywords: tuple[str, ...] = PRIVILEGED_KEYWORDS
    client_case: bool = False
    chat_context: int = 5
    large_chat: int = 100
    large_pages: int = 30
    dedup_min_key: int = 8
    recurrence_mails: int = 4
    review_min_keep: int = 8
    review_sample: float = 0.02
    batch_records: int = 10_000
    extra: dict = field(default_factory=dict)
