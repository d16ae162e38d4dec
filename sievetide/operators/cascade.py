"""Ordered rules: the first that holds gives state, rule and who decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AUDIO, SUPPORTED, VIDEO, ReviewConfig
from ..functions import subject as S
from ..functions import text as T
from ..tables import written
from .dedup import content_key, mark_duplicates, text_key
from .images import classify


def first_match(rules: list[tuple[Column, str, str]], otherwise: tuple[str, str]) -> Column:
    """(state, rule) of the first rule (condition, state, rule) that holds; a null condition does not."""
    pair = lambda state, rule: F.struct(F.lit(state).alias("state"), F.lit(rule).cast("string").alias("rule"))
    out = F.when(F.lit(False), pair("", ""))
    for condition, state, rule in rules:
        out = out.when(condition, pair(state, rule))
    return out.otherwise(pair(*otherwise))


def file_name_keyword(name: Column, keywords: tuple[str, ...]) -> Column:
    return S.has_keyword(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), r"[_.\-+]+", " "), keywords)


SHEETS, PICTURES, MESSAGES = (".xlsx", ".xls", ".csv"), (".png", ".jpg", ".jpeg", ".gif", ".webp"), (".html", ".htm", ".eml", ".msg")


def _given(df: DataFrame, column: str, otherwise: str) -> Column:
    """A column that df may lack, then otherwise (SQL)."""
    return F.col(column) if column in df.columns else F.expr(otherwise)


def _text_rules(files: DataFrame, config: ReviewConfig) -> tuple[Column, Column]:
    """Whether a document's text has a privileged keyword that counts, and whether the subject is absent from it."""
    text, ext, address = F.col("text"), F.col("ext"), config.subject.personal_email
    body = F.when(ext.isin(*MESSAGES), T.strip_signature(text)).otherwise(T.strip_notice(text))
    keyword = S.has_keyword(body, config.keywords) & ((ext == ".pdf") | ~S.sent_to_in_text(text, address))
    named = S.mentions(text, S.tokens(config.subject))
    return keyword, F.when(ext.isin(*SHEETS), ~F.col("sheet_hit")).otherwise(~named) if "sheet_hit" in files.columns else ~named


def _picture_class(files: DataFrame) -> Column:
    return classify(F.col("name"), _given(files, "width", "CAST(NULL AS INT)"), _given(files, "height", "CAST(NULL AS INT)"), F.col("bytes"), _given(files, "inline", "false"))


def file_cascade(files: DataFrame, config: ReviewConfig) -> DataFrame:
    """files with state, rule and decided_by, without their texts.

    files: id, name, ext, text (null: unreadable), bytes, protected, and where they are known content_hash (of the bytes),
    content_key (of a workbook's cells), sheet_hit (a row names the subject), width and height of pictures (null: unreadable),
    vision (decoration), picture_verdict (of the judge), chat_state and chat_rule (of chat exports).

    In order: password; keyword in the name, but of messages; byte copy; then by type: PDFs, documents, mails and pages have
    keyword, subject absent and content copy; sheets lack the subject in all cases; chat exports are what their excerpts are;
    pictures are unreadable, signatures or discarded by the judge; other types are unsupported; at last empty output.
    A copy counts only against a kept file, so a copy of a discarded file gets that file's rule. An unreadable PDF is
    delivered as it is. In client cases keywords and the subject don't count, but for sheets.
    """
    ext, judged, text = F.col("ext"), F.lit(not config.client_case), F.col("text")
    early = [(F.col("protected"), "discarded", "password"), (judged & ~ext.isin(*MESSAGES) & file_name_keyword(F.col("name"), config.keywords), "discarded", "keyword")]
    keyword, absent = _text_rules(files, config)
    picture, kind = ext.isin(*PICTURES), _picture_class(files)
    chat_rule = F.when(ext.isin(".html", ".htm") & judged, _given(files, "chat_rule", "CAST(NULL AS STRING)"))
    reads = ~picture & chat_rule.isNull() & ~((ext == ".pdf") & text.isNull())
    rules = [
        *early, (~ext.isin(*SUPPORTED), "discarded", "unsupported_type"),
        (picture & _given(files, "width", "CAST(NULL AS INT)").isNull(), "discarded", "unreadable_image"),
        (picture & ((kind == "signature") | ((kind == "ambiguous") & (_given(files, "vision", "CAST(NULL AS STRING)") == "decoration"))), "discarded", "signature_image"),
        (picture & (_given(files, "picture_verdict", "CAST(NULL AS STRING)") == "discard"), "discarded", "ai_file"),
        *[(chat_rule == r, "discarded", r) for r in ("keyword", "subject_absent", "dup")],
        (judged & reads & keyword, "discarded", "keyword"), ((judged | ext.isin(*SHEETS)) & reads & absent, "discarded", "subject_absent"), (F.col("bytes") == 0, "discarded", "empty_output"),
    ]
    key = (
        F.when(ext == ".pdf", F.concat(F.lit("pdf:"), text_key(text)))
        .when(ext.isin(*SHEETS), _given(files, "content_key", "CAST(NULL AS STRING)"))
        .when(ext.isin(*MESSAGES, ".txt"), content_key(text, config.dedup_min_key))
    )
    out = files.withColumn("fc", first_match(rules, ("kept", "files_filter"))).withColumn("fc_early", F.coalesce(early[0][0], F.lit(False)) | F.coalesce(early[1][0], F.lit(False)))
    left = F.col("fc.state") == "kept"
    out = out.withColumn("fc_key", F.when(left & chat_rule.isNull(), key)).withColumn("fc_hash", _given(files, "content_hash", "CAST(NULL AS STRING)"))
    # Copies are ranked among the files that are left, over a narrow table.
    narrow = written(out.drop("text"))
    kept = narrow.filter(left)
    hashes = written(kept.filter("fc_hash IS NOT NULL").groupBy("fc_hash").agg(F.min("id").alias("fc_first")))
    same_bytes = narrow.filter("fc_hash IS NOT NULL AND NOT fc_early").join(hashes, "fc_hash").filter("id > fc_first").select("id", F.lit(True).alias("fc_same"))
    same_text = mark_duplicates(kept.select("id", "fc_key"), ["fc_key"], ["id"], "fc_dup").filter("fc_dup AND fc_key IS NOT NULL").select("id", F.lit(True).alias("fc_same"))
    dup = F.coalesce(F.col("fc_same"), F.lit(False))
    out = narrow.join(same_bytes.unionAll(same_text).distinct(), "id", "left")
    out = out.withColumn("state", F.when(dup, "discarded").otherwise(F.col("fc.state"))).withColumn("rule", F.when(dup, "dup").otherwise(F.col("fc.rule")))
    return out.withColumn("decided_by", F.when(F.col("rule") == "ai_file", "judge").otherwise("rule")).drop("fc", "fc_early", "fc_key", "fc_hash", "fc_same")


def attachment_cascade(attachments: DataFrame, config: ReviewConfig) -> DataFrame:
    """attachments of delivered mails with state, rule and decided_by, without their texts.

    attachments: id (their order), name, ext, text, bytes, is_image, embedded (shown in the body), unrenderable (a format that
    can't be converted), width and height (null: unreadable), image_hash, recurs (in how many mails), vision, picture_verdict,
    dropped (the rule by which unpacking dropped it), screen (the judge's verdict; null: none), screened (the judge was
    asked), and sheet_hit.

    Pictures: shown in the body, unreadable, signature, recurring, sent before, decoration, then what the judge says, else
    review. Documents: what unpacking dropped, what the judge discards, keyword in the name, keyword and subject in the
    text; a document without a verdict still goes through these rules. A picture counts as sent before if an earlier one
    with its hash went to review.
    """
    judged, ext = F.lit(not config.client_case), F.col("ext")
    name_hit = judged & file_name_keyword(F.col("name"), config.keywords)
    keyword, absent = _text_rules(attachments, config)
    image, unread, kind, verdict = F.col("is_image"), F.col("width").isNull(), _picture_class(attachments), F.col("picture_verdict")
    recurring = (kind != "content") & (F.coalesce("recurs", F.lit(0)) >= config.recurrence_mails)
    documents = ext.isin(".docx", ".doc", ".txt", ".pdf", *SHEETS)
    rules = [
        (image & F.col("embedded"), "kept", "embedded_in_email"), (image & unread & ~F.col("unrenderable"), "discarded", "unreadable_image"), (image & unread, "review", "image_review"),
        (image & ((kind == "signature") | recurring), "discarded", "signature_image"), (image & (kind == "ambiguous") & (F.col("vision") == "decoration"), "discarded", "signature_image"),
        (image & (verdict == "discard"), "discarded", "ai_file"), (image & (verdict == "keep") & name_hit, "discarded", "keyword"), (image & (verdict == "keep"), "kept", "ai_image"), (image, "review", "image_review"),
        *[(F.col("dropped") == r, "discarded", r) for r in ("password", "zip_error", "unsupported_type", "unreadable")],
        (F.col("screened") & (F.col("screen") == "discard"), "discarded", "ai_file"), (name_hit, "discarded", "keyword"),
        (documents & F.col("text").isNull(), "discarded", "unreadable"), (judged & documents & keyword, "discarded", "keyword"), ((judged | ext.isin(*SHEETS)) & documents & absent, "discarded", "subject_absent"),
    ]
    # Pictures that get as far as the look at what was sent before.
    asked = image & ~F.col("embedded") & F.when(unread, F.col("unrenderable")).otherwise((kind != "signature") & ~recurring)
    narrow = written(attachments.withColumn("ac", first_match(rules, ("kept", "attachment_delivered"))).withColumn("ac_asked", F.coalesce(asked, F.lit(False))).drop("text"))
    sent = written(narrow.filter("ac.rule = 'image_review' AND image_hash IS NOT NULL").groupBy("image_hash").agg(F.min("id").alias("ac_first")))
    dup = F.col("ac_asked") & F.coalesce(F.col("id") > F.col("ac_first"), F.lit(False))
    out = narrow.join(sent, "image_hash", "left").withColumn("state", F.when(dup, "discarded").otherwise(F.col("ac.state"))).withColumn("rule", F.when(dup, "dup").otherwise(F.col("ac.rule")))
    return out.withColumn("decided_by", F.when(F.col("rule").isin("ai_file", "ai_image"), "judge").otherwise("rule")).drop("ac", "ac_first", "ac_asked")


def mail_screen(mails: DataFrame, verdicts: DataFrame) -> DataFrame:
    """mails (id, state, rule, decided_by) after the judge's verdicts (id, verdict) on the bodies of those that client cases keep: discard and review hold."""
    j = mails.join(verdicts.filter("verdict IN ('discard', 'review')").select("id", F.col("verdict").alias("ms")), "id", "left")
    hit = F.col("ms").isNotNull() & (F.col("state") == "kept")
    new = {"state": F.when(F.col("ms") == "discard", "discarded").otherwise("review"), "rule": F.lit("mail_screen"), "decided_by": F.lit("judge")}
    return j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in mails.columns])


def mail_cascade(mails: DataFrame, config: ReviewConfig) -> DataFrame:
    """mails (sender, recipients, subject, body, attachment_names, is_duplicate) with state and rule; what is left is pending for the judge.

    Where is_duplicate is not known yet, leave it out and mark copies over the narrow result: they come before all other rules.
    """
    s = config.subject
    words, judged = S.tokens(s), F.lit(not config.client_case)
    keyword = S.has_keyword(T.strip_signature(F.concat_ws("\n", "subject", "body")), config.keywords) & ~S.sent_to(F.col("recipients"), s.personal_email)
    has = lambda column, value: F.lower(F.trim(column)) == value.lower() if value else F.lit(False)
    forward = has(F.col("sender"), s.email) & S.sent_to(F.col("recipients"), s.personal_email) if s.email and s.personal_email else F.lit(False)
    nobody = lambda x: x.isNull() | (F.trim(x) == "") | (x == "No Recipient")
    first = F.get(F.col("recipients"), F.lit(0))
    draft = nobody(T.exchange_name(F.col("sender"))) | nobody(T.exchange_name(first))
    everything = F.concat_ws("\n", F.col("sender"), F.array_join("recipients", ", "), F.col("subject"), F.col("body"), F.array_join("attachment_names", ", "))
    absent = ~S.mentions(everything, words) if words else F.lit(False)
    rules = [
        *([(F.col("is_duplicate"), "discarded", "dup")] if "is_duplicate" in mails.columns else []), (judged & keyword, "discarded", "keyword"), (judged & forward, "review", "self_forward"),
        (~judged, "kept", "client_case"), (draft, "discarded", "draft"), (absent, "discarded", "subject_absent"),
    ]
    out = mails.withColumn("mc", first_match(rules, ("pending", None)))
    return out.withColumn("state", F.col("mc.state")).withColumn("rule", F.col("mc.rule")).withColumn("decided_by", F.when(F.col("mc.rule").isNotNull(), "rule")).drop("mc")


def with_copies(decided: DataFrame) -> DataFrame:
    """mail_cascade's result with is_duplicate, once that is known: copies are discarded as such."""
    dup = F.col("is_duplicate")
    return decided.withColumn("rule", F.when(dup, "dup").otherwise(F.col("rule"))).withColumn("state", F.when(dup, "discarded").otherwise(F.col("state"))).withColumn("decided_by", F.when(F.col("rule").isNotNull(), "rule"))


def media_kind(ext: Column) -> Column:
    return F.when(F.lower(ext).isin(*VIDEO), "video").when(F.lower(ext).isin(*AUDIO), "audio")
