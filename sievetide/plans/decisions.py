"""Queries over items: cascades, funnels, outcomes, filters, verdicts, the ledger."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import cascade, delivery, insights, ledger, numbering, verdicts
from ..operators.dedup import mark_mail_duplicates
from ..sources import adapters as A
from .base import query

CAST_SUM = "CAST(coalesce(sum({x}), 0) AS BIGINT)"
GROUPS = f"WITH {A.JUDGED}, g AS (SELECT state, rule, count(*) AS n FROM items GROUP BY state, rule)"


def _gone(rules: tuple[str, ...]) -> str:
    return f"CASE WHEN state = 'discarded' AND rule IN ({', '.join(repr(r) for r in rules)}) THEN n END"


_RULES = {k: insights.FUNNEL_RULES[k] for k in insights.FUNNEL_RULES}
_AI = "rule IN ('ai_email', 'ai_file', 'mail_screen')"
_SUMS = ", ".join([f"{CAST_SUM.format(x='n')} AS received", *[f"{CAST_SUM.format(x=_gone(r))} AS {k}_removed" for k, r in _RULES.items()], *[f"{CAST_SUM.format(x=f'CASE WHEN {_AI} AND state = {s!r} THEN n END')} AS ai_{s}" for s in ("kept", "discarded", "review")], CAST_SUM.format(x="CASE WHEN state = 'review' THEN n END") + " AS for_review"])
_LEFT = []
for _i, _k in enumerate(_RULES):
    _LEFT.append(f"received - {' - '.join(f'{k}_removed' for k in list(_RULES)[: _i + 1])} AS after_{_k}")
_FUNNEL_TAIL = f"""SELECT *, greatest(0, after_subject - ai_kept - ai_discarded - ai_review) AS ai_waiting, CASE WHEN received > 0 THEN CAST(floor((received - after_subject) * 100.0::DOUBLE / received + 0.5) AS BIGINT) ELSE 0 END AS removed_percent,
  CASE WHEN after_subject > 0 THEN CAST(floor((ai_kept + ai_review) * 100.0::DOUBLE / after_subject + 0.5) AS BIGINT) ELSE 0 END AS kept_percent FROM (SELECT *, {', '.join(_LEFT)} FROM s)"""


@query("a1_outcome_groups", f"WITH {A.JUDGED} SELECT state, rule, origin, count(*) AS count FROM items GROUP BY ALL")
def a1(spark, d):
    return insights.outcome_groups(A.judged(spark, d), ("state", "rule", "origin"))


@query("a2_outcome_groups_by_request", f"WITH {A.JUDGED} SELECT request, state, rule, count(*) AS count FROM items GROUP BY ALL")
def a2(spark, d):
    return insights.outcome_groups(A.judged(spark, d), ("request", "state", "rule"))


@query("a3_funnel", f"{GROUPS}, s AS (SELECT {_SUMS} FROM g) {_FUNNEL_TAIL}")
def a3(spark, d):
    return insights.funnel(insights.outcome_groups(A.judged(spark, d)))


@query("a3_funnel_by_request", f"WITH {A.JUDGED}, g AS (SELECT request, state, rule, count(*) AS n FROM items GROUP BY ALL), s AS (SELECT request, {_SUMS} FROM g GROUP BY request) {_FUNNEL_TAIL}")
def a3r(spark, d):
    return insights.funnel(insights.outcome_groups(A.judged(spark, d), ("request", "state", "rule")), ("request",))


OUTCOME_SQL = "CASE WHEN state = 'kept' THEN 'kept' WHEN state = 'review' THEN 'review' WHEN state = 'pending' THEN 'waiting' WHEN rule = 'dup' THEN 'duplicate' WHEN rule IN ('unsupported_type','password','zip_error','empty_output','unreadable_image') THEN 'type' WHEN rule = 'keyword' THEN 'keyword' WHEN rule = 'subject_absent' THEN 'subject' WHEN rule IN ('ai_email','ai_file','mail_screen') THEN 'ai_discarded' ELSE 'other' END"


@query(
    "a4_outcome_bars",
    f"""WITH {A.JUDGED}, o AS (SELECT kind, {OUTCOME_SQL} AS segment, count(*) AS n FROM items GROUP BY ALL), t AS (SELECT kind, CAST(sum(n) AS BIGINT) AS received, CAST(coalesce(sum(n) FILTER (segment = 'duplicate'), 0) AS BIGINT) AS duplicates FROM o GROUP BY kind)
    SELECT kind, received, duplicates, received - duplicates AS "unique", segment, CAST(list_position(['type','keyword','other','subject','ai_discarded','review','kept','waiting'], segment) AS INT) AS position, n FROM t JOIN o USING (kind) WHERE segment <> 'duplicate'""",
)
def a4(spark, d):
    return insights.outcome_bars(insights.outcome_groups(A.judged(spark, d), ("kind", "state", "rule")))


@query("a5_verdict_counts", f"WITH {A.JUDGED} SELECT request, count(*) FILTER (state = 'kept') AS kept, count(*) FILTER (state = 'discarded' AND rule <> 'dup') AS discarded FROM items GROUP BY request")
def a5(spark, d):
    return A.judged(spark, d).groupBy("request").agg(F.count_if(F.col("state") == "kept").alias("kept"), F.count_if((F.col("state") == "discarded") & (F.col("rule") != "dup")).alias("discarded"))


@query("a6_audited", f"WITH {A.JUDGED} SELECT request, count(*) AS audited FROM items WHERE state <> 'pending' AND rule <> 'dup' GROUP BY request")
def a6(spark, d):
    return A.judged(spark, d).filter("state != 'pending' AND rule != 'dup'").groupBy("request").agg(F.count("*").alias("audited"))


@query("a7_facets", f"WITH {A.JUDGED} SELECT state, count(*) AS n, grouping(state) = 1 AS is_total FROM items WHERE origin = 'files_folder' AND kind <> 'chat_message' GROUP BY GROUPING SETS ((state), ())")
def a7(spark, d):
    return insights.filter_items(A.judged(spark, d), tab="files").rollup("state").agg(F.count("*").alias("n"), (F.grouping("state") == 1).alias("is_total"))


@query("p23_item_filter", f"WITH {A.JUDGED} SELECT id, label, state, rule FROM items WHERE origin = 'files_folder' AND kind <> 'chat_message' AND {_AI} AND state = 'discarded' AND contains(lower(label), 'pdf')")
def p23(spark, d):
    return insights.filter_items(A.judged(spark, d), tab="files", step="ai", state="discarded", q="PDF").select("id", "label", "state", "rule")


@query("cascade_files", f"WITH {A.SCREENED} SELECT id, request, ext, state, rule FROM screened")
def cascade_files(spark, d):
    return A.screened(spark, d).select("id", "request", "ext", "state", "rule")


_BODY20 = "substr(regexp_replace(lower(body), '[^a-z0-9]', '', 'g'), 21, 100)"
_SUBJ = r"regexp_replace(regexp_replace(lower(subject), '^(re|fw|fwd|wg|aw)\s*:\s*', ''), '[^a-z0-9]', '', 'g')"
HASHED = f"""{A.MAILS}, hashed AS (SELECT *, sha256(request || '::' || CASE WHEN length(message_id) > 5 THEN sha256(message_id) ELSE sha256(regexp_replace(lower(sender), '[^a-z0-9]', '', 'g') || '_' || {_SUBJ} || '_' || {_BODY20}) END) AS email_hash FROM mails),
marked AS (SELECT *, row_number() OVER (PARTITION BY request, email_hash ORDER BY seq) > 1 OR (length(message_id) > 5 AND row_number() OVER (PARTITION BY request, message_id ORDER BY seq) > 1) AS is_duplicate FROM hashed)"""


def _with_hash(mails):
    base = ids.base_hash(F.col("message_id"), ids.fallback_hash(F.col("sender"), F.col("subject"), F.col("body")))
    return mails.withColumn("email_hash", ids.email_hash(F.col("request"), base))


MAIL_IDS = ("id", "seq", "request", "file_id", "message_id", "email_hash")


def hashed(spark, d):
    return _with_hash(A.mails(spark, d)).select(*MAIL_IDS)


@query("d1_mail_dedup", f"WITH {HASHED} SELECT id, email_hash, is_duplicate FROM marked")
def d1(spark, d):
    return mark_mail_duplicates(hashed(spark, d)).select("id", "email_hash", "is_duplicate")


@query("d3_duplicate_numbers", f"WITH {HASHED}, n AS (SELECT id, file_id, email_hash, row_number() OVER (PARTITION BY file_id, email_hash ORDER BY seq) - 1 AS occurrence FROM hashed) SELECT id, occurrence, sha256('duplicate:' || file_id || ':' || email_hash || ':' || occurrence) AS item_id FROM n WHERE occurrence > 0")
def d3(spark, d):
    from ..operators.dedup import number_repeats

    n = number_repeats(hashed(spark, d), ["file_id", "email_hash"], ["seq"]).filter("occurrence > 0")
    return n.select("id", F.col("occurrence").cast("long").alias("occurrence"), ids.duplicate_item_id(F.col("file_id"), F.col("email_hash"), F.col("occurrence")).alias("item_id"))


_MAIL_TEXT = f"trim({A.SIGNATURE_CUT.format(x='subject || chr(10) || body')})"
_ALL_TEXT = "sender || chr(10) || array_to_string(recipients, ', ') || chr(10) || subject || chr(10) || body || chr(10)"


@query(
    "cascade_mail",
    f"""WITH {HASHED} SELECT id, CASE WHEN is_duplicate OR kw THEN 'discarded' WHEN len(recipients) = 0 THEN 'discarded' WHEN NOT mentioned THEN 'discarded' ELSE 'pending' END AS state,
    CASE WHEN is_duplicate THEN 'dup' WHEN kw THEN 'keyword' WHEN len(recipients) = 0 THEN 'draft' WHEN NOT mentioned THEN 'subject_absent' END AS rule FROM (SELECT *, {A.KEYWORD_SQL.format(x=_MAIL_TEXT)} AS kw, {A.MENTION_SQL.format(x=_ALL_TEXT)} AS mentioned FROM marked)""",
)
def cascade_mail(spark, d):
    # One pass over the texts; copies are marked among ids and hashes.
    decided = cascade.mail_cascade(_with_hash(A.mails(spark, d)), A.CONFIG).select(*MAIL_IDS, "state", "rule", "decided_by")
    return cascade.with_copies(mark_mail_duplicates(decided)).select("id", "state", "rule")


@query(
    "cascade_mail_client",
    f"""WITH {HASHED}, s AS (SELECT doc_id AS id, CASE WHEN max(toxic) = 1 THEN 'discard' WHEN max(quality) = 0 THEN 'review' ELSE 'keep' END AS v FROM labels GROUP BY doc_id)
    SELECT m.id, CASE WHEN is_duplicate THEN 'discarded' WHEN v = 'discard' THEN 'discarded' WHEN v = 'review' THEN 'review' ELSE 'kept' END AS state, CASE WHEN is_duplicate THEN 'dup' WHEN v IN ('discard', 'review') THEN 'mail_screen' ELSE 'client_case' END AS rule FROM marked m LEFT JOIN s USING (id)""",
)
def cascade_mail_client(spark, d):
    decided = cascade.mail_cascade(_with_hash(A.mails(spark, d)), replace(A.CONFIG, client_case=True)).select(*MAIL_IDS, "state", "rule", "decided_by")
    labels = A.table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    screened = labels.select("id", F.when(F.col("t") == 1, "discard").when(F.col("q") == 0, "review").otherwise("keep").alias("verdict"))
    return cascade.mail_screen(cascade.with_copies(mark_mail_duplicates(decided)), screened).select("id", "state", "rule")


@query("cascade_attachments", f"WITH {A.ATTACHMENTS}")
def cascade_attachments(spark, d):
    return cascade.attachment_cascade(A.attachments(spark, d), A.CONFIG).select("id", "rule", "state")


@query("j4_coverage", f"WITH {A.JUDGED}, e AS (SELECT id FROM items WHERE id % 9 <> 0), i AS (SELECT id, state FROM items WHERE id % 11 <> 0), b AS (SELECT e.id AS eid, i.id AS iid, i.state FROM e FULL JOIN i ON e.id = i.id) SELECT count(eid) AS emails, count(iid) AS items, count(*) FILTER (iid IS NULL) AS missing, count(*) FILTER (eid IS NULL) AS orphans, count(*) FILTER (state = 'pending') AS pending, (SELECT string_agg(CAST(eid AS VARCHAR), ',' ORDER BY eid) FROM (SELECT eid FROM b WHERE iid IS NULL ORDER BY eid LIMIT 20)) AS first_missing FROM b")
def j4(spark, d):
    items = A.judged(spark, d).withColumn("file_id", F.lit("all"))
    return insights.coverage(items.filter("id % 9 != 0"), items.filter("id % 11 != 0")).drop("file_id")


DECIDE_SQL = "CASE WHEN quality IS NULL THEN 'review' WHEN toxic = 1 THEN 'discard' WHEN quality = 0 AND id % 5 <> 0 THEN 'discard' WHEN length(text) > 5000 THEN 'review' ELSE 'keep' END"
DECIDED = f"{A.FILES}, lab AS (SELECT doc_id AS id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), decided AS (SELECT f.id, f.request, {DECIDE_SQL.replace('id %', 'f.id %')} AS verdict, quality, toxic FROM files f LEFT JOIN lab USING (id))"


def decided(spark, d):
    labels = A.table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    j = A.files(spark, d).join(labels, "id", "left")
    relevance = F.when(F.col("quality") == 1, "relevant").when(F.col("quality") == 0, "irrelevant")
    sensitivity = F.when(F.col("toxic") == 1, "other_confidential").when(F.col("toxic") == 0, "none")
    return j.withColumn("verdict", verdicts.decide_file(relevance, sensitivity, F.lit(True), F.col("id") % 5 == 0, F.length("text") > 5000))


@query("v2_decide_file", f"WITH {DECIDED} SELECT id, verdict FROM decided")
def v2(spark, d):
    return decided(spark, d).select("id", "verdict")


@query("v1_parse_answer", """WITH a AS (SELECT doc_id AS id, quality, toxic FROM labels) SELECT id, CASE WHEN id % 6 <> 0 THEN CASE WHEN quality = 1 THEN 'relevant' ELSE 'irrelevant' END END AS relevance, CASE WHEN id % 6 <> 0 THEN CASE WHEN toxic = 1 THEN 'other_confidential' ELSE 'none' END END AS sensitivity FROM a""")
def v1(spark, d):
    a = A.table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    body = F.to_json(F.struct(F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant").alias("relevance"), F.when(F.col("id") % 6 == 0, "bad").when(F.col("toxic") == 1, "other_confidential").otherwise("none").alias("sensitivity"), F.lit("r").alias("reason"), F.lit(90).alias("confidence")))
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    p = verdicts.parse_answer(raw)
    return a.select("id", p["relevance"].alias("relevance"), p["sensitivity"].alias("sensitivity"))


# Every sensitivity, an unknown one, and none at all.
_SENSITIVITY = "(['none', 'payroll_compensation', 'legal_privileged', 'hr_investigation_or_discipline', 'third_party_personal_data', 'other_confidential', 'secret', NULL])[doc_id % 8 + 1]"
_CATEGORY = f"CASE WHEN {_SENSITIVITY} IN ('payroll_compensation', 'legal_privileged', 'hr_investigation_or_discipline', 'third_party_personal_data', 'other_confidential') THEN {_SENSITIVITY} END"


def _sensitivity():
    values = ("none", "payroll_compensation", "legal_privileged", "hr_investigation_or_discipline", "third_party_personal_data", "other_confidential", "secret", None)
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("doc_id") % 8 + 1).cast("int"))


@query(
    "v3_fold_mail",
    f"""SELECT doc_id AS id, CASE WHEN c IS NOT NULL OR quality = 0 THEN 'discard' ELSE 'keep' END AS verdict, CASE WHEN c IS NOT NULL THEN substr('Confidential (' || c || '): ' || r, 1, 240) ELSE r END AS reason,
    c IS NULL AND toxic = 1 AS second_pass, c IS NOT NULL AS confidential FROM (SELECT *, {_CATEGORY} AS c, 'because ' || repeat('x', CAST(doc_id % 300 AS INT)) AS r FROM labels)""",
)
def v3(spark, d):
    a = A.table(spark, d, "labels")
    reason = F.concat(F.lit("because "), F.repeat(F.lit("x"), (F.col("doc_id") % 300).cast("int")))
    f = verdicts.fold_mail(F.when(F.col("quality") == 0, "discard").otherwise("keep"), _sensitivity(), reason, F.col("toxic") == 1)
    return a.select(F.col("doc_id").alias("id"), f.alias("f")).select("id", "f.*")


@query("v4_review_gate", "SELECT doc_id AS id, quality IS NULL OR CAST(doc_id % 10 AS INT) >= 8 OR toxic = 1 OR ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 < 0.02 AS second FROM labels")
def v4(spark, d):
    a = A.table(spark, d, "labels")
    return a.select(F.col("doc_id").alias("id"), verdicts.needs_second_review(F.col("doc_id"), (F.col("doc_id") % 10).cast("int"), F.col("toxic") == 1, F.lit(False)).alias("second"))


@query("v6_second_review", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'keep' ELSE 'review' END WHEN doc_id % 3 = 0 AND quality = 1 AND toxic = 1 THEN 'discard' WHEN quality = 1 THEN 'keep' ELSE 'discard' END AS verdict FROM labels")
def v6(spark, d):
    a = A.table(spark, d, "labels")
    verdict = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("quality") == 1, "keep").otherwise("discard")
    return a.select(F.col("doc_id").alias("id"), verdicts.apply_second_review(F.when(F.col("doc_id") % 3 == 0, "email").otherwise("file"), verdict, F.when(F.col("toxic") == 1, "legal_privileged").otherwise("none")).alias("verdict"))


@query("v7_v8_v9_runs", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 < 2 THEN 'resubmit' WHEN o_orderstatus = 'F' THEN 'review' ELSE 'none' END AS next, CASE WHEN o_orderkey % 200 > 100 THEN 'batch' ELSE 'synchronous' END AS route, CASE WHEN o_orderkey % 2 = 0 THEN 'review' ELSE 'retry' END AS missing FROM orders")
def v789(spark, d):
    runs = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"), (F.col("o_orderkey") % 3).alias("attempt"))
    return verdicts.retry_runs(runs).select("id", "next", verdicts.route(F.col("id") % 200).alias("route"), verdicts.missing_answer(F.when(F.col("id") % 2 == 0, "file").otherwise("email")).alias("missing"))


@query(
    "v10_image_verdict",
    """SELECT p_partkey AS id, CASE WHEN v = 'discard' AND NOT (p_partkey % 3 = 1) THEN 'review' WHEN v = 'discard' AND s = 'none' AND NOT (p_partkey % 5 = 1) THEN 'review' ELSE v END AS verdict
    FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'discard' ELSE 'keep' END AS v, CASE WHEN p_partkey % 4 = 0 THEN 'other_confidential' ELSE 'none' END AS s FROM part)""",
)
def v10(spark, d):
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    # sure and readable may be missing.
    sure, readable = F.when(k % 3 != 0, k % 3 == 1), F.when(k % 5 != 0, k % 5 == 1)
    return p.select(k.alias("id"), verdicts.image_verdict(F.when(F.col("p_size") % 2 == 0, "discard").otherwise("keep"), F.when(k % 4 == 0, "other_confidential").otherwise("none"), sure, readable).alias("verdict"))


@query("v12_cascade_children", f"WITH {A.JUDGED}, c AS (SELECT conv_id * 1000 + turn AS id, conv_id AS parent_id FROM conversations) SELECT c.id, CASE WHEN i.state = 'discarded' THEN 'discarded' ELSE 'kept' END AS state, CASE WHEN i.state = 'discarded' THEN i.rule ELSE 'chat_excerpt' END AS rule FROM c LEFT JOIN items i ON i.id = c.parent_id")
def v12(spark, d):
    parents = A.judged(spark, d).select("id", "state", "rule", F.lit(None).cast("long").alias("parent_id"))
    # Messages get ids of their own range.
    children = A.messages(spark, d).select((F.lit(10**9) + F.col("chat") * 1000 + F.col("seq")).alias("id"), F.lit("kept").alias("state"), F.lit("chat_excerpt").alias("rule"), F.col("chat").alias("parent_id"))
    out = verdicts.cascade_to_children(parents.unionByName(children)).filter("parent_id IS NOT NULL")
    return out.select((F.col("id") - 10**9).alias("id"), "state", "rule")


@query("v13_fit_payload", "SELECT doc_id AS id, length(text) AS n, CASE WHEN length(text) > 4000 THEN least(length(text), 200) ELSE length(text) END AS kept_chars FROM documents")
def v13(spark, d):
    docs = A.table(spark, d, "documents")
    f = verdicts.fit_payload(F.lit(""), F.lit(""), F.col("text"), limit=4000, chain=200, body=100)
    return docs.select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"), F.length(f["rest"]).cast("long").alias("kept_chars"))


@query("v11_guarded_update", f"WITH {A.JUDGED} SELECT i.id, CASE WHEN l.id IS NOT NULL AND i.state = 'review' THEN 'kept' ELSE i.state END AS state, CASE WHEN l.id IS NOT NULL AND i.state = 'review' THEN 'person' ELSE i.rule END AS rule FROM items i LEFT JOIN (SELECT id FROM items WHERE id % 3 = 0) l ON l.id = i.id")
def v11(spark, d):
    items = A.judged(spark, d).select("id", "state", "rule")
    new = items.filter("id % 3 = 0").select("id", F.lit("kept").alias("new_state"), F.lit("person").alias("new_rule"))
    return verdicts.guarded_update(items, new, F.col("state") == "review")


@query("w6_change_log", f"WITH {A.ITEM_EVENTS} SELECT event_id, item_id, state FROM (SELECT *, lag(state) OVER w AS b, row_number() OVER w AS k FROM item_events WINDOW w AS (PARTITION BY item_id ORDER BY \"at\", event_id)) WHERE k = 1 OR state IS DISTINCT FROM b")
def w6(spark, d):
    return ledger.changes(A.item_events(spark, d), "item_id", ["at", "event_id"], ("state", "rule")).select("event_id", "item_id", "state")


@query("w7_current_state", f"WITH {A.ITEM_EVENTS} SELECT item_id, arg_max(state, (\"at\", event_id)) AS state, max(event_id) FILTER (true) IS NOT NULL AS seen FROM item_events GROUP BY item_id")
def w7(spark, d):
    return ledger.current(A.item_events(spark, d), "item_id", ["at", "event_id"], ("state",)).withColumn("seen", F.lit(True))


@query("d11_new_snapshots", "SELECT DISTINCT o_custkey AS case_id, sha256(o_orderstatus || '|' || o_orderpriority) AS signature FROM orders WHERE o_orderkey % 2 = 0 AND (o_custkey, o_orderstatus, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderstatus, o_orderpriority) FROM orders WHERE o_orderkey % 2 = 1)")
def d11(spark, d):
    from ..operators.dedup import new_snapshots

    o = A.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"), ids.state_signature(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("signature"))
    return new_snapshots(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["case_id", "signature"]).select("case_id", "signature").distinct()


@query("j14_item_history", f"WITH {A.ITEM_EVENTS} SELECT item_id, count(*) AS n, string_agg(state, '>' ORDER BY \"at\", state) AS path FROM item_events GROUP BY item_id")
def j14(spark, d):
    e = A.item_events(spark, d)
    items = e.select(F.col("item_id").alias("id")).distinct()
    h = ledger.history(items, e)
    return h.select(F.col("id").alias("item_id"), F.size("events").cast("long").alias("n"), F.array_join(F.transform("events", lambda x: x["state"]), ">").alias("path"))


@query("k1_audit_trail", f"WITH {A.JUDGED} SELECT state AS decision, label AS item, kind, origin, rule, decided_by FROM items")
def k1(spark, d):
    items = A.judged(spark, d).withColumns({"at": F.lit(None).cast("timestamp"), "parent": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    return delivery.trail(items).select("decision", "item", "kind", "origin", "rule", "decided_by")


@query("k2_discarded_trail", f"WITH {A.JUDGED} SELECT id, state, rule FROM items WHERE state IN ('discarded', 'review') AND EXISTS (SELECT 1 FROM items WHERE state = 'discarded')")
def k2(spark, d):
    return delivery.discarded_trail(A.judged(spark, d)).select("id", "state", "rule")


@query("k7_disposition", f"WITH {A.JUDGED} SELECT id, CASE WHEN state = 'discarded' THEN 'Discarded' WHEN state = 'review' THEN 'Review' WHEN id % 8 = 0 THEN 'Unconverted' ELSE 'Delivered' END AS disposition FROM items")
def k7(spark, d):
    return A.judged(spark, d).select("id", delivery.disposition(F.col("state"), F.col("rule"), F.col("id") % 8 != 0).alias("disposition"))


@query("w2_numbering", f"WITH {A.JUDGED} SELECT id, request, 100 + row_number() OVER (PARTITION BY request ORDER BY id) AS number FROM items WHERE state = 'kept'")
def w2(spark, d):
    return numbering.number_rows(A.judged(spark, d).filter("state = 'kept'"), ["request"], ["id"], 100).select("id", "request", F.col("number").cast("long").alias("number"))


@query("w2_numbering_all", "SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS number FROM documents")
def w2a(spark, d):
    return numbering.number_all(A.table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id")


@query("w3_ledger_numbering", f"WITH {A.JUDGED}, k AS (SELECT id, request FROM items WHERE state = 'kept'), l AS (SELECT id, request, row_number() OVER (PARTITION BY request ORDER BY id) AS n FROM k WHERE id % 2 = 0), t AS (SELECT request, max(n) AS top FROM l GROUP BY request) SELECT k.id, coalesce(l.n, coalesce(t.top, 0) + row_number() OVER (PARTITION BY k.request, l.n IS NULL ORDER BY k.id)) AS number FROM k LEFT JOIN l USING (id) LEFT JOIN t ON t.request = k.request")
def w3(spark, d):
    kept = A.judged(spark, d).filter("state = 'kept'").select("id", "request")
    old = numbering.number_rows(kept.filter("id % 2 = 0"), ["request"], ["id"], name="n").select("id", "request", "n")
    return numbering.number_with_ledger(kept, old, "id", ["request"], ["id"]).select("id", F.col("number").cast("long").alias("number"))


@query("w10_chunks", f"WITH {A.FILES} SELECT id, CAST(floor((row_number() OVER (PARTITION BY request ORDER BY id) - 1) / 100.0) AS INT) AS chunk FROM files")
def w10(spark, d):
    return numbering.chunk(A.files(spark, d), 100, ["request"], ["id"]).select("id", "chunk")


@query("a25_delivery_gate", f"WITH {A.JUDGED} SELECT request, count(*) FILTER (state = 'kept') AS kept, count(*) FILTER (state = 'kept' AND id % 9 <> 0) AS delivered, count(*) FILTER (state = 'kept' AND id % 9 = 0 AND id % 2 = 0) AS skipped, delivered + skipped >= kept AS open FROM items GROUP BY request")
def a25(spark, d):
    k = F.col("state") == "kept"
    g = A.judged(spark, d).groupBy("request").agg(F.count_if(k).alias("kept"), F.count_if(k & (F.col("id") % 9 != 0)).alias("delivered"), F.count_if(k & (F.col("id") % 9 == 0) & (F.col("id") % 2 == 0)).alias("skipped"))
    return g.withColumn("open", delivery.gate(F.col("kept"), F.col("delivered"), F.col("skipped")))


@query("r7_missing_deliveries", f"WITH {A.JUDGED} SELECT id FROM items WHERE state = 'kept' AND id % 9 = 0")
def r7(spark, d):
    kept = A.judged(spark, d).filter("state = 'kept'")
    return delivery.complete(kept, kept.filter("id % 9 != 0").select("id"), "id").select("id")


@query("r3_analysis_label", f"WITH {A.JUDGED} SELECT id, CASE WHEN decided_by = 'rule' THEN 'Rule' WHEN rule NOT IN ('ai_email','ai_file','mail_screen') THEN 'Rule' ELSE '1st analysis' END AS analysis FROM items")
def r3(spark, d):
    return A.judged(spark, d).select("id", insights.analysis_label(F.col("decided_by"), F.col("rule"), F.col("state"), F.lit(False)).alias("analysis"))


@query("o3_page", f"WITH {A.JUDGED} SELECT id, label FROM items ORDER BY id DESC LIMIT 100 OFFSET 100")
def o3(spark, d):
    return A.judged(spark, d).select("id", "label").orderBy(F.desc("id")).offset(100).limit(100)


@query("k4_request_lines", f"WITH {A.FILES} SELECT id, length(text) AS n FROM files WHERE ext = '.txt'")
def k4(spark, d):
    f = A.files(spark, d).filter("ext = '.txt'")
    lines = delivery.request_lines(f, "model", "")
    got = F.from_json("value", "custom_id STRING, body STRUCT<messages: ARRAY<STRUCT<content: STRING>>>")
    return lines.select(got.alias("j")).select(F.col("j.custom_id").cast("long").alias("id"), F.length(F.col("j.body.messages")[0]["content"]).cast("long").alias("n"))


@query("s4_s5_sync", "SELECT coalesce(a.s_suppkey, b.s_suppkey) AS id, coalesce(b.v, a.v) AS v FROM (SELECT s_suppkey, 'old' AS v FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey, 'new' AS v FROM supplier WHERE s_suppkey % 2 = 0) b ON a.s_suppkey = b.s_suppkey WHERE b.v IS NOT NULL OR a.s_suppkey % 5 = 0")
def s45(spark, d):
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    old, new = s.filter("id % 3 != 0").withColumn("v", F.lit("old")), s.filter("id % 2 = 0").withColumn("v", F.lit("new"))
    return ledger.prune(ledger.upsert(old, new, "id"), new.select("id"), "id", F.col("id") % 5 == 0)
