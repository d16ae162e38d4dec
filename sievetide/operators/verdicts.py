"""What a judge's answers become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SENSITIVITIES

ANSWER = "relevance STRING, sensitivity STRING, reason STRING, confidence INT"


def parse_answer(raw: Column) -> Column:
    """A judgement from JSON, fenced or not; null if it is none or a value is out of its set."""
    bare = F.regexp_replace(F.trim(raw), r"(?s)^```(?:json)?\s*|\s*```$", "")
    a = F.from_json(bare, ANSWER)
    ok = a["relevance"].isin("relevant", "irrelevant") & a["sensitivity"].isin(*SENSITIVITIES)
    return F.when(ok, a)


def clamp_percent(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.floor(x + F.lit(0.5)))).cast("int"))


def decide_file(relevance: Column, sensitivity: Column, employee: Column, involved: Column, large: Column) -> Column:
    """keep, discard or review; the first rule that holds."""
    return F.when(relevance.isNull() | sensitivity.isNull(), "review").when(sensitivity != "none", "discard").when(employee & (relevance == "irrelevant") & ~involved, "discard").when(large, "review").otherwise("keep")


def confidential_category(sensitivity: Column) -> Column:
    """The category that forbids delivery; null for none, and for values that are missing or unknown."""
    return F.when(sensitivity.isin(*SENSITIVITIES[1:]), sensitivity)


def fold_mail(verdict: Column, sensitivity: Column, reason: Column, second_pass: Column) -> Column:
    """(verdict, reason, second_pass, confidential): confidential mail goes, without a second pass."""
    category = confidential_category(sensitivity)
    bad = category.isNotNull()
    told = F.substring(F.concat(F.lit("Confidential ("), category, F.lit("): "), reason), 1, 240)
    return F.struct(
        F.when(bad, "discard").otherwise(verdict).alias("verdict"), F.when(bad, told).otherwise(reason).alias("reason"),
        (~bad & F.coalesce(second_pass, F.lit(False))).alias("second_pass"), bad.alias("confidential"),
    )


def sampled(id_: Column, share: float) -> Column:
    """A share of ids by the first 32 bits of their hash."""
    return F.conv(F.substring(F.sha2(id_.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(float(2**32)) < F.lit(share)


def needs_second_review(id_: Column, p_keep: Column, doubtful: Column, involved: Column, least: int = 8, share: float = 0.02) -> Column:
    return p_keep.isNull() | (p_keep >= least) | doubtful | involved | sampled(id_, share)


AUDIT = "decision STRING, reason STRING, needs_second_pass BOOLEAN, sensitivity STRING, confidence DOUBLE"


def apply_first_pass(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """requests (id) with what their mail answers (id, raw) decide: state, reason, p_keep, second_pass, confidential.

    An answer that is no JSON discards, and so does any decision but keep; a confidential category discards whatever else was
    said. A mail without an answer stays pending.
    """
    j = requests.join(answers, "id", "left")
    bare = F.regexp_replace(F.trim("raw"), r"(?s)^```(?:json)?\s*|\s*```$", "")
    broken = F.try_parse_json(bare).isNull()
    a = F.when(~broken, F.from_json(bare, AUDIT))
    verdict = F.when(a["decision"] == "keep", "keep").otherwise("discard")
    reason = F.when(broken, "Invalid AI output format.").otherwise(F.coalesce(F.nullif(a["reason"], F.lit("")), F.lit("Audited.")))
    j = j.withColumn("folded", F.when(F.col("raw").isNotNull(), fold_mail(verdict, a["sensitivity"], reason, a["needs_second_pass"]))).withColumn("p_keep", clamp_percent(a["confidence"]))
    state = F.when(F.col("folded").isNull(), "pending").when(F.col("folded.verdict") == "keep", "kept").otherwise("discarded")
    return j.select(*requests.columns, "raw", state.alias("state"), "folded.reason", "p_keep", "folded.second_pass", "folded.confidential")


def apply_second_review(kind: Column, verdict: Column, sensitivity: Column) -> Column:
    """Failures keep mail and send files to review; a confidential mail that would be kept goes."""
    return F.when(verdict.isNull(), F.when(kind == "email", "keep").otherwise("review")).when((kind == "email") & (verdict == "keep") & F.coalesce(sensitivity != "none", F.lit(False)), "discard").otherwise(verdict)


def missing_answer(kind: Column) -> Column:
    return F.when(kind == "file", "review").otherwise("retry")


def retry_runs(runs: DataFrame) -> DataFrame:
    """Failed, expired and cancelled runs are sent again once; after that their files go to review."""
    bad = F.col("status").isin("failed", "expired", "cancelled")
    return runs.withColumn("next", F.when(bad & (F.col("attempt") < 2), "resubmit").when(bad, "review").otherwise("none"))


def route(n: Column, threshold: int = 100) -> Column:
    return F.when(n > threshold, "batch").otherwise("synchronous")


def image_verdict(verdict: Column, sensitivity: Column, sure: Column, readable: Column) -> Column:
    """A picture is discarded only for sure; as irrelevant only if it has text to show that, as confidential even without."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    return F.when((verdict == "discard") & ~yes(sure), "review").when((verdict == "discard") & (sensitivity == "none") & ~yes(readable), "review").otherwise(verdict)


def fit_payload(first: Column, second: Column, rest: Column, limit: int = 400_000, chain: int = 20_000, body: int = 150_000) -> Column:
    """Over the limit the chain is cut first, then, if that is not enough, the bodies."""
    size = lambda *c: sum((F.length(F.coalesce(x, F.lit(""))) for x in c), F.lit(0))
    over, cut = size(first, second, rest) > limit, F.substring(rest, 1, chain)
    still = over & (size(first, second, cut) > limit)
    return F.struct(F.when(still, F.substring(first, 1, body)).otherwise(first).alias("first"), F.when(still, F.substring(second, 1, body)).otherwise(second).alias("second"), F.when(over, cut).otherwise(rest).alias("rest"))


def item_state(verdict: Column) -> Column:
    return F.when(verdict == "keep", "kept").when(verdict == "discard", "discarded").otherwise("review")


def guarded_update(items: DataFrame, decisions: DataFrame, guard: Column) -> DataFrame:
    """items with the decisions (id, new_state, new_rule) of the rows that the guard still allows."""
    j = items.join(decisions, "id", "left")
    ok = F.col("new_state").isNotNull() & F.coalesce(guard, F.lit(False))
    j = j.withColumn("vd_ok", ok)
    return j.withColumn("state", F.when(F.col("vd_ok"), F.col("new_state")).otherwise(F.col("state"))).withColumn("rule", F.when(F.col("vd_ok"), F.col("new_rule")).otherwise(F.col("rule"))).drop("new_state", "new_rule", "vd_ok")


def cascade_to_children(items: DataFrame) -> DataFrame:
    """Children of discarded parents are discarded by the parent's rule; again gives the same."""
    gone = items.filter("state = 'discarded'").select(F.col("id").alias("parent_id"), F.col("rule").alias("parent_rule"))
    j = items.join(gone, "parent_id", "left")
    hit = F.col("parent_rule").isNotNull()
    return j.withColumn("state", F.when(hit, "discarded").otherwise(F.col("state"))).withColumn("rule", F.when(hit, F.col("parent_rule")).otherwise(F.col("rule"))).drop("parent_rule")
