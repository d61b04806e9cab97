"""Budgets: from selections and prices to a session's summary and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import money

SUMMARY = ("total_budget_agorot", "food_subtotal_agorot", "tip_agorot", "estimated_total_agorot", "remaining_agorot", "max_food_subtotal_agorot", "remaining_food_budget_agorot", "fraction_used", "status", "overspend_agorot")


def line_total(price: Column, qty: Column) -> Column:
    return price.cast("bigint") * F.greatest(F.floor(qty), F.lit(0)).cast("bigint")


def food_subtotal(lines: DataFrame) -> DataFrame:
    """(session_id, food_subtotal_agorot) over priced lines: partial sums before the shuffle. Lines without a price don't
    count."""
    return lines.filter("price_agorot is not null").groupBy("session_id").agg(F.sum(line_total(F.col("price_agorot"), F.col("qty"))).alias("food_subtotal_agorot"))


def with_summary(sessions: DataFrame) -> DataFrame:
    """The ten measures for sessions that have diners, per_person_agorot, tip_bp and food_subtotal_agorot."""
    c = F.col
    out = sessions.withColumn("food_subtotal_agorot", F.coalesce("food_subtotal_agorot", F.lit(0).cast("bigint")))
    out = out.withColumn("total_budget_agorot", money.total_budget(c("diners"), c("per_person_agorot")))
    out = out.withColumn("tip_agorot", money.tip_for(c("food_subtotal_agorot"), c("tip_bp")))
    out = out.withColumn("estimated_total_agorot", c("food_subtotal_agorot") + c("tip_agorot"))
    out = out.withColumn("remaining_agorot", c("total_budget_agorot") - c("estimated_total_agorot"))
    out = out.withColumn("max_food_subtotal_agorot", money.max_food_subtotal(c("total_budget_agorot"), c("tip_bp")))
    out = out.withColumn("remaining_food_budget_agorot", F.greatest(c("max_food_subtotal_agorot") - c("food_subtotal_agorot"), F.lit(0).cast("bigint")))
    out = out.withColumn("fraction_used", F.when(c("total_budget_agorot") > 0, c("estimated_total_agorot") / c("total_budget_agorot")).otherwise(0.0))
    within = money.is_within_budget(c("food_subtotal_agorot"), c("tip_bp"), c("total_budget_agorot"))
    out = out.withColumn("status", F.when(~within, "over").when(c("fraction_used") >= money.CLOSE_THRESHOLD, "close").otherwise("comfortable"))
    return out.withColumn("overspend_agorot", F.when(within, 0.0).otherwise(-c("remaining_agorot")))


def compute_budget(sessions: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per session with its summary; a session without priced lines has a subtotal of 0."""
    return with_summary(sessions.join(food_subtotal(lines), "session_id", "left")).select("session_id", *SUMMARY)


# What the budget form says.
DINERS_MISSING, DINERS_WRONG, DINERS_MANY = "נא להזין מספר סועדים", "מספר הסועדים חייב להיות מספר שלם, 1 ומעלה", "עד 100 סועדים"
PER_PERSON_MISSING, PER_PERSON_WRONG, PER_PERSON_ZERO = "נא להזין תקציב לאדם", "סכום לא תקין", "התקציב חייב להיות גדול מאפס"
TIP_MISSING, TIP_WRONG, TIP_HIGH = "נא להזין אחוז טיפ (אפשר 0)", "אחוז לא תקין", "עד 100%"
# End of fixed values.


def validate_budget(forms: DataFrame) -> DataFrame:
    """Form texts diners, per_person, tip to values and errors: a number's prefix counts for diners and tip, as screens read
    them; ``valid`` if no field has an error."""
    s = money.SPACE
    blank = lambda name: money.trim(F.coalesce(F.col(name), F.lit(""))) == ""
    diners = F.regexp_extract("diners", rf"^{s}*([+-]?\d+)", 1).try_cast("double")
    tip = F.regexp_extract(F.replace("tip", F.lit(","), F.lit(".")), rf"^{s}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    out = forms.withColumn("diners_value", diners).withColumn("per_person_agorot", money.parse_money(F.col("per_person"))).withColumn("tip_value", tip)
    c = F.col
    out = out.withColumn("diners_error", F.when(blank("diners"), DINERS_MISSING).when(c("diners_value").isNull() | (c("diners_value") < 1), DINERS_WRONG).when(c("diners_value") > 100, DINERS_MANY))
    out = out.withColumn("per_person_error", F.when(blank("per_person"), PER_PERSON_MISSING).when(c("per_person_agorot").isNull(), PER_PERSON_WRONG).when(c("per_person_agorot") <= 0, PER_PERSON_ZERO))
    out = out.withColumn("tip_error", F.when(blank("tip"), TIP_MISSING).when(c("tip_value").isNull() | (c("tip_value") < 0), TIP_WRONG).when(c("tip_value") > 100, TIP_HIGH))
    valid = c("diners_error").isNull() & c("per_person_error").isNull() & c("tip_error").isNull()
    return out.withColumn("valid", valid).withColumn("tip_bp", F.when(valid, money.percent_to_bp(c("tip_value"))))
