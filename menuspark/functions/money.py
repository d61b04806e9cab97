"""Money: integer agorot (1/100 of a shekel) in, derived amounts as unrounded doubles, rounding only for display.

Everything here is a Column of built-in functions. Inputs are cast to bigint before they are multiplied, so that ANSI mode
finds no overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import bound
from .lexicon import MONEY_MARKS

MAX_AGOROT = 100_000_000
#: White space as JavaScript's \s has it; Java's has ASCII only.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
BIDI = "\u200e\u200f" + "".join(map(chr, [*range(0x202A, 0x202F), *range(0x2066, 0x206A)]))

# Which separators group digits and which begin the decimals.
COMMA_GROUPS = r"^\d{1,3}(?:,\d{3})+(?:\.\d+)?\z"
DOT_GROUPS, MANY_DOTS = r"^\d{1,3}(?:\.\d{3})+,\d+\z", r"^\d{1,3}(?:\.\d{3}){2,}\z"
COMMA_DECIMAL = r"^\d+,\d+\z"
# End of fixed values.


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def no_bidi(text: Column) -> Column:
    return F.translate(text, BIDI, "")


def round_half_away(value: Column) -> Column:
    """To a whole number, halves away from zero."""
    return F.round(value)


def is_valid_agorot(value: Column) -> Column:
    """A whole amount from 0 to ``MAX_AGOROT``; false for null and NaN."""
    v = value.cast("double")
    return F.coalesce(~F.isnan(v) & (v == F.floor(v)) & v.between(0, MAX_AGOROT), F.lit(False))


def _in_range(value: Column) -> Column:
    return F.when((value >= 0) & (value <= MAX_AGOROT), value.cast("bigint"))


def parse_number(value: Column) -> Column:
    """Agorot of an amount in shekels; null if it is negative, not finite or too large."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (v >= 0) & (v <= MAX_AGOROT), _in_range(round_half_away(v * 100)))


def parse_money(text: Column) -> Column:
    """Agorot of a text that holds one amount and nothing else but currency marks; else null.

    ``1,234.50``, ``1.234,50``, ``1.234.567`` and ``12,50`` are read; a single ``12.005`` is a decimal. The product with 100 is
    taken in doubles, as prices were read by the screens this matches.
    """
    marks = "(?iu)" + "|".join(MONEY_MARKS)
    strip = lambda x: F.replace(x, F.lit(","), F.lit(""))
    dotted = lambda x: F.replace(x, F.lit(","), F.lit("."))

    def plain(t: Column) -> Column:
        return (
            F.when(~F.contains(t, F.lit(",")) & ~t.rlike(MANY_DOTS), t)
            .when(t.rlike(COMMA_GROUPS), strip(t))
            .when(t.rlike(DOT_GROUPS) | t.rlike(MANY_DOTS), dotted(F.replace(t, F.lit("."), F.lit(""))))
            .when(t.rlike(COMMA_DECIMAL), dotted(t))
            .otherwise(t)
        )

    def amount(p: Column) -> Column:
        return F.when(p.rlike(r"^-?\d+(?:\.\d+)?\z"), bound(round_half_away(p.try_cast("double") * 100), _in_range))

    clean = trim(F.regexp_replace(no_bidi(trim(text)), marks, ""))
    # Without a digit there is no amount: most words of a page end here.
    return F.when(text.rlike(r"[0-9]"), bound(bound(clean, plain), amount))


def format_amount(agorot: Column) -> Column:
    """``1,234.50``; a negative one has a left-to-right mark and a minus before it."""
    body = F.format_number(F.abs(round_half_away(agorot)) / 100, 2)
    return F.when(agorot < 0, F.concat(F.lit("\u200e-"), body)).otherwise(body)


def format_ils(agorot: Column) -> Column:
    """``₪1,234.50``, the sign outside: it is that of the amount before rounding."""
    return F.concat(F.when(agorot < 0, F.lit("-")).otherwise(F.lit("")), F.lit("₪"), F.format_number(F.abs(round_half_away(F.abs(agorot))) / 100, 2))


def percent_to_bp(percent: Column) -> Column:
    return round_half_away(percent.cast("double") * 100).cast("bigint")


def bp_to_percent(bp: Column) -> Column:
    return bp / F.lit(100.0)


# The budget's measures.

CLOSE_THRESHOLD = 0.9


def _whole(value: Column) -> Column:
    return F.greatest(F.floor(value), F.lit(0)).cast("bigint")


def total_budget(diners: Column, per_person: Column) -> Column:
    return _whole(diners) * per_person.cast("bigint")


def tip_for(subtotal: Column, tip_bp: Column) -> Column:
    return subtotal.cast("double") * tip_bp / F.lit(10_000.0)


def is_within_budget(subtotal: Column, tip_bp: Column, total: Column) -> Column:
    """Exact: whole numbers on both sides."""
    return subtotal.cast("bigint") * (F.lit(10_000).cast("bigint") + tip_bp) <= total.cast("bigint") * 10_000


def max_food_subtotal(total: Column, tip_bp: Column) -> Column:
    """The largest subtotal that fits once the tip is added."""
    part = (total.cast("bigint") * 10_000 - F.pmod(total.cast("bigint") * 10_000, F.lit(10_000).cast("bigint") + tip_bp)) / (F.lit(10_000).cast("bigint") + tip_bp)
    return F.when(total > 0, part.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def marginal_cost(price: Column, tip_bp: Column) -> Column:
    return price + tip_for(price, tip_bp)


def percent_used(fraction: Column) -> Column:
    return round_half_away(fraction * 100).cast("bigint")


def meter(fraction: Column) -> Column:
    """The percentage as a bar shows it, from 0 to 100."""
    return F.least(F.greatest(percent_used(fraction), F.lit(0)), F.lit(100))
