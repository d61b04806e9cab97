"""Text rules of menu lines and dish names, as Columns of built-in functions; NFKC alone is a vectorised pandas function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .columns import bound
from .lexicon import CATEGORY_WORDS, CONTINUATIONS, CURRENCY_WORDS, PRICELESS_PATTERNS, PROMO_PATTERNS, UNIT_WORDS, VARIANT_PATTERNS
from .money import SPACE, no_bidi, trim

LEADER_DOTS = r"[.\u2024\u2025\u2026\u00B7\u2022\-_]{2,}"
PUNCTUATION = r"""["'`״׳.,:;!?()\[\]{}<>\-–—_/\\|*]"""
NIQQUD = r"[\u0591-\u05C7]"
#: Texts of these characters alone are their own NFKC form.
PLAIN = r"^[\x00-\x7F\u05D0-\u05EA\u0591-\u05C7\u200E\u200F]*\z"
SIMILARITY_THRESHOLD = 0.74


def clean_word(text: Column) -> Column:
    return trim(no_bidi(text))


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def clean_line_text(text: Column) -> Column:
    """Without bidi marks and leader dots, single spaces."""
    return collapse(F.regexp_replace(clean_word(text), LEADER_DOTS, " "))


def line_direction(text: Column) -> Column:
    """"rtl" if there are at least as many Hebrew and Arabic characters as Latin letters."""
    rtl = F.length(F.regexp_replace(text, r"[^\u0590-\u06FF]", ""))
    ltr = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    return F.when(rtl >= ltr, F.lit("rtl")).otherwise(F.lit("ltr"))


def is_unit_word(text: Column, words: tuple[str, ...] = UNIT_WORDS) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(clean_word(text)), r"[.,:;]+\z", "").isin(*words), F.lit(False))


def is_currency_word(text: Column) -> Column:
    return F.coalesce(F.lower(clean_word(text)).isin(*(w.lower() for w in CURRENCY_WORDS)), F.lit(False))


def is_category_word(text: Column, words: tuple[str, ...] = CATEGORY_WORDS) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(trim(text)), r"[:：]+\z", "").isin(*words), F.lit(False))


def heading_name(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"[:：]+\z", ""))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != ""))


def is_continuation(text: Column) -> Column:
    """Four words or more, or a connective at the start."""
    return (word_count(text) >= 4) | text.rlike(rf"{CONTINUATIONS}(?={SPACE}|\z)")


def detect_variant_labels(text: Column, patterns=VARIANT_PATTERNS) -> Column:
    """Labels of the patterns that match, by their first places, then list order."""
    def place(pattern: str) -> Column:
        flags = "(?si)" if pattern.startswith("(?i)") else "(?s)"
        return F.when(text.rlike(pattern), F.length(F.regexp_extract(text, rf"{flags}^(.*?)(?:{_flagless(pattern)})", 1)))

    found = F.array(*[F.struct(place(p).alias("at"), F.lit(i).alias("ord"), F.lit(label).alias("label")) for i, (p, label) in enumerate(patterns)])
    return F.transform(F.array_sort(F.filter(found, lambda x: x["at"].isNotNull())), lambda x: x["label"])


def _flagless(pattern: str) -> str:
    return pattern.removeprefix("(?i)")


def market_pattern(text: Column, patterns=PRICELESS_PATTERNS) -> Column:
    """struct(kind, note, rest) of the first pattern of the list that matches, its first match blanked in ``rest``; else null."""
    out = None
    for p in patterns:
        flags = "(?si)" if p.pattern.startswith("(?i)") else "(?s)"
        rest = F.regexp_replace(text, rf"{flags}^(.*?)(?:{_flagless(p.pattern)})", "$1 ")
        value = F.struct(F.lit(p.kind).alias("kind"), F.lit(p.note).alias("note"), rest.alias("rest"))
        out = F.when(text.rlike(p.pattern), value) if out is None else out.when(text.rlike(p.pattern), value)
    return out


def is_promo(text: Column, patterns=PROMO_PATTERNS) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return F.coalesce(out, F.lit(False))


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode's compatibility form, for which Spark has no function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def needs_nfkc(text: Column) -> Column:
    return F.coalesce(~text.rlike(PLAIN), F.lit(False))


def normalize_name(name: Column, *, is_nfkc: bool = True) -> Column:
    """A dish name for comparison: no niqqud, bidi marks or punctuation, single spaces, lower case. ``is_nfkc``: the name is in
    NFKC form already, as plain Hebrew and ASCII are; else it is brought to it first."""
    text = name if is_nfkc else nfkc(name)
    return F.lower(collapse(F.regexp_replace(no_bidi(F.regexp_replace(text, NIQQUD, "")), PUNCTUATION, " ")))


def trigrams(normal: Column) -> Column:
    """The character trigrams of a normalised name with two spaces at each side, in order; the k-th of equal ones is marked ``#k``, so
    sets of them intersect as multisets. One split, one sort and one scan: equal ones are neighbours, and each run is numbered."""
    letters = F.split(F.concat(F.lit("  "), normal, F.lit("  ")), "")

    def grams(c: Column) -> Column:
        return F.array_sort(F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))

    def numbered(g: Column, starts: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(starts, k + 1), F.size(g))
        return F.flatten(F.transform(starts, lambda at, k: F.transform(F.sequence(F.lit(1), stop(k) - at), lambda i: F.concat(F.get(g, at), F.lit("#"), i.cast("string")))))

    def scanned(g: Column) -> Column:
        # Most names repeat none.
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.transform(g, lambda x: F.concat(x, F.lit("#1")))).otherwise(runs(g))

    def runs(g: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: (i == 0) | (F.get(g, i) != F.get(g, i - 1)))
        return bound(starts, lambda s: numbered(g, s))

    return bound(letters, lambda c: bound(grams(c), scanned))


def dice(left: Column, right: Column, left_grams: Column, right_grams: Column) -> Column:
    """Dice's coefficient of two normalised names from their numbered trigrams: 0 if either is empty, 1 if equal."""
    shared = F.size(F.array_intersect(left_grams, right_grams))
    return F.when((left == "") | (right == ""), F.lit(0.0)).when(left == right, F.lit(1.0)).otherwise(2.0 * shared / (F.size(left_grams) + F.size(right_grams)))


def similarity(left: Column, right: Column) -> Column:
    """Dice's coefficient over the trigrams of two names (in NFKC form)."""
    a, b = normalize_name(left), normalize_name(right)
    return dice(a, b, trigrams(a), trigrams(b))


# Texts of suggestions and failures.
SAME = "שם ומחיר זהים בשתי תמונות"
SIMILAR, PRICES_DIFFER = "שם דומה", "אך מחירים שונים — ייתכן שאלו גדלים שונים"
FAILED_NETWORK = "לא ניתן להוריד את קובצי השפה. בדקו חיבור לאינטרנט ונסו שוב — הקבצים נשמרים במכשיר לאחר ההורדה הראשונה."
FAILED_MEMORY = "נגמר הזיכרון בזמן העיבוד. נסו תמונה אחת בכל פעם, או צלמו בנפרד חלקים מהתפריט."
FAILED_OTHER = "זיהוי הטקסט נכשל: "
# End of fixed values.


def duplicate_reason(score: Column, auto: Column, compatible: Column) -> Column:
    similar = F.concat(F.lit(f"{SIMILAR} ("), F.round(score * 100).cast("bigint").cast("string"), F.lit("%)"))
    return F.when(auto, F.lit(SAME)).when(compatible, similar).otherwise(F.concat(similar, F.lit(f" {PRICES_DIFFER}")))


def classify_ocr_error(message: Column) -> Column:
    """struct(kind, text): network, memory or other, and the text to show."""
    kind = F.when(message.rlike(r"(?i)fetch|network|Failed to load|ERR_"), "network").when(message.rlike(r"(?i)memory|Aborted|allocation"), "memory").otherwise("other")
    text = F.when(kind == "network", FAILED_NETWORK).when(kind == "memory", FAILED_MEMORY).otherwise(F.concat(F.lit(FAILED_OTHER), message))
    return F.struct(kind.alias("kind"), text.alias("text"))
