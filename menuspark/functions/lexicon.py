"""Word lists and patterns of the menu parser. They are parameters: pass other ones to the jobs that use them."""

from __future__ import annotations

from dataclasses import dataclass

# The lists below decide results and are given as they are.
CATEGORY_WORDS = (
    "ראשונות", "ראשונים", "מנות ראשונות", "עיקריות", "מנות עיקריות", "עיקריים",
    "קינוחים", "קינוח", "שתייה", "שתיה", "משקאות", "בר", "יינות", "יין", "בירות", "בירה",
    "סלטים", "סלט", "מרקים", "מרק", "פסטות", "פסטה", "פיצות", "פיצה", "המבורגר", "המבורגרים",
    "דגים", "בשרים", "מהגריל", "מהטאבון", "צמחוני", "טבעוני", "תוספות", "כריכים", "לחמים",
    "ארוחת בוקר", "בוקר", "צהריים", "ילדים", "מנות ילדים", "טפאס", "מאכלי ים", "קפה", "תפריט",
    "starters", "appetizers", "mains", "main courses", "desserts", "drinks", "beverages",
    "salads", "soups", "pasta", "pizza", "burgers", "fish", "meat", "grill", "sides",
    "sandwiches", "breakfast", "kids", "wine", "beer", "cocktails", "coffee", "menu",
)
UNIT_WORDS = (
    "גרם", "גר", "ג'", "ג", 'ק"ג', "קג", 'מ"ל', "מל", "ליטר", "ל", "יח", "יח'", "יחידות",
    "דקות", "שעות", "אנשים", "סועדים", "קלוריות", "אחוז", "שנה", "שנים", "מעלות",
    "g", "gr", "gram", "grams", "kg", "ml", "l", "ltr", "cl", "oz", "cm", "mm", "pcs",
    "kcal", "cal", "min", "mins", "%", "abv",
)
CURRENCY_WORDS = ("₪", 'ש"ח', "ש״ח", "שח", "NIS", "ILS")
MONEY_MARKS = ("₪", 'ש"ח', "ש״ח", "שקלים", "שקל", "שח", "NIS", "ILS")
CONTINUATIONS = r"(?iu)^(?:עם|מוגש(?:ת|ים)?|כולל(?:ת)?|בתוספת|בליווי|על|served|with|includes)"
UNCATEGORIZED, NO_CATEGORY, NO_NAME = "uncategorized", "ללא קטגוריה", "(ללא שם)"
OPTION = "אפשרות"
REASONS = {
    "no_name": "לא זוהה שם למנה",
    "ambiguous": "יותר ממחיר אחד בשורה — ודאו איזה גודל מתאים לכל מחיר",
    "unsure": "זיהוי טקסט לא ודאי",
    "promo": "נראה כמו מבצע או ארוחה עסקית — בדקו את התנאים",
    "inferred": "המחיר שויך לפי מיקום בעמודה — כדאי לוודא",
    "no_price": "לא זוהה מחיר — הזינו אותו ידנית",
    "manual": "פריט שנוסף ידנית — השלימו שם ומחיר",
}
# End of fixed values.


def hebrew_word(word: str) -> str:
    """A Hebrew word that no Hebrew letter touches."""
    return rf"(?<![\u0590-\u05FF])(?:{word})(?![\u0590-\u05FF])"


def latin_word(word: str) -> str:
    """A word between ASCII word boundaries. Java's own boundary is Unicode-aware and would miss one beside Hebrew."""
    return rf"(?<![A-Za-z0-9_])(?:{word})(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class Note:
    pattern: str
    kind: str
    note: str


# Order decides which pattern wins.
VARIANT_PATTERNS = (
    (hebrew_word("קטן|קטנה"), "קטן"),
    (hebrew_word("גדול(?:ה)?"), "גדול"),
    (hebrew_word("בינוני(?:ת)?"), "בינוני"),
    (hebrew_word("חצי"), "חצי"),
    (hebrew_word("שלם|שלמה"), "שלם"),
    (hebrew_word("חצי ליטר"), "חצי ליטר"),
    (hebrew_word("כוס"), "כוס"),
    (hebrew_word("בקבוק"), "בקבוק"),
    (hebrew_word("שליש"), "שליש"),
    ("(?i)" + latin_word("small"), "קטן"),
    ("(?i)" + latin_word("medium"), "בינוני"),
    ("(?i)" + latin_word("large"), "גדול"),
    ("(?i)" + latin_word("glass"), "כוס"),
    ("(?i)" + latin_word("bottle"), "בקבוק"),
)
PRICELESS_PATTERNS = (
    Note(r"מחיר\s*שוק", "market", "מחיר שוק — יש לברר במסעדה"),
    Note(r"מחיר\s*יום", "market", "מחיר יום — יש לברר במסעדה"),
    Note(r"לפי\s*מחיר\s*שוק", "market", "מחיר שוק — יש לברר במסעדה"),
    Note(r"(?i)market\s*price", "market", "Market price — ask the restaurant"),
    Note(r"(?<![A-Za-z0-9_])S\.?Q(?:\.(?=[A-Za-z0-9_])|(?![A-Za-z0-9_]))", "market", "מחיר משתנה — יש לברר במסעדה"),
    Note(r"לפי\s*משקל", "byWeight", "מתומחר לפי משקל"),
    Note(r"ל\s*100\s*גרם", "byWeight", "מתומחר לפי משקל"),
    Note(r'לק"ג|לקילו', "byWeight", "מתומחר לפי משקל"),
    Note(r"(?i)per\s*(?:kg|100\s*g)", "byWeight", "מתומחר לפי משקל"),
)
PROMO_PATTERNS = (
    hebrew_word("מבצע"),
    r"(?<![A-Za-z0-9_])1\s*\+\s*1(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])2\s*\+\s*1(?![A-Za-z0-9_])",
    r"ארוחה\s*עסקית",
    "עסקית",
    hebrew_word("הנחה"),
    hebrew_word("חינם"),
    r"(?i)(?<![A-Za-z0-9_])buy\s*one(?![A-Za-z0-9_])",
    "(?i)" + latin_word("combo"),
    "(?i)" + latin_word("deal"),
    r"(?i)\d+\s*%\s*(?:הנחה|off)",
)
# End of fixed values.
