"""Lines and pages with the geometry of a recognised menu, and what a page record holds."""

from __future__ import annotations

PAGE_WIDTH, CHAR_WIDTH, GAP = 1000, 13, 10
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
LINES = f"menu_id string, page_id string, line_no int, text string, confidence double, bbox {BOX}, words array<struct<text:string,confidence:double,bbox:{BOX}>>"
HINTS = f"menu_id string, page_id string, hint_no int, values array<bigint>, bbox {BOX}"
PAGES = "menu_id string, page_id string, page_seq int, page_width double"
VARIANTS = "array<struct<id:string,label:string,price_agorot:bigint,needs_review:boolean>>"
ITEMS = f"menu_id string, item_id string, item_pos bigint, name string, description string, category_id string, variants {VARIANTS}, price_kind string, confidence double, needs_review boolean, review_reasons array<string>, source_image_ids array<string>, origin string"


def line(tokens, y=100, height=24, confidence=92.0, ltr=False, menu="m", page="p", no=0):
    """The first token is at the right edge, unless the row is read from the left."""
    words, at = [], 0.0 if ltr else float(PAGE_WIDTH)
    for token in tokens:
        width = max(18, len(token) * CHAR_WIDTH)
        x0, x1 = (at, at + width) if ltr else (at - width, at)
        words.append((token, confidence, (float(x0), float(y), float(x1), float(y + height))))
        at = x1 + GAP if ltr else x0 - GAP
    box = (min(w[2][0] for w in words), float(y), max(w[2][2] for w in words), float(y + height))
    return (menu, page, no, " ".join(tokens), confidence, box, words)


def page(rows, menu="m", page_id="p"):
    """(tokens, options) rows to lines, one under the other."""
    out, y = [], 0
    for no, (tokens, options) in enumerate(rows):
        height = options.get("height", 24)
        y += height + 14
        out.append(line(tokens, **({"y": y} | options), menu=menu, page=page_id, no=no))
    return out


HEBREW = [
    (["מנות", "ראשונות"], {"height": 34}), (["חומוס", "הבית", "32"], {}), (["עם", "גרגרים", "חמים", "ושמן", "זית"], {}), (["סלט", "ירקות", "קצוץ", "38"], {}),
    (["מנת", "פוקצ׳ה", "180", "גרם", "29"], {}), (["עיקריות"], {"height": 34}), (["שניצל", "עוף", "עם", "צ׳יפס", "68"], {}), (["דג", "הים", "הטרי", "מחיר", "שוק"], {}),
    (["אנטריקוט", "לפי", "משקל"], {}), (["פסטה", "ברוטב", "עגבניות"], {}), (["שתייה"], {"height": 34}), (["בירה", "מהחבית", "קטן", "גדול", "22", "32"], {}),
    (["Fresh", "Lemonade", "18"], {"ltr": True}), (["יין", "הבית", "₪", "39"], {}),
]


def item(item_id, pos, name, price, image, description=None, menu="m", category="c", kind="fixed", review=False, label=None):
    prices = price if isinstance(price, list) else [price]
    variants = [(f"{item_id}-{k}", label, p, False) for k, p in enumerate(prices)]
    return (menu, item_id, pos, name, description, category, variants, kind, 1.0, review, [], [image] if image else [], "ocr")
