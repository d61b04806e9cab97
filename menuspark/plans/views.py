"""The driver's tables as menus, sessions, pages and logs: plain projections, the same as SQL in ``queries``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import bound, computed
from ..operators.menu import VARIANT
from ..sources.staging import staged

MENU_ITEMS = 16
#: The heading of each part type on a menu page.
HEADINGS = {"ECONOMY": "sides", "SMALL": "starters", "MEDIUM": "mains", "PROMO": "drinks", "STANDARD": "salads", "LARGE": "desserts"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _menu(key: str) -> Column:
    return F.floor(F.col(key) / MENU_ITEMS).cast("bigint")


def items(spark: SparkSession, sf_dir: str, *, simple_prices: bool = False) -> DataFrame:
    """``simple_prices``: one of two prices, so that equal names can have equal prices."""
    c = F.col
    kind = F.when(c("p_size") % 20 == 0, "market").when(c("p_size") % 20 == 1, "byWeight").otherwise("fixed")
    price = (4000 + 1000 * (c("p_size") % 2)).cast("bigint") if simple_prices else F.round(c("p_retailprice") * 100).cast("bigint")
    price = F.when(kind == "fixed", price) if simple_prices else F.when(kind != "market", price)
    id_ = c("p_partkey").cast("string")
    large = F.floor(price * 14 / 10).cast("bigint")
    variant = lambda k, label, p: F.struct(F.concat(id_, F.lit(f"-{k}")).alias("id"), F.lit(label).cast("string").alias("label"), p.alias("price_agorot"), F.lit(False).alias("needs_review"))
    one = F.array(variant(0, None, price)).cast(f"array<{VARIANT}>")
    two = F.array(variant(0, None, price), variant(1, "large", large)).cast(f"array<{VARIANT}>")
    return table(spark, sf_dir, "part").select(
        _menu("p_partkey").alias("menu_id"), id_.alias("item_id"), (c("p_partkey") % MENU_ITEMS).alias("item_pos"), c("p_name").alias("name"),
        F.when(c("p_size") % 3 == 0, F.concat(F.lit("with "), c("p_brand"))).alias("description"), c("p_type").alias("category_id"),
        (one if simple_prices else F.when(c("p_size") % 5 == 0, two).otherwise(one)).alias("variants"), kind.alias("price_kind"), F.lit(1.0).alias("confidence"),
        (c("p_size") % 7 == 0).alias("needs_review"), F.array().cast("array<string>").alias("review_reasons"), F.array(F.concat(F.lit("img_"), (c("p_partkey") % 3).cast("string"))).alias("source_image_ids"), F.lit("ocr").alias("origin"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each menu's part types but LARGE, which so is an unknown category, in alphabetical order."""
    own = table(spark, sf_dir, "part").filter("p_type != 'LARGE'").select(_menu("p_partkey").alias("menu_id"), F.col("p_type").alias("category_id")).distinct()
    order = F.row_number().over(Window.partitionBy("menu_id").orderBy("category_id")) - 1
    return own.select("menu_id", "category_id", F.lower("category_id").alias("name"), order.cast("bigint").alias("order"))


def tip_bp(priority: Column) -> Column:
    tips = {"1": 0, "2": 1000, "3": 1200, "4": 1250}
    out = F.lit(1800)
    for k, v in tips.items():
        out = F.when(F.substring(priority, 1, 1) == k, v).otherwise(out)
    return out


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    diners = 1 + c("o_orderkey") % 8
    total = F.round(c("o_totalprice") * 100).cast("bigint")
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("session_id"), diners.alias("diners"), F.floor(total / diners).cast("bigint").alias("per_person_agorot"), tip_bp(c("o_orderpriority")).alias("tip_bp"))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    id_ = c("l_partkey").cast("string")
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("session_id"), _menu("l_partkey").alias("menu_id"), id_.alias("item_id"), F.concat(id_, F.lit("-0")).alias("variant_id"), c("l_quantity").cast("int").alias("qty"))


def recommending(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each order as a session on the menu of its smallest part, and its selections on that menu. One in fifty customers has a budget for
    many dishes, and a few orders one for whole menus."""
    c = F.col
    first = F.min("menu_id").over(Window.partitionBy("session_id"))
    lines = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("session_id"), "l_partkey", _menu("l_partkey").alias("menu_id"))
    lines = staged(lines.withColumn("first", first).filter("menu_id = first").drop("first"), "session-lines")
    menu = lines.groupBy("session_id").agg(F.min("menu_id").alias("menu_id"))
    money = F.when(c("o_orderkey") % 5000 == 0, 3_000_000).when(c("o_custkey") % 50 == 0, 700_000).otherwise(200_000 + (c("o_custkey") % 50) * 4_000).cast("bigint")
    own = table(spark, sf_dir, "orders").join(menu, c("o_orderkey") == c("session_id")).select("session_id", "menu_id", F.lit(1).alias("diners"), money.alias("per_person_agorot"), tip_bp(c("o_orderpriority")).alias("tip_bp"))
    id_ = c("l_partkey").cast("string")
    return own, lines.select("session_id", "menu_id", id_.alias("item_id"), F.concat(id_, F.lit("-0")).alias("variant_id"), F.lit(1).alias("qty"))


def banquets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a session without selections that has money for the whole menu of its smallest part: all sessions of a menu are alike."""
    money = F.lit(30_000_000).cast("bigint")
    menu = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.min(_menu("l_partkey")).alias("menu_id"))
    return menu.select("session_id", "menu_id", money.alias("remaining_food_budget_agorot"), F.lit(0).cast("bigint").alias("food_subtotal_agorot"), money.alias("total_budget_agorot"), F.lit(0).alias("tip_bp"))


def qty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_qty_events(table(spark, sf_dir, "events"))


def as_qty_events(events: DataFrame) -> DataFrame:
    c = F.col
    item = c("event_id") % 20
    op = F.when(c("event_type") == "click", "add").when(c("event_type") == "error", "remove").when(c("event_type") == "purchase", "set").when(c("event_type") == "signup", "delete")
    return events.filter("event_type != 'view'").select(c("user_id").alias("session_id"), F.floor(item / MENU_ITEMS).cast("bigint").alias("menu_id"), item.cast("string").alias("item_id"), F.concat(item.cast("string"), F.lit("-0")).alias("variant_id"), "ts", "event_id", op.alias("op"), F.when(op == "set", F.floor("value") % 10).cast("int").alias("qty"))


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").filter("event_type != 'view'").select(F.col("user_id").alias("session_id")).distinct()
    return users.select("session_id", (1 + F.col("session_id") % 8).alias("diners"), F.lit(1_500_000).cast("bigint").alias("per_person_agorot"), F.lit(1200).alias("tip_bp"))


def page_texts(spark: SparkSession, sf_dir: str, *, two_pages: bool = False) -> DataFrame:
    """(menu_id, page_id, seq, kind, tokens, p_size): a menu page for each group of parts. A heading (0) where the type changes, a line for
    each part (1), and a line that goes on with it (2). ``two_pages``: odd parts are on a page before that of the even ones, each third
    part with one price has it in a row of its own beside the dish (3), and some of the others begin with "combo"."""
    c = F.col
    part = table(spark, sf_dir, "part").withColumn("menu_id", _menu("p_partkey").cast("string")).withColumn("page_seq", (1 - c("p_partkey") % 2 if two_pages else F.lit(0)).cast("int"))
    before = F.lag("p_type").over(Window.partitionBy("menu_id", "page_seq").orderBy("p_partkey"))
    part = part.withColumn("new", ~before.eqNullSafe(c("p_type"))).withColumn("price", (10 + c("p_size") + c("p_partkey") % 7).cast("string"))
    single = (c("p_size") % 20 > 1) & (c("p_size") % 5 != 0) & (c("p_size") % 4 != 2) if two_pages else F.lit(False)
    apart, promo = single & (c("p_partkey") % 3 == 0), single & (c("p_partkey") % 3 != 0) & (c("p_size") % 9 == 0)
    words = lambda *w: F.array(*[F.lit(x) if isinstance(x, str) else x for x in w])
    name = F.concat(F.when(promo, words("combo")).otherwise(F.array().cast("array<string>")), F.split("p_name", " "))
    second = (20 + c("p_size") + c("p_partkey") % 7).cast("string")
    rest = (
        F.when(apart, F.array().cast("array<string>")).when(c("p_size") % 20 == 0, words("market", "price")).when(c("p_size") % 20 == 1, words("per", "kg"))
        .when(c("p_size") % 5 == 0, words("small", "large", c("price"), second)).when(c("p_size") % 4 == 2, words(c("p_size").cast("string"), "g", c("price"))).otherwise(words(c("price")))
    )
    heading = F.lit(None).cast("string")
    for k, v in HEADINGS.items():
        heading = F.when(c("p_type") == k, v).otherwise(heading)
    row = lambda k, order, there, tokens: F.struct(F.lit(k).alias("k"), F.lit(order).alias("o"), there.alias("there"), tokens.alias("tokens"))
    rows = F.filter(
        F.array(row(0, 0, c("new"), F.array(heading)), row(1, 1, F.lit(True), F.concat(name, rest)), row(3, 2, apart, words(c("price"))), row(2, 3, c("p_size") % 3 == 0, words("with", c("p_brand"), "sauce"))),
        lambda x: x["there"],
    )
    page = F.concat(F.lit("page_"), c("menu_id"), F.when(F.lit(two_pages), F.concat(F.lit("_"), c("page_seq").cast("string"))).otherwise(""))
    return part.select("menu_id", page.alias("page_id"), "page_seq", "p_partkey", "p_size", F.explode(rows).alias("r")).select("menu_id", "page_id", "page_seq", "p_partkey", "p_size", c("r.k").alias("kind"), c("r.o").alias("row_order"), c("r.tokens").alias("tokens"))


def lines(spark: SparkSession, sf_dir: str, *, two_pages: bool = False) -> DataFrame:
    """The page texts as recognised lines: 13 units a character, 10 between words, 50 a line; a price's own row is at its dish's height."""
    c = F.col
    own = page_texts(spark, sf_dir, two_pages=two_pages)
    no = F.row_number().over(Window.partitionBy("menu_id", "page_id").orderBy("p_partkey", "row_order")) - 1
    own = own.withColumn("line_no", no).withColumn("height", F.when(c("kind") == 0, 34.0).otherwise(24.0)).withColumn("y", (c("line_no") - F.when(c("kind") == 3, 1).otherwise(0)) * 50.0)
    width = F.transform("tokens", lambda t: F.greatest(F.lit(18.0), F.length(t) * 13.0))
    own = computed(own, _width=width)
    left = lambda i: F.aggregate(F.slice("_width", F.lit(1), i), i * F.lit(10.0), lambda a, w: a + w)
    box = lambda x0, x1: F.struct(x0.alias("x0"), c("y").alias("y0"), x1.alias("x1"), (c("y") + c("height")).alias("y1"))
    confidence = (40 + c("p_size")).cast("double")
    words = F.transform("tokens", lambda t, i: F.struct(t.alias("text"), confidence.alias("confidence"), bound(left(i), lambda x: box(x, x + F.get("_width", i))).alias("bbox")))
    out = own.select("menu_id", "page_id", "line_no", F.array_join("tokens", " ").alias("text"), confidence.alias("confidence"), words.alias("words"), "y", "height", "p_partkey", "p_size", "kind")
    return out.withColumn("bbox", box(F.lit(0.0), F.element_at("words", -1)["bbox"]["x1"]))


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price hint beside each sixth size's line, one shekel above the printed price."""
    c = F.col
    own = lines(spark, sf_dir).filter("kind = 1 and p_size % 6 = 0")
    value = ((11 + c("p_size") + c("p_partkey") % 7) * 100).cast("bigint")
    return own.select("menu_id", "page_id", c("line_no").alias("hint_no"), F.array(value).alias("values"), "bbox")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    menu = table(spark, sf_dir, "part").select(_menu("p_partkey").cast("string").alias("menu_id")).distinct()
    return menu.select("menu_id", F.concat(F.lit("page_"), F.col("menu_id")).alias("page_id"), F.lit(0).alias("page_seq"), F.lit(1000.0).alias("page_width"))


def two_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of ``page_texts(two_pages=True)``: each part has a line, so they are known without the lines."""
    seq = (1 - F.col("p_partkey") % 2).cast("int")
    out = table(spark, sf_dir, "part").select(_menu("p_partkey").cast("string").alias("menu_id"), seq.alias("page_seq")).distinct()
    return out.select("menu_id", F.concat(F.lit("page_"), "menu_id", F.lit("_"), F.col("page_seq").cast("string")).alias("page_id"), "page_seq", F.lit(1000.0).alias("page_width"))


def right_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each part with two prices, its first word at the right edge: Hebrew for even sizes, Latin for odd ones."""
    c = F.col
    tokens = F.when(c("p_size") % 2 == 0, F.array(F.lit("מנת"), F.lit("הבית"), F.lit("הגדולה"))).otherwise(F.array(F.lit("the"), F.lit("house"), F.lit("special")))
    prices = F.array((10 + c("p_size")).cast("string"), (30 + c("p_size")).cast("string"))
    # A few bytes a line, and much work: without an exchange all lines of a file's row group are one task's.
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = part.select(F.lit("m").alias("menu_id"), F.lit("p").alias("page_id"), c("p_partkey").alias("line_no"), F.concat(tokens, prices).alias("tokens"))
    right = lambda i: 1000.0 - F.aggregate(F.slice("tokens", F.lit(1), i), F.lit(0.0), lambda a, t: a + 10.0 + F.length(t) * 13.0)
    word = lambda t, i: F.struct(t.alias("text"), F.lit(90.0).alias("confidence"), F.struct((right(i) - F.length(t) * 13.0).alias("x0"), F.lit(0.0).alias("y0"), right(i).alias("x1"), F.lit(24.0).alias("y1")).alias("bbox"))
    return own.select("menu_id", "page_id", "line_no", F.array_join("tokens", " ").alias("text"), F.transform("tokens", word).alias("words"))


def raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as JSON, every fiftieth one broken in one of three ways."""
    c = F.col
    own = sessions(spark, sf_dir)
    kind = c("session_id") % 50
    none = F.array()
    body = F.to_json(F.struct(
        F.when(kind == 2, 0).otherwise(1).alias("version"), F.lit("select").alias("step"), F.struct(F.when(kind == 3, -3).otherwise(c("diners")).alias("diners"), c("per_person_agorot").alias("perPersonAgorot"), c("tip_bp").alias("tipBp")).alias("budget"),
        F.struct(none.alias("categories"), none.alias("items"), F.lit(False).alias("confirmed")).alias("menu"), none.alias("selections"), none.alias("images"), F.lit(1_700_000_000_000).alias("updatedAt")))
    return own.select("session_id", F.when(kind == 1, F.substring(body, 1, 20)).otherwise(body).alias("json"))


def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, amount, text): prices printed in six shapes."""
    c = F.col
    price = F.round(c("l_extendedprice") * 100).cast("bigint")
    whole, cents = F.floor(price / 100), F.lpad((price % 100).cast("string"), 2, "0")
    kind = c("l_linenumber") % 6
    thousands = F.concat(F.floor(whole / 1000).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))
    text = (
        F.when(kind == 0, F.concat(F.lit("₪"), whole.cast("string"), F.lit("."), cents)).when(kind == 1, F.concat(whole.cast("string"), F.lit("."), cents, F.lit(" NIS"))).when(kind == 2, F.concat(whole.cast("string"), F.lit(","), cents))
        .when(kind == 3, F.concat(thousands, F.lit("."), cents)).when(kind == 4, F.concat(F.replace(thousands, F.lit(","), F.lit(".")), F.lit(","), cents)).otherwise(F.concat(whole.cast("string"), F.lit("-"), cents))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", price.alias("amount"), text.alias("text"))
