"""Saved sessions: JSON texts in and out. A session that breaks any rule is rejected as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import computed
from ..functions.money import is_valid_agorot
from ..operators.menu import PRICE_KINDS

VERSION = 1
STEPS, STATUSES, ORIGINS = ("budget", "upload", "review", "select"), ("pending", "processing", "done", "error"), ("ocr", "manual")
# Numbers are read as doubles first, so that 1.5 diners is a broken rule and not a broken JSON.
_VARIANT = "struct<id:string,label:string,priceAgorot:double,needsReview:boolean>"
_ITEM = f"struct<id:string,name:string,description:string,categoryId:string,variants:array<{_VARIANT}>,priceKind:string,confidence:double,needsReview:boolean,reviewReasons:array<string>,sourceImageIds:array<string>,origin:string>"
_MENU = f"struct<categories:array<struct<id:string,name:string,order:double>>,items:array<{_ITEM}>,confirmed:boolean>"
_IMAGE = "struct<id:string,name:string,rotationDeg:double,status:string,error:string,itemCount:double>"
SESSION = f"version double, step string, budget struct<diners:double,perPersonAgorot:double,tipBp:double>, menu {_MENU}, selections array<struct<itemId:string,variantId:string,qty:double>>, images array<{_IMAGE}>, updatedAt double, _corrupt string"
STORED = "version int, step string, budget struct<diners:int,perPersonAgorot:bigint,tipBp:int>, menu struct<categories:array<struct<id:string,name:string,order:int>>,items:array<struct<id:string,name:string,description:string,categoryId:string,variants:array<struct<id:string,label:string,priceAgorot:bigint,needsReview:boolean>>,priceKind:string,confidence:double,needsReview:boolean,reviewReasons:array<string>,sourceImageIds:array<string>,origin:string>>,confirmed:boolean>, selections array<struct<itemId:string,variantId:string,qty:int>>, images array<struct<id:string,name:string,rotationDeg:int,status:string,error:string,itemCount:int>>, updatedAt bigint"


def _whole(v: Column, low: int | None = None, high: int | None = None) -> Column:
    ok = v.isNotNull() & ~F.isnan(v) & (v == F.floor(v))
    return F.coalesce((ok if low is None else ok & (v >= low)) & (F.lit(True) if high is None else v <= high), F.lit(False))


def _text(v: Column) -> Column:
    return F.coalesce(F.length(v) >= 1, F.lit(False))


def _or(v: Column, ok: Column) -> Column:
    """Holds, or is missing and so gets its default."""
    return v.isNull() | F.coalesce(ok, F.lit(False))


def _variant(v: Column) -> Column:
    return _text(v["id"]) & _or(v["priceAgorot"], is_valid_agorot(v["priceAgorot"]))


def _item(i: Column) -> Column:
    rules = _text(i["id"]) & i["name"].isNotNull() & _text(i["categoryId"]) & F.coalesce(F.size(i["variants"]) >= 1, F.lit(False)) & F.coalesce(F.forall(i["variants"], _variant), F.lit(False))
    return rules & _or(i["priceKind"], i["priceKind"].isin(*PRICE_KINDS)) & _or(i["confidence"], i["confidence"].between(0, 1)) & _or(i["origin"], i["origin"].isin(*ORIGINS))


def _all(array: Column, rule) -> Column:
    return F.coalesce(F.forall(array, rule), F.lit(False))


def rules() -> dict[str, Column]:
    """Every rule of a session, by the reason a breach is listed under."""
    c = F.col
    return {
        "corrupt": c("s").isNotNull() & c("s._corrupt").isNull(),
        "version": F.coalesce(c("s.version") == VERSION, F.lit(False)),
        "step": F.coalesce(c("s.step").isin(*STEPS), F.lit(False)),
        "diners": _whole(c("s.budget.diners"), 1, 100),
        "per_person": is_valid_agorot(c("s.budget.perPersonAgorot")),
        "tip": _whole(c("s.budget.tipBp"), 0, 10_000),
        "categories": _all(c("s.menu.categories"), lambda x: _text(x["id"]) & x["name"].isNotNull() & _whole(x["order"])),
        "items": _all(c("s.menu.items"), _item),
        "selections": _all(c("s.selections"), lambda x: _text(x["itemId"]) & _text(x["variantId"]) & _whole(x["qty"], 1, 99)),
        "images": _all(c("s.images"), lambda x: _text(x["id"]) & x["name"].isNotNull() & _whole(x["rotationDeg"]) & F.coalesce(x["status"].isin(*STATUSES), F.lit(False)) & _or(x["itemCount"], _whole(x["itemCount"], 0))),
        "updated_at": c("s.updatedAt").isNotNull(),
    }


def _defaults(s: Column) -> Column:
    """The session with its defaults filled in and its numbers whole."""
    none = F.array().cast("array<string>")
    variant = lambda v: F.struct(v["id"].alias("id"), v["label"].alias("label"), v["priceAgorot"].cast("bigint").alias("priceAgorot"), F.coalesce(v["needsReview"], F.lit(False)).alias("needsReview"))
    item = lambda i: F.struct(
        i["id"].alias("id"), i["name"].alias("name"), i["description"].alias("description"), i["categoryId"].alias("categoryId"), F.transform(i["variants"], variant).alias("variants"),
        F.coalesce(i["priceKind"], F.lit("fixed")).alias("priceKind"), F.coalesce(i["confidence"], F.lit(1.0)).alias("confidence"), F.coalesce(i["needsReview"], F.lit(False)).alias("needsReview"),
        F.coalesce(i["reviewReasons"], none).alias("reviewReasons"), F.coalesce(i["sourceImageIds"], none).alias("sourceImageIds"), F.coalesce(i["origin"], F.lit("ocr")).alias("origin"))
    image = lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["rotationDeg"].cast("int").alias("rotationDeg"), x["status"].alias("status"), x["error"].alias("error"), F.coalesce(x["itemCount"], F.lit(0.0)).cast("int").alias("itemCount"))
    return F.struct(
        s["version"].cast("int").alias("version"), s["step"].alias("step"),
        F.struct(s["budget"]["diners"].cast("int").alias("diners"), s["budget"]["perPersonAgorot"].cast("bigint").alias("perPersonAgorot"), s["budget"]["tipBp"].cast("int").alias("tipBp")).alias("budget"),
        F.struct(F.transform(s["menu"]["categories"], lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["order"].cast("int").alias("order"))).alias("categories"), F.transform(s["menu"]["items"], item).alias("items"), F.coalesce(s["menu"]["confirmed"], F.lit(False)).alias("confirmed")).alias("menu"),
        F.transform(s["selections"], lambda x: F.struct(x["itemId"].alias("itemId"), x["variantId"].alias("variantId"), x["qty"].cast("int").alias("qty"))).alias("selections"),
        F.transform(s["images"], image).alias("images"), s["updatedAt"].cast("bigint").alias("updatedAt"))


def load_sessions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session_id, json) rows to (session_id, session) of good ones and (session_id, reasons) of rejected ones."""
    read = computed(raw.select("session_id", "json"), s=F.from_json("json", SESSION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})).drop("json")
    broken = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in rules().items()]))
    checked = computed(read, reasons=broken)
    good = checked.filter(F.size("reasons") == 0).select("session_id", _defaults(F.col("s")).alias("session"))
    return good, checked.filter(F.size("reasons") > 0).select("session_id", "reasons")


def session_tables(good: DataFrame) -> dict[str, DataFrame]:
    """Good sessions as flat tables; each session has a menu of its own, with its id."""
    menu = F.col("session_id").alias("menu_id")
    own = good.select("session_id", "session.*")
    items = own.select(menu, F.posexplode("menu.items").alias("item_pos", "i")).select(
        "menu_id", F.col("i.id").alias("item_id"), "item_pos", "i.name", "i.description", F.col("i.categoryId").alias("category_id"),
        F.transform("i.variants", lambda v: F.struct(v["id"].alias("id"), v["label"].alias("label"), v["priceAgorot"].alias("price_agorot"), v["needsReview"].alias("needs_review"))).alias("variants"),
        F.col("i.priceKind").alias("price_kind"), "i.confidence", F.col("i.needsReview").alias("needs_review"), F.col("i.reviewReasons").alias("review_reasons"), F.col("i.sourceImageIds").alias("source_image_ids"), "i.origin")
    return {
        "sessions": own.select("session_id", menu, "budget.diners", F.col("budget.perPersonAgorot").alias("per_person_agorot"), F.col("budget.tipBp").alias("tip_bp"), "step"),
        "menus": own.select(menu, "menu.confirmed"),
        "categories": own.select(menu, F.explode("menu.categories").alias("c")).select("menu_id", F.col("c.id").alias("category_id"), "c.name", "c.order"),
        "items": items,
        "selections": own.select("session_id", menu, F.explode("selections").alias("s")).select("session_id", "menu_id", F.col("s.itemId").alias("item_id"), F.col("s.variantId").alias("variant_id"), "s.qty"),
        "images": own.select(menu, F.explode("images").alias("m")).select("menu_id", F.col("m.id").alias("image_id"), "m.name", F.col("m.rotationDeg").alias("rotation_deg"), "m.status", "m.error", F.col("m.itemCount").alias("item_count")),
    }


def to_payload(sessions: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """(session_id, json): sessions (session_id, session) stamped with the version and the time in milliseconds."""
    now = F.unix_millis(F.current_timestamp()) if updated_at is None else updated_at
    stamped = F.col("session").withField("version", F.lit(VERSION)).withField("updatedAt", now.cast("bigint"))
    return sessions.select("session_id", F.to_json(stamped).alias("json"))


def save_sessions(sessions: DataFrame, path: str, *, buckets: int = 64, mode: str = "append", updated_at: Column | None = None) -> None:
    """Payloads as Parquet, partitioned by a hash of the session. Spark deals rows by bucket and cuts large buckets by its advisory
    partition size, so a task's rows don't grow with the sessions; small buckets are one file each."""
    out = to_payload(sessions, updated_at).withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)))
    out.hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").parquet(path)
