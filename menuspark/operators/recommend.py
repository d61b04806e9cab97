"""Recommendations: the best combinations of dishes for the money that is left, never crossing the budget.

The rules describe a depth-first search over a pool sorted by price, cut after ``node_budget`` nodes. A node is a path of
(idx, qty) steps with rising idx, and depth-first order is the lexicographic order of paths. So the search is a set: all paths that
respect budget, copies and category caps, numbered in path order. ``expand_combinations`` makes it by joins, a level at a time.
``recommend`` does the same by joins if asked to, and by default searches the sessions of a partition as numpy levels (``mapInArrow``), many
sessions at once: the same nodes, without shuffling them. Pools in which the node budget may bind are searched one by one.

``recommend_sessions`` and ``count_sessions`` search families. Sessions of a menu with the same ordered units differ in money alone: a poorer
one's nodes are those of a richer one that it can pay for, in the same order. So a family is searched once, with the most money in
it, and each session takes its own from the nodes. Sessions and dishes meet in the task, so no pool is shuffled.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import money
from ..sources.staging import staged
from .skew import join_spread

#: Nodes that the sessions searched together may have, by their pools' sizes alone.
TOGETHER = 1_000_000
#: A menu's sessions are dealt to tasks in pieces of about so many.
PIECE = 50_000
#: Nodes looked at together, in a matrix of sessions and the first nodes of their families.
LOOKED_AT = 2_000_000


@dataclass(frozen=True)
class RuleSet:
    # The defaults decide results.
    max_distinct_items: int = 4
    max_qty_per_item: int = 2
    max_per_category: int = 3
    max_suggestions: int = 5
    node_budget: int = 120_000
    diversity_bonus: float = 0.04
    duplicate_penalty: float = 0.05
    min_price_agorot: int = 100


# The reasons' texts.
LEFT, OF_BUDGET = "נשאר", "מהתקציב הכולל, כולל טיפ"
NEARLY_ALL, COMBINES, CATEGORIES, SIMPLE = "מנצל כמעט את כל התקציב שנותר לאוכל", "משלב", "קטגוריות שונות", "תוספת בודדת ופשוטה להזמנה"
# End of fixed values.

SESSION = ["session_id", "remaining_food_budget_agorot", "food_subtotal_agorot", "total_budget_agorot", "tip_bp"]
CANDIDATE = ["item_id", "variant_id", "name", "variant_label", "category_id", "category_name", "price_agorot"]


def pool(sessions: DataFrame, candidates: DataFrame, per_category: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """The affordable candidates of each session (SESSION columns and menu_id), most expensive first (``idx``), with the units of the
    category that are ordered already. Popular menus' sessions are spread over tasks.

    A session's pool is the end of its menu's candidates in order of price, so ``idx`` is a candidate's place in the menu less the place of
    the first that the session can pay for, and pools are neither sorted nor shuffled."""
    dishes = _usable(candidates, rules)
    order = Window.partitionBy("menu_id").orderBy(F.desc("price_agorot"), "item_pos", "variant_pos")
    dishes = staged(dishes.withColumn("_place", F.row_number().over(order)).withColumn("_dearer", F.lag("price_agorot").over(order)), "candidates")
    units = per_category.filter("category_id is not null").groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("category_id", "units"))).alias("_units"))
    own = staged(sessions.filter("remaining_food_budget_agorot > 0").select("menu_id", *SESSION).join(units, "session_id", "left"), "pool-sessions")
    budget, price = F.col("remaining_food_budget_agorot"), F.col("price_agorot")
    first = dishes.select("menu_id", "price_agorot", "_dearer", F.col("_place").alias("_first"))
    placed = join_spread(own, first, ["menu_id"]).filter((price <= budget) & (F.col("_dearer").isNull() | (F.col("_dearer") > budget)))
    out = join_spread(staged(placed.drop("price_agorot", "_dearer"), "pool-places"), dishes.drop("_dearer"), ["menu_id"]).filter(F.col("_place") >= F.col("_first"))
    out = out.withColumn("units", F.coalesce(F.try_element_at("_units", F.col("category_id")), F.lit(0)).cast("bigint")).withColumn("idx", F.col("_place") - F.col("_first"))
    return out.drop("_units", "_place", "_first")


def _usable(candidates: DataFrame, rules: RuleSet) -> DataFrame:
    return candidates.filter((F.col("price_agorot") > 0) & (F.col("price_agorot") >= rules.min_price_agorot))


def problems(sessions: DataFrame, per_category: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions with the same menu, money and ordered units are one problem: (one session of each, its smallest, with ``problem``;
    (problem, session_id) of all)."""
    own = sessions.filter("remaining_food_budget_agorot > 0").select("menu_id", *SESSION)
    units = per_category.filter("units != 0").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("category_id", "units"))).alias("ordered"))
    rest = [c for c in own.columns if c != "session_id"]
    key = F.sha2(F.to_json(F.struct(*rest, F.coalesce("ordered", F.array().cast(units.schema["ordered"].dataType)).alias("ordered"))), 256)
    keyed = staged(own.join(units, "session_id", "left").select(key.alias("problem"), "session_id", *rest), "problem-sessions")
    first = keyed.groupBy("problem").agg(F.min(F.struct("session_id", *rest)).alias("s")).select("problem", "s.*")
    return staged(first, "problems"), keyed.select("problem", "session_id")


def solve_once(sessions: DataFrame, candidates: DataFrame, per_category: DataFrame, solve: Callable[[DataFrame], DataFrame], rules: RuleSet = RuleSet()) -> DataFrame:
    """What ``solve`` finds in the pools of ``sessions`` (by session_id), searching each distinct problem once and giving its rows to all its
    sessions."""
    first, members = problems(sessions, per_category)
    found = solve(pool(first.drop("problem"), candidates, per_category, rules))
    by_problem = staged(found.join(first.select("session_id", "problem"), "session_id").drop("session_id"), "solutions")
    return join_spread(members, by_problem, ["problem"]).select(*found.columns)


def recommend_sessions(sessions: DataFrame, candidates: DataFrame, per_category: DataFrame, rules: RuleSet = RuleSet(), *, joins: bool = False) -> DataFrame:
    """``recommend`` for sessions (SESSION columns and menu_id): each family searched once, or each distinct problem by joins."""
    if joins:
        return solve_once(sessions, candidates, per_category, lambda pooled: recommend(pooled, rules, joins=True), rules)
    return with_texts(_with_dishes(sessions, candidates, per_category, rules).mapInArrow(_search_families(rules, _suggested), _BEST))


def count_sessions(sessions: DataFrame, candidates: DataFrame, per_category: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """(session_id, nodes, most): how many nodes but the root ``expand_combinations`` gives each session, and the most that one spends."""
    return _with_dishes(sessions, candidates, per_category, rules).mapInArrow(_search_families(rules, _counted), "session_id long, nodes long, most long")


def _with_dishes(sessions: DataFrame, candidates: DataFrame, per_category: DataFrame, rules: RuleSet) -> DataFrame:
    """Rows of sessions and of their menus' dishes in one partition: a menu's dishes by falling price, then its sessions by what they have
    ordered and falling budget. A menu of many sessions is dealt in pieces, each with all dishes."""
    c = F.col
    ordered = F.to_json(F.array_sort(F.collect_list(F.struct(c("category_id").cast("string").alias("category"), c("units").cast("bigint").alias("units")))))
    units = per_category.filter("units != 0 and category_id is not null").groupBy("session_id").agg(ordered.alias("ordered"))
    own = sessions.filter("remaining_food_budget_agorot > 0 and menu_id is not null").select("menu_id", *[c(x).cast("bigint").alias(x) for x in SESSION])
    own = staged(own.join(units, "session_id", "left"), "family-sessions")
    pieces = own.groupBy("menu_id").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")).filter("pieces > 1")
    pieces = F.broadcast(staged(pieces, "menu-pieces"))
    piece = F.pmod(F.xxhash64("session_id"), F.coalesce("pieces", F.lit(1))).cast("int")
    own = own.join(pieces, "menu_id", "left").select(
        "menu_id", piece.alias("piece"), F.lit(1).alias("kind"), F.coalesce("ordered", F.lit("")).alias("ordered"), (-c("remaining_food_budget_agorot")).alias("_a"), c("session_id").alias("_b"), F.lit(0).cast("bigint").alias("_c"), *SESSION)
    dishes = _usable(candidates, rules).select("menu_id", "item_pos", "variant_pos", *[c(x).cast("bigint" if x == "price_agorot" else "string").alias(x) for x in CANDIDATE]).join(pieces, "menu_id", "left")
    dishes = dishes.select(
        "menu_id", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"), F.lit(0).alias("kind"), F.lit("").alias("ordered"),
        (-c("price_agorot")).alias("_a"), c("item_pos").cast("bigint").alias("_b"), c("variant_pos").cast("bigint").alias("_c"), *CANDIDATE)
    both = own.unionByName(dishes, allowMissingColumns=True).withColumn("menu_id", c("menu_id").cast("string"))
    # The search is heavy for its few bytes, so a number of partitions is given, which keeps them from being coalesced by size.
    both = both.repartition(4 * int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "menu_id", "piece")
    return both.sortWithinPartitions("menu_id", "piece", "kind", "ordered", "_a", "_b", "_c").drop("_a", "_b", "_c")


def expand_combinations(pooled: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """(session_id, path, spent, node): all nodes but the root, within the node budget (the root is node 1)."""
    c = F.col
    dishes = pooled.select("session_id", "idx", "category_id", "price_agorot", "units", c("remaining_food_budget_agorot").alias("budget"))
    copies = F.transform(F.sequence(F.lit(1), F.lit(rules.max_qty_per_item)), lambda q: q)

    def grow(base: DataFrame, used: Column, spent: Column, path: Column) -> DataFrame:
        out = base.select("*", F.explode(copies).alias("qty"))
        out = out.filter((used + c("qty") <= rules.max_per_category) & (spent + c("price_agorot") * c("qty") <= c("budget")))
        step = F.struct(c("idx").cast("int").alias("idx"), c("qty").cast("int").alias("qty"), c("category_id").alias("category_id"))
        return out.select("session_id", F.concat(path, F.array(step)).alias("path"), (spent + c("price_agorot") * c("qty")).alias("spent"))

    none = F.array().cast("array<struct<idx:int,qty:int,category_id:string>>")
    level = grow(dishes, c("units"), F.lit(0).cast("bigint"), none)
    nodes = level
    for _ in range(rules.max_distinct_items - 1):
        both = level.join(dishes, "session_id").filter(c("idx") > F.element_at("path", -1)["idx"])
        own = F.aggregate(F.filter("path", lambda p: p["category_id"] == c("category_id")), c("units"), lambda a, p: a + p["qty"])
        level = grow(both, own, c("spent"), c("path"))
        nodes = nodes.unionByName(level)
    key = F.transform("path", lambda p: F.struct(p["idx"].alias("idx"), p["qty"].alias("qty")))
    nodes = nodes.select("session_id", key.alias("path"), "spent")
    nodes = nodes.withColumn("node", F.row_number().over(Window.partitionBy("session_id").orderBy("path")) + 1)
    return nodes.filter(c("node") <= rules.node_budget)


def score(spent: Column, budget: Column, categories: Column, repeats: Column, rules: RuleSet = RuleSet()) -> Column:
    return spent.cast("double") / budget + categories.cast("double") * rules.diversity_bonus - repeats.cast("double") * rules.duplicate_penalty


def by_joins(pooled: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """(session_id, rank, score, spent, lines) by joins alone."""
    c = F.col
    menu = F.map_from_entries(F.collect_list(F.struct(c("idx").cast("int"), F.struct(*CANDIDATE))))
    own = pooled.groupBy(*SESSION).agg(menu.alias("dishes"))
    out = expand_combinations(pooled, rules).join(own, "session_id")
    out = out.filter(money.is_within_budget(c("food_subtotal_agorot") + c("spent"), c("tip_bp"), c("total_budget_agorot")))
    names = F.array_distinct(F.transform("path", lambda p: F.element_at("dishes", p["idx"])["category_name"]))
    repeats = F.aggregate("path", F.lit(0), lambda a, p: a + p["qty"] - 1)
    out = out.withColumn("score", score(c("spent"), c("remaining_food_budget_agorot"), F.size(names), repeats, rules))
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), F.size("path"), "path")
    out = out.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= rules.max_suggestions)
    line = lambda p: F.struct(*[F.element_at("dishes", p["idx"])[f].alias(f) for f in ("item_id", "variant_id", "name", "variant_label", "category_name", "price_agorot")], p["qty"].alias("qty"))
    return out.select(*SESSION, "rank", "score", "spent", F.transform("path", line).alias("lines"))


def search_levels(prices: np.ndarray, category: np.ndarray, names: np.ndarray, units: np.ndarray, budget: int, rules: RuleSet) -> list[tuple[np.ndarray, ...]]:
    """The nodes (codes, spent, seen, again) of one session's pool by levels; prices fall. ``category`` numbers the categories and ``units`` are
    what each has already; ``names`` numbers their names.

    A level holds the paths of one length in order. Where the node budget may bind, each level keeps the first ``node_budget`` paths only: a
    path's prefixes all come before it, so no node within the budget is lost.
    """
    n, q = len(prices), rules.max_qty_per_item
    prices, category, names, units = prices.astype(np.int64), category.astype(np.int32), names.astype(np.int32), units.astype(np.int32)

    def grow(codes: np.ndarray, spent: np.ndarray, seen: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, ...]:
        last = codes[:, -1] // q + 1 if codes.shape[1] else np.zeros(1, np.int32)
        size = (n - last) * q
        row = np.repeat(np.arange(len(codes), dtype=np.int32), size)
        code = np.arange(len(row), dtype=np.int32) - np.repeat(np.cumsum(size) - size - last * q, size).astype(np.int32)
        cost = spent[row] + (prices[:, None] * np.arange(1, q + 1)).ravel()[code]
        ok = cost <= budget
        row, code, cost = row[ok], code[ok], cost[ok]
        idx, qty = code // q, code % q + 1
        used, new = units[category[idx]] + qty, np.ones(len(row), bool)
        for k in range(codes.shape[1]):
            before = codes[:, k][row]
            at = before // q
            used += np.where(category[at] == category[idx], before % q + 1, 0).astype(np.int32)
            new &= names[at] != names[idx]
        ok = used <= rules.max_per_category
        row, code = row[ok], code[ok]
        return np.concatenate([codes[row], code[:, None]], axis=1), cost[ok], seen[row] + new[ok], again[row] + qty[ok] - 1

    none = np.zeros(1, np.int64)
    levels: list[tuple[np.ndarray, ...]] = [(np.zeros((1, 0), np.int32), none, none, none)]
    step = max(1, 500_000 // max(n * q, 1))
    for _ in range(rules.max_distinct_items):
        parts, count = [], 0
        for at in range(0, len(levels[-1][0]), step):
            parts.append(grow(*(x[at : at + step] for x in levels[-1])))
            count += len(parts[-1][0])
            if count >= rules.node_budget:
                break
        if not count:
            break
        levels.append(tuple(np.concatenate([p[i] for p in parts])[: rules.node_budget] for i in range(4)))
    del levels[0]
    if sum(len(level[0]) for level in levels) >= rules.node_budget:
        levels = [_first_nodes(levels, rules.node_budget - 1)]
    return levels


def search(prices: np.ndarray, category: np.ndarray, names: np.ndarray, units: np.ndarray, budget: int, subtotal: int, total: int, tip_bp: int, rules: RuleSet) -> list[tuple[float, int, list[tuple[int, int]]]]:
    """The best (score, spent, path) of one session's pool."""
    q, best = rules.max_qty_per_item, []
    for codes, spent, seen, again in search_levels(prices, category, names, units, budget, rules):
        value = spent / budget + seen * rules.diversity_bonus - again * rules.duplicate_penalty
        value[(subtotal + spent) * (10_000 + tip_bp) > total * 10_000] = -np.inf
        k = min(rules.max_suggestions, len(value))
        least = np.partition(value, len(value) - k)[len(value) - k] if k else np.inf
        for i in np.flatnonzero((value >= least) & (value > -np.inf)):
            path = [int(x) for x in codes[i] if x >= 0]
            best.append((-float(value[i]), len(path), path, int(spent[i])))
    return [(-v, spent, [(x // q, x % q + 1) for x in path]) for v, _, path, spent in sorted(best)[: rules.max_suggestions]]


def _first_nodes(levels: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """The first paths of all levels in depth-first order; shorter ones are filled up with -1, which comes before any step."""
    width = levels[-1][0].shape[1]
    codes = np.concatenate([np.pad(c, ((0, 0), (0, width - c.shape[1])), constant_values=-1) for c, *_ in levels])
    order = np.lexsort(codes.T[::-1])[: max(most, 0)]
    return codes[order], *(np.concatenate([level[i] for level in levels])[order] for i in (1, 2, 3))


def most_nodes(n: np.ndarray, rules: RuleSet, depth: np.ndarray | None = None) -> np.ndarray:
    """The nodes that a pool of n dishes may have, the root included; ``depth``: the most dishes that each has money for."""
    depth = np.full(len(n), rules.max_distinct_items) if depth is None else np.minimum(depth, rules.max_distinct_items)
    sizes = np.array([[math.comb(k, d) * rules.max_qty_per_item**d for d in range(rules.max_distinct_items + 1)] for k in range(int(n.max(initial=0)) + 1)], np.float64)
    return sizes.cumsum(axis=1)[n, depth]


def levels_of_many(start: np.ndarray, n: np.ndarray, prices: np.ndarray, category: np.ndarray, names: np.ndarray, units: np.ndarray, budget: np.ndarray, rules: RuleSet) -> Iterator[tuple[np.ndarray, ...]]:
    """(session, spent, seen, again, codes) of the nodes of many sessions, a level after another. Session i has the dishes start[i] to
    start[i] + n[i]; codes are idx * copies + qty - 1."""
    q = rules.max_qty_per_item
    session = np.arange(len(n))
    codes, spent = np.zeros((len(n), 0), np.int32), np.zeros(len(n), np.int64)
    seen, again = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for depth in range(rules.max_distinct_items):
        last = codes[:, -1] // q + 1 if depth else np.zeros(len(codes), np.int64)
        size = (n[session] - last) * q
        row = np.repeat(np.arange(len(codes)), size)
        code = np.arange(len(row)) - np.repeat(np.cumsum(size) - size - last * q, size)
        dish, qty = start[session[row]] + code // q, code % q + 1
        cost = spent[row] + prices[dish] * qty
        ok = cost <= budget[session[row]]
        row, code, dish, qty, cost = row[ok], code[ok], dish[ok], qty[ok], cost[ok]
        used, new = units[dish] + qty, np.ones(len(row), bool)
        for k in range(depth):
            before = codes[row, k]
            at = start[session[row]] + before // q
            used += np.where(category[at] == category[dish], before % q + 1, 0)
            new &= names[at] != names[dish]
        ok = used <= rules.max_per_category
        row, code = row[ok], code[ok]
        codes = np.concatenate([codes[row], code[:, None].astype(np.int32)], axis=1)
        session, spent, seen, again = session[row], cost[ok], seen[row] + new[ok], again[row] + qty[ok] - 1
        yield session, spent, seen, again, codes
        if not len(codes):
            break


def search_many(start: np.ndarray, n: np.ndarray, prices: np.ndarray, category: np.ndarray, names: np.ndarray, units: np.ndarray, numbers: np.ndarray, rules: RuleSet) -> tuple[np.ndarray, ...]:
    """(session, score, spent, depth, codes) of the best paths of many sessions, best first in each. Session i has the dishes start[i] to
    start[i] + n[i]; ``numbers`` are SESSION's columns. Codes are idx * copies + qty - 1, -1 after a path's end."""
    budget, subtotal, total, tip = (numbers[:, k] for k in range(1, 5))
    levels = []
    for depth, (session, spent, seen, again, codes) in enumerate(levels_of_many(start, n, prices, category, names, units, budget, rules)):
        value = spent / budget[session] + seen * rules.diversity_bonus - again * rules.duplicate_penalty
        fits = (subtotal[session] + spent) * (10_000 + tip[session]) <= total[session] * 10_000
        levels.append((session[fits], value[fits], spent[fits], np.full(int(fits.sum()), depth + 1), np.pad(codes[fits], ((0, 0), (0, rules.max_distinct_items - depth - 1)), constant_values=-1)))
    owner, value, spent, depth, codes = (np.concatenate([x[k] for x in levels]) for k in range(5))
    order = np.lexsort((-value, owner))
    first = np.searchsorted(owner[order], np.arange(len(n)))
    rank = np.arange(len(order)) - first[owner[order]]
    # Whatever ties with a session's last place stays, for the order by length and path.
    place = np.minimum(first + rules.max_suggestions - 1, np.searchsorted(owner[order], np.arange(len(n)), side="right") - 1)
    least = value[order][np.maximum(place, 0)] if len(order) else np.zeros(len(n))
    keep = order[(rank < rules.max_suggestions) | (value[order] == least[owner[order]])]
    keep = keep[np.lexsort((*codes[keep].T[::-1], depth[keep], -value[keep], owner[keep]))]
    rank = np.arange(len(keep)) - np.searchsorted(owner[keep], np.arange(len(n)))[owner[keep]]
    keep = keep[rank < rules.max_suggestions]
    return owner[keep], value[keep], spent[keep], depth[keep], codes[keep]


_SHOWN = ("item_id", "variant_id", "name", "variant_label", "category_name", "price_agorot")
_LINE = "struct<item_id:string,variant_id:string,name:string,variant_label:string,category_name:string,price_agorot:bigint,qty:int>"
_BEST = f"session_id long, remaining_food_budget_agorot long, food_subtotal_agorot long, total_budget_agorot long, tip_bp long, rank int, score double, spent long, lines array<{_LINE}>"


def _best_of(table: pa.Table, rules: RuleSet) -> Iterator[pa.RecordBatch]:
    """The suggestions of the whole sessions in a table that is sorted by session and idx."""
    q = rules.max_qty_per_item
    column = lambda name: table.column(name).to_numpy()
    numbers = np.stack([column(c) for c in SESSION], axis=1)
    start = np.flatnonzero(np.concatenate([[True], numbers[1:, 0] != numbers[:-1, 0]]))
    n = np.diff(np.append(start, len(numbers)))
    code = lambda name: table.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    prices, units, category, names = column("price_agorot"), column("units"), code("category_id"), code("category_name")
    sizes, at = most_nodes(n, rules), 0
    while at < len(n):
        if sizes[at] > rules.node_budget:
            own = slice(start[at], start[at] + n[at])
            _, own_category = np.unique(category[own], return_inverse=True)
            firsts = units[own][np.unique(own_category, return_index=True)[1]]
            found = search(prices[own], own_category, names[own], firsts, *numbers[start[at], 1:].tolist(), rules)
            width = max(rules.max_distinct_items, 1)
            codes = np.array([[i * q + k - 1 for i, k in path] + [-1] * (width - len(path)) for *_, path in found], np.int32).reshape(-1, width)
            owner, value, spent, depth = np.full(len(found), at), np.array([x[0] for x in found]), np.array([x[1] for x in found], np.int64), np.array([len(x[2]) for x in found], np.int64)
            end = at + 1
        else:
            end = at + 1
            held = sizes[at]
            while end < len(n) and sizes[end] <= rules.node_budget and held + sizes[end] <= TOGETHER:
                held += sizes[end]
                end += 1
            owner, value, spent, depth, codes = search_many(start[at:end], n[at:end], prices, category, names, units, numbers[start[at:end]], rules)
            owner = owner + at
        dish = start[owner][:, None] + codes // q
        yield _rows(table, owner, numbers[start[owner]], value, spent, depth, codes, dish, rules)
        at = end


def _rows(dishes: pa.Table, owner: np.ndarray, numbers: np.ndarray, value: np.ndarray, spent: np.ndarray, depth: np.ndarray, codes: np.ndarray, dish: np.ndarray, rules: RuleSet) -> pa.RecordBatch:
    """Suggestions as rows of _BEST: ``owner`` rises and numbers the sessions, ``numbers`` are each row's SESSION columns, ``dish`` the rows of
    ``dishes`` that its codes stand for."""
    used = codes >= 0
    lines = [dishes.column(c).combine_chunks().take(pa.array(dish[used])) for c in _SHOWN]
    struct = pa.StructArray.from_arrays([*lines, pa.array((codes % rules.max_qty_per_item + 1)[used].astype(np.int32))], [*_SHOWN, "qty"])
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(depth)]), pa.int32()), struct)
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner) + 1
    return pa.RecordBatch.from_arrays([*(pa.array(numbers[:, k]) for k in range(5)), pa.array(rank.astype(np.int32)), pa.array(value, pa.float64()), pa.array(spent, pa.int64()), listed], [*SESSION, "rank", "score", "spent", "lines"])


def _search_sorted(rules: RuleSet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            ids = table.column("session_id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))  # the last session may go on in the next batch
            rest = table.slice(cut)
            if cut:
                yield from _best_of(table.slice(0, cut).combine_chunks(), rules)
        if rest is not None:
            yield from _best_of(rest.combine_chunks(), rules)

    return run


# Families.


@dataclass
class Families:
    """Families that are searched together. Family i has the dishes start[i] to start[i] + n[i] and the nodes first[i] to first[i] + count[i], in
    path order. A node's ``key`` is its path with ``bits`` a step, so that keys sort as paths do."""

    start: np.ndarray
    first: np.ndarray
    count: np.ndarray
    owner: np.ndarray
    spent: np.ndarray
    depth: np.ndarray
    seen: np.ndarray
    again: np.ndarray
    key: np.ndarray
    bits: int
    width: int

    def codes(self, nodes: np.ndarray, width: int) -> np.ndarray:
        steps = (self.key[nodes][:, None] >> (self.bits * np.arange(self.width - 1, -1, -1))) & ((1 << self.bits) - 1)
        return np.pad(steps - 1, ((0, 0), (0, width - self.width)), constant_values=-1)


def _searched(start: np.ndarray, n: np.ndarray, prices: np.ndarray, category: np.ndarray, names: np.ndarray, units: np.ndarray, budget: np.ndarray, bits: int, width: int, rules: RuleSet) -> Families:
    found = []
    for depth, (owner, spent, seen, again, codes) in enumerate(levels_of_many(start, n, prices, category, names, units, budget, rules)):
        key = np.zeros(len(codes), np.int64)
        for k in range(depth + 1 if len(codes) else 0):
            key |= (codes[:, k].astype(np.int64) + 1) << (bits * (width - 1 - k))
        found.append((owner, spent, np.full(len(owner), depth + 1), seen, again, key))
    columns = [np.concatenate([x[k] for x in found]) for k in range(6)]
    order = np.lexsort((columns[5], columns[0]))
    columns = [x[order] for x in columns]
    count = np.bincount(columns[0], minlength=len(n))
    return Families(start, np.cumsum(count) - count, count, *columns, bits, width)


def _paid(f: Families, family: np.ndarray, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of its family's nodes each session can pay for, and the most that one of them spends."""
    width = int(max(f.spent.max(initial=0), budget.max(initial=0))) + 1
    rising = np.sort(f.owner * width + f.spent)
    end = np.searchsorted(rising, family * width + budget, side="right")
    n = end - f.first[family]
    return n, np.where(n > 0, rising[np.maximum(end, 1) - 1] % width if len(rising) else 0, 0)


def _first_paid(f: Families, family: np.ndarray, budget: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sessions, nodes, taken): which of the nodes, a row of them for each session, are its first ``most``."""
    todo, length = np.arange(len(family)), 4 * max(most, 1)
    while todo.size:
        length = min(length, int(f.count[family[todo]].max()))
        step, left = max(1, LOOKED_AT // max(length, 1)), []
        for at in range(0, todo.size, step):
            s = todo[at : at + step]
            count = f.count[family[s]][:, None]
            nodes = f.first[family[s]][:, None] + np.minimum(np.arange(length), count - 1)
            taken = (np.arange(length) < count) & (f.spent[nodes] <= budget[s][:, None])
            so_far = taken.cumsum(axis=1)
            done = (so_far[:, -1] >= most) | (count[:, 0] <= length)
            yield s[done], nodes[done], (taken & (so_far <= most))[done]
            left.append(s[~done])
        todo, length = np.concatenate(left), 4 * length


def _value(f: Families, nodes: np.ndarray, budget: np.ndarray, rules: RuleSet) -> np.ndarray:
    return f.spent[nodes] / budget + f.seen[nodes] * rules.diversity_bonus - f.again[nodes] * rules.duplicate_penalty


def _top(f: Families, sessions: np.ndarray, nodes: np.ndarray, value: np.ndarray, rules: RuleSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best of each row of ``nodes`` (value -inf: none), ties by length and path."""
    k = min(rules.max_suggestions, value.shape[1])
    if not k or not len(sessions):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.partition(value, value.shape[1] - k, axis=1)[:, value.shape[1] - k]
    row, at = np.nonzero((value >= least[:, None]) & (value > -np.inf))
    owner, nodes, value = sessions[row], nodes[row, at], value[row, at]
    order = np.lexsort((f.key[nodes], f.depth[nodes], -value, owner))
    owner, nodes, value = owner[order], nodes[order], value[order]
    keep = np.arange(len(owner)) - np.searchsorted(owner, owner) < rules.max_suggestions
    return owner[keep], nodes[keep], value[keep]


def _cap(numbers: np.ndarray) -> np.ndarray:
    """The most that a session may spend: its budget, and no more than leaves its total with the tip within the whole budget."""
    _, budget, subtotal, total, tip = numbers.T
    return np.minimum(budget, total * 10_000 // (10_000 + tip) - subtotal)


def _best_of_families(f: Families, family: np.ndarray, numbers: np.ndarray, rules: RuleSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(session, node, score) of the best nodes of each session.

    Nodes with as many names and repeated copies are ranked by what they spend, so a session's best are among the first of each such
    class that it can pay for. Only where the node budget binds are its nodes looked at one by one."""
    budget, cap = numbers[:, 1], _cap(numbers)
    bound = _paid(f, family, budget)[0] >= rules.node_budget
    parts = []
    free = np.flatnonzero(~bound & (cap > 0))
    if free.size and f.owner.size:
        repeats = int(f.again.max()) + 1
        kinds, kind = np.unique(f.seen * repeats + f.again, return_inverse=True)
        width = int(max(f.spent.max(), cap.max())) + 1
        place = (f.owner * len(kinds) + kind) * width + (width - 1 - f.spent)
        order = np.lexsort((f.key, f.depth, place))
        place = place[order]
        own = family[free][:, None] * len(kinds) + np.arange(len(kinds))
        begin = np.searchsorted(place, own * width + (width - 1 - cap[free])[:, None])
        end = np.searchsorted(place, (own + 1) * width)
        k = min(rules.max_suggestions, int((end - begin).max(initial=0)))
        at = begin[:, :, None] + np.arange(k)
        there = (at < end[:, :, None]).reshape(len(free), -1)
        nodes = order[np.minimum(at, len(order) - 1)].reshape(len(free), -1)
        value = np.where(there, _value(f, nodes, budget[free][:, None], rules), -np.inf)
        parts.append(_top(f, free, nodes, value, rules))
    tied = np.flatnonzero(bound)
    for s, nodes, taken in _first_paid(f, family[tied], budget[tied], rules.node_budget - 1):
        s = tied[s]
        value = np.where(taken & (f.spent[nodes] <= cap[s][:, None]), _value(f, nodes, budget[s][:, None], rules), -np.inf)
        parts.append(_top(f, s, nodes, value, rules))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    owner, nodes, value = (np.concatenate([x[k] for x in parts]) for k in range(3))
    order = np.argsort(owner, kind="stable")
    return owner[order], nodes[order], value[order]


def _suggested(dishes: pa.Table, at: np.ndarray, numbers: np.ndarray, family: np.ndarray, found: Families | tuple, rules: RuleSet) -> pa.RecordBatch:
    """Rows of _BEST for sessions (``numbers`` and ``family`` of each). ``found``: their families' nodes, or the dishes of one family that is too
    large for that. ``at``: the rows of ``dishes`` that the families' dishes are."""
    q, width = rules.max_qty_per_item, max(rules.max_distinct_items, 1)
    if isinstance(found, Families):
        owner, nodes, value = _best_of_families(found, family, numbers, rules)
        spent, depth, codes, start = found.spent[nodes], found.depth[nodes], found.codes(nodes, width), found.start[family[owner]]
    else:
        rows = []
        for i, (number, prices, category, names, firsts, skipped) in enumerate(_one_by_one(numbers, *found)):
            rows += [(i, skipped, v, paid, len(path), [(skipped + x) * q + k - 1 for x, k in path] + [-1] * (width - len(path))) for v, paid, path in search(prices, category, names, firsts, *number[1:], rules)]
        owner, value, spent, depth = (np.array([x[k] for x in rows], np.float64 if k == 2 else np.int64) for k in (0, 2, 3, 4))
        codes, start = np.array([x[5] for x in rows], np.int64).reshape(-1, width), np.zeros(len(rows), np.int64)
    dish = at[np.where(codes >= 0, start[:, None] + codes // q, 0)]
    return _rows(dishes, owner, numbers[owner], value, spent, depth, codes, dish, rules)


def _counted(dishes: pa.Table, at: np.ndarray, numbers: np.ndarray, family: np.ndarray, found: Families | tuple, rules: RuleSet) -> pa.RecordBatch:
    """(session_id, nodes, most) for sessions, as for ``_suggested``."""
    if isinstance(found, Families):
        n, most = _paid(found, family, numbers[:, 1])
        bound = np.flatnonzero(n >= rules.node_budget)
        for s, nodes, taken in _first_paid(found, family[bound], numbers[bound, 1], rules.node_budget - 1):
            most[bound[s]] = np.where(taken, found.spent[nodes], 0).max(axis=1, initial=0)
        n = np.minimum(n, rules.node_budget - 1)
    else:
        levels = [search_levels(prices, category, names, firsts, number[1], rules) for number, prices, category, names, firsts, _ in _one_by_one(numbers, *found)]
        n = np.array([sum(len(x[0]) for x in own) for own in levels], np.int64)
        most = np.array([max((int(x[1].max(initial=0)) for x in own), default=0) for own in levels], np.int64)
    there = n > 0
    return pa.RecordBatch.from_arrays([pa.array(x[there].astype(np.int64)) for x in (numbers[:, 0], n, most)], ["session_id", "nodes", "most"])


def _one_by_one(numbers: np.ndarray, prices: np.ndarray, category: np.ndarray, names: np.ndarray, units: np.ndarray) -> Iterator[tuple]:
    """Each session with its pool: the family's dishes that it can pay for, and how many it can't."""
    for number in numbers.tolist():
        skipped = int(np.searchsorted(-prices, -number[1]))
        _, firsts, own = np.unique(category[skipped:], return_index=True, return_inverse=True)
        yield number, prices[skipped:], own, names[skipped:], units[skipped:][firsts], skipped


def _search_families(rules: RuleSet, answer: Callable[..., pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            table = (own if table is None else pa.concat_tables([table, own])).combine_chunks()
            menu, piece, kind = _codes(table, "menu_id")[0], table.column("piece").to_numpy(), table.column("kind").to_numpy()
            group = np.cumsum(np.concatenate([[False], (menu[1:] != menu[:-1]) | (piece[1:] != piece[:-1])]))
            yield from _answers(table.filter(pa.array(kind == 0)), group[kind == 0], table.filter(pa.array(kind == 1)), group[kind == 1], rules, answer)
            table = table.filter(pa.array((kind == 0) & (group == group[-1])))  # the last menu's sessions may go on in the next batch

    return run


def _codes(table: pa.Table, name: str) -> tuple[np.ndarray, list]:
    found = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def _answers(dishes: pa.Table, menu: np.ndarray, sessions: pa.Table, group: np.ndarray, rules: RuleSet, answer: Callable[..., pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``answer`` for all sessions (each of the menu ``group``), whose menus' dishes are all in ``dishes``."""
    if not dishes.num_rows or not sessions.num_rows:
        return
    numbers = np.stack([sessions.column(x).to_numpy() for x in SESSION], axis=1)
    prices, (category, kinds), (names, _) = dishes.column("price_agorot").to_numpy(), _codes(dishes, "category_id"), _codes(dishes, "category_name")
    kinds = {x: i for i, x in enumerate(kinds)}
    ordered, texts = _codes(sessions, "ordered")
    # Poor sessions don't make do with rich ones' nodes, of which there are many more: a family's budgets are within a power of two.
    band = np.frexp(numbers[:, 1].astype(np.float64))[1]
    begins = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (ordered[1:] != ordered[:-1]) | (band[1:] != band[:-1])]))
    family = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(group))))
    most = numbers[begins, 1]
    low, high = np.searchsorted(menu, group[begins]), np.searchsorted(menu, group[begins], side="right")
    low = np.array([a + int(np.searchsorted(-prices[a:b], -m)) for a, b, m in zip(low, high, most)], np.int64)
    n = high - low
    start = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(start - low, n)
    price, own_category, own_names, units = prices[at], category[at], names[at], np.zeros(len(at), np.int64)
    for i, begin in enumerate(begins):
        for x in json.loads(texts[ordered[begin]] or "[]"):
            own = slice(start[i], start[i] + n[i])
            units[own][own_category[own] == kinds.get(x["category"], -1)] = x["units"]
    depth = np.minimum(np.where(n > 0, most // price[np.maximum(start + n, 1) - 1], 0) if len(price) else 0 * n, rules.max_distinct_items)
    sizes, bits = most_nodes(n, rules, depth), np.array([int(x * rules.max_qty_per_item).bit_length() for x in n])
    i = 0
    while i < len(begins):
        end, held, b, w = i + 1, sizes[i], bits[i], max(int(depth[i]), 1)
        together = held <= TOGETHER and b * w <= 62
        while together and end < len(begins) and held + sizes[end] <= TOGETHER and max(b, bits[end]) * max(w, depth[end]) <= 62:
            held, b, w, end = held + sizes[end], max(b, bits[end]), max(w, int(depth[end])), end + 1
        own = slice(begins[i], begins[end] if end < len(begins) else len(group))
        if together:
            found = _searched(start[i:end], n[i:end], price, own_category, own_names, units, most[i:end], int(b), w, rules)
            yield answer(dishes, at, numbers[own], family[own] - i, found, rules)
        else:
            mine = slice(start[i], start[i] + n[i])
            # Equal money is searched once.
            _, first, back = np.unique(numbers[own, 1:], axis=0, return_index=True, return_inverse=True)
            once = answer(dishes, at[mine], numbers[own][first], family[own][first] - i, (price[mine], own_category[mine], own_names[mine], units[mine]), rules)
            yield _shared(once, numbers[own, 0], numbers[own, 0][first], back.ravel())
        i = end


def _shared(once: pa.RecordBatch, ids: np.ndarray, first: np.ndarray, whose: np.ndarray) -> pa.RecordBatch:
    """The rows of ``once``, in the order of its sessions ``first``, for all sessions ``ids``: each gets those of first[whose]."""
    number = {x: i for i, x in enumerate(first.tolist())}
    count = np.bincount([number[x] for x in once.column(0).to_pylist()], minlength=len(first)).astype(np.int64)
    begin, n = (np.cumsum(count) - count)[whose], count[whose]
    rows = once.take(pa.array(np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begin, n)))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), *rows.columns[1:]], rows.schema.names)


def recommend(pooled: DataFrame, rules: RuleSet = RuleSet(), *, joins: bool = False) -> DataFrame:
    """The best suggestions of each session, one row each: rank, score, subtotals, leftover, lines, reasons and description.
    ``pooled`` is as ``pool`` gives it; its rows are dealt out by session_id."""
    if joins:
        best = by_joins(pooled, rules)
    else:
        own = pooled.select(*[F.col(c).cast("bigint").alias(c) for c in SESSION], "idx", "units", *[F.col(c).cast("bigint" if c == "price_agorot" else "string").alias(c) for c in CANDIDATE])
        own = own.repartition(4 * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "session_id")
        best = own.sortWithinPartitions("session_id", "idx").mapInArrow(_search_sorted(rules), _BEST)
    return with_texts(best)


def with_texts(best: DataFrame) -> DataFrame:
    c = F.col
    out = best.withColumn("added_subtotal_agorot", c("spent")).withColumn("new_subtotal_agorot", c("food_subtotal_agorot") + c("spent"))
    out = out.withColumn("new_total_agorot", c("new_subtotal_agorot") * (F.lit(1.0) + c("tip_bp") / F.lit(10_000.0)))
    out = out.withColumn("leftover_agorot", F.greatest(F.lit(0.0), c("total_budget_agorot") - c("new_total_agorot")))
    names = F.size(F.array_distinct(F.transform("lines", lambda x: x["category_name"])))
    out = out.withColumn("reasons", build_reasons(c("leftover_agorot"), c("remaining_food_budget_agorot") - c("spent"), names, c("lines"))).withColumn("description", describe(c("lines")))
    key = F.array_join(F.array_sort(F.transform("lines", lambda x: F.concat(x["variant_id"], F.lit("x"), x["qty"].cast("string")))), "|")
    return out.withColumn("suggestion_id", key).select("session_id", "rank", "suggestion_id", "score", "added_subtotal_agorot", "new_subtotal_agorot", "new_total_agorot", "leftover_agorot", "lines", "reasons", "description")


def build_reasons(leftover: Column, unused: Column, categories: Column, lines: Column) -> Column:
    return F.array_compact(F.array(
        F.concat(F.lit(f"{LEFT} "), money.format_ils(F.greatest(F.lit(0.0), leftover)), F.lit(f" {OF_BUDGET}")),
        F.when(unused <= 500, NEARLY_ALL), F.when(categories > 1, F.concat(F.lit(f"{COMBINES} "), categories.cast("string"), F.lit(f" {CATEGORIES}"))),
        F.when((F.size(lines) == 1) & (F.try_element_at(lines, F.lit(1))["qty"] == 1), SIMPLE)))


def describe(lines: Column) -> Column:
    """``name (label) ×2 + other``."""
    def line(x: Column) -> Column:
        label = F.when(F.coalesce(x["variant_label"], F.lit("")) != "", F.concat(x["name"], F.lit(" ("), x["variant_label"], F.lit(")"))).otherwise(x["name"])
        return F.when(x["qty"] > 1, F.concat(label, F.lit(" ×"), x["qty"].cast("string"))).otherwise(label)

    return F.array_join(F.transform(lines, line), " + ")


