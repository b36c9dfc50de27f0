"""Budgets: packing in order, keeping what fits, the latest within a limit, prefixes and tails.

Packing and skipping are folds: each step depends on the one before. A fold runs over one key's items, which are one
review's, and holds them in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order(*order: Column, **fields: Column) -> Column:
    """One key's items as an array in order."""
    names = [c.alias(f"o{i}") for i, c in enumerate(order)]
    return F.array_sort(F.collect_list(F.struct(*names, *[c.alias(k) for k, c in fields.items()])))


def budget_of(tokens: int, per: int = 4) -> int:
    """The characters of joined text that a budget of estimated tokens holds: a text of n characters counts n // per."""
    return per * tokens + per - 1


def _runs(rows: DataFrame, key: list[str], nth: str, opens_at) -> DataFrame:
    """`rows` with `bin`, from 1: bins open at the places that a fold over one key's rows in order (`opens_at`, an expression of places) gives.

    The fold keeps the places where bins open and nothing of the rest, and a running count deals the rows to them, so a key of many
    rows costs no more than its rows and its bins.
    """
    starts = rows.groupBy(*key).agg(opens_at.alias("starts")).select(*key, F.explode("starts").alias(nth)).withColumn("opens", F.lit(1))
    w = Window.partitionBy(*key).orderBy(nth).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(starts, [*key, nth], "left").withColumn("bin", F.sum(F.coalesce("opens", F.lit(0))).over(w).cast("int")).drop("opens")


def pack(items: DataFrame, key: str, item: str, group: str, cost: str, budget: int, *order: Column, joint: int = 1) -> DataFrame:
    """(key, item, bin): bins filled in order, from 1. A bin closes if a group's items don't all fit, then items go in one by one; `joint` is what joining two costs.

    An item over the budget has a bin of its own. Groups are runs of items in order. For a budget of tokens of the joined text, cost is in characters,
    joint the length of what stands between two, and budget budget_of() the tokens.
    """
    by_group = Window.partitionBy(key, group)
    total = F.sum(cost).over(by_group) + (F.count("*").over(by_group) - 1) * joint
    lead = F.row_number().over(by_group.orderBy(*order)) == 1
    rows = items.select(key, item, F.col(cost).cast("bigint").alias("pack_cost"), total.cast("bigint").alias("pack_total"), lead.alias("pack_lead"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("pack_nth"))
    line = F.array_sort(F.collect_list(F.struct("pack_nth", "pack_cost", "pack_total", "pack_lead")))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        full = lambda more: (F.size(s["starts"]) > 0) & (s["used"] + joint + more > budget)
        opens = (F.size(s["starts"]) == 0) | (x["pack_lead"] & full(x["pack_total"])) | full(x["pack_cost"])
        used = F.when(opens, x["pack_cost"]).otherwise(s["used"] + joint + x["pack_cost"])
        return F.struct(used.cast("bigint").alias("used"), F.when(opens, F.array_append(s["starts"], x["pack_nth"])).otherwise(s["starts"]).alias("starts"))

    return _runs(rows, [key], "pack_nth", F.aggregate(line, start, step, lambda s: s["starts"])).select(key, item, "bin")


def keep_fitting(items: DataFrame, key: str, item: str, cost: str, budget: int, *order: Column, joint: int = 1) -> DataFrame:
    """(key, item, kept): in order, an item that doesn't fit is left out, and smaller ones after it may still enter. If all fit, all stay."""
    line = _in_order(*order, item=F.col(item), cost=F.col(cost))
    start = F.struct(F.lit(-joint).cast("bigint").alias("used"), F.array().cast(f"array<struct<item:{items.schema[item].dataType.simpleString()},kept:boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + joint + x["cost"] <= budget
        return F.struct(F.when(fits, s["used"] + joint + x["cost"]).otherwise(s["used"]).cast("bigint").alias("used"), F.concat(s["out"], F.array(F.struct(x["item"].alias("item"), fits.alias("kept")))).alias("out"))

    return items.groupBy(key).agg(F.aggregate(line, start, step, lambda s: s["out"]).alias("out")).select(key, F.explode("out").alias("x")).select(key, F.col("x.item").alias(item), F.col("x.kept").alias("kept"))


def latest_within(comments: DataFrame, key: str, body: str, newest: int, each: int, total: int, *order: Column, mark: str = " […]") -> DataFrame:
    """The newest comments of a key, from the newest back while characters are left; a body is cut to `each` or what is left. Older first.

    `order` is that of writing; a window finds the newest, so the fold sees `newest` bodies at most.
    """
    back = [c.desc() for c in order]
    recent = comments.withColumn("recent", F.row_number().over(Window.partitionBy(key).orderBy(*back))).where(F.col("recent") <= newest)
    rest = [c for c in comments.columns if c not in (key, body)]
    line = F.array_sort(F.collect_list(F.struct("recent", F.col(body).alias("body"), F.struct(*rest).alias("rest"))))
    kind = f"array<struct<recent:int,body:string,rest:{recent.select(F.struct(*rest).alias('r')).schema['r'].dataType.simpleString()}>>"
    start = F.struct(F.lit(total).alias("left"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        limit = F.least(F.lit(each), s["left"])
        size = F.char_length(x["body"])
        short = F.concat(F.rtrim(F.substring(x["body"], F.lit(1), limit - len(mark))), F.lit(mark))
        cut = F.when(size <= limit, x["body"]).when(limit <= len(mark), F.substring(x["body"], F.lit(1), limit)).otherwise(short)
        take = (s["left"] > 0) & (cut != "")
        return F.struct(F.when(take, s["left"] - F.char_length(cut)).otherwise(s["left"]).alias("left"), F.when(take, F.concat(s["out"], F.array(F.struct(x["recent"].alias("recent"), cut.alias("body"), x["rest"].alias("rest"))))).otherwise(s["out"]).alias("out"))

    kept = recent.groupBy(key).agg(F.aggregate(line, start, step, lambda s: s["out"]).alias("out")).select(key, F.explode("out").alias("x"))
    return kept.select(key, F.col("x.body").alias(body), *[F.col(f"x.rest.{c}").alias(c) for c in rest])


def tail(text: Column, lines: int = 40, chars: int = 8000) -> Column:
    """The last lines of a text, and of these the last characters."""
    parts = F.split(text, "\n")
    few = F.when(F.size(parts) > lines, F.slice(parts, -lines, lines)).otherwise(parts)
    joined = F.array_join(few, "\n")
    return F.when(F.char_length(joined) > chars, F.substring(joined, -chars, chars)).otherwise(joined)


def window_of(lines: DataFrame, key: str, number: str, first: Column, last: Column, context: int, most: int) -> DataFrame:
    """Lines from `context` before the first to `context` after the last, at most `most` of a key."""
    near = lines.where(F.col(number).between(F.greatest(first - context, F.lit(1)), last + context))
    return near.where(F.col(number) < F.greatest(first - context, F.lit(1)) + most)


def largest_prefix(items: DataFrame, key: str, cost: str, budget: int, *order: Column, joint: int = 1) -> DataFrame:
    """(key, items, cost, too_large): how many first items fit, and whether not even one does. Costs only grow along a prefix, so a running sum finds what a search would."""
    total = F.sum(F.col(cost) + joint).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - joint
    fit = items.withColumn("fit_total", total).groupBy(key).agg(F.count_if(F.col("fit_total") <= budget).alias("items"), F.max(F.when(F.col("fit_total") <= budget, F.col("fit_total"))).alias("cost"))
    return fit.select(key, "items", F.coalesce("cost", F.lit(0)).cast("bigint").alias("cost"), (F.col("items") == 0).alias("too_large"))


def shed(nodes: DataFrame, key: str, base: str, extra: str, budget: int, *order: Column) -> DataFrame:
    """`nodes` with state: the last ones lose their extra (`bare`) until all fit; if all bare don't fit, the last go (`gone`)."""
    w = Window.partitionBy(key)
    back = w.orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    all_, bases = F.sum(F.col(base) + F.col(extra)).over(w), F.sum(base).over(w)
    # A node stays whole if what the later ones shed is enough; it stays at all if the bare ones up to it fit.
    whole = all_ - F.coalesce(F.sum(extra).over(back), F.lit(0)) <= budget
    state = F.when(whole, "whole").when((bases <= budget) | (F.sum(base).over(ahead) <= budget), "bare").otherwise("gone")
    return nodes.withColumn("state", state)


def pending(plan: DataFrame, done: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """The first `most` units of the plan that aren't done."""
    return plan.join(done.select(key).distinct(), key, "left_anti").orderBy(*order).limit(most)


def shrink_to_fit(items: DataFrame, budgets: DataFrame, key: str, most: int = 60, least: int = 1000) -> DataFrame:
    """(key, a, b, c, d, cost, fits): how many of each of four lists stay, so that all that stays fits the budget.

    `items` (key, list, pos, cost) are the lists a to d, `budgets` (key, base, budget) what is there anyhow and what there may be. a and b are cut to
    their first `most`. Then, until it fits, the longer of a and b is halved, b where they are as long; when both are empty, c is
    halved; then d, down to one. A budget under `least` cuts nothing more. What fits nowhere ends at the last rung.

    The lengths alone tell every rung, a hundred or so whatever the lengths; each meets the running costs of its four lists by
    equal (key, list, length), and the first that fits is a grouped minimum.
    """
    lists = ("a", "b", "c", "d")
    w = Window.partitionBy(key, "list").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = items.select(key, "list", F.row_number().over(Window.partitionBy(key, "list").orderBy("pos")).alias("n"), F.sum("cost").over(w).alias("total"))
    counts = items.groupBy(key).agg(*[F.count_if(F.col("list") == x).cast("int").alias(x) for x in lists])
    sizes = budgets.join(counts, key, "left").select(key, "base", "budget", *[F.least(F.coalesce(x, F.lit(0)), F.lit(most if x in "ab" else 2**31 - 1)).cast("int").alias(x) for x in lists])

    def below(s: Column) -> Column:
        """The next rung; itself at the last."""
        half = lambda c: F.shiftright(c, 1)
        evidence = (s["a"] > 0) | (s["b"] > 0)
        return F.struct(
            F.when(evidence & (s["b"] < s["a"]), half(s["a"])).otherwise(s["a"]).alias("a"),
            F.when(evidence & (s["b"] >= s["a"]), half(s["b"])).otherwise(s["b"]).alias("b"),
            F.when(~evidence & (s["c"] > 0), half(s["c"])).otherwise(s["c"]).alias("c"),
            F.when(~evidence & (s["c"] <= 0) & (s["d"] > 1), half(s["d"])).otherwise(s["d"]).alias("d"),
        )

    start = F.array(F.struct(*lists))
    # No list halves more often than 31 times.
    ladder = F.aggregate(F.sequence(F.lit(1), F.lit(31 * len(lists))), start, lambda rungs, _: F.when(below(F.element_at(rungs, -1)) == F.element_at(rungs, -1), rungs).otherwise(F.concat(rungs, F.array(below(F.element_at(rungs, -1))))))
    rungs = sizes.select(key, "base", "budget", F.posexplode(ladder).alias("rung", "s"))
    parts = rungs.select(key, "rung", F.explode(F.array(*[F.struct(F.lit(x).alias("list"), F.col(f"s.{x}").alias("n")) for x in lists])).alias("p")).select(key, "rung", "p.list", "p.n").where("n > 0")
    costs = parts.join(running, [key, "list", "n"]).groupBy(key, "rung").agg(F.sum("total").alias("listed"))
    told = rungs.join(costs, [key, "rung"], "left").withColumn("cost", F.col("base") + F.coalesce("listed", F.lit(0)))
    row = F.struct("s", "cost", "budget")
    best = told.groupBy(key).agg(F.min(F.when((F.col("cost") <= F.col("budget")) | (F.col("budget") < least), F.struct("rung", row.alias("at")))).alias("fit"), F.max(F.struct("rung", row.alias("at"))).alias("last"))
    at = F.coalesce("fit.at", "last.at")
    return best.select(key, *[at["s"][x].alias(x) for x in lists], at["cost"].alias("cost"), (at["cost"] <= at["budget"]).alias("fits"))


def fragments(lines: DataFrame, key: list[str], size: str, budget: int, head: int = 0, context: int = 3) -> DataFrame:
    """(key, fragment, first, last, from_, to, cost, too_large): a too large hunk in pieces, from `lines` (key, pos, mark, size) of its body.

    A piece takes changed lines from where the one before ended, with all that stands between them, as long as its `size` and a `head` fit the
    budget; then up to `context` unchanged lines before it, and up to as many after, one at a time, while they fit too. Changed lines stand in
    one piece each; context may stand in two. `from_` to `to` are the changed lines' places, `first` to `last` those of all; a piece of one line
    that doesn't fit is too_large and has no context. A hunk that fits, or without changes, is whole.

    Costs along a hunk are running sums, so a piece is a difference of two; where pieces begin is a fold that keeps nothing but that.
    """
    w = Window.partitionBy(*key).orderBy("pos")
    whole = Window.partitionBy(*key)
    changed = F.col("mark").isin("+", "-")
    rows = lines.where("mark IN ('+', '-', ' ')").select(*key, "pos", "mark", F.col(size).cast("bigint").alias("size"))
    rows = rows.withColumns({"upto": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("size").over(whole), "any": F.max(changed.cast("int")).over(whole)})
    near = {}
    for side, move in (("b", F.lag), ("a", F.lead)):
        for i in range(1, context + 1):
            # What i unchanged lines in a row on this side cost; null where there aren't as many.
            cost = F.when(~move(changed, i).over(w), move("size", i).over(w))
            near[f"{side}{i}"] = cost if i == 1 else F.col(f"{side}{i - 1}") + cost
    for name, column in near.items():
        rows = rows.withColumn(name, column)
    is_whole = (F.col("all") + head <= budget) | (F.col("any") == 0)
    parts = rows.where(~is_whole).where(changed).withColumn("nth", F.row_number().over(w))
    line = F.array_sort(F.collect_list(F.struct("nth", "upto", "size")))
    start = F.struct(F.lit(0).cast("bigint").alias("base"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        opens = (F.size(s["starts"]) == 0) | (x["upto"] - s["base"] + head > budget)
        return F.struct(F.when(opens, x["upto"] - x["size"]).otherwise(s["base"]).alias("base"), F.when(opens, F.array_append(s["starts"], x["nth"])).otherwise(s["starts"]).alias("starts"))

    dealt = _runs(parts, key, "nth", F.aggregate(line, start, step, lambda s: s["starts"]))
    ends = lambda pick, side: F.struct(pick("pos").alias("pos"), *[pick(f"{side}{i}").alias(f"n{i}") for i in range(1, context + 1)])
    piece = dealt.groupBy(*key, "bin").agg(ends(lambda c: F.min_by(c, "nth"), "b").alias("b"), ends(lambda c: F.max_by(c, "nth"), "a").alias("a"), (F.max("upto") - F.min(F.col("upto") - F.col("size")) + head).alias("own"))
    fits = F.col("own") <= budget

    def taken(side: str, used: Column) -> tuple[Column, Column]:
        n, cost = F.lit(0), F.lit(0).cast("bigint")
        for i in range(1, context + 1):
            more = F.col(f"{side}.n{i}")
            ok = fits & more.isNotNull() & (used + more <= budget)
            # One that doesn't fit ends it, whatever follows; costs only grow.
            n, cost = F.when(ok, i).otherwise(n), F.when(ok, more).otherwise(cost)
        return n, cost

    n_b, cost_b = taken("b", F.col("own"))
    piece = piece.withColumns({"n_b": n_b, "cost_b": cost_b})
    n_a, cost_a = taken("a", F.col("own") + F.col("cost_b"))
    piece = piece.withColumns({"n_a": n_a, "cost_a": cost_a})
    cut = piece.select(*key, F.col("bin").alias("fragment"), (F.col("b.pos") - F.col("n_b")).alias("first"), (F.col("a.pos") + F.col("n_a")).alias("last"), F.col("b.pos").alias("from_"), F.col("a.pos").alias("to"), (F.col("own") + F.col("cost_b") + F.col("cost_a")).alias("cost"), (~fits).alias("too_large"))
    full = rows.where(is_whole).groupBy(*key).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min(F.when(changed, F.col("pos"))).alias("from_"), F.max(F.when(changed, F.col("pos"))).alias("to"), (F.max("all") + head).alias("cost"))
    return cut.unionByName(full.select(*key, F.lit(1).alias("fragment"), "first", "last", "from_", "to", "cost", F.lit(False).alias("too_large")))
