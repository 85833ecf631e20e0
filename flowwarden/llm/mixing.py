"""Mixing sources to target weights by budgets that flow down a tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowwarden.llm.text import checked_broadcast, materialize, text_of, word_count, sealed

NONE = "(none)"
SALTS = 64


def _weight(column: str, weights: Mapping[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(column)), F.lit(1)).cast("long")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]],
            budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (one row per leaf, with ``tokens``) and the ``budget`` of each leaf in tokens.

    At every level a parent's budget is shared by weight; a child that cannot
    use its share (its whole subtree holds too few tokens, ``max_epochs`` times
    over) gets what it can, and the rest goes to its siblings.  A parent never
    gets more than its subtree can use, so a shortage leaves it for its own
    siblings only when the children together are short.
    """
    tree = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    tree = tree.withColumn("given", F.least(budget.cast("long"), tree.agg(F.sum("cap")).scalar()))
    for depth, level in enumerate(levels):
        parent, node = list(levels[:depth]), list(levels[:depth + 1])
        nodes = tree.groupBy(*node).agg(F.sum("cap").alias("c"), F.first("given").alias("b")).withColumn("w", _weight(level, weights.get(level, {})))
        fill = W.partitionBy(*parent).orderBy(F.col("c") / F.col("w"), level).rowsBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy(*parent)
        nodes = (nodes.withColumn("c_before", F.sum("c").over(fill) - F.col("c"))
                 .withColumn("w_left", F.sum("w").over(whole) - F.sum("w").over(fill) + F.col("w"))
                 .withColumn("full", F.col("c") * F.col("w_left") <= F.col("w") * (F.col("b") - F.col("c_before")))
                 .withColumn("b_open", F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(whole), F.lit(0)))
                 .withColumn("w_open", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
                 .withColumn("w_upto", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(fill), F.lit(0))))
        upto = F.expr("(w_upto * b_open) div w_open")
        before = F.expr("((w_upto - w) * b_open) div w_open")
        nodes = nodes.select(*node, F.when(F.col("full"), F.col("c")).otherwise(upto - before).alias("given"))
        tree = tree.drop("given").join(nodes, node)
    return tree.withColumnRenamed("given", "budget").drop("cap")


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], fraction: tuple[int, int] = (8, 10),
        max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The selected rows with ``n_tokens``, ``copies`` and ``tokens_used``, and the levels as ``mix_<name>``.

    ``levels`` names the tree's levels from the top and gives their columns;
    ``weights`` has integer weights by level and name (1 where none is given).
    The budget is ``fraction`` (two integers) of all tokens; tokens are words.
    Each leaf runs through seeded epochs: every epoch orders the leaf's rows by
    a hash of seed, epoch and identifier, and the leaf takes the prefix that
    its budget buys.  The last row may be used in part (``tokens_used``).

    The order is cut at a hash, found by sums over hash ranges first and inside
    one range of a leaf then, so no leaf is ordered in one task.  Rows are then
    chosen by comparing hashes; texts are not sorted.

    A null level is a node of its own, ``(none)``.  Null texts and texts without
    words hold no tokens and are not chosen.  Repeated rows count each, and if
    the cut falls on one, its copies get the same part; rows without identifier
    share one place in the order, told apart by text hash.  An empty table gives
    no rows; other columns pass through.
    """
    names = list(levels)
    path = [f"mix_{n}" for n in names]
    # The levels are columns of the input by its own names, so they are taken before it gets inner ones.
    tree = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(p) for c, p in zip(levels.values(), path)]
    _, inner, keep = sealed(docs, {"n_tokens", "copies", "tokens_used", *path})
    wide = docs.select("*", *tree).toDF(*inner.values(), *path)
    text = text_of(inner[text_col])
    rows = wide.select(*[inner[c] for c in keep], *path, word_count(text).alias("n_tokens"), F.xxhash64(text).alias("__tie"))
    ident = F.coalesce(F.col(inner[id_col]).cast("string"), F.lit(NONE))
    slim = materialize(rows.select(ident.alias("ident"), *path, "n_tokens", "__tie").where("n_tokens > 0"), "mix-rows")
    leaves = slim.groupBy(*path).agg(F.sum("n_tokens").alias("tokens"))
    leaves = materialize(leaves, "mix-leaves")
    tokens = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, path, {f"mix_{k}": v for k, v in weights.items()}, F.lit(tokens * int(fraction[0]) // int(fraction[1])), max_epochs)
    plan = materialize(plan.select(*path, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest")), "mix-plan")
    few = checked_broadcast(plan)

    def with_plan(frame: DataFrame, small: DataFrame, has_few: bool) -> DataFrame:
        if has_few:
            return frame.join(F.broadcast(small), path)
        salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return frame.withColumn("__salt", F.pmod(F.col("__tie"), F.lit(SALTS)).cast("int")).join(salted, [*path, "__salt"]).drop("__salt")

    def order(name: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), name))

    placed = with_plan(slim, plan, few is not None).withColumn("at", order(F.col("ident"))).withColumn("band", F.substring("at", 1, 3))
    bands = placed.groupBy(*path, "band").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    upto = W.partitionBy(*path).orderBy("band").rowsBetween(W.unboundedPreceding, 0)
    cut_band = (bands.withColumn("before", F.sum("t").over(upto) - F.col("t"))
                .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest")))
                .select(*path, "band", "before"))
    inside = W.partitionBy(*path).orderBy("at", "n_tokens", "__tie").rowsBetween(W.unboundedPreceding, 0)
    cut = (placed.join(cut_band, [*path, "band"])
           .withColumn("start", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
           .where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("n_tokens") >= F.col("rest")))
           .select(*path, F.struct("at", "n_tokens", "__tie").alias("cut"), (F.col("rest") - F.col("start")).alias("part")))
    plan = materialize(plan.join(cut, path, "left"), "mix-cuts")
    chosen = with_plan(rows.where("n_tokens > 0"), plan, few is not None)
    here = F.struct(order(ident).alias("at"), F.col("n_tokens"), F.col("__tie"))
    last = F.when(F.col("cut").isNull() | (here > F.col("cut")), F.lit(0).cast("long")).when(here == F.col("cut"), F.col("part")).otherwise(F.col("n_tokens"))
    chosen = chosen.withColumn("__last", last).withColumn("copies", F.col("whole") + (F.col("__last") > 0).cast("long"))
    return chosen.where("copies > 0").select(
        *[F.col(inner[c]).alias(c) for c in keep], *path, "n_tokens", "copies",
        (F.col("whole") * F.col("n_tokens") + F.col("__last")).alias("tokens_used"))
