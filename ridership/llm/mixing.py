"""Mixing sources to target weights (operator 5): hierarchical budgets and seeded token prefixes.

The table's token budget is dealt down a tree, domain, language, source. Among the children of a node the budget goes by
weight, no child above its capacity (its tokens times the allowed epochs); what a child cannot take goes to its siblings
by weight, and only what all of them cannot take has reached the other branches before, as a node's capacity is the sum
of its children's. Each leaf then takes whole epochs of its documents and, of the next one, the shortest prefix in a
seeded order that reaches the rest of its budget.

Only DataFrame functions. A leaf may hold most documents: its prefix is found from token sums in 4,096 buckets of the
order, and only the bucket that holds the cut is sorted. Texts are never shuffled by these steps; the plan has one row
per leaf.

Defined cases: a NULL text has 0 tokens; NULL language, source or domain is a value of its own (''); ties of the order go to the smaller
``doc_id``, NULL first, then the smaller checksum of the text; documents repeated in every column are taken together;
a document without tokens is taken if it stands before the cut; a leaf without tokens or weight takes nothing; an empty
table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridership.session import stage

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _fill(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Deal each parent's ``_given`` to its children by ``weight`` up to ``capacity``: adds ``budget``.

    With children by rising capacity per weight, the share per weight after the first i are full rises while they are
    full and falls after, so the right one is the greatest.
    """
    order = Window.partitionBy(*parent).orderBy(F.asc_nulls_last(F.try_divide("capacity", "weight")), "_node")
    full = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    share = nodes.withColumn("_share", F.try_divide(F.col("_given") - full, rest))
    most = F.max("_share").over(Window.partitionBy(*parent))
    return share.withColumn("budget", F.greatest(F.lit(0.0), F.least(F.col("capacity"), most * F.col("weight")))).drop("_share")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, float]], budget: Column, epochs: int) -> DataFrame:
    """Budget of each leaf (domain, lang, source, tokens); a node without a weight has weight 1.

    ``weights`` maps a level to the weights of its values. ``budget`` is an expression over ``_all``, all tokens.
    """
    given = leaves.select(F.sum("tokens").alias("_all")).select(F.coalesce(budget.cast("double"), F.lit(0.0)).alias("_given")).scalar()
    out = None
    for depth, level in enumerate(LEVELS):
        path, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        weight = F.lit(1.0)
        for value, w in weights.get(level, {}).items():
            weight = F.when(F.col(level) == value, F.lit(float(w))).otherwise(weight)
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).cast("double").alias("capacity")).withColumns({"weight": weight, "_node": F.col(level)})
        nodes = nodes.withColumn("_given", given) if out is None else nodes.join(out.select(*parent, F.col("budget").alias("_given")), parent)
        out = _fill(nodes, parent or [F.lit(0)])
    return out.select(*LEVELS, "budget")


def mix(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, Mapping[str, float]],
    budget: Column,
    epochs: int = 2,
    seed: int = 5,
    digits: int = 3,
) -> DataFrame:
    """The chosen documents: the columns of ``docs``, ``mix_domain``, ``mix_tokens`` and ``mix_epoch`` (from 0)."""
    leaf = ["_domain", "_lang", "_source"]
    keyed = docs.withColumns(
        {
            "_domain": F.coalesce(domain.cast("string"), F.lit("")),
            "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "_tokens": word_count(F.col("text")),
            "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            "_no": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))),
            "_sum": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
        }
    )
    light = stage(keyed.select(*leaf, "_tokens", "_id", "_no", "_sum"), "mix_rows")
    leaves = stage(light.groupBy(*[F.col(f"_{c}").alias(c) for c in LEVELS]).agg(F.sum("_tokens").alias("tokens")), "mix_leaves")
    plan = (
        budgets(leaves, weights, budget, epochs)
        .join(leaves, list(LEVELS))
        .filter("tokens > 0")
        .withColumn("budget", F.round("budget", 3))
        .withColumn("_full", F.least(F.lit(epochs), F.floor(F.col("budget") / F.col("tokens"))))
        .select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "_full", (F.col("budget") - F.col("_full") * F.col("tokens")).alias("_rest"))
    )
    plan = stage(plan, "mix_plan")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"), F.col("_id")).cast("binary"))
    partial = light.join(plan.filter(f"_rest > 0 AND _full < {epochs}"), leaf).withColumn("_order", order)
    partial = partial.withColumn("_bucket", F.substring("_order", 1, digits))
    sums = partial.groupBy(*leaf, "_bucket").agg(F.sum("_tokens").alias("_n"), F.first("_rest").alias("_rest"))
    before = Window.partitionBy(*leaf).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # the last bucket that begins before the budget is reached
    cut = (
        sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter("_before < _rest")
        .groupBy(*leaf)
        .agg(F.max(F.struct("_bucket", "_before")).alias("_cut"))
        .select(*leaf, "_cut._bucket", "_cut._before")
    )
    place = ["_order", "_no", "_sum"]
    within = Window.partitionBy(*leaf).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    last = (
        partial.join(cut, [*leaf, "_bucket"])
        .withColumn("_so_far", F.col("_before") + F.coalesce(F.sum("_tokens").over(within), F.lit(0)))
        .filter("_so_far < _rest")
        .groupBy(*leaf)
        .agg(F.max(F.struct(*place)).alias("_last"))
    )
    whole = stage(plan.join(last, leaf, "left"), "mix_cuts")
    taken = keyed.join(whole, leaf).withColumn("_order", order)
    copies = F.col("_full") + F.when(F.col("_last").isNotNull() & (F.struct(*place) <= F.col("_last")), 1).otherwise(0)
    return (
        taken.withColumn("_copies", copies.cast("int"))
        .filter("_copies > 0")
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .withColumnsRenamed({"_domain": "mix_domain", "_tokens": "mix_tokens"})
        .select(*docs.columns, "mix_domain", "mix_tokens", "mix_epoch")
    )
