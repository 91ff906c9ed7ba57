"""Mixing sources to target weights: hierarchical token budgets, drawn from seeded epochs.

Sources are leaves of a tree (domain, language, source).  A node can give its
tokens ``max_epochs`` times.  From the root down, a node's budget is shared among
its children by weight; a child that cannot take its share gives what is left to
its siblings, and only what a whole family cannot take had already gone to other
families, because a family's share is bounded by what it can give.  A leaf gives whole
epochs, then the prefix of one more, in that epoch's seeded order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.tables import WORD, store, text_key

_HEX, _RANGE = 13, float(1 << 52)
_GROUP = 1_000  # documents of a leaf counted together, about


@dataclass(frozen=True)
class Level:
    """One level of the tree: the column that names a node, and whole weights among siblings."""

    name: str
    weights: dict[str, int] = field(default_factory=dict)
    other: int = 1

    def weight(self) -> Column:
        if not self.weights:
            return F.lit(self.other)
        known = F.create_map(*(F.lit(x) for pair in self.weights.items() for x in pair))
        return F.coalesce(F.try_element_at(known, F.col(self.name)), F.lit(self.other))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_in(epoch: Column, seed: int, doc_id: Column) -> Column:
    """A document's place in an epoch's order, a whole number below 2^52."""
    said = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, _HEX), 16, 10).cast("long")


def mix(
    documents: DataFrame, levels: list[Level], budget: float, max_epochs: int = 1, seed: int = 0, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per drawn copy: doc_id, crc (of the text), the levels' columns, epoch, tokens, taken.

    ``budget`` is the share of all tokens to draw (above 1 with repeats).  A leaf's copies make up
    its budget exactly; the copy at the end of a leaf's prefix has ``taken`` below ``tokens``.  Texts
    without tokens come with an epoch that is drawn whole, or where they stand inside the prefix.
    Null level values are a node of their own, named ''.  Nodes of weight 0 or less give nothing.
    Null text has no tokens.  Rows that share an id are separate and tied by checksum; equal rows are
    interchangeable.  Other columns are not read.  No rows in, no rows out.
    Ids are whole numbers.
    """
    names = [level.name for level in levels]
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_key(F.col(text_col)).alias("crc"),
        *(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names),
        (words_of(F.col(text_col)) if tokens is None else tokens.cast("long")).alias("tokens"),
    )
    rows = store(rows, "mix-documents")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("has"), F.count("*").alias("documents"))
    leaves = store(budgets(leaves, levels, budget, max_epochs), "mix-budgets").where("budget > 0")
    whole = F.floor(F.col("budget") / F.col("has")).cast("long")
    leaves = leaves.select(*names, "documents", whole.alias("whole"), (F.col("budget") - whole * F.col("has")).alias("rest"))
    placed = rows.join(leaves, names).withColumn("place", order_in(F.col("whole"), seed, F.col("doc_id")))
    groups = F.ceil(F.col("documents") / _GROUP)
    placed = placed.withColumn("group", F.floor(F.col("place") / F.lit(_RANGE) * groups).cast("long"))
    out = ["doc_id", "crc", *names, "epoch", "tokens", "taken"]
    full = placed.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    return full.withColumn("taken", F.col("tokens")).select(*out).unionByName(_prefix(placed.where("rest > 0"), names).select(*out))


def _prefix(placed: DataFrame, names: list[str]) -> DataFrame:
    """Copies of the last epoch up to the rest of each leaf's budget: groups of the order are
    summed first, and only the group where the budget ends is looked at document by document."""
    sums = placed.groupBy(*names, "group").agg(F.sum("tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(*names).orderBy("group")) - F.col("sum")
    placed = placed.join(sums.select(*names, "group", before.alias("begins"), "sum"), [*names, "group"]).where("begins < rest")
    ends = F.col("begins") + F.col("sum") > F.col("rest")
    order = Window.partitionBy(*names, "group").orderBy("place", "doc_id", "crc")
    start = F.col("begins") + F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    last = placed.where(ends).withColumn("start", start).where("start < rest")
    last = last.withColumn("taken", F.least("tokens", F.col("rest") - F.col("start"))).drop("start")
    inside = placed.where(~ends).withColumn("taken", F.col("tokens"))
    return inside.unionByName(last).withColumn("epoch", F.col("whole"))


def budgets(leaves: DataFrame, levels: list[Level], budget: float, max_epochs: int) -> DataFrame:
    """Leaves (level columns, has, ...) with their ``budget`` in whole tokens."""
    names = [level.name for level in levels]
    usable = leaves
    for level in levels:
        usable = usable.where(level.weight() > 0)
    able = usable.withColumn("able", F.col("has") * max_epochs)
    wanted = leaves.agg(F.floor(F.sum("has") * F.lit(budget)).cast("long")).first()[0] or 0
    nodes = None
    for depth, level in enumerate(levels):
        parent, path = names[:depth], names[: depth + 1]
        children = able.groupBy(*path).agg(F.sum("able").alias("able")).withColumn("weight", level.weight())
        if parent:
            children = children.join(nodes, parent)
        else:
            family = F.sum("able").over(Window.partitionBy(*parent))
            children = children.withColumn("budget", F.least(F.lit(wanted).cast("long"), family))
        nodes = _share(children, parent, level.name).select(*path, "budget")
    return leaves.join(nodes, names)


def _share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's budget by weight; children that are filled give way to their siblings.

    In order of ability per weight, a child is filled if the level that fills it needs no more than
    the budget.  The others share the rest by weight, whole tokens, remainders by name.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("able") / F.col("weight"), name)
    upto, family = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*parent)
    level = F.col("able") / F.col("weight")
    needs = F.sum("able").over(upto) + level * (F.sum("weight").over(family) - F.sum("weight").over(upto))
    filled = children.withColumn("filled", needs <= F.col("budget"))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("filled"), F.col("able"))).over(family), F.lit(0))
    weights = F.sum(F.when(~F.col("filled"), F.col("weight"))).over(family)
    share = F.floor(rest * F.col("weight") / weights).cast("long")
    shared = filled.withColumn("rest", rest).withColumn("share", F.when(~F.col("filled"), share))
    left = F.col("rest") - F.sum("share").over(family)
    nth = F.row_number().over(Window.partitionBy(*parent, "filled").orderBy(name))
    shared = shared.withColumn("left", left).withColumn("nth", nth)
    got = F.when(F.col("filled"), F.col("able")).otherwise(F.col("share") + F.when(F.col("nth") <= F.col("left"), 1).otherwise(0))
    return shared.withColumn("budget", got)
