"""Mixing sources to target weights: hierarchical budgeting, native functions only.

The corpus is a tree of domain, language and source. The token budget flows from
the root by target weights. A child that can't use its share, even when every
epoch that is allowed is spent, takes what it can; the rest goes to its siblings
by weight, and leaves the subtree only when the whole subtree is used up. A
subtree's capacity is the sum of its leaves', so filling siblings level by level
("water filling") does just that. All amounts are whole tokens.

A leaf with budget b and t tokens reads b DIV t whole epochs, and from one more
epoch the prefix, in seeded order, that reaches the rest of b. The end of a prefix
is found by sums over 256 ranges of the order, then over 256 ranges of the one in
which it ends, and so on until that has few rows: only those are ordered row by
row, and no task orders a leaf.

Defined results: a weight of 0 gives nothing, weights below it, fewer epochs than
one and a negative budget raise; null language or source form leaves of their own,
null ids count as the empty id, null texts have no tokens; rows that repeat an id
share a place and follow by tokens, the fewest first, those with as many tokens in
any order; texts of any length are counted whole; an empty table gives an empty
result; further columns are not read by mix_plan and kept by mix_documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, drop_table, write_table

LEAF = ["domain", "lang", "source"]
RANGE_DIGITS = 2  # hexadecimal digits by which ranges of the order are narrowed
LAST_ROWS = 4096  # rows of a leaf that are ordered one by one, if ids differ


@dataclass(frozen=True)
class Mix:
    """Target weights (whole numbers, default 1), budget as thousandths of the corpus, epochs at most, seed."""

    domains: Mapping[str, int] = field(default_factory=lambda: {"web": 4, "reference": 3, "forum": 3})
    langs: Mapping[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 1})
    sources: Mapping[str, int] = field(default_factory=dict)
    budget_permille: int = 1000
    max_epochs: int = 2
    seed: int = 17

    def __post_init__(self):
        for weights in (self.domains, self.langs, self.sources):
            bad = {k: w for k, w in weights.items() if not isinstance(w, int) or w < 0}
            if bad:
                raise ValueError(f"weights must be whole numbers from 0: {bad}")
        if self.max_epochs < 1 or self.budget_permille < 0:
            raise ValueError("max_epochs must be 1 or more and budget_permille 0 or more")


def domain_of(source: Column) -> Column:
    """The domain of a source: src0 is web, src1 to src9 are reference, all others forum."""
    return F.when(source == "src0", "web").when(source.rlike("^src[1-9]$"), "reference").otherwise("forum")


def _weight(key: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(key == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Share `budget` of each parent among its children by weight, none above its capacity: adds `share`.

    Children in the order of capacity by weight are full as long as their part
    of what is left, for the weight that is left, covers them. Those of weight 0
    come last and get nothing.
    """
    order = W.partitionBy(*parents).orderBy(F.expr("CASE WHEN weight > 0 THEN capacity / weight END").asc_nulls_last(), child)
    group = W.partitionBy(*parents)
    nodes = nodes.withColumn("before", F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    wide = lambda c: F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")
    nodes = nodes.withColumn("full", (F.col("weight") > 0) & (wide("capacity") * F.col("open").cast("decimal(12,0)") <= wide(F.col("budget") - F.col("before")) * F.col("weight").cast("decimal(12,0)")))
    nodes = nodes.withColumn("taken", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(group))
    nodes = nodes.withColumn("thirsty", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(group))
    part = F.expr("CAST(CAST(budget - taken AS decimal(20,0)) * CAST(weight AS decimal(12,0)) DIV CAST(greatest(thirsty, 1) AS decimal(12,0)) AS bigint)")
    return nodes.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop("before", "open", "full", "taken", "thirsty", "budget")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, tokens) with the column budget.

    Windows run over the tree's nodes, never over documents.
    """
    capacity = F.sum(F.col("tokens") * mix.max_epochs).alias("capacity")
    total = leaves.agg((F.sum("tokens") * mix.budget_permille).alias("t")).selectExpr("least(t DIV 1000, 9000000000000000000) AS budget")
    top = leaves.groupBy("domain").agg(capacity).join(F.broadcast(total)).withColumn("weight", _weight(F.col("domain"), mix.domains))
    top = _fill(top, [], "domain").select("domain", F.col("share").alias("budget"))

    mid = leaves.groupBy("domain", "lang").agg(capacity).join(top, "domain").withColumn("weight", _weight(F.col("lang"), mix.langs))
    mid = _fill(mid, ["domain"], "lang").select(F.col("domain").alias("d"), F.col("lang").alias("l"), F.col("share").alias("budget"))

    low = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    low = low.join(mid, (F.col("domain") == F.col("d")) & F.col("lang").eqNullSafe(F.col("l"))).drop("d", "l")
    low = low.withColumn("weight", _weight(F.col("source"), mix.sources))
    return _fill(low, ["domain", "lang"], "source").select(*LEAF, "tokens", F.col("share").alias("budget"))


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows (doc_id, domain, lang, source, n_tokens, ...) with the column times: in how many epochs each is read.

    rows is read several times; hand over a written table.
    """
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, mix)
    goals = budgets.selectExpr(
        "domain AS d", "lang AS l", "source AS s",
        "CASE WHEN tokens > 0 THEN budget DIV tokens ELSE 1 END AS epochs",
        "CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest",
    )
    goals = write_table(goals, "mix-goals")
    same = (F.col("domain") == F.col("d")) & F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    seeded = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = rows.join(goals, same).withColumn("place", seeded)

    # The range in which the prefix ends is the first whose sum reaches the rest; then the same inside it.
    at = (F.col("d") == F.col("d2")) & F.col("l").eqNullSafe(F.col("l2")) & F.col("s").eqNullSafe(F.col("s2"))
    inside, depth, ends = placed.withColumn("before", F.lit(0).cast("long")), 0, None
    while True:
        depth += RANGE_DIGITS
        sums = inside.withColumn("range", F.substring("place", 1, depth)).groupBy("d", "l", "s", "rest", "before", "range").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        upto = sums.withColumn("upto", F.col("before") + F.sum("t").over(W.partitionBy("d", "l", "s").orderBy("range")))
        found = upto.where("upto >= rest").groupBy("d", "l", "s").agg(F.min(F.struct("range", (F.col("upto") - F.col("t")).alias("before"), "n")).alias("end"))
        last = ends
        ends = write_table(found.selectExpr("d AS d2", "l AS l2", "s AS s2", "end.range AS end", "end.before AS before", "end.n AS n"), "mix-ends")
        if last is not None:
            drop_table(last)
        if depth >= 32 or (ends.agg(F.max("n")).first()[0] or 0) <= LAST_ROWS:
            break
        inside = placed.join(ends.drop("n"), at).where(F.substring("place", 1, depth) == F.col("end")).drop("d2", "l2", "s2", "end")
    placed = placed.join(ends.drop("n"), at).withColumn("range", F.substring("place", 1, depth))
    clear = placed.where("range <> end").withColumn("more", F.expr("CAST(range < end AS int)"))
    order = W.partitionBy(*LEAF).orderBy("place", "n_tokens")
    last = placed.where("range = end").withColumn("sum", F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = last.withColumn("more", F.expr("CAST(before + sum - n_tokens < rest AS int)"))
    out = clear.unionByName(last.select(*clear.columns))
    return out.withColumn("times", (F.col("epochs") + F.col("more")).cast("long")).select(*rows.columns, "times")


def measure(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens (words) of docs, and all of a document as struct `row` if that is named."""
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("held"))
    source = F.col("held.source")
    tokens = F.regexp_count(F.coalesce(F.col("held.text"), F.lit("")), F.lit(WORD)).cast("long")
    columns = [F.col("held.doc_id"), F.coalesce(domain_of(source), F.lit("forum")).alias("domain"), F.col("held.lang"), source, tokens.alias("n_tokens")]
    return held.select(*columns, *([F.col("held").alias(row)] if row else []))


def mix_plan(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """One row per document: doc_id, domain, lang, source, n_tokens, times."""
    return plan(write_table(measure(docs), "mix-rows"), mix or Mix())


def mix_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """docs as the plan reads them: a row for each epoch a document is read in, all columns as they were."""
    planned = plan(measure(docs, "row"), mix or Mix()).where("times > 0")
    return planned.select("row", F.explode(F.expr("sequence(1L, times)"))).select("row.*")
