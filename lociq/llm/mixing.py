"""Mixing sources to target weights: budgets down a tree of domains, languages and sources.

A node's budget is dealt to its children by weight. A child never gets more than what lies below it
times the allowed epochs; what it can't take goes to its siblings by weight, and only what all of
them together can't take is missing at the node, whose own siblings were dealt it before. Each leaf
then takes a prefix of its tokens in the seeded order of its epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.common import stash, unused

#: Rows of one leaf that one task orders at most, on average.
BUCKET_ROWS = 1_000_000
#: Copies of one row that are written out from one array.
COPIES = 4096


def word_count(text: Column) -> Column:
    """Words between ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _deal(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Add ``budget`` to rows (parent keys, key, weight, cap, above): the parent's budget ``above`` by weight.

    In the order of cap to weight, a child is full if its share of what is left is its cap or more; the
    others share the rest by weight, rounded so that nothing is lost. All in whole tokens.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("weight"), key)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    ranked = children.withColumn("_left", F.col("above") - F.coalesce(F.sum("cap").over(before), zero)).withColumn("_weights", F.sum("weight").over(after))
    ranked = ranked.withColumn("_full", F.col("cap") * F.col("_weights") <= F.col("_left") * F.col("weight"))
    taken = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(zero)).over(by)
    open_weight = F.when(F.col("_full"), zero).otherwise(F.col("weight"))
    ranked = ranked.withColumn("_rest", F.col("above") - taken).withColumn("_open", F.sum(open_weight).over(by)).withColumn("_upto", F.sum(open_weight).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.expr("(_rest * _upto) div _open - (_rest * (_upto - weight)) div _open")
    return ranked.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(share)).drop("_left", "_weights", "_full", "_rest", "_open", "_upto")


def budgets(leaves: DataFrame, levels: list[str], weight: dict[str, Column], total: int, max_epochs: int) -> DataFrame:
    """Rows (levels, tokens, n_docs, budget) for leaves (levels, tokens, n_docs) with tokens.

    ``weight`` gives each level's weight, a whole number of 1 or more, from the level's columns so far.
    """
    caps = leaves.where("tokens > 0").withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    above = None
    for k, level in enumerate(levels):
        nodes = caps.groupBy(*levels[: k + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", weight[level].cast("long"))
        if above is None:
            everything = F.sum("cap").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("above", F.least(F.lit(total).cast("long"), everything))
        else:
            nodes = nodes.join(above, levels[:k])
        dealt = _deal(nodes, levels[:k], level)
        above = dealt.select(*levels[: k + 1], F.col("budget").alias("above"))
    return caps.drop("cap").join(above.withColumnRenamed("above", "budget"), levels)


def _each(count: Column) -> tuple[Column, Column]:
    """Two generators, one after the other, of 0 to ``count`` - 1: the blocks, then the numbers of ``_block``."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / COPIES)))
    start = F.col("_block") * COPIES
    return blocks, F.explode(F.sequence(start, F.least(start + COPIES, count) - 1))


def mix(rows: DataFrame, id_col: str, levels: list[str], weight: dict[str, Column], share: tuple[int, int] = (1, 1), total: int | None = None, max_epochs: int = 4, seed: int = 7) -> DataFrame:
    """Rows (id, levels, epoch, take_tokens): what each row of (id, levels, tokens) gives to each epoch.

    ``total`` tokens are dealt, or ``share`` (a numerator and denominator) of all there are. Epochs count
    from 0; whole ones take all of a row, the last one takes rows in the order of
    md5("seed:epoch:id") until the leaf's budget is used up, and the row that crosses it with what is
    left. Equal ids of a leaf are ordered by their tokens. Rows without tokens give nothing; a null level is a
    node of its own named ''; a null id is ordered as ''. An empty table gives no rows. Other columns are not
    read; texts of any length come as their token counts.

    Rows alike in id, leaf and tokens are one row with a count until the end, so an id, or the missing one, that
    holds a third of all rows is as many rows as it has token counts. A
    leaf's order is found from the sums of its buckets, hex prefixes of the order's hash of which
    there are enough for BUCKET_ROWS rows each, and from running sums within buckets: no task sees a
    whole leaf. Budgets are a row a leaf.
    """
    levels_ = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in levels]
    rows = rows.select(id_col, *levels_, F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).where("tokens > 0")
    rows = stash(rows.groupBy(id_col, *levels, "tokens").agg(F.count("*").alias("_n")), "tokens")
    leaves = stash(rows.groupBy(*levels).agg(F.sum(F.col("tokens") * F.col("_n")).alias("tokens"), F.count("*").alias("n_docs")), "leaves")
    have, largest = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    total = have * share[0] // share[1] if total is None else total
    dealt = stash(budgets(leaves, levels, weight, total, max_epochs), "budgets").select(*levels, F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("rest"))
    digits = 2
    while largest > BUCKET_ROWS * 16**digits:
        digits += 1

    in_leaf = rows.join(dealt, levels)
    blocks, copies = _each(F.col("_n"))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("epoch")
    whole = in_leaf.where("full > 0").withColumn("_block", blocks).withColumn("_copy", copies).select(id_col, *levels, epochs, F.col("tokens").alias("take_tokens"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    last = in_leaf.where("rest > 0").withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, digits)).withColumn("_all", F.col("tokens") * F.col("_n"))
    sums = last.groupBy(*levels, "_bucket").agg(F.sum("_all").alias("_sum"))
    ahead = Window.partitionBy(*levels).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*levels, "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*levels, "_bucket").orderBy("_order", id_col, "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = last.withColumn("_start", F.coalesce(F.sum("_all").over(within), F.lit(0))).join(sums, [*levels, "_bucket"])
    placed = placed.withColumn("_left", F.col("rest") - F.col("_before") - F.col("_start")).where("_left > 0")
    taken = placed.withColumn("_take", F.least(F.col("_n"), F.expr("(_left + tokens - 1) div tokens")))
    blocks, copies = _each(F.col("_take"))
    left = F.col("_left") - F.col("_copy") * F.col("tokens")
    part = taken.withColumn("_block", blocks).withColumn("_copy", copies).select(id_col, *levels, F.col("full").alias("epoch"), F.least(F.col("tokens"), left).alias("take_tokens"))
    return whole.unionByName(part)


def take(df: DataFrame, chosen: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` once for each epoch in which ``chosen``, rows of mix(), takes of their id.

    Documents stay whole, also the one that crosses a leaf's budget. Rows of equal id go together, and so do all rows
    without an id, in each epoch that takes of one of them; these are not joined, as their epochs are few.
    """
    key, epoch = unused(df, "_id"), unused(df, "_epoch")
    wanted = chosen.select(F.col(id_col).alias(key), F.col("epoch").alias(epoch)).distinct()
    by_id = df.join(wanted.where(F.col(key).isNotNull()), F.col(id_col) == F.col(key)).select(*df.columns)
    missing = wanted.where(F.col(key).isNull()).agg(F.collect_list(epoch).alias(epoch))
    without = df.where(F.col(id_col).isNull()).crossJoin(F.broadcast(missing)).select(*df.columns, F.explode(epoch).alias(epoch))
    return by_id.unionByName(without.select(*df.columns))
