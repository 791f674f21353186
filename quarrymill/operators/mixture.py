"""Mixtures of sources: offsets, interleaving, sharding, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import numbered


def offsets(sizes: DataFrame, name: str, size: str) -> DataFrame:
    """Where each source begins when all are put one after another; runs over sources, not rows."""
    return sizes.withColumn("offset", F.coalesce(F.sum(size).over(W.orderBy(name).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def ordinals(df: DataFrame, source: str, order: Sequence[str]) -> DataFrame:
    """Each row's place in its source, from 0: ranges are counted first, so no task orders a whole source."""
    return numbered(df, order, [source])


def schedule(sizes: Mapping[str, int], batch: int, weights: Mapping[str, float] | None = None, stop: str = "all_exhausted", seed: int = 0) -> list[tuple[int, str, int, int, int]]:
    """(block, source, round, first, rows) of each block; a driver list as long as there are blocks of one epoch.

    Without weights sources take turns. A source is used up only when a draw goes
    past its end; then it starts a new round.
    """
    import random

    rng, names = random.Random(seed), list(sizes)
    at, rounds, done, out = dict.fromkeys(names, 0), dict.fromkeys(names, 0), set(), []
    turn = 0
    while names:
        name = rng.choices(names, [weights[n] for n in names])[0] if weights else names[turn % len(names)]
        turn += 1
        if at[name] >= sizes[name]:
            done.add(name)
            if stop == "first_exhausted" or len(done) == len(names):
                return out
            at[name], rounds[name] = 0, rounds[name] + 1
        rows = min(batch, sizes[name] - at[name])
        out.append((len(out), name, rounds[name], at[name], rows))
        at[name] += rows
    return out


def take_turns(df: DataFrame, source: str, order: Sequence[str], batch: int) -> DataFrame:
    """source, order, turn, seat, slot: sources give batches of their rows in turn, until each has given all once."""
    seats = df.select(source).distinct().withColumn("seat", (F.row_number().over(W.orderBy(source)) - 1).cast("long"))
    placed = ordinals(df.select(source, *order), source, order).join(F.broadcast(seats), source)
    return placed.select(source, *order, F.expr(f"pos DIV {batch}").alias("turn"), "seat", (F.col("pos") % batch).alias("slot"))


def digest(seed: int | None, *columns: str) -> Column:
    """What a seeded order sorts by."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def draws(spark: SparkSession, sizes: Mapping[str, int], source: str, batch: int, weights: Mapping[str, float], stop: str = "all_exhausted", seed: int = 0) -> DataFrame:
    """block, source, round, part of each block of an epoch, as schedule has them for weights.

    The source of a block hangs on a digest of seed and block, so tasks draw by
    themselves. A source's draws are numbered by range sums: the number says round
    and part, and the first draw past the parts uses the source up.
    """
    if any(weights[k] <= 0 for k in sizes):
        raise ValueError("each source needs a weight above zero")
    names, parts, total = list(sizes), {k: -(-n // batch) for k, n in sizes.items()}, sum(weights[k] for k in sizes)
    draw = F.conv(F.substring(digest(seed, "block"), 1, 13), 16, 10).cast("long") / float(1 << 52) * total
    name, count, upto = F.lit(names[-1]), F.lit(parts[names[-1]]), total
    for k, after in zip(names[-2::-1], names[:0:-1], strict=True):
        upto -= weights[after]
        name = F.when(draw < upto, F.lit(k)).otherwise(name)
        count = F.when(F.col(source) == k, F.lit(parts[k])).otherwise(count)
    n = int(1.1 * max((parts[k] + 1) * total / weights[k] for k in names)) + 64
    while True:
        numbered = ordinals(spark.range(n).select(F.col("id").alias("block")).select("block", name.alias(source)), source, ["block"]).withColumn("parts", count)
        used_up = [r["block"] for r in numbered.where("pos = parts").select("block").collect()]  # one for each source
        if len(used_up) == len(names) or used_up and stop == "first_exhausted":
            break
        n *= 2
    end = min(used_up) if stop == "first_exhausted" else max(used_up)
    return numbered.where(F.col("block") < end).select("block", source, F.expr("pos DIV parts").alias("round"), (F.col("pos") % F.col("parts")).alias("part"))


def interleave(df: DataFrame, source: str, order: Sequence[str], plan: DataFrame, batch: int, seed: int) -> DataFrame:
    """source, round, order, block, slot: rows by the blocks of draws, in an order of its own for each round."""
    last = plan.groupBy(source).agg(F.max("round").alias("__last"))
    rounds = df.select(source, *order).join(F.broadcast(last), source).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), "__last")))
    placed = numbered(rounds.withColumn("__key", digest(seed, "round", *order)), ["__key", *order], [source, "round"]).drop("__key", "__last")
    placed = placed.withColumn("part", F.expr(f"pos DIV {batch}"))
    return placed.join(plan, [source, "round", "part"]).select(source, "round", *order, "block", (F.col("pos") % batch).alias("slot"))


def stride(position: str, processes: int, slots: int, total: int) -> F.Column:
    """Position after (process, slot) of every full step are transposed; the tail stays."""
    p, step = F.col(position), processes * slots
    inner = F.pmod(p, F.lit(step))
    moved = p - inner + F.pmod(inner, F.lit(processes)) * slots + F.floor(inner / processes)
    return F.when(p < total - total % step, moved).otherwise(p).cast("long")


def shard(position: str, block: int, world: int) -> F.Column:
    """The rank of a row when blocks are dealt in turn."""
    return F.pmod(F.floor(F.col(position) / block), F.lit(world)).cast("long")


def chunk_order(df: DataFrame, position: str, chunk: int, seed: int) -> DataFrame:
    """Chunks in seeded order, rows inside as they were: adds chunk and chunk_key to sort by."""
    c = F.floor(F.col(position) / chunk).cast("long")
    return df.withColumn("chunk", c).withColumn("chunk_key", digest(seed, "chunk"))


def sample(df: DataFrame, n: int, order: Sequence[str], seed: int | None = None) -> DataFrame:
    """The first n rows by order, or by a seeded order."""
    if n <= 0:
        raise ValueError("a sample needs at least one row")
    return df.orderBy(*order).limit(n) if seed is None else df.orderBy(F.xxhash64(F.lit(seed), *order), *order).limit(n)


def report(sizes: DataFrame, name: str, size: str, weights: Mapping[str, int]) -> DataFrame:
    """Share of each source by size and weight, and the epoch length its weight implies."""
    w = F.lit(1)
    for k, v in weights.items():
        w = F.when(F.col(name) == k, v).otherwise(w)
    total = F.sum("weight").over(W.partitionBy())
    out = sizes.withColumn("weight", w.cast("long"))
    return out.select(name, size, "weight", F.round(100.0 * F.col("weight") / total, 4).alias("weight_share"), F.round(100.0 * F.col(size) / F.sum(size).over(W.partitionBy()), 4).alias("size_share"), F.floor(F.col(size) * total / F.col("weight")).cast("long").alias("expected_length"))


def optimize_weights(sizes: Mapping[str, int], most: int, total: int = 100) -> dict[str, int]:
    """Whole weights that sum to total and keep the expected length of each source within most, as even as they can be."""
    weights = {k: max(1, -(-n * total // most)) for k, n in sizes.items()}
    while sum(weights.values()) < total:
        k = max(sizes, key=lambda x: (sizes[x] / weights[x], x))
        weights[k] += 1
    while sum(weights.values()) > total and any(w > 1 for w in weights.values()):
        k = min((x for x in sizes if weights[x] > 1), key=lambda x: (sizes[x] / (weights[x] - 1), x))
        weights[k] -= 1
    return weights


def weight_plan(sources: DataFrame, name: str, size: str, weight: str, order: str, most: float = 4_500_000, total: int = 100) -> DataFrame:
    """name, size, weight: whole weights near the given ones that sum to total and keep each source's expected length below most.

    Each source has a floor, the least weight above size * total / most, and begins with its weight scaled to total,
    or its floor if that is more. What then lacks goes to the smallest source (the first by order). What is too much is
    taken, unit by unit, from the source farthest above its floor (the first by order); those units are the
    highest steps above all floors at once, so one window over the steps finds them, as many as the weights' sum.
    If all sources are at their floors the sum stays above total.
    """
    least = F.greatest(F.lit(1), F.floor(F.col(size) * total / most) + 1).cast("long")
    scaled = F.greatest(F.lit(1), F.bround(F.col(weight) * total / F.col("__all"))).cast("long")
    whole = sources.agg(F.sum(weight).alias("__all"), F.min_by(name, F.struct(size, order)).alias("__smallest"))  # one row
    begun = sources.join(F.broadcast(whole)).select(name, size, order, "__smallest", least.alias("__least"), F.greatest(least, scaled).alias("__w"))
    off = begun.agg((F.sum("__w") - total).alias("__over"))  # one row
    begun = begun.join(F.broadcast(off))
    steps = begun.where("__over > 0 AND __w > __least").select(name, order, "__over", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__w") - F.col("__least"))).alias("__step"))
    taken = steps.withColumn("__i", F.row_number().over(W.orderBy(F.desc("__step"), order))).where("__i <= __over").groupBy(name).agg(F.count(F.lit(1)).alias("__taken"))
    given = F.when((F.col("__over") < 0) & (F.col(name) == F.col("__smallest")), -F.col("__over")).otherwise(0)
    return begun.join(taken, name, "left").select(name, size, (F.col("__w") + given - F.coalesce("__taken", F.lit(0))).cast("long").alias("weight"))


def contiguous(position: str, total: int, ranks: int) -> Column:
    """Rank of a position when ranks hold runs of as equal a length as can be, the longer ones first."""
    base, more = divmod(total, ranks)
    pos = F.col(position)
    if base == 0:
        return pos.cast("long")
    return F.when(pos < more * (base + 1), F.floor(pos / (base + 1))).otherwise(more + F.floor((pos - more * (base + 1)) / base)).cast("long")


def restore_order(parts: DataFrame, position: str, total: int) -> DataFrame:
    """Gathered rows in their first order; positions that aren't 0 to total - 1, each once, raise when read."""
    n = F.count(F.lit(1))
    seen = parts.agg(n.alias("n"), F.count_distinct(position).alias("d"), F.min(position).alias("low"), F.max(position).alias("high"))
    right = F.expr(f"n = {total} AND d = {total} AND (n = 0 OR (low = 0 AND high = {total - 1}))")
    check = seen.select(F.when(right, F.lit(True)).otherwise(F.raise_error(F.lit("positions are no permutation")).cast("boolean")).alias("__right"))
    return parts.join(F.broadcast(check)).where("__right").drop("__right").orderBy(position)  # one row


def locate(requests: DataFrame, sizes: DataFrame, name: str, size: str, position: str = "position") -> DataFrame:
    """Source and place in it of global positions. sizes has a row for each source, so it goes to every task."""
    spans = offsets(sizes, name, size).select(name, F.col("offset").alias("__from"), (F.col("offset") + F.col(size)).alias("__to"))
    return requests.join(F.broadcast(spans), (F.col(position) >= F.col("__from")) & (F.col(position) < F.col("__to"))).withColumn("local", (F.col(position) - F.col("__from")).cast("long")).drop("__from", "__to")


def fetch(requests: DataFrame, sources: DataFrame, name: str, local: str, request: str) -> DataFrame:
    """The rows that (source, place) requests name, in the order of the requests."""
    return requests.join(sources, [name, local]).orderBy(request)


def named_union(parts: Mapping[str, DataFrame], column: str = "subset") -> DataFrame:
    """Tables of one schema put together, each with its name."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn(column, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def rank_samples(df: DataFrame, order: Sequence[str], total: int, ranks: int, seed: int | None = None, drop_last: bool = False, consumed: int = 0) -> DataFrame:
    """df dealt to ranks by turns, after a seeded shuffle if there is a seed: columns rank, step.

    So that ranks get as many, the tail is dropped or the first rows are repeated,
    as often as it takes. consumed: rows that all ranks together have read before.
    """
    if ranks < 1:
        raise ValueError("ranks must be 1 or more")
    each = max(0, -(-(total - ranks) // ranks)) if drop_last and total % ranks else -(-total // ranks)
    size = each * ranks
    placed = numbered(df, order) if seed is None else numbered(df.withColumn("__key", digest(seed, *order)), ["__key", *order]).drop("__key")
    if drop_last or total == 0:
        placed = placed.where(F.col("pos") < size)
    else:
        # Row p takes the places p, p + total, ... that lie below the size.
        turns = F.sequence(F.lit(0), F.floor((F.lit(size) - 1 - F.col("pos")) / total).cast("int"))
        placed = placed.withColumn("__turn", F.explode(turns)).withColumn("pos", F.col("pos") + F.col("__turn") * total).drop("__turn")
    out = placed.withColumn("rank", F.pmod("pos", F.lit(ranks)).cast("long")).withColumn("step", F.floor(F.col("pos") / ranks).cast("long"))
    return out.where(F.col("step") >= consumed // ranks).drop("pos")


def shuffled_chunks(df: DataFrame, position: str, chunk: int, total: int, seed: int, drop_last: bool = False) -> DataFrame:
    """df with `place`: whole chunks in seeded order, order kept inside; a short last chunk comes last or is dropped."""
    whole = total // chunk
    numbers = df.sparkSession.range(whole).select(F.col("id").alias("__chunk"), digest(seed, "id").alias("__key"))
    order = numbered(numbers, ["__key", "__chunk"], place="__at").drop("__key")
    marked = df.withColumn("__chunk", F.floor(F.col(position) / chunk).cast("long"))
    out = marked.join(order, "__chunk", "left").withColumn("place", (F.coalesce("__at", F.lit(whole)) * chunk + F.pmod(position, F.lit(chunk))).cast("long"))
    return (out.where(F.col("__at").isNotNull()) if drop_last else out).drop("__chunk", "__at")


def batches(df: DataFrame, position: str, total: int, per_rank: int, ranks: int, steps: int, drop_last: bool = True) -> DataFrame:
    """The rows that a training run of so many steps reads: columns step, rank, slot. Epochs follow each other.

    A global batch is ranks * per_rank rows; a short last one is dropped or read as it is.
    """
    wide = per_rank * ranks
    in_epoch = total // wide if drop_last else -(-total // wide)
    if in_epoch == 0:
        raise ValueError("a batch is larger than the data")
    local = F.floor(F.col(position) / wide)
    epochs = F.sequence(F.lit(0), F.floor((F.lit(steps - 1) - local) / in_epoch).cast("int"))
    rows = df.where((local < in_epoch) & (local < steps)).withColumn("__epoch", F.explode(epochs))
    at = F.pmod(position, F.lit(wide))
    return rows.withColumn("step", (F.col("__epoch") * in_epoch + local).cast("long")).withColumn("rank", F.floor(at / per_rank).cast("long")).withColumn("slot", F.pmod(at, F.lit(per_rank)).cast("long")).drop("__epoch")


def chunks(position: str, size: int) -> Column:
    if size < 1:
        raise ValueError("chunk size must be positive")
    return F.floor(F.col(position) / size).cast("long")


def by_length(df: DataFrame, length: str, order: Sequence[str]) -> DataFrame:
    """Ascending length, ties in the order there was."""
    return df.orderBy(length, *order)
