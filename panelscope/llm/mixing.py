"""Mixing sources to target weights by temperature (DataFrame functions; each step of the search for the exponent is one aggregation over the sources)."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace, unused

BLOCK_DOCS = 1024
TARGET_ENTROPY = 0.95
MAX_REPEATS = 2.0
#: Up to this number of sources their plan is broadcast; the plan of more is joined.
BROADCAST_SOURCES = 100_000
#: Exponents that one aggregation tries; digits to which the exponent is found.
TRIES, DIGITS = 32, 9


@dataclass(frozen=True)
class Mixture:
    """Weight of a source with t of all tokens: (t / tokens) ** exponent / norm; its budget is total times that."""

    exponent: float
    tokens: int
    norm: float
    total: float
    entropy: float

    def budget(self, t: Column) -> Column:
        """Token budget of a source with t tokens; 0 for a source without any."""
        return F.when(t > 0, F.pow(t / F.lit(float(self.tokens)), F.lit(self.exponent)) * F.lit(self.total / self.norm)).otherwise(F.lit(0.0))


def solve(sums: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS, budget: float | None = None) -> Mixture | None:
    """The largest exponent in 0..1 at which the relative entropy reaches its target, raised as far as the repetition limit asks.

    sums has the tokens of each source.  Entropy is relative to its largest value,
    1 for a single source.  Without a budget, the total is the least at which
    every source is used once in full, so mixing loses no document.  Sources
    without tokens get weight 0; without any tokens there is no mixture.
    """
    sums = sums.where("tokens > 0").select("tokens")
    n, whole, low, high = sums.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return None

    def measured(exponents: list[float]) -> list[tuple[float, float, float, float]]:
        """(norm, total, relative entropy, most repeats) at each exponent."""
        share = F.col("tokens") / F.lit(float(whole))
        tried = sums.select(share.alias("share"), F.posexplode(F.array(*map(F.lit, exponents))).alias("k", "e"))
        raw = F.pow("share", "e")
        rows = tried.groupBy("k").agg(F.sum(raw).alias("norm"), F.sum(raw * F.ln("share")).alias("logs")).collect()  # TRIES rows
        out = []
        for r in sorted(rows):
            e = exponents[r.k]
            total = whole * r.norm * (high / whole) ** (1 - e) if budget is None else budget
            out.append((r.norm, total, (log(r.norm) - e * r.logs / r.norm) / log(n) if n > 1 else 1.0, total * (low / whole) ** e / r.norm / low))
        return out

    def bisect(left: float, holds) -> float:
        """Where in left..1 holds() turns from false (low) to true, to DIGITS digits; each round tries TRIES exponents at once."""
        right = 1.0
        while right - left > 10.0**-DIGITS / 4:
            tries = [left + (right - left) * (k + 1) / (TRIES + 1) for k in range(TRIES)]
            turned = next((k for k, m in enumerate(measured(tries)) if holds(m)), TRIES)
            left, right = (tries[turned - 1] if turned else left), (tries[turned] if turned < TRIES else right)
        return round(right, DIGITS)

    exponent = 1.0
    if target_entropy is not None and measured([1.0])[0][2] < target_entropy:
        exponent = round(max(0.0, bisect(0.0, lambda m: m[2] < target_entropy) - 10.0**-DIGITS), DIGITS)
    if max_repeats is not None and measured([exponent])[0][3] > max_repeats:
        exponent = bisect(exponent, lambda m: m[3] <= max_repeats)
    norm, total, entropy, _ = measured([exponent])[0]
    return Mixture(exponent, int(whole), norm, total, entropy)


def n_tokens(text: str | Column = "text") -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _order(seed: int, *parts) -> Column:
    """A pseudo-random place in 0 .. 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 2)


#: What mix() adds.
ADDED = ["mix_source", "mix_tokens", "epoch", "block", "block_place", "doc_place"]


def added(docs: DataFrame) -> dict[str, str]:
    """The names of the columns that mix() adds to docs: ADDED, with underscores in front where docs has such a column."""
    return {name: unused(docs, name) for name in ADDED}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, block_docs: int = BLOCK_DOCS, **target) -> DataFrame:
    """docs repeated by the epochs of their sources, with mix_source, mix_tokens, epoch, block, block_place and doc_place.

    Each source's rows are dealt to blocks of about block_docs.  Every epoch
    permutes the blocks and, inside a block, the rows; whole epochs take every
    row, the last one takes blocks in their order, then rows of one block, while
    tokens are left in the budget.  Order by epoch, block_place and doc_place for
    a training order.  Null sources count as one source of their own; rows
    without words are taken once in the first epoch.  Rows of one id in one block
    and epoch share a place; which of them a budget cuts off first is then left
    open, as is the order of rows without id.  Extra columns stay as they are, see
    added() for clashing names; an empty table gives an empty result.  Keyword arguments go to solve().  Cumulative sums run over ranges of places, so that no task needs
    all blocks of a source.
    """
    ws = Workspace(docs.sparkSession)
    # the row travels as one column, so that no name of its columns meets one of those below
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("mix_source"), n_tokens(F.col(text_col)).alias("mix_tokens"))
    hashed = F.xxhash64(F.lit(seed), F.col("key"))
    sums = ws.save(rows.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    mixture = solve(sums, **target)
    shares = F.round(mixture.budget(F.col("tokens")), 3) if mixture else F.lit(0.0)
    plan = sums.select("mix_source", F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).cast("long").alias("n_blocks"), shares.alias("budget"), "tokens")
    if sums.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    dealt = rows.join(plan.select("mix_source", "n_blocks"), "mix_source").withColumn("block", F.pmod(hashed, F.col("n_blocks"))).drop("n_blocks")
    blocks = dealt.groupBy("mix_source", "block").agg(F.sum("mix_tokens").alias("block_tokens"))
    # whole epochs, then one that ends within a block; sums of doubles leave a hair over a whole number
    epochs = F.when(F.col("tokens") > 0, F.greatest(F.lit(1), F.ceil(F.col("budget") / F.col("tokens") - 1e-9))).otherwise(1)
    placed = (
        blocks.join(plan, "mix_source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs.cast("long") - 1)))
        .withColumn("left", F.round(F.col("budget") - F.col("epoch") * F.col("tokens")).cast("long"))
        .withColumn("block_place", _order(seed, F.col("mix_source"), F.col("epoch"), F.col("block")))
        .withColumn("range", F.shiftright("block_place", 50))
    )
    by_range = placed.groupBy("mix_source", "epoch", "range").agg(F.sum("block_tokens").alias("range_tokens"))
    w = W.partitionBy("mix_source", "epoch").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    by_range = by_range.withColumn("range_before", F.coalesce(F.sum("range_tokens").over(w), F.lit(0))).drop("range_tokens")
    w = W.partitionBy("mix_source", "epoch", "range").orderBy("block_place", "block").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.join(by_range, ["mix_source", "epoch", "range"]).withColumn("block_before", F.col("range_before") + F.coalesce(F.sum("block_tokens").over(w), F.lit(0)))
    taken = ws.save(
        placed.where((F.col("left") >= F.col("tokens")) | (F.col("block_before") < F.col("left")) | (F.col("tokens") == 0))
        .select("mix_source", "block", "epoch", "block_place", F.when((F.col("left") >= F.col("tokens")) | (F.col("tokens") == 0), F.lit(2**62)).otherwise(F.col("left") - F.col("block_before")).alias("room")),
        "blocks",
    )
    w = W.partitionBy("mix_source", "block", "epoch").orderBy("doc_place", "key").rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(taken, ["mix_source", "block"]).withColumn("doc_place", _order(seed + 1, F.col("epoch"), F.col("key")))
    out = out.withColumn("before", F.coalesce(F.sum("mix_tokens").over(w), F.lit(0)))
    return out.where((F.col("before") < F.col("room")) & ((F.col("mix_tokens") > 0) | (F.col("epoch") == 0))).select("row.*", *[F.col(name).alias(at) for name, at in added(docs).items()])
