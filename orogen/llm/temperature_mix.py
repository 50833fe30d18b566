"""Mixing of sources by a temperature, realised as block permutations.

A source's weight is its token share to the power of an exponent, normalised.
The exponent is bisected until the mix has a target entropy or repeats no source
beyond a limit. The weights and a token budget give each source a number of
passes over its documents, the last one partial. A pass visits the source's
blocks in a permutation of its own. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.llm.common import stored, text_of

#: Bits of a document's block and, twice, of its place in the block.
BITS = 12
GRID, ROUNDS = 33, 6


def words(text_col: str = "text") -> Column:
    """White-space separated words of the whole text; null and blank texts count as one."""
    return F.greatest(F.regexp_count(text_of(text_col), F.lit(r"\S+")), F.lit(1)).cast("long")


def _logs(sources: DataFrame) -> DataFrame:
    """Each source's log token count, less that of the largest."""
    top = sources.agg(F.max("tokens")).first()[0] or 1
    return sources.select(F.log(F.col("tokens") / float(top)).alias("x"))


def bisect(sources: DataFrame, wanted: Callable[[dict], bool]) -> float:
    """The largest exponent in 0 to 1 for which ``wanted`` holds; 0 if it never does.

    Each round measures a grid of exponents in one aggregation and keeps the
    interval where the answer changes. A row of measures has ``entropy``,
    ``most`` (the largest repetition, of a source relative to the largest
    one's) and ``size`` (the sum of powers relative to the largest).
    """
    x = _logs(sources)
    low, high = 0.0, 1.0
    for turn in range(ROUNDS):
        grid = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
        power = F.exp(F.col("a") * F.col("x"))
        rows = x.withColumn("a", F.explode(F.array(*map(F.lit, grid)))).groupBy("a").agg(
            F.sum(power).alias("size"), F.sum(power * F.col("x")).alias("moment"), F.max((F.col("a") - 1) * F.col("x")).alias("lift"))
        rows = rows.select("a", "size", (F.log("size") - F.col("a") * F.col("moment") / F.col("size")).alias("entropy"), F.exp("lift").alias("most"))
        seen = sorted((r.asDict() for r in rows.collect()), key=lambda r: r["a"])  # GRID rows
        if turn == 0 and (not seen or wanted(seen[-1])):
            return 1.0
        good = [i for i, r in enumerate(seen) if wanted(r)]
        if not good:
            return low
        low, high = seen[good[-1]]["a"], seen[min(good[-1] + 1, GRID - 1)]["a"]
    return low


def exponent_for_entropy(sources: DataFrame, nats: float) -> float:
    """The exponent nearest to 1 whose mix has at least this entropy."""
    return bisect(sources, lambda r: r["entropy"] >= nats)


def exponent_for_repeats(sources: DataFrame, repeats: float, budget: float | None = None) -> float:
    """The smallest exponent whose mix repeats no source beyond the limit.

    Without a budget the largest source is seen once.
    """
    top = sources.agg(F.max("tokens")).first()[0]

    def over(r: dict) -> bool:
        most = r["most"] if budget is None else r["most"] * budget / (r["size"] * top)
        return most > repeats

    # Repetition falls as the exponent grows: the last exponent that is over, and the next one isn't.
    if not sources.limit(1).count():
        return 1.0
    low = bisect(sources, over)
    return min(1.0, low + (1.0 / (GRID - 1) ** ROUNDS)) if low > 0 or over(_measure(sources, 0.0)) else 0.0


def _measure(sources: DataFrame, a: float) -> dict:
    row = _logs(sources).agg(F.sum(F.exp(a * F.col("x"))).alias("size"), F.exp(F.max((a - 1) * F.col("x"))).alias("most")).first()
    return row.asDict()


def plan(sources: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """Per source: ``weight`` (they sum to 1), ``passes`` (whole ones) and ``rest`` (tokens of a partial one).

    Without a budget it is the smallest that leaves no document out.
    """
    power = F.pow(F.col("tokens").cast("double"), exponent)
    top, total = sources.agg(F.max("tokens"), F.sum(power)).first()
    whole = float(top or 1) ** (1 - exponent) * float(total or 1) if budget is None else float(budget)
    out = sources.withColumn("weight", power / float(total or 1)).withColumn("repeats", whole * F.col("weight") / F.col("tokens"))
    # A hair more keeps rounding from leaving out the last document of a whole pass.
    passes = F.floor(F.col("repeats") + 1e-9)
    rest = F.greatest(F.col("repeats") - passes, F.lit(0.0)) * F.col("tokens")
    return out.select("source", "tokens", "weight", "repeats", passes.cast("int").alias("passes"), rest.alias("rest"))


def place(key: Column, turn: Column, seed: int) -> Column:
    """A document's place in a pass: its block's place in that pass's permutation, then its own in the block."""
    block = F.pmod(key, F.lit(1 << BITS))
    step = F.pmod(F.xxhash64(F.lit(seed), turn), F.lit(1 << BITS)) * 2 + 1
    first = F.pmod(F.xxhash64(F.lit(seed + 1), turn), F.lit(1 << BITS))
    return F.pmod(block * step + first, F.lit(1 << BITS)) * (1 << 2 * BITS) + F.pmod(F.xxhash64(key, turn), F.lit(1 << 2 * BITS))


def cuts(slim: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """Adds ``cut``: places below it are in the partial pass.

    Sums of 2**BITS blocks per source narrow the cut down, three times; no
    source's documents meet in one task.
    """
    state = planned.select("source", "passes", "rest", F.lit(0).cast("long").alias("cut"), F.lit(0.0).alias("used"))
    for level in (2, 1, 0):
        width, above = 1 << level * BITS, 1 << (level + 1) * BITS
        near = slim.join(state, "source").where("rest > 0").withColumn("at", place(F.col("key"), F.col("passes"), seed))
        near = near.where(F.floor(F.col("at") / above) == F.floor(F.col("cut") / above))
        sums = near.groupBy("source", "rest", "used", F.floor(F.col("at") / width).alias("block")).agg(F.sum("tokens").cast("double").alias("n"))
        running = sums.withColumn("sum", F.sum("n").over(Window.partitionBy("source").orderBy("block")))
        fits = F.col("used") + F.col("sum") <= F.col("rest")
        found = running.groupBy("source").agg(F.min(F.when(~fits, F.col("block"))).alias("block"), F.max("block").alias("last"), F.coalesce(F.max(F.when(fits, F.col("sum"))), F.lit(0.0)).alias("more"))
        cut = F.when(F.col("last").isNull(), F.col("cut")).otherwise(F.coalesce(F.col("block"), F.col("last") + 1) * width)
        state = stored(state.join(found, "source", "left").select("source", "passes", "rest", cut.cast("long").alias("cut"), (F.col("used") + F.coalesce("more", F.lit(0.0))).alias("used")), "mix")
    return planned.join(state.select("source", "cut"), "source")


def mix(df: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", *, repeats: float | None = None, entropy: float | None = None, budget: float | None = None, seed: int = 17) -> DataFrame:
    """The rows of ``df`` as often as the mix has them, with ``mix_tokens``, ``mix_weight``, ``mix_pass`` and ``mix_position``.

    Ordering by ``mix_position`` (0 to 1) gives the training order, in which any
    stretch has about the target weights. One of ``repeats`` and ``entropy``
    sets the exponent; neither leaves the natural shares. Without ``budget`` no
    document is left out. Null sources are one source; null and blank texts
    count one token. Rows with equal ids and texts share their places. An empty
    table gives none.
    """
    made = ("mix_tokens", "mix_weight", "mix_pass", "mix_position")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))
    rows = df.select(*kept, named.alias("__source"), key.alias("__key"), words(text_col).alias("mix_tokens"))
    slim = stored(rows.select(F.col("__source").alias("source"), F.col("__key").alias("key"), F.col("mix_tokens").alias("tokens")), "mix")
    sources = stored(slim.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix")
    if repeats is not None:
        exponent = exponent_for_repeats(sources, repeats, budget)
    else:
        exponent = 1.0 if entropy is None else exponent_for_entropy(sources, entropy)
    planned = stored(plan(sources, exponent, budget), "mix")
    planned = stored(cuts(slim, planned, seed), "mix")
    # The plan has a row a source; Spark broadcasts it if its files are small and shuffles otherwise.
    wide = rows.join(planned.select(F.col("source").alias("__source"), F.col("weight").alias("mix_weight"), "passes", "repeats", "cut"), "__source")
    partial = (place(F.col("__key"), F.col("passes"), seed) < F.col("cut")).cast("int")
    wide = wide.withColumn("__n", F.col("passes") + partial).where("__n > 0")
    wide = wide.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    at = (F.col("mix_pass") + place(F.col("__key"), F.col("mix_pass"), seed) / float(1 << 3 * BITS)) / F.greatest("repeats", F.col("__n").cast("double"))
    return wide.withColumn("mix_position", at).select(*kept, *made)
