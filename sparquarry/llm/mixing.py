"""Mixing sources by temperature, realised as budgeted block permutations.

A source's weight is its share of tokens to the power a, normalised: a = 1 is the
natural mix, a = 0 the uniform one.  The exponent is bisected until the mix has
the target entropy (a share of the largest possible; a natural mix that has more
stays as it is), or is the most uniform that repeats no source more than
max_repeats times, whichever exponent is larger.
With a budget of tokens each source gets its weight of it: whole passes, each a
permutation of the source's documents in blocks, and a last pass that stops where
the budget is used up.  By default the budget is the least that keeps every
document at least once.

A place in a permutation is 60 bits of a digest of seed, pass and id; its upper 16
bits are the block.  Shares are counted with map-side combine.  The bisection looks
at BRANCHES exponents per round over the per-source totals, a table that is never
collected.  Where the last pass ends is found by splitting ranges of places 256-fold,
for each source until its own range holds at most BLOCK documents, so no window spans
a source; only documents of that last range are ordered.  Rows of one place (an id
that repeats) are split further by a hash of the row's number.

Defined results: a null source is a source of its own; a null text has no tokens;
documents without tokens are in every whole pass and in no partial one; rows that
repeat are documents of their own, also where all their columns are equal; with one
source its weight is 1; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

ENTROPY, MAX_REPEATS, BRANCHES, ROUNDS, BLOCK = 0.92, 2.0, 32, 4, 256


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))).cast("long")


def exponent(totals: DataFrame, entropy: float = ENTROPY, max_repeats: float | None = MAX_REPEATS) -> float:
    """totals: source, tokens.  Entropy falls as the exponent grows, and so do the repeats of the smallest source."""
    some = totals.where(F.col("tokens") > 0)
    stats = some.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("all"), F.max("tokens").alias("top"), F.min("tokens").alias("low")).first()
    if not stats["n"] or stats["n"] == 1:
        return 1.0
    target = entropy * _log(stats["n"])
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / BRANCHES for i in range(BRANCHES + 1)]
        p = F.col("tokens") / F.lit(float(stats["all"]))
        # one row per source and exponent, combined where the totals lie
        each = some.select(p.alias("p"), F.explode(F.array(*[F.lit(a) for a in grid])).alias("a")).withColumn("pa", F.pow("p", "a"))
        sums = {r["a"]: r for r in each.groupBy("a").agg(F.sum("pa").alias("z"), F.sum(F.col("pa") * F.col("a") * F.log("p")).alias("l")).collect()}
        # H = ln Z - sum(p^a ln p^a) / Z
        enough = [_log(sums[a]["z"]) - sums[a]["l"] / sums[a]["z"] >= target for a in grid]
        last = max((i for i, ok in enumerate(enough) if ok), default=0)
        lo, hi = grid[last], grid[min(last + 1, BRANCHES)]
        if lo == hi:
            break
    found = lo
    if max_repeats is not None and stats["top"] > stats["low"]:
        # passes of a source over those of the largest: (top / tokens) ** (1 - a)
        found = max(found, 1 - _log(max(max_repeats, 1.0)) / _log(stats["top"] / stats["low"]))
    return min(1.0, max(0.0, found))


def _log(x: float) -> float:
    import math

    return math.log(x)


def plan(totals: DataFrame, a: float, budget: float | None = None) -> DataFrame:
    """source, tokens, weight, budget (tokens), passes (budget over tokens) of each source that has tokens."""
    some = totals.where(F.col("tokens") > 0)
    z = F.col("tokens").cast("double")
    parts = some.agg(F.sum(F.pow(z, F.lit(a))).alias("z"), F.max(F.pow(z, F.lit(1 - a))).alias("w")).first()
    if parts["z"] is None:
        return some.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("budget"), F.lit(0.0).alias("passes"))
    total = float(budget) if budget is not None else parts["z"] * parts["w"]  # the largest tokens / weight
    weight = F.pow(z, F.lit(a)) / F.lit(parts["z"])
    return some.select("source", "tokens", weight.alias("weight"), (weight * total).alias("budget"), (weight * total / z).alias("passes"))


#: Bits of a place, and of it those that name the block.
PLACE, BLOCK_BITS = 60, 16
#: Rows of per-source tables up to which they are broadcast; checked before each broadcast.
SMALL = 100_000
LEAST, MOST = -(2**63), 2**63 - 1


def place(seed: int, number: Column | None = None) -> Column:
    """A row's place in the permutation of a pass; without a number that of the last, partial one."""
    parts = [F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))] + ([] if number is None else [number.cast("string")])
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, PLACE // 4), 16, 10).cast("long")


def block(at: Column) -> Column:
    return F.shiftright(at, PLACE - BLOCK_BITS).cast("int")


def number(docs: DataFrame, *columns: str) -> DataFrame:
    """uid, doc_id, source, n_tokens of every row, and further columns; to be written, so that a row keeps its number."""
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", *columns, n_tokens(F.col("text")).alias("n_tokens"))


def _beside(rows: DataFrame, state: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of a per-source table, broadcast where it is small."""
    s = state.withColumnRenamed("source", "s")
    return rows.join(F.broadcast(s) if state.count() <= SMALL else s, F.col("source").eqNullSafe(F.col("s")), how).drop("s")


def _edges(rows: DataFrame, state: DataFrame) -> DataFrame:
    """state: source, rest, docs.  The range of places in which the last pass of each source ends, and what is left for it.

    source, rest, lo, hi (places), tlo, thi (ties): rows in front of the range are in the last pass.
    """
    state = state.select("source", "rest", "docs", *[F.lit(x).cast("long").alias(n) for n, x in (("lo", 0), ("hi", 2**PLACE - 1), ("tlo", LEAST), ("thi", MOST))])
    for key, low, high, bits in (("place", "lo", "hi", PLACE), ("tie", "tlo", "thi", 64)):
        for shift in range(bits - 8, -8, -8):
            shift = max(shift, 0)
            open_ = state.where(F.col("docs") > BLOCK)
            if open_.isEmpty():
                return state
            inside = _beside(rows.select("source", "place", "tie", "n_tokens"), open_.drop("docs")).where(F.col("place").between(F.col("lo"), F.col("hi")) & F.col("tie").between(F.col("tlo"), F.col("thi")))
            # ties are any 64 bits; their sign is turned so that digits order as they do
            digit = F.shiftrightunsigned(F.col(key) if key == "place" else F.col(key).bitwiseXOR(F.lit(LEAST)), shift).bitwiseAND(F.lit(255))
            bins = inside.groupBy("source", "rest", "lo", "hi", "tlo", "thi", digit.alias("bin")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
            w = Window.partitionBy("source").orderBy("bin")
            before = bins.withColumn("before", F.sum("tokens").over(w) - F.col("tokens"))
            edge = before.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("tokens") > F.col("rest")))
            base = F.col(low).bitwiseXOR(F.lit(LEAST)) if key == "tie" else F.col(low)
            start = base.bitwiseOR(F.shiftleft(F.col("bin"), shift))
            stop = start.bitwiseOR(F.lit((1 << shift) - 1))
            if key == "tie":
                start, stop = start.bitwiseXOR(F.lit(LEAST)), stop.bitwiseXOR(F.lit(LEAST))
            split = edge.withColumn("start", start).withColumn("stop", stop).withColumn("rest", F.col("rest") - F.col("before")).drop(low, high).withColumnRenamed("start", low).withColumnRenamed("stop", high)
            state = materialise(state.where(F.col("docs") <= BLOCK).unionByName(split.select(*state.columns)), "edge")
    return state


def deal(rows: DataFrame, entropy: float = ENTROPY, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = 0) -> DataFrame:
    """rows: of number(), written.  The same with weight, passes, copies and deals: (pass, block, place) of each pass that holds the row."""
    rows = rows.withColumn("place", place(seed)).withColumn("tie", F.xxhash64("uid"))
    totals = materialise(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "totals")
    mix = plan(totals, exponent(totals, entropy, max_repeats), budget)
    mix = mix.withColumn("whole", F.floor(F.col("passes") + 1e-9)).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("whole") * F.col("tokens")))
    mix = materialise(mix.select("source", "weight", "passes", "whole", "rest"), "mix")
    parts = _beside(totals.select("source", "docs"), mix.where(F.col("rest") > 0.5).select("source", "rest"))
    edges = materialise(_edges(rows, parts).drop("docs"), "edges")
    # within the last range documents are taken in order while they fit
    tail = _beside(rows.select("uid", "source", "place", "tie", "n_tokens"), edges).where(F.col("place").between(F.col("lo"), F.col("hi")) & F.col("tie").between(F.col("tlo"), F.col("thi")))
    w = Window.partitionBy("source").orderBy("place", "tie", "uid")
    tail = tail.withColumn("upto", F.sum("n_tokens").over(w)).where((F.col("upto") <= F.col("rest")) & (F.col("n_tokens") > 0)).select("uid", F.lit(1).alias("last"))
    out = _beside(_beside(rows, mix.drop("rest"), "left"), edges.drop("rest"), "left").join(materialise(tail, "tail"), "uid", "left")
    # without an edge the last pass is empty
    early = (F.col("n_tokens") > 0) & ((F.col("place") < F.col("lo")) | (F.col("place").between(F.col("lo"), F.col("hi")) & (F.col("tie") < F.col("tlo"))))
    extra = F.when(F.coalesce(early, F.lit(False)), 1).otherwise(F.coalesce(F.col("last"), F.lit(0)))
    whole = F.coalesce(F.col("whole"), F.lit(1)).cast("int")
    out = out.withColumn("copies", (whole + extra).cast("int"))

    def one(k: Column) -> Column:
        # the last pass ends at a cut of its places, so they are those that were cut
        at = F.when(k == whole, F.col("place")).otherwise(place(seed, k))
        return F.struct(k.alias("pass"), block(at).alias("block"), at.alias("place"))

    deals = F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>")), one)
    return out.withColumn("deals", deals).drop("place", "tie", "lo", "hi", "tlo", "thi", "last", "whole")


def copies(docs: DataFrame, entropy: float = ENTROPY, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = 0) -> DataFrame:
    """uid, doc_id, source, n_tokens, weight, passes, copies, deals for every row of docs.

    copies: how often the mix holds the document.  deals: for each pass that holds it (pass, block, place),
    its place in that pass's own permutation and the block that is in.
    """
    return deal(materialise(number(docs), "tokens"), entropy, max_repeats, budget, seed)


def permutation(docs: DataFrame, entropy: float = ENTROPY, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, source, n_tokens, weight, pass, block, place: one row for each time that the mix holds a document.

    The mix in order is that by pass and place; blocks can be dealt to tasks.
    """
    return copies(docs, entropy, max_repeats, budget, seed).select("doc_id", "source", "n_tokens", "weight", F.inline("deals"))


def mix(docs: DataFrame, entropy: float = ENTROPY, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = 0) -> DataFrame:
    """The columns of documents, each row as often as the mix holds it; dealt by pass and block, a pass after another, in the order of its permutation."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = materialise(number(docs, "text", "lang", "n_chars"), "numbered")
    dealt = deal(rows.drop("text", "lang", "n_chars"), entropy, max_repeats, budget, seed).select("uid", "deals")
    dealt = rows.join(dealt, "uid").select(*names, F.inline("deals"))
    return dealt.repartition("pass", "block").sortWithinPartitions("pass", "place").select(*names)
