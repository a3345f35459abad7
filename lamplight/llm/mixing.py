"""Mixing sources to target weights by temperature (operator 5).

Source weights are token shares raised to an exponent in [0, 1] and normalised. The exponent is bracketed by aggregates
over the table of sources, a grid of exponents in each, until it meets a target entropy or a repetition limit; sources
are never collected. The weights are then realised as block permutations: a source's documents are ordered by (block,
hash), whole epochs take all of them, and the rest of its budget takes whole blocks and then rows of one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lamplight.llm.common import cut, written

SEED = "mix-1"
MAX_REPEAT = 1.5
#: Documents of a block on average; only rows of one block of a source are ordered in a task.
BLOCK_DOCS = 2000
GRID = 17
ROUNDS = 8
#: Sources that are broadcast at most (a row of them is under 200 bytes).
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    """Tokens by white space, the default measure of a document."""
    t = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[ \t\n\r\x0b\f]+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))).cast("long")


def exponent(sources: DataFrame, max_repeat: float | None, target_entropy: float | None) -> float:
    """The largest exponent that meets the target: entropy (nats) reached, or no source repeated over max_repeat times
    while none is seen less than once. ``sources`` has ``tokens``. Flattening is most at 0 and none at 1."""
    live = sources.where("tokens > 0")
    total = live.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not total[0]:
        return 1.0
    share = F.col("tokens") / F.lit(float(total[0]))
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        taus = [low + (high - low) * k / (GRID - 1) for k in range(GRID)]
        if target_entropy is not None:
            got = live.agg(*[F.sum(F.pow(share, F.lit(t))).alias(f"z{k}") for k, t in enumerate(taus)], *[F.sum(F.pow(share, F.lit(t)) * F.log(share)).alias(f"s{k}") for k, t in enumerate(taus)]).first()
            import math

            flat = [math.log(got[f"z{k}"]) - t * got[f"s{k}"] / got[f"z{k}"] for k, t in enumerate(taus)]
            met = [h >= target_entropy for h in flat]  # holds for small exponents
            k = max((k for k, x in enumerate(met) if x), default=0)
            low, high = taus[k], taus[min(k + 1, GRID - 1)]
            answer = low
        else:
            ratio = total[2] / total[1]
            met = [ratio ** (1 - t) <= max_repeat for t in taus]  # holds for large exponents
            k = min((k for k, x in enumerate(met) if x), default=GRID - 1)
            low, high = taus[max(k - 1, 0)], taus[k]
            answer = high
    return answer


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, max_repeat: float = MAX_REPEAT, target_entropy: float | None = None, budget: int | None = None, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """Draw documents so that sources get their temperature weights of the token budget.

    Returns doc_id, source, tokens, block, epoch (0, 1, ...) and ``carry`` columns as __carry_0, ...: one row each time a document is drawn; (epoch,
    block, hash of the id) is its place in its source. ``budget`` defaults to the least that gives every source one
    whole epoch, so nothing is lost; a smaller one also cuts sources short, which is the feature. A null source is one
    source of its own. Null and empty texts have no tokens: they come with whole epochs, and a source without tokens
    gets one epoch. Ties of hash go by id, then tokens; repeated rows are drawn each. Null ids hash as the empty
    string. An empty table gives no rows.
    """
    count = words(F.col(text_col)) if tokens is None else tokens
    names = {"doc_id": F.col(id_col), "source": F.col(source_col).cast("string"), "tokens": F.coalesce(count.cast("long"), F.lit(0))}
    rows = docs.select(*[c.alias(k) for k, c in names.items()], *[F.col(c).alias(f"__carry_{k}") for k, c in enumerate(carry or [])])
    # texts are cut into words once for all that follows; only rows that carry texts on read them again
    narrow = written(rows.select(*names))
    if not carry:
        rows = narrow
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows, narrow = rows.withColumn("__order", hashed), narrow.withColumn("__order", hashed)
    sources = cut(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    size = sources.agg(F.count("*"), F.sum("docs"), F.sum("tokens"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))), F.max("tokens")).first()
    blocks = max(1, -(-(size[1] or 0) // BLOCK_DOCS))
    tau = exponent(sources, max_repeat, target_entropy)
    total = float(size[2] or 0) or 1.0
    z = float(sources.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / F.lit(total), F.lit(tau)))).first()[0] or 1.0)
    if budget is None:  # the least for which no weight falls below the source's own tokens
        budget = int((total * z) * (float(size[4] or 1) / total) ** (1 - tau) + 0.5)
    per = F.floor(F.pow(F.col("tokens") / F.lit(total), F.lit(tau)) / F.lit(z) * F.lit(float(budget)) + F.lit(0.5)).cast("long")
    plan = sources.select("source", F.col("tokens").alias("have"), F.when(F.col("tokens") > 0, per).otherwise(F.lit(0)).alias("quota"))
    plan = plan.select(
        "source",
        F.when(F.col("have") > 0, F.floor(F.col("quota") / F.col("have"))).otherwise(F.lit(1)).cast("int").alias("epochs"),
        F.when(F.col("have") > 0, F.col("quota") % F.col("have")).otherwise(F.lit(0)).alias("rest"),
    )
    block = F.pmod(F.conv(F.substring("__order", 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int")
    rows = rows.withColumn("block", block)
    sums = narrow.withColumn("block", block).groupBy("source", "block").agg(F.sum("tokens").alias("sum"))
    running = sums.withColumn("end", F.sum("sum").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    hint = F.broadcast if size[0] <= BROADCAST_SOURCES else (lambda x: x)
    edge = (
        running.alias("r").join(hint(plan.alias("p")), F.col("r.source").eqNullSafe(F.col("p.source")))
        .where("end > rest").groupBy("r.source").agg(F.min("block").alias("edge"), F.min_by(F.col("end") - F.col("sum"), F.col("block")).alias("before"))
        .select(F.col("source").alias("s2"), "edge", "before")
    )
    plan = cut(plan.join(hint(edge), F.col("source").eqNullSafe(F.col("s2")), "left").select(F.col("source").alias("s"), "epochs", "rest", "edge", "before"))
    near = rows.join(hint(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = near.where("edge is null or block <> edge").withColumn("extra", F.when(F.col("edge").isNull() | (F.col("block") < F.col("edge")), (F.col("rest") > 0).cast("int")).otherwise(F.lit(0)))
    w = Window.partitionBy("source", "block").orderBy("__order", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    part = near.where("block = edge").withColumn("run", F.sum("tokens").over(w) + F.col("before")).withColumn("extra", (F.col("run") <= F.col("rest")).cast("int")).drop("run")
    drawn = whole.unionByName(part).withColumn("n", F.col("epochs") + F.col("extra")).where("n > 0")
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return drawn.select("doc_id", "source", "tokens", "block", "epoch", *[f"__carry_{k}" for k in range(len(carry or []))])


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The input's rows and columns as often as ``mix`` draws them."""
    return mix(docs, carry=docs.columns, **options).select(*[F.col(f"__carry_{k}").alias(c) for k, c in enumerate(docs.columns)])
