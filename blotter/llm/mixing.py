"""Mix sources towards target weights by Pareto order sampling.

A source's target is its weight's share of all words, but at most ``max_repeats`` times
its own size; what lies above is shared again by weight until no source is above. A document
is to be taken target / size times on average, longer ones up to ``TILT`` more often and shorter ones less,
by the bit length of their size, so that the words still add up to the target and no document is taken more than
``max_repeats`` times. The whole part of its number is certain: so many copies. The rest is an inclusion
probability p of its own. Documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), with a fixed
random number u each, and taken from the smallest on until the source's remaining words are filled. That is a sample of
fixed size with unequal probabilities, and because the ranking is the same each time, reruns agree.

The fill needs a running sum over each source. A source may hold a third of all rows, so
rows are dealt by ranges of source and rank, which Spark makes even by sampling them, and the running sum is taken in two steps:
over ranges, whose sums are few, and within ranges. No task holds a source.

Everything is DataFrame expressions: no Python runs on executors.

Defined cases: a null text has no words and takes no room, and its document may be taken
or not. Documents without a source form one source, which comes last. A source without
words has target 0. Repeated rows, and rows with a null identifier, are sampled like any others;
equal rows are equal in rank too. An empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import staged, word_count

SEED = 20
MAX_REPEATS = 3
# How much more or less often than its source a document may be taken on average.
TILT = 0.5
# Parts into which a source's rows are dealt for the join with its target. It only spreads work.
SALTS = 64

_RANDOM_BITS = 52


def measure(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """``(doc_id, tag, source, size)``: size in words; the tag tells apart texts that share an
    identifier or have none."""
    return docs.select(
        F.col(id_column).alias("doc_id"),
        text_tag(F.col(text)).alias("tag"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
    )


def text_tag(text: Column) -> Column:
    return F.xxhash64(text)


def source_targets(
    sized: DataFrame, weights: Sequence[float], max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """``(source, source_size, target, mean, spread)``; mean and spread are those of the bit lengths of
    its documents' sizes, by words, as ``inclusion`` needs them.

    Weights repeat over the sources in code-point order. The resharing ends at a level at
    which every source gets the smaller of weight times level and its cap. Sources with the smallest
    cap per weight are at their cap, so one running sum in that order finds the level.
    The windows here run over one row a source.
    """
    bits = bit_length(F.col("size"))
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum(F.col("size") * bits).alias("weighed"),
        F.min(bits).alias("low"),
        F.max(bits).alias("high"),
    )
    mean = F.coalesce(F.try_divide("weighed", "source_size"), F.lit(0.0))
    sources = sources.withColumn("mean", mean).select(
        "source", "source_size", "mean", F.greatest(F.col("high") - mean, mean - F.col("low")).alias("spread")
    )
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    everywhere = Window.partitionBy()
    number = F.row_number().over(ordered) - 1
    weighed = sources.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), number % len(weights) + 1).cast("double")
    ).withColumn("cap", F.col("source_size") * float(max_repeats))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levelled = weighed.withColumns(
        {"level": left / F.sum("weight").over(onwards), "n": F.row_number().over(by_need)}
    )
    # The first source that the level leaves below its cap is the first without a cap to keep.
    below = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("n", "level"))
    first = F.min(below).over(everywhere)
    return levelled.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("first").isNull() | (F.col("n") < F.col("first.n")), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("first.level") * F.col("weight")))
        .alias("target"),
        "mean",
        "spread",
    )


def bit_length(size: Column) -> Column:
    return F.length(F.bin(size))


def inclusion(size: Column, rate: Column, mean: Column, spread: Column, max_repeats: int) -> Column:
    """How often a document is taken on average: by words the mean of a source is its rate, and no
    document exceeds ``max_repeats``."""
    room = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(float(max_repeats)), rate), F.lit(1.0)) - 1.0)
    longer = F.coalesce(F.try_divide(bit_length(size) - mean, spread), F.lit(0.0))
    return F.greatest(F.lit(0.0), rate * (F.lit(1.0) + F.lit(TILT) * room * longer))


def mix(
    sized: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
    salts: int = SALTS,
) -> DataFrame:
    """``(doc_id, tag, source, size, source_size, target, copies, taken)`` for every row."""
    # The number tells equal rows apart, so that even they can be dealt to several ranges.
    sized = staged(sized.withColumn("copy", F.monotonically_increasing_id()), "sizes")
    order = ("rank", "doc_id", "size", "tag", "copy")
    rated = staged(
        rated_rows(sized, weights, max_repeats, seed, salts)
        .repartitionByRange("source", *order)
        .withColumn("range", F.spark_partition_id()),
        "ranks",
    )
    filled = rated.groupBy("source", "range").agg(
        F.sum("size").alias("words"),
        F.sum(F.col("certain") * F.col("size")).alias("sure"),
        F.first("target").alias("target"),
    )
    own = Window.partitionBy("source")
    before = own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.select(
        "source",
        "range",
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("below"),
        (F.col("target") - F.sum("sure").over(own)).alias("room"),
    )
    within = Window.partitionBy("source", "range").orderBy(*order)
    running = F.coalesce(
        F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    half = F.col("size") / F.lit(2.0)
    sampled = (F.col("p") > 0) & (F.col("below") + F.col("within") + half <= F.col("room"))
    copies = (F.col("certain") + sampled.cast("long")).cast("long")
    return (
        rated.withColumn("within", running)
        .alias("r")
        .join(
            filled.alias("f"),
            F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.range") == F.col("f.range")),
        )
        .select("r.*", "f.below", "f.room")
        .withColumn("copies", copies)
        .select(
            "doc_id",
            "tag",
            "source",
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def rated_rows(
    sized: DataFrame, weights: Sequence[float], max_repeats: int, seed: int, salts: int
) -> DataFrame:
    """Every row with its source's size and target, its certain copies, its chance of one more and its rank."""
    dealt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)).cast("int")
    targets = source_targets(sized, weights, max_repeats).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    return (
        sized.withColumn("salt", dealt)
        .alias("d")
        .join(
            targets.alias("t"),
            F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.salt") == F.col("t.salt")),
        )
        .select("d.*", "t.source_size", "t.target", "t.mean", "t.spread")
        .drop("salt")
        .withColumn("often", inclusion(F.col("size"), rate, F.col("mean"), F.col("spread"), max_repeats))
        .withColumn("certain", F.floor("often"))
        .withColumn("p", F.col("often") - F.col("certain"))
        .withColumn("rank", pareto_rank(F.col("doc_id"), F.col("p"), seed))
        .drop("mean", "spread", "often")
    )


def mixed_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents that are in the mix, with all their columns, ``copies`` and ``taken``.

    Columns of these two names are replaced.

    Equal rows share an entry of the mix, the one with most copies.
    """
    entries = mixed.groupBy("doc_id", "tag").agg(
        F.max("copies").alias("copies"), F.max("taken").alias("taken")
    )
    own = "tag"
    while own in docs.columns:
        own = f"_{own}"
    tagged = docs.withColumn(own, text_tag(F.col("text"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col(f"d.{own}").eqNullSafe(F.col("m.tag"))
    return tagged.join(entries.filter("copies > 0").alias("m"), same).select(
        *[F.col(f"d.`{c}`") for c in docs.columns if c not in ("copies", "taken")], "m.copies", "m.taken"
    )


def pareto_rank(identifier: Column, p: Column, seed: int) -> Column:
    """Random odds over inclusion odds; null where nothing is left to chance."""
    u = random_number(identifier, seed)
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def random_number(identifier: Column, seed: int) -> Column:
    """The identifier's fixed number between 0 and 1."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), identifier.cast("string")))
    bits = F.conv(F.substring(digest, 1, _RANDOM_BITS // 4), 16, 10).cast("double")
    return (bits + 0.5) / float(2**_RANDOM_BITS)
