"""Mix sources to target weights by thresholds on a hash, without sorting documents.

Sources in the order of their code points (null last) weigh ``weights``, repeating, and
share all words by weight. A target stops at ``most`` times the words its source has; what
is left over goes to the others by weight, until no target is above its stop.

A source with target t and S words gives each document floor(t / S) times, and once more
where the document's hash lies below the source's threshold. Thresholds are found by
nested histograms: words are summed by source and the top bits of the hash; in the bucket
where the running sum passes the rest of the budget, and in that bucket only, they are
summed again by the next bits, until one hash value is left. It is taken if the
source's words come nearer to the target with it than without it.

So a source's words miss its target by half of one document at most. The hash is made of
id and text: reruns agree, whatever the partitioning. Rows equal in id and text share
their fate, and are taken or left together at the threshold. Null and empty texts have
size 0 and are taken 0 words; a null source is a source; a table without words has
targets of 0; an empty table gives an empty result. Texts are read whole. `shares` reads the
named columns only; `mix` returns all columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillframe.llm.common import stored, text
from quillframe.support import numbered, small_or_cut

WEIGHTS, MOST = (5, 2, 1), 3
# The hash has HASH_BITS bits; a histogram tells LEVEL_BITS of them apart.
HASH_BITS, LEVEL_BITS = 60, 12
# A table of very many sources is joined by source and salt, so that no source is one task's.
SALTS = 32
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str) -> Column:
    return F.regexp_count(text(text_col), F.lit(_WORD)).cast("long")


def row_hash(id_col: str, text_col: str) -> Column:
    """60 bits of a digest of id and text."""
    key = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"), text(text_col))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Only sums come to the driver. Sources above their stop are set aside, and the rest share
    what is left, until no further source is above: at most one round a source, in practice a few.
    """
    ranked = numbered(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("number", F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.select("source", "source_size", weight.cast("long").alias("weight"))
    stop = F.col("source_size") * F.lit(most)
    wide = "decimal(18,0)"

    def sums(kept: DataFrame) -> tuple[int, int]:
        row = kept.agg(F.sum(stop.cast("decimal(38,0)")), F.sum("weight")).first()
        return int(row[0] or 0), int(row[1] or 0)

    everything, all_weights = sums(ranked)
    total, above = everything // most, F.lit(False)
    words, share, seen = total, all_weights, (0, 0)
    while share:
        above = stop.cast(wide) * F.lit(share).cast(wide) < F.lit(words).cast(wide) * F.col("weight").cast(wide)
        now = sums(ranked.filter(above))
        if now == seen:
            break
        seen, words, share = now, total - now[0], all_weights - now[1]
    fair = F.lit(float(words)) * F.col("weight") / F.lit(float(share or 1))
    return ranked.select("source", "source_size", F.when(above, stop.cast("double")).otherwise(fair).alias("target"))


def _plan(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target, times, edge, with_edge) from rows of (source, size, hash)."""
    shift = HASH_BITS - LEVEL_BITS
    level = stored(_histogram(rows, shift), "mix-level")
    sources = level.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = targets(sources, weights, most)
    size = F.col("source_size")
    times = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(most))).otherwise(0).cast("long")
    goals = goals.withColumn("times", times)
    rest = F.when(F.col("times") < most, F.greatest(F.col("target") - F.col("times") * size, F.lit(0.0))).otherwise(0.0)
    goals = stored(goals.withColumn("rest", rest), "mix-goals")

    edges, before = None, goals.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("before"))
    while True:
        found = stored(_boundary(level, before), "mix-boundary")
        single = found.filter("low = high").select("source", "rest", "before", "words", F.col("low").alias("edge"))
        edges = single if edges is None else edges.unionByName(single)
        before = found.filter("low < high").select("source", "rest", "before", "bucket")
        if shift == 0 or before.isEmpty():
            break
        inside = before.select("source", "bucket")
        kept = by_source(rows.withColumn("bucket", F.shiftright("hash", shift)), inside, also="bucket")
        shift -= LEVEL_BITS
        level = _histogram(kept, shift)
    with_edge = 2 * (F.col("rest") - F.col("before")) > F.col("words")
    edges = edges.select("source", "edge", with_edge.alias("with_edge"))
    goals = goals.withColumnRenamed("source", "of").join(edges, F.col("of").eqNullSafe(F.col("source")), "left")
    goals = goals.select(
        F.col("of").alias("source"), "source_size", "target", "times",
        F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("with_edge", F.lit(False)).alias("with_edge"),
    )
    return stored(goals, "mix-plan")


def _histogram(rows: DataFrame, shift: int) -> DataFrame:
    """Words by source and bucket, and the least and greatest hash in it."""
    return rows.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
        F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high")
    )


def _boundary(level: DataFrame, open_sources: DataFrame) -> DataFrame:
    """The bucket of each open source in which its budget ends; a source has 2^LEVEL_BITS buckets at most."""
    given = open_sources.select(F.col("source").alias("of"), "rest", F.col("before").alias("start"))
    level = level.join(given, F.col("source").eqNullSafe(F.col("of")))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(running), F.lit(0)))
    last = F.max(F.struct("bucket", "before", "words", "low", "high", "rest")).alias("b")
    return level.filter((F.col("words") > 0) & (F.col("before") < F.col("rest"))).groupBy("source").agg(last).select("source", "b.*")


def by_source(rows: DataFrame, plan: DataFrame, also: str | None = None) -> DataFrame:
    """``rows`` joined with their source's row of ``plan``; a hot source is spread over salts.

    ``also`` is a column of both that has to be equal too. Plans of few sources are broadcast by measured size.
    """
    names = {c: f"_{c}" for c in plan.columns if c in ("source", also)}
    side = plan.withColumnsRenamed(names).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.pmod("hash", F.lit(SALTS)) == F.col("_salt"))
    if also:
        same &= F.col(also) == F.col(f"_{also}")
    return rows.join(small_or_cut(side), same).drop("_salt", *names.values())


def _rows(df: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(text_col).alias("size"), row_hash(id_col, text_col).alias("hash"),
    ]


def _times() -> Column:
    """How often a row is taken, by its source's plan and its hash."""
    once_more = (F.col("hash") < F.col("edge")) | ((F.col("hash") == F.col("edge")) & F.col("with_edge"))
    return F.col("times") + F.when(once_more, 1).otherwise(0)


def shares(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """(id, size, source_size, target, times, taken) of every row; taken counts words with repeats."""
    rows = stored(df.select(*_rows(df, id_col, text_col, source_col)), "mix-rows")
    told = by_source(rows, _plan(rows, weights, most)).withColumn("times", _times())
    return told.select("id", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """The mixed table: every row of ``df`` as often as its share says, none for rows left out."""
    rows = stored(df.select(*_rows(df, id_col, text_col, source_col)[1:]), "mix-rows")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    told = by_source(df.select(whole, *_rows(df, id_col, text_col, source_col)[1:]), _plan(rows, weights, most))
    again = told.select("row", F.explode(F.array_repeat(F.lit(1), _times().cast("int"))).alias("_"))
    return again.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
