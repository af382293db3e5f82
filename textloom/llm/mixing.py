"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Targets: sources in code-point order (null last) get the weights in turn and
share ``share`` times all words; a target stops at ``max_repeat`` times its
source's words and the excess is shared again by weight (water filling).

Blocks: each source is dealt by a seeded hash of id and text into shards of about
``shard_words`` words; a shard's documents, in hash order, form one stream that
is cut into blocks of ``block_words`` words. Seats (blocks to take) go to
sources by the highest quotients target / (2k - 1), then to a source's shards
in the same way by their words. A shard with n blocks and q seats takes every
block q div n times and, once more, the q mod n blocks that follow a seeded one.
What a document gives is the overlap of its words with the taken blocks, so
nothing but (id, source, size) is shuffled and no block becomes a row; as
blocks follow the hash order, nearly every document is taken whole or not.

Defined results: null and blank texts have size 0 and give 0 words; a null
source is a source of its own; repeated rows count and are taken one by one
(``mixed`` repeats rows of one id alike); null ids are told apart by their texts,
so only rows alike in both share a hash; an empty table gives an empty result; further columns
are ignored. The same rows give the same result in any order and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: str) -> DataFrame:
    """``votes`` with ``quota``: the ``seats`` of each group go to its keys by the highest quotients vote / (2k - 1).

    With V votes for N seats and m keys, the divisor in force is within m / 2N
    of V / N; seats that every divisor in that range gives are dealt at once,
    and only the few others are made rows and ranked. Ties go by key order.
    """
    w = Window.partitionBy(*group)
    x = votes.withColumn("_v", F.sum(vote).over(w)).withColumn("_m", F.count(F.lit(1)).over(w))
    live = (F.col("_v") > 0) & (F.col(seats) > 0) & (F.col(vote) > 0)
    fair = F.when(live, F.col(vote) / F.col("_v") * F.col(seats)).otherwise(0.0)
    slack = F.when(live, F.col("_m") / (2 * F.col(seats))).otherwise(0.0)
    x = x.withColumn("_low", F.greatest(F.floor(fair * (1 - slack) - 0.5), F.lit(0)).cast("long"))
    x = x.withColumn("_high", F.when(live, F.floor(fair * (1 + slack) + 1.5)).otherwise(0).cast("long"))
    more = x.where("_high > _low").withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    order = Window.partitionBy(*group).orderBy((F.col(vote) / (2 * F.col("_k") - 1)).desc(), "_k", *[F.col(k).asc_nulls_last() for k in key])
    given = x.groupBy(*group).agg(F.sum("_low").alias("_given"))
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    m, g = more.alias("m"), given.alias("g")
    ranked = m.join(g, same(more, given, group)).select("m.*", "_given") if group else more.crossJoin(given)
    won = ranked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col(seats) - F.col("_given"))
    won = won.groupBy(*key).agg(F.count(F.lit(1)).alias("_won"))
    out = x.join(won, same(x, won, key), "left").select(x["*"], "_won")
    return out.withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_v", "_m", "_low", "_high", "_won")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, max_repeat: int) -> DataFrame:
    """(source, source_size, target): one row per source, so the windows below span sources, not documents."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    by = by.withColumn("_w", w).withColumn("_cap", (F.col("source_size") * max_repeat).cast("double"))
    fill = Window.partitionBy().orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    spent = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * share - spent) / left
    by = by.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    return by.select("source", "source_size", F.least("_cap", F.col("_w") * F.col("_level")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2, block_words: int = 8, shard_words: int = 1 << 18, seed: int = 20240, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs``."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("_hash"))
    sized = written(sized, "mix-sizes")
    sources = source_targets(sized, weights, share, max_repeat).withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    sources = written(sainte_lague(sources, [], ["source"], "target", "_seats").drop("_seats"), "mix-sources")
    d = sized.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    d = d.withColumn("_shard", F.pmod(F.shiftright("_hash", 20), F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_words)))
    shard = Window.partitionBy("source", "_shard")
    stream = shard.orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_from", F.coalesce(F.sum("size").over(stream), F.lit(0))).withColumn("_words", F.sum("size").over(shard)).drop("_hash")
    shards = d.groupBy("source", "_shard").agg(F.max("_words").alias("_words"), F.max("quota").alias("_seats"))
    shards = sainte_lague(shards, ["source"], ["source", "_shard"], "_words", "_seats")
    shards = shards.select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "quota")
    d = d.drop("quota").join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h"))).drop("_s", "_h")
    blocks = F.greatest(F.ceil(F.col("_words") / block_words).cast("long"), F.lit(1))
    d = d.withColumn("_n", blocks).withColumn("_q", F.least("quota", max_repeat * F.col("_n")))
    d = d.withColumn("_turns", F.floor(F.col("_q") / F.col("_n"))).withColumn("_extra", F.col("_q") % F.col("_n"))
    # The extra blocks run on from a seeded one, past the end to the start: documents in hash order, nearly all of them whole.
    first = F.pmod(F.xxhash64(F.lit(seed + 1), "source", "_shard"), F.col("_n"))
    ends = F.col("_from") + F.col("size")
    within = lambda a, b: F.greatest(F.least(ends, b * block_words) - F.greatest(F.col("_from"), a * block_words), F.lit(0))
    more = within(first, first + F.col("_extra")) + within(F.lit(0), first + F.col("_extra") - F.col("_n"))
    taken = F.when(F.col("size") > 0, F.col("size") * F.col("_turns") + more).otherwise(0).cast("long")
    return d.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, to the nearest whole time; rows of size 0 stay once."""
    rows = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    # Rows that share an id share their number of times, the largest that one of them has.
    times = rows.groupBy(F.col("doc_id").alias("_mix_id")).agg(F.max(times).alias("_mix_n"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col(f"`{id_col}`").alias("id"))
    out = packed.join(times, F.col("id").eqNullSafe(F.col("_mix_id"))).where("_mix_n > 0")
    return out.select("all", F.explode(F.sequence(F.lit(1), "_mix_n"))).select("all.*")
