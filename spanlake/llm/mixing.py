"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame work throughout. A source's documents fall by hash into blocks, a
power of two of them. Targets are in words. Epochs whose every block is drawn
come first; of the last epoch, blocks are drawn in a permuted order until the
target is met, and the document at which it is met is cut, so that a source
yields its target to the word. The numbers of blocks drawn from all sources
form the root of a tree; each node deals half of its blocks to either child by
a multivariate hypergeometric draw, down to one exact quota vector per output
shard. Shards then take disjoint runs of each source's permuted blocks, and
order their documents by hash locally.

Sources are rows of a table, in any number. The driver sees sums over them,
and the tree of quotas, which has a column per source up to GROUPS sources;
beyond that, sources share GROUPS columns by hash. A column's blocks are
permuted before the shards cut it, so that each of its sources is dealt to all
shards.
"""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, joined_by, let, materialize, word_count

#: Weights by rank of the source in code point order, repeating (fixed values).
WEIGHTS = (5, 2, 1)
#: Words drawn in all and from one source at most, as multiples of what there is.
SHARE, CAP = 1.5, 2.0
#: Output shards; words that a block has on average, about; blocks of a source at most, as a power of two.
SHARDS, BLOCK_WORDS, MAX_BLOCK_BITS = 16, 4096, 16
#: Words that a group of drawn documents has on average, about, and groups of a shard at least.
GROUP_WORDS, LEAST_GROUPS = 1 << 21, 64
#: Columns of the tree, at most; up to so many sources are broadcast to their documents.
GROUPS = 4096


def hypergeometric(rng: np.random.Generator, good: int, other: int, draws: int) -> int:
    """How many of `draws` are good. Beyond the library's range the rounded normal law with its mean and variance."""
    if max(good, other) < 1_000_000_000:
        return int(rng.hypergeometric(good, other, draws))
    share, n = good / (good + other), good + other
    spread = (draws * share * (1 - share) * (n - draws) / max(1, n - 1)) ** 0.5
    return int(min(good, draws, max(draws - other, 0, round(rng.normal(draws * share, spread)))))


def split_tree(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, columns): exact block quotas; each node splits its blocks in proportion to the shards below it."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    take = int(quota.sum()) * left // shards
    rng = np.random.default_rng([seed, shards, int(quota.sum())])
    drawn = np.zeros_like(quota)
    after, need = int(quota.sum()), take
    for i, n in enumerate(quota.tolist()):  # multivariate hypergeometric, one column after the other
        after -= n
        drawn[i] = hypergeometric(rng, n, after, need) if need and n and after else min(n, need)
        need -= int(drawn[i])
    return np.concatenate([split_tree(drawn, left, 2 * seed + 1), split_tree(quota - drawn, shards - left, 2 * seed + 2)])


def stride_of(n: int) -> int:
    """A step without common divisor with n, next to n over the golden ratio: runs of multiples of it are spread evenly over n places."""
    return next(k for k in range(max(1, int(n * 0.6180339887)), n + 2) if gcd(k, n) == 1 or n == 0)


def row_hash(docs: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), docs["doc_id"].cast("long"), docs["text"])


def source_key(source: Column) -> Column:
    """A key that is not null, other for a null source than for any name."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def narrow_rows(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, sid, size, h): what drawing needs of each document, written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", source_key(F.col("source")).alias("sid"), word_count(F.col("text")).alias("size"), row_hash(docs, seed).alias("h"))
    return materialize(rows, "sizes")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank: its place by code point from 0, null last. Ranges are sorted apart; only their sizes are added up."""
    order = F.col("source").asc_nulls_last()
    numbered = materialize(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    counts = sorted(numbered.groupBy(part.alias("part")).count().collect())
    starts = dict(zip((r["part"] for r in counts), np.cumsum([0] + [r["count"] for r in counts]).tolist(), strict=False))
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[part] if starts else F.lit(0)
    return numbered.withColumn("rank", (start + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("at")


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (rank, source_size, ...) with target: weights share the total; what exceeds the cap is dealt anew.

    All is in one number, the words a unit of weight gets: it grows from round
    to round as capped sources leave their rest to the others.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    most = F.col("source_size") * F.lit(float(cap))
    total, all_w = sources.agg(F.sum("source_size"), F.sum(w)).first()
    unit = share * total / all_w if total else 0.0
    while total:
        over = unit * w > most
        capped, open_w = sources.agg(F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(w))).first()
        after = (share * total - capped) / open_w if open_w else unit
        if after <= unit * (1 + 1e-12):
            break
        unit = after
    return sources.withColumn("target", F.least(unit * w, most))


def plan(rows: DataFrame, shards: int = SHARDS, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source, from rows as `narrow_rows` gives them.

    sid, source_size, target, rows; blocks, factor, offset: the block
    permutation; drawn: blocks drawn whole; cut: words drawn from the block
    after those (0: none); first: where the source's run starts in its column
    of the tree; column_blocks, stride: the column's size and permutation;
    shard_ends: blocks that the shards up to each one hold of it.
    """
    spark = rows.sparkSession
    sums = rows.groupBy("sid").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = materialize(with_targets(materialize(ranked(sums), "ranked"), weights, share, cap), "targets")
    n = sources.count()
    whole = F.expr(f"source_size div {BLOCK_WORDS}")
    noise = F.xxhash64(F.lit(seed), "sid")
    table = sources.withColumns({
        "bits": F.when(whole > 0, F.least(F.lit(MAX_BLOCK_BITS), F.length(F.bin(whole)))).otherwise(0), "words": F.floor(F.col("target") + 0.5).cast("long"),
        "factor": 2 * F.pmod(noise, F.lit(1 << 20)) + 1, "offset": F.pmod(F.shiftright(noise, 20), F.lit(1 << 20)),
    })
    table = table.withColumns({"blocks": F.expr("shiftleft(1L, bits)"), "epochs": F.expr("if(source_size > 0, words div source_size, 0L)"), "rest": F.expr("if(source_size > 0, words % source_size, 0L)")})
    table = materialize(table, "permutations")
    # the block of the last epoch at which each source's target is met
    by_block = placed(rows, table, n).groupBy("sid", "position", "rest").agg(F.sum("size").alias("block_words"))
    start = F.coalesce(F.sum("block_words").over(Window.partitionBy("sid").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = by_block.withColumn("start", start).filter("start < rest AND start + block_words >= rest").select("sid", F.col("position").alias("edge"), (F.col("rest") - F.col("start")).alias("cut"))
    group = F.col("rank") if n <= GROUPS else F.pmod(F.xxhash64("sid"), F.lit(GROUPS))
    drawn = table.join(edge, "sid", "left").select(
        "sid", "source_size", "target", "rows", "blocks", "factor", "offset", group.alias("column"), (F.col("epochs") * F.col("blocks") + F.coalesce("edge", F.lit(0))).alias("drawn"), F.coalesce("cut", F.lit(0)).cast("long").alias("cut")
    )
    drawn = materialize(drawn.withColumn("taken_blocks", F.col("drawn") + (F.col("cut") > 0).cast("long")), "drawn")
    quotas = sorted(drawn.groupBy("column").agg(F.sum("taken_blocks").alias("n")).collect())  # GROUPS rows at most
    ends = np.cumsum(split_tree(np.array([r["n"] for r in quotas], np.int64), shards, seed), axis=0).T.tolist() if quotas else []
    strides = [stride_of(r["n"]) for r in quotas]
    tree = spark.createDataFrame([(r["column"], max(1, r["n"]), p, e) for r, p, e in zip(quotas, strides, ends, strict=True)], "column long, column_blocks long, stride long, shard_ends array<long>").coalesce(1)
    before = F.sum("taken_blocks").over(Window.partitionBy("column").orderBy(F.xxhash64("sid"), "sid").rowsBetween(Window.unboundedPreceding, -1))
    return materialize(drawn.withColumn("first", F.coalesce(before, F.lit(0))).join(F.broadcast(tree), "column").drop("column", "taken_blocks"), "plan")


def placed(rows: DataFrame, table: DataFrame, sources: int) -> DataFrame:
    """rows with the columns of their source's row of `table` and position: where their block stands in the permuted order.

    `table` has a row per source: up to GROUPS are broadcast; of more, those
    with many rows are, and the rest meet their rows by shuffle.
    """
    table = table.drop("source")
    joined = rows.join(F.broadcast(table.drop("rows")), "sid") if sources <= GROUPS else joined_by(rows, table, "sid", "rows", rows.count())
    block = F.col("h").bitwiseAND(F.col("blocks") - 1)
    return joined.withColumn("position", F.pmod(block * F.col("factor") + F.col("offset"), F.col("blocks")))


AT_EDGE = "(cut > 0 AND position = pmod(drawn, blocks))"
#: Parts that the block at which a target is met is summed in, so that no task sums up a large block.
PARTS = 1 << 16


def edge_words(near: DataFrame) -> DataFrame:
    """The rows of the blocks at which targets are met, from placed rows, with edge_words: how many of their first words the last epoch takes, and copy: their number among rows of equal source and hash.

    A block is summed in PARTS by further bits of the hash, then within each part.
    """
    rows = materialize(near.filter(AT_EDGE).withColumn("part", F.shiftrightunsigned("h", 40).bitwiseAND(PARTS - 1)), "edges")
    parts = rows.groupBy("sid", "part").agg(F.sum("size").alias("part_words"))
    so_far = F.sum("part_words").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("sid", "part", F.coalesce(so_far, F.lit(0)).alias("part_start"))
    run = Window.partitionBy("sid", "part").orderBy("h", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = rows.withColumns({"before": before, "copy": F.row_number().over(Window.partitionBy("sid", "part", "h").orderBy("doc_id", "size"))}).join(starts, ["sid", "part"])
    left = F.col("cut") - F.col("part_start") - F.col("before")
    return summed.withColumn("edge_words", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")).drop("part", "before", "part_start")


def draws_of(rows: DataFrame) -> DataFrame:
    """rows (placed, with edge_words) with draws: array of (epoch, shard, words, place), one for each time a row is taken.

    A draw of fewer words than size takes the document's first words. place orders a shard.
    """

    def one(epoch: Column) -> Column:
        n = F.col("blocks") * epoch + F.col("position")
        words = F.when(n < F.col("drawn"), F.col("size")).when((n == F.col("drawn")) & (F.col("cut") > 0), F.col("edge_words")).otherwise(F.lit(0))
        shard = let(F.pmod((F.col("first") + n) * F.col("stride"), "column_blocks"), lambda x: F.size(F.filter("shard_ends", lambda e: e <= x)))
        return F.struct(epoch.cast("int").alias("epoch"), shard.alias("shard"), words.cast("long").alias("words"), F.xxhash64("h", epoch).alias("place"))

    epochs = F.sequence(F.lit(0).cast("long"), F.floor(F.col("drawn") / F.col("blocks")))
    return rows.withColumn("draws", F.filter(F.transform(epochs, one), lambda d: d["words"] > 0))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 7, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, draws) for every row of docs (doc_id, source, text; others are ignored).

    Null texts have size 0 and are never drawn; a null source is a source of
    its own, last in order; rows that repeat are drawn on their own; an empty
    table, or one without words, draws nothing. Reruns agree: hashes decide.
    """
    rows = narrow_rows(docs, seed)
    table = plan(rows, shards, seed, weights)
    near = placed(rows, table, table.count())
    other = near.filter(f"NOT {AT_EDGE}").withColumn("edge_words", F.lit(0).cast("long"))
    found = draws_of(edge_words(near).drop("copy").unionByName(other))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return found.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 7, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """docs' columns, a row for each draw of `mix`, dealt to shards and shuffled inside them; cases as there.

    Documents are whole: where `mix` cuts one, it is drawn if the cut leaves
    half of its words or more, else left out. Only the rows of edge blocks
    meet a join; all others are drawn where they are read and move once, to
    their shard, in groups whose number follows the words drawn. Rows that
    repeat are numbered, in the order of their other columns, so that each has
    the draws of one of its equals in `mix`.
    """
    rows = narrow_rows(docs, seed)
    table = plan(rows, shards, seed, weights)
    n, words = table.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    name = fresh(docs, "mixed")
    whole = docs.select(F.struct(*docs.columns).alias(name), source_key(F.col("source")).alias("sid"), word_count(F.col("text")).alias("size"), row_hash(docs, seed).alias("h"))
    near = placed(whole, table, n)
    cut = edge_words(placed(rows, table, n)).select("sid", "h", "copy", "edge_words")
    copy = F.row_number().over(Window.partitionBy("sid", "h").orderBy(F.xxhash64(name)))
    edge = near.filter(AT_EDGE).withColumn("copy", copy).join(cut, ["sid", "h", "copy"]).drop("copy")
    other = near.filter(f"NOT {AT_EDGE}").withColumn("edge_words", F.lit(0).cast("long"))
    drawn = draws_of(edge.unionByName(other)).select(name, "size", F.explode("draws").alias("d")).filter("2 * d.words >= size")
    groups = max(LEAST_GROUPS, int(words // (shards * GROUP_WORDS)))
    dealt = drawn.repartition("d.shard", F.pmod("d.place", F.lit(groups))).sortWithinPartitions("d.shard", "d.place")
    return dealt.select(*[F.col(f"{name}.`{c}`").alias(c) for c in docs.columns])
