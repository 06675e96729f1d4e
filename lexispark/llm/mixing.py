"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source are dealt into blocks by the leading bits of a hash, and a source's
blocks are taken in hash order until its target is met, the last block only in part.  The
block quotas of all sources are then split down a binary tree over the output shards: each
node draws, without replacement from an urn, how many of its blocks of each source go left.
A shard so gets exact counts of every source, takes that many of the source's permuted
blocks, no block twice, and is shuffled on its own.  All of it is DataFrame and SQL work.

A node's draw is made in two steps, over groups of sources and then inside each group, so no
row holds more than about the square root of the number of sources.  Windows run over the
blocks of a source (at most 2**BLOCK_BITS), over the as many cells of a block that is taken
in part, and over the distinct documents of the one cell where it ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, sums_before, table
from .shards import BITS, hash_bits

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS, BLOCK_BITS = 1024, 10
LEVELS = 4
SEED = 20240611


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code point order, null last, weigh ``weights`` in turn.  They share ``share`` of
    all sizes by weight; a target stops at ``most`` times its source's size and what is over is
    shared again.  That is water filling: in order of cap per weight, sources are at their caps
    up to the first whose cap exceeds the level of the rest.
    """
    every = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    last = F.col("source").asc_nulls_last()
    kinds = F.array(*map(F.lit, weights))
    ranked = sums_before(every, [last], {"rank": F.lit(1)}).withColumn("weight", kinds[(F.col("rank") % len(weights)).cast("int")])
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("steep", F.col("cap").cast("double") / F.col("weight"))
    filled = table(sums_before(ranked, [F.col("steep").asc(), last], {"caps": F.col("cap"), "weights": F.col("weight"), "pos": F.lit(1)}))
    words, weight = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (share * F.lit(words or 0) - F.col("caps")) / (F.lit(weight or 0) - F.col("weights"))
    rest = filled.where(F.col("steep") >= level).agg(F.min_by(level, "pos")).first()[0]
    cap = F.col("cap").cast("double")
    return filled.select("source", "source_size", (cap if rest is None else F.least(cap, F.col("weight") * F.lit(rest))).alias("target"))


def _blocks(placed: DataFrame) -> DataFrame:
    """Per (source, block): how many epochs take it whole, and the words of a partial one."""
    sums = placed.groupBy("source", "block", "source_size", "target").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("block"))
    out = sums.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("words"))
    quota = [F.least(F.greatest(F.col("target") - e * F.col("source_size"), F.lit(0.0)), F.col("source_size").cast("double")) for e in range(MOST)]
    full = sum(((q > 0) & (F.col("upto") <= q)).cast("int") for q in quota)
    part = F.lit(None).cast("double")
    for q in quota:
        part = F.when((F.col("from") < q) & (q < F.col("upto")), q - F.col("from")).otherwise(part)
    return out.select("source", "block", full.alias("full"), part.alias("part"))


def _limits(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source, block, limit) of blocks taken in part: documents below (h, size) in order go along, and k of those at it.

    A document goes along while its middle is within the words that are left.  Copies of one
    document are one row here, and are counted out.
    """
    cut = blocks.where("part is not null").select(F.col("source").alias("s"), F.col("block").alias("b"), "part")
    cell = F.expr(f"shiftright(h, {BITS - BLOCK_BITS} - bits)")
    rows = table(placed.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select("source", "block", "bits", "part", "h", "size", cell.alias("cell")))
    cells = rows.groupBy("source", "block", "part", "cell").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source", "block").orderBy("cell"))
    ends = cells.withColumn("upto", upto).where("upto > part").groupBy("source", "block").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("from"))).alias("end"))
    ends = ends.select(F.col("source").alias("s"), F.col("block").alias("b"), "end")
    near = rows.join(table(ends), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & (F.col("cell") == F.col("end.cell")))
    each = near.groupBy("source", "block", "bits", "part", "end", "h", "size").agg(F.count("*").alias("n"))
    order = W.partitionBy("source", "block").orderBy("h", "size").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("before", F.col("end.from") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0)))
    fits = F.when(F.col("size") > 0, F.floor((2 * F.col("part") - 2 * F.col("before") + F.col("size")) / (2 * F.col("size")))).otherwise(F.when(F.col("before") < F.col("part"), F.col("n")).otherwise(0))
    each = each.withColumn("k", F.greatest(F.lit(0), F.least(fits, F.col("n"))).cast("long"))
    stop = F.min(F.when(F.col("k") < F.col("n"), F.struct("h", "size", "k", "n")))
    end = F.expr(f"named_struct('h', shiftleft(end.cell + 1, {BITS - BLOCK_BITS} - bits), 'size', 0L, 'k', 0L, 'n', 0L)")
    return each.groupBy("source", "block").agg(F.coalesce(stop, F.first(end)).alias("limit"))


def _draw(quotas: str, lack: str, urn: str, seed: int) -> Column:
    """How many of each of the urn's quotas are among ``lack`` blocks drawn from it without replacement.

    Block by block, one is drawn with the probability of what is lacking over what is left.
    """
    unit = f"cast(conv(substr(md5(concat_ws('/', '{seed}', {urn}, u.n)), 1, 13), 16, 10) AS bigint) / {float(1 << 52)!r}D"
    return F.expr(f"""aggregate({quotas},
      named_struct('n', aggregate({quotas}, 0L, (a, x) -> a + x), 'lack', {lack}, 'out', cast(array() as array<bigint>)),
      (s, q) -> aggregate(if(q > 0, sequence(1L, q), cast(array() as array<bigint>)),
        named_struct('n', s.n, 'lack', s.lack, 'x', 0L),
        (u, i) -> if({unit} * u.n < u.lack,
          named_struct('n', u.n - 1L, 'lack', u.lack - 1L, 'x', u.x + 1L),
          named_struct('n', u.n - 1L, 'lack', u.lack, 'x', u.x)),
        u -> named_struct('n', u.n, 'lack', u.lack, 'out', concat(s.out, array(u.x)))),
      s -> s.out)""")


def group_of(source: str, groups: int) -> Column:
    """The group of a source in the draws, by a hash of its name."""
    return (F.conv(F.substring(F.md5(F.coalesce(F.col(source).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % groups).cast("int")


def split_quotas(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(source, shard, quota): (source, quota) rows split among 2**levels shards by the tree.

    Every level halves each node by the multivariate hypergeometric draw: first how many blocks
    of each group of sources go left, then which sources of the group they are from.  Quotas are
    kept exactly and shards differ by one block.
    """
    groups = max(1, math.isqrt(max(0, quotas.count() - 1)) + 1)
    kinds = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "quota")))
    rows = quotas.withColumn("g", group_of("source", groups)).groupBy("g").agg(kinds.alias("all"))
    rows = rows.select(F.lit(0).cast("long").alias("node"), "g", F.col("all.source").alias("sources"), F.col("all.quota").alias("q"))
    for _ in range(levels):
        rows = table(rows.withColumn("total", F.expr("aggregate(q, 0L, (a, x) -> a + x)")))
        nodes = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("g", "total"))).alias("all"), F.sum("total").alias("n"))
        drawn = nodes.select("node", F.col("all.g").alias("g"), _draw("all.total", "n div 2", "node", seed).alias("lack"))
        lacks = drawn.select("node", F.explode(F.arrays_zip("g", "lack")).alias("z")).select("node", F.col("z.g").alias("g"), F.col("z.lack").alias("lack"))
        inside = rows.join(lacks, ["node", "g"]).withColumn("left", _draw("q", "lack", "concat(node, '/', g)", seed))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(q, left, (a, b) -> a - b)").alias("q")))
        rows = inside.select("g", "sources", F.explode(sides).alias("side")).select("side.node", "g", "sources", "side.q")
    return table(rows).select("node", F.explode(F.arrays_zip("sources", "q")).alias("z")).select(F.col("z.sources").alias("source"), F.col("node").alias("shard"), F.col("z.q").alias("quota"))


def plan_mix(docs: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and copies: an array of (epoch, shard), one for each time the mix takes the row.

    See mix_sources for the cases; the columns size, source_size, target and copies are replaced if docs has them.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    keyed = docs.withColumn("size", word_count()).withColumn("__h", hash_bits())
    sizes = table(keyed.select("source", "size", F.col("__h").alias("h")))
    # 2**bits blocks for a source: as many as it has BLOCK_WORDS, up to the bound
    bits = F.expr(f"size(filter(sequence(0, {BLOCK_BITS - 1}), k -> {BLOCK_WORDS}L * shiftleft(1L, k) < source_size))")
    named = table(source_targets(sizes).select(F.col("source").alias("s"), "source_size", "target", bits.alias("bits")))
    placed = sizes.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", F.expr(f"shiftright(h, {BITS} - bits)"))
    blocks = table(_blocks(placed))

    # one row for each time a block is taken, in a random order within its source
    taken = blocks.select("source", "block", F.explode(F.expr("transform(filter(sequence(1, 2), e -> e <= full + if(part is null, 0, 1)), e -> named_struct('epoch', e - 1, 'partial', e > full))")).alias("x")).select("source", "block", "x.epoch", "x.partial")
    turn = W.partitionBy("source").orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), "block", "epoch")), "block", "epoch")
    taken = table(taken.withColumn("rank", F.row_number().over(turn).cast("long")))
    quotas = split_quotas(table(taken.groupBy("source").agg(F.count("*").alias("quota"))), levels, seed)
    upto = F.sum("quota").over(W.partitionBy("source").orderBy("shard"))
    owner = quotas.withColumn("upto", upto).where("quota > 0").select(F.col("source").alias("s"), "shard", F.explode(F.expr("sequence(upto - quota + 1, upto)")).alias("r"))
    dealt = taken.join(owner, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r")))
    homes = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "partial"))).alias("__homes"))
    limits = _limits(placed, blocks).select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("limit").alias("__limit"))
    homes = homes.join(limits, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    homes = table(homes.select(F.col("source").alias("__hs"), F.col("block").alias("__hb"), "__homes", "__limit"))

    # beside the columns of docs, of whatever names, only names of our own
    named = named.select(F.col("s").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("bits").alias("__bits"))
    out = keyed.join(named, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__b", F.expr(f"shiftright(__h, {BITS} - __bits)"))
    out = out.join(homes, F.col("source").eqNullSafe(F.col("__hs")) & (F.col("__b") == F.col("__hb")), "left")
    at_limit = F.coalesce(F.expr("__h = __limit.h AND size = __limit.size AND __limit.k > 0"), F.lit(False))
    below = F.expr("__h < __limit.h OR (__h = __limit.h AND size < __limit.size)")
    if homes.where("__limit.k > 0").isEmpty():
        out = out.withColumn("__goes", below)
    else:
        out = out.where(~at_limit).withColumn("__goes", below).unionByName(_first_copies(out.where(at_limit)))
    copies = F.expr("transform(filter(coalesce(__homes, array()), x -> not x.partial or coalesce(__goes, false)), x -> named_struct('epoch', x.epoch, 'shard', x.shard))")
    return out.select(*docs.columns, "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"))


def _first_copies(same: DataFrame) -> DataFrame:
    """Rows that repeat a document at a block's limit, with __goes for the first __limit.k of each."""
    order = [F.col("__s").asc_nulls_last(), F.col("__h").asc(), F.col("__row").asc()]
    counted = table(sums_before(same.withColumn("__row", F.monotonically_increasing_id()), order, {"__no": F.lit(1)}))
    starts = counted.groupBy(F.col("__s").alias("__ts"), F.col("__h").alias("__th")).agg(F.min("__no").alias("__first"))
    out = counted.join(starts, F.col("__s").eqNullSafe(F.col("__ts")) & (F.col("__h") == F.col("__th")))
    return out.withColumn("__goes", F.col("__no") - F.col("__first") < F.col("__limit.k")).drop("__row", "__no", "__ts", "__th", "__first")


def mix_sources(docs: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """The mix: docs with mix_epoch, mix_shard and mix_order, a row for each time it is taken.

    Sort a shard by mix_order to shuffle it locally.  A source's words come within half of one
    document of its target; no document is taken more than twice; reruns agree, since all draws
    hash the row's doc_id and text.  Null text counts 0 words; such rows come along with their
    block.  Null source is a source of its own, the last.  A source of no words has target 0 and
    is not taken.  Of rows that repeat a doc_id and text where the last block ends, only as many
    go along as fit, whichever they are.  No rows give no rows.
    """
    planned = plan_mix(docs, levels, seed)
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "mix_epoch", "mix_shard", "mix_order")]
    taken = planned.select(*keep, F.explode("copies").alias("__c"))
    order = F.xxhash64(F.lit(seed), F.col("__c.shard"), F.col("__c.epoch"), hash_bits())
    return taken.select(*keep, F.col("__c.epoch").alias("mix_epoch"), F.col("__c.shard").alias("mix_shard"), order.alias("mix_order"))
