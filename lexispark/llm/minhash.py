"""MinHash near-duplicate detection with fast similarity sketching.

A document's set of word shingles is thrown at ``coords`` bins in rounds; a bin keeps
the least (round, hash) that fell into it.  The first ``coords`` rounds hash each
element to a bin, the next ``coords`` rounds force one bin each, so every coordinate
fills, with the concentration bounds of independent hashing, after about one pass for
sets larger than ``coords * log(coords)``.  Runs of coordinates are the band keys.

Every link that is returned has been confirmed on the full sets.  Equal sets meet by a
digest first.  A band bucket is then read as stars (each member against one hub, with
another hub in every round) and at last, where a bucket still spans several components,
in blocks of members against members, so a bucket never becomes all pairs of rows.  Buckets
around the same component are read as one there, so a set is not copied for each of its bands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_split, mark_likely, table
from .components import grow_components
from .textvec import mix, pieces, shingle_set, windows

COORDS, ROWS = 240, 6
HUB_ROUNDS = 3
#: A side of a block has about so many sets, or so many bytes of them, at most.
BLOCK, BLOCK_BYTES = 1024, 8 << 20

_FREE = np.uint64(2**64 - 1)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def _salts(coords: int) -> np.ndarray:
    return mix(np.arange(1, 2 * coords + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(items: np.ndarray, coords: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty array of distinct 64-bit items."""
    salts = _salts(coords)
    best = np.full(coords, _FREE)
    step = int(coords * (np.log(coords) + 2) / len(items)) + 1
    done = 0
    while done < coords:
        rounds = min(step, coords - done)
        h = mix(items[None, :] ^ salts[done : done + rounds, None])
        bins = ((h >> _32) * np.uint64(coords)) >> _32
        value = (h & _LOW) | (np.arange(done, done + rounds, dtype=np.uint64) << _32)[:, None]
        np.minimum.at(best, bins.ravel().astype(np.int64), value.ravel())
        done += rounds
        if not (best == _FREE).any():
            return best
        step = max(1, step // 4)
    for k in np.flatnonzero(best == _FREE):
        best[k] = (mix(items ^ salts[coords + k]) & _LOW).min() | (np.uint64(coords + k) << _32)
    return best


def band_keys(items: np.ndarray, coords: int, rows: int) -> np.ndarray:
    bands = sketch(items, coords).reshape(-1, rows)
    key = mix(np.arange(len(bands), dtype=np.uint64))
    for k in range(rows):
        key = mix(key ^ bands[:, k])
    return key


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for p in pieces(batch.column("text")):
            h = p.word_hashes(lower=True)
            # all windows of the piece at once; those across two documents are never looked at
            w = windows(h, size)
            found = []
            for a, b in zip(p.first_word[:-1], p.first_word[1:], strict=True):
                found.append(np.unique(w[a : b - size + 1]) if b - a >= size else shingle_set(h[a:b], size))
            yield *(batch.column(c).slice(p.first, p.rows) for c in ("doc_id", "mark")), found


def _digest(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _sketches(batches: Iterator[pa.RecordBatch], size: int, coords: int, rows: int) -> Iterator[pa.RecordBatch]:
    for ids, marks, sets in _sets(batches, size):
        some = [s for s in sets if len(s)]
        keys = np.concatenate([band_keys(s, coords, rows) for s in some]) if some else np.zeros(0, np.uint64)
        filled = np.array([len(s) > 0 for s in sets], bool)
        offsets = np.concatenate([[0], np.cumsum(filled * (coords // rows))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [ids, marks, pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, keys.view(np.int64))],
            ["doc_id", "mark", "n_shingles", "digest", "bands"],
        )


def _set_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for _, _, sets in _sets(batches, size):
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "items"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x & y| >= percent * |x | y| for sorted distinct arrays."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The matrix of intersection sizes, from 0/1 matrices over slices of the joint vocabulary."""
    items = np.concatenate(left + right)
    order = np.argsort(items)
    items = items[order]
    same = np.append(items[1:] == items[:-1], False)[: len(items)]
    # an item of one set alone is in no intersection
    shared = np.flatnonzero(same | np.roll(same, 1))
    items, order = items[shared], order[shared]
    code = np.cumsum(np.append(False, items[1:] != items[:-1])[: len(items)], dtype=np.int32)
    row = np.repeat(np.arange(len(left) + len(right), dtype=np.int32), [len(s) for s in left + right])[order]
    del items, order, same, shared
    out = np.zeros((len(left), len(right)), np.float32)
    width = max(1, (1 << 22) // (len(left) + len(right) + 1))  # 16 MiB of 0/1
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [start, start + width])
        has = np.zeros((len(left) + len(right), width), np.float32)
        has[row[a:b], code[a:b] - start] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out.astype(np.int64)


def _block(t: pa.Table, percent: int) -> pa.Table:
    """Links between the two sides of a block that join different components, a forest of them."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("items")]  # no copies: sets may be large
    side = t.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    edges = []
    if len(left) and len(right):
        size = np.array([len(s) for s in sets])
        common = overlaps([sets[i] for i in left], [sets[i] for i in right])
        hit = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
        comp, node = t.column("comp").to_numpy(), t.column("node").to_numpy()
        hit &= comp[left][:, None] != comp[right][None, :]
        root = {c: c for c in comp}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i, j in zip(*np.nonzero(hit), strict=True):
            a, b = find(comp[left[i]]), find(comp[right[j]])
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((node[left[i]], node[right[j]]))
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(partial(_confirm, percent=percent), "a long, b long")


def _open_buckets(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node, comp): members of the buckets that span several components."""
    at = table(members.select("key", "node").join(comps, "node").select("key", "node", F.col("component").alias("comp")))
    spread = at.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "n")
    return table(join_split(at, table(spread), "key", at.count()).drop("n"))


def _groups(docs: DataFrame, shingle: int, percent: int, coords: int, rows: int) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) for each document; mark is a hash of its text.

    Distinct sets are the nodes that are linked, each known by a number, so a doc_id that comes
    with several texts joins nothing.  A component is named by the least doc_id of its nodes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    schema = "doc_id long, mark long, n_shingles long, digest binary, bands array<long>"
    found = table(docs.mapInArrow(partial(_sketches, size=shingle, coords=coords, rows=rows), schema))
    same = found.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    nodes = table(same.withColumn("node", F.monotonically_increasing_id()))

    keys = nodes.select("node", F.explode("bands").alias("key"))
    n_keys = nodes.count() * (coords // rows)
    buckets = table(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n >= 2"))
    members = table(join_split(keys, buckets, "key", n_keys))
    wanted = table(members.select("node").distinct().join(nodes.select("node", "rep", "digest"), "node"))
    # texts stay where they lie; a set that was asked for in vain goes in the join by digest
    texts = mark_likely(docs, F.xxhash64("doc_id"), wanted.select(F.xxhash64("rep")).distinct()).where("__likely").select("doc_id", "text", "mark")
    items = texts.mapInArrow(partial(_set_rows, size=shingle), "digest binary, items binary").groupBy("digest").agg(F.first("items").alias("items"))
    sets = table(items.join(wanted.select("digest", "node"), "digest").select("node", "items", F.octet_length("items").alias("bytes")))

    pairs = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    comps = wanted.select("node", F.col("node").alias("component"))
    comps = grow_components(comps, table(_links(pairs, sets, percent)))
    left = _open_buckets(members.where("n >= 3"), comps)
    for k in range(1, HUB_ROUNDS):
        if left.isEmpty():
            break
        order = F.struct(F.xxhash64("node", F.lit(k)).alias("order"), F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
        hubs = table(left.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("h")))
        at = join_split(left, hubs, "key", left.count()).where("comp <> h.hub_comp")
        pairs = table(at.select(F.col("node").alias("a"), F.col("h.hub").alias("b")).distinct())
        comps = grow_components(comps, table(_links(pairs, sets, percent)))
        left = _open_buckets(left, comps)
    if not left.isEmpty():
        comps = grow_components(comps, _across(left, sets, percent))

    at = table(nodes.select("digest", "node", "rep", "n").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = table(at.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    named = join_split(at.withColumnRenamed("n", "n_rows"), least, "component", at.count()).select("digest", "component_id", F.col("n_rows").alias("n"))
    return join_split(found.select("doc_id", "mark", "n_shingles", "digest"), table(named), "digest", found.count(), "left")


def _component() -> Column:
    return F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coords: int = COORDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered; a document's set is its
    distinct ``shingle``-word shingles, or the whole sequence when it has fewer words.
    Documents with 100 * intersection >= percent * union are linked, and component_id is the
    smallest doc_id that links reach.  kept is doc_id = component_id.

    Null or wordless text: an empty set, linked with nothing, kept.  Null doc_id: never linked,
    component_id null, kept.  Rows that repeat a doc_id and a text are all returned alike; rows
    that repeat a doc_id with other text are each judged by their own text.  Only doc_id and
    text are read, so further columns do no harm.  No rows give no rows.
    """
    out = _groups(docs, shingle, percent, coords, rows)
    return out.select("doc_id", "n_shingles", _component().alias("component_id"), F.coalesce(F.col("doc_id") == _component(), F.lit(True)).alias("kept"))


def _blocks(left: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pool, i, j, side, node, comp): blocks in which all members of a bucket meet that are of different components.

    ``left`` has (key, node, comp), ``sizes`` (node, bytes).  In a bucket, members outside its main
    component (side 0) meet all (side 1).  Buckets of one main component are pooled where that copies less.
    """
    rows, cut = left.count(), lambda n, b: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(b) / BLOCK_BYTES, F.lit(1))).cast("int")
    copied = F.col("minor_bytes") * F.col("down") + F.col("all_bytes") * F.col("up")
    in_comps = left.join(sizes, "node").groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("bytes").alias("b"))
    best = F.max(F.struct("m", "b", (-F.col("comp")).alias("c"))).alias("best")
    keys = in_comps.groupBy("key").agg(best, F.sum("m").alias("n"), F.sum("b").alias("all_bytes"))
    keys = keys.select("key", "n", "all_bytes", (-F.col("best.c")).alias("main"), (F.col("n") - F.col("best.m")).alias("minor"), (F.col("all_bytes") - F.col("best.b")).alias("minor_bytes"))
    keys = table(keys.withColumns({"up": cut("minor", "minor_bytes"), "down": cut("n", "all_bytes")}).select("key", "n", "main", copied.alias("copied")))
    named = table(join_split(left, keys, "key", rows).select("key", "main", "node", "comp"))

    def shapes(members: DataFrame, *by: str) -> DataFrame:
        outside = F.col("comp") != F.col("main")
        sums = members.join(sizes, "node").groupBy(*by).agg(
            F.count("*").alias("n"), F.count_if(outside).alias("minor"), F.sum("bytes").alias("all_bytes"), F.sum(F.when(outside, F.col("bytes")).otherwise(0)).alias("minor_bytes")
        )
        return sums.withColumns({"up": cut("minor", "minor_bytes"), "down": cut("n", "all_bytes")})

    apart = keys.groupBy("main").agg(F.sum("copied").alias("apart"), F.sum("n").alias("n"))
    pooled = shapes(named.select("main", "node", "comp").distinct(), "main").select("main", copied.alias("together"))
    plan = table(apart.join(pooled, "main").select("main", "n", (F.col("together") <= F.col("apart")).alias("pooled")))
    pool = F.when(F.col("pooled"), F.concat(F.lit("m"), F.col("main"))).otherwise(F.concat(F.lit("k"), F.col("key"))).alias("pool")
    members = table(join_split(named, plan, "main", rows).select(pool, "main", "node", "comp").distinct())
    shape = table(shapes(members, "pool").select("pool", "n", "up", "down"))
    at = table(join_split(members, shape, "pool", members.count()))
    spot = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    minor = at.where("comp <> main").select("pool", "node", "comp", F.lit(0).alias("side"), spot("up", "up").alias("i"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("j"))
    every = at.select("pool", "node", "comp", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("up") - 1)).alias("i"), spot("down", "down").alias("j"))
    return minor.unionByName(every)


def _across(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of a bucket: members outside its main component against all, in blocks."""
    blocks = _blocks(left, sets.select("node", "bytes")).join(sets.select("node", "items"), "node")

    def forest(block: pa.Table) -> pa.Table:
        return _block(block, percent)

    return table(blocks.groupBy("pool", "i", "j").applyInArrow(forest, "a long, b long"))


def keep_representatives(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that are near-duplicates of one of smaller doc_id; same columns.

    Rows of null doc_id stay.  Rows that repeat a doc_id are each judged by their own text; rows
    that repeat a doc_id and its text stay or go together.
    """
    gone = table(_groups(docs, shingle, percent, COORDS, ROWS).where(F.col("doc_id") != _component()).select(F.col("doc_id").alias("__i"), F.col("mark").alias("__m")).distinct())
    doc_id, mark = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    # only rows that are likely to go are shuffled with their texts
    seen = mark_likely(docs, F.xxhash64(doc_id, mark), gone.select(F.xxhash64("__i", "__m")))
    checked = seen.where("__likely").join(gone, (doc_id == F.col("__i")) & (mark == F.col("__m")), "left_anti")
    return seen.where("not __likely").select(*docs.columns).union(checked.select(*docs.columns))
