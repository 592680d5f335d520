"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are linked at two or fewer differing bits. Two differing bits leave one of the two 32-bit halves
with at most one, so each half is searched for one difference. The anchors of a half are the 2**26 words of the Hamming
code over 31 of its bits, a perfect code of covering radius 1: every pattern has one anchor within distance 1, and each
fingerprint is replicated to all anchors within 1 + 1 = 2 (one or 16). Of two linked fingerprints, the nearest anchor of
the one is thus among the anchors of the other, in one half at least, and fingerprints are compared per anchor.

Equal fingerprints are merged before they are replicated, so groups of exact copies don't meet at an anchor. Dense
groups of near copies may still crowd one: an anchor with more than ``crowd`` fingerprints is not compared in one task.
Its fingerprints go to every point within distance 1 (the whole space as code, radius 0) instead: two of them are linked
exactly if they share such a point, and a point has at most 65 members, so that this costs 65 rows for each fingerprint
however large the group is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, per_batch, rows_in, stored, texts

#: Shingles whose bits are unpacked at once, 64 bytes for each.
BLOCK = 50_000
#: Fingerprints that one task replicates, to up to 32 anchors each.
TASK_PRINTS = 20_000


def _print_of(text: bytes | None, size: int) -> int:
    """The SimHash of one text, as a signed 64-bit number."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    k = min(size, len(words))
    h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :])], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``h``, a hash of the text, of every row; a null or blank text has fingerprint zero.

    A-Z are lower-cased, words are runs of anything but 0x20 and 0x09-0x0D, a text of fewer words than a shingle is one
    shingle, repeats count, and a bit is set if it is set in over half of the shingles' XXH64 (seed 42).
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([_print_of(t, shingle) for t in texts(batch)], pa.int64()), batch.column(2)], ["doc_id", "fp", "h"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")), f, "doc_id long, fp long, h long")


def _anchors(fp: Column, half: int) -> Column:
    """The anchors within distance 2 of a fingerprint's half, with the half in bit 31."""
    x = F.shiftright(fp, 32 * half).bitwiseAND(F.lit((1 << 31) - 1))
    syndrome = F.lit(0)
    for j in range(5):  # position p, from 1 to 31, counts in check j if bit j of p is set
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)
        syndrome = syndrome + F.bit_count(x.bitwiseAND(F.lit(mask))) % 2 * (1 << j)
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << p).cast("long") for p in range(31)))
    found = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda p: F.when((p < p.bitwiseXOR(syndrome)) | ((p == 0) & (syndrome == 0)), x.bitwiseXOR(flips[p]).bitwiseXOR(flips[p.bitwiseXOR(syndrome)])),
    )
    return F.transform(F.filter(found, lambda a: a.isNotNull()), lambda a: a + F.lit(half << 31))


def replicated(prints: DataFrame) -> DataFrame:
    """``fp`` at each of its anchors."""
    return prints.select("fp", F.explode(F.concat(_anchors(F.col("fp"), 0), _anchors(F.col("fp"), 1))).alias("anchor"))


def _compared(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Links among the fingerprints of each anchor: for each linked set, its members with the set's smallest."""
    import numpy as np

    lists = batch.column(0)
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    a, b = [], []
    for k in np.unique(sizes):
        groups = np.sort(flat[starts[sizes == k][:, None] + np.arange(k)], axis=1)
        if k <= 16:
            for i in range(k - 1):
                near = np.bitwise_count((groups[:, i + 1 :] ^ groups[:, i : i + 1]).view(np.uint64)) <= 2  # of signed numbers it counts the absolute value's bits
                g, j = near.nonzero()
                a.append(groups[g, i])
                b.append(groups[g, i + 1 + j])
            continue
        for g in groups:
            near = np.bitwise_count((g[:, None] ^ g[None, :]).view(np.uint64)) <= 2
            root = np.arange(k)
            while True:  # the smallest root among the linked, until none changes
                new = np.where(near, root[None, :], k).min(axis=1)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            other = root != np.arange(k)
            a.append(g[root[other]])
            b.append(g[other])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)], ["a", "b"])


def links(prints: DataFrame, crowd: int = 512) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints ``fp`` that connect exactly those that links of two bits or fewer connect.

    A set that is connected within an anchor or a point is given as a star around its smallest member, not as all its pairs, so the two of
    a pair can be further apart than two bits.
    """
    at = replicated(prints.repartition(rows_in(prints, TASK_PRINTS)))
    crowded = stored(at.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"))
    calm = at.join(crowded, "anchor", "left_anti").groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    found = per_batch(calm.select("fps"), _compared, "a long, b long")
    bits = F.array(F.lit(0).cast("long"), *(F.lit(1 << p if p < 63 else -(1 << 63)).cast("long") for p in range(64)))
    dense = at.join(crowded, "anchor", "left_semi").select("fp").distinct()
    points = dense.select("fp", F.explode(F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b))).alias("point"))
    stars = points.groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    hubs = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where(F.col("a") != F.col("b"))
    return found.unionByName(hubs).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that it is connected to, for all nodes of ``edges`` (``a``, ``b``).

    Each round takes the smallest root among the neighbours and then the root's root, so long chains shorten fast; rounds end when no root
    changes, as they must: roots only get smaller. Every round is written to the shared folder, and the driver only learns whether one changed.
    """
    both = stored(edges.union(edges.select("b", "a")).toDF("node", "other").distinct())
    roots = stored(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("low"))
        hooked = roots.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("via"))
        jump = roots.select(F.col("node").alias("via"), F.col("root").alias("next"))
        new = stored(hooked.join(jump, "via", "left").select("node", F.least("via", F.coalesce("next", "via")).alias("root"), "was"))
        changed = new.where(F.col("root") != F.col("was")).limit(1).count()
        forget(roots)
        roots = new.select("node", "root")
        if not changed:
            forget(both)
            return roots


def _grouped(docs: DataFrame, shingle: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and for each distinct one ``fp`` its ``root``, the smallest of its component, and the least id there."""
    prints = stored(fingerprints(docs, shingle))
    merged = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(merged.select("fp"), crowd)).withColumnRenamed("node", "fp")
    return prints, merged.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, crowd: int = 512) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    ``component_id`` is the smallest ``doc_id`` that can be reached over links, its own included. Null ids are kept and
    never win unless all of a component are null (then null). Blank and null texts share fingerprint zero and are linked
    like any other. Repeated rows stay repeated. Texts are read whole, however long. An empty table gives an empty result.
    """
    prints, rooted = _grouped(docs, shingle, crowd)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, crowd: int = 512) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component exactly one row.

    It is that of the smallest id; a null id comes after all others, so of a component without ids one row stays too. Rows that share an id
    but not a text are documents of their own: each is judged within its own component, and among rows of one id in one component the least hash of
    the text decides. Of rows that repeat both, the one with the least hash of the whole row stays, so that reruns agree. Columns of any
    name are kept, blank and null texts are near-duplicates of each other, and an empty table gives an empty result.
    """
    prints, rooted = _grouped(docs, shingle, crowd)
    # brought to one row for each fingerprint before the join, so that a large group of copies is many partial minima and no large key
    first_of = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h", F.col("count").alias("n"))).alias("x")
    of_print = prints.groupBy("fp", "doc_id", "h").count().groupBy("fp").agg(first_of)
    first = of_print.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("x").alias("x"))
    keep = stored(first.select(F.coalesce("x.doc_id", F.lit(0)).alias("_id"), F.col("x.nameless").alias("_nameless"), F.col("x.h").alias("_h"), (F.col("x.n") > 1).alias("again")))
    row = F.struct("*")
    rows = docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_nameless"), F.xxhash64("text").alias("_h"))
    # one plan for all sizes: both sides shuffled by key, and the keys, a hundredth of the texts, hashed; texts are not sorted
    kept = rows.join(keep.hint("shuffle_hash"), ["_id", "_nameless", "_h"])
    once, again = kept.where("not again"), kept.where("again").groupBy("_id", "_nameless", "_h").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.select("row.*").unionByName(again.select("row.*"))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, the fingerprint as 16 hex digits and ``component_id``, for each row of what ``near_duplicates`` found."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
