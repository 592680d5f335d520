"""The prefix trie of conversations: which of them share their first turns, and what storing each shared prefix once would save.

Turns are sorted by ranges of (conversation, turn), and each task scans its rows with numpy: a turn's place and a polynomial rolling fingerprint of all turns up
to it. A conversation that lies in several ranges gets the sums of the ranges before added, so a long one isn't one task's work. Equal depth
and fingerprint make a group of candidates; its representative is the smallest conversation, and each member is held against it turn by turn: its last turn's digest
and the fingerprint before must be the representative's, at every depth. Conversations of groups that fail are split exactly, by parent and last turn. Subtrees
are rolled up to the parents by pointer doubling, over shared nodes alone: what only one conversation has needs no sums.
Texts are never moved: a turn is its SHA-256 over role and text from the first step on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, stored

#: Turns that a conversation may take from the one that its hundred shares.
HEAD = 5
#: Two moduli below 2^31, so that products fit into 64 bits, and a base for each (any numbers would do).
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_180_591_621, 912_559_153)
#: Characters of role and text by which turns of one number are put in order before their digests are.
ORDER_CHARS = 64


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, what orders its turns, ``sha`` (SHA-256 of role and text, the role's length before them) and ``n``, the text's code points. Null role or text is empty; rows without a conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    head = F.struct(F.substring(role, 1, ORDER_CHARS).alias("role"), F.substring(text, 1, ORDER_CHARS).alias("text"))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), head.alias("head"), sha.alias("sha"), F.length(text).cast("long").alias("n"))


def _powers(n: int, base: int, modulus: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo the modulus, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, modulus)) % np.uint64(modulus)
        have += more
    return out[:n]


def scan(conv: np.ndarray, values: np.ndarray, before: tuple[int, int, list[int]], moduli: tuple[int, ...] = MODULI) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places and prefix sums of ``values`` times powers of the bases, along rows that are sorted by ``conv``.

    ``before`` are the conversation, number of turns and sums of the rows before these. Sums are of the value times base^place, so stretches can be joined by addition.
    """
    at = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    length = np.diff(np.r_[at, len(conv)])
    first = np.zeros(len(at), np.int64)
    if len(at) and conv[0] == before[0]:
        first[0] = before[1]
    place = np.arange(len(conv)) - np.repeat(at - first, length) + 1
    sums = []
    for k, (base, modulus) in enumerate(zip(BASES, moduli)):
        m = np.uint64(modulus)
        powers = _powers(int((place - np.repeat(first, length)).max(initial=0)) + 1, base % modulus, modulus)
        x = values % m * powers[place - np.repeat(first, length)] % m
        start = np.array([pow(base, int(f), modulus) if f else 1 for f in first], np.uint64)  # only the first may go on
        x = x * np.repeat(start, length) % m
        total = np.cumsum(x)  # below 2^31 times the rows of a batch
        base_of = np.r_[np.uint64(0), total[at[1:] - 1]] if len(at) else total
        x = total - np.repeat(base_of, length)
        if len(at) and conv[0] == before[0]:
            x[: length[0]] += np.uint64(before[2][k])
        sums.append(x % m)
    return place, sums


def scanned(rows: DataFrame, order: list[str], moduli: tuple[int, ...] = MODULI) -> DataFrame:
    """``rows`` (with ``conv_id``, ``sha`` and ``n``) in the order of ``conv_id``, ``order`` and ``sha``: ``place`` from 1 and ``fp``, the fingerprint of all turns up to it.

    Rows are dealt to ranges; those of a conversation that began in an earlier range get its turns and sums added. Only conversations at the edges of ranges do, so what is broadcast has
    at most two rows for each range.
    """
    local = "conv_id long, sha binary, n long, place long, s1 long, s2 long, part int"
    names = [c.split()[0] for c in local.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int | None, int, list[int]] = (None, 0, [0, 0])
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            sha = batch.column(1).to_pylist()
            values = np.frombuffer(b"".join(x[:8] for x in sha), "<u8")
            place, sums = scan(conv, values, before, moduli)
            before = (int(conv[-1]), int(place[-1]), [int(s[-1]) for s in sums])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(place), *(pa.array(s.astype(np.int64)) for s in sums), batch.column(3)], names)

    ranged = rows.repartitionByRange(F.col("conv_id"), *(F.col(c) for c in order)).withColumn("part", F.spark_partition_id())
    done = stored(ranged.sortWithinPartitions("conv_id", *order, "sha").select("conv_id", "sha", "n", "part").mapInArrow(run, local))
    # conversations that begin in one range and go on in another
    edges = done.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    over = edges.select(F.col("low").alias("conv_id"), "part").union(edges.select("high", "part")).distinct()
    over = over.join(over.groupBy("conv_id").agg(F.count("*").alias("ranges")).where("ranges > 1"), "conv_id").select("conv_id", "part")
    totals = done.join(F.broadcast(over), ["conv_id", "part"]).groupBy("conv_id", "part").agg(F.max("place").alias("place"), F.max_by(F.struct("s1", "s2"), "place").alias("s"))

    def carry(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("part")
        n, sums, out = 0, [0, 0], []
        for conv, part, place, s1, s2 in zip(some.conv_id, some.part, some.place, some.s1, some.s2):
            powers = [pow(b, n, m) for b, m in zip(BASES, moduli)]
            out.append((conv, part, n, *powers, *sums))
            sums = [(a + s * p) % m for a, s, p, m in zip(sums, (int(s1), int(s2)), powers, moduli)]
            n += int(place)
        return pd.DataFrame(out, columns=["conv_id", "part", "n0", "p1", "p2", "c1", "c2"])

    flat = totals.select("conv_id", "part", "place", "s.s1", "s.s2")
    carried = flat.groupBy("conv_id").applyInPandas(carry, "conv_id long, part int, n0 long, p1 long, p2 long, c1 long, c2 long")
    x = done.join(F.broadcast(stored(carried)), ["conv_id", "part"], "left")
    whole = [F.when(F.col("n0").isNull(), F.col(s)).otherwise((F.col(s) * F.col(p) % m + F.col(c)) % m) for s, p, c, m in (("s1", "p1", "c1", moduli[0]), ("s2", "p2", "c2", moduli[1]))]
    fp = F.shiftleft(whole[0], 31).bitwiseOR(whole[1])
    return x.select("conv_id", "sha", "n", (F.col("place") + F.coalesce("n0", F.lit(0))).alias("place"), fp.alias("fp"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conv_ids, and the turns of each rebuilt conversation: the first h of the conversation that its hundred begins with, then its own after its first h; ``h`` is the id's crc32 modulo 6.

    Both stored: ``conv_id``; and ``conv_id``, ``own`` (whether the turn is its own), ``place`` (where it stood), ``sha``, ``n``.
    """
    numbered = stored(scanned(turns(conversations), ["turn", "head"]).drop("fp"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("long")
    ids = stored(numbered.select("conv_id").distinct())
    lent = numbered.where((F.col("conv_id") % 100 == 0) & (F.col("place") <= HEAD)).withColumnRenamed("conv_id", "base")
    taken = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(lent, "base").where(F.col("place") <= h)
    own = numbered.where(F.col("place") > h)
    each = lambda df, mine: df.select("conv_id", F.lit(mine).alias("own"), "place", "sha", "n")
    return ids, each(own, True).unionByName(each(taken, False))


def classes(prefixes: DataFrame) -> DataFrame:
    """A stored row for each prefix that a conversation has: ``conv_id``, ``depth``, ``sha``, ``n``, ``rep``, the smallest conversation with that prefix, and ``up``, the smallest with the prefix before (null at depth 1).

    ``prefixes`` has ``conv_id``, ``place``, ``sha``, ``n``, ``fp``. Groups of one depth and fingerprint are held against their representative: last turn and the fingerprint before must
    agree. If every group of a conversation does, from the first turn on, its groups are exact. Of the others, from the first depth that fails, groups are made by representative of the parent and turn.
    """
    before = prefixes.select("conv_id", (F.col("place") + 1).alias("place"), F.col("fp").alias("fp_before"))
    rows = stored(prefixes.join(before, ["conv_id", "place"], "left").withColumnRenamed("place", "depth").withColumn("fp_before", F.coalesce("fp_before", F.lit(0).cast("long"))))
    first = F.min(F.struct("conv_id", "sha", "fp_before"))
    groups = stored(rows.groupBy("depth", "fp").agg(first.alias("first"), F.count("*").alias("members")).select("depth", "fp", F.col("first.conv_id").alias("rep"), F.col("first.sha").alias("rep_sha"), F.col("first.fp_before").alias("rep_before"), "members"))
    held = looked_up(rows, groups, ["depth", "fp"], "members").withColumn("same", (F.col("sha") == F.col("rep_sha")) & (F.col("fp_before") == F.col("rep_before")))
    held = stored(held.drop("rep_sha", "rep_before"))
    failed = stored(held.where(~F.col("same")).select("depth", "fp").distinct())
    good = _with_parent(held.select("conv_id", "depth", "sha", "n", "rep", "fp", "fp_before"), groups)
    if failed.isEmpty():
        return stored(good)
    # few or none: conversations with a group that holds different prefixes, from that depth on
    since = stored(held.join(failed, ["depth", "fp"]).groupBy("conv_id").agg(F.min("depth").alias("since")))
    good = stored(good.join(since, "conv_id", "left").where("since is null or depth < since").drop("since"))
    bad = stored(held.join(since, "conv_id").where("depth >= since").select("conv_id", "depth", "sha", "n"))
    out, last = good, since.join(good, "conv_id").where("depth = since - 1").select("conv_id", F.col("depth").alias("above"), F.col("rep").alias("up"))
    lowest, deepest = bad.agg(F.min("depth"), F.max("depth")).first()
    for depth in range(lowest, deepest + 1):
        here = bad.where(F.col("depth") == depth).join(last.where(F.col("above") == depth - 1).drop("above"), "conv_id", "left")
        least = here.groupBy(F.col("up").alias("of_up"), F.col("sha").alias("of_sha")).agg(F.min("conv_id").alias("rep"))
        here = here.join(least, (F.col("sha") == F.col("of_sha")) & F.col("up").eqNullSafe(F.col("of_up")))
        here = stored(here.select("conv_id", "depth", "sha", "n", "rep", "up"))
        last = here.select("conv_id", F.col("depth").alias("above"), F.col("rep").alias("up")).unionByName(last.where(F.col("above") >= depth))
        out = out.unionByName(here)
    return stored(out)


def _with_parent(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of rows whose groups are exact: ``up``, the representative of the group before."""
    above = groups.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("fp_before"), F.col("rep").alias("up"), "members")
    return looked_up(rows, stored(above), ["depth", "fp_before"], "members").select("conv_id", "depth", "sha", "n", "rep", "up")


def ends_of(ends: DataFrame) -> DataFrame:
    """``depth``, ``rep`` and ``ends_sha256``: the SHA-256 of the decimal ``conv_id``s that end at a node, in ascending order, joined by commas.

    Ids are dealt to ranges, so that those of a node with many are spread; each task joins its own to texts of some 64 KB, and what is hashed in one stream for each node are those.
    """
    block = "depth long, rep long, low long, ids binary"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, rep, conv = (batch.column(i).to_numpy() for i in range(3))
            new = np.r_[True, (depth[1:] != depth[:-1]) | (rep[1:] != rep[:-1])] if len(conv) else np.zeros(0, bool)
            at = np.r_[np.flatnonzero(new | (np.arange(len(conv)) % 8192 == 0)), len(conv)]
            out = [(int(depth[a]), int(rep[a]), int(conv[a]), ",".join(map(str, conv[a:b].tolist())).encode()) for a, b in zip(at[:-1], at[1:])]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns)], ["depth", "rep", "low", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, hashlib.sha256()

        def row(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["depth", "rep", "ends_sha256"])

        for batch in batches:
            done = []
            for depth, rep, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "rep", "ids"))):
                if (depth, rep) == key:
                    h.update(b",")
                else:
                    if key is not None:
                        done.append((*key, h.hexdigest()))
                    key, h = (depth, rep), hashlib.sha256()
                h.update(ids)
            yield row(done)
        if key is not None:
            yield row([(*key, h.hexdigest())])

    order = ["depth", "rep", "conv_id"]
    blocks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, block)
    return blocks.repartition("depth", "rep").sortWithinPartitions("depth", "rep", "low").mapInArrow(hashed, "depth long, rep long, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``depth``, ``rep``, ``up``, ``leaves``, ``saved``) with both summed over subtrees, by pointer doubling.

    After k rounds a node holds the sums of those less than 2^k below it; those exactly 2^k below give theirs, until nobody is that deep. Sums are combined by tasks before they are moved.
    """
    x = stored(nodes.select("depth", "rep", F.col("up").alias("to"), "leaves", "saved"))
    deepest, step = x.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        given = x.where(F.col("depth") >= step).groupBy((F.col("depth") - step).alias("depth"), F.col("to").alias("rep")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("members"))
        given = stored(given)
        zero = lambda c: F.coalesce(c, F.lit(0))
        # where a node's pointer leads, the pointer from there leads twice as far
        on = given.join(x.select("depth", "rep", F.col("to").alias("further")), ["depth", "rep"]).select((F.col("depth") + step).alias("depth"), F.col("rep").alias("to"), "further", "members")
        moved = looked_up(x, stored(on), ["depth", "to"], "members").drop("to").withColumnRenamed("further", "to")
        sums = given.drop("members")
        x = stored(moved.join(sums, ["depth", "rep"], "left").select("depth", "rep", "to", (F.col("leaves") + zero("more_leaves")).alias("leaves"), (F.col("saved") + zero("more_saved")).alias("saved")))
        step *= 2
    return x.drop("to")


def trie(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """A row for each node of the trie over conversations ``ids`` and their ``prefixes`` (as ``scanned`` gives them), the root included.

    Conversations without turns end at the root. Without any conversation there is no node.
    """
    rows = classes(prefixes)
    root_rep, n_all = ids.agg(F.min("conv_id"), F.count("*")).first()
    spark = ids.sparkSession
    if root_rep is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    up = F.coalesce("up", F.lit(root_rep))  # the first turn's parent is the root
    root = spark.createDataFrame([(0, root_rep, n_all, 0)], "depth long, rep long, n_convs long, n long").withColumn("up", F.lit(None).cast("long"))
    nodes = rows.groupBy("depth", "rep").agg(F.count("*").alias("n_convs"), F.min("n").alias("n"), F.min(up).alias("up"))
    nodes = stored(nodes.select("depth", "rep", "n_convs", "n", "up").unionByName(root.select("depth", "rep", "n_convs", "n", "up")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("rep")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    nodes = stored(nodes.join(children, ["depth", "rep"], "left").fillna(0, ["n_children", "alone"]))
    # below a node of one conversation there is a single leaf, and nothing is saved
    shared = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    start = nodes.where(shared).select("depth", "rep", "up", (F.col("alone") + (F.col("n_children") == 0).cast("long")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    sums = rolled_up(start)
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "rep")).alias("x")).select("conv_id", "x.depth", "x.rep")
    turnless = ids.join(rows.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root_rep).alias("rep"))
    ends = ends_of(last.unionByName(turnless))
    x = nodes.join(sums, ["depth", "rep"], "left").join(ends, ["depth", "rep"], "left")
    return x.select(
        F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", F.col("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def digest(conversations: DataFrame, moduli: tuple[int, ...] = MODULI) -> DataFrame:
    """The trie's nodes of all rebuilt conversations of the table, however long; see ``rebuilt`` and ``trie``.

    Turns of one conversation with equal numbers are ordered by role and text (their first 64 characters, then digests), null numbers first; repeated rows are turns of their own. Other columns are not read.
    """
    ids, parts = rebuilt(conversations)
    return trie(ids, stored(scanned(parts, ["own", "place"], moduli)))


# crc32 of the decimal id, a bit at a time: after each byte come eight shifts (-1)
ORACLE_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END) AS crc FROM t),
h AS (SELECT c, xor(crc, 4294967295) % 6 AS h FROM ids),
parts AS (SELECT h.c, 0 AS own, t.p, t.r, t.x FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.p <= h.h
          UNION ALL SELECT t.c, 1, t.p, t.r, t.x FROM t JOIN h ON t.c = h.c AND t.p > h.h),
numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, r, x FROM parts),
prefixes AS (SELECT c, d, x, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM numbered
             UNION ALL SELECT c, 0, '', [] FROM h),
named AS (SELECT c, d, x, min(c) OVER (PARTITION BY d, path) AS rep FROM prefixes),
up AS (SELECT n.c, n.d, n.x, n.rep, u.rep AS parent, n.d = max(n.d) OVER (PARTITION BY n.c) AS last FROM named n LEFT JOIN named u ON u.c = n.c AND u.d = n.d - 1),
nodes AS (SELECT rep, d, any_value(parent) AS parent, count(*) AS n, any_value(length(x)) AS chars,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM up GROUP BY rep, d),
kids AS (SELECT parent, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids ON kids.parent = nodes.rep AND kids.d = nodes.d),
-- a node lies below all nodes along the path of its smallest member
below AS (SELECT a.rep, a.d, sum((w.n - 1) * w.chars) AS saved, count(*) FILTER (w.k = 0) AS leaves FROM whole w JOIN named a ON a.c = w.rep AND a.d <= w.d GROUP BY a.rep, a.d)
SELECT w.rep AS conv_id, w.d::BIGINT AS depth, w.parent AS parent_conv_id, w.n::BIGINT AS n_convs, w.k::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN below b ON b.rep = w.rep AND b.d = w.d
"""
