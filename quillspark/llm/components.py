"""Connected components by alternating large-star and small-star steps on an edge table.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). The edge table stays distributed, each step is
written to the shared folder, and only one number a round comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillspark.llm.common import drop_path, drop_written, freed_exchanges, fresh_path, written

#: Keys of up to so many tokens take their second keys in one task; keys of about so many stand packed in one part.
TOGETHER, PACKED = 1 << 23, 1 << 25
#: Rows of a key's second keys that meet in one task.
MEETING = 1 << 20


def _write(edges: DataFrame, path: str) -> tuple:
    """Write edges, each there once, and give their number and a digest of them, from the same job."""
    seen = Observation()
    observed = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20))).alias("s"))
    with freed_exchanges(edges.sparkSession):
        observed.write.parquet(path)
    return tuple(seen.get[k] or 0 for k in "nxs")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(arcs: DataFrame, keep: Column) -> DataFrame:
    """For each u with neighbours v and least m of u and its neighbours: an edge (v, m) for every v that keep admits."""
    least = arcs.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
    joined = arcs.join(least, "u")
    return joined.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the least node that can be reached.

    Nulls and self loops are dropped, repeated edges count once; an empty table gives an empty result. Raises if the
    table has not settled after max_rounds, rather than returning partial components.
    """
    spark = edges.sparkSession
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = fresh_path(spark, "components")
    schema, before = edges.schema, _write(edges, path)
    edges = spark.read.schema(schema).parquet(path)
    for _ in range(max_rounds if before[0] else 0):
        # large star: neighbours above a node point to the least around it; so u > v in every edge
        arcs = _star(_both(edges), F.col("v") > F.col("u")).distinct()
        # small star: each node keeps its smaller neighbours and points them, and itself, to the least of them
        least = arcs.groupBy("u").agg(F.min("v").alias("m"))
        small = arcs.join(least, "u").select(F.explode(F.array("u", "v")).alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        step = fresh_path(spark, "components")
        after = _write(small, step)
        old, path, edges = path, step, spark.read.schema(schema).parquet(step)
        drop_path(spark, old)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def bucket_roots(members: DataFrame, verify: Callable[[DataFrame], DataFrame], fits: Callable[[str, str], Column], weight: Callable[[str], Column], finer: Callable[[DataFrame], Iterable[DataFrame]], enough: int = 1, many: int = 64, merge: Callable[[DataFrame], DataFrame] | None = None, share: float = 0.0) -> DataFrame:
    """(node, root), as of connected_components, of the pairs that share keys and that verify admits.

    members: k, node, times and columns that fits needs, each (k, node) once. Two nodes with one k count its weight if
    fits(a, b), with aliases of their rows, doesn't rule the pair out; pairs of a total of `enough` go to verify, which
    takes and gives (u, v). Each key's nodes first meet its head, the node that occurs most. Then the nodes outside a
    key's largest component meet those of other components, so n copies of one text give n links and not their square.
    A key of more than `many` nodes would give the square of them where they share a passage and nothing else. Its nodes
    therefore meet by second keys: finer takes (k, node) and gives one or several (k, node, k2), such that a pair that verify
    admits and that shares k shares a k2 in one of them, too; one of them is enough. They are made and met one after the
    other, so that one's exchanges stand on disk at a time, and a pair that several of them propose is verified once. The
    lesser n of such a pair is at least `share` of the greater. merge
    may give the rows of such keys fewer keys before, such that nodes that share one still do. No pair is left out for the
    size of its keys. finer is called when members has been read for the last time, and its tables are read until the end.
    """

    def pairs(met: DataFrame, least: int) -> DataFrame:
        met = met.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"), weight("a").alias("w"))
        return met.groupBy("u", "v").agg(F.sum("w").alias("w")).where(F.col("w") >= least).select("u", "v")

    often = F.shiftleft(F.least("times", F.lit(1 << 18)), 44).bitwiseOR(F.col("node").bitwiseAND(F.lit((1 << 44) - 1)))
    heads = members.withColumn("often", often).groupBy("k").agg(*(F.max_by(c, "often").alias(c) for c in members.columns if c != "k"))
    stars = members.alias("a").join(heads.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.node") != F.col("b.node")) & fits("a", "b"))
    stars = written(pairs(stars, enough), "stars")
    found = written(verify(stars), "star-links")
    roots = written(connected_components(found), "star-roots")
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = named.groupBy("k", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("k").agg(F.max_by("root", "m").alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("m").alias("nodes")).where("roots > 1")
    rest = written(named.join(main.select("k", "main", "nodes"), "k"), "unlinked")
    apart, few = F.col("a.root") != F.col("b.root"), rest.where(F.col("nodes") <= many)
    once = (F.col("a.root") == F.col("a.main")) | (F.col("a.node") > F.col("b.node"))
    met = few.alias("a").join(few.where("root <> main").alias("b"), (F.col("a.k") == F.col("b.k")) & apart & once & fits("a", "b"))
    big = rest.where(F.col("nodes") > many).drop("times", "nodes")
    fresh = lambda proposed: proposed.join(stars, ["u", "v"], "left_anti")
    links = written(verify(fresh(pairs(met, enough))), "rest-links")
    if merge is not None:
        big = written(merge(big), "merged-keys")
        drop_written(rest)
    parts = []
    for seconds in finer(big.select("k", "node")):
        fine = written(big.join(seconds, ["k", "node"]), "fine-keys")
        parts.append(written(pairs_of_second_keys(fine, share), "fine-pairs"))
        drop_written(fine)
    drop_written(rest if merge is None else big)
    if parts:
        links = links.union(written(verify(fresh(reduce(DataFrame.union, parts).distinct())), "fine-links"))
        for proposed in parts:
            drop_written(proposed)
    for end in ("u", "v"):  # links of nodes become links of the components found so far
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias("r")), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    joined = written(connected_components(links), "joined-roots")
    alone = joined.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti")
    above = joined.select(F.col("node").alias("root"), F.col("root").alias("least"))
    return roots.union(alone).join(above, "root", "left").select("node", F.coalesce("least", "root").alias("root"))


def pairs_of_second_keys(fine: DataFrame, share: float) -> DataFrame:
    """(u, v) of rows (k, node, k2, n, root, main): nodes of unlike roots, one of them outside main, that share k and k2.

    A key's rows meet in one task, where a pair that shares many second keys, as near copies do, comes out once and not once a
    second key. A key of more than MEETING rows is dealt to several tasks by its second keys. The lesser n is at least
    `share` of the greater.
    """
    fine = fine.select("k", "k2", "node", F.col("n").cast("long").alias("n"), "root", (F.col("root") == F.col("main")).alias("inside"))
    sizes = written(fine.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("slices")).where("slices > 1"), "large-fine-keys")
    fine = fine.withColumn("slice", F.lit(0)) if sizes.isEmpty() else fine.join(sizes, "k", "left").withColumn("slice", F.coalesce(F.pmod("k2", "slices"), F.lit(0)).cast("int")).drop("slices")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            yield from _met(rows, share)

    met = fine.select("k", "slice", "k2", "node", "n", "root", "inside").repartition("k", "slice").sortWithinPartitions("k", "slice").mapInArrow(run, "u long, v long")
    return met.distinct()


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The other columns of rows (k, slice, ...) that are ordered by k and slice, one k and slice after the other."""
    at, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k, part, *others = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(k)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and at != (k[i], part[i]):
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            at = k[i], part[i]
            held.append([c[i:j] for c in others])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _met(rows: list[np.ndarray], share: float, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Pairs of one key's rows (k2, node, n, root, inside) as pairs_of_second_keys has them, about `most` meetings at a time."""
    order = np.argsort(rows[0], kind="stable")
    k2, node, n, root, inside = (c[order] for c in rows)
    names, code = np.unique(node, return_inverse=True)
    first = np.flatnonzero(np.diff(k2, prepend=~k2[:1]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k2))))
    size = np.diff(np.append(first, len(k2)))
    outside = np.flatnonzero(~inside & (size[group] > 1))
    ends = np.cumsum(size[group[outside]])
    held, kept, at = [], 0, 0
    while at < len(outside):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        mine = outside[at:to]
        times = size[group[mine]]
        a = np.repeat(mine, times)
        b = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[group[mine]], times)
        fit = (root[a] != root[b]) & (inside[b] | (code[a] > code[b])) & (np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * share - 1e-9)
        x, y = code[a[fit]], code[b[fit]]
        held.append(np.unique(np.maximum(x, y) * len(names) + np.minimum(x, y)))
        kept, at = kept + len(held[-1]), to
        if kept > 4 * most or at == len(outside):
            pair = np.unique(np.concatenate(held))
            yield pa.RecordBatch.from_arrays([pa.array(names[pair // len(names)]), pa.array(names[pair % len(names)])], names=["u", "v"])
            held, kept = [], 0


def merged_keys(rows: DataFrame, kind: Column, several: dict[str, Column]) -> DataFrame:
    """rows (k, node, root, main, ...) with one key for all keys of a kind whose nodes have one node of least hash.

    The keys of one passage have nearly the same nodes and so, as a rule, the same least one: they become one key of about as
    many nodes, under which a pair meets once and not once a key. Nodes that shared a key share its new one. Of a node's rows
    one stays, with the values of `several` for the columns named there if keys were merged in it; main is told anew. The
    low bit of k is kept.
    """
    least = rows.groupBy("k").agg(F.min(F.xxhash64("node")).alias("g"), F.first(kind).alias("kind"))
    least = least.select("k", F.xxhash64("g", "kind").bitwiseAND(-2).bitwiseOR(F.col("k").bitwiseAND(1)).alias("g"))
    own = [c for c in rows.columns if c not in ("k", "node", "main")]
    held = rows.join(least, "k").groupBy(F.col("g").alias("k"), "node").agg(*(F.when(F.count(F.lit(1)) > 1, several[c]).otherwise(F.first(c)).alias(c) if c in several else F.first(c).alias(c) for c in own))
    main = held.groupBy("k", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("k").agg(F.max_by("root", "m").alias("main"))
    return held.join(main, "k")


def rarest_tokens(rows: DataFrame, tokens: DataFrame, parts: int = 8) -> DataFrame:
    """(k, node, k2) of rows (k, node): each node's `most` tokens that fewest nodes of its key have, ties by token.

    tokens: node, tokens without repeats, most. If two nodes can only be similar when all but most - 1 of the tokens of
    either are in the other, they share one of these. Tokens count by their low 32 bits, by which no such pair is lost.
    """
    return reduce(DataFrame.union, (written(x, "rarest-tokens") for x in token_parts(rows, tokens, parts)), rows.select("k", "node", F.lit(0).cast("long").alias("k2")).limit(0))


def token_parts(rows: DataFrame, tokens: DataFrame, parts: int) -> Iterator[DataFrame]:
    """What rarest_tokens gives, the keys dealt to parts, each to be written before the next; a key's tokens stand packed.

    There are as many parts as there are PACKED tokens, up to `parts`. A key's tokens are sorted in one task, by numpy; keys
    of more than TOGETHER tokens spread theirs over tasks as rows.
    """
    tokens = written(tokens, "tokens")
    if tokens.isEmpty():
        drop_written(tokens)
        return
    sizes = rows.join(tokens.select("node", F.size("tokens").alias("n")), "node").groupBy("k").agg(F.sum("n").cast("long").alias("n"))
    sizes = written(sizes, "key-sizes")
    most, total = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    large, spread, parts = sizes.where(F.col("n") > TOGETHER).select("k"), most > TOGETHER, min(parts, 1 + total // PACKED)
    for i in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == i)
        packed = (mine.join(large, "k", "left_anti") if spread else mine).join(tokens, "node").select("k", "node", "most", "tokens")
        yield packed.repartition("k").sortWithinPartitions("k").mapInArrow(_rarest, "k long, node long, k2 long")
        if spread:
            yield _rarest_of_large(mine.join(large, "k", "left_semi"), tokens)
    drop_written(sizes)
    drop_written(tokens)


def _rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second keys of rows (k, node, most, tokens) that are ordered by k."""

    def chosen(k: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        node, most, size, token = (np.concatenate(x) for x in zip(*held, strict=True))
        by_token = np.sort(token.astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(len(node), dtype=np.uint64), size))
        first = np.flatnonzero(np.diff(by_token >> np.uint64(32), prepend=np.uint64(1 << 32)))
        times = np.diff(np.append(first, len(by_token)))
        order = np.argsort(times, kind="stable")
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        by_node = np.sort(by_token << np.uint64(32) | np.repeat(rank, times))
        whose = (by_node >> np.uint64(32)).astype(np.int64)
        nth = np.arange(len(whose)) - np.searchsorted(whose, np.arange(len(node)))[whose]
        which = order[(by_node & np.uint64((1 << 32) - 1)).astype(np.int64)]
        kept = (nth < most[whose]) & (times[which] > 1)
        k2 = (by_token[first] >> np.uint64(32)).astype(np.int64)[which[kept]]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k2), k)), pa.array(node[whose[kept]]), pa.array(k2)], names=["k", "node", "k2"])

    at, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k, node, most = (b.column(i).to_numpy() for i in range(3))
        lists = b.column(3)
        size, token = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(size)])
        cuts = [*np.flatnonzero(np.diff(k, prepend=k[:1] - 1)).tolist(), len(k)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and at != k[i]:
                yield chosen(at, held)
                held = []
            at = k[i]
            held.append((node[i:j], most[i:j], size[i:j], token[ends[i] : ends[j]]))
    if held:
        yield chosen(at, held)


def _rarest_of_large(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """As _rarest, for keys that no task may hold whole: one row a token, counted by key."""
    token = F.explode(F.array_distinct(F.transform("tokens", lambda x: x.cast("long").bitwiseAND(F.lit((1 << 32) - 1))))).alias("token")
    held = rows.join(tokens, "node").select("k", "node", "most", token)
    counts = held.groupBy("k", "token").agg(F.count(F.lit(1)).alias("n"))
    ordered = held.join(counts, ["k", "token"]).groupBy("k", "node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"), F.first("most").alias("most"))
    return ordered.select("k", "node", F.explode(F.slice("t", F.lit(1), F.col("most"))).alias("x")).where("x.n > 1").select("k", "node", F.col("x.token").alias("k2"))
