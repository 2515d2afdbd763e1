"""Links within inverted lists, and connected components of links, as joins and grouped aggregates.

Nothing here gathers a list, a component or an edge set in one task or on the driver: lists meet in equi-joins, minima in
partial aggregates, and every round ends in a written table, which goes when the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsloom.llm.common import Tables

#: Rounds in which each list compares its members with two hubs, before those that are left are compared with all others. Each costs the
#: driver the plans of one more search for components.
HUB_ROUNDS = 1
#: Words of 64 bits of a set's parity.
PARITY_WORDS = 16


def parities(sets: DataFrame) -> DataFrame:
    """node, bits (struct) of sets (node, values: array of distinct longs): the parity of the number of values in each of
    64 * PARITY_WORDS classes of values. Two sets' parities differ in at most as many classes as there are values in one set alone."""
    each = sets.select("node", F.explode_outer("values").alias("v"))
    bit = F.expr("shiftleft(1L, cast(v & 63 AS int))")
    words = [F.bit_xor(F.when(F.shiftright("v", 6).bitwiseAND(PARITY_WORDS - 1) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(PARITY_WORDS)]
    return each.groupBy("node").agg(*words).select("node", F.struct(*[f"w{i}" for i in range(PARITY_WORDS)]).alias("bits"))


def parity_distance(x: str, y: str) -> Column:
    """Of the columns x.bits and y.bits: the classes in which they differ."""
    total = F.lit(0)
    for i in range(PARITY_WORDS):
        total = total + F.bit_count(F.col(f"{x}.bits.w{i}").bitwiseXOR(F.col(f"{y}.bits.w{i}")))
    return total


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of edges (a, b: long); a table of tables.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes."""
    e = tables.store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen or state.n == 0:
            # each edge is (node, root) now
            out = tables.store(e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
            tables.drop(e)
            return out
        seen = state
        # large-star: each node hands its smallest neighbour (or itself) to its larger neighbours
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: each node hands its smallest neighbour to its smaller neighbours, and keeps it
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u"))
        after = tables.store(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        tables.drop(e)
        e = after


def link_lists(members: DataFrame, verify: Callable[[DataFrame], DataFrame], possible: Callable[[str, str], Column], sets_of: Callable[[DataFrame], DataFrame], most_apart: Callable[[str, str], Column], tables: Tables, couples: DataFrame | None = None) -> DataFrame:
    """node, root for all nodes that have verified links; a table of tables. members: a table of list (long), node (long) and
    columns of the node that `possible` reads, each row once; it is dropped.

    verify takes pairs (a < b) and returns the rows that are links. possible(x, y) is a condition on the columns x.* and y.* of
    two members that every link meets; it is part of the join, so pairs that fail it are never made. sets_of(nodes) gives node
    and values of some nodes' sets, and most_apart(x, y) how many values at most linked members x and y have in one set alone.
    couples: pairs (a < b) to verify beside those of the lists, as lists of two nodes are.

    In each of HUB_ROUNDS rounds, each list that has members of several components yet compares them with two of them: in the first
    round with the one that meets most others over all its lists, as the original of a group of near copies does, and one
    chosen by a hash; then with two chosen by a hash among those that are not in the component of the first hub. A group
    of thousands falls into one component (or few) after as many comparisons as it has members. At last, what is still
    outside of its list's largest part is compared with the others of the list, unless the sets' parities tell them apart: the
    bound on them is exact, and part of the join. A pair within one component
    cannot change the components, so they are the same as if all pairs of all lists had been compared."""
    sizes = members.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    mass = members.join(sizes, "list").groupBy("node").agg(F.sum("n").alias("mass"))
    kept = [c for c in members.columns if c not in ("list", "node")]
    placed = tables.store(members.join(mass, "node").withColumn("root", F.col("node")).withColumn("main", F.lit(None).cast("long")), "placed")
    tables.drop(members)
    links = None
    roots = None
    for turn in range(HUB_ROUNDS):
        outside = F.col("main").isNull() | (F.col("root") != F.col("main"))
        card = F.struct("node", "root", *kept)
        keys = [-F.col("mass") if turn == 0 else F.xxhash64("node", F.lit(turn)), F.xxhash64("node", F.lit(-1 - turn))]
        firsts = [F.min(F.when(outside, F.struct(k.alias("o"), F.col("node").alias("o2"), card.alias("card")))).alias(f"h{i}") for i, k in enumerate(keys)]
        hubs = placed.groupBy("list").agg(*firsts, F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
        hubs = hubs.select("list", F.explode(F.array_distinct(F.array("h0.card", "h1.card"))).alias("y"))
        met = placed.select("list", F.struct("node", "root", *kept).alias("x")).join(hubs, "list").where((F.col("x.root") != F.col("y.root")) & possible("x", "y"))
        pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        pairs = tables.store((pairs.union(couples.select("a", "b")) if turn == 0 and couples is not None else pairs).distinct(), "pairs")
        found = verify(pairs).select("a", "b")
        # the roots are stars, so they stand for the links before
        links = tables.store(found if roots is None else found.union(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "links")
        roots_before, roots = roots, components(links, tables)
        joined = placed.drop("root", "main").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # the part of a list that most of its members are likely in is that of its heaviest
        state = joined.groupBy("list").agg(F.max_by("root", F.struct("mass", "node")).alias("main"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("list", "main")
        after = tables.store(joined.join(state, "list").select(*placed.columns), "placed")
        tables.drop(placed, pairs, links, *([roots_before] if roots_before is not None else []))
        placed = after
        if placed.isEmpty():
            tables.drop(placed)
            return roots
    # a pair that meets in several lists comes out of the least of them alone; a node is in a bounded number of lists
    cards = placed.groupBy("node").agg(F.collect_list("list").alias("lists"))
    cards = tables.store(cards.join(parities(sets_of(placed.select("node").distinct())), "node"), "cards")
    listed = placed.join(cards, "node")
    x = listed.where("root <> main").select("list", F.struct("node", "root", "lists", "bits", *kept).alias("x"))
    y = listed.select("list", F.struct("node", "root", "main", "lists", "bits", *kept).alias("y"))
    # of two members outside of the main part, one side is enough
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    met = F.array_min(F.array_intersect("x.lists", "y.lists")) == F.col("list")
    rest = x.join(y, "list").where((F.col("x.root") != F.col("y.root")) & once & possible("x", "y") & (parity_distance("x", "y") <= most_apart("x", "y")) & met)
    rest = tables.store(rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
    stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = tables.store(verify(rest).select("a", "b").union(stars), "links")
    out = components(links, tables)
    tables.drop(placed, cards, rest, links, roots)
    return out
