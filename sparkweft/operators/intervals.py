"""Trees as intervals: an Euler tour numbers every subject, so a subtree is a range of numbers.

Every subject has an arc down to it and one up from it; each arc knows the next one, and pointer
jumping, which doubles the steps known in every round, tells how far each is from the end. So a
forest takes as many rounds as the logarithm of its size, however deep or wide it is. Ancestors,
subtrees and checks of moves are comparisons of numbers after that; a move shifts them.

Numbers in order take so little room in a file that the planner, which goes by the size of files,
would send a table of millions of rows to every executor by way of the driver. So joins of two
tables that grow with the tree are merge joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch


def siblings(children: DataFrame, scratch: Scratch) -> DataFrame:
    """id, parent, after (the next sibling by id, or null) and first (whether none is before it).

    Rows are cut by range of parent and id, so a parent with any number of children is spread; each
    task looks within its part, and a part's last row at the first row of the next part.
    """
    cut = scratch.save(children.select("id", "parent").repartitionByRange(F.asc_nulls_first("parent"), "id").withColumn("_part", F.spark_partition_id()), "cut")
    here = W.partitionBy("_part").orderBy(F.asc_nulls_first("parent"), "id")
    at = cut.select("*", F.lead(F.struct("parent", "id")).over(here).alias("_next"), F.lag(F.struct("parent", "id")).over(here).alias("_last"))
    ends = cut.groupBy("_part").agg(F.min(F.struct("parent", "id")).alias("_head"), F.max(F.struct("parent", "id")).alias("_tail"))
    border = ends.select("_part", F.lead("_head").over(W.orderBy("_part")).alias("_head"), F.lag("_tail").over(W.orderBy("_part")).alias("_tail"))  # a row a part
    at = at.join(border, "_part").withColumns({"_next": F.coalesce("_next", "_head"), "_last": F.coalesce("_last", "_tail")})
    same = lambda c: F.col(f"{c}.parent").eqNullSafe(F.col("parent")) & F.col(c).isNotNull()
    return at.select("id", "parent", F.when(same("_next"), F.col("_next.id")).alias("after"), (~same("_last")).alias("first"))


def numbered(subjects: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """id, parent, first, last, depth of every subject (id, parent_subject_id): its subtree are those
    whose first is from its own first to its last.

    Ids are unique. Roots follow one another, and children, by id. A parent that isn't there makes
    its child a root. Subjects on a cycle or below one have no numbers and are left out; see ``unreachable``.
    """
    scratch = scratch or Scratch(subjects.sparkSession, "intervals")
    own = subjects.select("id", F.col("parent_subject_id").alias("_up"))
    rows = own.join(own.select(F.col("id").alias("_up"), F.lit(True).alias("_there")).hint("merge"), "_up", "left").select("id", F.when(F.col("_there"), F.col("_up")).alias("parent"))
    rows = scratch.save(siblings(rows, scratch), "siblings")
    heads = rows.where(F.col("first") & F.col("parent").isNotNull()).select(F.col("parent").alias("id"), F.col("id").alias("child"))
    # an arc is named by its subject and its way: down to it (0) or up from it (1)
    arc = lambda c, way: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("id"), F.lit(way).alias("way")))
    down = rows.join(heads.hint("merge"), "id", "left").select("id", F.lit(0).alias("way"), F.coalesce(arc("child", 0), arc("id", 1)).alias("next"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("rise"))
    up = rows.select("id", F.lit(1).alias("way"), F.coalesce(arc("after", 0), arc("parent", 1)).alias("next"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("rise"))
    arcs, k = scratch.save(down.unionByName(up), "arcs0"), 0
    total = arcs.count()
    while (1 << k) < total:  # n and rise: subjects begun and levels gained from an arc on, up to where it points
        ahead = arcs.select(F.struct("id", "way").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"), F.col("rise").alias("_rise"))
        step = arcs.where("next is not null").join(ahead.hint("merge"), "next").select("id", "way", F.col("_next").alias("next"), (F.col("n") + F.col("_n")).alias("n"), (F.col("rise") + F.col("_rise")).alias("rise"))
        step = step.unionByName(arcs.where("next is null"))  # those at the end stay as they are, and don't meet in one task
        k += 1
        arcs = scratch.save(step, f"arcs{k}")
        scratch.drop(f"arcs{k - 1}")
        if arcs.where("next is not null").isEmpty():
            break
    ranked = arcs.where("next is null")  # what still points somewhere goes round in a cycle
    both = ranked.groupBy("id").agg(F.max(F.when(F.col("way") == 0, F.col("n"))).alias("_from"), F.max(F.when(F.col("way") == 1, F.col("n"))).alias("_to"), F.max(F.when(F.col("way") == 0, F.col("rise"))).alias("_rise"))
    count = both.agg(F.max("_from").alias("n")).first()["n"] or 0
    out = both.join(rows.select("id", "parent").hint("merge"), "id").select(
        "id", "parent", (F.lit(count) - F.col("_from")).alias("first"), (F.lit(count) - F.col("_to") - 1).alias("last"), (-F.col("_rise")).alias("depth"))
    out = scratch.save(out, "numbered")
    scratch.keep("numbered")
    return out


def unreachable(subjects: DataFrame, numbers: DataFrame) -> DataFrame:
    """Subjects on a cycle or below one: those that the numbering lacks."""
    return subjects.join(numbers.select("id").hint("merge"), "id", "left_anti")


def subtree(numbers: DataFrame, subject_id) -> DataFrame:
    """id, depth of a subject (0) and of all below it: a filter on a range."""
    top = numbers.where(F.col("id") == F.lit(subject_id)).select("first", "last", "depth").first()
    inside = F.lit(False) if top is None else F.col("first").between(top["first"], top["last"])
    return numbers.where(inside).select("id", (F.col("depth") - (top["depth"] if top else 0)).alias("depth"))


def ancestors(numbers: DataFrame, subject_id) -> DataFrame:
    """id, depth of the subjects above one, nearest first (depth 1): those whose range holds its number."""
    top = numbers.where(F.col("id") == F.lit(subject_id)).select("first", "depth").first()
    holds = F.lit(False) if top is None else (F.col("first") < top["first"]) & (F.col("last") >= top["first"])
    return numbers.where(holds).select("id", (F.lit(top["depth"] if top else 0) - F.col("depth")).alias("depth"))


def _blocks(low: Column, high: Column) -> Column:
    """The dyadic blocks (size as a power of two, number) that make up a range, two of a size at most."""
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    # at size k the range of whole blocks is ceil(low / 2^k) .. floor((high + 1) / 2^k) - 1; those whose parent isn't whole are taken
    begin = lambda k: F.call_function("shiftright", low + power(k) - 1, k)
    end = lambda k: F.call_function("shiftright", high + 1, k)
    sizes = F.sequence(F.lit(0), F.lit(40))

    def at(k: Column) -> Column:
        whole, wide = begin(k) < end(k), begin(k + 1) < end(k + 1)
        left = F.when(wide & (begin(k) < 2 * begin(k + 1)), F.array(begin(k)))
        right = F.when(wide & (end(k) > 2 * end(k + 1)), F.array(end(k) - 1))
        alone = F.when(whole & ~wide, F.sequence(begin(k), end(k) - 1))
        none = F.array().cast("array<bigint>")
        return F.transform(F.concat(F.coalesce(alone, none), F.coalesce(left, none), F.coalesce(right, none)), lambda b: F.struct(k.alias("k"), b.alias("block")))

    return F.flatten(F.transform(F.filter(sizes, lambda k: begin(k) < end(k)), at))


def below(numbers: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id: every subject of each root's subtree, the root included (``roots``: id).

    A range join as an equal one: a subtree's range is cut into dyadic blocks, some two for each
    doubling, and a subject belongs to one block of each size that any range uses.
    """
    asked = roots.select("id").distinct().hint("merge").join(numbers, "id").select(F.col("id").alias("root"), F.explode(_blocks(F.col("first"), F.col("last"))).alias("b")).select("root", "b.k", "b.block")
    sizes = [r["k"] for r in asked.select("k").distinct().collect()]  # some forty at most
    if not sizes:
        return numbers.select(F.col("id").alias("root"), "id").limit(0)
    spread = numbers.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright("first", k).alias("block")) for k in sorted(sizes)])).alias("b")).select("id", "b.k", "b.block")
    return asked.hint("merge").join(spread, ["k", "block"]).select("root", "id")


def refused(numbers: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (id, to) that would make a subject its own ancestor: ``to`` is in its own subtree."""
    own = numbers.select("id", "first", "last")
    to = numbers.select(F.col("id").alias("to"), F.col("first").alias("_at"))
    return moves.join(own.hint("merge"), "id").join(to.hint("merge"), "to").where(F.col("_at").between(F.col("first"), F.col("last"))).select("id", "to")


def moved(numbers: DataFrame, subject_id, to) -> DataFrame:
    """The numbers after a subject and all below it go under another (None: become a root), as its
    last child. Nothing is joined: the subtree's numbers shift one way and those between its
    old and its new place the other way, so only rows of that range change."""
    both = {r["id"]: r for r in numbers.where(F.col("id").isin([x for x in (subject_id, to) if x is not None])).collect()}
    own = both[subject_id]
    lo, hi = own["first"], own["last"]
    if to is not None and lo <= both[to]["first"] <= hi:
        raise ValueError("a subject can't go into its own subtree")
    end = both[to]["last"] if to is not None else numbers.agg(F.max("last")).first()[0]
    size, deeper = hi - lo + 1, (both[to]["depth"] + 1 if to is not None else 0) - own["depth"]
    later = end >= hi  # it goes towards the end, and what is between comes forward
    inside = F.col("first").between(lo, hi)

    def place(x: Column) -> Column:
        """Where a number goes, the subtree's own aside."""
        return F.when(x.between(hi + 1, end), x - size).otherwise(x) if later else F.when(x.between(end + 1, lo - 1), x + size).otherwise(x)

    # an ancestor of the old place alone ends earlier, one of the new place alone ends later; both kinds hold the numbers of what moved
    old = (F.col("first") < lo) & (F.col("last") >= hi)
    new = F.lit(False) if to is None else F.lit(both[to]["first"]).between(F.col("first"), F.col("last"))
    if later:
        last = F.when(old & ~new, F.col("last") - size).when(new, F.col("last")).otherwise(place(F.col("last")))
    else:
        last = F.when(new & ~old, F.col("last") + size).when(old, F.col("last")).otherwise(place(F.col("last")))
    shift = end - hi if later else end + 1 - lo
    return numbers.select(
        "id", F.when(F.col("id") == F.lit(subject_id), F.lit(to)).otherwise(F.col("parent")).alias("parent"), F.when(inside, F.col("first") + shift).otherwise(place(F.col("first"))).alias("first"),
        F.when(inside, F.col("last") + shift).otherwise(last).alias("last"), F.when(inside, F.col("depth") + deeper).otherwise(F.col("depth")).alias("depth"))
