"""Where links lead: pointer doubling over functional graphs, longest paths over branches.

A chain of n links takes log2(n) / 2 rounds, each two joins and one written table. Nothing is bounded: neither the length
of a chain, nor the number of links, and no path is enumerated unless a branch lies in or before a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, written, written_with


def _doubled(state: DataFrame) -> DataFrame:
    ahead = state.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
    rows = state.join(ahead, "at", "left")
    return rows.select("id", F.coalesce("_at", "at").alias("at"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_open", F.lit(False)).alias("open"))


def follow(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Links (id, into), one of each id at most, to (id, at, steps): the end that each id leads to and how far away it is.

    Ids that lead into a cycle have no end; the second table (id, into, at, steps) is of these, with where they are after
    so many steps, or None if there are none.
    """
    heads = links.select(F.col("id").alias("into"), F.lit(True).alias("hit"))
    state = links.join(heads, "into", "left").select("id", F.col("into").alias("at"), F.lit(1).cast("long").alias("steps"), F.coalesce("hit", F.lit(False)).alias("open"))
    before = None
    while True:  # all ways that end in fewer steps than those of the round before have ended in it
        last = state
        state, counts = written_with(_doubled(_doubled(state)), "follow", open=F.count_if("open"))
        if before is not None:
            drop(last)
        if counts["open"] in (0, before):
            break
        before = counts["open"]
    ended = state.filter("NOT open").select("id", "at", "steps")
    return ended, links.join(state.filter("open").drop("open"), "id") if counts["open"] else None


def cycles(endless: DataFrame) -> DataFrame:
    """Ids that lead into cycles (id, into, at, steps: see ``follow``) to (id, at, steps): where a walk that stops at the
    first node it meets again stops, and after how many steps. A node of a cycle comes back to itself."""
    # the images of ever longer jumps shrink to the cycles, and then no more
    jump = written(endless.select("id", "at"), "jump")
    while True:
        ahead = jump.select(F.col("id").alias("at"), F.col("at").alias("on"))
        sizes = jump.join(ahead, "at").agg(F.count_distinct("at"), F.count_distinct("on")).first()
        if sizes[0] == sizes[1]:
            break
        last, jump = jump, written(jump.join(ahead, "at").select("id", F.col("on").alias("at")), "jump")
        drop(last)
    on = jump.select(F.col("at").alias("id")).distinct()
    # the smallest id of a cycle is its name; a round that changes no name is the last
    name, changed = endless.join(on, "id").select("id", F.col("into").alias("at"), F.col("id").alias("name")), 1
    while changed:
        last, ahead = name, name.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("name").alias("_name"))
        name, counts = written_with(last.join(ahead, "at").select("id", F.col("_at").alias("at"), F.least("name", "_name").alias("name"), (F.col("_name") < F.col("name")).alias("new")), "cycle-name", new=F.count_if("new"))
        if hasattr(last, "place"):
            drop(last)
        changed = counts["new"]
    length = name.groupBy("name").agg(F.count("*").alias("length"))
    round_trip = name.join(length, "name").select("id", F.col("id").alias("at"), F.col("length").alias("steps"))
    tails, _ = follow(endless.select("id", "into").join(on, "id", "left_anti"))
    into = tails.join(round_trip.select(F.col("id").alias("at"), F.col("steps").alias("more")), "at").select("id", "at", (F.col("steps") + F.col("more")).alias("steps"))
    return round_trip.unionByName(into)


def _split(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Distinct links (id, into): those of ids with one, and those of ids with several, or None."""
    each = links.groupBy("id", "into").agg(F.lit(1).alias("one"))
    fan, counts = written_with(each.join(each.groupBy("id").agg(F.count("*").alias("n")), "id").select("id", "into", "n"), "links", several=F.count_if(F.col("n") > 1))
    return fan.filter("n = 1").drop("n"), fan.filter("n > 1").drop("n") if counts["several"] else None


def ends_of(links: DataFrame) -> DataFrame:
    """Links (id, into), several of an id if need be, to (id, at, steps, cyc): the end of the longest walk from each id.

    A walk ends where there is no link, or at the first node it meets again (cyc). Of several longest ones the smallest
    end counts. Ids with one link are followed by doubling; ids with several are solved when all they lead to is, level
    by level over a graph of these ids alone; only what leads to a cycle through such an id is walked path by path.
    """
    single, several = _split(links)
    ended, endless = follow(single)
    known = ended.select("id", "at", "steps", F.lit(False).alias("cyc"))
    if endless is not None:
        known = known.unionByName(cycles(endless).withColumn("cyc", F.lit(True)))
    if several is None:
        return known
    known = written(known, "known")
    forks = several.select("id").distinct()
    total = forks.count()
    way = known.select(F.col("id").alias("into"), "at", "steps", "cyc")
    mark = lambda c: forks.select(F.col("id").alias(c), F.lit(True).alias("fork"))
    arcs = several.join(way, "into", "left").select("id", F.coalesce("at", "into").alias("at"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.coalesce("cyc", F.lit(False)).alias("cyc"))
    arcs = written(arcs.join(mark("at"), "at", "left").select("id", "at", "steps", "cyc", F.coalesce("fork", F.lit(False)).alias("fork")), "arcs")
    best = F.min(F.struct((-F.col("steps")).alias("minus"), "at", "cyc")).alias("b")
    solved, count = None, 0
    while True:
        if solved is None:
            rows = arcs.withColumn("open", F.col("fork"))
        else:
            after = solved.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("cyc").alias("_cyc"), F.lit(True).alias("fork"))
            rows = arcs.join(after, ["at", "fork"], "left").select("id", F.coalesce("_at", "at").alias("at"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_cyc", "cyc").alias("cyc"), (F.col("fork") & F.col("_at").isNull()).alias("open"))
        done = rows.groupBy("id").agg(best, F.max("open").alias("open")).filter("NOT open").select("id", F.col("b.at").alias("at"), (-F.col("b.minus")).alias("steps"), F.col("b.cyc").alias("cyc"))
        before, last = count, solved
        solved, counts = written_with(done, "solved", n=F.count(F.lit(1)))
        if last is not None:
            drop(last)
        count = counts["n"]
        if count in (before, total):
            break
    # ids whose way leads to a fork take its end
    through = known.join(mark("at"), "at", "left")
    plain = through.filter("fork IS NULL").select("id", "at", "steps", "cyc")
    after = solved.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("cyc").alias("_cyc"))
    led = through.filter("fork").drop("cyc", "fork").join(after, "at").select("id", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_cyc").alias("cyc"))
    found = plain.unionByName(led).unionByName(solved)
    if count == total:
        return found
    found = written(found, "found")
    walked = _walks(single.unionByName(several).join(found.select("id"), "id", "left_anti"), found)
    return found.unionByName(walked.groupBy("id").agg(best).select("id", F.col("b.at").alias("at"), (-F.col("b.minus")).alias("steps"), F.col("b.cyc").alias("cyc")))


def _walks(links: DataFrame, found: DataFrame) -> DataFrame:
    """All walks over ``links`` until they meet a node again, have no link, or come to an id whose end is found."""
    links = written(links, "tangled")
    ahead = links.join(found.select(F.col("id").alias("into"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("cyc").alias("_cyc")), "into", "left")
    ahead = ahead.join(links.select(F.col("id").alias("into"), F.lit(True).alias("on")).distinct(), "into", "left").select(F.col("id").alias("node"), "into", "_at", "_steps", "_cyc", "on")
    ahead = written(ahead, "tangled-ahead")
    front, parts = links.select("id").distinct().select("id", F.col("id").alias("node"), F.array("id").alias("path")), []
    while True:
        step = written(front.join(ahead, "node").select("id", F.col("into").alias("node"), F.array_contains("path", F.col("into")).alias("met"), F.size("path").cast("long").alias("n"), F.array_append("path", F.col("into")).alias("path"), "_at", "_steps", "_cyc", F.coalesce("on", F.lit(False)).alias("on")), "walks")
        over = step.filter("met OR NOT on")
        parts.append(over.select("id", F.when(F.col("met"), F.col("node")).otherwise(F.coalesce("_at", "node")).alias("at"), (F.col("n") + F.when(F.col("met"), 0).otherwise(F.coalesce("_steps", F.lit(0)))).alias("steps"), (F.col("met") | F.coalesce("_cyc", F.lit(False))).alias("cyc")))
        front = step.filter("NOT met AND on").select("id", "node", "path")
        if not front.limit(1).count():
            break
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def leading_to(links: DataFrame, goal: int) -> DataFrame:
    """Ids from which some walk over links (id, into) comes to ``goal``, and ``goal`` itself: (id)."""
    single, several = _split(links.filter(F.col("id") != F.lit(goal)))
    ended, _ = follow(single)
    spark = links.sparkSession
    reached = spark.range(1).select(F.lit(goal).cast(links.schema["id"].dataType).alias("id"))
    if several is not None:
        ended = written(ended, "ended")
        arcs = several.join(ended.select(F.col("id").alias("into"), "at"), "into", "left").select("id", F.coalesce("at", "into").alias("at"))
        arcs, front = written(arcs, "arcs"), reached
        reached = written(reached, "reached")
        while True:  # from fork to fork
            front = written(arcs.join(front.select(F.col("id").alias("at")), "at", "left_semi").select("id").distinct().join(reached, "id", "left_anti"), "front")
            if not front.limit(1).count():
                break
            last, reached = reached, written(reached.unionByName(front), "reached")
            drop(last)
    return reached.unionByName(ended.join(reached.select(F.col("id").alias("at")), "at", "left_semi").select("id"))
