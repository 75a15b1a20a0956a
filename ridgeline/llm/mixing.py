"""Mixing sources to target weights by entropy balancing.

Among all document rates whose taken words meet each source's target, entropy balancing picks those
closest to one copy each in Kullback-Leibler distance, here with an upper bound on the rate. The convex
dual has one multiplier per source, and its solution is an exponential tilt
rate = min(limit, exp(multiplier * size / mean size)). Newton steps on the dual run as aggregations over
the histogram of (source, size); rates are then rounded to whole copies.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import durable, fresh, named, row_hash, table, word_count

CYCLE = (5, 2, 1)
#: Newton steps per job.
STEPS = 3


def _source_key(source: Column) -> Column:
    """A non-null stand-in for a source, so that null is a source like any other."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, limit: float = 3.0, cycle: tuple = CYCLE) -> DataFrame:
    """(key, source_size, target) from (key, source_size), one row per source.

    Sources in code-point order, null last, weigh cycle[0], cycle[1], ... repeating, and share the sum of
    all sizes. A target stops at limit times its source's size; the excess goes to the others by weight.
    The stop order is known beforehand (by limit * size / weight), so one running sum finds the level.
    The windows here hold one row per source.
    """
    order = Window.orderBy(F.col("key") == "", "key")
    weights = F.array(*[F.lit(float(x)) for x in cycle])
    w = sizes.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("int")))
    w = w.withColumn("most", F.lit(limit) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    rising = Window.orderBy("ratio", "key")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))))
    w = w.withColumn("place", F.row_number().over(rising))
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(everything)
    w = w.withColumn("open", first)
    stopped = F.col("open").isNull() | (F.col("place") < F.col("open.place"))
    return w.select("key", "source_size", F.when(stopped, F.col("most")).otherwise(F.col("weight") * F.col("open.level")).cast("double").alias("target"))


def _rate(limit: float) -> Column:
    x = F.col("multiplier") * F.col("size") / F.col("scale")
    return F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(limit)).when(x >= math.log(limit), F.lit(limit)).otherwise(F.exp(x))


def _newton(cells: DataFrame, state: DataFrame, still: Column, limit: float, tolerance: float) -> DataFrame:
    """One step for every source; one that is near enough stays where it is."""
    rated = cells.join(state, "key").withColumn("rate", _rate(limit))
    words = F.col("n") * F.col("size")
    slope = F.when((F.col("rate") < limit) & ~F.col("full"), words * F.col("size") / F.col("scale") * F.col("rate")).otherwise(0.0)
    step = rated.groupBy("key").agg(F.sum(words * F.col("rate")).alias("got"), F.sum(slope).alias("slope"))
    s = state.join(step, "key").withColumn("gap", F.col("got") - F.col("target"))
    s = s.withColumns({"off": F.when(still, 0.0).otherwise(F.abs("gap") / F.col("target")), "low": F.when(F.col("gap") < 0, F.col("multiplier")).otherwise(F.col("low")), "high": F.when(F.col("gap") > 0, F.col("multiplier")).otherwise(F.col("high"))})
    newton = F.col("multiplier") - F.try_divide("gap", "slope")
    inside = (newton > F.col("low")) & (newton < F.col("high"))
    s = s.withColumn("multiplier", F.when(F.col("off") <= tolerance, F.col("multiplier")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2))
    return s.select(*state.columns)


def multipliers(cells: DataFrame, goal: DataFrame, limit: float = 3.0, tolerance: float = 1e-7, most: int = 60) -> DataFrame:
    """(key, multiplier, scale, full, source_size, target): the solution of the dual for every source.

    Each step is one aggregation over cells (key, size, n); STEPS of them are one job. A Newton step that leaves
    the bracket of the root is replaced by its middle, so that the search cannot diverge.
    """
    mean = cells.where("size > 0").groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = goal.join(mean, "key", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    low = F.least(F.lit(0.0), F.col("scale") * F.log(F.try_divide("target", "source_size")))
    state = state.withColumn("full", (F.col("source_size") > 0) & (F.col("target") >= limit * F.col("source_size") * (1 - 1e-12)))
    still = F.col("full") | (F.col("source_size") == 0) | (F.col("target") <= 0)
    state = state.withColumns({
        "multiplier": F.lit(0.0), "low": F.when(still, 0.0).otherwise(low),
        "high": F.when(still | (F.col("target") <= F.col("source_size")), 0.0).otherwise(F.col("scale") * math.log(limit)), "off": F.lit(1.0),
    })
    state = durable(state)
    for _ in range(-(-most // STEPS)):
        for _ in range(STEPS):
            state = _newton(cells, state, still, limit, tolerance)
        state = durable(state)
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    # Sums of floating numbers depend on the order of tasks in their last digits; reruns must not.
    return state.select("key", F.round("multiplier", 10).alias("multiplier"), "scale", "full", "source_size", "target")


def _repair() -> Column:
    """From the array of (octave, more, fewer) per source and its shortfall in words: copies to add by size.

    more and fewer are (room, size): the size of that octave to which most copies can be added, and from which
    most can be taken. From the largest octave down, whole copies of one of them take up the shortfall, so that
    what remains is about half a small document. At most one step per power of two: about 40.
    """

    def step(acc, x):
        to = F.when(acc["gap"] > 0, x["more"]).otherwise(x["fewer"])
        add = F.greatest(-to["room"], F.least(to["room"], F.round(acc["gap"] / to["size"]).cast("long")))
        return F.struct((acc["gap"] - add * to["size"]).alias("gap"), F.concat(acc["moves"], F.array(F.struct(to["size"].alias("size"), add.alias("add")))).alias("moves"))

    start = F.struct(F.col("gap").alias("gap"), F.expr("cast(array() as array<struct<size:bigint,add:bigint>>)").alias("moves"))
    return F.aggregate(F.reverse(F.sort_array("octaves")), start, step, lambda acc: acc["moves"])


def whole_copies(cells: DataFrame, solved: DataFrame, limit: int = 3) -> DataFrame:
    """(key, size, n, copies, source_size, target): copies in all for the n documents of each cell.

    Running sums of the rates, from the largest size down, are rounded, which leaves a source at most one
    largest document away from its target; the rest is put right by _repair. The window holds one row per
    distinct size of a source.
    """
    down = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = cells.join(solved, "key").withColumn("rate", _rate(float(limit)))
    c = c.withColumn("to", F.floor(F.sum(F.col("n") * F.col("rate")).over(down) + 0.5))
    c = c.withColumn("copies", F.col("to") - F.coalesce(F.lag("to").over(Window.partitionBy("key").orderBy(F.col("size").desc())), F.lit(0)))
    c = c.withColumn("copies", F.least(F.greatest("copies", F.lit(0)), limit * F.col("n"))).drop("to", "multiplier", "scale", "rate")
    c = durable(c)
    octave = F.floor(F.log2("size"))
    more, fewer = F.struct((limit * F.col("n") - F.col("copies")).alias("room"), "size"), F.struct(F.col("copies").alias("room"), "size")
    best = c.where("size > 0 AND NOT full").groupBy("key", octave.alias("octave")).agg(F.max(more).alias("more"), F.max(fewer).alias("fewer"))
    best = best.groupBy("key").agg(F.collect_list(F.struct("octave", "more", "fewer")).alias("octaves"))
    gap = c.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    moves = gap.join(best, "key").select("key", F.explode(_repair()).alias("m")).select("key", F.col("m.size").alias("size"), F.col("m.add").alias("add"))
    return c.join(moves, ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("add", F.lit(0))).drop("add", "full")


def _copies(docs: DataFrame, doc_id: str, text: str, source: str, limit: int, cycle: tuple) -> DataFrame:
    """One row per distinct (doc_id, text, source): doc_id, key, size, h, n (its rows), source_size, target, base, extra.

    Each of the n rows is taken base times, and `extra` of them once more. Texts are read once and stay where they
    are. h is a hash of doc_id and text, by which the documents of one source and size are ordered.
    """
    key, body, origin = named([doc_id, text, source])
    read = docs.select(key.alias("doc_id"), _source_key(origin).alias("key"), word_count(body).alias("size"), F.xxhash64(key, body).alias("h"))
    counts = durable(read.groupBy("doc_id", "key", "size", "h").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # As many buckets as rows per bucket: neither a bucket nor a cell's list of buckets is long, whatever source is hot.
    bucket = F.pmod("h", F.lit(max(1, math.isqrt(total)))).alias("bucket")
    parts = durable(counts.groupBy("key", "size", bucket).agg(F.sum("n").alias("n")))
    cells = durable(parts.groupBy("key", "size").agg(F.sum("n").alias("n")))
    sizes = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = durable(targets(sizes, float(limit), cycle))
    copies = whole_copies(cells, multipliers(cells, goal, float(limit)), limit)
    up_to_here = lambda *k: Window.partitionBy("key", "size", *k[:-1]).orderBy(k[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = parts.withColumn("start", F.sum("n").over(up_to_here("bucket")) - F.col("n")).drop("n").join(copies.withColumnRenamed("n", "cell_rows"), ["key", "size"])
    # Rows of one h and doc_id are one row here, so a bucket stays short however often a row is repeated.
    order = F.struct("h", F.col("doc_id").isNull().alias("none"), "doc_id").alias("order")
    rows = counts.select("*", bucket, order).withColumn("within", F.sum("n").over(up_to_here("bucket", "order")) - F.col("n")).drop("order")
    out = rows.join(plan, ["key", "size", "bucket"])
    first = F.col("start") + F.col("within")
    extra = F.least(F.greatest(F.pmod("copies", "cell_rows") - first, F.lit(0)), F.col("n"))
    return out.select("doc_id", "key", "size", "h", "n", "source_size", "target", F.floor(F.col("copies") / F.col("cell_rows")).cast("long").alias("base"), extra.cast("long").alias("extra"))


def _each(rows: DataFrame, times: str, number: str, block: int = 10_000) -> DataFrame:
    """rows as often as the column `times` says, numbered from 1; no array is longer than block or times / block."""
    (part,) = fresh(rows, "each_part")
    many = rows.where(F.col(times) > 0).withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / block))))
    return many.withColumn(number, F.explode(F.sequence(F.col(part) * block + 1, F.least(F.col(times), (F.col(part) + 1) * block)))).drop(part)


def _chosen(partial: DataFrame, columns: list[str], identity_: list[str], most: int, extra: str, copies: str) -> DataFrame:
    """partial with copies settled, where `extra` of an identity's rows (key, hash, id; at most `most`) are taken once more.

    Equal rows are folded per task and dealt by all their columns. An identity's different rows are ordered by a
    hash of them; places come from one count per bucket and ranks within buckets, so no task meets a whole identity.
    """
    kinds = {f.name: f.dataType.simpleString() for f in partial.schema}
    loose = [c for c in columns if any(x in kinds[c] for x in ("map<", "variant"))]  # no keys of a group, but for their JSON
    m, json_, bucket, part, start, within, here, number = fresh(partial, "chosen_m", "chosen_json", "chosen_bucket", "chosen_part", "chosen_start", "chosen_within", "chosen_here", "chosen_number")
    firm = [c for c in partial.columns if c not in loose]
    as_json = [F.to_json(c, {"ignoreNullFields": "false"}).alias(f"{json_}{k}") for k, c in enumerate(named(loose))]
    folded = partial.groupBy(*named(firm), *as_json).agg(F.count("*").alias(m), *[F.first(c).alias(name) for c, name in zip(named(loose), loose)])
    folded = folded.select(*named(partial.columns), m)
    folded = durable(folded.withColumn(part, row_hash(folded.select(*named(columns)))).withColumn(bucket, F.pmod(part, F.lit(max(1, math.isqrt(most))))))
    up_to_here = lambda keys, last: Window.partitionBy(*keys).orderBy(last).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = folded.groupBy(*identity_, bucket).agg(F.sum(m).alias(start))
    sums = sums.withColumn(start, F.sum(start).over(up_to_here(identity_, bucket)) - F.col(start)).select(*[F.col(c).alias(f"{start}{c}") for c in (*identity_, bucket)], start)
    placed = folded.withColumn(within, F.sum(m).over(up_to_here([*identity_, bucket], part)) - F.col(m))
    placed = placed.join(sums, [F.col(c).eqNullSafe(F.col(f"{start}{c}")) for c in (*identity_, bucket)])
    placed = placed.withColumn(here, F.least(F.greatest(F.col(extra) - F.col(start) - F.col(within), F.lit(0)), F.col(m)))
    return _each(placed, m, number).withColumn(copies, F.col(copies) + F.when(F.col(number) <= F.col(here), 1).otherwise(0)).select(*named(partial.columns))


def _planned(docs: DataFrame, doc_id: str, text: str, source: str, limit: int, cycle: tuple) -> tuple[DataFrame, list[str]]:
    """docs with (size, source_size, target, copies) under names that docs does not have, and these names.

    Texts move once, to meet their number of copies. Rows that repeat doc_id, text and source share theirs; only
    where some of them get one more than others are they told apart. An identity of over a 2,000th part of all
    rows would meet its answer in one task: there are fewer than 2,000 such, so their answers are broadcast.
    """
    names = fresh(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_key", "mix_hash", "mix_id", "mix_n", "mix_extra", "mix_own_key", "mix_own_hash")
    size, source_size, target, copies, key, h, number, n, extra, own_key, own_h = names
    plan = durable(_copies(docs, doc_id, text, source, limit, cycle))
    plan = plan.select(F.col("doc_id").alias(number), F.col("key").alias(key), F.col("h").alias(h), F.col("n").alias(n), F.col("size").alias(size), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("base").alias(copies), F.col("extra").alias(extra))
    own, body, origin = named([doc_id, text, source])
    rows = docs.withColumns({own_key: _source_key(origin), own_h: F.xxhash64(own, body)})
    same = [F.col(own_key) == F.col(key), F.col(own_h) == F.col(h), own.eqNullSafe(F.col(number))]
    keep = [*named(docs.columns), *[F.col(c) for c in names[:9]]]
    shown = [*named(docs.columns), *[F.col(c) for c in names[:4]]]
    total, most = plan.agg(F.sum(n), F.max(n)).first()
    once = lambda rest: rest.join(plan.where(F.col(n) == 1), same).select(*keep).withColumn(copies, F.col(copies) + F.col(extra)).select(*shown)
    if (most or 0) <= 1:
        return once(rows), names[:4]
    crowd = max(1000, total // 2000)
    rest, many = rows, []
    if most > crowd:
        hot = F.broadcast(plan.where(F.col(n) > crowd))
        rest, many = rows.join(hot, same, "left_anti"), [rows.join(hot, same).select(*keep)]
    many = functools.reduce(DataFrame.unionAll, [*many, rest.join(plan.where((F.col(n) > 1) & (F.col(n) <= crowd)), same).select(*keep)])
    some = (F.col(extra) > 0) & (F.col(extra) < F.col(n))
    alike = many.where(~some).withColumn(copies, F.col(copies) + (F.col(extra) > 0).cast("long"))
    out = once(rest).unionAll(alike.select(*shown))
    if not plan.where(some).isEmpty():
        out = out.unionAll(_chosen(many.where(some), docs.columns, [key, h, number], most, extra, copies).select(*shown))
    return out, names[:4]


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", limit: int = 3, cycle: tuple = CYCLE) -> DataFrame:
    """docs with size, source_size, target and copies; every input row stays, copies may be 0.

    A null source is a source of its own. Null and empty texts have size 0 and get one copy. Ties and
    repeated rows are ordered by a hash of doc_id and text; rows with one doc_id, text and source share their copies
    by a hash of all columns, equal ones in any order. An empty table gives an empty result. Columns of docs with the added names are replaced.
    """
    out, names = _planned(docs, doc_id, text, source, limit, cycle)
    added = ("size", "source_size", "target", "copies")
    return out.select(*named([c for c in docs.columns if c.lower() not in added]), *[F.col(a).alias(b) for a, b in zip(names, added)])


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", limit: int = 3, cycle: tuple = CYCLE) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with the columns of docs unchanged,
    whatever their names."""
    out, names = _planned(docs, doc_id, text, source, limit, cycle)
    (number,) = fresh(out, "mix_each")
    return _each(out, names[3], number).select(*named(docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    plan = _copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source", 3, CYCLE)
    rows = _each(plan, "n", "number")
    copies = F.col("base") + F.when(F.col("number") <= F.col("extra"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))
