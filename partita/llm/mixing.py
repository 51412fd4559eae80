"""Mixing sources to target weights by entropy balancing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import WORD_PATTERN, stored

#: Sources up to which their table of a few numbers each is sent to every task.
MOST_SOURCES = 10_000



def word_count(text: Column) -> Column:
    """How many words `[^\\x20\\x09-\\x0D]+` a text has; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): sources by code point, null last, take the weights in turn.

    The targets share `share` of all sizes by weight; one that would pass `most` times its source's size stops
    there and the excess goes to the others by weight, until none is above. The level at which that settles has a
    closed form: sources saturate in the order of capacity to weight. The window sees one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    weighed = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    fills = Window.orderBy(F.col("_room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        weighed.withColumn("_room", most * F.col("source_size"))
        .withColumn("_all", share * F.sum("source_size").over(everything))
        .withColumn("_full", F.coalesce(F.sum("_room").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_open"))
        # the level is that of the first source, in filling order, that does not saturate
        .withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_room"), F.struct(F.col("_room") / F.col("weight"), "_level"))).over(everything)["_level"])
    )
    target = F.least(F.col("_room"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_room")))
    return levels.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def balance(histogram: DataFrame, targets: DataFrame, most: float = 2.0, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(source, tilt, scale): rates min(most, exp(tilt * size / scale)) whose words meet each source's target.

    histogram: (source, size, n), size > 0. The dual of the entropy distance to "each document once" under one
    token constraint per source is convex with one unknown per source; safeguarded Newton steps solve it for all
    sources at once, a round being one aggregate over the histogram. Sources at `most` times their size have no
    finite solution: their tilt is null and every rate is `most`. An error where the words of some source are further than
    `tolerance` from its target after `rounds` rounds.
    """
    x = F.col("size") / F.col("scale")
    scales = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    state = (
        targets.join(scales, same(targets, scales))
        .select(targets["source"], "source_size", "target", "scale")
        .withColumns(
            {
                "full": F.col("target") >= most * F.col("source_size") * (1 - 1e-12),
                "tilt": F.lit(0.0),
                "low": F.lit(None).cast("double"),
                "high": F.lit(None).cast("double"),
                "gap": F.lit(1.0),
            }
        )
    )
    names = state.columns
    state = stored(state, "tilts")
    for _ in range(rounds):
        rate = F.least(F.lit(most), F.exp(F.least(F.col("tilt") * x, F.lit(50.0))))
        slope = F.when(rate < most, rate * x * F.col("size") * F.col("n")).otherwise(0.0)
        sums = (
            histogram.alias("h")
            .join(state.filter("not full").select("source", "tilt", "scale").alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
            .groupBy("s.source")
            .agg(F.sum(rate * F.col("size") * F.col("n")).alias("words"), F.sum(slope).alias("slope"))
        )
        low = F.when(F.col("words") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("words") >= F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") + (F.col("target") - F.col("words")) / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (F.coalesce(newton > F.col("low"), F.lit(True))) & (F.coalesce(newton < F.col("high"), F.lit(True)))
        wide = F.when(F.col("high").isNull(), F.col("low") + F.abs("low") + 1).when(F.col("low").isNull(), F.col("high") - F.abs("high") - 1)
        # a step may at most double the tilt's magnitude, so that exp() cannot run away
        near = F.abs(newton) <= 2 * F.abs("tilt") + 2
        step = F.when(newton.isNotNull() & inside & near, newton).otherwise(F.coalesce(wide, (F.col("low") + F.col("high")) / 2))
        state = stored(
            state.alias("t")
            .join(sums.alias("u"), F.col("t.source").eqNullSafe(F.col("u.source")), "left")
            .select("t.*", "words", "slope")
            .withColumns({"low": low, "high": high, "gap": F.coalesce(F.abs(F.col("words") / F.col("target") - 1), F.lit(0.0))})
            .withColumn("tilt", F.when(F.col("words").isNull() | (F.col("gap") <= tolerance), F.col("tilt")).otherwise(step))
            .select(*names),
            "tilts",
        )
        if not (state.agg(F.max("gap")).first()[0] or 0.0) > tolerance:
            break
    else:
        raise RuntimeError(f"rates did not settle in {rounds} rounds")
    return state.select("source", F.when(~F.col("full"), F.col("tilt")).alias("tilt"), "scale")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, group: int = 400) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken) for every row of docs (doc_id, text, source).

    Rates come from balance(). They become copies within groups of about `group` documents of a source, dealt by a
    hash of doc_id and text. Equal rows are counted first and dealt in lots of at most `group` rows to one group after the other, so that a document
    that makes up much of a source is spread too; a lot takes its copies as one, and its rows get them in turn. From the longest document down, each takes the copies that keep the group's words nearest
    its due, and hands the difference on to the next shorter one, so a group misses its due by half of a short
    document or so. No document is taken more than `most` times. A null text has size 0 and its copies are
    0; so have sources whose every text is empty. Null is a source of its own. Repeated rows are mixed one by one
    (equal rows in turn), reruns agree. An empty table gives no rows.
    """
    sized = stored(docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")), "sizes")
    targets = stored(source_targets(sized, weights, share, most), "targets")
    histogram = stored(sized.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    rates = balance(histogram, targets, most)
    plan = (
        targets.alias("t")
        .join(rates.alias("r"), F.col("t.source").eqNullSafe(F.col("r.source")), "left")
        .join(sized.groupBy("source").agg(F.count("*").alias("n_docs")).alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")))
        .select("t.*", "tilt", "scale", "n_docs")
    )
    plan = stored(plan, "mix-plan")
    if plan.count() <= MOST_SOURCES:  # a row per source; where they are more, a shuffle join that Spark can split
        plan = F.broadcast(plan)
    rate = F.when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(
        F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0))))
    )
    lots = sized.groupBy("source", "doc_id", "mark", "size").agg(F.count("*").alias("rows"))
    lots = lots.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / group))))
    lots = lots.withColumn("rows", F.least(F.lit(group).cast("long"), F.col("rows") - F.col("lot") * group))
    rated = (
        lots.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("d.doc_id", "d.size", "d.mark", "d.lot", "d.rows", "d.source", "source_size", "target", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"), "n_docs")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "mark") + F.col("lot"), F.ceil(F.col("n_docs") / group)))
    )
    member = F.struct((-F.col("size")).alias("minus"), "doc_id", "rate", "mark", "lot", "rows")
    grouped = rated.groupBy("source", "part", "source_size", "target").agg(F.sort_array(F.collect_list(member)).alias("docs"))
    none = F.array().cast("array<struct<doc_id:bigint,size:bigint,rate:double,rows:bigint,copies:bigint>>")
    start = F.struct(F.lit(0.0).alias("due"), none.alias("done"))

    def hand_on(state: Column, doc: Column) -> Column:
        size, rows = -doc["minus"], doc["rows"]
        want = F.when(size > 0, doc["rate"] * rows + state["due"] / size).otherwise(F.lit(0.0))
        copies = F.greatest(F.lit(0), F.least(most * rows, F.round(want).cast("long"))).cast("long")
        row = F.struct(doc["doc_id"].alias("doc_id"), size.alias("size"), doc["rate"].alias("rate"), rows.alias("rows"), copies.alias("copies"))
        due = state["due"] + (doc["rate"] * rows - copies) * size
        return F.struct(due.alias("due"), F.concat(state["done"], F.array(row)).alias("done"))

    done = grouped.select("source_size", "target", F.inline(F.aggregate("docs", start, hand_on)["done"]))
    each = done.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return (
        each.withColumn("copies", F.floor(F.col("copies") / F.col("rows")) + (F.col("_turn") <= F.col("copies") % F.col("rows")).cast("long"))
        .select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as mix() takes them, with all their columns. Rows must have unique doc_ids.

    Where a doc_id repeats, each of its rows is taken as often as the first of them.
    """
    copies = mix(docs, **options).groupBy("doc_id").agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    d, c = docs.alias("d"), copies.alias("c")  # aliases keep input columns of any name apart
    joined = d.join(c, F.col("d.doc_id").cast("long").eqNullSafe(F.col("c.doc_id")))
    names = [F.col(f"d.`{n}`") for n in docs.columns]
    return joined.select(F.struct(*names).alias("row"), F.explode(F.sequence(F.lit(1), F.col("c._copies").cast("int"))).alias("turn")).select("row.*")
