"""Reading order of page boxes: gap splits, gutters and cuts as window queries over all pages and regions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import new_folder

#: Boxes from which two boxes may cross a gutter.
CROWDED = 40
#: Fewest boxes that have a gutter: two on either side.
FEWEST = 4
#: How much of the narrower column a box takes that spans a gutter; how many times a line a headline is high; how many
#: times a gutter an empty band across is wide that goes before it.
SPANNING, TALL, WIDER = 0.25, 1.8, 1.5


def _reach(page: list[str], lo: str, hi: str):
    before = Window.partitionBy(*page).orderBy(lo, "idx").rowsBetween(Window.unboundedPreceding, -1)
    return F.max(hi).over(before)


def gap_groups(boxes: DataFrame, page: list[str], lo: str, hi: str, least: float) -> DataFrame:
    """Boxes with the number of their group along one axis: a group ends where an empty band of ``least`` follows."""
    starts = boxes.withColumn("_cut", F.coalesce((F.col(lo) - _reach(page, lo, hi) >= least).cast("int"), F.lit(0)))
    return starts.withColumn("group", F.sum("_cut").over(Window.partitionBy(*page).orderBy(lo, "idx"))).drop("_cut")


def widest_band(boxes: DataFrame, page: list[str], lo: str = "y1", hi: str = "y2") -> DataFrame:
    """Per page the widest empty band along an axis (the first of equals) and the box below it."""
    gaps = boxes.withColumn("gap", F.col(lo) - _reach(page, lo, hi)).filter("gap > 0")
    return gaps.groupBy(*page).agg(F.min(F.struct((-F.col("gap")).alias("g"), F.col(lo).alias("at"), "idx")).alias("b")).select(*page, (-F.col("b.g")).alias("gap"), F.col("b.at").alias("at"), F.col("b.idx").alias("idx"))


def gutters(boxes: DataFrame, page: list[str], least) -> DataFrame:
    """Per page the best column gutter: the longest run of x positions that few boxes cover (1, or 2 from ``CROWDED`` boxes
    on), emptier runs before longer ones, with two box centres or more on either side; an empty run may be of any width.
    ``least`` is a number or a column that is the same for all boxes of a page."""
    least = least if isinstance(least, Column) else F.lit(float(least))
    w, by_centre = Window.partitionBy(*page).orderBy("x"), Window.partitionBy(*page).orderBy(F.asc_nulls_last("c"))
    every = by_centre.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one sort does for all
    whole = boxes.select(*page, F.floor("x1").cast("int").alias("a"), F.floor("x2").cast("int").alias("b"), ((F.col("x1") + F.col("x2")) / 2).alias("c"), least.alias("least"))
    ranked = whole.withColumns({"n": F.count(F.lit(1)).over(every), "_centres": F.count("c").over(every), "_k": F.row_number().over(by_centre)}).filter(F.col("n") >= FEWEST)
    # two centres or more are on either side of what lies between the second from the left and the second from the right
    second = lambda k: F.max(F.when(F.col("_k") == k, F.col("c"))).over(every)
    sizes = ranked.withColumns({"end": F.max("b").over(every), "least": F.max("least").over(every), "_second": second(2), "_before": second(F.col("_centres") - 1)})
    edges = F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("x"), F.lit(-1).alias("d")))
    steps = sizes.select(*page, "n", "end", "least", "_second", "_before", F.inline(edges))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = steps.withColumns({"cover": F.sum("d").over(so_far), "to": F.lead("x").over(w)}).filter("to > x")  # of equal steps the last has all of them
    levels = levels.withColumn("to", F.least(F.col("to"), F.col("end") + 1))
    thin = levels.withColumn("thin", F.col("cover") <= F.when(F.col("n") < CROWDED, 1).otherwise(2))
    runs = thin.withColumn("run", F.sum((~F.col("thin")).cast("int")).over(w)).filter("thin").groupBy(*page, "run", "least", "_second", "_before").agg(F.min("x").alias("lo"), F.max("to").alias("hi"), F.min("cover").alias("cover"))
    runs = runs.filter((F.col("hi") - F.col("lo")) >= F.when(F.col("cover") == 0, 1.0).otherwise(F.col("least")))
    middle = (F.col("lo") + F.col("hi")) / 2
    kept = runs.filter((F.col("_second") < middle) & (F.col("_before") >= middle))
    return kept.groupBy(*page).agg(F.min(F.struct("cover", (F.col("lo") - F.col("hi")).alias("w"), "lo", "hi")).alias("g")).select(*page, F.col("g.lo").alias("lo"), F.col("g.hi").alias("hi"), F.col("g.cover").alias("cover"))


def fixed_columns(boxes: DataFrame, page: list[str], middle) -> DataFrame:
    """Two known columns: right one first, lines from top to bottom."""
    left = ((F.col("x1") + F.col("x2")) / 2 < middle).cast("int")
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy(left, (F.col("y1") + F.col("y2")) / 2, "idx")))


# --- orders and choices that need rounds: each round is a handful of joins and windows over all pages at once


def _kept(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "order")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _meeting(boxes: DataFrame, page: list[str], columns: list[str], low: str, high: str) -> DataFrame:
    """Pairs of different boxes of a page that overlap between ``low`` and ``high``, as structs p and q.

    The axis is cut in buckets as wide as the page's mean box, so a box is in as many as it is longer than that and all boxes
    together in no more than two each. A pair meets in the first bucket that both are in: boxes far apart never do.
    """
    size = F.greatest(F.avg(F.greatest(F.col(high) - F.col(low), F.lit(0.0))).over(Window.partitionBy(*page)), F.lit(1e-6))
    first, last = F.floor(F.col(low) / F.col("_size")), F.floor(F.greatest(F.col(low), F.col(high)) / F.col("_size"))
    spread = boxes.withColumn("_size", size).select(*page, F.struct(*columns).alias("b"), first.alias("first"), F.explode(F.sequence(first, last)).alias("bucket"))
    side = lambda n: spread.select(*page, "bucket", F.col("b").alias(n), F.col("first").alias(f"{n}_first"))
    met = side("p").join(side("q"), [*page, "bucket"]).filter((F.col("bucket") == F.greatest("p_first", "q_first")) & (F.col("p.idx") != F.col("q.idx")))
    return met.filter(F.least(f"p.{high}", f"q.{high}") > F.greatest(f"p.{low}", f"q.{low}")).select(*page, "p", "q")


def suppress_contained(boxes: DataFrame, page: list[str], most: float = 0.6) -> DataFrame:
    """Boxes that are not mostly inside a surer one that stays: of any two that share more than ``most`` of the smaller
    area the surer (ties: the first) stays, unless it goes itself.

    Each round settles the boxes all of whose surer rivals are settled.
    """
    area = lambda b: F.greatest(F.lit(1e-6), (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))
    p, q = F.col("p"), F.col("q")
    inter = F.greatest(F.lit(0.0), F.least(p["x2"], q["x2"]) - F.greatest(p["x1"], q["x1"])) * F.greatest(F.lit(0.0), F.least(p["y2"], q["y2"]) - F.greatest(p["y1"], q["y1"]))
    surer = (p["conf"] > q["conf"]) | ((p["conf"] == q["conf"]) & (p["idx"] < q["idx"]))
    rivals = _meeting(boxes, page, ["idx", "x1", "y1", "x2", "y2", "conf"], "y1", "y2").filter(surer & (inter / F.least(area(p), area(q)) > most))
    rivals = _kept(rivals.select(*page, F.col("p.idx").alias("by"), F.col("q.idx").alias("idx")))
    open_ = _kept(rivals.select(*page, "idx").distinct())
    gone = boxes.select(*page, "idx").limit(0)
    while not open_.isEmpty():
        waits = rivals.join(open_.withColumnRenamed("idx", "by"), [*page, "by"], "left_semi").select(*page, "idx")
        ready = open_.join(waits, [*page, "idx"], "left_anti")
        stays = rivals.join(gone.withColumnRenamed("idx", "by"), [*page, "by"], "left_anti").select(*page, "idx").distinct()
        ready = _kept(ready)
        gone = _kept(gone.unionByName(ready.join(stays, [*page, "idx"], "left_semi")))
        open_ = _kept(open_.join(ready, [*page, "idx"], "left_anti"))
    return boxes.join(gone, [*page, "idx"], "left_anti")


def column_order(boxes: DataFrame, page: list[str]) -> DataFrame:
    """Boxes with ``place``: columns are boxes tied by a horizontal overlap of half the narrower or more, directly or through
    others; they go from right to left by their mean centre, lines downwards.

    Boxes that start where all before them have ended begin a new group, and no tie crosses groups. A group is one column
    if each other box of it is tied to the one before it or to the one before it that reaches furthest. Only pages that have
    other groups go through rounds."""
    in_order, group = Window.partitionBy(*page).orderBy("x1", "idx"), Window.partitionBy(*page, "_group")
    before, every = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    box = F.struct("x2", "x1")
    unknown = [F.col(c).isNull() | F.isnan(c) for c in ("x1", "x2")]
    rows = boxes.withColumns({"_far": F.max(box).over(before), "_last": F.lag(box).over(in_order), "_odd": F.max(unknown[0] | unknown[1]).over(every)})
    starts = F.coalesce(F.col("x1") >= F.col("_far.x2"), F.lit(True))
    joins = F.coalesce(_tied(box, F.col("_far")) | _tied(box, F.col("_last")), F.lit(False))
    rows = rows.withColumns({"_group": F.when(F.col("_odd"), 0).otherwise(F.sum(starts.cast("int")).over(in_order)), "_sure": ~F.col("_odd") & (starts | joins)})
    rows = rows.select(*boxes.columns, "_group", "_sure").withColumns({"label": F.min("idx").over(group), "_centre": _mean_centre(group), "_sure": F.min("_sure").over(group)})
    whole = Window.partitionBy(*page).orderBy(*_columns_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = _kept(rows.withColumns({"place": _place(page), "_sure": F.min("_sure").over(whole)}).drop("_centre", "label"))
    placed, open_ = rows.filter("_sure").select(*boxes.columns, "place"), rows.filter("not _sure").drop("place")
    if open_.isEmpty():
        return placed
    labelled = open_.join(_column_labels(open_, [*page, "_group"]), [*page, "_group", "idx"]).withColumn("_centre", _mean_centre(Window.partitionBy(*page, "label")))
    return placed.unionByName(labelled.withColumn("place", _place(page)).select(*boxes.columns, "place"))


def _tied(p, q):
    inter = F.least(p["x2"], q["x2"]) - F.greatest(p["x1"], q["x1"])
    return (inter > 0) & (inter / F.greatest(F.lit(1e-6), F.least(p["x2"] - p["x1"], q["x2"] - q["x1"])) >= 0.5)


def _mean_centre(column):
    return F.avg((F.col("x1") + F.col("x2")) / 2).over(column)


def _columns_first() -> list:
    return [F.desc("_centre"), "label", (F.col("y1") + F.col("y2")) / 2, "idx"]


def _place(page: list[str]) -> Column:
    return (F.row_number().over(Window.partitionBy(*page).orderBy(*_columns_first())) - 1).cast("long")


def _column_labels(boxes: DataFrame, page: list[str]) -> DataFrame:
    """(page, idx, label): the least idx of the box's column, handed on along ties in rounds."""
    ties = _kept(_meeting(boxes, page, ["idx", "x1", "x2"], "x1", "x2").filter(_tied(F.col("p"), F.col("q"))).select(*page, F.col("p.idx").alias("idx"), F.col("q.idx").alias("other")))
    labels = _kept(boxes.select(*page, "idx", F.col("idx").alias("label")))
    while True:
        near = ties.join(labels.withColumnRenamed("idx", "other"), [*page, "other"]).groupBy(*page, "idx").agg(F.min("label").alias("near"))
        least = labels.join(near, [*page, "idx"], "left").select(*page, "idx", "label", F.least("label", F.coalesce("near", "label")).alias("to"))
        own = least.select(*page, F.col("idx").alias("to"), F.col("to").alias("far"))  # what the label's own box is now labelled
        moved = _kept(least.join(own, [*page, "to"]).select(*page, "idx", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("new")))
        labels = moved.drop("new")
        if moved.filter("new").isEmpty():
            return labels


def _spans(x1, x2, lo, hi, left, right):
    """Whether a box from x1 to x2 takes ``SPANNING`` of the narrower column, or more, on both sides of the gutter lo to hi."""
    need = SPANNING * F.least(lo - left, right - hi)
    return F.coalesce((x1 <= lo - need) & (x2 >= hi + need), F.lit(False))


def page_numbers(boxes: DataFrame, page: list[str]) -> DataFrame:
    """(page, idx) of page numbers: the box that starts lowest, if it is no wider than two lines are high and no other box
    ends more than a quarter of a line below its start."""
    return _numbered(boxes, page).filter("_last").select(*page, "idx")


def _numbered(boxes: DataFrame, page: list[str]) -> DataFrame:
    """Boxes with ``_last``, whether they are the page's number."""
    w = Window.partitionBy(*page)
    lowest = F.max(F.struct("y1", (-F.col("idx")).alias("i"))).over(w)["i"] == -F.col("idx")
    line = F.percentile(F.col("y2") - F.col("y1"), F.lit(0.5)).over(w)
    rows = boxes.withColumns({"_lowest": lowest, "_line": line, "_n": F.count(F.lit(1)).over(w)})
    rows = rows.withColumn("_others", F.max(F.when(~F.col("_lowest"), F.col("y2"))).over(w))
    last = F.col("_lowest") & (F.col("_n") > 1) & (F.col("x2") - F.col("x1") <= 2 * F.col("_line")) & (F.col("y1") >= F.col("_others") - 0.25 * F.col("_line"))
    return rows.withColumn("_last", F.coalesce(last, F.lit(False))).drop("_lowest", "_line", "_n", "_others")


def headlines(boxes: DataFrame, page: list[str], least, found: DataFrame | None = None) -> DataFrame:
    """(page, idx) of headlines: boxes that start in the top third of a page of three boxes or more, and are ``TALL`` times
    as high as its lines or span its gutter, unless text that is no headline stands above them. ``found``: the boxes' gutters,
    where they are known."""
    w = Window.partitionBy(*page)
    found = gutters(boxes, page, least) if found is None else found
    rows = boxes.join(found.select(*page, F.col("lo").alias("g_lo"), F.col("hi").alias("g_hi")), page, "left")
    rows = rows.select(*page, "idx", "x1", "x2", "y1", "y2", "g_lo", "g_hi", F.percentile(F.col("y2") - F.col("y1"), F.lit(0.5)).over(w).alias("line"), F.min("y1").over(w).alias("top"), F.max("y2").over(w).alias("bottom"), F.min("x1").over(w).alias("left"), F.max("x2").over(w).alias("right"), F.count(F.lit(1)).over(w).alias("n"))
    high = (F.col("y1") <= F.col("top") + (F.col("bottom") - F.col("top")) / 3) & (F.col("n") >= 3)
    large = (F.col("y2") - F.col("y1") >= TALL * F.col("line")) | _spans(F.col("x1"), F.col("x2"), F.col("g_lo"), F.col("g_hi"), F.col("left"), F.col("right"))
    rows = rows.select(*page, "idx", "x1", "x2", "y1", "y2", "line", (high & large).alias("head"))
    rows = _kept(rows.withColumn("_any", F.max("head").over(w)).filter("_any").drop("_any"))  # other pages have none
    p, q = F.col("p"), F.col("q")  # p above q
    above = (p["y2"] <= q["y1"] + 0.5 * q["line"]) & (F.least(p["x2"], q["x2"]) > F.greatest(p["x1"], q["x1"])) & q["head"]
    covers = _kept(_meeting(rows, page, ["idx", "x1", "x2", "y1", "y2", "line", "head"], "x1", "x2").filter(above).select(*page, F.col("p.idx").alias("by"), F.col("q.idx").alias("idx")))
    heads = _kept(rows.filter("head").select(*page, "idx"))
    while True:  # what text stands above is text itself
        under = covers.join(heads.withColumnRenamed("idx", "by"), [*page, "by"], "left_anti").select(*page, "idx").distinct()
        fewer = _kept(heads.join(under, [*page, "idx"], "left_anti"))
        if fewer.count() == heads.count():
            return fewer
        heads = fewer


def _cut(boxes: DataFrame, region: list[str], found: DataFrame) -> DataFrame:
    """Boxes with ``part`` by the gutters ``found``, the number of their part of the region. A region is cut at the widest empty band across, if it
    has no gutter or the band is ``WIDER`` times as wide; else at its gutter, the right side first; else at all bands.
    Beside a gutter only bands next to a box that spans it count. A region that is not cut has the one part 0. A region of
    fewer than ``FEWEST`` boxes has no gutter, nor have its parts: it is cut at all bands at once, which one after the other
    would leave the same parts. ``_done``: whether the part needs no further cut, as it is the region, part of such a region or
    ``_alone``, one box."""
    order = Window.partitionBy(*region).orderBy("y1", "idx")
    whole, before = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = boxes.join(found.select(*region, F.col("lo").alias("g_lo"), F.col("hi").alias("g_hi")), region, "left")
    rows = rows.withColumns({"_k": F.row_number().over(order), "_n": F.count(F.lit(1)).over(whole), "_left": F.min("x1").over(whole), "_right": F.max("x2").over(whole)})
    rows = rows.withColumn("_deep", F.max(F.struct("y2", (-F.col("_k")).alias("k"), "x1", "x2")).over(before))
    gap = F.col("y1") - F.col("_deep.y2")
    beside = [_spans(x1, x2, F.col("g_lo"), F.col("g_hi"), F.col("_left"), F.col("_right")) for x1, x2 in ((F.col("_deep.x1"), F.col("_deep.x2")), (F.col("x1"), F.col("x2")))]
    counts = (gap > 0) & (F.col("g_lo").isNull() | beside[0] | beside[1])
    rows = rows.withColumn("_band", F.max(F.when(counts, F.struct(gap.alias("gap"), (-F.col("_k")).alias("k")))).over(whole))
    few = F.col("_n") < FEWEST
    rows = rows.withColumn("_group", F.sum(F.coalesce(F.when(few, gap > 0).otherwise(gap >= 1.0).cast("int"), F.lit(0))).over(order))
    width = F.col("g_hi") - F.col("g_lo")
    across = F.coalesce(F.col("_band.gap").isNotNull() & (F.col("g_lo").isNull() | (F.col("_band.gap") > WIDER * width)), F.lit(False))
    left_side = ((F.col("x1") + F.col("x2")) / 2 < (F.col("g_lo") + F.col("g_hi")) / 2).cast("int")
    beside_gutter = F.col("g_lo").isNotNull() & ~few & ~across
    part = F.when(few, F.col("_group")).when(across, (F.col("_k") >= -F.col("_band.k")).cast("int")).when(F.col("g_lo").isNotNull(), left_side).otherwise(F.col("_group"))
    rows = rows.withColumns({"part": part.cast("int"), "_beside": beside_gutter})
    rows = rows.withColumns({"_parts": F.max("part").over(whole), "_ones": F.sum("part").over(whole), "_up": F.lag("part").over(order), "_down": F.lead("part").over(order)})
    # other parts than the sides of a gutter follow each other from top to bottom
    of_side = F.when(F.col("part") == 1, F.col("_ones")).otherwise(F.col("_n") - F.col("_ones"))
    alone = F.when(F.col("_beside"), of_side == 1).otherwise(~F.col("part").eqNullSafe(F.col("_up")) & ~F.col("part").eqNullSafe(F.col("_down")))
    rows = rows.withColumn("_alone", alone).withColumn("_done", (F.col("_parts") == 0) | few | F.col("_alone"))
    return rows.select(*boxes.columns, "part", "_alone", "_done")


def _rows(boxes: DataFrame, region: list[str]) -> DataFrame:
    """Boxes with ``row``: from the top, a box is of the first row whose first box is as high as its middle, else a new one."""
    columns = [c for c in boxes.columns if c not in region]
    sorted_ = F.array_sort(F.collect_list(F.struct(((F.col("y1") + F.col("y2")) / 2).alias("_y"), F.col("idx").alias("_i"), F.struct(*columns).alias("b"))))
    fits = lambda acc, x: F.filter(F.transform(acc["firsts"], lambda f, i: F.when((f["y1"] <= x["_y"]) & (x["_y"] <= f["y2"]), i)), lambda i: i.isNotNull())
    start = F.struct(F.array().cast("array<struct<y1:double,y2:double>>").alias("firsts"), F.array().cast("array<int>").alias("rows"))

    def step(acc, x):
        row = F.coalesce(F.get(fits(acc, x), F.lit(0)), F.size(acc["firsts"]))
        first = F.array(F.struct(x["b"]["y1"].cast("double").alias("y1"), x["b"]["y2"].cast("double").alias("y2")))
        return F.struct(F.when(row == F.size(acc["firsts"]), F.concat(acc["firsts"], first)).otherwise(acc["firsts"]).alias("firsts"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    folded = boxes.groupBy(*region).agg(sorted_.alias("s")).withColumn("r", F.aggregate("s", start, step)["rows"])
    out = folded.select(*region, F.explode(F.arrays_zip("s", "r")).alias("z"))
    return out.select(*region, *[F.col(f"z.s.b.{c}").alias(c) for c in columns], F.col("z.r").alias("row"))


def reading_order(boxes: DataFrame, page: list[str], width: str = "page_width", share: float = 0.008) -> DataFrame:
    """Boxes with ``place``, their position in right-to-left reading order (from 0): headlines, then the regions that cuts
    leave, each in rows from the top and from the right, the page number last; ties by idx. A gutter that boxes cross must be
    ``share`` of the page's width."""
    least = F.col(width) * share
    body = _kept(_numbered(boxes, page))
    found = _kept(gutters(body.filter("not _last"), page, least))
    heads = headlines(body.filter("not _last"), page, least, found)
    kind = F.when(F.col("_last"), 2).when(F.coalesce("_head", F.lit(False)), 0).otherwise(1)
    body = _kept(body.join(heads.withColumn("_head", F.lit(True)), [*page, "idx"], "left").withColumn("_kind", kind).drop("_last", "_head").withColumn("_region", F.array(F.col("_kind"))))
    region = [*page, "_region"]
    done, open_ = body.filter("_kind <> 1").withColumn("_alone", F.col("_kind") == 2), body.filter("_kind = 1")
    # pages without a headline have the gutters that were found for all their boxes
    headed = heads.select(*page).distinct()
    found = found.join(headed, page, "left_anti").withColumn("_region", F.array(F.lit(1))).unionByName(gutters(open_.join(headed, page, "left_semi"), region, least))
    while not open_.isEmpty():
        parts = _kept(_cut(open_, region, found).withColumn("_region", F.concat("_region", F.array("part"))).drop("part"))
        done = done.unionByName(parts.filter("_done").drop("_done"))
        open_ = parts.filter("not _done").drop("_done", "_alone")
        found = gutters(open_, region, least)
    single, several = done.filter("_alone").drop("_alone"), done.filter("not _alone").drop("_alone")
    placed = single.withColumn("row", F.lit(0)).unionByName(_rows(several, region))
    order = Window.partitionBy(*page).orderBy("_region", "row", -(F.col("x1") + F.col("x2")), (F.col("y1") + F.col("y2")), "idx")
    return placed.withColumn("place", (F.row_number().over(order) - 1).cast("long")).select(*boxes.columns, "place")
