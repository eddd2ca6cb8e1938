"""Page evaluation: predicted against gold line boxes of each page.

Candidates come from an equi join on the page and a band of the y axis, so a page with very many boxes is not compared
all against all. Matching is one-to-one and greedy by confidence within a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import measured
from ..functions.boxes import intersects, iou
from ..functions.scalars import ratio
from ..functions.text import new_repeat_run
from ..sources.store import kept

IOU = 0.5
BAND = 64.0
LONG, SHORT = 1.15, 0.85
OPEN, TAKEN, CLOSED = 0, 1, 2
#: Rounds of matching that are worked out before what is open is written. Each holds more sorts of all edges in a task's memory.
ROUNDS = 1


def _boxes(lines: DataFrame, name: str, page: list[str]) -> DataFrame:
    return lines.select(*page, F.struct("idx", "x1", "y1", "x2", "y2", *[c for c in ("conf", "text") if c in lines.columns]).alias(name))


def touching(pred: DataFrame, gold: DataFrame, page: list[str]) -> DataFrame:
    """(page, p, g) of all boxes of a page that overlap."""
    bands = lambda b: F.explode(F.sequence(F.floor(F.col(f"{b}.y1") / BAND), F.floor(F.greatest(F.col(f"{b}.y1"), F.col(f"{b}.y2")) / BAND)))
    p, g = _boxes(pred, "p", page).withColumn("band", bands("p")), _boxes(gold, "g", page).withColumn("band", bands("g"))
    # a pair is kept in the first band that both are in
    own = F.col("band") == F.floor(F.greatest(F.col("p.y1"), F.col("g.y1")) / BAND)
    return p.join(g, [*page, "band"]).filter(own & intersects(F.col("p"), F.col("g"))).drop("band")


def _near_enough(met: DataFrame, threshold: float) -> DataFrame:
    return met.withColumn("iou", iou(F.col("p"), F.col("g"))).filter(F.col("iou") >= threshold)


def iou_candidates(pred: DataFrame, gold: DataFrame, page: list[str], threshold: float = IOU) -> DataFrame:
    return _near_enough(touching(pred, gold, page), threshold)


def match_lines(pred: DataFrame, gold: DataFrame, page: list[str], threshold: float = IOU) -> DataFrame:
    """(page, p, g, iou): predictions by confidence (missing counts as 1, ties by position) each take the best gold box
    still free; of equally good ones the first."""
    return _matched(iou_candidates(pred, gold, page, threshold), page)


def _matched(candidates: DataFrame, page: list[str]) -> DataFrame:
    """The greedy choice over edges in order of confidence, position and overlap, for all pages at once.

    An edge that comes first among the open edges of both its ends is one that the greedy choice takes, and ends all other
    edges of these. Rounds of this give the whole choice; a round takes an edge of every group of boxes that are still linked, so
    there are no more rounds than such a group has matches, and mostly one or two. ROUNDS of them are one job.
    """
    rank = F.struct((-F.coalesce("p.conf", F.lit(1.0))).alias("c"), F.col("p.idx").alias("p"), (-F.col("iou")).alias("o"), F.col("g.idx").alias("g"))
    ends = [Window.partitionBy(*page, f"end{k}") for k in (0, 1)]
    rows, chosen = candidates.repartition(*page).select("*", F.col("p.idx").alias("end0"), F.col("g.idx").alias("end1"), rank.alias("rank"), F.lit(OPEN).alias("state")), []
    while True:
        for _ in range(ROUNDS):
            is_open = F.col("state") == OPEN
            # by ends 0, 1, then 1, 0: three sorts, since what a step leaves sorted by an end serves the next one
            for k in (0, 1):
                rows = rows.withColumn(f"first{k}", F.min(F.when(is_open, F.col("rank"))).over(ends[k]))
            rows = rows.withColumn("state", F.when(is_open & (F.col("rank") == F.col("first0")) & (F.col("rank") == F.col("first1")), TAKEN).otherwise(F.col("state"))).drop("first0", "first1")
            for k in (1, 0):
                rows = rows.withColumn(f"met{k}", F.max(F.col("state") == TAKEN).over(ends[k]))
            rows = rows.withColumn("state", F.when(is_open & (F.col("met0") | F.col("met1")), CLOSED).otherwise(F.col("state"))).drop("met0", "met1")
        done = kept(rows.filter(F.col("state") != CLOSED).select(*page, "p", "g", "iou", "end0", "end1", "rank", "state"), "edges")
        chosen.append(done.filter(F.col("state") == TAKEN).select(*page, "p", "g", "iou"))
        left = done.filter(F.col("state") == OPEN)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, chosen)
        rows = left.repartition(*page)


def line_outcomes(pred: DataFrame, gold: DataFrame, page: list[str], threshold: float = IOU, repeated: str = ".") -> DataFrame:
    """(page, kind, edits, gold_chars, longer, shorter, repeats, touches): matched pairs, extra and missed lines. ``repeated``
    (a pattern of one character) says of which characters a run counts as a repeat, by default of all."""
    return compared(pred, gold, page, threshold, repeated)[0]


def compared(pred: DataFrame, gold: DataFrame, page: list[str], threshold: float = IOU, repeated: str = ".") -> tuple[DataFrame, DataFrame]:
    """The outcomes of ``line_outcomes`` and the pairs of ``match_lines``, from boxes that meet once."""
    pred, gold = (lines.withColumn("text", F.coalesce("text", F.lit(""))) for lines in (pred, gold))  # a line without text is empty
    met = kept(touching(pred, gold, page), "touching")
    pairs = _matched(_near_enough(met, threshold), page)
    p, g = F.col("p.text"), F.col("g.text")
    longer = F.length(p) > LONG * F.length(g)
    matched = pairs.select(
        *page, F.lit("matched").alias("kind"), F.levenshtein(g, p).cast("long").alias("edits"), F.length(g).cast("long").alias("gold_chars"), longer.alias("longer"), ((~longer) & (F.length(p) < SHORT * F.length(g))).alias("shorter"), new_repeat_run(p, g, of=repeated).alias("repeats"), F.lit(True).alias("touches")
    )

    def unmatched(lines: DataFrame, side: str, kind: str) -> DataFrame:
        mine = pairs.select(*page, F.col(f"{side}.idx").alias("idx"))
        near = met.select(*page, F.col(f"{side}.idx").alias("idx")).distinct().withColumn("near", F.lit(True))
        left = lines.join(mine, [*page, "idx"], "left_anti").join(near, [*page, "idx"], "left")
        size = F.length("text").cast("long")
        repeats = new_repeat_run(F.col("text"), F.lit(""), of=repeated) if kind == "extra" else F.lit(False)
        gold_chars = size if kind == "missed" else F.lit(0).cast("long")
        return left.select(*page, F.lit(kind).alias("kind"), size.alias("edits"), gold_chars.alias("gold_chars"), F.lit(False).alias("longer"), F.lit(False).alias("shorter"), repeats.alias("repeats"), F.coalesce("near", F.lit(False)).alias("touches"))

    return matched.unionByName(unmatched(pred, "p", "extra")).unionByName(unmatched(gold, "g", "missed")), pairs


def page_scores(outcomes: DataFrame, page: list[str]) -> DataFrame:
    """Matched-line CER with its parts, precision and recall; per page and, where page is null, over all."""
    kind = lambda k: F.col("kind") == k
    sums = outcomes.groupingSets([[F.col(c) for c in page], []], *[F.col(c) for c in page]).agg(
        *[F.coalesce(F.sum(F.when(kind(k), F.col("edits"))), F.lit(0)).alias(f"{k}_edits") for k in ("matched", "missed", "extra")],
        *[F.count_if(kind(k)).alias(k) for k in ("matched", "missed", "extra")],
        F.sum("gold_chars").alias("gold_chars"),
    )
    edits = F.col("matched_edits") + F.col("missed_edits") + F.col("extra_edits")
    return sums.select("*", edits.alias("edits"), ratio(edits, F.col("gold_chars")).alias("cer"), ratio(F.col("matched"), F.col("matched") + F.col("extra")).alias("precision"), ratio(F.col("matched"), F.col("matched") + F.col("missed")).alias("recall"))


def error_breakdown(outcomes: DataFrame, page: list[str] | None = None) -> DataFrame:
    """(page, category, lines, edits, gold_chars); a line can be in several categories. Without ``page``: over all."""
    c = lambda test, name: F.when(test, F.lit(name))
    kind = F.col("kind")
    names = F.array_compact(F.array(
        c(kind == "matched", "recognition"), c(F.col("longer"), "length_mismatch_longer"), c(F.col("shorter"), "length_mismatch_shorter"), c(F.col("repeats"), "repeated_run"),
        c((kind == "extra") & F.col("touches"), "extra_overlaps_gold"), c((kind == "extra") & ~F.col("touches"), "extra_no_gold_overlap"), c((kind == "missed") & F.col("touches"), "missed_partly_covered"), c((kind == "missed") & ~F.col("touches"), "missed_not_detected"),
    ))
    rows = outcomes.select(*(page or []), F.explode(names).alias("category"), "edits", F.when(kind == "matched", F.col("gold_chars")).otherwise(0).alias("gold_chars"))
    return rows.groupBy(*(page or []), "category").agg(F.count(F.lit(1)).alias("lines"), F.sum("edits").alias("edits"), F.sum("gold_chars").alias("gold_chars"))


def joined_text(lines: DataFrame, page: list[str], order: str, skip_empty: bool) -> DataFrame:
    rows = lines.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.filter("text <> ''") if skip_empty else rows
    return rows.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("text"))


def page_cer(pred: DataFrame, gold: DataFrame, page: list[str], order: str = "idx") -> DataFrame:
    """Edits and CER of whole page texts, predicted lines in reading order, gold lines in gold order."""
    both = joined_text(gold, page, order, False).withColumnRenamed("text", "g").join(joined_text(pred, page, order, True).withColumnRenamed("text", "p"), page, "left")
    edits, chars = F.col("m.edits"), F.col("m.a_chars")
    return both.select(*page, measured(F.col("g"), F.coalesce("p", F.lit(""))).alias("m")).select(*page, edits.alias("edits"), chars.alias("gold_chars"), ratio(edits, chars).alias("page_cer"))


def order_agreement(pairs: DataFrame, page: list[str], pred_rank: str = "p.idx", gold_rank: str = "g.idx") -> DataFrame:
    """Kendall's tau of matched lines per page; null under two lines. Every pair that is not concordant is discordant.

    Lines are numbered in gold order. Two of them part at the highest bit in which their numbers differ, so each pair is met once:
    at the level of that bit, in the block of the bits above it. There one sort by predicted rank counts, for each line of the
    upper half, those of the lower half before it: n log n rows of a page in sorts, and nothing is gathered.
    """
    here = Window.partitionBy(*page)
    rows = pairs.select(*page, F.col(gold_rank).alias("g"), F.col(pred_rank).alias("p"))
    rows = rows.withColumn("place", F.row_number().over(here.orderBy("g", "p")) - 1).withColumn("n", F.count(F.lit(1)).over(here))
    levels = rows.filter("n > 1").withColumn("level", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("n") - 1)) - 1)))
    levels = levels.withColumn("upper", F.expr("shiftright(place, level) % 2")).withColumn("block", F.expr("shiftright(place, level + 1)"))
    # Of equal predicted ranks the upper half's lines come first: they are not concordant.
    before = Window.partitionBy(*page, "level", "block").orderBy("p", F.desc("upper")).rowsBetween(Window.unboundedPreceding, -1)
    met = levels.withColumn("lower", F.sum(1 - F.col("upper")).over(before)).filter("upper = 1").groupBy(*page).agg(F.sum("lower").alias("concordant"))
    n = F.col("lines")
    out = rows.groupBy(*page).agg(F.count(F.lit(1)).alias("lines")).join(met, page, "left")
    out = out.select(*page, "lines", F.coalesce("concordant", F.lit(0)).alias("concordant"), (n * (n - 1) / 2).cast("long").alias("pairs"))
    return out.withColumn("tau", ratio(2 * F.col("concordant") - F.col("pairs"), F.col("pairs")))


def overall(pages: DataFrame) -> DataFrame:
    """One row over page rows with edits, gold_chars, matched, extra, missed, concordant, pairs, tau, seconds, reviewed."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    cer = ratio(s("edits"), s("gold_chars"))
    return pages.agg(
        F.count(F.lit(1)).alias("pages"), cer.alias("cer"), F.round(1 - cer, 6).alias("accuracy"), ratio(2 * s("concordant") - s("pairs"), s("pairs")).alias("pooled_tau"), F.round(F.avg("tau"), 6).alias("mean_tau"), F.count_if("reviewed").alias("reviewed_pages"),
        ratio(s("matched"), s("matched") + s("extra")).alias("precision"), ratio(s("matched"), s("matched") + s("missed")).alias("recall"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.percentile("seconds", F.lit(0.5)), 6).alias("median_seconds"),
    )


def detector_stats(pred: DataFrame, gold: DataFrame, page: list[str], threshold: float = IOU) -> DataFrame:
    """tp, precision and recall per page at an overlap, 3 digits, 0 on empty sides."""
    tp = match_lines(pred.drop("text"), gold.drop("text"), page, threshold).groupBy(*page).agg(F.count(F.lit(1)).alias("tp"))
    sides = [d.groupBy(*page).agg(F.count(F.lit(1)).alias(n)) for d, n in ((pred, "n_pred"), (gold, "n_gold"))]
    rows = sides[0].join(sides[1], page, "full").join(tp, page, "left").fillna(0, ["tp", "n_pred", "n_gold"])
    share = lambda n: F.when(F.col(n) > 0, F.round(F.col("tp") / F.col(n), 3)).otherwise(0.0)
    return rows.select(*page, "tp", "n_pred", "n_gold", share("n_pred").alias("precision"), share("n_gold").alias("recall"))


def usable_gold(gold: DataFrame, least_side: float = 3.0) -> DataFrame:
    return gold.filter((F.length("text") > 0) & (F.col("x2") - F.col("x1") >= least_side) & (F.col("y2") - F.col("y1") >= least_side))


def reviewed_order(gold: DataFrame, orders: DataFrame, page: list[str]) -> DataFrame:
    """Gold lines with ``place``: the reviewed position where a page has one, else the line's own index. ``orders`` has
    the page and order (array); an order that is no permutation of the page's lines is an error."""
    sizes = gold.groupBy(*page).agg(F.count(F.lit(1)).alias("n"))
    ok = orders.join(sizes, page).withColumn("fine", F.array_sort("order") == F.sequence(F.lit(0), F.col("n").cast("int") - 1))
    places = ok.select(*page, F.posexplode(F.when(F.col("fine"), F.col("order")).otherwise(F.raise_error(F.lit("reading order is not a permutation")).cast("array<int>"))).alias("place", "line"))
    at = F.row_number().over(Window.partitionBy(*page).orderBy("idx")) - 1
    return gold.withColumn("line", at).join(places, [*page, "line"], "left").withColumn("place", F.coalesce("place", "line")).drop("line")
