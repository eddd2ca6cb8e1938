"""Annotation exports: latest state per page, boxes with their texts, alignment with ground truth, import tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell_lines, script_fraction, strip


def latest_annotation(annotations: Column) -> Column:
    """The annotation that was not cancelled and changed last; of equally late ones the first."""
    stamp = lambda a: F.coalesce(a["updated_at"], a["created_at"], F.lit(""))
    live = F.filter(annotations, lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    newest = F.array_max(F.transform(live, stamp))
    return F.get(F.filter(live, lambda a: stamp(a) == newest), F.lit(0))


def latest_per_page(rows: DataFrame, page: list[str], stamp: str, position: str, what: str = "kept") -> DataFrame:
    """The newest row of each page (ties: the later position), or with ``what="dropped"`` all others."""
    w = Window.partitionBy(*page).orderBy(F.desc(stamp), F.desc(position))
    ranked = rows.withColumn("_k", F.row_number().over(w))
    return ranked.filter(F.col("_k") == 1 if what == "kept" else F.col("_k") > 1).drop("_k")


def split_by_metadata(tasks: DataFrame, keys: list[str], overrides: DataFrame | None = None, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(tasks with all keys, the others); ``overrides`` has the id and the keys."""
    if overrides is not None:
        other = overrides.select(F.col(id_col), *[F.col(k).alias(f"_{k}") for k in keys])
        tasks = tasks.join(other, id_col, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in keys else F.col(c) for c in tasks.columns])
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return tasks.filter(~missing), tasks.filter(missing)


def region_lines(regions: Column) -> Column:
    """array<struct<line_index, id, box, text>>: box regions in order with the text region of the same id; texts without a box go."""
    boxes = F.filter(regions, lambda r: r["type"] == "rectangle")
    text = lambda i: F.get(F.filter(regions, lambda r: (r["type"] == "textarea") & (r["id"] == i)), F.lit(0))["text"]
    return F.transform(boxes, lambda b, k: F.struct((k + 1).alias("line_index"), b["id"].alias("id"), F.struct(b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("width"), b["height"].alias("height")).alias("box"), F.coalesce(text(b["id"]), F.lit("")).alias("text")))


def join_regions(boxes: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Box rows with the text row of the same keys, else an empty text."""
    return boxes.join(texts.select(*keys, F.col("text").alias("_t")), keys, "left").withColumn("text", F.coalesce("_t", F.lit(""))).drop("_t")


def complete_pages(lines: DataFrame, page: list[str], fail: bool = False) -> DataFrame:
    """Lines of the pages all of whose boxes have text; with ``fail`` an incomplete page is an error instead."""
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    rows = lines.withColumn("_gap", F.max(blank).over(Window.partitionBy(*page)))
    if fail:
        rows = rows.withColumn("_gap", F.when(F.col("_gap"), F.raise_error(F.lit("a page has boxes without text")).cast("boolean")).otherwise(F.lit(False)))
    return rows.filter("not _gap").drop("_gap")


def untexted_boxes(lines: DataFrame, page: list[str]) -> DataFrame:
    """Per page: lines, boxes without text, and whether the page is incomplete."""
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    return lines.groupBy(*page).agg(F.count(F.lit(1)).alias("lines"), F.count_if(blank).alias("untexted"), F.max(blank).alias("incomplete"))


def assign_lines(boxes: DataFrame, truth: DataFrame, article: str = "article_id", order: tuple = ("page_index", "line_index")) -> DataFrame:
    """The n-th box of an article gets its n-th ground-truth line; boxes beyond the last line get an empty text."""
    w = Window.partitionBy(article).orderBy(*order)
    placed = boxes.withColumn("_n", F.row_number().over(w))
    lines = truth.withColumn("_n", F.row_number().over(Window.partitionBy(article).orderBy("ord"))).select(article, "_n", F.col("text").alias("_t"))
    return placed.join(lines, [article, "_n"], "left").withColumn("text", F.coalesce("_t", F.lit(""))).drop("_n", "_t")


def lines_before_page(pages: DataFrame, article: str = "article_id", page: str = "page_index", n: str = "lines") -> DataFrame:
    """Pages with how many lines of the article earlier pages use."""
    w = Window.partitionBy(article).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)))


def count_differences(boxes: DataFrame, truth: DataFrame, article: str = "article_id", soft: int = 3) -> DataFrame:
    """Per article: box and line counts, their difference, whether they are equal and whether they differ by more than ``soft``."""
    a, b = (d.groupBy(article).agg(F.count(F.lit(1)).alias(n)) for d, n in ((boxes, "boxes"), (truth, "lines")))
    both = a.join(b, article, "full").fillna(0, ["boxes", "lines"]).withColumn("diff", F.col("boxes") - F.col("lines"))
    return both.withColumn("equal", F.col("diff") == 0).withColumn("far", F.abs("diff") > soft)


def pair_by_position(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides with the same position in their group; what one side has more is dropped."""
    number = lambda d, o: d.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(o)))
    return number(left, left_order).join(number(right, right_order), [group, "_n"]).drop("_n")


def truth_column(cells: DataFrame, article: str = "article_id", sample: int = 8, block: str | None = None, strict: bool = True) -> DataFrame:
    """The last column of each sheet whose sampled cells are mostly of one script; a sheet without one is an error, or has
    null if not ``strict``.

    ``cells`` has article, row (0 is the header), col, value. A column needs values in half the sampled rows, two at least.
    """
    rows = cells.filter(F.col("row").between(1, sample))
    counts = rows.groupBy(article).agg(F.countDistinct("row").alias("n"))
    share = script_fraction(F.col("value"), block) if block else script_fraction(F.col("value"))
    filled = rows.filter(strip(F.col("value")) != "").groupBy(article, "col").agg(F.count(F.lit(1)).alias("k"), F.avg(share).alias("share"))
    fit = filled.join(counts, article).filter((F.col("k") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2))) & (F.col("share") > 0.5))
    best = fit.groupBy(article).agg(F.max("col").alias("truth_col"))
    checked = counts.select(article).join(best, article, "left")
    if not strict:
        return checked
    none = F.raise_error(F.lit("no column in the expected script")).cast("int")
    return checked.withColumn("truth_col", F.coalesce("truth_col", none))


def truth_lines(cells: DataFrame, chosen: DataFrame, article: str = "article_id") -> DataFrame:
    """(article, ord, text): the lines of the chosen column in row order."""
    rows = cells.join(chosen, article).filter((F.col("col") == F.col("truth_col")) & (F.col("row") >= 1))
    lines = rows.select(article, "row", F.posexplode(cell_lines(F.col("value"))).alias("k", "text"))
    return lines.select(article, F.struct("row", "k").alias("ord"), "text")


def best_sheet(sheets: DataFrame, article: str = "article_id") -> DataFrame:
    """Per article the sheet to use: native before others, DONE in the name before others, then the newest; first wins ties.
    ``matches`` tells how many there were."""
    w = Window.partitionBy(article)
    done = F.contains("name", F.lit("DONE"))
    ranked = sheets.withColumn("_k", F.row_number().over(w.orderBy(F.desc("native"), F.desc(done), F.desc("modified"), "ord"))).withColumn("matches", F.count(F.lit(1)).over(w))
    return ranked.filter("_k = 1").drop("_k")


def discover(scans: DataFrame, sheets: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(scans with their sheet, scans that have none)."""
    return scans.join(sheets, key), scans.join(sheets, key, "left_anti")


def ready_articles(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ready, not ready): scan and sheet present, and the sheet's name says DONE."""
    ok = F.coalesce(F.col("scan").isNotNull() & F.contains("sheet", F.lit("DONE")), F.lit(False))
    return articles.filter(ok), articles.filter(~ok)


def import_task(lines: DataFrame, page: list[str]) -> DataFrame:
    """One JSON task per page: per box a rectangle and a text region that share an id, in line order."""
    rect = F.struct(F.col("id").alias("id"), F.lit("rectangle").alias("type"), F.struct("x", "y", "width", "height", F.lit(None).cast("array<string>").alias("text")).alias("value"))
    area = F.struct(F.col("id").alias("id"), F.lit("textarea").alias("type"), F.struct("x", "y", "width", "height", F.array("text").alias("text")).alias("value"))
    rows = lines.groupBy(*page).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_index", F.array(rect, area).alias("r")))), lambda s: s["r"])).alias("result"))
    return rows.select(*page, F.to_json(F.struct(F.struct(*page).alias("data"), F.array(F.struct("result")).alias("predictions"))).alias("task"))


def replace_page(rows: DataFrame, new: DataFrame, page: list[str]) -> DataFrame:
    """All rows but those of the pages that ``new`` has, and ``new``."""
    return rows.join(new.select(*page).distinct(), page, "left_anti").unionByName(new)


def outlier_boxes(boxes: DataFrame, page: list[str], ratio: float = 1.6, least: int = 3) -> DataFrame:
    """Boxes with ``outlier``: taller than ``ratio`` times the page's upper median, on pages of ``least`` boxes or more."""
    sizes = boxes.groupBy(*page).agg(F.array_sort(F.collect_list(F.col("y2") - F.col("y1"))).alias("h"))
    median = sizes.select(*page, F.element_at("h", F.floor(F.size("h") / 2).cast("int") + 1).alias("median"), F.size("h").alias("n"))
    return boxes.join(median, page).withColumn("outlier", (F.col("n") >= least) & (F.col("y2") - F.col("y1") > ratio * F.col("median"))).drop("n")
