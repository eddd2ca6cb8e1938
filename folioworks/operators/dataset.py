"""Line datasets: article-level splits, label clean-up, statistics, detector labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import centre_box
from ..functions.text import LABEL_MAP, SPECIAL_LETTERS, strip


def split_articles(articles: DataFrame, test: DataFrame, key: str = "article_id", val_share: float = 0.12, seed: int = 0) -> DataFrame:
    """(article, split): locked test articles, then of the rest in hash order the first max(1, share) as val.

    The number of articles that come before one is counted by hash bucket first, so no task ranks all of them.
    """
    rest = articles.select(key).distinct().join(test.select(key).distinct(), key, "left_anti").withColumn("h", F.xxhash64(F.col(key), F.lit(seed)))
    rest = rest.withColumn("b", F.shiftright("h", 54))  # at most 1024 buckets
    per = rest.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    ranked = rest.join(F.broadcast(before), "b").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h", key)))
    val = F.col("rank") <= F.greatest(F.lit(1), F.bround(val_share * F.col("total"), 0))
    own = articles.select(key).distinct().join(test.select(key).distinct(), key, "left_semi").withColumn("split", F.lit("test"))
    return ranked.select(key, F.when(val, "val").otherwise("train").alias("split")).unionByName(own)


def overlapping_splits(splits: DataFrame, key: str = "article_id") -> DataFrame:
    """Articles that are in more than one split; none in a sound dataset."""
    return splits.groupBy(key).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


def split_stats(lines: DataFrame) -> DataFrame:
    """Per split: lines, articles, pages, and the sorted article list."""
    return lines.groupBy("split").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("article_id").alias("articles"), F.countDistinct("article_id", "page_index").alias("pages"), F.array_join(F.sort_array(F.collect_set("article_id")), ",").alias("article_list")
    )


def source_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("split", "source").agg(F.count(F.lit(1)).alias("lines"))


def character_counts(lines: DataFrame, text: str = "text") -> DataFrame:
    """(ch, n): how often each character occurs."""
    return lines.select(F.explode(F.split(F.col(text), "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def character_set(lines: DataFrame, special: str = SPECIAL_LETTERS) -> DataFrame:
    """One row: the size of the character set, the characters in order, counts of the special letters."""
    counts = character_counts(lines)
    return counts.agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("ch")), "").alias("charset"), *[F.coalesce(F.sum(F.when(F.col("ch") == c, F.col("n"))), F.lit(0)).alias(f"special_{i}") for i, c in enumerate(special)])


def length_quantiles(lines: DataFrame, text: str = "text") -> DataFrame:
    """Least, upper median, p95, p99 and greatest length by index in the sorted lengths, not interpolated.

    Lengths are counted first: there are few different ones, however many lines.
    """
    counts = lines.groupBy(F.length(text).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    running = counts.select("len", F.sum("n").over(Window.orderBy("len")).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col("len")))
    total = F.col("total")
    return running.agg(F.min("len").alias("min"), at(F.floor(total / 2)).alias("median"), at(F.floor(total * 0.95)).alias("p95"), at(F.floor(total * 0.99)).alias("p99"), F.max("len").alias("max"))


def label_fixes(lines: DataFrame, rules: tuple = LABEL_MAP, text: str = "text") -> DataFrame:
    """(rule, n): how many replacements each rule makes, the rules applied one after the other."""
    counts, current = [], F.col(text)
    for old, new in rules:
        replaced = F.replace(current, F.lit(old), F.lit(new))
        gone = (F.length(current) - F.length(F.replace(current, F.lit(old), F.lit("")))) / len(old)
        counts.append(F.struct(F.lit(f"{old}->{new}").alias("rule"), gone.cast("long").alias("n")))
        current = replaced
    return lines.select(F.explode(F.array(*counts)).alias("c")).groupBy("c.rule").agg(F.sum("c.n").alias("n")).filter("n > 0")


def words_to_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """OCR words grouped to lines: text in order, bounding box, mean confidence / 100 to 4 digits. Blank words and
    layout rows (negative confidence) go."""
    used = words.filter((strip(F.col("text")) != "") & (F.col("conf") >= 0))
    return used.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.min("left").alias("left"), F.min("top").alias("top"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"), (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"), F.round(F.avg("conf") / 100, 4).alias("confidence"),
    )


def detector_labels(boxes: DataFrame, page: list[str]) -> DataFrame:
    """Per page the label text ``0 cx cy w h``, one line per box in order; boxes without area go."""
    c = centre_box(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    line = F.format_string("0 %.6f %.6f %.6f %.6f", F.col("c.cx"), F.col("c.cy"), F.col("c.w"), F.col("c.h"))
    rows = boxes.filter("width > 0 and height > 0").withColumn("c", c).select(*page, "line_index", line.alias("line"))
    return rows.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda x: x["line"]), "\n").alias("label"))


def confident(boxes: DataFrame, least: float = 0.35) -> DataFrame:
    """Detected boxes of at least this confidence."""
    return boxes.filter(F.col("conf") >= least)


def export_summary(boxes: DataFrame, page: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """(split, pages, boxes, articles) of exported boxes (article_id, split, width, height); excluded articles make a row of
    their own, with the articles that were asked to stay out. Boxes without area are not counted, their pages are."""
    whole = F.col("width") * F.col("height") > 0
    per = boxes.groupBy("split", "article_id", *[c for c in page if c != "article_id"]).agg(F.count_if(whole & (F.col("width") > 0)).alias("boxes"))
    articles = per.groupBy("split", "article_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("boxes").alias("boxes"))
    listed = articles.groupBy("split").agg(F.sum("pages").alias("pages"), F.sum("boxes").alias("boxes"), F.array_sort(F.collect_list("article_id")).alias("articles"))
    if excluded is None:
        return listed
    out = excluded.select("article_id").distinct().agg(F.array_sort(F.collect_list("article_id")).alias("articles"))
    return listed.unionByName(out.select(F.lit("excluded").alias("split"), F.lit(0).cast("long").alias("pages"), F.lit(0).cast("long").alias("boxes"), "articles"))


def page_boxes(lines: DataFrame) -> DataFrame:
    """Per article its pages in order with their line counts, and the totals."""
    pages = lines.groupBy("article_id", "page_index").agg(F.count(F.lit(1)).alias("lines"))
    return pages.groupBy("article_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("lines").alias("lines"), F.array_sort(F.collect_list(F.struct("page_index", "lines"))).alias("per_page"))


def short_articles(lines: DataFrame, least: int = 3) -> DataFrame:
    counts = lines.groupBy("article_id").agg(F.count(F.lit(1)).alias("lines"))
    return counts.withColumn("suspicious", F.col("lines") < least)


def article_totals(lines: DataFrame) -> DataFrame:
    """Pages and lines of each article with the per-page counts in page order, and a total row (article null)."""
    pages = lines.groupBy("article_id", "page_index").agg(F.count(F.lit(1)).alias("n"))
    return pages.rollup("article_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("lines"))


def exported_pairs(lines: DataFrame) -> DataFrame:
    """Lines with text per article and in all (article null)."""
    return lines.filter(strip(F.coalesce("text", F.lit(""))) != "").rollup("article_id").agg(F.count(F.lit(1)).alias("pairs"))


def label_length(lines: DataFrame, text: str = "text", spare: int = 8, most: int = 512) -> DataFrame:
    return lines.agg(F.least(F.lit(most), F.coalesce(F.max(F.length(text)), F.lit(0)) + spare).alias("max_label_length"))


def of_issues(articles: DataFrame, prefixes: list[str], key: str = "article_id") -> DataFrame:
    keep: Column = F.lit(False)
    for p in prefixes:
        keep = keep | F.startswith(F.col(key), F.lit(p))
    return articles.filter(keep)


def keep_pages(lines: DataFrame, articles: DataFrame, excluded: DataFrame) -> DataFrame:
    """Lines of the given articles, without the excluded pages."""
    return lines.join(articles.select("article_id"), "article_id", "left_semi").join(excluded.select("article_id", "page_index"), ["article_id", "page_index"], "left_anti")


def pages_without_image(annotated: DataFrame, images: DataFrame, page: list[str]) -> DataFrame:
    return annotated.select(*page).distinct().join(images, page, "left_anti")


def image_source(pages: DataFrame, full: DataFrame, preview: DataFrame, page: list[str]) -> DataFrame:
    """Pages with the path and source of their image: full page, else preview; neither is an error."""
    both = pages.join(full.select(*page, F.col("path").alias("f")), page, "left").join(preview.select(*page, F.col("path").alias("p")), page, "left")
    path = F.coalesce("f", "p", F.raise_error(F.lit("page has no image")).cast("string"))
    return both.withColumn("source", F.when(F.col("f").isNotNull(), "full").otherwise("preview")).withColumn("path", path).drop("f", "p")


def first_existing(wanted: DataFrame, files: DataFrame, names: Column) -> DataFrame:
    """The file of each wanted row that comes first among its candidate names (array column)."""
    tried = wanted.select("*", F.posexplode(names).alias("rank", "name")).join(files.select("name"), "name")
    keys = wanted.columns
    return tried.groupBy(*keys).agg(F.min_by("name", "rank").alias("name"))


def first_pages(lines: DataFrame, page: list[str], n: int) -> DataFrame:
    """The first n pages in page order."""
    return lines.select(*page).distinct().orderBy(*page).limit(n)
