"""Readers: every source as a DataFrame with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import file_type
from ..functions.text import NO_PROVIDER, infer_provider, parse_saved_text, strip
from .records import csv_records, good, json_file_records, json_line_records, rejects

OCR_RECORD = "source_file string, ocr_provider string, ocr_jawi_text string, metadata map<string,string>"
VALUE = "struct<x:double,y:double,width:double,height:double,text:array<string>>"
TASK = f"id bigint, data struct<article_id:string,page_index:int,image:string>, annotations array<struct<was_cancelled:boolean,updated_at:string,created_at:string,result:array<struct<id:string,type:string,value:{VALUE}>>>>"
ANNOTATION_ROW = "article_id string, page_index string, line_index string, x string, y string, w string, h string"
EVENT = "run_id string, seq bigint, ts timestamp, type string, agent string, duration double, incomplete boolean, attempts int, status string, error string"
OCR_PAGE = "run_id string, page int, status string, error string, duration double, lines array<struct<text:string,box:array<int>,confidence:double,order:int,low_confidence:boolean>>"


def ocr_texts(spark: SparkSession, paths, default_provider: str = NO_PROVIDER) -> DataFrame:
    """One record per text file: banner and metadata block parsed, provider inferred."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    parsed = raw.select("source_file", "value", parse_saved_text(F.col("value")).alias("p"))
    name = F.substring_index("source_file", "/", -1)
    return parsed.select("source_file", infer_provider(F.col("p.metadata"), name, F.col("value"), default=default_provider).alias("ocr_provider"), F.col("p.text").alias("ocr_jawi_text"), F.col("p.metadata").alias("metadata"))


def ocr_records(spark: SparkSession, paths) -> DataFrame:
    """JSON records with three required keys; one that is missing is an error. Text is trimmed, metadata defaults to empty."""
    raw = spark.read.schema(OCR_RECORD).json(paths, multiLine=True)
    need = lambda c: F.coalesce(c, F.raise_error(F.lit(f"record without {c}")).cast("string")).alias(c)
    return raw.select(need("source_file"), need("ocr_provider"), strip(need("ocr_jawi_text")).alias("ocr_jawi_text"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def word_pairs(spark: SparkSession, paths) -> DataFrame:
    """(pair, ord) of a JSON array of arrays."""
    raw = spark.read.text(paths, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("p"))
    return raw.select(F.posexplode("p").alias("ord", "pair")).select("pair", "ord")


def phrase_pairs(spark: SparkSession, rumi_path: str, jawi_path: str, split: str = "train") -> DataFrame:
    """(rumi, jawi, ord) of two index-aligned JSON arrays below the split's key; unequal lengths are an error."""
    side = lambda path, name: spark.read.text(path, wholetext=True).select(F.lit(name).alias("side"), F.from_json("value", f"{split} array<string>")[split].alias("words"))
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("words")))
    files = side(rumi_path, "r").unionByName(side(jawi_path, "j")).agg(of("r").alias("r"), of("j").alias("j"), F.count(F.lit(1)).alias("n"))
    both = files.filter(F.when(F.col("n") == 2, True).otherwise(F.raise_error(F.lit("phrases come in one file for each side")).cast("boolean")))
    zipped = F.when(F.size("r") == F.size("j"), F.arrays_zip("r", "j")).otherwise(F.raise_error(F.lit("phrase files differ in length")).cast("array<struct<r:string,j:string>>"))
    return both.select(F.posexplode(zipped).alias("ord", "p")).select(F.col("p.r").alias("rumi"), F.col("p.j").alias("jawi"), "ord")


def json_lines(spark: SparkSession, paths, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """JSONL rows; blank lines are skipped, broken ones are rows of ``json_line_rejects``."""
    return good(json_line_records(spark, paths, schema, required))


def json_line_rejects(spark: SparkSession, paths, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    return rejects(json_line_records(spark, paths, schema, required))


def ratings(spark: SparkSession, paths) -> DataFrame:
    return spark.read.schema("item_id string, rater string, adequacy string, fluency string").csv(paths, header=True)


def annotation_tasks(spark: SparkSession, paths) -> DataFrame:
    """Tasks of export files; what is none is a row of ``annotation_task_rejects``."""
    return good(json_file_records(spark, paths, TASK, ("id",)))


def annotation_task_rejects(spark: SparkSession, paths) -> DataFrame:
    return rejects(json_file_records(spark, paths, TASK, ("id",)))


def annotation_rows(spark: SparkSession, paths) -> DataFrame:
    """Annotation CSV with numbers as whole numbers, sorted by article, page and line."""
    raw = spark.read.schema(ANNOTATION_ROW).csv(paths, header=True)
    return raw.select("article_id", *[F.col(c).cast("double").cast("int").alias(c) for c in raw.columns if c != "article_id"]).orderBy("article_id", "page_index", "line_index")


def sheet_cells(spark: SparkSession, paths, columns: int) -> DataFrame:
    """(article_id, row, col, value) of header-less CSV exports, one file per article; a cell may hold several lines.

    Rows are the file's records, numbered from 0; blank ones have no cells. A file whose quotes do not close is left out and is
    a row of ``sheet_rejects``.
    """
    names = [f"c{i}" for i in range(columns)]
    records = csv_records(spark, paths)[0].filter("value <> ''")
    cells = F.from_csv("value", ", ".join(f"{n} string" for n in names), {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    parsed = records.select(F.regexp_extract("file", r"([^/]+?)(\.[^./]+)?$", 1).alias("article_id"), F.col("record").cast("int").alias("row"), cells.alias("cells"))
    return parsed.select("article_id", "row", F.posexplode(F.array(*[F.col(f"cells.{n}") for n in names])).alias("col", "value")).filter("value is not null")


def sheet_rejects(spark: SparkSession, paths) -> DataFrame:
    return csv_records(spark, paths)[1]


def reading_orders(spark: SparkSession, path: str) -> DataFrame:
    """(page_key, order) of a JSON object; a missing file gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "page_key string, `order` array<int>")
    whole = F.coalesce(F.from_json("value", "map<string,array<int>>"), F.raise_error(F.lit("reading order is not an object")).cast("map<string,array<int>>"))
    return raw.select(F.explode(whole).alias("page_key", "order"))


def locked_articles(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "array<string>")).alias("article_id"))


def uploads(spark: SparkSession, paths) -> DataFrame:
    """(path, document, length, file_type, content); the type comes from the leading bytes and is null if unknown."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1).alias("document"), "length", file_type(F.col("content")).alias("file_type"), "content")


def ocr_pages(spark: SparkSession, paths) -> DataFrame:
    """Page records; what is none is a row of ``ocr_page_rejects``."""
    return good(json_file_records(spark, paths, OCR_PAGE, ("run_id", "page")))


def ocr_page_rejects(spark: SparkSession, paths) -> DataFrame:
    return rejects(json_file_records(spark, paths, OCR_PAGE, ("run_id", "page")))


def events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """The event log as a stream; for a batch use ``json_lines``."""
    return spark.readStream.schema(schema).json(path)


def ocr_words(columnar: DataFrame, columns: tuple = ("text", "conf", "block_num", "par_num", "line_num", "left", "top", "width", "height")) -> DataFrame:
    """Word rows from columnar arrays, with ``seq``, their position."""
    return columnar.select("page_id", F.posexplode(F.arrays_zip(*columns)).alias("seq", "w")).select("page_id", "seq", "w.*")
