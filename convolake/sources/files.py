"""File sources and sinks: question-answer CSV, whole texts, folders, price lists, page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.functions.text import clean_text

# Columns, labels and default category of the question-answer files; accepted file endings.
QA_COLUMNS = "soru STRING, cevap STRING, kategori STRING, anahtar_kelimeler STRING"
QA_DEFAULT_CATEGORY = "genel"
ENDINGS = (".pdf", ".docx", ".txt", ".csv")
# Fixed value: price of the automatic model (USD per token).
AUTO_PRICES = {"openrouter/auto": (0.00001, 0.00003)}


def qa_rows(df: DataFrame) -> DataFrame:
    """Question-answer rows as knowledge rows; rows without both parts go."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    filled = lambda c, d: F.when(given(c), F.col(c)).otherwise(F.lit(d))
    return df.filter(given("soru") & given("cevap")).select(
        F.concat(F.lit("SORU: "), "soru", F.lit("\n\nCEVAP: "), "cevap").alias("content"),
        filled("kategori", QA_DEFAULT_CATEGORY).alias("category"),
        filled("anahtar_kelimeler", "").alias("keywords"),
        F.lit("qa_pair").alias("type"),
    )


def read_qa_csv(spark: SparkSession, path: str) -> DataFrame:
    return qa_rows(spark.read.csv(path, schema=QA_COLUMNS, header=True, multiLine=True, escape='"'))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row each."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source"), F.col("value").alias("content"), F.lit("text_document").alias("type")
    )


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, modified) of the accepted files; contents stay unread."""
    ending = "(?i)\\.(" + "|".join(e[1:] for e in ENDINGS) + ")$"
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")
        .filter(F.col("path").rlike(ending))
    )


def new_files(files: DataFrame, loaded: DataFrame, name: str = "name") -> DataFrame:
    """Files whose base name is not loaded yet."""
    return files.join(loaded.select(name).distinct(), name, "left_anti")


def page_rows(pages: DataFrame, text: str) -> DataFrame:
    """Texts of up to 5 characters are blanked, pages of up to 10 are left out, the rest is cleaned."""
    kept = F.when(F.length(text) > 5, F.col(text)).otherwise("")
    return pages.withColumn(text, kept).filter(F.length(text) > 10).withColumn(text, clean_text(F.col(text)))


def needs_ocr(images: Column, text: Column) -> Column:
    return (images > 0) | (F.length(F.trim(text)) < 50)


def price_list(df: DataFrame, json: str, special: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(id, prompt, completion, context) per million tokens from a provider's JSON rows."""
    special = AUTO_PRICES if special is None else special
    shape = "struct<id:string,pricing:struct<prompt:string,completion:string>,context_length:int>"
    m = df.select(F.from_json(json, shape).alias("m")).filter("m.id IS NOT NULL").select("m.*")

    def price(i: int, column: str) -> Column:
        out = F.col(column).cast("double")
        for model, pair in special.items():
            out = F.when(F.col("id") == model, F.lit(pair[i])).otherwise(out)
        return out * 1000000

    return m.select(
        "id",
        price(0, "pricing.prompt").alias("prompt"),
        price(1, "pricing.completion").alias("completion"),
        F.col("context_length").alias("context"),
    )


def ocr_document(pages: Column) -> Column:
    """Struct (text, images, bytes) of ``array<struct<markdown, images>>``; page heads only for several pages."""
    head = lambda i: F.when(F.size(pages) > 1, F.concat(F.lit("# PAGE "), (i + 1).cast("string"), F.lit("\n"))).otherwise("")
    text = F.array_join(F.transform(pages, lambda p, i: F.concat(head(i), p["markdown"], F.lit("\n\n"))), "")
    images = F.filter(F.flatten(F.transform(pages, lambda p: F.coalesce(p["images"], F.array()))), lambda x: x.isNotNull() & (x != ""))
    return F.struct(text.alias("text"), images.alias("images"), (F.length(text) * 4).alias("bytes"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def truncate(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Empty the table at ``path`` and keep its schema."""
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
