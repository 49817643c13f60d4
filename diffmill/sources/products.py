"""Review and report sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffmill.constants import CLASS_NAMES, PRODUCT
from diffmill.functions.text import lookup
from diffmill.sources.staging import found


def write_products(products: dict[str, DataFrame], path: str) -> None:
    """Each product to its own table."""
    for name, df in products.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_part(products: dict[str, DataFrame], path: str, part: int) -> None:
    """S5 for a batch: all products in one write, each in its own column and folder. The
    part is there once the write has set its completion mark, so a reader sees all products of a
    batch or none; writing a part again replaces it."""
    rows = None
    for name, df in products.items():
        own = df.select(F.lit(name).alias("product"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    rows.write.mode("overwrite").partitionBy("product").parquet(f"{path}/part={part}")


def read_product(
    spark: SparkSession, path: str, name: str, schema: T.StructType, parts: list[int] | None = None
) -> DataFrame:
    """A product of all finished parts, or of some of them, with the number ``part``."""
    done = [mark.rsplit("/", 1)[0] for mark in found(spark, f"{path}/part=*/_SUCCESS")]
    if parts is not None:
        done = [folder for folder in done if int(folder.rsplit("=", 1)[1]) in parts]
    own = [T.StructField("part", T.LongType()), T.StructField("product", T.StringType())]
    if not done:
        return spark.createDataFrame([], T.StructType([*schema.fields, own[0]]))
    rows = spark.read.schema(T.StructType([T.StructField(name, schema), *own])).option("basePath", path).parquet(*done)
    return rows.filter(F.col("product") == name).select(f"{name}.*", "part")


def evaluation_report(per_class: DataFrame, summary: DataFrame, matrix: DataFrame) -> DataFrame:
    """The report as numbered text lines, a line per class and matrix row. The inputs
    have a few rows each."""

    def number(name: str):
        return F.lpad(F.format_number(name, 4), 10, " ")

    head = summary.select(
        F.posexplode(
            F.array(
                F.lit(f"{PRODUCT} evaluation report"),
                F.concat(F.lit("Samples evaluated: "), F.col("support").cast("string")),
                F.lit("class  precision  recall  f1  support"),
            )
        ).alias("line_no", "line")
    )
    table = per_class.select(
        (F.lit(100) + F.coalesce("class_id", F.lit(-2))).alias("line_no"),
        F.concat_ws(
            " ",
            lookup(CLASS_NAMES, F.col("class_id"), "Unknown"),
            number("precision"),
            number("recall"),
            number("f1"),
            F.col("support").cast("string"),
        ).alias("line"),
    )
    averages = summary.select(
        F.posexplode(
            F.array(
                F.concat(F.lit("accuracy"), number("accuracy")),
                F.concat(F.lit("macro avg"), number("macro_precision"), number("macro_recall"), number("macro_f1")),
                F.concat(
                    F.lit("weighted avg"), number("weighted_precision"), number("weighted_recall"), number("weighted_f1")
                ),
            )
        ).alias("at", "line")
    ).select((F.lit(200) + F.col("at")).alias("line_no"), "line")
    rows = matrix.select(
        (F.lit(300) + F.coalesce("label", F.lit(-2))).alias("line_no"),
        F.concat_ws(" ", *[F.col(c).cast("string") for c in matrix.columns]).alias("line"),
    )
    return head.unionByName(table).unionByName(averages).unionByName(rows)


def write_report(report: DataFrame, path: str) -> None:
    """The lines of a report, some dozens, as one text file."""
    report.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)
