"""Diffs larger than a task (D1 to D10): segments of one diff are parsed in many tasks.

A segment is a run of whole lines. What a line means depends on the lines before it: the
current file, the line counter, and how long the open chunk is. Each segment is parsed as
far as it can be alone, and says what it does to these values:

* file: the last marker's, if it has one, else the one before;
* line counter: set by its last hunk header and moved from there, or just moved;
* open chunk, per file: lines since the last definition, or added to those before.

Such steps combine in any grouping, so a running window over one small row per segment (or per
segment and file) gives every segment the values it begins with. Then it is parsed
to the end. Chunks cut by the end of a segment, at most one per file and segment, are put
together by the number of their first line in the file. No task holds more of a diff than a
segment's lines and one row per segment, file or chunk start.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diffmill import constants as C
from diffmill.functions.text import is_blank, let, normalize_breaks
from diffmill.operators.diffs import chunk_starts, counter_step, cut_sections, files_of, is_definition, parse_diffs
from diffmill.sources.staging import staged

_CAP = C.MAX_CHUNK_LINES
_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, 0)


def segments_of(diffs: DataFrame, lines: int = 20_000) -> DataFrame:
    """``pr_id, segment, text``: diffs cut after every so many lines."""
    every = F.split(normalize_breaks(F.col("diff")), "\n")

    def cut(all_lines: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(all_lines), F.lit(lines)),
            lambda at: F.array_join(F.slice(all_lines, at, F.lit(lines)), "\n"),
        )

    whole = diffs.filter(~is_blank(F.col("diff")))
    rows = whole.select("pr_id", F.posexplode(let(every, cut)).alias("segment", "text"))
    return rows.withColumn("segment", F.col("segment").cast("bigint"))


def read_diff_segments(spark: SparkSession, path: str, lines: int = 20_000) -> DataFrame:
    """``pr_id, segment, text`` of text files with one diff each, whatever their size: the
    number in the file's name is the pull request. A file is read in splits, so a segment is
    a part of a split; its number is the split's offset and the place in it."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*\z", 1).try_cast("bigint")
    read = spark.read.option("lineSep", "\n").text(path).select(
        number.alias("pr_id"),
        F.col("_metadata.file_block_start").alias("offset"),
        # ascending within a split
        F.monotonically_increasing_id().alias("at"),
        # with the break that the source took off it is one break
        F.regexp_replace("value", r"\r\z", "").alias("value"),
    )
    held = read.groupBy("pr_id", "offset", F.floor(F.col("at") / lines).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("rows")
    )
    text = normalize_breaks(F.array_join(F.transform("rows", lambda r: r["value"]), "\n"))
    order = Window.partitionBy("pr_id").orderBy("offset", "run")
    # numbers need the order alone, not the texts
    numbered = held.select("pr_id", "offset", "run").withColumn("segment", F.row_number().over(order).cast("bigint") - 1)
    return held.withColumn("text", text).join(numbered, ["pr_id", "offset", "run"]).select("pr_id", "segment", "text")


def _segment_carries(cut: DataFrame) -> DataFrame:
    """``pr_id, segment, file, start``: file and line counter where each segment begins."""
    order = Window.partitionBy("pr_id").orderBy("segment")
    files = F.array_compact(F.transform("sections", lambda s: s["file"]))
    steps = cut.select(
        "pr_id", "segment", F.try_element_at(files, F.lit(-1)).alias("last_file"), counter_step(F.col("sections")).alias("step")
    ).select("pr_id", "segment", "last_file", "step.*")
    epoch = F.sum(F.col("resets").cast("int")).over(order.rowsBetween(*_SO_FAR))
    in_epoch = Window.partitionBy("pr_id", "epoch").orderBy("segment").rowsBetween(*_SO_FAR)
    counted = steps.withColumn("epoch", epoch).withColumn("after", F.sum("end").over(in_epoch))
    return counted.select(
        "pr_id",
        "segment",
        F.coalesce(F.last("last_file", ignorenulls=True).over(order.rowsBetween(*_BEFORE)), F.lit(C.UNKNOWN_FILE)).alias("file"),
        F.coalesce(F.lag("after").over(order), F.lit(0).cast("bigint")).alias("start"),
    )


def _file_parts(segments: DataFrame, stage: bool) -> DataFrame:
    """``pr_id, segment, at, file, lines``: the added lines of each file in each segment."""
    cut = segments.select("pr_id", "segment", cut_sections(F.col("text")).alias("sections"))
    cut = staged(cut, "diff-sections") if stage else cut
    joined = cut.join(_segment_carries(cut), ["pr_id", "segment"])
    files = files_of(F.col("sections"), F.col("file"), F.col("start"))
    parts = joined.select("pr_id", "segment", F.posexplode(files).alias("at", "f")).select("pr_id", "segment", "at", "f.*")
    return staged(parts, "diff-files") if stage else parts


def _file_carries(parts: DataFrame) -> DataFrame:
    """Per file and segment: the place of the file in the diff, the added lines of it before
    this segment, how many of them the open chunk has, and the last one's number."""
    last_definition = F.array_max(
        F.array_compact(F.transform("lines", lambda x, i: F.when(is_definition(x["code"]), i)))
    )
    steps = parts.select(
        "pr_id", "segment", "at", "file",
        F.size("lines").cast("bigint").alias("n"),
        last_definition.alias("definition"),
        F.element_at("lines", -1)["no"].alias("no"),
    )
    order = Window.partitionBy("pr_id", "file").orderBy("segment")
    epoch = F.sum(F.col("definition").isNotNull().cast("int")).over(order.rowsBetween(*_SO_FAR))
    in_epoch = Window.partitionBy("pr_id", "file", "epoch").orderBy("segment").rowsBetween(*_SO_FAR)
    counted = steps.withColumn("epoch", epoch).withColumn(
        "run", F.sum(F.col("n") - F.coalesce("definition", F.lit(0))).over(in_epoch)
    )
    earlier = F.lag("run").over(order)
    return counted.select(
        "pr_id",
        "segment",
        "file",
        F.first(F.struct("segment", "at")).over(order.rowsBetween(*_SO_FAR)).alias("place"),
        F.coalesce(F.sum("n").over(order.rowsBetween(*_BEFORE)), F.lit(0)).alias("before"),
        F.coalesce((earlier - 1) % _CAP + 1, F.lit(0)).cast("int").alias("open"),
        F.lag("no").over(order).alias("last_no"),
    )


def _fragments(lines: Column, before: Column, opened: Column, last_no: Column) -> Column:
    """Chunks, or parts of them, of a file's lines in a segment. ``first`` is the number in
    the file of the chunk's first line; ``cut`` marks what may go on in another segment."""

    def of_starts(starts: Column) -> Column:
        n = F.size(lines)

        def run(lo: Column, j: Column) -> Column:
            follows = (j == 0) & ~is_definition(F.get(lines, F.lit(0))["code"])
            # a full chunk is closed: then a new one begins here
            begin = F.when(follows, -(opened % _CAP)).otherwise(lo)
            earlier = F.when(
                j > 0,
                lo - F.when((j == 1) & ~is_definition(F.get(lines, F.lit(0))["code"]), -(opened % _CAP)).otherwise(F.get(starts, j - 1)),
            ).otherwise(opened)
            return F.struct(
                begin.alias("begin"),
                F.coalesce(F.get(starts, j + 1), n).alias("end"),
                ((earlier > 0) & (earlier % _CAP == 0)).alias("glued"),
            )

        def spans(r: Column) -> Column:
            def span(at: Column) -> Column:
                lo = F.greatest(at, F.lit(0))
                size = F.least(r["end"], at + _CAP) - lo
                number = F.when((at > r["begin"]) | r["glued"], F.coalesce(F.get(lines, lo - 1)["no"], last_no) + 1)
                return F.struct(
                    (before + at).alias("first"),
                    F.when(at >= 0, F.coalesce(number, F.get(lines, lo)["no"])).alias("start_line"),
                    ((at < 0) | ((lo + size == n) & (n - at < _CAP))).alias("cut"),
                    F.array_join(F.transform(F.slice(lines, lo + 1, size), lambda x: x["code"]), "\n").alias("code"),
                )

            return F.transform(F.sequence(r["begin"], r["end"] - 1, F.lit(_CAP)), span)

        return F.flatten(F.transform(F.transform(starts, run), spans))

    return let(chunk_starts(lines), of_starts)


def parse_segments(segments: DataFrame, stage: bool = False) -> DataFrame:
    """Chunks (pr_id, chunk_index, file, start_line, code) as ``parse_diffs`` gives them.

    ``segments`` has whole lines, numbered in their order. With ``stage`` the parsed segments
    are written between the passes, else they are parsed again in each.
    """
    parts = _file_parts(segments, stage)
    key = ["pr_id", "segment", "file"]
    carried = parts.select(*key, "lines").join(_file_carries(parts), key)
    pieces = carried.select(
        "pr_id", "segment", "file", "place",
        F.inline(_fragments(F.col("lines"), F.col("before"), F.col("open"), F.col("last_no"))),
    )
    # at most the chunk size of pieces makes up a chunk
    whole = pieces.filter("NOT cut").drop("cut")
    joined = (
        pieces.filter("cut")
        .groupBy("pr_id", "file", "first")
        .agg(F.array_sort(F.collect_list(F.struct("segment", "place", "start_line", "code"))).alias("p"))
        .select(
            "pr_id",
            F.get("p", F.lit(0))["segment"].alias("segment"),
            "file",
            F.get("p", F.lit(0))["place"].alias("place"),
            "first",
            F.get("p", F.lit(0))["start_line"].alias("start_line"),
            F.array_join(F.transform("p", lambda x: x["code"]), "\n").alias("code"),
        )
    )
    chunks = whole.unionByName(joined).filter(~is_blank(F.col("code")))
    chunks = staged(chunks, "diff-chunks") if stage else chunks
    # numbered by what begins in a segment first, so that no task ranks all chunks of a diff
    counts = chunks.groupBy("pr_id", "place", "segment").agg(F.count("*").alias("n"))
    in_diff = Window.partitionBy("pr_id").orderBy("place", "segment").rowsBetween(*_BEFORE)
    begins = counts.select("pr_id", "place", "segment", F.coalesce(F.sum("n").over(in_diff), F.lit(0)).alias("begin"))
    within = Window.partitionBy("pr_id", "place", "segment").orderBy("first")
    numbered = chunks.withColumn("nth", F.row_number().over(within) - 1).join(begins, ["pr_id", "place", "segment"])
    return numbered.select(
        "pr_id", (F.col("begin") + F.col("nth")).cast("int").alias("chunk_index"), "file", "start_line", "code"
    )


def parse_all(diffs: DataFrame, largest: int = 8 << 20, lines: int = 20_000, stage: bool = False) -> DataFrame:
    """``parse_diffs`` for tables that hold some very long diffs: those above ``largest``
    characters are parsed in segments, all others within their row."""
    long = F.coalesce(F.length("diff"), F.lit(0)) > largest
    segments = segments_of(diffs.filter(long), lines).repartition("pr_id", "segment")
    return parse_diffs(diffs.filter(~long)).unionByName(parse_segments(segments, stage))
