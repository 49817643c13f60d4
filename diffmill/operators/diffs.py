"""Diff parsing: unified diffs to function-level chunks (ids D1 to D10).

A diff arrives as one row, so everything that runs "per diff" can run inside that row,
without a shuffle, a sort or grouping, whatever the number of diffs. ``parse_diffs`` reads
Arrow batches of diffs line by line, once, with the file and the line counter as its only
state. Chained array expressions take several times as long for the same chunks, because
Spark interprets their lambdas.

What combines over parts of a diff (``split_diffs``) or gives lines (``added_lines``) needs
the steps as values; there they are array expressions that avoid running state:

* cutting at file markers gives every section its file at once;
* cutting a section at hunk headers gives every piece its first line number, and once
  deleted lines and headers are filtered out the index in the piece is the line count;
* the only carried value (added lines after a file marker with no hunk header between)
  is computed just for the pieces that have such lines, with a look-up by groups.

Values that are read several times are bound with ``let``, so each is computed once.
"""

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffmill import constants as C
from diffmill.functions.text import (
    is_blank,
    let,
    line_breaks,
    normalize_breaks,
    pattern,
    raw_lines,
)
from diffmill.schemas import CHUNKS

_FILE_MARK = r"\n(?=\+\+\+ b/)"
_HUNK_MARK = r"\n(?=" + C.HUNK_HEADER + ")"
_GROUP = 256
#: Diffs turned into Python texts at once, and characters of an output batch.
_ROWS_READ = 256
_BATCH_CHARS = 8 << 20
#: White space of a Java pattern with the flag U; without the separators \x1c to \x1f.
_PATTERN_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters by their Unicode property that are symbols by their category.
_CIRCLED_LETTERS = [("\u24b6", "\u24e9"), ("\U0001f130", "\U0001f149"), ("\U0001f150", "\U0001f169"), ("\U0001f170", "\U0001f189")]


def diff_lines(diffs: DataFrame) -> DataFrame:
    """One row per line with its position; blank diffs give no rows."""
    lines = diffs.filter(~is_blank(F.col("diff"))).select(
        "pr_id", F.posexplode(raw_lines(F.col("diff"))).alias("pos", "raw"),
        # the last element is no line when the diff ends in a line break
        F.size(raw_lines(F.col("diff"))).alias("n"),
    )
    return lines.filter((F.col("raw") != "") | (F.col("pos") < F.col("n") - 1)).drop("n")


def line_kind(raw: Column) -> Column:
    """File, hdr, hunk, del, add or ctx; the first rule that fits decides."""
    return (
        F.when(F.startswith(raw, F.lit("+++ b/")), "file")
        .when(F.startswith(raw, F.lit("+++")), "hdr")
        .when(raw.rlike("^" + C.HUNK_HEADER), "hunk")
        .when(F.startswith(raw, F.lit("-")), "del")
        .when(F.startswith(raw, F.lit("+")), "add")
        .otherwise("ctx")
    )


def is_definition(code: Column) -> Column:
    """The line starts a function or a class. The plain search comes first because
    it works on bytes and settles most lines."""
    candidate = F.contains(code, F.lit("def ")) | F.contains(code, F.lit("class "))
    return candidate & code.rlike(pattern(C.DEFINITION_START))


def _sections(diff: Column) -> Column:
    # The added newline lets a marker in the first line be found like any other.
    text = F.concat(F.lit("\n"), normalize_breaks(diff))
    return F.split(text, _FILE_MARK)


def _counting_lines(piece: Column) -> Column:
    """Lines of a piece that exist in the new file, without the piece's first line."""
    return F.filter(
        F.split(piece, "\n"),
        lambda ln, i: (i > 0) & ~F.startswith(ln, F.lit("-")) & ~F.startswith(ln, F.lit("+++")),
    )


def _numbered_additions(lines: Column, base: Column) -> Column:
    """Added lines without their mark; their number is ``base`` plus the index."""
    return F.array_compact(
        F.transform(
            lines,
            lambda ln, i: F.when(
                F.startswith(ln, F.lit("+")),
                F.struct((base + i).alias("no"), F.substr(ln, F.lit(2)).alias("code")),
            ),
        )
    )


def _cut_piece(piece: Column, index: Column) -> Column:
    """A hunk, or the lines between a file marker and the first hunk (no base then)."""
    base = F.when(
        index > 0, F.regexp_extract(piece, "^" + C.HUNK_HEADER, 1).try_cast("bigint")
    )
    return let(
        F.struct(base.alias("base"), _counting_lines(piece).alias("lines")),
        lambda p: F.struct(
            p["base"].alias("base"),
            F.size(p["lines"]).alias("n"),
            _numbered_additions(
                p["lines"], F.coalesce(p["base"], _zero())
            ).alias("added"),
        ),
    )


def _cut_section(section: Column, index: Column) -> Column:
    # null: no marker stands before these lines
    file = F.when(index > 0, F.substr(F.substring_index(section, "\n", 1), F.lit(7)))
    # end: line counter after the section; counted from the section's start, unless a hunk
    # header in it set the counter (resets)
    return let(
        F.transform(F.split(section, _HUNK_MARK), _cut_piece),
        lambda pieces: F.struct(
            file.alias("file"),
            pieces.alias("pieces"),
            F.exists(pieces, lambda p: p["base"].isNotNull()).alias("resets"),
            F.aggregate(
                pieces, _zero(), lambda at, p: F.coalesce(p["base"], at) + p["n"]
            ).alias("end"),
        ),
    )


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _counter_after(sections: Column, start: Column) -> Column:
    return F.aggregate(
        sections, start, lambda at, s: F.when(s["resets"], s["end"]).otherwise(at + s["end"])
    )


def _groups(sections: Column) -> Column:
    """Counter steps of every full group of sections. With them a counter can be looked up
    in a long diff without going through all sections before it."""
    return F.transform(
        F.sequence(F.lit(1), F.size(sections), F.lit(_GROUP)),
        lambda first: let(F.slice(sections, first, F.lit(_GROUP)), counter_step),
    )


def _line_number_before(sections: Column, groups: Column, index: Column, start: Column) -> Column:
    """Line counter at the end of the sections before ``index``."""
    whole = F.floor(index / _GROUP).cast("int")
    return _counter_after(
        F.slice(sections, whole * _GROUP + 1, index - whole * _GROUP),
        _counter_after(F.slice(groups, F.lit(1), whole), start),
    )


def _moved(lines: Column, by: Column) -> Column:
    return F.transform(
        lines, lambda x: F.struct((x["no"] + by).alias("no"), x["code"].alias("code"))
    )


def _section_lines(sections: Column, groups: Column, file: Column, start: Column) -> Column:
    """Added lines of each section that has any. ``file`` and ``start``, the line counter, hold before the
    first marker."""

    def with_lines(section: Column, index: Column) -> Column:
        def piece_lines(piece: Column) -> Column:
            carried = piece["base"].isNull() & (F.size(piece["added"]) > 0)
            return F.when(
                carried,
                let(
                    _line_number_before(sections, groups, index, start),
                    lambda before: _moved(piece["added"], before),
                ),
            ).otherwise(piece["added"])

        return F.struct(
            F.coalesce(section["file"], file).alias("file"),
            F.flatten(F.transform(section["pieces"], piece_lines)).alias("lines"),
        )

    return F.filter(F.transform(sections, with_lines), lambda s: F.size(s["lines"]) > 0)


def _merged_files(sections: Column) -> Column:
    """One entry per file; a file that comes back later is merged into its first place.

    Sections are sorted by file and cut where the file changes, so that the cost stays
    near the number of sections, however many files come back.
    """
    numbered = F.array_sort(
        F.transform(sections, lambda s, i: F.struct(s["file"].alias("file"), i.alias("at")))
    )

    def merge(order: Column) -> Column:
        first = lambda i: (i == 0) | (
            F.get(order, i)["file"] != F.get(order, F.greatest(i - 1, F.lit(0)))["file"]
        )
        starts = F.filter(F.transform(order, lambda _, i: i), first)
        return let(starts, lambda at: F.transform(F.array_sort(groups(order, at)), joined))

    def groups(order: Column, starts: Column) -> Column:
        def group(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(order))
            places = F.transform(F.slice(order, start + 1, end - start), lambda s: s["at"])
            return F.struct(F.get(places, F.lit(0)).alias("first"), places.alias("places"))

        return F.transform(starts, group)

    def joined(group: Column) -> Column:
        return F.struct(
            F.get(sections, group["first"])["file"].alias("file"),
            F.flatten(F.transform(group["places"], lambda i: F.get(sections, i)["lines"])).alias("lines"),
        )

    return let(numbered, merge)


def cut_sections(diff: Column) -> Column:
    """Sections of a diff, or of whole lines of one, without regard to what stands before."""
    return F.transform(_sections(diff), _cut_section)


def counter_step(sections: Column) -> Column:
    """What sections do to the line counter: set it to ``end`` if they ``resets``, else
    move it by ``end``."""
    return F.struct(
        F.exists(sections, lambda s: s["resets"]).alias("resets"),
        _counter_after(sections, _zero()).alias("end"),
    )


def files_of(sections: Column, file: Column | None = None, start: Column | None = None) -> Column:
    """Files with their added lines, in order of the first added line. Lines before the
    first marker belong to ``file``, and the line counter begins at ``start``."""
    file = F.lit(C.UNKNOWN_FILE) if file is None else file
    start = _zero() if start is None else start
    lines = let(_groups(sections), lambda groups: _section_lines(sections, groups, file, start))
    return let(lines, _merged_files)


def _files(diff: Column) -> Column:
    return let(cut_sections(diff), lambda sections: files_of(sections))


def chunk_starts(lines: Column) -> Column:
    """Places of the first line and of all definitions."""
    return F.array_compact(
        F.transform(lines, lambda x, i: F.when((i == 0) | is_definition(x["code"]), i))
    )


def added_lines(diffs: DataFrame) -> DataFrame:
    """Added lines with file, line number in the new file and boundary flag."""
    files = diffs.select("pr_id", F.posexplode(_files(F.col("diff"))).alias("file_ord", "f"))
    return files.select(
        "pr_id",
        "file_ord",
        F.col("f.file").alias("file"),
        F.posexplode("f.lines").alias("line_ord", "x"),
    ).select(
        "pr_id",
        "file_ord",
        "file",
        "line_ord",
        F.col("x.no").alias("line_no"),
        F.col("x.code").alias("code"),
        is_definition(F.col("x.code")).alias("boundary"),
    )


def _chunk_reader() -> Callable[[str], list[tuple[str, int, str]]]:
    """D1 to D10 of one diff, as (file, start_line, code) of each chunk. Made of local names
    alone, so that it goes to the workers by value."""
    other_break, line_break = re.compile(C.OTHER_LINE_BREAK), re.compile(C.LINE_BREAK)
    hunk = re.compile(C.HUNK_HEADER, re.ASCII)
    definition = re.compile(C.DEFINITION_START.replace(r"\s", f"[{_PATTERN_SPACE}]").replace(r"\w+", "(.)"))
    cap, unknown, space, top = C.MAX_CHUNK_LINES, C.UNKNOWN_FILE, C.WHITE_SPACE, (1 << 63) - 1
    marks, joiners, circled = {"Nl", "Mn", "Me", "Mc", "Nd", "Pc"}, "\u200c\u200d", _CIRCLED_LETTERS
    category = unicodedata.category

    def defines(code: str) -> bool:
        found = definition.match(code)
        if not found:
            return False
        letter = found[1]
        if letter < "\x80":
            return letter.isalnum() or letter == "_"
        kind = category(letter)
        return kind[0] == "L" or kind in marks or letter in joiners or any(a <= letter <= b for a, b in circled)

    def added(diff: str) -> dict[str, tuple[list[int], list[str]]]:
        if other_break.search(diff):
            diff = line_break.sub("\n", diff)
        # at: line counter; before: the counter at the file marker; no: number of the next line
        files, file, at, before, no = {}, unknown, 0, 0, 0
        for line in diff.split("\n"):
            first = line[:1]
            if first == "+":
                if line[:3] == "+++":
                    if line[:6] == "+++ b/":
                        file, before, no = line[6:], at, at
                    continue
                numbers, codes = files.get(file) or files.setdefault(file, ([], []))
                numbers.append(no)
                codes.append(line[1:])
            elif first == "-":
                continue
            elif first == "@":
                header = hunk.match(line)
                if header:
                    base = int(header[1]) if len(header[1].lstrip("0")) < 20 else top + 1
                    if base <= top:
                        at = no = base
                    else:  # no number of a line
                        no = before
                    continue
            at += 1
            no += 1
        return files

    def chunks(diff: str) -> list[tuple[str, int, str]]:
        out = []
        for file, (numbers, codes) in added(diff).items():
            starts = [0] + [
                i for i, code in enumerate(codes) if i and ("def " in code or "class " in code) and defines(code)
            ]
            ends = starts[1:] + [len(codes)]
            for j, (lo, hi) in enumerate(zip(starts, ends)):
                # a span whose predecessor was closed by the size cap follows on from the line before
                glued = j > 0 and (lo - starts[j - 1]) % cap == 0
                for at in range(lo, hi, cap):
                    code = "\n".join(codes[at : min(at + cap, hi)])
                    if code.strip(space):
                        start = numbers[at - 1] + 1 if glued or at > lo else numbers[at]
                        out.append((file, start, code))
        return out

    return chunks


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """chunks(pr_id, chunk_index, file, start_line, code). Diffs are read where they
    lie, in Arrow batches; an output batch is closed by its size."""
    key = diffs.schema["pr_id"].dataType
    schema = T.StructType([T.StructField("pr_id", key), *CHUNKS.fields[1:]])
    chunks_of, rows_read, most = _chunk_reader(), _ROWS_READ, _BATCH_CHARS

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts = batch.column(0), batch.column(1)
            rows, places, files, lines, codes, size = [], [], [], [], [], 0

            def closed() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [
                        own.take(pa.array(rows, pa.int64())),
                        pa.array(places, pa.int32()),
                        pa.array(files, pa.string()),
                        pa.array(lines, pa.int64()),
                        pa.array(codes, pa.string()),
                    ],
                    names=["pr_id", "chunk_index", "file", "start_line", "code"],
                )

            for begin in range(0, len(texts), rows_read):
                for row, text in enumerate(texts.slice(begin, rows_read).to_pylist(), begin):
                    if text is None:
                        continue
                    for place, (file, line, code) in enumerate(chunks_of(text.decode("utf-8", "replace"))):
                        rows.append(row)
                        places.append(place)
                        files.append(file)
                        lines.append(line)
                        codes.append(code)
                        size += len(file) + len(code)
                        if size > most:
                            yield closed()
                            rows, places, files, lines, codes, size = [], [], [], [], [], 0
            if rows:
                yield closed()

    # as bytes: a text that is no sound UTF-8 must not end the job
    return diffs.select("pr_id", F.col("diff").cast("binary").alias("diff")).mapInArrow(parse, schema)


def within_size_limit(chunks: DataFrame) -> DataFrame:
    """Drop chunks of more than 100 newlines (possible in tables from elsewhere)."""
    return chunks.filter(line_breaks(F.col("code")) <= C.MAX_CODE_NEWLINES)
