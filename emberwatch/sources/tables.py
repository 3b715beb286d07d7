"""CSV and TSV tables to the event schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import empty_as_null, first_filled, last_wins_map, quote_regex
from emberwatch.operators.skew import once
from emberwatch.schema import to_event_schema

#: Event column -> header names it is read from, compared without case, spaces or underscores.
HEADERS = {
    "timestamp": ["timestamp", "time", "datetime", "date", "timecreated", "utctime"],
    "message": ["message", "description", "details"],
    "ip": ["ip", "ipaddress", "sourceip", "srcip", "clientip"],
    "computer": ["computer", "computername", "hostname", "host"],
    "source": ["source", "provider", "providername", "channel"],
    "user": ["user", "username", "account", "subjectusername"],
    "processName": ["processname", "process", "image"],
    "processCmd": ["processcmd", "commandline", "command"],
    "path": ["path", "filepath", "file"],
    "level": ["level", "severity"],
    "eventId": ["eventid", "id"],
}

#: Mapped columns that make up the raw line, in this order.
RAW_COLUMNS = ["message", "ip", "computer", "source", "user", "processName", "processCmd", "path"]


def _plain(header: Column) -> Column:
    return F.translate(F.lower(header), " _", "")


def parse_cells(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows with a ``cells`` map (header -> text) to events: known headers are mapped, the rest is event data."""
    keep = keep or []
    known = sorted({name for names in HEADERS.values() for name in names})
    plain = last_wins_map(F.transform(F.map_keys("cells"), _plain), F.map_values("cells"))
    source = F.col("source_file") if "source_file" in rows.columns else F.lit(None).cast("string")
    frame = rows.withColumn("_plain", plain)
    frame = frame.select(
        *keep,
        *[first_filled(*[F.element_at("_plain", n) for n in names]).alias(c) for c, names in HEADERS.items()],
        F.map_filter("cells", lambda k, v: ~_plain(k).isin(known) & (F.coalesce(v, F.lit("")) != "")).alias("eventData"),
        source.alias("sourceFile"),
    )
    pairs = F.transform(F.map_entries("eventData"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    raw = F.concat_ws(" ", *RAW_COLUMNS, empty_as_null(F.array_join(pairs, " ")))
    return to_event_schema(
        frame.withColumns(
            {
                "rawLine": raw,
                "timestamp": F.try_to_timestamp("timestamp"),
                "eventId": F.col("eventId").try_cast("long"),
                "host": F.col("computer"),
                "sourceType": F.lit("csv"),
            }
        ),
        keep,
    )


def split_cells(line: Column, separator: str) -> Column:
    """One CSV line as an array of cells; quoted cells may hold the separator."""
    sep = quote_regex(separator)
    # possessive: a long cell is read in a loop, not by recursion
    pattern = f'{sep}("(?:[^"]++|"")*+"|[^{sep}]*+)'
    cells = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(pattern), F.lit(1))
    inner = lambda c: F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), inner(c)).otherwise(c))


def cells_of_lines(lines: DataFrame, separator: str = ",", keep: list[str] | None = None) -> DataFrame:
    """Lines (file, pos, value) of many files, each with a header line of its own, as ``cells``.

    The header rows, one per file, are joined back on the file.
    """
    firsts = lines.groupBy("file").agg(F.min(F.struct("pos", "value")).alias("_first"))
    headers = firsts.select(
        "file",
        F.col("_first.pos").alias("_pos"),
        split_cells(F.regexp_replace("_first.value", "^\ufeff", ""), separator).alias("_names"),
    )
    rows = once(lines, F.col("value"), "_line").filter(F.trim("_line") != "").join(headers, "file").filter(F.col("pos") > F.col("_pos"))
    return _named(rows, split_cells(F.col("_line"), separator), keep)


def _named(rows: DataFrame, values: Column, keep: list[str] | None = None) -> DataFrame:
    """Cells by the names of their file's header."""
    # a short row leaves its last cells NULL, surplus cells have no header
    paired = F.filter(F.arrays_zip(F.col("_names").alias("n"), values.alias("v")), lambda z: F.coalesce(z["n"], F.lit("")) != "")
    rows = rows.withColumn("_pairs", paired)
    cells = last_wins_map(F.transform("_pairs", lambda z: z["n"]), F.transform("_pairs", lambda z: z["v"]))
    return rows.select(*(keep or []), F.col("file").alias("source_file"), cells.alias("cells"))


def read_lines(spark, path: str, pattern: str) -> DataFrame:
    """Files below a folder as (file, pos, value); ``pos`` grows along each file."""
    frame = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return frame.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"),
        "value",
    )


def read_tables(spark, path: str, pattern: str = "*.csv", separator: str = ",") -> DataFrame:
    """CSV files with headers, whatever those are, as events; quoted cells may hold line breaks.

    The built-in reader reads a file as wide as the widest header.
    """
    firsts = read_lines(spark, path, pattern).groupBy("file").agg(F.min(F.struct("pos", "value")).alias("_first"))
    width = firsts.agg(F.max(F.size(split_cells(F.col("_first.value"), separator)))).first()[0] or 1
    names = [f"_c{i}" for i in range(width)]
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True)
    reader = reader.option("sep", separator).option("quote", '"').option("escape", '"').schema(", ".join(f"{n} string" for n in names))
    rows = reader.csv(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), F.array(*names).alias("_values")
    )
    headers = rows.groupBy("file").agg(F.min(F.struct("row", "_values")).alias("_first"))
    bare = F.transform("_first._values", lambda c: F.regexp_replace(c, "^\ufeff", ""))
    joined = rows.join(headers.select("file", F.col("_first.row").alias("_row"), bare.alias("_names")), "file")
    return parse_cells(_named(joined.filter(F.col("row") > F.col("_row")), F.col("_values")))
