"""CSV to items: the header names the fields, every value is text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rivulet.functions.views import let
from rivulet.items import HIDDEN, DYNAMIC_COLUMN, Items, quoted
from rivulet.session import pin_utc
from rivulet.sources.landed import ITEM_KEY, SOURCE_KEY, Parsed, require_bodies


def read_csv(spark: SparkSession, path: str | list[str], multiline: bool = True) -> Items:
    """Items of CSV files that share one header, in (file, row) order; a file with
    another header fails the run (``csv_items`` reads each under its own).

    Quoted cells may hold line breaks, so a file is read by one task. Without
    ``multiline`` files are split and read in parallel, and must not hold any. A row with too few or too many cells fails
    the run, which needs every column to be parsed: Spark's CSV column pruning
    lets such rows through, so it is off for this read.
    """
    pin_utc(spark)
    df = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("maxColumns", MAX_COLUMNS)
        .option("multiLine", multiline)
        .csv(path)
    )
    # Spark reads an empty cell as NULL; here it is text that is present.
    cells = [F.coalesce(quoted(c), F.lit("")).alias(c) for c in df.columns]
    place = [
        F.col("_metadata.file_path").alias(f"{HIDDEN}0"),
        F.col("_metadata.file_block_start").alias(f"{HIDDEN}1"),
        # Rising within a split, which is all that is asked of it.
        F.monotonically_increasing_id().alias(f"{HIDDEN}2"),
    ]
    return Items.from_ordered(df.select(*cells, *place), [f"{HIDDEN}{i}" for i in range(3)])


# Spark's own default is 20,480; more columns than this no schema can hold.
MAX_COLUMNS = 1_000_000
ROW_TYPE = "array<map<string, string>>"
# Noncharacters that stand for a cell border, a record border and an opening quote
# while a body is taken apart; no text may hold them.
_CELL, _RECORD, _QUOTED = "\ufdd0", "\ufdd1", "\ufdd2"


def _tables(body: Column) -> Column:
    """A body as an array of records, each an array of cells, null if it is no CSV.

    Split at the quotes, every other piece lies inside them. Borders are marked in the
    pieces outside; an empty piece between two quoted ones is an escaped quote. Outside
    pieces must reach from border to border, or a quote stands in the middle of a cell.
    """
    text = F.regexp_replace(F.coalesce(body, F.lit("")), "^\ufeff", "")
    return let(F.split(text, '"', -1), lambda pieces: _marked(pieces, text))


def _marked(pieces: Column, text: Column) -> Column:
    last = F.size(pieces) - 1

    def marked(piece: Column, i: Column) -> Column:
        borders = F.replace(F.regexp_replace(piece, "\r\n|\n|\r", _RECORD), F.lit(","), F.lit(_CELL))
        return (
            F.when(i % 2 == 1, F.concat(F.lit(_QUOTED), piece))
            .when((piece == "") & (i > 0) & (i < last), F.lit('"'))
            .otherwise(borders)
        )

    def strays(piece: Column, i: Column) -> Column:
        outside = (i % 2 == 0) & (piece != "")
        after = (i > 0) & ~piece.rlike("^[,\r\n]")
        before = (i < last) & ~piece.rlike("[,\r\n]$")
        return outside & (after | before)

    joined = F.array_join(F.transform(pieces, marked), "")
    records = F.filter(F.split(joined, _RECORD, -1), lambda r: r != "")
    cells = F.transform(records, lambda r: F.split(F.translate(r, _QUOTED, ""), _CELL, -1))
    stray = F.exists(F.transform(pieces, strays), lambda found: found)
    return F.when(~stray & ~text.rlike(f"[{_CELL}{_RECORD}{_QUOTED}]"), cells)


def _records(bodies: DataFrame) -> DataFrame:
    """url, and csv: the rows under their body's own header, or the problem with it."""

    def named(table: Column) -> Column:
        header = F.coalesce(F.get(table, F.lit(0)), F.array().cast("array<string>"))
        rows = F.slice(table, 2, F.greatest(F.size(table), F.lit(1)))
        even = table.isNotNull() & F.forall(rows, lambda row: F.size(row) == F.size(header))
        # A name that comes twice means its last column.
        places = F.filter(
            F.transform(header, lambda name, i: F.struct(name.alias("name"), i.alias("i"))),
            lambda column: F.array_position(F.slice(header, column["i"] + 2, F.size(header)), column["name"]) == 0,
        )
        as_map = lambda row: F.map_from_entries(
            F.transform(places, lambda column: F.struct(column["name"], F.get(row, column["i"])))
        )
        return F.struct(
            F.when(even, F.transform(rows, as_map)).alias("rows"),
            F.when(~even, F.lit("bad CSV")).alias("problem"),
        )

    return require_bodies(bodies).select("url", let(_tables(F.col("body")), named).alias("csv"))


def _exploded(records: DataFrame, rows: Column) -> Items:
    df = records.select(F.col("url").alias(SOURCE_KEY), F.posexplode(rows).alias(ITEM_KEY, "row"))
    item = F.transform_values("row", lambda _, v: v.cast("variant")).alias(DYNAMIC_COLUMN)
    return Items.from_ordered(df.select(item, SOURCE_KEY, ITEM_KEY), [SOURCE_KEY, ITEM_KEY])


def parse_csv_bodies(bodies: DataFrame) -> Parsed:
    """Dynamic items of landed CSV documents, each with a header of its own, and
    the ragged bodies set aside."""
    records = _records(bodies)
    rejects = records.where("csv.problem is not null").select(
        "url", F.col("csv.problem").alias("reason")
    )
    return Parsed(_exploded(records, F.col("csv.rows")), rejects)


def csv_items(bodies: DataFrame) -> Items:
    """Like ``parse_csv_bodies``, but a ragged body fails the run."""
    problem, rows = F.col("csv.problem"), F.col("csv.rows")
    failure = F.raise_error(F.concat(problem, F.lit(" at "), F.col("url")))
    checked = F.when(problem.isNull(), rows).otherwise(failure.cast(ROW_TYPE))
    return _exploded(_records(bodies), checked)
