"""Line dedup: runs of lines that already stand in an earlier text are deleted.

Windows of line hashes. Of each window of consecutive lines the line with the
smallest hash is a fingerprint, so equal windows share one. Fingerprints seen once
cannot be part of a repeated run and their windows drop out; the others are compared
whole (128 bits of hash over the lines). Unlike winnowing proper, every window is a
row, and no match is extended. A window that occurs at an earlier place (smaller
doc_id, then smaller line) is deleted with all its lines.

Only hashes and places are shuffled; counting and the earliest place of a window
are aggregates with map-side combine, so a line that a third of all texts carry
costs a row per task.

Defined results
* a line is what stands between line feeds; lines that are empty after trimming
  belong to no window and stay; blanks around a line don't count;
* a run has ``run`` lines, or fewer with ``words`` words together: a document's line
  is often a paragraph, and one of 50 words is a passage whatever stands around it;
* a run is judged on the input, not on what is left of other texts;
* texts of fewer than ``run`` lines are a single window of all their lines, if
  ``short`` is set (the default): a repeated short text loses all lines;
* null text stays null; a text all of whose lines go becomes the empty text;
* null ids come last in the order; rows with equal id and text count as one text;
  extra columns are kept, whatever their names; a text of any length counts whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import Scratch, fresh

RUN = 3
WORDS = 50


def line_rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text_hash, place, h): the non-empty lines of each text."""
    text = F.col(f"`{text_col}`")
    docs = documents.where(text.isNotNull()).select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n").alias("lines"))
    hashes = F.transform("lines", lambda x: F.when(F.trim(x) != "", F.struct(F.xxhash64(F.trim(x)).alias("h"), F.size(F.split(F.trim(x), r"\s+")).alias("words"))))
    return docs.select("doc_id", "text_hash", hashes.alias("hashes"))


def numbered(hashes: Column) -> Column:
    """Array of (place, h, words) of the non-empty lines."""
    return F.filter(F.transform(hashes, lambda x, i: F.struct(i.alias("place"), x["h"].alias("h"), x["words"].alias("words"))), lambda x: x["h"].isNotNull())


def windows_of(n: Column, run: int, short: bool, words: int | None) -> Column:
    """Array of the windows of a text: ``run`` lines, or the fewest lines from a place that hold ``words`` words."""

    def at(i: Column) -> Column:
        whole = [F.when((i + run - 1 <= F.size(n)) | ((i == 1) & F.lit(short)), F.slice(n, i, run))]
        counts = [F.lit(0)]
        for k in range(run - 1 if words else 0):
            counts.append(counts[-1] + F.coalesce(F.get(n, i + (k - 1))["words"], F.lit(0)))
            whole.append(F.when((i + k <= F.size(n)) & (counts[-1] >= words) & (counts[-2] < words), F.slice(n, i, k + 1)))
        return F.array_compact(F.array(*whole))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(n)), at))


def repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, short: bool = True, words: int | None = WORDS) -> DataFrame:
    """Rows (doc_id, text_hash, places): the line numbers to delete of each text that loses lines."""
    scratch = Scratch(documents.sparkSession, "lines")
    rows = line_rows(documents, id_col, text_col)
    rows = rows.select("doc_id", "text_hash", numbered(F.col("hashes")).alias("n")).where(F.size("n") > 0)
    one = rows.select("doc_id", "text_hash", F.explode(windows_of(F.col("n"), run, short, words)).alias("w"))
    lines = F.transform("w", lambda x: x["h"])
    one = one.select(
        "doc_id", "text_hash",
        F.array_min(lines).alias("fingerprint"),
        F.xxhash64(lines).alias("key1"), F.xxhash64(F.lit(1), F.reverse(lines)).alias("key2"),
        F.transform("w", lambda x: x["place"]).alias("places"),
    )
    windows = scratch.keep(one, "windows")
    seen = windows.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    met = windows.join(seen, "fingerprint", "left_semi")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash", F.col("places")[0].alias("line"))
    first = met.groupBy("key1", "key2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = met.join(first.drop("n"), ["key1", "key2"]).where(place > F.col("first"))
    return later.select("doc_id", "text_hash", F.explode("places").alias("place")).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("places"))


def without_lines(lines: Column, places: Column) -> Column:
    """The text of the lines whose numbers are not among the places."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)  # by a hash set: places may be many
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, short: bool = True, emptied: bool = True, words: int | None = WORDS) -> DataFrame:
    """The documents, their texts without repeated runs of lines; columns as before.

    ``emptied``: keep texts that lose all their lines, as empty ones, or leave them out;
    ``words``: None counts runs of ``run`` lines only.
    """
    own_id, own_hash, own_places, own_lines, own_text = (fresh(documents, f"__own_{n}") for n in ("id", "hash", "places", "lines", "text"))
    gone = repeated_lines(documents, id_col, text_col, run, short, words)
    gone = gone.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("places").alias(own_places))
    text, places = F.col(f"`{text_col}`"), F.col(own_places)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash))
    joined = documents.join(gone, same, "left").withColumn(own_lines, F.when(places.isNotNull(), F.split(text, "\n")))
    joined = joined.withColumn(own_text, F.when(places.isNull(), text).otherwise(without_lines(F.col(own_lines), places)))
    if not emptied:
        joined = joined.where(places.isNull() | (F.trim(own_text) != ""))
    return joined.select(*[F.col(own_text).alias(c) if c == text_col else F.col(f"`{c}`") for c in documents.columns])
