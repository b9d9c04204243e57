"""Records of notes and manifests: rows in text, page ranges, samples, seals, folders, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import let, manifest_key
from corpusmill.operators.ordered import by_key, running


def table_rows(body: Column, digest: str) -> Column:
    """Rows (``label, url, offset, length, hash, absent, stats``) of the manifest tables in a note; a hash that isn't like ``digest`` is absent. Heads and rules are no rows."""
    pattern = "(?m)^\\| ([^|\\n]+) \\| (\\S+) \\| ([0-9]+) \\| ([0-9]+) \\| ([^|\\n]+) \\|(?: ([^|\\n]*) \\|)?$"
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(pattern))
    cell = lambda x, i: F.trim(F.regexp_extract(x, pattern, i))

    def row(x: Column) -> Column:
        known = cell(x, 5).rlike(f"^{digest}$")
        return F.struct(
            cell(x, 1).alias("label"),
            F.when(cell(x, 2) == "·", "").otherwise(cell(x, 2)).alias("url"),
            cell(x, 3).cast("bigint").alias("offset"),
            cell(x, 4).cast("bigint").alias("length"),
            F.when(known, cell(x, 5)).otherwise("").alias("hash"),
            (~known).alias("absent"),
            cell(x, 6).alias("stats"),
        )

    return F.filter(F.transform(lines, row), lambda r: (r["label"] != "what") & ~r["label"].rlike("^-+$"))


def page_ranges(sections: DataFrame, collection: str, order: list[str], text: str) -> DataFrame:
    """``collection``, ``order``, ``page_from, page_to`` of every section from its ``[page n]`` marks; without a mark at its start it goes on from the last page before, 1 at first.

    Marks are read first: only numbers are put in order and carried.
    """
    marks = F.transform(F.regexp_extract_all(text, F.lit("\\[page ([0-9]+)\\]"), F.lit(1)), lambda x: x.cast("bigint"))
    at_start = F.col(text).rlike("^\\s*(#[^\\n]*\\n\\s*)?\\[page [0-9]+\\]")
    numbers = sections.select(collection, *order, let(marks, lambda m: F.struct(F.when(at_start, F.get(m, F.lit(0))).alias("first"), F.get(m, F.size(m) - 1).alias("last"))).alias("m"))
    numbers = numbers.select(collection, *order, F.col("m.first").alias("first_mark"), F.col("m.last").alias("last_mark"))
    seen = F.coalesce("seen", F.lit(1).cast("bigint"))
    carried = running(numbers, [collection], order, lasts={"seen": F.col("last_mark")})
    return carried.select(collection, *order, F.coalesce("first_mark", seen).alias("page_from"), F.coalesce("last_mark", seen).alias("page_to"))


def ends_and_some(rows: DataFrame, key: str, order: str, all_up_to: int, some: int) -> DataFrame:
    """Rows with ``place`` and ``total``: all of a key with up to ``all_up_to``, else the first, the last and ``some`` by the hash of key and place."""
    w = Window.partitionBy(key)
    placed = by_key(rows, key).withColumns({"place": F.row_number().over(w.orderBy(order)), "total": F.count("*").over(w)})
    end = (F.col("place") == 1) | (F.col("place") == F.col("total"))
    # Only rows among which some are picked need a name; as bytes it sorts as in letters, in half the room.
    name = F.when((F.col("total") > all_up_to) & ~F.col("end"), F.unhex(F.sha2(F.concat_ws("/", F.col(key).cast("string"), F.col("place").cast("string")), 256)))
    ranked = placed.withColumn("end", end).withColumn("rank", F.row_number().over(Window.partitionBy(key, "end").orderBy(name)))
    return ranked.where((F.col("total") <= all_up_to) | F.col("end") | (F.col("rank") <= some)).drop("end", "rank")


def previewed(structure: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``structure`` (``label, hash``) that ``stored`` (``label, hash, pos``) has by their label without type and shape, with ``shown``: whether the hash is still the stored one. The last of rows with one label counts; a null hash is never shown."""
    last = stored.groupBy(manifest_key(F.col("label")).alias("key")).agg(F.max_by(F.struct("hash"), "pos").alias("kept"))
    return structure.withColumn("key", manifest_key(F.col("label"))).join(last, "key").withColumn("shown", F.coalesce(F.col("hash") == F.col("kept.hash"), F.lit(False))).drop("key", "kept")


def stepped(rows: DataFrame, key: str, at: str, most: int, newest: Column) -> DataFrame:
    """At most ``most`` evenly stepped places of each key's span from its least ``at`` on, with ``newest`` of the rows at that place, null where there is none. Only one row a key and place is joined."""
    held = rows.where(F.col(at).isNotNull()).groupBy(key, at).agg(newest)
    ends = held.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    step = F.greatest(F.lit(1).cast("bigint"), F.ceil((F.col("last") - F.col("first") + 1) / most))
    return ends.select(key, F.explode(F.sequence("first", "last", step)).alias(at)).join(held, [key, at], "left")


def against_seal(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """``state`` of every entry of ``manifest`` (``want``, ``copy``) by the hash ``sha`` of its file, and what to restore it from."""
    both = manifest.join(files.select(key, "sha"), key, "left")
    state = F.when(F.col("sha").isNull(), "missing").when(F.col("sha") == F.col("want"), "sealed").otherwise("differs")
    return both.withColumn("state", state).withColumn("restore", F.when(F.col("state") != "sealed", F.col("copy")))


def common_folders(paths: DataFrame, key: str, path: str) -> DataFrame:
    """``pages, folder``: what the least and the greatest list of folders share, all others share as well; so no key is gathered."""
    dirs = F.split(path, "/")
    ends = paths.select(key, F.slice(dirs, 1, F.size(dirs) - 1).alias("d")).groupBy(key).agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("pages"))
    most = F.least(F.size("a"), F.size("b"))
    same = F.filter(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), lambda i: F.slice("a", F.lit(1), i) == F.slice("b", F.lit(1), i))
    folder = F.when(F.size(same) > 0, F.concat(F.array_join(F.slice("a", F.lit(1), F.size(same)), "/"), F.lit("/"))).otherwise("")
    return ends.select(key, "pages", folder.alias("folder"))


def filled(template: str, names: list[str]) -> Column:
    """``template`` with ``{name}`` replaced by the columns ``names``; other names stay. What was put in isn't looked at again."""
    parts, rest = [], template
    while rest:
        found = min((rest.find(f"{{{n}}}"), n) for n in names if f"{{{n}}}" in rest) if any(f"{{{n}}}" in rest for n in names) else None
        if found is None:
            parts.append(F.lit(rest))
            break
        at, name = found
        parts += [F.lit(rest[:at]), F.col(name).cast("string")]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)
