"""Whole collections as sections that run on from document to document, cut down to a number of sections, described and rendered as notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let, one_line, strip_space, token_display, token_estimate
from corpusmill.operators.ordered import packed, running
from corpusmill.operators.sections import chopped, distinctive_terms, heading_blocks
from corpusmill.sources.tables import written

#: Share of the documents that stay each time a collection is too large.
SHRINK = 0.95
_BLOCK = "struct<name:string,title:string>"


def pieces_of(docs: DataFrame, limit: int) -> DataFrame:
    """``key, at, rid, name, no, title, depth, text`` of ``docs`` (``key, at, name, md``): blocks by headings, one above ``limit`` in parts; written. Documents without text have none."""
    rows = docs.select("key", "at", F.monotonically_increasing_id().alias("rid"), "name", F.coalesce("md", F.lit("")).alias("md"))
    pieces = F.flatten(F.transform(heading_blocks(F.col("md"), F.col("name")), lambda b: chopped(b, limit)))
    each = rows.select("key", "at", "rid", "name", F.posexplode(pieces).alias("no", "b"))
    return written(each.select("key", "at", "rid", "name", "no", "b.title", "b.depth", "b.text"), "pieces")


def collection_sections(pieces: DataFrame, limit: int, **blocks) -> DataFrame:
    """``pieces`` (of ``pieces_of``) with ``section_no``, packed through all documents of a key in the order of ``at``.

    A section breaks where ``limit`` would be passed, and once it is more than half full before a heading of depth 1 or another document. Only numbers are sorted; texts are joined to them.
    """
    numbers = pieces.select("key", "at", "rid", "no", F.length("text").alias("size"), ((F.col("no") == 0) | (F.col("depth") == 1)).alias("opens"))
    placed = written(packed(numbers, "key", ["at", "rid", "no"], "size", "opens", limit, **blocks).select("rid", "no", "section_no"), "sections")
    return pieces.join(placed, ["rid", "no"])


def fitting_documents(numbered: DataFrame, most: int) -> DataFrame:
    """``key, rid, kept, left, fits``: which documents stay so that a key has at most ``most`` sections.

    The last twentieth goes until it does, or one document is left. What the first documents fill is the same with or without the others, so each candidate's sections are read off at its last document and nothing is packed again.
    ``numbered`` has ``key, at, rid, section_no``.
    """
    docs = numbered.groupBy("key", "at", "rid").agg((F.max("section_no") + 1).alias("upto"))
    placed = written(running(docs, ["key"], ["at", "rid"]), "documents-placed")
    steps = F.sequence(F.lit(1), F.ceil(F.log(F.greatest(F.col("n"), F.lit(2))) / -F.log(F.lit(SHRINK))).cast("int") + 20)
    sizes = F.aggregate(steps, F.array("n"), lambda a, _: let(F.element_at(a, -1), lambda last: F.when(last > 1, F.concat(a, F.array(F.floor(last * SHRINK)))).otherwise(a)))
    tried = placed.where("pos = 0").select("key", F.explode(sizes).alias("m"))
    at_end = placed.select(F.col("key").alias("of"), (F.col("pos") + 1).alias("end"), "upto")
    good = tried.join(at_end, F.col("key").eqNullSafe(F.col("of")) & (F.col("m") == F.col("end"))).where((F.col("upto") <= most) | (F.col("m") == 1))
    left = written(good.groupBy("key").agg(F.max("m").alias("left"), F.max_by("upto", "m").alias("sections")), "documents-left")
    told = placed.join(left.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")))
    return told.select("key", "rid", (F.col("pos") < F.col("left")).alias("kept"), "left", (F.col("sections") <= most).alias("fits"))


def _labels(blocks: Column, many: Column) -> Column:
    """Titles of blocks; in a collection with the document's name where it changes, if the title doesn't begin with it."""
    named = lambda b, i: many & ((i == 0) | (F.get(blocks, i - 1)["name"] != b["name"])) & ~b["title"].startswith(b["name"])
    return F.transform(blocks, lambda b, i: F.concat(F.when(named(b, i), F.concat(b["name"], F.lit(" · "))).otherwise(""), b["title"]))


def common_folder(names: Column) -> Column:
    """The longest folder that all names lie in, with its slash, else empty."""
    dirs = F.transform(names, lambda x: F.slice(F.split(x, "/"), F.lit(1), F.size(F.split(x, "/")) - 1))
    first, least = F.array_min(dirs), F.array_max(dirs)
    shared = lambda a, b: F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.lit(1)) - 1), lambda i: (i < F.size(a)) & (F.slice(a, F.lit(1), i + 1) == F.slice(b, F.lit(1), i + 1)))
    return let(first, lambda a: let(least, lambda b: let(F.size(shared(a, b)), lambda n: F.when(n > 0, F.concat(F.array_join(F.slice(a, F.lit(1), n), "/"), F.lit("/"))).otherwise(F.lit("")))))


def section_rows(numbered: DataFrame, many: DataFrame) -> DataFrame:
    """``key, section_no, text, title, covers, begins`` of every section of ``numbered`` (pieces with ``section_no``).

    ``many`` (``key, many``) tells keys of several documents. ``covers`` is a list, ``begins`` how a section of a single block starts. A section is at most ``limit`` characters, so it is gathered in a row.
    """
    held = numbered.groupBy("key", "section_no").agg(F.array_sort(F.collect_list(F.struct("at", "rid", "no", "name", "title", "text"))).alias("p"))
    held = held.join(many.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of"))).drop("of")
    held = held.select("key", "section_no", "many", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.transform("p", lambda x: F.struct(x["name"].alias("name"), x["title"].alias("title"))).cast(f"array<{_BLOCK}>").alias("b"), F.get("p", F.lit(0))["text"].alias("head"))
    names = F.array_distinct(F.transform("b", lambda x: x["name"]))
    held = held.withColumns({"names": names, "labels": _labels(F.col("b"), F.col("many")), "folder": common_folder(names)})
    several, others = F.col("many") & (F.size("names") > 1), F.size("names") - 1
    listed = F.concat(F.get("names", F.lit(0)), F.lit(" + "), others.cast("string"), F.lit(" more file"), F.when(others > 1, "s").otherwise(""))
    title = F.when(several & (F.col("folder") != ""), F.concat("folder", F.lit(" · "), F.size("names").cast("string"), F.lit(" files"))).when(several, listed).otherwise(F.get("labels", F.lit(0)))
    covers = F.when(several, F.col("labels")).otherwise(F.slice("labels", F.lit(2), F.size("labels")))
    plain = one_line(F.regexp_replace(F.regexp_replace("head", "\\[page [0-9]+\\]", ""), "(?m)^#+\\s[^\\n]*$", ""))
    begins = F.when(F.size("covers") == 0, F.left(plain, F.lit(110))).otherwise("")
    return held.withColumns({"title": title, "covers": covers}).select("key", "section_no", "text", "title", "covers", F.when(begins != "", F.concat(F.lit('begins "'), begins, F.when(F.length(begins) >= 110, "…").otherwise(""), F.lit('"'))).otherwise("").alias("begins"))


def shortened(covers: Column, budget: Column) -> Column:
    """A list as one text as far as ``budget`` goes (the first always), then how many more there are."""
    begin = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def add(a: Column, c: Column) -> Column:
        fits = a["on"] & ((a["t"] == "") | (F.length(a["t"]) + F.length(c) + 2 <= budget))
        return F.struct(F.when(fits, F.concat(a["t"], F.when(a["t"] != "", "; ").otherwise(""), c)).otherwise(a["t"]).alias("t"), (a["n"] + fits.cast("int")).alias("n"), fits.alias("on"))

    return let(F.aggregate(covers, begin, add), lambda r: F.when(r["n"] < F.size(covers), F.concat(r["t"], F.lit("; +"), (F.size(covers) - r["n"]).cast("string"), F.lit(" more"))).otherwise(r["t"]))


def collection_notes(docs: DataFrame, limit: int = 24_000, most: int = 160, total: int = 40_000) -> tuple[DataFrame, DataFrame]:
    """Section notes (``key, section_no, title, covers, terms, tokens, body, note``) and an index note a key (``key, sections, tokens, skipped, body``) of ``docs`` (``key, at, name, md``).

    ``note`` is the sha256 of a body, by which the index names it. Lists longer than ``total`` together get their share of it, 300 at least. The five best of the six most distinctive terms that no title of a section's list holds follow.
    A key that one document still fills with more than ``most`` sections has no notes.
    """
    pieces = pieces_of(docs, limit)
    numbered = written(collection_sections(pieces, limit), "numbered")
    fit = written(fitting_documents(numbered.select("key", "at", "rid", "section_no"), most), "fitting")
    counts = written(fit.where("fits").groupBy("key").agg((F.count("*") > 1).alias("many"), F.count_if(~F.col("kept")).alias("skipped"), F.max("left").alias("files")), "collections")
    kept = numbered.join(fit.where("kept AND fits").select("rid"), "rid", "left_semi")
    sections = written(section_rows(kept, counts.select("key", "many")), "section-rows")
    terms = distinctive_terms(sections.select(F.struct("key").alias("of"), "section_no", "text"), "of", "section_no", "text").groupBy("of", "section_no").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    terms = terms.select(F.col("of.key").alias("k"), F.col("section_no").alias("s"), "t")
    size = F.length(F.array_join("covers", "; "))
    sums = written(sections.groupBy("key").agg(F.sum(size).alias("sum"), F.count("*").alias("n")), "section-sums")
    rows = sections.join(sums.withColumnRenamed("key", "k0"), F.col("key").eqNullSafe(F.col("k0"))).join(terms, F.col("key").eqNullSafe(F.col("k")) & (F.col("section_no") == F.col("s")), "left")
    budget = F.when(F.col("sum") > total, F.greatest(F.lit(300), F.floor(size * total / F.col("sum")).cast("int"))).otherwise(F.lit(2147483647))
    low = F.lower(F.concat_ws(" ", "covers", "begins"))
    words = F.filter(F.transform(F.coalesce("t", F.array().cast("array<struct<rank:int,term:string>>")), lambda x: x["term"]), lambda w: ~F.contains(low, w))
    best = F.slice(words, 1, 5)
    shown = F.when(F.size("covers") > 0, shortened(F.col("covers"), budget)).otherwise(F.col("begins"))
    head = F.concat(F.lit("---\nsource: "), F.coalesce("key", F.lit("")), F.lit("\nsection: "), (F.col("section_no") + 1).cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(": "), "title", F.lit("\n---\n\n"))
    notes = rows.select("key", "section_no", "title", shown.alias("covers"), F.when(F.size(best) > 0, F.concat(F.lit("terms: "), F.array_join(best, ", "))).otherwise("").alias("terms"), token_estimate(F.col("text")).alias("tokens"), F.concat(head, strip_space(F.col("text")), F.lit("\n")).alias("body"))
    notes = written(notes.withColumn("note", F.sha2("body", 256)), "section-notes")

    more = lambda c: F.when(F.col(c) != "", F.concat(F.lit(" · "), c)).otherwise("")
    line = F.concat(F.lit("- ["), F.regexp_replace("title", "[\\[\\]]", ""), F.lit("]("), "note", F.lit("): "), token_display(F.col("tokens")), F.lit(" tokens"), more("covers"), more("terms"))
    # At most ``most`` lines of bounded length a key.
    lines = notes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("section_no", line.alias("line")))).alias("l"), F.count("*").alias("sections"), F.sum("tokens").alias("tokens"))
    index = lines.join(counts.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")))
    gone = F.when(F.col("skipped") > 0, F.concat(F.lit("\n## Not included\n\n- "), F.col("skipped").cast("string"), F.lit(" lower-ranked files\n"))).otherwise("")
    top = F.concat(F.lit("# "), F.coalesce("key", F.lit("")), F.lit("\n\n> "), F.col("files").cast("string"), F.lit(" files. "), token_display(F.col("tokens")), F.lit(" tokens in "), F.col("sections").cast("string"), F.lit(" sections.\n\n## Sections\n\n"))
    return notes, index.select("key", "sections", "tokens", "skipped", F.concat(top, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"), gone).alias("body"))
