"""Ranked, paged search over entries: exact, prefix, word prefix, contains, extension class, fuzzy, path mode."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.names import app_rank, extension_priority, match_tier, name_length, quoted, word_prefix
from lodestone.functions.text import fuzzy_score
from lodestone.operators.alignment import aligned

PAGE, FUZZY_MOST, PATH_MOST, PATH_LEVELS = 300, 200, 200, 4
LAST = ("drive", "file_ref")


@dataclass(frozen=True)
class Query:
    """What a line asks for: text, kinds all, dirs or files, and whether it is an extension alone."""

    text: str
    kinds: str = "all"
    by_extension: bool = False


def parse_line(line: str) -> Query:
    """ext:x files with that ending, *.x any kind, folder: or : directories, file: or ! files."""
    line = line.strip()
    for prefix, kinds, by_ext in (("ext:", "files", True), ("*.", "all", True), ("folder:", "dirs", False), (":", "dirs", False), ("file:", "files", False), ("!", "files", False)):
        if line.startswith(prefix):
            return Query(line[len(prefix) :].strip().lstrip("." if by_ext else ""), kinds, by_ext)
    return Query(line)


def of_kind(entries: DataFrame, kinds: str) -> DataFrame:
    return entries if kinds == "all" else entries.where("is_dir" if kinds == "dirs" else "not is_dir")


def not_excluded(excluded: tuple[str, ...]) -> Column:
    """Paths under none of the lower-case prefixes."""
    kept = F.lit(True)
    for prefix in excluded:
        kept = kept & ~F.lower("path").startswith(prefix)
    return kept


def without_prefixes(entries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Entries under no prefix of a table (prefix): a prefix ends with a separator, so an equality on each ancestor of a folder finds it.

    Folders are walked once each, not once for every entry in them.
    """
    folder = F.lower(F.regexp_extract("path", r"(?s)^(.*\\)", 1))
    placed = entries.withColumn("_folder", folder)
    parts = F.split(F.col("_folder"), r"\\")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "\\"), F.lit("\\")))
    folders = placed.where("_folder <> ''").select("_folder").distinct().select("_folder", F.explode(above).alias("prefix"))
    hit = folders.join(prefixes.select(F.lower("prefix").alias("prefix")).where("prefix is not null").distinct(), "prefix", "left_semi").select("_folder").distinct()
    return placed.join(hit, "_folder", "left_anti").drop("_folder")


def _page(rows: DataFrame, order: list, limit: int, skip: int) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(limit)


def generic_matches(entries: DataFrame, query: str, case_sensitive: bool = False, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Clean entries that match, with rank (the tier) and name_len."""
    name, q = (F.col("name"), query) if case_sensitive else (F.col("name_lower"), query.lower())
    rows = entries.where(name.contains(q)).where(~F.col("is_junk"))
    if excluded:
        rows = rows.where(not_excluded(excluded))
    return rows.withColumn("rank", match_tier(name, q)).withColumn("name_len", name_length(F.col("name_lower")))


def raw_total(entries: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """(raw_total) of names that match, junk and excluded ones with them; it can exceed what pages reach."""
    name, q = (F.col("name"), query) if case_sensitive else (F.col("name_lower"), query.lower())
    return entries.where(name.contains(q)).agg(F.count("*").alias("raw_total"))


def search_generic(entries: DataFrame, query: str, limit: int = PAGE, skip: int = 0, case_sensitive: bool = False, excluded: tuple[str, ...] = ()) -> DataFrame:
    rows = generic_matches(entries, query, case_sensitive, excluded)
    return _page(rows, ["rank", "name_len", "name_lower", *LAST], limit, skip)


def extension_class(entries: DataFrame, query: str) -> str | None:
    """The extension that a query names, if entries have it: ".x" of 3 bytes or more, or a word of 2 to 6 bytes without a dot."""
    q = query.lower()
    size = len(q.encode())
    ext = q[1:] if q.startswith(".") and size >= 3 else q if "." not in q and " " not in q and 2 <= size <= 6 else None
    return ext if ext and not entries.where(F.col("ext") == ext).isEmpty() else None


def extension_matches(entries: DataFrame, ext: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Clean entries of an extension with rank, boundary and name_len, by their stem against the extension."""
    rows = entries.where((F.col("ext") == ext) & ~F.col("is_junk"))
    if excluded:
        rows = rows.where(not_excluded(excluded))
    name = F.col("name_lower")
    rank = F.when(name == ext, 1).when(name.startswith(ext), 2).when(name == f".{ext}", 1).otherwise(3)
    return rows.withColumn("rank", rank).withColumn("boundary", F.when((rank <= 2) | word_prefix(name, ext), 0).otherwise(1)).withColumn("name_len", name_length(name))


def search_extension(entries: DataFrame, ext: str, limit: int = PAGE, skip: int = 0, excluded: tuple[str, ...] = ()) -> DataFrame:
    rows = extension_matches(entries, ext, excluded)
    return _page(rows, ["rank", "boundary", F.desc("user_path"), "depth", "name_len", "name_lower", *LAST], limit, skip)


def fuzzy_fill(entries: DataFrame, query: str, page: DataFrame, room: int, excluded: tuple[str, ...] = (), by_alignment: bool = False) -> DataFrame:
    """Up to `room` further entries that have the query as a subsequence, best first, with rank 5. by_alignment: scored by the best alignment, not from the left."""
    q = query.lower()
    loose = F.col("name_lower").rlike(".*".join(quoted(c) for c in q))
    rows = entries.where(loose & ~F.col("is_junk"))
    if excluded:
        rows = rows.where(not_excluded(excluded))
    rows = rows.join(F.broadcast(page.select(*LAST)), list(LAST), "left_anti")  # a page of at most PAGE rows
    if by_alignment:
        rows = aligned(rows, q, min(room, FUZZY_MOST))
    else:
        rows = rows.withColumn("score", fuzzy_score(F.col("name_lower"), q)).where("score >= 0")
    rows = rows.withColumn("rank", F.lit(5)).withColumn("name_len", name_length(F.col("name_lower")))
    return rows.orderBy(F.desc("score"), "name_lower", *LAST).limit(min(room, FUZZY_MOST))


def search_paged(entries: DataFrame, query: str, limit: int = PAGE, skip: int = 0, case_sensitive: bool = False, excluded: tuple[str, ...] = (), by_alignment: bool = False) -> tuple[DataFrame, int]:
    """(page, total of clean matches). An extension that entries have is searched as such, else by name; a first page that isn't full is filled by subsequences (see fuzzy_fill)."""
    if not query:
        return entries.limit(0).select(*LAST, "name", "path", "is_dir", F.lit(0).alias("rank")), 0
    columns = [*LAST, "name", "path", "is_dir", "rank"]
    if not case_sensitive and (ext := extension_class(entries, query)):
        return search_extension(entries, ext, limit, skip, excluded).select(*columns), extension_matches(entries, ext, excluded).count()
    page = search_generic(entries, query, limit, skip, case_sensitive, excluded)
    total = generic_matches(entries, query, case_sensitive, excluded).count()
    if skip == 0 and total < limit and len(query.encode()) >= 2:
        return page.select(*columns).unionByName(fuzzy_fill(entries, query, page, limit - total, excluded, by_alignment).select(*columns)), total
    return page.select(*columns), total


def search_line(entries: DataFrame, line: str, limit: int = PAGE) -> DataFrame:
    """A command line's query: an ending in name order, or a search whose page is then filtered by kind."""
    q = parse_line(line)
    if q.by_extension:
        return of_kind(entries, q.kinds).where(F.col("name_lower").endswith("." + q.text.lower())).orderBy("name_lower", *LAST).limit(limit)
    return of_kind(search_paged(entries, q.text, limit)[0], q.kinds)


def path_search(entries: DataFrame, path: str, most: int = PATH_MOST) -> DataFrame:
    """The entry of a path; if there is none, those up to four levels under its longest existing directory whose names contain its last part, directories first.

    A path with a file in the middle has no result, one with no directory of entries on it is looked up from its drive on.
    """
    low = path.lower().rstrip("\\")
    parts = low.split("\\")
    prefixes = ["\\".join(parts[:k]) for k in range(1, len(parts))]
    known = entries.where(F.lower("path").isin(low, *prefixes)).select(F.lower("path").alias("path"), "is_dir").distinct().collect()  # a row or so for each part of the path
    kinds = {r["path"]: r["is_dir"] for r in known}
    exact = entries.where(F.lower("path") == low).withColumn("rank", F.lit(1))
    base = max((p for p in prefixes if p in kinds), key=len, default=prefixes[0] if prefixes else "")
    if low in kinds or not kinds.get(base, True):
        return exact.orderBy(*LAST).limit(most)
    depth = F.length(F.regexp_replace(F.substring(F.lower("path"), len(base) + 2, 1 << 20), r"[^\\]", "")) + 1
    under = entries.where(F.lower("path").startswith(base + "\\") & (depth <= PATH_LEVELS) & F.col("name_lower").contains(parts[-1]))
    under = under.withColumn("rank", F.coalesce(match_tier(F.col("name_lower"), parts[-1]), F.lit(4)))
    return under.orderBy("rank", F.desc("is_dir"), "name_lower", *LAST).limit(most)


#: What a line must look like to be a path or an expression.
_PATH_START = r"(?i)(?:[a-z]:[\\/]|\\\\|~[\\/]|(?:appdata|localappdata|temp|userprofile|programfilesx86|programfiles|program files|program files \(x86\)|windows|system32)[\\/]|%[^%\\/]+%[\\/])"
_PATH_ALONE = r"(?i)(?:[a-z]:|~|%[^%\\/]+%)"
_MATH_LINE = r"[0-9+\-*/().%\s^]+"


def line_kind(text: Column) -> Column:
    """path, math or name: what a typed line is looked up as. An expression has a digit and an operator; a backslash makes a path of anything else."""
    bare = F.regexp_replace(text, '^"+|"+$', "")
    is_path = bare.rlike(f"^{_PATH_START}") | bare.rlike(f"^{_PATH_ALONE}$") | bare.contains("\\")
    is_math = text.rlike(f"^{_MATH_LINE}$") & text.rlike("[0-9]") & text.rlike(r"[+\-*/%^]")
    return F.when(is_path, "path").when(is_math, "math").otherwise("name")


def expand_path(text: str, env: dict[str, str], home: str, aliases: dict[str, str] | None = None) -> str | None:
    """A typed path as a full one: quotes, ~, %VAR%, drive, UNC, aliases; None for an unknown variable or no path."""
    text = text.strip().strip('"').replace("/", "\\")
    if not text:
        return None
    lower = {k.lower(): v for k, v in env.items()}
    parts = text.split("%")
    if len(parts) % 2 == 0:
        return None
    for k in range(1, len(parts), 2):
        if (value := lower.get(parts[k].lower())) is None:
            return None
        parts[k] = value
    text = "".join(parts)
    if text == "~" or text.startswith("~\\"):
        return home + text[1:]
    if re.match(r"[A-Za-z]:", text) or text.startswith("\\\\"):
        return text
    if text.startswith("\\"):
        return home[:2] + text
    head, slash, rest = text.partition("\\")
    return (aliases or {}).get(head.lower(), f"{home}\\{head}") + slash + rest


def app_search(apps: DataFrame, frequency: DataFrame, query: str) -> DataFrame:
    """Applications (name, path) by rank, launches, name: 10, or 16 for an empty query, which hides settings pages."""
    q = query.lower()
    low = F.lower("name")
    rows = apps.withColumn("rank", app_rank(low, q) if q else F.when(~F.col("name").startswith("Settings: "), 1)).where("rank is not null")
    rows = rows.withColumn("path_lower", F.lower("path")).join(frequency.select("path_lower", "cnt"), "path_lower", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return rows.orderBy("rank", F.desc("cnt"), low, "path").limit(10 if q else 16)


def client_app_search(apps: DataFrame, query: str, most: int = 16, most_listed: int = 524) -> DataFrame:
    """Applications (name, path, ordinal) by rank, then fuzzy score, then name; 4 is the rank of a subsequence. An empty query lists all but settings pages in their order."""
    q = query.strip().lower()
    if not q:
        return apps.where(~F.col("name").startswith("Settings: ")).withColumn("rank", F.lit(0)).orderBy("ordinal", "path").limit(most_listed)
    low = F.lower("name")
    ranked = apps.withColumn("_rank", app_rank(low, q)).withColumn("_fuzzy", F.when(F.col("_rank").isNull(), fuzzy_score(low, q)).otherwise(-1))
    rows = ranked.withColumn("rank", F.coalesce("_rank", F.when(F.col("_fuzzy") >= 0, 4))).where("rank is not null")
    return rows.orderBy("rank", F.desc("_fuzzy"), low, "ordinal", "path").limit(most).drop("_rank", "_fuzzy")


def first_apps(apps: DataFrame, limit: int) -> DataFrame:
    """The first applications in name order, all of rank 0."""
    return apps.withColumn("rank", F.lit(0)).orderBy(F.lower("name"), "path").limit(limit)


def sections(web: DataFrame, apps: DataFrame, files: DataFrame, most_apps: int = 16, most: int = 524) -> DataFrame:
    """Rows (name, path, is_dir, rank) of one result list with section and position: web, applications, folders, files."""
    parts = [web.limit(1).withColumn("section", F.lit(0)), apps.limit(most_apps).withColumn("section", F.lit(2)), files.limit(most).withColumn("section", F.when(F.col("is_dir"), 3).otherwise(4))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.orderBy("section", "rank", F.lower("name"), "path").limit(most)


#: What the sections of a result list are called.
SECTIONS = ("Web", "Calculation", "Applications", "Folders", "Files")


def section_counts(rows: DataFrame, total_files: Column | None = None) -> DataFrame:
    """(section, label, n, more) of the sections of a list that have rows, in their order; more: files beyond those shown, if their total is known."""
    label = F.element_at(F.array(*[F.lit(x) for x in SECTIONS]), F.col("section") + 1)
    more = F.when(F.col("section") == 4, F.greatest(total_files - F.col("n"), F.lit(0))) if total_files is not None else F.lit(None)
    counts = rows.groupBy("section").agg(F.count("*").alias("n"))
    return counts.select("section", label.alias("label"), "n", F.coalesce(more.cast("long"), F.lit(0).cast("long")).alias("more")).orderBy("section")


def next_page(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Rows whose path isn't among those shown."""
    return rows.join(shown.select("path").distinct(), "path", "left_anti")


def highlights(name: Column, query: str, most: int = 3) -> Column:
    """array<struct<start, len>> of the first non-overlapping hits, from 0, without regard to case."""
    pieces = F.split(F.lower(name), quoted(query.lower()), -1)
    size = len(query)
    starts = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.struct((F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda s, p: s + F.length(p)) + (k - 1) * size).alias("start"), F.lit(size).alias("len")))
    return F.when(F.size(pieces) > 1, F.slice(starts, 1, most)).otherwise(F.array().cast("array<struct<start: int, len: int>>"))


def with_extension_priority(entries: DataFrame) -> DataFrame:
    return entries.withColumn("ext_prio", extension_priority(F.col("name_lower")))
