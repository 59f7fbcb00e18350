"""Entity resolution over application sources: merge, first wins, collapse of entries with one target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.names import app_name_score, canonical_path, file_name_key, known_folder_path, launchable, normalized_app_name, stem
from lodestone.functions.text import package_exe
from lodestone.sources.tables import broadcast_if_small, first_of_each

ORDER = ["src_prio", "ordinal"]


def coalesced(sources: DataFrame, filled: tuple[str, ...] = ("install_location", "uninstall_string", "quiet_uninstall_string", "icon")) -> DataFrame:
    """One row for each lower name: the first row's values, and of `filled` the first that isn't null, in source order."""
    order = F.struct(*ORDER)
    key = F.lower("name").alias("name_key")
    kept = [c for c in sources.columns if c not in filled]
    aggregates = [F.min_by(F.struct(*kept), order).alias("_first"), *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in filled if c in sources.columns]]
    return sources.groupBy(key).agg(*aggregates).select("name_key", "_first.*", *[c for c in filled if c in sources.columns])


def first_by_name(sources: DataFrame) -> DataFrame:
    """The first source, then ordinal, of each normalised name; names without letters and digits go."""
    named = sources.withColumn("name_norm", normalized_app_name(F.col("name"))).where("name_norm <> ''")
    return first_of_each(named, ["name_norm"], ORDER)


def first_by_path(apps: DataFrame) -> DataFrame:
    return first_of_each(apps.withColumn("path_lower", F.lower("path")), ["path_lower"], ORDER)


def with_target(apps: DataFrame, links: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """apps with target, the canonical path of what an entry starts, and package_file, the file name in a Store id without a path; null if there is none.

    links: path, target of shortcuts. An id stands for the path behind it: one in a known folder or one that ends with .exe. Of a
    shortcut the target is that of its link, of an .exe itself; other entries and ids of other paths have none. aliases (path, canonical): other
    names of a path, like short ones. Of several links of a path, and several names, the first in order counts.
    """
    low = links.select(F.lower("path").alias("_real"), F.lower("target").alias("_linked")).groupBy("_real").agg(F.min("_linked").alias("_linked"))
    path, is_id = F.lower(F.trim("path")), F.lower(F.trim("path")).startswith("aumid:")
    rest = F.regexp_extract(path, r"(?s)^aumid:(.*)$", 1)
    behind = F.coalesce(F.lower(known_folder_path(rest)), F.when(rest.endswith(".exe"), rest))
    whole = apps.withColumns({"path_lower": F.lower("path"), "_real": F.when(is_id, behind).otherwise(path)}).join(low, "_real", "left")
    target = F.when(F.col("_real").endswith(".lnk"), F.col("_linked")).when(F.col("_real").endswith(".exe"), F.col("_real"))
    store = F.when(is_id & F.col("_real").isNull(), F.concat(package_exe(rest), F.lit(".exe")))
    whole = whole.withColumns({"target": canonical_path(target), "package_file": store}).drop("_real", "_linked")
    if aliases is None:
        return whole
    named = aliases.select(canonical_path(F.col("path")).alias("target"), canonical_path(F.col("canonical")).alias("_canonical")).groupBy("target").agg(F.min("_canonical").alias("_canonical"))
    return whole.join(named, "target", "left").withColumn("target", F.coalesce("_canonical", "target")).drop("_canonical")


def one_of_target(apps: DataFrame) -> DataFrame:
    """Of entries that stand for one target the best named; ties keep the earlier one.

    apps: name, path, target, package_file, src_prio, ordinal. Entries are a graph over two kinds of keys. Entries of one target are
    together. Store ids with one file name are together, and with the first target, in the order of its entries, that has this file
    name. Two targets are never joined, neither by a common file name nor through a Store id, so each component is a target or a file
    name and is found by one join; no order of rows matters. Entries without either are alone, but for copies of their path. Groups are
    aggregated before they are shuffled, so a target that most entries share is no hot key.
    """
    place = F.struct(*ORDER, F.lower("path").alias("path"))
    asked = apps.where("package_file is not null").select(F.col("package_file").alias("_file")).distinct()
    own_file = apps.where("target is not null").withColumn("_file", file_name_key(F.col("target")))
    first = own_file.join(asked, "_file", "left_semi").groupBy("_file").agg(F.min_by("target", place).alias("_joined"))
    whole = apps.join(first, F.col("package_file") == F.col("_file"), "left").withColumn("_score", app_name_score(F.col("name"), F.col("path"), F.col("target")))
    key = F.coalesce("target", "_joined", F.concat(F.lit("file?"), F.col("package_file")), F.concat(F.lit("path?"), F.lower("path")))
    best = F.min_by(F.struct(*apps.columns), F.struct(-F.col("_score"), *ORDER, F.col("path"), F.col("name")))
    return whole.groupBy(key.alias("_key")).agg(best.alias("_best")).select("_best.*")


def discover(sources: DataFrame, links: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The catalogue of launchable entries in name order."""
    usable = sources.where(launchable(F.col("path")))
    return one_of_target(with_target(first_by_path(first_by_name(usable)).drop("path_lower"), links, aliases)).orderBy(F.lower("name"), "path")


def same_pool(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two pools have the same lower paths."""
    x, y = (d.select(F.lower("path").alias("p")) for d in (a, b))
    left, right = x.exceptAll(y), y.exceptAll(x)
    return left.union(right).agg((F.count("*") == 0).alias("same"))


def launches(log: DataFrame, path: str = "path") -> DataFrame:
    return log.groupBy(F.lower(path).alias("path_lower")).agg(F.count("*").alias("cnt"))


def by_priority(rows: DataFrame, key: list[str], priority: Column, usable: Column) -> DataFrame:
    """The usable row of each key with the smallest priority."""
    return first_of_each(rows.where(usable).withColumn("_priority", priority), key, ["_priority"]).drop("_priority")


def _compared(app: Column, path: Column) -> tuple[Column, Column]:
    """An application's name without space and a file's without its ending, as they are compared."""
    return F.regexp_replace(F.lower(app), r"\s", ""), F.regexp_replace(file_name_key(path), r"\.exe$", "")


def best_executable(candidates: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(app or key, path) of the best of candidates (app, path, ordinal): 100 for the app's own name, 50 if one has the other in it; none without a score."""
    compact, name = _compared(F.col("app"), F.col("path"))
    score = F.when(name == compact, 100).when(name.contains(compact) | compact.contains(name), 50).otherwise(0)
    return candidates.withColumn("score", score).where("score > 0").groupBy(*(key or ["app"])).agg(F.max_by("path", F.struct("score", -F.col("ordinal"))).alias("path"))


def _parts(rows: DataFrame, text: str, others: DataFrame, other: str) -> DataFrame:
    """rows with each part of their text that is as long as some `other` text of their folder."""
    sizes = broadcast_if_small(others.select("folder", F.char_length(other).alias("_size")).distinct())
    room = F.char_length(text) - F.col("_size") + 1
    starts = F.when(F.col("_size") == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), room))
    return rows.join(sizes, "folder").where(room > 0).select(*rows.columns, "_size", F.explode(starts).alias("_at")).select(*rows.columns, F.col(text).substr(F.col("_at"), F.col("_size")).alias("part"))


def best_in_folder(asked: DataFrame, inside: DataFrame) -> DataFrame:
    """(folder, compact, found) of names (folder, compact) that `best_executable` finds a file for among those of their folder (folder, name, path, ordinal).

    found: struct of order and path, the best least. Of two texts one has the other in it if one of its parts is equal, so all cases
    are equalities. Of files with one part the first is taken before they are joined, so applications of a folder don't meet all its files.
    """
    first = lambda rows, by: rows.groupBy("folder", by).agg(F.min("file").alias("file"))
    names = first(inside.withColumn("file", F.struct(F.col("ordinal").isNull().alias("late"), "ordinal", "path")), "name")
    asked = asked.select("folder", "compact").dropna().distinct()
    same = asked.join(names.withColumnRenamed("name", "compact"), ["folder", "compact"])
    longer = asked.join(first(_parts(names, "name", asked, "compact"), "part").withColumnRenamed("part", "compact"), ["folder", "compact"])
    shorter = _parts(asked, "compact", names, "name").distinct().join(names.withColumnRenamed("name", "part"), ["folder", "part"])
    found = lambda rows, score: rows.select("folder", "compact", F.struct(F.lit(-score).alias("score"), "file.late", "file.ordinal", "file.path").alias("found"))
    return found(same, 100).unionByName(found(longer, 50)).unionByName(found(shorter, 50)).groupBy("folder", "compact").agg(F.min("found").alias("found"))


def executables(apps: DataFrame, files: DataFrame) -> DataFrame:
    """(app, path) of each application's executable, from the first of its icon, its install location and its uninstall commands that gives one.

    apps: app, icon, install_location, uninstall_string, quiet_uninstall_string; files: path, ordinal, the files that exist. An
    icon counts if it is an executable or a shortcut itself, else for what is best named beside it; an application with an install
    location has no later source. An uninstaller's command counts for what is best named beside it. Null and unknown paths give nothing.
    """
    known = files.select(F.lower("path").alias("path_lower"), "path", "ordinal").groupBy("path_lower").agg(F.min_by(F.struct("path", "ordinal"), F.struct("ordinal", "path")).alias("_file")).select("path_lower", "_file.*")
    icon = F.btrim(F.btrim(F.element_at(F.split("icon", ","), 1)), F.lit('"'))
    command = lambda c: F.when(~F.lower(F.btrim(c)).rlike("^(?:msiexec|wmic)"), F.coalesce(F.nullif(F.regexp_extract(F.btrim(c), '^"([^"]*)"?', 1), F.lit("")), F.regexp_extract(F.btrim(c), r"^([^\s\"]+)", 1)))
    named = [("icon", 0, icon), ("uninstall", 2, command("uninstall_string")), ("uninstall", 3, command("quiet_uninstall_string"))]
    asked = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("place"), F.lower(path).alias("path_lower")) for kind, k, path in named])
    pointed = apps.select("app", "install_location", F.explode(asked).alias("s")).select("app", "install_location", "s.*").where("path_lower <> ''").join(known, "path_lower")
    pointed = pointed.where((F.col("kind") == "icon") | (F.col("path_lower").endswith(".exe") & F.col("install_location").isNull()))
    bare = stem(F.col("path"))
    uninstaller = (F.col("kind") == "uninstall") & (bare.contains("unins") | bare.isin("setup", "install"))
    itself = F.col("path_lower").rlike(r"\.(?:exe|lnk)$") & ~uninstaller
    direct = pointed.where(itself).select("app", "place", "path")
    folder = lambda path: F.regexp_replace(F.lower(path), r"\\[^\\]*$", "")
    beside = pointed.where(~itself).select("app", "place", folder("path_lower").alias("folder"))
    located = apps.where("install_location is not null").select("app", F.lit(1).alias("place"), F.regexp_replace(F.lower("install_location"), r"\\+$", "").alias("folder"))
    compact, name = _compared(F.col("app"), F.col("path"))
    inside = known.where(F.col("path_lower").endswith(".exe")).select(folder("path_lower").alias("folder"), name.alias("name"), "path", "ordinal")
    hunted = beside.unionByName(located).distinct().withColumn("compact", compact)
    best = hunted.join(best_in_folder(hunted, inside), ["folder", "compact"]).groupBy("app", "place").agg(F.min("found").alias("found")).select("app", "place", "found.path")
    return direct.unionByName(best).groupBy("app").agg(F.min_by("path", F.struct("place", "path")).alias("path"))
