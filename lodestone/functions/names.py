"""Columns derived from file and application names, and predicates over names and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name lists and patterns that results depend on.
JUNK_DIRS = ("windows", "program files", "program files (x86)", "$recycle.bin", "prefetch", "appdata", "temp", "perflogs", "debug", "bin", "obj", "node_modules", ".git", "__pycache__", "microsoft")
USER_DIRS = ("users", "documents", "downloads", "desktop", "pictures", "videos", "music")
DOCUMENT_EXTS = tuple("txt md pdf doc docx xls xlsx ppt pptx csv rtf html css js ts json yml yaml toml ini log rs c h cpp hpp py go java cs rb php sql bat cmd ps1 ipynb".split())
MEDIA_EXTS = tuple("png jpg jpeg gif bmp svg webp ico mp3 mp4 mkv avi mov wav flac".split())
ARCHIVE_EXTS = tuple("zip rar 7z tar gz bz2 iso".split())
IMAGE_EXTS = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "ico")
SHELLS = ("cmd", "powershell", "pwsh", "wscript", "cscript")
INTERPRETERS = (*SHELLS, "mshta", "rundll32", "regsvr32")
ARCHITECTURES = r"\((?:x86|x64|arm64|32-bit|64-bit)\)"
VERSION = r"[0-9]*\.[0-9.]*"


def quoted(text: str) -> str:
    """A Java regular expression for exactly this text."""
    return "".join("\\" + c if re.match(r"[^\w\s]", c) else c for c in text)


def extension(name_lower: Column, is_dir: Column) -> Column:
    """What follows the last dot; null without it. A name's only dot in front gives an extension to directories alone."""
    last = F.element_at(F.split(name_lower, r"\."), -1)
    dots = F.length(name_lower) - F.length(F.replace(name_lower, F.lit("."), F.lit("")))
    leading_only = (dots == 1) & name_lower.startswith(".")
    return F.when((dots > 0) & (last != "") & (~leading_only | is_dir), last)


def extension_priority(name_lower: Column) -> Column:
    """0 documents and code, 1 media, 2 archives, 3 others; a name without a dot is its own extension."""
    ext = F.element_at(F.split(name_lower, r"\."), -1)
    return F.when(ext.isin(*DOCUMENT_EXTS), 0).when(ext.isin(*MEDIA_EXTS), 1).when(ext.isin(*ARCHIVE_EXTS), 2).otherwise(3)


def word_prefix(name: Column, query: str) -> Column:
    """Whether one of the non-overlapping occurrences of query, from the left, begins a word (ASCII letters and digits)."""
    if not query:
        return F.lit(True)
    if query.isascii() and query.isalnum():
        return name.rlike(f"(?:^|[^A-Za-z0-9]){quoted(query)}")
    pieces = F.split(name, quoted(query), -1)
    after_hit = not (query[-1].isascii() and query[-1].isalnum())
    left = F.transform(pieces, lambda piece, k: (k < F.size(pieces) - 1) & (piece.rlike("[^A-Za-z0-9]$") | ((piece == "") & ((k == 0) | F.lit(after_hit)))))
    return F.exists(left, lambda hit: hit)


def match_tier(name: Column, query: str) -> Column:
    """1 exact, 2 prefix, 3 prefix of a word, 4 contains; null if none."""
    return F.when(name == query, 1).when(name.startswith(query), 2).when(word_prefix(name, query), F.when(name.contains(query), 3)).when(name.contains(query), 4)


def name_length(name_lower: Column) -> Column:
    return F.least(F.octet_length(name_lower), F.lit(255))


def app_rank(name_lower: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 a word begins with the query, 3 contains; null if none."""
    words = F.split(name_lower, r"[ \-_.(\[]")
    return F.when(name_lower == query, 0).when(name_lower.startswith(query), 1).when(F.exists(words, lambda w: w.startswith(query)), 2).when(name_lower.contains(query), 3)


def kind(is_dir: Column) -> Column:
    return F.when(is_dir, "dir").otherwise("file")


def file_name_key(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"[\\/]"), -1))


def stem(path: Column) -> Column:
    """The lower file name without its last extension."""
    return F.regexp_replace(file_name_key(path), r"(?<=.)\.[^.]*$", "")


#: Folder ids that stand before a path in application ids.
KNOWN_FOLDERS = {"{1ac14e77-02e7-4e5d-b744-2eb1ae5198b7}": "C:\\Windows\\System32", "{d65231b0-b2f1-4857-a4ce-a8e7c6ea7d27}": "C:\\Windows\\SysWOW64", "{6d809377-6af0-444b-8957-a3773f02200e}": "C:\\Program Files"}


def known_folder_path(rest: Column, folders: dict[str, str] = KNOWN_FOLDERS) -> Column:
    """The path of an id like {folder id}\\rest; null without a separator or for another id."""
    at = F.instr(rest, "\\")
    head, tail = F.lower(F.substring(rest, F.lit(1), at - 1)), F.substring(rest, at + 1, F.length(rest))
    base = F.coalesce(*[F.when(head == k, v) for k, v in folders.items()])
    return F.when(at > 0, F.concat(base, F.lit("\\"), tail))


def canonical_path(path: Column) -> Column:
    """The lower path with one kind of separator and without empty, "." and ".." steps; what stands at a network path's beginning stays."""
    low = F.translate(F.lower(F.trim(path)), "/", "\\")
    start = F.regexp_extract(low, r"^(?:\\\\|\\)?", 0)
    steps = F.filter(F.split(low, r"\\"), lambda s: (s != "") & (s != "."))
    back = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", back(done)).otherwise(F.array_append(done, s)))
    return F.concat(start, F.array_join(walked, "\\"))


def _web_page(lower: Column) -> Column:
    return lower.startswith("http") | lower.rlike(r"\.(?:url|html|htm)$")


def shell_junk(name: Column, path: Column) -> Column:
    low, rest = F.lower(name), F.regexp_extract(F.lower(path), r"(?s)^aumid:(.*)$", 1)
    return _web_page(rest) | low.startswith("uninstall ") | low.startswith("install ") | low.endswith(" command prompt")


def shortcut_junk(target: Column) -> Column:
    name = stem(target)
    return _web_page(F.lower(target)) | (name == "") | name.isin(*SHELLS) | name.contains("unins")


def launchable(path: Column) -> Column:
    p = F.trim(path)
    network = p.startswith("\\\\") & ~device_path(p)
    return p.rlike(r"^[A-Za-z]:[\\/]") | network | p.startswith("aumid:") | p.startswith("ms-") | p.startswith("shell:::")


def device_path(path: Column) -> Column:
    return path.startswith("\\\\.\\") | path.startswith("\\\\?\\")


def installer_junk(path: Column) -> Column:
    low = F.lower(path)
    return low.contains("\\package cache\\") | low.endswith("\\package cache") | stem(path).contains("unins")


def uninstaller_allowed(exe: Column) -> Column:
    bare = ~exe.contains("\\") & ~exe.contains("/")
    return ~stem(exe).isin(*INTERPRETERS) & ~(bare & (stem(exe) != "msiexec"))


def looks_like_url(text: Column) -> Column:
    return text.startswith("http://") | text.startswith("https://") | text.rlike(r"\.(?:com|net|org)")


def image_name(path: Column) -> Column:
    last = F.element_at(F.split(F.lower(path), r"[\\/]"), -1)
    return F.element_at(F.split(last, r"\."), -1).isin(*IMAGE_EXTS) & last.contains(".") & ~last.contains(":")


def normalized_app_name(name: Column) -> Column:
    """Lower letters and digits of a name without shortcut and user suffixes and without version, channel and architecture at its end."""
    n = F.regexp_replace(F.trim(name), r"(?i) - shortcut$", "")
    n = F.regexp_replace(n, r"(?i)(?:\(user\)|\(machine\)| - user| - machine)$", "")
    n = F.regexp_replace(n, rf"(?i)(?:(?:^|\s+)(?:-|stable|browser|{VERSION}(?:\s+{ARCHITECTURES})?))+\s*$", "")
    return F.lower(F.regexp_replace(n, "[^A-Za-z0-9]", ""))


def app_name_score(name: Column, path: Column, target_exe: Column) -> Column:
    """How well a name reads, for the choice between entries of one target."""
    upper, lower = name.rlike("[A-Z]"), name.rlike("[a-z]")
    low = F.lower(name)
    of_user = low.contains("(user)") | low.contains("- user") | low.endswith(" user")
    compact = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
    readable = F.when(target_exe.isNull(), 0).when(compact == stem(target_exe), -8).when(name.contains(" "), 3).otherwise(0)
    score = F.when(upper & lower, 4).when(upper, -4).otherwise(0) + F.when(of_user, -6).otherwise(0) - F.floor(F.length(name) / 8).cast("int") + F.when(F.lower(path).endswith(".lnk"), 2).otherwise(0) + readable
    return score.cast("int")
