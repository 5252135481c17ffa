"""Rules for File values: what a restore, an update and a new row may hold, and uploads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What File values must look like.
STATUSES = ("ready", "uploaded")
FILE_ID, EXTENSION = r"^[A-Za-z0-9_-]{21}$", r"^[a-zA-Z0-9]{1,10}$"
HASH = r"^(?:[a-f0-9]{32}|[a-f0-9]{40}|[a-f0-9]{64}|[a-f0-9]{128})$"
MIME = r"^[a-zA-Z0-9][a-zA-Z0-9!#$&\-^_]*/[a-zA-Z0-9][a-zA-Z0-9!#$&\-^_.+]*$"
FILE_NAME = r"[<>:\x22/\\|?*\x00-\x1f\x7f]"
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*:[^\s]+$"
LONGEST_MIME, LONGEST_NAME, LONGEST_URL, LARGEST_SIDE, LARGEST_SIZE = 100, 255, 2048, 50_000, (1 << 53) - 1
#: Fields that may change once a file has an id.
FREE = ("fileName", "url")
FIELDS = ("status", "fileId", "url", "fileName", "hash", "extension", "mimeType", "size", "width", "height")


def _whole(value: Column, most: int) -> Column:
    return (value >= 0) & (value == F.floor(value)) & (value <= most)


def _named(checks: list[tuple[Column, str]]) -> Column:
    """Names of the checks that fail; a missing value fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks]))


def restore_problems(file: Column, ids: Column) -> Column:
    """Names of the rules that a File brought back doesn't keep; `ids` are the file ids of its row."""
    text = {f: F.coalesce(file[f], F.lit("")) for f in ("status", "fileId", "url", "fileName", "hash", "extension", "mimeType")}
    empty = lambda f: text[f] == ""
    uploaded, image = text["status"] == "uploaded", text["mimeType"].startswith("image/")
    return _named([
        (text["fileId"].rlike(FILE_ID), "fileId"), (F.size(F.filter(ids, lambda x: x == text["fileId"])) <= 1, "fileId is taken"), (text["status"].isin(*STATUSES), "status"), (empty("hash") | text["hash"].rlike(HASH), "hash"),
        (empty("mimeType") | (text["mimeType"].rlike(MIME) & (F.length(text["mimeType"]) <= LONGEST_MIME)), "mimeType"), (_whole(file["size"], LARGEST_SIZE), "size"), (_whole(file["width"], LARGEST_SIDE), "width"), (_whole(file["height"], LARGEST_SIDE), "height"),
        (empty("extension") | text["extension"].rlike(EXTENSION), "extension"), (~text["fileName"].rlike(FILE_NAME) & (F.length(text["fileName"]) <= LONGEST_NAME), "fileName"), (empty("url") | (text["url"].rlike(URL) & (F.length(text["url"]) <= LONGEST_URL)), "url"),
        (~uploaded | (~empty("hash") & (file["size"] > 0) & ~empty("mimeType")), "uploaded without content"),
        (F.when(image, ~uploaded | (file["width"] != 0) | (file["height"] != 0)).otherwise((file["width"] == 0) & (file["height"] == 0)), "dimensions"),
    ])


def default_problems(file: Column) -> Column:
    """Fields of a new File that aren't at their defaults; it has no id yet."""
    return _named([(F.coalesce(file[f], F.lit(0.0)) == 0 if f in ("size", "width", "height") else F.coalesce(file[f], F.lit("")) == "", f) for f in FIELDS])


def update_problems(file: Column, previous: Column) -> Column:
    """For a File with an id: fields that differ from the File of that id among the row's previous ones, or that there is
    none; for one without, what isn't at its default."""
    before = F.get(F.filter(previous, lambda p: p["fileId"] == file["fileId"]), F.lit(0))
    fixed = _named([(file[f].eqNullSafe(before[f]), f) for f in FIELDS if f not in FREE])
    known = F.when(before.isNull(), F.array(F.lit("no such file"))).otherwise(fixed)
    return F.when(F.coalesce(file["fileId"], F.lit("")) != "", known).otherwise(default_problems(file))


def uploaded(file: Column, file_id: str, name: str, mime: str, content_hash: str, size: int, width: int = 0, height: int = 0) -> Column:
    """The File with an upload's content if it has that id, else as it is."""
    made = {"status": F.lit("uploaded"), "fileName": F.lit(name), "hash": F.lit(content_hash), "extension": F.lit(name.rpartition(".")[2] if "." in name else ""), "mimeType": F.lit(mime), "size": F.lit(float(size)), "width": F.lit(float(width)), "height": F.lit(float(height))}
    new = reduce(lambda f, kv: f.withField(*kv), made.items(), file)
    return F.when(file["fileId"] == file_id, new).otherwise(file)
