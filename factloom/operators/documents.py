"""Documents of cassettes: where their files are, which preview to show, and the preview backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import is_blank
from ..functions.uris import document_cassette, document_folder, document_number, safe_part

TREES = ("original", "icon", "small", "medium", "normal")

# fixed order of fallbacks per requested size
VARIANTS = {
    "original": ("original",),
    "icon": ("icon", "small", "medium", "normal", "original"),
    "small": ("medium", "normal", "small", "icon", "original"),
    "medium": ("medium", "normal", "small", "icon", "original"),
    "normal": ("normal", "medium", "small", "icon", "original"),
}
IMAGE_ORDER = ("normal", "medium", "small", "icon", "original")

# fixed file extensions of the image media types
IMAGE_EXTENSIONS = ("art", "bmp", "cmx", "cod", "dib", "gif", "ico", "ief", "jfif", "jpe", "jpeg", "jpg", "pbm", "pgm", "pict",
                    "png", "pnm", "pnt", "pntg", "pnz", "ppm", "qti", "qtif", "ras", "rf", "rgb", "svg", "svgz", "tif", "tiff",
                    "wbmp", "webp", "wdp", "xbm", "xpm", "xwd", "avif", "heic", "heif")


def document_files(listing: DataFrame, cassettes: DataFrame) -> DataFrame:
    """``schemas.DOC_FILES`` rows from a file listing (path, modificationTime) and the cassettes' folders."""
    rel = F.regexp_extract("path", r"/(originals|documents/(?:icon|small|medium|normal))/([^/]+)/([^/]+)$", 1)
    folder = F.regexp_extract("path", r"/([^/]+)/([^/]+)$", 1)
    name = F.regexp_extract("path", r"/([^/]+)$", 1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    roots = cassettes.select(F.col("id").alias("cassette_id"), F.regexp_replace("path", "/+$", "").alias("root"))
    inside = F.regexp_extract("path", r"^(?:file:)?(.*)/(?:originals|documents)/.*$", 1)
    found = listing.where(rel != "").withColumn("root", F.regexp_replace(inside, "^//", ""))
    return found.join(roots, "root").select(
        "cassette_id", F.when(rel == "originals", "original").otherwise(F.element_at(F.split(rel, "/"), -1)).alias("tree"),
        folder.alias("folder"), F.left(name, F.length(name) - F.length(ext)).alias("stem"), ext.alias("ext"), "path",
        F.col("modificationTime").alias("mtime"))


def locate(uris: DataFrame, files: DataFrame, cassettes: DataFrame) -> DataFrame:
    """Files of each ``document_uri``: one path per tree, previews older than the original left out.

    ``problem`` names what is wrong with an address: not_a_document, unknown_cassette, unsafe_part or
    ambiguous (several files of one tree); its paths are then null.
    """
    named = cassettes.where("enabled").select(F.col("id").alias("cassette_id"), F.lower("name").alias("cassette_key"))
    named = named.groupBy("cassette_key").agg(F.min("cassette_id").alias("cassette_id"))
    asked = uris.select(
        "document_uri", F.lower(document_cassette("document_uri")).alias("cassette_key"),
        document_folder("document_uri").alias("folder"), document_number("document_uri").alias("number")).distinct()
    asked = asked.join(named, "cassette_key", "left").withColumn("key", F.lower("number"))

    # a file answers to its name without extension and to its whole name
    keys = F.array_distinct(F.array(F.lower("stem"), F.lower(F.concat("stem", "ext"))))
    slots = files.withColumn("key", F.explode(keys)).groupBy("cassette_id", "folder", "key").agg(*[
        x for t in TREES for x in (
            F.count(F.when(F.col("tree") == t, 1)).alias(f"{t}_n"), F.max(F.when(F.col("tree") == t, F.col("path"))).alias(f"{t}_path"),
            F.max(F.when(F.col("tree") == t, F.col("mtime"))).alias(f"{t}_mtime"))])
    # never a broadcast: sizes estimated from packed files are far below those of the rows
    rows = asked.join(slots.hint("merge"), ["cassette_id", "folder", "key"], "left")
    several = F.greatest(*[F.coalesce(f"{t}_n", F.lit(0)) for t in TREES]) > 1
    problem = (F.when(F.col("cassette_key").isNull(), "not_a_document").when(F.col("cassette_id").isNull(), "unknown_cassette")
               .when(~F.coalesce(safe_part("folder") & safe_part("number"), F.lit(False)), "unsafe_part").when(several, "ambiguous"))
    shown = problem.isNull()
    return rows.select(
        "document_uri", "cassette_id", "folder", "number", problem.alias("problem"),
        *[F.when(shown & (fresh_preview(f"{t}_mtime", "original_mtime") if t != "original" else F.lit(True)), F.col(f"{t}_path")).alias(t) for t in TREES])


def fresh_preview(preview_time, original_time) -> Column:
    """True unless the preview is older than an existing original."""
    p, o = (F.col(c) if isinstance(c, str) else c for c in (preview_time, original_time))
    return p.isNotNull() & (o.isNull() | (p >= o))


def variant(locations: DataFrame, size: str) -> DataFrame:
    """Adds ``path``: the file to show at a requested size."""
    if size not in VARIANTS:
        raise ValueError(f"size must be one of {', '.join(VARIANTS)}")
    return locations.withColumn("path", F.coalesce(*VARIANTS[size]))


def is_image(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*IMAGE_EXTENSIONS)


def best_image(locations: DataFrame) -> DataFrame:
    """Adds ``image`` and ``image_variant``: the largest preview, or original, that is an image."""
    found = F.coalesce(*[F.when(is_image(F.col(t)), F.struct(F.col(t).alias("image"), F.lit(t).alias("image_variant"))) for t in IMAGE_ORDER])
    return locations.select("*", found["image"].alias("image"), found["image_variant"].alias("image_variant"))


# --- preview backlog --------------------------------------------------------------------------------------

STATES = ("queued", "processing", "failed")


def backlog(requests: DataFrame, cassettes: DataFrame) -> DataFrame:
    """(cassette_id, queued, processing, failed, oldest_queued) per enabled cassette and, with a null id, in total."""
    counted = requests.groupBy("cassette_id").agg(
        *[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in STATES],
        F.min(F.when(F.col("state") == "queued", F.col("requested_at"))).alias("oldest_queued"))
    per = (cassettes.where("enabled").select(F.col("id").alias("cassette_id")).join(counted, "cassette_id", "left").fillna(0, list(STATES)))
    return per.rollup("cassette_id").agg(*[F.sum(s).alias(s) for s in STATES], F.min("oldest_queued").alias("oldest_queued"))


def request_faults(requests: DataFrame, cassettes: DataFrame) -> DataFrame:
    """(request, code) of preview requests that cannot be worked on. ``folder_cassette_id`` tells where a request lies."""
    def slot(c: str) -> Column:
        return ~F.coalesce(safe_part(c), F.lit(False))

    codes = {
        "bad_id": ~F.coalesce(F.col("request_id").rlike("^[0-9a-fA-F]{32}$"), F.lit(False)),
        "other_cassette": ~F.col("cassette_id").eqNullSafe(F.col("folder_cassette_id")),
        "bad_folder": slot("folder_name"), "bad_number": slot("document_number"),
        "bad_file_name": is_blank("document_uri") | is_blank("original_file_name") | F.coalesce(F.col("original_file_name").contains("/"), F.lit(False)),
        "bad_metadata": ~F.coalesce((F.col("original_length") > 0) & F.col("original_sha256").rlike("^[0-9a-fA-F]{64}$") & (F.col("attempt") >= 0), F.lit(False)),
    }
    listed = F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in codes.items()]), lambda c: c.isNotNull())
    known = cassettes.select(F.col("id").alias("folder_cassette_id"))
    return requests.join(known, "folder_cassette_id", "left_semi").select("request_id", "folder_cassette_id", F.explode(listed).alias("code"))
