"""Column builders for names, paths, times and display text. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File extensions and their MIME types.
MIME_TYPES = {
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "tiff": "image/tiff",
    "tif": "image/tiff",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
DEFAULT_MIME = "application/octet-stream"
DEFAULT_DATASET = "default-dataset"


def non_empty(c: Column) -> Column:
    """'' counts as missing."""
    return F.nullif(c, F.lit(""))


def non_zero(c: Column) -> Column:
    """0 counts as missing."""
    return F.when(c != 0, c)


def first_truthy(*cols: Column) -> Column:
    """First text that is neither null nor empty, else null."""
    return F.coalesce(*[non_empty(c) for c in cols])


def is_true(c: Column) -> Column:
    """A missing flag reads as false."""
    return F.coalesce(c, F.lit(False))


def blob_url_parts(url: Column) -> Column:
    """``https://account.host/container/a/b`` as struct(account, container, blob_name)."""
    parts = F.split(F.replace(url, F.lit("https://"), F.lit("")), "/")
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    return F.struct(
        F.split(parts[0], r"\.")[0].alias("account"),
        F.get(parts, 1).alias("container"),
        F.when(F.size(parts) > 2, rest).alias("blob_name"),
    )


def blob_path_parts(path: Column) -> Column:
    """``/container/blob`` split once; ``error`` is set when there are not two parts."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/", 2)
    ok = F.size(parts) == 2
    return F.struct(
        F.when(ok, parts[0]).alias("container"),
        F.when(ok, F.get(parts, 1)).alias("blob_name"),
        F.when(~F.coalesce(ok, F.lit(False)), F.lit("invalid blob path")).alias("error"),
    )


def document_id(blob_name: Column) -> Column:
    return F.replace(blob_name, F.lit("/"), F.lit("__"))


def dataset_of(blob_name: Column, default: str = DEFAULT_DATASET) -> Column:
    parts = F.split(blob_name, "/")
    return F.when(F.size(parts) >= 2, parts[0]).otherwise(F.lit(default))


def dataset_and_file(
    id_: Column, blob_name: Column, dataset: Column, file_name: Column, skip_container: bool = False
) -> Column:
    """struct(dataset, file_name) through the fallback chain field, id, blob name, 'unknown'.

    Names are split once, so a second ``__`` stays in the file name. With
    ``skip_container`` a blob name of three or more segments loses its second one.
    """
    unknown = F.lit("unknown")

    def pair(text: Column, sep: str, file_default: Column) -> Column:
        cut = F.split(text, sep, 2)
        return F.struct(
            F.coalesce(non_empty(cut[0]), unknown).alias("dataset"),
            F.coalesce(non_empty(F.get(cut, 1)), file_default).alias("file_name"),
        )

    named = F.coalesce(non_empty(file_name), unknown)
    given = non_empty(dataset)
    blob = first_truthy(blob_name, id_)
    from_id = F.when(F.contains(id_, F.lit("__")), pair(id_, "__", named)).when(
        F.contains(id_, F.lit("/")), pair(id_, "/", named)
    )
    from_blob = (
        F.when(F.contains(blob, F.lit("/")), pair(blob, "/", unknown))
        .when(F.contains(blob, F.lit("__")), pair(blob, "__", unknown))
        .otherwise(F.struct(unknown.alias("dataset"), F.coalesce(blob, unknown).alias("file_name")))
    )
    chain = (
        F.when(given.isNotNull() & (given != "unknown"), F.struct(given.alias("dataset"), named.alias("file_name")))
        .when(from_id.isNotNull() & (from_id["dataset"] != "unknown"), from_id)
        .otherwise(from_blob)
    )
    if not skip_container:
        return chain
    segments = F.split(blob_name, "/")
    direct = F.struct(
        F.coalesce(non_empty(segments[0]), F.get(segments, 1)).alias("dataset"),
        F.when(F.size(segments) > 2, F.array_join(F.slice(segments, 3, F.greatest(F.size(segments) - 2, F.lit(0))), "/"))
        .otherwise(F.element_at(segments, -1)).alias("file_name"),
    )
    return F.when(F.contains(blob_name, F.lit("/")), direct).otherwise(chain)


_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_ts(c: Column, default: Column | None = None) -> Column:
    """ISO-8601 text as a UTC TIMESTAMP_NTZ; anything else is null, or ``default`` if asked for."""
    offset = c.rlike(r":\d{2}(\.\d+)?[+-]\d{2}:?\d{2}$|T\d{2}:\d{2}[+-]\d{2}:?\d{2}$")
    zoned = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(c).cast("timestamp_ntz")
    )
    ts = F.when(c.rlike(_ISO), F.when(offset, zoned).otherwise(c.try_cast("timestamp_ntz")))
    return ts if default is None else F.coalesce(ts, default)


def preview(c: Column, n: int, suffix: str = "") -> Column:
    """First n characters; the suffix is added only when something was cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(suffix))).otherwise(c)


def extension(filename: Column) -> Column:
    """Lower-cased text after the last dot, '' when there is no dot."""
    return F.when(
        F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1))
    ).otherwise(F.lit(""))


def content_type(filename: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(filename)), F.lit(DEFAULT_MIME))


def ocr_route(filename: Column) -> Column:
    """Whether a text provider gets the file as an image or as a document."""
    image = extension(filename).isin("jpg", "jpeg", "png")
    return F.when(image, F.lit("image_url")).otherwise(F.lit("document_url"))


def format_duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    left = F.floor(F.pmod(seconds, F.lit(60.0)) + 0.5)
    return (
        F.when(seconds.isNull(), F.lit("N/A"))
        .when(seconds < 1, F.concat(F.floor(seconds * 1000 + 0.5).cast("string"), F.lit("ms")))
        .when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m "), left.cast("string"), F.lit("s")))
        .otherwise(
            F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m"))
        )
    )


def format_bytes(size: Column) -> Column:
    """1024-based units with at most two decimals and no trailing zeros."""
    out = F.when(F.coalesce(size, F.lit(0)) == 0, F.lit("0 B"))
    units = ["B", "KB", "MB", "GB", "TB"]
    for power, unit in enumerate(units):
        number = F.regexp_replace(F.format_string("%.2f", size / F.lit(float(1024**power))), r"\.?0+$", "")
        shown = F.concat(number, F.lit(f" {unit}"))
        out = out.otherwise(shown) if power == len(units) - 1 else out.when(size < 1024 ** (power + 1), shown)
    return out


def format_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM d, yyyy, hh:mm a"), F.lit("N/A"))


def truncate(c: Column, n: int) -> Column:
    """At most n characters, the last three being dots when cut; null reads as ''."""
    text = F.coalesce(c, F.lit(""))
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(n - 3)), F.lit("...")))


def python_float_sql(d: str) -> str:
    """SQL text spelling a double as Python's ``str`` does.

    Spark switches to E notation at 1e7 and below 1e-3; Python at 1e16 and below 1e-4. Only
    numbers in E notation are taken apart: sign, digits and exponent, then put together again.
    """
    parts = (
        "named_struct('sign', regexp_extract(s, r'^(-?)', 1), "
        "'digits', concat(regexp_extract(s, r'^-?(\\d)\\.', 1), regexp_replace(regexp_extract(s, r'\\.(\\d+)E', 1), '^0$', '')), "
        "'exp', CAST(regexp_extract(s, r'E(-?\\d+)$', 1) AS INT))"
    )
    large = (
        "concat(p.sign, rpad(left(p.digits, p.exp + 1), p.exp + 1, '0'), '.', "
        "coalesce(nullif(substr(p.digits, p.exp + 2), ''), '0'))"
    )
    small = "concat(p.sign, '0.', repeat('0', -p.exp - 1), p.digits)"
    wide = (
        "concat(p.sign, left(p.digits, 1), if(length(p.digits) > 1, concat('.', substr(p.digits, 2)), ''), 'e', "
        "if(p.exp < 0, '-', '+'), if(abs(p.exp) < 10, '0', ''), abs(p.exp))"
    )
    spelled = f"CASE WHEN p.exp BETWEEN 7 AND 15 THEN {large} WHEN p.exp BETWEEN -4 AND -1 THEN {small} ELSE {wide} END"
    text = f"CAST({d} AS STRING)"
    return (
        f"CASE WHEN contains({text}, 'E') THEN "
        f"transform(transform(array({text}), s -> {parts}), p -> {spelled})[0] ELSE {text} END"
    )


def python_float_text(name: str) -> Column:
    """The named double column spelled as Python does."""
    return F.expr(python_float_sql(f"`{name}`"))
