"""Scalar expressions of the catalogue, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the stored frame: nonce, chunk, and what each chunk adds (length and tag).
NONCE, CHUNK, EXTRA = 12, 1 << 20, 20


def stored_size(size: Column) -> Column:
    """Bytes on disk of an encrypted content: nonce, content, and the additions of each chunk."""
    return (NONCE + size + F.ceil(size / CHUNK) * EXTRA).cast("bigint")


def content_path(volume: Column, sha: Column) -> Column:
    return F.concat_ws("/", volume, F.lit("_content"), F.substring(sha, 1, 2), sha)


#: Units of sizes.
UNITS = ("B", "KB", "MB", "GB", "TB")


def one_decimal(x: Column, ties_up: bool = False) -> Column:
    """A number with one decimal, rounded by its exact binary value as Python and C do; ties to even, or up as in the
    pages (format_string rounds the shortest decimal text of a number, with ties up)."""
    size = F.abs(x.cast("double"))
    low = F.floor(size * 10)
    tie = low * 2 + 1  # in twentieths; near a tie both differences are exact
    over = (size * 16 - tie) + size * 4
    up = (over > 0) | ((over == 0) & (F.lit(True) if ties_up else low % 2 == 1))
    tenths = low + up.cast("bigint")
    shown = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(size < 2.0**48, shown).when(x.isNotNull(), F.format_string("%.1f", x.cast("double")))


def human_bytes(size: Column) -> Column:
    """One decimal in steps of 1024 up to PB."""
    out = None
    for i, unit in enumerate(UNITS):
        shown = F.concat(one_decimal(size / float(1024**i)), F.lit(f" {unit}"))
        test = size < 1024 ** (i + 1)
        out = F.when(test, shown) if out is None else out.when(test, shown)
    return out.otherwise(F.concat(one_decimal(size / float(1024**5)), F.lit(" PB")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)), "/")


def valid_remote(name: Column) -> Column:
    """Fixed value: the pattern of names of remotes."""
    return F.coalesce(name.rlike("^[a-zA-Z0-9_-]{1,64}$"), F.lit(False))


def decoded_path(header: Column) -> Column:
    """A path sent as base64, or the text itself if it is none or not UTF-8."""
    return F.coalesce(F.try_validate_utf8(F.try_to_binary(header, F.lit("base64")).cast("string")), header)


def cron_fields(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+")) == 5


def disk_class(pct: Column, is_cache: Column | None = None) -> Column:
    level = F.when(pct >= 90, "critical").when(pct >= 75, "warning").otherwise("ok")
    return level if is_cache is None else F.when(is_cache, "cache").otherwise(level)


def top_folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def iso_seconds(text: Column) -> Column:
    """Unix seconds of an ISO time with Z or an offset; 0 if it is none."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))) / F.lit(1e6), F.lit(0.0))


def epoch_millis(moment: Column) -> Column:
    return F.unix_millis(moment.cast("timestamp"))


def utc_range(day: Column, zone: str) -> tuple[Column, Column]:
    """Begin and end of a zone's day in UTC, without zone."""
    at = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone).cast("timestamp_ntz")
    return at(day), at(F.date_add(day, 1))


# The texts that follow are those of the pages and of the command line, in their language.

NEVER, NOW_TEXT, NONE = "nunca", "agora", "—"


def duration_text(seconds: Column, minutes: str = "whole") -> Column:
    """A duration as the statistics page (minutes "whole"), the activity page ("split") or the command line ("decimal")
    writes it."""
    whole = F.floor(seconds / 60).cast("string")
    middle = {
        "whole": F.concat(whole, F.lit("min")),
        "split": F.concat(whole, F.lit("min "), F.floor(seconds % 60 + 0.5).cast("string"), F.lit("s")),
        "decimal": F.concat(one_decimal(seconds / 60.0), F.lit("min")),
    }[minutes]
    pages = minutes != "decimal"
    few = F.format_string("%.0fs", seconds if pages else F.rint(seconds))
    return F.when(seconds.isNull(), NONE).when(seconds < 60, few).when(seconds < 3600, middle).otherwise(F.concat(one_decimal(seconds / 3600.0, ties_up=pages), F.lit("h")))


def age_text(seconds: Column) -> Column:
    """How long ago, as the statistics page writes it."""
    days = F.floor(seconds / 86400)
    months = F.floor(days / 30)
    ago = lambda n, unit: F.concat(F.lit("há "), n.cast("string"), F.lit(unit))
    return (
        F.when(seconds < 60, NOW_TEXT).when(seconds < 3600, ago(F.floor(seconds / 60), "min")).when(seconds < 86400, ago(F.floor(seconds / 3600), "h")).when(days < 30, ago(days, "d"))
        .when(months == 1, ago(months, " mês")).when(months < 12, ago(months, " meses")).otherwise(ago(F.floor(months / 12), "a"))
    )


def relative_text(seconds: Column, moment: Column) -> Column:
    """How long ago, as the navigation writes it; the date after 30 days."""
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} atrás"))
    return (
        F.when(F.abs(seconds) < 10, NOW_TEXT).when(seconds < 60, ago(seconds, "s")).when(seconds < 3600, ago(F.floor(seconds / 60), "min"))
        .when(seconds < 86400, ago(F.floor(seconds / 3600), "h")).when(seconds < 86400 * 30, ago(F.floor(seconds / 86400), "d")).otherwise(F.date_format(moment, "yyyy-MM-dd"))
    )


def stale(last: Column, now: Column, days: int = 30) -> Column:
    """Never, or longer ago than so many days."""
    return last.isNull() | (last < now - F.make_dt_interval(days=F.lit(days)))


def trend_class(change: Column) -> Column:
    return F.when(change > 5, "red").when(change > 1, "amber").otherwise("green")


def last_line(text: Column) -> Column:
    """The last line that is not empty; an empty text if there is none."""
    return F.coalesce(F.try_element_at(F.filter(F.split(text, "\n"), lambda x: x != ""), F.lit(-1)), F.lit(""))


def at_least(version: Column, major: int, minor: int) -> Column:
    """Whether a version is major.minor or later; one that can't be read is (0, 0)."""
    part = lambda i: F.try_element_at(F.split(version, r"\."), F.lit(i)).try_cast("int")
    read = F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(1).alias("a"), part(2).alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    return read >= F.struct(F.lit(major).alias("a"), F.lit(minor).alias("b"))


def quoted_name(name: Column) -> Column:
    """A file name in a header: percent escapes, a space among them."""
    return F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


CHECKPOINT = "struct<done_dirs:array<string>,pending_dirs:array<string>,resume_count:bigint>"


def checkpoint(text: Column) -> Column:
    """A walk's checkpoint; nothing done, nothing pending and no resume if it can't be read."""
    read = F.from_json(text, CHECKPOINT)
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(read["done_dirs"], none).alias("done_dirs"), F.coalesce(read["pending_dirs"], none).alias("pending_dirs"), F.coalesce(read["resume_count"], F.lit(0)).alias("resume_count"))


#: The least and greatest of the five fields of a schedule, and the names that two of them know.
CRON = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def valid_cron(text: Column) -> Column:
    """Whether a schedule has five fields, each a list of *, values and ranges within bounds, with steps."""
    fields = F.split(F.trim(text), r"\s+")
    names = {3: MONTHS, 4: WEEKDAYS}

    def valid(i: int) -> Column:
        low, high = CRON[i]
        name = "|".join(names.get(i, ()))
        extra = rf"|(?i:{name})(?:-(?i:{name}))?" if name else "|last" if i == 2 else ""

        def item(x: Column) -> Column:
            first, last = F.regexp_extract(x, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(x, r"^\d+-(\d+)", 1).try_cast("int")
            within = lambda n: n.isNull() | n.between(low, high)
            step = F.regexp_extract(x, r"/(\d+)$", 1).try_cast("int")
            return x.rlike(rf"^(?:\*(?:/\d+)?|\d+(?:-\d+(?:/\d+)?)?{extra})$") & within(first) & within(last) & (last.isNull() | (first <= last)) & (step.isNull() | (step > 0))

        return F.forall(F.split(F.get(fields, i), ","), item)

    test = F.size(fields) == 5
    for i in range(5):
        test = test & valid(i)
    return F.coalesce(test, F.lit(False))
