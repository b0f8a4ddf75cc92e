"""Names, time stamps and label lines as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone names that are dropped from recognised text.
ZONES = ("EST", "EDT", "CST", "CDT", "MST", "MDT", "PST", "PDT", "AST", "ADT", "HST", "AKST", "AKDT", "UTC", "GMT", "BST", "CET", "CEST", "IST", "JST", "KST", "AEST", "AEDT", "NZST", "NZDT")
# Formats of recognised text in order of trial, and whether they have a date.
TIME_FORMATS = (
    ("h:m:s a d-MMM-yy", True),
    ("h:m:s a d-MMM-yyyy", True),
    ("h:m:s a d/M/yyyy", True),
    ("h:m:s a d/M/yy", True),
    ("h:m:s a M/d/yyyy", True),
    ("H:m:s d-MMM-yy", True),
    ("H:m:s d-MMM-yyyy", True),
    ("H:m:s d/M/yyyy", True),
    ("H:m:s d/M/yy", True),
    ("h:m:s a", False),
    ("H:m:s", False),
    ("h:m a", False),
    ("H:m", False),
)
# Formats of times that users type, in order of trial.
USER_FORMATS = (
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m",
    "M/d/yyyy H:m",
    "M/d/yyyy h:m a",
    "yyyy-M-d h:m a",
    "yyyy-M-d h:m:s a",
)


def modality(name: Column, rule: str = "catalogue") -> Column:
    """catalogue: ir unless rgb is there too, else rgb. index: RGB before IR, else unknown."""
    low = F.lower(name)
    ir, rgb = low.contains("ir"), low.contains("rgb")
    if rule == "catalogue":
        return F.when(ir & ~rgb, "ir").otherwise("rgb")
    return F.when(rgb, "rgb").when(ir, "ir").otherwise("unknown")


def clip_name(chamber: Column, wave: Column, stem: Column, start_sec: Column, transformed: bool = False) -> Column:
    return F.concat(F.concat_ws("_", chamber, wave, stem, F.concat(F.lit("s"), start_sec.cast("int").cast("string"))), F.lit("_transformed.mp4" if transformed else ".mp4"))


def link_name(chamber: Column, wave: Column, clip: Column, frame: Column) -> Column:
    return F.concat_ws("__", chamber, wave, clip, frame)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def frame_stem(clip: Column, frame: Column) -> Column:
    """Six digits, or more where the number has more."""
    return F.concat(clip, F.lit("_f"), F.format_string("%06d", frame.cast("long")))


def file_date(name: Column) -> Column:
    """The first six-digit group as ddmmyy, years from 69 in the 1900s; null where it is no date."""
    digits = F.regexp_extract(name, r"(\d{6})", 1)
    day = F.try_to_timestamp(digits, F.lit("ddMMyy")).cast("date")
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def clean_ocr(text: Column, keep_months: bool = False) -> Column:
    """O to 0 everywhere (``keep_months``: only beside digits), o and l between digits, zones and offsets out, spaces squeezed."""
    out = F.regexp_replace(text, r"(?<=[\d:])O|O(?=[\d:])", "0") if keep_months else F.regexp_replace(text, "O", "0")
    out = F.regexp_replace(F.regexp_replace(out, r"(?<=\d)o(?=\d)", "0"), r"(?<=\d)l(?=\d)", "1")
    out = F.regexp_replace(out, r"(?i)\b(?:UTC|GMT)\s*[+-]?\d{1,2}(?::?\d{2})?\b", "")
    out = F.regexp_replace(out, rf"(?i)\b(?:{'|'.join(ZONES)})\b", "")
    return F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"^\s+|\s+$", "")


def time_format(text: Column) -> Column:
    """The first format in the list that reads the text; null if none does."""
    return F.coalesce(*(F.when(F.try_to_timestamp(text, F.lit(f)).isNotNull(), F.lit(f)) for f, _ in TIME_FORMATS))


def has_date(fmt: Column) -> Column:
    return fmt.isin([f for f, dated in TIME_FORMATS if dated])


def parse_with(text: Column, fmt: Column) -> Column:
    return F.coalesce(*(F.when(fmt == f, F.try_to_timestamp(text, F.lit(f))) for f, _ in TIME_FORMATS))


def parse_time(text: Column, fmt: Column, base_date: Column, day_offset: Column, zone: str = "America/New_York") -> Column:
    """Unix seconds. A format without date takes ``base_date`` plus ``day_offset`` days."""
    read = parse_with(text, fmt)
    clock = F.date_format(read, "HH:mm:ss")
    local = F.when(has_date(fmt), read).otherwise(F.try_to_timestamp(F.concat_ws(" ", F.date_add(base_date, day_offset).cast("string"), clock), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.unix_micros(F.to_utc_timestamp(local, zone)) / F.lit(1e6)


def add_seconds(text: Column) -> Column:
    """``H:MM AM`` becomes ``H:MM:00 AM``; other text, and such without a space before AM or PM, stays."""
    return F.regexp_replace(text, r"(?i)^(\d{1,2}:\d{2})\s+(AM|PM)\b(.*)$", "$1:00 $2$3")


def repair_seconds(text: Column, fmt: str, base_date: Column, day_offset: Column, zone: str = "America/New_York") -> Column:
    """Unix seconds of cleaned text that lacks its seconds, read again with them in the recording's own format; null for all other text."""
    fixed = add_seconds(text)
    return F.when(fixed != text, parse_time(fixed, F.lit(fmt), base_date, day_offset, zone))


def frame_of(seconds: Column, rate: Column) -> Column:
    """Frame of a second, cut off."""
    return (seconds * rate).cast("int")


def second_of(frame: Column, rate: Column) -> Column:
    return frame / rate


def ocr_calls(frames: Column, interval: int) -> Column:
    return F.floor(frames / interval) + 1


def ocr_cost(calls: Column, free: int = 0, per_thousand: float = 1.5) -> Column:
    """Price of ``calls`` beyond those that are free."""
    return F.greatest(calls - free, F.lit(0)) * F.lit(per_thousand) / 1000


def actual_rate(frames: Column, seconds: Column, nominal: float) -> Column:
    """Frames a second between two frames; the nominal rate where no time passes."""
    return F.when(seconds == 0, F.lit(nominal)).otherwise(F.abs(frames) / seconds)


def user_time(text: Column, zone: str = "America/New_York") -> Column:
    read = F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in USER_FORMATS))
    return F.unix_micros(F.to_utc_timestamp(read, zone)) / F.lit(1e6)


def local_string(unix: Column, zone: str = "America/New_York", fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Local time of unix seconds; a dash for NaN and null."""
    at = F.from_utc_timestamp(F.timestamp_micros((unix * 1_000_000).cast("long")), zone)
    return F.when(F.isnan(unix) | unix.isNull(), F.lit("—")).otherwise(F.date_format(at, fmt))


def label_issues(line: Column, classes: int | None) -> Column:
    """What is wrong with a ``cls cx cy w h`` line, as an array; NaN coordinates pass, blank lines too. ``classes`` None sets no upper bound."""
    blank = F.trim(F.regexp_replace(line, r"\s", " ")) == ""
    outside = lambda c: (c < 0) | (c > 1) & ~F.isnan(c)
    issue = lambda condition, name: F.when(condition, F.lit(name))

    def values(parts: Column) -> Column:
        at = [F.try_element_at(parts, F.lit(i)).try_cast("double").alias(f"c{i}") for i in range(2, 6)]
        return F.struct(F.size(parts).alias("n"), F.try_element_at(parts, F.lit(1)).try_cast("int").alias("cls"), *at)

    def issues(v: Column) -> Column:
        cls, at, five = v["cls"], [v[f"c{i}"] for i in range(2, 6)], v["n"] == 5
        above = F.lit(False) if classes is None else cls >= classes
        numeric = cls.isNotNull() & at[0].isNotNull() & at[1].isNotNull() & at[2].isNotNull() & at[3].isNotNull()
        return F.array_compact(F.array(issue(~five & ~blank, "fields"), issue(five & ~numeric, "not_numeric"), issue(five & numeric & ((cls < 0) | above), "class"), issue(five & numeric & (outside(at[0]) | outside(at[1]) | outside(at[2]) | outside(at[3])), "range")))

    # Lambdas name the fields and their values, so that a line is split and read once instead of once for every condition.
    return F.get(F.transform(F.transform(F.array(F.split(F.trim(line), r"\s+")), values), issues), F.lit(0))


def fingerprint(document: Column) -> Column:
    """SHA-256 of a JSON document that depends neither on key order nor on white space, at any depth.

    The document is read as a variant, whose objects hold their keys in order; null where it is no JSON.
    """
    return F.sha2(F.to_json(F.try_parse_json(document)), 256)


def dhash(grid: Column, rows: int, columns: int) -> Column:
    """Difference hash of a row-major grid: a bit for right > left, most significant first."""
    places = F.array(*(F.lit(r * columns + c) for r in range(rows) for c in range(columns - 1)))
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc * 2 + (F.get(grid, i + 1) > F.get(grid, i)).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def evenly_spaced(total: Column, k: int) -> Column:
    """k evenly spaced indices below ``total``: all if there are fewer, the middle one for k = 1; half-even rounding."""
    every = F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)))
    some = F.array((total / 2).cast("int")) if k == 1 else F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (total - 1) / F.lit(float(k - 1))).cast("int"))
    return F.when(total <= 0, F.array().cast("array<int>")).when(total <= k, every.cast("array<int>")).otherwise(some.cast("array<int>"))


def count_badge(n: Column, target: int) -> Column:
    return F.when(n == target, "ok").when(n == target - 1, "warn").otherwise("bad")


def missing_badge(share: Column) -> Column:
    return F.when(share == 0, "ok").when(share <= 0.10, "yellow").otherwise("bad")
