"""Dates as text: read one named format, convert zones, print another.

A read date is a struct of its wall-clock time (without zone), the zone's offset in
seconds and the zone's short name. A zone setting applies to texts that name none. A
numeric offset in the text stays as it is; a short name counts as offset 0 unless it is
UTC, GMT with hours, or one that the input zone itself uses. The weekday of a text is
not checked. Fractions go down to microseconds. Two-digit years from 69 are in the
1900s. Time-only formats are on 1970-01-01.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions import bind

#: Format names, as (what to take off, pattern to read, zone in the text, pieces to print).
#: W takes a weekday off, S runs of blanks. Pieces: plain patterns, D for the day padded with a blank,
#: O and C for an offset without and with colon, Z for one that is "Z" at zero, N for the zone's name, F for a fraction.
FORMATS = {
    "Layout": ("", "MM/dd hh:mm:ssa ''yy", "offset", ("MM/dd hh:mm:ssa ''yy ", "O")),
    "ANSIC": ("WS", "MMM d HH:mm:ss yyyy", "", ("EEE MMM ", "D", " HH:mm:ss yyyy")),
    "UnixDate": ("WS", "MMM d HH:mm:ss yyyy", "name", ("EEE MMM ", "D", " HH:mm:ss ", "N", " yyyy")),
    "RubyDate": ("W", "MMM d HH:mm:ss yyyy", "offset", ("EEE MMM dd HH:mm:ss ", "O", " yyyy")),
    "RFC822": ("", "dd MMM yy HH:mm", "name", ("dd MMM yy HH:mm ", "N")),
    "RFC822Z": ("", "dd MMM yy HH:mm", "offset", ("dd MMM yy HH:mm ", "O")),
    "RFC850": ("W", "dd-MMM-yy HH:mm:ss", "name", ("EEEE, dd-MMM-yy HH:mm:ss ", "N")),
    "RFC1123": ("W", "dd MMM yyyy HH:mm:ss", "name", ("EEE, dd MMM yyyy HH:mm:ss ", "N")),
    "RFC1123Z": ("W", "dd MMM yyyy HH:mm:ss", "offset", ("EEE, dd MMM yyyy HH:mm:ss ", "O")),
    "RFC3339": ("", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "iso", ("yyyy-MM-dd'T'HH:mm:ss", "Z")),
    "RFC3339Nano": ("", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "iso", ("yyyy-MM-dd'T'HH:mm:ss", "F", "Z")),
    "Kitchen": ("", "h:mma", "", ("h:mma",)),
    "Stamp": ("S", "MMM d HH:mm:ss", "", ("MMM ", "D", " HH:mm:ss")),
    "StampMilli": ("S", "MMM d HH:mm:ss[.SSSSSS]", "", ("MMM ", "D", " HH:mm:ss.SSS")),
    "StampMicro": ("S", "MMM d HH:mm:ss[.SSSSSS]", "", ("MMM ", "D", " HH:mm:ss.SSSSSS")),
    "StampNano": ("S", "MMM d HH:mm:ss[.SSSSSS]", "", ("MMM ", "D", " HH:mm:ss.SSSSSS'000'")),
    "DateTime": ("", "yyyy-MM-dd HH:mm:ss", "", ("yyyy-MM-dd HH:mm:ss",)),
    "DateOnly": ("", "yyyy-MM-dd", "", ("yyyy-MM-dd",)),
    "TimeOnly": ("", "HH:mm:ss", "", ("HH:mm:ss",)),
    "UTC": ("", "yyyy-MM-dd'T'HH:mm:ss'Z'", "", ("yyyy-MM-dd'T'HH:mm:ss'Z'",)),
    "CompactOffset": ("", "yyyyMMddHHmmss", "offset", ("yyyyMMddHHmmss", "O")),
}
#: Date and time styles.
DATE_STYLES = {
    "YYYY-MM-DD": "yyyy-MM-dd", "DD-MM-YYYY": "dd-MM-yyyy", "MM-DD-YYYY": "MM-dd-yyyy",
    "YYYY/MM/DD": "yyyy/MM/dd", "DD/MM/YYYY": "dd/MM/yyyy", "MM/DD/YYYY": "MM/dd/yyyy",
}
TIME_STYLES = {"24h": "HH:mm:ss", "12h": "hh:mm:ss a", "24h-HM": "HH:mm", "12h-HM": "hh:mm a"}


@dataclass(frozen=True)
class DateFormat:
    """Settings of a date node; they are checked when it is made."""

    in_format: str
    out_format: str
    in_timezone: str = ""
    out_timezone: str = ""
    date_style: str = ""
    time_style: str = ""

    def __post_init__(self):
        for name in (self.in_format, self.out_format):
            if name not in FORMATS:
                raise ValueError(f"unknown format {name!r}")
        for zone in (self.in_timezone, self.out_timezone):
            if zone:
                try:
                    ZoneInfo(zone)
                except Exception as e:
                    raise ValueError(f"unknown time zone {zone!r}") from e
        if self.date_style and (self.date_style not in DATE_STYLES or self.out_format not in ("DateOnly", "DateTime")):
            raise ValueError(f"date style {self.date_style!r} does not go with {self.out_format}")
        if self.time_style and (self.time_style not in TIME_STYLES or self.out_format not in ("TimeOnly", "DateTime")):
            raise ValueError(f"time style {self.time_style!r} does not go with {self.out_format}")

    @property
    def pieces(self) -> tuple[str, ...]:
        if not (self.date_style or self.time_style):
            return FORMATS[self.out_format][3]
        date = DATE_STYLES[self.date_style or "YYYY-MM-DD"] if self.out_format != "TimeOnly" else ""
        time = TIME_STYLES[self.time_style or "24h"] if self.out_format != "DateOnly" else ""
        return (" ".join(x for x in (date, time) if x),)


def zone_names(zone: str) -> dict[int, str]:
    """Offsets in seconds that the zone has had since 1970, with the latest short name of each."""
    out, tz = {}, ZoneInfo(zone)
    at = datetime(1970, 1, 1, tzinfo=UTC)
    while at.year < 2038:
        local = at.astimezone(tz)
        out[int(local.utcoffset().total_seconds())] = local.tzname()
        at += timedelta(days=14)
    return out


def _offset_at(local: Column, zone: str) -> Column:
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return (F.unix_seconds(local.cast("timestamp")) - F.unix_seconds(utc.cast("timestamp"))).cast("int")


def _lookup(table: dict, key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default) if table else default


def normalized(s: Column, in_format: str) -> Column:
    """Completes partial texts of the two formats that allow them."""
    if in_format == "DateTime":
        count = lambda c: F.char_length(s) - F.char_length(F.replace(s, F.lit(c), F.lit("")))
        return F.when((F.octet_length(s) == 10) & (count("-") == 2), F.concat(s, F.lit(" 00:00:00"))).when((F.octet_length(s) == 16) & (count(":") == 1), F.concat(s, F.lit(":00"))).otherwise(s)
    if in_format == "DateOnly":
        compact = (F.octet_length(s) == 8) & ~s.contains("-") & ~s.contains("/")
        return F.when(compact, F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))).otherwise(s)
    return s


def parse(s: Column, in_format: str, in_timezone: str = "") -> Column:
    """Struct (local, offset, zone), null if the text is not of the format."""
    return bind(s, lambda x: _parse(x, in_format, in_timezone))


def _parse(s: Column, in_format: str, in_timezone: str) -> Column:
    off, pattern, kind, _ = FORMATS[in_format]
    s = normalized(s, in_format)
    if "W" in off:
        s = F.regexp_replace(s, r"^[A-Za-z]+,? +", "")
    if "S" in off:
        s = F.regexp_replace(s, r" +", " ")
    offset_re = {"offset": r"([+-]\d{4})", "iso": r"(Z|[+-]\d\d:\d\d)$", "name": r" ([A-Z]{3,5}(?:[+-]\d{1,2})?)(?= |$)"}.get(kind)
    mark = F.regexp_extract(s, offset_re, 1) if offset_re else F.lit("")
    if kind == "offset":
        s = F.regexp_replace(s, r" ?[+-]\d{4}", "")
    elif kind:
        s = F.regexp_replace(s, offset_re, "")
    if "SSSSSS" in pattern:  # any number of digits; what is beyond microseconds is cut
        s = F.regexp_replace(F.regexp_replace(s, r"(\.\d{6})\d+$", "$1"), r"(\.\d{1,5})$", "$100000")
        s = F.regexp_replace(s, r"(\.\d{6})\d+$", "$1")
    local = F.try_to_timestamp(s, F.lit(pattern)).cast("timestamp_ntz")
    if "yy" in pattern and "yyyy" not in pattern:
        local = F.when(F.year(local) >= 2069, local - F.expr("INTERVAL 100 YEARS")).otherwise(local)
    return bind(F.struct(local.alias("local"), mark.alias("mark")), lambda x: _zoned(x["local"], x["mark"], kind, in_timezone))


def _zoned(local: Column, mark: Column, kind: str, in_timezone: str) -> Column:
    zone = in_timezone or "UTC"
    names = zone_names(zone)
    own = _offset_at(local, zone) if in_timezone else F.lit(0)
    if kind in ("offset", "iso"):
        digits = F.regexp_replace(mark, ":", "")
        seconds = F.substring(digits, 2, 2).try_cast("int") * 3600 + F.substring(digits, 4, 2).try_cast("int") * 60
        seconds = F.when(mark == "Z", F.lit(0)).when(mark.startswith("-"), -seconds).otherwise(seconds)
        ok, offset = (mark != "") & seconds.isNotNull(), seconds
        title = F.when(mark == "Z", F.lit("UTC")).when(offset == own, _lookup(names, offset, F.lit(""))).otherwise(F.lit(""))
    elif kind == "name":
        by_name = {v: k for k, v in names.items()} if in_timezone else {}
        hours = F.regexp_extract(mark, r"^GMT([+-]\d{1,2})$", 1).try_cast("int")
        offset = _lookup({k: v for k, v in by_name.items() if k}, mark, F.coalesce(hours * 3600, F.lit(0)))
        ok, title = mark != "", mark
    else:
        ok, offset = F.lit(True), own
        title = _lookup(names, own, F.lit("")) if in_timezone else F.lit("UTC")
    return F.when(ok & local.isNotNull(), F.struct(local.alias("local"), offset.cast("int").alias("offset"), title.alias("zone")))


def in_zone(t: Column, zone: str) -> Column:
    """The same moment in another zone."""
    return bind(t, lambda x: _in_zone(x, zone))


def _in_zone(t: Column, zone: str) -> Column:
    utc = t["local"] - F.make_dt_interval(secs=t["offset"])
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    offset = (F.unix_seconds(local.cast("timestamp")) - F.unix_seconds(utc.cast("timestamp"))).cast("int")
    return F.when(t.isNotNull(), F.struct(local.alias("local"), offset.alias("offset"), _lookup(zone_names(zone), offset, F.lit("")).alias("zone")))


def _offset_text(seconds: Column, colon: str) -> Column:
    n = F.abs(seconds)
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(F.when(seconds < 0, F.lit("-")).otherwise(F.lit("+")), two(n / 3600), F.lit(colon), two((n % 3600) / 60))


def show(t: Column, pieces: tuple[str, ...]) -> Column:
    """The text of a date struct."""
    return bind(t, lambda x: _show(x, pieces))


def _show(t: Column, pieces: tuple[str, ...]) -> Column:
    at = t["local"].cast("timestamp")
    out = []
    for p in pieces:
        if p == "D":
            out.append(F.lpad(F.dayofmonth(at).cast("string"), 2, " "))
        elif p == "O":
            out.append(_offset_text(t["offset"], ""))
        elif p == "Z":
            out.append(F.when(t["offset"] == 0, F.lit("Z")).otherwise(_offset_text(t["offset"], ":")))
        elif p == "N":
            out.append(F.when(t["zone"] == "", _offset_text(t["offset"], "")).otherwise(t["zone"]))
        elif p == "F":
            out.append(F.regexp_replace(F.regexp_replace(F.date_format(at, ".SSSSSS"), "0+$", ""), r"^\.$", ""))
        else:
            out.append(F.date_format(at, p))
    return F.concat(*out) if len(out) > 1 else out[0]


def reformat(s: Column, config: DateFormat) -> Column:
    """Struct (result, error): both null for a null or blank text, an error where the text is not of the input format."""
    t = parse(s, config.in_format, config.in_timezone)
    if config.out_timezone:
        t = in_zone(t, config.out_timezone)
    if config.out_format == "UTC":
        t = in_zone(t, "UTC")
    blank = s.isNull() | (F.regexp_replace(s, r"[\s\p{Z}]+", "") == "")
    error = F.concat(F.lit("'"), s, F.lit(f"' is no date of format {config.in_format}"))
    return bind(t, lambda x: F.struct(F.when(~blank, show(x, config.pieces)).alias("result"), F.when(~blank & x.isNull(), error).alias("error")))
