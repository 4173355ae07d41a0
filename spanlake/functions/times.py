"""Times, frame clocks and sizes as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ts(text: Column) -> Column:
    """Seconds of '12.5', '1:23.5' or '01:02:03.25'; else null."""
    ok = F.trim(text).rlike(r"^(\d+:){0,2}\d+(\.\d*)?$")
    return F.when(ok, F.aggregate(F.split(F.trim(text), ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double")))


def _ms(t: Column) -> Column:
    return F.round(t * 1000).cast("long")


def _parts(ms: Column, mark: str) -> Column:
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def fmt_ts(t: Column) -> Column:
    """HH:MM:SS.mmm, rounded to milliseconds first."""
    return _parts(_ms(t), ".")


def srt_ts(t: Column) -> Column:
    return _parts(_ms(t), ",")


def fmt_ts_compact(t: Column) -> Column:
    """fmt_ts without hours where they are 0, and without a zero ahead of them."""
    return F.regexp_replace(fmt_ts(t), "^(00:|0(?=[1-9]:))", "")


def frame_rate(text: Column) -> Column:
    """(num, den) of a rate text such as '30000/1001' or '25', reduced; decimals near an NTSC rate become n/1001. Null for other texts, and for numbers beyond a long."""
    fraction = text.rlike(r"^\d+/0*[1-9]\d*$")
    num, den = F.regexp_extract(text, r"^(\d+)/", 1).try_cast("long"), F.regexp_extract(text, r"/(\d+)$", 1).try_cast("long")
    # Euclid's steps as a fold: each takes (a, b) to (b, a mod b), and stays where b is 0
    start = F.struct(num.alias("a"), den.alias("b"))
    step = lambda p, _: F.struct(F.when(p["b"] == 0, p["a"]).otherwise(p["b"]).alias("a"), F.when(p["b"] == 0, F.lit(0).cast("long")).otherwise(p["a"] % F.greatest(p["b"], F.lit(1))).alias("b"))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda p: F.greatest(p["a"], F.lit(1)))
    x = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.cast("double"))
    pair = lambda n, d: F.struct(n.cast("long").alias("num"), d.cast("long").alias("den"))
    ntsc = [(24000, 23.976), (30000, 29.97), (60000, 59.94)]
    out = F.when(fraction & (num.isNull() | den.isNull()), F.lit(None)).when(fraction, pair(F.floor(num / gcd), F.floor(den / gcd)))
    for n, rate in ntsc:
        out = out.when(F.abs(x - rate) <= 0.005, pair(F.lit(n), F.lit(1001)))
    return out.when(x < float(1 << 53), pair(F.round(x), F.lit(1)))


def frames(t: Column, num: Column, den: Column) -> Column:
    """Frames in t seconds at num/den a second; halves go to the even number."""
    return F.bround(t * num / den).cast("long")


def nominal_rate(num: int, den: int) -> tuple[int, int]:
    """The rate that clocks and markers count in: num/den where den is 1 or 1001, else the nearest whole number."""
    return (num, den) if den in (1, 1001) else (max(1, round(num / den)), 1)


def frame_clock(t: Column, num: Column, den: Column) -> Column:
    """Non-drop clock HH:MM:SS:FF of t seconds at num/den frames a second, counted in the nominal rate."""
    n, base = frames(t, num, den), F.bround(num / den).cast("long")
    seconds = F.floor(n / base)
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60, n % base)


def rational_time(t: Column, num: Column, den: Column) -> Column:
    """Frame-aligned time as 'frames*den/nums'."""
    return F.concat((frames(t, num, den) * den).cast("string"), F.lit("/"), num.cast("string"), F.lit("s"))


def human_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", n / float(1024**k))).otherwise(out)
    return out


#: Directory and suffix of file categories (fixed values).
IMAGES, VIDEOS = "jpg|jpeg|png|webp", "mp4|mkv|webm|mov|m4a|wav"


def file_category(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(path.rlike("(^|/)clips/"), "clips").when(path.rlike("(^|/)cache/"), "media").when(suffix.rlike(f"^({IMAGES})$"), "captures").when(suffix.rlike(f"^({VIDEOS})$"), "media").otherwise("text")
