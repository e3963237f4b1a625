"""Times, clocks and durations as text. All round half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _whole(seconds: Column | str) -> Column:
    return F.greatest(F.lit(0), F.bround(_c(seconds), 0).cast("long"))


def timestamp(seconds: Column | str) -> Column:
    """MM:SS, or HH:MM:SS from one hour on; negative counts as 0; null gives null (FMT-1)."""
    t = _whole(seconds)
    h, m, s = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    return F.when(_c(seconds).isNull(), None).when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def elapsed(seconds: Column | str) -> Column:
    """'Xm YYs' or 'Xs'; null gives '-' (FMT-2)."""
    t = _whole(seconds)
    m, s = F.floor(t / 60), t % 60
    return F.when(_c(seconds).isNull(), "-").when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def timecode(seconds: Column | str) -> Column:
    """M:SS or H:MM:SS; null gives 0:00 (FMT-3)."""
    t = F.coalesce(_whole(seconds), F.lit(0))
    h, m, s = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def minutes_left(seconds: Column | str) -> Column:
    """'<1 min' under 45 s, else whole minutes; null for null and negative (FMT-4)."""
    x = _c(seconds)
    return F.when(x.isNull() | (x < 0), None).when(x < 45, "<1 min").otherwise(F.format_string("%d min", F.bround(x / 60, 0).cast("long")))


def duration(seconds: Column | str) -> Column:
    """As `timecode`, but '' for null and 0 (FMT-5)."""
    x = _c(seconds)
    return F.when(x.isNull() | (x == 0), "").otherwise(timecode(x))


def month_day(iso: Column | str) -> Column:
    """'Mon D' of an ISO time; '' for null and malformed text (FMT-6)."""
    t = F.try_to_timestamp(_c(iso))
    return F.coalesce(F.date_format(t, "MMM d"), F.lit(""))


#: Fixed values of the time estimate of a clean-up pass.
POLISH_BASE, POLISH_FACTOR = 8.0, 0.05
SHARE_MIN, SHARE_MAX = 0.05, 0.40


def polish_seconds(audio_seconds: Column | str, enabled: Column | bool = True) -> Column:
    """Estimated seconds of a clean-up pass; 0 if off, unknown or 0 (FMT-7)."""
    x = _c(audio_seconds)
    on = enabled if isinstance(enabled, Column) else F.lit(enabled)
    return F.when(on & (x != 0), F.lit(POLISH_BASE) + x * POLISH_FACTOR).otherwise(0.0)


def polish_share(transcribe: Column | str, polish: Column | str, enabled: Column | bool = True) -> Column:
    """Share of the clean-up pass in the whole, kept within its limits; 0 if it is off or nothing is estimated (FMT-8)."""
    t, p = F.coalesce(_c(transcribe), F.lit(0.0)), F.coalesce(_c(polish), F.lit(0.0))
    on = enabled if isinstance(enabled, Column) else F.lit(enabled)
    return F.when(on & (t + p > 0), F.greatest(F.lit(SHARE_MIN), F.least(F.lit(SHARE_MAX), F.try_divide(p, t + p)))).otherwise(0.0)


def unit_key(idx: Column | str) -> Column:
    """track<idx> (FMT-10)."""
    return F.concat(F.lit("track"), _c(idx).cast("string"))
