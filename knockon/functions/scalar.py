"""Column expressions (all JVM-side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from knockon import schema as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: White space as text tools strip it (Unicode spaces and the control characters that count as space).
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
          "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_NUMBER = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?)$"


def strip(c) -> Column:
    """Text without white space at either end; text between two visible ASCII characters is left as it is."""
    text = _c(c).cast("string")
    plain = F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(plain, text).otherwise(F.btrim(text, F.lit(SPACES)))


def coerce_double(c, dtype=None) -> Column:
    """Text or number -> double; text that is no plain number, and NaN, become null.

    Text from a sign, point or digit to a digit, without an x, is left to the cast, which
    takes nothing else there than the pattern does; other text is held against the pattern.
    """
    col = _c(c)
    if dtype is None or isinstance(dtype, StringType):
        text = strip(col)
        plain = (F.substring(col, 1, 1).between("+", "9") & F.substring(col, -1, 1).between("0", "9")
                 & ~F.contains(col, F.lit("x")) & ~F.contains(col, F.lit("X")))
        col = F.when(plain, col).when(text.rlike(_NUMBER), text).try_cast("double")
    else:
        col = col.cast("double")
        if isinstance(dtype, IntegralType):
            return col
    return F.nanvl(col, F.lit(None).cast("double"))


# Date layouts accepted for the flight date: y-m-d, y/m/d, yyyymmdd and m/d/y; a clock time may follow and is ignored.
_DATE = (r"^(?:([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})|([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})"
         r"|([0-9]{4})([0-9]{2})([0-9]{2})|([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}))"
         r"(?:[T ]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?: ?[AaPp][Mm])?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$")
_PLAIN = r"(?s)^.{4}-.{2}-.[0-9]\z"
_OTHER = r"|(?s:^.*$)"  # any other text: no group is set
_ISO = "$1$4$7$12-$2$5$8$10-$3$6$9$11"


def parse_date(c, dtype=None) -> Column:
    """Flight date from text or a date/timestamp column; bad values -> null.

    Text of the form yyyy-mm-dd, the usual one, is cast as it is; it is named twice
    at most, because a filter on the date derives the text again at each mention.  One pattern
    rewrites the other layouts to ISO, and what is no date to text without digits.
    """
    col = _c(c)
    if dtype is not None and not isinstance(dtype, StringType):
        return col.cast("date")
    return F.when(col.rlike(_PLAIN), col).otherwise(F.regexp_replace(strip(col), _DATE + _OTHER, _ISO)).try_cast("date")


def hhmm_whole(hhmm) -> Column:
    """HHMM clock number cut to a whole number; null outside 0 to 2400."""
    num = _c(hhmm)
    return F.when((num > -1) & (num < 2401), num.cast("int"))


def hhmm_split(whole) -> tuple[Column, Column]:
    """Hours and minutes of a whole clock number; 2400 is 00:00 (of the next day)."""
    clock = F.when(_c(whole) == 2400, F.lit(0)).otherwise(_c(whole))
    return (clock / 100).cast("int"), clock % 100  # clock >= 0: the cast is a floor


def hhmm_valid(whole, hours, minutes, date_col) -> Column:
    """A clock of 0-23 hours and 0-59 minutes on a known date."""
    return (_c(whole).isNotNull() & _c(hours).between(0, 23) & _c(minutes).between(0, 59)
            & _c(date_col).isNotNull())


def hhmm_at(whole, hours, minutes, date_col) -> Column:
    """Naive local timestamp (timestamp_ntz) of a valid clock."""
    total = _c(hours) * 60 + _c(minutes) + F.when(_c(whole) == 2400, 1440).otherwise(0)
    return F.timestamp_add("MINUTE", total, _c(date_col).cast("timestamp_ntz"))


def hhmm_timestamp(date_col, hhmm) -> Column:
    """FL_DATE + HHMM -> naive local timestamp (timestamp_ntz), null when invalid."""
    whole = hhmm_whole(hhmm)
    parts = (whole, *hhmm_split(whole), date_col)
    return F.when(hhmm_valid(*parts), hhmm_at(*parts))


def hhmm_hour(date_col, hhmm) -> Column:
    """Hour of day of the same parse (2400 -> 0); null when the time or date is invalid."""
    whole = hhmm_whole(hhmm)
    hours, minutes = hhmm_split(whole)
    return F.when(hhmm_valid(whole, hours, minutes, date_col), hours).cast("int")


def hhmm_minutes(date_col, hhmm) -> Column:
    """Minutes from midnight (2400: 1440) of the same parse; null when the time or date is invalid."""
    whole = _c(hhmm).try_cast("int")
    return F.when(whole.between(0, 2400) & (whole % 100 < 60) & _c(date_col).isNotNull(),
                  whole - (whole / 100).cast("int") * 40)


def minutes_hour(minutes) -> Column:
    """Hour of day of minutes from midnight (1440 -> 0)."""
    return (_c(minutes) / 60).cast("int") % 24


def minutes_timestamp(date_col, minutes) -> Column:
    """Naive local timestamp (timestamp_ntz) so many minutes after the date begins."""
    return F.timestamp_add("MINUTE", _c(minutes), _c(date_col).cast("timestamp_ntz"))


def epoch_minutes(date_col, minutes) -> Column:
    """Minutes from 1970-01-01 00:00 to so many minutes after the date begins."""
    return F.unix_date(_c(date_col)).cast("long") * 1440 + _c(minutes)


def epoch_hour(minutes) -> Column:
    """Hour of day of minutes from 1970-01-01 00:00."""
    return (F.pmod(_c(minutes), F.lit(1440)) / 60).cast("int")


def epoch_timestamp(minutes) -> Column:
    """Naive local timestamp (timestamp_ntz) of minutes from 1970-01-01 00:00."""
    return F.timestamp_add("MINUTE", _c(minutes), F.lit("1970-01-01").cast("timestamp_ntz"))


def overnight_fix(dep, arr, day=None) -> Column:
    """Push the arrival a day later when it is before the departure.

    Both are timestamps, or numbers with ``day`` in their unit.
    """
    dep, arr = _c(dep), _c(arr)
    return F.when(arr < dep, arr + (F.expr("INTERVAL 1 DAY") if day is None else F.lit(day))).otherwise(arr)


def iso_weekday(date_col) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return (F.weekday(_c(date_col)) + 1).cast("int")


def route(origin, dest) -> Column:
    """ORIGIN-DEST, null if either side is null."""
    return F.concat(_c(origin), F.lit("-"), _c(dest))


def minutes_between(start_ts, end_ts) -> Column:
    """(end - start) in fractional minutes, as double."""
    secs = F.timestamp_diff("SECOND", _c(start_ts), _c(end_ts))
    return secs.cast("double") / F.lit(60.0)


def flag_over(c, threshold: float = S.DELAY_FLAG_MINUTES) -> Column:
    """1 if value > threshold else 0; null counts as 0."""
    return F.coalesce(_c(c) > F.lit(threshold), F.lit(False)).cast("int")


def same_value_flag(a, b) -> Column:
    """1 if a == b, else 0 (null -> 0)."""
    return F.coalesce(_c(a) == _c(b), F.lit(False)).cast("int")


def dep_period(hour) -> Column:
    h = _c(hour)
    out = None
    for lo, hi, label in S.DEP_PERIODS:
        cond = h.between(lo, hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def turnaround_bin(minutes) -> Column:
    m = _c(minutes)
    out = None
    for lo, hi, label in S.TURNAROUND_BINS:
        cond = (m >= lo) & ((m < hi) if label != S.TURNAROUND_LABELS[-1] else (m <= hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def turnaround_bin_rank(label) -> Column:
    out = None
    for i, name in enumerate(S.TURNAROUND_LABELS):
        cond = _c(label) == name
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def prev_delay_bin_labels() -> list[str]:
    e = S.PREV_DELAY_EDGES
    return [f"{e[i]} to {e[i + 1]}" for i in range(len(e) - 1)]


def prev_delay_bin(delay) -> Column:
    """Right-closed bins on the fixed edges; the first bin is also left-closed."""
    d = _c(delay)
    e = S.PREV_DELAY_EDGES
    labels = prev_delay_bin_labels()
    out = F.when((d >= e[0]) & (d <= e[1]), F.lit(labels[0]))
    for i in range(1, len(labels)):
        out = out.when((d > e[i]) & (d <= e[i + 1]), F.lit(labels[i]))
    return out


def prev_delay_bin_index(delay) -> Column:
    d = _c(delay)
    e = S.PREV_DELAY_EDGES
    out = F.when((d >= e[0]) & (d <= e[1]), F.lit(0))
    for i in range(1, len(e) - 1):
        out = out.when((d > e[i]) & (d <= e[i + 1]), F.lit(i))
    return out


def per10(coef) -> Column:
    """exp(10 * beta): odds ratio per +10 minutes."""
    return F.exp(F.lit(10.0) * _c(coef))


def decay_value(amplitude, lam, k) -> Column:
    return _c(amplitude) * F.exp(-_c(lam) * _c(k))


def half_life(lam) -> Column:
    return F.when(_c(lam) > 0, F.lit(math.log(2.0)) / _c(lam))


def tail_bucket(tail, n_partitions: int) -> Column:
    """crc32(utf8(stripped tail)) % n; a null tail goes to bucket 0."""
    return F.coalesce(F.crc32(strip(tail).cast("binary")) % F.lit(n_partitions),
                      F.lit(0)).cast("int")
