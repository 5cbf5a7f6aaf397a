"""Scalar helpers as columns, and as Python where a plan is made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Natural lengths of time buckets in seconds.
BUCKETS = (30, 60, 300, 600, 900, 1800, 3600, 7200, 14400, 43200, 86400)
# Bytes and seconds by unit.
_SIZES = {"k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "p": 10**15, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40, "pi": 2**50}
_SECONDS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def choose_bucket(span_seconds: float) -> int:
    """The smallest natural bucket that cuts a span of a minute at least into 200 points or fewer."""
    return next((b for b in BUCKETS if b >= max(60.0, span_seconds) / 200), BUCKETS[-1])


def bucket_start(ts: Column, seconds: int) -> Column:
    """The start of a time's bucket, as a timestamp without zone; buckets of 30 seconds or less are no cut."""
    if seconds <= 30:
        return ts.cast("timestamp").cast("timestamp_ntz")
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")


def _lookup(key: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def duration_seconds(text: Column) -> Column:
    """``"500ms"``, ``"10s"``, ``"5m"``, ``"1h"`` or a number of seconds; null is 0."""
    own = F.lower(F.trim(text))
    number = F.regexp_extract(own, r"^([0-9]*\.?[0-9]+)(ms|s|m|h)?$", 1).try_cast("double")
    unit = F.regexp_extract(own, r"^([0-9]*\.?[0-9]+)(ms|s|m|h)?$", 2)
    return F.when(text.isNull(), 0.0).otherwise(number * F.coalesce(_lookup(unit, _SECONDS), F.lit(1.0)))


def size_bytes(text: Column) -> Column:
    """``"1.5Gi"``, ``"200MB"`` and the like in bytes; what is no size is 0."""
    own = F.lower(F.trim(text))
    digits = F.translate(own, "abcdefghijklmnopqrstuvwxyz", "")  # the number alone, if the letters stand at its end
    unit = F.substring(own, F.length(digits) + 1, F.length(own))
    unit = F.when(unit.endswith("b"), F.substring(unit, 1, F.length(unit) - 1)).otherwise(unit)
    times = F.when(unit == "", 1.0).otherwise(_lookup(unit, _SIZES))
    plain = F.translate(F.rtrim(digits), ".0123456789", "") == ""
    whole = own.startswith(digits) & plain & ~digits.startswith(".") & ~F.rtrim(digits).endswith(".")
    return F.coalesce(F.when(whole, (digits.try_cast("double") * times).cast("long")), F.lit(0))


def next_stream_id(text: Column) -> Column:
    """``ms-seq`` to ``ms-(seq + 1)``, split at the first dash; without a dash ``-1`` is added; a sequence that is no number stays."""
    at = F.instr(text, "-")
    seq = F.substring(text, at + 1, F.length(text)).try_cast("long")
    return F.when(at == 0, F.concat(text, F.lit("-1"))).when(seq.isNull(), text).otherwise(F.concat(F.substring(text, F.lit(1), at), (seq + 1).cast("string")))


def rule_worker(rule: Column) -> Column:
    """What follows the first colon of a rule's name; null without one."""
    return F.when(rule.contains(":"), F.regexp_extract(rule, "^[^:]*:(.*)$", 1))
