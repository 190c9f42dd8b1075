"""Keys of the archive layout as Column functions.

``{prefix}data/account=A/loggroup=G/dt=YYYY-MM-DD/NAME.jsonl.zst`` and
``{prefix}manifest/account=A/loggroup=G/window=START-END.json``, with G percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
DATA_KEY = r"^(?:.*/)?data/account=([^/]+)/loggroup=([^/]+)/dt=([^/]+)/([^/]+)\.jsonl\.zst$"
MANIFEST_KEY = r"^(?:.*/)?manifest/account=([^/]+)/loggroup=([^/]+)/window=(-?\d+)-(-?\d+)\.json$"


def sanitize(group: Column) -> Column:
    """Percent-encode every byte but letters, digits, ``_``, ``.`` and ``-``."""
    return F.replace(F.replace(F.url_encode(group), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def unsanitize(text: Column) -> Column:
    """The strict inverse; null if malformed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def norm_prefix(prefix: Column) -> Column:
    """Without slashes around it and with one behind it, or empty."""
    bare = F.regexp_replace(prefix, "^/+|/+$", "")
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("/")))


def date_of(ts_ms: Column) -> Column:
    """UTC date as text; times beyond year 9999 or before year 0 give 1970-01-01."""
    inside = ts_ms.between(-62_167_219_200_000, 253_402_300_799_999)
    return F.date_format(F.timestamp_millis(F.when(inside, ts_ms).otherwise(F.lit(0))), "yyyy-MM-dd")


def data_key(prefix: Column, account: Column, group: Column, dt: Column, name: Column) -> Column:
    return F.concat(
        norm_prefix(prefix), F.lit("data/account="), account, F.lit("/loggroup="), sanitize(group), F.lit("/dt="), dt, F.lit("/"), name, F.lit(".jsonl.zst")
    )


def parse_data_key(key: Column) -> dict[str, Column]:
    """account, log_group, dt, name; null where the key is not of this layout."""
    part = lambda i: F.when(key.rlike(DATA_KEY), F.regexp_extract(key, DATA_KEY, i))
    return {"account": part(1), "log_group": unsanitize(part(2)), "dt": part(3), "name": part(4)}


def group_prefix(prefix: Column, account: Column, group: Column, kind: str = "data") -> Column:
    """What the keys of a group's objects (or ``manifest``s) begin with."""
    return F.concat(account_prefix(prefix, account, kind), F.lit("loggroup="), sanitize(group), F.lit("/"))


def account_prefix(prefix: Column, account: Column, kind: str = "manifest") -> Column:
    return F.concat(norm_prefix(prefix), F.lit(f"{kind}/account="), account, F.lit("/"))


def manifest_key(prefix: Column, account: Column, group: Column, start: Column, end: Column) -> Column:
    return F.concat(
        norm_prefix(prefix), F.lit("manifest/account="), account, F.lit("/loggroup="), sanitize(group),
        F.lit("/window="), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(".json"),
    )


def parse_manifest_key(key: Column) -> dict[str, Column]:
    part = lambda i: F.when(key.rlike(MANIFEST_KEY), F.regexp_extract(key, MANIFEST_KEY, i))
    return {"account": part(1), "log_group": unsanitize(part(2)), "window_start_ms": part(3).cast("long"), "window_end_ms": part(4).cast("long")}


def drain_name(start: Column, seq: Column) -> Column:
    return F.format_string("%d-%06d", start, seq)


def reconcile_name(start: Column, attempt: Column, seq: Column) -> Column:
    return F.format_string("%d-r%02d%04d", start, attempt, seq)


def gateway_name(first_ts: Column, suffix: Column) -> Column:
    """``<first event's time>-<8 hex digits>``; for a name of its own give ``F.uuid()``'s text."""
    return F.concat(first_ts.cast("string"), F.lit("-"), F.substring(F.replace(suffix, F.lit("-")), 1, 8))


def dates(start: Column, end: Column) -> Column:
    """The UTC dates that a half-open range of times touches, in order."""
    days = F.sequence(F.floor(start / DAY_MS).cast("long"), F.floor((end - 1) / DAY_MS).cast("long"))
    return F.when(start < end, F.transform(days, lambda d: date_of(d * DAY_MS))).otherwise(F.array().cast("array<string>"))
