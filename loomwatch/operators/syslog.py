"""Syslog lines to fields: RFC 5424, then RFC 3164, else nothing. All in regular expressions of the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.functions.keys import filled

# Names of facilities and severities by number, words that tell categories and actions.
FACILITIES = ("kernel", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console", "solaris-cron", *[f"local{i}" for i in range(8)])
LEVELS = ("emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug")
AUTH_PROCESSES = ("sshd", "login", "su", "sudo", "auth", "cron", "systemd")
NETWORK_PROCESSES, SYSTEM_PROCESSES = ("kernel", "dhclient", "firewall", "iptables"), ("init", "crond")
AUTH_WORDS = ("login", "authentication", "denied", "failed")
ACTIONS = (("accept", ("accepted",)), ("reject", ("failed", "denied", "refused")), ("start", ("started", "starting")), ("stop", ("stopped", "stopping")), ("error", ("error", "fatal", "critical")), ("warn", ("warning", "warn")))

RFC5424 = r"(?s)^<([0-9]+)>([0-9]+)\s+([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(\[[^\]]*\])?\s*(.*)$"
RFC3164 = r"(?s)^<([0-9]+)>([A-Za-z]{3})\s+([0-9]{1,2})\s+([0-9]{2}:[0-9]{2}:[0-9]{2})\s+(\S+)\s+(\S+?)(?:\[([0-9]+)\])?:\s+(.*)$"
PARAMETER = r'(\w+)=(?:"((?:[^"\\]|\\.)*)"|(\S+))'


def named(code: Column, names: tuple[str, ...], other: str) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), code.cast("int")), F.concat(F.lit(other), code.cast("string")))


def facility(pri: Column) -> Column:
    return named(F.floor(pri / 8), FACILITIES, "facility-")


def level(pri: Column) -> Column:
    return named(F.pmod(pri, F.lit(8)), LEVELS, "severity-")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def action(message: Column) -> Column:
    """The first of the ordered word groups that occurs."""
    low = F.lower(message)
    return reduce(lambda found, a: F.when(has_any(low, a[1]), a[0]).otherwise(found), reversed(ACTIONS), F.lit("info"))


def category_5424(app: Column, message: Column) -> Column:
    return F.when(app.isin(*AUTH_PROCESSES) | has_any(F.lower(message), AUTH_WORDS), "auth").otherwise("system")


def category_3164(process: Column, message: Column) -> Column:
    low = F.lower(process)
    found = F.when(low.isin(*AUTH_PROCESSES), "auth").when(low.isin(*NETWORK_PROCESSES), "network").when(low.isin(*SYSTEM_PROCESSES), "process")
    return found.when(has_any(F.lower(message), AUTH_WORDS), "auth").otherwise("system")


def structured_data(element: Column) -> Column:
    """map(id -> map(name -> value)) of one bracketed element; null without."""
    inner = F.regexp_extract(element, r"^\[(.*)\]$", 1)
    names, quoted, bare = (F.regexp_extract_all(inner, F.lit(PARAMETER), F.lit(i)) for i in (1, 2, 3))
    plain = F.transform(quoted, lambda v, i: F.regexp_replace(F.coalesce(filled(v), F.get(bare, i), F.lit("")), r'\\(["\\\]])', "$1"))
    return F.when(F.length(element) > 0, F.create_map(F.regexp_extract(inner, r"^(\S+)", 1), F.map_from_arrays(names, plain)))


def parse_5424(payload: Column, received: Column) -> Column:
    """A struct, null if the line is not RFC 5424. Nil structured data stays in the message; an unreadable time is the time of receipt."""
    part = lambda i: F.regexp_extract(payload, RFC5424, i)
    pri = part(1).cast("long")
    message = part(9)
    return F.when(
        payload.rlike(RFC5424),
        F.struct(
            F.lit("rfc5424").alias("format"), pri.alias("pri"), part(2).cast("int").alias("version"), facility(pri).alias("facility"), level(pri).alias("severity"),
            F.coalesce(F.try_to_timestamp(part(3)), received).alias("ts"), part(4).alias("host"), part(5).alias("process"), part(6).alias("pid"), part(7).alias("message_id"),
            structured_data(part(8)).alias("structured_data"), message.alias("message"), category_5424(part(5), message).alias("category"), action(message).alias("action"),
        ),
    )


def parse_3164(payload: Column, received: Column, year: int = 2026) -> Column:
    """A struct, null if the line is not RFC 3164; the year, which lines lack, is a parameter."""
    part = lambda i: F.regexp_extract(payload, RFC3164, i)
    pri = part(1).cast("long")
    message = part(8)
    time = F.try_to_timestamp(F.concat_ws(" ", F.lit(str(year)), F.initcap(part(2)), part(3), part(4)), F.lit("yyyy MMM d HH:mm:ss"))
    return F.when(
        payload.rlike(RFC3164),
        F.struct(
            F.lit("rfc3164").alias("format"), pri.alias("pri"), F.lit(None).cast("int").alias("version"), facility(pri).alias("facility"), level(pri).alias("severity"),
            F.coalesce(time, received).alias("ts"), part(5).alias("host"), part(6).alias("process"), filled(part(7)).alias("pid"), F.lit(None).cast("string").alias("message_id"),
            F.lit(None).cast("map<string,map<string,string>>").alias("structured_data"), message.alias("message"), category_3164(part(6), message).alias("category"), action(message).alias("action"),
        ),
    )


def parse(raw: DataFrame, payload: str = "raw_payload", received: str = "received_at", year: int = 2026) -> DataFrame:
    """Adds parsed (struct) and parse_ok. A line of neither format has null fields but category system and action info."""
    text, at = F.col(payload), F.col(received)
    found = raw.withColumn("parsed", F.coalesce(parse_5424(text, at), parse_3164(text, at, year)))
    return found.withColumns(
        {
            "parse_ok": F.col("parsed").isNotNull(),
            "category": F.coalesce("parsed.category", F.lit("system")),
            "action": F.coalesce("parsed.action", F.lit("info")),
        }
    )


def unparsed(parsed: DataFrame, collector: str = "syslog") -> DataFrame:
    """Lines for the dead-letter table."""
    return parsed.where(~F.col("parse_ok")).drop("parsed", "parse_ok", "category", "action").withColumns({"collector": F.lit(collector), "error": F.lit("no syslog format")})
