"""The strict contract of sensor batches: every violation of an event as a code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.functions import checks, keys
from loomwatch.functions.severity import SEVERITIES, lookup
from loomwatch.operators.normalize import SENSOR_TYPES

# Fixed values of the contract.
VERSION, FUTURE_MINUTES, MOST_EVENTS, MOST_BATCH_BYTES, MOST_EVENT_BYTES = "1.0", 5, 100, 1_048_576, 65_536
MOST_KEYS, MOST_BYTES, MOST_DEPTH, MOST_TEXT, MOST_TAGS, MOST_TAG = 32, 16_384, 4, 1024, 32, 64
COMPONENTS = ("fim", "hash_checker", "scanner", "alert_engine")
STATUSES = ("not_applicable", "created", "matched", "added", "modified", "removed", "invalid")
STATUS_OF = {
    "fim.baseline.created": ("created",), "fim.file.added": ("added",), "fim.file.modified": ("modified",), "fim.file.removed": ("removed",), "hash.verified": ("matched",),
    "hash.mismatch": ("modified", "not_applicable"),
}
REQUIRED = {
    "fim.baseline.created": ("baseline_id", "hash_algorithm", "baseline_status"),
    "fim.scan.completed": ("scan_id", "baseline_id"),
    "fim.file.added": ("file_path", "current_hash", "hash_algorithm", "baseline_id", "scan_id", "baseline_status"),
    "fim.file.modified": ("file_path", "previous_hash", "current_hash", "hash_algorithm", "baseline_id", "scan_id", "baseline_status"),
    "fim.file.removed": ("file_path", "previous_hash", "hash_algorithm", "baseline_id", "scan_id", "baseline_status"),
    "hash.verified": ("file_path", "previous_hash", "current_hash", "hash_algorithm", "baseline_status"),
    "hash.mismatch": ("file_path", "previous_hash", "current_hash", "hash_algorithm", "baseline_status"),
}
COUNTS = {"fim.baseline.created": ("file_count",), "fim.scan.completed": ("added", "modified", "removed", "unchanged", "ignored", "duration_ms")}
TEXTS = {"alert.created": ("title", "description"), "alert.updated": ("previous_status", "current_status")}
ROOT = ("event_id", "schema_version", "timestamp", "sequence", "source", "event_type", "severity", "asset", "evidence", "metadata")
SOURCE = ("product", "product_version", "instance_id", "component")
ASSET = ("asset_id", "hostname", "ip", "os")
EVIDENCE = ("file_path", "hash_algorithm", "previous_hash", "current_hash", "baseline_id", "baseline_status", "scan_id", "file_size_bytes", "mtime")
#: What the first violation is called in a receipt; any other is a validation_error.
RECEIPT_CODES = {"invalid_schema_version": "unsupported_schema_version", "invalid_event_type": "invalid_event_type", "invalid_severity": "invalid_severity", "invalid_timestamp": "invalid_timestamp", "timestamp_in_future": "invalid_timestamp", "invalid_event_id": "invalid_event_id"}


@dataclass(frozen=True)
class Dialect:
    """What differs between producers: the product's name (any if None), what event types start with, the key of an alert's id."""

    product: str | None = None
    prefix: str = ""
    alert_id: str = "alert_id"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def child(parent: Column, name: str) -> Column:
    return F.try_variant_get(parent, f"$.{name}", "variant")


#: A whole number of more digits than a variant holds as one.
LONG_WHOLE = r"^[1-9][0-9]{38,}\z"


def kind_of(v: Column) -> Column:
    """The type of a variant; empty if there is none."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def read(v: Column, kind: Column, whole: bool = False) -> Column:
    """there, void (an explicit null), and the text, or the whole number, of a variant of the kind; other kinds have none."""
    if whole:
        long = F.startswith(kind, F.lit("DECIMAL(")) & F.endswith(kind, F.lit(",0)")) & (F.length(kind) > len("DECIMAL(9,0)"))  # 5.0 has kind DECIMAL(1,0)
        value = F.when((kind == "BIGINT") | long, F.try_variant_get(v, "$", "decimal(38,0)")).alias("whole")
    else:
        value = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias("text")
    return F.struct((~kind.isin("", "VOID")).alias("there"), (kind == "VOID").alias("void"), value)


def member(parent: Column, name: str) -> Column:
    """read() of a member."""
    return bind(child(parent, name), lambda v: bind(kind_of(v), lambda kind: read(v, kind))).alias(name)


def split_texts(json: Column) -> Column:
    """JSON cut at its quotation marks: what is outside of texts, a text or key, what is outside and so on."""
    return F.split(F.regexp_replace(json, r"\\(u[0-9a-fA-F]{4}|.)", "~"), '"', -1)


def tree(json: Column, parts: Column) -> Column:
    """json, keys (null if it is no object), longest text or key, and what remains without texts (plain)."""
    return F.struct(
        json.alias("json"), F.json_object_keys(json).alias("keys"), F.coalesce(F.array_max(F.transform(F.filter(parts, lambda x, i: i % 2 == 1), F.length)), F.lit(0)).alias("longest"),
        F.array_join(F.filter(parts, lambda x, i: i % 2 == 0), "").alias("plain"),
    )


def bounded(t: Column) -> Column:
    """Whether an extension tree is an object, has no nulls and keeps to the limits of keys, bytes, texts and depth."""
    flat = F.regexp_replace(t["plain"], r"\[\]|\{\}", "0")  # an empty object or array is not entered
    for _ in range(MOST_DEPTH):
        flat = F.regexp_replace(flat, r"[\[{][^\[\]{}]*[\]}]", "0")
    fits = (F.size(t["keys"]) <= MOST_KEYS) & (F.octet_length(t["json"]) <= MOST_BYTES) & (t["longest"] <= MOST_TEXT)
    return t["keys"].isNotNull() & fits & ~t["plain"].contains("null") & ~flat.rlike(r"[\[{]")


def sized(m: Column, least: int, most: int) -> Column:
    return F.coalesce(F.length(m["text"]).between(least, most), F.lit(False))


def optional(m: Column, ok: Column) -> Column:
    """Absent, or an explicit null, which is a violation of its own, or as it should be."""
    return ~m["there"] | F.coalesce(ok, F.lit(False))


def metadata_names(dialect: Dialect) -> tuple[str, ...]:
    return ("correlation_id", "tags", dialect.alert_id, "rule_id", "dedup_fingerprint")


def groups(dialect: Dialect) -> dict[str, tuple[str, tuple[str, ...]]]:
    """The members that rules look at, by group: the path to them and their names."""
    named = lambda of: tuple(sorted({n for names in of.values() for n in names}))
    return {
        "root": ("", ("event_id", "schema_version", "timestamp", "sequence", "event_type", "severity")), "source": ("source.", SOURCE), "asset": ("asset.", ASSET),
        "evidence": ("evidence.", EVIDENCE), "metadata": ("metadata.", metadata_names(dialect)), "counts": ("evidence.details.", named(COUNTS)), "texts": ("evidence.details.", named(TEXTS)),
    }


#: Parts of an event whose keys are judged, with the paths to them.
PARTS = {"root": "$", "source": "$.source", "asset": "$.asset", "evidence": "$.evidence"}


#: Members that are read as whole numbers; the others are read as texts.
WHOLE = {"sequence", "file_size_bytes", *(n for names in COUNTS.values() for n in names)}
#: Canonical JSON is at most so many times its source: 1e6 becomes 1000000.0, a broken byte three.
GROWS = 4


def drawn_type(dialect: Dialect) -> str:
    """All members that rules look at as one type, so that a variant is walked once."""
    g = {n: ",".join(f"{m} variant" for m in names) for n, (_, names) in groups(dialect).items()}
    details = ",".join(f"{m} variant" for m in sorted({*groups(dialect)["counts"][1], *groups(dialect)["texts"][1]}))
    return f"struct<{g['root']},source struct<{g['source']}>,asset struct<{g['asset']}>,evidence struct<{g['evidence']},details struct<{details}>>,metadata struct<{g['metadata']}>>"


def names_of(v: Column, path: str) -> Column:
    """The keys of the object there; null if it is none."""
    return F.map_keys(F.try_variant_get(v, path, "map<string,variant>"))


def members(v: Column, payload: Column, dialect: Dialect) -> Column:
    """First step: every member as a variant, the parts' keys, the extension trees as JSON, the tags."""
    json = lambda path: F.to_json(F.try_variant_get(v, path, "variant"))
    few = F.octet_length(payload) <= MOST_EVENT_BYTES // GROWS
    return F.struct(
        F.try_variant_get(v, "$", drawn_type(dialect)).alias("all"), F.struct(json("$.evidence.details").alias("details"), json("$.metadata").alias("metadata")).alias("json"),
        F.when(~few, F.octet_length(F.to_json(v))).otherwise(F.octet_length(payload)).alias("bytes"), F.struct(*[names_of(v, path).alias(n) for n, path in PARTS.items()]).alias("keys"),
        F.try_variant_get(v, "$.metadata.tags", "array<variant>").alias("tags"),
    )


def at(all_: Column, path: str, name: str) -> Column:
    """A member in what has drawn_type()."""
    return reduce(lambda c, n: c[n], [n for n in path.split(".") if n], all_)[name]


def kinds(c: Column, dialect: Dialect) -> Column:
    """Second step: the members' types, the trees cut at their texts."""
    return F.struct(
        *[F.struct(*[kind_of(at(c["all"], path, n)).alias(n) for n in names]).alias(g) for g, (path, names) in groups(dialect).items()],
        F.struct(*[split_texts(c["json"][n]).alias(n) for n in ("details", "metadata")]).alias("cut"),
    )


def drawn(c: Column, k: Column, dialect: Dialect) -> Column:
    """Third step: all that the rules look at."""
    j = c["json"]
    return F.struct(
        *[F.struct(*[read(at(c["all"], path, n), k[g][n], n in WHOLE).alias(n) for n in names]).alias(g) for g, (path, names) in groups(dialect).items()],
        c["bytes"].alias("bytes"), c["keys"]["root"].alias("keys"), F.struct(*[c["keys"][n].alias(n) for n in ("source", "asset", "evidence")]).alias("names"),
        c["tags"].alias("tags"), tree(j["details"], k["cut"]["details"]).alias("details"), tree(j["metadata"], k["cut"]["metadata"]).alias("extra"),
    )


def judged(x: Column, payload: Column, now: Column, dialect: Dialect) -> Column:
    """Codes of the violations in what drawn() has read."""
    metadata = metadata_names(dialect)
    r, s, a, e, m = (x[n] for n in ("root", "source", "asset", "evidence", "metadata"))
    kind = r["event_type"]["text"]
    kind = F.when(F.startswith(kind, F.lit(dialect.prefix)), F.substring(kind, len(dialect.prefix) + 1, 100)) if dialect.prefix else kind
    time, path = checks.utc_time(r["timestamp"]["text"]), e["file_path"]["text"]
    algorithm, current, previous = e["hash_algorithm"]["text"], e["current_hash"]["text"], e["previous_hash"]["text"]
    only = lambda names, allowed: F.coalesce(F.size(F.array_except(names, F.array(*[F.lit(n) for n in allowed]))) == 0, F.lit(True))
    void = reduce(lambda p, q: p | q, [g[n]["void"] for g, names in ((a, ("ip", "os")), (e, EVIDENCE), (m, metadata)) for n in names])
    hashed = lambda h: optional(e[h], checks.matches(e[h]["text"], r"^[0-9a-f]+\z") & (F.length(e[h]["text"]) == lookup(algorithm, checks.HASHES, 0)))
    tags = F.transform(x["tags"], lambda t: F.when(F.schema_of_variant(t) == "STRING", F.length(F.try_variant_get(t, "$", "string"))))
    names = lambda of, ok: reduce(lambda p, q: p & q, [~(kind == k) | reduce(lambda u, w: u & w, [ok(n) for n in ns]) for k, ns in of.items()])
    plain = checks.matches(path, "^[^/]") & ~path.rlike(r"\\|^[A-Za-z]:|\x00|//|/\z|(^|/)\.{1,2}(/|\z)")
    statuses = [~(kind == k) | F.coalesce(e["baseline_status"]["text"].isin(*v), F.lit(False)) for k, v in STATUS_OF.items()]
    rules = {
        "too_large": x["bytes"] <= MOST_EVENT_BYTES,
        "invalid_event_id": checks.is_uuid4(r["event_id"]["text"]),
        "invalid_schema_version": r["schema_version"]["text"] == VERSION,
        "invalid_timestamp": time.isNotNull(),
        "timestamp_in_future": time.isNull() | (time <= now + F.make_interval(mins=F.lit(FUTURE_MINUTES))),
        "invalid_sequence": F.coalesce(r["sequence"]["whole"] >= 1, checks.matches(F.get_json_object(payload, "$.sequence"), LONG_WHOLE)),
        "invalid_source": (s["product"]["text"] == dialect.product if dialect.product else sized(s["product"], 1, MOST_TEXT))
        & sized(s["product_version"], 1, 32) & checks.matches(s["product_version"]["text"], checks.SEMVER) & checks.is_canonical_uuid(s["instance_id"]["text"]) & s["component"]["text"].isin(*COMPONENTS),
        "invalid_event_type": kind.isin(*SENSOR_TYPES),
        "invalid_severity": r["severity"]["text"].isin(*SEVERITIES),
        "invalid_asset": sized(a["asset_id"], 1, 255) & sized(a["hostname"], 1, 255) & optional(a["os"], sized(a["os"], 1, 255)),
        "invalid_ip": optional(a["ip"], sized(a["ip"], 2, 45) & checks.exact_ip(a["ip"]["text"])),
        "invalid_evidence": x["names"]["evidence"].isNotNull() & optional(e["baseline_id"], sized(e["baseline_id"], 1, 255)) & optional(e["scan_id"], sized(e["scan_id"], 1, 255))
        & optional(e["baseline_status"], e["baseline_status"]["text"].isin(*STATUSES)) & optional(e["file_size_bytes"], e["file_size_bytes"]["whole"] >= 0) & optional(e["mtime"], checks.utc_time(e["mtime"]["text"]).isNotNull()),
        "invalid_path": optional(e["file_path"], sized(e["file_path"], 1, 4096) & plain),
        "invalid_hash": optional(e["hash_algorithm"], algorithm.isin(*checks.HASHES)) & hashed("current_hash") & hashed("previous_hash"),
        "invalid_details": bounded(x["details"]),
        "invalid_metadata": bounded(x["extra"]) & F.forall(x["extra"]["keys"], lambda k: k.isin(*metadata) | F.startswith(k, F.lit("x_")))
        & reduce(lambda p, q: p & q, [optional(m[n], sized(m[n], 1, MOST_TEXT)) for n in metadata if n != "tags"]),
        "invalid_tags": optional(m["tags"], (F.size(x["tags"]) <= MOST_TAGS) & F.forall(tags, lambda n: F.coalesce(n.between(1, MOST_TAG), F.lit(False)))),
        "null_field": ~void,
        "unknown_field": only(x["keys"], ROOT) & only(x["names"]["source"], SOURCE) & only(x["names"]["asset"], ASSET) & only(x["names"]["evidence"], (*EVIDENCE, "details")),
        "missing_evidence": names(REQUIRED, lambda n: e[n]["there"]),
        "invalid_baseline_status": reduce(lambda p, q: p & q, statuses),
        "forbidden_current_hash": ~(kind == "fim.file.removed") | ~e["current_hash"]["there"],
        "hashes_equal": ~kind.isin("fim.file.modified", "hash.mismatch") | current.isNull() | previous.isNull() | (current != previous),
        "invalid_counts": names(COUNTS, lambda n: F.coalesce(x["counts"][n]["whole"] >= 0, F.lit(False))),
        "invalid_alert": names(TEXTS, lambda n: sized(x["texts"][n], 1, MOST_BYTES)) & (~F.startswith(kind, F.lit("alert.")) | m[dialect.alert_id]["there"]) & (~(kind == "alert.created") | m["rule_id"]["there"]),
    }
    # A type that is unknown has no further rules: they hold.
    typed = list(rules)[list(rules).index("missing_evidence") :]
    return checks.failures({k: F.coalesce(c, F.lit(True)) if k in typed else c for k, c in rules.items()})



BROKEN = ("invalid_json",)


def errors(payload: Column, now: Column, dialect: Dialect = Dialect()) -> Column:
    """Codes of all violations of the event in a JSON text, in a fixed order; [invalid_json] if it is none.

    Text with a key twice or numbers that are not finite is no JSON. Types are strict: no text counts as a number
    and no number with a fraction as a whole one. The text is parsed once. with_errors() does the same for a table, and faster.
    """
    found = lambda v: bind(members(v, payload, dialect), lambda c: bind(kinds(c, dialect), lambda k: bind(drawn(c, k, dialect), lambda x: judged(x, payload, now, dialect))))
    return bind(F.try_parse_json(payload), lambda v: F.when(v.isNull(), F.array(*map(F.lit, BROKEN))).otherwise(found(v)))


def with_errors(events: DataFrame, payload: str, now: Column, dialect: Dialect = Dialect(), name: str = "errors", parsed: str | None = None) -> DataFrame:
    """The events with errors() of their payload, step by step as columns: each step is compiled and what it draws is used often.

    ``parsed`` names a column that has the payload as a variant already.
    """
    v, c, k, x = (F.col(f"__{n}") for n in "vckx")
    steps = events.withColumn("__v", F.col(parsed) if parsed else F.try_parse_json(payload)).withColumn("__c", members(v, F.col(payload), dialect)).withColumn("__k", kinds(c, dialect)).withColumn("__x", drawn(c, k, dialect))
    found = F.when(v.isNull(), F.array(*map(F.lit, BROKEN))).otherwise(judged(x, F.col(payload), now, dialect))
    return steps.withColumn(name, found).drop("__v", "__c", "__k", "__x")


def receipt_code(found: Column) -> Column:
    """What a receipt calls the first of the violations; null without any."""
    return F.when(F.size(found) > 0, lookup(F.get(found, F.lit(0)), RECEIPT_CODES, "validation_error"))


def batch_errors(batches: DataFrame, payload: str = "payload", canonical: str | None = None, events: str | None = None, batch_id: str | None = None) -> DataFrame:
    """Adds batch_errors to whole batches (a JSON text): too_large, invalid_batch_id, invalid_sent_at, unknown_field, invalid_events (1 to MOST_EVENTS), invalid_json.

    ``canonical`` names a column to add for the canonical JSON, null for what is none, ``events`` one for the JSON of
    each event, null for what has no list of them, ``batch_id`` one for the id as a text. A batch is parsed and written once.
    """
    v, json, c = F.col("__v"), F.col("__json"), F.col("__c")
    found = batches.withColumn("__v", F.try_parse_json(payload)).withColumn("__json", F.to_json(v)).withColumn("__c", F.try_variant_get(v, "$", "struct<batch_id variant,sent_at variant>"))
    found = found.withColumns({"__text": F.struct(*[F.when(kind_of(c[n]) == "STRING", F.try_variant_get(c[n], "$", "string")).alias(n) for n in ("batch_id", "sent_at")]), "__cut": F.from_json(json, "events array<string>")["events"]})
    # Cut out of the canonical JSON as they stand, events need not be written again; the cut holds where it adds up to the whole.
    text, cut = F.col("__text"), F.col("__cut")
    whole = F.concat(F.lit('{"batch_id":"'), text["batch_id"], F.lit('","events":['), F.array_join(cut, ","), F.lit('],"sent_at":"'), text["sent_at"], F.lit('"}'))
    found = found.withColumn("__plain", F.coalesce(json == whole, F.lit(False)))
    plain, listed = F.col("__plain"), F.try_variant_get(v, "$.events", "array<variant>")
    rules = {
        "too_large": (F.octet_length(payload) <= MOST_BATCH_BYTES) & (F.octet_length(json) <= MOST_BATCH_BYTES),
        "invalid_batch_id": checks.is_uuid4(text["batch_id"]),
        "invalid_sent_at": checks.utc_time(text["sent_at"]).isNotNull(),
        "invalid_events": F.when(plain, F.size(cut)).otherwise(F.size(listed)).between(1, MOST_EVENTS),
        "unknown_field": plain | (F.size(F.array_except(F.json_object_keys(json), F.array(*[F.lit(n) for n in ("batch_id", "sent_at", "events")]))) == 0),
    }
    judged = found.withColumn("batch_errors", F.when(v.isNull(), F.array(F.lit("invalid_json"))).otherwise(checks.failures(rules)))
    made = {canonical: json, events: F.when(plain, cut).otherwise(F.transform(listed, lambda e: F.to_json(e))), batch_id: F.try_variant_get(v, "$.batch_id", "string")}
    return judged.select(*batches.columns, "batch_errors", *[c.alias(name) for name, c in made.items() if name])


def classify_batch(batch: DataFrame, inbox: DataFrame) -> DataFrame:
    """Adds ack to the rows (batch_id, position, source_instance_id, event_id, content_hash, errors): rejected, duplicate, accepted or conflict.

    An event that breaks the contract is rejected. A key that came earlier in the batch or is in the inbox is a
    duplicate if its content is the same, else a conflict; one conflict rejects its whole batch.
    """
    from pyspark.sql import Window

    key = ["source_instance_id", "event_id"]
    good = F.size("errors") == 0
    w = Window.partitionBy("batch_id", *key, good).orderBy("position")
    held = inbox.select(*key, F.col("content_hash").alias("__held"))
    seen = batch.withColumn("__first", F.first("content_hash").over(w)).withColumn("__n", F.row_number().over(w)).join(held, key, "left")
    known = F.coalesce("__held", F.when(F.col("__n") > 1, F.col("__first")))
    ack = F.when(~good, "rejected").when(known.isNull(), "accepted").when(known == F.col("content_hash"), "duplicate").otherwise("conflict")
    judged = seen.withColumn("ack", ack)
    clash = F.max((F.col("ack") == "conflict").cast("int")).over(Window.partitionBy("batch_id")) == 1  # a batch has at most MOST_EVENTS rows
    return judged.withColumn("batch_conflict", clash).select(*batch.columns, "ack", "batch_conflict")


def receipts(judged: DataFrame) -> DataFrame:
    """Per batch: accepted, duplicate and rejected events and whether it was stored."""
    of = lambda kind: F.count_if(F.col("ack") == kind).alias(kind)
    counted = judged.groupBy("batch_id").agg(of("accepted"), of("duplicate"), of("rejected"), of("conflict"), F.max("batch_conflict").alias("aborted"))
    stored = ~F.col("aborted") & (F.col("accepted") + F.col("duplicate") > 0)
    return counted.withColumn("status", F.when(F.col("aborted"), "conflict").when(stored, "stored").otherwise("rejected"))


def replayed(batches: DataFrame, receipts_: DataFrame) -> DataFrame:
    """Batches (batch_id, content_hash) against stored receipts: new, replay or conflict."""
    held = receipts_.select("batch_id", F.col("content_hash").alias("__held"))
    state = F.when(F.col("__held").isNull(), "new").when(F.col("__held") == F.col("content_hash"), "replay").otherwise("conflict")
    return batches.join(held, "batch_id", "left").withColumn("state", state).drop("__held")


def with_hash(events: DataFrame, payload: str = "payload") -> DataFrame:
    return events.withColumn("content_hash", keys.content_hash(F.col(payload)))
