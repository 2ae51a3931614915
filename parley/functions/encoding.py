"""JSON, ids and digests as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

# Fields of an insight that are left out when null (or false), tags of stream chunks with the JSON names of their fields, the name space of reply ids, settings with defaults.
CHUNK_FIELDS = {
    "start": ("messageId",), "text-start": ("id",), "text-delta": ("id", "delta"), "text-end": ("id",), "data-activity": ("data", "transient"), "error": ("errorText",), "finish": ("finishReason",),
}
OPTIONAL = ("source", "id", "producer", "feedback", "feedback_withdraw_pending")
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"
SETTINGS = {"micEnabled": ("boolean", "false")}


def chunk_json(kind: str, *values: Column) -> Column:
    """A chunk of a stream for the user interface: its tag, then its fields."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), *[v.alias(name) for name, v in zip(CHUNK_FIELDS[kind], values, strict=True)]))


def text_delta(chunk: Column) -> Column:
    """The text that a chunk adds; null for chunks of other kinds and for what isn't JSON."""
    return F.when(F.get_json_object(chunk, "$.type") == "text-delta", F.get_json_object(chunk, "$.delta"))


def _member(name: str, value: Column, bare: bool = False) -> Column:
    """``"name":value`` of a JSON object; null for a null value that is to be left out."""
    whole = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
    member = F.substring(whole, F.lit(2), F.length(whole) - 2)
    return F.when(value.isNotNull(), member) if bare else member


def _insight_json(insight: Column, names: list[str]) -> Column:
    stored = {name: F.nullif(insight[name], F.lit(False)) if name == "feedback_withdraw_pending" else insight[name] for name in names}
    members = F.array_compact(F.array(*[_member(name, value, name in OPTIONAL) for name, value in stored.items()]))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def session_json(sessions: DataFrame) -> Column:
    """The rows as stored sessions: null fields are kept, but those of insights that mean nothing when null, or false, are left out."""

    def member(field: StructField) -> Column:
        if field.name != "insights":
            return _member(field.name, sessions[field.name])
        texts = F.transform(sessions["insights"], lambda i: _insight_json(i, field.dataType.elementType.names))
        return F.concat(F.lit('"insights":'), F.coalesce(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")), F.lit("null")))

    return F.concat(F.lit("{"), F.concat_ws(",", *map(member, sessions.schema)), F.lit("}"))


def settings(document: Column) -> Column:
    """A settings document with defaults for what is missing; all defaults for one that can't be read."""
    read = F.from_json(document, ", ".join(f"{name} {kind}" for name, (kind, _) in SETTINGS.items()), {"mode": "PERMISSIVE"})
    return F.struct(*[F.coalesce(read[name], F.lit(default).cast(kind)).alias(name) for name, (kind, default) in SETTINGS.items()])


def message_id(given: Column, task: Column, session: Column, text: Column) -> Column:
    """The id that a message came with, or one made of its task and a hash of task, session and text."""
    made = F.concat(task, F.lit(":msg:"), F.left(F.sha2(F.concat_ws("\n", task, session, text), 256), F.lit(16)))
    return F.when(F.length(F.trim(given)) > 0, given).otherwise(made)


def reply_id(turn: Column) -> Column:
    """UUID of version 5 of a turn's name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE)), turn.cast("binary")))
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def revision(names_and_digests: Column) -> Column:
    """16 hex digits for an array of (name, digest), whatever its order."""
    lines = F.transform(F.array_sort(names_and_digests), lambda x: F.concat_ws(":", x["name"], x["digest"]))
    return F.left(F.sha2(F.array_join(lines, "\n"), 256), F.lit(16))
