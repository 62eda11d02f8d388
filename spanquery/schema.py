"""Schemas of the span contract and of the tables derived from it."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_TYPES = ("LLM_CALL", "TOOL_CALL", "RETRIEVAL", "AGENT_STEP", "GATEWAY", "ERROR")
OK_STATUS = "ok"

#: One span: thirteen fields in contract order.
SPAN = T.StructType(
    [
        T.StructField("trace_id", T.StringType(), False),
        T.StructField("span_id", T.StringType(), False),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("model", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("latency_ms", T.DoubleType(), False),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("ts_epoch_ms", T.TimestampType(), False),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType(), False), False),
    ]
)

#: The span as it arrives in JSON: the time is a number of milliseconds.
SPAN_JSON = T.StructType([T.StructField(f.name, T.LongType() if f.name == "ts_epoch_ms" else f.dataType) for f in SPAN])

#: A change record of the prompt_versions table, one row a message.
CHANGE = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("source_lsn", T.LongType()),
        T.StructField("source_tx_id", T.LongType()),
        T.StructField("source_snapshot", T.StringType()),
        T.StructField("source_ts", T.TimestampType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("ingest_ts", T.TimestampType()),
        T.StructField("kafka_partition", T.IntegerType()),
        T.StructField("kafka_offset", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("template_text", T.StringType()),
        T.StructField("params_json", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("envelope_json", T.StringType()),
    ]
)


def backward_incompatibilities(old: dict, new: dict) -> list[str]:
    """Why a reader with Avro record schema ``new`` cannot read data written with ``old``.

    A field that only the reader has needs a default; a shared field may widen (int to long,
    float or double and so on), gain union branches or enum symbols, and nothing else.
    """
    widens = {"int": {"long", "float", "double"}, "long": {"float", "double"}, "float": {"double"}, "string": {"bytes"}, "bytes": {"string"}}

    def branches(kind) -> list:
        return kind if isinstance(kind, list) else [kind]

    def name(kind) -> str:
        return kind["type"] if isinstance(kind, dict) else kind

    def reads(written, read) -> bool:
        return any(
            name(written) == name(r) and _inner(written, r) or name(r) in widens.get(name(written), ()) for r in branches(read)
        )

    def _inner(written, read) -> bool:
        if not (isinstance(written, dict) and isinstance(read, dict)):
            return True
        if written["type"] == "enum":
            return set(written["symbols"]) <= set(read["symbols"]) or "default" in read
        if written["type"] == "map":
            return all(reads(w, read["values"]) for w in branches(written["values"]))
        if written["type"] == "array":
            return all(reads(w, read["items"]) for w in branches(written["items"]))
        return True

    found, before = [], {f["name"]: f for f in old["fields"]}
    for field in new["fields"]:
        prior = before.get(field["name"]) or next((before[a] for a in field.get("aliases", ()) if a in before), None)
        if prior is None:
            if "default" not in field:
                found.append(f"{field['name']}: added without a default")
        else:
            found += [f"{field['name']}: {name(w)} can't be read" for w in branches(prior["type"]) if not reads(w, field["type"])]
    return found
