"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths; the hash of that set selects a declarative mapping to canonical turns.  Turns are written with a
template whose control strings can't occur in texts, as texts escape them reversibly; the loss mask covers the assistants' texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.llm.common import arrow, map_batches

# Control strings of common templates, none of which is left in an escaped text, and this template's own marks.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BEGIN, END = "<|im_start|>", "<|im_end|>\n"

SPECIAL = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
ESCAPED = re.compile(r"\\([012])")
SEGMENT = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)

# A mapping: where the turns lie (a list field, or fields of the record in order), and how a turn's role and text are named.
MAPPINGS: dict[str, dict] = {}


def paths(value, prefix: str = "") -> set[str]:
    """Nested field paths; the elements of a list share ``[]``."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else {prefix}
    if isinstance(value, list):
        return set().union(*(paths(v, prefix + "[]") for v in value)) if value else {prefix + "[]"}
    return {prefix}


def fingerprint(field_paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


def register(field_paths: set[str], mapping: dict) -> None:
    MAPPINGS[fingerprint(field_paths)] = mapping


# Layouts: one turn a row; prompt and answer pairs; instructions with and without input or system text; message lists under their usual names.
register({"role", "text"}, {"each": [("@role", "text")]})
register({"turn", "role", "text"}, {"each": [("@role", "text")]})
register({"role", "content"}, {"each": [("@role", "content")]})
for ask, answer in (("prompt", "response"), ("prompt", "completion"), ("question", "answer"), ("instruction", "output"), ("instruction", "response")):
    register({ask, answer}, {"each": [("user", ask), ("assistant", answer)]})
    register({"system", ask, answer}, {"each": [("system", "system"), ("user", ask), ("assistant", answer)]})
register({"instruction", "input", "output"}, {"each": [("user", "instruction", "input"), ("assistant", "output")]})
for listed in ("messages", "conversation", "conversations", "turns"):
    for role, text in (("role", "content"), ("role", "text"), ("from", "value")):
        register({f"{listed}[].{role}", f"{listed}[].{text}"}, {"list": listed, "each": [(f"@{role}", text)]})
        register({"system", f"{listed}[].{role}", f"{listed}[].{text}"}, {"first": "system", "list": listed, "each": [(f"@{role}", text)]})
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def canonical(record: dict) -> list[tuple[str, str]] | None:
    """Turns of a record, or None if no mapping fits its layout.  Nulls are empty; parts of one turn are joined by an empty line."""
    mapping = MAPPINGS.get(fingerprint(paths(record)))
    if mapping is None:
        return None
    turns = [("system", record[mapping["first"]] or "")] if "first" in mapping else []
    for item in record[mapping["list"]] if "list" in mapping else [record]:
        for role, *parts in mapping["each"]:
            name = (item[role[1:]] or "") if role[0] == "@" else role
            turns.append((ROLES.get(name, name), "\n\n".join(str(item[p]) for p in parts if item[p] or len(parts) == 1) if any(item[p] for p in parts) else ""))
    return turns


def escape(text: str) -> str:
    """No control string is left: a backslash, or a control string's first character, becomes a backslash and a digit."""
    return SPECIAL.sub(lambda m: {"\\": r"\0", "<": r"\1", "[": r"\2"}.get(m.group()[0], m.group()[0]) + m.group()[1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\<["[int(m.group(1))], text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text and the place of its own text in it."""
    head = BEGIN + escape(role).replace("\n", r"\n") + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def format_chat(records: DataFrame) -> DataFrame:
    """``conv_id, turn, role, segment, loss_start, loss_end`` per canonical turn from ``records(conv_id, turn, record)``, ``record`` being JSON.

    A conversation's formatted text is its segments in the order of turn, role and segment.  The loss mask of a segment is empty unless an assistant
    speaks.  A record that is no JSON object or fits no mapping is a turn of the role ``unknown`` that holds the record as it is, so nothing is lost.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, turn, record in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    value = json.loads(record or "null")
                except ValueError:
                    value = None
                turns = canonical(value) if isinstance(value, dict) else None
                for role, text in [("unknown", record or "")] if turns is None else turns:
                    formatted, lo, hi = segment(role, text)
                    out.append((conv_id, turn, role, formatted, lo if role == "assistant" else 0, hi if role == "assistant" else 0))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            names = ("conv_id", "turn", "role", "segment", "loss_start", "loss_end")
            yield arrow({n: (list(c), t) for n, c, t in zip(names, columns, types, strict=True)})

    schema = "conv_id long, turn long, role string, segment string, loss_start long, loss_end long"
    return map_batches(records.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "record"), task, schema)


def read_chat(formatted: DataFrame) -> DataFrame:
    """Reads conversations back from their segments: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    A conversation is streamed in order and only its digests are held, so one with a third of all turns needs no more memory than any other.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0}

        def row(conv_id, s) -> tuple:
            return conv_id, s["n"], s["turns"].hexdigest(), s["loss"], s["masked"].hexdigest(), s["chars"]

        state = fresh()
        for batch in batches:
            out = []
            for conv_id, text, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if begun and conv_id != now:
                    out.append(row(now, state))
                    state = fresh()
                now, begun = conv_id, True
                state["chars"] += len(text)
                for m in SEGMENT.finditer(text):
                    role, body = unescape(m.group(1).replace(r"\n", "\n")), unescape(m.group(2))
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{body}\n".encode())
                masked = unescape(text[lo:hi])
                state["loss"] += len(masked)
                state["masked"].update(masked.encode())
            yield table(out)
        if begun:
            yield table([row(now, state)])

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        return arrow({n: (list(c), t) for n, c, t in zip(names, columns, types, strict=True)})

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_batches(ordered.select("conv_id", "segment", "loss_start", "loss_end"), task, schema)


def turn_records(conversations: DataFrame) -> DataFrame:
    """``records`` of a table with a row per turn; null texts and roles become empty."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return conversations.select("conv_id", "turn", F.to_json(F.struct("turn", blank("role"), blank("text")), {"ignoreNullFields": "false"}).alias("record"))
