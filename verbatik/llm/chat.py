"""Chat formatting of typed content parts.

A message's content is an ordered list of parts (text, image, audio or document). A visitor flattens them into one string:
text is escaped, every other part becomes a placeholder, and its reference and expanded token count are recorded in order.
Turns are marked by control strings; `\\` and `<|` in texts and line feeds in roles are escaped, so that the formatted string
can be read back to exactly the messages it was made of.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Pixels on a side of an image patch, audio tokens a second, and tokens a document page expands to.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024

#: A part: text parts use `text`; image parts width and height; audio parts seconds; document parts pages.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<position:int,turn:int,type:string,ref:string,tokens:long>"

_ESCAPED = re.compile(r"\\(.)", re.S)
_CONTROL = re.compile(r"<\|(im_start|im_end|image|audio|document)\|>")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


@dataclass
class Flattener:
    """Visits the parts of one conversation in order and keeps what they flatten to."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    turn: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown content part {part.get('type')!r}")

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"position": len(self.attachments), "turn": self.turn, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.pieces.append(PLACEHOLDER[kind])

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)


def render(messages: list[tuple[str, list[dict]]]) -> tuple[str, list[dict], list[tuple[int, int]]]:
    """(formatted, attachments, spans under the loss mask): each assistant content is one [start, end) of code points."""
    seen, pieces, spans, at = Flattener(), [], [], 0
    for turn, (role, parts) in enumerate(messages):
        seen.turn, seen.pieces = turn, []
        for part in parts:
            seen.visit(part)
        head, body = f"{START}{escape_role(role)}\n", "".join(seen.pieces)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        pieces += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(pieces), seen.attachments, spans


def parse(formatted: str) -> list[tuple[str, list[dict]]]:
    """The messages that render() made the string of; attachments come back as parts with their type only."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        role, parts, at = unescape(formatted[at + len(START) : line]), [], line + 1
        while True:
            mark = _CONTROL.search(formatted, at)
            if mark is None:
                raise ValueError("a turn has no end")
            if mark.start() > at:
                parts.append({"type": "text", "text": unescape(formatted[at : mark.start()])})
            at = mark.end()
            if mark[0] == END:
                at += 1
                break
            parts.append({"type": mark[1]})
        out.append((role, parts))
    return out


def format_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, attachments, loss_spans) of messages (conv_id, turn, role, parts array of PART).

    Turns go in ascending turn, null first; equal turns by role, then by parts. A null role is the empty one, null parts are
    none and null conv_ids are one conversation. Further columns of messages are not looked at.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))))
    gathered = messages.groupBy("conv_id").agg(ordered.alias("messages"))
    key = messages.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key}, formatted string, attachments array<{ATTACHMENT}>, loss_spans array<struct<start:long,end:long>>"

    def run(batches):
        for batch in batches:
            out = [render([(m["role"], m["parts"]) for m in x]) for x in batch.column("messages").to_pylist()]
            attachments = pa.array([a for _, a, _ in out], pa.list_(pa.struct([("position", pa.int32()), ("turn", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, _, s in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([f for f, _, _ in out], pa.string()), attachments, spans], names=["conv_id", "formatted", "attachments", "loss_spans"])

    return gathered.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold: n_turns and turns_sha256 from parsing them, loss_chars and loss_sha256 from their mask."""
    key = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = chars = 0
                for role, parts in parse(text):
                    body = "".join(p.get("text") or "" for p in parts)
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for span in spans:
                    own = unescape(_CONTROL.sub("", text[span["start"] : span["end"]]))
                    chars += len(own)
                    loss.update(own.encode())
                rows.append((n, turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def text_messages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as messages of one text part each; a null text is empty."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of conversation -1, read back from its formatted string.

    Null texts and roles are empty; turns go in ascending turn, null first, then by role and text; repeated rows stay; rows
    without a conv_id are one conversation; further columns are not read; an empty table leaves conversation -1 alone.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{END}{START}assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(text_messages(rows.unionByName(probe))))
