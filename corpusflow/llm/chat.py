r"""Chat formatting as prefix trees.

Conversations that share initial turns are merged: sorted by the hashes of their prefixes, they stand in the depth-first
order of the tree of prefixes, so each task streams its range, emits the turns that differ from the conversation before,
and closes a bundle at ``bundle_chars``.  A bundle is one training sequence: a shared turn stands in it once, with
position ids that continue its ancestors' and with the intervals of the sequence that it attends to.  Ties on the path are
split by conversation id, so a first turn, or a whole conversation, that a third of the rows share is spread over tasks and
repeated once a bundle.

Template: ``<turn>role\ntext</turn>\n``.  ``\``, ``<`` and ``#`` inside roles and texts get a ``\`` before them, so no text
can close a turn or open one; ``\n`` inside a role is written ``\n`` likewise.  Tokens are code points.

Rows: null text or role is empty; rows of one turn number are ordered by role and text; rows with a null conversation id
form one conversation; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, partitions

BUNDLE = (
    "text string, position_ids array<struct<start:bigint,end:bigint,first_position:bigint>>,"
    "nodes array<struct<start:bigint,end:bigint,parent:int,loss_start:bigint,loss_end:bigint,attends:array<struct<start:bigint,end:bigint>>>>,"
    "conversations array<struct<conv_id:bigint,leaf:int>>"
)
_NODE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("parent", pa.int32()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_SCHEMA = pa.schema(
    [
        ("text", pa.string()),
        ("position_ids", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_position", pa.int64())]))),
        ("nodes", pa.list_(_NODE)),
        ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())]))),
    ]
)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"([\\<#])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


class _Bundle:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.positions: list[dict] = []
        self.ends: list[int] = []
        self.conversations: list[dict] = []
        self.path: list[tuple[str, str, int]] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        same = 0
        while same < min(len(turns), len(self.path)) and turns[same] == self.path[same][:2]:
            same += 1
        del self.path[same:]
        for role, text in turns[same:]:
            parent = self.path[-1][2] if self.path else -1
            head = f"<turn>{escape_role(role)}\n"
            body = escape(text)
            start = self.size
            end = start + len(head) + len(body) + len("</turn>\n")
            loss = (start + len(head), end - len("</turn>\n")) if role == LOSS_ROLE else (start, start)
            # neighbouring intervals of the ancestors are joined
            attends = [dict(x) for x in self.nodes[parent]["attends"]] if parent >= 0 else []
            if attends and attends[-1]["end"] == start:
                attends[-1]["end"] = end
            else:
                attends.append({"start": start, "end": end})
            position = self.ends[parent] if parent >= 0 else 0
            self.parts += (head, body, "</turn>\n")
            self.size = end
            self.ends.append(position + end - start)
            self.positions.append({"start": start, "end": end, "first_position": position})
            self.nodes.append({"start": start, "end": end, "parent": parent, "loss_start": loss[0], "loss_end": loss[1], "attends": attends})
            self.path.append((role, text, len(self.nodes) - 1))
        self.conversations.append({"conv_id": conv_id, "leaf": self.path[-1][2] if self.path else -1})

    def row(self) -> dict:
        return {"text": "".join(self.parts), "position_ids": self.positions, "nodes": self.nodes, "conversations": self.conversations}


def format_tree(conversations: DataFrame, bundle_chars: int = 32768) -> DataFrame:
    """One row for each bundle: the sequence, its nodes in depth-first order, and the leaf of each conversation."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # each step hashes the turn together with the hash of all turns before it
    chain = F.aggregate(
        "turns",
        F.struct(F.array().cast("array<bigint>").alias("path"), F.lit(0).cast("bigint").alias("last")),
        lambda acc, t: F.struct(
            F.concat(acc["path"], F.array(F.xxhash64(acc["last"], t["role"], t["text"]))).alias("path"),
            F.xxhash64(acc["last"], t["role"], t["text"]).alias("last"),
        ),
    )["path"]
    convs = materialize(convs.withColumn("path", chain), "conversations")
    ordered = convs.repartitionByRange(partitions(convs.sparkSession), "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, out, held = _Bundle(), [], 0
        for batch in batches:
            ids, turns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for conv_id, own in zip(ids, turns, strict=True):
                bundle.add(conv_id, [(t["role"], t["text"]) for t in own])
                if bundle.size >= bundle_chars or len(bundle.conversations) >= 512:
                    out.append(bundle.row())
                    held += bundle.size
                    bundle = _Bundle()
                if held >= 1 << 21:
                    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                    out, held = [], 0
        if bundle.conversations:
            out.append(bundle.row())
        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return ordered.select("conv_id", "turns").mapInArrow(emit, BUNDLE)


def read_back(bundles: DataFrame) -> DataFrame:
    """Each conversation as its bundle holds it: its formatted text, its turns, and its text under the loss mask."""
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss_text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                for c in b["conversations"]:
                    formatted, loss, at = [], [], c["leaf"]
                    for iv in b["nodes"][at]["attends"] if at >= 0 else []:
                        formatted.append(b["text"][iv["start"] : iv["end"]])
                    while at >= 0:
                        node = b["nodes"][at]
                        loss.append(unescape(b["text"][node["loss_start"] : node["loss_end"]]))
                        at = node["parent"]
                    whole = "".join(formatted)
                    turns = []
                    for m in re.finditer(r"<turn>((?:\\.|[^\\<\n])*)\n((?:\\.|[^\\<])*)</turn>\n", whole, flags=re.S):
                        turns.append({"role": unescape_role(m[1]), "text": unescape(m[2])})
                    out.append({"conv_id": c["conv_id"], "formatted": whole, "turns": turns, "loss_text": "".join(reversed(loss))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return bundles.mapInArrow(read, "conv_id bigint, formatted string, turns array<struct<role:string,text:string>>, loss_text string")


def digest(turns: list[tuple[str, str]]) -> str:
    """Hex digest of role, newline, text, newline a turn; used by tests."""
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
