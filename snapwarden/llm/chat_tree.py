"""Chat formatting with a prefix tree of conversations.

Conversations that share their initial turns share the nodes of a tree. A shard of the output holds a run of the sorted
distinct conversations and writes its nodes depth-first, each shared turn once. A node carries its formatted text, its token
ids, the position id of its first token (tokens of its ancestors before it) and the intervals of the shard's token stream
that its tokens may attend to besides their own past: its ancestors', adjacent ones merged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapwarden.llm.storage import arrow_batches, materialise
from snapwarden.llm.tokens import default_path, encoder

#: Strings that control the template; inside texts and role names they are broken up.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]")
_control = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_escape = re.compile(r"\\([-+])")


def escape(text: str) -> str:
    r"""A backslash becomes ``\-``; a control string gets ``\+`` behind its first character."""
    return _control.sub(lambda m: f"{m[0][0]}\\+{m[0][1:]}", text.replace("\\", "\\-"))


def unescape(text: str) -> str:
    return _escape.sub(lambda m: "\\" if m[1] == "-" else "", text)


def parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text of a turn, the escaped text, and what stands behind."""
    body = escape(text)
    if role == "user":
        return "[INST] ", body, " [/INST]"
    if role == "assistant":
        return "", body, "</s>"
    if role == "system":
        return "<<SYS>>", body, "<</SYS>>"
    return f"[ROLE]{escape(role)}[/ROLE]", body, "[END]"


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if piece.startswith("[INST] ") and piece.endswith(" [/INST]"):
        return "user", unescape(piece[7:-8])
    if piece.startswith("<<SYS>>") and piece.endswith("<</SYS>>"):
        return "system", unescape(piece[7:-8])
    if piece.startswith("[ROLE]") and piece.endswith("[END]"):
        role, _, body = piece[6:-5].partition("[/ROLE]")
        return unescape(role), unescape(body)
    if piece.endswith("</s>"):
        return "assistant", unescape(piece[:-4])
    raise ValueError("not a formatted turn")


_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
NODE = T.StructType(
    [T.StructField(a, b) for a, b in (("shard", T.IntegerType()), ("node", T.LongType()), ("parent", T.LongType()), ("depth", T.IntegerType()), ("piece", T.StringType()), ("loss_start", T.IntegerType()), ("loss_end", T.IntegerType()))]
    + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("first_position", T.LongType()), T.StructField("emit_start", T.LongType()), T.StructField("emit_end", T.LongType())]
    + [T.StructField("loss_tokens", T.ArrayType(T.IntegerType())), T.StructField("attends", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("path", T.StringType())]
)
_NODE_ARROW = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())), pa.string()]


def _build(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(path), TaskContext.get().partitionId()
        stack: list[dict] = []  # the nodes from the root to the last one
        count = emitted = 0

        for batch in batches:
            rows, begun = [], []  # nodes of this batch, and what to encode for them
            for key, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                same = 0
                while same < len(stack) and same < len(turns) and (stack[same]["role"], stack[same]["text"]) == (turns[same]["role"], turns[same]["text"]):
                    same += 1
                del stack[same:]
                for depth, turn in enumerate(turns[same:], same):
                    begun += parts(turn["role"], turn["text"])
                    node = {"role": turn["role"], "text": turn["text"], "node": count, "depth": depth, "up": stack[-1] if stack else None, "path": None}
                    rows.append(node)
                    stack.append(node)
                    count += 1
                if len(turns) > same:  # sorted and distinct, so a conversation always ends at a new node
                    rows[-1]["path"] = key
            if not rows:
                continue
            ids, ends = own.ids(pa.array(begun, pa.string()))  # one call for the whole batch
            ids = ids.astype("int32")
            out = []
            for k, node in enumerate(rows):
                before, body, behind = begun[3 * k : 3 * k + 3]
                a, b, c, d = (int(x) for x in ends[3 * k : 3 * k + 4])
                up, loss = node["up"], node["role"] == "assistant"
                spans = [] if up is None else [list(s) for s in up["attends"]]
                if up is not None:
                    if spans and spans[-1][1] == up["start"]:
                        spans[-1][1] = up["end"]
                    else:
                        spans.append([up["start"], up["end"]])
                node |= {"attends": spans, "start": emitted, "end": emitted + d - a, "position": 0 if up is None else up["position"] + up["end"] - up["start"]}
                out.append([shard, node["node"], None if up is None else up["node"], node["depth"], before + body + behind, len(before) if loss else None, len(before) + len(body) if loss else None, ids[a:d], node["position"], emitted, node["end"], [b - a, c - a] if loss else [], spans, node["path"]])
                emitted = node["end"]
                node["up"] = None  # a chain of parents must not outlive its batch
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_NODE_ARROW)], NODE.names)

    return run


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the nodes of each shard in order; where a conversation ends, tell about it what the output says."""
    at, stack = None, []
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["shard"] != at:
                at, stack = r["shard"], []
            del stack[r["depth"] :]
            turns, loss, n_loss, chars = stack[-1] if stack else (hashlib.sha256(), hashlib.sha256(), 0, 0)
            role, text = parse(r["piece"])
            turns, loss = turns.copy(), loss.copy()
            turns.update(f"{role}\n{text}\n".encode())
            if r["loss_start"] is not None:
                said = unescape(r["piece"][r["loss_start"] : r["loss_end"]])
                loss.update(said.encode())
                n_loss += len(said)
            stack.append((turns, loss, n_loss, chars + len(r["piece"])))
            if r["path"] is not None:
                rows.append((r["path"], len(stack), turns.hexdigest(), n_loss, loss.hexdigest(), stack[-1][3]))
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3], pa.int64()), pa.array(columns[4]), pa.array(columns[5], pa.int64())], ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def format_conversations(rows: DataFrame, *, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """rows, one per turn → (nodes, members). nodes: see the module; members: conv_id, path, where nodes.path tells its end.

    Turns go by turn number, nulls first, ties by role and text; null roles and texts are empty; a null conv_id is a
    conversation of its own. Equal conversations share one path, so that any number of copies costs one entry. A tree
    whose conversations fall into several shards has its shared turns once in each, as a shard is a sequence of its own.
    """
    spark = rows.sparkSession
    arrow_batches(spark)
    turn = F.struct(F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    conv = rows.groupBy(F.col(conv_column).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    conv = conv.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    line = F.concat_ws("", F.transform("turns", lambda x: F.substring(F.sha2(F.concat(F.length(x["role"]).cast("string"), F.lit(":"), x["role"], x["text"]), 256), 1, 32)))
    conv = materialise(conv.select("conv_id", "turns", line.alias("line")), "chat-turns")
    distinct = conv.groupBy("line").agg(F.first("turns").alias("turns"))
    ordered = distinct.repartitionByRange("line").sortWithinPartitions("line").select(F.sha2("line", 256).alias("path"), "turns")
    nodes = materialise(ordered.mapInArrow(_build(path or default_path()), NODE), "chat-nodes")
    return nodes, conv.select("conv_id", F.sha2("line", 256).alias("path"))


def read_conversations(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Per conversation, from the formatted output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    told = nodes.select("shard", "node", "depth", "piece", "loss_start", "loss_end", "path").repartition("shard").sortWithinPartitions("shard", "node")
    told = told.mapInArrow(_read_back, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.join(told, "path").drop("path")
