r"""Chat formatting as one prefix tree.

Conversations are sorted by their turns, so that those with the same first turns are
neighbours. A node is a turn after certain turns; it is written once, however many
conversations and tasks share it, depth first. The text is cut into blocks; a block names
the nodes above its first one that stand in earlier blocks, and does not repeat them.
Position ids count along a node's own path, and a node may attend to the outer nodes
above it, to its ancestors' intervals in the block and to itself.

A turn is written `<s>[role]` line feed text `</s>`. In roles and texts, `\` `<` `[` and
`]` are written `\\` `\l` `\b` and `\e`, so that no control string can stand in them.
A code point is a token; a tokenizer may be run on each node, since no node is cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.llm.common import broadcast_if_small, cut, table

OPEN, ROLE_END, CLOSE = "<s>[", "]\n", "</s>"
#: A block that has this many code points is closed after the conversation that it is in.
BLOCK_CHARS = 1 << 18
LOSS_ROLE = "assistant"

_OUT = str.maketrans({"\\": "\\\\", "<": "\\l", "[": "\\b", "]": "\\e"})
_BACK = {"\\\\": "\\", "\\l": "<", "\\b": "[", "\\e": "]"}
_CODE = re.compile(r"\\[\\lbe]")

_PAIR = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_NODE = pa.struct([("key", pa.binary()), ("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()), ("n_outer", pa.int32()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("sees", pa.list_(_PAIR))])
_LEAF = pa.struct([("conv_id", pa.int64()), ("node", pa.int32()), ("n_outer", pa.int32())])
SCHEMA = "block_id long, text string, outer array<binary>, nodes array<struct<key:binary,start:long,end:long,position:long,parent:int,n_outer:int,loss_start:long,loss_end:long,sees:array<struct<start:long,end:long>>>>, conversations array<struct<conv_id:long,node:int,n_outer:int>>"


def escape(x: str) -> str:
    return x.translate(_OUT)


def unescape(x: str) -> str:
    return _CODE.sub(lambda m: _BACK[m[0]], x)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """(the turn in the template, where its text starts, where it ends)."""
    head, body = f"{OPEN}{escape(role)}{ROLE_END}", escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(written: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for part in written.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition(ROLE_END)
        out.append((unescape(role), unescape(text)))
    return out


def path_keys(turns: list[tuple[str, str]]) -> list[bytes]:
    """A digest for each turn with the turns before it: the keys of a conversation's nodes."""
    out, above = [], b""
    for role, text in turns:
        r = role.encode("utf-8", "surrogatepass")
        above = hashlib.md5(above + len(r).to_bytes(8, "little") + r + text.encode("utf-8", "surrogatepass")).digest()
        out.append(above)
    return out


class _Block:
    """A block while it is written. Its outer nodes are the path at its start."""

    def __init__(self, outer: list[bytes]) -> None:
        self.outer = outer
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[int] = []  # nodes of the block on the path of the last conversation
        self.depth = len(outer)  # outer nodes on it

    def add(self, conv: int | None, turns: list[tuple[str, str]], keys: list[bytes]) -> None:
        same = 0
        while same < min(len(keys), self.depth) and keys[same] == self.outer[same]:
            same += 1
        if same < self.depth:
            self.path, self.depth = [], same
        held = 0
        while held < min(len(keys) - self.depth, len(self.path)) and self.nodes[self.path[held]]["key"] == keys[self.depth + held]:
            held += 1
        del self.path[held:]
        above = sum(len(write_turn(*t)[0]) for t in turns[: self.depth]) if not self.path else 0
        for turn, key in zip(turns[self.depth + held :], keys[self.depth + held :], strict=True):
            written, a, z = write_turn(*turn)
            parent = self.path[-1] if self.path else -1
            up = self.nodes[parent] if self.path else None
            loss = turn[0] == LOSS_ROLE
            sees = [*(up["sees"] if up else [])]
            if sees and sees[-1]["end"] == self.size:  # one interval with what stands just before
                sees[-1] = {"start": sees[-1]["start"], "end": self.size + len(written)}
            else:
                sees.append({"start": self.size, "end": self.size + len(written)})
            position = up["position"] + up["end"] - up["start"] if up else above
            self.nodes.append({"key": key, "start": self.size, "end": self.size + len(written), "position": position, "parent": parent, "n_outer": self.depth, "loss_start": self.size + a if loss else -1, "loss_end": self.size + z if loss else -1, "sees": sees})
            self.path.append(len(self.nodes) - 1)
            self.parts.append(written)
            self.size += len(written)
        self.leaves.append({"conv_id": conv, "node": self.path[-1] if self.path else -1, "n_outer": self.depth})


def _turns(row: pa.Scalar) -> list[tuple[str, str]]:
    return [(x["role"], x["text"]) for x in row.as_py()]


def _last_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of the last conversation of a partition that has one."""
    last = None
    for b in batches:
        if b.num_rows:
            last = b.column("turns")[b.num_rows - 1]
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([path_keys(_turns(last))], pa.list_(pa.binary()))], names=["part", "keys"])


def _writer(before: dict[int, list[bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """before: for each partition, the keys of the last conversation of the partitions before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, number, now = _Block(before.get(part, [])), part << 33, before.get(part, [])

        def close() -> pa.RecordBatch:
            nonlocal block, number
            columns = [pa.array([number], pa.int64()), pa.array(["".join(block.parts)], pa.string()), pa.array([block.outer], pa.list_(pa.binary())), pa.array([block.nodes], pa.list_(_NODE)), pa.array([block.leaves], pa.list_(_LEAF))]
            block, number = _Block(now), number + 1
            return pa.RecordBatch.from_arrays(columns, names=["block_id", "text", "outer", "nodes", "conversations"])

        for b in batches:
            for conv, row in zip(b.column("conv_id").to_pylist(), b.column("turns"), strict=True):
                turns = _turns(row)
                now = path_keys(turns)
                block.add(conv, turns, now)
                if block.size + 64 * len(block.leaves) > BLOCK_CHARS:
                    yield close()
        if block.leaves:
            yield close()

    return run


def format_trees(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each block: block_id, text, outer, nodes, conversations.

    outer are the keys of the nodes above the block's first ones, from the root on; they
    stand in earlier blocks. nodes are in depth-first order: the key, the interval in text,
    the position id of its first code point, the parent in the block (-1 without), how
    many of outer are above it, the interval of the loss mask (-1 without), and sees, the
    intervals of the block that it attends to. conversations name each conversation's
    last node in the block (-1 if its path has none) and how many of outer are on its path.

    Defined cases: a null role or text is empty; turns of one number, and turns without
    one (which come first), go by role, then text; a repeated row is a repeated turn; a
    row with a null conv_id is a conversation of its own; equal conversations share all
    nodes; an empty table has no blocks. A turn that very many conversations share is
    written once: a task knows the last path of the tasks before it (a row a partition
    comes to the driver for that), and the range of turns and ids splits its
    conversations over the tasks. A conversation itself is one row.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    alone = rows.filter("conv_id is null").select("conv_id", F.array(F.struct("turn", "role", "text")).alias("turns"))
    keyed = known.unionByName(alone).select("conv_id", "turns", F.transform("turns", lambda x: F.xxhash64(x["role"], x["text"])).alias("path"))
    ordered = cut(keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns"))
    before, now = {}, []
    ends = {r.part: [bytes(k) for k in r["keys"]] for r in ordered.mapInArrow(_last_paths, "part int, keys array<binary>").collect()}
    for part in range(max(ends, default=-1) + 1):
        before[part], now = now, ends.get(part, now)
    return ordered.mapInArrow(_writer(before), SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "block_id", "last_position"]
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for b in batches:
        out: list[list] = [[] for _ in names]
        for number, text, nodes, convs, outer in zip(b.column("block_id").to_pylist(), b.column("text"), b.column("nodes"), b.column("conversations"), b.column("outer_texts"), strict=True):
            text, nodes, outer = text.as_py(), nodes.as_py(), outer.as_py() or []
            for x in convs.as_py():
                path = []
                at = x["node"]
                while at >= 0:
                    path.append(nodes[at])
                    at = nodes[at]["parent"]
                path.reverse()
                above = outer[: x["n_outer"]]
                written = "".join(o["text"] for o in above) + "".join(text[s["start"] : s["end"]] for s in (path[-1]["sees"] if path else []))
                turns = read_turns(written)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(o["text"][o["loss_start"] : o["loss_end"]]) for o in above if o["loss_start"] >= 0)
                loss += "".join(unescape(text[n["loss_start"] : n["loss_end"]]) for n in path if n["loss_start"] >= 0)
                end = path[-1]["position"] + path[-1]["end"] - path[-1]["start"] if path else len(written)
                for column, v in zip(out, (x["conv_id"], len(turns), sha(said), len(loss), sha(loss), len(written), number, end), strict=True):
                    column.append(v)
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)


def with_outer_texts(blocks: DataFrame) -> DataFrame:
    """blocks with outer_texts: the texts of their outer nodes and the loss intervals in them, read from the blocks that
    have them. Blocks are read twice, so they should be stored."""
    asked = blocks.select("block_id", F.posexplode("outer").alias("at", "key"))
    needed = cut(asked.select("key").distinct())
    each = blocks.select("text", F.explode("nodes").alias("n")).select(F.col("n.key").alias("key"), F.col("n.start").alias("a"), "n.end", "n.loss_start", "n.loss_end", "text")
    held = each.join(broadcast_if_small(needed), "key", "left_semi")
    shift = lambda c: F.when(F.col(c) >= 0, F.col(c) - F.col("a")).otherwise(-1).alias(c)
    texts = cut(held.select("key", F.col("text").substr((F.col("a") + 1).cast("int"), (F.col("end") - F.col("a")).cast("int")).alias("text"), shift("loss_start"), shift("loss_end")))
    found = asked.join(broadcast_if_small(texts), "key").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("at", "text", "loss_start", "loss_end"))).alias("outer_texts"))
    return blocks.join(broadcast_if_small(cut(found)), "block_id", "left")


def conversation_digest(blocks: DataFrame) -> DataFrame:
    """Each conversation as read back from its blocks: by what its last node attends to, and by the loss mask."""
    return with_outer_texts(blocks).select("block_id", "text", "nodes", "conversations", "outer_texts").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, block_id long, last_position long").drop("block_id", "last_position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversation_digest(cut(format_trees(rows.unionByName(extra))))


ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text, case when conv_id is null then row_number() over () end alone from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]', null), (-1, 1, 'assistant', '</s>[INST] ok [/INST]', null)),
x as (
  select *, length(role || text) + len(regexp_extract_all(role || text, '[\\<\[\]]')) + 10 chars from c)
select conv_id, count(*)::bigint n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) loss_sha256,
       sum(chars)::bigint formatted_chars
from x group by conv_id, alone
"""
