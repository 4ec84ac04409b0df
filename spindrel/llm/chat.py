"""Chat formatting as prefix trees: conversations that share initial turns share those turns' tokens.

Conversations are ordered by the hashes of their turns and dealt out by range, so that neighbours share as much
as they can; a first turn that very many conversations share is spread over tasks, each of which emits it once. A task
walks its conversations depth-first and emits each turn that the one before did not have as a node: its tokens,
their loss mask, the position of its first token in the conversation, its offset in the packed tree and
the intervals of the packed tree that it attends to (its ancestors, then itself causally). A conversation is a leaf.

A turn is written `<s>[INST]role[/INST]text</s>`. Control strings inside roles and texts get a backslash after
their first character, and backslashes are doubled, so that a text can never close its turn and is restored exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import VOCABULARY, Encoder

#: Control strings of the template and of the vocabulary (fixed values).
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|endoftext|>")
LEARNED = ("assistant",)
#: Turns whose hashes order conversations; beyond, turns are still shared between neighbours.
ORDERED = 32
#: Tokens of a tree after which the next conversation starts a new one.
TREE_TOKENS = 200_000

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
_LINKED = "path binary, conv_id long, turn_no long, role string, text string, chain binary, last boolean"
_NODES = "tree long, node long, parent long, conv_id long, position long, `offset` long, ids binary, loss binary, attends array<struct<start:long,stop:long>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn -> the same with the hash chain up to each turn and the conversation's path."""
    out: list[tuple] = []
    head: list[tuple] = []
    path, chain, now, n = b"", b"", (None,), 0

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_()), strict=True)], names=["path", "conv_id", "turn_no", "role", "text", "chain", "last"])
            out.clear()

    def close() -> None:
        if head:
            out.extend((path, *x, False) for x in head[:-1])
            out.append((path, *head[-1], True))
            head.clear()

    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            role, text = role or "", text or ""
            if (conv,) != now:
                close()
                now, path, chain, n = (conv,), b"", b"", 0
            chain = hashlib.blake2b(chain + f"{len(role)} {role} {text}".encode(), digest_size=16).digest()
            if n < ORDERED:
                path += chain[:8]
            elif head:
                out.extend((path, *x, False) for x in head)
                head.clear()
            head.append((conv, n, role, text, chain))
            n += 1
            if len(out) >= 2000:
                yield from flush()
    close()
    yield from flush()


def _tree(vocabulary: str, tree_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(vocabulary)
        tree, size, nodes = TaskContext.get().partitionId() << 33, 0, 0
        stack: list[tuple[bytes, int, int, int]] = []  # chain, node, offset, length of the nodes on the current path
        depth, fresh, out = 0, True, []

        def intervals(upto: int) -> list[dict]:
            found: list[dict] = []
            for _, _, start, length in stack[:upto]:
                if found and found[-1]["stop"] == start:
                    found[-1]["stop"] = start + length
                else:
                    found.append({"start": start, "stop": start + length})
            return found

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                kinds = (*[pa.int64()] * 6, pa.binary(), pa.binary(), spans)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["tree", "node", "parent", "conv_id", "position", "offset", "ids", "loss", "attends"])
                out.clear()

        for batch in batches:
            for _, conv, n, role, text, chain, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n == 0:
                    depth = 0
                    if size >= tree_tokens:
                        tree, size, nodes, stack = tree + 1, 0, 0, []
                if depth < len(stack) and stack[depth][0] == chain:
                    depth += 1
                else:
                    del stack[depth:]
                    parts = [encode(f"<s>[INST]{escape(role)}[/INST]"), encode(escape(text)), encode("</s>")]
                    ids = np.array([i for p in parts for i in p], dtype="<u4")
                    loss = np.zeros(len(ids), np.uint8)
                    if role in LEARNED:
                        loss[len(parts[0]) : len(parts[0]) + len(parts[1])] = 1
                    position = sum(x[3] for x in stack)
                    out.append((tree, nodes, stack[-1][1] if stack else -1, None, position, size, ids.tobytes(), loss.tobytes(), intervals(depth)))
                    stack.append((chain, nodes, size, len(ids)))
                    size, nodes, depth = size + len(ids), nodes + 1, depth + 1
                if last:
                    out.append((tree, stack[depth - 1][1], None, conv, None, None, None, None, intervals(depth)))
                if len(out) >= 2000:
                    yield from flush()
        yield from flush()

    return run


def format_chats(turns: DataFrame, vocabulary: str = VOCABULARY, tree_tokens: int = TREE_TOKENS) -> DataFrame:
    """turns(conv_id, turn, role, text, ...) -> packed prefix trees, two kinds of rows.

    A node (position not null): tree, node, parent (-1: none), position of its first token in its conversations,
    offset in the packed tree, ids (little-endian unsigned 32-bit), loss (a byte, 0 or 1, for each id) and
    attends, the packed intervals of its ancestors. A conversation (position null): conv_id, tree, node (its last
    turn) and attends, the packed intervals that make it up.

    Turns are taken in order of turn, then role and text; a null turn comes first, a repeated row is one
    more turn. Null roles and texts are empty. Rows with a null conv_id are one conversation. Very long texts are one node. Other
    columns are not read. An empty table gives no rows.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    linked = rows.mapInArrow(_link, _LINKED)
    spread = linked.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id", "turn_no")
    return spread.mapInArrow(_tree(vocabulary, tree_tokens), _NODES)


def _unpack(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        import base64

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            piece = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
        tree, ids, loss, out = None, [], [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            out.clear()
            kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "formatted", "turns", "learned"])

        for batch in batches:
            for its, conv, raw, mask, attends, position in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if its != tree:
                    tree, ids, loss = its, [], []
                if position is not None:
                    ids.extend(np.frombuffer(raw, "<u4").tolist())
                    loss.extend(mask)
                    continue
                text, runs, on = [], [], 0
                for span in attends:
                    for i in range(span["start"], span["stop"]):
                        part = piece[ids[i]]
                        text.append(part)
                        if loss[i]:
                            if not on:
                                runs.append([])
                            runs[-1].append(part)
                        on = loss[i]
                whole = b"".join(text).decode()
                turns = [{"role": unescape(a), "text": unescape(b)} for a, b in _TURN.findall(whole)]
                out.append((conv, whole, turns, [unescape(b"".join(r).decode()) for r in runs]))
                if len(out) >= 500:
                    yield flush()
        yield flush()

    return run


def read_back(packed: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packed trees -> conv_id, formatted, turns array<struct<role, text>> and learned, the unescaped texts under the loss mask.

    Everything is decoded from the trees' ids along each conversation's intervals; trees are of bounded size and
    each is read in one task.
    """
    rows = packed.select("tree", "conv_id", "ids", "loss", "attends", "position", "offset")
    rows = rows.repartition("tree").sortWithinPartitions("tree", F.col("position").isNull(), "offset").drop("offset")
    return rows.mapInArrow(_unpack(vocabulary), "conv_id long, formatted string, turns array<struct<role:string,text:string>>, learned array<string>")
