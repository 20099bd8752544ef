"""Chat formatting as a prefix tree: shared initial turns are emitted once, depth first.

Conversations are ordered by the chain of their turns' hashes, so those that share initial turns are
neighbours. A task streams over its conversations in that order with one stack of open turns: a
turn that the previous conversation has at the same place is shared, every other one is emitted as a node
with its tokens, the position of its first token (its ancestors' tokens come before it) and the
intervals of its ancestors in the pack, which are what its tokens may attend to besides themselves.

Template: <|im_start|>role\\ntext<|im_end|>\\n. Inside roles and texts every "<|" gets a backslash
("<\\|"), and one that already has backslashes gets one more, so reading back is exact.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stage import global_places
from tidemark.llm.common import pick, shuffle_width, written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BLOCK = 256  # conversations streamed together; trees do not cross blocks
PACK_TOKENS = 65_536  # a pack is closed at the end of the conversation that reaches this
FLUSH_ROWS, FLUSH_TOKENS = 2_000, 500_000

PACKS = (
    "block bigint, seq bigint, pack bigint, conv_id bigint, is_end boolean, node bigint, depth bigint, start bigint, position bigint, "
    "loss_start bigint, loss_end bigint, tokens array<int>, attends array<struct<start: bigint, end: bigint>>"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class Coder:
    """Tokens of a turn and back; the two marks have ids after the vocabulary's."""

    def __init__(self, ranks_file: str):
        with open(ranks_file, "rb") as src:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, src)}
        self.coding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.open, self.close = max(ranks.values()) + 1, max(ranks.values()) + 2

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Tokens, and where the text's tokens start and end among them."""
        code = self.coding.encode_ordinary
        head = [self.open, *code(escape_role(role) + "\n")]
        body = code(escape(text))
        return [*head, *body, self.close, *code("\n")], len(head), len(head) + len(body)

    def text_of(self, tokens: list[int]) -> str:
        return self.coding.decode_bytes(tokens).decode()

    def read_turn(self, tokens: list[int]) -> tuple[str, str, int]:
        """Role, text and formatted characters of one turn's tokens."""
        inside = self.text_of(tokens[1 : tokens.index(self.close)])
        after = self.text_of(tokens[tokens.index(self.close) + 1 :])
        role, _, text = inside.partition("\n")
        return unescape_role(role), unescape(text), len(OPEN) + len(inside) + len(CLOSE) + len(after)


def chained(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, node, role, text): turns in order, with a hash of the conversation up to and including each.

    Order: turn, then role, then text, nulls first; null roles and texts are empty from here on. A null
    conv_id is one conversation. A conversation is read as a stream, never held as a whole.
    """
    turns = pick(conversations, "conv_id", "turn", "role", "text")
    keys = ["conv_id", "turn", "role", "text"]
    dealt = turns.repartition(shuffle_width(turns), "conv_id").sortWithinPartitions(*keys)

    def run(batches):
        conv, idx, node = object(), 0, b""
        for batch in batches:
            nodes, places = [], []
            roles, texts = ([v or "" for v in batch.column(c).to_pylist()] for c in ("role", "text"))
            for c, role, text in zip(batch.column("conv_id").to_pylist(), roles, texts):
                if c != conv:
                    conv, idx, node = c, 0, b""
                said = role.encode()
                node = hashlib.blake2b(node + len(said).to_bytes(8, "little") + said + text.encode(), digest_size=16).digest()
                nodes.append(node)
                places.append(idx)
                idx += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").cast(pa.int64()), pa.array(places, pa.int64()), pa.array(nodes, pa.binary()), pa.array(roles, pa.string()), pa.array(texts, pa.string())],
                ["conv_id", "idx", "node", "role", "text"],
            )

    return dealt.mapInArrow(run, "conv_id bigint, idx bigint, node binary, role string, text string")


def packed(conversations: DataFrame, ranks_file: str = RANKS) -> DataFrame:
    """The packs (see PACKS): per block, ordered by seq, nodes in depth-first order and an end row per conversation.

    A node's tokens fill [start, start + length) of its pack and have the position ids position,
    position + 1, ...; attends holds its ancestors' intervals. Assistant nodes carry the interval of their text
    in loss_start and loss_end. An end row names the node that the conversation ends with. Equal conversations share all nodes.
    """
    turns = written(chained(conversations), "chat-turns")
    paths = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("path"))
    paths = paths.select("conv_id", F.col("path")["node"].alias("path"))  # 16 bytes a turn, no text
    places = global_places(paths, ["path", "conv_id"], "chat-order").select(F.col("conv_id").alias("_conv"), "place")
    placed = turns.join(places, turns["conv_id"].eqNullSafe(F.col("_conv"))).drop("_conv")
    placed = placed.withColumn("block", F.floor(F.col("place") / BLOCK))
    ordered = placed.repartition(shuffle_width(placed), "block").sortWithinPartitions("block", "place", "idx")

    def run(batches):
        coder = Coder(ranks_file)
        rows, held = [], 0
        block, place, stack = None, None, []  # stack: (hash, node, start, end, tokens up to here, interval list)
        pack = seq = number = used = 0
        conv, shared, last = None, True, 0

        def end_row():
            return (block, seq, pack, conv, True, stack[last][1], last, *[None] * 6)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PACK_TYPES)], PACK_NAMES)

        for part in batches:
            for now_block, now_place, c, idx, node, role, text in zip(
                *(part.column(n).to_pylist() for n in ("block", "place", "conv_id", "idx", "node", "role", "text"))
            ):
                if now_place != place:  # the next conversation
                    if place is not None:
                        rows.append(end_row())
                        seq += 1
                    if now_block != block:
                        block, pack, seq, number, used, stack = now_block, 0, 0, 0, 0, []
                    elif used >= PACK_TOKENS:
                        pack, number, used, stack = pack + 1, 0, 0, []
                    place, conv, shared = now_place, c, True
                last = idx
                if shared and idx < len(stack) and stack[idx][0] == node:
                    continue
                shared = False
                del stack[idx:]
                tokens, lo, hi = coder.turn(role, text)
                above = stack[-1] if stack else None
                attends = list(above[5]) if above else []
                if above:
                    if attends and attends[-1][1] == above[2]:
                        attends[-1] = (attends[-1][0], above[3])
                    else:
                        attends.append((above[2], above[3]))
                start, position = used, above[4] if above else 0
                used += len(tokens)
                stack.append((node, number, start, used, position + len(tokens), attends))
                mask = (start + lo, start + hi) if role == "assistant" else (None, None)
                rows.append((block, seq, pack, None, False, number, idx, start, position, *mask, tokens, [{"start": a, "end": b} for a, b in attends]))
                number, seq, held = number + 1, seq + 1, held + len(tokens)
                if len(rows) >= FLUSH_ROWS or held >= FLUSH_TOKENS:
                    yield batch()
                    rows, held = [], 0
        if place is not None:
            rows.append(end_row())
        if rows:
            yield batch()

    return ordered.mapInArrow(run, PACKS)


PACK_NAMES = ["block", "seq", "pack", "conv_id", "is_end", "node", "depth", "start", "position", "loss_start", "loss_end", "tokens", "attends"]
PACK_TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
    pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
]


def read_back(packs: DataFrame, ranks_file: str = RANKS) -> DataFrame:
    """Per conversation, from the packs alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Digests are carried along the open nodes, so shared turns are read once.
    """
    ordered = packs.repartition(shuffle_width(packs), "block").sortWithinPartitions("block", "seq")

    def run(batches):
        coder = Coder(ranks_file)
        stack = []  # per open depth: digests of the turns and of the loss text, loss characters, formatted characters
        for part in batches:
            out = []
            names = ("conv_id", "is_end", "depth", "start", "loss_start", "loss_end", "tokens")
            for conv, is_end, depth, start, lo, hi, tokens in zip(*(part.column(n).to_pylist() for n in names)):
                if is_end:
                    turns, loss, chars, total = stack[depth]
                    out.append((conv, depth + 1, turns.hexdigest(), chars, loss.hexdigest(), total))
                    continue
                del stack[depth:]
                turns, loss, chars, total = stack[-1] if stack else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                role, text, length = coder.read_turn(tokens)
                turns, loss = turns.copy(), loss.copy()
                turns.update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    masked = unescape(coder.text_of(tokens[lo - start : hi - start]))
                    loss.update(masked.encode())
                    chars += len(masked)
                stack.append((turns, loss, chars, total + length))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], READ)

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.mapInArrow(run, schema)


READ = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def formatted(conversations: DataFrame, ranks_file: str = RANKS) -> DataFrame:
    """Formats all conversations, writes the packs and reads each conversation back from them."""
    return read_back(written(packed(conversations, ranks_file), "chat-packs"), ranks_file)
