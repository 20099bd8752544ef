"""SentencePiece encoding and decoding over a trie of distinct marked words.

White space becomes the mark at the front of each word, and no piece runs across a mark, so words
are independent. The distinct words of a batch are sorted and traversed as a trie, depth first.
The forward state of a prefix is the last piece of its best segmentation; it depends on the prefix alone,
so words with a common prefix share the states along it and only new characters are worked
on. Following the last pieces back from a word's end gives its segmentation.

The model file holds merge priorities instead of probabilities. A maximum over sums of its scores would not
give the segmentation its vocabulary stands for, so "best" means what the merges produce: a
piece may follow another one exactly if merging the two together leaves both as they are.
"""

from __future__ import annotations

import gc
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tidemark.llm.common import pick, release_memory

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
ROWS = 250  # whose texts are Python strings at a time
CACHED_WORDS = 600_000  # per task, about 200 bytes each; the cache starts anew when it is full


class Pieces:
    """Encoder and decoder of one model file; its ids and texts equal the model's own."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in every if model.is_byte(i)}
        self.texts = [b""] * len(every)
        for piece, i in self.ids.items():
            self.texts[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            self.texts[i] = bytes([byte])
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.scores[p])
        self.rank = {p: n for n, p in enumerate(order, 1)}  # place of the merge that makes the piece; 0: a character
        self.halves = lru_cache(maxsize=None)(self._halves)  # at most one entry per piece
        self.may_follow = lru_cache(maxsize=300_000)(self._may_follow)
        self.coded = lru_cache(maxsize=100_000)(self._coded)
        self.nodes = self._backwards()
        self.cache: dict[str, bytes] = {}

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """Segmentation by merging, straight from the definition: the best pair first, the leftmost on ties."""
        parts = list(text)
        while len(parts) > down_to:
            ranked = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge; None if merging its characters does not give the piece."""
        parts = self.merged(piece, down_to=2)
        return (parts[0], parts[1]) if len(parts) == 2 and "".join(parts) in self.scores else None

    def _may_follow(self, left: str, right: str) -> bool:
        """Whether merging left + right gives [left, right].

        The merges of both sides are undone, the latest first; at each point no earlier merge may join the two
        characters groups at the border. On equal rank the left one comes first.
        """
        if any(len(p) > 1 and self.halves(p) is None for p in (left, right)):
            return False
        rank, limit = self.rank, len(self.rank) + 2
        while left:
            if rank.get(left + right, limit) < limit:
                return False
            a, b = rank.get(left, 0), rank.get(right, 0)
            if not a and not b:
                break
            if a > b:
                limit, left = a, self.halves(left)[1]
            else:
                limit, right = b + 1, self.halves(right)[0]
        return True

    def _backwards(self) -> list[dict[str, int]]:
        # A trie of the pieces from their last character on; key "" marks a whole piece.
        nodes: list[dict[str, int]] = [{}]
        for piece in self.ids:
            at = 0
            for c in reversed(piece):
                to = nodes[at].get(c)
                if to is None:
                    to = nodes[at][c] = len(nodes)
                    nodes.append({})
                at = to
            nodes[at][""] = 1
        return nodes

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """Ids (as `kind`) of distinct words, by one traversal of their trie."""
        out = {}
        path = ""
        last = [""]  # last[n]: the last piece of the best segmentation of the path's first n characters
        nodes, may_follow, coded = self.nodes, self.may_follow, self.coded
        for word in sorted(words):
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for n in range(shared + 1, len(word) + 1):
                starts, node = [], nodes[0]
                for k in range(n - 1, -1, -1):  # pieces that end here, by falling start
                    to = node.get(word[k])
                    if to is None:
                        break
                    node = nodes[to]
                    if "" in node:
                        starts.append(k)
                for start in reversed(starts):
                    piece = word[start:n]
                    if may_follow(last[start], piece):
                        break
                else:
                    piece = word[n - 1]  # a character that the vocabulary lacks
                last.append(piece)
            path = word
            found, n = [], len(word)
            while n:
                piece = last[n]
                found.append(coded(piece))
                n -= len(piece)
            found.reverse()
            out[word] = b"".join(found)
        return out

    @property
    def kind(self):
        return np.uint16 if len(self.texts) <= 65_536 else np.uint32

    def _coded(self, piece: str) -> bytes:
        """A piece's id, or the ids of the bytes of a character that the vocabulary lacks."""
        found = self.ids.get(piece)
        return np.array([found] if found is not None else [self.byte_ids[b] for b in piece.encode()], dtype=self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = {w for words in marked for w in words if w not in self.cache}
        if len(self.cache) + len(new) > CACHED_WORDS:
            self.cache = {}
            new = {w for words in marked for w in words}
        self.cache.update(self.segment(list(new)))
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, words)), dtype=self.kind) for words in marked]

    def decode(self, ids) -> str:
        joined = b"".join(map(self.texts.__getitem__, ids))
        return (joined[1:] if joined[:1] == b" " else joined).decode(errors="replace")


def _parts(texts: list[str], most: int = 1_000_000):
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    yield start, len(texts)


def encoded(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """`docs` with the column text replaced by tokens (ids; null for a null text, empty for an empty one).

    Works row by row on whole texts: repeated rows and null ids need no care. Other columns stay, but one named tokens is replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("text", "tokens")]
    kept = docs.select(*[docs[c] for c in names], docs["text"])

    def run(batches):
        pieces = Pieces(model_file)
        release_memory()  # what loading the model took, and earlier steps of this worker
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    texts = some.column(some.num_columns - 1).to_pylist()
                    for lo, hi in _parts([t or "" for t in texts]):
                        ids = pieces.encode([t or "" for t in texts[lo:hi]])
                        made = [None if t is None else i.astype(np.int32) for t, i in zip(texts[lo:hi], ids)]
                        part = some.slice(lo, hi - lo)
                        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.list_(pa.int32()))], [*names, "tokens"])
        finally:
            pieces = None
            gc.collect()  # the model and its caches refer to each other
            release_memory()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, tokens array<int>" if schema else "tokens array<int>")


def decoded(rows: DataFrame, model_file: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); null stays null."""

    def run(batches):
        pieces = Pieces(model_file)
        for batch in batches:
            found = [None if t is None else pieces.decode(t) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.string())], ["doc_id", "text"])

    return pick(rows, "doc_id", "tokens").mapInArrow(run, "doc_id bigint, text string")


def round_trips(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """Per row: doc_id, n_tokens, n_byte_tokens, ids_sha256 (32-bit little-endian ids), decoded_sha256, round_trip.

    Texts are encoded and decoded again in one pass. The mark itself inside a text reads back as a space, as the model
    has it; round_trip allows for that alone. A null text has no tokens, null digests and round_trip true.
    """

    def run(batches):
        pieces = Pieces(model_file)
        low, high = min(pieces.byte_ids.values()), max(pieces.byte_ids.values())
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids_in = batch.column("doc_id").cast(pa.int64())
            for lo, hi in _parts([t or "" for t in texts]):
                rows = []
                for text, ids in zip(texts[lo:hi], pieces.encode([t or "" for t in texts[lo:hi]])):
                    back = pieces.decode(ids.tolist())
                    digests = (hashlib.sha256(x).hexdigest() for x in (ids.astype("<i4").tobytes(), back.encode()))
                    sure = (None, None) if text is None else tuple(digests)
                    rows.append((len(ids), int(((ids >= low) & (ids <= high)).sum()), *sure, back == (text or "").replace(SPACE, " ")))
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [ids_in.slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
                )

    schema = "doc_id bigint, n_tokens bigint, n_byte_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return pick(docs, "doc_id", "text").mapInArrow(run, schema)
