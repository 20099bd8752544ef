"""Packing of documents into sequences by first-fit decreasing, in randomised groups.

A document's ids are cut into pieces of at most one sequence. Pieces are dealt to groups by a hash of their row, so groups are
of one size whatever ids, sources or lengths are frequent. Each group is packed on its own: its pieces by falling length, each into the
first sequence with room, which a tournament tree over the room that sequences have left finds in a logarithmic number of steps.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch, pick, written

SEQUENCE = 2048
END = 1  # id after each document
GROUP_PIECES = 16_384
CACHED_WORDS = 600_000  # per task, about 200 bytes each; the cache starts anew when it is full
SEGMENT = 1_000_000  # characters whose parts are held at a time
# After a blank, these characters are never white space for any table of characters.
SAFE = frozenset(map(chr, (*range(0x21, 0x7F), *range(0xC0, 0x530))))
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
MODEL = "byte_bpe_50k.json"
# How byte-level vocabularies spell the 256 bytes: visible ones as they are, the others by the code points from 256 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPELT = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts; equal to the tokenizer's own, with what it gives for a word kept.

    The tokenizer cuts a text before every blank that a visible character follows and works on the parts alone,
    so a text's ids are those of its parts in order.
    """

    def __init__(self, model_file: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(model_file)
        self.model.encode_special_tokens = True  # names of special tokens in a text are text
        self.bpe = self.model.model
        self.known: dict[str, bytes] = {}  # a part without its blank
        self.first: dict[str, bytes] = {}  # a part at the start of a text, which has none
        self.cached = cached
        self.ends = {c: self._ids([c])[0].tobytes() for c in ",.;:!?"}  # one of these after letters is a unit of its own
        blank = self._ids([" "])[0][0]
        self.mark = self.model.id_to_token(blank)[0]  # how the vocabulary writes a blank
        self.opens = np.zeros(self.model.get_vocab_size(), bool)
        for token, i in self.model.get_vocab().items():
            self.opens[i] = token.startswith(self.mark)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of a blank and letters alone, one unit of the tokenizer, straight from its model."""
        found = self.known.get(word)
        if found is None:
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(SPELT)
            found = self.known[word] = b"".join([t.id.to_bytes(4, "little") for t in self.bpe.tokenize(self.mark + spelt)])
        return found

    def _learn(self, parts: list[str]) -> None:
        rest = []
        for part in parts:
            if LETTERS.fullmatch(part):
                self._word(part)
            elif part[-1:] in self.ends and LETTERS.fullmatch(part, 0, len(part) - 1):
                self.known[part] = self._word(part[:-1]) + self.ends[part[-1]]
            else:
                rest.append(part)
        # Parts without further blanks are learnt side by side: each begins where an id with a blank does.
        plain = [p for p in rest if " " not in p]
        rest = [p for p in rest if " " in p]
        for at in range(0, len(plain), 1_000):
            some = plain[at : at + 1_000]
            ids = self._ids([" " + " ".join(some)])[0]
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(some):
                rest += some
                continue
            whole, ends = ids.tobytes(), (4 * np.append(starts[1:], len(ids))).tolist()
            self.known.update((p, whole[i:j]) for p, i, j in zip(some, (4 * starts).tolist(), ends))
        self.known.update(zip(rest, (i.tobytes() for i in self._ids([" " + p for p in rest]))))

    def parts(self, text: str) -> list[str]:
        """The first part, and the others without their blank."""
        words = text.split(" ")
        if all(w and w[0] in SAFE for w in set(words[1:]).difference(self.known)):
            return words
        out = words[:1]
        for word in words[1:]:
            if word and word[0] in SAFE:
                out.append(word)
            else:
                out[-1] += " " + word
        return out

    def segments(self, text: str) -> Iterator[str]:
        """The text in stretches of about SEGMENT characters, cut where the tokenizer cuts."""
        at = 0
        while len(text) - at > SEGMENT:
            cut = text.find(" ", at + SEGMENT)
            while cut >= 0 and not (cut + 1 < len(text) and text[cut + 1] in SAFE):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.parts(t) for t in texts]
        new = set()
        for parts in cut:
            new.update(parts[1:])
        fresh = new.difference(self.known)
        if len(self.known) + len(fresh) > self.cached:
            self.known, fresh = {}, new
        self._learn(list(fresh))
        starts = {parts[0] for parts in cut}.difference(self.first)
        if len(self.first) + len(starts) > self.cached // 10:
            self.first, starts = {}, {parts[0] for parts in cut}
        self.first.update(zip(starts, (i.tobytes() for i in self._ids(list(starts)))))
        known = self.known.__getitem__
        return [self.first[parts[0]] + b"".join(map(known, parts[1:])) for parts in cut]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers; holds the parts of about SEGMENT characters at a time."""
        held: list[str] = []
        size = 0
        for text in texts:
            if size + len(text) > SEGMENT:
                yield from self._encode(held)
                held, size = [], 0
            if len(text) > SEGMENT:
                yield b"".join(self._encode([s])[0] for s in self.segments(text))
                continue
            held.append(text)
            size += len(text)
        yield from self._encode(held)


_encoders: dict[str, Encoder] = {}


def _pieces(model_file: str, length: int, with_ids: bool):
    def run(batch):
        encoder = _encoders.get(model_file) or _encoders.setdefault(model_file, Encoder(model_file))
        rows, size = [], 0
        texts = (t.as_py() or "" for t in batch.column("text"))
        end = np.array([END], "<u4").tobytes()
        for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
            ids += end
            total = len(ids) // 4
            for start in range(0, total, length):
                part = ids[4 * start : 4 * (start + length)]
                rows.append((doc, start, len(part) // 4, zlib.crc32(part), total, part))
            size += total
            if size >= SEGMENT:
                yield _batch(rows, with_ids)
                rows, size = [], 0
        if rows:
            yield _batch(rows, with_ids)

    return run


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    *plain, ids = zip(*rows)
    cols = [pa.array(c, pa.int64()) for c in plain]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    if with_ids:
        offsets = np.cumsum([0, *map(len, ids)]) // 4
        cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names)


def first_fit(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each of the lengths, which must not grow, by first fit.

    Leaves of the tree are bins in order, a node holds the largest room below it; going left wherever the room
    there is enough ends at the first bin that fits.
    """
    width = 1
    while width < len(lengths):
        width *= 2
    tree = [room] * (2 * width)
    bins, offsets = [], []
    for length in lengths:
        at = 1
        while at < width:
            at *= 2
            if tree[at] < length:
                at += 1
        bins.append(at - width)
        offsets.append(room - tree[at])
        tree[at] -= length
        at //= 2
        while at:
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
    return bins, offsets


def _group(room: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), -lengths))
        bins, offsets = first_fit(lengths[order].tolist(), room)
        group = table.column("group")[0].as_py()
        ids, places = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        ids[order] = np.array(bins, np.int64) * groups + group
        places[order] = offsets
        return table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(places))

    return run


def placed(pieces: DataFrame, length: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`pieces` (a written table with piece and length, and columns of its own) with sequence_id and offset."""
    groups = -(-pieces.count() // group_pieces) or 1
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    shape = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in dealt.schema)}, sequence_id bigint, offset bigint"
    return dealt.groupBy("group").applyInArrow(_group(length, groups), shape).drop("group")


def packed(docs: DataFrame, model_file: str | None = None, length: int = SEQUENCE, group_pieces: int = GROUP_PIECES, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless left out, ids.

    Each row of `docs` is a document; its ids are the tokenizer's for the text, null counting as empty, and an end id. Every id is in exactly one piece of
    at most `length`; the pieces of a sequence lie gapless from offset 0 and sum up to at most `length`. Repeated rows
    and ids, and null ids, stay documents of their own. No rows give none. Other columns are ignored.
    """
    path = model_file or tokenizer_path()
    shape = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if ids else "")
    pieces = per_batch(pick(docs, "doc_id", "text"), _pieces(path, length, ids), shape)
    pieces = written(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    found = placed(pieces.drop("ids"), length, group_pieces)
    return (found.join(pieces.select("piece", "ids"), "piece") if ids else found).drop("piece")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids): the ids of each sequence in order, and the document of each of its pieces."""
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return whole.select("sequence_id", F.size(ids).cast("bigint").alias("length"), ids.alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
