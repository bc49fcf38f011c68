"""Packing documents into sequences: bounded-space online best fit.

Each partition keeps a fixed number of open sequences. A document's ids go, whole if they can, into
the open sequence that they fill best; when none has room the fullest is filled up with the first
ids and emitted, and the rest goes on. What is still open at a partition's end is packed again, many
partitions' leftovers together, until one partition is left.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import common

LENGTH = 4096
END_ID = 2
#: Open sequences of a partition.
OPEN = 32
#: Partitions whose leftovers are packed together.
MERGE = 32
#: A gap up to this stays as padding, rather than cut a document for it.
SMALL_GAP = 16
#: Words whose ids a worker remembers, at most.
MEMO_WORDS = 800_000
_BATCH = 512

PIECE = "doc_id long, rk binary, copy long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _byte_letters() -> dict[int, str]:
    """How byte-level models write each byte: printable Latin-1 characters as they are, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: A word that the tokenizer below takes apart in one way only: letters of Basic Latin, Latin-1 and Latin
#: Extended-A, then ASCII punctuation. These letters are composed already, each has one lower-case letter (U+0130 has
#: two characters and is left out), and all are letters to the tokenizer's pattern, as no mark is.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+)([!-/:-@\[-`{-~]*)")
#: What a tokenizer does before its model, if it treats the words of a text one by one.
_WORDWISE = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Encoder:
    """Token ids as little-endian 32-bit bytes: those that the tokenizer, as its file has it, gives the whole text.

    A tokenizer that drops white space and never joins across it gives a text the ids of its words, one
    after the other; so words seen before are looked up. Of new words those of plain letters and marks go
    to the model in two parts, and all others to the tokenizer. A text that spells a token which the
    tokenizer cuts out beforehand, in whatever case, goes to the tokenizer whole, and so do all
    texts if its file asks for other steps than these. The memory holds two generations, so that what
    is in use stays when the older one is dropped.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        own = json.loads(self.tokenizer.to_str())
        added = own["added_tokens"]
        self.wordwise = all(own[k] == v for k, v in _WORDWISE.items()) and not any(x["lstrip"] or x["rstrip"] or x["normalized"] or not x["content"].isascii() or len(x["content"].split()) != 1 for x in added)
        self.cut_out = [x["content"].lower().encode() for x in added]
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not self.wordwise:
            return self._whole(text)
        raw = text.encode()
        words = raw.split()
        try:
            known = self.known
            return b"".join([known[w] for w in words])
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in known]
        low = raw.lower()
        if any(x in low for x in self.cut_out):
            return self._whole(text)
        if len(known) + len(new) > MEMO_WORDS // 2:
            self.older, self.known = known, {}
            known, new = self.known, list(dict.fromkeys(words))
        for w in new:
            known[w] = self._word(w)
        return b"".join([known[w] for w in words])

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, w: bytes) -> bytes:
        found = self.older.get(w)
        if found is None:
            plain = _PLAIN.fullmatch(w)
            if plain is None:
                return self._whole(w.decode())
            found = self._letters(plain[1])
            if plain[2]:
                found += self._marks(plain[2])
        return found

    def _letters(self, w: bytes) -> bytes:
        low = w.lower() if w.isascii() else w.decode().lower().encode()
        found = self.known.get(low) or self.older.get(low)
        if found is None:
            shown = low.decode() if low.isascii() else low.decode("latin-1").translate(self.letters)
            ids = [x.id for x in self.model.tokenize(shown)]
            found = struct.pack(f"<{len(ids)}I", *ids)
        self.known[low] = found
        return found

    def _marks(self, w: bytes) -> bytes:
        found = self.known.get(w)
        if found is None:
            found = self.known[w] = self._whole(w.decode())
        return found


@dataclass
class Sequence:
    used: int = 0
    pieces: list = field(default_factory=list)


class Packer:
    """Bounded-space best fit; emits finished sequences as lists of pieces."""

    def __init__(self, length: int = LENGTH, open_most: int = OPEN, small_gap: int = SMALL_GAP):
        self.length, self.most, self.small = length, open_most, small_gap
        self.open: list[Sequence] = []

    def _put(self, s: Sequence, doc: tuple, start: int, ids: bytes) -> None:
        s.pieces.append((doc, start, ids, s.used))
        s.used += len(ids) // 4

    def add(self, doc: tuple, start: int, ids: bytes) -> Iterator[Sequence]:
        """Places ids, which begin at `start` of the document; yields the sequences that this closes."""
        whole = self.length * 4
        while len(ids) >= whole:
            s = Sequence()
            self._put(s, doc, start, ids[:whole])
            yield s
            start, ids = start + self.length, ids[whole:]
        n = len(ids) // 4
        if not n:
            return
        fits = [s for s in self.open if s.used + n <= self.length]
        if fits:
            best = max(fits, key=lambda s: s.used)
            self._put(best, doc, start, ids)
            if best.used == self.length:
                self.open.remove(best)
                yield best
            return
        if len(self.open) >= self.most:
            fullest = max(self.open, key=lambda s: s.used)
            self.open.remove(fullest)
            room = self.length - fullest.used
            if room > self.small:
                self._put(fullest, doc, start, ids[: room * 4])
                start, ids = start + room, ids[room * 4 :]
            yield fullest
            yield from self.add(doc, start, ids)
            return
        s = Sequence()
        self._put(s, doc, start, ids)
        self.open.append(s)


def _rows(sequences: list[tuple[int, Sequence]], left: bool) -> pa.RecordBatch:
    out: dict[str, list] = {k.split()[0]: [] for k in PIECE.split(", ")}
    for sequence_id, s in sequences:
        for (doc_id, rk, copy, tokens), start, ids, offset in s.pieces:
            values = (doc_id, rk, copy, start, len(ids) // 4, zlib.crc32(ids), tokens, -1 if left else sequence_id, offset, ids if left else None)
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 7, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def _emit(closed: Iterator[Sequence], packer: Packer, round_: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the closed sequences, then of what stays open; ids tell rounds and partitions apart."""
    base, n, ready = (round_ << 58) + (TaskContext.get().partitionId() << 32), 0, []
    for s in closed:
        ready.append((base + n, s))
        n += 1
        if len(ready) >= _BATCH:
            yield _rows(ready, False)
            ready = []
    if last:
        ready += [(base + n + k, s) for k, s in enumerate(packer.open)]
    if ready:
        yield _rows(ready, False)
    if not last and packer.open:
        yield _rows([(0, s) for s in packer.open], True)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_most: int = OPEN) -> DataFrame:
    """One row a piece: doc_id, copy, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and END_ID, so that an empty or null text is one id. The pieces of a
    document cover its ids once; those of a sequence cover 0 up to its length without a gap. copy tells
    rows of docs apart that are equal in id and text. Other columns of docs are left out. An empty table
    gives no pieces.

    Texts are read once, in place: no text is shuffled. Leftovers are at most open_most sequences a
    partition; they carry their ids, so that they can be cut to fit, and each round of merging leaves
    a MERGE-th of them.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", common.text_or_empty().alias("text"), common.row_key().alias("rk"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(tokenizer), Packer(length, open_most)
        place = TaskContext.get().partitionId() << 40
        end = END_ID.to_bytes(4, "little")

        def closed() -> Iterator[Sequence]:
            k = place
            for batch in batches:
                for doc_id, rk, text in zip(batch.column("doc_id"), batch.column("rk"), batch.column("text"), strict=True):
                    ids = encode(text.as_py()) + end
                    yield from packer.add((doc_id.as_py(), rk.as_py(), k, len(ids) // 4), 0, ids)
                    k += 1

        yield from _emit(closed(), packer, 0, False)

    def again(round_: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(length, open_most)

            def closed() -> Iterator[Sequence]:
                for batch in batches:
                    for x in batch.to_pylist():
                        yield from packer.add((x["doc_id"], x["rk"], x["copy"], x["doc_tokens"]), x["start"], x["ids"])

            yield from _emit(closed(), packer, round_, last)

        return run

    parts, round_ = rows.rdd.getNumPartitions(), 0
    done = common.written(rows.mapInArrow(first, PIECE), "pieces")
    packed = [done.where("ids IS NULL")]
    left = done.where("ids IS NOT NULL")
    last = False
    while not last:
        parts, round_ = max(1, -(-parts // MERGE)), round_ + 1
        last = parts == 1
        # a total order before packing, so that a task that runs again packs alike; long pieces first
        dealt = left.repartition(parts, F.xxhash64("rk", "copy", "start")).sortWithinPartitions(F.desc("length"), "rk", "copy", "start")
        done = common.written(dealt.mapInArrow(again(round_, last), PIECE), "pieces")
        packed.append(done.where("ids IS NULL"))
        left = done.where("ids IS NOT NULL")
    out = packed[0]
    for more in packed[1:]:
        out = out.union(more)
    return out.drop("rk", "ids").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "copy")


def production_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir).select("doc_id", "text"), production_tokenizer())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack(docs, production_tokenizer())
