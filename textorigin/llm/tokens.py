"""Token ids in files of independent zstandard frames with a trailing seek table, written and read on the executors.

A file holds, one after the other: one zstandard frame per document (its ids as little-endian unsigned 32-bit integers), a
skippable frame with the document ids, and a skippable frame with the seek table of the public zstandard seekable format:
per frame its compressed size, its decompressed size and a checksum (here crc32 of the ids' bytes), then the number of
frames, a flag byte and the magic number. A reader fetches the last bytes, the table, and then only the frames it wants.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, shared_dir
from . import held, words as W

END_ID = 0
LEVEL = 3
#: text bytes that one file takes, roughly
FILE_BYTES = 64 << 20
#: pieces of text whose ids a worker remembers (about 80 MB in all), and bytes of text that it handles at once
KEPT_PIECES, PIECE_BYTES = 1_000_000, 1 << 20
#: places for looking up remembered pieces without sorting
SLOTS = 1 << 22
#: Fixed values of the zstandard seekable format: magic numbers of the frames and of the footer
SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_FOOTER, _ENTRY, _ID, _HEAD = struct.Struct("<IBI"), np.dtype("<u4, <u4, <u4"), np.dtype([("has", "u1"), ("id", "<i8")]), struct.Struct("<II")

MANIFEST = "file string, part int, documents long, ids long"
ROWS = "doc_id long, at long, n_tokens long, ids_crc32 long, part int"


#: kinds of characters that a byte-level splitting step always tells apart; no apostrophe, for it may start a piece
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u023f", r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
_RUN = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+")
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]], _KIND[48:58] = 1, 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = 3
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True


def _white(raw: np.ndarray) -> np.ndarray:
    """True for every byte that belongs to a character which any of the libraries may take for white space."""
    white = _SPACE[raw]
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(raw[:-2] == lead) if len(raw) > 2 else np.zeros(0, np.int64)
        if lead == 0xC2 and len(raw) > 1 and raw[-2] == lead:
            at = np.append(at, len(raw) - 2)
        second, third = raw[at + 1], raw[np.minimum(at + 2, len(raw) - 1)]
        found = {
            0xC2: (second == 0x85) | (second == 0xA0),
            0xE1: (second == 0x9A) & (third == 0x80),
            0xE2: ((second == 0x80) & ((third <= 0x8B) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))) | ((second == 0x81) & (third == 0x9F)),
            0xE3: (second == 0x80) & (third == 0x80),
        }[lead]
        for step in range(2 if lead == 0xC2 else 3):
            white[at[found] + step] = True
    return white


def _alphabet() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + others.index(b)) for b in range(256)}


_ALPHABET = _alphabet()


class Encoder:
    """Ids of whole texts, the same as encoding each text at once.

    The first splitting step of a byte-level vocabulary joins at most one blank to what follows, and nothing to what
    precedes; and it tells letters, digits and punctuation apart. So a text may be cut before each blank, and on both sides of each
    line end, that stands between two characters that are no white space, and between two plain characters of different kinds.
    The pieces of a slice are told apart by 64-bit hashes, only new ones go to the tokenizer, and the ids of the first
    KEPT_PIECES are remembered. Texts for other vocabularies are not cut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        own = json.loads(self.model.to_str())
        before, added = own.get("pre_tokenizer") or {}, own.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not own.get("normalizer")
        self.cuts = self.cuts and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        # ids of all pieces one after the other, begin and length of each piece, and two places in a table for each hash
        self.ids, self.filled = np.zeros(1 << 20, np.uint32), 0
        self.places, self.count = np.zeros((1 << 16, 2), np.int32), 0
        self.slot_key, self.slot_place = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)

    def _add(self, got: list[list[int]]) -> np.ndarray:
        """Append the ids of pieces; returns the pieces' numbers."""
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        at, n = self.count, int(sizes.sum())
        while at + len(got) > len(self.places):
            self.places = np.concatenate([self.places, np.zeros_like(self.places)])
        while self.filled + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : self.filled + n] = np.fromiter(itertools.chain.from_iterable(got), np.uint32, n)
        self.places[at : at + len(got), 0], self.places[at : at + len(got), 1] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.filled += n
        self.count += len(got)
        return np.arange(at, at + len(got), dtype=np.int32)

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Runs of letters, digits or punctuation go straight to the vocabulary's merges, in the alphabet of its bytes; other
        pieces through all steps of the tokenizer. Returns the pieces' numbers."""
        special = [t for t in self.special if any(t in p for p in pieces)]
        good = np.array([self.cuts and bool(_RUN.fullmatch(p)) and not any(t in p for t in special) for p in pieces], bool)
        out = np.empty(len(pieces), np.int32)
        if good.any():
            spelled = "\n".join(itertools.compress(pieces, good)).encode().decode("latin-1").translate(_ALPHABET).split(_ALPHABET[10])
            tokenize = self.model.model.tokenize
            out[good] = self._add([[t.id for t in tokenize(w)] for w in spelled])
        others = np.flatnonzero(~good)
        for i in range(0, len(others), 1_000):
            part = others[i : i + 1_000]
            got = self.model.encode_batch_fast([pieces[k] for k in part], add_special_tokens=False)
            out[part] = self._add([e.ids for e in got])
        return out

    def _kinds(self, raw: np.ndarray) -> np.ndarray:
        """Per byte: 1 letter, 2 digit, 3 punctuation, 0 anything else; a letter is one of ASCII or of U+00C0 to U+023F."""
        kind = _KIND[raw]
        at = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC8))
        at = at[at + 1 < len(raw)]
        at = at[~((raw[at] == 0xC3) & ((raw[at + 1] == 0x97) | (raw[at + 1] == 0xB7)))]
        kind[at] = kind[at + 1] = 1
        return kind

    def _cuts(self, raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Begins of the pieces, ascending; every text that is not empty begins one."""
        cut = np.zeros(len(raw) + 1, bool)
        if self.cuts and len(raw) > 2:
            white = _white(raw)
            alone = np.zeros(len(raw), bool)
            alone[1:-1] = ((raw[1:-1] == 32) | (raw[1:-1] == 10)) & ~white[:-2] & ~white[2:]
            ends = borders[1:][borders[1:] > borders[:-1]]
            alone[ends - 1] = alone[ends[:-1]] = False
            cut[:-1] = alone
            cut[1:][alone & (raw == 10)] = True
            data = raw.tobytes()
            if not any(t.encode() in data for t in self.special):
                kind = self._kinds(raw)
                cut[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        cut[borders[:-1][borders[1:] > borders[:-1]]] = True
        return np.flatnonzero(cut[:-1])

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text, and END_ID, as bytes; null is an empty text."""
        raw, borders = W.texts(column)
        for low, high in W.slices(borders, PIECE_BYTES):
            yield from self._slice(raw[borders[low] : borders[high]], borders[low : high + 1] - borders[low])

    @staticmethod
    def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (keys & np.uint64(SLOTS - 1)).astype(np.int32), ((keys >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int32)

    def _slice(self, raw: np.ndarray, borders: np.ndarray) -> Iterator[bytes]:
        begin = self._cuts(raw, borders)
        end = np.append(begin[1:], len(raw)) if len(begin) else begin
        keys = W.hashes(raw, begin, end, W.SAME)
        place = np.full(len(keys), -1, np.int32)
        for slot in self._slots(keys):
            same = self.slot_key[slot] == keys
            place[same] = self.slot_place[slot[same]]
        # what the table does not hold, by distinct pieces
        open_ = np.flatnonzero(place < 0)
        distinct, first, which = np.unique(keys[open_], return_index=True, return_inverse=True)
        count, filled = self.count, self.filled
        if len(distinct):
            at, data = open_[first], raw.tobytes()
            numbers = self._learn([data[a:b].decode() for a, b in zip(begin[at].tolist(), end[at].tolist())])
            place[open_] = numbers[which]
            if count < KEPT_PIECES:
                left = np.arange(len(distinct))
                for slot in self._slots(distinct):
                    free = left[self.slot_key[slot[left]] == 0]
                    # of pieces that want the same place one gets it: the last, for keys and numbers alike
                    self.slot_key[slot[free]], self.slot_place[slot[free]] = distinct[free], numbers[free]
                    left = left[self.slot_key[slot[left]] != distinct[left]]
        starts, sizes = self.places[place, 0], self.places[place, 1]
        stops = np.cumsum(sizes)
        steps = np.repeat((starts - (stops - sizes)).astype(np.int32), sizes)
        steps += np.arange(len(steps), dtype=np.int32)
        out = self.ids[steps].astype("<u4", copy=False)
        per_text = np.concatenate([[0], stops])[np.searchsorted(begin, borders)]
        tail = np.array([END_ID], "<u4").tobytes()
        data = out.tobytes()
        if count >= KEPT_PIECES:  # nothing of this slice is kept
            self.count, self.filled = count, filled
        for a, b in zip(per_text[:-1].tolist(), per_text[1:].tolist()):
            yield data[4 * a : 4 * b] + tail


def _open(path: str):
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def write_file(path: str, documents: Iterable[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write frames as they come, then the tables. Returns the number of documents and of ids."""
    fs, at = _open(path)
    press = zstandard.ZstdCompressor(level=LEVEL)
    sizes, ids = [], []
    with fs.open_output_stream(at, compression=None) as out:
        for doc, raw in documents:
            frame = press.compress(raw)
            out.write(frame)
            sizes.append((len(frame), len(raw), zlib.crc32(raw)))
            ids.append((doc is not None, doc or 0))
        own = np.array(ids, _ID).tobytes()
        table = np.array(sizes, _ENTRY).tobytes() + _FOOTER.pack(len(sizes), 0x80, SEEKABLE)
        out.write(_HEAD.pack(SKIPPABLE_IDS, len(own)) + own + _HEAD.pack(SKIPPABLE_TABLE, len(table)) + table)
    return len(sizes), sum(n for _, n, _ in sizes) // 4


def read_table(file) -> tuple[np.ndarray, np.ndarray]:
    """Seek table and document ids, from the end of an open file."""
    size = file.size()
    n, flags, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
    if magic != SEEKABLE or flags != 0x80:
        raise ValueError("no seek table with checksums at the end of the file")
    length = n * _ENTRY.itemsize
    start = size - _FOOTER.size - length
    table = np.frombuffer(file.read_at(length, start), _ENTRY)
    head = start - 2 * _HEAD.size - n * _ID.itemsize
    kind, own = _HEAD.unpack(file.read_at(_HEAD.size, head))
    if kind != SKIPPABLE_IDS or own != n * _ID.itemsize:
        raise ValueError("the document ids do not match the seek table")
    return table, np.frombuffer(file.read_at(own, head + _HEAD.size), _ID)


def read_frames(path: str, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, int | None, bytes]]:
    """(number in the file, document id, bytes of the ids) of the wanted frames, or of all. Only their bytes are read."""
    fs, at = _open(path)
    with fs.open_input_file(at) as file:
        table, ids = read_table(file)
        starts = np.concatenate([[0], np.cumsum(table["f0"], dtype=np.int64)])
        unpack = zstandard.ZstdDecompressor()
        for i in range(len(table)) if wanted is None else wanted:
            raw = unpack.decompress(file.read_at(int(table["f0"][i]), int(starts[i])), max_output_size=max(1, int(table["f1"][i])))
            if len(raw) != table["f1"][i] or zlib.crc32(raw) != table["f2"][i]:
                raise ValueError(f"frame {i} of {path} is damaged")
            yield i, int(ids["id"][i]) if ids["has"][i] else None, raw


def read_documents(path: str, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """Ids of the given documents of one file; other documents are not decompressed."""
    fs, at = _open(path)
    with fs.open_input_file(at) as file:
        _, ids = read_table(file)
    wanted = np.flatnonzero(np.isin(ids["id"], list(doc_ids)) & (ids["has"] == 1))
    return {doc: np.frombuffer(raw, "<u4") for _, doc, raw in read_frames(path, wanted)}


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, files: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append id 0, and write ``files`` files below ``folder`` in ascending order of ``doc_id``.

    Returns the manifest: file, part (order of the files), documents, ids and ``start`` (ids in all earlier files). A null text is
    empty and gives just the end id; a null id comes first; documents with equal ids follow each other by their text;
    repeated rows are written each; an empty table gives no rows. Other columns are not written.

    Rows are dealt by ranges of (doc_id, hash of the text), so one id with very many rows is spread as well. A task writes under a
    name of its own and the manifest names the files of the tasks that ended well, so tasks may be run again.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    base = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        encoders = held.only("tokens")
        if tokenizer not in encoders:
            encoders[tokenizer] = Encoder(tokenizer)
        encoder = encoders[tokenizer]

        def documents():
            batch = first
            while batch is not None:
                yield from zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)))
                batch = next(batches, None)

        part = TaskContext.get().partitionId()
        path = f"{base}/tokens-{part:06d}-{uuid.uuid4().hex}.zst"
        fs, at = _open(base)
        fs.create_dir(at, recursive=True)
        n, ids = write_file(path, documents())
        yield pa.record_batch([pa.array([x]) for x in (path, part, n, ids)], ["file", "part", "documents", "ids"]).cast(
            pa.schema([("file", pa.string()), ("part", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())])
        )

    manifest = cut_lineage(dealt.mapInArrow(write, MANIFEST))
    # one row per file: a table as small as the list of files
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


def read_tokens(manifest: DataFrame, files: int) -> DataFrame:
    """One row per document as read back from the files of ``manifest``: doc_id, start, n_tokens and the checksum of its ids.

    Each frame is decompressed and checked against the seek table. Files are dealt to ``files`` tasks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, frames = start, read_frames(path)
                # a few thousand frames at a time, however long the file is
                while True:
                    rows = []
                    for _, doc, raw in itertools.islice(frames, 4_096):
                        rows.append((doc, at, len(raw) // 4, zlib.crc32(raw)))
                        at += len(raw) // 4
                    if not rows:
                        break
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "start").repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(docs: DataFrame, tokenizer: str, files: int) -> DataFrame:
    """Write the token files to a new folder below the shared one, and return what reading them back gives per document."""
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/textorigin-tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(docs, folder, tokenizer, files), files)
