"""Token ids in seekable zstandard files.

A file is: independent zstandard frames of FRAME_BYTES of little-endian uint32 ids each (the last shorter), with content checksums;
a skippable frame with the index of its documents (doc_id and number of ids as an Arrow stream, zstandard-compressed, so that ids of any
type are kept); and the seek table, a skippable frame at the very end with the compressed and plain size and the checksum (low 32 bits of
XXH64) of each frame, as in the published seekable format. A reader takes the tail, then only the frames that hold the documents asked for.

Documents are range-partitioned by doc_id and, where ids are null or repeat, by a hash of the text, so files follow each other in ascending
order, no id is a task of its own, and one task holds a frame and a segment of text at a time. A task writes to a name of its own and renames
at the end; only files whose task reported back are read, so retried or speculative tasks leave nothing behind that counts.

Texts are cut into the tokenizer's pre-tokens by its published pattern, a segment of SEGMENT bytes at a time as arrays of byte classes; each
distinct pre-token of a segment is encoded by the tokenizers library once, and a memo of MEMO_ENTRIES keeps those seen before until the task ends.
Texts with characters whose class may differ between Unicode versions, or with a special token's string, go to the library whole. A text of
more than UNIT bytes is cut at spaces between two ASCII letters, where pre-tokens always end, so no text needs memory in proportion to its length
unless it has no such space. tests/llm holds all this against encoding whole texts.

Nulls: a null text is empty and gives the end id alone. Null doc_ids come first. Rows that repeat a doc_id lie next to each other, in the order of
a hash of their texts (ties are rows alike, so the files agree). No rows give no files and an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh_path, read
from .words import LONGEST, Keys, firsts, packed, raw

END_ID = 0
FRAME_BYTES = 1 << 18
LEVEL = 3
#: Bytes of text that are cut at a time, and from which a text is taken in parts.
SEGMENT, UNIT = 1 << 21, 1 << 20
#: Pre-tokens that the memo holds, at some 60 bytes each.
MEMO_ENTRIES = 1 << 19
#: Rows of a batch that goes back to the JVM.
ROWS = 10_000
SEEK_MAGIC, INDEX_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: The published pre-token pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ with these classes.
LETTER, NUMBER, BLANK, OTHER, UNSURE = range(5)
_BLANKS = frozenset([9, 10, 11, 12, 13, 32, 0xA0])
#: Scripts that have long been in Unicode: every version classes these characters alike.
_SURE = ((0x00, 0x7F), (0xA0, 0x24F), (0x370, 0x377), (0x391, 0x3C9), (0x410, 0x44F), (0x2010, 0x2027), (0x2030, 0x203A), (0x20AC, 0x20AC))

_held: dict = {}


def _class_of(point: int) -> int:
    if not any(lo <= point <= hi for lo, hi in _SURE):
        return UNSURE
    if point in _BLANKS:
        return BLANK
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(point))[0], OTHER)


_TOP = 0x20AD
_CLASSES = np.array([*map(_class_of, range(_TOP)), UNSURE], np.uint8)
_ASCII = np.r_[_CLASSES[:128], np.full(128, UNSURE, np.uint8)]
_ASCII_LETTER = np.array([chr(c).isascii() and chr(c).isalpha() for c in range(256)])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of UTF-8 belongs to."""
    out = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        end = len(data) - 1
        first, second, third = (data[np.minimum(lead + k, end)].astype(np.int32) for k in range(3))
        point = np.where(first < 0xE0, (first & 31) << 6 | second & 63, (first & 15) << 12 | (second & 63) << 6 | third & 63)
        of = np.where(first < 0xF0, _CLASSES[np.minimum(point, _TOP)], np.uint8(UNSURE))
        for k in range(3):
            longer = first >= (0, 0, 0xE0)[k]
            out[np.minimum(lead[longer] + k, end)] = of[longer]
    return out


def piece_starts(data: np.ndarray, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sorted places where pre-tokens begin in texts that lie one after another; text k is data[bounds[k]:bounds[k + 1]]."""
    if not len(data):
        return np.zeros(0, np.int64)
    change = np.empty(len(data), bool)
    change[:1] = True
    np.not_equal(classes[1:], classes[:-1], out=change[1:])
    change[bounds[:-1][bounds[:-1] < len(data)]] = True
    runs = np.flatnonzero(change)
    ends = np.r_[runs[1:], len(data)]
    of = classes[runs]
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds] = True
    followed = ~begins[ends]  # another run of the same text comes behind
    blank = of == BLANK
    last = ends - 1
    last = np.where(blank & (data[last] >= 0x80), last - 1, last)  # a blank of two bytes
    out = np.zeros(len(data), bool)
    out[runs] = True
    before_text = blank & followed
    out[last[before_text]] = True  # all blanks but the last are a piece; the last, if it is a space, goes with what follows
    joined = before_text & (data[last] == 0x20)
    out[ends[joined]] = False
    mark = np.flatnonzero((of == OTHER) & (ends - runs == 1) & (data[runs] == 0x27) & out[runs] & followed)
    mark = mark[of[np.minimum(mark + 1, len(of) - 1)] == LETTER]
    if len(mark):
        at, stop = ends[mark], ends[mark + 1]
        one, two = data[at], np.where(stop - at > 1, data[np.minimum(at + 1, len(data) - 1)], 0)
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
        for pair in (b"re", b"ve", b"ll"):
            size = np.where((one == pair[0]) & (two == pair[1]), 2, size)
        at, stop, size = at[size > 0], stop[size > 0], size[size > 0]
        out[at] = False
        rest = at + size
        out[rest[rest < stop]] = True
    return np.flatnonzero(out)


def units_of(data: np.ndarray, offsets: np.ndarray, unit: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of parts of texts (offsets: bounds of the texts) and, for each part, whether its text ends there."""
    long = np.flatnonzero(np.diff(offsets) > unit)
    more = []
    for k in long.tolist():
        at, end = int(offsets[k]), int(offsets[k + 1])
        while end - at > unit:
            look, cut = at + unit, None
            while cut is None and look < end - 2:
                w = data[look : min(end, look + unit)]
                hits = _ASCII_LETTER[w[:-2]] & (w[1:-1] == 0x20) & _ASCII_LETTER[w[2:]]
                cut = look + 1 + int(hits.argmax()) if hits.any() else None
                look += unit - 2
            if cut is None:
                break
            more.append(cut)
            at = cut
    starts = np.concatenate([offsets[:-1], np.array(more, offsets.dtype)])
    ends_text = np.r_[np.ones(len(offsets) - 1, bool), np.zeros(len(more), bool)]
    order = np.lexsort((~ends_text, starts))  # a text that is empty comes before its follower, parts come behind the start of theirs
    starts, own = starts[order], ends_text[order]
    return np.r_[starts, offsets[-1]], np.r_[own[1:], True]


def _byte_alphabet() -> list[str]:
    """The published letter for each byte: itself if it can be seen, else the next one from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(other)) for b in range(256)]


class Memo(Keys):
    """Ids of pre-tokens of up to LONGEST bytes."""

    def __init__(self, most: int = MEMO_ENTRIES):
        super().__init__(most)

    def clear(self) -> None:
        super().clear()
        self.ids, self.offsets = np.full(4096, END_ID, np.uint32), np.zeros(1025, np.int64)
        self.offsets[1], self.n = 4, 1  # entry 0 is the end id, which no key has

    def add(self, ids: list[int], counts: list[int]) -> int:
        """New entries with these numbers of ids; the first one's number. They have no key."""
        k, n = len(counts), len(ids)
        self.room(k)
        if len(self.offsets) <= len(self.low):
            self.offsets = np.r_[self.offsets, np.zeros(len(self.low) + 1 - len(self.offsets), np.int64)]
        at = int(self.offsets[self.n]) // 4
        while at + n > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[at : at + n] = ids
        self.offsets[self.n + 1 : self.n + 1 + k] = 4 * (at + np.cumsum(counts))
        self.n += k
        return self.n - k

    def taken(self, entries: np.ndarray) -> np.ndarray:
        """Ids of the entries, one after another."""
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.offsets[: self.n + 1]), pa.py_buffer(self.ids)])
        got = held.take(pa.array(entries))
        return np.frombuffer(got.buffers()[2], "<u4", int(np.frombuffer(got.buffers()[1], np.int64)[len(entries)]) // 4) if len(entries) else np.zeros(0, "<u4")


class Encoder:
    """Ids of pre-tokens and of whole texts, with a bounded memo of pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        if hasattr(self.model.model, "_resize_cache"):  # the memo takes its place
            self.model.model._resize_cache(0)
        self.alphabet = dict(enumerate(_byte_alphabet()))
        self.memo = Memo()

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _held:
            _held[path] = cls(path)
        return _held[path]

    def forget(self) -> None:
        self.memo.clear()

    def merged(self, pieces: list[bytes]) -> tuple[list[int], list[int]]:
        """Ids of pre-tokens by the library's merges, each pre-token in the byte alphabet, and their numbers."""
        merge, ids, counts = self.model.model.tokenize, [], []
        for x in b"\xff".join(pieces).decode("latin-1").translate(self.alphabet).split(self.alphabet[255]):  # no UTF-8 has this byte
            got = merge(x)
            ids += [t.id for t in got]
            counts.append(len(got))
        return ids, counts

    def segments(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """texts: strings without nulls. Of each segment: its ids, the end id behind each text included; the numbers of ids, in this segment, of the
        texts that end in it; and of ids that belong to a text that goes on."""
        data, offsets = raw(texts)
        bounds, ends = units_of(data, offsets)
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SEGMENT, "right")) - 1)
            last = min(last, len(ends))
            yield self._segment(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], ends[first:last])
            first = last

    def _entries(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Entries of the memo for pre-tokens of up to LONGEST bytes."""
        low, high = packed(data, starts, sizes)
        found = self.memo.find(low, high)
        order, number, one = firsts(low, high, found)
        if len(one):
            held = data.tobytes()
            first = self.memo.add(*self.merged([held[s:e] for s, e in zip(starts[one].tolist(), (starts[one] + sizes[one]).tolist(), strict=True)]))
            self.memo.name(first, low[one], high[one])
            found[order] = first + number
        return found

    def _segment(self, data: np.ndarray, bounds: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        if self.memo.n > self.memo.most:
            self.memo.clear()
        classes = byte_classes(data)
        whole = np.zeros(len(ends), bool)  # goes to the library as it is
        odd = np.flatnonzero(classes == UNSURE)
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        whole[np.searchsorted(bounds, np.r_[odd, special], "right") - 1] = True
        starts = piece_starts(data, classes, bounds)
        if whole.any():
            owner = np.searchsorted(bounds, starts, "right") - 1
            starts = starts[~whole[owner] | (starts == bounds[owner])]
        sizes = np.diff(np.r_[starts, len(data)])
        alone = whole[np.searchsorted(bounds, starts, "right") - 1] if whole.any() else np.zeros(len(starts), bool)
        short = (sizes <= LONGEST) & ~alone
        entries = np.empty(len(starts), np.int32)
        entries[short] = self._entries(data, starts[short], sizes[short])
        named = self.memo.n
        if len(rest := np.flatnonzero(~short)):  # few; these are forgotten after the segment
            texts = [data[s : s + n].tobytes() for s, n in zip(starts[rest].tolist(), sizes[rest].tolist(), strict=True)]
            place = {x: named + k for k, x in enumerate(sorted(set(zip(alone[rest].tolist(), texts, strict=True))))}
            if long := [x for library, x in place if not library]:
                self.memo.add(*self.merged(long))
            for library, x in place:
                if library:
                    self.memo.add(ids := self.model.encode(x.decode(), add_special_tokens=False).ids, [len(ids)])
            entries[rest] = [place[x] for x in zip(alone[rest].tolist(), texts, strict=True)]
        after = np.searchsorted(starts, bounds[1:])  # number of pieces up to the end of each part
        after = np.where(bounds[1:] == len(data), len(starts), after)
        count = np.diff(self.memo.offsets[: self.memo.n + 1]) // 4
        total = np.r_[0, np.cumsum(count[entries])][after]
        text_ends = np.flatnonzero(ends)
        of_text = np.diff(np.r_[0, total[text_ends]]) + 1
        left = int(total[-1] - (total[text_ends[-1]] if len(text_ends) else 0))
        ids = self.memo.taken(np.insert(entries, after[text_ends], 0))
        self.memo.n = named
        return ids, of_text, left


class Writer:
    """One file; see the module. add() takes ids of documents in order; a document's ids may come in parts."""

    def __init__(self, sink, level: int = LEVEL, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.sink, self.frame_bytes, self.left, self.frames, self.doc_ids, self.sizes = sink, frame_bytes, bytearray(), [], [], []

    def add_ids(self, ids: np.ndarray) -> None:
        self.left += ids.astype("<u4", copy=False).tobytes()
        at = 0
        while len(self.left) - at >= self.frame_bytes:
            self._frame(bytes(self.left[at : at + self.frame_bytes]))
            at += self.frame_bytes
        del self.left[:at]

    def add_documents(self, doc_ids: pa.Array, sizes: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.sizes.append(sizes)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.add_documents(pa.array([doc_id]), np.array([len(ids)]))
        self.add_ids(ids)

    def _frame(self, plain: bytes) -> None:
        from xxhash import xxh64_intdigest

        self.sink.write(packed := self.pack.compress(plain))
        self.frames.append((len(packed), len(plain), xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.left:
            self._frame(bytes(self.left))
        ids = pa.chunked_array(self.doc_ids).combine_chunks() if self.doc_ids else pa.array([], pa.int64())
        listed = pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([np.zeros(0, np.int64), *self.sizes]), pa.int64())], ["doc_id", "n"])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, listed.schema) as stream:
            stream.write_batch(listed)
        index = self.pack.compress(out.getvalue().to_pybytes())
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC))


class Reader:
    """Documents of one file. source: a seekable binary file."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain = (np.r_[0, np.cumsum(table[:, k])] for k in (0, 1))
        self.sums = table[:, 2]
        at = int(self.packed[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no index of documents behind the frames")
        with pa.ipc.open_stream(self.unpack.decompress(self._at(at + 8, length))) as stream:
            listed = stream.read_all()
        self.doc_ids, self.sizes = listed.column("doc_id").combine_chunks(), listed.column("n").to_numpy()
        self.starts = np.r_[0, np.cumsum(self.sizes)]

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        from xxhash import xxh64_intdigest

        plain = self.unpack.decompress(self._at(int(self.packed[k]), int(self.packed[k + 1] - self.packed[k])))
        if xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return plain

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; reads only the frames that it lies in."""
        start, end = 4 * int(self.starts[k]), 4 * int(self.starts[k + 1])
        first, last = int(np.searchsorted(self.plain, start, "right")) - 1, int(np.searchsorted(self.plain, end, "left"))
        plain = b"".join(self.frame(j) for j in range(first, last))
        at = int(self.plain[first])
        return np.frombuffer(plain[start - at : end - at], "<u4")

    def raw(self) -> Iterator[memoryview]:
        """Bytes of the ids of each document in order, each frame once."""
        held, at, frame = b"", 0, 0
        for n in (4 * self.sizes).tolist():
            if len(held) - at < n:
                parts = [held[at:]]
                have = len(parts[0])
                while have < n:
                    parts.append(self.frame(frame))
                    have, frame = have + len(parts[-1]), frame + 1
                held, at = b"".join(parts), 0
            yield memoryview(held)[at : at + n]
            at += n

    def documents(self) -> Iterator[tuple]:
        """(doc_id, start, ids) of all documents."""
        for k, raw in enumerate(self.raw()):
            yield self.doc_ids[k].as_py(), int(self.starts[k]), np.frombuffer(raw, "<u4")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, frame_bytes: int = FRAME_BYTES) -> list[dict]:
    """Writes docs to files under path; a row for each file, in order: name, docs, ids, start (ids in the files before)."""
    tokenizer = tokenizer or tokenizer_path()
    text = F.coalesce("text", F.lit(""))
    ordered = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get(), Encoder.at(tokenizer)
        store, at = _store(path)
        store.create_dir(at, recursive=True)
        name, draft, n_docs, n_ids = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tok.zst", f"{at}/.part-{task.taskAttemptId()}", 0, 0
        with store.open_output_stream(draft) as sink:
            out = Writer(sink, frame_bytes=frame_bytes)
            for b in batches:
                sizes, open_ = [], 0
                for ids, ended, left in encoder.segments(b.column(1)):
                    out.add_ids(ids)
                    n_ids += len(ids)
                    if len(ended):
                        ended[0] += open_
                        open_ = 0
                    sizes.append(ended)
                    open_ += left
                out.add_documents(b.column(0), np.concatenate([np.zeros(0, np.int64), *sizes]))
                n_docs += b.num_rows
            out.close()
        encoder.forget()
        if n_docs:
            store.move(draft, f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "docs": [n_docs], "ids": [n_ids]})
        else:
            store.delete_file(draft)

    rows = arrow_map(ordered, run, "part long, name string, docs long, ids long").collect()  # one row a file
    files, start = [], 0
    for r in sorted(rows, key=lambda r: r["part"]):
        files.append({"name": r["name"], "docs": r["docs"], "ids": r["ids"], "start": start})
        start += r["ids"]
    return files


def read_tokens(spark, path: str, files: list[dict], kind: str = "bigint") -> DataFrame:
    """doc_id (of type kind), start, n_tokens, ids_crc32 of every document, from the files; each frame is checked."""
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(path)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{at}/{name}") as source:
                    reader = Reader(source)
                    sums = np.fromiter(map(zlib.crc32, reader.raw()), np.int64, len(reader.sizes))
                for k in range(0, len(sums), ROWS):
                    part = slice(k, k + ROWS)
                    yield pa.RecordBatch.from_arrays([reader.doc_ids[part], *(pa.array(x, pa.int64()) for x in (base + reader.starts[:-1][part], reader.sizes[part], sums[part]))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(f["name"], f["start"]) for f in files], "name string, base long").repartition(len(files))
    return arrow_map(listed, run, schema)


def tokenized(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """docs written to files under path (a new one in the shared folder) and read back; see write_tokens and read_tokens."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    return read_tokens(spark, path, write_tokens(docs, path, tokenizer), docs.schema["doc_id"].dataType.simpleString())


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    return tokenized(read(spark, sf_dir, "documents"))
