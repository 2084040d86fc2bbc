"""Token ids in a binary file format of shuffled byte or bit planes.

A file holds the ids of consecutive documents, cut into blocks of ``BLOCK_IDS`` ids. Each block is transposed into
the planes of its 32-bit ids (four bytes or 32 bits), each plane is compressed with zstandard, and an index at the end
of the file gives every block's place, number of ids and plane lengths, so that a reader can fetch any range:

    magic | planes of block 0, planes of block 1, ... | documents | index | footer

``documents`` is the doc_ids (int64), their numbers of ids (uint32) and a bit each for those that are no null, compressed; ``index`` is one
record of ``2 + planes`` unsigned 64-bit numbers a block (offset, ids, plane lengths); the footer is the offsets of both
sections, blocks, documents, ids, planes and the magic again. Numbers are little-endian.

Texts are encoded whole; null is empty. Documents go in ascending doc_id (null first, ties by text hash), each
followed by the end id; repeated rows each have their own. An empty table gives no files and an empty result. Other
columns are ignored. Files are written once per task attempt under a new name, and only the attempt whose manifest row
Spark commits is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm.common import RID, column, give_back, materialize, pick, shared_path, shuffle_partitions, slices, small_batches, strings, worker_state

MAGIC = b"MWPLANE2"
BLOCK_IDS, END_ID, LEVEL = 1 << 16, 2, 3
FILE_BYTES = 256 << 20  # of text to a file
CACHE_PIECES = 250_000
FOOTER = "<QQQQQQ8s"
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- encoding ---------------------------------------------------------------------------------------------------


class PieceEncoder:
    """Ids of whole texts with the tokenizers library, doing each distinct piece of a slice once.

    A single space between two characters that are no white space always starts a new pre-token of a byte-level BPE,
    so a text may be cut before it, and the ids of the parts make up the ids of the text. A piece of letters and
    plain marks alone is one pre-token of letters and one of marks: those go to the library's BPE model, each distinct
    one once (a bounded cache carries them from slice to slice). Other pieces, and texts with other white space, go
    to the library's encoder as they are.
    """

    EDGE = r"^[\x00-\x20\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2060}\x{3000}\x{feff}]|[\x00-\x20\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2060}\x{3000}\x{feff}]$|^$|<\|"
    PLAIN = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<marks>[.,;:!?*#$%&|()\-]*)$"

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        # Cutting holds for a byte-level BPE that changes no text before, and whose added tokens begin with "<|".
        marks = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.whole = not (type(tokenizer.model).__name__ == "BPE" and tokenizer.normalizer is None and isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and tokenizer.pre_tokenizer.use_regex and all(m.startswith("<|") for m in marks))
        self.encode, self.bpe = tokenizer.encode_batch_fast, tokenizer.model.tokenize
        self.end = np.uint32(end_id).tobytes()
        self.cache: dict[str, bytes] = {}
        # How the byte-level pre-tokenizer writes each byte.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytes = {b: spell(chr(b))[0][0] for b in range(128)}
        for c in map(chr, range(128, 2048)):
            for b, x in zip(c.encode(), spell(c)[0][0]):
                self.bytes[b] = x

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def _model(self, pretokens: list[str]) -> list[bytes]:
        known = self.cache
        missing = [p for p in pretokens if p not in known]
        if len(known) + len(missing) > CACHE_PIECES:
            known = self.cache = {p: known[p] for p in pretokens if p in known}
        spell, bpe = self.bytes, self.bpe
        for p in missing:
            found = bpe((p if p.isascii() else p.encode().decode("latin-1")).translate(spell))
            known[p] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        return [known[p] for p in pretokens]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, each with the space before it, and how many each has."""
        found = pc.extract_regex(pieces, self.PLAIN)
        plain = pc.is_valid(found)
        fields = found.filter(plain)
        letters, marks = (pc.struct_field(fields, name).dictionary_encode() for name in ("letters", "marks"))
        others = _list(pieces.filter(pc.invert(plain)))
        ids = self._model([" " + x for x in _list(letters.dictionary)])
        n_letters = len(ids)
        ids += [i if m else b"" for m, i in zip(_list(marks.dictionary), self._model(_list(marks.dictionary)))]
        n_marks = len(ids)
        ids += self._ids([" " + x for x in others])
        # A plain piece is its letters, then its marks; another one is itself, then nothing.
        ids.append(b"")
        parts = np.full((len(pieces), 2), len(ids) - 1, np.int64)
        mask = plain.to_numpy(zero_copy_only=False)
        parts[mask, 0] = letters.indices.to_numpy(zero_copy_only=False)
        parts[mask, 1] = marks.indices.to_numpy(zero_copy_only=False) + np.int64(n_letters)
        parts[~mask, 0] = n_marks + np.arange(len(others))
        flat, size = _ragged(*_joined(ids), parts.ravel())
        return flat, size.reshape(-1, 2).sum(axis=1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by the end id; the number of ids of each text."""
        n = len(texts)
        if self.whole:
            flat, size = _joined([x + self.end for x in self._ids(_list(texts))])
            return flat, size
        parts = pc.split_pattern(texts, " ")
        pieces, doc = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        later = np.ones(len(doc), bool)
        later[first] = False
        coded = pieces.filter(pa.array(later)).dictionary_encode()
        odd_piece = pc.match_substring_regex(coded.dictionary, self.EDGE).to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        odd = np.zeros(n, bool)
        odd[doc[later][odd_piece[codes]]] = True
        # A text's first piece must not border on white space either.
        heads = pieces.take(pa.array(first))
        odd |= pc.match_substring_regex(heads, self.EDGE).to_numpy(zero_copy_only=False)
        used = ~odd[doc[later]]
        starts = [texts[i].as_py() if odd[i] else h for i, h in enumerate(heads.to_pylist())]
        flat, size = self._pieces(coded.dictionary)
        more, more_size = _joined([*self._ids(starts), self.end])
        flat, size, base = np.concatenate([flat, more]), np.concatenate([size, more_size]), len(size)
        # The start of each text, its later pieces, the end id.
        order, owner = codes[used], doc[later][used]
        lo, hi = np.searchsorted(owner, np.arange(n)), np.searchsorted(owner, np.arange(n), side="right")
        at = np.concatenate([lo, hi])
        extra = np.concatenate([base + np.arange(n), np.full(n, base + n)])
        rank = np.argsort(np.concatenate([2 * np.arange(n), 2 * np.arange(n) + 1]), kind="stable")
        order = np.insert(order, at[rank], extra[rank])
        out, lengths = _ragged(flat, size, order)
        ends = np.flatnonzero(order == base + n)
        return out, np.diff(np.cumsum(lengths)[ends], prepend=0)


def _list(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _ragged(flat: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of a ragged array in the given order, and their sizes."""
    lengths = size[order]
    shift = (np.cumsum(size) - size)[order] - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))], lengths


# --- file format ------------------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8))[:n] for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file to ``sink`` (a binary stream)."""

    def __init__(self, sink, planes: int = 4, block: int = BLOCK_IDS):
        import zstandard

        self.sink, self.planes, self.block = sink, planes, block
        self.press = zstandard.ZstdCompressor(level=LEVEL).compress
        self.at, self.held, self.waiting, self.total = 0, [], 0, 0
        self.index: list[tuple[int, ...]] = []
        self.docs: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // self.block * self.block
        for lo in range(0, stop, self.block):
            part = ids[lo : min(lo + self.block, stop)]
            packed = [self.press(p) for p in to_planes(part, self.planes)]
            self.index.append((self.at, len(part), *map(len, packed)))
            self._put(b"".join(packed))
        self.held, self.waiting = [ids[stop:]], len(ids) - stop

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, known: np.ndarray | None = None) -> None:
        """Documents with their numbers of ids, and all ids; ``known`` is false where there is no doc_id."""
        self.docs.append(doc_ids.astype("<i8"))
        self.known.append(np.ones(len(doc_ids), bool) if known is None else known)
        self.counts.append(counts.astype("<u4"))
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.block:
            self._blocks(False)

    def close(self) -> None:
        self._blocks(True)
        docs_at, n_docs = self.at, sum(map(len, self.docs))
        known = np.packbits(np.concatenate(self.known)) if self.known else np.zeros(0, np.uint8)
        self._put(self.press(b"".join(x.tobytes() for x in [*self.docs, *self.counts, known])))
        index_at = self.at
        self._put(np.array(self.index, "<u8").tobytes())
        self._put(struct.pack(FOOTER, docs_at, index_at, len(self.index), n_docs, self.total, self.planes, MAGIC))
        self.sink.close()


class PlaneReader:
    """Reads one file from ``source`` (a seekable binary stream), block by block."""

    def __init__(self, source):
        import zstandard

        self.source, self.open = source, zstandard.ZstdDecompressor().decompress
        source.seek(0, 2)
        size = source.tell()
        docs_at, index_at, blocks, n_docs, self.total, planes, magic = struct.unpack(FOOTER, self._get(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        self.index = np.frombuffer(self._get(index_at, 8 * blocks * (2 + planes)), "<u8").reshape(blocks, 2 + planes)
        raw = self.open(self._get(docs_at, index_at - docs_at), max_output_size=13 * n_docs + 1) if n_docs else b""
        self.doc_ids, self.counts = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, "<u4", n_docs, offset=8 * n_docs)
        self.known = np.unpackbits(np.frombuffer(raw, np.uint8, offset=12 * n_docs), count=n_docs).astype(bool)

    def _get(self, at: int, size: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(size))

    def block(self, i: int) -> np.ndarray:
        at, n, *sizes = (int(x) for x in self.index[i])
        data = self._get(at, sum(sizes))
        ends = np.cumsum(sizes)
        return from_planes([self.open(data[e - s : e]) for s, e in zip(sizes, ends)], n)

    def documents(self):
        """doc_id (None where there is none) and ids of each document, in order."""
        held, blocks = np.zeros(0, np.uint32), iter(range(len(self.index)))
        for doc, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.counts.tolist()):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(next(blocks)))
                have += len(parts[-1])
            ids = np.concatenate(parts) if len(parts) > 1 else held
            yield doc if known else None, ids[:n]
            held = ids[n:]


# --- jobs -------------------------------------------------------------------------------------------------------


def qualified(spark, path: str) -> str:
    """``path`` as Spark takes it, with the name of its store: a bare path lies in the default file system, not on an executor's disk."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def _filesystem(path: str):
    from pyarrow import fs

    scheme, _, rest = path.partition("://")  # Hadoop's names of object stores; abfs, gs, hdfs and file are the same in both
    return fs.FileSystem.from_uri(path if not rest else f"{ {'s3a': 's3', 's3n': 's3', 'wasb': 'abfs', 'wasbs': 'abfss'}.get(scheme, scheme) }://{rest}")


def _write(path: str, tokenizer: str, end_id: int, planes: int, block: int):
    def run(batches):
        encode, writer, name = None, None, ""
        for b in slices(batches, "text", 2 << 20):
            if writer is None:
                known = worker_state()  # loading a tokenizer costs more than most tasks' texts
                encode = known.setdefault(("encoder", tokenizer, end_id), None) or PieceEncoder(tokenizer, end_id)
                known["encoder", tokenizer, end_id] = encode
                store, folder = _filesystem(path)
                store.create_dir(folder, recursive=True)
                part = TaskContext.get().partitionId()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
                writer = PlaneWriter(store.open_output_stream(f"{folder}/{name}"), planes, block)
            ids, counts = encode(strings(b, "text").cast(pa.string()))
            docs = column(b, "doc_id").cast(pa.int64())
            writer.add(pc.fill_null(docs, 0).to_numpy(zero_copy_only=False), counts, ids, pc.is_valid(docs).to_numpy(zero_copy_only=False))
        if writer is not None:
            writer.close()
            give_back()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([part], pa.int64()), "file": [name], "n_docs": pa.array([sum(map(len, writer.docs))], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

    return run


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, planes: int = 4, block: int = BLOCK_IDS, files: int | None = None) -> DataFrame:
    """Write the files of ``docs`` and return their manifest: file_no, file (full path), n_docs, n_ids, start (ids before it)."""
    spark = docs.sparkSession
    path = qualified(spark, path or shared_path(spark, "tokens"))
    base = pick(docs, "doc_id", "text", rid=True).withColumn("tie", F.xxhash64("text"))
    small_batches(spark)
    if files is None:
        volume = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(shuffle_partitions(spark), -(-volume // FILE_BYTES))
    place = ("doc_id", "tie", RID)  # repeats of one row may fill several files
    ranged = base.repartitionByRange(files, *place).sortWithinPartitions(*place).select("doc_id", "text")
    written = ranged.mapInArrow(_write(path, tokenizer or tokenizer_path(), end_id, planes, block), "file_no long, file string, n_docs long, n_ids long")
    manifest = materialize(written, "tokens-manifest")
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return manifest.select("file_no", F.concat(F.lit(f"{path}/"), "file").alias("file"), "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))


def _read(batches):
    for b in batches:
        for row in b.to_pylist():
            store, file = _filesystem(row["file"])
            at, out = row["start"], []
            with store.open_input_file(file) as source:
                for doc, ids in PlaneReader(source).documents():
                    out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(out) == 8192:
                        yield _digest(out)
                        out = []
            if out:
                yield _digest(out)
    give_back()


def _digest(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files of the manifest."""
    files = manifest.select("file", "start")
    return files.repartition(max(1, shuffle_partitions(manifest.sparkSession), manifest.count()), "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
