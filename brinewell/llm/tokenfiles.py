"""Token ids in Arrow files of fixed-size-list batches: equal-length sequences and masks, read without copying.

Texts are encoded with a ready tokenizer. Where its file splits and normalises as `_BY_PIECES` says, every piece of a plain
text between white space is encoded once per worker and looked up afterwards, which gives the ids that encoding the whole
text gives; texts with characters for which that is not certain, and all texts of other tokenizers, are encoded whole. Documents are dealt out by ranges of doc_id, sorted, packed back to back into
sequences of seq_len ids, and written by each task to one Arrow IPC file. The index (which rows of which file hold a
document) is written by Spark in the same job, so only files of tasks that succeeded are ever read.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first; documents that share a doc_id
follow each other in the order of their ids' bytes; an empty table gives no files and no rows; only doc_id and text
are read. Texts are never cut: a long one spans sequences. The last sequence of a file is padded, and masked there.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinewell.llm.shared import release_memory, scratch_path, texts

END_ID = 2
SEQ_LEN = 2048
#: Sequences in a record batch of a file.
BATCH_SEQS = 256
PARTITION_BYTES = 32 << 20
_LETTERS = "a-zªµºß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĸĺļľŀłńņňŉŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżžſ"
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9²³¹¼-¾]|[^\\s{_LETTERS}0-9²³¹¼-¾]+")
#: What a tokenizer file must say for its pieces to be encoded apart: fixed values.
_BY_PIECES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None, "truncation": None, "padding": None,
}
#: Anything else may be normalised, split or lower-cased in ways that depend on its neighbours.
_NOT_PLAIN = r"[^\t\n\r -~¡-įı-ž]|<\|"
#: Bytes of text that are taken apart at once, and pieces in half a cache: two workers stand beside an executor's heap.
_SLICE_BYTES, _CACHE = 1 << 19, 150_000


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Cache:
    """The entries used lately: between limit and twice that many."""

    def __init__(self, limit: int) -> None:
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key: str) -> bytes | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Encoder:
    """Encodes arrays of texts; one for each worker process. Pieces seen before stay known until a task ends."""

    _known: dict[str, Encoder] = {}

    def __init__(self, tokenizer_json: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model, self.seen = self.tokenizer.model, _Cache(_CACHE)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        rules = json.loads(tokenizer_json)
        special = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in rules["added_tokens"])
        model = rules["model"]
        self.by_pieces = special and model["type"] == "BPE" and not model.get("dropout") and all(rules.get(k) == v for k, v in _BY_PIECES.items())
        self.symbols = str.maketrans({chr(b): s for b, s in _byte_symbols().items()})
        del rules, model
        release_memory()  # the parsed file

    @classmethod
    def of(cls, tokenizer_json: str) -> Encoder:
        key = str(zlib.crc32(tokenizer_json.encode()))
        if key not in cls._known:
            cls._known[key] = cls(tokenizer_json)
        return cls._known[key]

    def piece(self, piece: str) -> bytes:
        """Ids of a piece without white space. Pieces and the words in them share a cache."""
        got = self.seen.get(piece)
        if got is None:
            words = _PRETOKEN.findall(piece.lower())
            if words == [piece]:
                got = np.array([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.symbols))], self.dtype).tobytes()
            else:
                got = b"".join([self.piece(w) for w in words])
            self.seen.put(piece, got)
        return got

    def pieces(self, them: list[str]) -> list[bytes]:
        """Ids of each piece."""
        young = self.seen.young
        return [young.get(p) or self.piece(p) for p in them]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        bounds = split.offsets.to_numpy().astype(np.int64)
        pieces = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        where, pool = pieces.indices.to_numpy(), self.pieces(pieces.dictionary.to_pylist())
        lens = np.fromiter(map(len, pool), np.int32, len(pool)) // self.dtype.itemsize
        begins = np.cumsum(lens, dtype=np.int32) - lens
        each = lens[where]
        ends = np.cumsum(each, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(b"".join(pool), self.dtype)[np.arange(total, dtype=np.int32) + np.repeat(begins[where] - (ends - each), each)] if total else np.zeros(0, self.dtype)
        return ids, np.diff(np.r_[0, ends].astype(np.int64)[bounds - bounds[0]])

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of texts in order: all ids, and how many each text has."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _SLICE_BYTES, "right")))
            part = texts.slice(at, upto - at)
            odd = pc.match_substring_regex(part, _NOT_PLAIN).to_numpy(zero_copy_only=False) if self.by_pieces else np.ones(len(part), bool)
            if not odd.any():
                yield self._plain(part)
            else:
                ids, counts = self._plain(pc.if_else(pa.array(odd), "", part))
                places = np.flatnonzero(odd)
                pieces = np.split(ids, np.cumsum(counts)[:-1])
                for i in places:  # one by one: an encoding takes about a hundred bytes a token
                    [whole] = self.tokenizer.encode_batch_fast([part[int(i)].as_py()], add_special_tokens=False)
                    pieces[i] = np.array(whole.ids, self.dtype)
                    counts[i] = len(pieces[i])
                yield np.concatenate(pieces), counts
            at = upto


def encoded(docs: DataFrame, tokenizer_json: str, bounds: list[int], end_id: int = END_ID) -> DataFrame:
    """part (the range of doc_id), doc_id, n_tokens, ids (little-endian) with the end id."""
    edges = np.array(bounds, np.int64)

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_json)
        for b in them:
            doc_ids, at = b.column("doc_id"), 0
            for ids, counts in encoder.encode(b.column("text")):
                ends = np.cumsum(counts + 1)
                out = np.full(ends[-1], end_id, encoder.dtype)
                keep = np.ones(len(out), bool)
                keep[ends - 1] = False
                out[keep] = ids
                mine = doc_ids.slice(at, len(counts))
                at += len(counts)
                parts = np.searchsorted(edges, pc.fill_null(mine, np.iinfo(np.int64).min).to_numpy(), "right").astype(np.int32)
                offsets = np.r_[0, ends] * encoder.dtype.itemsize
                data = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
                yield pa.record_batch({"part": pa.array(parts), "doc_id": mine, "n_tokens": pa.array(counts + 1), "ids": data})
        encoder.seen = _Cache(_CACHE)
        release_memory()

    return texts(docs).mapInArrow(batches, "part int, doc_id long, n_tokens long, ids binary")


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Writer:
    """One Arrow IPC file of fixed-size-list batches."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, seq_len: int) -> None:
        fs, path = _filesystem(f"{folder}/{name}")
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.ids = pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), nullable=False), seq_len)
        self.mask = pa.list_(pa.field("item", pa.bool_(), nullable=False), seq_len)
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, pa.schema([("input_ids", self.ids), ("mask", self.mask)]))
        self.seq_len, self.dtype, self.pending, self.held, self.total = seq_len, dtype, [], 0, 0

    def add(self, ids: np.ndarray) -> int:
        """Appends ids; returns the place of the first in the file."""
        first = self.total
        self.pending.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BATCH_SEQS * self.seq_len:
            self.flush(False)
        return first

    def flush(self, last: bool) -> None:
        flat, step = np.concatenate(self.pending) if self.pending else np.zeros(0, self.dtype), BATCH_SEQS * self.seq_len
        while len(flat) >= step or last and len(flat):
            n = min(step, len(flat))
            seqs = -(-n // self.seq_len)
            ids, mask = np.zeros(seqs * self.seq_len, self.dtype), np.zeros(seqs * self.seq_len, bool)
            ids[:n], mask[:n] = flat[:n], True
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.ids), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.mask)], names=["input_ids", "mask"]))
            flat = flat[n:]
        self.pending, self.held = [flat], len(flat)

    def close(self) -> None:
        self.flush(True)
        self.out.close()
        self.sink.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer_json: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Writes the files and the index below folder; returns the index: part, file, doc_id, first (place in the file), n_tokens.

    There is a range of doc_id, and a file, for every partition_bytes of text, however much there is; tasks sort their
    range with spilling and write it as it comes, so partition_bytes may be raised to have fewer files.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).first()["bytes"] or 0
    grid = [i / -(-total // partition_bytes) for i in range(1, -(-total // partition_bytes))]
    at = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), grid, max(20_000, 10 * len(grid))).alias("at")).first()["at"] if grid else None
    bounds = sorted(set(at or []))
    dealt = encoded(docs, tokenizer_json, bounds, end_id).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, attempt = Encoder.of(tokenizer_json).dtype, f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        now, writer, name = None, None, ""
        for b in batches:
            firsts, names = [], []
            for part, ids in zip(b.column("part").to_pylist(), b.column("ids"), strict=True):
                if part != now:
                    if writer:
                        writer.close()
                    now, name = part, f"tokens-{part:08d}-{attempt}.arrow"
                    writer = _Writer(folder, name, dtype, seq_len)
                firsts.append(writer.add(np.frombuffer(ids.as_buffer(), dtype)))
                names.append(name)
            yield pa.record_batch({"part": b.column("part"), "file": pa.array(names, pa.string()), "doc_id": b.column("doc_id"), "first": pa.array(firsts, pa.int64()), "n_tokens": b.column("n_tokens")})
        if writer:
            writer.close()

    schema = "part int, file string, doc_id long, first long, n_tokens long"
    dealt.mapInArrow(write, schema).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(schema).parquet(f"{folder}/index")


class _Reader:
    """Random access to one file: local files are mapped, and slices share their memory."""

    def __init__(self, folder: str, name: str) -> None:
        fs, path = _filesystem(f"{folder}/{name}")
        self.source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len, self.batch, self.at = self.file.schema.field("input_ids").type.list_size, None, -1

    def ids(self, first: int, n: int) -> np.ndarray:
        step, out = BATCH_SEQS * self.seq_len, []
        for k in range(first // step, (first + n - 1) // step + 1):
            if k != self.at:
                batch = self.file.get_batch(k)
                self.batch, self.at = batch.column(0).values.to_numpy(), k
            out.append(self.batch[max(0, first - k * step) : first + n - k * step])
        return out[0] if len(out) == 1 else np.concatenate(out)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files below folder: doc_id, start (ids of all before it), n_tokens, ids_crc32."""
    index = spark.read.schema("part int, file string, doc_id long, first long, n_tokens long").parquet(f"{folder}/index")
    totals = index.groupBy("file", "part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select(F.col("file").alias("_file"), before.alias("before"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for b in batches:
            sums = []
            for file, first, n in zip(b.column("file").to_pylist(), b.column("first").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                if file != name:
                    name, reader = file, _Reader(folder, file)
                sums.append(zlib.crc32(reader.ids(first, n).astype("<u4")))
            yield pa.record_batch({"file": b.column("file"), "doc_id": b.column("doc_id"), "first": b.column("first"), "n_tokens": b.column("n_tokens"), "ids_crc32": pa.array(sums, pa.int64())})

    sums = index.mapInArrow(check, "file string, doc_id long, first long, n_tokens long, ids_crc32 long")
    return sums.join(F.broadcast(base), F.col("file") == F.col("_file")).select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_file_report(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes docs' token files to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    folder = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, folder, tokenizer_json, **options)
    return read_token_files(docs.sparkSession, folder)
