"""Token ids as binary files: each document a zstandard frame under one shared dictionary.

A file holds documents in ascending order of id, as does the row of files. Its layout, all
little-endian:

    b"TOKZ0001" | dictionary hash (16 bytes) | bytes an id takes (u4)
    one zstandard frame for each document: its ids, end id included
    index: for each document  id i8 | null id u1 | offset u8 | frame bytes u4 | ids u4
    number of documents u8 | offset of the index u8 | b"TOKZ0001"

So a reader finds a short document through the index and decompresses it alone. The dictionary
lies beside the files, under its hash. It is trained on a bounded sample: the ids of the
``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS`` characters whose id has the least hash. It
changes the files' size, never their content.

Files are written by tasks with pyarrow's file systems (local, hdfs, s3, gs) under a name of
their own and then renamed, so a task that runs again replaces its file by an equal one. A task holds
one batch of rows and writes on; a file ends at ``FILE_BYTES``.

Defined results: null text is empty and has the end id alone; null ids come first; rows of equal
id are ordered by text hash; repeated rows are written each; an empty table gives no files and an
empty result; other columns are not looked at. With ``order`` given, files follow these columns
and not the ids.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from codexlake.llm.shared import few_by_hash, new_path, small, stored, text_key

MAGIC = b"TOKZ0001"
END_ID = 0
LEVEL = 3
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 4096
DICTIONARY_BYTES = 1 << 16
FILE_BYTES = 32 << 20
#: Documents that are encoded at once.
BATCH_DOCS = 256
#: Bytes of words and ids that a worker remembers, by a rough count; as much again is held for a while.
REMEMBERED_BYTES = 64 << 20
#: What a remembered word takes beside its characters and ids.
ENTRY_BYTES = 200
INDEX = np.dtype([("id", "<i8"), ("none", "u1"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4")])


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer, remembering the ids of words.

    Such a tokenizer first cuts a text before every space that stands between two other
    characters that aren't white space, and around every such line feed, and encodes each piece for
    itself; so the ids of a text are those of its pieces. It also cuts between a letter and ASCII marks
    at a word's end (apostrophes aside). A text with any other white space at such a place, or with
    the string of an added token such as the end of a text, is encoded whole. New words are encoded in one string: a word's first token is the one that begins
    with its space.
    """

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, tokenizer_json: str, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how it writes a space
        self.forget()
        self.feed = self._whole(["\n"])[0]

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.taken = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it."""
        out: list[bytes] = []
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(part):  # not a tokenizer that keeps words apart
                out += self._whole([" " + w for w in part])
                continue
            data, cuts = ids.tobytes(), [*(at * self.dtype.itemsize).tolist(), ids.nbytes]
            out += [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Remember all pieces, which are words, or a line feed and a word."""
        self.taken += sum(map(len, pieces)) * 2 + ENTRY_BYTES * len(pieces)
        marked = {}
        words, starts = set(), []
        for p in pieces:
            if p[0] == "\n":
                starts.append(p)
            elif len(core := p.rstrip(self.MARKS)) < len(p) and core and core[-1].isalpha():
                marked[p] = core
                if core not in self.known:
                    words.add(core)
            else:
                words.add(p)
        words_ = list(words)
        self.known.update(zip(words_, self._spaced(words_), strict=True))
        self.known.update((p, self.feed + ids) for p, ids in zip(starts, self._whole([p[1:] for p in starts]), strict=True))
        tails = {p[len(c) :] for p, c in marked.items()}
        marks = dict(zip(tails, self._whole([*tails]), strict=True))
        for p, core in marked.items():
            self.known[p] = self.known[core] + marks[p[len(core) :]]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.taken > (REMEMBERED_BYTES if self.remembered is None else self.remembered):
            self.known, self.older, self.taken = {}, self.known, 0
        # a piece is a word, the first one of a line with the line feed before it
        cut = [("\n" + t.replace("\n", " \n")).split(" ") for t in texts]
        special = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        for i in special:
            cut[i] = []
        new = set(chain.from_iterable(cut)).difference(self.known)
        odd = {p for p in new if p in ("", "\n") or p[-1].isspace() or p[p[0] == "\n"].isspace()}
        new -= odd
        if self.older:
            again = new & self.older.keys()
            self.known.update((p, self.older[p]) for p in again)
            self.taken += sum(map(len, again)) * 2 + ENTRY_BYTES * len(again)
            new -= again
        self._learn(new)
        known, skip = self.known.__getitem__, len(self.feed)
        plain = [i not in special and (not odd or odd.isdisjoint(pieces)) for i, pieces in enumerate(cut)]
        out = [b"".join(map(known, pieces))[skip:] if ok else b"" for ok, pieces in zip(plain, cut, strict=True)]
        whole = [i for i, ok in enumerate(plain) if not ok]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=1)
def _encoder(tokenizer_json: str, remembered: int | None = None) -> PieceEncoder:
    return PieceEncoder(tokenizer_json, remembered)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a Spark path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def train_dictionary(docs: DataFrame, tokenizer_json: str, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> bytes:
    """Dictionary bytes from a bounded sample of short documents; empty if there is too little."""
    rows = few_by_hash(docs.filter(F.length("text") <= sample_chars).select("text", "doc_id"), "doc_id", sample_docs, docs.count())
    texts = [r.text for r in rows]
    samples = [x for x in PieceEncoder(tokenizer_json).encode(texts) if x] if texts else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples
        return b""


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:16]


def _frames(kind: type, dictionary: bytes, **options):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return kind(dict_data=data, **options)


class _FileWriter:
    def __init__(self, folder: str, name: str, dictionary: bytes, width: int):
        self.fs, path = file_system(f"{folder}/{name}")
        self.name, self.path, self.draft = name, path, f"{path}.{uuid.uuid4().hex}.draft"
        self.out, self.index, self.at, self.ids = self.fs.open_output_stream(self.draft), [], 0, 0
        self._put(MAGIC + dictionary_hash(dictionary) + struct.pack("<I", width))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: int | None, frame: bytes, n: int) -> None:
        self.index.append((key or 0, key is None, self.at, len(frame), n))
        self._put(frame)
        self.ids += n

    def close(self) -> tuple:
        start = self.at
        self._put(np.array(self.index, INDEX).tobytes())
        self._put(struct.pack("<QQ", len(self.index), start) + MAGIC)
        self.out.close()
        self.fs.move(self.draft, self.path)
        return self.name, len(self.index), self.ids, self.at


FILES = "file string, n_docs long, n_ids long, bytes long"


def write_part(batches: Iterable[pa.RecordBatch], part: int, folder: str, tokenizer_json: str, dictionary: bytes, file_bytes: int = FILE_BYTES, remembered: int | None = None) -> list[tuple]:
    """Write one task's rows (doc_id, text); its files. The words that are remembered stay for the worker's next
    task, as most words of a text are in others too; reading the files drops them."""
    encoder, pack = _encoder(tokenizer_json, remembered), _frames(zstandard.ZstdCompressor, dictionary, level=LEVEL)
    done, file = [], None
    width, end = encoder.dtype.itemsize, np.array([END_ID], encoder.dtype).tobytes()
    for rows in batches:
        for a in range(0, rows.num_rows, BATCH_DOCS):
            some = rows.slice(a, BATCH_DOCS).to_pydict()  # ids as whole numbers, null or not
            for key, ids in zip(some["doc_id"], encoder.encode([t or "" for t in some["text"]]), strict=True):
                if file is None:
                    file = _FileWriter(folder, f"{part:07d}-{len(done):05d}.tokz", dictionary, width)
                file.add(key, pack.compress(ids + end), len(ids) // width + 1)
                if file.at >= file_bytes:
                    done, file = [*done, file.close()], None
    if file is not None:
        done.append(file.close())
    return done


def write_files(docs: DataFrame, folder: str, tokenizer_json: str, file_bytes: int = FILE_BYTES, order: tuple[Column, ...] = (), remembered: int | None = None) -> DataFrame:
    """Write all texts (columns doc_id, text) by ``order`` (by default by id, then by text hash);
    the stored list of files, in order of name."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_json)
    fs, at = file_system(folder)
    fs.create_dir(at)
    with fs.open_output_stream(f"{at}/{dictionary_hash(dictionary).hex()}.dictionary") as f:
        f.write(dictionary)
    given = spark.sparkContext.broadcast((tokenizer_json, dictionary))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = write_part(batches, TaskContext.get().partitionId(), folder, *given.value, file_bytes, remembered)
        columns = list(zip(*done, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "n_docs", "n_ids", "bytes"])

    order = [c.alias(f"order_{i}") for i, c in enumerate(order or (F.col("doc_id"), text_key(F.col("text"))))]
    names = [f"order_{i}" for i in range(len(order))]
    rows = docs.select("doc_id", "text", *order).repartitionByRange(*names).sortWithinPartitions(*names)
    return stored(rows.select("doc_id", "text").mapInArrow(write, FILES), "files")


def _index(f, size: int) -> tuple[np.ndarray, int, bytes]:
    f.seek(size - 24)
    n, start = struct.unpack("<QQ", f.read(16))
    if f.read(8) != MAGIC:
        raise ValueError("not a whole file of token ids")
    f.seek(0)
    head = f.read(28)
    f.seek(start)
    return np.frombuffer(f.read(n * INDEX.itemsize), INDEX), struct.unpack("<I", head[24:])[0], head[8:24]


def _dictionary(fs, path: str, key: bytes) -> bytes:
    with fs.open_input_file(f"{os.path.dirname(path)}/{key.hex()}.dictionary") as f:
        words = f.read()
    if dictionary_hash(words) != key:
        raise ValueError("the dictionary is not the one that the file names")
    return words


def read_document(folder: str, file: str, at: int) -> list[int]:
    """The ids of the document at a place in a file's index; reads that frame alone."""
    fs, path = file_system(f"{folder}/{file}")
    with fs.open_input_file(path) as f:
        index, width, key = _index(f, f.size())
        f.seek(int(index[at]["offset"]))
        frame = f.read(int(index[at]["bytes"]))
    ids = _frames(zstandard.ZstdDecompressor, _dictionary(fs, path, key)).decompress(frame)
    return np.frombuffer(ids, f"<u{width}").tolist()


READ = "file string, doc_id long, inside long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    _encoder.cache_clear()  # the worker may have written the files
    for rows in batches:
        for uri in rows["path"]:
            fs, path = file_system(uri)
            with fs.open_input_file(path) as f:
                index, width, key = _index(f, f.size())
                unpack = _frames(zstandard.ZstdDecompressor, _dictionary(fs, path, key))
                sums = []
                for a in range(0, len(index), 1024):
                    part = index[a : a + 1024]
                    first, last = int(part["offset"][0]), int(part["offset"][-1] + part["bytes"][-1])
                    f.seek(first)
                    block = memoryview(f.read(last - first))
                    for o, n in zip((part["offset"] - first).tolist(), part["bytes"].tolist(), strict=True):
                        ids = np.frombuffer(unpack.decompress(block[o : o + n]), f"<u{width}")
                        sums.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            n = np.array([x[0] for x in sums], np.int64)
            yield pd.DataFrame({
                "file": os.path.basename(path), "doc_id": pd.Series(index["id"]).astype("Int64").mask(index["none"] == 1),
                "inside": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [x[1] for x in sums],
            })


def read_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    base = stored(files.select("file", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokz").load(folder).select("path")
    return there.mapInPandas(_read, READ).join(small(base), "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, tokenizer_path: str, folder: str | None = None, order: tuple[Column, ...] = (), remembered: int | None = None) -> DataFrame:
    """Write the documents' ids to ``folder`` (by default a new shared one), read them back.
    ``order``: columns of ``docs`` that the files follow; by default the ids. ``remembered``: bytes of words that each
    worker remembers, by default ``REMEMBERED_BYTES``; fewer take less memory and more time."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-ids")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    return read_files(spark, folder, write_files(docs, folder, tokenizer_json, order=order, remembered=remembered))
