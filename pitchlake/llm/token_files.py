"""Token ids as Arrow stream files of equal-length sequences, with masks, that are read without copying.

Documents are dealt out in ascending order of their id (one range shuffle of the texts, sorted inside each partition); the
task that holds a range encodes it and writes one pair of files, so ids never travel. ``ids-NNNNN.arrow`` is an Arrow stream
whose batches all have ``ROWS`` rows of fixed-size lists: ``ids`` (``length`` token ids), ``mask`` (true where an id is real,
false in the padding at the end of a file) and ``ends`` (true at the last id of a document). As no batch is compressed and all
but the last have the same number of bytes, batch k begins at ``head + k * step``: ``TokenFiles`` maps the files and returns
sequence i as views into the map. ``docs-NNNNN.arrow`` holds the ids of the file's documents in order. ``manifest`` has one row
a file. A document lies in one file, over as many sequences as it needs; documents follow each other without padding.

Files are written under a name of the attempt and then renamed, so an executor lost halfway leaves nothing that is read.

Words between blanks are encoded by the tokenizers library alone and remembered: the tokenizers this is for never join
across a blank, and a special string has none in it. ``check_splittable`` refuses other tokenizer files.

Defined results: a null text counts as empty and has the end id alone; null document ids come first; rows with one id follow
in the order of their texts' hashes, equal rows next to each other; every row is a document of its own; an empty table writes no
file and reads as an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pitchlake.llm.storage import shared_dir, tidy

#: Bytes of texts that are encoded together.
PORTION = 12 << 20
#: Ids of a sequence, sequences of a batch.
LENGTH = 2048
ROWS = 32
#: Words that a worker remembers before it starts anew.
MAX_WORDS = 1_500_000
#: Words of letters that are one piece of the splitting pattern, whatever their case, and ASCII marks behind them, which are
#: another: all but the apostrophe, which may open a contraction.
PLAIN = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ÿ]{1,64})([!-&(-/:-@\[-`{-~]*)")
MAX_TAILS = 10_000
#: Characters of a longer text that are encoded at a time.
STRETCH = 1 << 20
#: Bytes of ids that a reader hands on at a time.
READ_BYTES = 8 << 20

MANIFEST = "shard long, n_docs long, n_ids long, n_sequences long"


def check_splittable(path: str) -> None:
    """Words may be encoded alone where the pattern drops white space and special strings hold none."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]) for t in spec["added_tokens"])
    dropped = split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and r"[^\s" in split["pattern"]["Regex"]
    lowered = any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
    if not (plain and dropped and lowered and spec.get("post_processor") is None and spec["truncation"] is None and spec["padding"] is None):
        raise ValueError(f"{path}: this tokenizer may join across white space")


class Words(dict):
    """Plain word in lower case -> its ids as bytes, as the library gives them. A worker keeps it for all its tasks.

    Plain words, of Latin letters alone, are one piece each of the splitting pattern and the tokenizer lowers their case: new ones
    are encoded by one call, as words of one line, and its pieces are theirs in order; marks behind one are a piece of their own.
    Other words are encoded one by one.
    """

    def __init__(self, path: str, dtype: np.dtype):
        super().__init__()
        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.tails: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def of(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        if len(self) > MAX_WORDS:
            self.clear()
        out, new, later = list(map(self.get, words)), set(), []
        for i, word in enumerate(words):
            if out[i] is None:
                if m := PLAIN.fullmatch(word):
                    core, tail = m[1].lower(), self.tail(m[2])
                    if (known := self.get(core)) is not None:
                        out[i] = known + tail
                    else:
                        new.add(core)
                        later.append((i, core, tail))
                else:
                    out[i] = self._ids(word).tobytes()
        if new:
            self._encode_plain(list(new))
        for i, core, tail in later:
            out[i] = self[core] + tail
        return out

    def tail(self, marks: str) -> bytes:
        if (found := self.tails.get(marks)) is None:
            found = self._ids(marks).tobytes()
            if len(self.tails) < MAX_TAILS:
                self.tails[marks] = found
        return found

    def _encode_plain(self, new: list[str]) -> None:
        coded = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        ids, owner = np.array(coded.ids, dtype=self.dtype), np.array(coded.word_ids)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(ids)]])
        raw, cuts = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
        self.update((w, raw[a:b]) for w, a, b in zip(new, cuts[:-1], cuts[1:], strict=True))

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text: different words are looked up once, and the texts' ids gathered from theirs."""
        for mark in "\n\t\r":
            texts = pa.compute.replace_substring(texts, mark, " ")
        lists = pa.compute.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        parts = self.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(parts), dtype=self.dtype)
        sizes = np.fromiter(map(len, parts), dtype="int64", count=len(parts)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        word = coded.indices.to_numpy()
        lengths = sizes[word]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        gathered = ids[np.repeat(starts[word] - ends[:-1], lengths) + np.arange(ends[-1])]
        cuts = ends[np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])]
        for begin, end in zip(cuts.tolist(), cuts[1:].tolist()):
            yield gathered[begin:end]

    def stretches(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a long text, a stretch of it at a time."""
        begin = 0
        while begin < len(text):
            end = len(text) if len(text) - begin <= STRETCH else text.find(" ", begin + STRETCH)
            end = len(text) if end < 0 else end
            yield from self.texts(pa.array([text[begin:end]]))
            begin = end


def portions(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``PORTION`` bytes; a longer one is a run of its own."""
    sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
    begin = held = 0
    for at, size in enumerate(sizes.tolist()):
        if at > begin and held + size > PORTION:
            yield texts.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    if begin < len(texts):
        yield texts.slice(begin)


_KNOWN: dict[tuple[str, str], Words] = {}


def known_words(path: str, dtype: np.dtype) -> Words:
    """This worker's words of a tokenizer file."""
    key = (path, dtype.str)
    if key not in _KNOWN:
        _KNOWN[key] = Words(path, dtype)
    return _KNOWN[key]


def id_type(path: str, end_id: int) -> np.dtype:
    """Two bytes an id where the vocabulary allows it."""
    return np.dtype("<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    flags = pa.list_(pa.bool_(), length)
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", flags), ("ends", flags)])


class SequenceWriter:
    """Gathers ids and writes a batch whenever it is full."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.length, self.schema = length, _schema(dtype, length)
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.ids, self.ends = np.zeros(length * rows, dtype), np.zeros(length * rows, bool)
        self.filled = self.n_ids = self.n_sequences = 0

    def add(self, ids: np.ndarray) -> None:
        while len(ids):
            part, ids = ids[: len(self.ids) - self.filled], ids[len(self.ids) - self.filled :]
            self.ids[self.filled : self.filled + len(part)] = part
            self.filled += len(part)
            self.n_ids += len(part)
            if self.filled == len(self.ids):
                self._flush()

    def end(self, end_id: int) -> None:
        self.ends[self.filled] = True
        self.add(np.array([end_id], self.ids.dtype))

    def _flush(self) -> None:
        rows = -(-self.filled // self.length)
        size = rows * self.length
        self.ids[self.filled :] = 0
        columns = (self.ids[:size], np.arange(size) < self.filled, self.ends[:size])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(c.copy()), self.length) for c in columns]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += rows
        self.filled = 0
        self.ends[:] = False

    def close(self) -> None:
        if self.filled:
            self._flush()
        self.out.close()


def _names(folder: str, shard: int) -> tuple[str, str]:
    return f"{folder}/ids-{shard:05d}.arrow", f"{folder}/docs-{shard:05d}.arrow"


def write(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    folder: str | None = None,
    length: int = LENGTH,
    rows: int = ROWS,
) -> str:
    """Write the ids of all documents, each followed by ``end_id``; returns the folder."""
    spark, path = df.sparkSession, public_tokenizers.path(tokenizer)
    check_splittable(path)
    dtype = id_type(path, end_id)
    folder = (folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")
    id_type_ = pa.schema(df.select(df[id_col].alias("id")).limit(0).toArrow().schema).field("id").type

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        shard, attempt = TaskContext.get().partitionId(), f".{TaskContext.get().taskAttemptId()}.part"
        names, words, n_docs = _names(place, shard), known_words(path, dtype), 0
        with store.open_output_stream(names[0] + attempt) as ids_sink, store.open_output_stream(names[1] + attempt) as docs_sink:
            out = SequenceWriter(ids_sink, dtype, length, rows)
            docs = pa.ipc.new_stream(docs_sink, pa.schema([("id", id_type_)]))
            for batch in itertools.chain([first], batches):
                docs.write_batch(pa.record_batch([batch.column("id").cast(id_type_)], names=["id"]))
                n_docs += batch.num_rows
                for part in portions(batch.column("text")):
                    if len(part) == 1 and len(part[0].as_py()) > STRETCH:
                        for ids in words.stretches(part[0].as_py()):
                            out.add(ids)
                        out.end(end_id)
                        continue
                    for ids in words.texts(part):
                        out.add(ids)
                        out.end(end_id)
            out.close()
            docs.close()
        for name in names:
            store.move(name + attempt, name)
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "n_docs": [n_docs], "n_ids": [out.n_ids], "n_sequences": [out.n_sequences]}
        )

    text = F.coalesce(df[text_col], F.lit(""))
    docs = df.select(df[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["id", "tie", "row"]  # the row parts equal rows, should one be a third of the table
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    manifest = dealt.mapInArrow(tidy(work), MANIFEST).toArrow()  # a row a file
    spark.createDataFrame(manifest.to_pylist(), MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> list[dict]:
    """One entry a file in order, with the ids and sequences of all files before it."""
    found = [r.asDict() for r in spark.read.parquet(f"{folder}/manifest").collect()]
    start = first = 0
    for entry in sorted(found, key=lambda r: r["shard"]):
        entry |= {"start": start, "first_sequence": first}
        start, first = start + entry["n_ids"], first + entry["n_sequences"]
    return sorted(found, key=lambda r: r["shard"])


def flat(column: pa.Array) -> np.ndarray:
    """The values of a column of fixed-size lists; flags are packed bits and must be copied."""
    values = column.flatten()
    return values.to_numpy(zero_copy_only=not pa.types.is_boolean(values.type))


def read_documents(spark: SparkSession, folder: str, id_type: T.DataType | str = "long") -> DataFrame:
    """(id, start, ids): every document as the files hold it; ids are little-endian unsigned 32-bit integers with the end id,
    ``start`` is the number of ids before them."""
    kind = id_type if isinstance(id_type, str) else id_type.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, start in ((r["shard"], r["start"]) for b in batches for r in b.to_pylist()):
            store, place = fs.FileSystem.from_uri(folder)
            names = _names(place, shard)
            with store.open_input_stream(names[1]) as f:
                doc_ids = pa.ipc.open_stream(f).read_all().column("id")
            with store.open_input_stream(names[0]) as f:
                nth, held, open_ids, size = 0, [], [], 0
                for batch in pa.ipc.open_stream(f):
                    real = flat(batch.column("mask"))
                    ids = flat(batch.column("ids"))[real].astype("<u4")
                    begin = 0
                    for end in np.flatnonzero(flat(batch.column("ends"))[real]) + 1:
                        whole = b"".join([*open_ids, ids[begin:end].tobytes()])
                        held.append((start, whole))
                        begin, open_ids, start, size = end, [], start + len(whole) // 4, size + len(whole)
                        if size >= READ_BYTES:
                            yield _documents(doc_ids.slice(nth, len(held)), held)
                            nth, held, size = nth + len(held), [], 0
                    open_ids.append(ids[begin:].tobytes())
                if held:
                    yield _documents(doc_ids.slice(nth, len(held)), held)

    files = [(e["shard"], e["start"]) for e in manifest(spark, folder)]
    dealt = spark.createDataFrame(files, "shard long, start long").repartitionByRange(max(1, len(files)), "shard")
    return dealt.mapInArrow(tidy(work), f"id {kind}, start long, ids binary")


def _documents(doc_ids: pa.ChunkedArray, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    starts, ids = zip(*held)
    return pa.record_batch([doc_ids.combine_chunks(), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["id", "start", "ids"])


class TokenFiles:
    """Random access to the sequences of a folder that this machine can map: ``files[i]`` is (ids, mask), ids a view."""

    def __init__(self, folder: str, entries: list[dict]):
        self.place = fs.FileSystem.from_uri(folder)[1]
        self.entries = entries
        self.firsts = np.array([e["first_sequence"] for e in entries], dtype="int64")
        self.opened: dict[int, tuple] = {}

    def __len__(self) -> int:
        return int(self.firsts[-1] + self.entries[-1]["n_sequences"]) if self.entries else 0

    def _open(self, shard: int) -> tuple:
        """(map, schema, where the first batch begins, bytes of a batch, rows of a batch)."""
        if shard not in self.opened:
            source = pa.memory_map(_names(self.place, shard)[0])
            schema = pa.ipc.read_schema(source)
            head = source.tell()
            rows = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema).num_rows
            self.opened[shard] = (source, schema, head, source.tell() - head, rows)
        return self.opened[shard]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = int(np.searchsorted(self.firsts, i, side="right")) - 1
        source, schema, head, step, rows = self._open(self.entries[at]["shard"])
        k, row = divmod(i - int(self.firsts[at]), rows)
        source.seek(head + k * step)
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
        return flat(batch.column("ids").slice(row, 1)), flat(batch.column("mask").slice(row, 1))
