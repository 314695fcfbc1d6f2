"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in Spark, batch by batch; a batch keeps, for every position of its
documents, the number of the word in the batch's own list. The lists are dealt out by a hash of the
word, so that equal words of all batches meet in one partition, where each distinct word is encoded
once. The ids go back to the batches and are joined to the positions. Decoding joins ids with the
pieces of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm import merging, tokens

#: Fixed values of the vocabulary's own splitting rule.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Bytes of text in a batch.
BATCH = 16 << 20
#: Ids of a batch that are decoded and handed to Spark at a time (a longer document by itself).
PART = 1 << 18


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges, pieces and added tokens of a vocabulary file; its size is that of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        if end != WORD_END or spec["decoder"] is not None:
            raise ValueError("a vocabulary with word ends and without a decoder is needed")
        self.pairs = merging.Pairs(*zip(*((ids[a], ids[b], r, ids[a + b]) for r, (a, b) in enumerate(spec["model"]["merges"]))))
        symbols = _byte_symbols()
        self.inner = np.array([ids[c] for c in symbols], np.int64)
        self.final = np.array([ids[c + end] for c in symbols], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.piece = {i: p for p, i in [*ids.items(), *self.added.items()]}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and their offsets."""
        off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        full = off[1:] > off[:-1]
        sym[off[1:][full] - 1] = self.final[raw[off[1:][full] - 1]]
        return merging.merge(sym, off, self.pairs)


class Splitter:
    """Texts to words; the strings of added tokens are words of their own, marked by a leading blank."""

    def __init__(self, added: list[str]):
        self.added = set(added)
        self.cut = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.find = regex.compile(PATTERN).findall

    def plain(self, text: str) -> list[str]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # each character by itself: a final sigma is no special case
        return self.find(text.lower() if "Σ" not in text else "".join(c.lower() for c in text))

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        out = []
        for part in self.cut.split(text):
            out += [" " + part] if part in self.added else self.plain(part)
        return out


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


POSITIONS = "batch string, doc_ids binary, sizes binary, places binary, n_words long"
WORDS = "batch string, shard int, places binary, words binary"


def _batches(records: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    task, k = TaskContext.get().partitionId(), 0
    for b in records:
        _, off = tokens.parts(b.column(1))
        for i, j in tokens.slices(off, BATCH):
            yield f"{task}-{k}", b.slice(i, j - i)
            k += 1


def _split(b: pa.RecordBatch, splitter: Splitter) -> tuple[list[np.ndarray], _Numbers]:
    numbers, at = _Numbers(), []
    for t in b.column(1):
        w = splitter(t.as_py() or "")
        at.append(np.fromiter(map(numbers.__getitem__, w), np.uint32, len(w)))
    return at, numbers


def positions(docs: DataFrame, added: list[str]) -> DataFrame:
    """For each batch the ids of its documents, their sizes in words and the numbers of the words."""
    def run(records):
        s = Splitter(added)
        for name, b in _batches(records):
            at, numbers = _split(b, s)
            ids = b.column(0)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([ids], ["doc_id"]))
            flat = np.concatenate(at) if at else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_pydict({
                "batch": [name], "doc_ids": [sink.getvalue().to_pybytes()], "sizes": [_pack(np.array([len(a) for a in at], np.uint32))],
                "places": [_pack(flat)], "n_words": pa.array([len(numbers)], pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(tokens.lean(run), POSITIONS)


def distinct_words(docs: DataFrame, added: list[str], shards: int) -> DataFrame:
    """The distinct words of each batch with their numbers, dealt to shards by a hash of the word."""
    def run(records):
        s = Splitter(added)
        for name, b in _batches(records):
            _, numbers = _split(b, s)
            raw = [w.encode() for w in numbers]
            shard = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % shards
            order = np.argsort(shard, kind="stable").astype(np.uint32)
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            full = [k for k in range(shards) if cuts[k + 1] > cuts[k]]
            parts = [order[cuts[k]: cuts[k + 1]] for k in full]
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * len(full)), pa.array(full, pa.int32()), pa.array([_pack(p) for p in parts], pa.binary()),
                pa.array([zlib.compress(b"\n".join([raw[i] for i in p]), 1) for p in parts], pa.binary())],
                ["batch", "shard", "places", "words"])

    return docs.select("doc_id", "text").mapInArrow(tokens.lean(run), WORDS)


def encode_words(words: DataFrame, vocabulary) -> DataFrame:
    """Each distinct word of a partition is encoded once; every batch gets the ids of its own words."""
    def run(records):
        v, known = vocabulary.value, {}
        for b in records:
            for name, places, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                listed = zlib.decompress(blob).split(b"\n")
                new = [w for w in listed if w not in known]
                plain = [w for w in new if w[:1] != b" "]
                sym, off = v.encode(plain)
                sym = sym.astype(np.uint32)
                known.update((w, sym[off[i]: off[i + 1]].tobytes()) for i, w in enumerate(plain))
                known.update((w, np.uint32(v.added[w[1:].decode()]).tobytes()) for w in new if w[:1] == b" ")
                ids = [known[w] for w in listed]
                yield pa.RecordBatch.from_pydict({
                    "batch": [name], "places": [places], "sizes": [_pack(np.array([len(x) // 4 for x in ids], np.uint32))],
                    "ids": [zlib.compress(b"".join(ids), 1)]})

    return words.mapInArrow(tokens.lean(run), "batch string, places binary, sizes binary, ids binary")


def _ragged(values: np.ndarray, off: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[off[i]:off[i+1]] for every i of `at`, in one array, and where each ends."""
    size = (off[1:] - off[:-1])[at]
    end = np.cumsum(size)
    if not len(at):
        return values[:0], end
    return values[np.repeat(off[at] - (end - size), size) + np.arange(end[-1])], end


def _joined(position: pa.Table, answers: pa.Table) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Of a batch, from its positions and the answers of all shards: some documents at a time, with
    their ids in one array and where each document's end."""
    p = position.slice(0, 1).to_pylist()[0]
    said = [[c.as_py() for c in answers[name]] for name in ("places", "sizes", "ids")]
    size = np.zeros(p["n_words"], np.int64)
    for places, sizes, _ in zip(*said):
        size[_unpack(places, np.uint32)] = _unpack(sizes, np.uint32)
    if (size == 0).any():
        raise RuntimeError(f"words of batch {p['batch']} were not answered: the input changed between two reads")
    off = np.concatenate([[0], np.cumsum(size)])
    ids = np.empty(off[-1], np.uint32)
    for places, _, got in zip(*said):
        at = _unpack(places, np.uint32).astype(np.int64)
        lead = np.concatenate([[0], np.cumsum(size[at])])
        ids[np.repeat(off[at] - lead[:-1], size[at]) + np.arange(lead[-1])] = _unpack(got, np.uint32)
    doc_ids = pa.ipc.open_stream(p["doc_ids"]).read_all().column(0)
    places, n_words = _unpack(p["places"], np.uint32), _unpack(p["sizes"], np.uint32).astype(np.int64)
    word_end = np.concatenate([[0], np.cumsum(n_words)])
    # by ids before each document, not words: a word may be long
    before = np.concatenate([[0], np.cumsum(size[places])])[word_end]
    for i, j in tokens.slices(before, PART):
        part, end = _ragged(ids, off, places[word_end[i]: word_end[j]].astype(np.int64))
        yield doc_ids.slice(i, j - i).combine_chunks(), part, before[i: j + 1] - before[i]


def decode(ids: np.ndarray, pieces: np.ndarray) -> str:
    """Ids joined with their pieces; pieces are separated by a blank, as the vocabulary has no decoder."""
    return " ".join(pieces[ids].tolist())


def _piece_array(v: Vocabulary) -> np.ndarray:
    pieces = np.empty(max(v.piece) + 1, object)
    for i, p in v.piece.items():
        pieces[i] = p
    return pieces


def _answered(docs: DataFrame, path: str, shards: int | None, finish, schema: str) -> DataFrame:
    """`finish` makes the columns behind doc_id from ids, where each document's end, and the pieces.
    They leave Python as Arrow batches of few documents: a batch of 16 MB of text as lists and
    strings would take some hundred MB of its worker and of the executor beside it."""
    spark = docs.sparkSession
    v = Vocabulary(path)
    vocabulary, pieces = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(_piece_array(v))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shards = shards or 2 * parts
    words = distinct_words(docs, list(v.added), shards).repartition(parts, "shard")
    answers = encode_words(words, vocabulary)
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([pa.RecordBatch.from_arrays([d, *finish(ids, end, pieces.value)], names)
                                     for d, ids, end in _joined(left, right)])
        tokens.give_back()
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return positions(docs, list(v.added)).groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, path: str, shards: int | None = None) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, ids (array<int>), text (decoded). One row for each input
    row; null and empty texts have no ids and an empty decoded text; a null doc_id stays null;
    other columns are ignored. The texts are read twice and must be the same both times."""
    def finish(ids, end, pieces):
        texts = [decode(ids[a:b], pieces) for a, b in zip(end[:-1], end[1:])]
        return pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(texts, pa.string())

    return _answered(docs, path, shards, finish, "ids array<int>, text string")


def digests(docs: DataFrame, path: str, shards: int | None = None) -> DataFrame:
    """As `encode`, with n_tokens, ids_sha256 and decoded_sha256 in place of ids and text."""
    def finish(ids, end, pieces):
        each = [ids[a:b] for a, b in zip(end[:-1], end[1:])]
        return (pa.array(np.diff(end)), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                pa.array([hashlib.sha256(decode(x, pieces).encode()).hexdigest() for x in each], pa.string()))

    return _answered(docs, path, shards, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")
