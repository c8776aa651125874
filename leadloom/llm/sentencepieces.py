"""SentencePiece encoding with byte offsets, and decoding.

Encoding normalises a text by longest prefixes of the compiled character map
and records which source byte every normalised byte comes from; pieces found
by byte-pair merging of the normalised text are then projected to spans of
bytes of the original text (end exclusive). Of a character that is written as
bytes, the last byte piece has the whole character as its span and the others
are empty. Where the model has no character map, the projection is read from
the lengths of the pieces, for many texts at once, with no array for each byte.
The digest of spans is that of all starts, a semicolon and all ends.

``coded`` encodes, projects, decodes the ids again and makes digests in one
pass, so that only what is asked for leaves the Python worker. Texts are taken
in groups of bounded size; words of a group that are not in the cache are
merged side by side.

Cases: a null text counts as empty and has no pieces; texts are encoded whole;
repeated rows stay; an empty table gives an empty result; all columns of the
input are kept, but a new column takes the place of one with its name.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, other_names, released, table, tokenizer_path
from .pieces import BYTE, CONTROL, MARK, UNKNOWN, Cache, PieceModel, load


class Encoder:
    """Ids and spans of texts; words that were seen come from a cache."""

    def __init__(self, model: PieceModel):
        self.model = model
        #: the ids of a word as little-endian 32-bit numbers, so that those of a text are one join
        self.cache = Cache(lambda word: np.array(model.encode(word), dtype="<i4").tobytes())
        #: bytes of the source that a piece covers (byte pieces: none yet), and the byte of a byte piece, else -1
        self.width = np.array([0 if k == BYTE else len(p.replace(MARK, " ").encode()) for p, k in zip(model.pieces, model.kinds)], np.int32)
        self.byte = np.array([int(p[3:5], 16) if k == BYTE else -1 for p, k in zip(model.pieces, model.kinds)], np.int16)

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.model.words(self.model.normalized(text or ""))))

    def packed_all(self, texts: list[str | None]) -> list[bytes]:
        """``packed`` of a group of texts; words that are not known yet are merged together."""
        words = [self.model.words(self.model.normalized(t or "")) for t in texts]
        long = self.cache.fill(itertools.chain.from_iterable(words), self.model.encode_all)
        out = [b"".join(map(self.cache.__getitem__, ws)) for ws in words]
        for w in long:
            del self.cache[w]
        return out

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<i4").tolist()

    def spans(self, text: str | None, ids: list[int]) -> tuple[list[int], list[int]]:
        """First byte and end of each piece in the UTF-8 of ``text``."""
        starts, ends = self.all_spans([text], np.array(ids, "<i4"), np.array([0, len(ids)]))
        return starts.tolist(), ends.tolist()

    def all_spans(self, texts: list[str | None], ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``spans`` of many texts, one after the other; the ids of text k are ``ids[cuts[k] : cuts[k + 1]]``."""
        width, byte = self.width[ids], self.byte[ids]
        lead = np.flatnonzero((byte >= 0) & (byte & 0xC0 != 0x80))
        size = 1 + sum((byte[lead] >= b).astype(np.int32) for b in (0xC0, 0xE0, 0xF0))
        width[lead + size - 1] = size
        ends = np.cumsum(width, dtype=np.int32)
        before = np.concatenate([np.zeros(1, np.int32), ends])[cuts[:-1]] + np.int32(self.model.dummy_prefix)
        ends -= np.repeat(before, np.diff(cuts))
        starts = np.maximum(ends - width, 0)
        ends = np.maximum(ends, 0)
        for k, text in enumerate(texts):
            if not self.model.plain or MARK in (text or ""):
                mine = slice(cuts[k], cuts[k + 1])
                starts[mine], ends[mine] = self._aligned(text or "", ids[mine].tolist())
        return starts, ends

    def _aligned(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """Spans by the source byte of every normalised byte."""
        kinds, pieces = self.model.kinds, self.model.pieces
        normal, source = self.model.normalize(text)
        starts, ends, at, i = [], [], 0, 0
        while i < len(ids):
            if kinds[ids[i]] != BYTE:
                starts.append(source[at])
                at += len(pieces[ids[i]].encode())
                ends.append(source[at])
                i += 1
                continue
            b = normal[at]
            size = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            starts += [source[at]] * size
            ends += [source[at]] * (size - 1) + [source[at + size]]
            at += size
            i += size
        return starts, ends


class Decoder:
    def __init__(self, model: PieceModel):
        self.model = model
        self.bytes = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else model.unk_surface.encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for p, k in zip(model.pieces, model.kinds)
        ]

    def decode(self, ids: list[int]) -> str:
        return self.joined(ids, list(map(self.bytes.__getitem__, ids)))

    def joined(self, ids: list[int], parts: list[bytes]) -> str:
        kinds = self.model.kinds
        if self.model.dummy_prefix or self.model.trim:
            for k, i in enumerate(ids):
                if kinds[i] == CONTROL:
                    continue
                if kinds[i] not in (BYTE, UNKNOWN) and self.model.pieces[i].startswith(MARK):
                    parts[k] = parts[k].lstrip(b" ") if self.model.trim else parts[k][1:]
                break
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return self._with_faults(ids, parts)

    def _with_faults(self, ids: list[int], parts: list[bytes]) -> str:
        """Runs of byte pieces by themselves; every byte of no character becomes U+FFFD."""
        out, run = [], b""
        for i, part in [*zip(ids, parts), (None, b"")]:
            if i is not None and self.model.kinds[i] == BYTE:
                run += part
                continue
            at = 0
            while at < len(run):
                b = run[at]
                size = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
                try:
                    out.append(run[at : at + size].decode())
                    at += size
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            run = b""
            out.append(part.decode())
        return "".join(out)


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    return Encoder(load(path))


#: Texts are coded in groups of so many documents or characters.
GROUP_DOCS, GROUP_CHARS = 512, 1_000_000
_INTS = T.ArrayType(T.IntegerType())
CODED = {
    "n_tokens": T.LongType(), "ids": _INTS, "starts": _INTS, "ends": _INTS, "decoded": T.StringType(),
    "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "spans_sha256": T.StringType(),
}


@functools.lru_cache(maxsize=1)
def _numbers() -> list[bytes]:
    """The decimal numbers below 65536, each with a comma."""
    return [b"%d," % n for n in range(65_536)]


def _decimal(numbers: np.ndarray) -> bytes:
    """Decimal numbers, each with a comma after it."""
    values = numbers.tolist()
    if not values or max(values) < 65_536:
        return b"".join(map(_numbers().__getitem__, values))
    return b"".join([b"%d," % n for n in values])


def _spans_text(starts: np.ndarray, ends: np.ndarray) -> bytes:
    """All starts, a semicolon and all ends."""
    last = _decimal(ends)
    if len(starts) and (starts[1:] == ends[:-1]).all():  # each piece starts where the one before ends
        first = b"%d," % starts[0] + last[: last.rindex(b",", 0, -1) + 1] if len(starts) > 1 else b"%d," % starts[0]
    else:
        first = _decimal(starts)
    return first[:-1] + b";" + last[:-1]


class Coder:
    """The columns of ``CODED`` for groups of texts."""

    def __init__(self, path: str):
        self.encoder, self.decoder = encoder_of(path), Decoder(load(path))

    def columns(self, texts: list[str | None], wanted: tuple[str, ...]) -> dict[str, pa.Array]:
        packed = self.encoder.packed_all(texts)
        cuts = np.cumsum([0, *[len(x) // 4 for x in packed]]).astype(np.int32)
        flat = np.frombuffer(b"".join(packed), dtype="<i4")
        parts = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        out: dict[str, pa.Array] = {"n_tokens": pa.array(np.diff(cuts), pa.int64()), "ids": pa.ListArray.from_arrays(cuts, flat)}
        if "ids_sha256" in wanted:
            out["ids_sha256"] = pa.array([sha(_decimal(flat[p])[:-1]) for p in parts])
        if {"starts", "ends", "spans_sha256"} & {*wanted}:
            starts, ends = self.encoder.all_spans(texts, flat, cuts)
            out |= {"starts": pa.ListArray.from_arrays(cuts, starts), "ends": pa.ListArray.from_arrays(cuts, ends)}
            if "spans_sha256" in wanted:
                out["spans_sha256"] = pa.array([sha(_spans_text(starts[p], ends[p])) for p in parts])
        if {"decoded", "decoded_sha256"} & {*wanted}:
            decoded = [self.decoder.decode(flat[p].tolist()) for p in parts]
            out["decoded"] = pa.array(decoded, pa.string())
            if "decoded_sha256" in wanted:
                out["decoded_sha256"] = pa.array([sha(x.encode()) for x in decoded])
        return {k: out[k] for k in wanted}


def coded(df: DataFrame, wanted: tuple[str, ...], text: str = "text", model: str | None = None, keep_text: bool = True) -> DataFrame:
    """``df`` with the columns ``wanted`` of ``CODED`` added; without ``keep_text`` the text is left out."""
    path = model or tokenizer_path()
    names = other_names([c for c in df.columns if keep_text or c != text], wanted)
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(k, CODED[k]) for k in wanted]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for part, texts in in_batches(batches, "__text", GROUP_DOCS, GROUP_CHARS):
            new = coder.columns(texts, wanted)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new.values()], names=[*names, *wanted])
        released()

    return rows.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", model: str | None = None, spans: bool = True, ids: str = "ids") -> DataFrame:
    """``df`` with ids array<int>, and with ``spans`` starts and ends array<int> (bytes of the source), added."""
    out = coded(df, ("ids", "starts", "ends") if spans else ("ids",), text, model)
    return out if ids == "ids" else out.withColumnRenamed("ids", ids)


def decode(df: DataFrame, ids: str = "ids", model: str | None = None, text: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` added; null ids count as none."""
    path = model or tokenizer_path()
    names = other_names(df.columns, (text,))
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(ids).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load(path))
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_DOCS):
                part = batch.slice(at, GROUP_DOCS)
                column = part.column("__ids")
                flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
                ends = np.cumsum([0, *[x or 0 for x in column.value_lengths().to_pylist()]]).tolist()
                new = pa.array([decoder.decode(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], new], names=[*names, text])
        released()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(text, T.StringType())]))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return coded(docs, ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"), keep_text=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` but the text, with its ids and their spans, and the digests of ids, decoded text and spans."""
    return coded(docs, ("n_tokens", "ids", "starts", "ends", "ids_sha256", "decoded_sha256", "spans_sha256"), keep_text=False)
