"""BPE encoding and decoding through a distinct-word table.

A text is cut where a character that is no white space is followed by ASCII
white space: the tokenizer's own pattern always cuts there, so each chunk (white
space, then the word) has the same ids alone as in the text.  Chunks are counted
over all texts, the distinct chunks of the table are encoded once each by the
library, and the ids come back by position.  Ids become text again through an
id-to-piece table, whose size is the vocabulary's.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import map_batches, texts_of, written
from examlake.llm.words import HEAD, count_pieces, head_of

_CHUNK = re.compile(rb"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
#: Characters that a Unicode class of white space may hold beyond the six ASCII ones.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer, once in each process; truncation and padding are off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=4)
def specials(path: str) -> re.Pattern | None:
    """A pattern of the added tokens' strings, which the library finds inside texts."""
    found = sorted((x.content for x in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


def chunks(text: bytes, path: str) -> list[bytes]:
    """The chunks of a text, which joined give the text and encoded one by one give its ids.

    Texts with added tokens or with white space beyond ASCII are cut by the
    library's own splitter.
    """
    s = text.decode("utf-8", "replace")
    held = specials(path)
    if not (held and held.search(s)) and not _ODD.search(s):
        return _CHUNK.findall(text)
    t, out, at = tokenizer(path), [], 0
    for m in [*(held.finditer(s) if held else ()), None]:
        part = s[at : m.start() if m else len(s)]
        out += [part[a:b].encode() for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(part)] if part else []
        if m:
            out.append(m[0].encode())
            at = m.end()
    return out


def width(path: str) -> str:
    """The narrowest integers that hold the vocabulary's ids."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 0x10000 else "<u4"


def encode_pieces(pieces: list[bytes], path: str) -> list[bytes]:
    """The ids of each piece as little-endian integers of ``width(path)``."""
    kind = width(path)
    return [np.asarray(x.ids, kind).tobytes() for x in tokenizer(path).encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]


class Chunks:
    """A chunk table as two Arrow columns; each worker makes its dictionary once, the driver none."""

    def __init__(self, pieces: pa.Array, ids: pa.Array):
        self.pieces, self.ids = pieces, ids

    def table(self) -> dict[bytes, bytes]:
        if self.pieces is not None:
            self.of = dict(zip(self.pieces.to_pylist(), self.ids.to_pylist(), strict=True))
            self.pieces = self.ids = None
        return self.of


def chunk_table(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """``piece, ids``: the most frequent distinct chunks of all texts, at most ``head``, each encoded once."""
    counts = written(count_pieces(docs, lambda text: chunks(text, path)), "chunks")

    def ids_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(encode_pieces(batch.column("piece").to_pylist(), path), pa.binary())], ["piece", "ids"])

    return map_batches(head_of(counts, head)[0].select("piece"), ids_of, "piece binary, ids binary")


def encode(docs: DataFrame, path: str, key: str = "doc_id", head: int = HEAD) -> DataFrame:
    """``key, ids binary``: each text's ids as little-endian unsigned 32-bit integers.

    Columns beyond ``key`` and ``text`` are ignored; rows may repeat and keys
    may be null.  Null and empty texts have no ids; texts of any length are
    encoded whole; an empty frame gives an empty frame.  ``head`` bounds the
    broadcast chunk table.  Every chunk of the table is encoded once; each of
    the rare chunks beyond it is encoded where it stands, because a join by
    position would shuffle every text twice for their sake.
    """
    kind = width(path)
    rows = docs.select(F.col(key).alias("key"), "text")
    found = chunk_table(rows, path, head).toArrow()
    known = docs.sparkSession.sparkContext.broadcast(Chunks(*(found[c].cast(pa.large_binary()).combine_chunks() for c in ("piece", "ids"))))

    def look_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, out = known.value.table(), []
        for text in texts_of(batch):
            pieces = chunks(text, path)
            parts = list(map(of.get, pieces))
            if None in parts:
                rare = list({x for x, part in zip(pieces, parts, strict=True) if part is None})
                own = dict(zip(rare, encode_pieces(rare, path), strict=True))
                parts = [own[x] if part is None else part for x, part in zip(pieces, parts, strict=True)]
            out.append(np.frombuffer(b"".join(parts), kind).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "ids"])

    return map_batches(rows, look_up, f"key {rows.schema['key'].dataType.simpleString()}, ids binary").withColumnRenamed("key", key)


def id_pieces(spark, path: str) -> DataFrame:
    """``id int, piece binary``: the bytes of each id; one row for each id of the vocabulary."""
    t = tokenizer(path)
    special = {i: x.content.encode() for i, x in t.get_added_tokens_decoder().items()}
    byte = _byte_of()
    return spark.createDataFrame([(i, special[i] if i in special else bytes(byte[c] for c in piece)) for piece, i in t.get_vocab(with_added_tokens=True).items()], "id int, piece binary")


def _byte_of() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable bytes stand for themselves, the others follow from 256 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded string``, the text of ``ids``, by a map-side join with the id-to-piece table.

    The table has a row for each id of the vocabulary, which bounds the
    broadcast whatever the corpus.  Invalid UTF-8 becomes U+FFFD; no ids give
    an empty text.
    """
    pieces = {r["id"]: bytes(r["piece"]) for r in id_pieces(encoded.sparkSession, path).collect()}
    table = encoded.sparkSession.sparkContext.broadcast([pieces.get(i, b"") for i in range(max(pieces) + 1)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = table.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(of, np.frombuffer(x.as_py() or b"", "<u4").tolist())).decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(join, f"{kinds}, decoded string")
