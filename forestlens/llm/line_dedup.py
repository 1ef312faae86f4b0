"""Line de-duplication across documents.

Every line is normalised to a key, hashed to 128 bits, and (key, document) rows are reduced to
the smallest and largest document per key: they differ exactly if two documents share the
key, which needs no distinct count and combines before the shuffle, so a line found in a third
of all documents is one row per task. The rows of shared keys are joined back (Spark splits a
hot key's side), gathered per document, and each text is reassembled without them.

Defined results: a null or empty text has one empty line; a null id is one document, ordered
last; rows that share an id are one document; lines of keys under ``min_chars`` code points
always stay; an empty table gives no rows. Other columns are kept and never read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forestlens.llm.common import ASCII_SPACE, cell, id_key, materialize

_SPACE = ASCII_SPACE.encode()


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """The key's 128-bit hash; None if the key (stripped, A-Z lower-cased) is too short."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def line_keys(docs: DataFrame, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """``(h1, h2, doc)``: the distinct line keys of every row."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found, of, size = [], [], 0
            for i, value in zip(ids, _texts(batch.column(1))):
                own = {d for line in value.split(b"\n") if (d := line_digest(line, min_chars))}
                found.extend(own)
                of.extend([i] * len(own))
                size += len(own)
                if size >= 100_000:
                    yield rows(found, of)
                    found, of, size = [], [], 0
            if found:
                yield rows(found, of)

    def rows(found: list[bytes], of: list[int]) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(of, pa.int64())], ["h1", "h2", "doc"])

    return docs.select(id_key(doc_id).alias("doc"), cell(text).alias("text")).mapInArrow(explode, "h1 long, h2 long, doc long")


def dedup_lines(docs: DataFrame, min_chars: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (a struct of all columns), ``kept_text``, ``n_lines``, ``n_dropped`` per row of
    ``docs``. A key found in two or more documents stays only in the smallest."""
    keys = materialize(line_keys(docs, min_chars, doc_id, text), "line-keys")
    shared = keys.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first <> last")
    # written, so that both sides of the next join are plain exchanges: Spark can then split a hot key
    shared = materialize(shared, "line-shared")
    drops = keys.join(shared.select("h1", "h2", "first"), ["h1", "h2"]).filter("doc <> first").groupBy("doc").agg(
        F.collect_set(F.struct("h1", "h2")).alias("drops"))

    @F.arrow_udf("struct<kept_text:string,n_lines:long,n_dropped:long>")
    def reassemble(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, lines, dropped = [], [], []
        for value, own in zip(_texts(texts), drops):
            own = own.as_py()
            parts = value.split(b"\n")
            stay = parts
            if own:
                gone = {np.array([d["h1"], d["h2"]], "<i8").tobytes() for d in own}
                stay = [p for p in parts if line_digest(p, min_chars) not in gone]
            kept.append(b"\n".join(stay) if stay is not parts else value)
            lines.append(len(parts))
            dropped.append(len(parts) - len(stay))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
            ["kept_text", "n_lines", "n_dropped"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       id_key(doc_id).alias("of"), cell(text).alias("own_text"))
    joined = rows.join(drops.hint("shuffle_hash"), F.col("of") == F.col("doc"), "left")
    return joined.select("row", reassemble("own_text", "drops").alias("out")).select("row", "out.*")


def deduplicated_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """``docs`` with each text replaced by what stays of it (and ``n_chars`` counted anew)."""
    out = dedup_lines(docs, text=text, **options)
    new = {text: F.col("kept_text")} | ({n_chars: F.length("kept_text").cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
