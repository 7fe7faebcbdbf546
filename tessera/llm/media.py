"""Media columns: texts stored as animated GIFs, read back frame by frame."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import gif

_BINS = 16


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        docs = batch.column(1).cast(pa.binary())
        rows, media, lengths, size = [], [], [], 0
        for i in range(len(docs)):
            data = docs[i].as_py() or b""
            rows.append(i)
            lengths.append(len(data))
            media.append(gif.encode(data.ljust(max(gif.WIDTH, -(-len(data) // gif.WIDTH) * gif.WIDTH))))
            size += len(media[-1])
            if size > 1 << 24:
                yield _stored(ids, rows, lengths, media)
                rows, media, lengths, size = [], [], [], 0
        if rows:
            yield _stored(ids, rows, lengths, media)


def _stored(ids, rows, lengths, media) -> pa.RecordBatch:
    return pa.record_batch([ids.take(pa.array(rows)), pa.array(lengths, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes and media, a GIF of the text's UTF-8 bytes.

    The bytes are padded with spaces to a positive multiple of 192, the frame
    width. Null texts are empty; repeated rows repeat; other columns are
    ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_store, f"doc_id {kind}, n_bytes long, media binary")


def _histogram(canvas: np.ndarray) -> list[int]:
    """Pixels of the composed RGBA canvas by luminance, in equal bins; transparent ones count as black."""
    grey = np.einsum("hwc->hw", canvas[..., :3], dtype=np.uint16) // 3
    return np.bincount((grey >> 4).reshape(-1), minlength=_BINS).tolist()


_FRAME = pa.struct([("frame", pa.int32()), ("delay_ms", pa.int64()), ("at_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64()))])
_FRAMES = "array<struct<frame: int, delay_ms: bigint, at_ms: bigint, width: int, height: int, pixels: binary, histogram: array<bigint>>>"
_FIELDS = [f.name for f in _FRAME]


def frames_of(data: bytes | None) -> list[dict] | None:
    """The timed frames of a GIF; None for null and for damaged data."""
    if data is None:
        return None
    try:
        frames = gif.decode(data)
    except (ValueError, IndexError, struct.error):
        return None
    out, at = [], 0
    for k, f in enumerate(frames):
        values = (k, f.delay_ms, at, f.indices.shape[1], f.indices.shape[0], f.indices.tobytes(), _histogram(f.canvas))
        out.append(dict(zip(_FIELDS, values, strict=True)))
        at += f.delay_ms
    return out


def with_frames(media: DataFrame, column: str = "media", name: str = "frames") -> DataFrame:
    """All columns and ``name``: an array of the GIF's frames (frame, delay_ms, at_ms, width, height, pixels, histogram).

    pixels are the frame's palette indices row by row; histogram counts the
    composed canvas's luminance in 16 equal bins, after palette, transparency
    and disposal. Null and damaged media, and such of more than
    ``gif.MOST_PIXELS`` a picture, have null frames. A column of that name in
    the input is replaced; repeated rows repeat; an empty table gives no rows.
    """
    media = media.drop(name)
    at = media.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, rows = 0, 0, []
            for i in range(batch.num_rows):
                rows.append(frames_of(batch.column(at)[i].as_py()))
                size += sum(len(f["pixels"]) for f in rows[-1] or ())
                if size > 1 << 24 or i + 1 == batch.num_rows:
                    part = batch.slice(begin, len(rows))
                    yield pa.record_batch([*part.columns, pa.array(rows, pa.list_(_FRAME))], names=[*part.schema.names, name])
                    begin, size, rows = i + 1, 0, []

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields), f"`{name}` {_FRAMES}"])
    return media.mapInArrow(run, schema)


def read_frames(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per frame of every GIF: the other columns, then those of a frame as in ``with_frames``.

    Null and damaged media have no frames. Input columns with the name of a
    frame's column are dropped.
    """
    others = [c for c in media.columns if c != column and c not in _FIELDS]
    return with_frames(media.select(*others, column), column, "__frames").select(*others, F.inline("__frames"))


def media_digest(docs: DataFrame) -> DataFrame:
    """store_media, read back frame by frame: sizes, checksums and a feature (frames, milliseconds, summed histogram) of each text's payload.

    One row per row of ``docs``; nulls, repeated rows and empty tables as in
    ``store_media``.
    """
    read = with_frames(store_media(docs))
    payload = F.aggregate("frames", F.lit(b""), lambda s, f: F.concat(s, f["pixels"]))
    counts = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), _BINS), lambda s, f: F.zip_with(s, f["histogram"], lambda a, b: a + b))
    ms = F.aggregate("frames", F.lit(0).cast("long"), lambda s, f: s + f["delay_ms"])
    feature = F.concat(F.lit("frames="), F.size("frames").cast("string"), F.lit(";ms="), ms.cast("string"), F.lit(";hist="), F.array_join(F.transform(counts, lambda n: n.cast("string")), ","))
    read = read.select("doc_id", "n_bytes", "media", payload.alias("payload"), feature.alias("feature"))
    size = F.octet_length("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", size - 15, F.lit(16))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
