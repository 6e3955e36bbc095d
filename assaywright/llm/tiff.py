"""TIFF columns: op7. Image directories are walked, strips and tiles are decoded (none, PackBits, LZW, deflate), predictors are undone,
and one row is made for each page; images of 8-bit samples can also be written.

Broken files give no rows or stop at the broken page; nothing outside the file's bytes is read, and a page that says it has more samples
than its stored bytes could hold by the best its compression can do is a broken one. There is no other limit on a page.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import flat_utf8, ready, released, table

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Field types of the format: bytes and struct letter.
_TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_SIZE, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_SIZE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
#: Samples in a row of the pages that the query writes, and rows in a strip.
ROW, STRIP_ROWS = 64, 256
#: The most bytes that one stored byte can stand for: a deflate code of one bit for 258, an LZW code of 12 bits for 4096 - 256, a pair for 128.
_MOST = {NONE: 1, PACKBITS: 64, LZW: 2560, DEFLATE: 2064, OLD_DEFLATE: 2064}


# ---- compression
def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        i += 1
        if c < 128:
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128:
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes([257 - (j - i), data[i]])
        else:
            while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, most: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early. Ends at `most` bytes."""
    out = bytearray()
    words = [bytes([i]) for i in range(256)] + [b"", b""]
    width, held, bits, last = 9, 0, 0, None
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257 or len(out) >= most:
            break
        if code == 256:
            del words[258:]
            width, last = 9, None
            continue
        if last is None:
            word = words[code]
        elif code < len(words):
            word = words[code]
            words.append(last + word[:1])
        elif code == len(words):
            word = last + last[:1]
            words.append(word)
        else:
            raise ValueError("bad LZW code")
        out += word
        last = word
        if len(words) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out[:most])


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    codes: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1

    def reset() -> None:
        nonlocal codes, width
        put(256)
        codes, width = {bytes([i]): i for i in range(256)}, 9

    reset()
    word, free = b"", 258
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in codes:
            word = more
            continue
        put(codes[word])
        codes[more] = free
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
        if free >= 4094:
            reset()
            free = 258
        word = data[i : i + 1]
    if word:
        put(codes[word])
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 0xFF)
    return bytes(out)


def _inflate(data: bytes, compression: int, most: int) -> bytes:
    if compression == NONE:
        return data[:most]
    if compression == PACKBITS:
        return packbits_decode(data)[:most]
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise ValueError(f"compression {compression} is not supported")


# ---- directories
def _directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    if len(raw) < 8 or raw[:2] not in (b"II", b"MM"):
        return
    order = "<" if raw[:2] == b"II" else ">"
    if struct.unpack_from(order + "H", raw, 2)[0] != 42:
        return
    at, seen = struct.unpack_from(order + "I", raw, 4)[0], set()
    while at and at not in seen and at + 2 <= len(raw):
        seen.add(at)
        n = struct.unpack_from(order + "H", raw, at)[0]
        if at + 2 + 12 * n + 4 > len(raw):
            return
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            if kind not in _TYPES:
                continue
            size, letter = _TYPES[kind]
            where = at + 2 + 12 * i + 8
            if size * count > 4:
                where = struct.unpack_from(order + "I", raw, where)[0]
            if where + size * count > len(raw):
                continue
            tags[tag] = struct.unpack_from(f"{order}{count * len(letter)}{letter[0]}", raw, where)
        yield order, tags
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def _unpredict(block: np.ndarray, predictor: int) -> np.ndarray:
    """Undo horizontal differences; block is (rows, columns, samples) of an unsigned type."""
    return np.cumsum(block, axis=1, dtype=block.dtype) if predictor == 2 else block


def _unpredict_float(raw: np.ndarray, rows: int, cols: int, samples: int, order: str, size: int) -> np.ndarray:
    """Undo floating-point prediction: rows hold the values' bytes by significance, as differences."""
    flat = raw.reshape(rows, cols * samples * size)
    flat = np.cumsum(flat.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, cols * samples)
    return np.ascontiguousarray(flat.transpose(0, 2, 1)).reshape(rows, cols, samples, size)[..., :: 1 if order == ">" else -1].copy().view(f"{order}f{size}")[..., 0]


def read_pages(raw: bytes) -> Iterator[dict]:
    """Each page's width, height, samples, bits and pixels, (height, width, samples), in the file's order. Ends at a page it can't read."""
    for page, (order, tags) in enumerate(_directories(raw)):
        one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
        width, height, samples, compression, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        bits = one(BITS, 1)
        floats = tags.get(339, (1,))[0] == 3
        if len(set(tags.get(BITS, (1,)))) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64) or compression not in _MOST:
            return
        kind = np.dtype(f"{order}{'f' if floats else 'u'}{max(1, bits // 8)}")
        planes = samples if one(PLANAR, 1) == 2 and samples > 1 else 1
        each = samples // planes
        tiled = TILE_AT in tags
        bw, bh = (one(TILE_W, 0), one(TILE_H, 0)) if tiled else (width, min(one(ROWS, height), height))
        at, sizes = tags.get(TILE_AT if tiled else STRIP_AT, ()), tags.get(TILE_SIZE if tiled else STRIP_SIZE, ())
        if not (width and height and bw and bh):
            return
        across, down = -(-width // bw), -(-height // bh)
        if min(len(at), len(sizes)) < across * down * planes:
            return
        used = sum(sizes[: across * down * planes])
        if used > len(raw) or height * (width * samples * bits // 8) > used * _MOST[compression]:
            return
        pixels = np.zeros((height, width, samples), kind)
        try:
            for k in range(across * down * planes):
                plane, y, x = k // (across * down), k % (across * down) // across * bh, k % across * bw
                rows = bh if tiled else min(bh, height - y)
                line = -(-bw * each * bits // 8)
                data = _inflate(raw[at[k] : at[k] + sizes[k]], compression, rows * line)
                data = np.frombuffer(data.ljust(rows * line, b"\0"), np.uint8)
                if bits < 8:
                    b = np.unpackbits(data.reshape(rows, line), axis=1).reshape(rows, -1, bits)
                    block = (b * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)[:, : bw * each].astype(np.uint8).reshape(rows, bw, each)
                elif predictor == 3:
                    block = _unpredict_float(data, rows, bw, each, order, bits // 8)
                else:
                    block = data.view(kind).reshape(rows, bw, each)
                    if predictor == 2:
                        block = _unpredict(block.astype(block.dtype.newbyteorder("=")), 2)
                part = block[: height - y, : width - x]
                pixels[y : y + part.shape[0], x : x + part.shape[1], plane * each : (plane + 1) * each] = part
        except (ValueError, zlib.error, IndexError):
            return
        yield {"page": page, "width": width, "height": height, "samples": samples, "bits": bits, "pixels": pixels}


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = STRIP_ROWS, tile: int = 0, order: str = "<") -> bytes:
    """A TIFF of 8-bit pages, each (height, width) or (height, width, samples), in strips, or in tiles of tile x tile."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in pages:
        px = np.asarray(image, np.uint8)
        px = px[:, :, None] if px.ndim == 2 else px
        h, w, n = px.shape
        blocks = [px[y : y + rows] for y in range(0, h, rows)]
        if tile:
            full = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile, n), np.uint8)
            full[:h, :w] = px
            blocks = [full[y : y + tile, x : x + tile] for y in range(0, full.shape[0], tile) for x in range(0, full.shape[1], tile)]
        at, sizes = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            data = b.tobytes()
            data = {NONE: lambda d: d, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1)}[compression](data)
            at.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * n), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if n == 3 else 1]), (SAMPLES, 3, [n]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_W, 4, [tile]), (TILE_H, 4, [tile]), (TILE_AT, 4, at), (TILE_SIZE, 4, sizes)] if tile else [(STRIP_AT, 4, at), (ROWS, 4, [rows]), (STRIP_SIZE, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            size, letter = _TYPES[kind]
            packed = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(packed) > 4:
                place, packed = len(out), packed + b"\0" * (len(packed) % 2)
                out += packed
                packed = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


# ---- columns
def stored_form(size: int) -> dict:
    """How the page of a payload is written, by its length alone: PackBits or LZW where a directory outweighs the samples, deflated
    strips, and from 256 kB on deflated tiles of 64 x 64 with horizontal differences."""
    if size <= ROW:
        return {"compression": PACKBITS}
    if size <= 4 * ROW:
        return {"compression": LZW}
    if size < 1 << 18:
        return {"compression": DEFLATE}
    return {"compression": DEFLATE, "predictor": 2, "tile": 64}


def with_media(df: DataFrame, text: str = "text", name: str = "media") -> DataFrame:
    """Adds a TIFF of one page that stores the text's UTF-8, padded with zeros to a positive multiple of 64, as rows of 64 samples, in
    the form that stored_form() gives.

    A null text is stored as an empty one: one row of zeros. Equal texts have equal files; texts of any length are stored whole. An empty
    table gives no rows. A column of this name is replaced, and so is the text, if that is its name.
    """
    ready(df.sparkSession)
    if text == name:
        return with_media(df.withColumnRenamed(text, "_text"), "_text", name).drop("_text")
    df = df.drop(name)
    schema = df.select("*", F.lit(None).cast("binary").alias(name)).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = flat_utf8(batch.column(batch.schema.get_field_index(text)))
            out = []
            for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                rows = max(1, -(-(e - s) // ROW))
                px = np.zeros(rows * ROW, np.uint8)
                px[: e - s] = data[s:e]
                out.append(write_pages([px.reshape(rows, ROW)], **stored_form(rows * ROW)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, name])

    return df.mapInArrow(released(run), schema)


def media_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each page of each row's TIFF: df's columns and page, width, height, samples, bits, payload (the samples' bytes, row by row)
    and feature, the mean, deviation and entropy of the payload's bytes with the difference of neighbours.

    Null, empty and foreign bytes give no rows, and neither does an empty table; repeated rows give repeated pages. Columns of these names
    are replaced.
    """
    ready(df.sparkSession)
    kinds = {"page": "int", "width": "int", "height": "int", "samples": "int", "bits": "int", "payload": "binary", "feature": "string"}
    df = df.drop(*kinds)
    schema = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, cols = [], [[] for _ in kinds]
            for i, raw in enumerate(batch.column(batch.schema.get_field_index(media))):
                for p in read_pages(raw.as_py() or b""):
                    payload = p["pixels"].tobytes()
                    rows.append(i)
                    for c, v in zip(cols, (p["page"], p["width"], p["height"], p["samples"], p["bits"], payload, feature(payload)), strict=True):
                        c.append(v)
            types = [pa.int32()] * 5 + [pa.binary(), pa.string()]
            kept = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*batch.schema.names, *kinds])

    return df.mapInArrow(released(run), schema)


def feature(payload: bytes) -> str:
    """mean:deviation:entropy:roughness with three decimals, from exact counts, so that equal payloads give equal strings."""
    x = np.frombuffer(payload, np.uint8)
    n = len(x)
    counts = np.bincount(x, minlength=256)
    v = np.arange(256)
    mean = float((counts * v).sum()) / n
    var = float((counts * v * v).sum()) / n - mean * mean
    p = counts[counts > 0] / n
    rough = float(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) / max(1, n - 1)
    return f"{mean:.3f}:{max(0.0, var) ** 0.5:.3f}:{max(0.0, float(-(p * np.log2(p)).sum())):.3f}:{rough:.3f}"


def op7_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes through a TIFF and back: lengths, digests and a feature of what was read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = with_media(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "media")
    pages = media_pages(media)
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
