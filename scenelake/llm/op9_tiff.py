"""Operator 9: media columns, TIFF.

decode() walks the image directories of a file and undoes the compression (none, PackBits, LZW, deflate) and the
predictor of each strip or tile; read_tiff() emits one row for each page of a binary column. encode() writes
8-bit grey pages in strips, so that a byte string is stored losslessly as samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm.common import documents, id_and_text, texts_of

#: Fixed values of the format: tags, and the sizes of field types 1 to 12.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257

#: Samples in a row, and rows of a strip and a page, of the files that are written here.
STORED_WIDTH, STORED_STRIP, STORED_PAGE = 64, 1024, 65_536
TILE = 32
#: Bytes of samples that a page may have, and that a file's pages may have together.
MOST_BYTES = 1 << 28


class TiffError(ValueError):
    """The bytes are no TIFF file that this module reads."""


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + n + 2]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        j = i + 1
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j] != data[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def un_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early."""
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, table, bits, have, width, last = bytearray(), list(start), 0, 0, 9, b""
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, bits = bits >> have, bits & ((1 << have) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, width, last = list(start), 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise TiffError("LZW code out of turn")
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
        if len(out) >= size:
            break
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    out, bits, have, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have)
            bits &= (1 << have) - 1

    def fresh() -> None:
        nonlocal table, width
        put(CLEAR)
        table, width = {bytes((i,)): i for i in range(256)}, 9

    fresh()
    now, following = b"", 258
    for byte in data:
        more = now + bytes((byte,))
        if more in table:
            now = more
            continue
        put(table[now])
        table[more] = following
        following += 1
        if following == 4094:
            fresh()
            following = 258
        else:
            width = 12 if following >= 2048 else 11 if following >= 1024 else 10 if following >= 512 else 9
        now = bytes((byte,))
    if now:
        put(table[now])
        following += 1
        width = 12 if following >= 2048 else 11 if following >= 1024 else 10 if following >= 512 else 9
    put(END)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size)


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    #: height x width x samples, in the machine's byte order
    pixels: np.ndarray


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory; each is visited once, so that a loop ends."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise TiffError("no TIFF header")
    (at,) = struct.unpack(order + "I", data[4:8])
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        if at + 2 > len(data):
            raise TiffError("directory beyond the end")
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 2 + 12 * n + 4 > len(data):
            raise TiffError("directory beyond the end")
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in TYPE_CODE:
                continue
            length, place = TYPE_SIZE[kind] * count, at + 2 + 12 * i + 8
            if length > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + length > len(data):
                raise TiffError("field beyond the end")
            fields[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, place)
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def decode(data: bytes, most: int = MOST_BYTES) -> list[Page]:
    """The pages of a file: samples of 8, 16 or 32 bits, in one plane or several.

    Sizes are checked before anything is made of them: a file that declares more than it can hold is an error, as is one
    whose pages have more than `most` bytes of samples.
    """
    pages, total = [], 0
    for number, (order, f) in enumerate(directories(data)):
        def one(tag: int, default: int | None = None, f: dict = f) -> int:
            if not f.get(tag, (default,)) or f.get(tag, (default,))[0] is None:
                raise TiffError(f"field {tag} is missing")
            return f.get(tag, (default,))[0]

        width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        bits, compression, predictor, planes = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
        if width < 1 or height < 1 or samples < 1 or bits not in (8, 16, 32) or len(set(f.get(BITS, (1,)))) > 1:
            raise TiffError("size or sample width not supported")
        if predictor not in (1, 2) or planes not in (1, 2):
            raise TiffError("predictor or planes not supported")
        kind = np.dtype(f"{order}u{bits // 8}")
        tiled = TILE_OFFSETS in f
        across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        if across < 1 or down < 1:
            raise TiffError("strips or tiles without rows or columns")
        offsets, counts = (f.get(TILE_OFFSETS, ()), f.get(TILE_COUNTS, ())) if tiled else (f.get(STRIP_OFFSETS, ()), f.get(STRIP_COUNTS, ()))
        layers, deep = (samples, 1) if planes == 2 else (1, samples)
        columns, lines = -(-width // across), -(-height // down)
        blocks = layers * columns * lines
        if len(offsets) < blocks or len(counts) < len(offsets):
            raise TiffError("too few strips or tiles")
        size = width * height * samples * bits // 8
        total += size
        # what a strip or tile can hold at most for each of its bytes: deflate 1032, LZW 3640 / 1.5, PackBits 64
        if max(size, blocks * across * down * deep * bits // 8) > 4000 * max(1, len(data)) or total > most or across * down * deep * bits // 8 > most:
            raise TiffError("more samples declared than the file can hold")
        pixels = np.zeros((height, width, samples), kind.newbyteorder("="))
        for k in range(blocks):
            layer, rest = divmod(k, columns * lines)
            line, column = divmod(rest, columns)
            rows = down if tiled else min(down, height - line * down)
            size = rows * across * deep * bits // 8
            if offsets[k] < 0 or counts[k] < 0 or offsets[k] + counts[k] > len(data):
                raise TiffError("a strip or tile beyond the end")
            raw = data[offsets[k] : offsets[k] + counts[k]]
            if compression == NONE:
                raw = raw[:size]
            elif compression == PACKBITS:
                raw = unpack_bits(raw, size)
            elif compression == LZW:
                raw = un_lzw(raw, size)
            elif compression in (DEFLATE, OLD_DEFLATE):
                raw = inflate(raw, size)
            else:
                raise TiffError(f"compression {compression} not supported")
            if len(raw) < size:
                raise TiffError("a strip or tile is too short")
            block = np.frombuffer(raw, kind).reshape(rows, across, deep).astype(kind.newbyteorder("="))
            if predictor == 2:
                block = np.add.accumulate(block, axis=1, dtype=block.dtype)
            y, x = line * down, column * across
            block = block[: height - y, : width - x]
            pixels[y : y + block.shape[0], x : x + block.shape[1], layer * deep : layer * deep + deep] = block
        pages.append(Page(number, width, height, samples, bits, compression, pixels))
    return pages


def _tiles(image: np.ndarray, predictor: int) -> list[bytes]:
    """The tiles of an 8-bit image, row by row; those at the edge are filled up with 0."""
    out = []
    for y in range(0, image.shape[0], TILE):
        for x in range(0, image.shape[1], TILE):
            tile = np.zeros((TILE, TILE), np.uint8)
            part = image[y : y + TILE, x : x + TILE]
            tile[: part.shape[0], : part.shape[1]] = part
            out.append((np.diff(tile, axis=1, prepend=np.uint8(0)) if predictor == 2 else tile).astype(np.uint8).tobytes())
    return out


def encode(payload: bytes, compression: int = DEFLATE, predictor: int = 1, strip: int = STORED_STRIP, page: int = STORED_PAGE, width: int = STORED_WIDTH, tiled: bool = False) -> bytes:
    """Stores bytes, a multiple of width, as 8-bit grey samples: pages of at most `page` rows in strips of `strip` rows, or in tiles of 32 x 32."""
    pack = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1)}[compression]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for at in range(0, len(payload), page * width):
        image = payload[at : at + page * width]
        if predictor == 2:
            rows = np.frombuffer(image, np.uint8).reshape(-1, width)
            image = np.diff(rows, axis=1, prepend=np.zeros((len(rows), 1), np.uint8)).astype(np.uint8).tobytes()
        parts = [image[s : s + strip * width] for s in range(0, len(image), strip * width)]
        if tiled:
            parts = _tiles(np.frombuffer(payload, np.uint8)[at : at + page * width].reshape(-1, width), predictor)
        offsets, counts = [], []
        for part in parts:
            packed = pack(part)
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        fields = [(WIDTH, (width,)), (HEIGHT, (len(image) // width,)), (BITS, (8,)), (COMPRESSION, (compression,)), (PHOTOMETRIC, (1,)), (STRIP_OFFSETS, tuple(offsets)), (SAMPLES, (1,)), (ROWS_PER_STRIP, (strip,)), (STRIP_COUNTS, tuple(counts)), (PREDICTOR, (predictor,))]
        if tiled:
            fields = [x for x in fields if x[0] not in (STRIP_OFFSETS, ROWS_PER_STRIP, STRIP_COUNTS)]
            fields += [(TILE_WIDTH, (TILE,)), (TILE_HEIGHT, (TILE,)), (TILE_OFFSETS, tuple(offsets)), (TILE_COUNTS, tuple(counts))]
        places = {}
        for tag, values in fields:
            if len(values) > 1:
                places[tag] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields))
        for tag, values in fields:
            out += struct.pack("<HHII", tag, 4, len(values), places.get(tag, values[0]))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_tiff(media: DataFrame, column: str, key: str) -> DataFrame:
    """key, page, width, height, samples, bits, compression, pixels, error: one row for each page of each file.

    pixels are the samples row by row, little-endian. A null, empty or broken file has one row with page -1 and
    the error; pages before the broken place are not given. Repeated rows give repeated pages; an empty table an
    empty result. Only the two columns named are read.
    """
    rows = media.select(F.col(key).alias("key"), F.col(column).cast("binary").alias("media"))
    kind = rows.schema["key"].dataType.simpleString()

    def pages(batches):
        for b in batches:
            for k, x in zip(b.column("key"), b.column("media").to_pylist(), strict=True):
                try:
                    if not x:
                        raise TiffError("no bytes")
                    found = [(p.number, p.width, p.height, p.samples, p.bits, p.compression, p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes(), None) for p in decode(x)]
                except (ValueError, struct.error, zlib.error, LookupError, ArithmeticError, MemoryError) as e:
                    found = [(-1, None, None, None, None, None, None, str(e)[:200])]
                for row in found:
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], b.schema.field("key").type), *[pa.array([v], t) for v, t in zip(row, (pa.int32(),) * 6 + (pa.binary(), pa.string()), strict=True)]], names=["key", "page", "width", "height", "samples", "bits", "compression", "pixels", "error"])

    return rows.mapInArrow(pages, f"key {kind}, page int, width int, height int, samples int, bits int, compression int, pixels binary, error string").withColumnRenamed("key", key)


#: Forms that texts are stored in; a checksum of the bytes picks one. Pixels in tiles have 32 rows each.
FORMS = tuple((compression, predictor, tiled) for compression in (DEFLATE, LZW, PACKBITS, NONE) for predictor in (1, 2) for tiled in (False, True))


def form_of(payload: bytes) -> tuple[int, int, bool]:
    return FORMS[zlib.crc32(payload) % len(FORMS)]


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a TIFF file, in one of FORMS.

    The text's bytes (null: none) are padded with bytes 0 to a positive multiple of 64. Ids may be null or
    repeated; equal texts have equal files; an empty table gives an empty result.
    """

    def store(payload: bytes) -> bytes:
        compression, predictor, tiled = form_of(payload)
        return encode(payload, compression, predictor, tiled=tiled)

    def store_all(batches):
        for b in batches:
            texts = texts_of(b)
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(part)), pa.array(map(len, part), pa.int64()), pa.array([store(padded(x)) for x in part], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(store_all, "doc_id long, n_bytes long, media binary")


def padded(x: bytes) -> bytes:
    return x + b"\0" * (64 - len(x) if not x else -len(x) % 64)


def features(samples: np.ndarray) -> str:
    """Rows, mean, deviation and entropy of 8-bit samples."""
    counts = np.bincount(samples, minlength=256)
    n, levels = counts.sum(), np.arange(256)
    mean = counts @ levels / n
    share = counts[counts > 0] / n
    return f"rows={n // STORED_WIDTH};mean={mean:.4f};std={np.sqrt(max(0.0, counts @ levels**2 / n - mean**2)):.4f};entropy={-(share * np.log2(share)).sum():.4f}"


def digest_media(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> digests and features of the samples read back from the file."""

    def digest(batches):
        for b in batches:
            rows = []
            for media in b.column("media").to_pylist():
                pages = decode(media)
                samples = np.concatenate([p.pixels.ravel() for p in pages])
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples), len(pages)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages"])

    return stored.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(store_texts(documents(spark, sf_dir)))
