"""TIFF pages as rows.

A file's image directories are walked from the first to the last; each becomes a page. Strips or tiles are decoded from
none, PackBits, LZW or deflate; horizontal differencing (8, 16 and 32 bit samples) and the floating-point predictor
are undone. Samples of 1, 2 and 4 bits come as one byte each. Both byte orders, both bit orders, BigTIFF and planar layouts are read. A
directory that points back to one already walked ends the walk.

Defined results: a page that can't be read gives an error row, unless `errors` is unset, and the walk goes on with the next; null or empty bytes, and
bytes that hold no directory, give one error row; sizes that are zero, or that no file of this length can hold, are
faults and nothing is allocated for them; empty tables give empty results; repeated rows each give their pages; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, batch, narrowed

WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
FILL_ORDER = 266
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: No codec here makes more bytes of one: the longest LZW string has 3838 bytes and takes 12 bits at most.
MOST_FROM_ONE = 4096
FAULTS = (ValueError, KeyError, TypeError, IndexError, ZeroDivisionError, OverflowError, MemoryError, struct.error, zlib.error)
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}


def unpack_bits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out.append(data[i + 1 : i + 2 + c])
            i += c + 2
        elif c > 128:
            out.append(data[i + 1 : i + 2] * (257 - c))
            i += 2
        else:
            i += 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, size: int = 1 << 62) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widening one code early; ends when `size` bytes are there."""
    left = size
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, bits, last, out = list(start), 9, 0, 0, b"", []
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(start), 9, b""
            continue
        if not last:
            now = table[code]
        else:
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
        out.append(now)
        last = now
        left -= len(now)
        if left <= 0:
            break
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table, width, last = {bytes((i,)): i for i in range(256)}, 9, b""
    size = 258
    put(256, width)
    for i in range(len(data)):
        c = data[i : i + 1]
        if last + c in table:
            last += c
            continue
        put(table[last], width)
        table[last + c] = size
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
        if size == 4094:
            put(256, width)
            table, width, size = {bytes((i,)): i for i in range(256)}, 9, 258
        last = c
    if last:
        put(table[last], width)
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def decode_block(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == PACKBITS:
        return unpack_bits(data)[:size]
    if compression == LZW:
        return lzw_decode(data, size)[:size]
    raise ValueError(f"compression {compression} isn't read")


def undo_predictor(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: (rows, columns, samples)."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.add.accumulate(block, axis=1, dtype=block.dtype)
    if predictor == 3:  # bytes by significance, differenced over the row
        rows, cols, samples = block.shape
        width = block.dtype.itemsize
        raw = np.frombuffer(block.tobytes(), np.uint8).reshape(rows, -1, samples)
        raw = np.add.accumulate(raw, axis=1, dtype=np.uint8).reshape(rows, width, cols * samples)
        raw = raw.transpose(0, 2, 1).reshape(rows, -1)
        return np.frombuffer(raw.tobytes(), block.dtype.newbyteorder(">")).reshape(rows, cols, samples)
    raise ValueError(f"predictor {predictor} isn't read")


@dataclass
class Page:
    index: int
    width: int
    height: int
    compression: int
    samples: np.ndarray  # (height, width, samples)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    (magic,) = struct.unpack_from(order + "H", data, 2)
    big = magic == 43
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
    n_kind, e_kind, inline, step = ("Q", "HHQ", 8, 20) if big else ("H", "HHI", 4, 12)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + n_kind, data, at)
        at += struct.calcsize(n_kind)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + e_kind, data, at + i * step)
            value = at + i * step + step - inline
            k = KINDS.get(kind)
            if k is None:
                continue
            size = struct.calcsize(k) * count
            if size > inline:
                (value,) = struct.unpack_from(order + ("Q" if big else "I"), data, value)
            tags[tag] = struct.unpack_from(f"{order}{count}{k}", data, value)
        yield order, tags
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, at + n * step)


def small_samples(raw: bytes, rows: int, n: int, bits: int) -> np.ndarray:
    """uint8 (rows, n) of samples of 1, 2 or 4 bits, most significant first; each row begins at a byte."""
    width = -(-n * bits // 8)
    b = np.frombuffer(raw, np.uint8, rows * width).reshape(rows, width)
    parts = [b >> np.uint8(8 - bits * (i + 1)) & np.uint8((1 << bits) - 1) for i in range(8 // bits)]
    return np.stack(parts, axis=2).reshape(rows, -1)[:, :n]


def page_of(data: bytes, order: str, tags: dict[int, tuple], index: int) -> Page:
    one = lambda t, default=None: tags.get(t, (default,))[0]
    w, h, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise ValueError(f"samples of {bits} bits aren't read")
    if bits < 8 and predictor != 1:
        raise ValueError(f"predictor {predictor} on samples of {bits} bits isn't read")
    kind = np.dtype(np.uint8) if bits < 8 else np.dtype(f"{'f' if one(FORMAT, 1) == 3 else 'i' if one(FORMAT, 1) == 2 else 'u'}{bits // 8}").newbyteorder(order)
    deep = 1 if planar == 2 else samples
    tiled = TILES in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(one(ROWS, h), h))
    at, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags.get(STRIP_BYTES, (len(data),)))
    if min(w, h, samples, bw, bh) < 1:
        raise ValueError("a size is zero")
    across, down = -(-w // bw), -(-h // bh)
    row = -(-bw * deep * bits // 8)
    if len(at) != across * down * (samples // deep) or len(sizes) != len(at):
        raise ValueError("strips or tiles are missing")
    if bh * row > MOST_FROM_ONE * (len(data) + 1) or h * row > MOST_FROM_ONE * (len(data) + 1):
        raise ValueError("the file is too short for the sizes that it names")
    out = np.zeros((h, w, samples), kind.newbyteorder("="))
    for k, (a, n) in enumerate(zip(at, sizes, strict=True)):
        plane, k = divmod(k, across * down)
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        part = data[a : a + n]
        if one(FILL_ORDER, 1) == 2:
            part = np.packbits(np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little")).tobytes()
        raw = decode_block(part, compression, rows * row)
        if bits < 8:
            block = small_samples(raw, rows, bw * deep, bits).reshape(rows, bw, deep)
        else:
            block = np.frombuffer(raw, kind, rows * bw * deep).reshape(rows, bw, deep)
            block = undo_predictor(block.astype(kind.newbyteorder("=")) if predictor == 2 else block, predictor, order)
        part = block[: h - y, : w - x]
        out[y : y + part.shape[0], x : x + part.shape[1], plane if planar == 2 else slice(None)] = part[:, :, 0] if planar == 2 else part
    return Page(index, w, h, compression, out)


def walk(data: bytes) -> Iterator[tuple[int, Page | Exception]]:
    """Each page by its number, or why it can't be read."""
    index, found = 0, directories(data)
    while True:
        try:
            order, tags = next(found)
        except StopIteration:
            if not index:
                yield 0, ValueError("no directory")
            return
        except FAULTS as e:  # where the next directory is stays unknown
            yield index, e
            return
        try:
            yield index, page_of(data, order, tags, index)
        except FAULTS as e:
            yield index, e
        index += 1


def pages(data: bytes) -> Iterator[Page]:
    """The pages; raises at the first that can't be read."""
    for _, p in walk(data):
        if isinstance(p, Exception):
            raise p
        yield p


def write_tiff(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 64, tile: int = 0, order: str = "<") -> bytes:
    """Images of (height, width) or (height, width, samples) unsigned samples, one directory each; the same bytes for the same
    images. tile: side of square tiles, a multiple of 16; else strips of `rows` rows."""
    out = bytearray(b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)
    link = 4
    for image in images:
        im = image if image.ndim == 3 else image[:, :, None]
        h, w, deep = im.shape
        kind = im.dtype.newbyteorder(order)
        blocks = []
        if tile:
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    b = np.zeros((tile, tile, deep), im.dtype)
                    part = im[y : y + tile, x : x + tile]
                    b[: part.shape[0], : part.shape[1]] = part
                    blocks.append(b)
        else:
            blocks = [im[y : y + rows] for y in range(0, h, rows)]
        at, sizes = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            raw = b.astype(kind).tobytes()
            raw = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}[compression](raw)
            at.append(len(out))
            sizes.append(len(raw))
            out += raw
        tags = [(WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [im.dtype.itemsize * 8] * deep), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [2 if deep == 3 else 1]), (SAMPLES, "H", [deep]), (PREDICTOR, "H", [predictor])]
        tags += [(TILE_WIDTH, "I", [tile]), (TILE_HEIGHT, "I", [tile]), (TILES, "I", at), (TILE_BYTES, "I", sizes)] if tile else [(STRIPS, "I", at), (ROWS, "I", [rows]), (STRIP_BYTES, "I", sizes)]
        entries = []
        for tag, k, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{k}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, place = struct.pack(order + "I", len(out)), raw
                out += place
            entries.append(struct.pack(order + "HHI", tag, 4 if k == "I" else 3, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


UNIT, SIDE = 576, 24


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and shares of 16 equal ranges of the samples."""
    flat = samples.reshape(-1)
    shares = np.bincount(flat >> 4, minlength=16) / len(flat)
    return f"{flat.mean():.4f};{flat.std():.4f};" + ",".join(f"{x:.4f}" for x in shares)


def text_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a TIFF of 8-bit samples, 24 wide, read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in b.column(1):
            n, payload = payload_of(t.as_py())
            media = write_tiff([np.frombuffer(payload, np.uint8).reshape(-1, SIDE)], rows=2730)
            (page,) = pages(media)
            back = page.samples.tobytes()
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(page.samples)))
        return batch(schema, b.column(0), *map(list, zip(*rows, strict=True)))

    return arrow_map(narrowed(docs, doc_id=id_col, text=text_col), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def tiff_pages(files: DataFrame, id_col: str, data_col: str, errors: bool = True) -> DataFrame:
    """One row per page: id, page, width, height, compression, data (samples, row by row), error. A page that can't be read has only id, page and
    why in error; without errors it is left out."""
    schema = pa.schema([("id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("compression", pa.int32()), ("data", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for k, p in walk(data.as_py() or b""):
                    if isinstance(p, Page):
                        rows.append((i, k, p.width, p.height, p.compression, p.samples.tobytes(), None))
                        size += p.samples.nbytes
                    elif errors:
                        rows.append((i, k, None, None, None, None, f"{type(p).__name__}: {p}"))
                    if size > 16 << 20 or len(rows) > 4096:
                        yield batch(schema, *map(list, zip(*rows, strict=True)))
                        rows, size = [], 0
        if rows:
            yield batch(schema, *map(list, zip(*rows, strict=True)))

    return narrowed(files, id=id_col, data=data_col).mapInArrow(run, "id long, page int, width int, height int, compression int, data binary, error string")
