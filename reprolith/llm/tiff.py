"""TIFF as a column: files of bytes in, one row per page out, and back.

The reader walks the chain of image directories (classic and big TIFF, either byte order), takes
strips or tiles apart, decodes PackBits, LZW or deflate, and undoes horizontal or floating-point
predictors. A file that can't be read gives one row with the reason and no pixels.
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
from pyspark.sql import functions as F

from .common import batch_of, text_bytes

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes of one page, decoded, that are accepted at most.
MAX_PAGE = 1 << 30
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes) -> bytes:
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


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        end = i + 1
        while end < n and end - i < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out += bytes([end - i - 1]) + data[i:end]
        i = end
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Variable codes of 9 to 12 bits, most significant bit first, widened one code early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last, out = list(first), 9, b"", []
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if not last:
            if code > 255:
                raise TiffError("LZW: the first code isn't a byte")
            now = table[code]
        else:
            if code < len(table):
                now = table[code]
            elif code == len(table):
                now = last + last[:1]
            else:
                raise TiffError("LZW: a code from nowhere")
            table.append(last + now[:1])
        out.append(now)
        last = now
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    table, out, held, bits, width = {bytes([i]): i for i in range(256)}, bytearray(), 0, 0, 9
    size = 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    at = b""
    for byte in data:
        more = at + bytes([byte])
        if more in table:
            at = more
            continue
        put(table[at])
        table[more] = size
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
        elif size >= 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        at = bytes([byte])
    if at:
        put(table[at])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _inflate(data: bytes, most: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None


@dataclass(frozen=True)
class Page:
    pixels: np.ndarray  # height x width x samples
    compression: int
    predictor: int
    tiled: bool


def _directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """Tags of each image directory, in file order."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("not a TIFF")
    end = "<" if data[:2] == b"II" else ">"
    magic = struct.unpack_from(end + "H", data, 2)[0]
    if magic not in (42, 43):
        raise TiffError("not a TIFF")
    count, entry, word = ("H", "HHI4s", "I") if magic == 42 else ("Q", "HHQ8s", "Q")
    at, seen = struct.unpack_from(end + word, data, 4 if magic == 42 else 8)[0], set()
    while at:
        if at in seen:
            raise TiffError("the chain of directories goes in a circle")
        seen.add(at)
        n = struct.unpack_from(end + count, data, at)[0]
        at += struct.calcsize(count)
        tags: dict[int, tuple] = {-1: (end,)}
        for _ in range(n):
            tag, kind, m, raw = struct.unpack_from(end + entry, data, at)
            at += struct.calcsize(end + entry)
            if (c := _TYPES.get(kind)) is None:
                continue
            form = f"{end}{m}s" if c == "s" else f"{end}{m * len(c)}{c[0]}"
            size = struct.calcsize(form)
            tags[tag] = struct.unpack_from(form, raw if size <= len(raw) else data, 0 if size <= len(raw) else struct.unpack(end + word, raw)[0])
        yield tags
        at = struct.unpack_from(end + word, data, at)[0]


def _page(data: bytes, tags: dict[int, tuple]) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag in tags:
            return tags[tag][0]
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default

    end, width, height = tags[-1][0], one(256), one(257)
    samples, bits, compression, predictor = one(277, 1), one(258, 1), one(259, 1), one(317, 1)
    planar, kind = one(284, 1), _KINDS.get(one(339, 1), "u")
    if len({*tags.get(258, (bits,))}) > 1 or bits not in (1, 8, 16, 32, 64):
        raise TiffError(f"samples of {tags.get(258)} bits")
    if kind == "f" and bits < 32 or bits == 1 and predictor != 1:
        raise TiffError("no such samples")
    tiled = 322 in tags
    bw, bh = (one(322), one(323)) if tiled else (width, min(one(278, height), height) or 1)
    offsets, counts = tags.get(324 if tiled else 273), tags.get(325 if tiled else 279)
    if offsets is None or counts is None or len(offsets) != len(counts):
        raise TiffError("no strips or tiles")
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    if not (0 < width and 0 < height and 0 < bw and 0 < bh) or height * width * samples * max(bits // 8, 1) > MAX_PAGE:
        raise TiffError("no such size")
    across, down = -(-width // bw), -(-height // bh)
    if len(offsets) < across * down * planes:
        raise TiffError("too few strips or tiles")
    dtype = np.dtype("u1" if bits in (1, 8) and kind != "i" else f"{end}{kind}{bits // 8}")
    out = np.zeros((height, width, samples), dtype.newbyteorder("="))
    line = (bw * each * bits + 7) // 8
    for i in range(across * down * planes):
        plane, at = divmod(i, across * down)
        y, x = at // across * bh, at % across * bw
        rows = bh if tiled else min(bh, height - y)
        raw = data[offsets[i] : offsets[i] + counts[i]]
        match compression:
            case 1:
                got = raw
            case 32773:
                got = unpack_bits(raw)
            case 5:
                got = unpack_lzw(raw)
            case 8 | 32946:
                got = _inflate(raw, rows * line)
            case _:
                raise TiffError(f"compression {compression}")
        if len(got) < rows * line:
            raise TiffError("a strip or tile ends early")
        got = got[: rows * line]
        if bits == 1:
            block = np.unpackbits(np.frombuffer(got, "u1").reshape(rows, line), axis=1)[:, : bw * each].reshape(rows, bw, each)
        elif predictor == 3:  # bytes by significance, most significant first, differenced along the line
            flat = np.frombuffer(got, "u1").reshape(rows, bits // 8, bw * each)
            flat = np.cumsum(flat.reshape(rows, -1).reshape(rows, -1, each), axis=1, dtype="u1").reshape(rows, bits // 8, bw * each)
            block = np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">f{bits // 8}").reshape(rows, bw, each).astype(out.dtype)
        else:
            block = np.frombuffer(got, dtype).reshape(rows, bw, each).astype(out.dtype)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype)
        out[y : y + rows, x : x + bw, plane * each : plane * each + each] = block[: height - y, : width - x]
    return Page(out, compression, predictor, tiled)


def read_pages(data: bytes) -> Iterator[Page]:
    """Pages of a file in order of its directories."""
    try:
        for tags in _directories(data):
            yield _page(data, tags)
    except (struct.error, IndexError) as e:
        raise TiffError(f"the file ends early: {e}") from None


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """A classic TIFF of height x width x samples arrays of unsigned 8- or 16-bit samples."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for pixels in pages:
        h, w, s = pixels.shape
        bits = pixels.dtype.itemsize * 8
        bw, bh = tile or (w, min(rows_per_strip, h))
        offsets, counts = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                block = pixels[y : y + bh, x : x + bw]
                if tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                raw = block.astype(pixels.dtype.newbyteorder(order)).tobytes()
                line = len(raw) // block.shape[0]
                match compression:
                    case 32773:
                        raw = b"".join(pack_bits(raw[i : i + line]) for i in range(0, len(raw), line))
                    case 5:
                        raw = pack_lzw(raw)
                    case 8 | 32946:
                        raw = zlib.compress(raw, level)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [bits] * s), (259, "H", [compression]), (262, "H", [2 if s == 3 else 1]), (277, "H", [s]), (317, "H", [predictor])]
        tags += [(322, "I", [bw]), (323, "I", [bh]), (324, "I", offsets), (325, "I", counts)] if tile else [(273, "I", offsets), (278, "I", [bh]), (279, "I", counts)]
        entries = b""
        for tag, c, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{c}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) & 1)
                raw, where = b"", len(out)
                out += struct.pack(f"{order}{len(values)}{c}", *values)
                raw = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, 3 if c == "H" else 4, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) & 1)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


_PAGES = pa.schema([("key", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])


def tiff_pages(files: DataFrame, key_col: str, data_col: str) -> DataFrame:
    """One row per page of each file: key, page, sizes, coding, pixels (row by row), error.

    Pages before a broken one are given. A null or empty file, or one that can't be read, gives one row
    with `error` and no pixels; a file without directories gives none. Equal keys are told apart by nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = -1
                try:
                    for k, p in enumerate(read_pages(data or b"")):  # noqa: B007
                        h, w, s = p.pixels.shape
                        row = (key, k, w, h, s, p.pixels.dtype.itemsize * 8, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None)
                        yield batch_of(_PAGES, {f.name: [v] for f, v in zip(_PAGES, row, strict=True)})
                except TiffError as e:
                    row = (key, k + 1, *[None] * 8, str(e))
                    yield batch_of(_PAGES, {f.name: [v] for f, v in zip(_PAGES, row, strict=True)})

    ddl = "key long, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
    return files.select(F.col(key_col).cast("long"), F.col(data_col).cast("binary")).mapInArrow(run, ddl)


#: A payload is a multiple of one line: 64 pixels of 3 samples; pages have at most so many lines.
LINE, PAGE_LINES = 192, 4096


def payload_of(content: bytes) -> bytes:
    """Spaces appended up to a positive multiple of a line."""
    return content.ljust(max(LINE, -(-len(content) // LINE) * LINE), b" ")


def store(payload: bytes) -> bytes:
    """The payload as 8-bit RGB pages of 64 pixels a line, deflated strips behind a predictor."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE // 3, 3)
    return write_pages([lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)], DEFLATE, predictor=2)


def describe(pages: list[Page]) -> str:
    """Size, mean and spread of each channel, mean step along lines, and histogram, in whole numbers."""
    total = np.zeros((4, 3), np.int64)
    steps, histogram, lines = 0, np.zeros(8, np.int64), 0
    for p in pages:
        x = p.pixels.astype(np.int64)
        total[0] += x.sum((0, 1))
        total[1] += (x * x).sum((0, 1))
        steps += int(np.abs(np.diff(x, axis=1)).sum())
        histogram += np.bincount(p.pixels.ravel() >> 5, minlength=8)
        lines += x.shape[0]
    n = lines * (LINE // 3)
    mean = [int(v) * 1000 // n for v in total[0]]
    var = [int(q) * 1000 // n - int(v) * int(v) * 1000 // (n * n) for v, q in zip(total[0], total[1], strict=True)]
    return f"pages={len(pages)};lines={lines};mean={','.join(map(str, mean))};var={','.join(map(str, var))};step={steps * 1000 // n};hist={','.join(map(str, histogram))}"


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the text stored as a TIFF, read back, and what was read.

    A null text is an empty one, of one line of spaces. Repeated rows are listed each; an empty table gives
    an empty one. Digests are of the samples read back; a difference to what was stored is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                media = store(payload_of(content))
                pages = list(read_pages(media))
                back = b"".join(p.pixels.tobytes() for p in pages)
                rows.append((doc_id, len(content), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(pages)))
            if rows:
                yield batch_of(_DIGEST, dict(zip(_DIGEST.names, zip(*rows, strict=True), strict=True)))

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("content")).mapInArrow(run, ddl)
