"""Codecs, predictors and packed samples of TIFF blocks, on bytes and numpy arrays."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

from tessel.errors import RasterError
from tessel.sources.tiff import DTYPES

Decoder = Callable[[bytes], bytes]


def packbits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128 and i < n:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def packbits_encoded(data: bytes) -> bytes:
    """Runs of three or more as runs, the rest as literals."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    edges = np.flatnonzero(np.diff(a)) + 1
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.extend(bytes([len(part) - 1]) + part)
        literal.clear()

    for begin, end in zip(np.append(0, edges).tolist(), np.append(edges, len(a)).tolist(), strict=True):
        n = end - begin
        if n < 3:
            literal.extend(data[begin:end])
            continue
        flush()
        while n > 0:
            k = min(n, 128)
            if k == 1:
                literal.append(data[begin])
            else:
                out.extend(bytes([257 - k, data[begin]]))
            n -= k
    flush()
    return bytes(out)


CLEAR, END = 256, 257


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; a width changes one code early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, bits, out, previous = list(first), 9, 0, 0, [], b""
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == CLEAR:
                table, width, previous = list(first), 9, b""
                continue
            if code == END:
                return b"".join(out)
            if not previous:
                if code >= len(table):
                    raise RasterError("corrupt LZW data")
                entry = table[code]
            else:
                if code > len(table):
                    raise RasterError("corrupt LZW data")
                entry = table[code] if code < len(table) else previous + previous[:1]
                if len(table) < 4096:
                    table.append(previous + entry[:1])
            out.append(entry)
            previous = entry
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def lzw_encoded(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table = {bytes([i]): i for i in range(256)}

    def put(code: int) -> None:
        nonlocal held, bits
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(CLEAR)
    size, known = 258, b""
    for i in range(len(data)):
        longer = known + data[i : i + 1]
        if longer in table:
            known = longer
            continue
        put(table[known])
        table[longer] = size
        size += 1
        if size == 4094:
            put(CLEAR)
            table, size, width = {bytes([b]): b for b in range(256)}, 258, 9
        elif size >= 1 << width:
            width += 1
        known = data[i : i + 1]
    if known:
        put(table[known])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def deflate(data: bytes) -> bytes:
    return zlib.decompress(data)


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def zstd_encoded(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


def old_jpeg(data: bytes) -> bytes:
    raise RasterError("old style JPEG compression is not supported.")


def jpeg(data: bytes) -> bytes:
    from tessel.sources.jpeg import decode

    return decode(data)


def absent(name: str) -> Decoder:
    def decode(data: bytes) -> bytes:
        raise RasterError(f"no decoder for {name}: add_decoder() takes one")

    return decode


def default_registry() -> dict[int, Decoder]:
    """Decoders by compression; those of formats without a library here say so, and can be replaced."""
    return {1: bytes, 5: lzw, 6: old_jpeg, 7: jpeg, 8: deflate, 32946: deflate, 32773: packbits, 34712: absent("JPEG 2000"), 34887: absent("LERC"), 50000: zstd, 50001: absent("WebP")}


ENCODERS: dict[int, Decoder] = {1: bytes, 5: lzw_encoded, 8: zlib.compress, 32946: zlib.compress, 32773: packbits_encoded, 50000: zstd_encoded}
_registry = default_registry()


def add_decoder(compressions: int | list[int], decoder: Decoder) -> None:
    for c in [compressions] if isinstance(compressions, int) else compressions:
        _registry[c] = decoder


def registry(own: dict[int, Decoder] | None = None) -> dict[int, Decoder]:
    return _registry | (own or {})


def find_decoder(compression: int, own: dict[int, Decoder] | None = None) -> Decoder | None:
    return registry(own).get(compression)


def get_decoder(compression: int, own: dict[int, Decoder] | None = None) -> Decoder:
    found = find_decoder(compression, own)
    if found is None:
        raise RasterError(f"Unknown compression method identifier: {compression}")
    return found


def dtype_of(sample_format: int, bits: int) -> str:
    """The element type that holds a sample."""
    if sample_format == 1 and 1 <= bits <= 64:
        return next(f"uint{n}" for n in (8, 16, 32, 64) if bits <= n)
    if sample_format == 2 and 1 <= bits <= 64:
        return next(f"int{n}" for n in (8, 16, 32, 64) if bits <= n)
    if sample_format == 3 and bits in (16, 32, 64):
        return "float64" if bits == 64 else "float32"
    raise RasterError("Unsupported data format/bitsPerSample")


def zeros_for_type(field_type: int, count: int) -> np.ndarray:
    """As many values of a tag's field type, rationals as pairs."""
    if field_type == 2:
        field_type = 1
    if field_type not in DTYPES:
        raise RasterError(f"Invalid field type: {field_type}")
    return np.zeros(count * (2 if field_type in (5, 10) else 1), DTYPES[field_type])


def array_type(sample_format: int, bits: int) -> str:
    """The narrower rule: integers with a sign have 8, 16 or 32 bits, and none has 64."""
    if sample_format == 1 and bits <= 32 or sample_format == 2 and bits in (8, 16, 32) or sample_format == 3 and bits in (16, 32, 64):
        return dtype_of(sample_format, bits)
    raise RasterError("Unsupported data format/bitsPerSample")


def needs_normalization(sample_format: int, bits: int) -> bool:
    whole = sample_format in (1, 2) and bits <= 32 and bits % 8 == 0
    return not whole and not (sample_format == 3 and bits in (16, 32, 64))


def unpredicted(data: bytes, predictor: int, width: int, height: int, bits: list[int], samples: int, order: str) -> tuple[bytes, str]:
    """Bytes before a predictor was used, and their byte order. samples: how many stand side by side."""
    if predictor not in (2, 3):
        return data, order
    if len(set(bits)) > 1:
        raise RasterError("When decoding with predictor, all samples must have the same size.")
    size = bits[0]
    if predictor == 2:
        if size not in (8, 16, 32):
            raise RasterError(f"Predictor 2 needs samples of 8, 16 or 32 bits, not {size}.")
        rows = np.frombuffer(data, f"{order}u{size // 8}", count=len(data) // (size // 8))
        rows = rows[: len(rows) // (width * samples) * width * samples].reshape(-1, width, samples)
        summed = np.cumsum(rows, axis=1, dtype=f"u{size // 8}")
        return summed.astype(f"{order}u{size // 8}").tobytes(), order
    if size not in (16, 32, 64):
        raise RasterError(f"Predictor 3 needs samples of 16, 32 or 64 bits, not {size}.")
    n = size // 8
    rows = np.frombuffer(data, np.uint8)
    line = width * samples * n
    rows = rows[: len(rows) // line * line].reshape(-1, width * n, samples)
    summed = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(-1, n, width * samples)
    return np.ascontiguousarray(summed.transpose(0, 2, 1)).tobytes(), ">"


def predicted(data: bytes, width: int, bits: int, samples: int, order: str) -> bytes:
    """Predictor 2 applied: what unpredicted() undoes."""
    rows = np.frombuffer(data, f"{order}u{bits // 8}").reshape(-1, width, samples)
    return np.diff(rows, axis=1, prepend=np.zeros_like(rows[:, :1])).astype(f"{order}u{bits // 8}").tobytes()


def unpacked(data: bytes, width: int, height: int, bits: list[int], formats: list[int], order: str) -> list[np.ndarray]:
    """The samples of a block whose pixels hold len(bits) samples, as an array (height, width) each; rows missing at the end are 0."""
    types = [dtype_of(f, b) for f, b in zip(formats, bits, strict=True)]
    whole = all(b in (8, 16, 32, 64) for b in bits)
    line = width * sum(bits) // 8 if whole else -(-width * sum(bits) // 8)
    need = line * height
    data = data[:need] + bytes(max(0, need - len(data)))
    if whole:
        kinds = {(f, b): f"{order}{'uif'[f - 1]}{b // 8}" for f, b in zip(formats, bits, strict=True)}
        record = np.dtype([(f"s{i}", kinds[f, b]) for i, (f, b) in enumerate(zip(formats, bits, strict=True))])
        rows = np.frombuffer(data, record).reshape(height, width)
        return [rows[f"s{i}"].astype(t) for i, t in enumerate(types)]
    each = np.unpackbits(np.frombuffer(data, np.uint8).reshape(height, line), axis=1)[:, : width * sum(bits)].reshape(height, width, sum(bits))
    out, at = [], 0
    for f, b, t in zip(formats, bits, types, strict=True):
        value = np.zeros((height, width), np.uint64)
        for i in range(b):
            value = (value << np.uint64(1)) | each[:, :, at + i]
        at += b
        if f == 3:
            value = value.astype(f"u{b // 8}").byteswap().view(f">f{b // 8}") if order == ">" else value.astype(f">u{b // 8}").view(f"<f{b // 8}")
        elif f == 2:
            value = value.astype(np.int64)
            value = np.where(value >= 1 << (b - 1), value - (1 << b), value)
        out.append(value.astype(t))
    return out
