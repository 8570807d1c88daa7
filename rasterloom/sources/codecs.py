"""Image files: a PNG and BMP codec of this library's own (8 bits a channel, no interlacing). Channels are in BGR order, as users of imread know them."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np

SIGN = b"\x89PNG\r\n\x1a\n"


def encode_png(a: np.ndarray, level: int = 6) -> bytes:
    a = np.asarray(a, np.uint8)
    a = a[..., None] if a.ndim == 2 else a
    h, w, c = a.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    a = a[..., [2, 1, 0, 3][:c]] if c > 2 else a
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], 1)
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png(buf: bytes) -> np.ndarray:
    at, parts, palette, alpha = 8, [], None, None
    while at + 8 <= len(buf):
        size, tag = struct.unpack(">I4s", buf[at : at + 8])
        data = buf[at + 8 : at + 8 + size]
        if tag == b"IHDR":
            w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", data)
        elif tag == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif tag == b"IDAT":
            parts.append(data)
        at += 12 + size
    if depth != 8 or lace:
        raise ValueError("PNG files of 8 bits a channel without interlacing")
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    for y in range(h):
        f, row = raw[y, 0], raw[y, 1:].astype(int)
        up = out[y - 1].astype(int) if y else np.zeros(w * c, int)
        if f == 1:
            row = row.reshape(w, c).cumsum(0).ravel()
        elif f == 2:
            row = row + up
        elif f in (3, 4):
            row = row.copy()
            for i in range(w * c):
                left, above, corner = (row[i - c], up[i], up[i - c]) if i >= c else (0, up[i], 0)
                if f == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
                row[i] = (row[i] + guess) & 255
        out[y] = row & 255
    a = out.reshape(h, w, c)
    if kind == 3:
        a = palette[a[..., 0]]
    return a[..., [2, 1, 0, 3][: a.shape[2]]] if a.shape[2] > 2 else a


def encode_bmp(a: np.ndarray) -> bytes:
    a = np.asarray(a, np.uint8)
    a = np.repeat(a[..., None] if a.ndim == 2 else a, 3 if a.ndim == 2 or a.shape[2] == 1 else 1, 2)[..., :3]
    h, w, _ = a.shape
    rows = np.pad(a[::-1].reshape(h, -1), ((0, 0), (0, -w * 3 % 4))).tobytes()
    return struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def decode_bmp(buf: bytes) -> np.ndarray:
    at, (w, h, _, bits) = struct.unpack("<I", buf[10:14])[0], struct.unpack("<iiHH", buf[18:30])
    if bits not in (24, 32):
        raise ValueError("BMP files of 24 or 32 bits")
    c = bits // 8
    size = -(-w * c // 4) * 4
    a = np.frombuffer(buf, np.uint8, size * abs(h), at).reshape(abs(h), size)[:, : w * c].reshape(abs(h), w, c)
    return (a[::-1] if h > 0 else a).copy()


def imdecode(buf, flags=1):
    """flags: 1 colour (BGR), 0 grey, negative as stored; None for bytes that are no image."""
    b = bytes(np.asarray(buf, np.uint8)) if not isinstance(buf, bytes | bytearray) else bytes(buf)
    try:
        a = decode_png(b) if b.startswith(SIGN) else decode_bmp(b) if b.startswith(b"BM") else None
    except (ValueError, KeyError, struct.error, zlib.error, UnboundLocalError):
        return None
    if a is None or flags < 0:
        return a[..., 0] if a is not None and a.shape[2] == 1 else a
    grey = a.shape[2] < 3
    if flags == 0:
        return a[..., 0].copy() if grey else np.clip(np.floor(a[..., 0] * 0.114 + a[..., 1] * 0.587 + a[..., 2] * 0.299 + 0.5), 0, 255).astype(np.uint8)
    return np.repeat(a[..., :1], 3, 2) if grey else a[..., :3].copy()


def imencode(ext, img, params=None):
    """(ok, bytes as an array)"""
    if ext.lower() == ".png":
        level = dict(zip(params[::2], params[1::2], strict=True)).get(16, 6) if params else 6
        return True, np.frombuffer(encode_png(img, level), np.uint8)
    if ext.lower() == ".bmp":
        return True, np.frombuffer(encode_bmp(img), np.uint8)
    raise ValueError(f"no encoder for {ext}")


def imread(filename, flags=1):
    p = Path(filename)
    return imdecode(p.read_bytes(), flags) if p.is_file() else None


def imwrite(filename, img, params=None):
    Path(filename).write_bytes(imencode(Path(filename).suffix, img, params)[1].tobytes())
    return True
