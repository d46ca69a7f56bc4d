"""Test helpers: a TIFF writer and plain-Python counterparts of a few operators."""

import struct
import zlib

import numpy as np


def write_tiff(path, stack, compress=False, order="<", more=()):
    """Write a (z, y, x) stack as a multi-page TIFF with one strip per page."""
    stack = np.asarray(stack)
    kind = {"u": 1, "i": 2, "f": 3}[stack.dtype.kind]
    bits = stack.dtype.itemsize * 8
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in stack:
        data = page.astype(stack.dtype.newbyteorder(order)).tobytes()
        data = zlib.compress(data) if compress else data
        at = len(out)
        out += data + b"\0" * (len(data) % 2)
        ifd = len(out)
        out[link:link + 4] = struct.pack(order + "I", ifd)
        tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, bits), (259, 3, 8 if compress else 1),
                (273, 4, at), (278, 4, page.shape[0]), (279, 4, len(data)), (339, 3, kind)]
        tags = sorted([*tags, *more])
        out += struct.pack(order + "H", len(tags))
        for tag, code, value in tags:
            cell = struct.pack(order + "HH", value, 0) if code == 3 else struct.pack(order + "I", value)
            out += struct.pack(order + "HHI", tag, code, 1) + cell
        link = len(out)
        out += b"\0\0\0\0"
    path.write_bytes(bytes(out))


def write_blocks(path, stack, block, tiled=False, compress=False, order="<", predictor=False):
    """Write a (z, y, x) stack of integers as pages of several strips of ``block`` rows, or of tiles ``block`` wide and high."""
    stack = np.asarray(stack)
    high, wide = block if tiled else (block, stack.shape[2])
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in stack:
        places, sizes = [], []
        for y in range(0, page.shape[0], high):
            for x in range(0, page.shape[1], wide):
                part = page[y:y + high, x:x + wide]
                if tiled:  # padding that a reader must not take for pixels
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1])), constant_values=77)
                if predictor:
                    part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), part.dtype))
                data = part.astype(stack.dtype.newbyteorder(order)).tobytes()
                data = zlib.compress(data) if compress else data
                places.append(len(out))
                sizes.append(len(data))
                out += data + b"\0" * (len(data) % 2)
        own = [(322, [wide]), (323, [high]), (324, places), (325, sizes)] if tiled else [(273, places), (278, [high]), (279, sizes)]
        tags = sorted([(256, [page.shape[1]]), (257, [page.shape[0]]), (258, [stack.dtype.itemsize * 8]), (259, [8 if compress else 1]),
                       (317, [2 if predictor else 1]), (339, [1]), *own])
        cells = b""
        for tag, values in tags:
            raw = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                raw, at = struct.pack(order + "I", len(out)), raw
                out += at
            cells += struct.pack(order + "HHI", tag, 4, len(values)) + raw
        out[link:link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags)) + cells
        link = len(out)
        out += b"\0\0\0\0"
    path.write_bytes(bytes(out))


def voxel_rows(session, stack, red=None, green=None):
    rows = []
    for z, y, x in zip(*np.nonzero(stack)):
        rows.append((session, int(z), int(y), int(x), int(stack[z, y, x]),
                     None if red is None else float(red[z, y, x]), None if green is None else float(green[z, y, x])))
    return rows


VOXELS = "session_id string, z int, y int, x int, label int, red double, green double"


def greedy(rows, order):
    """Sequential greedy over dict rows sorted by ``order``."""
    taken_a, taken_b, out = set(), set(), []
    for row in sorted(rows, key=order):
        if row["label_a"] not in taken_a and row["label_b"] not in taken_b:
            taken_a.add(row["label_a"])
            taken_b.add(row["label_b"])
            out.append((row["label_a"], row["label_b"]))
    return sorted(out)
