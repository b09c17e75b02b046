"""Tensor files: a little-endian 64-bit header length, a JSON header, then raw data.

Files are memory-mapped, so workers on one machine share the pages; nothing is broadcast.
"""

from __future__ import annotations

import json

import numpy as np

_KINDS = {"BF16": np.uint16, "F32": np.float32, "F16": np.float16}


def widen(half: np.ndarray) -> np.ndarray:
    """bf16 bits as 32-bit floats."""
    return (half.astype(np.uint32) << np.uint32(16)).view(np.float32)


def narrow(x: np.ndarray) -> np.ndarray:
    """32-bit floats as bf16 bits, rounded to the nearest even."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return ((bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) >> np.uint32(16)).astype(np.uint16)


class TensorFile:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            self.header = json.loads(f.read(n))
        self.raw = np.memmap(path, np.uint8, "r", 8 + n)

    def get(self, name: str, dtype: str, shape: tuple[int, ...]) -> np.ndarray:
        """The tensor, checked against dtype and full shape; bf16 comes as uint16 bits."""
        entry = self.header.get(name)
        if entry is None:
            raise KeyError(f"tensor {name} is missing")
        if entry["dtype"] != dtype or tuple(entry["shape"]) != tuple(shape):
            raise ValueError(f"tensor {name}: {entry['dtype']} {entry['shape']}, expected {dtype} {list(shape)}")
        a, b = entry["data_offsets"]
        return self.raw[a:b].view(_KINDS[dtype]).reshape(shape)


def write_tensors(path: str, tensors: dict[str, np.ndarray]) -> None:
    """Write float32 and uint16 (bf16 bits) arrays."""
    header, at, blobs = {}, 0, []
    for name, x in tensors.items():
        blob = np.ascontiguousarray(x).tobytes()
        header[name] = {"dtype": "BF16" if x.dtype == np.uint16 else "F32", "shape": list(x.shape), "data_offsets": [at, at + len(blob)]}
        at += len(blob)
        blobs.append(blob)
    head = json.dumps(header).encode()
    with open(path, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head + b"".join(blobs))
