"""Binary layouts of patch, surface and curvature files, as bytes in and arrays out."""

from __future__ import annotations

import struct

import numpy as np

#: Magic numbers of triangle surfaces and of curvature files (3 bytes, big-endian).
TRIANGLES, CURVATURE = 0xFFFFFE, 0xFFFFFF
PATCH_RECORD = np.dtype([("id", ">i4"), ("x", ">f4"), ("y", ">f4"), ("z", ">f4")])
PATCH_HEADER, CURVATURE_HEADER = 8, 15


def read_patch(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(xyz float64, vertex ids, is_border). Border vertices are stored as -(id + 1), others as id + 1."""
    if len(raw) < 8:
        raise ValueError(f"a patch has a header of 8 bytes, not {len(raw)}")
    head, n = struct.unpack(">2i", raw[:8])
    if head != -1:
        raise ValueError(f"patch header is {head}, not -1")
    if len(raw) - 8 < n * PATCH_RECORD.itemsize:
        raise ValueError(f"patch of {n} vertices needs {n * PATCH_RECORD.itemsize} bytes, has {len(raw) - 8}")
    return patch_records(raw[8 : 8 + n * PATCH_RECORD.itemsize])


def patch_records(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of records without a header."""
    rows = np.frombuffer(raw, PATCH_RECORD)
    stored = rows["id"].astype(np.int64)
    xyz = np.stack([rows[a].astype(np.float64) for a in "xyz"], axis=1)
    return xyz, np.abs(stored) - 1, stored < 0


def write_patch(xyz: np.ndarray, ids: np.ndarray, border: np.ndarray | None = None) -> bytes:
    """Two columns get z = 0."""
    rows = np.zeros(len(ids), PATCH_RECORD)
    stored = np.asarray(ids, dtype=np.int64) + 1
    rows["id"] = stored if border is None else np.where(border, -stored, stored)
    for i, a in enumerate("xyz"[: xyz.shape[1] if len(ids) else 0]):
        rows[a] = xyz[:, i]
    return patch_header(len(ids)) + rows.tobytes()


def patch_header(n: int) -> bytes:
    return struct.pack(">2i", -1, n)


def read_surface(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(vertices float64, faces int64) of a triangle surface: magic, comment lines up to an empty one, counts, coordinates, faces."""
    if int.from_bytes(raw[:3], "big") != TRIANGLES:
        raise ValueError("not a triangle surface")
    at = raw.index(b"\n\n") + 2
    n, m = struct.unpack(">2i", raw[at : at + 8])
    if len(raw) < at + 8 + 12 * (n + m):
        raise ValueError("the surface is cut short")
    return np.frombuffer(raw, ">f4", 3 * n, at + 8).reshape(n, 3).astype(np.float64), np.frombuffer(raw, ">i4", 3 * m, at + 8 + 12 * n).reshape(m, 3).astype(np.int64)


def write_surface(vertices: np.ndarray, faces: np.ndarray, comment: str = "created by meshql") -> bytes:
    return TRIANGLES.to_bytes(3, "big") + comment.encode() + b"\n\n" + struct.pack(">2i", len(vertices), len(faces)) + np.asarray(vertices, ">f4").tobytes() + np.asarray(faces, ">i4").tobytes()


def read_curvature(raw: bytes) -> np.ndarray:
    """One value per vertex."""
    if int.from_bytes(raw[:3], "big") != CURVATURE:
        raise ValueError("not a curvature file")
    n, _, each = struct.unpack(">3i", raw[3:15])
    if each != 1 or len(raw) < 15 + 4 * n:
        raise ValueError("a curvature file has one value for each vertex")
    return np.frombuffer(raw, ">f4", n, 15).astype(np.float64)


def write_curvature(values: np.ndarray, n_faces: int = 0) -> bytes:
    return curvature_header(len(values), n_faces) + np.asarray(values, ">f4").tobytes()


def curvature_header(n: int, n_faces: int = 0) -> bytes:
    return CURVATURE.to_bytes(3, "big") + struct.pack(">3i", n, n_faces, 1)


def curvature_values(raw: bytes) -> np.ndarray:
    """Values without a header."""
    return np.frombuffer(raw, ">f4").astype(np.float64)
