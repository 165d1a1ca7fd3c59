"""Arrays in files of the shared folder: written aside and renamed; mapped where the folder is a file system, else read."""

from __future__ import annotations

import os
import uuid

import numpy as np


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of names, types and lengths, then the arrays, each at a multiple of 64 bytes."""
    head, at, body = [], 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append(f"{name}:{a.dtype.str}:{len(a)}:{at}")
        body.append((at, a))
        at += -(-a.nbytes // 64) * 64
    line = " ".join(head).encode()
    line = line + b" " * (63 - len(line) % 64) + b"\n"
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        system, target = fs.FileSystem.from_uri(uri)
        temporary = f"{target}.{uuid.uuid4().hex}"
        stream = system.open_output_stream(temporary)
    else:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.{uuid.uuid4().hex}"
        stream = open(temporary, "wb")  # noqa: SIM115
    with stream:
        stream.write(line)
        for at, a in body:
            data = a.tobytes()
            stream.write(data + b"\0" * (-len(data) % 64))
    if path is not None:
        os.replace(temporary, path)
        return
    there = lambda: system.get_file_info(target).type != fs.FileType.NotFound
    try:  # another attempt of the task may have been faster; its content is the same
        if there():
            system.delete_file(temporary)
        else:
            system.move(temporary, target)
    except OSError:
        if not there():
            raise


def is_mapped(uri: str) -> bool:
    return _local(uri) is not None


def load(uri: str) -> dict[str, np.ndarray]:
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        system, target = fs.FileSystem.from_uri(uri)
        with system.open_input_file(target) as f:
            data = np.frombuffer(f.read_buffer(), np.uint8)
    else:
        data = np.asarray(np.memmap(path, np.uint8, "r"))
    end = 0
    while data[end] != 10:
        end += 63 if end == 0 else 64
    out = {}
    for x in bytes(data[:end]).decode().split():
        name, kind, n, at = x.split(":")
        first, kind = end + 1 + int(at), np.dtype(kind)
        out[name] = data[first : first + int(n) * kind.itemsize].view(kind)
    return out


def remove(uri: str) -> None:
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        system, target = fs.FileSystem.from_uri(uri)
        system.delete_dir(target)
    else:
        import shutil

        shutil.rmtree(path, ignore_errors=True)
