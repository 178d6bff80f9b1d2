"""Arrays in files of the shared folder, memory-mapped by workers.

A file holds named arrays, each with a type and a length of its own.  Files are
written under a name of their own and moved into place, so a task that runs
twice does no harm.  Where the shared folder is a mounted path workers map the
files in place; elsewhere each worker maps a copy that it has unlinked at once.
A worker holds no more than ``MOST_MAPS`` files mapped.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs

MOST_MAPS = 512
_maps: OrderedDict[tuple[str, str], dict[str, np.ndarray]] = OrderedDict()


def _local(path: str) -> str | None:
    return path.removeprefix("file://") if path.startswith(("file:///", "/")) else (path.removeprefix("file:") if path.startswith("file:/") else None)


def write(root: str, name: str, columns: dict[str, np.ndarray]) -> None:
    """Writes one file of arrays."""
    columns = {k: np.ascontiguousarray(c) for k, c in columns.items()}
    head = json.dumps([[k, c.dtype.str, len(c)] for k, c in columns.items()]).encode()
    head += b" " * (-len(head) % 8)
    parts = [np.array([len(head)], np.int64).tobytes(), head]
    for c in columns.values():
        parts += [c.tobytes(), b"\0" * (-c.nbytes % 8)]
    own = f"{root}/{name}.{uuid.uuid4().hex}"
    if (path := _local(own)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            for p in parts:
                f.write(p)
        os.replace(path, _local(f"{root}/{name}"))
        return
    store, path = fs.FileSystem.from_uri(own)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        for p in parts:
            f.write(p)
    store.move(path, path.rpartition(".")[0])


def _mapped(uri: str) -> mmap.mmap | None:
    if (path := _local(uri)) is not None:
        if not os.path.exists(path):
            return None
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with tempfile.TemporaryFile() as f, store.open_input_stream(path) as source:
        while block := source.read(1 << 22):
            f.write(block)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def read(root: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped and kept for this worker; none if there is no such file."""
    if (held := _maps.get((root, name))) is not None:
        _maps.move_to_end((root, name))
        return held
    for other in [k for k in _maps if k[0] != root]:  # a worker may outlive a table
        del _maps[other]
    out: dict[str, np.ndarray] = {}
    if (data := _mapped(f"{root}/{name}")) is not None:
        at = 8 + int(np.frombuffer(data, np.int64, 1)[0])
        for column, kind, n in json.loads(data[8:at]):
            out[column] = np.frombuffer(data, kind, n, at)
            at += out[column].nbytes + -out[column].nbytes % 8
    _maps[root, name] = out
    while len(_maps) > MOST_MAPS:  # a file is unmapped when nothing uses its arrays any more
        _maps.popitem(last=False)
    return out


def find(keys: np.ndarray | None, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each wanted key in sorted keys."""
    if keys is None or not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted
