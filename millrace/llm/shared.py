"""Arrays as raw little-endian files in the shared folder: written by tasks, memory-mapped by workers.

Where the folder has no path (an object store), workers read the arrays that they use into memory of bounded size.  Nothing is
copied to a machine's own disk.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections import OrderedDict
from functools import lru_cache

import numpy as np


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, array: np.ndarray) -> None:
    """Writes under a name of its own and renames, so that a file is whole whichever attempt of a task ends first."""
    own = f"{uri}.{uuid.uuid4().hex}"
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(own), "wb") as out:
            out.write(memoryview(np.ascontiguousarray(array)).cast("B") if array.nbytes else b"")
        os.replace(_local(own), path)
        return
    store, path = _store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{path}{own[len(uri):]}") as out:
        out.write(np.ascontiguousarray(array).tobytes())
    try:
        store.move(f"{path}{own[len(uri):]}", path)
    except OSError:
        if store.get_file_info(path).type.name == "NotFound":
            raise
        store.delete_file(f"{path}{own[len(uri):]}")  # another attempt was first; it wrote the same


#: Maps that a worker holds, the last used ones; a process may have 65,530 on Linux.
MAPS = 30_000


@lru_cache(maxsize=MAPS)
def _memory_map(path: str, kind: str) -> np.ndarray:
    """A map outlives the file's descriptor, so that no number of files meets the limit of open ones."""
    with open(path, "rb") as source:
        if not os.fstat(source.fileno()).st_size:
            return np.zeros(0, kind)
        apart = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        return np.frombuffer(mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ, **apart), kind)


#: Arrays read from stores without paths, the last used ones at the end, and how many bytes of them a worker keeps.
_read: OrderedDict[str, np.ndarray] = OrderedDict()
KEPT = 256 << 20


def mapped(uri: str, kind: str) -> np.ndarray:
    """The file as a read-only memory map; from a store without paths, read into memory, of which a worker keeps the last used ``KEPT`` bytes."""
    if (path := _local(uri)) is not None:
        return _memory_map(path, kind)
    if uri not in _read:
        store, path = _store(uri)
        with store.open_input_file(path) as source:
            _read[uri] = np.frombuffer(source.read_buffer(), np.uint8)
        while len(_read) > 1 and sum(x.nbytes for x in _read.values()) > KEPT:
            _read.popitem(last=False)
    _read.move_to_end(uri)
    return _read[uri].view(kind)


def forget() -> None:
    """Drops all maps: their pages count as a worker's memory in later stages."""
    _memory_map.cache_clear()
    _read.clear()
