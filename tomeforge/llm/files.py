"""Binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class Committed:
    """A file that gets its name only once it is whole.

    Attempts of one task write the same bytes under names of their own, so that a
    lost executor leaves no half file behind and a repeated attempt does no harm.
    """

    def __init__(self, folder: str, name: str):
        self.system, path = locate(folder)
        self.system.create_dir(path, recursive=True)
        self.path, self.own = f"{path}/{name}", f"{path}/_{name}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.stream = self.system.open_output_stream(self.own)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.system.move(self.own, self.path)
        else:
            self.system.delete_file(self.own)
