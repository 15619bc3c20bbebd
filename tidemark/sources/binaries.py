"""External tools, looked up on first use on the machine that runs them."""

from __future__ import annotations

import shutil
from functools import cache


@cache
def find_binary(name: str, folder: str | None = None) -> str:
    """Full path of a tool in a folder, else on the search path; FileNotFoundError if it is in neither."""
    found = (folder and shutil.which(name, path=folder)) or shutil.which(name)
    if not found:
        raise FileNotFoundError(f"{name} is not on the search path")
    return found
