"""SQL out of a model's reply."""

from __future__ import annotations

import re

_FENCE = re.compile(r"\A\s*```[\w-]*[ \t]*\n|\n?[ \t]*```\s*\Z")
_BLOCK = re.compile(r"(?ims)^[ \t]*(?:with|select)\b.*?;[ \t]*$")


def strip_fences(text: str) -> str:
    return _FENCE.sub("", text).strip()


def extract_sql(text: str) -> str:
    """The longest statement that begins a line with WITH or SELECT and ends one with a semicolon.

    Without a semicolon, what follows the last line that begins so; else nothing.
    """
    parts = re.findall(r"```[\w-]*[ \t]*\n(.*?)```", text, re.S) or [strip_fences(text)]
    blocks = [b.strip() for p in parts for b in _BLOCK.findall(p)]
    if blocks:
        return max(blocks, key=len).rstrip(";").strip()
    starts = [m for p in parts for m in [re.search(r"(?ims)^[ \t]*(?:with|select)\b.*\Z", p)] if m]
    return max((m[0].strip() for m in starts), key=len, default="")
