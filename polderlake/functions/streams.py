"""Names of event streams, file paths and bronze tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_scheme(path: str) -> str:
    """`file:///a/b`, `file:/a/b` and `/a/b` -> `/a/b`; `s3a://x/a` -> `/x/a`."""
    return re.sub("/+", "/", re.sub("^[A-Za-z][A-Za-z0-9+.-]*:", "", path))


def stream_of_path(path: Column, root: str) -> Column:
    """`<root>/a/b/c/dt=...` -> `a.b.c`; null when the path lies elsewhere or has no date folder."""
    anchor = re.escape(without_scheme(root).strip("/"))
    found = F.regexp_extract(path, f"/{anchor}/(.+?)/dt=", 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit("/"), F.lit("."))


def table_of_stream(stream: Column, prefix: str) -> Column:
    """`<prefix>.a.b.c` -> `a_b_c`; null for another prefix or fewer than three parts."""
    parts = F.split(stream, r"\.")
    named = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "_")
    return F.when((F.size(parts) >= 3) & (F.element_at(parts, 1) == prefix), named)
