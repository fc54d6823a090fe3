"""Files of a store by their URI, on the driver or in Python workers."""

from __future__ import annotations

import re
from urllib.parse import quote

import pyarrow.fs

#: Fixed names: schemes that Hadoop has for what Arrow calls s3.
S3_SCHEMES = ("s3a", "s3n")


def filesystem_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system for a URI as Spark writes it, and the path in it.

    Plain paths and file: are local; s3a:// and s3n:// are read as s3://. What is
    not ASCII may stand there as it is. Schemes that Arrow does not know raise
    ValueError or ArrowInvalid.
    """
    named = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?=/)", uri)
    if not named:
        return pyarrow.fs.LocalFileSystem(), uri
    scheme, rest = named[1].lower(), uri[named.end() :]
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    scheme = "s3" if scheme in S3_SCHEMES else scheme
    return pyarrow.fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe="/:@?&=%+~!$'()*,;[]-._")}")
