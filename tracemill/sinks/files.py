"""Whole files from rows: transcripts as their harness would lay them out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame

#: Bytes of rows that are handed to Python at once, here and in what the files are made by.
BATCH, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def write(files: DataFrame, folder: str) -> None:
    """Writes each row (path, content) as the file ``path`` below ``folder`` (a URI of a shared store), content a string or bytes.

    A file appears whole or not at all and replaces the one before it, so a task that runs again does no harm. A null
    content is an empty file; rows without a path are left out. A task holds a few files at once, by their bytes, however
    many it writes.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in ((p.as_py(), c.as_py()) for p, c in zip(*batch.columns)):
                target = f"{root}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                # Another suffix than a transcript's, so that no reader takes the part for a file.
                part = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part, compression=None) as f:
                    f.write(content.encode("utf-8", "surrogatepass") if isinstance(content, str) else content or b"")
                store.move(part, target)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    conf = files.sparkSession.conf
    before = conf.get(BATCH, None)
    conf.set(BATCH, str(BYTES))
    try:
        files.select("path", "content").where("path is not null").mapInArrow(put, "path string").write.format("noop").mode("overwrite").save()
    finally:
        conf.unset(BATCH) if before is None else conf.set(BATCH, before)
