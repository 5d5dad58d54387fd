"""Greedy line chunks with overlap, cut where headings and running lengths say, on Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.corpus import split_lines

MOST_CHARS, OVERLAP = 2000, 200
HEADING = re.compile(r"\s{0,3}(#{1,6})\s+(.+?)\s*")
SCHEMA = "doc_id long, path string, chunk_id string, heading string, start_line long, end_line long, text string, text_sha256 string"


def fold_lines(lines: list[str]) -> list[tuple[str, int, int, str]]:
    """(heading, start_line, end_line, text) of each chunk.

    A chunk ends before the next heading, or with the line that brings it to MOST_CHARS, whichever comes first: both are looked up, in the
    positions of headings and in the running sum of lengths. A chunk of over OVERLAP characters lends its end to the one after it. After a cut by size the
    lent end counts as the chunk's first line, so a heading that follows at once leaves it a chunk of its own.
    """
    heads = [(k, found[2].strip()) for k, line in enumerate(lines) if (found := HEADING.fullmatch(line))]
    at_head = np.array([k for k, _ in heads], np.int64)
    upto = np.concatenate([[0], np.cumsum([len(line) + 1 for line in lines], dtype=np.int64)])
    done: list[tuple[str, int, int, str]] = []
    here, lent, by_size = 0, "", False
    while here < len(lines) or (by_size and lent):
        inside = by_size and bool(lent)  # the chunk begins within the line before
        k = int(np.searchsorted(at_head, here if inside else here + 1))
        section = heads[k][0] if k < len(heads) else len(lines)
        full = int(np.searchsorted(upto, upto[here] + MOST_CHARS - (len(lent) + 1 if lent else 0)))
        end, by_size = min(section, full), full <= section
        text = "\n".join([*([lent] if lent else ()), *lines[here:end]]).strip()
        if text:
            in_force = int(np.searchsorted(at_head, here - inside, side="right"))
            done.append((heads[in_force - 1][1] if in_force else "", here + (not inside), end, text))
        here, lent = end, text[-OVERLAP:] if len(text) > OVERLAP else ""
    return done


def chunk_lines(marked: DataFrame) -> DataFrame:
    """Chunks of files given as (doc_id, path, lines array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(8)]
            for doc, path, lines in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (heading, start, end, text) in enumerate(fold_lines(lines or []), 1):
                    for column, value in zip(out, (doc, path, f"{path}#{k:04d}", heading, start, end, text, hashlib.sha256(text.encode()).hexdigest())):
                        column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return marked.select("doc_id", "path", "lines").mapInArrow(run, SCHEMA)


def chunk_files(source: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return chunk_lines(source.select("doc_id", "path", split_lines(F.col("text")).alias("lines")))
