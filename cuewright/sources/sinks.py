"""Results written to files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(df: DataFrame, folder: str, ending: str = "") -> None:
    """Each row (name, body) as one file of a folder; a body without a line break at its end gets one. A file is written aside and then renamed, so a task run twice leaves it whole; other files stay.

    folder: a url of a file system all executors reach (hdfs, s3, gs, or file: on a mounted disk). A path without a scheme is each machine's own, and is taken with a local master only.
    """
    if "://" not in folder and not folder.startswith("file:"):
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise ValueError(f"not a url all machines share: {folder}")
        folder = os.path.abspath(folder)

    def write(rows) -> None:
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        for name, body in rows:
            path = f"{base}/{name}{ending}"
            aside = f"{path}.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(aside) as f:
                f.write((body if body.endswith("\n") else body + "\n").encode())
            fs.move(aside, path)

    df.select("name", "body").where("name is not null and body is not null").foreachPartition(write)


def _file_system(folder: str):
    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return fs, base.rstrip("/")


def write_people(people: DataFrame, path: str) -> None:
    """(key, name) as one JSON object with sorted keys, nothing where there are none. A corpus's people are a small dimension: one row of text."""
    one = people.where("key is not null").groupBy().agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "name"))))).alias("value")).where("value <> '{}'")
    if not one.isEmpty():
        one.coalesce(1).write.mode("overwrite").text(path)


def write_graph(people: DataFrame, edges: DataFrame, folder: str) -> None:
    """A graph as two tables, people and edges; no value holds all of it."""
    people.write.mode("overwrite").parquet(f"{folder}/people")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def append_log(results: DataFrame, path: str) -> None:
    """Results as lines of an append-only JSON log."""
    results.write.mode("append").json(path)


def write_notes(people: DataFrame, edges: DataFrame, recordings: DataFrame, folder: str, weights: bool = False, files: DataFrame | None = None) -> DataFrame:
    """A note for every person of a graph as a file of a folder, in one call; gives the row of statistics of what was written (people, recurring, local, edges, stated, implied)."""
    from cuewright.operators.render import note_statistics, person_notes

    notes = person_notes(people, edges, recordings, weights, files)
    write_files(notes.select(notes.file.alias("name"), "body"), folder, ".md")
    return note_statistics(people, edges)
