"""Notes in, chunks out (IO1-IO5, CH1-CH24)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import markdown as M
from notelake.functions.analyzer import tokenize

CHUNKS = "chunk_id string, note_path string, title string, content string, heading_path array<string>, start_line int, end_line int, lexical_only boolean, dense_suffix string, link_terms string, part int, tags array<string>, aliases array<string>, created string, properties map<string,array<string>>, embed_input string"


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """IO1: whole files with path and time of change."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{md,base}").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("note_path"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("raw"))


def indexable(path: Column, prefixes: list[str], ignored: list[str]) -> Column:
    """IO2: not below a reserved prefix, an ignored folder or a /pattern/."""
    out = F.lit(True)
    for p in prefixes:
        out = out & ~path.startswith(p)
    for i in ignored:
        out = out & (~F.regexp_like(path, F.lit(i[1:-1])) if len(i) > 2 and i[0] == i[-1] == "/" else ~path.startswith(i.rstrip("/") + "/"))
    return out


def word_count(text: str) -> int:
    """The default token counter; any function of a text may stand in for it."""
    return len(tokenize(text, derived=False))


def _rows(raw: str, path: str, count: Callable[[str], int]) -> list[tuple]:
    if path.endswith(".base"):
        chunks, meta = M.base_docs(raw, path), {"tags": [], "aliases": [], "created": None, "properties": {}}
    else:
        chunks, meta = M.chunk_note(raw, path)
    out = {}
    for c in (p for own in chunks for p in M.within_budget(own, count)):
        i = M.chunk_id(path, c)
        out.setdefault(i, (i, path, c.title, c.content, c.heading_path, c.start_line, c.end_line, c.lexical_only, c.dense_suffix, c.link_terms, c.part, meta["tags"], meta["aliases"], meta["created"], meta["properties"], M.embed_input(c)))
    return list(out.values())


def chunk_notes(notes: DataFrame, count: Callable[[str], int] = word_count) -> DataFrame:
    """Chunks of ``(note_path, raw)``: a note is cut in one place, notes anywhere. Null text is empty."""
    names = [f.split(" ")[0] for f in CHUNKS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [r for p, t in zip(pdf["note_path"], pdf["raw"], strict=True) for r in _rows(t or "", p or "", count)]
            yield pd.DataFrame(rows, columns=names)

    return notes.select("note_path", "raw").mapInPandas(run, CHUNKS)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than the session has cores, dealt over all cores; any other scan as it is.

    Files of one row group cannot be split, which leaves costly functions of
    their rows to one task.  Large inputs have many splits and are not moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def documents_as_notes(documents: DataFrame) -> DataFrame:
    """The documents table as notes: the source is the folder, the language a tag."""
    front = F.concat(F.lit("---\ntags: ["), F.col("lang"), F.lit("]\nsource: "), F.col("source"), F.lit("\n---\n"))
    return documents.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("note_path"), F.concat(front, "text").alias("raw"))


def conversations_as_notes(conversations: DataFrame) -> DataFrame:
    """Conversations as notes: a section for each turn."""
    turn = F.concat(F.lit("## "), "role", F.lit("\n"), "text")
    own = conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("raw"))
    return own.select(F.concat(F.lit("chats/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("note_path"), "raw")


def pages_as_notes(pages: DataFrame) -> DataFrame:
    """Pages as notes: HTML read as text."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"note_path": [f"pages/{i}.md" for i in pdf["page_id"]], "raw": [M.html_text(h or "") for h in pdf["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "note_path string, raw string")
