"""Files in and out: plain texts, DOCX, NDJSON. Other formats go through a reader that is passed in."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import placed
from ..session import cut, ship

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: A page with fewer letters than this is taken for a scan.
LETTERS_PER_PAGE = 40
Reader = Callable[[bytes], tuple[str, list[str], str]]


def docx_markdown(data: bytes) -> str:
    """Headings, list items, paragraphs and tables of a DOCX file as markdown, in the order of the document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names: dict[str, str] = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId", "")] = (name.get(f"{_W}val", "") if name is not None else "").lower()

    def text(node: ElementTree.Element) -> str:
        out = []
        for x in node.iter():
            out += [x.text or ""] if x.tag == f"{_W}t" else ["\t"] if x.tag == f"{_W}tab" else ["\n"] if x.tag == f"{_W}br" else []
        return "".join(out).strip()

    lines = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p" and text(node):
            mark = node.find(f"{_W}pPr/{_W}pStyle")
            style = mark.get(f"{_W}val", "") if mark is not None else ""
            style = names.get(style, style.lower())
            if "heading" in style or "title" in style:
                level = next((int(c) for c in style if c.isdigit()), 1)
                lines.append("#" * min(max(level, 1), 6) + " " + text(node))
            else:
                lines.append(("- " if "list" in style else "") + text(node))
        elif node.tag == f"{_W}tbl":
            rows = [[text(c) for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            for n, r in enumerate(rows):
                lines.append("| " + " | ".join(r) + " |")
                if n == 0:
                    lines.append("| " + " | ".join("---" for _ in r) + " |")
    return "\n".join(lines)


def scanned(letters: int, pages: int) -> bool:
    """Whether a document's text is so thin that it must be read from its pictures."""
    return letters / max(pages, 1) < LETTERS_PER_PAGE


def read_documents(spark: SparkSession, path: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """path, text, method, warnings, error of every file below ``path``; a file that fails is a row with an error.

    TXT and DOCX are read here; ``readers`` has a function for each other suffix (pdf for instance).
    """
    ship(spark)
    more = dict(readers or {})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, data in zip(b["path"], b["content"]):
                suffix = name.rpartition(".")[2].lower()
                try:
                    if suffix in more:
                        text, warnings, method = more[suffix](bytes(data))
                    elif suffix == "txt":
                        text, warnings, method = bytes(data).decode("utf-8"), [], "txt"
                    elif suffix == "docx":
                        text, warnings, method = docx_markdown(bytes(data)), [], "docx_markdown"
                    else:
                        raise ValueError(f"no reader for .{suffix}")
                    rows.append((name, text, method, list(warnings), None))
                except Exception as error:  # one bad file must not end the job
                    rows.append((name, None, None, [], f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "text", "method", "warnings", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(read, "path string, text string, method string, warnings array<string>, error string")


def accepted(files: DataFrame, column: str, suffixes: tuple[str, ...] = ("pdf", "docx")) -> tuple[DataFrame, DataFrame]:
    """Rows whose file name has an accepted suffix, and the others with a reason."""
    fine = F.coalesce(F.lower(F.regexp_extract(column, r"\.([^.]+)$", 1)).isin(*suffixes), F.lit(False))
    return files.where(fine), files.where(~fine).withColumn("error", F.lit("unsupported file type"))


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Write files (file_name, content) into a folder every executor reaches, and return file_name, path, bytes, error of each.

    A file of a name that is there is replaced; names are cut to what follows their last slash. What is written appears
    under its name only when it is whole, so a task that is run again does no harm. Works on a mounted file system.
    """
    ship(files.sparkSession)

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            rows = []
            for name, data in zip(b["file_name"], b["content"]):
                own = re.split(r"[/\\\\]", name or "")[-1]
                try:
                    if own in ("", ".", "..") or data is None:
                        raise ValueError("no name or no content")
                    path = os.path.join(folder, own)
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    with open(part, "wb") as f:
                        f.write(bytes(data))
                    os.replace(part, path)
                    rows.append((name, path, len(data), None))
                except Exception as error:  # one bad file must not end the job
                    rows.append((name, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["file_name", "path", "bytes", "error"]).astype({"bytes": "Int64"})

    return cut(files.select("file_name", "content").mapInPandas(save, "file_name string, path string, bytes long, error string"))


def raw_dumps(texts: DataFrame) -> DataFrame:
    """path, dump: the extracted text of each document under its method and length, to be written for inspection."""
    head = F.concat(F.lit("[extraction_method="), F.coalesce("method", F.lit("none")), F.lit("]\n[char_count="), F.length(F.coalesce("text", F.lit(""))).cast("string"), F.lit("]\n\n"))
    return texts.select("path", F.concat(head, F.coalesce("text", F.lit(""))).alias("dump"))


def progress_events(results: DataFrame, total: int) -> DataFrame:
    """seq (0, 1, ...), json: a meta event, then rejected files, then the others by name; null fields are left out."""
    spark = results.sparkSession
    meta = spark.createDataFrame([(0, "meta", total)], "seq long, type string, total int")
    order = F.struct((F.col("status") == "ok").alias("late"), F.col("file_name"))
    ranked = results.select(order.alias("o"), F.lit("result").alias("type"), "file_name", "status", "candidate_id", "error")
    events = placed(ranked.withColumn("all", F.lit(0)), "all", [F.col("o.late"), F.col("o.file_name"), F.col("candidate_id")], "seq").drop("o", "all").withColumn("seq", F.col("seq").cast("long"))
    both = meta.unionByName(events, allowMissingColumns=True)
    return both.select("seq", F.to_json(F.struct("type", "total", "file_name", "status", "candidate_id", "error")).alias("json"))


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; malformed lines are left out, and a last line without its end is read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def progress_counts(events: DataFrame) -> DataFrame:
    """done, ok, failed, total of progress events."""
    is_ = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    result = F.col("type") == "result"
    return events.agg(is_(result).alias("done"), is_(result & (F.col("status") == "ok")).alias("ok"), is_(result & (F.col("status") != "ok")).alias("failed"), F.max("total").alias("total"))
