"""Feeds that Spark's readers can't take apart: JSON objects in a row with any layout, and numbered pages."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import checkpointed, unwrapped

_STRING = re.compile(rb'(?:[^"\\]|\\.)*+', re.DOTALL)
_MARK = re.compile(rb'["{}]')
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
#: Bytes of objects after which a batch is handed on.
BATCH_BYTES = 4_000_000


def walk(piece: bytes, state: int, depth: int, floor: int | None = 0) -> tuple[int, int, int, list[tuple[int, int]]]:
    """State, depth and least depth after a piece of text, and the (position, depth) pairs where the depth left 0 or came back to it.

    A closing brace at the floor's depth counts for nothing; without a floor depths may fall below 0, as where the depth at
    a text's start isn't known.
    """
    at, low, turns = 0, depth, []
    while at < len(piece):
        if state == ESCAPED:
            at, state = at + 1, INSIDE
        elif state == INSIDE:
            at = _STRING.match(piece, at).end()
            if at < len(piece):
                # a quote, or a backslash whose second half is in the next piece
                state, at = (OUTSIDE if piece[at] == 0x22 else ESCAPED), at + 1
        elif (mark := _MARK.search(piece, at)) is None:
            break
        else:
            at = mark.end()
            if mark[0] == b'"':
                state = INSIDE
            elif mark[0] == b"{":
                depth += 1
                if depth == 1:
                    turns.append((mark.start(), 1))
            elif floor is None or depth > floor:
                depth -= 1
                low = min(low, depth)
                if depth == 0:
                    turns.append((at, 0))
    return state, depth, low, turns


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text up to each closing brace, with its file and the range of the file that it was read in, in order within a task."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("piece"))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range its bytes, and what it does to a reader that comes from outside or inside a string: state, net depth, least depth."""
    key, found = None, None

    def row() -> pa.RecordBatch:
        path, start, size = key
        return pa.RecordBatch.from_pylist([{"path": path, "start": start, "size": size, "bytes": found[0], "ends": [list(map(int, e)) for e in found[1]]}], schema=_SUMMARY)

    for batch in batches:
        for path, start, size, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if (path, start, size) != key:
                if key:
                    yield row()
                key, found = (path, start, size), [0, [(s, 0, 0) for s in (OUTSIDE, INSIDE, ESCAPED)]]
            found[0] += len(piece) + 1
            ends = []
            for state, depth, low in found[1]:
                state, depth, least, _ = walk(piece + b"}", state, depth, None)
                ends.append((state, depth, min(low, least)))
            found[1] = ends
    if key:
        yield row()


_SUMMARY = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("ends", pa.list_(pa.list_(pa.int64())))])


def _states(summaries: DataFrame) -> DataFrame:
    """The state and depth in which each range of a file begins, and whether its last piece ends with the file and not with a brace."""

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        state, depth, out = OUTSIDE, 0, []
        # a brace too much was counted; a byte order mark is not among the pieces
        unclosed = pdf["bytes"].sum() - pdf["size"].iloc[0] in (1, -2)
        for i, (start, ends) in enumerate(zip(pdf["start"], pdf["ends"])):
            out.append((pdf["path"].iloc[0], start, state, depth, bool(unclosed and i == len(pdf) - 1)))
            after, net, low = map(int, ends[state])
            # braces that close nothing count for nothing
            state, depth = after, max(depth + net, net - low)
        return pd.DataFrame(out, columns=["path", "start", "state", "depth", "unclosed"])

    return summaries.groupBy("path").applyInPandas(follow, "path string, start long, state int, depth int, unclosed boolean")


def _parts(pieces: Iterator[tuple]) -> Iterator[tuple[str, bytes]]:
    """The objects and parts of objects in a range's pieces: ``whole``, or ``head``, ``middle`` and ``tail`` of objects that cross ranges."""
    parts: list[bytes] = []
    own, depth, ahead = True, 0, next(pieces)
    _, _, _, state, depth, unclosed = ahead
    own = depth == 0  # whether what is open began in this range
    while ahead:
        piece, ahead = ahead[2], next(pieces, None)
        text = piece if unclosed and ahead is None else piece + b"}"
        state, depth, _, turns = walk(text, state, depth)
        begin = 0
        for position, level in turns:
            if level:
                begin = position
            else:
                yield "whole" if own else "head", b"".join([*parts, text[begin:position]])
                parts, own = [], True
        if depth:
            parts.append(text[begin:])
    if depth:
        yield "tail" if own else "middle", b"".join(parts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for (path, start), pieces in itertools.groupby(rows, key=lambda r: r[:2]):
        out: list[tuple] = []
        for n, (kind, text) in enumerate(_parts(pieces)):
            out.append((path, start, n, kind, text))
            if sum(len(o[4]) for o in out[-64:]) > BATCH_BYTES or len(out) >= 4096:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    path, start, n, kind, text = zip(*out)
    return pa.RecordBatch.from_pydict({"path": path, "start": start, "n": pa.array(n, pa.int32()), "kind": kind, "json": pa.array(text, pa.binary())})


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``start``, ``n`` and ``json``: each top-level object of some files, whatever separates objects and however they are laid out.

    Objects may be pretty, in one line, in an array, or follow each other with or without commas. Files are read in ranges in
    parallel: a first pass tells what each range does to the depth of braces and to strings, a table of a row for each range
    says in which state a range begins, and a second pass cuts the objects; those that cross ranges are put together from
    their parts. Objects that a file's end cuts off are left out, and so is what stands outside of objects. ``start`` is the
    range in which an object begins and ``n`` its place there.
    """
    pieces = _pieces(spark, path)
    summaries = pieces.mapInArrow(_summaries, "path string, start long, size long, bytes long, ends array<array<long>>")
    # one row for each range of a file: as many as the driver plans tasks for
    states = checkpointed(_states(checkpointed(summaries)))
    known = F.when(F.col("state").isNull(), F.raise_error(F.lit("ranges of files changed between two reads: keep spark.sql.files.maxPartitionBytes"))).otherwise(F.col("state"))
    marked = pieces.join(F.broadcast(states), ["path", "start"], "left").select("path", "start", "piece", known.alias("state"), "depth", "unclosed")
    found = checkpointed(marked.mapInArrow(_cut, "path string, start long, n int, kind string, json binary"))
    # of what crosses ranges there are two rows for each range at most
    order = Window.partitionBy("path").orderBy("start", "n")
    parts = found.where("kind <> 'whole'").withColumn("_first", F.last(F.when(F.col("kind") == "tail", F.struct("start", "n")), True).over(order))
    in_order = F.array_sort(F.collect_list(F.struct("start", "n", "kind", "json")))
    across = parts.groupBy("path", "_first").agg(in_order.alias("_p")).where(F.element_at("_p", -1)["kind"] == "head")
    text = F.aggregate("_p", F.lit(b""), lambda s, p: F.concat(s, p["json"]))
    whole = found.where("kind = 'whole'").select("path", "start", "n", "json").unionByName(across.select("path", "_first.start", "_first.n", text.alias("json")))
    return whole.withColumn("json", F.decode("json", "UTF-8"))


def feed(objects: DataFrame, id_path: str = "id", wrapper: str = "raw_data", inner_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON objects: ``id`` and ``raw_data`` of those that have an id, of their own or inside their wrapper; and objects that are no JSON."""
    parsed = objects.withColumn("_ok", F.try_parse_json("json").isNotNull())
    raw = unwrapped(F.col("json"), (wrapper,))
    id_: Column = F.coalesce(F.nullif(F.get_json_object("json", f"$.{id_path}"), F.lit("")), F.get_json_object("json", f"$.{wrapper}.{inner_id}"))
    rows = parsed.where("_ok").select(id_.alias("id"), raw.alias("raw_data")).where("id IS NOT NULL")
    return rows, parsed.where("NOT _ok").select("path", "start", "n", "json", F.nullif(F.regexp_extract("json", '"id":\\s*"([^"]+)"', 1), F.lit("")).alias("id"))
