"""A queue of messages as a folder of growing files, for batches and streams.

Producers append lines to the segments of a folder, each an envelope ``{"routing_key", "reply_to", "correlation_id", "headers", "body"}``
whose body is a JSON text. Spark's own file source reads a file once, when it first sees it; this one goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a segment that one task reads, and of the lines in one Arrow batch.
PIECE, BATCH = 32 << 20, 4 << 20
TAIL = 1 << 16
SCHEMA = "segment string, position long, value string"
ENVELOPE = "routing_key string, reply_to string, correlation_id string, headers map<string,string>, body string"


@dataclass
class Piece(InputPartition):
    """Those lines of a segment that start at ``start`` or later and before ``end``."""

    segment: str
    start: int
    end: int
    cut: bool


class _Folder:
    """What the readers of both kinds do; tasks open files by URI, so the folder may lie in any file system that Arrow knows."""

    def __init__(self, options: dict):
        self.uri, self.piece = options["path"].rstrip("/"), int(options.get("piecebytes", PIECE))

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri if ":/" in self.uri else f"file://{self.uri}")

    def ends(self, known: dict[str, int]) -> dict[str, int]:
        """The end of the last whole line of each segment; a line that a producer hasn't ended yet waits. Only what was appended
        after ``known`` is looked at, backwards from the end."""
        from pyarrow import fs

        system, home = self._fs()
        out = {}
        for f in system.get_file_info(fs.FileSelector(home, allow_not_found=True)):
            if not f.is_file or f.base_name[0] in "._":
                continue
            low, high = known.get(f.base_name, 0), f.size
            with system.open_input_file(f.path) as file:
                while high > low:
                    start = max(low, high - TAIL)
                    file.seek(start)
                    at = file.read(high - start).rfind(b"\n")
                    if at >= 0:
                        low = start + at + 1
                        break
                    high = start
            out[f.base_name] = low
        return out

    def pieces(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        return [Piece(s, a, min(a + self.piece, z), a > start.get(s, 0)) for s, z in sorted(end.items()) for a in range(start.get(s, 0), z, self.piece)]

    def lines(self, p: Piece) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("segment", pa.string()), ("position", pa.int64()), ("value", pa.string())])
        system, home = self._fs()
        with system.open_input_file(f"{home}/{p.segment}") as raw:
            # from the byte before a cut on, as the rest of a line that starts in the piece before is passed over
            at = p.start - p.cut
            raw.seek(at)
            skip, rest, positions, values, held = p.cut, b"", [], [], 0
            while at < p.end:
                block = raw.read(1 << 20)
                if not block:
                    break
                *whole, tail = (rest + block).split(b"\n")
                for line in whole:
                    if at >= p.end:
                        break
                    if not skip and line.strip():
                        positions.append(at)
                        values.append(line.decode("utf-8", "replace"))
                        held += len(line)
                    skip, at = False, at + len(line) + 1
                rest = tail
                if held >= BATCH:
                    yield pa.record_batch([[p.segment] * len(positions), positions, values], schema=schema)
                    positions, values, held = [], [], 0
            if positions:
                yield pa.record_batch([[p.segment] * len(positions), positions, values], schema=schema)


class _Batch(DataSourceReader, _Folder):
    def __init__(self, options: dict):
        _Folder.__init__(self, options)

    def partitions(self):
        return self.pieces({}, self.ends({})) or [Piece("", 0, 0, False)]

    def read(self, partition: Piece):
        return self.lines(partition) if partition.end else iter(())


class _Stream(DataSourceStreamReader, _Folder):
    """An offset is the end of what was read of each segment that is still there."""

    def __init__(self, options: dict):
        _Folder.__init__(self, options)
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.last = self.ends(self.last)
        return self.last

    def partitions(self, start: dict, end: dict):
        return self.pieces(start, end)

    def read(self, partition: Piece):
        return self.lines(partition)


class Messages(DataSource):
    """``spark.read`` or ``spark.readStream`` of format "messages": SCHEMA of a folder, a row a line."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(Messages)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value."""
    return F.call_function("try_parse_json", text).isNotNull()


def opened(lines: DataFrame) -> DataFrame:
    """(message_id, routing_key, reply_to, correlation_id, headers, body, error) of lines of SCHEMA. ``error`` says why a message can't be
    taken: its line is no envelope (then the line is its body), or its body is no JSON."""
    e = F.from_json("value", ENVELOPE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(F.concat_ws(":", "segment", "position").alias("message_id"), "value", e.alias("e"))
    whole = F.col("e").isNotNull() & F.col("e._bad").isNull() & F.col("e.body").isNotNull()
    fields = [F.when(whole, F.col(f"e.{c}")).alias(c) for c in ("routing_key", "reply_to", "correlation_id", "headers")]
    error = F.when(~whole, "EnvelopeError: the line is no envelope").when(~is_json(F.col("e.body")), "JSONDecodeError: the body is no JSON")
    return rows.select("message_id", *fields, F.when(whole, F.col("e.body")).otherwise(F.col("value")).alias("body"), error.alias("error"))
