"""Message framing of byte streams: octet counts or newlines, found out per connection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.config import Limits
from millrace.functions.text import decode_bytes

_COUNT = re.compile(rb"([0-9]{1,10}) ")


@dataclass
class Framer:
    """State of one connection: what is left of its bytes, its style once known, its error once broken.

    The style is octet counting if a whole counted frame comes first, else newlines; the first
    frame settles it. After an error nothing more is accepted. Only what is left after all whole
    frames were taken is held against the limit, so a full buffer of good frames is no error.
    """

    limit: int = Limits.max_message_bytes
    buffer: bytes = b""
    style: str = ""
    error: str = ""
    frames: list[bytes] = field(default_factory=list)

    def _counted(self) -> bytes | None:
        m = _COUNT.match(self.buffer)
        if not m:
            if self.style == "octet" and self.buffer and (not self.buffer[:11].isdigit() or len(self.buffer) > 10):
                self.error = "FRAME:no octet count where one was due"
            return None
        n = int(m[1])
        if not 0 < n <= self.limit:
            if self.style == "octet" or b"\n" not in self.buffer:
                self.error = f"FRAME:invalid octet count {n}"
            return None
        if len(self.buffer) < m.end() + n:
            return None
        frame, self.buffer = self.buffer[m.end() : m.end() + n], self.buffer[m.end() + n :]
        return frame

    def _line(self) -> bytes | None:
        line, sep, rest = self.buffer.partition(b"\n")
        if not sep:
            return None
        self.buffer = rest
        return line[:-1] if line.endswith(b"\r") else line

    def feed(self, chunk: bytes) -> list[bytes]:
        """The frames that are whole with these bytes."""
        out: list[bytes] = []
        if self.error:
            return out
        self.buffer += chunk
        while self.buffer and not self.error:
            frame = self._counted() if self.style != "newline" else None
            if frame is not None:
                self.style = "octet"
            elif self.style != "octet" and not self.error and (frame := self._line()) is not None:
                self.style = "newline"
            if frame is None:
                break
            out.append(frame)
        if not self.error and len(self.buffer) > self.limit + 16:
            self.error = f"LIMIT:unframed data of more than {self.limit} bytes"
        return out


_FRAMES = "connection string, seq bigint, frame binary, error string"


def frames(chunks: DataFrame, limit: int = Limits.max_message_bytes) -> DataFrame:
    """connection, seq, frame, error from chunks (connection, seq, data).

    A connection is one ordered state, so one task reads it, but in batches: what it holds is the
    bytes of an unfinished frame, however long the connection is. A null connection is one of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name: object = object()
        f, n = Framer(limit), 0

        def end() -> list[tuple]:
            return [(name, n, None, f.error)] if f.error else []

        for pdf in batches:
            rows: list[tuple] = []
            for own, data in zip(pdf["connection"], pdf["data"]):
                if own != name:
                    rows += end()
                    name, f, n = own, Framer(limit), 0
                for x in f.feed(bytes(data or b"")):
                    rows.append((name, n, x, None))
                    n += 1
            yield pd.DataFrame(rows, columns=["connection", "seq", "frame", "error"])
        yield pd.DataFrame(end(), columns=["connection", "seq", "frame", "error"])

    ordered = chunks.select("connection", "seq", "data").repartition("connection").sortWithinPartitions("connection", "seq")
    return ordered.select("connection", "data").mapInPandas(run, _FRAMES)


def framed_blobs(blobs: DataFrame, limit: int = Limits.max_message_bytes) -> DataFrame:
    """connection, seq, frame, error from whole captures (connection, data): row-local, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["connection"], pdf["data"]):
                f = Framer(limit)
                got = f.feed(bytes(data or b""))
                rows += [(name, i, x, None) for i, x in enumerate(got)] + ([(name, len(got), None, f.error)] if f.error else [])
            yield pd.DataFrame(rows, columns=["connection", "seq", "frame", "error"])

    return blobs.select("connection", "data").mapInPandas(run, _FRAMES)


def datagrams(packets: DataFrame, limit: int = Limits.max_message_bytes, counters: Observation | None = None) -> DataFrame:
    """Packets (data) within the size limit; longer ones are no messages, and are counted in counters (events_oversized_datagram)."""
    if counters is not None:
        packets = packets.observe(counters, F.count_if(F.octet_length("data") > limit).alias("events_oversized_datagram"))
    return packets.where(F.octet_length("data") <= limit)


def decoded(rows: DataFrame, data: str = "data") -> DataFrame:
    """Adds raw_message, raw_bytes_b64 and decode_note to rows of bytes; no byte is lost."""
    text, b64, note = decode_bytes(F.col(data))
    return rows.withColumns({"raw_message": text, "raw_bytes_b64": b64, "decode_note": note})
