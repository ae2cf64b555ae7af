"""Where messages come from: files, lists, sockets. All give the columns that the pipeline reads."""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from millrace.config import Limits
from millrace.sources.framing import Framer, decoded


def oversized(column: str, limit: int, name: str) -> Column:
    """The counter of messages that are left out for their size, for DataFrame.observe."""
    return F.count_if(F.octet_length(column) > limit).alias(name)


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds file_line_number (1-based) to lines with file_path and file_block_start, in the order they were read.

    Lines are numbered within the part of a file that Spark read as one split, plus the number of
    lines in the splits before: only counts per split are put in order, so a file of any size is
    numbered by as many tasks as it has splits.
    """
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file_path").orderBy("file_block_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = lines.groupBy("file_path", "file_block_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).withColumn("_before", before)
    return lines.join(splits, ["file_path", "file_block_start"]).withColumn("file_line_number", F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_id", "_n", "_first", "_before", "file_block_start")


def _file_lines(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("value").cast("binary").alias("data"), F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file_path"), F.col("_metadata.file_block_start").alias("file_block_start"))


def _as_file(rows: DataFrame) -> DataFrame:
    out = decoded(rows).withColumns({"transport": F.lit("file"), "transport_protocol": F.lit("file/line")})
    return out.select("transport", "transport_protocol", "file_path", *[c for c in ("file_line_number", "file_block_start") if c in out.columns], "raw_message", "raw_bytes_b64", "decode_note")


def read_files(spark: SparkSession, paths: str | list[str], limit: int = Limits.max_message_bytes, counters: Observation | None = None) -> DataFrame:
    """Lines of log files: one event a line, blank lines included, with file_path and 1-based file_line_number.

    Lines over the limit are left out, and counted in counters (events_oversized_file_line) when
    the result has been consumed.
    """
    numbered = number_lines(_file_lines(spark.read.format("text").load(paths)))
    if counters is not None:
        numbered = numbered.observe(counters, oversized("data", limit, "events_oversized_file_line"))
    return _as_file(numbered.where(F.octet_length("data") <= limit))


def stream_files(spark: SparkSession, path: str, per_trigger: int = 100, limit: int = Limits.max_message_bytes) -> DataFrame:
    """The lines of files that arrive in a folder, as a stream. Line numbers are given per micro-batch (number_lines), which holds whole files.

    Lines over the limit come with a null message, so that the numbers stay right; they are counted as the stream's metric.
    """
    lines = _file_lines(spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path))
    lines = lines.observe("files", oversized("data", limit, "events_oversized_file_line"))
    return _as_file(lines.withColumn("data", F.when(F.octet_length("data") <= limit, F.col("data"))))


def replay(spark: SparkSession, messages: Sequence[str | bytes], transport: str = "replay") -> DataFrame:
    """A list of messages, in order, as rows."""
    rows = [(i + 1, m if isinstance(m, bytes) else m.encode("utf-8", "surrogateescape")) for i, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "file_line_number bigint, data binary")
    return decoded(df).select(F.lit(transport).alias("transport"), F.lit(f"{transport}/line").alias("transport_protocol"), "file_line_number", "raw_message", "raw_bytes_b64", "decode_note")


def inline(spark: SparkSession, text: str, **meta: object) -> DataFrame:
    """One message with attributes of the caller's own."""
    df = spark.createDataFrame([(text,)], "raw_message string")
    return df.withColumns({k: F.lit(v) for k, v in meta.items()})


#: A row is a message, or tells of one (or of a connection) that was turned away: rejected is then the name of its counter.
_NET = "data binary, peer_ip string, peer_port int, local_port int, received double, seq bigint, rejected string"
PARTITION_ROWS = 2_000
REJECTIONS = ("events_oversized_datagram", "connections_rejected_limit", "error.FRAME_ERROR")

class _NetReader(DataSourceStreamReader):
    """A listener on the driver; each read takes what has come in since.

    Messages are in memory until their batch is committed. A batch that is asked for again is
    given again as long as the driver lives; UDP and TCP themselves promise no more.
    """

    def __init__(self, kind: str, options: dict) -> None:
        self.kind, self.limit = kind, int(options.get("limit", Limits.max_message_bytes))
        self.max_connections = int(options.get("maxConnections", Limits.max_connections))
        self.address = (options.get("host", "127.0.0.1"), int(options["port"]))
        self.rows: list[tuple] = []
        self.base = 0
        self.sock: socket.socket | None = None

    def _open(self) -> socket.socket:
        if self.sock is None:
            self.sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM if self.kind == "udp" else socket.SOCK_STREAM)
            self.sock.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            if self.kind == "udp":
                self.sock.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 4 << 20)
            self.sock.bind(self.address)
            self.sock.setblocking(False)
            self.peers: dict[socket.socket, tuple[tuple, Framer]] = {}
            if self.kind == "tcp":
                self.sock.listen(64)
        return self.sock

    def _poll(self, seconds: float = 0.05) -> None:
        s, until = self._open(), time.time() + seconds
        while time.time() < until:
            got = self._poll_udp(s) if self.kind == "udp" else self._poll_tcp(s)
            if not got:
                time.sleep(0.005)

    def _put(self, data: bytes | None, peer: tuple, rejected: str | None = None) -> None:
        self.rows.append((data, peer[0], peer[1], self.address[1], time.time(), self.base + len(self.rows), rejected))

    def _poll_udp(self, s: socket.socket) -> bool:
        try:
            data, peer = s.recvfrom(self.limit + 1)
        except BlockingIOError:
            return False
        if len(data) > self.limit:
            self._put(None, peer, "events_oversized_datagram")
        else:
            self._put(data, peer)
        return True

    def _poll_tcp(self, s: socket.socket) -> bool:
        got = False
        try:
            conn, peer = s.accept()
            if len(self.peers) >= self.max_connections:
                conn.close()
                self._put(None, peer, "connections_rejected_limit")
            else:
                conn.setblocking(False)
                self.peers[conn] = (peer, Framer(self.limit))
            got = True
        except BlockingIOError:
            pass
        for conn, (peer, framer) in list(self.peers.items()):
            try:
                data = conn.recv(65_536)
            except BlockingIOError:
                continue
            except OSError:
                data = b""
            got = True
            for f in framer.feed(data):
                self._put(f, peer)
            if framer.error:
                self._put(None, peer, "error.FRAME_ERROR")
            if not data or framer.error:
                conn.close()
                del self.peers[conn]
        return got

    def initialOffset(self) -> dict:
        self._open()
        return {"n": 0}

    def latestOffset(self) -> dict:
        self._poll()
        return {"n": self.base + len(self.rows)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = self.rows[start["n"] - self.base : end["n"] - self.base]
        return [_Rows(rows[i : i + PARTITION_ROWS]) for i in range(0, max(1, len(rows)), PARTITION_ROWS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return iter(partition.value)

    def commit(self, end: dict) -> None:
        done = end["n"] - self.base
        self.rows, self.base = self.rows[done:], end["n"]

    def stop(self) -> None:
        if self.sock is not None:
            for c in self.peers:
                c.close()
            self.sock.close()


class _Rows(InputPartition):
    def __init__(self, rows: list[tuple]) -> None:
        super().__init__(rows)


class UdpSource(DataSource):
    """format("millrace_udp"), options host, port, limit: one datagram, one message."""

    @classmethod
    def name(cls) -> str:
        return "millrace_udp"

    def schema(self) -> str:
        return _NET

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _NetReader("udp", dict(self.options))


class TcpSource(UdpSource):
    """format("millrace_tcp"): octet-counted or newline-framed messages per connection."""

    @classmethod
    def name(cls) -> str:
        return "millrace_tcp"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _NetReader("tcp", dict(self.options))


def listen(spark: SparkSession, kind: str, port: int, host: str = "127.0.0.1", **options: object) -> DataFrame:
    """A stream of the messages that reach a UDP or TCP port.

    Each has an identifier made of where, when and as the how manieth it came, which a micro-batch
    that is run again repeats. What was turned away is counted as the stream's metrics.
    """
    spark.dataSource.register(UdpSource if kind == "udp" else TcpSource)
    reader = spark.readStream.format(f"millrace_{kind}").option("host", host).option("port", port)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    rows = reader.load().observe("net", *[F.count_if(F.col("rejected") == x).alias(x.replace(".", "_")) for x in REJECTIONS]).where("rejected IS NULL")
    place = F.concat_ws("\u0001", F.lit(f"{kind}:{host}"), "local_port", "peer_ip", "peer_port", F.col("received").cast("string"), F.col("seq").cast("string"))
    return decoded(rows).select(
        F.left(F.sha2(place, 256), F.lit(32)).alias("event_id"), F.lit(kind).alias("transport"), F.lit(f"syslog/{kind}").alias("transport_protocol"), "peer_ip", "peer_port", "local_port", F.col("received").alias("ingested_at_unix_utc"),
        "raw_message", "raw_bytes_b64", "decode_note",
    )
