"""Fetched payloads as a Spark data source, in batch and as a stream: `spark.read.format("payloads").load(folder)`.

A row is a payload, or a line of one in JSON lines: path, at (the byte at which it starts), attrs (the `key=value` parts of
the path), body, and error, which is null for a payload that can be decoded. Nothing is lost without a word: one that is
empty, isn't UTF-8 or isn't of its form is a row with an error, its body as far as it can be shown. Blank lines of JSON
lines hold no payload.

Options: `form` (json, lines, xml, html; else by the file's ending), `forms` (a JSON object: form by the path's `source`), `pieceBytes` (128 MB: files of lines are cut into pieces
of this size, a line belongs to the piece in which it starts; small files share a task up to it, at most `pieceFiles` of
them). Names that begin with `_` or `.` are left out, a folder that doesn't exist gives no row. Files are read where
Spark runs, through the file systems of Arrow, so the folder must be one that all executors see; an error in reading
a file fails its task, which Spark repeats.

A stream (option `index`, a folder of its own) numbers what it finds: each offset is a count of files in the index, each
of which names the payloads that were new. So a payload is read once, whatever its time or name; a file must be complete
when it appears and must not change.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, at long, attrs map<string,string>, body string, error string"
FORMS = {"json": "json", "jsonl": "lines", "ndjson": "lines", "xml": "xml", "rss": "xml", "html": "html", "htm": "html"}
CHUNK = 1 << 20


@dataclass(frozen=True)
class Piece:
    path: str
    start: int
    end: int


class Pieces(InputPartition):
    def __init__(self, value: list[Piece]):
        super().__init__(value)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


def _listed(folder: str) -> list[tuple[str, int]]:
    """Paths and sizes of the payload files under a folder, by path."""
    system, path = _open(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x[:1] in "_." for x in p[len(path) :].strip("/").split("/"))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))


def form_of(path: str, form: str | None, forms: dict[str, str]) -> str:
    return forms.get(attributes(path).get("source")) or form or FORMS.get(path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower(), "html")


def attributes(path: str) -> dict[str, str]:
    return dict(x.split("=", 1) for x in path.split("/")[:-1] if "=" in x)


def fault(form: str, raw: bytes) -> str | None:
    """Why a payload can't be decoded, or None."""
    try:
        text = raw.decode("utf-8")
        if not text.strip():
            return "empty"
        if form in ("json", "lines"):
            whole = json.loads(text)
            if form == "lines" and not isinstance(whole, dict):
                return "not an object"
        elif form == "xml":
            expat.ParserCreate().Parse(raw, True)
    except UnicodeDecodeError as e:
        return f"not UTF-8 at byte {e.start}"
    except (ValueError, RecursionError, expat.ExpatError) as e:
        return f"not {'XML' if form == 'xml' else 'JSON'}: {e}"
    return None


def _lines(file, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """Lines that start within the piece, with the byte at which they do; only \\n ends a line."""
    at = max(piece.start - 1, 0)
    file.seek(at)
    held, skip = b"", piece.start > 0
    while at < piece.end:
        chunk = file.read(CHUNK)
        parts = chunk.split(b"\n")
        if len(parts) == 1 and chunk:
            held += chunk
            continue
        parts[0], held = held + parts[0], b""
        last = parts.pop()
        for line in parts:
            if at >= piece.end:
                return
            if not skip:
                yield at, line
            at, skip = at + len(line) + 1, False
        held = last
        if not chunk:
            if held and not skip and at < piece.end:
                yield at, held
            return


def _payloads(system: fs.FileSystem, piece: Piece, form: str) -> Iterator[tuple[int, bytes]]:
    with system.open_input_file(piece.path) as file:
        if form == "lines":
            yield from ((at, line) for at, line in _lines(file, piece) if line.strip())
        else:
            yield 0, file.read()


class _Reading:
    def __init__(self, options):
        self.folder = options["path"]
        self.form, self.forms = options.get("form"), json.loads(options.get("forms", "{}"))
        self.bytes, self.files = int(options.get("pieceBytes", 128 << 20)), int(options.get("pieceFiles", 1000))

    def dealt(self, files: list[tuple[str, int]]) -> list[Pieces]:
        """Files dealt to tasks: those of lines cut, the others whole, small ones together."""
        tasks: list[list[Piece]] = []
        room = 0
        for path, size in files:
            step = self.bytes if form_of(path, self.form, self.forms) == "lines" else max(size, 1)
            for lo in range(0, max(size, 1), step):
                piece = Piece(path, lo, min(lo + step, size))
                if not tasks or piece.end - lo > room or len(tasks[-1]) == self.files:
                    tasks.append([])
                    room = self.bytes
                tasks[-1].append(piece)
                room -= piece.end - lo
        return [Pieces(t) for t in tasks]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        system, _ = _open(self.folder)
        for piece in partition.value:
            form, attrs = form_of(piece.path, self.form, self.forms), attributes(piece.path)
            for at, raw in _payloads(system, piece, form):
                yield piece.path, at, attrs, raw.decode("utf-8", "replace"), fault(form, raw)


class BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Pieces]:
        return self.dealt(_listed(self.folder)) or [Pieces([])]


class StreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.index = options["index"]

    def _numbered(self) -> dict[int, str]:
        return {int(p.rsplit("/", 1)[-1].split(".")[0]): p for p, _ in _listed(self.index)}

    def _named(self, path: str) -> list[tuple[str, int]]:
        with _open(self.index)[0].open_input_file(path) as file:
            return [tuple(x) for x in json.loads(file.read())]

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        """The index after what is new has been added to it: written aside, then moved in place."""
        system, folder = _open(self.index)
        files = self._numbered()
        known = {path for f in files.values() for path, _ in self._named(f)}
        new, last = [x for x in _listed(self.folder) if x[0] not in known], max(files, default=0)
        if new:
            last += 1
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/_{last}") as out:
                out.write(json.dumps(new).encode())
            system.move(f"{folder}/_{last}", f"{folder}/{last}.json")
        return {"files": last}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        files = self._numbered()
        return self.dealt([x for n in range(start["files"] + 1, end["files"] + 1) for x in self._named(files[n])])


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def _register(spark: SparkSession) -> None:
    """The source goes to Spark's workers by value: the one that plans a stream doesn't get the session's code archives."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(PayloadSource)
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def payloads(spark: SparkSession, folder: str, **options) -> DataFrame:
    _register(spark)
    return spark.read.format("payloads").options(**options).load(folder)


def payload_stream(spark: SparkSession, folder: str, index: str, **options) -> DataFrame:
    _register(spark)
    return spark.readStream.format("payloads").options(index=index, **options).load(folder)
