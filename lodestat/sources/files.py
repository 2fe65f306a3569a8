"""Files in and out: tables by suffix, JSON lines, manifests, digests, progress."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from pathlib import PurePosixPath
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestat.operators.preprocess import AnalysisError

_SUFFIXES = (".csv", ".tsv", ".json", ".jsonl", ".parquet")


#: How times are written to and read from text files: microseconds are kept.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool = False) -> DataFrame:
    """By suffix. JSON is read as lines first; if that gives broken records, as one document.
    Without a schema, columns of text files are inferred, which costs a pass. `multi_line`: fields of CSV and TSV
    hold line breaks; such files can't be split between tasks."""
    suffix = PurePosixPath(path).suffix.lower()
    r = spark.read if schema is None else spark.read.schema(schema)
    if suffix in (".csv", ".tsv"):
        r = r.option("timestampFormat", TIME_FORMAT).option("timestampNTZFormat", TIME_FORMAT)
        return r.csv(path, header=True, inferSchema=schema is None, sep="\t" if suffix == ".tsv" else ",", escape='"', multiLine=multi_line)
    if suffix == ".parquet":
        return r.parquet(path)
    if suffix in (".json", ".jsonl"):
        lines = r.json(path)
        if suffix == ".json" and (not lines.columns or "_corrupt_record" in lines.columns):
            return r.json(path, multiLine=True)
        return lines
    raise AnalysisError(f"unsupported file type: {suffix or path}; known are {', '.join(_SUFFIXES)}")


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a line that is no object fails, a missing path is empty."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Columns in sorted order, one object a line; the commit protocol makes it whole or nothing."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str) -> None:
    """Line breaks inside fields are kept; such a file is read with multi_line."""
    w = df.write.mode("overwrite").option("timestampFormat", TIME_FORMAT).option("timestampNTZFormat", TIME_FORMAT)
    w.csv(path, header=True, escape='"')


def file_digests(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """(path, length, sha256) of the files under a path, read in chunks, so a file may have any size. The file
    system is taken from the path (file, hdfs, s3, gs and what else pyarrow reads)."""
    names = spark.read.format("binaryFile").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                system, inner = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                h = hashlib.sha256()
                with system.open_input_stream(unquote(inner)) as f:
                    while part := f.read(chunk):
                        h.update(part)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], ["path", "length", "sha256"])

    return names.mapInArrow(run, "path string, length bigint, sha256 string")


def fingerprint(value: object) -> str:
    """Digest of a value as canonical JSON: sorted keys, no blanks."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work not yet done under the same fingerprint."""
    return work.join(done, list(keys), "left_anti")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_manifest(spark: SparkSession, path: str, value: dict) -> None:
    """Pretty JSON, written beside and renamed, on whatever file system the path names."""
    text = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)
    part, fs = _path(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    to, _ = _path(spark, path)
    if not fs.rename(part, to):
        fs.delete(to, False)
        if not fs.rename(part, to):
            raise OSError(f"cannot write {path}")


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest at a path, None if there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def unless_done(spark: SparkSession, manifest: str, inputs: object, make: Callable[[], dict]) -> tuple[dict, bool]:
    """(manifest, made): skips a stage whose manifest carries the fingerprint of the same inputs."""
    mark = fingerprint(inputs)
    old = read_manifest(spark, manifest)
    if old is not None and old.get("fingerprint") == mark:
        return old, False
    new = make() | {"fingerprint": mark}
    write_manifest(spark, manifest, new)
    return new, True


def check_shard(spark: SparkSession, manifest: str, found: DataFrame, inputs: object) -> None:
    """A written shard must be what its manifest says: fingerprint of the inputs, number of rows and digests
    of the files ((path, length, sha256), compared by digest). Raises otherwise."""
    want = read_manifest(spark, manifest)
    if want is None:
        raise AnalysisError("the shard has no manifest")
    digests = sorted(r["sha256"] for r in found.select("sha256").collect())
    for what, a, b in (("fingerprint", want.get("fingerprint"), fingerprint(inputs)), ("files", want.get("files"), digests)):
        if a != b:
            raise AnalysisError(f"the {what} of the shard changed")


def check_inputs(spark: SparkSession, paths: Sequence[str], most: int = 3, most_bytes: int = 25 << 20) -> list[str]:
    """Number, kinds and sizes of input files; limits are parameters."""
    if not paths or len(paths) > most:
        raise AnalysisError(f"between one and {most} files are needed")
    for name in paths:
        if PurePosixPath(name).suffix.lower() not in _SUFFIXES:
            raise AnalysisError(f"unsupported file type: {name}")
        p, fs = _path(spark, name)
        if not fs.exists(p):
            raise AnalysisError(f"no such file: {name}")
        if fs.getContentSummary(p).getLength() > most_bytes:
            raise AnalysisError(f"{name} is larger than {most_bytes} bytes")
    return list(paths)
