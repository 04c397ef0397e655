"""ZIP archives of source trees, under limits, and receipts of processes."""

from __future__ import annotations

import io
import subprocess
import time
import zipfile
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "archive string, path string, content binary, error string"


@dataclass(frozen=True)
class Limits:
    compressed_bytes: int = 100 << 20
    expanded_bytes: int = 500 << 20
    file_bytes: int = 25 << 20
    entries: int = 50_000
    path_bytes: int = 512
    path_components: int = 40
    expansion_ratio: int = 100


def entries(data: bytes, limits: Limits) -> tuple[list[tuple[str, bytes]], str | None]:
    """Files below the single root of an archive, or no file and why the whole archive is refused."""
    if len(data) > limits.compressed_bytes:
        return [], "too_large"
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, EOFError):
        return [], "malformed"
    names, seen, roots, total, out = archive.infolist(), set(), set(), 0, []
    if len(names) > limits.entries:
        return [], "too_many_entries"
    for e in names:
        name, parts = e.orig_filename, e.orig_filename.rstrip("/").split("/")
        kind, rights = e.external_attr >> 16 & 0o170000, e.external_attr >> 16 & 0o777
        if e.flag_bits & 1:
            return [], "encrypted"
        if "\0" in name or "\\" in name or len(name.encode()) > limits.path_bytes or len(parts) > limits.path_components or any(p in ("", ".", "..") for p in parts):
            return [], "unsafe_path"
        if kind not in (0, 0o040000, 0o100000) or kind == 0o100000 and rights not in (0, 0o644, 0o755):
            return [], "unsupported_entry"
        if tuple(parts) in seen:
            return [], "duplicate_path"
        seen.add(tuple(parts))
        roots.add(parts[0])
        if len(roots) > 1:
            return [], "multiple_roots"
        if not e.is_dir():
            total += e.file_size
            if e.file_size > limits.file_bytes or total > limits.expanded_bytes or total > len(data) * limits.expansion_ratio:
                return [], "too_large"
            try:
                with archive.open(e) as f:
                    content = f.read(limits.file_bytes + 1)
            except (zipfile.BadZipFile, NotImplementedError, EOFError, OSError):
                return [], "malformed"
            if len(content) > limits.file_bytes:
                return [], "too_large"
            out.append(("/".join(parts[1:]), content))
    return (out, None) if roots else ([], "malformed")


def extracted(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(archive, path, content, error) of ``archives`` (path, content): their files, or one row with the error for an archive that is refused. An archive is held in memory, which the limits bound."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                files, error = entries(data.as_py() or b"", limits)
                rows = [(name, p, c, None) for p, c in files] or [(name, None, None, error)] * (error is not None)
                for k in range(0, len(rows), 256):
                    part = rows[k : k + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.string()))], names=["archive", "path", "content", "error"])

    return archives.select("path", "content").mapInArrow(run, SCHEMA)


@dataclass
class Receipt:
    ordinal: int
    started: bool
    exit_code: int | None
    success: bool
    timed_out: bool
    elapsed_ns: int
    stdout: bytes
    stderr: bytes


def run_once(program: list[str], cwd: str, ordinal: int, timeout_ms: int) -> Receipt:
    began = time.perf_counter_ns()
    since = lambda: time.perf_counter_ns() - began
    try:
        child = subprocess.Popen(program, cwd=cwd, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    except OSError as failure:
        return Receipt(ordinal, False, None, False, False, since(), b"", str(failure).encode())
    late = False
    try:
        out, err = child.communicate(timeout=timeout_ms / 1000)
    except subprocess.TimeoutExpired:
        late = True
        child.kill()
        out, err = child.communicate()
    took = since()
    return Receipt(ordinal, True, child.returncode if child.returncode >= 0 else None, not late and child.returncode == 0, late, took, out, err)


def receipts(spark: SparkSession, program: list[str], cwd: str, runs: int, timeout_ms: int = 60_000) -> DataFrame:
    """Receipts of ``runs`` runs of one command, in order; the first counts apart from the others."""
    rows = [asdict(run_once(program, cwd, k, timeout_ms)) for k in range(runs)]
    schema = "ordinal int, started boolean, exit_code int, success boolean, timed_out boolean, elapsed_ns long, stdout binary, stderr binary"
    return spark.createDataFrame([(*list(r.values())[:6], bytearray(r["stdout"]), bytearray(r["stderr"])) for r in rows], schema)
