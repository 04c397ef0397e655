"""Package manifests: Cargo.toml, package.json, pyproject.toml, requirements*.txt and go.mod as rows of dependencies.

Manifests are few and small, and each is parsed whole, by Python's own readers in Arrow batches on the executors. One that cannot be parsed is a row with its
error in place of a dependency; null content counts as empty.
"""

from __future__ import annotations

import json
import re
import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "manifest string, ecosystem string, scope string, name string, requirement string, source_kind string, error string"
RISKY = ("path", "git", "wildcard", "unknown")
_REQUIREMENT = re.compile(r"[<>=!~; \[@]")


def is_manifest(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return name.isin("Cargo.toml", "package.json", "pyproject.toml", "go.mod") | (name.startswith("requirements") & name.endswith(".txt"))


def split_requirement(value: str) -> tuple[str, str]:
    m = _REQUIREMENT.search(value)
    end = m.start() if m else len(value)
    return value[:end], value[end:].strip()


def python_kind(requirement: str) -> str:
    return "path" if "@ file:" in requirement else "git" if "@ git+" in requirement else "wildcard" if requirement == "*" else "registry"


def npm_kind(requirement: str) -> str:
    if requirement == "*":
        return "wildcard"
    if requirement.startswith("workspace:"):
        return "workspace"
    if requirement.startswith(("file:", "link:")):
        return "path"
    if requirement.startswith("git") or "github.com/" in requirement:
        return "git"
    return "registry" if requirement else "unknown"


def _tables(value, *way) -> dict:
    for key in way:
        value = value.get(key) if isinstance(value, dict) else None
    return value if isinstance(value, dict) else {}


def cargo(content: str) -> list[tuple[str, str, str, str]]:
    """(scope, name, requirement, kind)."""
    doc, kinds = tomllib.loads(content), ("dependencies", "dev-dependencies", "build-dependencies")
    tables = [(scope, _tables(doc, t)) for t, scope in zip(kinds, ("runtime", "development", "build"))] + [("workspace", _tables(doc, "workspace", "dependencies"))]
    tables += [(f"target:{target}:{t}", _tables(body, t)) for target, body in _tables(doc, "target").items() for t in kinds]
    out = []
    for scope, table in tables:
        for name, v in table.items():
            if isinstance(v, str):
                out.append((scope, name, v, "wildcard" if v == "*" else "registry"))
            elif isinstance(v, dict):
                kind = next((k for k, on in (("path", "path" in v), ("git", "git" in v), ("workspace", v.get("workspace") is True), ("registry", "version" in v)) if on), "unknown")
                out.append((scope, name, next((v[k] for k in ("version", "path", "git") if isinstance(v.get(k), str)), ""), kind))
            else:
                out.append((scope, name, json.dumps(v), "unknown"))
    return out


def package_json(content: str) -> list[tuple[str, str, str, str]]:
    doc, out = json.loads(content), []
    for table, scope in (("dependencies", "runtime"), ("devDependencies", "development"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
        for name, v in _tables(doc, table).items():
            v = v if isinstance(v, str) else ""
            out.append((scope, name, v, npm_kind(v)))
    return out


def pyproject(content: str) -> list[tuple[str, str, str, str]]:
    doc = tomllib.loads(content)
    project = _tables(doc, "project")
    lists = [("runtime", project.get("dependencies"))] + [(f"optional:{group}", v) for group, v in _tables(project, "optional-dependencies").items()]
    out = [(scope, *split_requirement(x), python_kind(split_requirement(x)[1])) for scope, v in lists if isinstance(v, list) for x in v if isinstance(x, str)]
    for name, v in _tables(doc, "tool", "poetry", "dependencies").items():
        if name != "python":
            kind = ("path" if "path" in v else "git" if "git" in v else "unknown") if isinstance(v, dict) else python_kind(v if isinstance(v, str) else "")
            out.append(("runtime", name, v if isinstance(v, str) else json.dumps(v), kind))
    return out


def requirements(content: str) -> list[tuple[str, str, str, str]]:
    out = []
    for line in map(str.strip, content.splitlines()):
        if line and line[0] not in "#-":
            value = line.split(" #")[0]
            name, requirement = split_requirement(value)
            if name:
                out.append(("runtime", name, requirement, python_kind(value)))
    return out


def go_mod(content: str) -> list[tuple[str, str, str, str]]:
    out, block = [], False
    for line in map(str.strip, content.splitlines()):
        if line == "require (":
            block = True
        elif block and line == ")":
            block = False
        else:
            body = line if block else line[8:] if line.startswith("require ") else ""
            words = body.split()
            if len(words) > 1 and not body.startswith("//"):
                out.append(("runtime", words[0], words[1], "registry"))
    return out


READERS = {"Cargo.toml": ("cargo", cargo), "package.json": ("npm", package_json), "pyproject.toml": ("python", pyproject), "go.mod": ("go", go_mod)}


def dependencies(files: DataFrame) -> DataFrame:
    """Distinct rows of :data:`SCHEMA` of the manifests among ``files`` (path, content)."""

    def run(batches):
        names = ["manifest", "ecosystem", "scope", "name", "requirement", "source_kind", "error"]
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ecosystem, reader = READERS.get(path.rpartition("/")[2], ("python", requirements))
                try:
                    rows += [(path, ecosystem, *r, None) for r in reader(content or "")]
                except ValueError as wrong:
                    rows.append((path, ecosystem, None, None, None, None, str(wrong)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(7)], names=names)

    return files.where(is_manifest(F.col("path"))).select("path", F.col("content").cast("string")).mapInArrow(run, SCHEMA).distinct()


def kinds(rows: DataFrame) -> DataFrame:
    """For each ecosystem and scope: dependencies, those not from a registry, and risky ones (a path, a git address, no bound, or unknown)."""
    ok = rows.where("error is null")
    kind = F.col("source_kind")
    return ok.groupBy("ecosystem", "scope").agg(F.count(F.lit(1)).alias("dependencies"), F.count_if(kind != "registry").alias("non_registry"), F.count_if(kind.isin(*RISKY)).alias("risky"), F.count_distinct("manifest").alias("manifests"))
