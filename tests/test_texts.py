"""Parsers and inventories on texts written by hand."""

import hashlib
import io
import json
import subprocess
import sys
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.functions import inventories, lexer, render, scalars, tokens
from tessera.functions import tokens as tok
from tessera.operators import audit, clones, kernel, receipts
from tessera.plans import bundle, ingest
from tessera.sources import archive, code, git, manifests
from tessera.streaming import jobs

RUST = """//! top
use std::{fs, io};
use crate::a::b as c;
mod alpha;
extern crate serde;
/// doc
#[derive(Debug)]
pub struct S { x: i32 }
pub const fn f<'a>(a: &'a str, b: u8) -> u8 { if a == "x" && b > 1 { return 1; } 'c'; 0 }
pub(crate) fn g() {}
pub use x::y;
mod tests { #[test] fn t1() { assert_eq!(1, 1); } #[test]
#[ignore] fn t2() { assert!(true) } fn helper() {} }
"""
PYTHON = '''import os, sys as s, a.b.c as d
from . import x
from .pkg.mod import (y,
  z)
LIMIT = 3
def f(a, b=(1, 2)):
    """doc"""
    return "import no"
class _P: pass
class Q:
    def test_m(self):
        self.assertEqual(1, 1)
@pytest.mark.skip
def test_x():
    assert f(1)
'''
SCRIPT = """import a, {b} from './a.js'; import "side";
const r = require("x"); const m = await import('./dyn');
export * from "./all"; export { q as w } from './q';
/** doc */
export default function foo(a, b) { return a ? b : 0 }
export const K = 1;
describe.skip("s", () => { it("one", () => { expect(1).toBe(1) }) });
test("two", () => { assert.equal(1, 1) });
// import 'not'
"""
GO = """package m
import "fmt"
import (
  x "a/b"
)
// Doc
func Pub(a int) error { return nil }
func (r *T) Meth() {}
const (
  One = 1
  two = 2
)
func TestA(t *testing.T) { t.Skip(); t.Errorf("x") }
"""


def test_imports():
    assert [r[1:] for r in inventories.imports(RUST, "rust")] == [("std", "rust-use"), ("crate::a::b", "rust-use"), ("alpha", "rust-mod"), ("serde", "rust-extern-crate"), ("x::y", "rust-use")]
    assert [r[1] for r in inventories.imports(PYTHON, "python")] == ["a.b.c", "os", "sys", ".", ".pkg.mod"]
    assert [r[1:] for r in inventories.imports(SCRIPT, "javascript")] == [("./a.js", "js-import"), ("side", "js-import"), ("./dyn", "js-dynamic-import"), ("x", "js-require"), ("./all", "js-export-from"), ("./q", "js-export-from")]
    assert [r[:2] for r in inventories.imports(GO, "go")] == [(2, "fmt"), (4, "a/b")]


def test_exported_names():
    assert [r[1:] for r in inventories.exported(RUST, "rust")] == [("S", "type", True), ("f", "function", False), ("x::y", "reexport", False)]
    assert [r[1:] for r in inventories.exported(PYTHON, "python")] == [("LIMIT", "constant", False), ("f", "function", True), ("Q", "type", False), ("test_x", "function", False)]
    assert [r[1:] for r in inventories.exported(SCRIPT, "javascript")] == [("*", "reexport", False), ("w", "reexport", False), ("foo", "function", True), ("K", "constant", False)]
    assert [r[1:] for r in inventories.exported(GO, "go")] == [("Pub", "function", True), ("Meth", "function", False), ("One", "constant", False), ("TestA", "function", False)]


def test_test_cases():
    assert inventories.tests(RUST, "rust") == ([(12, "t1", False), (13, "t2", True)], 2)
    assert inventories.tests(PYTHON, "python") == ([(11, "test_m", False), (14, "test_x", True)], 2)
    assert inventories.tests(SCRIPT, "javascript") == ([(7, "one", True), (8, "two", False)], 2)
    assert inventories.tests(GO, "go") == ([(13, "TestA", True)], 1)


@pytest.mark.parametrize("language", sorted(set(lexer.EXTENSIONS.values())))
def test_lexer_takes_anything(language):
    for text in ("", "\n\n", "'", '"', '"""', "/*", "`", "r#\"", "((((", "}", "é ü 中", "\\", "import", "export {", "pub", "use", "from", "func (", "def", "it(", "describe.skip(", "#[test"):
        assert all(t.line <= t.end_line for t in lexer.lex(text, language))
        for kernel in (inventories.imports, inventories.exported, inventories.tests, inventories.measures):
            kernel(text, language)
    assert not lexer.balanced(lexer.lex("(]", language)) and lexer.balanced(lexer.lex("([{}])", language))


def test_copies_are_found_whatever_their_names(spark, tmp_path):
    body = "def {a}({b}):\n    if {b} > 1:\n        return {b} * 2\n    for {c} in range({b}):\n        print({c}, 'x')\n    return None\n"
    for name, words in {"one.py": "fab", "two.py": "gxy"}.items():
        (tmp_path / name).write_text(body.format(**dict(zip("abc", words))))
    (tmp_path / "three.py").write_text("x = 1\n")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden/four.py").write_text("x = 1\n")
    (tmp_path / "data.bin").write_bytes(b"\xff\xfe")
    files = code.discover(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["data.bin", "one.py", "three.py", "two.py"]
    assert tuple(code.coverage(files).first()) == (4, 3, 3, 0)
    found = clones.groups(code.token_text(code.sources(files)), 20, 5).collect()
    assert [(r.occurrences, r.first_file, r.lines) for r in found] == [(2, "one.py", 6)]


def test_manifests(spark):
    cargo = '[dependencies]\na = "1"\nb = { path = "../b" }\nc = { workspace = true }\n[dev-dependencies]\nd = "*"\n[target."cfg(unix)".dependencies]\ne = { git = "g", version = "2" }\n'
    npm = '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "workspace:*"}, "peerDependencies": {"c": "x github.com/y"}}'
    poetry = '[project]\ndependencies = ["p[x]>=1; y"]\n[project.optional-dependencies]\ng = ["q @ git+https://z"]\n[tool.poetry.dependencies]\npython = "3"\nr = "*"\n'
    rows = [("x/Cargo.toml", cargo), ("package.json", npm), ("pyproject.toml", poetry), ("requirements-dev.txt", "# no\n-r other\nz==1 # why\n\n"), ("go.mod", "module m\nrequire a/b v1\nrequire (\n\tc v2 // indirect\n)\n"), ("bad/package.json", "{"), ("notes.txt", "a"), ("go.mod", None)]
    got = manifests.dependencies(spark.createDataFrame(rows, "path string, content string")).collect()
    assert {(r.ecosystem, r.scope, r.name, r.requirement, r.source_kind) for r in got if r.error is None} == {
        ("cargo", "runtime", "a", "1", "registry"), ("cargo", "runtime", "b", "../b", "path"), ("cargo", "runtime", "c", "", "workspace"), ("cargo", "development", "d", "*", "wildcard"), ("cargo", "target:cfg(unix):dependencies", "e", "2", "git"),
        ("npm", "runtime", "a", "^1", "registry"), ("npm", "development", "b", "workspace:*", "workspace"), ("npm", "peer", "c", "x github.com/y", "git"), ("python", "runtime", "p", "[x]>=1; y", "registry"), ("python", "optional:g", "q", "@ git+https://z", "git"),
        ("python", "runtime", "r", "*", "wildcard"), ("python", "runtime", "z", "==1", "registry"), ("go", "runtime", "a/b", "v1", "registry"), ("go", "runtime", "c", "v2", "registry"),
    }
    assert [r.manifest for r in got if r.error is not None] == ["bad/package.json"]


def test_quoted_paths():
    assert [git.decode_quoted(p) for p in ("a b", '"a\\tb\\"\\\\"', '"\\303\\251"', '"\\377x"')] == [b"a b", b'a\tb"\\', "é".encode(), b"\xffx"]
    assert [git.decode_quoted(p) for p in ('"a', '"', '"\\q"', '"\\"', '"\\400"', '""', None)] == [None] * 7
    assert git.display(b"\xffa\\b c") == "\\xffa\\\\b\\x20c"


def test_broken_log_records_are_rows(spark):
    h = "a" * 40
    rows = [f"{h}\x005\x00\n2\t3\tsrc/m.rs\n-\t-\tsrc/m.rs\n", f"{h[:-1]}b\x006\x00\n", f"{h}\x00x\x00\n", "zz\x001\x00\n", f"{h}\x007\x00\n1\tsrc/x\n", f"{h}\x008\x00\n-\t1\tsrc/x\n", f'{h}\x009\x00\n1\t1\t"x\n', " \n"]
    got = {(r.ts, r.path, r.line_mass, r.is_text, r.is_binary, r.error) for r in git.parse_log(spark.createDataFrame([(x,) for x in rows], "value string")).collect()}
    assert (5, "src/m.rs", 5, True, True, None) in got
    assert {(r[0], r[5]) for r in got if r[5]} == {(None, "timestamp"), (1, "object id"), (7, "numstat"), (8, "numstat"), (9, "path")}


def test_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-q")
    for k, text in enumerate(("a\n", "a\nb\n", "c\n")):
        (tmp_path / "é x.py").write_text(text)
        run("add", "-A")
        run("commit", "-q", "-m", f"m{k}")
    commits, more = git.history(spark, str(tmp_path), 2)
    rows = commits.collect()
    assert more and sorted((r.path, r.line_mass) for r in rows) == [("é x.py", 1), ("é x.py", 3)] and all(r.error is None for r in rows)
    files = git.regular(git.tree(spark, str(tmp_path)))
    assert [(r.path, r.size) for r in files.collect()] == [("é x.py", 2)]
    assert [bytes(r.content) for r in git.blobs(spark, str(tmp_path), files).collect()] == [b"c\n"]
    assert git.snapshot(str(tmp_path))["dirty"] is False
    (tmp_path / "new").write_text("")
    assert git.snapshot(str(tmp_path))["dirty"] is True


def test_bundle(spark):
    good = '{"id": "r-1", "artifact": "d@0123456", "axis": "a", "instrument": "mechanical", "procedure": "p.md", "evidence": "e", "verdict": "v", "integrity": "i", "agent": {"kind": "k", "id": "i"}, "ts": "2026-07-10T12:34:56Z"}'
    text = lambda *lines: audit.record_lines(spark.createDataFrame([("\n".join(lines),)], "text string"))
    report = spark.createDataFrame([("by r-1.\nand r-2, r-2",)], "text string")
    codes = lambda *lines: sorted((r.code, r.line) for r in audit.audit(text(*lines), report).collect())
    assert codes(good) == [("unknown_report_record", 2)]
    assert codes(good, "", good, "[1]", "{", good.replace('"v"', "7")) == [("duplicate_record_id", 3), ("duplicate_record_id", 6), ("invalid_json_record", 4), ("invalid_json_record", 5), ("invalid_record_field", 6), ("unknown_report_record", 2)]
    assert ("no_valid_records", None) in codes("")
    need = spark.createDataFrame([("report.md",), ("records.jsonl",), ("x.md",)], "path string")
    known = spark.createDataFrame([("records.jsonl", bytearray()), ("x.md", bytearray(b"\xff"))], "path string, content binary")
    assert {(r.id, r.code) for r in audit.required(need, known).collect()} == {("report.md", "missing_required_file"), ("records.jsonl", "empty_required_file"), ("x.md", "invalid_report_encoding")}


def test_rendering(spark):
    d = spark.createDataFrame([("a<b", 5, 2.0), ("c", 50, None), ("d" * 80, 1, 3.0)], "name string, n long, v double")
    assert render.text_table("Top", d, [F.col("n").desc()], 2, 10).splitlines()[:3] == ["Top", "name  n   v", "c     50  -"]
    assert "(no rows)" in render.text_table("Top", d.where("false"), [F.col("n")], 2)
    svg = render.scatter(d, "n", "v", "name", [F.col("n").desc()], 10, "T")
    assert svg.count("<circle") == 2 and "a&lt;b" in svg
    assert sorted(r.value for r in render.json_lines(d.limit(2)).collect())[1] == '{"name":"c","n":50,"v":null}'
    p = receipts.posterior(spark.createDataFrame([("x", 0.5), ("y", 0.1)], "claim string, probability double"), spark.createDataFrame([("x", 1, 0.6), ("x", 2, 0.7), ("z", 1, 0.2)], "claim string, seq int, probability double"))
    assert {tuple(r) for r in p.collect()} == {("x", 0.7, 2), ("y", 0.1, 0), ("z", 0.2, 1)}


def test_kernel_stops_within_its_budget(spark):
    ok = lambda o, u=None, usd=0.0: lambda artifact: (o, u or {}, usd)
    a, b = kernel.Program("a", "1", "c", ok({"x": 1}, {"q": 0.9}, 2.0)), kernel.Program("b", "1", "c", ok({"y": 2}))
    run = kernel.evaluate(None, [a, b], {"q": 0.5}, kernel.Resources(5.0, 10**6, 5))
    assert (run.stopped_reason, run.beliefs, run.remaining.usd, run.remaining.programs, len(run.digests)) == ("complete", {"q": 0.9}, 3.0, 3, 2)
    reasons = lambda some, **budget: kernel.evaluate(None, some, {"q": 0.5}, kernel.Resources(**{"usd": 5.0, "wall_time_ms": 10**6, "programs": 5} | budget)).stopped_reason
    assert reasons([a, b], usd=1.0) == reasons([a, b], usd=2.0) == "budget_exhausted" and reasons([a, b], programs=1) == "program_limit" and reasons([a], usd=2.0) == "complete"
    assert reasons([kernel.Program("n", "1", "c", ok(1), applies=lambda x: ("unsupported", "no")), a]) == "unsupported"
    assert reasons([kernel.Program("n", "1", "c", ok(1), estimate=kernel.Resources(usd=9.0))]) == "budget_exhausted"
    assert reasons([kernel.Program("n", "1", "c", ok(1, {"unknown": 0.1}))]) == reasons([kernel.Program("n", "1", "c", lambda x: 1 / 0)]) == "failed"
    other = kernel.evaluate(None, [a, kernel.Program("b", "2", "c", ok({"y": 2})), b], {"q": 0.5}, kernel.Resources(5.0, 10**6, 5))
    rows = {r.step: (r.mismatch, r.left, r.right) for r in kernel.zipped(run.frame(spark), other.frame(spark)).collect()}
    assert rows == {0: (None, None, None), 1: ("version", "1", "2"), 2: ("step", None, None)}
    assert [kernel.elapsed_ms(n) for n in (0, 1, 1_999_999, 2_000_000)] == [0, 1, 1, 2]
    key = spark.range(1).select(scalars.cache_key(F.lit(7), F.lit("abc"), F.lit("v1"))).first()[0]
    assert key == hashlib.sha256(b"7:abc:v1").hexdigest() + ".json"


def test_archives(spark):
    def pack(*files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in files:
                z.writestr(zipfile.ZipInfo(name), content)
        return bytearray(out.getvalue())

    link = zipfile.ZipInfo("r/l")
    link.external_attr = 0o120777 << 16
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr(link, "x")
    rows = {"good": pack(("r/a.py", "x = 1\n"), ("r/d/", ""), ("r/d/b.md", "")), "roots": pack(("r/a", ""), ("s/a", "")), "up": pack(("r/../a", "")), "abs": pack(("/a", "")), "none": bytearray(b"PK"), "link": bytearray(bad.getvalue()), "big": pack(("r/a", "x" * 50)), "void": pack()}
    got = archive.extracted(spark.createDataFrame(list(rows.items()), "path string, content binary"), archive.Limits(file_bytes=40)).collect()
    assert {(r.archive, r.path) for r in got if r.error is None} == {("good", "a.py"), ("good", "d/b.md")}
    assert {r.archive: r.error for r in got if r.error} == {"roots": "multiple_roots", "up": "unsafe_path", "abs": "unsafe_path", "none": "malformed", "link": "unsupported_entry", "big": "too_large", "void": "malformed"}


def test_process_receipts(spark, tmp_path):
    got = archive.receipts(spark, [sys.executable, "-c", "print('x'); raise SystemExit(3)"], str(tmp_path), 2).collect()
    assert [(r.ordinal, r.started, r.exit_code, r.success, bytes(r.stdout)) for r in got] == [(0, True, 3, False, b"x\n"), (1, True, 3, False, b"x\n")]
    assert archive.run_once(["sleep", "9"], str(tmp_path), 0, 200).timed_out and not archive.run_once(["/no/such"], str(tmp_path), 0, 200).started


def test_bundle_of_instruments_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text(PYTHON)
    (tmp_path / "b.go").write_text(GO)
    (tmp_path / "package.json").write_text('{"dependencies": {"x": "*"}}')
    files = code.discover(spark, str(tmp_path))
    got = {r.instrument: (r.state, r.observations) for r in bundle.analyze(spark, files, bundle.INSTRUMENTS | {"broken": lambda f, s: 1 / 0}).collect()}
    assert got.pop("broken") == ("failed", None) and all(s == "complete" for s, _ in got.values()) and len(got) == 5
    assert json.loads(got["api"][1])["symbols"] == 8 and json.loads(got["tests"][1]) == {"cases": 3, "ignored": 2, "assertions": 3} and json.loads(got["dependencies"][1])["manifest_dependencies"] == 1
    assert main(["query", "nothing", "x"], spark) == 2 and main(["audit", str(tmp_path)], spark) == 1
    assert "missing_required_file" in capsys.readouterr().out
    assert main(["query", "category_mix", "/root/testdata/sf0.001", "--top", "3"], spark) == 0 and capsys.readouterr().out.startswith("category_mix")


def test_job_streams(spark, tmp_path):
    def drain(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    rows = [("k", "a", 1, "requested", "2024-01-01 00:00:00"), ("k", "b", 2, "requested", "2024-01-01 00:05:00"), ("k", "a", 3, "complete", "2024-01-01 00:10:00"), ("k", "c", 4, "requested", "2024-01-01 02:00:00"), ("m", "d", 5, "requested", "2024-01-01 05:00:00")]
    schema = "key string, analysis_id string, seq int, state string, ts timestamp"
    spark.createDataFrame(rows, "key string, analysis_id string, seq int, state string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert {(r.request, r.analysis_id, r.joined) for r in drain(jobs.admissions(stream()), "append", "adm")} == {("a", "a", False), ("b", "a", True), ("c", "c", False), ("d", "d", False)}
    latest = {r.analysis_id: (r.events, r.state) for r in drain(jobs.latest_states(stream()), "complete", "lat")}
    assert latest == {"a": (2, "complete"), "b": (1, "requested"), "c": (1, "requested"), "d": (1, "requested")} == {r.analysis_id: (r.events, r.state) for r in jobs.latest_states(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert {(r.begins.hour, r.state, r.events) for r in drain(jobs.entered(stream()), "append", "ent")} == {(0, "requested", 2), (0, "complete", 1), (2, "requested", 1)}


def test_stable_hashes():
    assert [f"{h:016x}" for h in tokens.fnv1a(["", "a", "foobar", None])] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8", "cbf29ce484222325"]


def test_plain_texts_and_written_sources(spark, tmp_path):
    texts = ["ab, c\n1", "é日本x", "", "😀z \t", None]
    data, offs = tok.texts(pa.array(texts))
    assert ingest.plain(data, offs) == ["".join(c if c.isascii() and c.isalpha() or c == " " else " " for c in t or "") for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: (r.language, r.text) for r in ingest.source_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"s/0.rs", "s/1.py", "s/2.js", "s/3.go"} and got["s/1.py"] == ("python", ingest.TEMPLATES["python"].replace("{d}", "1").replace("{c}", "   x"))
    # the text is written once, whatever asks for it
    plan = ingest.source_files(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("MapInArrow") == 1


def test_uses_are_resolved_in_several_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ingest, "parts", lambda *a: seen.append(a[1:]) or 7)
    ingest.rust_use_resolution(spark, "/root/testdata/sf0.001")
    assert seen == [(200, 50_000)]
