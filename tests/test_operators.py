"""Functions and operators on literals: text, ranking, vectors, streams, control tables."""

from __future__ import annotations

import datetime
import math
import random

from pyspark.sql import functions as F

from codeloom import pipeline
from codeloom.functions import paths, text as tx
from codeloom.operators import clones, control, ranking, smells, vectors
from codeloom.sources import extract
from codeloom.streaming import events as ev


def one(spark, rule, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(rule.alias("x")).first()["x"]


def cognitive(source: str) -> int:
    """The same rule, character by character."""
    total, depth, i = 0, 0, 0
    while i < len(source):
        t = source[i:]
        if t.startswith("else if"):
            total, i = total + 1, i + 4
            continue
        hit = next((k for k in ("if ", "if(", "for ", "for(", "while ", "while(", "switch ", "switch(", "match ", "match(", "catch ", "catch(") if t.startswith(k)), None)
        if hit:
            total, depth, i = total + 1 + depth, depth + 1, i + len(hit)
        elif t.startswith("case "):
            total, i = total + 1, i + 5
        elif t.startswith(("try ", "try{")):
            depth, i = depth + 1, i + 4
        elif t.startswith(("&&", "||")):
            total, i = total + 1, i + 2
        elif t[0] == "?":
            total, i = total + 1 + depth, i + 1
        elif t[0] == "}":
            depth, i = max(0, depth - 1), i + 1
        else:
            i += 1
    return total


def test_complexity(spark):
    rng = random.Random(3)
    parts = ["if (a) {", "}", "for (;;) {", "else if (b) {", "a && b", "x ? y : z", "case 1:", "try {", "} catch (e) {", "while (x) {", "plain;", "match x {"]
    for _ in range(30):
        source = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert one(spark, tx.cognitive(F.lit(source))) == cognitive(source), source
        depth = best = 0
        for c in source:
            depth = depth + 1 if c == "{" else max(0, depth - 1) if c == "}" else depth
            best = max(best, depth)
        assert one(spark, tx.nesting_depth(F.lit(source))) == best
    assert one(spark, tx.cyclomatic(F.lit("if a && b || c ? d : e"))) == 5


def test_text_functions(spark):
    assert one(spark, tx.tokens(F.lit("Héllo, x_y a1 é 7"))) == ["héllo", "x_y", "a1", "é"]
    assert [one(spark, tx.token_estimate(F.lit(x))) for x in ("", "a", "abcde", None)] == [0, 1, 2, None]
    assert abs(one(spark, tx.entropy(F.lit("abcd"))) - 2) < 1e-9 and one(spark, tx.entropy(F.lit(""))) == 0
    assert one(spark, tx.looks_sensitive(F.lit("x = 'Ab3dEf9hIj2lMn5pQr8tUv1xYz4bCd7f' end")))
    assert not one(spark, tx.looks_sensitive(F.lit("plain words only")))
    assert one(spark, tx.redact(F.lit("a\nMY_Token = 1\nb"))) == "a\n[REDACTED_SECRET_LINE]\nb"
    assert one(spark, tx.signature_preview(F.lit("fn f(a: i32)\n  -> u8 {\n}"))) == "fn f(a: i32) -> u8"
    assert one(spark, tx.skeleton(F.lit("import x\ndef f():\n    return 1\nclass A:\n"))) == "def f():\nclass A:"


def test_minhash(spark):
    a, b = [f"t{i}" for i in range(100)], [f"t{i}" for i in range(5, 105)]
    sig = lambda xs: tx.minhash(F.transform(F.array(*map(F.lit, xs)), tx.token_hash))
    same, near, far = (one(spark, tx.equal_slots(sig(a), sig(x))) for x in (a, b, [f"u{i}" for i in range(100)]))
    assert same == 1 and near > 0.75 and far < 0.2
    assert one(spark, tx.minhash(F.array().cast("array<bigint>"))) is None


def test_paths(spark):
    files = ["./src/a.py", "src\\b.py", "src/tests/c.py", "lib/d.rs", None]
    df = spark.createDataFrame([(f,) for f in files], "path string")
    kept = lambda *a: [r["path"] for r in df.where(paths.path_filter(F.col("path"), *a)).collect()]
    assert kept(["src"], ["tests"]) == files[:2]
    assert kept((), ["src"]) == ["lib/d.rs", None] and kept(["src/tests"], ["src"]) == []
    assert kept(["**/*.rs"]) == ["lib/d.rs"] and kept(["d.rs"]) == ["lib/d.rs"]
    assert one(spark, paths.import_matches(F.lit("a::{b, c}"), "a::c::d")) and not one(spark, paths.import_matches(F.lit("ab"), "a"))


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30), ("d", 1)], "id string, cost int")
    assert [r["id"] for r in ranking.budget(df, None, ["id"], "cost", 35).orderBy("id").collect()] == ["a", "b"]


def test_ranking_with_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, "graph graph index"), (2, ""), (3, None), (4, "index über"), (None, "graph")], "doc_id long, text string")
    for rule in (ranking.bm25, ranking.tfidf, ranking.simple_tfidf):
        assert [r["doc_id"] for r in rule(df, "doc_id", "text", "graph").collect()] == [1]
        assert rule(df, "doc_id", "text", "absent").count() == 0
        assert rule(df.limit(0), "doc_id", "text", "graph").count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [-1.0, 0.0]), (6, [2.0, 0.0]), (7, [math.nan, 1.0]), (None, [1.0, 0.0])]
    t = vectors.VectorTable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    q = spark.createDataFrame([(0, [3.0, 0.0])], "query int, embedding array<float>")
    found = {r["id"]: (r["score"], r["rank"]) for r in t.top(q, 10).collect()}
    assert found[1] == (1.0, 1) and found[6] == (1.0, 2) and found[5][0] == -1 and all(found[i][0] == 0 for i in (2, 3, 4, 7))
    assert t.count().first()["n"] == 7
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1)], "query string, id string, rank int")
    assert [r["id"] for r in vectors.fuse([a, b]).orderBy("rank").collect()] == ["y", "x"]


def test_clones_meet_in_crowded_bands(spark, monkeypatch):
    monkeypatch.setattr(clones, "BLOCK", 3)
    base = [f"w{i}" for i in range(80)]
    rows = [(f"f{i:02}", base + [f"own{i}"]) for i in range(12)] + [("copy", base + ["own0"]), ("short", ["a"]), ("none", None), (None, base)]
    pairs, members = clones.similar_classes(spark.createDataFrame(rows, "id string, tokens array<string>"), "id", "tokens", 0.8)
    assert pairs.count() == 66 and members.count() == 13
    assert {r["copies"] for r in clones.clone_groups(spark.createDataFrame(rows, "id string, tokens array<string>"), "id", "tokens").collect()} == {1, 2}


def test_percentiles(spark):
    for n in (1, 2, 100):
        df = spark.createDataFrame([("t", float(i)) for i in range(n)] + [("t", None)], "tool string, v double")
        for rule, at in (("nearest", lambda p: math.floor(p * (n - 1) + 0.5)), ("floor", lambda p: min(math.floor(n * p), n - 1))):
            found = {r["point"]: r["value"] for r in control.percentiles(df, "tool", "v", (0.5, 0.95), rule).collect()}
            assert found == {p: float(at(p)) for p in (0.5, 0.95)}


def test_lsp_verdicts(spark):
    verdict = lambda *a: one(spark, control.lsp_verdict(*map(F.lit, a)))
    assert verdict("", "b", "f", 0.5, 1) == "empty_caller_fqn" and verdict("a", "b", "f", 1.5, 1) == "invalid_confidence_range"
    assert verdict("a", "b", "", 0.5, 1) == "empty_file" and verdict("a", "b", "f", 0.5, 0) == "invalid_line_number" and verdict("a", "b", "f", 0.5, 3) == "accepted"


def test_smells(spark):
    source = "def f(a, b, c, d, e, g):\n" + "    x = 1\n" * 60 + "    # TODO\n"
    df = spark.createDataFrame([("a", source), ("b", None), ("c", "")], "id string, source string")
    found = {(r["id"], r["smell"]): r["severity"] for r in smells.text_findings(df).collect()}
    assert found[("a", "long_function")] == "warning" and ("a", "too_many_parameters") in found and not any(k[0] != "a" for k in found)


def at(minute: float) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_debounce(spark):
    rows = [("p", "created", at(0)), ("p", "modified", at(1)), ("p", "modified", at(2)), ("p", "deleted", at(30)), ("q", "modified", at(1))]
    df = spark.createDataFrame(rows, "path string, kind string, ts timestamp")
    found = {(r["path"], r["first_ts"]): (r["kind"], r["events"]) for r in ev.debounce(df, "5 minutes").collect()}
    assert found == {("p", at(0)): ("created", 3), ("p", at(30)): ("deleted", 1), ("q", at(1)): ("modified", 1)}


def test_streams_give_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"/p{rng.randint(0, 4)}", rng.choice(["a", "b"]), at(i * 3 + rng.random())) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id int, path string, kind string, ts timestamp")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = ev.replay(ev.tumbling(stream(), "30 minutes"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    batch = {tuple(r) for r in ev.tumbling(df, "30 minutes").collect()}
    got = {tuple(r) for r in found.collect()}
    assert got <= batch and all(r in got for r in batch if r[0] + datetime.timedelta(minutes=30) <= at(580))
    waits = ev.replay(ev.stateful_debounce(stream(), 600_000), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert waits.agg(F.sum("events")).first()[0] <= 200 and waits.where("events < 1").count() == 0
    changes = stream().select("path", "kind", "ts", (F.col("event_id") % 3 == 0).alias("deleted"))
    ev.upsert_batches(changes, str(tmp_path / "t"), ["path"], str(tmp_path / "c3"))
    last = {}
    for i, path, _, _ in rows:
        last[path] = i
    assert {r["path"] for r in spark.read.parquet(str(tmp_path / "t" / "v1")).collect()} == {p for p, i in last.items() if i % 3}


def test_extractors():
    kinds = lambda text, lang: {(r[1], r[2], r[4]) for r in extract.records(text, lang)}
    py = kinds("import os\nclass A(B):\n    def f(self, x):\n        g(x)\n", "python")
    assert {("CLASS", "A", None), ("METHOD", "f", None), ("INHERITS", "A", "B"), ("CALLS", "f", "g"), ("IMPORTS", None, "os")} <= py
    rs = kinds("use a::b;\npub struct S;\nimpl T for S {}\nfn main() {\n    fib(3);\n}\n", "rust")
    assert {("STRUCT", "S", None), ("IMPLEMENTS", "S", "T"), ("FUNCTION", "main", None), ("CALLS", "main", "fib"), ("IMPORTS", None, "a::b")} <= rs
    for lang, text, want in (
        ("java", "class A extends B {\n    public int f(int a) {\n        g();\n    }\n}\n", {("CLASS", "A", None), ("INHERITS", "A", "B"), ("FUNCTION", "f", None), ("CALLS", "f", "g")}),
        ("go", "type T struct {\n}\nfunc (t *T) F() {\n\tg()\n}\n", {("STRUCT", "T", None), ("FUNCTION", "F", None), ("CALLS", "F", "g")}),
        ("typescript", "export class A extends B {\n  f(x: number): void {\n    g(x);\n  }\n}\n", {("CLASS", "A", None), ("INHERITS", "A", "B"), ("FUNCTION", "f", None)}),
        ("ruby", "class A < B\n  def f\n    g(1)\n  end\nend\n", {("CLASS", "A", None), ("INHERITS", "A", "B"), ("FUNCTION", "f", None), ("CALLS", "f", "g")}),
        ("shell", "f() {\n  x\n}\n", {("FUNCTION", "f", None)}),
        ("kotlin", "class A : B() {\n    fun f() {\n        g()\n    }\n}\n", {("CLASS", "A", None), ("FUNCTION", "f", None)}),
        ("swift", "class A: B {\n    func f() {\n        g()\n    }\n}\n", {("CLASS", "A", None), ("FUNCTION", "f", None)}),
        ("php", "class A extends B {\n    public function f() {\n        g();\n    }\n}\n", {("CLASS", "A", None), ("FUNCTION", "f", None)}),
        ("c", "struct S {\n};\nint f(int a) {\n    g(a);\n}\n", {("STRUCT", "S", None), ("FUNCTION", "f", None), ("CALLS", "f", "g")}),
        ("cpp", "class A : public B {\n};\nint A::f(int a) {\n    g(a);\n}\n", {("CLASS", "A", None), ("INHERITS", "A", "B"), ("FUNCTION", "f", None)}),
        ("javascript", "function f() {\n  g();\n}\n", {("FUNCTION", "f", None), ("CALLS", "f", "g")}),
        ("json", '{"a": {"b": 1}}', {("PROPERTY", "a", None), ("PROPERTY", "b", None)}),
    ):
        assert want <= kinds(text, lang), (lang, kinds(text, lang))


def test_embedders(spark):
    for text in ("", "a", "hello world", "x" * 20):
        want = [0.0] * 8
        for i, c in enumerate(text):
            want[i % 8] = ord(c) / 255
        got = one(spark, pipeline.CharacterEmbedder(8).embed(F.lit(text)))
        assert got == (want if text else None)
    both = pipeline.FallbackEmbedder(pipeline.CharacterEmbedder(8), pipeline.StaticEmbedder(8))
    assert one(spark, both.embed(F.lit(""))) == [0.0] * 8
    assert abs(sum(v * v for v in one(spark, pipeline.StaticEmbedder(16).embed(F.lit("alpha beta gamma")))) - 1) < 1e-9


def test_block_search_leaves_out_the_own_label(spark):
    rows = [(i, [float(i % 3), 1.0], "ab"[i % 2] if i % 5 else None) for i in range(20)]
    base = spark.createDataFrame(rows, "id long, v array<float>, label string")
    ask = base.selectExpr("id as query", "v", "label").where("query < 4")
    label = dict((r[0], r[2]) for r in rows)
    found = vectors.top_k(vectors.compared(ask, base, 3), "query", "score", "id", 3).collect()
    assert len(found) == 12 and all(label[r["query"]] is None or label[r["query"]] != label[r["id"]] for r in found)
