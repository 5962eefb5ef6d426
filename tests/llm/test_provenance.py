"""The most copied code stays indexed although its copies are edited."""

import random

from codeloom.llm.provenance import flag_files, judge


def test_edited_copies_of_a_hot_library(spark):
    rng = random.Random(7)
    words = "amber birch cedar delta ember fjord grove heron inlet jetty knoll larch maple north olive pines quill ridge stone tulip".split()
    shapes = ["{} = {}({})", "if {} > {}: {}()", "{}.{}({}, 1)", "return {} + {} * {}", "for {} in {}.{}:", "del {}[{}].{}", "assert {} is not {}, {}", "with {}({}) as {}:"]

    def line() -> str:
        return rng.choice(shapes).format(*("_".join(rng.sample(words, rng.randint(1, 4))) for _ in range(3)))

    library, own = [line() for _ in range(40)], "\n".join(line() for _ in range(40))
    rows = []
    for n in range(150):
        lines = [line() if rng.random() < 0.08 else x for x in library]
        rows.append((f"file:/r{n}/a.py", "FILE", f"/r{n}/a.py", f"/r{n}", "\n".join(lines)))
    assert judge("own.py", own) is None and judge("a.py", rows[0][-1]) is None
    rows += [("file:/r0/own.py", "FILE", "/r0/own.py", "/r0", own)] * 3
    nodes = spark.createDataFrame(rows, "id string, kind string, path string, repository_path string, source string")
    flagged = {r.node_id for r in flag_files(nodes).collect()}
    assert flagged == {r[0] for r in rows if not r[0].endswith("own.py")}


HEADER = """// This program is free software; anybody may pass it on
// and change it under the terms that its authors have chosen,
// which are the second edition of them or any later one.
// It comes in the hope that somebody finds a use for it,
// yet nobody promises that it is fit for anything at all.
// The terms should have come together with this program;
// whoever has not got them may write to the foundation,
// whose address stands at the end of the common manual,
// and which sends them to everybody who asks for them.
"""


def rows_of(spark, files):
    rows = [(f"file:{p}", "FILE", p, p.rsplit("/", 1)[0], s) for p, s in files.items()]
    return spark.createDataFrame(rows, "id string, kind string, path string, repository_path string, source string")


def code(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    words = "amber birch cedar delta ember fjord grove heron inlet jetty knoll larch maple north olive pines quill ridge".split()
    return [f"{'_'.join(rng.sample(words, 3))} = {rng.choice(words)}({rng.choice(words)}, {rng.choice(words)})" for _ in range(n)]


def test_a_common_licence_header_is_no_copy(spark):
    files = {f"/r{i}/a.c": HEADER + "\n".join(code(i, 5)) for i in range(6)}
    assert flag_files(rows_of(spark, files)).count() == 0


def test_ownership_scattered_over_other_files(spark):
    """Many small files of a third repository hold some of the lines too, and take their ownership."""
    library = code(99, 60)
    files = {"/a/lib.py": "\n".join(library), "/b/copy.py": "\n".join(library)}
    files |= {f"/c{i}/part.py": "\n".join(code(i, 60) + library[i * 6 : i * 6 + 6]) for i in range(10)}
    flagged = {r.node_id for r in flag_files(rows_of(spark, files)).collect()}
    assert {"file:/a/lib.py", "file:/b/copy.py"} <= flagged and not any("part" in x for x in flagged)


def test_defined_results(spark):
    files = rows_of(spark, {"/a/x.py": "x = 1\n"})
    odd = spark.createDataFrame([("n", "FILE", None, None, "\n".join(code(1, 30))), (None, "FILE", "p", "r", "x"), ("e", "FILE", "p", "r", ""), ("z", "FILE", "p", "r", None)], files.schema)
    assert flag_files(files.union(odd)).count() == 0 and flag_files(files.limit(0)).count() == 0


def test_a_loose_folder_alone_is_no_evidence():
    own = "\n".join(code(5, 12))
    assert judge("/r/deps/a.py", own) is None
    assert judge("/r/deps/a.py", "# Copyright the kite authors, licensed under MIT\n" + own) == "vendored"
    assert judge("/r/node_modules/kite/a.py", own) == "vendored"
