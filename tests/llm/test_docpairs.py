"""Descriptions, inherited documentation over planted hierarchies, and defined results."""

from __future__ import annotations

from codeloom.llm import docpairs

SCHEMA = "id string, kind string, name string, path string, line_number int, lang string, source string, branch string, repository_path string"
DOC = "/** Computes how many rows fit into one page of the store. */"


def nodes_of(spark, files, branch="main", repo="/r"):
    rows = []
    for path, text in files.items():
        rows.append((f"file:{path}", "FILE", path, path, None, None, text, branch, repo))
        for number, line in enumerate(text.split("\n"), 1):
            if "void " in line or "def " in line or "fn " in line:
                name = line.split("(")[0].split()[-1]
                rows.append((f"{path}:{name}:{number}", "METHOD", name, path, number, None, None, branch, repo))
    return spark.createDataFrame(rows, SCHEMA)


def java(name, tail, doc):
    return f"class {name} {tail}{{\n    {doc}\n    void f() {{\n    }}\n}}\n"


def test_bases():
    assert docpairs.bases_of(" extends B implements C, D<E> ", "java") == ["B", "C", "D"]
    assert docpairs.bases_of("(B, mod.C, metaclass=M):", "python") == ["B", "C"]
    assert docpairs.bases_of("(val x: Int) : B(x), C ", "kotlin") == ["B", "C"]
    assert docpairs.bases_of(": public B, private C ", "cpp") == ["B", "C"]


def test_rust_impl_is_of_the_type():
    _, classes = docpairs.document("impl Display for Foo {\n}\nimpl Bar {\n}\n", "rust", [])
    assert ("Foo", "Display", 0) in classes and not any(c[0] == "Display" for c in classes) and ("Bar", None, -1) in classes


def test_inherited_documentation(spark):
    inherit = "/** {@inheritDoc} */"
    files = {
        "/r/Base.java": java("Base", "", DOC), "/r/I.java": java("I", "", "/** The interface tells what every page of the store holds. */"),
        "/r/One.java": java("One", "extends Base ", inherit), "/r/Both.java": java("Both", "extends Nothing implements I ", inherit),
        "/r/Loop.java": java("Loop", "extends Pool ", inherit), "/r/Pool.java": java("Pool", "extends Loop ", inherit), "/r/Open.java": java("Open", "extends Gone ", inherit),
    }
    deep = {f"/r/D{i}.java": java(f"D{i}", f"extends {'Base' if i == 0 else f'D{i - 1}'} ", inherit) for i in range(20)}
    nodes = nodes_of(spark, files | deep)
    found = {r["node_id"].split(":")[0].rsplit("/", 1)[1]: r["origin"] for r in docpairs.pairs(nodes.union(nodes)).collect()}
    assert found["One.java"] == "/r/Base.java:f:3" and found["Both.java"] == "/r/I.java:f:3"
    assert all(found[f"D{i}.java"] == "/r/Base.java:f:3" for i in range(20))
    assert not {"Loop.java", "Pool.java", "Open.java"} & set(found)
    own = {r["node_id"] for r in docpairs.documented_functions(nodes).collect()}
    assert own == {"/r/Base.java:f:3", "/r/I.java:f:3"}


def test_equal_names_in_one_repository(spark):
    files = {
        "/r/a.java": java("Base", "", DOC) + java("A", "extends Base ", "/** {@inheritDoc} */"),
        "/r/b.java": java("Base", "", "/** Tells how many of the other pages are still kept. */"),
    }
    found = {r["node_id"]: r["origin"] for r in docpairs.pairs(nodes_of(spark, files)).collect()}
    assert found["/r/a.java:f:8"] == "/r/a.java:f:3"


def test_long_signature_and_branches(spark):
    long_ = "def f(\n" + "    a,\n" * 400 + "):\n    \"\"\"Walks all pages of the store and counts them.\"\"\"\n"
    dev = "\n\n" + long_
    nodes = nodes_of(spark, {"/r/a.py": long_}).union(nodes_of(spark, {"/r/a.py": dev}, "dev"))
    assert docpairs.documented_functions(nodes).count() == 2


def test_defined_results(spark):
    rows = [("x", "METHOD", None, None, None, None, None, None, None), (None, "METHOD", "f", "/r/a.py", 1, None, None, "main", "/r"), ("f", "FILE", "a", "/r/a.py", None, None, None, None, None), ("g", "FILE", "a", "/r/b.py", None, None, "", None, None), ("m", "METHOD", "f", "/r/b.py", 99, None, None, None, None)]
    nodes = spark.createDataFrame(rows, SCHEMA)
    assert docpairs.pairs(nodes).count() == 0 and docpairs.pairs(nodes.limit(0)).count() == 0


def described(text, lang, name="f", line=None):
    lines = text.split("\n")
    at = line or next(i for i, x in enumerate(lines, 1) if f"{name}(" in x)
    return docpairs.document(text, lang, [(name, at)])[0][0][2] >= docpairs.MIN_WORDS


def test_descriptions_that_look_like_something_else():
    for text in (
        "Denotes how many rows fit into one page.", "Standard deviation of the sizes of all pages.", "Blacklists the given page for all other readers.",
        "Coverage of the pages by rows that are kept.", "Missing documents are fetched again from the remote store.", "Todo items of all users come out in order.",
        "Undocumented members are listed after the others.", "Tells whether the copyright notice stands at the top.", "Uses @c malloc to get the memory of a page.",
        "TODO: split this\n\nComputes how many rows fit into one page.", "@param n count\n@brief Computes how many rows fit into one page.",
        "Sends mail to @owner about all the pages lost.", "Hack tables are read before the others are.", "Turns a raw page into at most one row for each\nplaceholder.",
    ):
        assert docpairs.description_of(text, "f")[1] >= docpairs.MIN_WORDS, text
    for text in (
        "pylint: disable=too-many-arguments, too-many-locals, too-many-branches, no-self-use", "eslint-disable-next-line a, b, c, d, e, f, g", "Copyright 2019 The Page Store Authors of this file and others",
        "TODO: say what this does\nand how it does so for all the pages", "@param n how many rows fit into one page", "to be documented when the interface has settled down",
        "clang-format off since this table is set by hand", "c8 ignore next because nobody can ever get here", "Licensed under the terms of the licence beside this file",
    ):
        assert docpairs.description_of(text, "f")[1] < docpairs.MIN_WORDS, text


def test_documentation_directly_before():
    words = "Computes how many rows fit into one page."
    assert described(f"/**\n * {words}\n * Reads src/*.ts too.\n */\nint f() {{\n}}\n", "java")
    assert described(f"/** {words} */\n@Route(\n    path = \"/a\",\n    name = \"b\")\nint f() {{\n}}\n", "java")
    assert described(f"/** {words} */\n// eslint-disable-next-line no-console\nfunction f() {{\n}}\n", "javascript")
    assert described(f"/** {words} */ int f() {{\n}}\n", "java") and described(f"/** {words} */ @Override\nint f() {{\n}}\n", "java")
    assert described(f"\ufeff# {words}\ndef f():\n    pass\n", "python")
    assert not described(f"/** {words} */\n\nint f() {{\n}}\n", "java") and not described(f"/** {words} */\nint x = g(\n  1)\nint f() {{\n}}\n", "java")
    assert not described(f"/** {words} */\n// eslint-disable-next-line\n\nint f() {{\n}}\n", "java")


def test_docstrings():
    words = "Computes how many rows fit into one page."
    for text in (
        f'def f(a): """{words}"""\n', f'def f(q="\\"", r="("):\n    """{words}"""\n', f'def f(a: "x:"):\n    "Computes how many "\n', f'def f():\n    ("Computes how many rows "\n     "fit into one page.")\n',
        f'def f():\n    """Tells \\"""whole\\""" {words}"""\n',
    ):
        assert described(text, "python") == ("many \"\n" not in text), text


def test_class_heads():
    def bases(text, lang):
        return {c[:2] for c in docpairs.document(text, lang, [])[1] if c[1]}

    assert docpairs.document("class A:\n    pass\n", "python", [])[1] == [("A", None, -1)]
    assert bases("class A:\n    x = 1\nclass B(\n    A,\n    m.C,\n):\n    pass\n", "python") == {("B", "A"), ("B", "C")}
    assert bases("class A: B {\n}\n", "swift") == {("A", "B")} and bases("@Foo public class A\n    extends B\n    implements C {\n}\n", "java") == {("A", "B"), ("A", "C")}
    assert bases("class API A : public B {\n};\n", "cpp") == {("A", "B")} and bases("unsafe impl T for A {\n}\n", "rust") == {("A", "T")}
    assert bases("class A < B\n  attr :x\n", "ruby") == {("A", "B")} and bases("class A { // of all pages\n", "java") == set()


def test_every_branch_and_nodes_without_repository(spark):
    inherit = "/** {@inheritDoc} */"
    base = {"/r/Base.java": java("Base", "", DOC), "/r/Other.java": java("Other", "", "/** Tells how many of the other pages are still kept. */")}
    main = nodes_of(spark, base | {"/r/A.java": java("A", "extends Base ", inherit)}, repo=None)
    dev = nodes_of(spark, {"/r/A.java": java("A", "extends Other ", inherit)}, "dev", repo=None)
    own = nodes_of(spark, {"/r/A.java": java("A", "", "/** Counts the pages that are not kept any more. */")}, "own", repo=None)
    nodes = main.union(dev).union(own)
    found = {(r["origin"], r["description"].split()[0]) for r in docpairs.pairs(nodes.union(nodes)).collect() if r["node_id"] == "/r/A.java:f:3"}
    assert found == {("/r/Base.java:f:3", "Computes"), ("/r/Other.java:f:3", "Tells"), ("/r/A.java:f:3", "Counts")}
    assert "/r/A.java:f:3" in {r["node_id"] for r in docpairs.documented_functions(nodes).collect()}


def test_missing_branch(spark):
    nodes = nodes_of(spark, {"/r/Base.java": java("Base", "", DOC)})
    bare = nodes.selectExpr(*(c if c != "branch" else "if(kind = 'METHOD', null, branch) AS branch" for c in nodes.columns))
    assert docpairs.documented_functions(bare).count() == 1
    bare = nodes.selectExpr(*(c if c != "branch" else "if(kind = 'FILE', null, branch) AS branch" for c in nodes.columns))
    assert docpairs.documented_functions(bare).count() == 1
