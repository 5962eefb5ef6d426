"""Validity of sources: languages, error collection, and the operator over tables."""

import ast
import hashlib
from datetime import datetime
from pathlib import Path

from codeloom.llm.syntax import python, validity
from codeloom.llm.common import LANGUAGES

GO = 'package a\n\nimport "fmt"\n\ntype T[K comparable] struct {\n\ta, b int\n\tM map[string][]K\n}\n\nfunc (t *T[K]) F(x int, ys ...string) (n int, err error) {\n\tfor i, y := range ys {\n\t\tif v, ok := t.M[y]; ok && len(v) > i {\n\t\t\tfmt.Println(T[int]{a: 1, b: 2}, func() {}, v[1:])\n\t\t}\n\t}\n\tswitch z := any(x).(type) {\n\tcase int, string:\n\t\t_ = z\n\tdefault:\n\t\treturn\n\t}\n\treturn x, nil\n}\n'


def test_valid_sources():
    assert validity.check(GO, "go") == []
    assert validity.check('{"a": [1, -2.5e3, {"b": null}], "c": "\\u00e9"}', "json") == []
    assert validity.check("match x:\n    case [a, *_]:\n        pass\n", "python") == []
    for language in LANGUAGES:
        assert validity.check("", language) == []


CONSTRUCTS = {
    "kotlin": '''@file:JvmName("X")
package a.b
import a.b.*
sealed class R<out T : Any>(val x: Int = 3, private var y: String?) : Base<T>(x), I by z where T : Comparable<T> {
    companion object { const val K = 1; @JvmStatic fun of(): R<Int>? = null }
    init { require(x > 0) { "bad ${if (x > 1) "a" else "b"}" } }
    constructor(a: Int) : this(a, null) { }
    override val size: Int
        get() = field + 1
    suspend inline fun <reified T> go(vararg a: T, f: T.(Int) -> Unit = {}): Int? {
        val (p, q) = a to b
        when (val v = f(a)) {
            is String, !in 1..3 -> println(v)
            else -> throw X()
        }
        val r = a?.b?.c ?: return@go null
        a.map { it * 2 }.filter { (k, v) -> k > v }
            .forEach(::println)
        for ((i, x) in xs.withIndex()) if (i > 3) break else continue
        try { y!!.z() } catch (e: Exception) { } finally { }
        return if (x) 1 else 2
    }
}
enum class E(val a: Int) : I { A(1), B(2) { override fun f() = 2 }, ; abstract fun f(): Int }
''',
    "swift": '''@objc public final class A<T: Equatable>: B, C where T: D {
    private(set) var x: [String: Int?] = [:]
    var z: Int = 0 { didSet { print(oldValue) } }
    init?(_ a: Int, b c: String = "x", d: inout [Int], e: @escaping (Int) -> Void) throws { super.init() }
    subscript(i: Int) -> Int { get { 1 } set { x = newValue } }
    func f<U>(_ u: U) async throws -> (Int, String) where U: Hashable {
        guard let a = b, case .some(let c) = d, x > 3 else { return (1, "a") }
        if let q = w as? Int, !q.isEmpty { print("v \\(x + y[2]) \\(f("z"))") } else { }
        switch v {
        case .a(let x) where x > 2: fallthrough
        case 3...5: x = 2
        default: break
        }
        let r = arr.map { $0 * 2 }.filter({ (x: Int) -> Bool in x > 1 }).reduce(0, +)
        let n = a?.b?[2] ?? c!
        DispatchQueue.main.async { [weak self] in self?.go() }
        do { let y = try? await z() } catch let e as E { } catch { throw e }
        return (1, a ? b : c)
    }
}
protocol P: AnyObject { associatedtype T; var x: Int { get set }; func f() -> Self }
''',
    "rust": '''#![allow(x)]
use a::{b, c::*, d as e};
pub(crate) struct S<'a, T: Fn(&'a str) -> Vec<Vec<T>> = X>(pub T, &'a mut [u8; 3]) where T: Copy + 'a;
impl<'a, T> Tr for S<'a, T> { const N: usize = 1 << 3; fn f(&mut self, (a, b): (u8, u8)) -> impl Iterator<Item = u8> + '_ { a.iter().map(|&x| x >> 1) } }
fn main() -> Result<(), Box<dyn Error>> {
    let Some(x) = y.collect::<Vec<_>>().first() else { return Ok(()) };
    'o: for (i, c) in "a".chars().enumerate() { if c == 'x' || i >= 3 { break 'o; } }
    match x { A { b, .. } | B(1..=5, _) if b > 2 => {} &[first, .., last] => foo()?, _ => unreachable!("{}", r#"x"y"#), }
    let f = async move |z: i32| -> i32 { z.0 .1 };
    if let Some(S { a: 1, b }) = s && b { } else if x < y as usize { }
    unsafe { *p = Foo { a, ..Default::default() } }
    vec![1; 3].iter().for_each(drop);
    Ok(())
}
macro_rules! m { ($x:expr) => { $x }; }
''',
    "php": '''<html><?php
namespace A\\B;
use X\\{Y, Z as W};
#[Attr(1)]
abstract class C extends D implements E, F {
    public function __construct(private readonly int|string $a, ?Foo &...$b) { parent::__construct($a); }
    public function g(array $x = ['a' => 1, ...$y]): ?array {
        foreach ($x as $k => [$a, 'b' => $c]): echo $k; endforeach;
        if ($a): echo 1; elseif ($b): else: endif;
        $r = match(true) { $a > 1, $b => 'x', default => throw new E() };
        $f = fn(int $x): int => $x ** 2;
        return $this?->foo['x']->bar(...) ?? (int) $z . "a {$b['c']} $d" <=> $q;
    }
}
enum Suit: string { case A = 'a'; const X = self::A; }
$s = <<<EOT
  text $x
  EOT;
echo 1, 2; $i++; ?>
html <?= $x ?> more
''',
    "ruby": '''module A
  class B < C::D
    CONST = %w[a b].freeze
    def initialize(a, b = 2, *c, d:, e: 3, **f, &g)
      @a, @b = a, b
    rescue Foo, Bar => e
      raise "x #{e.message} #{h["k"]}" unless e.nil?
    ensure
      2
    end
    def self.x = 42
    def []=(k, v); @h[k] = v; end
    private def foo?(x) x end
  end
end
y = case x
    when 1, 2 then "a"
    when /re x/i
      "b"
    else :c
    end
puts [1, 2].map { |v| v * 2 }.select(&:even?).inject(0) { |s, (a, b)| s + a }
h = { a: 1, "b": 2, :c => 3, **o }
while i < 10 do i += 1 end
t = <<~EOS
  heredoc #{x} end
EOS
z = ->(a, b = 1) { a + b }
begin; x; end while y
a = b ? c : d
puts -x, *args
loop { break }
yield(x) if block_given?
''',
    "shell": '''#!/bin/bash
f() { local a="$1" b=${2:-"x y"}; }
if [[ $a =~ ^[0-9]+$ && ( -f x || ! -d "y" ) ]]; then :; elif test -z "$b"; then echo; else exit 1; fi
for ((i=0; i<3; i++)); do echo $i; done
case "$x" in
  a|b) echo 1 ;;
  (c*) ;;
  *) echo "${x%%.*}" >&2
esac
cat <<EOF > out
 $(date) unbalanced " ( {
EOF
x=$(cat <<EOF
a ) b
EOF
)
{ echo a; echo b; } && ( cd x; ls ) || true &
read -r a <<< "$b"
''',
}

BROKEN = {
    "kotlin": ["fun f() {\n    println(1)\n", "fun f( {\n}\n", "def f(self):\n    x = 1\n"],
    "swift": ["func f() {\n    print(1)\n", "let = 3\n", "def f(self, x):\n    return x\n"],
    "rust": ["fn f() {\n    let x = 1\n    let y = 2;\n}\n", "fn f(x i32) {}\n", "pub fn f() {\n    if x {\n"],
    "php": ["<?php\nfunction f( {\n}\n", "<?php\n$x = ;\n", "<?php\nclass A { function f() { }\n"],
    "ruby": ["def f(a)\n  if a\n    1\n  end\n", "x = (1 + \n", "func f(a int) int {\n\treturn a\n}\n"],
    "shell": ["if [ 1 ]; then\n  echo\n", "f() {\n  echo 'x\n}\n", "for x in a; do echo; fi\n"],
}


def test_constructs():
    for language, source in CONSTRUCTS.items():
        assert validity.check(source, language) == [], language


def test_broken_sources():
    for language, sources in BROKEN.items():
        for source in sources:
            assert validity.check(source, language), (language, source)
        assert validity.check(CONSTRUCTS[language].replace("\n", "\n<<<<<<< HEAD\n", 1), language), language


def test_any_depth_is_valid():
    assert validity.check("int x = " + "(" * 5000 + "1" + ")" * 5000 + ";", "c") == []


def test_every_error_is_kept():
    go = "package a\n\nfunc f() {\n\tx := := 1\n}\n\n@@ -1 +1 @@\n\nfunc g() {\n\ty = = 2\n}\n"
    assert {4, 7, 10} <= {line for line, _ in validity.check(go, "go")}
    assert [line for line, _ in validity.check('{"a": tru,\n "b": 01,\n "c": 1,\n}', "json")] == [1, 2, 4]
    assert [line for line, _ in validity.check("def f(:\n    pass\n\nx = 1\n\ny = = 2\n", "python")] == [1, 6]


def test_a_stray_brace_ends():
    assert validity.check("}\nint x;\n", "cpp")


def test_operator(spark):
    at = datetime(2026, 1, 1)
    sources = {"/r/a.json": "{", "/r/b.json": "{}", "/r/c.json": "x = 1\n", "/r/d.rs": "fn"}
    nodes = spark.createDataFrame([("FILE", p, s) for p, s in sources.items()] * 2, "kind string, path string, source string")
    rows = [(p, {"/r/c.json": "Python"}.get(p), hashlib.md5(s.encode()).hexdigest(), "/r", at, at) for p, s in sources.items()]
    rows += [("/r/c.json", "json", "old", "/r", at, at.replace(year=2025)), ("/r/none.json", "json", "x", "/r", at, at)]
    deferred = spark.createDataFrame(
        rows, "path string, language string, content_hash string, repository_path string, spilled_at timestamp, written_at timestamp"
    )
    assert sorted(r.path for r in validity.invalid_files(deferred, nodes).collect()) == ["/r/a.json", "/r/d.rs"]
    rates = {r.language: (r.files, r.unjudged, r.invalid, r.rate) for r in validity.rates(deferred, nodes).collect()}
    assert rates == {"json": (2, 0, 1, 0.5), "python": (1, 0, 0, 0.0), "rust": (1, 0, 1, 1.0)}


def nested(levels: int, last: str) -> str:
    return "".join("    " * i + f"if a{i}:\n" for i in range(levels)) + "    " * levels + last + "\n"


def test_limits_of_the_parser_are_no_errors():
    deep = lambda inner, after="": "(" * 300 + inner + ")" * 300 + after + "\n"
    match = "match x:\n" + "    " * 51 + "case 1:\n" + "".join("    " * (52 + i) + f"if b{i}:\n" for i in range(60)) + "    " * 112 + "pass"
    valid = ["x = " + deep("1"), nested(150, "pass"), nested(50, match), "x = " + "9" * 5000 + "\n", "x = " + "-" * 10000 + "1\n", "x = a" + ".b" * 100_000 + "\n"]
    valid += ["x = " + deep("f\"{a['b']:#>{w}}{c:#x}{d:'^9}\\{e[\"f\"]}\""), deep("a.b", " += 1"), deep("a, [b, *c]", " = d"), "del " + deep("a, b")]
    for source in valid:
        assert validity.check(source, "python") == [], source[:40]
    wrong = {deep("1 1"): 1, "\n" + deep("1")[:-2]: 2, nested(150, "x = = 1"): 151, "x = " + deep("1") + "y = = 2\n": 2, deep("f()", " = 1"): 1, deep("a, b", " += 1"): 1, "del " + deep("a, *b"): 1}
    for source, line in wrong.items():
        assert line in [n for n, _ in validity.check(source, "python")], source[:40]


def test_limits_of_the_language_are_errors():
    assert validity.check("x = f'{a:{b:{c}}}'\n", "python") == []
    assert [n for n, _ in validity.check("\nx = f'{a:{b:{c:{d}}}}'\n", "python")] == [2]


def test_flattened_sources_are_as_valid(monkeypatch):
    monkeypatch.setattr(python, "LEVELS", 2)
    for path in [*Path(ast.__file__).parent.glob("*.py")][:150]:
        rest, found = python.flattened(path.read_text(encoding="utf-8"))
        assert not found and python.parse(rest) is None, path


def test_what_is_not_judged_is_not_valid(spark):
    beyond = "x = " + "lambda: " * 20_000 + "1\n"
    assert validity.check(beyond, "python") is None
    assert [n for n, _ in validity.check(beyond + "y = = 2\n", "python")] == [2]
    rows = [("FILE", "/r/a.py", beyond), ("FILE", "/r/b.py", beyond), ("FILE", "/r/b.py", "x = 1\n"), ("FILE", "/r/c.py", beyond), ("FILE", "/r/c.py", "x = =\n")]
    nodes = spark.createDataFrame(rows, "kind string, path string, source string")
    deferred = spark.createDataFrame(
        [(f"/r/{x}.py", "python", "old", "/r", None, None) for x in "abc"],
        "path string, language string, content_hash string, repository_path string, spilled_at timestamp, written_at timestamp",
    )
    assert [r.path for r in validity.invalid_files(deferred, nodes).collect()] == ["/r/c.py"]
    assert [(r.files, r.unjudged, r.invalid, r.rate) for r in validity.rates(deferred, nodes).collect()] == [(3, 2, 1, 1.0)]
