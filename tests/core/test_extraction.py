import pytest

from tidemark.functions import syntax
from tidemark.functions.facts import calls, facts, method_lines
from tidemark.functions.tokens import kinds, tokenize


def of(source, kind):
    return [name for k, name in facts("<?php " + source) if k == kind]


ODD = [
    "", "no code", "<?php", "<?php class", "<?php use A\\B", "<?php '", '<?php "{$', "<?php <<<X\nabc", "<?php /* open",
    '<?php $a = "x {$b["k"]} $c[0] ${d} $e->f->g"; ?>\ntail', "<?php <<<'R'\n $no\n R;\n", "﻿<?php $ä = 1; {{{ }", "<?php ${", "<?php `ls $x`",
]


@pytest.mark.parametrize("source", ODD)
def test_tokens_lose_nothing(source):
    tokens = tokenize(source)
    assert "".join(t.text for t in tokens) == source
    assert len(kinds(tokens)) == len(tokens)
    facts(source), calls(source), method_lines(source)


@pytest.mark.parametrize(
    ("source", "kind", "names"),
    [
        ("use Foo\\Bar; use Baz\\Qux;", "use", ["Foo\\Bar", "Baz\\Qux"]),
        ("use Foo\\{Bar, Baz as B, In\\C};", "use", ["Foo\\Bar", "Foo\\Baz", "Foo\\In\\C"]),
        ("use Foo\\Bar, Baz\\Qux as Q; use function a\\f; use \\Abs\\D;", "use", ["Foo\\Bar", "Baz\\Qux", "a\\f", "Abs\\D"]),
        ("use A\\B /* c */;", "use", []),
        ("$f = function () use ($x) { };", "use", []),
        ("namespace App; class User {} interface I {} trait T {}", "declared", ["App\\User", "App\\I", "App\\T"]),
        ("class MyClass {}", "declared", ["MyClass"]),
        ("namespace { class Foo {} }", "declared", ["\\Foo"]),
        ("enum Suit { case A; } $o = new class { };", "declared", []),
        ("$a = [A::class => B::class];", "declared", ["B"]),
        ("class A extends Bar implements BI, CI {}", "extends", ["Bar"]),
        ("class A extends Bar implements BI, CI {}", "implements", ["BI", "CI"]),
        ("interface A extends B, C {}", "extends", ["B", "C"]),
        ("namespace N; class A extends \\Fully\\Qualified\\Name {}", "extends", ["Fully\\Qualified\\Name"]),
        ("namespace N; class A extends Models\\User {}", "extends", ["N\\Models\\User"]),
        ("class A { use T1, T2; use T3 { x as y; } }", "trait", ["T1", "T2", "T3"]),
        ("class A { use T; }", "use", []),
        ("namespace A; class X {} namespace B; use C\\D;", "use", ["C\\D"]),
        ("new Bar(); new Bar(); new self(); new static; new $x;", "new", ["Bar"]),
        ("Bar::f(); self::g(); parent::h(); static::i(); Baz::X;", "static", ["Bar", "Baz"]),
        ("include 'a.php'; require_once('b/c.php'); include __DIR__ . '/d.php'; require $x;", "include", ["a.php", "b/c.php"]),
        ("$this->a(); $b->c();", "var", ["$this", "$b"]),
    ],
)
def test_facts(source, kind, names):
    assert of(source, kind) == names


def test_calls():
    source = """<?php
namespace App;
use Lib\\User as U;
use Lib\\Tool;
class A {
    function f() { $this->g(); Tool::run(); U::x(); $v->m(); self::s(); static::t(); f()->chain(); $this?->no(); }
    function q() { $x = "{$this->a}"; $this->lost(); }
}
"""
    assert calls(source) == [
        ("App\\A::f", "App\\A::g"), ("App\\A::f", "Lib\\Tool::run"), ("App\\A::f", "Lib\\UserU::x"), ("App\\A::f", "$v->m"), ("App\\A::f", "App\\self::s"), ("App\\A::f", "->chain"),
        ("App\\A::q", "App\\A::a"),
    ]


def test_lines():
    source = "<?php\nclass A\n{\n    function f()\n    {\n        $a = 1;\n\n        return $a;\n    }\n    public $p;\n    function g() { }\n}\n"
    assert dict(method_lines(source)) == {4: "A::f", 5: "A::f", 6: "A::f", 8: "A::f", 11: "A::g"}


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("namespace App; use Foo\\Bar, Baz\\Qux as Q; use T\\{A, B as C, In\\D}; use function a\\f;", {"use": ["Foo\\Bar", "Baz\\Qux", "T\\A", "T\\B", "T\\In\\D", "a\\f"]}),
        ("namespace N; class A extends Bar implements BI, \\X\\CI { use T1, In\\T2; }", {"declared": ["N\\A"], "extends": ["Bar"], "implements": ["BI", "X\\CI"], "trait": ["T1", "N\\In\\T2"]}),
        ("interface I extends J, K {} trait T { use U; function f() { $g = function () use ($x) {}; } use V; }", {"declared": ["I", "T"], "extends": ["J", "K"], "trait": ["U", "V"]}),
        ("$a = [A::class => B::class]; A::X; A::$p; B::f(); self::g(); static::h();", {"static": ["B", "self", "static"]}),
        ("new Bar(); new self; new static(); new class extends Base { use T; }; new $x;", {"new": ["Bar", "self", "static"], "extends": ["Base"], "trait": ["T"]}),
        ("$foo->bar(); $this->x->y(); $v->p; $w?->q(); A::$s->m();", {"var": ["foo"]}),
        ("enum Suit implements HasLabel { case A; } class After {}", {"declared": ["After"]}),
        ("namespace { class Foo {} }", {"declared": ["Foo"]}),
        ("class A { function f() { return \"{$this->x} y\"; } use T; }", {"declared": ["A"], "trait": ["T"]}),
        ("include 'a.php'; require_once('b.php'); include 'c' . 'd'; include __DIR__ . '/e';", {"include": ["a.php", "b.php"]}),
        ("use A\\B /* c */; // d", {"use": ["A\\B"]}),
        ("class A { function f( {", {}),
    ],
)
def test_syntax_facts(source, expected):
    got: dict = {}
    for kind, name in syntax.facts("<?php " + source):
        got.setdefault(kind, []).append(name)
    assert got == expected


@pytest.mark.parametrize("source", ODD)
def test_syntax_on_odd_texts(source):
    syntax.facts(source)
