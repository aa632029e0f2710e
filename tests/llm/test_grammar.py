"""Valid code that uses much of each grammar must not be flagged."""

import re

import pytest

from codeloom.llm import syntax

# ruff: noqa
SAMPLES = {
'ts': ["""import React, { useState as useS } from 'react';
import type { X } from './x';
import * as all from "y";
export { a, b as c } from './z';
export default class A<T extends B = {}> extends C<T> implements D {
  private readonly x: Map<string, number[]> = new Map();
  static #p = 1;
  constructor(private a: string, public b?: number) { super(); this.a = a!; }
  get v(): string | undefined { return this.#p as unknown as string; }
  async *gen(): AsyncGenerator<number> { yield* other(); }
  @Input() name: string;
  method<K extends keyof T>(k: K, ...r: any[]): T[K] { return this.m[k]; }
}
type U = | 'a' | 'b' | { [k: string]: number };
type F = (a: number, b?: string) => Promise<void>;
declare module 'm' { export const q: number; }
enum E { A = 1, B, C = 'x' }
namespace N { export type T = typeof x; }
const { a: { b }, c = 3, ...d } = obj, [e, , f] = arr;
label: for (let i = 0, n = x.length; i < n; i++) { if (i % 2 === 0) continue label; else break; }
do { x++; } while (x < 10);
try { f(); } catch { g(); } finally { h(); }
switch (x) { case 1: case 'a': f(); break; default: g(); }
const fn = function* named(a = 1, { b } = {}) { return a ?? b; };
const g2 = async x => { await x; };
if (a) b(); else if (c) d(); else { e(); }
x = a ? b : c ? d : e;
const big = 10n, h = 0xFFn, s = 1_000.5e-3;
export const selectX = (s: S) => s.x;
var v = void 0, t = typeof x === 'u', dl = delete o.p, i2 = 'k' in o, i3 = o instanceof P;
a ||= b; a &&= c; a ??= d; a **= 2;
new Foo;
throw new Error(`x ${a ? `y ${b}` : ''} z`);
for await (const z of gen()) { }
const obj2 = { a, 'b-c': 1, [d]: 2, e() { return 1; }, get f() { return 2; }, async g() {}, ...h, 3: 4 };
"""],
'java':["""package a.b;
import static x.Y.*;
public interface I<T> extends J<T>, K { int X = 1; default void m() { } static int s(int... a) { return a.length; } T get(); }
@interface Ann { String value() default "x"; int[] n() default {1, 2}; }
enum E implements I { A(1) { void f() {} }, B(2); private final int v; E(int v) { this.v = v; } }
record P(int x, String y) { P { if (x < 0) throw new IllegalArgumentException(); } }
abstract class C<T extends Comparable<? super T> & S> {
  static { x = 1; }
  { y = 2; }
  protected transient volatile int a = 1, b[] = {1, 2};
  @SuppressWarnings({"a", "b"}) @Deprecated public C(final int a) throws A, B { super(a); this.<T>foo(); }
  synchronized <R> Map<String, ? extends List<R>> m(Map<String, int[]> q) {
    int[][] z = new int[3][]; Object o = (Runnable & Serializable) () -> { };
    for (int i = 0, j = 1; i < 3; i++, j--) { }
    for (var e : q.entrySet()) System.out.println(e.getKey() + "x" + (char) 'c');
    label: while (true) { do { if (a >>> 2 == 1L || b != 0x1F) break label; } while (!c); }
    try (var r = open(); var s = x) { } catch (A | B e) { } finally { }
    switch (k) { case 1: case 2: f(); break; default: g(); }
    int w = switch (k) { case A, B -> 1; case C -> { yield 2; } default -> throw new X(); };
    if (o instanceof String s && s.length() > 2) return null; else if (x) ; else { }
    synchronized (this) { assert x > 1 : "m"; }
    Function<Integer, Integer> f = x -> x * 2; Supplier<T> g = Foo::new; String t = \"\"\"
      text { \"\"\";
    return cond ? (T) a : b;
  }
  native int n(); abstract int q();
}
"""],
'go':["""package a

import (
	_ "x"
	. "y"
	z "w/z"
)

const (
	A = iota
	B
	C, D = 1 << 2, "s"
)

var (
	x, y = 1, func() int { return 2 }()
	m    = map[string][]struct{ A, B int }{"a": {{1, 2}, {A: 3}}}
	p    *T
	ch   chan<- int
)

type (
	F func(a int, b ...string) (int, error)
	S struct {
		io.Reader
		*T
		a, b int `json:"x"`
		f    func()
	}
	I interface {
		~int | ~string
		M() (x int)
		fmt.Stringer
	}
)

func (s *S) m() {
	if v, ok := x.(int); ok && v > 1 {
	} else if err := f(); err != nil {
		return
	} else {
	}
	for {
		break
	}
	for i, j := 0, 1; i < 3; i, j = i+1, j-1 {
	}
	for range ch {
	}
	for k := range m {
		_ = k
		continue
	}
	switch {
	case a > 1, b:
		fallthrough
	default:
	}
	select {
	case v := <-ch:
	case ch <- 1:
	default:
	}
	defer func() { recover() }()
	go s.m()
	a[1:2], b = c[:], -d
	x += ^y &^ z
	*p = &T{}
	var arr [3]int
	arr[0]++
	goto end
end:
	f(func(a int) {
		g()
	}, []int{1, 2}...)
	return
}

func G[K comparable, V any](m map[K]V) (r []K) { return nil }
"""],'python':[]}


@pytest.mark.parametrize("lang", ["go", "java", "ts"])
def test_wide_grammar_is_permitted(lang):
    base = "js" if lang == "ts" else lang
    pairs = syntax.permitted_pairs(lang)
    for text in SAMPLES[lang]:
        for line in syntax.statement_lines(text, lang):
            assert [line[i : i + 2] for i in range(1, len(line) - 1) if line[i : i + 2] not in pairs] == [], line
            assert not any(re.search(r, line) for r in syntax._FORBIDDEN[base]), line
