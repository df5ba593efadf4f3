"""Symbols of Rust and TypeScript: strings, comments, nesting and broken files."""

from __future__ import annotations

from hypothesis import given
from hypothesis import strategies as st

from mdlake.operators._lexer import code_of
from mdlake.operators.symbols import extract_file

RUST = '''//! Module
/* fn hidden() {
   /* nested */ fn hidden_too() {} */
const TEXT: &str = "fn in_string() { // no comment";
const RAW: &str = r#"
#[test]
fn in_raw() { "quoted" }
"#;
pub(crate) mod inner {
    /// TC-7
    #[tokio::test]
    #[ignore]
    async fn slow() {
        let c = '{';
        let s: &'static str = "}";
    }
    impl<T: Into<u8>> Shape for Square<T>
    where
        T: Copy,
    {
        fn area(&self, xs: [u8; 4]) -> u8 {
            0
        }
    }
    impl Square<u8> {
        pub const unsafe extern "C" fn side() {}
    }
    struct Unit;
}
trait Named {
    fn name(&self) -> String;
}
#[test] fn short() {}
'''

TYPESCRIPT = '''/**
 * TC-1 function none() {}
 */
export default class Shape {}
const text = `function inside() { ${"`" + `}`} {`
const pattern = /["'`{]/;
describe('all', () => {
  // TC-2
  it.each([1, 2])("it's {each}", ({ a }) => {
    expect(a).toBe("}");
  });
  test.todo('later');
  xit('off', () => {});
  it.concurrent.skip('skipped', () => expect(1));
  test.describe('nested', () => {
    test('deep', () => {});
  });
});
export async function run({ a }: Args): void {
  "test('no')";
}
'''


def _rows(path: str, language: str, source: str) -> list[tuple]:
    return [(s["qualified_name"], s["kind"], s["line"], s["end_line"], s["container"], s["ignored"]) for s in extract_file(path, language, source)]


def test_rust():
    assert _rows("a.rs", "rust", RUST) == [
        ("inner", "container", 9, 29, None, False),
        ("inner::slow", "test_function", 13, 16, "inner", True),
        ("inner::<Square<T> as Shape>::area", "function", 21, 23, "inner::<Square<T> as Shape>", False),
        ("inner::Square::side", "function", 26, 26, "inner::Square", False),
        ("inner::Unit", "container", 28, 28, "inner", False),
        ("Named", "container", 30, 32, None, False),
        ("Named::name", "function", 31, 31, "Named", False),
        ("short", "test_function", 33, 33, None, False),
    ]
    slow = extract_file("a.rs", "rust", RUST)[1]
    assert (slow["leading_line"], [(x["text"], x["line"]) for x in slow["marks"]]) == (10, [("/// TC-7", 10), ("#[tokio::test]", 11), ("#[ignore]", 12)])


def test_typescript():
    assert _rows("src/a.ts", "typescript", TYPESCRIPT) == [
        ("a.ts", "container", 1, 22, None, False),
        ("Shape", "container", 4, 4, None, False),
        ("all", "container", 7, 18, None, False),
        ("it's {each}", "test_function", 9, 11, "all", False),
        ("later", "test_function", 12, 12, "all", False),
        ("off", "test_function", 13, 13, "all", True),
        ("skipped", "test_function", 14, 14, "all", True),
        ("nested", "container", 15, 17, "all", False),
        ("deep", "test_function", 16, 16, "nested", False),
        ("run", "function", 19, 21, None, False),
    ]
    assert [x["text"] for x in extract_file("a.ts", "typescript", TYPESCRIPT)[3]["marks"]] == ["// TC-2"]


def test_broken_files():
    assert _rows("a.rs", "rust", "fn open() {\n    if x {\n") == [("open", "function", 1, 2, None, False)]
    assert _rows("a.rs", "rust", "}}}\nfn after() {}\n") == [("after", "function", 2, 2, None, False)]
    assert _rows("a.rs", "rust", 'const X: &str = "never closed\nfn lost() {}\n') == []
    assert _rows("a.rs", "rust", "/* never closed\nfn lost() {}\n") == []
    assert _rows("a.ts", "typescript", "const x = 'never closed\nfunction found() {}\n")[1:] == [("found", "function", 2, 2, None, False)]
    assert _rows("a.rs", "rust", "") == []
    deep = "mod m {" * 5000
    assert len(_rows("a.rs", "rust", "\n".join(["mod m {"] * 300))) == 300 and _rows("a.rs", "rust", deep)


@given(st.sampled_from(["rust", "typescript"]), st.text(alphabet="fn mod(){}[]<>;:'\"`$/*\\r#\n testim=", max_size=80))
def test_any_text(language, source):
    code, strings = code_of(language, source)
    assert len(code) == len(source) and [c == "\n" for c in code] == [c == "\n" for c in source]
    assert all(a < b for a, b in strings) and all(x[1] <= y[0] for x, y in zip(strings, strings[1:]))
    for s in extract_file("a", language, source):
        assert 1 <= s["leading_line"] <= s["line"] <= s["end_line"] <= source.count("\n") + 1
