import pytest
from helpers import rows, values
from pyspark.sql import functions as F

from lodeline.operators import inventory as I
from lodeline.operators import structure as S

SOURCE = '''using System;
using static System.Math;
using Alias = My.Other.Name;
using System;
namespace Shop.Core;

[Serializable]
[Table("a, b", Schema = "dbo", Order = 2), Obsolete]
public sealed class Cart<T> : Base<int>, IStore<T>, IThing where T : new()
{
    private readonly int _a, _b = 2;
    [Inject]
    protected static string Name = "x";
    private Cart() { }
    public Cart(IStore<T> store, [From] ref Dictionary<string, int> map, int n = 3)
        : base(n)
    {
        Init(store);
    }
    public Cart(int other) { }
    public int Total { get; private set; }
    public string Title => Name;
    [Key]
    public List<int> Items
    {
        get { return _items; }
        set { _items = value; }
    }
    [HttpGet("x/{id}")]
    public async Task<int> Add(int qty, string unit = "a,b")
    {
        var x = new Thing(1);
        if (qty > 0)
        {
            this._svc.Check(qty);
            base.Run();
            await a.b.Go(Inner(qty)).Then();
        }
        return x?.Skip();
    }
    int Add(long q) => Add((int)q);
    public abstract void Clear();
}
internal interface IThing : IOne, ITwo<int>
{
    [Ignored]
    int Count(List<int> items);
    string Label { get; }
}
public class Plain : IStore
{
    public void Clear() { }
}
public struct NotSeen { }
'''


@pytest.fixture(scope="module")
def files(spark):
    data = [("p", "a.cs", SOURCE), ("p", "b.cs", SOURCE.replace("\n", "\r\n")), ("p", "c.cs", ""), ("p", "d.cs", "var x = 1;")]
    return spark.createDataFrame(data, "project string, path string, content string")


def of(df, path="a.cs"):
    return df.where(F.col("path") == path).drop("project", "path")


def test_types(files):
    got = of(S.extract_types(files)).select(
        "type_name", "kind", F.array_join("modifiers", " "), "base", F.array_join("interfaces", ";"), "line"
    )
    assert sorted(got.collect(), key=lambda r: r.line) == [
        ("Cart", "class", "public sealed", "Base<int>", "IStore<T>;IThing", 7),
        ("IThing", "interface", "internal", None, "IOne;ITwo<int>", 44),
        # a leading plain interface is base and interface
        ("Plain", "class", "public", "IStore", "IStore", 50),
    ]


def test_methods(files):
    got = of(S.extract_methods(files)).select(
        "type_name", "name", "returns", F.array_join("modifiers", " "),
        F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["type"], p["name"], p["default"])), ";"),
        "line_start", "line_end",
    )
    assert sorted(map(tuple, got.collect()), key=lambda r: r[5]) == [
        ("Cart", "Add", "Task<int>", "public async", 'int:qty;string:unit:"a,b"', 29, 40),
        ("Cart", "Add", "int", "", "long:q", 41, 41),
        ("Cart", "Clear", "void", "public abstract", "", 42, 42),
        ("IThing", "Count", "int", "public", "List<int>:items", 46, 47),
        ("Plain", "Clear", "void", "public", "", 52, 52),
    ]


def test_properties(files):
    got = of(S.extract_properties(files)).select(
        "type_name", "name", "value_type", "has_getter", "has_setter", "line_start", "line_end"
    )
    assert sorted(map(tuple, got.collect()), key=lambda r: r[5]) == [
        ("Cart", "Total", "int", True, True, 21, 21),
        ("Cart", "Title", "string", False, False, 22, 22),
        ("Cart", "Items", "List<int>", True, True, 23, 28),
        ("IThing", "Label", "string", True, False, 48, 48),
    ]


def test_fields(files):
    got = of(S.extract_fields(files)).select("name", "value_type", "is_readonly", "is_static", "is_const", "line_start")
    assert sorted(map(tuple, got.collect())) == [
        ("Name", "string", False, True, False, 12), ("_a", "int", True, False, False, 11), ("_b", "int", True, False, False, 11),
    ]


def test_attributes(files):
    got = of(S.extract_attributes(files)).select("type_name", "parent_member", "name", "args", "line").collect()
    assert {(r.type_name, r.parent_member, r.name, r.line): r.args for r in got} == {
        ("Cart", None, "Serializable", 7): {},
        ("Cart", None, "Table", 7): {"arg0": "a, b", "Schema": "dbo", "Order": "2"},
        ("Cart", None, "Obsolete", 7): {},
        ("Cart", "Name", "Inject", 12): {},
        ("Cart", "Items", "Key", 23): {},
        ("Cart", "Add", "HttpGet", 29): {"arg0": "x/{id}"},
    }


def test_first_public_constructor(files):
    got = of(S.extract_ctor_params(files)).select("pos", "type", "name", "default")
    assert rows(got) == [(0, "IStore<T>", "store", None), (1, "Dictionary<string, int>", "map", None), (2, "int", "n", "3")]


def test_imports(files):
    got = S.extract_imports(files).where("path in ('a.cs', 'c.cs')").orderBy("path").collect()
    assert [(r.namespace, r.usings) for r in got] == [("Shop.Core", ["System", "System.Math", "My.Other.Name"]), ("", [])]


def test_bodies(files):
    got = {r.key: r for r in of(S.extract_bodies(files)).collect()}
    assert sorted(got) == ["Cart::Add::29", "Cart::Add::41", "Cart::Clear::42", "IThing::Count::46", "Plain::Clear::52"]
    add = got["Cart::Add::29"]
    assert add.is_async and not add.is_static
    assert add.full_code.split("\n") == SOURCE.split("\n")[28:40]
    assert add.body.split("\n") == SOURCE.split("\n")[31:40]
    assert got["Cart::Clear::42"].body == ""


def test_call_sites(files):
    calls = of(S.extract_call_sites(files)).withColumn("to", S.resolve_receiver(F.col("receiver")))
    assert rows(calls.select("line", "callee_method", "to")) == [
        (35, "Check", "SameClass"), (36, "Run", "BaseClass"), (37, "Go", "a"), (37, "Inner", "SameClass"), (37, "Then", "Unknown"),
        (41, "Add", "SameClass"),
    ]


def test_receivers(spark):
    texts = ["", "this", "base", "this._svc.X", "a.b.c", "System.IO.File", None]
    assert values(spark, texts, "r string", S.resolve_receiver(F.col("r"))) == [
        "SameClass", "SameClass", "BaseClass", "SameClass", "a", "System", "Unknown",
    ]


def test_line_ends_do_not_matter(files):
    for extract in (S.extract_types, S.extract_methods, S.extract_fields, S.extract_call_sites, S.extract_properties):
        frame = extract(files)
        assert rows(of(frame, "a.cs")) == rows(of(frame, "b.cs")) if "modifiers" not in frame.columns else (
            of(frame, "a.cs").exceptAll(of(frame, "b.cs")).isEmpty()
        )
        assert of(frame, "c.cs").isEmpty() and of(frame, "d.cs").isEmpty()


def test_visibility(files):
    methods = S.extract_methods(files)
    assert of(S.visibility_view(methods)).count() == 4
    assert of(S.visibility_view(methods, include_private=True)).count() == 5


def test_member_index_holds_every_kind(files):
    got = of(S.member_index(files)).groupBy("member_type").count()
    assert dict(rows(got)) == {"Class": 3, "Interface": 5, "Method": 5, "Property": 4, "Field": 3, "Attribute": 6}


def test_file_index(files):
    got = I.file_index(S.extract_types(files), S.extract_methods(files)).where("path = 'a.cs'")
    assert rows(got) == [("p", "a.cs", 3, 5)]


def test_markup(spark):
    html = '<p class="a" id="b"><a href="/x">x</a><A href="/y" rel="n">y</a><br></p>'
    pages = spark.createDataFrame([("h", "p", html)], "project string, path string, content string")
    assert rows(S.page_tags(pages).select("tag_no", "tag")) == [(1, "p"), (2, "a"), (3, "a"), (4, "br")]
    assert rows(S.tag_attributes(pages).select("tag_no", "name", "value")) == [
        (1, "class", "a"), (1, "id", "b"), (2, "href", "/x"), (3, "href", "/y"), (3, "rel", "n"),
    ]
    assert rows(S.page_links(pages).select("target")) == [("/x",)]


LAYOUTS = '''namespace A {
  [Obsolete] public class Outer : Base, IThing<List<int>, string> {
    [Key, Column("x, {y}")] private int _x = 1, _y;
    private int[] _a = { 1, 2 };
    private Point _p = new Point { X = 1, Y = 2 };
    public Dictionary<string, List<int>> Map { get; init; } = new();
    // class Hidden { void No() { } }
    /* public int Gone;
       public void Gone2() { } */
    public class Inner
    {
      public void In() { Deep(); }
    }
    public string Odd = "class Fake { public int Z; }";
    [HttpGet("a"), Authorize(Roles = "x")] public async Task<Dictionary<string, int>> After(
        [FromBody] List<int> items,
        string text = "a, (b)",
        int n = 3
    )
        {
      var r = recv.Make<List<int>>(items).Run();
      Bare<int>();
      foreach (var i in items) { if (i > 0) { this._p.Move(i); } }
            }
    public Outer(
        IStore<int> store,
        string name)
        : base(name) { Init(); }
    public int Sum => Add(1, 2);
    public void One() { A(); } public int Two { get { return B(); } }
  }
  struct S { public void NotSeen() { } }
}
'''


@pytest.fixture(scope="module")
def layouts(spark):
    return spark.createDataFrame([("p", "l.cs", LAYOUTS)], "project string, path string, content string")


def test_layouts(layouts):
    members = {
        (r.what, n): (r.type_name, " ".join(r.modifiers), r.line_start, r.line_end)
        for r in S.members(layouts).collect() for n in r.names
    }
    assert members == {
        ("Class", "Outer"): ("Outer", "public", 2, 31), ("Class", "Inner"): ("Inner", "public", 10, 13),
        ("Field", "_x"): ("Outer", "private", 3, 3), ("Field", "_y"): ("Outer", "private", 3, 3),
        ("Field", "_a"): ("Outer", "private", 4, 4), ("Field", "_p"): ("Outer", "private", 5, 5),
        ("Property", "Map"): ("Outer", "public", 6, 6), ("Method", "In"): ("Inner", "public", 12, 12),
        ("Field", "Odd"): ("Outer", "public", 14, 14), ("Method", "After"): ("Outer", "public async", 15, 24),
        ("Ctor", "Outer"): ("Outer", "public", 25, 28), ("Property", "Sum"): ("Outer", "public", 29, 29),
        ("Method", "One"): ("Outer", "public", 30, 30), ("Property", "Two"): ("Outer", "public", 30, 30),
    }
    after = S.extract_methods(layouts).where("name = 'After'").first()
    assert after.returns == "Task<Dictionary<string, int>>"
    assert [tuple(p) for p in after.params] == [("List<int>", "items", None), ("string", "text", '"a, (b)"'), ("int", "n", "3")]
    attributes = {(r.parent_member, r.name): r.args for r in S.extract_attributes(layouts).collect()}
    assert attributes == {
        (None, "Obsolete"): {}, ("_x", "Key"): {}, ("_y", "Key"): {}, ("_x", "Column"): {"arg0": "x, {y}"},
        ("_y", "Column"): {"arg0": "x, {y}"}, ("After", "HttpGet"): {"arg0": "a"}, ("After", "Authorize"): {"Roles": "x"},
    }
    types = {r.type_name: (r.base, r.interfaces) for r in S.extract_types(layouts).collect()}
    assert types == {"Outer": ("Base", ["IThing<List<int>, string>"]), "Inner": (None, [])}
    assert [(r.type, r.name) for r in S.extract_ctor_params(layouts).orderBy("pos").collect()] == [("IStore<int>", "store"), ("string", "name")]
    calls = S.extract_call_sites(layouts).withColumn("to", S.resolve_receiver(F.col("receiver")))
    assert rows(calls.select("line", "caller_method", "callee_method", "to")) == [
        (12, "In", "Deep", "SameClass"), (21, "After", "Make", "recv"), (21, "After", "Run", "Unknown"),
        (23, "After", "Move", "SameClass"), (30, "One", "A", "SameClass"),
    ]


def test_texts_with_marks_of_their_own_and_long_lines(spark):
    import time

    strings = ", ".join(f'"s, {{{i}}}"' for i in range(20_000))
    long_line = f"class A {{\n  string[] _all = new[] {{ {strings} }};\n  object _o = Make({', '.join(f'F({i})' for i in range(20_000))});\n  void M() {{ B(); }}\n}}\n"
    odd = "class A {\n" + "".join(f"  public void M{i}(int a)\n  {{\n    Call{i}(a);\n      }}\n" for i in range(40_000)) + "}\n"
    marked = "class A {\n  string _s = \"﷐﷑﷒﷯\";\n  void M﷓() { }\n  void N() { B(); }\n}\n"
    for text, names in ((long_line, ["M", "_all", "_o"]), (marked, ["N", "_s"])):
        frame = spark.createDataFrame([("p", "x.cs", text)], "project string, path string, content string")
        start = time.time()
        assert sorted(n for r in S.members(frame).where("what <> 'Class'").collect() for n in r.names) == names
        assert time.time() - start < 60
    frame = spark.createDataFrame([("p", "x.cs", odd)], "project string, path string, content string")
    start = time.time()
    assert S.extract_methods(frame).where("line_end = line_start + 3").count() == 40_000
    assert len(odd) > 2_000_000 and time.time() - start < 60
