import pytest
from helpers import rows, values
from pyspark.sql import functions as F

from lodeline.functions import naming as N
from lodeline.operators import catalogue as C
from lodeline.sources import manifests as M
from lodeline.sources import memberdocs as D

LIB = ", mscorlib, Version=4.0.0.0, Culture=neutral, PublicKeyToken=b77a5c561934e089"
G = "System.Collections.Generic."


def test_type_names(spark):
    names = {
        "System.Int32": "int",
        "System.Void": "void",
        "": "void",
        None: "void",
        "Shop.Cart": "Cart",
        "Shop.Cart, Shop": "Cart",
        "Cart": "Cart",
        f"System.Nullable`1[[System.Int64{LIB}]]": "long?",
        f"System.Nullable`1[[Shop.Kind{LIB}]]": "Kind?",
        f"{G}List`1[[System.String{LIB}]]": "List<string>",
        f"{G}Dictionary`2[[System.String{LIB}],[Shop.Cart{LIB}]]": "Dictionary<string, Cart>",
        f"{G}Dictionary`2[[{G}List`1[[System.Int32{LIB}]]{LIB}],[System.Char{LIB}]]": "Dictionary<List<int>, char>",
        f"System.Func`3[[A.B{LIB}],[C.D{LIB}],[{G}List`1[[E{LIB}]]{LIB}]]": "Func<B, D, List<E>>",
        f"System.Threading.Tasks.Task`1[[{G}List`1[[{G}List`1[[{G}List`1[[System.Byte{LIB}]]{LIB}]]{LIB}]]{LIB}]]":
            "Task<List<List<List<byte>>>>",
        "System.Int32[]": "Int32[]",
        f"{G}List`1[[Shop.Cart[]{LIB}]]": "List<Cart[]>",
    }
    deep, short = f"System.Int32{LIB}", "int"
    for _ in range(10):
        deep, short = f"{G}Dictionary`2[[System.String{LIB}],[{deep}]]{LIB}", f"Dictionary<string, {short}>"
    names[deep.removesuffix(LIB)] = short
    got = values(spark, list(names), "n string", N.simplify_type_name(F.col("n")))
    assert dict(zip(names, got)) == names


def test_versions(spark):
    data = [
        ("a", "9.1.2"), ("a", "10.0.0"), ("a", "10.0.0-rc1"), ("a", "10.0.1-beta"), ("b", "1.0.0-a"), ("b", "1.0.0-a.1"),
        ("b", "1.0.0-a.b"), ("b", "1.0.0-2"), ("c", "1.0"), ("c", "1.0.0.1"), ("d", "2.0.0-rc.9"), ("d", "2.0.0-rc.10"),
    ]
    df = spark.createDataFrame(data, "package string, version string")
    # a package with prereleases only has no stable version
    assert rows(C.latest_version(df)) == [("a", "10.0.0"), ("c", "1.0.0.1")]
    assert rows(C.latest_version(df, True)) == [("a", "10.0.1-beta"), ("b", "1.0.0-a.b"), ("c", "1.0.0.1"), ("d", "2.0.0-rc.10")]


def test_frameworks(spark):
    df = spark.createDataFrame(
        [("a", "net8.0"), ("a", "net6.0"), ("a", "net48"), ("b", "net35"), ("b", "net48"), ("c", "netstandard2.0")],
        "package string, framework string",
    )
    assert rows(C.pick_framework(df)) == [("a", "net8.0"), ("b", "net35"), ("b", "net48"), ("c", "netstandard2.0")]
    assert rows(C.pick_framework(df, "net48")) == [("a", "net48"), ("b", "net48"), ("c", "netstandard2.0")]
    assert rows(C.pick_framework(df, "net6.0").where("package = 'a'")) == [("a", "net6.0")]


def test_alias_rows(spark):
    df = spark.createDataFrame([("a", "1.0", None)], "package string, version string, framework string")
    assert rows(C.publish_with_alias(df, pinned=True)) == [("a", "1.0", "net10.0", False)]
    assert [r[1] for r in rows(C.publish_with_alias(df, pinned=False))] == ["1.0", "latest"]


def test_dependencies_of_nearest_group(spark):
    deps = spark.createDataFrame(
        [("a", "net9.0", "x", "1"), ("a", "net6.0", "y", "2"), ("a", "", "z", "3"), ("b", "", "w", "4"), ("c", "net10.0", "v", "5")],
        "package string, framework string, dependency string, min_version string",
    )
    targets = spark.createDataFrame([(p, "net8.0") for p in "abc"], "package string, framework string")
    assert rows(C.direct_dependencies(deps, targets).select("package", "dependency", "version")) == [("a", "y", "2"), ("b", "w", "4")]


TYPES = [
    ("Shell", "Class", 0, 0, 0, 0, 0), ("Cart", "Class", 2, 14, 3, 0, 0), ("One", "Interface", 0, 1, 0, 0, 0),
    ("Kind", "Enum", 0, 0, 0, 5, 0), ("Opt", "Struct", 0, 0, 2, 0, 2), ("Bare", "Struct", 0, 0, 0, 0, 0), ("Call", "Delegate", 1, 0, 0, 0, 0),
]


def test_usable_types_and_hints(spark):
    df = spark.createDataFrame(
        TYPES, "type_name string, kind string, n_ctors int, n_methods int, n_props int, n_fields int, n_static int"
    )
    usable = C.usable_types(df)
    hint = C.type_hint(*[F.col(c) for c in ("kind", "n_ctors", "n_methods", "n_props", "n_fields", "n_static")])
    assert dict(rows(usable.select("type_name", hint))) == {
        "Cart": " [2 ctors, 14 methods, 3 props]", "One": " [1 method]", "Kind": " [5 values]", "Opt": " [2 options]", "Bare": "",
        "Call": " [1 ctor]",
    }
    assert rows(C.types_by_kind(df).select("kind_rank", "kind", "types")) == [
        (0, "Class", 1), (1, "Interface", 1), (2, "Enum", 1), (3, "Struct", 2), (4, "Delegate", 1),
    ]


def test_overloads(spark):
    df = spark.createDataFrame(
        [("T", "A", 2, 0, 0, "a2"), ("T", "A", 0, 1, 1, "a0g"), ("T", "A", 0, 0, 2, "a0"), ("T", "B", 1, 0, 3, "b1"), ("T", "C", 1, 0, 4, "c"), ("T", "C", 1, 0, 5, "d")],
        "type_name string, method string, n_params int, is_generic int, pos int, signature string",
    )
    assert rows(C.collapse_overloads(df, "type_name")) == [
        ("T", "A", "a0", 2, "// + 2 overloads"), ("T", "B", "b1", 0, ""), ("T", "C", "c", 1, "// + 1 overload"),
    ]
    assert rows(C.collapse_ctors(df, "type_name")) == [
        ("T", 0, "a0g", 1, "// + 1 overload"), ("T", 1, "b1", 2, "// + 2 overloads"), ("T", 2, "a2", 0, ""),
    ]
    assert [r.signature for r in C.expand_overloads(df, "T", "A").collect()] == ["a0g", "a0", "a2"]


def test_method_keys(spark):
    df = spark.createDataFrame([("f", "A", "M"), ("f", "B", "M"), ("f", "A", "N"), ("g", "A", "M")], "path string, class_name string, method_name string")
    assert sorted(r.method_key for r in C.method_keys(df, "path").collect()) == ["A::M", "B::M", "M", "N"]


def test_properties(spark):
    df = spark.createDataFrame(
        [("A", True, False), ("PATCH", True, False), ("B", False, False), ("C", True, True)], "name string, can_read boolean, is_static boolean"
    )
    assert [r.name for r in C.readable_props(df).collect()] == ["A", "C"]
    assert [r.name for r in C.readable_props(df, surface=True).collect()] == ["A"]


def test_inherited_properties(spark):
    types = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "Missing"), ("D", None)], "type_name string, base string")
    props = spark.createDataFrame(
        [("A", "x", "int"), ("B", "x", "long"), ("B", "y", "string"), ("C", "z", "bool"), ("Missing", "never", "int"), ("D", "d", "int")],
        "type_name string, name string, value_type string",
    )
    got = rows(C.inherited_properties(types, props))
    assert got == [
        ("A", "x", "int", "A", 0), ("A", "y", "string", "B", 1), ("A", "z", "bool", "C", 2), ("B", "x", "long", "B", 0),
        ("B", "y", "string", "B", 0), ("B", "z", "bool", "C", 1), ("C", "z", "bool", "C", 0), ("D", "d", "int", "D", 0),
    ]
    circle = spark.createDataFrame([("A", "B"), ("B", "A")], "type_name string, base string")
    assert C.ancestors(circle).count() == 4


def test_reflected_members(spark):
    data = [
        ("N", None, "T", "Run", True, False), ("N", "Outer", "T", "Run", True, False), ("N", None, "T", "ToString", True, False),
        ("N", None, "T", "get_X", True, True), ("N", None, "T", "Hidden", False, False), ("", None, "T", "Run", True, False),
    ]
    df = spark.createDataFrame(data, "namespace string, declaring_type string, type_name string, method string, is_public boolean, is_special boolean")
    assert rows(C.reflect_members(df).select("type_name", "method")) == [("Outer.T", "Run"), ("T", "Run")]


DOC = """<doc><members>
<member name="T:System.Task"><summary>A <see cref="T:System.Task"/> and <seealso href="http://x.y/z"/>
  with <paramref name="n"/>, <c>code</c> &lt;ok&gt; <see cref="P:A.B.C">text</see>.</summary></member>
<member name="M:A.B.Run(System.Int32)"><param name="n">first</param><param name="n"> second </param><typeparam name="T"/>
<exception cref="T:E">bad</exception><returns></returns></member>
<member name="P:A.B.Empty"><summary>  </summary></member>
<member name=""><summary>x</summary></member>
</members></doc>"""


@pytest.fixture(scope="module")
def docs(spark):
    files = spark.createDataFrame(
        [("p", "1.0", "lib/net/a.xml", DOC), ("p", "1.0", "lib/net/b.xml", DOC.replace("bad", "worse").replace("M:A", "M:a")),
         ("p", "1.0", "ref/a.xml", DOC), ("p", "latest", "Lib\\a.xml", DOC)],
        "package string, version string, path string, content string",
    )
    return D.scan_member_docs(files).cache()


def test_member_docs(docs):
    got = docs.where("path = 'lib/net/a.xml'").orderBy("pos").collect()
    assert [r.member_id for r in got] == ["T:System.Task", "M:A.B.Run(System.Int32)"]
    assert got[0].summary == "A Task and y/z with n, code <ok> C."
    assert (got[1].params, got[1].type_params, got[1].exceptions, got[1].returns) == ({"n": "second"}, {"T": ""}, {"T:E": "bad"}, None)
    assert docs.where("path like 'ref%'").isEmpty()


def test_first_file_wins(docs):
    entries = docs.where("version = '1.0'").select("member_id", F.element_at("exceptions", "T:E").alias("e"), "path")
    got = C.first_wins_merge(entries.select("member_id", F.coalesce("e", F.lit("")).alias("e"), "path"), ["member_id"], ["path"])
    assert rows(got.select("member_id", "e")) == [("M:A.B.Run(System.Int32)", "bad"), ("T:System.Task", "")]


def test_resolution(docs):
    one = docs.where("path = 'lib/net/a.xml'")
    ids = lambda df: [r.member_id for r in df.collect()]
    assert ids(C.resolve_docs(one, "run")) == ["M:A.B.Run(System.Int32)"]
    assert ids(C.resolve_docs(one, "b.RUN")) == ["M:A.B.Run(System.Int32)"]
    assert ids(C.resolve_docs(one, "X.Run")) == []
    assert ids(C.resolve_docs(one, "X.Run", "B")) == ["M:A.B.Run(System.Int32)"]
    assert ids(C.resolve_docs(one, "Task")) == ["T:System.Task"]


def test_docs_fall_back_to_latest(spark, docs):
    asked = spark.createDataFrame([("p", "1.0"), ("p", "9.9"), ("q", "1.0"), ("p", None)], "package string, version string")
    got = C.docs_for_member(docs, asked).select("version", "found_version").distinct()
    assert sorted(map(tuple, got.collect()), key=str) == [("1.0", "1.0"), ("9.9", "latest"), (None, "latest")]


def test_member_ids(spark):
    ids = ["M:A.B.C.Run(System.Int32)", "T:Task", "P:A.Name"]
    got = values(spark, ids, "m string", *N.member_id_parts(F.col("m")).values())
    assert got == [("M", "C", "Run"), ("T", "", "Task"), ("P", "A", "Name")]


def test_manifests(spark):
    one = '<Project Sdk="Web"><TargetFramework>net9.0</TargetFramework><PackageReference Include="A" Version="1" /><PackageReference Include="B"><X/></PackageReference><PackageReference Version="3"/></Project>'
    two = "<Project><TargetFrameworks>net8.0;net9.0</TargetFrameworks></Project>"
    files = spark.createDataFrame([("p", "a.csproj", one), ("p", "b.csproj", two), ("p", "c.csproj", "<Project/>")], "project string, path string, content string")
    got = sorted(map(tuple, M.scan_manifests(files).drop("project").collect()), key=str)
    assert got == [
        ("a.csproj", "Web", "net9.0", "A", "1"), ("a.csproj", "Web", "net9.0", "B", "Unknown"), ("a.csproj", "Web", "net9.0", "Unknown", "3"),
        ("b.csproj", "Unknown", "net8.0;net9.0", None, None), ("c.csproj", "Unknown", "Unknown", None, None),
    ]
    assert rows(M.package_usage(files).select("path", "packages")) == [("a.csproj", 3), ("b.csproj", 0), ("c.csproj", 0)]


def test_catalogue_search(spark):
    df = spark.createDataFrame([("Ring", "1"), ("SmallRing", "1"), ("Other", "1"), ("Rings", "2")], "package string, version string")
    assert [r.package for r in C.search_catalogue(df, "ring", 2).collect()] == ["Ring", "Rings"]
    for query, take in (("", 5), ("a", 0), ("a", 101)):
        with pytest.raises(ValueError):
            C.search_catalogue(df, query, take)
    assert values(spark, [" a, b,,c  d"], "t string", C.split_tags(F.col("t"))) == [["a", "b", "c", "d"]]


def test_cache_keys(spark):
    got = values(spark, ["a@1@n", "a@1", "a", ""], "k string", *N.split_cache_key(F.col("k")).values())
    assert got == [("a", "1", "n"), ("a", "1", "unknown"), ("a", "unknown", "unknown"), ("", "unknown", "unknown")]
    assert values(spark, [("a", "", None)], "p string, v string, f string", N.cache_key(F.col("p"), F.col("v"), F.col("f"))) == ["a@latest@net10.0"]


def test_signatures(spark):
    df = spark.sql(
        "select array(named_struct('type','int','name','a','default','1'), named_struct('type','T','name','b','default',cast(null as string))) p,"
        " array('public','static') m, array('IA','IB') i, cast(array() as array<string>) e"
    )
    got = df.select(
        N.method_signature(F.lit("void"), F.lit("Run"), F.col("p")), N.method_signature(F.lit("void"), F.lit("Run"), F.col("p"), defaults=False),
        N.declared_signature(F.col("m"), F.lit("void"), F.lit("Run"), F.col("p")),
        N.type_info(F.lit("B"), F.col("i")), N.type_info(F.lit(""), F.col("e")), N.type_info(F.lit("B"), F.col("i"), tiered=False),
    ).first()
    assert tuple(got) == (
        "void Run(int a = 1, T b)", "void Run(int a, T b)", "public static void Run(int a = 1, T b)",
        "Extends: B | Implements: IA, IB", "", "extends B, implements IA, IB",
    )
    got = values(spark, [(0, 0), (3, 3), (3, 5)], "a int, b int", N.line_label(F.col("a"), F.col("b")))
    assert got == ["", "// Line 3", "// Lines 3-5"]


def test_long_chains_and_circles_of_bases(spark):
    chain = [(f"T{i}", f"T{i - 1}") for i in range(1, 151)] + [("T0", "Unknown"), ("A", "B"), ("B", "C"), ("C", "A"), ("Self", "Self")]
    types = spark.createDataFrame(chain, "type_name string, base string")
    props = spark.createDataFrame([("T0", "Id", "int"), ("T75", "Id", "long"), ("A", "X", "int"), ("C", "X", "str"), ("Self", "Y", "int")], "type_name string, name string, value_type string")
    got = {(r.type_name, r.name): (r.value_type, r.declared_in, r.depth) for r in C.inherited_properties(types, props).collect()}
    assert got["T150", "Id"] == ("long", "T75", 75) and got["T74", "Id"] == ("int", "T0", 74)
    assert got["A", "X"] == ("int", "A", 0) and got["B", "X"] == ("str", "C", 1) and got["Self", "Y"] == ("int", "Self", 0)
