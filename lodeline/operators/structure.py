"""Structure of source text and markup.

Source text is cut into statements: strings and comments are hidden first, then
the text ends a statement at every ``{``, ``}`` and ``;``. A statement is a row,
and how deep it stands is a running sum over the rows of its file, so a block
belongs to what opened it and ends where its depth is reached again, however the
text is laid out. What is a type or a member is read from a statement alone, with
all its brackets hidden, so a pattern sees words and needs no look beyond them.
The work grows with the text: nothing is searched twice, and no search runs on.

Types are classes and interfaces; the owner of a member is the type whose block
it stands in. Text that is no source gives no rows. In one declaration, variables
behind a block (``a = { 1 }, b = { 2 }``) are not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.text import captures

# Words that may stand before a declaration, and words that begin a statement.
MODIFIERS = (
    "public|private|protected|internal|static|virtual|override|abstract|async|sealed|partial"
    "|readonly|const|new|extern|unsafe|required|volatile"
)
STATEMENT_WORDS = (
    "return|await|throw|else|if|while|for|foreach|switch|using|lock|catch|case|yield|goto|in|is|as"
    "|out|ref|var|class|interface|namespace|struct|enum|record|event|delegate|get|set|init|add|remove|where|operator"
)

# Unicode keeps the noncharacters from U+FDD0 on free for internal use. Characters
# that mean something to a pattern are put there: inside strings, and inside brackets.
_MEANT = " ,=<>()[]{};:"
_QUOTES = "\"'"
_FREE = [chr(c) for c in range(0xFDD0, 0xFDF0)]
_IN_STRING = "".join(_FREE[: len(_MEANT) + len(_QUOTES)])
_IN_BRACKETS = "".join(_FREE[len(_IN_STRING) : len(_IN_STRING) + len(_MEANT)])
_EDGE = _FREE[-1]
_LT, _GT, _PAR, _END_PAR, _SQ, _END_SQ = (_IN_BRACKETS[_MEANT.index(c)] for c in "<>()[]")

_STRING = (
    r'"{3}(?s:.*?)"{3}|(?:@\$?|\$@)"[^"]*+(?:""[^"]*+)*+"|\$?"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|'(?:[^'\\\n]|\\[^\n][^'\n]*+)'"
)
_COMMENT = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_ARRAY_VALUES = r"(?<=\[\])\s*+\{[^{};()]*+\}"

_MODS = rf"((?:(?:{MODIFIERS}) )*+)"
_TYPE = rf"((?!(?:{STATEMENT_WORDS}|{MODIFIERS})\b)[\w@{_PAR}][^ ]*+)"
_PARAMS = rf"{_PAR}([^ :;{{=]*){_END_PAR}"
_TAIL = r"(?: ?=>.*| where .*)?$"
ATTRIBUTES = rf"^((?:{_SQ}[^ ]*{_END_SQ} ?)*)"
TYPE_HEAD = rf"^{_MODS}(class|interface) (\w+)[^ :]*(?: {_PAR}[^ ]*)?(?: ?: ?((?:(?! where ).)*+))?(?: where .*)?$"
METHOD = rf"^{_MODS}{_TYPE} (?:[\w.]+\.)?(\w+)(?:{_LT}[^ ]*?{_GT})? ?{_PARAMS}{_TAIL}"
CTOR = rf"^{_MODS}(\w+) ?{_PARAMS}(?: ?: ?(?:base|this) ?{_PAR}.*)?(?: ?=>.*)?$"
PROPERTY = rf"^{_MODS}{_TYPE} (?:[\w.]+\.)?(\w+)(?: ?=>.*)?$"
FIELD = rf"^{_MODS}{_TYPE} (\w+(?: ?=(?!>).*| ?,.*)?)$"


def _hide(text: Column, pattern: str, change) -> Column:
    """``change`` applied to every match of a pattern, in one pass."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{_EDGE}$0{_EDGE}"), _EDGE)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, change(p)).otherwise(p)), "")


def _shown(text: Column) -> Column:
    """Text with everything hidden put back."""
    return F.translate(text, _IN_STRING + _IN_BRACKETS, _MEANT + _QUOTES + _MEANT)


def _opened(text: Column) -> Column:
    """Text with its brackets put back; strings stay hidden."""
    return F.translate(text, _IN_BRACKETS, _MEANT)


def _nesting(text: Column) -> Column:
    """How deep the brackets of a text go, at most."""
    step = lambda acc, c: F.when(
        F.instr(F.lit("<([{"), c) > 0,
        F.struct((acc["now"] + 1).alias("now"), F.greatest(acc["most"], acc["now"] + 1).alias("most")),
    ).otherwise(F.struct(F.greatest(acc["now"] - 1, F.lit(0)).alias("now"), acc["most"].alias("most")))
    brackets = F.split(F.regexp_replace(text, r"[^<>()\[\]{}]++", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.filter(brackets, lambda c: c != ""), start, step)["most"]


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _closed(text: Column) -> Column:
    """Text with all that stands in brackets hidden, from the innermost outwards."""
    inner = r"<[^<>()\[\]{}]*+>|\([^()\[\]{}]*+\)|\[[^()\[\]{}]*+\]|\{[^()\[\]{}]*+\}"

    def close(whole: Column) -> Column:
        opens = F.length(whole) - F.length(F.translate(whole, "<([{", ""))
        rounds = F.when(opens <= 3, opens).otherwise(_nesting(whole))
        step = lambda acc, _: _hide(acc, inner, lambda p: F.translate(p, _MEANT, _IN_BRACKETS))
        return F.when(opens > 0, F.aggregate(F.sequence(F.lit(1), rounds), whole, step)).otherwise(whole)

    return _once(text, close)


def _commas(text: Column) -> Column:
    """Parts between commas that are not inside brackets or strings."""
    parts = F.transform(F.split(_closed(text), ","), lambda p: F.trim(_opened(p)))
    return F.filter(parts, lambda p: p != "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def statements(files: DataFrame) -> DataFrame:
    """``project, path, pos, text, line, last_line, depth, ends`` of every statement.

    ``depth`` counts the blocks around it, ``ends`` is the mark it ends with;
    strings are hidden and comments gone.
    """
    content = F.replace(F.translate("content", "".join(_FREE), "\ufffd" * len(_FREE)), F.lit("\r\n"), F.lit("\n"))

    def change(piece: Column) -> Column:
        return F.when(F.startswith(piece, F.lit("/")), F.regexp_replace(piece, r"[^\n]++", "")).otherwise(
            F.translate(piece, _MEANT + _QUOTES, _IN_STRING)
        )

    plain = F.regexp_replace(_hide(content, f"{_COMMENT}|{_STRING}|{_ARRAY_VALUES}", change), r"(?m)^[ \t]*+#[^\n]*+", "")
    marked = F.split(F.regexp_replace(plain, "[{};]", f"$0{_EDGE}"), _EDGE)
    # The files are dealt out whole, before they are taken apart; all windows then stay where they are.
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # In the order of their keys there, so that the windows sort rows that are in order but for the places in a file.
    dealt = files.select("project", "path", "content").repartition(parts, "project", "path").sortWithinPartitions("project", "path")
    rows = dealt.select("project", "path", F.posexplode(marked).alias("pos", "text"))
    change_of_depth = F.when(F.col("ends") == "{", 1).when(F.col("ends") == "}", -1).otherwise(0)
    before = Window.partitionBy("project", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ends", F.right("text", F.lit(1))).withColumns(
        {
            "depth": F.coalesce(F.sum(change_of_depth).over(before), F.lit(0)),
            "_line": F.coalesce(F.sum(_newlines(F.col("text"))).over(before), F.lit(0)) + 1,
        }
    )
    lead = _newlines(F.regexp_extract("text", r"^\s*+", 0))
    return rows.withColumns(
        {"line": (F.col("_line") + lead).cast("int"), "last_line": (F.col("_line") + _newlines(F.col("text"))).cast("int")}
    ).drop("_line")


def _read_heads(rows: DataFrame) -> DataFrame:
    """Add ``head``, the statement as words with its brackets hidden, ``attributes``, and what a type head says."""
    flat = F.trim(F.regexp_replace(F.regexp_replace("text", r"[{};]$", ""), r"\s++", " "))
    rows = rows.withColumn("_closed", _closed(flat))
    rows = rows.withColumn("attributes", F.regexp_extract("_closed", ATTRIBUTES, 1))
    return rows.withColumn("head", F.ltrim(F.substring(F.col("_closed"), F.length("attributes") + 1, F.length("_closed")))).drop("_closed")


def declarations(files: DataFrame) -> DataFrame:
    """Every type and every statement that stands directly in one.

    ``owner`` (name, kind) is the type around it; ``type`` (name, kind, modifiers,
    bases) is set for types. ``block_line`` and ``block_pos`` tell where its own
    block ends, ``has_get`` and ``has_set`` what stands in that block.
    """
    rows = statements(files)
    maybe = (F.col("ends") != "}") & F.rlike("text", F.lit(r"\b(?:class|interface)\s"))
    typed = _read_heads(rows.withColumn("_all", F.col("text")).withColumn("text", F.when(maybe, F.col("text"))))
    part = lambda i: F.regexp_extract("head", TYPE_HEAD, i)
    found = F.struct(
        part(3).alias("name"), part(2).alias("kind"), _words(part(1)).alias("modifiers"), _commas(_opened(part(4))).alias("bases")
    )
    is_type = F.rlike("head", F.lit(TYPE_HEAD))
    rows = typed.withColumn("type", F.when(is_type, found)).withColumn("text", F.col("_all")).drop("_all", "head", "attributes")

    # A statement stands in the block opened one level up; one that opens a block also opens a level.
    opens, closes = F.col("ends") == "{", F.col("ends") == "}"
    inside = F.struct((F.col("depth") - 1).alias("level"), F.lit(False).alias("opening"))
    opening = F.struct(F.col("depth").alias("level"), F.lit(True).alias("opening"))
    placed = rows.select("*", F.explode(F.when(opens, F.array(inside, opening)).otherwise(F.array(inside))).alias("_at"))
    placed = placed.select("*", "_at.level", "_at.opening").drop("_at")
    accessor = lambda word: F.rlike("text", F.lit(rf"^\s*+(?:\w+ )*{word}\s*+(?:[;{{]|=>)"))
    count = lambda word: F.when(~F.col("opening") & accessor(word), 1).otherwise(0)
    level = Window.partitionBy("project", "path", "level").orderBy("pos", "opening")
    sofar = level.rowsBetween(Window.unboundedPreceding, 0)
    around = F.last(F.when(F.col("opening"), F.struct("type.name", "type.kind")), ignorenulls=True).over(sofar)
    placed = placed.withColumns(
        {
            "owner": F.when(~F.col("opening"), around),
            "_gets": F.sum(count("get")).over(sofar), "_sets": F.sum(count("set")).over(sofar),
            "_edge": F.col("opening") | (closes & ~F.col("opening")),
        }
    )
    # Among the marks of one level, the one after an opening mark closes it.
    edges = Window.partitionBy("project", "path", "level", "_edge").orderBy("pos", "opening")
    closing = lambda c: F.when(F.col("opening"), F.lead(c).over(edges))
    placed = placed.withColumns(
        {
            "_block_line": closing("last_line"), "_block_pos": closing("pos"),
            "_has_get": closing("_gets") > F.col("_gets"), "_has_set": closing("_sets") > F.col("_sets"),
        }
    )
    own = F.when(~F.col("opening"), F.struct("text", "line", "last_line", "ends", "type", "owner"))
    whole = placed.groupBy("project", "path", "pos").agg(
        F.first(own, ignorenulls=True).alias("s"),
        *[F.max(f"_{c}").alias(c) for c in ("block_line", "block_pos", "has_get", "has_set")],
    )
    whole = whole.select("project", "path", "pos", "s.*", "block_line", "block_pos", "has_get", "has_set")
    wanted = F.col("type").isNotNull() | (F.col("owner.name").isNotNull() & ~F.col("ends").isin("}", ""))
    return _read_heads(whole.where(wanted))


def members(files: DataFrame) -> DataFrame:
    """Types and members: ``what`` they are, their names and the parts of their heads.

    ``what`` is Class (interfaces too), Method, Ctor, Property or Field;
    ``type_name`` and ``kind`` are the type itself or the owner, ``name`` the
    first or only name, ``rest`` the parameters or the variables.
    """
    # What is asked of the rows later is a filter on the column that ``explode`` gives, so no pattern runs again in it.
    rows = declarations(files).select("*", F.explode(F.array(_parsed())).alias("_read")).where("size(_read) > 1")
    part = lambda i: F.get("_read", F.lit(i))
    rows = rows.select(
        "*", part(0).alias("what"), _words(part(1)).alias("_modifiers"), _opened(part(2)).alias("value_type"), _opened(part(4)).alias("rest")
    )
    is_type = F.col("what") == "Class"
    variables = F.transform(_commas(F.col("rest")), lambda v: F.regexp_extract(v, r"^(\w+)", 1))
    names = F.when(is_type, F.array("type.name")).when(F.col("what") == "Field", variables).otherwise(F.array(part(3)))
    return rows.select(
        "project", "path", "pos", "what",
        F.coalesce("type.name", "owner.name").alias("type_name"), F.coalesce("type.kind", "owner.kind").alias("kind"),
        F.when(is_type, F.col("type.modifiers")).when(F.col("owner.kind") == "interface", F.array(F.lit("public")))
        .otherwise(F.col("_modifiers")).alias("modifiers"),
        F.col("type.bases").alias("bases"), names.alias("names"), "value_type", "rest",
        F.col("line").alias("line_start"), F.coalesce("block_line", "last_line").alias("line_end"),
        F.coalesce("block_pos", "pos").alias("last_pos"), F.coalesce("has_get", F.lit(False)).alias("has_getter"),
        F.coalesce("has_set", F.lit(False)).alias("has_setter"), "attributes",
    )


def _parsed() -> Column:
    """What a declaration is, its modifiers, type, name and rest; one element if it is none of these.

    Each pattern runs at most once, and only where those before it did not match.
    """
    head, ends = F.col("head"), F.col("ends")
    row = lambda pattern, what, *groups: F.regexp_replace(head, pattern, _EDGE.join([what, *groups]))
    matched = lambda text: F.contains(text, F.lit(_EDGE))
    none = F.lit("")

    def field() -> Column:
        initialised = F.rlike(head, F.lit(r"^[^=]*=(?!>)"))
        able = (F.col("owner.kind") == "class") & ((ends == ";") | initialised)
        return F.when(able, row(FIELD, "Field", "$1", "$2", "", "$3")).otherwise(none)

    def accessible() -> Column:
        able = (ends == "{") | F.contains(head, F.lit("=>"))
        found = F.when(able, row(PROPERTY, "Property", "$1", "$2", "$3", "")).otherwise(none)
        return _once(found, lambda t: F.when(matched(t), t).otherwise(field()))

    def callable_() -> Column:
        method = _once(row(METHOD, "Method", "$1", "$2", "$3", "$4"), lambda t: F.when(matched(t), t).otherwise(accessible()))
        own = lambda t: matched(t) & (F.split_part(t, F.lit(_EDGE), F.lit(4)) == F.col("owner.name"))
        return _once(row(CTOR, "Ctor", "$1", "", "$2", "$3"), lambda t: F.when(own(t), t).otherwise(method))

    has_brackets = F.contains(head, F.lit(_PAR))
    text = F.when(has_brackets, callable_()).otherwise(accessible())
    is_type = F.col("type").isNotNull()
    return F.split(F.when(is_type, F.lit(_EDGE.join(["Class", "", "", "", ""]))).otherwise(text), _EDGE)


def _base(bases: Column, kind: Column) -> Column:
    generic = lambda b: F.rlike(b, F.lit(r"^I\w*<"))
    return F.when(kind == "class", F.try_element_at(F.filter(bases, lambda b: ~generic(b)), F.lit(1)))


def _interfaces(bases: Column, kind: Column) -> Column:
    listed = F.filter(bases, lambda b: F.rlike(b, F.lit(r"^I\w*$")) | F.rlike(b, F.lit(r"^I\w*<")))
    return F.when(kind == "class", listed).otherwise(bases)


def extract_types(files: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Classes and interfaces with modifiers, base, interfaces and first line.

    A leading plain name such as ``IStore`` counts as base and as interface.
    ``read`` are the members of the files, where they have been read before.
    """
    bases, kind = F.col("bases"), F.col("kind")
    return _members_of(files, read).where("what = 'Class'").select(
        "project", "path", "type_name", "kind", "modifiers", _base(bases, kind).alias("base"),
        _interfaces(bases, kind).alias("interfaces"), F.col("line_start").alias("line"),
    )


def _members_of(files: DataFrame, read: DataFrame | None) -> DataFrame:
    return members(files) if read is None else read


def _parameters(text: Column) -> Column:
    """Array of (type, name, default) from the text between parentheses."""
    shape = r"^(?:\[[^\]]*\]\s*)*(?:(?:this|ref|out|in|params|scoped|readonly)\s+)*(.+?)\s+(\w+)(?:\s*=\s*(.*))?$"
    return F.transform(
        _commas(text),
        lambda p: F.struct(
            F.regexp_extract(p, shape, 1).alias("type"),
            F.regexp_extract(p, shape, 2).alias("name"),
            F.nullif(_shown(F.regexp_extract(p, shape, 3)), F.lit("")).alias("default"),
        ),
    )


def extract_methods(files: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Methods with return type, parameters, modifiers and line span; ``read`` as in ``extract_types``."""
    return _members_of(files, read).where("what = 'Method'").select(
        "project", "path", "type_name", F.get("names", F.lit(0)).alias("name"), F.col("value_type").alias("returns"), "modifiers",
        _parameters(F.col("rest")).alias("params"), "line_start", "line_end",
    )


def extract_properties(files: DataFrame) -> DataFrame:
    """Properties with accessor flags; expression-bodied ones have neither."""
    return members(files).where("what = 'Property'").select(
        "project", "path", "type_name", F.get("names", F.lit(0)).alias("name"), "value_type", "modifiers",
        "has_getter", "has_setter", "line_start", "line_end",
    )


def extract_fields(files: DataFrame) -> DataFrame:
    """One row per declared variable. Interfaces have no fields."""
    is_a = lambda word: F.array_contains("modifiers", word).alias(f"is_{word}")
    return members(files).where("what = 'Field'").select(
        "project", "path", "type_name", "value_type", "modifiers", "line_start", "line_end", F.explode("names").alias("name"),
        is_a("readonly"), is_a("static"), is_a("const"),
    )


def _attribute_texts(attributes: Column) -> Column:
    """Attributes in front of a declaration, each as its own text with strings hidden."""
    lists = F.regexp_extract_all(_opened(attributes), F.lit(r"\[((?:[^\[\]]++|\[[^\[\]]*+\])*+)\]"), F.lit(1))
    return F.flatten(F.transform(lists, lambda a: _commas(F.regexp_replace(a, r"^\s*\w+\s*:(?!:)\s*", ""))))


def _arguments(attribute: Column) -> Column:
    """Arguments by name; those without one are ``arg0``, ``arg1``, …"""
    named = r"^(\w+)\s*=(?!=)\s*(.*)$"
    trimmed = lambda v: F.trim(_shown(v), F.lit('"'))

    def entry(arg: Column, i: Column) -> Column:
        is_named = F.rlike(arg, F.lit(named))
        return F.struct(
            F.when(is_named, F.regexp_extract(arg, named, 1)).otherwise(
                F.concat(F.lit("arg"), i.cast("string"))
            ),
            trimmed(F.when(is_named, F.regexp_extract(arg, named, 2)).otherwise(arg)),
        )

    inside = F.regexp_extract(attribute, r"(?s)^[\w.]+\s*\((.*)\)$", 1)
    return F.map_from_entries(F.transform(_commas(inside), entry))


def extract_attributes(files: DataFrame) -> DataFrame:
    """Attributes of types, methods, properties and fields; interface members have none.

    The attribute of a field that declares several variables is given for each.
    """
    is_type = F.col("what") == "Class"
    owners = F.when(is_type, F.array(F.lit(None).cast("string"))).otherwise(F.col("names"))
    return (
        members(files)
        .where("(what = 'Class' or kind = 'class') and what <> 'Ctor' and attributes <> ''")
        .select(
            "project", "path", "type_name", F.col("line_start").alias("line"), owners.alias("_owners"),
            F.explode(_attribute_texts(F.col("attributes"))).alias("_attribute"),
        )
        .select("project", "path", "type_name", "line", "_attribute", F.explode("_owners").alias("parent_member"))
        .withColumn("name", F.regexp_extract("_attribute", r"^([\w.]+)", 1))
        .withColumn("args", _arguments(F.col("_attribute")))
        .drop("_attribute")
    )


def extract_ctor_params(files: DataFrame) -> DataFrame:
    """Parameters of the first public constructor of each class."""
    public = members(files).where("what = 'Ctor' and kind = 'class'").where(F.array_contains("modifiers", "public"))
    first = Window.partitionBy("project", "path", "type_name").orderBy("pos")
    return (
        public.withColumn("_place", F.row_number().over(first))
        .where("_place = 1")
        .select("project", "path", "type_name", F.posexplode(_parameters(F.col("rest"))).alias("pos", "p"))
        .select("project", "path", "type_name", "pos", "p.type", "p.name", "p.default")
    )


def extract_imports(files: DataFrame) -> DataFrame:
    """First namespace and distinct using directives of each file."""
    using = r"(?m)^[ \t]*using[ \t]+(?:static[ \t]+)?(?:\w+[ \t]*=[ \t]*)?([\w.]+)[ \t]*;"
    return files.select(
        "project",
        "path",
        F.regexp_extract("content", r"(?m)^[ \t]*namespace[ \t]+([\w.]+)", 1).alias("namespace"),
        F.array_distinct(F.regexp_extract_all(F.col("content"), F.lit(using), F.lit(1))).alias("usings"),
    )


def extract_bodies(files: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Code and body of every method, keyed ``Class::Method::Line``; ``read`` as in ``extract_types``.

    Texts meet their methods where both are dealt by file: the planner takes the
    texts for as small as the table they are made from, and must not send them all
    to every task.
    """
    lines = F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n")
    methods = _members_of(files, read).where("what = 'Method'").select(
        "project", "path", "type_name", F.get("names", F.lit(0)).alias("method_name"), "modifiers", "line_start", "line_end"
    )
    texts = files.select("project", "path", lines.alias("_file"))
    code = F.slice("_file", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1)
    opens = F.transform("_lines", lambda line: F.rtrim(line).endswith("{"))
    at = F.array_position(opens, F.lit(True)).cast("int")
    rest = F.filter("_lines", lambda _, i: i >= at)
    out = methods.join(texts.hint("merge"), ["project", "path"]).withColumn("_lines", code).select(
        "project", "path", F.col("type_name").alias("class_name"), "method_name", F.col("line_start").alias("line"),
        F.array_join("_lines", "\n").alias("full_code"),
        F.when(at > 0, F.array_join(rest, "\n")).otherwise(F.lit("")).alias("body"),
        *[
            F.array_contains("modifiers", word).alias(f"is_{word}")
            for word in ("async", "static", "virtual", "override", "abstract")
        ],
    )
    return out.withColumn("key", F.concat_ws("::", "class_name", "method_name", F.col("line").cast("string")))


def extract_call_sites(files: DataFrame) -> DataFrame:
    """Every invocation inside a method: callee, receiver text and line.

    Bare calls with type arguments (``Foo<T>()``) and conditional calls
    (``a?.M()``) are not seen. The receiver is null for a call on another
    expression; the line is the one the name stands on.
    """
    words = "if|while|for|foreach|switch|catch|using|lock|return|typeof|sizeof|default|when|nameof|base|this"
    generic = r"(?:<[^<>()]*+(?:<[^<>()]*+(?:<[^<>()]*+>[^<>()]*+)*+>[^<>()]*+)*+>)?"
    quote = _IN_STRING[len(_MEANT)]
    plain = r"(?<![\w.?])(?<!\bnew[ ])((?:[A-Za-z_]\w*\.)*)([A-Za-z_]\w*)\("
    through = rf"(?<![\w.?])(?<!\bnew[ ])((?:[A-Za-z_]\w*\.)+)([A-Za-z_]\w*){generic}\("
    chained = rf"((?:[)\]!{quote}][ ]*|^\s*)\.)([A-Za-z_]\w*){generic}\("
    methods = members(files).where("what = 'Method' and kind = 'class'").select(
        "project", "path", "pos", F.struct(
            F.col("type_name").alias("caller_class"), F.get("names", F.lit(0)).alias("caller_method"), "last_pos"
        ).alias("_method"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("_line"),
    )
    # The statement that heads a method counts from its arrow on.
    head_lines = F.regexp_replace(F.substring_index("text", "=>", 1), r"[^\n]++", "")
    code = F.when(F.contains("text", F.lit("=>")), F.concat(head_lines, F.substring(F.col("text"), F.instr("text", "=>"), F.length("text"))))
    rows = statements(files).select(
        "project", "path", "pos", F.lit(None).cast(methods.schema["_method"].dataType).alias("_method"),
        "text", (F.col("last_line") - _newlines(F.col("text"))).alias("_line"),
    )
    sofar = Window.partitionBy("project", "path").orderBy("pos", F.col("_method").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.lag(F.col("_method").isNotNull()).over(Window.partitionBy("project", "path").orderBy("pos", F.col("_method").isNull()))
    within = rows.union(methods).withColumns({"_in": F.last("_method", ignorenulls=True).over(sofar), "_heads": heading})
    within = within.where("text is not null and pos <= _in.last_pos").withColumn("text", F.when(F.col("_heads"), code).otherwise(F.col("text")))
    found = F.col("_call")
    prefix = F.concat(found[0], found[2], found[4])
    return (
        within.select("project", "path", "_in.caller_class", "_in.caller_method", "_line", F.posexplode(F.split("text", "\n")).alias("_i", "_code"))
        .select(
            "project", "path", "caller_class", "caller_method", (F.col("_line") + F.col("_i")).cast("int").alias("line"),
            F.explode(captures(F.col("_code"), f"{chained}|{through}|{plain}", 6)).alias("_call"),
        )
        .select(
            "project", "path", "caller_class", "caller_method", "line", F.concat(found[1], found[3], found[5]).alias("callee_method"),
            F.when(F.rlike(prefix, F.lit(r"^(?:[^\w.]|\.|\s)")), F.lit(None).cast("string"))
            .otherwise(F.rtrim(prefix, F.lit(".")))
            .alias("receiver"),
        )
        .where(~F.rlike("callee_method", F.lit(rf"^(?:{words})$")))
    )


def resolve_receiver(receiver: Column) -> Column:
    """Class a call goes to: own, base, or the root of the receiver chain."""
    root = F.split_part(receiver, F.lit("."), F.lit(1))
    return (
        F.when(receiver.isNull(), F.lit("Unknown"))
        .when((root == "") | (root == "this"), F.lit("SameClass"))
        .when(root == "base", F.lit("BaseClass"))
        .otherwise(root)
    )


def visibility_view(members: DataFrame, include_private: bool = False) -> DataFrame:
    return members if include_private else members.where(F.array_contains("modifiers", "public"))


def member_index(files: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """The long search index of a source collection, from one reading of the files; ``read`` as in ``extract_types``."""
    none = F.lit(None).cast("string")
    what, owner = F.col("what"), F.col("type_name")
    is_type, is_class = what == "Class", F.col("kind") == "class"
    empty = F.array().cast("array<string>")

    def rows(kind: Column, names: Column, parent: Column) -> Column:
        return F.transform(
            names, lambda n: F.struct(kind.alias("member_type"), n.alias("name"), parent.alias("parent"))
        )

    interfaces = F.when(is_type, _interfaces(F.col("bases"), F.col("kind"))).otherwise(empty)
    attributes = F.transform(
        F.when((is_type | is_class) & (F.col("attributes") != ""), _attribute_texts(F.col("attributes"))).otherwise(empty),
        lambda a: F.regexp_extract(a, r"^([\w.]+)", 1),
    )
    # the attribute of a field is listed once per variable
    times = F.when(is_type, F.lit(1)).otherwise(F.size("names"))
    entries = F.concat(
        rows(what, F.col("names"), F.when(is_type, none).otherwise(owner)),
        rows(F.lit("Interface"), interfaces, owner),
        rows(F.lit("Attribute"), F.flatten(F.array_repeat(attributes, times)), owner),
    )
    return (
        _members_of(files, read)
        .where("what <> 'Ctor'")
        .select("project", "path", F.col("line_start").cast("bigint").alias("line"), F.explode(entries).alias("_e"))
        .select("project", "path", "_e.parent", "_e.member_type", "_e.name", "line")
    )


# Markup ---------------------------------------------------------------------

TAG = r"<([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)>"


def page_tags(pages: DataFrame) -> DataFrame:
    """Opening tags of each page in order of appearance."""
    return pages.select(
        "project",
        "path",
        F.posexplode(F.regexp_extract_all(F.col("content"), F.lit(TAG), F.lit(0))).alias("pos", "_tag"),
    ).select(
        "project",
        "path",
        (F.col("pos") + 1).alias("tag_no"),
        F.lower(F.regexp_extract("_tag", TAG, 1)).alias("tag"),
        F.regexp_extract("_tag", TAG, 2).alias("attributes"),
    )


def tag_attributes(pages: DataFrame) -> DataFrame:
    """Attributes of each tag, one row each."""
    attribute = r'([A-Za-z-]+)="([^"]*)"'
    return (
        page_tags(pages)
        .select("project", "path", "tag_no", "tag", F.explode(
            F.regexp_extract_all(F.col("attributes"), F.lit(attribute), F.lit(0))
        ).alias("_attr"))
        .select(
            "project",
            "path",
            "tag_no",
            "tag",
            F.lower(F.regexp_extract("_attr", attribute, 1)).alias("name"),
            F.regexp_extract("_attr", attribute, 2).alias("value"),
        )
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Link targets of each page, with repeats."""
    href = r'<a\s[^>]*href="([^"]*)"'
    return pages.select(
        "project", "path", F.explode(F.regexp_extract_all(F.col("content"), F.lit(href), F.lit(1))).alias("target")
    )
