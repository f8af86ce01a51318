"""Signatures, type names, member ids, markup and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runtime type names and their short forms.
TYPE_ALIASES = {
    "System.String": "string",
    "System.Int32": "int",
    "System.Int64": "long",
    "System.Boolean": "bool",
    "System.Double": "double",
    "System.Decimal": "decimal",
    "System.Single": "float",
    "System.Byte": "byte",
    "System.SByte": "sbyte",
    "System.Int16": "short",
    "System.UInt16": "ushort",
    "System.UInt32": "uint",
    "System.UInt64": "ulong",
    "System.Char": "char",
    "System.Object": "object",
    "System.Void": "void",
}

# stand for the separator, "[]", and the ends of a finished argument
_SEP, _ARRAY, _OPEN, _CLOSE = "\u0001", "\u0002", "\u0003", "\u0004"


def parameter_list(params: Column, defaults: bool = True) -> Column:
    """``type name = default, ...`` from an array of (type, name, default)."""

    def show(p: Column) -> Column:
        text = F.concat_ws(" ", p["type"], p["name"])
        if not defaults:
            return text
        return F.concat(text, F.coalesce(F.concat(F.lit(" = "), p["default"]), F.lit("")))

    return F.array_join(F.transform(params, show), ", ")


def method_signature(returns: Column, name: Column, params: Column, defaults: bool = True) -> Column:
    return F.concat(returns, F.lit(" "), name, F.lit("("), parameter_list(params, defaults), F.lit(")"))


def declared_signature(modifiers: Column, returns: Column, name: Column, params: Column) -> Column:
    return F.concat_ws(" ", F.array_join(modifiers, " "), method_signature(returns, name, params))


def type_info(base: Column, interfaces: Column, tiered: bool = True) -> Column:
    """Base and interfaces in one line, in the wording of either scorer."""
    extends, implements, between = (
        ("Extends: ", "Implements: ", " | ") if tiered else ("extends ", "implements ", ", ")
    )
    has_base = base.isNotNull() & (base != "")
    return F.concat_ws(
        between,
        F.when(has_base, F.concat(F.lit(extends), base)),
        F.when(F.size(interfaces) > 0, F.concat(F.lit(implements), F.array_join(interfaces, ", "))),
    )


def _alias_or_last(plain: Column) -> Column:
    """Alias, or last dotted segment, of a name without generic arguments."""
    bare = F.trim(F.substring_index(plain, ",", 1))
    table = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, bare), F.substring_index(bare, ".", -1))


def _fold_generics(name: Column) -> Column:
    """Short form of ``Ns.List`1[[System.Int32, lib]]`` and deeper nests.

    Each pass cuts the innermost arguments down to their short names and folds
    the generic that holds them. There are as many passes as the name has
    argument lists, which is at least how deep it is nested.
    """
    text = F.concat(F.lit("["), F.replace(name, F.lit("[]"), F.lit(_ARRAY)), F.lit("]"))
    for full, short in TYPE_ALIASES.items():
        text = F.replace(text, F.lit(f"[{full},"), F.lit(f"[{short},"))
        text = F.replace(text, F.lit(f"[{full}]"), F.lit(f"[{short}]"))

    def fold(text: Column, _: Column) -> Column:
        text = F.regexp_replace(text, r"\[([^\[\],]+),[^\[\]]*\]", "[$1]")
        text = F.regexp_replace(text, r"\[[^\[\]<>`,]*\.([^\[\]<>.`,]+)\]", "[$1]")
        text = F.regexp_replace(text, r"\[([^\[\]`,]*)\]", f"{_OPEN}$1{_CLOSE}")
        text = F.regexp_replace(text, r"(?:[^\[\]`,]*\.)?([^\[\]`.,]+)`\d+\[([^\[\]]*)\]", "$1<$2>")
        return F.replace(text, F.lit(f"{_CLOSE},{_OPEN}"), F.lit(_SEP))

    lists = F.length(name) - F.length(F.replace(name, F.lit("[["), F.lit("[")))
    text = F.aggregate(F.sequence(F.lit(0), lists), text, fold)
    text = F.regexp_replace(text, r"^\[([^\[\]]*)\]$", "$1")
    text = F.translate(text, _OPEN + _CLOSE, "")
    return F.replace(F.replace(text, F.lit(_SEP), F.lit(", ")), F.lit(_ARRAY), F.lit("[]"))


def simplify_type_name(name: Column) -> Column:
    """Short form of a runtime type name, however deep its arguments are nested."""
    name = F.translate(name, _SEP + _ARRAY + _OPEN + _CLOSE, "")
    nullable = F.regexp_extract(name, r"System\.Nullable`1\[\[([^,\]]+)", 1)
    return (
        F.when(name.isNull() | (name == ""), F.lit("void"))
        .when(~F.contains(name, F.lit("`")), _alias_or_last(name))
        .when(nullable != "", F.concat(_alias_or_last(nullable), F.lit("?")))
        .otherwise(_fold_generics(name))
    )


def member_id_parts(member_id: Column) -> dict[str, Column]:
    """Kind letter, type segment and short name of ``M:Ns.Type.Name(args)``."""
    bare = F.regexp_replace(member_id, r"^.:", "")
    path = F.split(F.substring_index(bare, "(", 1), r"\.")
    return {
        "kind": F.regexp_extract(member_id, r"^(.):", 1),
        "type_segment": F.coalesce(F.try_element_at(path, F.lit(-2)), F.lit("")),
        "short_name": F.element_at(path, -1),
    }


def markup_to_text(markup: Column) -> Column:
    """Readable text of doc markup; null when nothing is left.

    References become the last segment of their target, named references their
    name, other tags vanish and their text stays.
    """
    target = r'(?:cref|href)="(?:[A-Z]:)?(?:[^"]*\.)?([^".]*)"'
    text = F.regexp_replace(
        markup, r"(?s)<(see|seealso)\s[^>]*?" + target + r"[^>]*?(?:/>|>.*?</\1>)", "$2"
    )
    text = F.regexp_replace(text, r'<(?:paramref|typeparamref)\s[^>]*?name="([^"]*)"[^>]*?/>', "$1")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def accessor_string(has_getter: Column, has_setter: Column) -> Column:
    return F.concat_ws(" ", F.when(has_getter, F.lit("get;")), F.when(has_setter, F.lit("set;")))


def line_label(start: Column, end: Column) -> Column:
    number = lambda c: c.cast("string")
    return (
        F.when((start == 0) & (end == 0), F.lit(""))
        .when(start == end, F.concat(F.lit("// Line "), number(start)))
        .otherwise(F.concat(F.lit("// Lines "), number(start), F.lit("-"), number(end)))
    )


def split_cache_key(key: Column) -> dict[str, Column]:
    """Package, version and framework of ``id@version@framework``."""
    part = lambda i: F.nullif(F.split_part(key, F.lit("@"), F.lit(i)), F.lit(""))
    unknown = F.lit("unknown")
    return {
        "package": F.split_part(key, F.lit("@"), F.lit(1)),
        "version": F.coalesce(part(2), unknown),
        "framework": F.coalesce(part(3), unknown),
    }


def cache_key(package: Column, version: Column, framework: Column) -> Column:
    blank = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return F.concat_ws("@", package, blank(version, "latest"), blank(framework, "net10.0"))
