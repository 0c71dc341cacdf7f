"""Symbol strings, kinds, ranges, languages and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_symbol(symbol: Column) -> Column:
    """The five fields of a symbol string, spaces kept in the last; null when there are fewer."""
    parts = F.split(symbol, " ", 5)
    names = ("scheme", "manager", "package", "version", "descriptor")
    return F.when(F.size(parts) == 5, F.struct(*[parts[i].alias(n) for i, n in enumerate(names)]))


def format_symbol(scheme: Column, manager: Column, package: Column, version: Column, descriptor: Column) -> Column:
    """Five fields as one string; a null field counts as empty, so that positions stay."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (scheme, manager, package, version, descriptor)])


def go_symbol(package: Column, version: Column, descriptor: Column) -> Column:
    return format_symbol(F.lit("scip-go"), F.lit("go"), package, version, descriptor)


def go_descriptor(package: Column, type_: Column, method: Column, field: Column, local: Column, parameter: Column) -> Column:
    """pkg, T#, M()., f., 'local x', 'param x', each only if it is there, joined without a gap."""

    def part(value: Column, before: str, after: str) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(before), value, F.lit(after))).otherwise(F.lit(""))

    return F.concat(part(package, "", ""), part(type_, "", "#"), part(method, "", "()."), part(field, "", "."), part(local, "local ", ""), part(parameter, "param ", ""))


def infer_kind(symbol: Column) -> Column:
    """Kind from the marks in the whole symbol string, tested in this order."""
    type_, call = F.contains(symbol, F.lit("#")), F.contains(symbol, F.lit("()."))
    return F.when(type_ & call, "Method").when(call, "Function").when(type_, "Type").when(F.contains(symbol, F.lit("/")), "Package").otherwise("Variable")


def display_name(symbol: Column) -> Column:
    """The name in the fifth space-separated field: after the last '#' without a closing '()', else after the
    last '/', else the field; the whole string when there are fewer than five fields."""
    parts = F.split(symbol, " ")
    descriptor = F.try_element_at(parts, F.lit(5))
    after_type = F.regexp_replace(F.element_at(F.split(descriptor, "#"), -1), r"\(\)$", "")
    after_path = F.element_at(F.split(descriptor, "/"), -1)
    named = F.when(F.contains(descriptor, F.lit("#")), after_type).when(F.contains(descriptor, F.lit("/")), after_path).otherwise(descriptor)
    return F.when(F.size(parts) < 5, symbol).otherwise(named)


# Kinds of symbol indexes to kinds of the model, and those to node labels.
KIND_OF_INDEX = {"Namespace": "Package", "Type": "Type", "Class": "Type", "Interface": "Interface", "Function": "Function", "Method": "Method", "Field": "Field", "Variable": "Variable", "Constant": "Constant", "Parameter": "Parameter"}
LABEL_OF_KIND = {"Function": "Function", "Method": "Method", "Type": "Class", "Class": "Class", "Interface": "Interface", "Package": "Module", "Module": "Module", "Parameter": "Parameter"}


def _mapped(value: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), F.lit(default))


def index_kind(kind: Column) -> Column:
    return _mapped(kind, KIND_OF_INDEX, "Variable")


def kind_label(kind: Column) -> Column:
    return _mapped(kind, LABEL_OF_KIND, "Variable")


def labels_kind(labels: Column) -> Column:
    """The kind of a node: the last of its labels that is one."""
    known = F.filter(labels, lambda x: x.isin("Function", "Method", "Class", "Interface", "Variable", "Parameter", "Module"))
    return F.when(F.size(known) > 0, F.element_at(known, -1)).otherwise("Unknown")


def range_parts(span: Column) -> Column:
    """(start_line, start_column, end_line, end_column), lines from 1 and columns from 0, of a range of four
    numbers or, on one line, three; null for any other."""
    n = F.size(span)
    at = lambda i: F.try_element_at(span, F.lit(i)).cast("long")
    return F.when(n == 4, F.struct((at(1) + 1).alias("start_line"), at(2).alias("start_column"), (at(3) + 1).alias("end_line"), at(4).alias("end_column"))).when(
        n == 3, F.struct((at(1) + 1).alias("start_line"), at(2).alias("start_column"), (at(1) + 1).alias("end_line"), at(3).alias("end_column"))
    )


def is_definition(roles: Column) -> Column:
    return roles.bitwiseAND(F.lit(1)) != 0


def language(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit(".go")), "Go").when(F.endswith(path, F.lit(".java")), "Java").when(F.endswith(path, F.lit(".py")), "Python").when(F.endswith(path, F.lit(".ts")) | F.endswith(path, F.lit(".js")), "TypeScript").otherwise("unknown")


def is_exported(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^\p{Lu}"), F.lit(False))


def scope(name: Column) -> Column:
    """'package' or 'private' of a top-level name; null for the blank name."""
    return F.when(name == "_", None).when(is_exported(name), "package").otherwise("private")


def fallback_id(path: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"), column.cast("string"))


def lines_of_code(start: Column, end: Column) -> Column:
    return F.when(end <= start, F.lit(1)).otherwise(end - start + 1).cast("long")


# Folders that a source walk leaves out.
SKIPPED_FOLDERS = ("vendor", ".git", ".github", "node_modules", ".vscode", "bin", "build", "dist", "tmp", ".idea")


def is_go_source(path: Column) -> Column:
    """A Go file that is no test, in no skipped folder."""
    folders = F.split(path, "/")
    inner = F.slice(folders, 1, F.size(folders) - 1)
    return F.endswith(path, F.lit(".go")) & ~F.endswith(path, F.lit("_test.go")) & ~F.arrays_overlap(inner, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))


def is_document(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0)).isin(".md", ".txt", ".rst", ".adoc")
