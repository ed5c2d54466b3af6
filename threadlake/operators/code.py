"""Symbols of code blocks by patterns, and files and modules merged from them. All in the JVM.

A pattern has one or two groups, of which the first that is not empty names the symbol. Of each block the first different
names stay, up to the caps; a file's names are those of its blocks in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlake.functions.text import code_language
from threadlake.operators.sessions import module_type
from threadlake.operators.summaries import PATHS

# FIXED values: patterns of symbols by language and kind, caps by kind, endings of files without a path.
_SCRIPT = {
    "functions": [r"(?m)(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\()", r"(?m)(?:export\s+)?(?:const|let)\s+(\w+)\s*[:=][^=].*=>"],
    "classes": [r"(?m)class\s+(\w+)"],
    "imports": [r"(?m)import\s+.*?from\s+['\"]([^'\"]+)['\"]"],
    "exports": [r"(?m)export\s+(?:default\s+)?(?:function|class|const|let)\s+(\w+)"],
    "dependencies": [r"(?m)import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"(?m)import\s+['\"]([^'\"]+)['\"]"],
}
SYMBOLS = {
    **dict.fromkeys(("typescript", "tsx", "javascript", "jsx", "js", "ts"), _SCRIPT),
    "python": {"functions": [r"(?m)^def\s+(\w+)"], "classes": [r"(?m)^class\s+(\w+)"], "imports": [r"(?m)^(?:import\s+(\S+)|from\s+(\S+)\s+import)"], "dependencies": [r"(?m)^(?:import\s+(\S+)|from\s+(\S+)\s+import)"]},
    "rust": {"functions": [r"(?m)(?:pub\s+)?fn\s+(\w+)"], "classes": [r"(?m)(?:pub\s+)?(?:struct|enum)\s+(\w+)"], "imports": [r"(?m)use\s+([\w:]+)"]},
    "go": {"functions": [r"(?m)func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)"], "classes": [r"(?m)type\s+(\w+)\s+struct"], "imports": [r"(?m)\"([\w./]+)\""]},
}
CAPS = {"functions": 50, "classes": 20, "imports": 30, "exports": 20, "dependencies": 20}
ENDINGS = {"typescript": "ts", "javascript": "js", "python": "py", "rust": "rs"}
_FENCE = r"(?s)```([\w-]*)[ \t]*\n(.*?)```"


def _names(code: Column, pattern: str) -> Column:
    one = F.regexp_extract_all(code, F.lit(pattern), 1)
    if pattern.replace(r"\(", "").replace("(?", "").count("(") == 1:
        return one
    return F.zip_with(one, F.regexp_extract_all(code, F.lit(pattern), 2), lambda a, b: F.when(a != "", a).otherwise(b))


def symbols(language: Column, code: Column, kind: str) -> Column:
    """The names of a kind in code, once each, in the order in which the language's patterns find them."""
    none = F.array().cast("array<string>")
    found = None
    for names in {id(v): v for v in SYMBOLS.values()}.values():
        if kind in names:
            lists = F.concat(*(_names(code, p) for p in names[kind]))
            if names is SYMBOLS["go"] and kind == "imports":
                lists = F.filter(lists, lambda x: x.contains("/"))
            elif names is _SCRIPT and kind == "dependencies":
                lists = F.filter(lists, lambda x: ~x.startswith("."))
            on = language.isin([k for k, v in SYMBOLS.items() if v is names])
            lists = F.slice(F.array_distinct(F.filter(lists, lambda x: x != "")), 1, CAPS[kind])
            found = F.when(on, lists) if found is None else found.when(on, lists)
    return none if found is None else found.otherwise(none)


def code_files(messages: DataFrame) -> DataFrame:
    """(session_id, message_index, pos, path, language, and an array for each kind) of every fenced block that is not blank.
    A block without a language has the one it looks like; one without a path is part of the language's unknown file."""
    rows = messages.filter("content IS NOT NULL").select("session_id", "message_index", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)(```[\w-]*[ \t]*\n.*?```)"), 1)).alias("pos", "fence"))
    rows = rows.withColumn("code", F.regexp_extract("fence", _FENCE, 2)).filter("trim(regexp_replace(code, '[\\\\s]+', '')) <> ''")
    named = F.regexp_extract("fence", _FENCE, 1)
    rows = rows.withColumn("language", F.when(named.isin("", "unknown"), code_language(F.col("code"))).otherwise(named))
    first = F.regexp_replace(F.element_at(F.split("code", "\n"), 1), r"^\s+|\s+\z", "")
    ending = F.coalesce(*(F.when(F.col("language") == k, F.lit(v)) for k, v in ENDINGS.items()), F.col("language"))
    path = F.coalesce(*(F.nullif(F.regexp_extract(first, p, 1), F.lit("")) for p in PATHS), F.concat(F.lit("unknown."), ending))
    return rows.select("session_id", "message_index", "pos", path.alias("path"), "language", *(symbols(F.col("language"), F.col("code"), kind).alias(kind) for kind in CAPS))


def structure(files: DataFrame) -> DataFrame:
    """(session_id, path, kind, place, name) of code_files: what each file has, the first of equal names staying. Names are
    told apart before a file's names meet, so blocks are not gathered."""
    kinds = reduce(DataFrame.unionByName, [files.select("session_id", "path", F.lit(k).alias("kind"), F.col("message_index").alias("at"), "pos", F.posexplode(k).alias("nth", "name")) for k in CAPS])
    once = kinds.groupBy("session_id", "path", "kind", "name").agg(F.min(F.struct("at", "pos", "nth")).alias("x"))
    place = F.row_number().over(Window.partitionBy("session_id", "path", "kind").orderBy("x")) - 1
    return once.select("session_id", "path", "kind", place.cast("bigint").alias("place"), "name")


def modules(files: DataFrame) -> DataFrame:
    """(session_id, name, type, files) of code_files: the files of one base name, in order, and the kind of module that the
    first of them is."""
    merged = files.groupBy("session_id", "path").agg(F.min(F.struct("message_index", "pos")).alias("first"), F.max(F.size("functions")).alias("n_functions"), F.array_distinct(F.flatten(F.collect_set("classes"))).alias("classes"))
    functions = F.when(F.col("n_functions") > 0, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>"))
    merged = merged.withColumn("type", module_type(F.col("path"), functions, F.col("classes"))).withColumn("name", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.\w+$", ""))
    found = merged.groupBy("session_id", "name").agg(F.min_by("type", "first").alias("type"), F.transform(F.array_sort(F.collect_list(F.struct("first", "path"))), lambda x: x["path"]).alias("files"))
    return found.select("session_id", "name", "type", F.array_join("files", ",").alias("files"))
