"""Code structures, captures merged over whole tables, titles and query variants, each with its own oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlake.functions import text as T
from threadlake.operators import code, merging
from threadlake.plans.operator_oracles import MESSAGES
from threadlake.plans.operator_queries import PLATFORMS, messages
from threadlake.sources import captures
from threadlake.sources.tables import table

#: Blocks of code that the words of a message name; {0} to {5} are its first words.
TEMPLATES = [
    "```python\n# src/{0}/{1}.py\nimport {2}\nfrom {3} import x\ndef {4}(a):\n    pass\nclass {5}:\n    pass\ndef {4}(b):\n    pass\n```",
    "```tsx\n// {0}/{1}.tsx\nimport {{ {2} }} from './{3}'\nimport '{4}'\nimport {5} from \"{2}\"\nexport function {0}() {{}}\nexport const {1} = (a) => a\nclass {3}Props {{}}\n```",
    "```rust\nuse std::{0};\npub struct {1} {{}}\nenum {2} {{}}\npub fn {3}() {{}}\nfn {4}() {{}}\n```\nand\n```go\n// {0}_test.go\nimport \"{1}/{2}\"\nimport \"{3}\"\ntype {4} struct {{}}\nfunc (r *{4}) {5}() {{}}\nfunc {0}() {{}}\n```",
    "```\nfunction {0}() {{ return 1 }}\nconst {1} = async (x) => x\nlet {2} = (\n```",
    "```js\nvar {0} = (1)\nexport default class {1} {{}}\n```\n```sql\nselect {2}\n```\n```\n   \n```",
]


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.expr("conv_id div 5")).alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_index"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([a-zA-Z]+)"), 1).alias("w"), F.pmod(F.col("conv_id") + F.col("turn") * 3, F.lit(len(TEMPLATES))).alias("t"))
    words = [F.coalesce(F.get("w", i), F.lit(f"w{i}")) for i in range(6)]

    def filled(template: str):
        text = F.lit(template.replace("{{", "{").replace("}}", "}"))
        for i, w in enumerate(words):
            text = F.replace(text, F.lit(f"{{{i}}}"), w)
        return text

    content = F.coalesce(*(F.when(F.col("t") == i, filled(t)) for i, t in enumerate(TEMPLATES)))
    return rows.select("session_id", "message_index", content.alias("content"))


def code_structures(spark, sf_dir):
    return code.structure(code.code_files(coded(spark, sf_dir)))


def code_modules(spark, sf_dir):
    return code.modules(code.code_files(coded(spark, sf_dir)))


def merged_captures(spark, sf_dir):
    """What is stored of each conversation and what comes in, by id first."""
    return merging.merge_captures(captures.stored(spark, sf_dir), captures.incoming(spark, sf_dir), 300, 1500).select("session_id", "place", "message_id", "role", F.md5("content").alias("md5"))


def derived_titles(spark, sf_dir):
    """The first request in 72 characters on one line, or else the first message, or else the platform's name."""
    m = messages(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    head = T.collapsed(F.substring("content", 1, 2000))
    first = m.groupBy("session_id").agg(F.min_by(head, F.when(F.col("role") == "user", F.col("message_index"))).alias("asked"), F.max(F.col("role") == "user").alias("has"), F.min_by(head, "message_index").alias("any"))
    text = F.when(F.col("has"), F.col("asked")).otherwise(F.col("any"))
    label = F.element_at(F.array(*map(F.lit, PLATFORMS)), (F.col("session_id") % 6 + 1).cast("int"))
    return first.select("session_id", F.when(text == "", F.concat(F.initcap(label), F.lit(" session"))).when(F.length(text) > 72, F.concat(F.substring(text, 1, 71), F.lit("…"))).otherwise(text).alias("title"))


def query_variants(spark, sf_dir):
    rows = messages(spark, sf_dir).filter("role = 'user'").select("session_id", "message_index", F.substring(F.coalesce("content", F.lit("")), 1, 200).alias("task"))
    return rows.select("session_id", "message_index", F.posexplode(T.query_variants(F.col("task"))).alias("place", "variant"))


def _sql_list(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for n in names) + "]"


_TEXTS = [t.replace("{{", "{").replace("}}", "}") for t in TEMPLATES]
_FILLED = "t"
for _i in range(6):
    _FILLED = f"replace({_FILLED}, '{{{_i}}}', coalesce(w[{_i + 1}], 'w{_i}'))"
_KINDS = ("functions", "classes", "imports", "exports", "dependencies")


def _found(kind: str) -> str:
    """The SQL list of a kind's names, by language."""
    pick = lambda p, g=1: f"regexp_extract_all(code, '{p}', {g})"
    either = lambda p: f"list_transform(list_zip({pick(p, 1)}, {pick(p, 2)}), lambda z: CASE WHEN z[1] <> '' THEN z[1] ELSE z[2] END)"
    quoted = "[''\"]([^''\"]+)[''\"]"
    script = {
        "functions": f"list_concat({either('(?:function[ \\t\\n]+([0-9A-Za-z_]+)|(?:const|let|var)\\s+(\\w+)\\s*=\\s*(?:async\\s*)?\\()')}, {pick('(?:export\\s+)?(?:const|let)\\s+(\\w+)\\s*[:=][^=].*=>')})",
        "classes": pick("class\\s+(\\w+)"),
        "imports": pick("import\\s+.*?from\\s+" + quoted),
        "exports": pick("export\\s+(?:default\\s+)?(?:function|class|const|let)\\s+(\\w+)"),
        "dependencies": f"list_filter(list_concat({pick('import\\s+.*?from\\s+' + quoted)}, {pick('import\\s+' + quoted)}), lambda z: NOT starts_with(z, '.'))",
    }[kind]
    load = "(?m)^(?:import\\s+(\\S+)|from\\s+(\\S+)\\s+import)"
    python = {"functions": pick("(?m)^def\\s+(\\w+)"), "classes": pick("(?m)^class\\s+(\\w+)"), "imports": either(load), "dependencies": either(load)}.get(kind, "[]")
    rust = {"functions": pick("fn\\s+(\\w+)"), "classes": pick("(?:struct|enum)\\s+(\\w+)"), "imports": pick("use\\s+([\\w:]+)")}.get(kind, "[]")
    go = {"functions": pick("func\\s+(?:\\(\\w+\\s+\\*?\\w+\\)\\s+)?(\\w+)"), "classes": pick("type\\s+(\\w+)\\s+struct"), "imports": f"list_filter({pick('\"([\\w./]+)\"')}, lambda z: contains(z, '/'))"}.get(kind, "[]")
    return f"CASE WHEN language IN ('typescript', 'tsx', 'javascript', 'jsx', 'js', 'ts') THEN {script} WHEN language = 'python' THEN {python} WHEN language = 'rust' THEN {rust} WHEN language = 'go' THEN {go} ELSE [] END"


_LOOKS = "CASE WHEN regexp_matches(code, 'import React|ReactDOM|jsx|tsx|<\\w+\\s*/>') THEN 'typescript' WHEN regexp_matches(code, 'def\\s+\\w+\\(|from\\s+\\w+\\s+import|print\\(') THEN 'python' WHEN regexp_matches(code, 'fn\\s+\\w+|let mut |impl\\s+\\w+|use std::') THEN 'rust' WHEN regexp_matches(code, 'func\\s+\\w+|package\\s+\\w+|:=|fmt\\.') THEN 'go' WHEN regexp_matches(code, 'class\\s+\\w+|function\\s+\\w+|const\\s+\\w+\\s*=') THEN 'javascript' ELSE 'unknown' END"
_FILES = f"""raw AS (SELECT conv_id // 5 AS session_id, conv_id * 1000 + turn AS at_i, regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+') AS w, {_sql_list(_TEXTS)}[(conv_id + turn * 3) % {len(TEMPLATES)} + 1] AS t FROM conversations),
    msg AS (SELECT session_id, at_i, regexp_extract_all({_FILLED}, '(?s)```[\\w-]*[ \\t]*\\n.*?```') AS fs FROM raw), fences AS (SELECT session_id, at_i, unnest(fs) AS f, generate_subscripts(fs, 1) - 1 AS pos FROM msg),
    blocks AS (SELECT *, regexp_extract(f, '^```([\\w-]*)', 1) AS named, regexp_replace(regexp_replace(f, '^```[\\w-]*[ \\t]*\\n', ''), '```$', '') AS code FROM fences),
    langs AS (SELECT *, CASE WHEN named = '' THEN {_LOOKS} ELSE named END AS language, trim(split_part(code, chr(10), 1)) AS head FROM blocks WHERE regexp_matches(code, '\\S')),
    files AS (SELECT *, coalesce(nullif(regexp_extract(head, '^(?://|#|--)\\s+([\\w./\\\\-]+\\.\\w+)\\s*$', 1), ''), 'unknown.' || CASE language WHEN 'typescript' THEN 'ts' WHEN 'javascript' THEN 'js' WHEN 'python' THEN 'py' WHEN 'rust' THEN 'rs' ELSE language END) AS path FROM langs),
    lists AS ({' UNION ALL '.join(f"SELECT session_id, path, at_i, pos, '{k}' AS kind, {_found(k)} AS l FROM files" for k in _KINDS)}),
    names AS (SELECT session_id, path, kind, at_i, pos, unnest(l) AS name, generate_subscripts(l, 1) AS nth FROM lists)"""
_STOP = "the a an is are was were be been have has had do does did will would could should may might can this that these those which who what where when how and or but not if then than so as at by for in of on to up from with about i you we they me my".split()
ORACLES = {
    "code_structures": f"""WITH {_FILES}, once AS (SELECT * FROM names WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY session_id, path, kind, name ORDER BY at_i, pos, nth) = 1)
        SELECT session_id, path, kind, row_number() OVER (PARTITION BY session_id, path, kind ORDER BY at_i, pos, nth) - 1 AS place, name FROM once""",
    "code_modules": f"""WITH {_FILES}, p AS (SELECT session_id, path, min(at_i * 100 + pos) AS first_at FROM files GROUP BY ALL),
        k AS (SELECT *, lower(path) AS u, EXISTS (SELECT 1 FROM names n WHERE n.session_id = p.session_id AND n.path = p.path AND kind = 'functions') AS f, EXISTS (SELECT 1 FROM names n WHERE n.session_id = p.session_id AND n.path = p.path AND kind = 'classes') AS c,
            EXISTS (SELECT 1 FROM names n WHERE n.session_id = p.session_id AND n.path = p.path AND kind = 'classes' AND regexp_matches(name, 'Props|Component')) AS shown FROM p),
        t AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.\\w+$', '') AS name, CASE WHEN regexp_matches(u, '\\.test\\.|\\.spec\\.|__tests__') THEN 'test' WHEN regexp_matches(u, 'config|settings|\\.env') THEN 'config' WHEN regexp_matches(u, 'components?/|\\.tsx$') OR shown THEN 'component'
            WHEN regexp_matches(u, 'service|api|client|fetch|http') THEN 'service' WHEN regexp_matches(u, 'util|helper|lib/|shared') OR (f AND NOT c) THEN 'util' ELSE 'unknown' END AS type FROM k)
        SELECT session_id, name, arg_min(type, first_at) AS type, string_agg(path, ',' ORDER BY first_at) AS files FROM t GROUP BY session_id, name""",
    "merged_captures": f"""WITH {captures.SQL}, c AS (SELECT session_id, source, message_index, {{'id': message_id, 'role': role, 'content': CASE WHEN source = 'incoming' AND length(content) > 300 THEN content[:300] || chr(10) || chr(10) || '[content truncated at 300 chars]' ELSE content END}} AS m FROM captures),
        s AS (SELECT session_id, coalesce(list(m ORDER BY message_index) FILTER (source = 'stored'), []) AS prior, coalesce(list(m ORDER BY message_index) FILTER (source = 'incoming'), []) AS fresh, coalesce(sum(length(m.content)) FILTER (source = 'stored'), 0) AS n FROM c GROUP BY session_id),
        r AS (SELECT session_id, CASE WHEN n >= 1500 THEN prior ELSE list_reduce(list_prepend({{'o': prior, 'm': NULL}}, list_transform(fresh, lambda f: {{'o': []::STRUCT(id VARCHAR, role VARCHAR, content VARCHAR)[], 'm': f}})), lambda a, e: {{'o': CASE
            WHEN e.m.id IS NOT NULL AND list_contains(list_transform(a.o, lambda p: p.id), e.m.id) THEN list_transform(a.o, lambda p, j: CASE WHEN j = list_position(list_transform(a.o, lambda p2: p2.id), e.m.id) AND length(e.m.content) >= length(p.content) THEN e.m ELSE p END)
            WHEN list_contains(list_transform(a.o, lambda p: p.role || '::' || trim(regexp_replace(left(p.content, 80), '\\s+', ' ', 'g'))), e.m.role || '::' || trim(regexp_replace(left(e.m.content, 80), '\\s+', ' ', 'g')))
                THEN list_transform(a.o, lambda p, j: CASE WHEN j = list_position(list_transform(a.o, lambda p2: p2.role || '::' || trim(regexp_replace(left(p2.content, 80), '\\s+', ' ', 'g'))), e.m.role || '::' || trim(regexp_replace(left(e.m.content, 80), '\\s+', ' ', 'g'))) AND length(e.m.content) >= length(p.content) THEN e.m ELSE p END)
            ELSE list_append(a.o, e.m) END, 'm': NULL}}).o END AS o FROM s)
        SELECT session_id, place, o[place + 1].id AS message_id, o[place + 1].role AS role, md5(o[place + 1].content) AS md5 FROM (SELECT session_id, o, unnest(range(0, len(o))) AS place FROM r)""",
    "derived_titles": f"""WITH {MESSAGES}, m AS (SELECT session_id, message_index, role, trim(regexp_replace(left(coalesce(content, ''), 2000), '\\s+', ' ', 'g')) AS t FROM messages),
        f AS (SELECT session_id, coalesce(arg_min(t, message_index) FILTER (role = 'user'), arg_min(t, message_index)) AS t FROM m GROUP BY session_id)
        SELECT session_id, CASE WHEN t = '' THEN ['Chatgpt', 'Claude', 'Grok', 'Gemini', 'Deepseek', 'Perplexity'][session_id % 6 + 1] || ' session' WHEN length(t) > 72 THEN t[:71] || '…' ELSE t END AS title FROM f""",
    "query_variants": f"""WITH {MESSAGES}, q AS (SELECT session_id, message_index, left(coalesce(content, ''), 200) AS task FROM messages WHERE role = 'user'),
        k AS (SELECT *, array_to_string(list_filter(string_split_regex(lower(task), '\\W+'), lambda w: length(w) > 2 AND NOT list_contains({_sql_list(_STOP)}, w))[:6], ' ') AS k FROM q),
        v AS (SELECT *, list_concat([task], CASE WHEN k <> '' AND k <> lower(task) THEN [k, 'implementing ' || k] ELSE [] END, [CASE WHEN regexp_matches(task, '(?i)error|bug|fix|fail|issue|crash|broken') THEN 'error debugging ' ELSE 'code for ' END || k]) AS l FROM k)
        SELECT session_id, message_index, (generate_subscripts(l, 1) - 1)::INT AS place, unnest(l) AS variant FROM v""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
